"""Spreadsheets of search results and surveys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.operators.classify import DOCUMENT_URL

#: Columns of the search export (fixed values).
COLUMNS = (
    "cnpj", "denominacao", "tipo_veiculo", "publico_alvo", "situacao", "administrador", "gestor", "segmento", "pl_atual", "pl_medio_12m",
    "cotistas_atual", "competencia_ultima", "documento_id", "documento_categoria", "documento_data_referencia", "documento_url", "possivel_vedacao", "trechos",
)
BOM, SEPARATOR, END = "﻿", ";", "\r\n"


def export_rows(found: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """One row per document of each fund, COLUMNS all as text; a fund without documents has one row.

    order: columns that stay beside the text as ordem_<name>; `documento` is a document's place.
    """
    if "documentos" not in found.columns:
        found = found.withColumn("documentos", F.lit(None).cast("array<struct<id_fnet:bigint,categoria:string,competencia:date,trechos:array<struct<texto:string,possivel_vedacao:boolean>>>>"))
    rows = found.select("*", F.posexplode_outer("documentos").alias("place", "d"))
    there = F.col("d").isNotNull()
    flagged = F.when(F.coalesce((F.size("d.trechos") > 0) & F.forall("d.trechos", lambda t: t["possivel_vedacao"]), F.lit(False)), "sim").otherwise("nao")
    values = {
        "documento_id": F.col("d.id_fnet"), "documento_categoria": F.col("d.categoria"), "documento_data_referencia": F.col("d.competencia"),
        "documento_url": F.when(there, F.concat(F.lit(DOCUMENT_URL), F.col("d.id_fnet").cast("string"))), "possivel_vedacao": F.when(there, flagged),
        "trechos": F.when(there, F.array_join(F.transform("d.trechos", lambda t: t["texto"]), " ||| ")),
    }
    kept = [F.col("place" if c == "documento" else c).alias(f"ordem_{c}") for c in order]
    return rows.select(*[F.coalesce(values.get(c, F.col(c)).cast("string"), F.lit("")).alias(c) for c in COLUMNS], *kept)


def csv_cell(c: Column) -> Column:
    """Quoted only if it holds a quote, a separator or a line end."""
    return F.when(c.rlike('[";\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(rows: DataFrame, columns: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one line, column value, of the columns (default: all), beside the columns to keep."""
    columns = tuple(rows.columns) if columns is None else columns
    return rows.select(F.concat_ws(SEPARATOR, *[csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("value"), *keep)


def write_ordered(rows: DataFrame, order: tuple[str, ...], folder: str, columns: tuple[str, ...] | None = None) -> None:
    """All rows in an order as one spreadsheet in parts: joined by their names they are the file.

    The rows are sorted over ranges, so no task holds all of them; the mark of UTF-8 and the header
    are the first line of the first part, and lines end as on Windows. order: names of columns, `-`
    before a name for the largest first; nulls come last. columns: those to write (default: all).
    """
    columns = tuple(rows.columns) if columns is None else columns
    keys = {f"key_{i}": o for i, o in enumerate(order)}
    lines = csv_lines(rows.withColumns({k: F.col(o.removeprefix("-")) for k, o in keys.items()}), columns, tuple(keys))
    title = rows.sparkSession.createDataFrame([(BOM + SEPARATOR.join(columns),)], "value string").withColumn("after", F.lit(0))
    both = title.unionByName(lines.withColumn("after", F.lit(1)), allowMissingColumns=True)
    directed = [F.col(k).desc_nulls_last() if o.startswith("-") else F.col(k).asc_nulls_last() for k, o in keys.items()]
    both.orderBy("after", *directed).select("value").write.option("lineSep", END).text(folder)


def join_parts(spark: SparkSession, folder: str, target: str) -> int:
    """Joins the parts that write_ordered left into one file, by a copy that holds a buffer alone; returns its bytes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    source = path(folder).getFileSystem(conf)
    files = path(target).getFileSystem(conf)
    out = files.create(path(target), True)
    try:
        for name in sorted(s.getPath().getName() for s in source.listStatus(path(folder))):
            if name.startswith("part-"):
                part = source.open(path(f"{folder}/{name}"))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                finally:
                    part.close()
    finally:
        out.close()
    return files.getFileStatus(path(target)).getLen()


def file_name(terms: list[str]) -> str:
    base = "fundos"
    if terms:
        base = re.sub(r"^-|-$", "", re.sub(r"[^\w\-]+", "-", terms[0], flags=re.ASCII)).lower()
    return f"fundos-{base or 'consulta'}.csv"


def json_rows(found: DataFrame) -> DataFrame:
    return found.select(F.to_json(F.struct("*")).alias("value"))
