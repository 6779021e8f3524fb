"""Registered queries through the sources, the store and the sinks: archives, the paged search, streams, touched parts, ordered files."""

from __future__ import annotations

import datetime as dt
import json
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.functions.text import fold
from lastro.operators import export, ingest, postings, quality, search
from lastro.operators.order import numbered
from lastro.plans import driver_tables as D
from lastro.plans.catalog import FOUND, TEXT_FILTERS, query
from lastro.plans.loading import FULL_MERGE, REPORTS_OF_LINES, fidc_tables, fii_extracts
from lastro.session import shared_folder
from lastro.sources import csvzip, paged
from lastro.store import Store
from lastro.streaming import running, sync


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df by way of a table in the shared folder."""
    folder = shared_folder(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


# Archives


def member_lines(rows: DataFrame, archive, member: str) -> tuple[DataFrame, dict[str, str]]:
    """A table's rows as lines of a CSV member, and its header, which the writer puts before them in each archive that has rows."""
    columns = tuple(c for c in rows.columns if c != "row_idx")
    text = rows.select(*columns, F.col("row_idx").alias("place"), archive.alias("archive"))
    return export.csv_lines(text, columns, ("archive", "place")).withColumn("member", F.lit(member)), {member: export.SEPARATOR.join(columns)}


def write_members(members: list[tuple[DataFrame, dict[str, str]]], folder: str) -> None:
    lines = reduce(DataFrame.unionByName, [rows for rows, _ in members])
    csvzip.write_archives(lines, folder, {k: v for _, titles in members for k, v in titles.items()}).collect()  # a row per archive


@query(FULL_MERGE)
def archive_reports(spark, d):
    """The three extracts as a year's archives, written by Spark and read back a member a task."""
    folder = shared_folder(spark, "archives")
    names = ("inf_mensal_fii_geral.csv", "inf_mensal_fii_complemento.csv", "inf_mensal_fii_ativo_passivo.csv")
    year = F.concat(F.lit("inf_mensal_fii_"), F.substring("Data_Referencia", 1, 4), F.lit(".zip"))
    write_members([member_lines(t, year, n) for t, n in zip(fii_extracts(spark, d), names, strict=True)], folder)
    tables = [csvzip.table(spark, f"{folder}/inf_mensal_fii_*.zip", token=t) for t in ("geral", "complemento", "ativo_passivo")]
    return ingest.fii_reports(*tables)[0].select("cnpj", "competencia", "versao", "num_cotistas", "pl", "valor_cota", "fonte")


@query(REPORTS_OF_LINES)
def archive_fidc(spark, d):
    """A year's archives of three tables, one of them with a class column, by way of ZIP files; a task writes a year and reads a member of it."""
    folder = shared_folder(spark, "archives")
    year = F.concat(F.lit("inf_mensal_fidc_"), F.substring("DT_COMPTC", 1, 4), F.lit(".zip"))
    write_members([member_lines(table, year, f"{name}.csv") for name, table in fidc_tables(spark, d)], folder)
    tables = csvzip.tables(spark, f"{folder}/inf_mensal_fidc_*.zip")
    return ingest.fidc_reports(tables)[0].select("cnpj", "competencia", "pl", "num_cotistas", "fonte")


# The paged search


def keep_answers(records: DataFrame, searches: list[paged.Search], folder: str, size: int) -> None:
    """Stores the answers to requests about records (tipo, cnpj, id_categoria, entrega, id and value, their JSON), pages of `size`, for paged.stored()."""
    for search in searches:
        mine = records.filter(F.col("tipo") == search.tipo)
        for name in ("cnpj", "id_categoria"):
            if getattr(search, name) is not None:
                mine = mine.filter(F.col(name) == getattr(search, name))
        if search.desde:
            mine = mine.filter(F.col("entrega") >= F.to_timestamp_ntz(F.lit(search.desde), F.lit("dd/MM/yyyy")))
        if search.ate:
            mine = mine.filter(F.col("entrega") < F.to_timestamp_ntz(F.lit(search.ate), F.lit("dd/MM/yyyy")) + F.expr("interval 1 day"))
        if search.ordem == "desc":
            newest = mine.orderBy(F.col("entrega").desc(), F.col("id").desc()).limit(1)
            pages = newest.groupBy().agg(F.collect_list("value").alias("rows"), F.count(F.lit(1)).alias("total")).withColumn("page", F.lit(0).cast("long"))
        else:
            ordered = numbered(mine.select("entrega", "id", "value"), ["entrega", "id"], partial(written, records.sparkSession))
            total = ordered.count()
            pages = ordered.groupBy(F.floor(F.col("number") / size).alias("page")).agg(F.array_sort(F.collect_list(F.struct("number", "value"))).alias("r")).select("page", F.col("r.value").alias("rows"), F.lit(total).alias("total"))
            if not total:
                pages = records.sparkSession.createDataFrame([(0, [], 0)], "page long, rows array<string>, total long")
        body = F.concat(F.lit('{"recordsFiltered": '), F.col("total").cast("string"), F.lit(', "data": ['), F.array_join("rows", ", "), F.lit("]}"))
        lines = pages.select(F.lit(search.name()).alias("request"), F.floor(F.col("page") / paged.SPAN).alias("pages"), F.concat(F.col("page").cast("string"), F.lit(" "), body).alias("value"))
        lines.hint("rebalance", "pages").write.mode("append").partitionBy("request", "pages").text(folder)


#: Documents' types and categories in the service, by language and source; days that a search or a cursor names.
TYPES = {"en": "1", "de": "2", "fr": "3", "es": "4"}
SINCE, UNTIL = dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 2, 6)
CURSORS = {"1": "2024-01-02T00:00:00", "2": "2024-01-01T20:00:00", "all": "2024-01-02T12:00:00"}
TYPE_OF = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END"
RECORDS = f"(SELECT id_fnet, cnpj, {TYPE_OF} AS tipo, data_entrega, CAST(id_fnet % 3 + 1 AS INTEGER) AS cat FROM (SELECT *, categoria AS lang FROM {D.DOCUMENTS}))"


def records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the document service made of the documents' metadata, in its own forms."""
    rows = D.documents(spark, d)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), F.col("categoria"))
    record = F.struct(
        F.col("id_fnet").cast("string").alias("id"), F.col("cnpj").alias("cnpjFundo"), F.col("categoria").alias("categoriaDocumento"), F.date_format("data_entrega", "dd/MM/yyyy HH:mm").alias("dataEntrega"),
        F.concat(F.lit("FUNDO "), "cnpj").alias("descricaoFundo"),
    )
    return rows.filter(kind.isNotNull()).select(kind.alias("tipo"), "cnpj", (F.col("id_fnet") % 3 + 1).cast("int").alias("id_categoria"), F.col("data_entrega").alias("entrega"), F.col("id_fnet").alias("id"), F.to_json(record).alias("value"))


@query(f"SELECT id_fnet, cnpj, tipo, data_entrega FROM {RECORDS} WHERE tipo IN ('1', '3') AND cat = 2 AND data_entrega >= TIMESTAMP '{SINCE}' AND data_entrega < TIMESTAMP '{UNTIL}'")
def paged_search(spark, d):
    """Types, a category and bounds on the delivery go into the requests: only answers to these are stored."""
    folder = shared_folder(spark, "answers")
    asked = [paged.Search(t, id_categoria=2, desde=paged.day_text(SINCE), ate=paged.day_text(UNTIL)) for t in ("1", "3")]
    keep_answers(records(spark, d), asked, folder, 50)
    return search_pages(spark, folder)


def search_pages(spark: SparkSession, folder: str) -> DataFrame:
    paged.register(spark)
    raw = spark.read.format("documents").options(tipos=",".join(TYPES.values()), files=folder, size="50", tasks="4").load()
    found = raw.filter(F.col("tipo").isin("1", "3") & (F.col("id_categoria") == 2) & (F.col("entrega") >= F.lit(SINCE).cast("timestamp_ntz")) & (F.col("entrega") < F.lit(UNTIL).cast("timestamp_ntz")))
    return sync.fetched(found).select("id_fnet", "cnpj", "tipo", "data_entrega")


def cursor_of(tipo: str) -> dt.datetime:
    return dt.datetime.fromisoformat(CURSORS.get(tipo, CURSORS["all"]))


BEGINS = "CASE tipo " + " ".join(f"WHEN '{t}' THEN TIMESTAMP '{cursor_of(t) - paged.OVERLAP}'" for t in TYPES.values()) + " END"


@query(f"""WITH r AS (SELECT * FROM {RECORDS} WHERE tipo IS NOT NULL), n AS (SELECT tipo, max(data_entrega) AS newest FROM r GROUP BY tipo)
SELECT id_fnet, cnpj, data_entrega, 'pendente' AS status_download FROM r JOIN n USING (tipo) WHERE data_entrega >= {BEGINS} AND newest > {BEGINS} + INTERVAL 1 DAY""")
def stream_cursors(spark, d):
    """A stream from stored cursors, one of an older store among them, into the store's touched parts."""
    folder, own = shared_folder(spark, "answers"), shared_folder(spark, "store")
    made = written(spark, records(spark, d))
    newest = {r.tipo: r.m for r in made.groupBy("tipo").agg(F.max("entrega").alias("m")).collect()}  # four types
    asked = [paged.Search(t, ordem="desc") for t in TYPES.values()]
    asked += [paged.Search(t, desde=paged.day_text(cursor_of(t) - paged.OVERLAP), ate=paged.day_text(newest[t])) for t in TYPES.values() if t in newest]
    keep_answers(made, asked, folder, 50)
    paged.register(spark)
    raw = spark.readStream.format("documents").options(tipos=",".join(TYPES.values()), files=folder, size="50", tasks="4", cursors=json.dumps(CURSORS)).load()
    query_ = sync.stream_documents(sync.fetched(raw), Store(spark, own), f"{own}/checkpoint", name=f"stream-{own[-8:]}", types=list(TYPES.values()))
    query_.awaitTermination()
    return Store(spark, own).read("documentos").select("id_fnet", "cnpj", "data_entrega", "status_download")


# The store


def synced(spark: SparkSession, d: str) -> Store:
    """A store of all documents, and then a sync of some that changed and some that are new."""
    store = Store(spark, shared_folder(spark, "store"))
    docs = D.documents(spark, d)
    store.write("documentos", docs)
    fresh = docs.filter("status_download = 'erro'").select(F.expr("id_fnet + 10000000").alias("id_fnet"), "cnpj", "categoria", "data_entrega", F.lit(0).alias("arrival"))
    changed = docs.filter(CHANGED).select("id_fnet", "cnpj", F.lit("novo").alias("categoria"), "data_entrega", F.lit(1).alias("arrival"))
    sync.merge_documents(store, fresh.unionByName(changed))
    return store


NEW = f"SELECT id_fnet + 10000000 AS id_fnet, cnpj, categoria, 'pendente' AS status_download FROM {D.DOCUMENTS} WHERE status_download = 'erro'"
CHANGED = "categoria = 'es' AND id_fnet < 100"


@query(f"SELECT id_fnet, cnpj, CASE WHEN {CHANGED} THEN 'novo' ELSE categoria END AS categoria, status_download FROM {D.DOCUMENTS} UNION ALL {NEW}")
def touched_upsert(spark, d):
    """The rows of the store after a sync that rewrote the parts that it touched."""
    return synced(spark, d).read("documentos").select("id_fnet", "cnpj", "categoria", "status_download")


@query(f"SELECT strftime(competencia, '%Y%m') AS parte, CASE WHEN year(any_value(competencia)) = 1997 THEN 'v2' ELSE 'v1' END AS versao, count(*) AS informes, count(*) FILTER (num_cotistas = -1) + CASE WHEN year(any_value(competencia)) = 1997 THEN count(*) ELSE 0 END AS novos FROM {D.REPORTS} GROUP BY 1")
def touched_parts(spark, d):
    """Which version each part of a table is of, and its rows: a year's reports that come again rewrite that year's months and no others."""
    store = Store(spark, shared_folder(spark, "store"))
    reports = D.reports(spark, d)
    store.write("informes_mensais", reports)
    store.merge("informes_mensais", reports.filter(F.year("competencia") == 1997).select("cnpj", "competencia", F.lit(-1).alias("num_cotistas")), ["cnpj", "competencia"], ["num_cotistas"])
    versions = spark.createDataFrame(sorted(store.versions("informes_mensais").items()), "parte string, versao string")
    rows = store.read("informes_mensais").groupBy(F.date_format("competencia", "yyyyMM").alias("parte")).agg(F.count(F.lit(1)).alias("informes"), F.count_if(F.col("num_cotistas") == -1).alias("novos"))
    return versions.join(rows, "parte")


# The index of tokens


def indexed(spark: SparkSession, d: str) -> Store:
    """A store of the texts and their index: all of them, then some again."""
    store = Store(spark, shared_folder(spark, "store"))
    texts = D.texts(spark, d).select("id_fnet", "texto", "texto_norm", "origem")
    store.write("documento_textos", texts.drop("texto_norm"), late=lambda rows: rows.withColumn("texto_norm", fold(F.col("texto"))))
    postings.index_texts(store, texts)
    return store


@query(f"SELECT token, count(*) AS n FROM (SELECT id_fnet, unnest(list_distinct(regexp_extract_all(texto_norm, '[0-9a-z]+'))) AS token FROM {D.TEXTS}) GROUP BY token")
def indexed_tokens(spark, d):
    """How many documents each token of the index has, after some were indexed twice."""
    store = indexed(spark, d)
    postings.index_texts(store, store.read("documento_textos").filter("origem = 'vazio'"))
    return store.read("documento_tokens").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT cnpj, any_value(pl_medio_12m) AS pl_medio_12m, count(*) AS n_documentos, max(id_fnet) AS maior_id FROM {FOUND} GROUP BY cnpj")
def indexed_search(spark, d):
    """The same search as without an index; texts are read of the index's candidates alone."""
    store = indexed(spark, d)
    found = postings.candidates(store, list(TEXT_FILTERS.termos), flexible=False)
    out = search.search_text(D.funds(spark, d), D.metrics(spark, d), D.documents(spark, d), postings.texts_of(store, found), TEXT_FILTERS)
    return out.select("cnpj", "pl_medio_12m", F.size("documentos").cast("bigint").alias("n_documentos"), F.array_max(F.transform("documentos", lambda x: x["id_fnet"])).alias("maior_id"))


# Running metrics


@query(f"SELECT cnpj, competencia_ultima, pl_atual, pl_medio_12m, cotistas_atual FROM {D.METRICS}")
def running_metrics(spark, d):
    """The metrics from a stream of reports that arrive a year at a time, the later ones first, and each year's first with other values."""
    folder, own = shared_folder(spark, "reports"), shared_folder(spark, "store")
    reports = D.reports(spark, d)
    year = F.year("competencia")
    wrong = reports.withColumns({"pl": (F.col("pl") + 1).cast("decimal(20,2)"), "num_cotistas": F.lit(None).cast("int"), "arrival": F.lit(0).cast("long")})
    # A file a year is read in a micro-batch of its own, the newest file last.
    both = wrong.filter(year % 2 == 0).unionByName(reports.withColumn("arrival", F.lit(1).cast("long"))).withColumn("year", year)
    both.repartition("year").write.partitionBy("year").parquet(folder)
    kind = "cnpj string, competencia date, pl decimal(20,2), num_cotistas int, arrival long, year int"
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(folder)
    store = Store(spark, own)
    running.keep_metrics(spark, stream, store, f"{own}/checkpoint", name=f"metrics-{own[-8:]}").awaitTermination()
    return store.read("fundos_metricas").select("cnpj", "competencia_ultima", "pl_atual", "pl_medio_12m", "cotistas_atual")


# Sinks and checks


@query(f"SELECT 'cnpj;denominacao;situacao' AS value, CAST(0 AS BIGINT) AS line UNION ALL SELECT cnpj || ';' || denominacao || ';' || situacao, row_number() OVER (ORDER BY situacao DESC, cnpj) FROM {D.FUNDS}")
def ordered_file(spark, d):
    """A spreadsheet in parts, and its lines in the order of the parts' names; the reader takes the mark of UTF-8 away."""
    folder = shared_folder(spark, "export")
    export.write_ordered(D.funds(spark, d).select("cnpj", "denominacao", "situacao"), ("-situacao", "cnpj"), folder)
    lines = spark.read.option("lineSep", export.END).text(folder).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return numbered(written(spark, lines), ["file", "block", "at"], partial(written, spark)).select("value", F.col("number").alias("line"))


@query("SELECT count(*) AS rows, count(*) FILTER (c_acctbal >= 0) AS saldo, count(*) FILTER (c_nationkey % 3 <> 0) AS pais FROM customer")
def observed_fill(spark, d):
    """Counts of filled values that are taken while the rows are written."""
    rows = D.read(spark, d, "customer").select(F.expr("if(c_acctbal >= 0, c_acctbal, null)").alias("saldo"), F.expr("if(c_nationkey % 3 = 0, '', 'x')").alias("pais"))
    rows, seen = quality.observed(rows, ("saldo", "pais"), "fill")
    written(spark, rows)
    quality.require(seen, {"saldo": 0.0})()
    return spark.createDataFrame([seen.get], "rows long, saldo long, pais long")
