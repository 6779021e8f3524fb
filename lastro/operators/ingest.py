"""Which row wins: reconciling registry and monthly-report extracts.

Every input has row_idx, the row's place in its file, and where several files are
read file_idx, the file's place in its archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastro.functions import parsing as P
from lastro.functions.text import fold

#: A registry row counts as active in the first sense if its situation is this (fixed value).
ACTIVE = "EM FUNCIONAMENTO NORMAL"
#: Candidate columns (fixed values).
FUND_ID = ("CNPJ_FUNDO", "CNPJ_FUNDO_CLASSE")
MONTH = ("DATA_REFERENCIA", "DT_COMPTC")
REGISTRY = {
    "cnpj": FUND_ID, "denominacao": ("DENOM_SOCIAL",), "tipo": ("TP_FUNDO", "TP_FUNDO_CLASSE"), "situacao": ("SIT",), "administrador": ("ADMIN",),
    "gestor": ("GESTOR",), "publico_alvo": ("PUBLICO_ALVO",), "classe_cvm": ("CLASSE",), "dt_registro": ("DT_REG",),
}
GENERAL = {"cnpj": FUND_ID, "competencia": MONTH, "versao": ("VERSAO",), "publico_alvo": ("PUBLICO_ALVO",), "segmento": ("SEGMENTO_ATUACAO",), "denominacao": ("NOME_FUNDO_CLASSE", "NOME_FUNDO", "DENOM_SOCIAL")}
COMPLEMENT = {
    "cnpj": FUND_ID, "competencia": MONTH, "num_cotistas": ("TOTAL_NUMERO_COTISTAS", "QT_COTST", "NUMERO_COTISTAS"),
    "pl": ("PATRIMONIO_LIQUIDO", "VL_PATRIM_LIQ"), "valor_cota": ("VALOR_PATRIMONIAL_COTAS", "VL_PATRIM_COTA", "VALOR_PATRIMONIAL_COTA"),
}
BALANCE = {"cnpj": FUND_ID, "competencia": MONTH, "pl": ("PATRIMONIO_LIQUIDO", "VL_PATRIM_LIQ")}
CLASS_TABLE = {
    "cnpj": FUND_ID, "competencia": ("DT_COMPTC", "DATA_REFERENCIA", "DATA_COMPETENCIA"), "pl": ("VL_PATRIM_LIQ", "TAB_IV_VL_PL", "VL_PL", "PATRIMONIO_LIQUIDO"),
    "num_cotistas": ("QT_COTST", "QT_COTISTAS", "NR_COTST", "TAB_X_QT_COTST"), "denominacao": ("DENOM_SOCIAL",), "classe": ("CNPJ_CLASSE", "CLASSE", "CLASSE_SERIE", "TAB_X_CLASSE_SERIE"),
}
PRIORITY = {"pl": "tab_iv", "num_cotistas": "tab_x"}


def columns(table: DataFrame, wanted: dict[str, tuple[str, ...]], required: tuple[str, ...], filename: str = "") -> DataFrame:
    """The wanted columns by their candidates, as trimmed text; absent ones are null."""
    found = P.resolve([c for c in table.columns if c not in ("row_idx", "file_idx", "member")], wanted, required, filename)
    have = [P.cell(F.col(f"`{c}`")).alias(k) if c else F.lit(None).cast("string").alias(k) for k, c in found.items()]
    return table.select(*have, *[c for c in ("row_idx", "file_idx", "member") if c in table.columns])


def is_active(situation: Column) -> Column:
    """Active in the second sense: the folded situation has `funcionamento`."""
    return F.contains(fold(F.coalesce(situation, F.lit(""))), F.lit("funcionamento"))


def registry_funds(table: DataFrame) -> DataFrame:
    """One row per fund: the active row, of equals the one registered last, of equals the first."""
    rows = columns(table, REGISTRY, ("cnpj", "denominacao"), "registry")
    rows = rows.withColumns({"cnpj": P.cnpj(F.col("cnpj")), "dt_registro": P.date(F.col("dt_registro")), "tipo_veiculo": P.vehicle_type(F.col("tipo"), F.col("denominacao"))}).filter("cnpj is not null")
    return dedupe_registry(rows).drop("tipo", "row_idx")


def dedupe_registry(rows: DataFrame) -> DataFrame:
    active = F.coalesce(F.upper("situacao") == ACTIVE, F.lit(False))
    w = Window.partitionBy("cnpj").orderBy(active.desc(), F.col("dt_registro").desc_nulls_last(), F.col("row_idx"))
    return rows.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def dedupe_lookup(rows: DataFrame) -> DataFrame:
    """The first active row stays; without one, the last row."""
    active = is_active(F.col("situacao"))
    w = Window.partitionBy("cnpj").orderBy(active.desc(), F.when(active, F.col("row_idx")).otherwise(-F.col("row_idx")))
    return rows.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def accepted_ids(rows: DataFrame) -> DataFrame:
    """id, cnpj of every row up to a fund's first active one; of equal ids the last row counts."""
    w = Window.partitionBy("cnpj")
    first = F.min(F.when(is_active(F.col("situacao")), F.col("row_idx"))).over(w)
    kept = rows.withColumn("first_active", first).filter("id is not null and (first_active is null or row_idx <= first_active)")
    return kept.groupBy("id").agg(F.max_by("cnpj", "row_idx").alias("cnpj"))


def joined_audiences(classes: DataFrame) -> DataFrame:
    """publico_alvo: each fund's audiences in order, joined by ` | `, without those that the text so far contains; cnpjs_classes in order."""
    each = classes.groupBy("cnpj").agg(
        F.array_sort(F.collect_list(F.struct("row_idx", "publico_alvo"))).alias("p"),
        F.array_sort(F.collect_list(F.when(F.col("cnpj_classe") != F.col("cnpj"), F.struct("row_idx", "cnpj_classe")))).alias("c"),
    )

    def add(acc: Column, x: Column) -> Column:
        new = x["publico_alvo"]
        skip = new.isNull() | F.contains(acc, new)
        return F.when(skip, acc).when(acc == "", new).otherwise(F.concat(acc, F.lit(" | "), new))

    text = F.nullif(F.aggregate("p", F.lit(""), add), F.lit(""))
    return each.select("cnpj", text.alias("publico_alvo"), F.transform("c", lambda x: x["cnpj_classe"]).alias("cnpjs_classes"))


def universe(registry: DataFrame, legacy: DataFrame) -> DataFrame:
    """Registry rows, and legacy rows of funds that the registry doesn't have."""
    rest = legacy.join(registry.select("cnpj"), "cnpj", "left_anti").withColumn("fonte", F.lit("cad_fi"))
    return registry.withColumn("fonte", F.lit("registro")).unionByName(rest, allowMissingColumns=True)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"cnpj": P.cnpj(F.col("cnpj")), "competencia": P.month(F.col("competencia"))}).filter("cnpj is not null and competencia is not null")


def running_version(rows: DataFrame) -> DataFrame:
    """Adds accepted: whether a row's version isn't below the running one.

    In file order, a lower version than the running one is skipped; a row without a
    version never is, and it resets the running version.
    """
    w = Window.partitionBy("cnpj", "competencia").orderBy("row_idx")
    # A reset starts a new run; within a run the running version is the largest so far.
    runs = rows.withColumn("run", F.sum(F.when(F.col("versao").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("cnpj", "competencia", "run").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max("versao").over(before), F.lit(0))
    return runs.withColumn("accepted", F.col("versao").isNull() | (F.col("versao") >= top)).drop("run")


def fii_versions(general: DataFrame) -> DataFrame:
    """Version of each report after all rows: that of the last accepted row."""
    rows = running_version(general)
    return rows.groupBy("cnpj", "competencia").agg(F.max_by("versao", F.when(F.col("accepted"), F.col("row_idx"))).alias("versao"))


def fii_attributes(general: DataFrame) -> DataFrame:
    """A fund's attributes: the accepted row of the latest month, of equals the last in the file, taken whole."""
    rows = running_version(general).filter("accepted")
    row = F.struct("publico_alvo", "segmento", "denominacao")
    return rows.groupBy("cnpj").agg(F.max_by(row, F.struct("competencia", "row_idx")).alias("r")).select("cnpj", "r.*")


def last_wins(rows: DataFrame, *values: str) -> DataFrame:
    """The last row's values, null or not."""
    return rows.groupBy("cnpj", "competencia").agg(*[F.max_by(v, "row_idx").alias(v) for v in values])


def first_known(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("cnpj", "competencia").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("row_idx"))).alias(value))


def fii_reports(general: DataFrame, complement: DataFrame, balance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Monthly reports of all three extracts, and the funds' attributes.

    The balance's net worth only fills in where the complement has none.
    """
    g = _keyed(columns(general, GENERAL, ("cnpj", "competencia"), "geral")).withColumn("versao", P.integer(F.col("versao")))
    c = _keyed(columns(complement, COMPLEMENT, ("cnpj", "competencia"), "complemento")).withColumns({"num_cotistas": P.integer(F.col("num_cotistas")), "pl": P.decimal(F.col("pl")), "valor_cota": P.decimal(F.col("valor_cota"), 8)})
    b = _keyed(columns(balance, BALANCE, ("cnpj", "competencia"), "ativo_passivo")).withColumn("pl", P.decimal(F.col("pl")))
    key = ["cnpj", "competencia"]
    out = fii_versions(g).join(last_wins(c, "num_cotistas", "pl", "valor_cota"), key, "full").join(first_known(b, "pl").withColumnRenamed("pl", "pl_balance"), key, "full")
    out = out.withColumn("pl", F.coalesce("pl", "pl_balance")).drop("pl_balance").withColumn("fonte", F.lit("fii_inf_mensal"))
    return out, fii_attributes(g)


def class_values(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Each value of a month, in one pass for all values. values: the column of each value that says which files come first.

    Of each file, the sum over classes if it has a class column (has_class), else the last known
    value; over files, the preferred one's, of equals the first's. Months without any are left out.
    """
    of_file = []
    for v, first in values.items():
        last = F.max_by(v, F.when(F.col(v).isNotNull(), F.col("row_idx")))
        of_file += [F.when(F.first("has_class"), F.sum(v)).otherwise(last).alias(v), F.first(first).alias(first)]
    each = rows.groupBy("cnpj", "competencia", "file_idx").agg(*of_file)
    best = [F.min_by(v, F.when(F.col(v).isNotNull(), F.struct(first, "file_idx"))).alias(v) for v, first in values.items()]
    return each.groupBy("cnpj", "competencia").agg(*best).filter(F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull())


def fidc_reports(tables: list[tuple[str, DataFrame]], archive: str = "") -> tuple[DataFrame, DataFrame]:
    """Monthly reports of an archive's tables (name, rows), and the funds' first known names."""
    wanted = []
    for i, (name, table) in enumerate(tables):
        found = P.resolve([c for c in table.columns if c not in ("row_idx", "file_idx", "member")], CLASS_TABLE)
        if found["cnpj"] and found["competencia"] and (found["pl"] or found["num_cotistas"]):
            rows = _keyed(columns(table, CLASS_TABLE, (), name))
            low = name.lower()
            rows = rows.withColumns({"pl": P.decimal(F.col("pl")), "num_cotistas": P.integer(F.col("num_cotistas")), "file_idx": F.lit(i), "has_class": F.lit(found["classe"] is not None), "pl_first": F.lit(0 if PRIORITY["pl"] in low else 1), "cotistas_first": F.lit(0 if PRIORITY["num_cotistas"] in low else 1)})
            wanted.append(rows)
    if not wanted:
        raise P.LayoutError(f"{archive}: no table with columns of {CLASS_TABLE['pl']} or {CLASS_TABLE['num_cotistas']}; it holds {[n for n, _ in tables]}")
    rows = wanted[0]
    for more in wanted[1:]:
        rows = rows.unionByName(more)
    found = class_values(rows, {"pl": "pl_first", "num_cotistas": "cotistas_first"}).withColumns({"pl": F.col("pl").cast("decimal(20,2)"), "num_cotistas": F.col("num_cotistas").cast("int")})
    names = rows.filter("denominacao is not null").groupBy("cnpj").agg(F.min_by("denominacao", F.struct("file_idx", "row_idx")).alias("denominacao"))
    return found.withColumn("fonte", F.lit("fidc_inf_mensal")), names


def registry_class_archive(funds: DataFrame, classes: DataFrame, keep_order: bool = False) -> DataFrame:
    """The current registry: funds with their classes' audiences and ids, and row_idx, the place in the file, if wanted."""
    f = columns(funds, {"cnpj": FUND_ID, "id": ("ID_REGISTRO_FUNDO",), "denominacao": ("DENOMINACAO_SOCIAL", "DENOM_SOCIAL"), "tipo": ("TIPO_FUNDO", "TP_FUNDO"), "situacao": ("SITUACAO", "SIT"), "administrador": ("ADMINISTRADOR", "ADMIN"), "gestor": ("GESTOR",)}, ("cnpj",), "registro_fundo")
    f = f.withColumn("cnpj", P.cnpj(F.col("cnpj"))).filter("cnpj is not null")
    c = columns(classes, {"id": ("ID_REGISTRO_FUNDO",), "publico_alvo": ("PUBLICO_ALVO",), "cnpj_classe": ("CNPJ_CLASSE",)}, (), "registro_classe")
    c = c.withColumn("cnpj_classe", P.cnpj(F.col("cnpj_classe"))).join(accepted_ids(f), "id")
    return dedupe_lookup(f).drop("id", *([] if keep_order else ["row_idx"])).join(joined_audiences(c), "cnpj", "left")
