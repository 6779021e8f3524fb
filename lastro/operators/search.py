"""Fund search: structured filters, the documents in force, phrases and snippets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastro.functions import text as T

#: Page sizes at most on screen and for export (fixed values).
SCREEN_LIMIT, EXPORT_LIMIT = 200, 2000


@dataclass(frozen=True)
class Filters:
    tipos_veiculo: tuple[str, ...] = ()
    publico_alvo: tuple[str, ...] = ()
    situacao: str | None = None
    pl_min: float | None = None
    pl_max: float | None = None
    cotistas_min: int | None = None
    cotistas_max: int | None = None
    termos: tuple[str, ...] = ()
    exigir_todos_termos: bool = False
    excluir_vedacoes: bool = False
    literal: bool = False
    categorias_documento: tuple[str, ...] = ("Regulamento",)
    apenas_vigente: bool = True
    max_trechos: int = 3
    limite: int = 50
    offset: int = 0


def filters_from_query(query: str, export: bool = False) -> Filters:
    """A URL's query string as filters: repeated or comma-separated lists, flags as `=1`, limits clamped.

    Text that isn't a number is rejected.
    """
    given = parse_qs(query.lstrip("?"), keep_blank_values=False)

    def many(name: str) -> tuple[str, ...]:
        return tuple(p.strip() for v in given.get(name, []) for p in v.split(",") if p.strip())

    def one(name: str, kind=float):
        return kind(given[name][0]) if name in given else None

    most = EXPORT_LIMIT if export else SCREEN_LIMIT
    return Filters(
        tipos_veiculo=many("tipo"), publico_alvo=many("publico"), situacao=one("situacao", str),
        pl_min=one("plMin"), pl_max=one("plMax"), cotistas_min=one("cotistasMin", int), cotistas_max=one("cotistasMax", int),
        termos=many("termo"), exigir_todos_termos=one("todos", str) == "1", excluir_vedacoes=one("excluirVedacoes", str) == "1",
        literal=one("literal", str) == "1", categorias_documento=many("categoria") or ("Regulamento",),
        apenas_vigente=one("todasVersoes", str) != "1", max_trechos=one("maxTrechos", int) or 3,
        limite=min(max(one("limite", int) or (most if export else 25), 1), most), offset=max(one("offset", int) or 0, 0),
    )


def fund_predicate(f: Filters) -> Column | None:
    """The condition on funds joined with their metrics; a bound rejects a fund without the figure."""
    parts: list[Column] = []
    if f.tipos_veiculo:
        parts.append(F.col("tipo_veiculo").isin(*f.tipos_veiculo))
    if f.situacao:
        parts.append(F.lower("situacao") == F.lower(F.lit(f.situacao)))
    if f.publico_alvo:
        # `%` and `_` of a term are wildcards.
        parts.append(reduce(lambda a, b: a | b, [F.lower("publico_alvo").like(f"%{p.lower()}%") for p in f.publico_alvo]))
    for column, low, high in (("pl_medio_12m", f.pl_min, f.pl_max), ("cotistas_atual", f.cotistas_min, f.cotistas_max)):
        if low is not None:
            parts.append(F.col(column) >= low)
        if high is not None:
            parts.append(F.col(column) <= high)
    return reduce(lambda a, b: a & b, parts) if parts else None


def funds_with_metrics(funds: DataFrame, metrics: DataFrame, f: Filters) -> DataFrame:
    joined = funds.join(metrics.drop("atualizado_em"), "cnpj", "left")
    condition = fund_predicate(f)
    return joined if condition is None else joined.filter(condition)


def by_size(df: DataFrame) -> DataFrame:
    """The order of results: largest 12-month mean first, funds without one last."""
    return df.orderBy(F.col("pl_medio_12m").desc_nulls_last(), F.col("cnpj"))


def page(df: DataFrame, f: Filters) -> DataFrame:
    return by_size(df).offset(f.offset).limit(f.limite)


def in_force(documents: DataFrame) -> DataFrame:
    """The newest document of each fund and category, over all documents, extracted or not.

    Documents without a fund or a category are never in force.
    """
    known = documents.filter(F.col("cnpj").isNotNull() & F.col("categoria").isNotNull())
    w = Window.partitionBy("cnpj", "categoria").orderBy(F.col("data_entrega").desc_nulls_last(), F.col("id_fnet").desc())
    return known.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def matching_documents(documents: DataFrame, texts: DataFrame, f: Filters, admitted: DataFrame | None = None) -> DataFrame:
    """Documents that the filters' categories, currency and terms admit, with texto and texto_norm.

    admitted: the funds (cnpj) whose documents count. Texts are looked at last, and only
    those of documents that everything else admits.
    """
    chosen = documents
    # Category and fund are the window's keys, so these filters may go below it.
    if f.categorias_documento:
        chosen = chosen.filter(F.col("categoria").isin(*f.categorias_documento))
    if admitted is not None:
        chosen = chosen.join(admitted.select("cnpj"), "cnpj", "left_semi")
    if f.apenas_vigente:
        chosen = in_force(chosen)
    found = chosen.join(texts.select("id_fnet", "texto", "texto_norm"), "id_fnet")
    if f.termos:
        # The condition needs both sides, so no text is matched before the join has kept it.
        found = found.filter(F.when(F.coalesce(F.col("cnpj"), F.lit("")) != "-", T.has_terms(F.col("texto_norm"), list(f.termos), f.exigir_todos_termos, not f.literal)))
    return found


def document_matches(documents: DataFrame, texts: DataFrame, f: Filters, admitted: DataFrame | None = None) -> DataFrame:
    """One row per matching document with termos_encontrados and trechos."""
    rows = matching_documents(documents, texts, f, admitted)
    rows = rows.withColumn("termos_encontrados", T.matched_terms(F.col("texto_norm"), list(f.termos), not f.literal))
    return T.snippets(rows, "texto", "texto_norm", list(f.termos), most=f.max_trechos, flexible=not f.literal).drop("texto", "texto_norm")


def search_funds(funds: DataFrame, metrics: DataFrame, f: Filters) -> DataFrame:
    """A page of funds, without text conditions."""
    return page(funds_with_metrics(funds, metrics, f), f)


def search_text(funds: DataFrame, metrics: DataFrame, documents: DataFrame, texts: DataFrame, f: Filters) -> DataFrame:
    """All funds that have a matching document, each with its documents (newest first) and their snippets.

    Under excluir_vedacoes a document goes if all of its returned snippets follow a prohibition.
    Order and cut with page(); the count of the result is the exact total.
    """
    funds = funds_with_metrics(funds, metrics, f)
    found = document_matches(documents, texts, f, funds)
    document = F.struct(
        F.col("data_entrega"), F.col("id_fnet"), F.col("categoria"), F.col("tipo"), F.col("competencia"),
        F.col("url_storage"), F.col("termos_encontrados"), F.col("trechos"),
    )
    rows = found.select("cnpj", document.alias("documento"), F.forall("trechos", lambda t: t["possivel_vedacao"]).alias("vedado"))
    if f.excluir_vedacoes:
        # explode/collect keeps the condition from being pushed below the snippets.
        rows = rows.groupBy("cnpj").agg(F.collect_list(F.when(~F.col("vedado"), F.col("documento"))).alias("documentos")).filter(F.size("documentos") > 0)
    else:
        rows = rows.groupBy("cnpj").agg(F.collect_list("documento").alias("documentos"))
    newest = F.array_sort("documentos", lambda a, b: F.when(a["data_entrega"].eqNullSafe(b["data_entrega"]), F.when(a["id_fnet"] > b["id_fnet"], -1).when(a["id_fnet"] < b["id_fnet"], 1).otherwise(0)).when(a["data_entrega"].isNull() | (a["data_entrega"] < b["data_entrega"]), 1).otherwise(-1))
    return funds.join(rows.withColumn("documentos", newest), "cnpj")


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("cnpj").alias("total"))


def domain_values(funds: DataFrame, column: str) -> DataFrame:
    return funds.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def category_counts(documents: DataFrame) -> DataFrame:
    return documents.filter("categoria is not null").groupBy("categoria").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "categoria")


def fund_page(documents: DataFrame, texts: DataFrame, cnpj: str) -> DataFrame:
    """A fund's documents, newest first, and whether each has text."""
    own = documents.filter(F.col("cnpj") == cnpj).join(texts.select("id_fnet", F.lit(True).alias("tem")), "id_fnet", "left")
    return own.withColumn("tem_texto", F.col("tem").isNotNull()).drop("tem").orderBy(F.col("data_entrega").desc_nulls_last(), F.col("id_fnet").desc())


def series(reports: DataFrame, cnpj: str) -> DataFrame:
    return reports.filter(F.col("cnpj") == cnpj).orderBy("competencia")


def document_page(documents: DataFrame, texts: DataFrame, id_fnet: int, terms: list[str], most: int = 10) -> DataFrame:
    """One document with snippets for the terms, if it has text."""
    row = documents.filter(F.col("id_fnet") == id_fnet).join(texts, "id_fnet", "left")
    return T.snippets(row, "texto", "texto_norm", terms, most=most) if terms else row


@dataclass
class Result:
    """A page and the exact total."""

    funds: DataFrame
    total: int
    filters: Filters = field(default_factory=Filters)


def search(funds: DataFrame, metrics: DataFrame, documents: DataFrame, texts: DataFrame, f: Filters) -> Result:
    """The whole search: without terms over funds alone, else over documents in text.

    texts: all of them, or those of an index's candidates (postings), which the terms' patterns confirm.
    """
    found = search_text(funds, metrics, documents, texts, f) if f.termos else funds_with_metrics(funds, metrics, f)
    return Result(page(found, f), found.count(), f)
