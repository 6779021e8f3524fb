"""Looking for terms in documents, newest first, without a stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastro.functions import parsing as P
from lastro.functions import text as T
from lastro.operators.ingest import is_active

#: Characters of a text in which the fund's own number is looked for (fixed value).
PREAMBLE = 4000


def document_cnpj(field: Column, description: Column) -> Column:
    """The fund of a document by its metadata: the field, else a number in the description."""
    return F.coalesce(P.cnpj(field), P.cnpj_in(description))


def text_cnpj(documents: DataFrame, registry: DataFrame, text: str = "texto", key: str = "id_fnet") -> DataFrame:
    """key, cnpj: a valid number from the text's preamble, one that the registry has before others, then by place."""
    found = documents.select(key, F.posexplode(F.regexp_extract_all(F.substring(text, 1, PREAMBLE), F.lit(f"({P.CNPJ_PATTERN})"), 1)).alias("pos", "hit"))
    found = found.withColumn("cnpj", P.cnpj(F.col("hit"))).filter(P.cnpj_valid(F.col("cnpj")))
    known = registry.select("cnpj", F.lit(1).alias("known")).distinct()
    found = found.join(known, "cnpj", "left")
    return found.groupBy(key).agg(F.min_by("cnpj", F.struct(F.coalesce(-F.col("known"), F.lit(0)).alias("k"), "pos")).alias("cnpj"))


def eligible(documents: DataFrame, registry: DataFrame, active_only: bool = True) -> DataFrame:
    """Each fund's first document in arrival order, if the registry doesn't know the fund as inactive."""
    w = Window.partitionBy("cnpj").orderBy("arrival")
    first = documents.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")
    out = first.join(registry.select("cnpj", F.col("situacao").alias("situacao_cadastro"), F.lit(True).alias("cadastrado")), "cnpj", "left")
    return out.filter(F.col("cadastrado").isNull() | is_active(F.col("situacao_cadastro"))) if active_only else out


def prospect(documents: DataFrame, texts: DataFrame, registry: DataFrame, terms: list[str], category: str | None = "Regulamento", active_only: bool = True, most_documents: int | None = None, wanted: int | None = None, most: int = 3) -> DataFrame:
    """Funds whose first eligible document matches, with snippets, in arrival order.

    documents: id_fnet, cnpj, descricao, categoria, arrival (newest first). A document
    without a fund in its metadata takes the fund of its text. most_documents bounds the
    documents that are read, wanted the funds returned.
    """
    docs = documents
    if category is not None:
        docs = docs.filter(F.contains(T.fold(F.coalesce("categoria", F.lit(""))), F.lit(T.fold_text(category))))
    docs = docs.withColumn("cnpj", document_cnpj(F.col("cnpj"), F.col("descricao"))).join(texts.select("id_fnet", "texto", "texto_norm"), "id_fnet", "left")
    from_text = text_cnpj(docs.filter("cnpj is null and texto <> ''"), registry).withColumnRenamed("cnpj", "cnpj_texto")
    docs = docs.join(from_text, "id_fnet", "left").withColumn("cnpj", F.coalesce("cnpj", "cnpj_texto")).drop("cnpj_texto")
    known = eligible(docs.filter("cnpj is not null"), registry, active_only)
    if most_documents is not None:
        known = known.orderBy("arrival").limit(most_documents)
    hits = known.filter(F.coalesce(T.has_terms(F.col("texto_norm"), terms), F.lit(False)))
    if wanted is not None:
        hits = hits.orderBy("arrival").limit(wanted)
    hits = hits.withColumn("termos", T.matched_terms(F.col("texto_norm"), terms))
    return T.snippets(hits, "texto", "texto_norm", terms, most=most).drop("texto", "texto_norm", "cadastrado")


def domain_id(domains: DataFrame, group: str, label: str) -> DataFrame:
    """The id of a label in the groups whose name has the hint; labels compare folded."""
    same = T.fold(F.trim("rotulo")) == T.fold_text(label)
    return domains.filter(F.contains(F.lower("grupo"), F.lit(group.lower())) & same & ~F.col("id_fnet").isin("", "0")).orderBy("grupo", "id_fnet").limit(1)


def fund_types(domains: DataFrame) -> DataFrame:
    """Numeric ids other than 0."""
    return domains.filter(F.col("id_fnet").rlike(r"^\d+$") & (F.col("id_fnet").try_cast("bigint") != 0))
