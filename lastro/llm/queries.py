"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.llm import bpe, collocation, fingerprint, hnsw, langid, maintext, minhash, oracles, packing, secrets, spelling, suffix, urlfilter, warc
from lastro.llm.common import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


#: The rules that pages are judged by (fixed values).
URL_RULES = "allow org/, block example.org/es/, block example.org/en/1, allow com/fr/, block com/de/"


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.rules(URL_RULES), recount=True)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), width=100, with_text=False)


def op11_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


# The operators over tables that have what the plain ones may lack: payloads that repeat, vectors that link


def warc_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's operator over the pages and, of every other page, two more that have its payload."""
    pages = table(spark, sf_dir, "pages")
    more = pages.filter("page_id % 2 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("page_id", F.col("page_id") + 10_000_000 * F.col("k")).drop("k")
    return warc.round_trip(pages.unionByName(more))


def vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator over the vectors, each doubled in length, each without its first component, and each of every third turned around."""
    vectors = table(spark, sf_dir, "embeddings")
    changed = [
        (1, F.transform("embedding", lambda x: x * F.lit(2).cast("float")), F.lit(True)),
        (2, F.transform("embedding", lambda x, i: F.when(i == 0, F.lit(0).cast("float")).otherwise(x)), F.lit(True)),
        (3, F.transform("embedding", lambda x: -x), F.col("vec_id") % 3 == 0),
    ]
    out = vectors.select("vec_id", "embedding", "label")
    for k, e, which in changed:
        out = out.unionByName(vectors.filter(which).select((F.col("vec_id") + 10_000_000 * k).alias("vec_id"), e.alias("embedding"), "label"))
    return hnsw.near_duplicates(out, least=0.98)


QUERIES = {f.__name__: f for f in (op1_packing, op2_bpe, op3_warc, op4_hnsw, op5_langid, op6_minhash, op7_secrets, op8_urls, op9_fingerprints, op10_suffix, op11_maintext, op12_collocations, op13_spelling, warc_copies, vector_links)}
#: Encoding, models and fingerprints can't be said in SQL, and repeated strings are too slow in it; tests hold them against brute force.
ORACLES = {"op3_warc": oracles.WARC, "op4_hnsw": oracles.VECTORS, "op6_minhash": oracles.NEAR, "op7_secrets": oracles.SECRETS, "op11_maintext": oracles.MAIN_TEXT, "op12_collocations": oracles.COLLOCATIONS, "op13_spelling": oracles.SPELLING, "warc_copies": oracles.WARC_COPIES, "vector_links": oracles.VECTOR_LINKS}
