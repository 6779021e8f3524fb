"""The corpus pipeline: documents in, training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.llm import langid, minhash, packing, secrets, suffix
from lastro.llm.common import checkpoint, table
from lastro.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text, or no letters); a missing lang becomes the predicted one.

    Rows are judged one by one: repeated rows and null ids stay or go as their texts do, texts of
    any length are read whole, and of extra columns none is passed on. No labelled rows give no
    language, so all rows go; an empty table stays empty.
    """
    model = langid.train(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    judged = langid.predict(docs, model).filter("lang_pred <> 'und'")
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, once if it is repeated.

    Rows of one doc_id go or stay together, equal ones once; rows without an id stay, and so do
    rows without words. Ties are broken by the doc_id. Extra columns aren't passed on.
    """
    groups = checkpoint(minhash.near_duplicates(docs, width=5, percent=80))
    dropped = groups.filter("not kept").select("doc_id").distinct()
    repeated = groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    kept = docs.join(dropped, "doc_id", "left_anti")
    if repeated.isEmpty():  # ids are unique as a rule; texts then move once
        return kept.select(*COLUMNS)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated strings of 100 bytes; a document that loses all its text goes.

    A document that had no text stays, its null text empty. Rows of one doc_id stand in the order
    of their texts, rows without an id after all others; of equal rows of 100 bytes or more the
    first stays. Extra columns aren't passed on.
    """
    out = suffix.remove_repeats(docs, width=100, carry=OTHERS)
    out = out.filter("n_removed = 0 or kept <> ''").withColumnRenamed("kept", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets that the rules find, the base ones and those that the operator adds.

    No document goes: a null text becomes an empty one, repeated rows and rows without an id are
    each masked for themselves, and where spans overlap each adds a mask for what lies beyond the
    one before. Extra columns aren't passed on.
    """
    out = secrets.redact(secrets.scan(docs, carry=OTHERS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, with their ids; one row per piece of every row.

    A null or empty text gives one sequence of one token; repeated rows are packed each for
    itself; a null id stays null; other columns have no part in it.
    """
    return packing.pack(docs, vocabulary_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secret_scan), ("packing", pack)]

#: The stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
