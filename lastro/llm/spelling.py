"""Spelling variants: a symmetric-delete join, verified distances, forms and their roots.

Every word emits itself and its distinct single deletions; words that share such a key are
within distance two and are verified. Keys are 64-bit polynomial hashes made from prefix sums,
so that a word of length n costs n numbers, not n strings; they propose pairs alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import RollingHash, checkpoint, importable, join_spread, text_slices

#: A maximal run of letters (fixed values).
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One occurrence in so many loses a code point (fixed value).
EVERY = 97
#: Keys that a worker makes at once, and bytes of words.
KEYS, BYTES = 200_000, 1 << 20


def occurrences(docs: DataFrame) -> DataFrame:
    """word of each occurrence, after the deletions that the occurrence's checksum asks for. A null id reads as an empty one."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return occurrences(docs).filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def deletion_keys(words: list[str], rolling: RollingHash) -> list[np.ndarray]:
    """For each word the distinct hashes of itself and of what one deletion leaves."""
    out = []
    for word in words:
        code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(code)
        rolling.powers(n + 1)
        up = rolling.up[:n]
        # Sums of code times a power of its place; what follows a deletion moves down by one place.
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up, dtype=np.uint64)])
        after = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code[1:] * rolling.up[: n - 1], dtype=np.uint64)])
        cut = before[:-1] + (after[-1] - after)
        out.append(np.unique(np.append(cut, before[-1])))
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = RollingHash(0x9E3779B97F4A7C15)
    for batch in text_slices(batches, "word", BYTES):
        found = deletion_keys(batch.column("word").to_pylist(), rolling)
        keys, ids = np.concatenate(found).view(np.int64), np.repeat(batch.column("id").to_numpy(), [len(k) for k in found])
        for a in range(0, len(keys), KEYS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + KEYS]), pa.array(ids[a : a + KEYS])], names=["key", "id"])


def near(a: str, b: str) -> Column:
    """Whether two columns' words differ by exactly one inserted, deleted or replaced code point."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.col(a) != F.col(b)) & (F.levenshtein(F.col(a), F.col(b), 1) == 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, word_a, n_a, b, word_b, n_b of near words, each pair once. words: id, word, n of a written table, ids unique."""
    keys = checkpoint(words.select("id", "word").mapInArrow(_keys, "key long, id long"))
    pairs = keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    side = lambda s: words.select(F.col("id").alias(s), F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(near("word_a", "word_b"))


def group_variants(docs: DataFrame, shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the documents.

    Words are maximal runs of letters, A-Z lower-cased, of `shortest` code points and `least`
    occurrences; one occurrence in 97 by its checksum loses a code point first. A word's form is
    its near word of largest n (ties: the smallest in code-point order) if that n is `ratio`
    times its own; its root is where forms lead, the word itself if it has none. Forms' counts
    grow by `ratio` at each step, so no loop is possible and chains are short.

    Null texts have no words; a null doc_id reads as an empty one; repeated rows count each; other
    columns have no part in it; an empty table gives no rows. Words of any length are handled whole.
    """
    importable(docs.sparkSession)
    words = checkpoint(vocabulary(docs, shortest, least).withColumn("id", F.monotonically_increasing_id()))
    pairs = checkpoint(near_pairs(words))
    one = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), F.col("word_b").alias("form"), F.col("n_b").alias("form_n"))
    two = pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), F.col("word_a").alias("form"), F.col("n_a").alias("form_n"))
    best = one.unionByName(two).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form", "other")).alias("f"))
    joined = words.join(best, "id", "left")
    takes = F.coalesce(-F.col("f.less") >= F.lit(ratio) * F.col("n"), F.lit(False))
    mine = lambda c: F.when(takes, c)
    forms = checkpoint(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), mine(F.col("f.form")).alias("form"), mine(-F.col("f.less")).alias("form_n"), mine(F.col("f.other")).alias("up")))

    # Each round doubles the way that a word has gone; words at their root stay there.
    step = checkpoint(forms.filter("up is not null").select("id", "up"))
    while True:
        onward = step.select(F.col("id").alias("up"), F.col("up").alias("next"))
        longer = checkpoint(join_spread(step, onward, ["up"], "left", by="id").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        step = longer.select("id", "up")
        if longer.filter("moved").isEmpty():
            break
    roots = join_spread(step, words.select(F.col("id").alias("up"), F.col("word").alias("root")), ["up"], by="id").select("id", "root")
    return forms.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
