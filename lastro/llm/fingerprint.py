"""Document fingerprints by one-permutation MinHash, by DataFrame functions only.

Each five-word shingle is hashed once. The hash's leading bits choose one of BINS
bins, which keeps its least hash. An empty bin takes the value of the first filled
bin on a fixed random walk of its own over all bins (optimal densification; the walks'
first bins are a table, beyond it the filled bins are ranked by a hash), so two
texts agree in a bin as often as their sets are similar. BITS low-order bits of each
value, hashed once more with its bin, are stored as hexadecimal digits; agreement by
chance is taken off again: (agreeing share - 2**-BITS) / (1 - 2**-BITS).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, WIDTH = 256, 4, 5
#: Draws of a walk before the filled bins are ranked by a hash.
DRAWS = 16
#: Bytes of text in a range of neighbours; ranges at most.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 16
EMPTY = "-" * BINS


def _scramble(x: int) -> int:
    """The splitmix64 finaliser."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


#: The leading bits of a hash name its bin. Hashes are even; the largest odd number of each bin
#: stands behind all of its hashes, and alone in an empty bin.
SHIFT = 63 - (BINS.bit_length() - 1)
LAST = [((b + 1) << SHIFT) - 1 for b in range(BINS)]
#: The bins that each bin's walk visits.
WALKS = [[_scramble(((i + 1) << 32) + t) % BINS for t in range(1, DRAWS + 1)] for i in range(BINS)]


def _hashes(words: Column) -> Column:
    """Even 63-bit hashes of the shingles of a word list, not distinct; fewer words than WIDTH are one shingle."""
    mask = F.lit((1 << 63) - 2)
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)]).bitwiseAND(mask))
    return F.when(n >= WIDTH, many).when(n > 0, F.array(F.xxhash64(words).bitwiseAND(mask))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(rows: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the fingerprint of a text column: BINS hexadecimal digits, or as many hyphens for no words."""
    words, hashes, bins, filled = (f"{into}_{k}" for k in ("words", "hashes", "bins", "filled"))
    keep = [F.col(f"`{c}`") for c in rows.columns]
    bin_of = lambda x: F.shiftright(x, SHIFT).cast("int")
    # Column by column, so that each is computed once and not inside another's lambda.
    out = rows.select(*keep, F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias(words))
    out = out.select(*keep, F.sort_array(F.concat(_hashes(F.col(words)), F.lit(LAST).cast("array<bigint>"))).alias(hashes))
    # The first of each bin, in the bins' order.
    least = F.filter(F.col(hashes), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(hashes), i - 1))))
    out = out.select(*keep, F.transform(least, lambda x: F.when(x.bitwiseAND(F.lit(1)) == 0, x)).alias(bins))
    values = F.col(bins)
    there = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(values, b).isNotNull())
    out = out.select(*keep, values, there.alias(filled))
    walks = F.array(*[F.lit(w) for w in WALKS])

    def value(own: Column, i: Column) -> Column:
        """The bin's own value, else that of the first filled bin on its walk, else that of the filled bin that a hash with this bin ranks first."""
        found = F.get(F.filter(F.get(walks, i), lambda b: F.get(values, b).isNotNull()), F.lit(0))
        ranked = F.array_min(F.transform(F.col(filled), lambda b: F.struct(F.xxhash64(F.lit(0), i, b).alias("h"), b.alias("b"))))["b"]
        taken = F.when(own.isNotNull(), own).otherwise(F.coalesce(F.get(values, found), F.get(values, ranked)))
        # The bits of a value taken for several bins differ between them.
        low = F.xxhash64(taken, i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        return F.get(F.lit(list("0123456789abcdef")), low)

    digits = F.array_join(F.transform(values, value), "")
    return out.select(*keep, F.when(F.size(filled) > 0, digits).otherwise(EMPTY).alias(into))


def likeness(a: str, b: str) -> Column:
    """Similarity estimate of two fingerprint columns, 0 to 1; texts without words are like each other alone."""
    pairs = F.zip_with(F.split(F.col(a), ""), F.split(F.col(b), ""), lambda x, y: x == y)
    share = F.size(F.filter(pairs, lambda same: same)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    fair = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), 1.0).when((F.col(a) == EMPTY) | (F.col(b) == EMPTY), 0.0).otherwise(fair)


def _range_of(bounds: list[int]) -> Column:
    """How many bounds lie below the id, by two levels of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.lit([g[-1] for g in groups])
    group = F.size(F.filter(tops, lambda b: b < F.col("doc_id")))
    inside = F.size(F.filter(F.coalesce(F.get(_ragged(groups), group), F.array().cast("array<bigint>")), lambda b: b < F.col("doc_id")))
    return group * step + inside


def _ragged(groups: list[list[int]]) -> Column:
    return F.array(*[F.lit(g).cast("array<bigint>") for g in groups])


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text and next_fingerprint of the next document by descending doc_id (after the last, the first).

    docs: doc_id, text; adds their fingerprint too. Documents are dealt into ranges of ids, and each
    range is one window; only a range's last document looks beyond it. Rows with one
    doc_id stand in descending order of text; rows without an id come last.
    """
    spark = docs.sparkSession
    stats = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not stats.rows:
        return docs.withColumns({"fingerprint": F.lit(EMPTY), "next_text": F.lit(""), "next_fingerprint": F.lit(EMPTY)})
    ranges = int(min(MOST_RANGES, stats.rows, stats.bytes // RANGE_BYTES + 12))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges + 1000).alias("b")).first().b if shares else []
    dealt = docs.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(_range_of(sorted(set(bounds or [])))))
    # One row per range, whose number is bounded: the id its documents begin with.
    tops = {r["range"]: r.top for r in dealt.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    follows = {r: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    edges = spark.createDataFrame([(r, n, tops[n]) for r, n in follows.items()], "range int, next_range int, top long")
    # The heads are picked before their fingerprints are taken, so that only theirs are.
    starts = F.broadcast(edges.select(F.col("next_range").alias("nr"), "top").distinct())
    head = dealt.join(starts, (F.col("range") == F.col("nr")) & F.col("doc_id").eqNullSafe(F.col("top")))
    head = head.groupBy("nr").agg(F.max("text").alias("text"))
    head = fingerprint(head, "text", "fingerprint").select("nr", F.struct("text", "fingerprint").alias("head"))
    head = head.join(F.broadcast(edges), F.col("nr") == F.col("next_range")).select("range", "head")
    w = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    out = fingerprint(dealt, "text", "fingerprint").withColumns({"lead_text": F.lead("text").over(w), "lead_print": F.lead("fingerprint").over(w)})
    out = out.join(head, "range", "left")
    return out.withColumns({"next_text": F.coalesce("lead_text", F.col("head.text")), "next_fingerprint": F.coalesce("lead_print", F.col("head.fingerprint"))}).drop("range", "head", "lead_text", "lead_print")


def compare_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document's. doc_id must be an integer column. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; one row per row of docs. A null text counts as empty. Repeated rows are
    neighbours of each other; other columns are ignored whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
