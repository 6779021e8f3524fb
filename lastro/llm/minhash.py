"""Near-duplicate detection by a signature-coordinate inverted join.

Each distinct shingle set posts under its coordinate-value pairs. Two sets of similarity
0.8 agree in 38 of 48 coordinates on average. The match threshold T falls as the table
grows, so that of one pair at exactly the limit for each set of the table, MISSED are
expected to agree in fewer than T; pairs of more than the limit are missed less still (at
250,000 sets T is 20, and a pair at the limit is missed once in a billion times). Sets that
agree in T share at least one of any 49 - T of a set's values, so a set posts only as many
of its rarest (the prefix); values that nobody else has can't collide, so posting them is
skipped, and a set of more than 48 - T such values is skipped as a whole.

Collisions are counted and checked on full sets in two steps. First each posting
list's members are checked against one member (a star), which joins most groups of
copies without looking at their pairs. Then every list that still has members of
different components counts collisions between such members alone, short lists many
at a time and long ones in blocks of bounded size; what reaches the threshold is
checked on full sets. Links inside one component are skipped: they can't change the result.

Equal sets count once, whatever the number of their copies. A set is of 64-bit hashes of
shingles, two of which agree by chance once in 2 ** 64 pairs. Lists, stars and components
of any size are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import checkpoint, held, importable, join_spread, mix64, spread, text_slices, tidy
from lastro.llm.graph import components

SLICE_BYTES = 1 << 20
MAX_WORDS_HELD = 1 << 17
COORDINATES = 48
#: Links at the limit that may be missed in a table where each set has one.
MISSED = 1e-3
#: Members of other components, and members, that one task compares at most.
BLOCK_A, BLOCK_B = 1024, 2048
#: Members of a posting list that is counted together with others, and rows of such lists in a task, about.
SHORT, SHORT_ROWS = 48, 20_000


def threshold(sets: int, percent: int) -> int:
    """The most coordinates T such that so many pairs at the limit agree in fewer than T less than MISSED times."""
    p, below, t = percent / 100, 0.0, 0
    while t < COORDINATES:
        below += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if below * max(sets, 1) > MISSED:
            break
        t += 1
    return max(t, 1)


class Words(dict):
    """Hashes of words, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS_HELD:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = held(Words())


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, one text after the other, and their counts.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased.
    A text with fewer words than the width has one shingle, a text without words none.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((WORDS[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    n = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    begin, out = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(n)))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(out[-1]) - out[:-1][doc] + begin[:-1][doc]
    x = np.zeros(len(at), np.uint64)
    short = (sizes < width)[doc]
    for k in range(width):
        inside = at + k < begin[1:][doc]
        x = np.where(inside, mix64(x + h[np.minimum(at + k, max(len(h) - 1, 0))]) if len(h) else x, x)
    x = np.where(short, mix64(x + sizes[doc].astype(np.uint64)), x)
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return x[new], np.bincount(doc[new], minlength=len(texts))


def signatures(x: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """For each non-empty set, the least hash of each coordinate, scrambled with the coordinate."""
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(begin), coordinates), np.uint64)
    with np.errstate(over="ignore"):
        seeds = mix64(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k in range(coordinates):
            v = (x ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
            v ^= v >> np.uint64(32)
            out[:, k] = mix64(np.minimum.reduceat(v * np.uint64(0xD6E8FEB86659FD93), begin) + np.uint64(k + 1) * seeds[0]) if len(begin) else 0
    return out


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id (null if empty), signature (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE_BYTES):
            x, n = shingle_sets(batch.column("text").to_pylist(), width)
            sig = iter(signatures(x, n, COORDINATES).view(np.int64))
            upto = np.concatenate(([0], np.cumsum(n))).tolist()
            ids = [xxhash.xxh3_128_digest(x[a:b].tobytes()) if b > a else None for a, b in zip(upto, upto[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "set_id": pa.array(ids, pa.binary()), "signature": pa.array([None if i is None else next(sig) for i in ids], pa.list_(pa.int64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id binary, signature array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """set_id, items (the full set as bytes of sorted 64-bit hashes); one row per row of docs with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE_BYTES):
            x, n = shingle_sets(batch.column("text").to_pylist(), width)
            upto = np.concatenate(([0], np.cumsum(n))).tolist()
            own = [x[a:b].tobytes() for a, b in zip(upto, upto[1:], strict=False) if b > a]
            yield pa.RecordBatch.from_pydict({"set_id": pa.array([xxhash.xxh3_128_digest(o) for o in own], pa.binary()), "items": pa.array(own, pa.binary())})

    return docs.mapInArrow(run, "set_id binary, items binary")


def _verify(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows a, b, items_a, items_b, those that reach the similarity on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                least, most = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * least >= percent * most else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "items_a", "items_b").mapInArrow(run, "a binary, b binary")


def _counted(least: int):
    """Of one block, the members that reach the threshold with a member of another component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tidy()
        a, b = pdf[pdf.role == "a"], pdf[pdf.role == "b"]
        sa, sb = (np.array(x.signature.tolist(), np.int64).reshape(-1, COORDINATES) for x in (a, b))
        ma, mb = a.prefix.to_numpy(np.int64), b.prefix.to_numpy(np.int64)
        own = int(pdf.coordinate.iloc[0])
        comp, _ = pd.factorize(pd.concat([a.component, b.component]))
        count = np.zeros((len(a), len(b)), np.uint8)
        earlier = np.zeros((len(a), len(b)), bool)
        for k in range(COORDINATES):
            same = sa[:, k][:, None] == sb[:, k][None, :]
            count += same
            if k < own:  # the pair belongs to the first posting list that both are on
                pa_, pb_ = (ma >> k & 1).astype(bool), (mb >> k & 1).astype(bool)
                if pa_.any() and pb_.any():
                    earlier |= same & pa_[:, None] & pb_[None, :]
        hit = (count >= least) & ~earlier & (comp[: len(a)][:, None] != comp[len(a) :][None, :])
        out = pd.concat([a[hit.any(axis=1)], b[hit.any(axis=0)]])
        return out[["value", "i", "j", "role", "set_id", "component"]]

    return run


def _counted_short(least: int):
    """Of many short lists, the pairs of different components that reach the threshold, each in the first list that both are on."""

    def run(key, rows):
        tidy()
        value = rows.column("value").to_numpy()
        by = np.argsort(value, kind="stable")
        value = value[by]
        sig = rows.column("signature").combine_chunks().values.to_numpy().reshape(-1, COORDINATES)[by]
        mask, own = rows.column("prefix").to_numpy()[by], rows.column("coordinate").to_numpy()[by]
        comp, _ = pd.factorize(rows.column("component").to_pandas().iloc[by])
        found = []
        for step in range(1, SHORT):
            i = np.flatnonzero(value[step:] == value[:-step])
            if not len(i):
                break
            i = i[comp[i] != comp[i + step]]
            for k in range(0, len(i), 1 << 14):
                a = i[k : k + (1 << 14)]
                same = sig[a] == sig[a + step]
                a, same = (x[same.sum(axis=1) >= least] for x in (a, same))
                both = (mask[a] & mask[a + step])[:, None] >> np.arange(COORDINATES) & 1
                found.append((a[np.argmax(same & (both > 0), axis=1) == own[a]], step))
        ids = rows.column("set_id")
        left = np.concatenate([by[a] for a, _ in found]) if found else np.empty(0, np.int64)
        right = np.concatenate([by[a + step] for a, step in found]) if found else np.empty(0, np.int64)
        return pa.table({"a": ids.take(pa.array(left)).combine_chunks(), "b": ids.take(pa.array(right)).combine_chunks()})

    return run


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a and b reach the similarity, by products of incidence matrices over the items both sides have."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    fa, fb = np.concatenate(a), np.concatenate(b)
    items = np.intersect1d(fa, fb)
    both = np.zeros((len(a), len(b)), np.float64)
    if len(items):
        def incidence(flat, n):
            at = np.minimum(np.searchsorted(items, flat), len(items) - 1)
            found = items[at] == flat
            return np.repeat(np.arange(len(n)), n)[found], at[found]

        (ra, ca), (rb, cb) = incidence(fa, na), incidence(fb, nb)
        oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
        ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
        for lo in range(0, len(items), 1024):
            hi = min(lo + 1024, len(items))
            pa_, pb_ = slice(*np.searchsorted(ca, [lo, hi])), slice(*np.searchsorted(cb, [lo, hi]))
            x, y = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
            x[ra[pa_], ca[pa_] - lo] = 1
            y[rb[pb_], cb[pb_] - lo] = 1
            both += x @ y.T
    return 100 * both >= percent * (na[:, None] + nb[None, :] - both)


def _checked(percent: int):
    """Of one block of full sets, a link for each member and other component it links with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tidy()
        a, b = pdf[pdf.role == "a"], pdf[pdf.role == "b"]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []})
        comp, _ = pd.factorize(pd.concat([a.component, b.component]))
        hit = linked([np.frombuffer(x, np.uint64) for x in a["items"]], [np.frombuffer(x, np.uint64) for x in b["items"]], percent)
        i, j = np.nonzero(hit & (comp[: len(a)][:, None] != comp[len(a) :][None, :]))
        first = pd.DataFrame({"i": i, "j": j, "c": comp[len(a) :][j]}).drop_duplicates(["i", "c"])
        return pd.DataFrame({"a": a.set_id.to_numpy()[first.i], "b": b.set_id.to_numpy()[first.j]})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Returns one row per row of docs: doc_id, n_shingles (size of the set), component_id
    (smallest doc_id reachable by links, itself included), kept (doc_id = component_id).
    Null or wordless texts have an empty set and link with nothing; so do rows with a
    null doc_id, whose component_id and kept are null. Repeated rows share a component
    and are each returned; a text's copies count once however many there are. Other
    columns of docs are ignored whatever their names.
    """
    importable(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = checkpoint(_profiles(docs, width))
    known = rows.filter("doc_id is not null and set_id is not null")
    # A set's copies have one signature.
    values = checkpoint(known.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.first("signature").alias("signature")))
    least = threshold(values.count(), percent)
    prefix = COORDINATES - least + 1
    posted = values.select("set_id", F.posexplode("signature").alias("coordinate", "value"))
    shared = checkpoint(posted.groupBy("value").count().filter("count > 1"))
    posted = join_spread(posted, shared, ["value"], by="set_id", counts=shared)
    # A set's values that others have too, rare ones first; its other values come before these in the prefix.
    lists = posted.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("count", "value", "coordinate"))).alias("all"))
    lists = lists.filter(F.size("all") > COORDINATES - prefix).withColumn("own", F.expr(f"slice(all, 1, {prefix - COORDINATES} + size(all))"))
    mask = F.aggregate("own", F.lit(0).cast("long"), lambda m, x: m + F.call_function("shiftleft", F.lit(1).cast("long"), x.coordinate))
    lists = checkpoint(lists.select("set_id", mask.alias("prefix"), "own"))
    postings = lists.select("set_id", "prefix", F.explode("own").alias("p")).select("set_id", "prefix", "p.value", "p.coordinate")

    centres = checkpoint(postings.groupBy("value").agg(F.min("set_id").alias("a"), F.count(F.lit(1)).alias("count")).filter("count > 1"))
    stars = join_spread(postings, centres.drop("count"), ["value"], by="set_id", counts=centres.drop("a"))
    stars = checkpoint(stars.filter("set_id != a").select("a", F.col("set_id").alias("b")).distinct())
    needed = values.join(lists.select("set_id"), "set_id", "left_semi").select(F.col("first").alias("doc_id")).distinct()
    full = checkpoint(_sets(docs.join(needed, "doc_id", "left_semi"), width).dropDuplicates(["set_id"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs: a written table a, b; one a may have any number of b."""
        dealt, copied = spread(pairs, ["a"])
        dealt = dealt.join(full.select(F.col("set_id").alias("b"), F.col("items").alias("items_b")), "b")
        centre = copied(full.select(F.col("set_id").alias("a"), F.col("items").alias("items_a")))
        return checkpoint(_verify(dealt.join(centre, ["a", "salt"]), percent))

    links = verified(stars)

    label = components(links)
    member = postings.join(label.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    sizes = member.groupBy("value", "component").count()
    sizes = sizes.groupBy("value").agg(F.sum("count").alias("all"), F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("most"))
    sizes = checkpoint(sizes.filter("most < all"))
    member = checkpoint(join_spread(member, sizes, ["value"], by="set_id", counts=sizes.select("value", F.col("all").alias("count"))))
    short = member.filter(F.col("all") <= SHORT)
    tasks = short.count() // SHORT_ROWS + 1
    short = short.select("value", "coordinate", "set_id", "prefix", "component").join(values.select("set_id", "signature"), "set_id")
    short = short.groupBy(F.pmod(F.xxhash64("value"), F.lit(tasks)).alias("task")).applyInArrow(_counted_short(least), "a binary, b binary")
    links = links.union(verified(checkpoint(short)))

    member = member.filter(F.col("all") > SHORT).withColumns({"ni": F.ceil((F.col("all") - F.col("most")) / BLOCK_A), "nj": F.ceil(F.col("all") / BLOCK_B), "h": F.xxhash64("set_id")})
    columns = ["value", "coordinate", "set_id", "prefix", "component"]
    side_a = member.filter("component != main").select(*columns, F.lit("a").alias("role"), F.pmod("h", "ni").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1)).alias("j"))
    side_b = member.select(*columns, F.lit("b").alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)).alias("i"), F.pmod("h", "nj").alias("j"))
    blocks = side_a.unionByName(side_b).join(values.select("set_id", "signature"), "set_id")
    counted = blocks.groupBy("value", "i", "j").applyInPandas(_counted(least), "value long, i long, j long, role string, set_id binary, component binary")
    more = checkpoint(counted.join(full, "set_id").groupBy("value", "i", "j").applyInPandas(_checked(percent), "a binary, b binary"))

    label = components(links.union(more)).withColumnRenamed("node", "set_id")
    of_set = checkpoint(values.select("set_id", "first").join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")))
    least_id = of_set.groupBy("component").agg(F.min("first").alias("component_id"))
    of_set = join_spread(of_set, least_id, ["component"]).select("set_id", "component_id")
    out = join_spread(rows.select("doc_id", "n_shingles", "set_id"), of_set, ["set_id"], "left")
    alone = F.when(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
