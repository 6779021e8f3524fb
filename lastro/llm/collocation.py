"""Phrase collocations: sketch bounds, guarded automata over shards, scores.

A first pass counts words and pairs of each task's texts in a sketch of CELLS counters; the
tasks' sketches are summed cell by cell, and what stays is a bit for each cell whose sum reaches
the threshold. A phrase's cell is an upper bound of its count, so a phrase without a bit is rare.
A second pass does the same for longer phrases, of which only those count whose pairs all have
their bits. A third pass cuts texts into shards of a task. The phrases of a shard whose bits are set are
compiled into pyahocorasick automata, each pattern between delimiters, so that no part of a
word matches; the shard's text is scanned with overlapping matches. Counts are summed over a
task's shards, then over tasks, and only then compared with the threshold. An automaton thus
holds what one shard has at most, however many candidates the corpus has.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastro.llm.common import checkpoint, importable, join_spread, mix64, shuffle_partitions, text_slices

#: Counters of the sketch, and of one row of it; a counter stops at 255, so thresholds above that count whole words instead.
CELLS, BLOCK = 1 << 26, 1 << 16
#: Words of a shard, and characters of an automaton's patterns, at most.
SHARD_WORDS, AUTOMATON_CHARS = 2_000_000, 4_000_000
#: Bytes of text that a task takes at least, where there are tasks enough, and phrases whose counts it sums before it hands them on.
TASK_BYTES, HELD_PHRASES = 64 << 20, 1_000_000
#: Bytes of text that are split at once.
PART = 4 << 20
LONGEST = 4

_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _split(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Words of concatenated texts in parts: number in the part's list, piece, place of the first byte, and the list.

    starts: where texts begin. Pieces are numbered on over all parts; a part ends where a word does.
    """
    begin, pieces = 0, 0
    while begin < len(data):
        end = min(begin + PART, len(data))
        while end < len(data) and not _KIND[data[end - 1]]:  # a long word isn't cut
            more = np.flatnonzero(_KIND[data[end : end + PART]])
            end = end + int(more[0]) + 1 if len(more) else min(end + PART, len(data))
        part = data[begin:end]
        kind = _KIND[part]
        inside = kind == 0
        first = np.zeros(len(part), bool)
        first[starts[np.searchsorted(starts, begin) : np.searchsorted(starts, end)] - begin] = True
        piece = np.cumsum(first | (kind == 2), dtype=np.int64) + pieces
        pieces = int(piece[-1])
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:]
        at = np.flatnonzero(opens)
        if len(at):
            places = np.cumsum(inside, dtype=np.int32)
            offsets = np.append(places[at] - 1, places[-1]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[part[inside]])])
            coded = words.dictionary_encode()
            yield coded.indices.to_numpy(), piece[at], at + begin, [w.decode("utf-8", "replace") for w in coded.dictionary.to_pylist()]
        begin = end


def _words(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[str]]]:
    """A batch's words by language: language, numbers, pieces, list."""
    text = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    if offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    langs = batch.column("lang").dictionary_encode()
    codes, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
    starts = offsets - offsets[0]
    for number, piece, at, words in _split(data, np.unique(starts[:-1][np.diff(starts) > 0])):
        own = codes[np.searchsorted(starts, at, side="right") - 1]
        for k in np.unique(own).tolist():
            mine = own == k
            yield names[k], number[mine], piece[mine], words


def _hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")) & 0xFFFFFFFF
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), seed) for w in words), np.uint64, len(words))


def _cells(own: np.ndarray, n: int) -> np.ndarray:
    """Cells of the n consecutive words that begin at each word."""
    long = len(own) - n + 1
    mixed = np.full(max(long, 0), n, np.uint64)
    for k in range(n):
        mixed = mix64(mixed + own[k : k + long] * np.uint64(2 * k + 1))
    return (mixed & np.uint64(CELLS - 1)).astype(np.int64)


def _together(piece: np.ndarray, n: int) -> np.ndarray:
    return piece[: len(piece) - n + 1] == piece[n - 1 :] if len(piece) >= n else np.zeros(0, bool)


def _sketch(least: int, pairs: bytes | None):
    """Counts words and pairs or, where the pairs' bits are known, phrases of three and four words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.uint8)
        bits = None if pairs is None else np.frombuffer(pairs, np.uint8)
        for batch in text_slices(batches, "text", PART):
            for lang, number, piece, words in _words(batch):
                own = _hashes(lang, words)[number]
                if bits is None:
                    found = [_cells(own, n)[_together(piece, n)] for n in (1, 2)]
                else:
                    two = may = _pairs(own, piece, bits)
                    found = []
                    for n in range(3, LONGEST + 1):
                        may = may[:-1] & two[n - 2 :]
                        found.append(_cells(own, n)[may])
                cells = np.sort(np.concatenate(found))
                if len(cells):
                    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                    at, many = cells[first], np.diff(np.append(first, len(cells)))
                    table[at] = np.minimum(table[at] + many, least)
        blocks = table.reshape(-1, BLOCK)
        codec = pa.Codec("zstd", compression_level=1)
        for k in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counts": pa.array([codec.compress(blocks[k].tobytes(), asbytes=True)], pa.binary())})

    return run


def _sum(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd")
        for batch in batches:
            for k, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(codec.decompress(packed, BLOCK, asbytes=True), np.uint8)
                # Counters stop at the threshold, so two of them fit 16 bits.
                held[k] = np.minimum(held[k].astype(np.uint16) + counts, least).astype(np.uint8) if k in held else counts
        for k, counts in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(counts >= least).tobytes()], pa.binary())})

    return run


def upper_bounds(docs: DataFrame, least: int, pairs: bytes | None = None) -> bytes:
    """A bit for each cell of the sketch of words and pairs, or of longer phrases made of such pairs: whether its count reaches `least`.

    CELLS / 8 bytes, whatever the corpus.
    """
    counted = docs.mapInArrow(_sketch(min(least, 255), pairs), "block int, counts binary")
    summed = counted.repartition(shuffle_partitions(docs.sparkSession), "block").mapInArrow(_sum(min(least, 255)), "block int, bits binary")
    out = np.zeros((CELLS // BLOCK, BLOCK // 8), np.uint8)
    for row in summed.collect():  # 8 KB each, CELLS / BLOCK of them at most
        out[row.block] = np.frombuffer(bytes(row.bits), np.uint8)
    return out.tobytes()


def _frequent(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def _pairs(own: np.ndarray, piece: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each word and the next are in one piece and may be frequent."""
    out = _together(piece, 2)
    at = np.flatnonzero(out)
    out[at] = _frequent(bits, _cells(own, 2)[at])
    return out


def _scan(lang: str, ids: np.ndarray, piece: np.ndarray, words: list[str], bits: np.ndarray, longer: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Phrases of one language's shard that may be frequent, words among them, and their counts."""
    own = _hashes(lang, words)[ids]
    many, counts = len(words), np.bincount(ids, minlength=len(words))
    single = np.flatnonzero((counts > 0) & _frequent(bits, _cells(_hashes(lang, words), 1)))
    phrases, found = [words[i] for i in single.tolist()], [counts[single]]
    # A phrase is a candidate where its parts are and its own bound allows.
    may = {2: _pairs(own, piece, bits)}
    for n in range(3, LONGEST + 1):
        may[n] = may[n - 1][:-1] & may[n - 1][1:]
        at = np.flatnonzero(may[n])
        may[n][at] = _frequent(longer, _cells(own, n)[at])
    patterns: list[str] = []
    pair = np.zeros(max(len(ids) - 1, 0), np.int64)
    for n in range(2, LONGEST + 1):
        at = np.flatnonzero(may[n])
        # Exact keys of equal phrases, from their words' numbers.
        key = ids[at].astype(np.int64) * many + ids[at + 1] if n == 2 else pair[at] * (many if n == 3 else len(ids)) + (ids[at + 2] if n == 3 else pair[at + 2])
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        if n == 2:
            pair[at] = same
        for i in at[first].tolist():
            patterns.append(" ".join([words[j] for j in ids[i : i + n].tolist()]))
    if patterns:
        # Only words that stand beside a candidate are scanned; a line is a run of them.
        run = np.zeros(len(ids), bool)
        run[:-1] |= may[2]
        run[1:] |= may[2]
        kept = np.flatnonzero(run)
        joined = np.append(may[2], False)[kept]
        text = " " + "".join([words[i] + (" " if on else " \n ") for i, on in zip(ids[kept].tolist(), joined.tolist(), strict=True)])
        totals = np.zeros(len(patterns), np.int64)
        begin, chars = 0, 0
        for k in range(len(patterns) + 1):
            if k == len(patterns) or (chars > AUTOMATON_CHARS and k > begin):
                totals[begin:k] = _count(patterns[begin:k], text)
                begin, chars = k, 0
            if k < len(patterns):
                chars += len(patterns[k])
        if totals.sum() != sum(int(m.sum()) for m in may.values()):
            raise AssertionError("automata found other places than the candidates'")
        phrases += patterns
        found.append(totals)
    return phrases, np.concatenate(found)


def _count(patterns: list[str], text: str) -> np.ndarray:
    """Overlapping matches of each pattern between delimiters."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(patterns):
        automaton.add_word(f" {phrase} ", i)
    automaton.make_automaton()
    hits = np.fromiter((i for _, i in automaton.iter(text)), np.int32)
    return np.bincount(hits, minlength=len(patterns))


COUNTS = "lang string, size int, phrase string, f long"


def _shards(packed: bytes, packed_longer: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, longer = np.frombuffer(packed, np.uint8), np.frombuffer(packed_longer, np.uint8)
        known: dict[str, int] = {}
        held: dict[str, list] = {}
        summed: dict[str, dict[str, int]] = {}
        sizes: dict[str, int] = {}
        total = pieces = 0

        def scan() -> None:
            words = list(known)
            while held:
                lang, parts = held.popitem()
                ids, piece = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                del parts
                sizes[lang] = sizes.get(lang, 0) + len(ids)
                own = summed.setdefault(lang, {})
                for phrase, n in zip(*(x if isinstance(x, list) else x.tolist() for x in _scan(lang, ids, piece, words, bits, longer)), strict=True):
                    own[phrase] = own.get(phrase, 0) + n
            known.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in summed.items():
                phrases, many = [*own, None], [*own.values(), sizes[lang]]
                for a in range(0, len(phrases), 20_000):
                    some, n = phrases[a : a + 20_000], many[a : a + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array([0 if p is None else p.count(" ") + 1 for p in some], pa.int32()), pa.array(some, pa.string()), pa.array(n, pa.int64())], names=["lang", "size", "phrase", "f"]
                    )
            summed.clear()
            sizes.clear()

        for batch in text_slices(batches, "text", PART):
            top = pieces
            for lang, number, piece, words in _words(batch):
                own = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
                held.setdefault(lang, []).append((own[number], piece + pieces))
                total, top = total + len(number), max(top, pieces + int(piece[-1]))
            pieces = top + 1
            if total > SHARD_WORDS:
                scan()
                total = pieces = 0
                if sum(map(len, summed.values())) > HELD_PHRASES:
                    yield from out()
        scan()
        yield from out()

    return run


def counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """lang, size, phrase, f of all phrases of 1 to 4 words that occur `least` times, exactly; size 0: all words of a language."""
    importable(docs.sparkSession)
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null and text <> ''")
    spark = docs.sparkSession
    size = read.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    read = read.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    pairs = upper_bounds(read, least)
    found = read.mapInArrow(_shards(pairs, upper_bounds(read, least, pairs)), COUNTS)
    return checkpoint(found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter((F.col("size") == 0) | (F.col("f") >= least)))


def _whole(c: str):
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, most: int = 2000) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    docs: lang, text; other columns have no part in it. Texts lose A-Z's case, are split at
    `[.,;:!?\\x0A-\\x0D]` into pieces and those at blanks and tabs into words. a is the count of
    a phrase of 2 to 4 words, overlaps included, l and r those of its two parts at the cut whose
    floor(2000000 a / (l + r)), the score, is least (ties: the first cut), n all words of the
    language. Phrases inside a longer one of which 100 f >= `inside` a are dropped, the `most`
    best by score, a, phrase stay; arithmetic is exact.

    A null lang is `und` and shares its counts; null and empty texts have no words; repeated
    rows count each; an empty table, or none with a phrase of `least` occurrences, gives no rows.
    Bytes that aren't UTF-8 read as U+FFFD. Texts of any length are read whole.
    """
    table = counts(docs, least)
    known = table.filter("size > 0").select("lang", "size", "phrase", "f")
    candidates = known.filter("size > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    longer = candidates.filter("size > 2").withColumn("w", words).select(
        "lang", F.col("a").alias("whole"),
        F.explode(F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> array_join(slice(w, i, s), ' '))))")).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    drop = F.col("whole").isNotNull() & (_whole("whole") * F.lit(100) >= _whole("a") * F.lit(inside))
    kept = checkpoint(candidates.join(longer, ["lang", "phrase"], "left").filter(~drop).select("lang", "phrase", "size", "a"))

    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    # A frequent word begins or ends many phrases: its rows are dealt over tasks.
    left = join_spread(cuts, known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"], by="phrase")
    both = join_spread(left, known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], by="phrase")
    score = F.expr("(cast(a as decimal(19,0)) * 2000000BD) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    sizes = table.filter("size = 0").select("lang", F.col("f").alias("n"))
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
