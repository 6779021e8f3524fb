"""Exact removal of repeated byte strings by per-shard suffix arrays.

A byte is removed if a string of `width` bytes that covers it also starts earlier
(smaller doc_id, or same document and earlier start). Matches never cross
documents; strings are judged on the input.

1. Every start of a full-width string is given an anchor: the least hash among the
   string's inner `GRAM`-byte grams. Equal strings have equal anchors, so only
   starts with the same anchor can match. Consecutive starts with one anchor form a
   run of about 27 starts. Documents are dealt into blocks by their ids; a block
   sends, per bucket of anchors, one compact array of (anchor, digest of the run's
   text, document), each text once.
2. A bucket sees which anchors occur with one text only (nothing to do, beyond the
   text's first run: its other runs are removed whole) and which occur with several
   texts. It answers each block with a code per run.
3. The first runs of texts whose anchor has several texts go, as text, to shards by
   their anchors. A shard lays them out in document order, builds the suffix array
   by Larsson-Sadakane refinement (groups of equal prefixes are refined by the ranks
   half a prefix further; sorted suffixes drop out), and the longest common prefixes
   by Kasai's rule, in lanes. Neighbours with a common prefix of `width` bytes or
   more are equal strings; all but the first in the layout are removed.
4. An anchor with more texts than a shard holds (a line on a third of all pages) is
   dealt over several shards. Each sends its first occurrences as a sorted run cut
   by binary search at fixed bounds of the strings' hashes; each range is merged by
   binary search of every run in the range's earliest owners.
5. Blocks of documents and their removed ranges meet once more to drop the bytes.

Texts within a block are compared as bytes. Across blocks and shards they are equal if
128 bits agree (32 of the anchor and 96 of the text; 128 for strings) of BLAKE2b under a
key drawn for each query: of 10 ** 13 texts any two do so by chance with a probability
below 10 ** -12, and nobody can choose texts that do.

An anchor that very many runs have would crowd its bucket. A small sample of documents
tells which ones do; such an anchor's runs go to buckets by their texts instead, and for
texts that very many blocks have by groups of blocks too. Whichever of its runs stand for
an equal text in some bucket are then compared as a hot anchor's. So the sample has no
part in the result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lastro.llm.common import RollingHash, checkpoint, held, importable, mix64, tidy

GRAM = 48
#: Starts of a run at most.
RUN = 256
#: Bytes of documents in a block, bytes of documents for each bucket, bytes in a shard.
#: A block's and a shard's arrays take about 100 bytes for each of theirs in a Python worker.
BLOCK_BYTES, BUCKET_BYTES, SHARD_BYTES = 1 << 20, 16 << 20, 1 << 20
#: Texts of one anchor beyond which it is dealt over several shards.
HOT_TEXTS = 8192
#: Runs of one anchor beyond which it is dealt over several buckets; least bytes and least share of a sample
#: that finds such anchors; anchors at most (others stay in one bucket); blocks that may send one text to one bucket.
HOT_RUNS, SAMPLE_BYTES, SAMPLE_SHARE, MOST_ANCHORS, TOGETHER = 1 << 20, 16 << 20, 4e-5, 1 << 16, 1 << 16
NOTHING, REPEATED, COMPARE, COMPARE_HOT = range(4)
ONE, TWO = held(RollingHash(0x9E3779B97F4A7C15)), held(RollingHash(0xC2B2AE3D27D4EB4F))
LAST = (1 << 63) - 1


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and each suffix's place. (Kasai's rule needs the whole order.)

    Larsson-Sadakane: a suffix's rank is the last place of its group; a group is
    sorted by the ranks of what stands h bytes further on, h doubling.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    _number(head, order, rank, np.arange(n))
    h, todo = 8, _unsorted(head)
    while len(todo):
        at = order[todo]
        group = rank[at]
        further = at + h
        second = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        both = group << 32 | second
        by = np.argsort(both, kind="stable")
        order[todo], both = at[by], both[by]
        head = np.ones(len(todo), bool)
        head[1:] = both[1:] != both[:-1]
        _number(head, order[todo], rank, todo)
        todo = todo[_unsorted(head)]
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def _number(head: np.ndarray, suffixes: np.ndarray, rank: np.ndarray, places: np.ndarray) -> None:
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(head)) - 1
    rank[suffixes] = np.repeat(places[last], np.diff(np.append(first, len(head))))


def _unsorted(head: np.ndarray) -> np.ndarray:
    """Places in groups of two or more."""
    alone = head.copy()
    alone[:-1] &= head[1:]
    return np.flatnonzero(~alone)


def common_prefixes(text: np.ndarray, order: np.ndarray, place: np.ndarray, cap: int, lanes: int = 8192) -> np.ndarray:
    """At each place, the common prefix with the place before, up to cap (Kasai's rule).

    The text is cut into lanes that advance together, one comparison at a time; a
    lane's next suffix starts with what the one before it had, less one.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    lanes = max(1, min(lanes, n // 64))
    bounds = np.linspace(0, n, lanes + 1).astype(np.int64)
    p, stop, common = bounds[:-1].copy(), bounds[1:], np.zeros(lanes, np.int64)
    padded = np.concatenate((text, np.zeros(cap + 1, np.uint8)))
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    live = np.flatnonzero(p < stop)
    while len(live):
        at, have = p[live], common[live]
        other = before[at]
        same = (other >= 0) & (have < cap) & (at + have < n) & (other + have < n)
        same &= padded[at + have] == padded[other + have]
        common[live[same]] += 1
        over = live[~same]
        out[place[p[over]]] = common[over]
        p[over] += 1
        common[over] = np.maximum(common[over] - 1, 0)
        live = live[p[live] < stop[live]]
    return out


def runs(data: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: first start, starts, anchor, hash of the run's text,
    whether the anchor stands at two places of the run.

    data: texts one after the other; begin: where each begins (one more than texts).
    """
    empty = np.empty(0, np.int64)
    n = len(data)
    if n < width:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty.astype(bool)
    values = mix64(np.arange(1, 257, dtype=np.uint64))[data]
    prefix = ONE.prefix(values)
    p = np.arange(n - GRAM + 1)
    grams = least = ONE.ranges(prefix, p, p + GRAM)
    window, size = width - GRAM + 1, 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if window > size:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    valid = np.ones(len(least), bool)
    for b in (begin[1:-1, None] - np.arange(1, width)[None, :],) if len(begin) > 2 else ():
        b = b[(b >= 0) & (b < len(valid))]
        valid[b] = False
    first = valid.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    parts = -(-(stop - start) // RUN)
    if len(parts) and parts.max() > 1:
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + inner * RUN
        stop = np.minimum(np.repeat(stop, parts), start + RUN)
    # A string twice in one run has its anchor at two places of the run.
    again, span = np.zeros(len(start), bool), np.arange(window)
    for k in range(0, len(start), 1 << 14):
        a, z = start[k : k + (1 << 14)], stop[k : k + (1 << 14)] - 1
        value = least[a][:, None]
        first_at = a + np.argmax(grams[a[:, None] + span] == value, axis=1)
        last_at = z + window - 1 - np.argmax(grams[z[:, None] + span[::-1]] == value, axis=1)
        again[k : k + (1 << 14)] = first_at != last_at
    return start, stop - start, least[start], TWO.ranges(TWO.prefix(values), start, stop + width - 1), again


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray, key: bytes, size: int) -> bytes:
    """Keyed digests of data[start:stop], one after the other."""
    view = memoryview(data)
    return b"".join([hashlib.blake2b(view[a:z], digest_size=size, key=key).digest() for a, z in zip(start.tolist(), stop.tolist(), strict=True)])


class Block:
    """The documents of one block, in order, with their runs."""

    def __init__(self, rows: pa.Table, width: int, with_runs: bool = True):
        texts = [x or b"" for x in rows.column("text").to_pylist()]
        ids = [LAST if x is None else x for x in rows.column("doc_id").to_pylist()]
        self.rows = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), np.int64)
        self.ids = np.array([ids[i] for i in self.rows], np.int64)
        self.texts = [texts[i] for i in self.rows]
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        if with_runs:
            self.start, self.count, self.anchor, self.text, self.again = runs(self.data, self.begin, width)
            self.doc = np.searchsorted(self.begin, self.start, side="right") - 1
            self.stop = self.start + self.count + width - 1
            by = np.lexsort((self.text, self.anchor))
            new = np.ones(len(by), bool)
            new[1:] = (self.anchor[by][1:] != self.anchor[by][:-1]) | (self.text[by][1:] != self.text[by][:-1])
            self.own = np.zeros(len(by), bool)  # the first run with its text in this block
            self.own[by[new]] = True  # lexsort keeps the order of equals
            self._verify(by[~new], by[np.flatnonzero(new)[np.cumsum(new) - 1]][~new])

    def _verify(self, runs: np.ndarray, stand: np.ndarray) -> None:
        """Runs whose bytes aren't those of the run that stands for them stand for themselves."""
        size = (self.stop - self.start)[runs]
        same = size == (self.stop - self.start)[stand]
        self.own[runs[~same]] = True
        runs, stand, size = runs[same], stand[same], size[same]
        for a in range(0, len(runs), 4096):
            r, s, n = runs[a : a + 4096], stand[a : a + 4096], size[a : a + 4096]
            upto = np.cumsum(n) - n
            place = np.arange(n.sum())
            equal = self.data[place + np.repeat(self.start[r] - upto, n)] == self.data[place + np.repeat(self.start[s] - upto, n)]
            self.own[r[~np.logical_and.reduceat(equal, upto)]] = True

    def sent(self, buckets: int, number: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs that are sent, by bucket; the buckets that have any, and where each begins and ends. hot: the leading 32 bits of anchors that are dealt over buckets."""
        at = np.flatnonzero(self.own)
        by_anchor = self.anchor[at]
        crowded = np.isin(by_anchor >> np.uint64(32), hot)
        by_text = mix64(by_anchor + mix64(self.text[at]) + np.uint64(number // TOGETHER))
        bucket = (np.where(crowded, by_text, by_anchor) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        own, first = np.unique(bucket[by], return_index=True)
        return at[by], own, np.append(first, len(by))


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: zero planes then compress to nothing."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _send(width: int, buckets: int, hot: np.ndarray, secret: bytes):
    def run(key, rows):
        tidy()
        block = Block(rows, width)
        at, there, upto = block.sent(buckets, key[0].as_py(), hot)
        out = {"bucket": [], "block": [], "anchors": [], "texts": [], "docs": []}
        for k, b in enumerate(there.tolist()):  # a block has few buckets, however many there are
            own = at[upto[k] : upto[k + 1]]
            out["bucket"].append(b)
            out["block"].append(key[0].as_py())
            out["anchors"].append((block.anchor[own] >> np.uint64(32)).astype(np.uint32).tobytes())
            out["texts"].append(digests(block.data, block.start[own], block.stop[own], secret, TEXT.itemsize))
            out["docs"].append(planes(block.ids[block.doc[own]]))
        return pa.table({k: pa.array(v, pa.int64() if k in ("bucket", "block") else pa.binary()) for k, v in out.items()})

    return run


#: The digest of a run's text.
TEXT = np.dtype([("a", "<u8"), ("b", "<u4")])


def _answer(hot: int, crowded: np.ndarray):
    def run(key, rows):
        tidy()
        blocks = rows.column("block").to_numpy()
        anchors = [np.frombuffer(x, np.uint32) for x in rows.column("anchors").to_pylist()]
        sizes = np.array([len(x) for x in anchors])
        anchor = np.concatenate(anchors)
        text = np.concatenate([np.frombuffer(x, TEXT) for x in rows.column("texts").to_pylist()])
        text_a, text_b = text["a"], text["b"]
        doc = np.concatenate([unplanes(x, np.int64) for x in rows.column("docs").to_pylist()])
        code = np.zeros(len(anchor), np.uint8)
        by = np.argsort(anchor, kind="stable")
        same = anchor[by][1:] == anchor[by][:-1]
        several = np.zeros(len(by), bool)
        several[1:] |= same
        several[:-1] |= same
        at = np.sort(by[several])
        if len(at):
            at = at[np.lexsort((np.repeat(blocks, sizes)[at], doc[at], text_b[at], text_a[at], anchor[at]))]
            new_anchor, new_text = np.ones(len(at), bool), np.ones(len(at), bool)
            new_anchor[1:] = anchor[at][1:] != anchor[at][:-1]
            new_text[1:] = new_anchor[1:] | (text_a[at][1:] != text_a[at][:-1]) | (text_b[at][1:] != text_b[at][:-1])
            group = np.cumsum(new_anchor) - 1
            texts = np.bincount(group, weights=new_text)[group]
            code[at] = np.where(~new_text, REPEATED, np.where(texts > hot, COMPARE_HOT, np.where(texts > 1, COMPARE, NOTHING)))
        # Elsewhere more texts have such an anchor.
        code[np.isin(anchor, crowded) & (code != REPEATED)] = COMPARE_HOT
        cut = np.cumsum(sizes)[:-1]
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(blocks), pa.int64()), "codes": pa.array([x.tobytes() for x in np.split(code, cut)], pa.binary())})

    return run


REMOVED = "block long, row long, start long, size long"


def _ranges(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching ranges of each document as one."""
    by = np.lexsort((start, doc))
    doc, start, stop = doc[by], start[by], stop[by]
    if not len(doc):
        return doc, start, stop
    shift = doc * (int(stop.max()) + 2)  # documents apart
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach[np.append(first[1:], len(doc)) - 1] - shift[first])


def _decide(width: int, buckets: int, hot: np.ndarray):
    """What the answers decide, as ranges, and the runs to compare, as text."""

    def run(key, rows, answers):
        tidy()
        number = key[0].as_py()
        block = Block(rows, width)
        code = np.where(block.own, NOTHING, REPEATED).astype(np.uint8)
        at, there, upto = block.sent(buckets, number, hot)
        places = np.searchsorted(there, answers.column("bucket").to_numpy())
        for k, codes in zip(places.tolist(), answers.column("codes").to_pylist(), strict=True):
            code[at[upto[k] : upto[k + 1]]] = np.frombuffer(codes, np.uint8)
        code[(code == NOTHING) & block.again] = COMPARE
        gone = np.flatnonzero(code == REPEATED)
        d = block.doc[gone]
        s = block.start[gone] - block.begin[d]
        d, s, e = _ranges(d, s, s + block.count[gone] + width - 1)
        more = np.flatnonzero(code >= COMPARE)
        md = block.doc[more]
        a, z = block.start[more], block.start[more] + block.count[more] + width - 1
        none = [None] * len(d)
        data = block.data.tobytes() if len(more) else b""
        return pa.table({
            "block": pa.array([number] * (len(d) + len(more)), pa.int64()),
            "row": pa.array(np.concatenate((d, md)), pa.int64()),
            "start": pa.array(np.concatenate((s, a - block.begin[md])), pa.int64()),
            "size": pa.array(np.concatenate((e - s, block.count[more])), pa.int64()),
            "doc_id": pa.array([*none, *block.ids[md].tolist()], pa.int64()),
            "anchor": pa.array([*none, *block.anchor[more].view(np.int64).tolist()], pa.int64()),
            "hot": pa.array([*none, *(code[more] == COMPARE_HOT).tolist()], pa.bool_()),
            "text": pa.array([*none, *[data[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]], pa.binary()),
        })

    return run


class Shard:
    """Runs' texts laid out in document order, with the groups of equal strings."""

    def __init__(self, rows: pa.Table, width: int):
        number = {c: rows.column(c).to_numpy() for c in ("doc_id", "block", "row", "start", "size")}
        by = np.lexsort((number["start"], number["row"], number["block"], number["doc_id"]))
        self.of = {c: x[by] for c, x in number.items()}
        texts = rows.column("text").to_pylist()
        self.hot = rows.column("hot").to_numpy()[by]
        parts = [texts[i] for i in by.tolist()]
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in parts]))).astype(np.int64)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        order, place = suffix_array(self.data)
        common = common_prefixes(self.data, order, place, width)
        group = np.cumsum(common < width) - 1
        size = self.of["size"]
        upto = np.cumsum(size)
        self.run = np.repeat(np.arange(len(size)), size)
        self.at = np.arange(upto[-1]) - (upto - size)[self.run] + self.begin[:-1][self.run]
        group = group[place[self.at]]
        first = np.full(len(self.data), len(self.at), np.int64)
        np.minimum.at(first, group, np.arange(len(self.at)))
        self.repeated = first[group] != np.arange(len(self.at))

    def removed(self, which: np.ndarray, width: int) -> pa.Table:
        run = self.run[which]
        start = self.at[which] - self.begin[:-1][run] + self.of["start"][run]
        document = run  # ranges of one run at a time; blocks join them
        d, s, e = _ranges(document, start, start + width)
        return pa.table({"block": pa.array(self.of["block"][d], pa.int64()), "row": pa.array(self.of["row"][d], pa.int64()), "start": pa.array(s, pa.int64()), "size": pa.array(e - s, pa.int64())})


def _compare(width: int):
    def run(key, rows):
        tidy()
        shard = Shard(rows, width)
        return shard.removed(np.flatnonzero(shard.repeated), width)

    return run


def _compare_hot(width: int, ranges: int, secret: bytes):
    """A hot shard's repeated starts (range null), and its first occurrences as sorted runs."""

    def run(key, rows):
        tidy()
        shard = Shard(rows, width)
        gone = shard.removed(np.flatnonzero(shard.repeated), width)
        n = len(gone)
        keep = np.flatnonzero(~shard.repeated)
        one, two = np.ascontiguousarray(np.frombuffer(digests(shard.data, shard.at[keep], shard.at[keep] + width, secret, 16), np.uint64).reshape(-1, 2).T)
        by = np.lexsort((two, one))
        keep, one, two = keep[by], one[by], two[by]
        cut = np.searchsorted(one >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64) * np.uint64((1 << 32) // ranges + 1))
        r = shard.run[keep]
        columns = {"one": one, "two": two, "docs": shard.of["doc_id"][r], "blocks": shard.of["block"][r], "rows": shard.of["row"][r], "starts": shard.at[keep] - shard.begin[:-1][r] + shard.of["start"][r]}
        some = [k for k in range(ranges) if cut[k + 1] > cut[k]]
        out = {c: pa.concat_arrays([gone.column(c).combine_chunks(), pa.nulls(len(some), pa.int64())]) for c in gone.column_names}
        out["range"] = pa.array([None] * n + some, pa.int64())
        for c, x in columns.items():
            out[c] = pa.array([None] * n + [x[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())
        return pa.table(out)

    return run


def _merge(width: int):
    """One range of strings: each run is looked up among the range's earliest owners."""

    def run(key, rows):
        tidy()
        parts = {c: [np.frombuffer(x, np.uint64 if c in ("one", "two") else np.int64) for x in rows.column(c).to_pylist()] for c in ("one", "two", "docs", "blocks", "rows", "starts")}
        all_ = {c: np.concatenate(x) for c, x in parts.items()}
        by = np.lexsort((all_["starts"], all_["rows"], all_["blocks"], all_["docs"], all_["two"], all_["one"]))
        one, two = all_["one"][by], all_["two"][by]
        new = np.ones(len(by), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        owner, both = by[new], np.array([one[new], two[new]])
        gone, base = [], 0
        joint = both[0] ^ mix64(both[1])
        sort = np.argsort(joint)
        for a, b in zip(parts["one"], parts["two"], strict=True):
            at = sort[np.searchsorted(joint[sort], a ^ mix64(b))]
            gone.append(base + np.flatnonzero(owner[at] != base + np.arange(len(a))))
            base += len(a)
        g = np.concatenate(gone)
        return pa.table({"block": pa.array(all_["blocks"][g]), "row": pa.array(all_["rows"][g]), "start": pa.array(all_["starts"][g]), "size": pa.array(np.full(len(g), width))})

    return run


def _drop(width: int, with_text: bool, carried: list[str]):
    def run(key, rows, ranges):
        tidy()
        block = Block(rows, width, with_runs=False)
        number = {c: ranges.column(c).to_numpy() for c in ("row", "start", "size")} if len(ranges) else {c: np.empty(0, np.int64) for c in ("row", "start", "size")}
        d, s, e = _ranges(number["row"], number["start"], number["start"] + number["size"])
        upto = np.searchsorted(d, np.arange(len(block.texts) + 1))
        out = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i, text in enumerate(block.texts):
            own = slice(upto[i], upto[i + 1])
            begin, end = s[own].tolist(), e[own].tolist()
            kept = b"".join([text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True)]) if begin else text
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(begin))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode("utf-8", "ignore") if with_text else "")
        table = {**{c: rows.column(c).take(pa.array(block.rows)) for c in ("doc_id", *carried)}, "n_bytes": pa.array(np.diff(block.begin), pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        return pa.table(table | ({"kept": pa.array(out["kept"], pa.string())} if with_text else {}))

    return run


def _crowded(source: DataFrame, total: int, width: int) -> np.ndarray:
    """The leading 32 bits of anchors that about HOT_RUNS runs or more have, by a sample of documents."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(total, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            if batch.num_rows:
                anchors = np.concatenate([runs(np.frombuffer(t, np.uint8), np.array([0, len(t)]), width)[2] for t in batch.column("text").to_pylist()])
                value, n = np.unique(anchors >> np.uint64(32), return_counts=True)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(value.astype(np.int64)), "n": pa.array(n, pa.int64())})

    place = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30))
    counts = source.filter(place < int(share * (1 << 30))).select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    many = counts.filter(F.col("n") >= max(2, HOT_RUNS * share / 2)).orderBy(F.col("n").desc()).limit(MOST_ANCHORS).collect()
    return np.array(sorted(r.anchor for r in many), np.uint64)


def remove_repeats(docs: DataFrame, width: int = 100, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, carry: tuple[str, ...] = (), hot: int = HOT_TEXTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Removes every byte of a `width`-byte string that also starts earlier in the corpus.

    doc_id must be an integer column. Returns one row per row of docs: doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes), the
    columns named in carry and, if with_text, kept (the remaining text; a character that
    was cut apart goes as a whole). A null text counts as empty. Rows with one doc_id
    stand in the order of their texts, rows without an id after all others; each is
    returned. Other columns of docs are ignored whatever their names.
    """
    if width <= GRAM:
        raise ValueError(f"the width must be more than {GRAM} bytes")
    spark = docs.sparkSession
    importable(spark)
    carried = [f"carried_{i}" for i in range(len(carry))]
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, carried, strict=True)])
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = total // BLOCK_BYTES + 1, total // BUCKET_BYTES + 8
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    everything = source.withColumn("block", F.pmod(key, F.lit(blocks)))
    dealt = everything.select("doc_id", "text", "block")

    by_block, secret, crowded = dealt.groupBy("block"), os.urandom(16), _crowded(dealt, total, width)
    sent = by_block.applyInArrow(_send(width, buckets, crowded, secret), "bucket long, block long, anchors binary, texts binary, docs binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer(hot, crowded), "block long, bucket long, codes binary")
    decided = by_block.cogroup(answers.groupBy("block")).applyInArrow(_decide(width, buckets, crowded), f"{REMOVED}, doc_id long, anchor long, hot boolean, text binary")
    decided = checkpoint(decided)

    compare = decided.filter("text is not null")
    sizes = {r.hot: r.n for r in compare.groupBy("hot").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    removed = decided.filter("text is null").select("block", "row", "start", "size")
    if False in sizes:
        shards = sizes[False] // shard_bytes + 1
        removed = removed.union(compare.filter("not hot").groupBy(F.pmod("anchor", F.lit(shards)).alias("shard")).applyInArrow(_compare(width), REMOVED))
    if True in sizes:
        shards = sizes[True] // shard_bytes + 1
        dealt_hot = compare.filter("hot").groupBy(F.pmod(F.xxhash64("block", "row"), F.lit(shards)).alias("shard"))
        pieces = checkpoint(dealt_hot.applyInArrow(_compare_hot(width, min(shards * 8, 1 << 20), secret), f"{REMOVED}, range long, one binary, two binary, docs binary, blocks binary, rows binary, starts binary"))
        removed = removed.union(pieces.filter("range is null").select("block", "row", "start", "size"))
        removed = removed.union(pieces.filter("range is not null").groupBy("range").applyInArrow(_merge(width), REMOVED))
    whole = StructType([StructField("doc_id", LongType()), *[everything.schema[c] for c in carried], *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType()), *([StructField("kept", StringType())] if with_text else [])])
    out = everything.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(_drop(width, with_text, carried), whole)
    return out.select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), *[F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)], *whole.fieldNames()[1 + len(carried) :])
