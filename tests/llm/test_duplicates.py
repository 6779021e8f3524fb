import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lastro.llm import graph, hnsw, minhash, suffix
from lastro.llm.common import join_spread

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def roots(n, pairs):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def copies(seed=3):
    """Texts with groups of near copies of many degrees, a line that most share, exact copies."""
    source, out = random.Random(seed), []
    for _ in range(12):
        base = [source.choice(WORDS) for _ in range(source.choice([6, 40, 120]))]
        for _ in range(source.choice([1, 5, 9])):
            own = list(base)
            for _ in range(source.randrange(0, 8)):
                own[source.randrange(len(own))] = source.choice(WORDS)
            out.append(" ".join(own) + (" common line of words that many have" if source.random() < 0.5 else ""))
    return out + [out[0].upper(), out[0], "", "one", "one two", "\n\t", "one two"]


@pytest.mark.parametrize(("width", "short"), [(4, 48), (5, 48), (4, 2)])
def test_near_duplicates(spark, monkeypatch, width, short):
    monkeypatch.setattr(minhash, "SHORT", short)  # 2: every longer list goes by blocks
    texts = copies()
    docs = spark.createDataFrame([(i + 10, t, "x") for i, t in enumerate(texts)] + [(99999, None, "x"), (None, texts[0], "x")], "doc_id long, text string, component string")
    sets = [shingles(t, width) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = {i + 10: (len(s), r + 10) for i, (s, r) in enumerate(zip(sets, roots(len(texts), pairs), strict=True))} | {99999: (0, 99999)}
    got = minhash.near_duplicates(docs, width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, None)]


def test_near_duplicates_edges(spark):
    kind = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f")], kind)).collect()] == [(5, 2, 5, True)] * 2


def test_components(spark):
    source = random.Random(1)
    pairs = [(source.randrange(300), source.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    want = roots(500, pairs)
    assert got == {n: want[n] for n in {x for p in pairs for x in p}}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def without_repeats(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            if s in seen:
                gone[p : p + width] = True
            seen.add(s)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def passages(seed=5):
    source = random.Random(seed)
    shared = ["".join(source.choice("abcdeé \n") for _ in range(source.choice([99, 100, 101, 150, 700]))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [source.choice(shared) if source.random() < 0.6 else "".join(source.choice("abcdefgh ") for _ in range(source.randrange(0, 200))) for _ in range(source.randrange(0, 5))]
        rows.append((i, "".join(parts)))
    return rows + [(100, "ab" * 500), (101, "x" * 450), (102, "x" * 99), (103, "x" * 100), (104, rows[3][1]), (105, "".join(random.Random(1).choices("ab", k=3000)))]


@pytest.mark.parametrize(("hot", "shard", "runs"), [(8192, 1 << 20, 1 << 20), (2, 2000, 1 << 20), (0, 1 << 20, 1 << 20), (8192, 3000, 2), (3, 2000, 40)])
def test_remove_repeats(spark, monkeypatch, hot, shard, runs):
    monkeypatch.setattr(suffix, "HOT_RUNS", runs)  # 2: most anchors are dealt over buckets
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix, "TOGETHER", 3)
    rows = passages()
    docs = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, block string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, hot=hot, shard_bytes=shard).collect()}
    assert got == without_repeats(rows)


def test_crowded_anchors_are_found(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_RUNS", 100)
    line = "a line of more than a hundred characters that every one of these documents has somewhere in its text, and that says nothing"
    docs = spark.createDataFrame([(i, f"{hashlib.sha256(bytes([i])).hexdigest() * 3} {line}".encode()) for i in range(200)], "doc_id long, text binary")
    found = suffix._crowded(docs, 80_000, 100)
    assert 1 <= len(found) <= 8
    assert len(suffix._crowded(docs.limit(0), 0, 100)) == 0


def test_equal_hashes_are_not_taken_for_equal_texts(monkeypatch):
    """All runs' hashes agree; bytes tell them apart."""
    ranges = suffix.RollingHash.ranges

    def collide(self, prefix, start, end):
        return ranges(self, prefix, start, end) if self.base == suffix.ONE.base else np.zeros(len(start), np.uint64)

    monkeypatch.setattr(suffix.RollingHash, "ranges", collide)
    rows = passages()
    docs = pa.table({"doc_id": [i for i, _ in rows], "text": [t.encode() for _, t in rows]})
    block = suffix.Block(docs, 100)
    texts = [block.data[a:z].tobytes() for a, z in zip(block.start, block.stop, strict=True)]
    kept = {(int(a), t) for a, t, o in zip(block.anchor, texts, block.own, strict=True) if o}
    assert (block.text == 0).all() and kept == {(int(a), t) for a, t in zip(block.anchor, texts, strict=True)}


def test_remove_repeats_edges(spark):
    kind = "doc_id long, text string, lang string"
    assert suffix.remove_repeats(spark.createDataFrame([], kind)).count() == 0
    text = "é" * 20 + "".join(random.Random(4).choices("abc", k=200))
    size = len(text.encode())
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame([(1, text, "a"), (1, text, None), (None, text, "n"), (2, None, "e")], kind), carry=("lang",)).collect())
    assert got == [(0, size), (1, 0), (1, size), (2, 0)]
    with pytest.raises(ValueError):
        suffix.remove_repeats(spark.createDataFrame([], kind), width=20)


@pytest.mark.parametrize("text", [b"", b"a", b"banana", b"aaaaaaaaaa" * 30, bytes(random.Random(1).choices(b"ab", k=3000)), bytes(range(256)) * 3])
def test_suffix_array(text):
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return
    order, place = suffix.suffix_array(data)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == want and place[order].tolist() == list(range(len(text)))
    common = suffix.common_prefixes(data, order, place, 50, lanes=7)

    def lcp(a, b):
        n = 0
        while max(a, b) + n < len(text) and n < 50 and text[a + n] == text[b + n]:
            n += 1
        return n

    assert common.tolist() == [0] + [lcp(a, b) for a, b in zip(want, want[1:], strict=False)]


def vectors(seed=2):
    draw = np.random.default_rng(seed)
    centres, rows = draw.normal(size=(20, 16)), []
    for i in range(420):
        c = centres[i % 20]
        rows.append((i, (c + draw.normal(size=16) * (0.11 if i % 3 else 1)).astype(np.float32).tolist(), i % 2))
    return rows + [(500, rows[3][1], rows[3][2]), (501, rows[3][1], 1 - rows[3][2]), (502, [2 * x for x in rows[3][1]], rows[3][2]), (503, rows[3][1], None)]


def test_vectors(spark):
    rows = vectors()
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [], 1)]
    df = spark.createDataFrame([(*r, 7) for r in rows + bad], "vec_id long, embedding array<float>, label int, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()}
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & np.array([[a[2] is not None and a[2] == b[2] for b in rows] for a in rows])
    pairs = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i != j]
    want = {ids[i]: (sum(a == i for a, _ in pairs), ids[r]) for i, r in enumerate(roots(len(rows), pairs))}
    assert {k: v[:2] for k, v in got.items() if k < 900} == want and sum(n for n, _ in want.values()) > 100
    assert all(got[b[0]] == (0, b[0], True) for b in bad)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def twins(linked, n=1500, size=32, seed=3):
    """Unit vectors, and others of which those numbered `linked` lie near one of them each."""
    draw = np.random.default_rng(seed)
    x, q = draw.normal(size=(n, size)), draw.normal(size=(n, size))
    q[linked] = x[linked] + 0.02 * draw.normal(size=(len(linked), size))
    return unit(x), unit(q)


def found(lookup, q, same=False):
    return {(a + int(i), int(j)) for a, block in lookup.blocks(q, same) for i, j in zip(*np.nonzero(block), strict=True)}


def true_links(x, q, least):
    return set(zip(*(v.tolist() for v in np.nonzero(q @ x.T >= least)), strict=True))


def test_graph_recall():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, 32))
    x[1500:] = x[:1500] + 0.08 * draw.normal(size=(1500, 32))
    x = unit(x)
    lookup = hnsw.Lookup(x, hnsw.Graph(x), 0.97)
    assert lookup.widen() > 300 and not lookup.whole
    assert found(lookup, x, same=True) == true_links(x, x, 0.97) and found(lookup, x[:500]) == true_links(x, x[:500], 0.97)


def test_graph_is_written_and_read():
    x, _ = twins(np.arange(5), 700)
    graph = hnsw.Graph(x)
    again = hnsw.Graph.load(x, graph.dump())
    assert again.entry == graph.entry and all((a == b).all() for a, b in zip(again.links, graph.links, strict=True))


@pytest.mark.parametrize("lost", [[3], list(range(3, 200)), list(range(0, 1500, 2))])
def test_every_point_is_connected(lost):
    class Cut(hnsw.Graph):
        """No link leads to the points `lost` before the graph is connected."""

        def _connect(self):
            for held in self.links:
                held[np.isin(held, [p for p in lost if p != self.entry])] = -1
            super()._connect()

    x, q = twins(np.array(lost))
    graph = Cut(x)
    assert graph.paths[0].all() and graph.links[0].shape[1] <= 2 * hnsw.LINKS + hnsw.EXTRA
    lookup = hnsw.Lookup(x, graph, 0.97)
    lookup.widen()
    assert found(lookup, q) == true_links(x, q, 0.97) == {(i, i) for i in lost}


def test_beam_widens(monkeypatch):
    x, q = twins(np.arange(7, 1500, 100))
    lookup = hnsw.Lookup(x, hnsw.Graph(x), 0.97, beam=1)
    lookup.widen()
    assert lookup.beam > 1 and found(lookup, q) == true_links(x, q, 0.97)
    monkeypatch.setattr(hnsw.Graph, "near", lambda self, q, *_: (np.empty(0, np.int64),) * 2)
    lookup.widen()  # a graph that finds nothing: the beam then holds every point
    assert lookup.whole and found(lookup, q) == true_links(x, q, 0.97)


def test_ids_of_several_vectors(spark, caplog):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 0.001], 0), (None, [1.0, 0.0], 0), (4, [1.0], 0), (5, [2.0], 0), (6, [1.0, 0.0, 0.0], 0), (7, [-0.0, 1.0], 0)]
    with caplog.at_level("INFO", logger="lastro.llm.hnsw"):
        got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 0, None, None), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 2, 1, False)], key=str)
    assert "3 graphs" in caplog.text


def test_vectors_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_POINTS", 40)
    rows = [r for r in vectors() if r[2] is not None]
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    assert got == dict(zip([r[0] for r in rows], (near.sum(axis=1) - 1).tolist(), strict=True))


@pytest.mark.parametrize("shards", [1, 2])
def test_link_counts_are_symmetric(monkeypatch, shards):
    n = 300
    x = np.concatenate(twins(np.arange(0, n, 3), n))
    place = (np.arange(len(x)) + (np.arange(len(x)) >= n)) % 2
    full = hnsw.Lookup.search

    def one_way(self, q, own=None):
        """A graph that finds nothing for queries whose first number is below 0."""
        return full(self, q, own) & (q[:, :1] >= 0)

    ids, second = np.arange(len(x)) + 1000, (place == 1) & (shards == 2)
    rows = pa.table({"point": ids, "copies": np.ones(len(x), np.int64), "embedding": list(x), "second": second})
    key = (pa.scalar(0), pa.scalar(32), pa.scalar(0), pa.scalar(shards - 1))
    graphs = [hnsw._build(0.97)(key, rows.filter(pa.array(second == s))).append_column("second", pa.array([s])) for s in ([False, True] if shards == 2 else [False])]
    monkeypatch.setattr(hnsw.Lookup, "search", one_way)
    out = hnsw._meet(0.97)(key, rows, pa.concat_tables(graphs)).to_pylist()
    near = (x @ x.T >= 0.97) & ~np.eye(len(x), dtype=bool)
    near &= (second[:, None] != second) | (shards == 1)
    near &= (x[:, :1] >= 0) | (x[:, 0] >= 0)  # found from either end
    assert near.sum() > 20 and {r["point"]: r["n"] for r in out if r["n"] is not None} == dict(zip(ids.tolist(), near.sum(axis=1).tolist(), strict=True))
    assert sorted(tuple(sorted((r["point"], r["other"]))) for r in out if r["n"] is None) == [(1000 + i, 1000 + j) for i, j in zip(*np.nonzero(np.triu(near)), strict=True)]


def test_only_points_that_may_link_are_looked_up(monkeypatch):
    linked = np.arange(0, 1500, 50)
    x, q = twins(linked, size=64)
    left, right = (hnsw.Lookup(v, hnsw.Graph(v), 0.97) for v in (x, q))
    asked, full = [], hnsw.Lookup.search

    def counted(self, points, own=None):
        asked.append(len(points))
        return full(self, points, own)

    monkeypatch.setattr(hnsw.Lookup, "search", counted)
    found = {(int(rows[i]), int(j)) for rows, block in hnsw.pairs(left, right) for i, j in zip(*np.nonzero(block), strict=True)}
    assert found == {(i, i) for i in linked.tolist()} and 2 * len(linked) <= sum(asked) < 4 * len(linked)


@pytest.mark.parametrize("size", [1, 2, 15, 64, 200])
def test_no_link_lies_above_the_bound(size):
    draw = np.random.default_rng(size)
    x = unit(draw.normal(size=(400, size)) * np.linspace(1, 0.01, size))
    q = unit(x + 0.15 * draw.normal(size=x.shape) / np.sqrt(size))
    near = q @ x.T >= 0.97
    rows, cols = hnsw.may_link(q, x, 0.97)
    assert near.any() and set(np.flatnonzero(near.any(axis=1))) <= set(rows) and set(np.flatnonzero(near.any(axis=0))) <= set(cols)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_of_one_direction_are_one_point(spark, kind):
    x = [0.3, -1.7, 1e-9]
    rows = [(k, [v * 2.0**k for v in x], True) for k in (-40, -1, 0, 1, 60)] + [(7, [3 * v for v in x], True), (8, [-v for v in x], True), (9, [0.0, 0.0, 0.0], False), (10, None, False)]
    made = hnsw.scaled(spark.createDataFrame(rows, f"k int, embedding array<{kind}>, good boolean"))
    got = {r.k: r.embedding for r in made.filter("good").collect()}
    assert made.schema["embedding"].dataType.elementType.simpleString() == kind
    assert len({tuple(got[k]) for k in (-40, -1, 0, 1, 60)}) == 1 and len({tuple(v) for v in got.values()}) == 3
    assert all(1 <= max(map(abs, v)) < 2 for v in got.values())


def test_threshold():
    assert [minhash.threshold(n, 80) for n in (1, 250_000, 10**10)] == [29, 20, 15]


def test_near_duplicates_of_long_and_hot_texts(spark, monkeypatch):
    """One set with very many copies, a star of near copies of it, a chain, and long texts."""
    from lastro.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 8)
    source = random.Random(9)
    base = [f"w{source.randrange(5000)}" for _ in range(60)]
    texts = [" ".join(base)] * 300
    for _ in range(120):
        own = list(base)
        own[source.randrange(60)] = f"x{source.randrange(10**6)}"
        texts.append(" ".join(own))
    long = [f"w{source.randrange(5000)}" for _ in range(60_000)]
    texts += [" ".join(long), " ".join([*long[:-4000], "end"]), " ".join(long[::-1]), "z" * 500_000, " ".join(["the the the"] * 30_000)]
    chain = list(base)
    for k in range(0, 60, 2):
        chain[k] = f"y{k}"
        texts.append(" ".join(chain))
    sets = [shingles(t, 4) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=4).collect()}
    assert got == {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, roots(len(texts), pairs), strict=True))}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_joins(spark, monkeypatch, how):
    from lastro.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 5)
    keys = [7] * 300 + [None] * 200 + [8] * 90 + list(range(100, 200))
    rows = common.checkpoint(spark.createDataFrame([(i, k, f"t{i % 9}") for i, k in enumerate(keys)], "id long, k long, salts string"))
    facts = spark.createDataFrame([(k, k * 2) for k in (7, 100, 150, 999)], "k long, v long")
    for by, counts in ((None, None), ("id", rows.groupBy("k").count())):
        got = common.join_spread(rows.drop("salts"), facts, ["k"], how, by, counts)
        assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=str) == sorted(map(tuple, rows.join(facts, "k", how).select("id", "k", "v").collect()), key=str)
    dealt, copied = common.spread(rows.drop("salts"), ["k"])
    assert dealt.filter("k = 7").select("salt").distinct().count() > 3 and copied(facts).filter("k = 7").count() > 3 == 3 * copied(facts).filter("k = 150").count()


# Memory of workers


def test_a_task_starts_without_what_earlier_tasks_left(spark, documents):
    """Python workers serve one task after the other: caches of the operators that ran before are empty when a task begins."""
    minhash.near_duplicates(documents).count()
    suffix.remove_repeats(documents).count()

    def left(batches):
        from lastro.llm import minhash, suffix
        from lastro.llm.common import text_slices

        for batch in text_slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(minhash.WORDS) + len(suffix.ONE.up) + len(suffix.TWO.up)], pa.int64())})

    found = documents.select("text").repartition(8).mapInArrow(left, "n long").collect()
    assert found and {r.n for r in found} == {2}


def test_powers_are_an_eighth_more_than_asked_for_at_most():
    for n in (1, 2, 3, 17, 1000, (1 << 20) + 1):
        rolling = suffix.RollingHash(12345)
        rolling.powers(n)
        assert n <= len(rolling.up) <= max(n * 9 // 8, n + 1)
        rolling.clear()
        assert len(rolling.up) == len(rolling.down) == 1


def test_told_keys_come_without_lists(spark, monkeypatch):
    """A list given to createDataFrame starts a further set of Python workers on every executor."""
    given = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (given.append(type(data)), create(self, data, *a, **k))[1])
    rows = spark.range(20_000).selectExpr("cast(if(id < 9000, null, if(id < 15000, 1, id)) as long) key", "id")
    facts = spark.range(20_000).selectExpr("id key", "id * 2 twice").union(spark.sql("select cast(null as long), -1L"))
    counts = rows.groupBy("key").count()
    out = {r.key: (r["count"], r.twice) for r in join_spread(rows, facts, ["key"], by="id", counts=counts).groupBy("key", "twice").count().collect()}
    assert given and set(given) == {pa.Table}
    assert out[1] == (6000, 2) and out[19_999] == (1, 39_998) and sum(n for n, _ in out.values()) == 11_000
