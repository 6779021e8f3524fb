import re

import corpus_pipeline
import pytest

from tests.llm import test_duplicates as brute
from tests.llm.test_others import spans


@pytest.fixture(scope="module")
def kept(spark, documents):
    """What each stage gave, as Parquet would hand it on."""
    from lastro.llm.common import checkpoint

    docs, out = documents, [documents]
    for _, stage in corpus_pipeline.STAGES:
        docs = checkpoint(stage(spark, docs, "/root/testdata/sf0.001"))
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "secrets", "packing"]
    for df in kept[1:-1]:
        assert df.columns == kept[0].columns


def test_language(kept):
    before, after = rows(kept[0]), rows(kept[1])
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}


def test_near_duplicates(kept):
    before, after = rows(kept[1]), rows(kept[2])
    ids = sorted(before)
    sets = [brute.shingles(before[i].text, 5) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(after) == {ids[r] for r in set(brute.roots(len(ids), pairs))}


def test_repeats(kept):
    before, after = rows(kept[2]), rows(kept[3])
    want = brute.without_repeats([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, (n, gone, _, _) in want.items() if not gone or gone < n}
    for i, r in after.items():
        assert r.n_chars == len(r.text) and (r.text == before[i].text) == (want[i][1] == 0)


def test_secrets(kept):
    before, after = rows(kept[3]), rows(kept[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert (r.text == before[i].text) == (spans(before[i].text) == "") and not spans(re.sub(r"\[secret\]", "", r.text)).count("access")


def test_packing(kept):
    ids = {r.doc_id for r in kept[5].select("doc_id").distinct().collect()}
    assert ids == set(rows(kept[4]))


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, block int, salt int, found string, ids string"


def stage(spark, name, rows):
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, "x", 1, 2, "y", "z") for i, t, lang in rows], KIND)
    return dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")


A, B = " ".join(f"word{i}" for i in range(40)), " ".join(f"other{i}" for i in range(40))
ODD = [(1, A, "en"), (1, A, "en"), (2, A, None), (None, B, "fr"), (None, B, "fr"), (3, None, "en"), (4, "", "en"), (5, "12 34", None), (6, f"password=hunter22 {B}", "fr"), (7, "lone ", "en"), (8, "z" * 300_000, "en")]


@pytest.mark.parametrize(("name", "want"), [
    ("language", [1, 1, 2, None, None, 6, 7, 8]), ("near_duplicates", [1, None, None, 3, 4, 5, 6, 7, 8]), ("repeats", [1, 3, 4, 5, 6, None, None, 7, 8]), ("secrets", [i for i, _, _ in ODD]),
])
def test_odd_rows(spark, name, want):
    got = stage(spark, name, ODD).collect()
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in got)
    want = sorted(-1 if i is None else i for i in want)
    if name == "repeats":  # of B's copies the first in order stays whole; the others lose all or most
        want = [i for i in want if i >= 0]
        ids = [i for i in ids if i >= 0]
    assert ids == want
    assert list(got[0].asDict()) == list(corpus_pipeline.COLUMNS)
    if name == "secrets":
        assert {r.text for r in got if r.doc_id == 6} == {f"[secret] {B}"} and {r.text for r in got if r.doc_id == 3} == {""}
    if name == "language":
        assert {r.lang for r in got if r.doc_id == 2} <= {"en", "fr"} and all(r.lang for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, name):
    assert stage(spark, name, []).count() == 0


def test_odd_rows_packed(spark):
    got = stage(spark, "packing", ODD[:7]).collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in got}) == [-1, 1, 2, 3, 4] and [r.length for r in got if r.doc_id in (3, 4)] == [1, 1]
