import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lastro.functions import text as T

TEXT = "É vedada a aquisição de CPR-\nF. As Cédulas do Produto Rural; cpr-f e CPRF, mas não CPR-Fulano nem xCPR-F."


def python_snippets(text, terms, most, flexible=True, context=160):
    """Brute force over Python's own regex engine."""
    norm, found, seen = T.fold_text(text), [], set()
    clean = lambda x: " ".join(x.split())
    for t in terms:
        for m in re.finditer(T.term_pattern(t, flexible), norm):
            a, b = m.span()
            if a in seen or len(found) >= most:
                continue
            seen.add(a)
            before, hit, after = clean(text[max(0, a - context) : a]), clean(text[a:b]), clean(text[b : b + context])
            lead = before + " " if before else ""
            near = re.sub(r"\s+", " ", norm[max(0, a - 120) : a])
            found.append((lead + hit + (" " + after if after else ""), hit, len(lead), len(lead) + len(hit), a, any(p in near for p in T.PROHIBITIONS)))
    return found


def test_fold_keeps_length(spark):
    words = ["Ação", "İstanbul", "ß", "ĳ", "한글", "😀É", "", "Áb"]
    got = [r.f for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.fold(F.col("w")).alias("f")).collect()]
    want = ["".join(unicodedata.normalize("NFD", c.lower()[0])[0] for c in w) for w in words]
    assert got == want == [T.fold_text(w) for w in words]
    assert [len(a) for a in got] == [len(w) for w in words]


def test_tokens_and_prefilter():
    assert T.tokens("CPR-F (Cédula)") == ["cpr", "f", "cedula"]
    assert T.prefilter_token("cédulas de produto") == "cedula"
    assert T.prefilter_token("de a") is None
    with pytest.raises(ValueError):
        T.term_pattern("--")


@pytest.mark.parametrize(("term", "text", "flexible", "found"), [
    ("CPR-F", "a cpr-\nf b", True, True), ("CPR-F", "cprf", True, True), ("CPR-F", "cpr-fulano", True, False), ("CPR-F", "xcpr-f", True, False),
    ("cédula de produto", "cedulas dos produtos", True, True), ("cédula de produto", "cedulas dos produtos", False, False), ("de a", "do o", True, True),
])
def test_terms(spark, term, text, flexible, found):
    row = spark.createDataFrame([(T.fold_text(text),)], "n string").select(T.has_term(F.col("n"), term, flexible).alias("x")).first()
    assert row.x is found


@pytest.mark.parametrize("most", [0, 1, 3, 50])
def test_snippets_match_brute_force(spark, most):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + [TEXT, "", "😀 the ação the x"]
    terms = ["the", "cpr-f", "de la", "the of"]
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, t string").withColumn("n", T.fold(F.col("t")))
    got = {r.i: [tuple(s) for s in r.trechos] for r in T.snippets(rows, "t", "n", terms, most=most).collect()}
    assert got == {i: python_snippets(d, terms, max(1, most)) for i, d in enumerate(docs)}


def test_highlight_and_prohibition(spark):
    rows = spark.createDataFrame([(TEXT,)], "t string").withColumn("n", T.fold(F.col("t")))
    out = T.snippets(rows, "t", "n", ["CPR-F"]).select(F.explode("trechos").alias("s")).select("s", T.highlighted(F.col("s")).alias("h")).collect()
    assert out[0].h.startswith("É vedada a aquisição de «CPR- F»") and out[0].s.possivel_vedacao
    assert len(out) == 3


def test_snippet_rows_run_each_pattern_once(spark):
    rows = spark.createDataFrame([(1, "A Taxa, a taxa"), (2, "nada"), (3, None), (4, "")], "id long, texto string")
    out = T.snippets(rows.withColumn("texto_norm", T.fold(F.col("texto"))), "texto", "texto_norm", ["taxa"], most=2)
    out = T.snippet_rows(out, "id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == plan.count("regexp_extract_all(") == 1
    assert [(r.id, r.match, r.posicao_documento) for r in out.orderBy("id", "posicao_documento").collect()] == [(1, "Taxa", 2), (1, "taxa", 10)]


def test_first_occurrences_end_where_those_of_the_whole_text_end(spark):
    rows = spark.createDataFrame([("ab ab abc ab",), ("abc",), ("",), (None,), ("ab",), ("x ab ab",)], "t string")
    pattern = r"(?<![0-9a-z])ab(?![0-9a-z])"
    every = T.occurrences(rows, "t", [pattern], ["p"])
    some = T.occurrences(rows, "t", [pattern], ["p"], first=2, within=["ab"])
    whole, cut = ({r.t: [tuple(x) for x in r.p] if r.p is not None else None for r in df.collect()} for df in (every, some))
    assert whole["ab ab abc ab"] == [(0, 2), (3, 5), (10, 12)] and whole["abc"] == [] and whole["ab"] == [(0, 2)]
    assert cut == {t: None if p is None else p[:2] for t, p in whole.items()}
