"""The index of tokens and the running metrics."""

import datetime as dt
import random
import re
from decimal import Decimal

from pyspark.sql import Row
from pyspark.sql import functions as F

from lastro import schema
from lastro.functions import text as T
from lastro.operators import metrics, postings
from lastro.store import Store
from lastro.streaming import running

WORDS = ["cpr", "cprf", "cpr-f", "cprs", "f", "fs", "cedula", "cedulas", "de", "do", "produto", "rural", "rurais", "cedulado", "xcpr", "ção", "9", "."]
TERMS = ["CPR-F", "cpr", "cédulas de produto", "de", "Cedula do Produto Rural", "9", "rural f cpr", "a b c d e f g h i j k l m n"]


def texts_of(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else T.fold_text(t)) for i, t in rows], "id_fnet long, texto string, texto_norm string")


def test_candidates_hold_all_matches(spark, tmp_path):
    """Whatever the words, spaces and terms: every match is a candidate, and the terms' patterns find the same among candidates."""
    rng = random.Random(4)
    rows = [(rng.choice([i, 10_000 + i, 990_000 + i]), "".join(rng.choice(WORDS) + rng.choice([" ", "", "-", "\n"]) for _ in range(rng.randint(0, 12)))) for i in range(150)] + [(7_000_001, None), (7_000_002, ""), (7_000_003, "??")]
    store = Store(spark, str(tmp_path / "s"))
    texts = texts_of(spark, rows).dropDuplicates(["id_fnet"])
    store.write("documento_textos", texts)
    postings.index_texts(store, texts)
    held = {r.id_fnet: r.texto_norm or "" for r in texts.collect()}
    for flexible in (True, False):
        for term in TERMS[:-1]:
            want = {i for i, t in held.items() if re.search(T.term_pattern(term, flexible), t)}
            found = postings.candidates(store, [term], flexible=flexible)
            ids = {r.id_fnet for r in found.collect()}
            assert want <= ids and (len(T.tokens(term)) > 1 or ids == want), term
            chosen = postings.texts_of(store, found)
            assert {r.id_fnet for r in chosen.filter(T.has_term(F.col("texto_norm"), term, flexible)).collect()} == want
    both = {i for i, t in held.items() if re.search(T.term_pattern("cpr"), t) and re.search(T.term_pattern("rural"), t)}
    assert both <= {r.id_fnet for r in postings.candidates(store, ["cpr", "rural"], every=True).collect()} < {r.id_fnet for r in postings.candidates(store, ["cpr", "rural"]).collect()}


def test_long_terms_ask_for_what_can_be_asked():
    ways = postings.forms(TERMS[-1])
    assert ways == [] or all(sum(len(g) for g in w) <= postings.MOST_FORMS for w in ways)
    assert postings.forms("CPR-F", flexible=False) == [[["cprf"]], [["cpr"], ["f"]]]


def test_texts_that_come_again(spark, tmp_path):
    """A document's old tokens go with its old text, and other ranges aren't rewritten."""
    store = Store(spark, str(tmp_path / "s"))
    postings.index_texts(store, texts_of(spark, [(1, "alfa beta"), (2, "beta"), (50_000, "alfa")]))
    before = store.versions("documento_tokens")
    postings.index_texts(store, texts_of(spark, [(1, "gama"), (2, None)]))
    got = {(r.token, r.id_fnet) for r in store.read("documento_tokens").collect()}
    assert got == {("gama", 1), ("alfa", 50_000)}
    after = store.versions("documento_tokens")
    assert all(after[p] == v for p, v in before.items() if p.startswith("5-")) and all(v == "v2" for p, v in after.items() if p.startswith("0-"))
    assert postings.candidates(store, ["beta"]).count() == 0 and postings.candidates(Store(spark, str(tmp_path / "none")), ["beta"]).count() == 0


def test_tokens_move_packed(spark, tmp_path):
    """A row a document until its tokens are written, and what follows from a text is made when the texts have been dealt."""
    rows = [(1, "b a b"), (2, ""), (3, None), (10_001, "c"), (None, "d")]
    packed = postings.packed(texts_of(spark, rows))
    assert {(r.id_fnet, r.tokens) for r in packed.collect()} == {(1, "b a"), (2, ""), (3, ""), (10_001, "c"), (None, "d")}
    assert {tuple(r) for r in postings.unpacked(packed).collect()} == {("b", 1), ("a", 1), (None, 2), (None, 3), ("c", 10_001), ("d", None)}
    store = Store(spark, str(tmp_path / "s"))
    seen = []

    def late(table):
        seen.append(table.columns)
        return table.withColumn("texto_norm", F.upper("texto"))

    store.write("documento_textos", texts_of(spark, rows).drop("texto_norm"), late=late)
    assert seen == [["id_fnet", "texto", "parte"]]
    assert {(r.id_fnet, r.texto_norm) for r in store.read("documento_textos").collect()} == {(i, t and t.upper()) if t else (i, t) for i, t in rows}
    postings.index_texts(store, texts_of(spark, rows))
    postings.index_texts(store, texts_of(spark, [(1, "e"), (2, "f")]))
    assert sorted(map(tuple, store.read("documento_tokens").collect()), key=str) == sorted([("e", 1), ("f", 2), ("c", 10_001), ("d", None)], key=str)


def test_running_metrics_equal_a_whole_run(spark, tmp_path):
    """Any split of the reports, late months, months that come again with another value or none."""
    rng = random.Random(2)
    months = [dt.date(2020 + k // 12, k % 12 + 1, 1) for k in range(30)]
    money = lambda: rng.choice([None, Decimal(rng.randint(-500, 10**9)) / 100])
    arrivals = [(c, m, money(), rng.choice([None, rng.randint(0, 99)])) for c in ("a", "b", "c") for m in rng.sample(months, 5 if c == "c" else 30)]
    arrivals += [(c, m, money(), None) for c in ("a", "b") for m in rng.sample(months, 4)] + [(None, months[0], money(), 1), ("a", None, money(), 1)]
    rng.shuffle(arrivals)
    kind = "cnpj string, competencia date, pl decimal(20,2), num_cotistas int, arrival long"
    store, rows = Store(spark, str(tmp_path / "s")), [(*r, i) for i, r in enumerate(arrivals)]
    for part in (rows[:20], rows[20:21], rows[21:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        running.keep_metrics(spark, spark.readStream.schema(kind).parquet(str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination(200)
    last = {(c, m): (c, m, pl, n) for c, m, pl, n, _ in rows if c and m}
    whole = metrics.fund_metrics(spark.createDataFrame(list(last.values()), "cnpj string, competencia date, pl decimal(20,2), num_cotistas int"))
    assert sorted(store.read("fundos_metricas").select(*whole.columns).collect()) == sorted(whole.collect())
    assert schema.schema("fundos_metricas").fieldNames()[0] == "cnpj"


def test_state_is_read_once_for_a_fund():
    """A fund's arrivals of a batch read and write its state once, whatever the number of its months; later arrivals win."""

    class Handle:
        def __init__(self):
            self.value, self.calls = None, []

        def getValueState(self, name, kind):  # noqa: N802
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    handle, fund = Handle(), running.RunningMetrics()
    fund.init(handle)
    rows = [Row(competencia=f"2024-{m:02d}-01", pl=f"{m}.00", num_cotistas=m, arrival=a) for m in range(1, 13) for a in (1, 0)]
    (got,) = fund.handleInputRows(("f",), iter(rows), None)
    assert handle.calls == ["get", "update"] and got.pl_atual == Decimal("12.00") and got.pl_medio_12m == Decimal("6.50")
    (got,) = fund.handleInputRows(("f",), iter([Row(competencia="2024-12-01", pl=None, num_cotistas=None, arrival=2)]), None)
    assert (got.pl_atual, got.pl_medio_12m, got.cotistas_atual, got.competencia_ultima) == (Decimal("11.00"), Decimal("6.00"), 11, dt.date(2024, 12, 1))
