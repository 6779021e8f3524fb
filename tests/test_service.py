"""Archives, the paged search, streams, the store in parts, ordered files and layout checks."""

import datetime as dt
import json
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lastro import cli, schema
from lastro.functions import parsing as P
from lastro.functions.parsing import LayoutError
from lastro.operators import export, health, quality, report
from lastro.operators.order import numbered
from lastro.plans import service as service_plan
from lastro.sources import csvzip, documents, paged
from lastro.store import KEPT, Conflict, Store
from lastro.streaming import sync
from tests.test_ingest import A, B, C, zipped

DAY = dt.datetime(2026, 5, 1)


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


# Archives


def test_members_are_partitions(spark, tmp_path):
    one = zipped(tmp_path / "a.zip", geral="A;B\n1;x\n2;y\n", outra="A\n9\n", vazia="")
    two = zipped(tmp_path / "b.zip", geral="B;C\nz;Ç\n")
    rows = csvzip.read_cells(spark, str(tmp_path / "*.zip"))
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 4
    chosen = rows.filter(F.col("file_idx") == 1)
    assert chosen.rdd.getNumPartitions() == 1 and [r.cells for r in chosen.collect()] == [{"A": "9"}]
    assert rows.filter(F.col("member").contains("geral")).rdd.getNumPartitions() == 2
    got = csvzip.table(spark, one, two, token="geral")
    assert {(r.A, r.B, r.C, r.row_idx) for r in got.collect()} == {("1", "x", None, 0), ("2", "y", None, 1), (None, "z", "Ç", 0)}
    assert {r.member: r["columns"] for r in csvzip.headers(spark, one).collect()} == {"geral.csv": ["A", "B"], "outra.csv": ["A"], "vazia.csv": []}
    with pytest.raises(LayoutError):
        csvzip.table(spark, one, two, token="outra")
    with pytest.raises(FileNotFoundError):
        csvzip.files_of(spark, str(tmp_path / "none.zip"))


def test_large_members_are_streamed(spark, tmp_path):
    """More rows than a batch, equal names, ragged rows, quotes and line ends inside cells."""
    text = "N;N;T\n" + "".join(f'{i};{i + 1};"a;""{i}\n"\n' for i in range(25_000)) + "7\n8;9;x;more\n\n ; \n"
    path = zipped(tmp_path / "big.zip", big=text)
    rows = csvzip.table(spark, path).orderBy("row_idx").collect()
    assert len(rows) == 25_002 and (rows[24_999].N, rows[24_999]["T"]) == ("25000", 'a;"24999\n') and (rows[-2].N, rows[-2]["T"]) == (None, None) and (rows[-1].N, rows[-1]["T"]) == ("9", "x")
    cells = csvzip.read_cells(spark, path).filter("row_idx = 3").first().cells
    assert cells == {"N": "4", "T": 'a;"3\n'}


def test_archives_are_written(spark, tmp_path):
    rows = [(f"{a}.zip", f"{m}.csv", k, f"{a}{m};{k}") for a in "xy" for m in "pq" for k in range(3)]
    got = csvzip.write_archives(spark.createDataFrame(rows, "archive string, member string, place long, value string"), str(tmp_path / "out")).collect()
    assert {r.path.rpartition("/")[2]: (r.members, r.rows) for r in got} == {"x.zip": (2, 6), "y.zip": (2, 6)}
    with zipfile.ZipFile(tmp_path / "out/x.zip") as z:
        assert z.namelist() == ["p.csv", "q.csv"] and z.read("q.csv") == b"xq;0\r\nxq;1\r\nxq;2\r\n" and z.testzip() is None
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x.zip", "y.zip"]


# The paged search


class Service(BaseHTTPRequestHandler):
    """The document service over `records`, with its filters."""

    records: list[dict] = []
    asked: list[dict] = []
    broken: set[str] = set()

    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        type(self).asked.append(q | {"at": time.monotonic()})
        if q["tipoFundo"] in self.broken:
            self.send_response(404)
            self.end_headers()
            return
        rows = [r for r in self.records if r["tipo"] == q["tipoFundo"]]
        when = lambda r: dt.datetime.strptime(r["dataEntrega"], "%d/%m/%Y %H:%M")
        if "dataInicial" in q:
            rows = [r for r in rows if when(r).date() >= dt.datetime.strptime(q["dataInicial"], "%d/%m/%Y").date()]
        if "dataFinal" in q:
            rows = [r for r in rows if when(r).date() <= dt.datetime.strptime(q["dataFinal"], "%d/%m/%Y").date()]
        if "cnpjFundo" in q:
            rows = [r for r in rows if r["cnpjFundo"] == q["cnpjFundo"]]
        if q["idCategoriaDocumento"] != "0":
            rows = [r for r in rows if str(r["cat"]) == q["idCategoriaDocumento"]]
        rows.sort(key=when, reverse=q["o[0][dataEntrega]"] == "desc")
        a, n = int(q["s"]), int(q["l"])
        body = json.dumps({"recordsTotal": 999, "recordsFiltered": len(rows), "data": rows[a : a + n]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.records, Service.asked, Service.broken = [], [], set()
    yield f"http://127.0.0.1:{server.server_address[1]}/search"
    server.shutdown()


def record(i, tipo, day, hour=10, cat=1, cnpj=A):
    return {"id": i, "tipo": tipo, "cat": cat, "cnpjFundo": cnpj, "categoriaDocumento": f"c{cat}", "dataEntrega": f"{day:02}/05/2026 {hour:02}:00"}


def search(spark, url, **options):
    paged.register(spark)
    return spark.read.format("documents").options(tipos="1,2", url=url, size="3", interval="0", **options).load()


def test_filters_go_into_the_request(spark, service):
    Service.records = [record(i, str(i % 2 + 1), i % 20 + 1, i % 24, i % 3, [A, B][i % 2]) for i in range(60)]
    found = search(spark, service).filter((F.col("tipo") == "1") & (F.col("id_categoria") == 2) & (F.col("cnpj") == A) & (F.col("entrega") >= F.lit(DAY.replace(day=5, hour=12)).cast("timestamp_ntz")) & (F.col("entrega") < F.lit(DAY.replace(day=15)).cast("timestamp_ntz")))
    got = sorted(json.loads(r.value)["id"] for r in found.collect())
    moment = lambda r: dt.datetime.strptime(r["dataEntrega"], "%d/%m/%Y %H:%M")
    assert got == sorted(r["id"] for r in Service.records if r["tipo"] == "1" and r["cat"] == 2 and r["cnpjFundo"] == A and DAY.replace(day=5, hour=12) <= moment(r) < DAY.replace(day=15)) and got
    asked = [{k: v for k, v in q.items() if k in ("tipoFundo", "idCategoriaDocumento", "cnpjFundo", "dataInicial", "dataFinal")} for q in Service.asked]
    assert asked and all(q == {"tipoFundo": "1", "idCategoriaDocumento": "2", "cnpjFundo": A, "dataInicial": "05/05/2026", "dataFinal": "15/05/2026"} for q in asked)
    plan = plan_of(found)
    assert "PushedFilters" in plan and "EqualTo(id_categoria,2)" in plan and "EqualTo(tipo,1)" in plan, plan


def test_pages_are_planned_from_the_total(spark, service):
    Service.records = [record(i, "1", 1 + i % 28) for i in range(20)] + [record(100, "2", 3)]
    rows = search(spark, service, tasks="3")
    assert rows.rdd.getNumPartitions() == 4  # seven pages in three ranges, and one page
    got = [(r.tipo, r.arrival, json.loads(r.value)["id"]) for r in rows.collect()]
    assert len(got) == 21 and sorted(a for t, a, _ in got if t == "1") == list(range(20)) and {i for _, _, i in got} == {*range(20), 100}
    assert search(spark, service, maxPages="2").filter("tipo = '1'").count() == 6
    Service.records = []
    assert search(spark, service).count() == 0


def test_stored_answers_to_less_are_not_taken(spark, tmp_path):
    (tmp_path / "1-0.json").write_text(json.dumps({"data": [record(1, "1", 1)]}))
    paged.register(spark)
    rows = spark.read.format("documents").options(tipos="1", files=str(tmp_path)).load()
    assert rows.count() == 1
    with pytest.raises(Exception, match="no stored answer"):
        rows.filter(F.col("id_categoria") == 2).count()


def test_answers_are_stored_as_lines_of_many_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "SPAN", 4)
    kept = [(record(i, "1", 1 + i % 28), i) for i in range(57)]
    rows = [("1", A, 2, DAY + dt.timedelta(minutes=i), i, json.dumps(r)) for r, i in kept]
    made = spark.createDataFrame(rows, "tipo string, cnpj string, id_categoria int, entrega timestamp_ntz, id long, value string")
    asked = [paged.Search("1"), paged.Search("1", id_categoria=2), paged.Search("1", id_categoria=3), paged.Search("1", ordem="desc")]
    service_plan.keep_answers(made, asked, str(tmp_path), 5)
    assert len(list(tmp_path.glob("request=1/pages=*"))) == 3  # twelve pages
    ask = paged.stored(str(tmp_path))
    for search_ in asked[:2]:
        answers = [ask(search_, 5 * k, 5) for k in range(14)]
        assert [r["id"] for a in answers for r in a["data"]] == list(range(57)) and {a["recordsFiltered"] for a in answers[:12]} == {57}
        assert [len(a["data"]) for a in answers] == [5] * 11 + [2, 0, 0] and ask(search_, 0, 5) == answers[0]
    assert ask(asked[2], 0, 5) == {"recordsFiltered": 0, "data": []}
    assert [r["id"] for r in ask(asked[3], 0, 1)["data"]] == [56]
    with pytest.raises(FileNotFoundError, match="no stored answer"):
        ask(paged.Search("1", id_categoria=9), 0, 5)


def test_service_rate_is_one_for_all_ranges(spark, service):
    Service.records = [record(i, "1", 1 + i % 28) for i in range(24)]
    paged.register(spark)
    rows = spark.read.format("documents").options(tipos="1", url=service, size="3", interval="0.2", tasks="2").load()
    assert rows.count() == 24
    at = sorted(q["at"] for q in Service.asked[1:])
    assert at[-1] - at[0] > 0.2 * 2 * 3 * 0.9  # eight pages by two tasks, each waiting for two turns


# Streams


def test_stream_stops_and_goes_on(spark, service, tmp_path):
    """Cursors of an older store, an overlap that comes again, a stop in between, a type that fails: the rows are those of one run."""
    paged.register(spark)

    def run(store, folder):
        raw = spark.readStream.format("documents").options(tipos="1,2,3", url=service, size="2", interval="0", cursors=json.dumps({"1": "2026-05-04T10:00:00", "all": "2026-05-02T00:00:00"})).load()
        sync.stream_documents(sync.fetched(raw), store, str(tmp_path / folder), name=folder, types=["1", "2", "3"]).awaitTermination(200)

    every = [record(i, str(i % 2 + 1), 1 + i // 2) for i in range(20)]
    Service.records, Service.broken = every[:12], {"3"}
    parts = Store(spark, str(tmp_path / "parts"))
    run(parts, "a")
    first = {r.id_fnet for r in parts.read("documentos").collect()}
    assert first == {i for i in range(12) if 1 + i // 2 >= (3 if i % 2 == 0 else 1)}
    assert {r.fonte: r.cursor for r in parts.read("sync_state").collect()} == {"fnet_documentos:tf=1:cat=all": "2026-05-06T10:00:00", "fnet_documentos:tf=2:cat=all": "2026-05-06T10:00:00"}
    # What was downloaded in between stays so although the overlap brings it again.
    parts.merge("documentos", spark.createDataFrame([(10, "baixado")], "id_fnet long, status_download string"), ["id_fnet"])
    Service.records, Service.asked = every, []
    run(parts, "a")
    assert {q.get("dataInicial") for q in Service.asked if q["o[0][dataEntrega]"] == "asc"} == {"05/05/2026"}
    whole = Store(spark, str(tmp_path / "whole"))
    run(whole, "b")
    columns = ["id_fnet", "cnpj", "categoria", "data_entrega", "tipo"]
    assert sorted(parts.read("documentos").select(*columns).collect()) == sorted(whole.read("documentos").select(*columns).collect())
    assert {r.id_fnet for r in parts.read("documentos").filter("status_download = 'baixado'").collect()} == {10}
    versions = parts.versions("documentos")
    run(parts, "a")  # nothing new
    assert parts.versions("documentos") == versions


def test_repeated_batches_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    kind = "id_fnet long, cnpj string, categoria string, data_entrega timestamp_ntz, arrival long"
    rows = spark.createDataFrame([(1, A, "a", DAY, 0)], kind)
    sync.merge_documents(store, rows, {"batch:x": 4})
    assert store.manifest("documentos")["notes"] == {"batch:x": 4}
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    before = store._versions("documentos")
    sync.stream_documents(stream, store, str(tmp_path / "c"), name="x").awaitTermination(100)  # its batch 0 came before 4
    assert store._versions("documentos") == before


def test_streams_are_logged(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    now = [DAY]
    log = sync.RunLog(store, lambda: now[0])
    spark.streams.addListener(log)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.queryName("boa").foreachBatch(lambda df, n: df.count()).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(100)

        def fail(df, n):
            raise ValueError("quebrou")

        query = stream.writeStream.queryName("ruim").foreachBatch(fail).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="quebrou"):
            query.awaitTermination(100)
        for _ in range(100):
            runs = {r.fonte: r for r in store.read("sync_runs").collect()}
            if len(runs) == 2 and all(r.status != "executando" for r in runs.values()):
                break
            time.sleep(0.3)
    finally:
        spark.streams.removeListener(log)
    assert (runs["boa"].status, json.loads(runs["boa"].detalhe)["lidos"], runs["boa"].iniciado_em) == ("ok", 5, DAY)
    assert runs["ruim"].status == "erro" and "quebrou" in runs["ruim"].erro and len(runs["ruim"].erro) <= health.ERROR_CHARS
    checks = {r.nome: r.status for r in health.run_checks(store.read("sync_runs"), DAY).collect()}
    assert checks == {"frescor:boa": "ok", "execucao:ruim": "erro"}


# Downloads


def test_one_rate_for_all_tasks(spark, tmp_path):
    """Three tasks together make no more than a request in each interval."""
    stamps = tmp_path / "stamps"
    stamps.mkdir()

    def fetch(url):
        import time
        import uuid

        (stamps / f"{time.time():.6f}-{uuid.uuid4().hex}").write_text(url)
        return b"<?xml ?>"

    queue = spark.createDataFrame([(i,) for i in range(12)], "id_fnet long")
    got = documents.download(queue, "x/{}", str(tmp_path / "files"), fetch, interval=0.3, tasks=3).collect()
    assert sorted(r.id_fnet for r in got) == list(range(12)) and all(r.formato == "xml" for r in got)
    at = sorted(float(p.name.partition("-")[0]) for p in stamps.iterdir())
    assert len(at) == 12 and min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.15 and at[-1] - at[0] > 0.3 * 11 * 0.9


def test_slots():
    now, waits = [100.0], []

    def wait(s):
        waits.append(round(s, 3))
        now[0] += s

    get = documents.slotted(lambda u: round(now[0] - 100, 3), 1, 3, 1.0, lambda: now[0], wait)
    assert [get("a"), get("b")] == [1.0, 4.0]
    now[0] = 120.5
    assert get("c") == 22.0  # the next slot of this task, not one that has gone


# The store


def documents_of(spark, ids, word):
    return spark.createDataFrame([(i, A, word) for i in ids], "id_fnet long, cnpj string, categoria string")


def test_merges_write_what_they_touch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    many = spark.range(200_000).select(F.col("id").alias("id_fnet"), F.lit(A).alias("cnpj"), F.sha2(F.col("id").cast("string"), 256).alias("raw_json"))
    store.write("documentos", many)
    size = store.size(f"{store.folder}/documentos/data")
    assert len(store.versions("documentos")) == 20
    touched = store.merge("documentos", documents_of(spark, [5, 150_001, 200_005], "novo"), ["id_fnet"], ["categoria"])
    assert touched == ["0", "15", "20"] and store.versions("documentos") == {str(p): "v2" if p in (0, 15, 20) else "v1" for p in range(21)}
    added = store.size(f"{store.folder}/documentos/data") - size
    assert added < size * 0.2
    got = store.read("documentos")
    assert got.count() == 200_001 and {r.id_fnet for r in got.filter("categoria = 'novo'").collect()} == {5, 150_001, 200_005} and got.filter("raw_json is null").count() == 1
    # Later merges remove what no kept version names.
    for n in range(KEPT + 1):
        store.merge("documentos", documents_of(spark, [5], f"n{n}"), ["id_fnet"], ["categoria"])
    assert len(store._versions("documentos")) == KEPT and store.read("documentos").filter("id_fnet = 5").first().categoria == f"n{KEPT}"
    assert store.read("documentos").count() == 200_001 and store.size(f"{store.folder}/documentos/data") < size * 1.4


def test_a_merge_that_fails_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("documentos", documents_of(spark, [1, 2], "a"))
    before = store.manifest("documentos")

    def wrong():
        raise LayoutError("no")

    for act in (lambda: store.merge("documentos", documents_of(spark, [1], "b"), ["id_fnet"], check=wrong), lambda: store.write("documentos", documents_of(spark, [1], "b"), check=wrong)):
        with pytest.raises(LayoutError):
            act()
    with pytest.raises(Exception, match="division|DIVIDE"):
        store.merge("documentos", documents_of(spark, [1], "b").withColumn("versao", F.expr("raise_error('division')").cast("int")), ["id_fnet"])
    assert store.manifest("documentos") == before and not [n for n in store._names(f"{store.folder}/documentos") if n.startswith("staged")]
    assert [r.categoria for r in store.read("documentos").orderBy("id_fnet").collect()] == ["a", "a"]


def test_two_writers_do_not_lose_rows(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    store.write("documentos", documents_of(spark, [1], "a"))

    def between(target, source):
        other.merge("documentos", documents_of(spark, [2], "outra"), ["id_fnet"])
        return target.unionByName(source, allowMissingColumns=True)

    with pytest.raises(Conflict):
        store.merge("documentos", documents_of(spark, [3], "minha"), ["id_fnet"], how=between)
    assert {r.id_fnet for r in store.read("documentos").collect()} == {1, 2}


def test_empty_tables_and_null_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("documentos").count() == 0 and store.merge("documentos", documents_of(spark, [], "a"), ["id_fnet"]) == [] and store._versions("documentos") == []
    store.write("documentos", documents_of(spark, [], "a"))
    assert store.read("documentos").schema == schema.schema("documentos") and store.read("documentos").count() == 0
    store.merge("documentos", documents_of(spark, [None, 1], "a"), ["id_fnet"])
    assert store.versions("documentos").keys() == {"nulo", "0"} and store.read("documentos").count() == 2


# Sinks


def test_ordered_files(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), F.concat(F.lit('a;"'), F.col("id").cast("string")).alias("t"), F.when(F.col("id") % 10 > 0, F.col("id") % 4).alias("k")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write_ordered(rows, ("-k", "n"), str(tmp_path / "parts"), ("n", "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(p.name for p in (tmp_path / "parts").glob("part-*"))
    assert len(names) > 1
    size = export.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "all.csv"))
    text = (tmp_path / "all.csv").read_bytes()
    assert size == len(text) and text.count(b"\xef\xbb\xbf") == 1 and text.startswith(b"\xef\xbb\xbfn;t\r\n")
    want = sorted(rows.collect(), key=lambda r: (r.k is None, -(r.k or 0), r.n))
    assert text.decode("utf-8-sig").split("\r\n")[1:-1] == [f'{r.n};"a;""{r.t[3:]}"' for r in want]
    export.write_ordered(rows.limit(0), ("n",), str(tmp_path / "none"))
    export.join_parts(spark, str(tmp_path / "none"), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_bytes() == b"\xef\xbb\xbfn;t;k\r\n"


def test_numbers(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("n"))

    def written(df):
        df.write.parquet(str(tmp_path / "t"))
        return spark.read.parquet(str(tmp_path / "t"))

    assert all(r.n == r.number for r in numbered(rows, ["n"], written).collect())


# Checks


def test_observed_layouts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(i, None, "x" if i < 3 else "") for i in range(10)], "id_fnet long, cnpj string, categoria string")

    def load(**least):
        seen_rows, seen = quality.observed(rows, tuple(least), f"o{len(least)}{sum(least.values())}")
        store.merge("documentos", seen_rows, ["id_fnet"], check=quality.require(seen, least, what="arquivo"))
        return seen.get

    for least in ({"categoria": 0.5}, {"cnpj": 0.0}):
        with pytest.raises(LayoutError, match="arquivo.*too few"):
            load(**least)
    assert store.read("documentos").count() == 0
    assert load(categoria=0.3) == {"rows": 10, "categoria": 3} and store.read("documentos").count() == 10
    none, seen = quality.observed(rows.limit(0), ("cnpj",), "none")
    none.write.parquet(str(tmp_path / "none"))
    with pytest.raises(LayoutError, match="0 rows"):
        quality.require(seen, {})()


def test_check_and_survey_commands(spark, tmp_path, capsys):
    store = str(tmp_path / "store")
    header = "TP_FUNDO;CNPJ_FUNDO;DENOM_SOCIAL;SIT;PUBLICO_ALVO;ADMIN\n"
    (tmp_path / "good.csv").write_text(header + f"FIDC;{A};Fundo A;EM FUNCIONAMENTO NORMAL;Geral;ADMIN X\n")
    (tmp_path / "moved.csv").write_text(header + f"FIDC;{A};Fundo A;EM FUNCIONAMENTO NORMAL;;\n")
    (tmp_path / "bad.csv").write_text("X;Y\n1;2\n")
    args = [x for n in ("good", "moved", "bad") for x in ("--arquivos", str(tmp_path / f"{n}.csv"))]
    assert cli.main(["check-files", "--store", store, *args], spark) == 1
    said = capsys.readouterr().out.splitlines()
    assert [line.split()[0] for line in said] == ["OK", "FALHA", "FALHA"] and "publico_alvo, administrador" in said[1] and "CNPJ" in said[2]
    assert cli.main(["check-files", "--store", store, "--arquivos", str(tmp_path / "good.csv")], spark) == 0
    with pytest.raises(LayoutError):
        cli.main(["sync-registry", "--store", store, "--file", str(tmp_path / "moved.csv"), "--exigir", "administrador"], spark)
    assert Store(spark, store).read("fundos").count() == 0
    cli.main(["sync-registry", "--store", store, "--file", str(tmp_path / "good.csv"), "--exigir", "administrador"], spark)
    # The registry's own order, from the fallback where the first file is missing; funds that it lacks come last.
    funds = "ID_Registro_Fundo;CNPJ_Fundo;Tipo_Fundo;Denominacao_Social;Situacao;Administrador;Gestor\n" + f"2;{C};FIDC;Fundo C;Em Funcionamento Normal;ADMIN X;\n1;{B};FIDC;Fundo B;Em Funcionamento Normal;Admin x;\n"
    spare = zipped(tmp_path / "reserva.zip", registro_fundo=funds, registro_classe=f"ID_Registro_Fundo;CNPJ_Classe;Publico_Alvo\n1;{B};Profissional\n")
    out = tmp_path / "survey.csv"
    cli.main(["survey", "--store", store, "--administrador", "admin x", "--saida", str(out), "--registro", str(tmp_path / "none.zip"), "--registro", spare], spark)
    text = out.read_bytes()
    assert text.startswith(b"\xef\xbb\xbf") and [line.split(";")[0] for line in text.decode("utf-8-sig").split("\r\n")[1:-1]] == [C, B, A]


def test_answers_for_a_monitor(spark):
    kind = "nome string, status string, mensagem string"
    totals = spark.createDataFrame([(1, 2, 3)], "fundos long, documentos long, textos long")
    good, bad = (spark.createDataFrame([("x", s, "m")], kind) for s in ("aviso", "erro"))
    code, body = health.as_http(good, totals)
    assert code == 200 and json.loads(body) == {"status": "aviso", "verificacoes": [{"nome": "x", "status": "aviso", "mensagem": "m"}], "contagens": {"fundos": 1, "documentos": 2, "textos": 3}}
    assert health.as_http(bad, totals)[0] == 503
    code, body = health.as_http(good, totals.withColumn("fundos", F.raise_error(F.lit("sem banco"))))
    assert code == 503 and json.loads(body)["verificacoes"][0]["nome"] == "banco"
    assert report.check_lines(bad) == ["status geral: ERRO", "", "verificações:", "  [X] x: m"]


def test_lines_for_a_reader(spark):
    rows = spark.createDataFrame([("1", "1234567890.00"), ("2", "-51000"), ("3", "0"), ("4", None)], "cnpj string, pl_medio_12m string").withColumn("pl_medio_12m", F.col("pl_medio_12m").cast("decimal(20,2)"))
    assert [r[0] for r in rows.orderBy("cnpj").select(P.millions(F.col("pl_medio_12m"))).collect()] == ["R$ 1.234,6mi", "R$ -0,1mi", None, None]
    for c, t in (("denominacao", "string"), ("tipo_veiculo", "string"), ("publico_alvo", "string"), ("administrador", "string"), ("cotistas_atual", "int")):
        rows = rows.withColumn(c, F.lit(None).cast(t))
    documents = F.expr("array(named_struct('id_fnet', 7L, 'categoria', 'Regulamento', 'competencia', date'2026-05-01', 'trechos', array(named_struct('texto', 'abc', 'possivel_vedacao', true))))")
    first = report.fund_lines(rows.withColumn("documentos", documents)).orderBy("cnpj").first().value.splitlines()
    assert first[2:] == ["(sem denominação)  [1]", "  ? | público-alvo n/d", "  PL médio 12m: R$ 1.234,6mi | cotistas n/d | admin: n/d", "  -- Regulamento (2026-05-01) doc 7", "     ...abc... [POSSÍVEL VEDAÇÃO]"]
    assert report.fund_lines(rows).filter("cnpj = '4'").first().value.endswith("PL médio 12m: PL n/d | cotistas n/d | admin: n/d")
