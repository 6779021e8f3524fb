import datetime as dt
import json
import zipfile
from decimal import Decimal

import pytest

from lastro.functions.parsing import LayoutError
from lastro.operators import ingest, metrics, upsert
from lastro.sources import csvzip, documents, html, paged
from lastro.store import Store
from lastro.streaming import sync

A, B, C = "11222333000181", "00000000000272", "00000000000353"


def zipped(path, **files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name + ".csv", text.encode("latin-1"))
    return str(path)


def test_registry(spark, tmp_path):
    text = f"TP_FUNDO;CNPJ_FUNDO;DENOM_SOCIAL;DT_REG;SIT;PUBLICO_ALVO;ADMIN;GESTOR;CLASSE\nFI;{A};Fundo \"A\";2010-01-01;CANCELADA;;ADMIN Z;G;\nFII;{A};Fundo A;2015-03-10;EM FUNCIONAMENTO NORMAL;Público;ADMIN A;G;\n ; ;\nFI;{B};\"Terra; FIAGRO\nlonga\";10/03/2015;CANCELADA;;;;\n"
    (tmp_path / "cad.csv").write_bytes(text.encode("latin-1"))
    got = {r.cnpj: r for r in ingest.registry_funds(csvzip.table(spark, str(tmp_path / "cad.csv"))).collect()}
    assert set(got) == {A, B}
    assert got[A].administrador == "ADMIN A" and got[A].dt_registro == dt.date(2015, 3, 10) and got[A].publico_alvo == "Público"
    assert got[B].tipo_veiculo == "FIAGRO" and "\n" in got[B].denominacao and got[B].classe_cvm is None


def fii(spark, tmp_path):
    general = f"CNPJ_Fundo;Data_Referencia;Versao;Nome_Fundo;Publico_Alvo;Segmento_Atuacao\n{A};2026-05-01;2;N2;P;Lajes\n{A};2026-05-01;1;N1;P;Velho\n{A};2026-04-01;;N0;P;Antes\n"
    complement = f"CNPJ_Fundo;Data_Referencia;Total_Numero_Cotistas;Patrimonio_Liquido;Valor_Patrimonial_Cotas\n{A};2026-05-01;1000;1;1\n{A};2026-05-01;1100;110000000.00;101,00\n{A};2026-04-01;;;\n"
    balance = f"CNPJ_Fundo;Data_Referencia;Total_Ativo;Patrimonio_Liquido\n{A};2026-05-01;9;999.99\n{A};2026-04-01;9;100000000\n"
    path = zipped(tmp_path / "fii.zip", inf_geral=general, inf_complemento=complement, inf_ativo_passivo=balance)
    return ingest.fii_reports(*(csvzip.table(spark, path, token=t) for t in ("geral", "complemento", "ativo_passivo")))


def test_fii_and_metrics(spark, tmp_path):
    reports, attributes = fii(spark, tmp_path)
    got = {r.competencia: r for r in reports.collect()}
    may, april = got[dt.date(2026, 5, 1)], got[dt.date(2026, 4, 1)]
    assert (may.versao, may.pl, may.num_cotistas, may.valor_cota) == (2, Decimal("110000000.00"), 1100, Decimal("101.00000000"))
    assert (april.versao, april.pl) == (None, Decimal("100000000.00"))
    assert attributes.first().segmento == "Lajes"
    m = metrics.fund_metrics(reports).first()
    assert (m.pl_medio_12m, m.pl_atual, m.cotistas_atual, m.competencia_ultima) == (Decimal("105000000.00"), Decimal("110000000.00"), 1100, dt.date(2026, 5, 1))


def test_running_version_resets(spark):
    rows = [("c", "m", v, i) for i, v in enumerate([3, 2, None, 1, 0, None])]
    df = spark.createDataFrame(rows, "cnpj string, competencia string, versao int, row_idx int")
    assert [r.accepted for r in ingest.running_version(df).orderBy("row_idx").collect()] == [True, False, True, True, False, True]
    assert ingest.fii_versions(df).first().versao is None


def test_fidc(spark, tmp_path):
    iv = f"CNPJ_FUNDO;DENOM_SOCIAL;DT_COMPTC;VL_PATRIM_LIQ\n{B};Nome;2026-05-31;50000000,00\n"
    x = f"CNPJ_FUNDO;DENOM_SOCIAL;DT_COMPTC;CLASSE_SERIE;QT_COTST\n{B};;2026-05-31;S1;8\n{B};;2026-05-31;S2;2\n"
    other = f"CNPJ_FUNDO;DT_COMPTC;VL_PL;QT_COTST\n{B};2026-05-31;1;999\n{C};2026-05-31;7;\n"
    reports, names = ingest.fidc_reports(csvzip.tables(spark, zipped(tmp_path / "f.zip", a_outra=other, tab_IV=iv, tab_X=x)))
    got = {r.cnpj: r for r in reports.collect()}
    assert (got[B].pl, got[B].num_cotistas) == (Decimal("50000000.00"), 10) and (got[C].pl, got[C].num_cotistas) == (Decimal("7.00"), None)
    assert names.first().denominacao == "Nome"
    with pytest.raises(LayoutError):
        ingest.fidc_reports(csvzip.tables(spark, zipped(tmp_path / "g.zip", t=f"CNPJ_FUNDO;DT_COMPTC\n{B};2026-05-31\n")))


def test_missing_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text("COLUNA_NOVA;OUTRA\n1;2\n")
    with pytest.raises(LayoutError, match="CNPJ_FUNDO"):
        ingest.registry_funds(csvzip.table(spark, str(tmp_path / "x.csv")))


def test_class_registry(spark, tmp_path):
    funds = f"ID_Registro_Fundo;CNPJ_Fundo;Tipo_Fundo;Denominacao_Social;Situacao;Administrador;Gestor\n1;{A};FIDC;Velho;Cancelado;X;\n2;{A};FIDC;Vivo;Em Funcionamento Normal;X;\n3;{A};FIDC;Depois;Cancelado;X;\n"
    classes = f"ID_Registro_Fundo;CNPJ_Classe;Publico_Alvo\n1;{A};Profissional\n2;{B};Qualificado\n2;{C};Profissional\n3;{C};Nunca\n"
    path = zipped(tmp_path / "r.zip", registro_fundo=funds, registro_classe=classes)
    got = ingest.registry_class_archive(csvzip.table(spark, path, token="registro_fundo"), csvzip.table(spark, path, token="registro_classe")).collect()
    assert len(got) == 1 and got[0].denominacao == "Vivo" and got[0].publico_alvo == "Profissional | Qualificado" and got[0].cnpjs_classes == [B, C]


def test_upserts(spark):
    target = spark.createDataFrame([(1, "a", "baixado"), (2, "b", "erro")], "id int, nome string, estado string")
    source = spark.createDataFrame([(2, None, "pendente"), (3, "c", "pendente")], "id int, nome string, estado string")
    got = {r.id: (r.nome, r.estado) for r in upsert.upsert(target, source, ["id"], ["nome"]).collect()}
    assert got == {1: ("a", "baixado"), 2: (None, "erro"), 3: ("c", "pendente")}
    again = upsert.upsert(upsert.upsert(target, source, ["id"]), source, ["id"])
    assert {r.id: (r.nome, r.estado) for r in again.collect()} == {1: ("a", "baixado"), 2: (None, "pendente"), 3: ("c", "pendente")}


def test_documents(spark, tmp_path):
    rows = [{"id": i, "descricaoFundo": "FUNDO 11.222.333/0001-81", "categoriaDocumento": "Regulamento", "dataReferencia": "29/07/2026 13:00", "dataEntrega": "30/07/2026 10:00", "versao": "x" if i == 1 else "2"} for i in (1, 2, 3)] + [{"descricaoFundo": "sem id"}]
    for n in range(2):
        (tmp_path / f"1-{n}.json").write_text(json.dumps({"recordsFiltered": 4, "data": rows[2 * n : 2 * n + 2]}))
    (tmp_path / "2-0.json").write_text(json.dumps({"recordsFiltered": 0, "data": []}))
    paged.register(spark)
    raw = spark.read.format("documents").option("tipos", "1,2").option("files", str(tmp_path)).option("size", 2).load()
    got = documents.document_rows(raw.select("tipo", "arrival", "value")).orderBy("id_fnet").collect()
    assert [(r.id_fnet, r.cnpj, r.versao) for r in got] == [(1, A, None), (2, A, 2), (3, A, 2)]
    assert raw.filter("tipo = '2'").count() == 0 and raw.filter("tipo = '1'").count() == 4
    assert got[0].competencia == dt.date(2026, 7, 1) and got[0].data_referencia == "29/07/2026 13:00" and got[0].data_entrega == dt.datetime(2026, 7, 30, 10)
    for odd in ({"x": 1}, [], {"data": {"id": 1}}, {"data": ["x"]}):
        with pytest.raises(paged.ShapeError):
            paged.check_shape(odd)
    assert paged.check_shape({"data": None}) == [] and paged.total_of({"recordsFiltered": 0, "recordsTotal": 3, "data": []}) == 3


def test_retry():
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return b"x"

    assert paged.fetch_with_retry(flaky, wait=waits.append) == b"x" and waits == [2.0, 4.0]

    class Gone(Exception):
        status = 404

    def gone():
        raise Gone

    with pytest.raises(Gone):
        paged.fetch_with_retry(gone, wait=waits.append)
    assert waits == [2.0, 4.0]


def test_requests_are_spaced():
    now, waits = [0.0], []

    def wait(s):
        waits.append(s)
        now[0] += s

    get = paged.spaced(lambda url: url.encode(), 1.0, lambda: now[0], wait)
    assert get("a") == b"a" and get("b") == b"b" and waits == [1.0]
    now[0] += 5
    get("c")
    assert waits == [1.0]


def test_files(spark, tmp_path):
    """Encodings, members that aren't asked for, the first path that exists, fill rates."""
    (tmp_path / "latin.csv").write_bytes("A;Ação\n1;é\n;\n2;x\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("\ufeffA;Ação\n1;é\n3\n".encode())
    for name, want in (("latin", [("1", "é"), ("2", "x")]), ("utf", [("1", "é"), ("3", None)])):
        rows = csvzip.table(spark, str(tmp_path / f"{name}.csv"))
        assert [(r.A, r.ACAO) for r in rows.orderBy("row_idx").collect()] == want
    path = zipped(tmp_path / "z.zip", um="A\n1\n", dois="A;B\n2;\n3;x\n")
    assert [n for n, _ in csvzip.tables(spark, path)] == ["um.csv", "dois.csv"]
    two = csvzip.table(spark, path, token="dois")
    assert csvzip.fill_rates(two, ["A", "B"]).first().asDict() == {"rows": 2, "A": 1.0, "B": 0.5}
    assert csvzip.first_readable(spark, str(tmp_path / "none.zip"), path) == path
    with pytest.raises(RuntimeError):
        csvzip.first_readable(spark, str(tmp_path / "none.zip"))
    with pytest.raises(LayoutError):
        csvzip.check_layout(two.columns, {"c": ("C",)}, ("c",), "z")


def test_sync(spark):
    target = spark.createDataFrame([(1, "velho", "baixado", dt.datetime(2026, 1, 1))], "id_fnet long, categoria string, status_download string, data_entrega timestamp_ntz")
    arrivals = spark.createDataFrame([(1, "x", dt.datetime(2026, 1, 2), 0), (1, "novo", dt.datetime(2026, 1, 2), 1), (2, "n", dt.datetime(2026, 1, 3), 2)], "id_fnet long, categoria string, data_entrega timestamp_ntz, arrival int")
    got = {r.id_fnet: (r.categoria, r.status_download) for r in sync.apply_documents(target, arrivals).collect()}
    assert got == {1: ("novo", "baixado"), 2: ("n", "pendente")}
    assert sync.new_cursor(arrivals, "f", dt.datetime(2026, 1, 4)).first().cursor == "2026-01-03T00:00:00"
    assert sync.since(arrivals, dt.datetime(2026, 1, 4)).count() == 1
    done = []
    with pytest.raises(ExceptionGroup):
        sync.sync_types(["a", "b", "c"], lambda t: done.append(t) or (1 / 0 if t == "b" else {}))
    assert done == ["a", "b", "c"] and sync.truncated(200, 2, 100) and not sync.truncated(199, 2, 100)


def test_stream(spark, tmp_path):
    kind = "id_fnet long, cnpj string, categoria string, data_entrega timestamp_ntz, arrival long"
    store = Store(spark, str(tmp_path / "store"))
    for n, rows in enumerate([[(1, A, "a", None, 0)], [(1, A, "b", None, 1), (2, None, "c", None, 2)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = sync.stream_documents(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), store, str(tmp_path / "check"), name=f"docs{n}")
        q.awaitTermination(120)
    assert {r.id_fnet: (r.categoria, r.status_download) for r in store.read("documentos").collect()} == {1: ("b", "pendente"), 2: ("c", "pendente")}
    assert [r.cnpj for r in store.read("fundos").collect()] == [A]


def test_html_options(spark):
    page = "<select id='tipo'><option value='0'>Todos</option><option value='1'> FII <b>x</b></option><option value='2'></option></select><select name='cat'><option>Sem valor</option></select><select><option value='9'>nada</option></select>"
    got = html.select_options(spark.createDataFrame([(page,), (None,), ("<p>",)], "html string")).collect()
    assert [tuple(r) for r in got] == [("tipo", "0", "Todos"), ("tipo", "1", "FII x"), ("cat", "", "Sem valor")]
    odd = """<!-- <select id=x><option value=1>no</option></select> --><SELECT class="a" NAME = 'T&amp;C'><OPTION selected value=7>A&ccedil;&atilde;o &#38; x<option value="8">B</OPTION>\n<option value=''> C </option>"""
    assert [tuple(r) for r in html.select_options(spark.createDataFrame([(odd, 5)], "html string, n int"), "html", "n").collect()] == [(5, "T&C", "8", "B"), (5, "T&C", "", "C")]


def test_texts(spark):
    rows = spark.createDataFrame([(1, bytearray(("<a>Ação " + "x" * 300).encode()), "xml"), (2, bytearray(b"%PDF"), "pdf")], "id_fnet long, content binary, formato string")
    got = {r.id_fnet: r for r in documents.texts(rows).collect()}
    assert got[1].texto_norm.startswith("<a>acao") and len(got[1].texto) == len(got[1].texto_norm) and got[2].origem == "vazio"


@pytest.mark.parametrize("encoding", ["latin-1", "utf-8"])
def test_long_plain_files(spark, tmp_path, encoding):
    """A plain file of more than a block is read from its start, whatever its encoding."""
    body = "".join(f"{k:014d};Fundo é {'x' * 60}\n" for k in range(20_000))
    (tmp_path / "longo.csv").write_bytes(f"CNPJ;NOME\n{body}".encode(encoding))
    rows = csvzip.table(spark, str(tmp_path / "longo.csv"))
    assert rows.count() == 20_000
    assert rows.orderBy("row_idx").first().CNPJ == "0" * 14 and {r.NOME for r in rows.collect()} == {f"Fundo é {'x' * 60}"}


def test_tables_of_several_archives(spark, tmp_path):
    """Members of one name are one table, whatever their places; an archive may lack one; headers are written once a member."""
    rows = [("a_01.zip", "b.csv", 0, "1;x"), ("a_02.zip", "a.csv", 0, "9"), ("a_02.zip", "b.csv", 1, "3;z"), ("a_02.zip", "b.csv", 0, "2;y")]
    table = spark.createDataFrame(rows, "archive string, member string, place long, value string")
    got = csvzip.write_archives(table, str(tmp_path / "out"), {"a.csv": "C", "b.csv": "A;B"}).collect()
    assert {(r.path.rpartition("/")[2], r.members, r.rows) for r in got} == {("a_01.zip", 1, 2), ("a_02.zip", 2, 5)}
    found = csvzip.tables(spark, str(tmp_path / "out" / "a_*.zip"))
    assert [n for n, _ in found] == ["a.csv", "b.csv"]
    assert [r.C for r in found[0][1].collect()] == ["9"]
    assert {(r.A, r.B, r.row_idx) for r in found[1][1].collect()} == {("1", "x", 0), ("2", "y", 0), ("3", "z", 1)}
