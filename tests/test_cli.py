import json

import pytest

from lastro import cli
from tests.test_ingest import A, zipped


def test_commands(spark, tmp_path, capsys):
    store = str(tmp_path / "store")

    def call(*args):
        return cli.main([args[0], "--store", store, *args[1:]], spark)

    (tmp_path / "cad.csv").write_text(f"TP_FUNDO;CNPJ_FUNDO;DENOM_SOCIAL;DT_REG;SIT\nFII;{A};Fundo A;2015-03-10;EM FUNCIONAMENTO NORMAL\n")
    call("sync-registry", "--file", str(tmp_path / "cad.csv"))
    parts = {
        "geral": f"CNPJ_Fundo;Data_Referencia;Versao;Nome_Fundo;Publico_Alvo;Segmento_Atuacao\n{A};2026-05-01;1;Fundo A;Geral;Lajes\n",
        "complemento": f"CNPJ_Fundo;Data_Referencia;Total_Numero_Cotistas;Patrimonio_Liquido\n{A};2026-05-01;10;5,00\n",
        "ativo_passivo": f"CNPJ_Fundo;Data_Referencia;Patrimonio_Liquido\n{A};2026-05-01;9\n",
    }
    call("sync-fii", "--file", zipped(tmp_path / "fii.zip", **parts))
    call("metrics")
    docs = [{"id": 7, "cnpjFundo": A, "categoriaDocumento": "Regulamento", "dataEntrega": "01/05/2026 10:00"}]
    (tmp_path / "api").mkdir()
    (tmp_path / "api/1-0.json").write_text(json.dumps({"data": docs}))
    call("sync-documents", "--file", str(tmp_path / "api"), "--tipos", "1")
    own = cli.Store(spark, store)
    fund = own.read("fundos").first()
    assert (fund.segmento, fund.tipo_veiculo, fund.situacao) == ("Lajes", "FII", "EM FUNCIONAMENTO NORMAL")
    assert own.read("documentos").first().status_download == "pendente"
    capsys.readouterr()
    call("search", "--filtros", "plMin=1", "--json")
    said = capsys.readouterr().out.splitlines()
    assert said[0] == "1 fundos" and json.loads(said[1])["pl_medio_12m"] == 5
    with pytest.raises(Exception, match="COLUNA|CNPJ"):
        (tmp_path / "bad.csv").write_text("X;Y\n1;2\n")
        call("sync-registry", "--file", str(tmp_path / "bad.csv"))
    call("download-docs", "--origem", str(tmp_path / "remote-{}.bin"))
    assert own.read("documentos").first().status_download == "erro"
    runs = own.read("sync_runs").orderBy("id").collect()
    assert [r.status for r in runs] == ["ok", "ok", "ok", "ok", "erro", "ok"] and json.loads(runs[3].detalhe) == {"documentos": 1, "tipos_truncados": []} and json.loads(runs[5].detalhe) == {"baixados": 0, "erros": 1}
    assert len(own._versions("sync_runs")) <= cli.KEPT
    assert call("status", "--check") == 1


def test_killed_runs_stay_open(spark, tmp_path, monkeypatch):
    """What is in the log while a command runs is what a killed one leaves."""
    store, seen = cli.Store(spark, str(tmp_path / "store")), []
    monkeypatch.setitem(cli.COMMANDS, "metrics", (lambda own, args: seen.extend(own.read("sync_runs").collect()), ()))
    cli.main(["metrics", "--store", store.folder], spark)
    assert [(r.id, r.fonte, r.status) for r in seen] == [(1, "metrics", "executando")] and store.read("sync_runs").first().status == "ok"


def test_types_have_their_own_cursors(spark, tmp_path, capsys):
    store = cli.Store(spark, str(tmp_path / "store"))
    (tmp_path / "api").mkdir()

    def answer(tipo, *rows, asked=""):
        """The first page of a type's answer; asked: what the request says besides, in a stored answer's name."""
        (tmp_path / f"api/{tipo}{asked}-0.json").write_text(json.dumps({"data": [{"id": i, "cnpjFundo": A, "categoriaDocumento": c, "dataEntrega": f"{day:02}/05/2026 10:00"} for i, c, day in rows]}))

    def call(*args):
        return cli.main(["sync-documents", "--store", store.folder, "--file", str(tmp_path / "api"), *args], spark)

    answer("1", (1, "Regulamento", 1), (2, "Fato", 20))
    (tmp_path / "api/2-0.json").write_text("{}")  # not an answer
    with pytest.raises(ExceptionGroup):
        call("--tipos", "2,1")
    assert {r.fonte: r.cursor for r in store.read("sync_state").collect()} == {"fnet_documentos:tf=1:cat=all": "2026-05-20T10:00:00"}
    answer("2", (3, "Regulamento", 2))
    # The cursor less a day is in the request; the time is tested again.
    answer("1", (6, "Fato", 18), (4, "Fato", 19), (2, "Fato", 20), asked="~desde_2026-05-19")
    call("--tipos", "1,2", "--pagina", "3", "--max-paginas", "1")
    assert sorted(r.id_fnet for r in store.read("documentos").collect()) == [1, 2, 3, 4] and "truncated after 1 pages: 1" in capsys.readouterr().err
    answer("1", (5, "Fato", 18), (4, "Fato", 19), (7, "Regulamento", 19), asked="~desde_2026-05-18")
    call("--tipos", "1", "--categoria-unica", "Fato", "--desde", "2026-05-18")
    assert sorted(r.id_fnet for r in store.read("documentos").collect()) == [1, 2, 3, 4, 5]
    (tmp_path / "remote-4.bin").write_bytes(b" <?xml version='1.0'?><a/>")
    cli.main(["download-docs", "--store", store.folder, "--origem", str(tmp_path / "remote-{}.bin"), "--categorias", "Fato", "--limite", "2"], spark)
    got = {r.id_fnet: (r.status_download, r.url_storage, r.formato) for r in store.read("documentos").collect()}
    assert got[2] == ("erro", None, None) and got[4] == ("baixado", "fnet/4.xml", "xml") and got[5][0] == "pendente"
    assert (tmp_path / "store/files/fnet/4.xml").read_bytes().startswith(b" <?xml")
