import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lastro.functions.text import fold
from lastro.operators import classify, export, health, prospect, search
from lastro.schema import TABLES, schema

A, B = "11222333000181", "00000000000272"


@pytest.fixture(scope="module")
def store(spark):
    funds = spark.createDataFrame([(A, "Fundo A", "FII", "Qualificado", "Em Funcionamento Normal"), (B, "Fundo; B", "FIDC", "Geral", "CANCELADA")], "cnpj string, denominacao string, tipo_veiculo string, publico_alvo string, situacao string")
    funds = funds.withColumns({c: F.lit(None).cast("string") for c in ("administrador", "gestor", "segmento")})
    metrics = spark.createDataFrame([(A, dt.date(2026, 5, 1), Decimal(10), Decimal(10), 5), (B, dt.date(2026, 5, 1), Decimal(20), Decimal(20), 9)], TABLES["fundos_metricas"].replace(", atualizado_em timestamp_ntz", ""))
    day = lambda n: dt.datetime(2026, 1, n)
    docs = [(400, A, "Regulamento", day(1)), (500, A, "Regulamento", day(2)), (501, A, "Regulamento", day(3)), (600, B, "Regulamento", day(1)), (700, B, "Fato", day(1)), (800, None, "Regulamento", day(9))]
    documents = spark.createDataFrame(docs, "id_fnet long, cnpj string, categoria string, data_entrega timestamp_ntz")
    documents = documents.withColumns({"tipo": F.lit(None).cast("string"), "url_storage": F.lit(None).cast("string"), "competencia": F.lit(None).cast("date")})
    body = [(400, "Permitida a CPR-F."), (500, "A CPR-F antiga"), (501, "Aplica em CPR-\nF e cédulas do produto"), (600, "É vedada a aplicação em CPR-F"), (700, "cpr"), (800, "cpr-f")]
    texts = spark.createDataFrame(body, "id_fnet long, texto string").withColumn("texto_norm", fold(F.col("texto")))
    return funds, metrics, documents, texts


def ids(result):
    return [[d.id_fnet for d in r.documentos] for r in result.funds.collect()]


@pytest.mark.parametrize(("given", "want"), [
    ({"termos": ("CPR-F",)}, [[600], [501]]), ({"termos": ("CPR-F",), "excluir_vedacoes": True}, [[501]]), ({"termos": ("CPR-F",), "apenas_vigente": False}, [[600], [501, 500, 400]]),
    ({"termos": ("cpr-f", "cédula de produto"), "exigir_todos_termos": True}, [[501]]), ({"termos": ("cédula de produto",), "literal": True}, []), ({"termos": ("CPR-F",), "pl_max": 15}, [[501]]),
    ({"termos": ("CPR-F",), "limite": 1, "offset": 1}, [[501]]), ({"termos": ("CPR",), "categorias_documento": ("Fato",)}, [[700]]),
])
def test_search(store, given, want):
    result = search.search(*store, search.Filters(**given))
    assert ids(result) == want
    if "limite" in given:
        assert result.total == 2


def test_newer_document_without_text_hides_older(store):
    funds, metrics, documents, texts = store
    assert ids(search.search(funds, metrics, documents, texts.filter("id_fnet <> 501"), search.Filters(termos=("CPR-F",)))) == [[600]]


@pytest.mark.parametrize(("given", "want"), [
    ({}, [B, A]), ({"tipos_veiculo": ("FII",)}, [A]), ({"situacao": "em funcionamento normal"}, [A]), ({"publico_alvo": ("QUALI",)}, [A]), ({"publico_alvo": ("g_ral", "x")}, [B]), ({"cotistas_min": 6}, [B]),
])
def test_funds(store, given, want):
    assert [r.cnpj for r in search.search(*store, search.Filters(**given)).funds.collect()] == want


def test_query_string():
    f = search.filters_from_query("?tipo=FII,FIDC&tipo=FIP&termo=CPR-F&todos=1&limite=9999&plMin=1.5")
    assert f.tipos_veiculo == ("FII", "FIDC", "FIP") and f.exigir_todos_termos and f.limite == 200 and f.pl_min == 1.5 and f.apenas_vigente
    assert search.filters_from_query("limite=9999", export=True).limite == 2000
    with pytest.raises(ValueError):
        search.filters_from_query("plMin=1,5")


def test_export(spark, store, tmp_path):
    found = search.search(*store, search.Filters(termos=("CPR-F",))).funds
    rows = export.export_rows(found)
    export.write_ordered(export.export_rows(found, ("pl_medio_12m", "documento")), ("-ordem_pl_medio_12m", "cnpj", "ordem_documento"), str(tmp_path / "parts"), export.COLUMNS)
    size = export.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "out.csv"))
    text = (tmp_path / "out.csv").read_bytes().decode()
    assert size == len(text.encode()) and text.startswith("\ufeffcnpj;") and text.endswith("\r\n") and '"Fundo; B"' in text and text.count("\r\n") == 3
    assert [r.possivel_vedacao for r in rows.collect()] == ["sim", "nao"]
    assert export.export_rows(search.search(*store, search.Filters()).funds).first().documento_id == ""
    assert export.file_name(["CPR-F / x"]) == "fundos-cpr-f-x.csv" and export.file_name([]) == "fundos-fundos.csv"


def test_pages(store):
    funds, _, documents, texts = store
    assert [(r.id_fnet, r.tem_texto) for r in search.fund_page(documents, texts.filter("id_fnet <> 500"), A).collect()] == [(501, True), (500, False), (400, True)]
    assert len(search.document_page(documents, texts, 501, ["cpr-f"]).first().trechos) == 1
    assert [tuple(r) for r in search.category_counts(documents).collect()] == [("Regulamento", 5), ("Fato", 1)]


@pytest.mark.parametrize(("text", "want"), [
    ("O Fundo é monocedente.", ("monocedente", "termo explicito no regulamento")), ("fundo multicedente", ("multicedente", "termo explicito no regulamento")),
    ("“Cedente”: a EMPRESA, CNPJ 11.222.333/0001-81;", ("monocedente", "definicao de Cedente(s)")), ("Cedentes significam as pessoas jurídicas que venham a ceder", ("multicedente", "definicao de Cedente(s)")),
    ("monocedente ou multicedente", ("ambiguo", "termos conflitantes")), ("nada aqui", ("indeterminado", "")), ("", ("indeterminado", "")),
])
def test_assignors(spark, text, want):
    rows = spark.createDataFrame([(text,)], "texto string").withColumn("texto_norm", fold(F.col("texto")))
    r = classify.assignor_class(rows).first()
    assert (r.classificacao, r.fonte) == want


def test_fees(spark):
    texts = [
        "taxa de custodia minimo mensal de r$ 9,00. (d) taxa de consultoria de 0,35% (trinta e cinco) ao ano, com valor minimo mensal de r$ 15.000,00. taxa maxima de custodia 7% r$ 1,00",
        "remuneracao da consultora especializada: remuneracao mensal fixa de r$ 12.500,00 e uma remuneracao variavel de 2%", "", "nada",
        "taxa de consultoria 1,5% a. a. e 1,5% ao ano e 10,123% e 1234% taxa de consultoria 2% aa." + " " * 950 + "9%", "taxa de consultoria e despesas do fundo 3% encargos do fundo 4%",
    ]
    got = [r.f for r in classify.fees(spark.createDataFrame(list(enumerate(texts)), "i int, texto_norm string")).orderBy("i").collect()]
    assert got[0].pct_aa == ["0,35"] and got[0].minimos_mensais == ["15.000,00"] and not got[0].outros_valores and got[0].presente
    assert got[1].fixos_mensais == ["12.500,00"] and got[1].tem_variavel and got[1].pct_sem_periodo == ["2"]
    assert not got[2].presente and not got[3].presente
    assert got[4].pct_aa == ["1,5", "2"] and got[4].pct_sem_periodo == ["10,123"]
    assert got[5].pct_sem_periodo == ["3"]  # a title less than CLAUSE_SKIP behind the term ends nothing


def test_survey(spark):
    funds = spark.createDataFrame([(A, "FA", "registro", "Ativo", None, None, [B], 0), ("9" * 14, "FC", "cad_fi", "x", None, None, None, 1)], "cnpj string, denominacao string, fonte string, situacao string, publico_alvo string, gestor string, cnpjs_classes array<string>, row_idx int")
    docs = spark.createDataFrame([(7, B, "Regulamento", dt.datetime(2026, 1, 1))], "id_fnet long, cnpj string, categoria string, data_entrega timestamp_ntz")
    texts = spark.createDataFrame([(7, "Fundo monocedente. Taxa de consultoria de 1% a.a.", 3)], "id_fnet long, texto string, num_paginas int").withColumn("texto_norm", fold(F.col("texto")))
    got = {r.cnpj: r for r in classify.fee_survey(funds, docs, texts).collect()}
    assert got[A].taxa_consultoria_pct_aa == "1" and got[A].obs.endswith(B) and got[A].cedencia == "monocedente" and got["9" * 14].obs.startswith("nenhum")
    assert tuple(classify.fee_survey(funds, docs, texts).columns) == classify.SURVEY_COLUMNS


def test_prospect(spark):
    registry = spark.createDataFrame([(A, "EM FUNCIONAMENTO NORMAL"), ("00000000000191", "CANCELADA")], "cnpj string, situacao string")
    docs = spark.createDataFrame([(1, None, "sem numero", "Regulamento", 0), (2, "00000000000191", "", "Regulamento", 1), (3, A, "", "Outro", 2), (4, A, "", "Regulamento", 3)], "id_fnet long, cnpj string, descricao string, categoria string, arrival int")
    body = "protocolo 99112223330001819 adm 33.000.167/0001-01 Fundo 11.222.333/0001-81 aplica em CPR-F"
    texts = spark.createDataFrame([(i, body) for i in (1, 2, 3, 4)], "id_fnet long, texto string").withColumn("texto_norm", fold(F.col("texto")))
    got = prospect.prospect(docs, texts, registry, ["CPR-F"]).collect()
    assert [(r.id_fnet, r.cnpj) for r in got] == [(1, A)] and len(got[0].trechos) == 1
    domains = spark.createDataFrame([("categoriaDoc", "5", " Regulamento "), ("categoriaDoc", "0", "Regulamento"), ("tipo", "x", "Y")], "grupo string, id_fnet string, rotulo string")
    assert prospect.domain_id(domains, "Categoria", "REGULAMENTO").first().id_fnet == "5" and prospect.fund_types(domains).count() == 1


NOW = dt.datetime(2026, 7, 29, 12)


def checks(spark, runs, month=dt.date(2026, 6, 1), delivered=dt.datetime(2026, 7, 28), origin="xml"):
    r = spark.createDataFrame(runs, schema("sync_runs"))
    docs = spark.createDataFrame([(1, delivered, "baixado")], "id_fnet long, data_entrega timestamp_ntz, status_download string")
    out = health.diagnose(r, spark.createDataFrame([(A,)], "cnpj string"), spark.createDataFrame([(A, month)] if month else [], "cnpj string, competencia date"), docs, spark.createDataFrame([(1, origin)], "id_fnet long, origem string"), NOW)
    return {c.nome: (c.status, c.mensagem) for c in out.collect()}, health.worst(out).first().status


def run(i, source, start, status="ok", error=None):
    return (i, source, start, None if status == "executando" else start, status, None, error)


@pytest.mark.parametrize(("runs", "more", "name", "status", "worst"), [
    ([run(1, "cvm", NOW)], {}, "frescor:cvm", "ok", "ok"), ([], {}, "execucoes", "erro", "erro"), ([run(1, "cvm", NOW, "erro", "x"), run(2, "cvm", NOW)], {}, "frescor:cvm", "ok", "ok"),
    ([run(1, "fnet", NOW, "erro", "boom")], {}, "execucao:fnet", "erro", "erro"), ([run(1, "cvm", dt.datetime(2026, 6, 29, 12))], {}, "frescor:cvm", "erro", "erro"),
    ([run(1, "fnet", NOW - dt.timedelta(days=3, hours=23))], {}, "frescor:fnet", "ok", "ok"), ([run(1, "fnet", NOW - dt.timedelta(hours=10), "executando")], {}, "execucao:fnet", "erro", "erro"),
    ([run(1, "cvm", NOW)], {"month": dt.date(2026, 2, 1)}, "informes", "erro", "erro"), ([run(1, "cvm", NOW)], {"month": None}, "informes", "erro", "erro"),
    ([run(1, "cvm", NOW)], {"origin": "vazio"}, "ocr", "aviso", "aviso"), ([run(1, "cvm", NOW)], {"delivered": dt.datetime(2025, 6, 1)}, "documentos", "aviso", "aviso"),
])
def test_health(spark, runs, more, name, status, worst):
    got, level = checks(spark, runs, **more)
    assert got[name][0] == status and level == worst


def test_short_run_has_no_row(spark):
    got, _ = checks(spark, [run(1, "fnet", NOW - dt.timedelta(hours=5), "executando")])
    assert not [n for n in got if "fnet" in n]


def test_recorded():
    runs = []
    with health.recorded(runs, "x") as details:
        details["n"] = 1
    with pytest.raises(ZeroDivisionError), health.recorded(runs, "y"):
        1 / 0  # noqa: B018
    assert [r["status"] for r in runs] == ["ok", "erro"] and runs[0]["detalhe"] == '{"n": 1}' and "ZeroDivision" in runs[1]["erro"]
