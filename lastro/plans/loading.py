"""Registered queries that load and reconcile: extracts, archives, upserts, queues, checks; and the same in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from lastro.functions import parsing as P
from lastro.operators import classify, health, ingest, prospect, upsert
from lastro.plans import driver_tables as D
from lastro.plans.catalog import NOW, RUNNING, SUPPLIERS, query, suppliers
from lastro.sources import csvzip, documents
from lastro.streaming import sync

KEYED = "cnpj, competencia"


def month_text(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def money_text(c):
    """An amount as the sources write it: points between thousands, a comma before cents."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


# Extracts of monthly reports


def fii_extracts(spark, d):
    rows = D.registry_rows(spark, d)
    key = [F.col("cnpj").alias("CNPJ_Fundo_Classe"), month_text("competencia").alias("Data_Referencia")]
    general = rows.select(*key, F.col("versao").cast("string").alias("Versão"), F.col("publico_alvo").alias("Publico_Alvo"), F.col("situacao").alias("Segmento_Atuacao"), F.concat(F.lit(" "), "cnpj").alias("Nome_Fundo"), "row_idx")
    complement = rows.filter("publico_alvo <> '5-LOW'").select(*key, (F.col("row_idx") % 1000).cast("string").alias("Total_Numero_Cotistas"), money_text(F.col("pl")).alias("Patrimonio_Liquido"), F.concat((F.col("row_idx") % 90).cast("string"), F.lit(",12345678")).alias("Valor_Patrimonial_Cotas"), "row_idx")
    balance = rows.select(*key, money_text(F.col("pl")).alias("Patrimonio_Liquido"), "row_idx")
    return general, complement, balance


FULL_MERGE = f"""WITH g AS (SELECT {KEYED}, arg_max_null(versao, row_idx) AS versao FROM {RUNNING} WHERE accepted GROUP BY ALL),
c AS (SELECT {KEYED}, CAST(arg_max(row_idx % 1000, row_idx) AS INTEGER) AS num_cotistas, arg_max_null(pl, row_idx) AS pl, CAST(arg_max(row_idx % 90 || '.12345678', row_idx) AS DECIMAL(20,8)) AS valor_cota FROM {D.REGISTRY_ROWS} WHERE publico_alvo <> '5-LOW' GROUP BY ALL),
b AS (SELECT {KEYED}, arg_min(pl, row_idx) FILTER (pl IS NOT NULL) AS pl FROM {D.REGISTRY_ROWS} GROUP BY ALL)
SELECT cnpj, competencia, versao, num_cotistas, coalesce(c.pl, b.pl) AS pl, valor_cota, 'fii_inf_mensal' AS fonte FROM g FULL JOIN c USING ({KEYED}) FULL JOIN b USING ({KEYED})"""


@query(FULL_MERGE)
def full_merge(spark, d):
    return ingest.fii_reports(*fii_extracts(spark, d))[0].select("cnpj", "competencia", "versao", "num_cotistas", "pl", "valor_cota", "fonte")


@query(f"SELECT cnpj, publico_alvo, situacao AS segmento, cnpj AS denominacao FROM (SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY competencia DESC, row_idx DESC) AS n FROM {RUNNING} WHERE accepted) WHERE n = 1")
def report_attributes(spark, d):
    return ingest.fii_reports(*fii_extracts(spark, d))[1].select("cnpj", "publico_alvo", "segmento", "denominacao")


def fidc_tables(spark, d):
    """An archive's tables from the order lines; a line that is there twice counts once."""
    once = Window.partitionBy("l_orderkey", "l_partkey", "l_linenumber").orderBy("l_extendedprice", "l_quantity", "l_shipdate", "l_suppkey")
    rows = D.read(spark, d, "lineitem").withColumn("place", F.row_number().over(once)).filter("place = 1").select(
        D.padded("l_suppkey").alias("cnpj"), F.trunc("l_shipdate", "month").alias("competencia"), F.col("l_linenumber").alias("file_idx"), F.expr("l_orderkey * 1000000 + l_partkey").alias("row_idx"),
        F.expr("if(l_returnflag = 'N', null, cast(l_extendedprice as decimal(20,2)))").alias("pl"), "l_linestatus", "l_quantity",
    )
    key = [F.col("cnpj").alias("CNPJ_FUNDO"), month_text("competencia").alias("DT_COMPTC")]
    name = F.when(F.col("file_idx") > 2, F.concat(F.lit("Fundo "), F.col("row_idx").cast("string"))).otherwise("").alias("DENOM_SOCIAL")
    order = (F.col("row_idx") * 10 + F.col("file_idx")).alias("row_idx")
    return [
        ("outra", rows.filter("l_linestatus = 'O'").select(*key, money_text(F.col("pl")).alias("VL_PL"), F.col("l_quantity").cast("int").cast("string").alias("QT_COTST"), order)),
        ("x_tab_iv_2024", rows.select(*key, name, money_text(F.col("pl")).alias("VL_PATRIM_LIQ"), order)),
        ("x_tab_x_2024", rows.filter("l_linestatus = 'F'").select(*key, F.lit("S").alias("CLASSE_SERIE"), F.col("l_quantity").cast("int").cast("string").alias("QT_COTST"), order)),
    ]


LINES = """(SELECT cnpj, competencia, pl, row_idx * 10 + file_idx AS o, file_idx, s, CAST(q AS INTEGER) AS q FROM (SELECT lpad(CAST(l_suppkey AS VARCHAR), 14, '0') AS cnpj, CAST(date_trunc('month', l_shipdate) AS DATE) AS competencia, l_linenumber AS file_idx, l_orderkey * 1000000 + l_partkey AS row_idx,
CASE WHEN l_returnflag <> 'N' THEN CAST(l_extendedprice AS DECIMAL(20,2)) END AS pl, l_linestatus AS s, l_quantity AS q FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber ORDER BY l_extendedprice, l_quantity, l_shipdate, l_suppkey) = 1))"""


REPORTS_OF_LINES = f"""WITH l AS (SELECT * FROM {LINES}),
o AS (SELECT {KEYED}, arg_max(pl, o) FILTER (pl IS NOT NULL) AS pl, arg_max(q, o) AS q FROM l WHERE s = 'O' GROUP BY ALL),
i AS (SELECT {KEYED}, arg_max(pl, o) FILTER (pl IS NOT NULL) AS pl FROM l GROUP BY ALL), x AS (SELECT {KEYED}, CAST(sum(q) AS INTEGER) AS q FROM l WHERE s = 'F' GROUP BY ALL),
a AS (SELECT cnpj, competencia, coalesce(i.pl, o.pl) AS pl, coalesce(x.q, o.q) AS num_cotistas FROM i FULL JOIN o USING ({KEYED}) FULL JOIN x USING ({KEYED}))
SELECT cnpj, competencia, pl, num_cotistas, 'fidc_inf_mensal' AS fonte FROM a WHERE pl IS NOT NULL OR num_cotistas IS NOT NULL"""


@query(REPORTS_OF_LINES)
def fidc_reports(spark, d):
    return ingest.fidc_reports(fidc_tables(spark, d))[0].select("cnpj", "competencia", "pl", "num_cotistas", "fonte")


@query(f"SELECT cnpj, 'Fundo ' || min(o // 10) AS denominacao FROM {LINES} WHERE file_idx > 2 GROUP BY cnpj")
def fidc_names(spark, d):
    return ingest.fidc_reports(fidc_tables(spark, d))[1]


# Registry


@query(f"""WITH r AS (SELECT cnpj, list(publico_alvo ORDER BY row_idx) AS p, list(lpad(CAST(row_idx % 50 AS VARCHAR), 14, '0') ORDER BY row_idx) FILTER (lpad(CAST(row_idx % 50 AS VARCHAR), 14, '0') <> cnpj) AS c FROM {D.REGISTRY_ROWS} GROUP BY cnpj)
SELECT cnpj, list_reduce(p, lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || ' | ' || x END) AS publico_alvo, coalesce(c, []) AS cnpjs_classes FROM r""")
def ordered_concat_dedup(spark, d):
    rows = D.registry_rows(spark, d).withColumn("cnpj_classe", F.lpad((F.col("row_idx") % 50).cast("string"), 14, "0"))
    return ingest.joined_audiences(rows)


FIRST_ACTIVE = f"(SELECT *, min(row_idx) FILTER (situacao = 'EM FUNCIONAMENTO NORMAL') OVER (PARTITION BY cnpj) AS first_active FROM {D.REGISTRY_ROWS})"


@query(f"""WITH f AS (SELECT * FROM {FIRST_ACTIVE}), ids AS (SELECT row_idx AS id, cnpj FROM f WHERE first_active IS NULL OR row_idx <= first_active),
c AS (SELECT i.cnpj, l.k, l.p, l.s FROM ids i JOIN (SELECT l_orderkey AS id, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS k, l_returnflag AS p, lpad(CAST(l_suppkey AS VARCHAR), 14, '0') AS s FROM lineitem) l USING (id)),
j AS (SELECT cnpj, list(p ORDER BY k, p) AS p, list(s ORDER BY k, s) FILTER (s <> cnpj) AS s FROM c GROUP BY cnpj), w AS (SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY situacao = 'EM FUNCIONAMENTO NORMAL' DESC, CASE WHEN first_active IS NULL THEN -row_idx ELSE row_idx END) AS n FROM f)
SELECT cnpj, 'Fundo ' || row_idx AS denominacao, situacao, list_reduce(j.p, lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || ' | ' || x END) AS publico_alvo, CASE WHEN j.cnpj IS NOT NULL THEN coalesce(j.s, []) END AS cnpjs_classes FROM w LEFT JOIN j USING (cnpj) WHERE n = 1""")
def registry_archive(spark, d):
    rows = D.registry_rows(spark, d)
    funds = rows.select(F.col("row_idx").cast("string").alias("ID_Registro_Fundo"), F.col("cnpj").alias("CNPJ_Fundo"), F.concat(F.lit("Fundo "), F.col("row_idx").cast("string")).alias("Denominacao_Social"), F.col("situacao").alias("Situacao"), "row_idx")
    lines = D.read(spark, d, "lineitem")
    classes = lines.select(F.col("l_orderkey").cast("string").alias("ID_Registro_Fundo"), D.padded("l_suppkey").alias("CNPJ_Classe"), F.col("l_returnflag").alias("Publico_Alvo"), F.expr("l_orderkey * 100000000 + l_partkey * 100 + l_linenumber").alias("row_idx"))
    return ingest.registry_class_archive(funds, classes).select("cnpj", "denominacao", "situacao", "publico_alvo", "cnpjs_classes")


KINDS = ("Fundo Imobiliário", "FIDC-NP", "Direitos Creditórios", "FII x", "Participações", "FIAGRO")
KIND = "['" + "', '".join(KINDS) + "'][c_nationkey % 6 + 1]"


def typed(spark, d):
    kind = F.element_at(F.lit(list(KINDS)), F.col("c_nationkey") % 6 + 1)
    return D.read(spark, d, "customer").select(D.padded("c_custkey").alias("cnpj"), kind.alias("tipo"), F.col("c_mktsegment").alias("administrador"), F.expr("if(c_acctbal >= 0, 'Em Funcionamento Normal', 'Cancelado')").alias("situacao"), F.col("c_custkey").alias("row_idx"))


@query(f"SELECT lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS cnpj, {KIND} AS tipo FROM customer WHERE c_mktsegment ILIKE '%build%' AND c_nationkey % 6 IN (1, 2) AND c_acctbal >= 0 ORDER BY c_custkey LIMIT 30")
def select_funds(spark, d):
    return classify.select_funds(typed(spark, d), "Build", "fidc", most=30).select("cnpj", "tipo")


@query(f"SELECT s.cnpj, {KIND} AS tipo FROM {SUPPLIERS} s LEFT JOIN customer ON s.cnpj = lpad(CAST(c_custkey AS VARCHAR), 14, '0')")
def select_listed(spark, d):
    return classify.select_funds(typed(spark, d), cnpjs=suppliers(spark, d).select("cnpj")).select("cnpj", "tipo")


DOMAINS = "(SELECT p_brand AS grupo, CAST(p_size AS VARCHAR) AS id_fnet, ' ' || p_type || ' ' AS rotulo, p_partkey FROM part)"


def domains(spark, d):
    return D.read(spark, d, "part").select(F.col("p_brand").alias("grupo"), F.col("p_size").cast("string").alias("id_fnet"), F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("rotulo"))


@query(f"SELECT grupo, id_fnet FROM {DOMAINS} WHERE grupo ILIKE '%brand#1%' AND trim(rotulo) ILIKE 'economy' ORDER BY grupo, id_fnet LIMIT 1")
def domain_id(spark, d):
    return prospect.domain_id(domains(spark, d), "Brand#1", "Écônomy").select("grupo", "id_fnet")


@query(f"SELECT grupo, CASE WHEN p_partkey % 3 = 0 THEN id_fnet WHEN p_partkey % 3 = 1 THEN id_fnet END AS id_fnet FROM {DOMAINS} WHERE p_partkey % 3 = 0 AND CAST(id_fnet AS INTEGER) <> 0")
def fund_types(spark, d):
    """Ids that are numbers other than 0; others are words, or 0."""
    value = F.element_at(F.array(F.col("p_size").cast("string"), F.lit("0"), F.concat(F.lit("x"), F.col("p_size").cast("string"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return prospect.fund_types(D.read(spark, d, "part").select(F.col("p_brand").alias("grupo"), value.alias("id_fnet")))


# Files


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS cnpj, c_name || ' é; \"x\"' AS denominacao, 'FII' AS tipo_veiculo, CASE WHEN c_acctbal >= 0 THEN 'EM FUNCIONAMENTO NORMAL' ELSE 'CANCELADA' END AS situacao, CAST(NULL AS VARCHAR) AS gestor FROM customer")
def csv_registry(spark, d):
    """The registry as Latin-1 files of the regulator's format, written and read back."""
    from lastro.session import shared_folder

    folder = shared_folder(spark, "registry")
    rows = D.read(spark, d, "customer").select(D.padded("c_custkey").alias("CNPJ Fundo"), F.concat("c_name", F.lit(' é; "x"')).alias("Denom. Social"), F.lit("FII").alias("TP_FUNDO"), F.expr("if(c_acctbal >= 0, 'EM FUNCIONAMENTO NORMAL', 'CANCELADA')").alias("Sit"), F.lit("  ").alias("GESTOR"))
    rows.write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').option("quote", '"').option("ignoreTrailingWhiteSpace", False).csv(folder)
    cells = csvzip.read_cells(spark, f"{folder}/part-*.csv")
    table = cells.select(*[F.col("cells")[c].alias(c) for c in ("CNPJ_FUNDO", "DENOM_SOCIAL", "TP_FUNDO", "SIT", "GESTOR")], "row_idx")
    return ingest.registry_funds(table).select("cnpj", "denominacao", "tipo_veiculo", "situacao", "gestor")


@query("SELECT count(*) AS rows, avg(CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.0 END) AS saldo, avg(CASE WHEN c_nationkey % 3 = 0 THEN 0.0 ELSE 1.0 END) AS pais FROM customer")
def fill_rates(spark, d):
    rows = D.read(spark, d, "customer").select(F.expr("if(c_acctbal >= 0, c_acctbal, null)").alias("saldo"), F.expr("if(c_nationkey % 3 = 0, '', 'x')").alias("pais"))
    return csvzip.fill_rates(rows, ["saldo", "pais"])


# Documents' metadata


@query("""SELECT doc_id AS id_fnet, CASE WHEN doc_id % 3 = 0 THEN '11222333000181' WHEN doc_id % 3 = 1 THEN lpad(CAST(doc_id AS VARCHAR), 14, '0') END AS cnpj, nullif(trim(lang), '') AS categoria, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 9 AS INTEGER) END AS versao,
DATE '2026-07-01' AS competencia, '29/07/2026 13:00' AS data_referencia, TIMESTAMP '2026-07-30 10:05:00' AS data_entrega FROM documents""")
def document_rows(spark, d):
    i = F.col("doc_id")
    record = F.struct(
        i.cast("string").alias("id"), F.when(i % 3 == 0, "FUNDO 11.222.333/0001-81 X").otherwise("SEM NUMERO").alias("descricaoFundo"), F.when(i % 3 == 1, i.cast("string")).alias("cnpjFundo"), F.concat(F.lit(" "), "lang").alias("categoriaDocumento"),
        F.lit("29/07/2026 13:00").alias("dataReferencia"), F.lit("30/07/2026 10:05").alias("dataEntrega"), F.when(i % 2 == 0, (i % 9).cast("string")).otherwise("x").alias("versao"),
    )
    raw = D.read(spark, d, "documents").select(F.to_json(record).alias("value")).unionByName(D.read(spark, d, "documents").select(F.lit('{"descricaoFundo": "sem id"}').alias("value")))
    return documents.document_rows(raw).select("id_fnet", "cnpj", "categoria", "versao", "competencia", "data_referencia", "data_entrega")


@query("SELECT c_custkey, regexp_replace(lpad(CAST(c_custkey * 7919 AS VARCHAR), 14, '0'), '^(..)(...)(...)(....)(..)$', '\\1.\\2.\\3/\\4-\\5') AS cnpj FROM customer")
def cnpj_mask(spark, d):
    return D.read(spark, d, "customer").select("c_custkey", P.cnpj_mask(P.cnpj((F.col("c_custkey") * 7919).cast("string"))).alias("cnpj"))


# Upserts, queues, cursors


def arrivals(spark, d):
    docs = D.documents(spark, d)
    changed = docs.filter("status_download <> 'baixado'").select("id_fnet", "cnpj", F.concat("categoria", F.lit("!")).alias("categoria"), "tipo", "data_entrega", "competencia")
    again = changed.withColumn("categoria", F.concat("categoria", F.lit("!")))
    new = docs.filter("status_download = 'erro'").select(F.expr("id_fnet + 10000000").alias("id_fnet"), "cnpj", "categoria", "tipo", "data_entrega", "competencia")
    return changed.withColumn("arrival", F.lit(0)).unionByName(again.withColumn("arrival", F.lit(1))).unionByName(new.withColumn("arrival", F.lit(2)))


@query(f"SELECT id_fnet, CASE WHEN status_download <> 'baixado' THEN categoria || '!!' ELSE categoria END AS categoria, status_download FROM {D.DOCUMENTS} UNION ALL SELECT id_fnet + 10000000, categoria, 'pendente' FROM {D.DOCUMENTS} WHERE status_download = 'erro'")
def sync_twice(spark, d):
    """The same arrivals a second time change nothing, and no download state is lost."""
    once = sync.apply_documents(D.documents(spark, d), arrivals(spark, d))
    return sync.apply_documents(once, arrivals(spark, d)).select("id_fnet", "categoria", "status_download")


@query(f"SELECT id_fnet, CASE WHEN status_download <> 'pendente' THEN status_download WHEN categoria = 'en' THEN 'erro' ELSE 'baixado' END AS status_download, CASE WHEN status_download = 'pendente' AND categoria <> 'en' THEN 'fnet/' || id_fnet || '.xml' END AS url_storage FROM {D.DOCUMENTS}")
def downloads(spark, d):
    docs = D.documents(spark, d).withColumns({"formato": F.lit(None).cast("string"), "baixado_em": F.lit(None).cast("timestamp_ntz")})
    url = F.when(F.col("categoria") != "en", F.concat(F.lit("fnet/"), F.col("id_fnet").cast("string"), F.lit(".xml")))
    results = sync.download_queue(docs).select("id_fnet", url.alias("url_storage"), F.lit("xml").alias("formato"), F.lit(NOW).cast("timestamp_ntz").alias("baixado_em"))
    return sync.downloaded(docs, results).select("id_fnet", "status_download", "url_storage")


@query("SELECT 'eventos' AS fonte, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS cursor FROM events")
def cursor_write(spark, d):
    rows = D.read(spark, d, "events").withColumnRenamed("ts", "data_entrega")
    return sync.new_cursor(rows, "eventos", NOW).select("fonte", "cursor")


@query(f"SELECT f.cnpj, coalesce(s.denominacao, f.denominacao) AS denominacao, CASE WHEN s.cnpj IS NULL THEN situacao END AS situacao, tipo_veiculo FROM {D.FUNDS} f FULL JOIN {SUPPLIERS} s USING (cnpj)")
def registry_upsert(spark, d):
    """Registry rows replace their columns with nulls too; what they lack stays."""
    source = suppliers(spark, d).withColumn("situacao", F.lit(None).cast("string"))
    return upsert.upsert(D.funds(spark, d).select("cnpj", "denominacao", "situacao", "tipo_veiculo"), source, ["cnpj"])


@query(f"WITH n AS (SELECT cnpj, competencia, CAST(pl * 2 AS DECIMAL(20,2)) AS pl, CAST(NULL AS INTEGER) AS num_cotistas FROM {D.REPORTS} WHERE num_cotistas > 500) SELECT cnpj, competencia, CASE WHEN n.cnpj IS NOT NULL THEN n.pl ELSE r.pl END AS pl, CASE WHEN n.cnpj IS NULL THEN r.num_cotistas END AS num_cotistas FROM {D.REPORTS} r LEFT JOIN n USING (cnpj, competencia)")
def report_upsert(spark, d):
    reports = D.reports(spark, d)
    source = reports.filter("num_cotistas > 500").select("cnpj", "competencia", (F.col("pl") * 2).cast("decimal(20,2)").alias("pl"), F.lit(None).cast("int").alias("num_cotistas"))
    return upsert.upsert(reports, source, ["cnpj", "competencia"])


@query(f"SELECT grupo, id_fnet, max(rotulo) AS rotulo FROM {DOMAINS} GROUP BY grupo, id_fnet")
def domain_upsert(spark, d):
    new = domains(spark, d).groupBy("grupo", "id_fnet").agg(F.max("rotulo").alias("rotulo"))
    old = new.filter("grupo > 'Brand#2'").withColumn("rotulo", F.lit("velho"))
    return upsert.upsert(old, new, ["grupo", "id_fnet"])


@query(f"SELECT id_fnet, texto_norm, CAST(len(texto) AS INTEGER) AS num_caracteres FROM {D.TEXTS} JOIN {D.DOCUMENTS} USING (id_fnet) WHERE status_download = 'baixado' AND origem = 'vazio' UNION ALL SELECT id_fnet, texto_norm, 0 FROM {D.TEXTS} WHERE origem <> 'vazio'")
def extraction_upsert(spark, d):
    """Texts of the recognition queue join those that are there."""
    texts = D.texts(spark, d)
    queue = sync.extraction_queue(D.documents(spark, d), texts, ocr=True).select("id_fnet")
    fresh = documents.texts(texts.join(queue, "id_fnet", "left_semi").select("id_fnet", F.col("texto").cast("binary").alias("content"), F.lit("xml").alias("formato")))
    old = texts.filter("origem <> 'vazio'").select("id_fnet", "texto_norm", F.lit(0).alias("num_caracteres"))
    return upsert.upsert(old, fresh.select("id_fnet", "texto_norm", "num_caracteres"), ["id_fnet"])


# Checks

AGE = "floor(epoch(TIMESTAMP '2024-06-01 12:00:00' - {}) / 86400)"
HOURS = "epoch(TIMESTAMP '2024-06-01 12:00:00' - iniciado_em) / 3600"
RUN_CHECKS = f"""(SELECT CASE WHEN status IN ('erro', 'executando') THEN 'execucao:' ELSE 'frescor:' END || fonte AS nome, CASE WHEN status IN ('erro', 'executando') OR dias > 9 THEN 'erro' ELSE 'ok' END AS status,
CASE WHEN status = 'erro' THEN 'última execução falhou: None' WHEN status = 'executando' THEN 'execução iniciada há ' || CAST(round_even({HOURS}, 0) AS INTEGER) || 'h sem conclusão' WHEN dias > 9 THEN 'sem execução bem-sucedida há ' || dias || ' dias (limite 9)' ELSE 'última execução há ' || dias || ' dia(s)' END AS mensagem
FROM (SELECT *, CAST({AGE.format('iniciado_em')} AS INTEGER) AS dias, row_number() OVER (PARTITION BY fonte ORDER BY id DESC) AS n FROM {D.RUNS}) WHERE n = 1 AND (status <> 'executando' OR {HOURS} > 6))"""
DATA_CHECKS = f"""(WITH x AS (SELECT (SELECT max(competencia) FROM {D.REPORTS}) AS mes, (SELECT max(data_entrega) FROM {D.DOCUMENTS}) AS entrega, (SELECT count(*) FROM {D.DOCUMENTS} WHERE status_download = 'erro') AS erros, (SELECT count(*) FROM {D.TEXTS} WHERE origem = 'vazio') AS fila),
y AS (SELECT *, (2024 - year(mes)) * 12 + 6 - month(mes) AS atraso, CAST({AGE.format('entrega')} AS INTEGER) AS dias FROM x)
SELECT 'informes' AS nome, CASE WHEN atraso > 4 THEN 'erro' ELSE 'ok' END AS status, CASE WHEN atraso > 4 THEN 'informe mais recente é de ' || strftime(mes, '%Y-%m') || ' (' || atraso || ' meses atrás)' ELSE 'competência mais recente: ' || strftime(mes, '%Y-%m') END AS mensagem FROM y
UNION ALL SELECT 'documentos', CASE WHEN dias > 7 THEN 'aviso' ELSE 'ok' END, 'documento mais recente entregue há ' || dias || CASE WHEN dias > 7 THEN ' dias — backfill em andamento ou sync do FNET defasado' ELSE ' dia(s)' END FROM y
UNION ALL SELECT 'downloads', 'aviso', erros || ' documentos com erro de download' FROM y WHERE erros > 50 UNION ALL SELECT 'ocr', 'aviso', fila || ' documentos sem camada de texto (fila de OCR)' FROM y WHERE fila > 0)"""
CHECKS = f"(SELECT * FROM {RUN_CHECKS} UNION ALL SELECT * FROM {DATA_CHECKS})"


@query(f"SELECT * FROM {CHECKS}")
def diagnosis(spark, d):
    return health.diagnose(D.runs(spark, d), D.funds(spark, d), D.reports(spark, d), D.documents(spark, d), D.texts(spark, d), NOW)


@query(f"SELECT CASE max(CASE status WHEN 'erro' THEN 2 WHEN 'aviso' THEN 1 ELSE 0 END) WHEN 2 THEN 'erro' WHEN 1 THEN 'aviso' ELSE 'ok' END AS status FROM {CHECKS}")
def worst_status(spark, d):
    return health.worst(diagnosis(spark, d))


@query(f"SELECT 'execucoes' AS nome, 'erro' AS status, 'nenhuma execução de ingestão registrada' AS mensagem UNION ALL SELECT * FROM {DATA_CHECKS}")
def diagnosis_without_runs(spark, d):
    none = D.runs(spark, d).filter(F.col("iniciado_em") < F.lit(dt.datetime(1900, 1, 1)).cast("timestamp_ntz"))
    return health.diagnose(none, D.funds(spark, d), D.reports(spark, d), D.documents(spark, d), D.texts(spark, d), NOW)
