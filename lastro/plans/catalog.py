"""Registered queries over the benchmark tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.functions import parsing as P
from lastro.functions import text as T
from lastro.operators import classify, export, health, ingest, prospect, search, upsert
from lastro.operators import metrics as M
from lastro.plans import driver_tables as D
from lastro.sources.html import select_options
from lastro.streaming import sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = dt.datetime(2024, 6, 1, 12, 0, 0)
LANGS = ("en", "fr", "de", "es")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def bounded(core: str) -> str:
    """A term's pattern for an engine without look-around."""
    return f"(^|[^0-9a-z]){core}($|[^0-9a-z])"


CONNECTOR = "(?:" + "|".join(T.CONNECTORS) + ")"
ANY_THE, FLEXIBLE = bounded("thes?"), bounded(f"{CONNECTOR}[^0-9a-z]*las?")


# Text


@query("SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def fold_text(spark, d):
    return D.read(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(f"SELECT id_fnet FROM {D.TEXTS} WHERE regexp_matches(texto_norm, '{FLEXIBLE}')")
def term_match_flexible(spark, d):
    return D.texts(spark, d).filter(T.has_term(F.col("texto_norm"), "de la")).select("id_fnet")


@query(f"SELECT id_fnet FROM {D.TEXTS} WHERE regexp_matches(texto_norm, '{bounded('license[^0-9a-z]*terms')}') OR regexp_matches(texto_norm, '{bounded('the')}')")
def term_match_literal(spark, d):
    return D.texts(spark, d).filter(T.has_terms(F.col("texto_norm"), ["license terms", "the"], flexible=False)).select("id_fnet")


@query(f"SELECT id_fnet FROM {D.TEXTS} WHERE regexp_matches(texto_norm, '{bounded('licenses?')}') OR regexp_matches(texto_norm, '{bounded('permissions?')}')")
def terms_any(spark, d):
    return D.texts(spark, d).filter(T.has_terms(F.col("texto_norm"), ["license", "permission"])).select("id_fnet")


@query(f"SELECT id_fnet FROM {D.TEXTS} WHERE regexp_matches(texto_norm, '{ANY_THE}') AND regexp_matches(texto_norm, '{bounded('ofs?')}')")
def terms_all(spark, d):
    return D.texts(spark, d).filter(T.has_terms(F.col("texto_norm"), ["the", "of"], every=True)).select("id_fnet")


@query(f"SELECT id_fnet FROM {D.TEXTS} WHERE contains(texto_norm, 'license')")
def prefilter_like(spark, d):
    return D.texts(spark, d).filter(F.contains("texto_norm", F.lit(T.prefilter_token("Licenses of the")))).select("id_fnet")


@query(f"SELECT id_fnet, CAST(len(regexp_extract_all(regexp_replace(texto_norm, '([^0-9a-z])', '\\1\\1', 'g'), '{ANY_THE}')) AS BIGINT) AS n FROM {D.TEXTS}")
def term_occurrences(spark, d):
    return D.texts(spark, d).select("id_fnet", T.count_occurrences(F.col("texto_norm"), T.term_pattern("the")).cast("bigint").alias("n"))


@query(f"""SELECT id_fnet, CAST(strpos(texto_norm, 'license') - 1 AS INTEGER) AS inicio, regexp_matches(regexp_replace(substr(texto_norm, greatest(strpos(texto_norm, 'license') - 120, 1), least(strpos(texto_norm, 'license') - 1, 120)), '\\s+', ' ', 'g'), '{"|".join(T.PROHIBITIONS)}') AS possivel_vedacao FROM {D.TEXTS} WHERE contains(texto_norm, 'license')""")
def prohibition_flag(spark, d):
    rows = D.texts(spark, d).filter("contains(texto_norm, 'license')").withColumn("inicio", F.instr("texto_norm", "license") - 1)
    return rows.select("id_fnet", "inicio", T.prohibited(F.col("texto_norm"), F.col("inicio")).alias("possivel_vedacao"))


# Search


@query(f"SELECT id_fnet, cnpj, categoria FROM (SELECT *, row_number() OVER (PARTITION BY cnpj, categoria ORDER BY data_entrega DESC NULLS LAST, id_fnet DESC) AS n FROM {D.DOCUMENTS} WHERE cnpj IS NOT NULL AND categoria IS NOT NULL) WHERE n = 1")
def current_document(spark, d):
    return search.in_force(D.documents(spark, d)).select("id_fnet", "cnpj", "categoria")


FUND_FILTERS = search.Filters(tipos_veiculo=("FII", "FIDC"), situacao="em funcionamento normal", publico_alvo=("build", "auto"), pl_min=50000, cotistas_max=900)
FUND_WHERE = "tipo_veiculo IN ('FII', 'FIDC') AND lower(situacao) = 'em funcionamento normal' AND (lower(publico_alvo) LIKE '%build%' OR lower(publico_alvo) LIKE '%auto%') AND pl_medio_12m >= 50000 AND cotistas_atual <= 900"


@query(f"SELECT f.cnpj, tipo_veiculo, pl_medio_12m, cotistas_atual FROM {D.FUNDS} f LEFT JOIN {D.METRICS} m USING (cnpj) WHERE {FUND_WHERE}")
def fund_filter_search(spark, d):
    return search.funds_with_metrics(D.funds(spark, d), D.metrics(spark, d), FUND_FILTERS).select("cnpj", "tipo_veiculo", "pl_medio_12m", "cotistas_atual")


@query(f"SELECT f.cnpj, denominacao, pl_medio_12m FROM {D.FUNDS} f LEFT JOIN {D.METRICS} m USING (cnpj) ORDER BY pl_medio_12m DESC NULLS LAST, cnpj LIMIT 50 OFFSET 20")
def fund_search_page(spark, d):
    return search.search_funds(D.funds(spark, d), D.metrics(spark, d), search.Filters(offset=20)).select("cnpj", "denominacao", "pl_medio_12m")


TEXT_FILTERS = search.Filters(termos=("the",), categorias_documento=LANGS, literal=True)
CURRENT = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cnpj, categoria ORDER BY data_entrega DESC NULLS LAST, id_fnet DESC) AS n FROM {D.DOCUMENTS} WHERE categoria IN ('en','fr','de','es')) WHERE n = 1)"
FOUND = f"{D.FUNDS} f JOIN {CURRENT} c USING (cnpj) JOIN {D.TEXTS} t USING (id_fnet) LEFT JOIN {D.METRICS} m USING (cnpj) WHERE regexp_matches(texto_norm, '{bounded('the')}')"


@query(f"SELECT cnpj, any_value(pl_medio_12m) AS pl_medio_12m, count(*) AS n_documentos, max(id_fnet) AS maior_id FROM {FOUND} GROUP BY cnpj")
def fund_text_search(spark, d):
    out = search.search_text(D.funds(spark, d), D.metrics(spark, d), D.documents(spark, d), D.texts(spark, d), TEXT_FILTERS)
    return out.select("cnpj", "pl_medio_12m", F.size("documentos").cast("bigint").alias("n_documentos"), F.array_max(F.transform("documentos", lambda x: x["id_fnet"])).alias("maior_id"))


@query(f"SELECT count(DISTINCT cnpj) AS total FROM {FOUND}")
def count_distinct_funds(spark, d):
    return search.totals(search.search_text(D.funds(spark, d), D.metrics(spark, d), D.documents(spark, d), D.texts(spark, d), TEXT_FILTERS))


@query(f"SELECT DISTINCT publico_alvo FROM {D.FUNDS} WHERE publico_alvo IS NOT NULL")
def domain_values(spark, d):
    return search.domain_values(D.funds(spark, d), "publico_alvo")


@query(f"SELECT categoria, count(*) AS n FROM {D.DOCUMENTS} WHERE categoria IS NOT NULL GROUP BY categoria")
def category_counts(spark, d):
    return search.category_counts(D.documents(spark, d))


@query(f"SELECT d.id_fnet, t.id_fnet IS NOT NULL AS tem_texto FROM {D.DOCUMENTS} d LEFT JOIN (SELECT * FROM {D.TEXTS} WHERE origem <> 'vazio') t ON d.id_fnet = t.id_fnet WHERE cnpj = '00000000000007'")
def fund_page(spark, d):
    return search.fund_page(D.documents(spark, d), D.texts(spark, d).filter("origem <> 'vazio'"), "00000000000007").select("id_fnet", "tem_texto")


# Metrics


@query(f"SELECT cnpj, competencia_ultima, pl_atual, pl_medio_12m, cotistas_atual FROM {D.METRICS}")
def metrics_12(spark, d):
    return D.metrics(spark, d)


@query(f"SELECT cnpj, competencia, {D.half_even('total', 'nullif(n, 0)')} AS pl_medio_12m FROM (SELECT *, sum(pl) OVER w AS total, count(pl) OVER w AS n FROM {D.REPORTS} WINDOW w AS (PARTITION BY cnpj ORDER BY competencia ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))")
def trailing_mean(spark, d):
    return M.trailing_mean(D.reports(spark, d)).select("cnpj", "competencia", "pl_medio_12m")


# Which row wins


@query(f"SELECT cnpj, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY upper(situacao) = 'EM FUNCIONAMENTO NORMAL' DESC, dt_registro DESC NULLS LAST, row_idx) AS n FROM {D.REGISTRY_ROWS}) WHERE n = 1")
def dedupe_registry(spark, d):
    return ingest.dedupe_registry(D.registry_rows(spark, d)).select("cnpj", "row_idx")


@query(f"SELECT cnpj, coalesce(min(row_idx) FILTER (contains(lower(situacao), 'funcionamento')), max(row_idx)) AS row_idx FROM {D.REGISTRY_ROWS} GROUP BY cnpj")
def dedupe_lookup(spark, d):
    return ingest.dedupe_lookup(D.registry_rows(spark, d)).select("cnpj", "row_idx")


RUNNING = f"(SELECT *, versao IS NULL OR versao >= coalesce(max(versao) OVER (PARTITION BY cnpj, competencia, run ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM (SELECT *, sum(CASE WHEN versao IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY cnpj, competencia ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM {D.REGISTRY_ROWS}))"


@query(f"SELECT cnpj, competencia, arg_max_null(versao, row_idx) AS versao FROM {RUNNING} WHERE accepted GROUP BY cnpj, competencia")
def version_wins(spark, d):
    return ingest.fii_versions(D.registry_rows(spark, d))


@query(f"SELECT cnpj, publico_alvo FROM (SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY competencia DESC, row_idx DESC) AS n FROM {RUNNING} WHERE accepted) WHERE n = 1")
def fund_attributes(spark, d):
    rows = D.registry_rows(spark, d).withColumns({"segmento": F.lit(None).cast("string"), "denominacao": F.lit(None).cast("string")})
    return ingest.fii_attributes(rows).select("cnpj", "publico_alvo")


@query(f"SELECT cnpj, competencia, arg_max_null(pl, row_idx) AS pl FROM {D.REGISTRY_ROWS} GROUP BY cnpj, competencia")
def measure_last_wins(spark, d):
    return ingest.last_wins(D.registry_rows(spark, d), "pl")


@query(f"SELECT cnpj, competencia, arg_min(pl, row_idx) FILTER (pl IS NOT NULL) AS pl FROM {D.REGISTRY_ROWS} GROUP BY cnpj, competencia")
def measure_fill(spark, d):
    return ingest.first_known(D.registry_rows(spark, d), "pl")


PER_FILE = f"(SELECT cnpj, competencia, file_idx, priority, CASE WHEN any_value(has_class) THEN sum(pl) ELSE arg_max(pl, row_idx) END AS pl FROM {D.CLASS_ROWS} WHERE pl IS NOT NULL GROUP BY ALL)"


@query(f"SELECT cnpj, competencia, file_idx, CAST(pl AS DECIMAL(20,2)) AS pl FROM {PER_FILE}")
def class_sum_vs_last(spark, d):
    rows = D.class_rows(spark, d)
    out = ingest.class_values(rows.withColumns({"competencia": F.concat_ws("|", F.col("competencia").cast("string"), F.col("file_idx").cast("string"))}), {"pl": "priority"})
    parts = F.split("competencia", r"\|")
    return out.select("cnpj", parts[0].cast("date").alias("competencia"), parts[1].cast("int").alias("file_idx"), F.col("pl").cast("decimal(20,2)").alias("pl"))


@query(f"SELECT cnpj, competencia, CAST(arg_min(pl, priority * 100 + file_idx) AS DECIMAL(20,2)) AS pl FROM {PER_FILE} GROUP BY cnpj, competencia")
def priority_pick(spark, d):
    return ingest.class_values(D.class_rows(spark, d), {"pl": "priority"}).select("cnpj", "competencia", F.col("pl").cast("decimal(20,2)").alias("pl"))


SUPPLIERS = "(SELECT lpad(CAST(s_suppkey * 3 AS VARCHAR), 14, '0') AS cnpj, s_name AS denominacao FROM supplier)"


def suppliers(spark, d):
    return D.read(spark, d, "supplier").select(F.expr("lpad(cast(s_suppkey * 3 as string), 14, '0')").alias("cnpj"), F.col("s_name").alias("denominacao"))


@query(f"SELECT cnpj, denominacao, 'registro' AS fonte FROM {SUPPLIERS} UNION ALL SELECT cnpj, denominacao, 'cad_fi' FROM {D.FUNDS} WHERE cnpj NOT IN (SELECT cnpj FROM {SUPPLIERS})")
def override_union(spark, d):
    return ingest.universe(suppliers(spark, d), D.funds(spark, d).select("cnpj", "denominacao"))


@query(f"SELECT cnpj, denominacao FROM {SUPPLIERS} UNION ALL SELECT DISTINCT cnpj, NULL FROM {D.DOCUMENTS} WHERE cnpj NOT IN (SELECT cnpj FROM {SUPPLIERS})")
def missing_parents(spark, d):
    return upsert.with_parents(suppliers(spark, d), D.documents(spark, d))


@query(f"SELECT cnpj, coalesce(s.denominacao, f.denominacao) AS denominacao, f.tipo_veiculo FROM {D.FUNDS} f FULL JOIN {SUPPLIERS} s USING (cnpj)")
def upsert_protected(spark, d):
    target = D.funds(spark, d).select("cnpj", "denominacao", "tipo_veiculo")
    return upsert.upsert(target, suppliers(spark, d), ["cnpj"], ["denominacao"])


@query(f"SELECT f.cnpj, coalesce(nullif(s.denominacao, ''), f.denominacao) AS denominacao, CASE WHEN s.cnpj IS NOT NULL THEN coalesce(nullif(tipo, ''), 'FIDC') ELSE tipo END AS tipo_veiculo FROM (SELECT cnpj, denominacao, CASE WHEN tipo_veiculo <> 'FII' THEN tipo_veiculo END AS tipo FROM {D.FUNDS}) f LEFT JOIN {SUPPLIERS} s ON f.cnpj = s.cnpj")
def enrich_nonnull(spark, d):
    target = D.funds(spark, d).select("cnpj", "denominacao", F.expr("nullif(tipo_veiculo, 'FII')").alias("tipo_veiculo"))
    return upsert.enrich(target, suppliers(spark, d), "cnpj", {"tipo_veiculo": F.lit("FIDC")})


@query(f"SELECT publico_alvo, count(*) AS n FROM {D.REGISTRY_ROWS} GROUP BY publico_alvo ORDER BY n DESC, min(row_idx) LIMIT 15")
def common_types(spark, d):
    return classify.common_types(D.registry_rows(spark, d), "publico_alvo")


# Queues and sync


@query(f"SELECT id_fnet FROM {D.DOCUMENTS} WHERE status_download = 'baixado' AND id_fnet NOT IN (SELECT id_fnet FROM {D.TEXTS} WHERE origem <> 'vazio')")
def extract_queue(spark, d):
    return sync.extraction_queue(D.documents(spark, d), D.texts(spark, d).filter("origem <> 'vazio'")).select("id_fnet")


@query(f"SELECT d.id_fnet FROM {D.DOCUMENTS} d JOIN {D.TEXTS} t USING (id_fnet) WHERE status_download = 'baixado' AND origem = 'vazio'")
def ocr_queue(spark, d):
    return sync.extraction_queue(D.documents(spark, d), D.texts(spark, d), ocr=True).select("id_fnet")


@query(f"SELECT id_fnet FROM {D.DOCUMENTS} WHERE status_download = 'pendente' ORDER BY data_entrega DESC NULLS LAST, id_fnet DESC LIMIT 25")
def download_queue(spark, d):
    return sync.download_queue(D.documents(spark, d), 25).select("id_fnet")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE event_type = 'purchase')")
def incremental_overlap(spark, d):
    events = D.read(spark, d, "events")
    cursor = events.filter("event_type = 'purchase'").agg(F.max("ts").alias("m")).first().m
    return sync.since(events, cursor, "ts").select("event_id")


@query("SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY user_id")
def last_arrivals(spark, d):
    events = D.read(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("arrival"))
    return sync.last_arrivals(events, "user_id").select("user_id", "event_id")


@query(f"SELECT cnpj, arg_min(id_fnet, id_fnet) AS id_fnet FROM {D.DOCUMENTS} d GROUP BY cnpj HAVING NOT coalesce(bool_or(cnpj IN (SELECT cnpj FROM {D.FUNDS} WHERE situacao = 'CANCELADA')), false)")
def first_seen_gate(spark, d):
    docs = D.documents(spark, d).withColumn("arrival", F.col("id_fnet"))
    return prospect.eligible(docs, D.funds(spark, d)).select("cnpj", "id_fnet")


# Health


@query(f"SELECT fonte, max(id) AS id FROM {D.RUNS} GROUP BY fonte")
def latest_run(spark, d):
    return health.latest_runs(D.runs(spark, d)).select("fonte", "id")


@query(f"SELECT (SELECT count(*) FROM {D.FUNDS}) AS fundos, (SELECT count(*) FROM {D.REPORTS}) AS informes, (SELECT count(*) FROM {D.DOCUMENTS}) AS documentos, (SELECT count(*) FROM {D.DOCUMENTS} WHERE status_download = 'pendente') AS downloads_pendentes, (SELECT count(*) FROM {D.DOCUMENTS} WHERE status_download = 'erro') AS downloads_com_erro, (SELECT count(*) FROM {D.TEXTS}) AS textos, (SELECT count(*) FROM {D.TEXTS} WHERE origem = 'vazio') AS fila_ocr, (SELECT max(competencia) FROM {D.REPORTS}) AS ultima_competencia, (SELECT max(data_entrega) FROM {D.DOCUMENTS}) AS ultima_entrega")
def health_counts(spark, d):
    return health.counts(D.funds(spark, d), D.reports(spark, d), D.documents(spark, d), D.texts(spark, d))


@query(f"SELECT CASE WHEN status IN ('erro', 'executando') THEN 'execucao:' ELSE 'frescor:' END || fonte AS nome, CASE WHEN status IN ('erro', 'executando') OR floor(epoch(TIMESTAMP '2024-06-01 12:00:00' - iniciado_em) / 86400) > 9 THEN 'erro' ELSE 'ok' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY fonte ORDER BY id DESC) AS n FROM {D.RUNS}) WHERE n = 1 AND (status <> 'executando' OR epoch(TIMESTAMP '2024-06-01 12:00:00' - iniciado_em) / 3600 > 6)")
def freshness_checks(spark, d):
    return health.run_checks(D.runs(spark, d), NOW).select("nome", "status")


# Parsing


@query("SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 14, '0') AS cnpj FROM customer")
def parse_cnpj(spark, d):
    raw = F.concat(F.lit("CNPJ "), F.regexp_replace((F.col("c_custkey") * 7919).cast("string"), r"(\d)(\d{3})$", "$1.$2"), F.lit(" "))
    return D.read(spark, d, "customer").select("c_custkey", P.cnpj(raw).alias("cnpj"))


def _check_sql(n: int, digits: str) -> str:
    total = " + ".join(f"CAST(substr({digits}, {i + 1}, 1) AS INTEGER) * {(n - 1 - i) % 8 + 2}" for i in range(n))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


@query(f"WITH a AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') AS b FROM customer), e AS (SELECT *, b || CASE WHEN c_custkey % 2 = 0 THEN CAST({_check_sql(12, 'b')} AS VARCHAR) ELSE '5' END AS g FROM a), h AS (SELECT *, g || CAST({_check_sql(13, 'g')} AS VARCHAR) AS k FROM e) SELECT c_custkey, CAST({_check_sql(12, 'k')} AS VARCHAR) = substr(k, 13, 1) AND k <> repeat(substr(k, 1, 1), 14) AS valido FROM h")
def cnpj_check_digits(spark, d):
    rows = D.read(spark, d, "customer").select("c_custkey", F.expr("lpad(cast(c_custkey * 7919 as string), 12, '0')").alias("b"))

    def with_digit(df, column, n):
        digits = [F.substring(column, i + 1, 1).cast("int") * ((n - 1 - i) % 8 + 2) for i in range(n)]
        rest = sum(digits[1:], digits[0]) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest).cast("string")

    rows = rows.withColumn("g", F.concat("b", F.when(F.col("c_custkey") % 2 == 0, with_digit(rows, "b", 12)).otherwise("5")))
    rows = rows.withColumn("k", F.concat("g", with_digit(rows, "g", 13)))
    return rows.select("c_custkey", P.cnpj_valid(F.col("k")).alias("valido"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) AS valor, CAST(trunc(CAST(o_totalprice AS DECIMAL(20,2))) AS INTEGER) AS inteiro FROM orders")
def parse_decimal_br(spark, d):
    text = F.translate(F.format_number(F.col("o_totalprice").cast("decimal(20,2)"), 2), ",.", ".,")
    return D.read(spark, d, "orders").select("o_orderkey", P.decimal(text).alias("valor"), P.integer(text).alias("inteiro"))


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS iso, CAST(date_trunc('month', o_orderdate) AS DATE) AS curta, CAST(date_trunc('month', o_orderdate) AS DATE) AS referencia, CAST(NULL AS DATE) AS invalida FROM orders")
def parse_competencia(spark, d):
    day = F.col("o_orderdate")
    return D.read(spark, d, "orders").select("o_orderkey", P.month(F.date_format(day, "yyyy-MM-dd")).alias("iso"), P.month(F.date_format(day, "MM/yyyy")).alias("curta"), P.reference_month(F.date_format(day, "dd/MM/yyyy HH:mm")).alias("referencia"), P.month(F.lit("2024-13")).alias("invalida"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS barra, CAST(date_trunc('minute', o_orderdate) AS TIMESTAMP) AS entrega FROM orders")
def parse_dates(spark, d):
    day = F.col("o_orderdate")
    return D.read(spark, d, "orders").select("o_orderkey", P.date(F.date_format(day, "yyyy-MM-dd")).alias("iso"), P.date(F.date_format(day, "d/M/yyyy")).alias("barra"), P.delivered(F.date_format(day, "dd/MM/yyyy HH:mm")).alias("entrega"))


@query("SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN 'FIDC' WHEN 1 THEN 'FII' WHEN 2 THEN 'FIP' WHEN 3 THEN 'FIF' WHEN 4 THEN 'FIAGRO' END AS tipo FROM customer")
def map_vehicle_type(spark, d):
    kind = F.expr("element_at(array('fidc np', ' FII-x', 'FMIEE', 'FICFI', 'FII', ' '), c_nationkey % 6 + 1)")
    name = F.expr("if(c_nationkey % 6 = 4, 'Fiagro X', 'X')")
    return D.read(spark, d, "customer").select("c_custkey", P.vehicle_type(kind, name).alias("tipo"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '^\\s*<\\?xml') THEN 'xml' WHEN regexp_matches(html, '^\\s*<') THEN 'html' WHEN regexp_matches(html, '^\\s*\\{') THEN 'json' ELSE 'bin' END AS formato FROM pages")
def detect_format(spark, d):
    return D.read(spark, d, "pages").select("page_id", P.detect_format(F.col("html").cast("binary")).alias("formato"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '^\\s*[<{]') THEN html ELSE base64(encode(html)) END AS conteudo FROM pages")
def base64_decode(spark, d):
    return D.read(spark, d, "pages").select("page_id", P.maybe_base64(F.base64(F.col("html").cast("binary")).cast("binary")).cast("string").alias("conteudo"))


@query("SELECT o_custkey, unnest(list_transform(generate_series(CAST(date_trunc('month', min(o_orderdate)) AS DATE), CAST(date_trunc('month', max(o_orderdate)) AS DATE), INTERVAL 1 MONTH), lambda x: strftime(x, '%Y%m'))) AS mes FROM orders GROUP BY o_custkey")
def month_sequence(spark, d):
    spans = D.read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.select("o_custkey", F.explode(P.months_between(F.to_date("a"), F.to_date("b"))).alias("mes"))


# Forms


@query("SELECT page_id, 'tipo' AS grupo, CAST(page_id AS VARCHAR) AS id_fnet, 'Fundo ' || page_id AS rotulo FROM pages UNION ALL SELECT page_id, 'classe', '', 'Todas' FROM pages")
def html_select_udtf(spark, d):
    form = F.concat(F.lit("<select id='tipo' name='x'><option value='0'> </option><option value='"), "page_id", F.lit("'> Fundo <b>"), "page_id", F.lit("</b></option></select><SELECT name=classe><option>Todas</option></SELECT>"))
    return select_options(D.read(spark, d, "pages").withColumn("html", F.concat(form, "html")), "html", "page_id")
