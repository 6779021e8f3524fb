"""The fund store's tables seen in the benchmark tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.functions.text import fold
from lastro.operators.metrics import fund_metrics
from lastro.session import importable


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(c: str):
    return F.lpad(F.col(c).cast("string"), 14, "0")


def funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        padded("c_custkey").alias("cnpj"), F.col("c_name").alias("denominacao"),
        F.expr("element_at(array('FII','FIDC','FIP','FIAGRO'), c_nationkey % 4 + 1)").alias("tipo_veiculo"), F.col("c_mktsegment").alias("publico_alvo"),
        F.expr("if(c_acctbal >= 0, 'EM FUNCIONAMENTO NORMAL', 'CANCELADA')").alias("situacao"), F.lit(None).cast("string").alias("administrador"),
        F.lit(None).cast("string").alias("gestor"), F.lit(None).cast("string").alias("segmento"),
    )


FUNDS = "(SELECT lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS cnpj, c_name AS denominacao, ['FII','FIDC','FIP','FIAGRO'][c_nationkey % 4 + 1] AS tipo_veiculo, c_mktsegment AS publico_alvo, CASE WHEN c_acctbal >= 0 THEN 'EM FUNCIONAMENTO NORMAL' ELSE 'CANCELADA' END AS situacao FROM customer)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(padded("o_custkey").alias("cnpj"), F.trunc("o_orderdate", "month").alias("competencia"), "o_orderkey", "o_totalprice")
    last = rows.groupBy("cnpj", "competencia").agg(F.max(F.struct("o_orderkey", "o_totalprice")).alias("r"))
    pl = F.when(F.col("r.o_orderkey") % 11 != 0, F.col("r.o_totalprice").cast("decimal(20,2)"))
    return last.select("cnpj", "competencia", pl.alias("pl"), F.when(F.col("r.o_orderkey") % 13 != 0, F.col("r.o_orderkey") % 1000).cast("int").alias("num_cotistas"))


REPORTS = "(SELECT cnpj, competencia, CASE WHEN k % 11 <> 0 THEN CAST(p AS DECIMAL(20,2)) END AS pl, CASE WHEN k % 13 <> 0 THEN CAST(k % 1000 AS INTEGER) END AS num_cotistas FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS cnpj, CAST(date_trunc('month', o_orderdate) AS DATE) AS competencia, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1, 2))"


def half_even(total: str, n: str) -> str:
    """A mean of cents rounded half to even, in integers."""
    q, r = f"(CAST({total} * 100 AS HUGEINT) // {n})", f"(CAST({total} * 100 AS HUGEINT) % {n})"
    return f"CAST(CAST({q} + CASE WHEN 2 * {r} > {n} OR (2 * {r} = {n} AND {q} % 2 = 1) THEN 1 ELSE 0 END AS DECIMAL(20,0)) * 0.01 AS DECIMAL(20,2))"


METRICS = f"(SELECT cnpj, max(competencia) AS competencia_ultima, arg_max(pl, competencia) FILTER (pl IS NOT NULL) AS pl_atual, {half_even('sum(CASE WHEN n <= 12 THEN pl END)', 'nullif(count(CASE WHEN n <= 12 THEN pl END), 0)')} AS pl_medio_12m, arg_max(num_cotistas, competencia) FILTER (num_cotistas IS NOT NULL) AS cotistas_atual FROM (SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY competencia DESC) AS n FROM {REPORTS}) GROUP BY cnpj)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fund_metrics(reports(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id_fnet"), F.expr("lpad(cast(doc_id % 100 as string), 14, '0')").alias("cnpj"), F.col("lang").alias("categoria"), F.col("source").alias("tipo"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(n_chars as int), 0)").alias("data_entrega"), F.expr("date'2024-01-01'").alias("competencia"), F.lit(None).cast("string").alias("url_storage"),
        F.expr("case doc_id % 5 when 0 then 'pendente' when 1 then 'erro' else 'baixado' end").alias("status_download"),
    )


DOCUMENTS = "(SELECT doc_id AS id_fnet, lpad(CAST(doc_id % 100 AS VARCHAR), 14, '0') AS cnpj, lang AS categoria, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(n_chars AS INTEGER)) AS data_entrega, CASE doc_id % 5 WHEN 0 THEN 'pendente' WHEN 1 THEN 'erro' ELSE 'baixado' END AS status_download FROM documents)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id_fnet"), F.col("text").alias("texto"), fold(F.col("text")).alias("texto_norm"), F.expr("if(n_chars < 300, 'vazio', 'xml')").alias("origem"))


TEXTS = "(SELECT doc_id AS id_fnet, text AS texto, lower(strip_accents(text)) AS texto_norm, CASE WHEN n_chars < 300 THEN 'vazio' ELSE 'xml' END AS origem FROM documents)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("case event_id % 3 when 0 then 'ok' when 1 then 'erro' else 'executando' end")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("fonte"), F.col("ts").alias("iniciado_em"), F.lit(None).cast("timestamp_ntz").alias("terminado_em"), status.alias("status"), F.lit(None).cast("string").alias("erro"))


RUNS = "(SELECT event_id AS id, event_type AS fonte, ts AS iniciado_em, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'erro' ELSE 'executando' END AS status FROM events)"


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several registry rows per fund."""
    return read(spark, sf_dir, "orders").select(
        padded("o_custkey").alias("cnpj"), F.expr("if(o_orderstatus = 'F', 'EM FUNCIONAMENTO NORMAL', 'CANCELADA')").alias("situacao"),
        F.expr("if(o_orderkey % 9 = 0, null, to_date(o_orderdate))").alias("dt_registro"), F.col("o_orderkey").alias("row_idx"), F.col("o_orderpriority").alias("publico_alvo"),
        F.expr("if(o_orderkey % 7 = 0, null, cast(o_orderkey % 5 as int))").alias("versao"), F.trunc("o_orderdate", "month").alias("competencia"), F.expr("if(o_orderkey % 4 = 0, null, cast(o_totalprice as decimal(20,2)))").alias("pl"),
    )


REGISTRY_ROWS = "(SELECT lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS cnpj, CASE WHEN o_orderstatus = 'F' THEN 'EM FUNCIONAMENTO NORMAL' ELSE 'CANCELADA' END AS situacao, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS dt_registro, o_orderkey AS row_idx, o_orderpriority AS publico_alvo, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 5 AS INTEGER) END AS versao, CAST(date_trunc('month', o_orderdate) AS DATE) AS competencia, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS pl FROM orders)"


def class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several files of an archive, some with a class column."""
    return read(spark, sf_dir, "lineitem").select(
        padded("l_suppkey").alias("cnpj"), F.trunc("l_shipdate", "month").alias("competencia"), F.col("l_linenumber").alias("file_idx"), F.expr("l_orderkey * 1000000 + l_partkey").alias("row_idx"),
        F.expr("if(l_returnflag = 'N', null, cast(l_extendedprice as decimal(20,2)))").alias("pl"), F.expr("l_linenumber % 2 = 0").alias("has_class"), F.expr("if(l_linenumber = 4, 0, 1)").alias("priority"),
    )


CLASS_ROWS = "(SELECT lpad(CAST(l_suppkey AS VARCHAR), 14, '0') AS cnpj, CAST(date_trunc('month', l_shipdate) AS DATE) AS competencia, l_linenumber AS file_idx, l_orderkey * 1000000 + l_partkey AS row_idx, CASE WHEN l_returnflag <> 'N' THEN CAST(l_extendedprice AS DECIMAL(20,2)) END AS pl, l_linenumber % 2 = 0 AS has_class, CASE WHEN l_linenumber = 4 THEN 0 ELSE 1 END AS priority FROM lineitem)"
