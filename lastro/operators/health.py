"""Freshness checks over the run log and the tables."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days without a run by group of sources, hours of a run, months of reports, days of documents, failed downloads (fixed values).
RUN_DAYS, STUCK_HOURS, REPORT_MONTHS, DOCUMENT_DAYS, DOWNLOAD_ERRORS = {"cvm": 9, "fnet": 3}, 6, 4, 7, 50
ORDER = ("ok", "aviso", "erro")
ERROR_CHARS = 4000


def limit_days(group: str) -> int:
    """The group's limit; MONITOR_MAX_DIAS_<GROUP> overrides it if it is digits alone."""
    given = os.environ.get(f"MONITOR_MAX_DIAS_{group.upper()}", "")
    return int(given) if given.isdigit() else RUN_DAYS[group]


def latest_runs(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("fonte").orderBy(F.col("id").desc())
    return runs.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def elapsed_days(since: Column, now: Column) -> Column:
    """Whole periods of 24 hours, not calendar days."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 86_400_000_000).cast("int")


def counts(funds: DataFrame, reports: DataFrame, documents: DataFrame, texts: DataFrame) -> DataFrame:
    """One row of totals; one pass over each table."""
    d = documents.agg(F.count(F.lit(1)).alias("documentos"), F.count_if(F.col("status_download") == "pendente").alias("downloads_pendentes"), F.count_if(F.col("status_download") == "erro").alias("downloads_com_erro"), F.max("data_entrega").alias("ultima_entrega"))
    t = texts.agg(F.count(F.lit(1)).alias("textos"), F.count_if(F.col("origem") == "vazio").alias("fila_ocr"))
    f, r = funds.agg(F.count(F.lit(1)).alias("fundos")), reports.agg(F.count(F.lit(1)).alias("informes"), F.max("competencia").alias("ultima_competencia"))
    return f.crossJoin(r).crossJoin(d).crossJoin(t)  # one row each


# The names, levels and messages of the checks below are what readers of the reports go by.


def run_checks(runs: DataFrame, now: dt.datetime) -> DataFrame:
    """nome, status, mensagem for each source's latest run; a run under way for a few hours has no row."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = latest_runs(runs)
    hours = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("iniciado_em").cast("timestamp"))) / 3_600_000_000
    days = elapsed_days(F.coalesce("terminado_em", "iniciado_em"), at)
    most = F.when(F.startswith("fonte", F.lit("fnet")), limit_days("fnet")).otherwise(limit_days("cvm"))
    running, failed = F.col("status") == "executando", F.col("status") == "erro"
    rows = rows.filter(~running | (hours > STUCK_HOURS)).withColumns({"horas": F.bround(hours, 0).cast("int"), "dias": days, "limite": most})
    late = F.col("dias") > F.col("limite")
    name = F.concat(F.when(running | failed, "execucao:").otherwise("frescor:"), F.col("fonte"))
    said = (
        F.when(failed, F.concat(F.lit("última execução falhou: "), F.coalesce("erro", F.lit("None"))))
        .when(running, F.concat(F.lit("execução iniciada há "), F.col("horas").cast("string"), F.lit("h sem conclusão")))
        .when(late, F.format_string("sem execução bem-sucedida há %d dias (limite %d)", "dias", "limite"))
        .otherwise(F.format_string("última execução há %d dia(s)", "dias"))
    )
    return rows.select(name.alias("nome"), F.when(failed | running | late, "erro").otherwise("ok").alias("status"), said.alias("mensagem"))


def data_checks(totals: DataFrame, now: dt.datetime) -> DataFrame:
    """nome, status, mensagem about reports, documents, downloads and the recognition queue."""
    at = F.lit(now).cast("timestamp_ntz")
    month = F.col("ultima_competencia")
    behind = (F.year(at) - F.year(month)) * 12 + F.month(at) - F.month(month)
    days = elapsed_days(F.col("ultima_entrega"), at)
    label = F.date_format(month, "yyyy-MM")

    def check(name: str, when: Column, status: Column, said: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("nome"), status.alias("status"), said.alias("mensagem")))

    late, old = behind > REPORT_MONTHS, days > DOCUMENT_DAYS
    checks = F.array_compact(F.array(
        check("informes", F.lit(True), F.when(month.isNull() | late, "erro").otherwise("ok"), F.when(month.isNull(), "nenhum informe mensal carregado").when(late, F.concat(F.lit("informe mais recente é de "), label, F.lit(" ("), behind.cast("string"), F.lit(" meses atrás)"))).otherwise(F.concat(F.lit("competência mais recente: "), label))),
        check("documentos", F.col("ultima_entrega").isNotNull(), F.when(old, "aviso").otherwise("ok"), F.concat(F.lit("documento mais recente entregue há "), days.cast("string"), F.when(old, " dias — backfill em andamento ou sync do FNET defasado").otherwise(" dia(s)"))),
        check("downloads", F.col("downloads_com_erro") > DOWNLOAD_ERRORS, F.lit("aviso"), F.concat(F.col("downloads_com_erro").cast("string"), F.lit(" documentos com erro de download"))),
        check("ocr", F.col("fila_ocr") > 0, F.lit("aviso"), F.concat(F.col("fila_ocr").cast("string"), F.lit(" documentos sem camada de texto (fila de OCR)"))),
    ))
    return totals.select(F.inline(checks))


def diagnose(runs: DataFrame, funds: DataFrame, reports: DataFrame, documents: DataFrame, texts: DataFrame, now: dt.datetime) -> DataFrame:
    """All checks."""
    none = runs.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("execucoes").alias("nome"), F.lit("erro").alias("status"), F.lit("nenhuma execução de ingestão registrada").alias("mensagem"))
    return none.unionByName(run_checks(runs, now)).unionByName(data_checks(counts(funds, reports, documents, texts), now))


def worst(checks: DataFrame) -> DataFrame:
    """One row: the worst status, ok without checks."""
    level = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    return checks.agg(F.element_at(F.array(*map(F.lit, ORDER)), F.coalesce(F.max(level), F.lit(1)).cast("int")).alias("status"))


def as_json(checks: DataFrame) -> str:
    rows = [r.asDict() for r in checks.collect()]  # a few checks
    status = max((r["status"] for r in rows), key=ORDER.index, default="ok")
    return json.dumps({"status": status, "verificacoes": rows}, ensure_ascii=False)


def as_http(checks: DataFrame, totals: DataFrame) -> tuple[int, str]:
    """The answer for a web caller, status code and body: 503 if the worst is an error, so that a monitor needs the code alone.

    totals: counts(). What can't be read at all is an error of the store.
    """
    try:
        n = totals.first()
        body = json.loads(as_json(checks)) | {"contagens": {k: n[k] for k in ("fundos", "documentos", "textos")}}
    except Exception as exc:  # noqa: BLE001  the answer says so
        body = {"status": "erro", "verificacoes": [{"nome": "banco", "status": "erro", "mensagem": str(exc).partition("\n")[0]}]}
    return (503 if body["status"] == "erro" else 200), json.dumps(body, ensure_ascii=False)


@contextlib.contextmanager
def recorded(runs: list[dict], source: str, clock=lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None), note=lambda row: None):
    """Records a run: `runs` gets a row when it begins, which is closed as ok or erro; yields a dict for its details.

    note is told the row when the run begins and when it has ended.
    """
    row = {"id": len(runs) + 1, "fonte": source, "iniciado_em": clock(), "terminado_em": None, "status": "executando", "detalhe": None, "erro": None}
    runs.append(row)
    details: dict = {}
    note(row)
    try:
        yield details
    except BaseException as exc:
        row |= {"status": "erro", "erro": f"{type(exc).__name__}: {exc}"[:ERROR_CHARS], "terminado_em": clock()}
        note(row)
        raise
    row |= {"status": "ok", "detalhe": json.dumps(details, ensure_ascii=False, default=str), "terminado_em": clock()}
    note(row)
