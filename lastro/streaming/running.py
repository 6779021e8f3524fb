"""Fund metrics kept as state: each fund's months, updated by the reports that arrive."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lastro.operators.metrics import TRAILING
from lastro.session import importable
from lastro.store import Store

METRICS = "cnpj string, competencia_ultima date, pl_atual decimal(20,2), pl_medio_12m decimal(20,2), cotistas_atual int"
#: Python's keyed state needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def metrics_of(months: dict[str, tuple[str | None, int | None]]) -> tuple:
    """competencia_ultima, pl_atual, pl_medio_12m, cotistas_atual of a fund's months (pl as text, holders)."""
    newest = sorted(months, reverse=True)
    values = [Decimal(months[m][0]) for m in newest if months[m][0] is not None]
    recent = [Decimal(months[m][0]) for m in newest[:TRAILING] if months[m][0] is not None]
    holders = next((months[m][1] for m in newest if months[m][1] is not None), None)
    mean = None
    if recent:
        with localcontext() as c:
            c.prec = 60
            mean = (sum(recent) / len(recent)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
    return dt.date.fromisoformat(newest[0]), values[0] if values else None, mean, holders


class RunningMetrics(StatefulProcessor):
    """Holds all months of a fund, so that a month that comes late, or again with another value or none, counts as in a whole run.

    They are one value, which is read and written once for a fund's arrivals of a batch, however many months it has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.months = handle.getValueState("months_text", "months string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        held = self.months.get()
        own = {m: (pl, n) for m, pl, n in json.loads(held[0])} if held else {}
        for r in sorted(rows, key=lambda r: (r.arrival, r.competencia)):
            own[r.competencia] = (r.pl, r.num_cotistas)
        self.months.update((json.dumps([(m, *v) for m, v in own.items()]),))
        last, pl, mean, holders = metrics_of(own)
        yield Row(cnpj=key[0], competencia_ultima=last, pl_atual=pl, pl_medio_12m=mean, cotistas_atual=holders)

    def close(self) -> None:
        pass


def running_metrics(reports: DataFrame) -> DataFrame:
    """A stream of the metrics of each fund that reports arrive for. reports: a stream of cnpj, competencia, pl, num_cotistas, arrival (of equal months the last counts)."""
    importable(reports.sparkSession)
    rows = reports.filter("cnpj is not null and competencia is not null").select("cnpj", F.col("competencia").cast("string").alias("competencia"), F.col("pl").cast("decimal(20,2)").cast("string").alias("pl"), F.col("num_cotistas").cast("int").alias("num_cotistas"), "arrival")
    return rows.groupBy("cnpj").transformWithState(RunningMetrics(), METRICS, "Update", "None")


def keep_metrics(spark: SparkSession, reports: DataFrame, store: Store, checkpoint: str, name: str = "metricas") -> StreamingQuery:
    """Merges the running metrics into fundos_metricas: only the parts of funds with arrivals are rewritten."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def step(batch: DataFrame, number: int) -> None:
        own = Store(batch.sparkSession, store.folder)
        if own.manifest("fundos_metricas")["notes"].get(f"batch:{name}", -1) >= number:
            return
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        own.merge("fundos_metricas", batch.withColumn("atualizado_em", F.lit(now).cast("timestamp_ntz")), ["cnpj"], notes={f"batch:{name}": number})

    return running_metrics(reports).writeStream.queryName(name).outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
