"""Places in an order, for tables of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with `number`, their place in the order from 0, without bringing them into one task.

    written: writes a table and reads it again, so that the places within ranges don't change.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumns({"range": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = sorted((r["range"], r["count"]) for r in placed.groupBy("range").count().collect())  # one row per range
    offsets, total = [], 0
    for k, n in counts:
        offsets.append((k, total))
        total += n
    table = rows.sparkSession.createDataFrame(offsets, "range int, offset long")
    return placed.join(F.broadcast(table), "range").withColumn("number", F.col("offset") + F.col("place")).drop("range", "place", "offset")
