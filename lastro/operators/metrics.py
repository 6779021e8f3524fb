"""Metrics of each fund from its monthly reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reports that the mean looks back over.
TRAILING = 12


def fund_metrics(reports: DataFrame) -> DataFrame:
    """cnpj, competencia_ultima, pl_atual, pl_medio_12m, cotistas_atual.

    The mean is over the last 12 reports, not calendar months; a report without a value
    takes a place but doesn't count. It rounds half to even. Current values are the last
    that aren't null in the whole series.
    """
    w = Window.partitionBy("cnpj").orderBy(F.col("competencia").desc())
    rows = reports.withColumn("place", F.row_number().over(w))
    recent = F.when(F.col("place") <= TRAILING, F.col("pl"))
    out = rows.groupBy("cnpj").agg(
        F.max("competencia").alias("competencia_ultima"),
        F.max_by("pl", F.when(F.col("pl").isNotNull(), F.col("competencia"))).alias("pl_atual"),
        F.sum(recent).alias("total"), F.count(recent).alias("n"),
        F.max_by("num_cotistas", F.when(F.col("num_cotistas").isNotNull(), F.col("competencia"))).alias("cotistas_atual"),
    )
    mean = F.when(F.col("n") > 0, F.bround(F.col("total") / F.col("n").cast("decimal(10,0)"), 2)).cast("decimal(20,2)")
    return out.select("cnpj", "competencia_ultima", "pl_atual", mean.alias("pl_medio_12m"), "cotistas_atual")


def trailing_mean(reports: DataFrame) -> DataFrame:
    """The same mean as a running series."""
    w = Window.partitionBy("cnpj").orderBy("competencia").rowsBetween(1 - TRAILING, 0)
    return reports.withColumn("pl_medio_12m", F.bround(F.sum("pl").over(w) / F.count("pl").over(w).cast("decimal(10,0)"), 2).cast("decimal(20,2)"))
