"""Keyed upserts on Parquet tables: a new version of the table from the old one and the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sides(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    t = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("t"))
    s = source.select(*keys, F.struct(*[c for c in source.columns if c not in keys]).alias("s"))
    return t.join(s, keys, "full"), F.col("s").isNotNull()


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Source rows replace or join target rows by key. source has one row per key.

    update: columns that the source sets, nulls too, on rows that exist (default: all of
    the source's); other columns keep the target's value. New rows take all that the
    source has. So columns that aren't in update are protected.
    """
    joined, there = _sides(target, source, keys)
    new = F.col("t").isNull()
    update = [c for c in source.columns if c not in keys] if update is None else update
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in source.columns:
            take = there if c in update else there & new
            out.append(F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return joined.select(*out)


def enrich(target: DataFrame, source: DataFrame, key: str, fill: dict[str, Column] | None = None) -> DataFrame:
    """Source values that aren't empty replace the target's; fill gives values for empty columns of funds that the source has."""
    joined = target.alias("t").join(source.withColumn("there", F.lit(True)).alias("s"), key, "left")
    out = []
    for c in target.columns:
        own = F.col(f"t.{c}")
        if c == key:
            out.append(F.col(key))
        elif c in source.columns:
            out.append(F.coalesce(F.nullif(F.col(f"s.{c}"), F.lit("")), own).alias(c))
        elif fill and c in fill:
            out.append(F.when(F.col("s.there"), F.coalesce(F.nullif(own, F.lit("")), fill[c])).otherwise(own).alias(c))
        else:
            out.append(own.alias(c))
    return joined.select(*out)


def with_parents(parents: DataFrame, children: DataFrame, key: str = "cnpj") -> DataFrame:
    """Parents, and a bare row for each key of the children that has none."""
    missing = children.select(key).filter(F.col(key).isNotNull()).distinct().join(parents.select(key), key, "left_anti")
    return parents.unionByName(missing, allowMissingColumns=True)


def replace(folder: str, table: DataFrame) -> None:
    """Writes a table's new version; its inputs must lie elsewhere."""
    table.write.mode("overwrite").parquet(folder)
