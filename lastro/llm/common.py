"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro import session

#: Bytes of a batch that goes to a Python worker at most: a session's setting, which operators
#: lower from Spark's default, so that an executor holds few of them whatever its rows' size.
BATCH, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "8388608b", "67108864b"


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package, and take small batches unless the session says otherwise."""
    session.importable(spark)
    if spark.conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)


#: What a Python worker keeps for the batches of one task, and the task it was last emptied for.
HELD, TIDIED = [], [-1]


def held(cache):
    """A module's cache, which tidy() empties."""
    HELD.append(cache)
    return cache


def tidy() -> None:
    """When a task begins, gives the system what the worker's earlier tasks left: their caches and freed pages.

    Workers serve one task after the other, of whatever operator, so without this an executor holds
    the most that any of them took. Operators call it before a task's first batch or group.
    """
    context = TaskContext.get()
    if context is None or context.taskAttemptId() == TIDIED[0]:
        return
    TIDIED[0] = context.taskAttemptId()
    for cache in HELD:
        cache.clear()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own readers only."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or what
    setCheckpointDir() set. Where neither is set, a local session (as in tests) takes a folder
    of its own; on a cluster that is an error, since executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/lastro-shared"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under the application's own, which goes when the application ends."""
    own = f"{shared_base(spark)}/lastro-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{what}-{uuid.uuid4().hex}"


#: Lets Spark drop a query's shuffle files as soon as the query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder; the shuffles that led to it go."""
    spark = df.sparkSession
    path = shared_dir(spark, "table")
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that are dealt out at most.
HOT_KEYS = 4096


def spread(rows: DataFrame, keys: list[str], by: str | None = None, counts: DataFrame | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """rows with a column salt, and what gives another table, of one row per key, the salts to be joined with.

    One key, or null, may hold a large part of rows. A key that has more rows than a task's
    share is dealt to four salts for each share, and its facts are copied for each salt. Such
    keys are fewer than tasks; HOT_KEYS of them at most are told to all executors, and any
    other key has less than 1 / HOT_KEYS of the rows. by: a column whose hash deals a key's
    rows; without it their places do, and rows must come from a written table, so that they
    don't change when a task is run again. counts: the keys and their rows (count), if known.
    """
    spark, parts = rows.sparkSession, shuffle_partitions(rows.sparkSession)
    own = [f"own_{k}" for k in range(len(keys))]
    counts = rows.groupBy(*keys).count() if counts is None else counts
    total = rows.count() if by is None else counts.agg(F.sum("count")).first()[0] or 0
    many = None
    if total > HOT_KEYS:
        hot = counts.filter(F.col("count") * parts > total).orderBy(F.col("count").desc()).limit(HOT_KEYS)
        hot = hot.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.ceil(F.col("count") * (4 * parts) / total).alias("salts"))
        found = hot.toArrow()  # a list of rows would start Python workers of their own
        many = F.broadcast(spark.createDataFrame(found, hot.schema)) if found.num_rows else None
    if many is None:
        alone = F.lit(0).cast("long")
        return rows.withColumn("salt", alone), lambda facts: facts.withColumn("salt", alone)

    def told(df: DataFrame) -> DataFrame:
        same = [df[k].eqNullSafe(many[o]) for k, o in zip(keys, own, strict=True)]
        return df.join(many, same, "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long"))).drop(*own)

    dealt = told(rows if by else rows.withColumn("place", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64(by or "place"), "salts")).drop("salts", *([] if by else ["place"]))
    return dealt, lambda facts: told(facts).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")


def join_spread(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", by: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """rows.join(facts, keys, how) by spread(); facts has one row per key."""
    dealt, copied = spread(rows, keys, by, counts)
    return dealt.join(copied(facts), [*keys, "salt"], how).drop("salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` units together; a larger row stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary Arrow column; null counts as 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most `most` bytes of text, so that memory doesn't depend on the batch size."""
    tidy()
    for batch in batches:
        if batch.num_rows:
            for a, b in slices(text_lengths(batch.column(column)), most):
                yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """Polynomial hashes modulo 2**64 of any range of an array, by one prefix sum."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.clear()

    def clear(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            step = 1 << max(0, (n - 1).bit_length() - 4)  # an eighth more than needed at most
            size = -(-n // step) * step
            up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.down[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.up[start] + (end - start).astype(np.uint64))
