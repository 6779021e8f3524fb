"""The fund store: Parquet tables in parts, of which a sync rewrites those that it touches.

A table's rows lie in parts that follow from their keys (schema.PARTS): documents by ranges of
ids, reports by month, so that what arrives together lies together. A version of a table is a
manifest, a small file that names the folder of each part. A merge reads the parts that its
arrivals fall into, writes these anew beside the old ones and then adds a manifest, which is
what commits it: readers see one version or the next, a job that dies leaves the last one, and
what is written grows with the arrivals and not with the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro import schema
from lastro.operators.upsert import upsert

#: Versions of a table that stay for readers that have begun.
KEPT = 3
CODEC = "zstd"
PART = "parte"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class Store:
    """Tables of schema.TABLES under a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Files

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def remove(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def size(self, folder: str) -> int:
        """Bytes of all files in a folder."""
        path = self._path(folder)
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    # Versions

    def _versions(self, name: str) -> list[str]:
        found = [n.removesuffix(".json") for n in self._names(f"{self.folder}/{name}/manifests") if n.startswith("v") and n.endswith(".json")]
        return sorted(found, key=lambda v: int(v[1:]))

    def manifest(self, name: str) -> dict:
        """parts: the version in which each part was written; notes: what writers left."""
        found = self._versions(name)
        return json.loads(self._text(f"{self.folder}/{name}/manifests/{found[-1]}.json")) if found else {"parts": {}, "notes": {}}

    def _next(self, name: str) -> str:
        found = self._versions(name)
        return f"v{int(found[-1][1:]) + 1 if found else 1}"

    def _commit(self, name: str, version: str, parts: dict[str, str], notes: dict) -> None:
        target, own = f"{self.folder}/{name}/manifests/{version}.json", f"{self.folder}/{name}/manifests/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(own), True)
        stream.write(bytearray(json.dumps({"parts": parts, "notes": notes}).encode()))
        stream.close()
        if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(own), self._path(target)):
            self.remove(own)
            raise Conflict(f"{name}: another writer has committed {version}")
        self._clean(name)

    def _clean(self, name: str) -> None:
        """Removes manifests but the last KEPT, and the parts that none of these names."""
        base, found = f"{self.folder}/{name}", self._versions(name)
        used: set[str] = set()
        for v in found[-KEPT:]:
            used |= set(json.loads(self._text(f"{base}/manifests/{v}.json"))["parts"].values())
        for v in found[:-KEPT]:
            self.remove(f"{base}/manifests/{v}.json")
        newest = int(found[-1][1:])
        for folder in self._names(f"{base}/data"):
            if folder not in used and int(folder[1:].partition("-")[0]) <= newest:
                self.remove(f"{base}/data/{folder}")

    # Tables

    def _read(self, name: str, parts: dict[str, str]) -> DataFrame:
        kind = schema.schema(name)
        paths = [f"{self.folder}/{name}/data/{v}/{PART}={p}" for p, v in sorted(parts.items())]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, name: str, only: Callable[[str], bool] | None = None) -> DataFrame:
        """A table, or the parts of it that `only` is true of; other parts' files aren't looked at."""
        return self._read(name, {p: v for p, v in self.manifest(name)["parts"].items() if only is None or only(p)})

    def versions(self, name: str) -> dict[str, str]:
        """Each part's version."""
        return {p: v.partition("-")[0] for p, v in self.manifest(name)["parts"].items()}

    def _shape(self, name: str, table: DataFrame) -> DataFrame:
        there = set(table.columns)
        return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.schema(name)])

    def _put(self, name: str, version: str, table: DataFrame, check: Callable[[], None] | None = None, late: Callable[[DataFrame], DataFrame] | None = None, deal: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, str]:
        own = f"{version}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.folder}/{name}/data/{own}"
        # A part's rows come together, and a part that is large is split over tasks.
        dealt = deal(table) if deal else (table if late else self._shape(name, table)).withColumn(PART, schema.part(name)).hint("rebalance", PART)
        if late or deal:
            dealt = self._shape(name, late(dealt) if late else dealt).withColumn(PART, schema.part(name))
        dealt.write.option("compression", CODEC).partitionBy(PART).parquet(folder)
        try:
            if check:
                check()
        except BaseException:
            self.remove(folder)
            raise
        return {n.removeprefix(f"{PART}="): own for n in self._names(folder) if n.startswith(f"{PART}=")}

    def write(self, name: str, table: DataFrame, notes: dict | None = None, check: Callable[[], None] | None = None, late: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """A new version of the whole table. check is called when the rows are written and before they count; what it raises leaves the table as it was.

        late: adds columns that follow from the others, when the rows are dealt to their parts.
        """
        version, old = self._next(name), self.manifest(name)
        self._commit(name, version, self._put(name, version, table, check, late), old["notes"] | (notes or {}))

    def merge(
        self, name: str, source: DataFrame, keys: list[str], update: list[str] | None = None, how: Callable[[DataFrame, DataFrame], DataFrame] | None = None, notes: dict | None = None, check: Callable[[], None] | None = None, widen: Callable[[set[str], set[str]], set[str]] | None = None,
        unpack: Callable[[DataFrame], DataFrame] | None = None, deal: Callable[[DataFrame, set[str]], DataFrame] | None = None
    ) -> list[str]:
        """A new version in which the parts that the source's rows fall into are upserted; returns these parts.

        source has one row per key. how(target, source) gives the rows of the touched parts (default:
        upsert by keys, setting the columns of `update`); it must keep the target's other rows. The
        source is computed once: it is written beside the table first. widen(touched, there) names
        parts to rewrite besides. No rows make no new version, unless there are notes. Where the
        source and what `how` gives are of another form than the table, unpack(source) has the keys
        that parts follow from, and deal(rows, touched) the table's rows, those of a part in few tasks.
        """
        version, old = self._next(name), self.manifest(name)
        staged = f"{self.folder}/{name}/staged-{uuid.uuid4().hex}"
        try:
            source.write.option("compression", CODEC).parquet(staged)
            if check:
                check()
            fresh = self.spark.read.schema(source.schema).parquet(staged)
            touched = {r[0] for r in (unpack(fresh) if unpack else fresh).select(schema.part(name).alias(PART)).distinct().collect()}  # as many as there are parts
            if widen:
                touched = widen(touched, set(old["parts"]))
            if not touched and not notes:
                return []
            parts = dict(old["parts"])
            if touched:
                target = self._read(name, {p: v for p, v in parts.items() if p in touched})
                out = how(target, fresh) if how else upsert(target, fresh, keys, update)
                # A part that has lost its rows goes.
                parts = {p: v for p, v in parts.items() if p not in touched} | self._put(name, version, out, deal=(lambda rows: deal(rows, touched)) if deal else None)
            self._commit(name, version, parts, old["notes"] | (notes or {}))
        finally:
            self.remove(staged)
        return sorted(touched)
