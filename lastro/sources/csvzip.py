"""Regulator tables: `;`-separated CSV, UTF-8 or Latin-1, alone or inside ZIP archives.

The format `regulator` plans one partition for each member of each archive, from the archive's
central directory, which range reads fetch; a task opens the archive where it lies and inflates
its own member in a stream, whatever the archive's size. Filters on path, member and file_idx
choose members before anything is inflated. A member is read twice if its header isn't plain
ASCII or its rows are asked for: once to tell its encoding, which all of it decides, and once for
rows. Every row carries row_idx, its place in its file, which the row-order rules need.
"""

from __future__ import annotations

import codecs
import csv
import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial, reduce
from itertools import groupby, islice, zip_longest
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains
from pyspark.sql.types import StructType

from lastro.functions.parsing import LayoutError, column_name, resolve
from lastro.session import importable

DATASETS = {
    "cadastro": "FI/CAD/DADOS/cad_fi.csv",
    "fii": "FII/DOC/INF_MENSAL/DADOS/inf_mensal_fii_{}.zip",
    "fidc": "FIDC/DOC/INF_MENSAL/DADOS/inf_mensal_fidc_{}.zip",
    "registro": "FI/CAD/DADOS/registro_fundo_classe.zip",
    "registro_reserva": "FI/CAD/DADOS/registro_fundo_classe_.zip",
}


def dataset_path(base: str, dataset: str, period: str | int = "") -> str:
    return f"{base.rstrip('/')}/{DATASETS[dataset].format(period)}"


Opener = Callable[[], BinaryIO]


def encoding_of(member: Opener) -> str:
    """UTF-8 (a mark in front is skipped) if all of the member is, else Latin-1."""
    check = codecs.getincrementaldecoder("utf-8")()
    with member() as stream:
        try:
            while block := stream.read(1 << 20):
                check.decode(block)
            check.decode(b"", True)
        except UnicodeDecodeError:
            return "latin-1"
    return "utf-8-sig"


def lines(member: Opener) -> Iterator[list[str]]:
    """Rows of a table, the header first; blank rows are dropped."""
    with io.TextIOWrapper(member(), encoding=encoding_of(member), newline="") as text:
        for row in csv.reader(text, delimiter=";"):
            if any(x.strip() for x in row):
                yield row


def _file(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of what Spark's readers call `uri`."""
    scheme, found, rest = uri.partition(":")
    if found and scheme == "file":
        uri = "file:///" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@contextmanager
def opened(uri: str) -> Iterator[BinaryIO]:
    """A file that can be read at any place."""
    files, path = _file(uri)
    with files.open_input_file(path) as stream:
        yield stream


def member_names(stream: BinaryIO) -> list[str]:
    """Names of an archive's CSV members in its directory's order, or one empty name for a plain file."""
    head = stream.read(4)
    stream.seek(0)
    if head != b"PK\x03\x04":
        return [""]
    return [n for n in zipfile.ZipFile(stream).namelist() if n.lower().endswith(".csv")]


def _opener(stream: BinaryIO, name: str) -> Opener:
    if name:
        return partial(zipfile.ZipFile(stream).open, name)

    def whole() -> BinaryIO:
        return io.BytesIO(stream.read_at(stream.size(), 0)) if stream.size() < 1 << 20 else io.BufferedReader(_Kept(stream))

    return whole


class _Kept(io.RawIOBase):
    """A file from its start, at a place of this reader's own; the file stays open when the reader is closed."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.at = stream, 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.stream.read_at(len(into), self.at)
        into[: len(got)] = got
        self.at += len(got)
        return len(got)


@dataclass
class Member(InputPartition):
    path: str
    place: int
    name: str


#: Rows of a batch.
ROWS = 10_000
PLACES = ("path", "file_idx", "member", "row_idx", "cells", "columns")
CELLS = "path string, file_idx int, member string, row_idx long, cells map<string,string>"
HEADERS = "path string, file_idx int, member string, columns array<string>"


class RegulatorSource(DataSource):
    """Rows of all members. Option paths: files, a line each.

    The schema names what is read: path, file_idx (the member's place in its archive), member,
    row_idx, and columns by their normalised names as strings, null where a member lacks them; or
    cells, all of a row as a map; or columns, the names in a member's header, one row a member.
    Ragged rows: missing cells are null, more cells than names are dropped; of equal names the
    last counts. Blank rows are dropped.
    """

    @classmethod
    def name(cls) -> str:
        return "regulator"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["paths"].split("\n"), schema.fieldNames())


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], wanted: list[str]):
        self.paths, self.wanted = paths, wanted
        self.tests: list[Callable[[Member], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        fields = {("path",): "path", ("member",): "name", ("file_idx",): "place"}
        for f in filters:
            field = fields.get(getattr(f, "attribute", None))
            if field and isinstance(f, (EqualTo, In, StringContains)):
                self.tests.append(partial(_passes, f, field))
            else:
                yield f

    def partitions(self) -> list[Member]:
        found = []
        for path in self.paths:
            with opened(path) as stream:
                found += [Member(path, k, n) for k, n in enumerate(member_names(stream))]
        return [m for m in found if all(t(m) for t in self.tests)]

    def read(self, member: Member | None) -> Iterator[pa.RecordBatch]:
        if member is None:  # what Spark hands over where nothing was planned
            return
        with opened(member.path) as stream:
            own = _opener(stream, member.name)
            if "columns" in self.wanted:
                yield self._batch(member, 1, {"columns": pa.array([header(own)], pa.list_(pa.string()))})
                return
            table = lines(own)
            names = [column_name(c) for c in next(table, [])]
            at = 0
            while held := list(islice(table, ROWS)):
                values: dict[str, pa.Array] = {"row_idx": pa.array(range(at, at + len(held)), pa.int64())}
                if "cells" in self.wanted:
                    values["cells"] = pa.array([list(dict(zip(names, row, strict=False)).items()) for row in held], pa.map_(pa.string(), pa.string()))
                columns = dict(zip(names, zip_longest(*(row[: len(names)] for row in held), [None] * len(names)), strict=False))
                values |= {c: pa.array(columns[c][: len(held)], pa.string()) for c in self.wanted if c in columns and c not in PLACES}
                yield self._batch(member, len(held), values)
                at += len(held)

    def _batch(self, member: Member, n: int, values: dict[str, pa.Array]) -> pa.RecordBatch:
        values |= {"path": pa.array([member.path] * n, pa.string()), "member": pa.array([member.name] * n, pa.string()), "file_idx": pa.array([member.place] * n, pa.int32())}
        return pa.RecordBatch.from_arrays([values[c] if c in values else pa.nulls(n, pa.string()) for c in self.wanted], names=self.wanted)


def _passes(f: Filter, field: str, member: Member) -> bool:
    own = getattr(member, field)
    return own == f.value if isinstance(f, EqualTo) else f.value in own if isinstance(f, StringContains) else own in f.value


def header(member: Opener) -> list[str]:
    """The normalised names of a member's columns; all of a member is read only if its header isn't plain ASCII."""
    with member() as stream:
        first = io.TextIOWrapper(stream, encoding="ascii", newline="")
        try:
            names = next((row for row in csv.reader(first, delimiter=";") if any(x.strip() for x in row)), [])
        except UnicodeDecodeError:
            names = next(lines(member), [])
    return [column_name(c) for c in names]


def register(spark: SparkSession) -> None:
    """Makes the format `regulator` known, with its filters pushed down."""
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegulatorSource)


def files_of(spark: SparkSession, *paths: str) -> list[str]:
    """The files that paths, folders and patterns name, in order, without Spark's own marks."""
    found = []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        system = path.getFileSystem(conf)
        matches = system.globStatus(path)
        if not matches:
            raise FileNotFoundError(text)
        for status in matches:
            for one in system.listStatus(status.getPath()) if status.isDirectory() else [status]:
                if one.isFile() and one.getPath().getName()[0] not in "._":
                    found.append(one.getPath().toString())
    return sorted(found)


def source(spark: SparkSession, kind: str, *paths: str) -> DataFrame:
    """The columns that `kind`, a schema, names, of all members of the files."""
    register(spark)
    return spark.read.format("regulator").schema(kind).option("paths", "\n".join(files_of(spark, *paths))).load()


def read_cells(spark: SparkSession, *paths: str, member: int | None = None) -> DataFrame:
    """All rows of all tables in files, or of the member with that place: path, file_idx, member, row_idx and cells (a map by normalised column name; of equal names the last)."""
    rows = source(spark, CELLS, *paths)
    return rows if member is None else rows.filter(F.col("file_idx") == member)


def headers(spark: SparkSession, *paths: str) -> DataFrame:
    """path, file_idx, member, columns of each table, empty ones too."""
    return source(spark, HEADERS, *paths)


def columns_of(spark: SparkSession, names: Iterable[str], *paths: str) -> DataFrame:
    """The named columns of all members, and path, file_idx, member, row_idx."""
    own = ", ".join(f"`{n}` string" for n in dict.fromkeys(names) if n not in PLACES)
    return source(spark, f"{own}{', ' if own else ''}row_idx long, file_idx int, member string, path string", *paths)


def _listed(spark: SparkSession, *paths: str) -> list:
    return headers(spark, *paths).orderBy("path", "file_idx").collect()  # a row per archive member


def _rows_of(spark: SparkSession, found: list, *paths: str) -> DataFrame:
    """Rows of chosen members (rows of _listed), with the columns of any of them."""
    rows = columns_of(spark, [c for h in found for c in h.columns], *paths)
    # The first filters choose members before they are inflated; the last is exact where archives differ.
    by_place: dict[int, list[str]] = {}
    for h in found:
        by_place.setdefault(h.file_idx, []).append(h.path)
    rows = rows.filter(F.col("member").isin(*{h.member for h in found})).filter(F.col("file_idx").isin(*by_place))
    if len(by_place) > 1:
        rows = rows.filter(reduce(lambda a, b: a | b, [(F.col("file_idx") == k) & F.col("path").isin(*p) for k, p in by_place.items()]))
    return rows.drop("path")


def tables(spark: SparkSession, *paths: str) -> list[tuple[str, DataFrame]]:
    """Each table of the files as (member, rows with its own columns and row_idx); members of several archives that have one name are one table."""
    named: dict[tuple[str, int], list] = {}
    seen: dict[tuple[str, str], int] = {}
    for h in _listed(spark, *paths):
        again = seen[h.path, h.member] = seen.get((h.path, h.member), -1) + 1
        named.setdefault((h.member, again), []).append(h)
    # An archive may lack a table, so a table's place is the last that it has anywhere.
    ordered = sorted(named.items(), key=lambda x: (max(h.file_idx for h in x[1]), x[0]))
    return [(member, _rows_of(spark, found, *paths)) for (member, _), found in ordered]


def table(spark: SparkSession, *paths: str, token: str = "") -> DataFrame:
    """Of each file the first table whose member's name has the token; columns are those of any of them."""
    found = {}
    listed = _listed(spark, *paths)
    for h in listed:
        if token in h.member.lower():
            found.setdefault(h.path, h)
    if len(found) < len({h.path for h in listed}) or not found:
        raise LayoutError(f"{paths}: no member with {token!r} in {[h.member for h in listed]}")
    return _rows_of(spark, list(found.values()), *paths)


def write_archives(rows: DataFrame, folder: str, titles: dict[str, str] | None = None) -> DataFrame:
    """ZIP archives of CSV members: path, members, rows of each archive that was written.

    rows: archive, member (their names), place (the order of a member's lines, the header first)
    and value (a line). titles: headers of members whose rows have none. An archive is one task's, which streams its members' lines; it is written
    under a name of the task's own and then renamed, so a task that is run again leaves one whole file.
    """
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = _file(folder)
        files.create_dir(root, recursive=True)
        mark = f".attempt-{TaskContext.get().taskAttemptId()}"
        archive = member = None
        done: list[tuple[str, int, int]] = []
        stream = packed = inner = None

        def close(all_of_it: bool) -> None:
            nonlocal inner
            if inner:
                inner.close()
                inner = None
            if all_of_it and packed:
                packed.close()
                stream.close()
                files.move(f"{root}/{archive}{mark}", f"{root}/{archive}")

        for batch in batches:
            at = 0
            for (own, name), same in groupby(zip(batch.column("archive").to_pylist(), batch.column("member").to_pylist(), strict=True)):
                n = sum(1 for _ in same)
                if own != archive:
                    close(True)
                    archive, member = own, None
                    stream = files.open_output_stream(f"{root}/{archive}{mark}")
                    packed = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                    done.append((f"{folder}/{archive}", 0, 0))
                if name != member:
                    close(False)
                    member, inner = name, packed.open(name, "w", force_zip64=True)
                    if titles and name in titles:
                        inner.write(f"{titles[name]}\r\n".encode())
                    done[-1] = (done[-1][0], done[-1][1] + 1, done[-1][2] + (1 if titles and name in titles else 0))
                inner.write("".join([v + "\r\n" for v in batch.column("value").slice(at, n).to_pylist()]).encode())
                done[-1] = (done[-1][0], done[-1][1], done[-1][2] + n)
                at += n
        close(True)
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int64())], names=["path", "members", "rows"])

    ordered = rows.select("archive", "member", "place", "value").repartition("archive").sortWithinPartitions("archive", "member", "place")
    return ordered.mapInArrow(run, "path string, members int, rows long")


def first_readable(spark: SparkSession, *paths: str) -> str:
    """The first path that exists."""
    last: Exception | None = None
    for p in paths:
        try:
            spark.read.format("binaryFile").load(p).select("path").head()
            return p
        except Exception as exc:  # noqa: BLE001  any reader error means the next path
            last = exc
    raise RuntimeError(f"none of {paths} can be read") from last


def check_layout(columns: list[str], wanted: dict[str, tuple[str, ...]], required: tuple[str, ...], filename: str) -> dict[str, str | None]:
    return resolve(columns, wanted, required, filename)


def fill_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with a value, for each column."""
    shares = [F.avg(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1.0).otherwise(0.0)).alias(c) for c in columns]
    return rows.agg(F.count(F.lit(1)).alias("rows"), *shares)
