"""WARC archives as a chunked record table.

Writing: each page is a record. Of equal payloads (by SHA-256 and size) one is stored,
the others are revisits of it and name its record. A payload longer than SEGMENT_BYTES
goes out as a response and continuation records (the format's own segments), one row
each, so no record is ever assembled as a whole and parts of one payload may lie in
different archives. Archives are written by Spark's writer, gzip-compressed: a row is one
record's bytes.

Reading: Spark's text reader inflates an archive in a stream and hands on the bytes
between one version line and the next, so that a task never holds more than a few
records; a parser joins them again and goes by the lengths that headers state. A payload
comes out as rows of record, segment, chunk number and at most CHUNK_BYTES. Payloads of
one segment are digested from their rows as they stream by, carrying the digest's state
from row to row; chunks of segmented payloads are sorted within partitions by record,
segment and chunk, and one pass carries the state across rows. A length or digest that
isn't the one the header states, and an archive that ends inside a record, are errors.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.llm.common import checkpoint, importable, join_spread, shared_dir, shuffle_partitions, slices, text_lengths

SEGMENT_BYTES, CHUNK_BYTES = 1 << 20, 64 << 10
#: Raw bytes of an archive, about.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def name_of(page_id: int | None, mark: str, segment: int = 1) -> str:
    """A record's name; the mark, of URL and payload, tells apart records of one id."""
    parts = ["" if page_id is None else page_id, mark, *([] if segment == 1 else [segment])]
    return f"<urn:page:{':'.join(map(str, parts))}>"


def header(kind: str, name: str, length: int, fields: list[tuple[str, str]]) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in fields]
    return (VERSION + "\r\n".join([*lines, f"Content-Length: {length}", "", ""])).encode("utf-8", "surrogatepass")


def records(page_id: int | None, mark: str, url: str, payload: memoryview, sha1: bytes, refers: str | None = None, copies: int = 1, segment_bytes: int = SEGMENT_BYTES) -> Iterator[list[bytes | memoryview]]:
    """A page's records, each as parts to be written one after the other; the last line feed is the writer's.

    refers: the name of the record that this one revisits; copies: equal rows that it stands for.
    """
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    fields = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("X-Payload-Length", str(len(payload)))]
    fields += [("X-Copies", str(copies))] if copies > 1 else []
    name = name_of(page_id, mark)
    if refers is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers), ("Content-Type", "application/http; msgtype=response")]
        yield [header("revisit", name, len(HTTP), fields), HTTP, b"\r\n\r"]
        return
    count = max(1, -(-len(payload) // segment_bytes))
    first = payload[:segment_bytes]
    if count > 1:
        fields.append(("WARC-Segment-Number", "1"))
    yield [header("response", name, len(HTTP) + len(first), [*fields, ("Content-Type", "application/http; msgtype=response")]), HTTP, first, b"\r\n\r"]
    for k in range(1, count):
        part = payload[k * segment_bytes : (k + 1) * segment_bytes]
        own = [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k + 1))]
        if k == count - 1:
            own.append(("WARC-Segment-Total-Length", str(len(HTTP) + len(payload))))
        yield [header("continuation", name_of(page_id, mark, k + 1), len(part), own), part, b"\r\n\r"]


def write(pages: DataFrame, folder: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes a record per row of pages into archives in folder; returns the number of rows.

    Of records with equal payloads of least_bytes or more, that with the largest page_id is
    the response and the others revisit it; smaller ones are all responses. A null html
    counts as empty, a null url as an empty one. Rows with a null id are all responses, and
    so are rows that tie for the largest id; revisits then name the one whose mark is the
    largest. Rows equal in id, url and html are one record that states its copies. URLs may
    be of any length. Other columns are ignored.
    """
    importable(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    mark = F.substring(F.sha2(F.concat("sha256", F.col("url").cast("binary")), 256), 1, 32)
    rows = rows.withColumn("mark", mark)
    small = checkpoint(rows.select("page_id", "sha256", "mark", F.octet_length("payload").alias("size")))
    totals = small.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    per_file = max(16, int((totals["rows"] or 1) * archive_bytes / max(1, (totals["bytes"] or 0) + 600 * (totals["rows"] or 1))))
    key = ["sha256", "size"]
    large = small.filter(F.col("size") >= least_bytes)
    main = large.groupBy(*key).agg(F.max(F.struct("page_id", "mark")).alias("main"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = join_spread(large, main, key).filter("page_id < main.page_id").select("page_id", F.col("mark").alias("revisit_mark"), "main").distinct()
    repeated = not small.groupBy("page_id", "mark").count().filter("count > 1").isEmpty()
    if repeated:  # each task first joins the copies that it holds
        rows = rows.groupBy("page_id", "mark").agg(F.first("url").alias("url"), F.first("payload").alias("payload"), F.count(F.lit(1)).alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    # Ids and marks are spread before the payloads move: a hot payload's rows are as many keys.
    revisits = revisits.withColumnRenamed("page_id", "revisit_id")
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("mark") == F.col("revisit_mark")), "left")
    joined = joined.select("page_id", "mark", "url", "payload", F.unhex(F.sha1("payload")).alias("sha1"), F.col("main.page_id").alias("main_id"), F.col("main.mark").alias("main_mark"), "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(text_lengths(batch.column("payload")), 4 << 20):
                part = batch.slice(a, b - a)
                out: list[bytes] = []
                held = 0
                columns = [part.column(c).to_pylist() for c in ("page_id", "mark", "url", "sha1", "main_id", "main_mark", "copies")]
                for p, i, m, u, s, mi, mm, n in zip(part.column("payload"), *columns, strict=True):
                    view = memoryview(p.as_buffer()) if len(p.as_buffer() or b"") else memoryview(b"")
                    for r in records(i, m, u, view, s, None if mm is None else name_of(mi, mm), n, segment_bytes):
                        out.append(b"".join(r))
                        held += len(out[-1])
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    lines = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)
    return totals["rows"]


class Parser:
    """Archive bytes in pieces of any size in; (fields, chunk number, bytes, last) out."""

    def __init__(self):
        self.held, self.fields, self.left, self.chunk, self.skip = bytearray(), None, 0, 0, 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
        self.held += data
        while True:
            if self.fields is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = bytes(self.held[:end]).decode("utf-8", "surrogatepass").split("\r\n")
                if lines[0] != VERSION.strip():
                    raise ValueError("no record begins here")
                self.fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                self.left, self.chunk = int(self.fields["content-length"]), 0
                self.skip = self.fields["warc-type"] != "continuation"
                del self.held[: end + 4]
            if self.skip:  # the HTTP header; it is short
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                del self.held[: end + 4]
                self.left -= end + 4
                self.skip = False
            while self.left > CHUNK_BYTES:
                if len(self.held) < CHUNK_BYTES:
                    return
                yield self.fields, self.chunk, bytes(self.held[:CHUNK_BYTES]), False
                del self.held[:CHUNK_BYTES]
                self.left, self.chunk = self.left - CHUNK_BYTES, self.chunk + 1
            if len(self.held) < self.left + 4:
                return
            yield self.fields, self.chunk, bytes(self.held[: self.left]), True
            del self.held[: self.left + 4]
            self.fields = None

    def finish(self) -> None:
        """Says that the archive is at its end."""
        if self.held or self.fields is not None:
            raise ValueError("the archive ends inside a record")


def _page(name: str | None) -> int | None:
    """The page in a record's name."""
    page = (name or "").removeprefix("<urn:page:").partition(":")[0]
    return int(page) if page else None


CHUNKS = "record string, page_id long, record_type string, refers_to long, segment int, chunk int, data binary, last boolean, stated_bytes long, stated_digest string, copies long, whole boolean"


def read(spark: SparkSession, folder: str, segmented: bool = False) -> DataFrame:
    """The archives' chunked record table, columns CHUNKS; segmented: rows of segmented records alone.

    What a header states (length, digest, copies) stands on a record's first chunk. A
    revisit is one chunk without data. whole: the record is one segment.
    """
    importable(spark)
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, CHUNKS.split(", "), strict=True)])

    def row(fields: dict[str, str], chunk: int, data: bytes, last: bool) -> tuple:
        kind, segment = fields["warc-type"], int(fields.get("warc-segment-number", 1))
        stated = chunk == 0 and kind != "continuation"
        size, digest = (int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")) if stated else (None, None)
        name = fields.get("warc-segment-origin-id", fields["warc-record-id"])
        refers = _page(fields.get("warc-refers-to")) if kind == "revisit" else None
        copies = int(fields.get("x-copies", 1)) if stated else None
        whole = kind != "continuation" and "warc-segment-number" not in fields
        return name, _page(name), "response" if kind == "continuation" else kind, refers, segment, chunk, data, last, size, digest, copies, whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, own, parser = 0, None, Parser()
        version = VERSION.encode()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value"), strict=True):
                if path != own:  # what stands before an archive's first version line is nothing
                    parser.finish()
                    own, parser = path, Parser()
                    pieces = (value.as_py(),)
                else:
                    pieces = (version, value.as_py())
                for piece in pieces:
                    for fields, chunk, data, last in parser.feed(piece):
                        if segmented and fields["warc-type"] != "continuation" and "warc-segment-number" not in fields:
                            continue
                        rows.append(row(fields, chunk, data, last))
                        held += len(data) + 200
                        if held > 4 << 20:
                            yield flush()
                            rows, held = [], 0
        parser.finish()
        if rows:
            yield flush()

    files = spark.read.option("lineSep", VERSION).option("pathGlobFilter", "part-*.gz").text(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value")).mapInArrow(run, CHUNKS)


class Digest:
    """The state that is carried from chunk to chunk of one record."""

    def __init__(self):
        self.sha1, self.total = hashlib.sha1(), 0

    def update(self, data) -> None:
        self.sha1.update(data)
        self.total += len(data)

    def check(self, record: str, size: int, digest: str) -> None:
        if (self.total, base32(self.sha1.digest())) != (size, digest):
            raise ValueError(f"{record}: its payload isn't the one that its header states")


SUMMARY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, copies long"


def _summaries(segmented: bool):
    """Summaries of records whose chunks follow each other in the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, due, first = Digest(), (1, 0), None
        out: list[tuple] = []

        def end():
            if first["record_type"] != "revisit":  # a revisit has no payload
                state.check(first["record"], first["stated_bytes"], first["stated_digest"])
            out.append((first["page_id"], first["stated_bytes"], first["stated_digest"], first["record_type"], first["refers_to"], first["copies"]))

        def flush():
            names = [c.split()[0] for c in SUMMARY.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

        for batch in batches:
            held = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "data"}
            for k, data in enumerate(batch.column("data")):
                at = held["segment"][k], held["chunk"][k]
                if at == (1, 0):
                    if segmented and first is not None:
                        end()
                    first, state = {c: x[k] for c, x in held.items()}, Digest()
                elif at != due or held["record"][k] != first["record"]:
                    raise ValueError(f"{held['record'][k]}: chunk {at} stands where {due} is due")
                state.update(data.as_buffer())
                due = (at[0] + 1, 0) if held["last"][k] else (at[0], at[1] + 1)
                if not segmented and held["last"][k]:
                    end()
                    due = (1, 0)
            if out:
                yield flush()
                out.clear()
        if segmented and first is not None:
            end()
            yield flush()

    return run


def summaries(chunks: DataFrame, segmented: DataFrame | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each row that the archives were written from.

    segmented: the table of segmented records alone. Lengths and digests are taken from the
    chunks' data and compared with the headers'.
    """
    columns = ["record", "page_id", "record_type", "refers_to", "segment", "chunk", "data", "last", "stated_bytes", "stated_digest", "copies"]
    whole = chunks.filter("whole").select(*columns).mapInArrow(_summaries(False), SUMMARY)
    parts = (chunks if segmented is None else segmented).filter("not whole").select(*columns)
    parts = parts.repartition(shuffle_partitions(chunks.sparkSession), "record").sortWithinPartitions("record", "segment", "chunk")
    out = whole.unionByName(parts.mapInArrow(_summaries(True), SUMMARY))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


class MissingRecords(RuntimeError):
    """Archives give back fewer or more rows than were written, so one of them is missing or there twice."""


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives and reads them back; a whole archive that is missing is an error, as the rows are counted."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read_back(pages.sparkSession, folder, write(pages, folder))


def read_back(spark: SparkSession, folder: str, rows: int) -> DataFrame:
    """summaries() of the archives in a folder that were written from so many rows."""
    out = checkpoint(summaries(read(spark, folder), read(spark, folder, segmented=True)))
    found = out.count()
    if found != rows:
        raise MissingRecords(f"{folder}: {found} rows where {rows} were written")
    return out
