"""Packing by power-of-two decomposition.

A document of n tokens becomes pieces whose lengths are powers of two: as many of
the full length as fit, then the binary digits of the rest, from large to small.
Each piece is a sequence of its own, so no sequence crosses documents and nothing
is padded. Sequences of equal length share a bucket; batches are drawn from one
bucket at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.llm.bpe import SLICE_BYTES, loaded, vocabulary
from lastro.llm.common import text_slices


def lengths(n: int, most: int) -> list[int]:
    """The piece lengths of n tokens; most is a power of two."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, path: str, most: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Packs every document into sequences of at most `most` tokens; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket
    (length is 2 ** bucket) and, if with_ids, ids. Every document ends with end_id, so
    a null or empty text gives one piece of one token. Repeated rows are packed each
    for itself; null ids stay null; other columns are ignored whatever their names.
    The scan isn't shuffled: sequence_id is the piece's partition and place in it, so
    write the result once and take ids from what was written.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    source = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in text_slices(batches, "text", SLICE_BYTES):
            ids, begin = bpe.encode(batch.column("text").to_pylist())
            ids = np.insert(ids, begin[1:], end_id).astype("<u4")
            begin = begin + np.arange(len(begin))
            cuts = [lengths(n, most) for n in np.diff(begin).tolist()]
            row = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
            length = np.array([n for c in cuts for n in c], np.int64)
            upto = np.concatenate(([0], np.cumsum(length)))
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "start": pa.array(upto[:-1] - begin[row], pa.int64()),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.int64()),
                "doc_tokens": pa.array(np.diff(begin)[row], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.round(F.log2("length")).cast("int")})


def write_buckets(packed: DataFrame, folder: str) -> None:
    """Writes the sequences, one folder per bucket; tasks write what they hold, without a shuffle."""
    packed.write.partitionBy("bucket").parquet(folder)


def read_bucket(spark: SparkSession, folder: str, bucket: int) -> DataFrame:
    """The sequences of 2 ** bucket tokens, from that bucket's folder alone; batches drawn from it need no padding."""
    return spark.read.parquet(folder).filter(F.col("bucket") == bucket)
