"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (n = 2, 3, 4 over
lower-case letters and word boundaries, a blended spectrum) present in both,
divided by the root of the product of the numbers present in each. Landmarks, a
bounded sample of the labelled texts, give Nyström features; one-versus-rest
kernel ridge regression on them gives a weight per class and landmark.

n-grams are hashed to a fixed number of coordinates, so a text is a row of zeros
and ones and the kernel against the landmarks is a matrix product. Weights,
landmarks and the Nyström map are constant, so their product is taken once and a
batch of texts is scored by one product with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.bpe import LETTER, classes
from lastro.llm.common import importable, mix64, text_slices

SLICE_BYTES = 1 << 20
ORDERS = (2, 3, 4)
COORDINATES = 1 << 15
_LETTERS: list[np.ndarray] = []


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of booleans for each text, and whether it has letters."""
    if not _LETTERS:
        _LETTERS.append(classes() == LETTER)
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in low], np.int64)
    cp = np.frombuffer(("".join(f" {t} " for t in low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = _LETTERS[0][cp]
    lettered = np.bincount(doc[letter], minlength=len(texts)) > 0
    cp = np.where(letter, cp, 32)
    keep = letter.copy()  # of blanks, the first after a letter and the first of a text
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    keep[:1] = True
    cp, doc = cp[keep].astype(np.uint64), doc[keep]
    out = np.zeros((len(texts), COORDINATES), bool)
    h = cp.copy()
    for n in range(2, max(ORDERS) + 1):
        h = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + cp[n - 1 :] + np.uint64(n))
        if n in ORDERS:
            inside = doc[n - 1 :] == doc[: len(h)]
            out[doc[: len(h)][inside], (h[inside] % np.uint64(COORDINATES)).astype(np.int64)] = True
    return out, lettered


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # coordinates x classes
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Labels (`und` without letters) and scores."""
        label, score = [], np.zeros(len(texts))
        for a in range(0, len(texts), 128):
            x, lettered = presence(texts[a : a + 128])
            x = x.astype(np.float32)
            size = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
            f = 4 * (x @ self.weights / size + self.bias).astype(np.float64) if self.labels else np.zeros((len(x), 1))
            p = np.exp(f - f.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            known = lettered & bool(self.labels)
            label += [self.labels[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            score[a : a + len(x)] = np.where(known, p.max(axis=1), 0)
        return label, score


def fit(bits: np.ndarray, labels: list[str], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regression on Nyström features. bits: packed rows of presence."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((COORDINATES, 1), np.float32), np.zeros(1))
    per = max(1, landmarks // len(names))
    labels_array = np.array(labels)
    chosen = np.concatenate([np.flatnonzero(labels_array == n)[:per] for n in names])
    base = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    base /= np.sqrt(np.maximum(base.sum(axis=1), 1))[:, None]
    kernel = np.empty((len(bits), len(chosen)))
    for a in range(0, len(bits), 256):
        x = np.unpackbits(bits[a : a + 256], axis=1).astype(np.float32)
        kernel[a : a + 256] = x @ base.T / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    value, vector = np.linalg.eigh(kernel[chosen])
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    features = kernel @ root
    y = np.where(labels_array[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1 / np.array([np.sum(labels_array == n) for n in names])
    w = sum(weight[i] * (labels_array == n) for i, n in enumerate(names))
    w = w / w.sum() * len(w)  # classes count alike
    mean, bias = (features * w[:, None]).sum(0) / w.sum(), (y * w[:, None]).sum(0) / w.sum()
    centred = features - mean
    solved = np.linalg.solve((centred * w[:, None]).T @ centred + ridge * np.eye(features.shape[1]), (centred * w[:, None]).T @ (y - bias))
    return Model(names, (base.T @ (root @ solved)).astype(np.float32), bias - mean @ solved)


def train(labelled: DataFrame, per_class: int = 1000, landmarks: int = 256, ridge: float = 1.0) -> Model:
    """Fits a model to columns doc_id, text, lang.

    per_class bounds the sample: about so many rows of each class, chosen by a hash of
    their ids, reach the driver, each as a fixed number of bits.
    """
    importable(labelled.sparkSession)
    labelled = labelled.filter("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return fit(np.zeros((0, COORDINATES // 8), np.uint8), [], landmarks, ridge)
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_class / n))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE_BYTES):
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                bits, lettered = presence(part.column("text").to_pylist())
                packed = [np.packbits(b).tobytes() if ok else None for b, ok in zip(bits, lettered.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"place": part.column("place"), "lang": part.column("lang"), "bits": pa.array(packed, pa.binary())})

    sample = labelled.select("text", "lang", place.alias("place")).filter(F.col("place") < share[F.col("lang")])
    rows = sorted((r.place, r.lang, bytes(r.bits)) for r in sample.mapInArrow(run, "place double, lang string, bits binary").filter("bits is not null").toLocalIterator())
    bits = np.frombuffer(b"".join(b for _, _, b in rows), np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, COORDINATES // 8), np.uint8)
    return fit(bits, [n for _, n, _ in rows], landmarks, ridge)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """lang_pred and score beside every column of docs.

    A null text, or one without letters, is `und` with score 0. Rows are judged one by
    one and whole, so repeated rows and null ids need no rule. Columns of docs that are
    named lang_pred or score are replaced.
    """
    importable(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # coordinates x classes numbers
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, SLICE_BYTES):
            label, score = held.value.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    plain = docs.select(*[F.col(f"`{c}`") for c in others])
    schema = StructType([*plain.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return plain.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Predicts every document's language by a model of those not held out.

    Returns doc_id, held_out, lang_pred, score. Rows with a null id are never held out.
    """
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
