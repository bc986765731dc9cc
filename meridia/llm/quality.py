"""A quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Each white-space chunk gives two words: itself in lower case, and its shape (letters as x or X, runs shortened). Both
sequences give 1-grams and 2-grams, hashed to 2 ** BITS coordinates; a 2-gram of two equal words is a coordinate of
its own. The value of a coordinate is SCALE times its share of the n-grams, so a score is a sparse dot product.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import below, chunks, mapped, MASK, Memo, only, owned, slices

#: Bits of the n-gram hash.
BITS = 18
#: See above.
SCALE = 40.0
#: Coordinates of a repeated word and a repeated shape.
_AGAIN = (np.uint32(1), np.uint32(2))
_RUN = re.compile(r"(.)\1{2,}")


def shape(chunk: str) -> str:
    """The chunk with upper-case letters as X, others as x and digits as 9, runs of one sign as two."""
    return _RUN.sub(r"\1\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in chunk))


def _pair(chunk: str) -> bytes:
    return np.array([zlib.crc32(chunk.lower().encode()), zlib.crc32(b"\0" + shape(chunk).encode())], "<u4").tobytes()


@functools.cache
def _memo() -> Memo:
    owned(__name__, _memo.cache_clear)
    return Memo(_pair)


def _bigrams(h: np.ndarray, again: np.uint32) -> np.ndarray:
    mixed = h[:-1] * np.uint32(0x9E3779B1) ^ h[1:] * np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(15)
    return np.where(h[:-1] == h[1:], again, mixed * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS))


def grams(text: str | None) -> np.ndarray:
    """Coordinates of all n-grams of the whole text, repeated ones repeatedly; none if it is null or has no word."""
    h = np.frombuffer(b"".join(map(_memo().__getitem__, chunks(text or ""))), "<u4").reshape(-1, 2)
    words, shapes = h[:, 0], h[:, 1]
    return np.concatenate([words >> np.uint32(32 - BITS), shapes >> np.uint32(32 - BITS), _bigrams(words, _AGAIN[0]), _bigrams(shapes, _AGAIN[1])])


@dataclass
class Model:
    weights: np.ndarray  # of 2 ** BITS coordinates
    bias: float

    def score(self, coordinates: np.ndarray) -> float:
        """The chance of label 1."""
        z = self.bias + (SCALE * float(self.weights[coordinates].mean()) if len(coordinates) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8000, label: str = "quality", epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5, seed: int = 11) -> Model:
    """Learns from at most `rows` different labels (doc_id, y), the first in an order by a hash of them: that is the bound on the sample.

    Labels that are null or neither 0 nor 1, null ids and null texts teach nothing; a document with both labels counts with
    each, and a label or a document that is repeated counts once (of several texts of one id, one). With no rows all scores
    are 0.5. Whole texts are hashed on the executors.
    """
    marks = only(labels, doc_id="doc_id", y=label).where("doc_id is not null and y in (0, 1)").where(learnable(F.col("doc_id"))).select("doc_id", F.col("y").cast("int").alias("y")).distinct()
    draw = F.xxhash64("doc_id", "y", F.lit(seed)).bitwiseAND(F.lit(MASK))
    # those below a bound are a few more than are wanted, so that the order of all needn't be found
    marks = marks.withColumn("draw", draw).where(F.col("draw") <= below(rows, marks.count())).orderBy("draw", "doc_id", "y").limit(rows).select("doc_id", "y")
    drawn = only(docs, doc_id="doc_id", text="text").where("text is not null").join(F.broadcast(marks), "doc_id")  # marks: at most `rows` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [np.unique(grams(x), return_counts=True) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([f[i].astype("<u4").tobytes() for f in found], pa.binary()) for i in (0, 1))], names=["doc_id", "y", "at", "n"])

    counted = mapped(drawn.select("doc_id", "text", "y"), run, "doc_id long, y int, at binary, n binary", __name__)
    got = counted.groupBy("doc_id", "y").agg(F.min(F.struct("at", "n")).alias("f")).select("doc_id", "y", "f.at", "f.n").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    data = [(np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(n.as_buffer(), "<u4")) for a, n in zip(got["at"], got["n"], strict=True)]
    return ftrl([(at, (SCALE / max(1, int(n.sum())) * n).astype(np.float32)) for at, n in data], got["y"].to_pylist(), epochs, alpha, beta, l1, l2, seed)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> Model:
    """Follow the regularised leader, a coordinate at a time; the bias is not regularised."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            at, x = rows[i]
            w, wb = weights(z[at], n[at]), -zb * alpha / (beta + nb**0.5)
            g = 1 / (1 + np.exp(-np.clip(wb + w @ x, -35, 35))) - y[i]
            gx = g * x
            z[at] += gx - (np.sqrt(n[at] + gx * gx) - np.sqrt(n[at])) / alpha * w
            n[at] += gx * gx
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    return Model(weights(z, n).astype(np.float32), -zb * alpha / (beta + nb**0.5))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of `docs` and the chance of label 1; null and empty texts have the chance that the bias gives.

    Only `text` is read for the score; a column called `column` is replaced. Each row is scored by itself, so repeated rows get
    the same score and an empty table gives an empty one.
    """
    keep = docs.drop(column)
    shared = keep.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2 ** BITS numbers
    schema = T.StructType([*keep.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            found = [m.score(grams(x)) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, column])

    return mapped(keep, run, schema, __name__)
