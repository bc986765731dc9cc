"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed character 2-grams and 3-grams: its letters in lower case, everything else a space.
Counts are damped by a square root, weighted by inverse document frequency and scaled to length 1. For each language a
spherical k-means gives `clusters` centroids. A text has the language of the centroid with the largest cosine; it is
rejected if its cosine distance is beyond a limit that is learned from texts with about as many different n-grams.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import below, mapped, MASK, only, slices

#: Language of texts without letters.
NONE = "und"
#: Bits of the n-gram hash.
BITS = 13
#: Longest run of characters that is hashed at once; longer texts are counted piece by piece.
_PIECE = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """For each code up to U+FFFF: itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


def counts(text: str | None) -> np.ndarray:
    """Counts of the hashed 2-grams and 3-grams of the whole text; all 0 if it is null or has no letter."""
    total = np.zeros(1 << BITS, np.int64)
    table, text = _letters(), text or ""
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer((" " + text[max(0, at - 2) : at + _PIECE].lower() + " ").encode("utf-32-le", "replace"), "<u4")
        if (high := c[c >= 0x10000]).size:
            c = np.where(np.isin(c, [x for x in np.unique(high).tolist() if not chr(x).isalpha()]), np.uint32(32), c)
        c = np.where(c < 0x10000, table[np.minimum(c, 0xFFFF)], c)
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        if len(c) < 3:
            continue
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        three ^= three >> np.uint32(15)
        two ^= two >> np.uint32(15)
        both = np.concatenate([two * np.uint32(0x2C1B3C6D), three * np.uint32(0x297A2D39)]) >> np.uint32(32 - BITS)
        total += np.bincount(both, minlength=1 << BITS)
    return total


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # a row each, of length 1
    idf: np.ndarray
    least: np.ndarray  # limit of the cosine by the power of two of the number of different n-grams

    def vector(self, n: np.ndarray) -> np.ndarray:
        v = np.sqrt(n).astype(np.float32) * self.idf
        return v / max(float(np.linalg.norm(v)), 1e-9)

    def nearest(self, n: np.ndarray) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1), and whether the text is rejected."""
        kinds = np.count_nonzero(n)
        if not kinds or not self.langs:
            return NONE, 0.0, True
        cosines = self.centroids @ self.vector(n)
        k = int(cosines.argmax())
        score = float(np.clip(cosines[k], 0, 1))
        return self.langs[k], score, score < self.least[min(len(self.least) - 1, int(kinds).bit_length())]


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def fit(docs: DataFrame, per_lang: int = 1000, clusters: int = 3, slack: float = 0.6, low: float = 0.01, seed: int = 7) -> Model:
    """Learns from `doc_id`, `text` and `lang` of at most `per_lang` documents of each language, the first in an order by a hash of doc_id.

    The bound on the sample is `per_lang`; whole texts of the drawn rows are counted on the executors. Rows with a null
    text, language or id, and texts without letters, teach nothing, and a repeated id counts once for each language (with one of its
    texts); an empty table gives a model that rejects all.
    `slack`: the limit of rejection is the quantile `low` of the cosines of the sample's texts of about that many n-grams,
    times this, so that a few odd texts in the sample don't open it; where the sample has no text of that size, those of
    the nearest size count.
    The driver holds the sample's counts (6 bytes for each different n-gram of a text) and one language's rows at a time
    as vectors; the model has 0.8 MB a language, so languages are taken to be some hundreds at most.
    """
    rows = only(docs, doc_id="doc_id", text="text", lang="lang").where("lang is not null and text is not null and doc_id is not null").where(learnable(F.col("doc_id")))
    draw = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit(MASK))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("doc_id").alias("n")).collect()}
    bounds = docs.sparkSession.createDataFrame([(lang, below(per_lang, n)) for lang, n in sorted(sizes.items())], "lang string, most long")
    drawn = rows.join(F.broadcast(bounds), "lang").where(draw <= F.col("most")).select("lang", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = [counts(x) for x in b.column(2).to_pylist()]
            at = [np.flatnonzero(x) for x in n]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([x[i].astype("<u4").tobytes() for x, i in zip(n, at, strict=True)], pa.binary())], names=["lang", "doc_id", "at", "n"])

    width = 1 << BITS
    counted = mapped(drawn, run, "lang string, doc_id long, at binary, n binary", __name__).where("length(at) > 0")
    once = counted.groupBy("lang", "doc_id").agg(F.min(F.struct("at", "n")).alias("f")).select("lang", "doc_id", "f.at", "f.n")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id"))  # of the few more than are wanted
    got = once.withColumn("r", first).where(F.col("r") <= per_lang).drop("r").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")]) if sizes else None
    if got is None or not got.num_rows:
        return Model([], np.zeros((0, width), np.float32), np.ones(width, np.float32), np.zeros(24, np.float32))
    sparse = [(np.frombuffer(a.as_buffer(), "<u2"), np.frombuffer(n.as_buffer(), "<u4")) for a, n in zip(got["at"], got["n"], strict=True)]
    seen = np.zeros(width)
    for at, _ in sparse:
        seen[at] += 1
    idf = (np.log((1 + len(sparse)) / (1 + seen)) + 0.1).astype(np.float32)

    def vectors(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), width), np.float32)
        for row, k in zip(x, rows, strict=True):
            at, n = sparse[k]
            row[at] = np.sqrt(n) * idf[at]
            row /= max(float(np.linalg.norm(row)), 1e-9)
        return x

    langs, centroids, of = [], [], np.array(got["lang"].to_pylist())
    rows_of = {lang: np.flatnonzero(of == lang) for lang in sorted(set(of))}
    for lang, own in rows_of.items():
        found = _spherical(vectors(own), clusters, seed)
        langs += [lang] * len(found)
        centroids.append(found)
    model = Model(langs, np.concatenate(centroids), idf, np.zeros(24, np.float32))
    best = np.zeros(len(sparse))
    for own in rows_of.values():
        best[own] = (vectors(own) @ model.centroids.T).max(1)
    sizes_of = np.array([len(at).bit_length() for at, _ in sparse])
    least = np.array([np.quantile(best[sizes_of == k], low) if (sizes_of == k).any() else np.inf for k in range(24)])
    seen = np.flatnonzero(np.isfinite(least))
    nearest = seen[np.abs(np.arange(24)[:, None] - seen[None]).argmin(1)]  # sizes that the sample lacks have the limit of the nearest one
    model.least = (np.minimum.accumulate(least[::-1])[::-1] * slack)[nearest].astype(np.float32)
    return model


def _spherical(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of length 1 of at most k clusters of the rows of x."""
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < min(k, len(x)):  # the next start: the row farthest from those before
        c = np.concatenate([c, x[[(x @ c.T).max(1).argmin()]]])
    for _ in range(10):
        to = (x @ c.T).argmax(1)
        c = np.stack([m / max(float(np.linalg.norm(m)), 1e-9) for m in (x[to == j].sum(0) for j in range(len(c)) if (to == j).any())])
    return c


def predict(docs: DataFrame, model: Model, text: str = "text", columns: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """All columns of `docs` and the language, the cosine of the nearest centroid and whether the text is rejected.

    Null texts and texts without a letter are NONE with score 0, and rejected. Only `text` is read for the prediction;
    columns called as the new ones are replaced. Each row is predicted by itself, so repeated rows get the same, and an empty
    table gives an empty one; of two centroids that are equally near the first counts.
    """
    keep = docs.drop(*columns)
    shared = keep.sparkSession.sparkContext.broadcast(model)  # centroids x 2 ** BITS numbers, 0.8 MB a language
    schema = T.StructType([*keep.schema.fields, *(T.StructField(c, k) for c, k in zip(columns, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            found = [m.nearest(counts(x)) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *columns])

    return mapped(keep, run, schema, __name__)
