"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words (letters and digits in lower case; other signs only separate). Running Karp-Rabin hashes
of `least` words of all benchmark items are the seeds. A document's own running hashes are joined with them; for each
item that shares a seed, matches are grown along runs of seeds, and the longest match that overlaps no marked word is
marked as a tile again and again. An item leaks into a document if tiles cover enough of its words, in whatever order
they stand there.

A benchmark of a few blocks is a stated query set: each block, of bounded size, is broadcast and held against all documents.
A larger one is joined: documents give the seeds that a Bloom filter of all benchmark seeds lets through, these are joined with
the items' seeds, and each pair whose shared seeds can cover enough of the item is tiled. Both ways give the same rows.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import chunks, fields, free_name, mapped, Memo, only, owned, shared_folder, slices

#: Words of the shortest tile.
LEAST = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Characters of benchmark text that are held against the documents at once.
BLOCK = 8_000_000
#: Blocks up to which each is a pass over the documents.
PASSES = 4
#: Largest Bloom filter, in bits: 64 MB.
BLOOM_BITS = 1 << 29

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _memo() -> Memo:
    owned(__name__, _memo.cache_clear)
    return Memo(lambda chunk: b"".join(xxhash.xxh3_64_intdigest(w.encode()).to_bytes(8, "little") for w in _WORD.findall(chunk.lower())))


def words(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of the whole text; none if it is null."""
    return np.frombuffer(b"".join(map(_memo().__getitem__, chunks(text or ""))), "<u8")


def rolling(w: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `least` words."""
    n = max(0, len(w) - least + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(least):
        acc = acc * _BASE + w[j : j + n]
    return acc


class Seeds:
    """The seeds of a block of items. Items with fewer than `least` words have themselves as seed."""

    def __init__(self, items: list[tuple[int, str | None]], least: int):
        self.items = [(i, words(x)) for i, x in items]
        self.least = [min(least, len(w)) for _, w in self.items]  # words of the shortest tile of each item
        self.by_size = {}
        for size in sorted({n for n in self.least if n}):
            h = [rolling(w, size) if n == size else np.zeros(0, np.uint64) for n, (_, w) in zip(self.least, self.items, strict=True)]
            flat = np.concatenate(h)
            both = np.unique(np.stack([flat, np.repeat(np.arange(len(h)), [len(x) for x in h]).astype(np.uint64)], axis=1), axis=0)
            self.by_size[size] = np.ascontiguousarray(both[:, 0]), both[:, 1].astype(np.int64), h

    def hits(self, w: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each item that shares a seed with w: the runs of seeds that both have."""
        found = {}
        for size, (seeds, item, of) in self.by_size.items():
            own = rolling(w, size)
            shared = own[seeds[np.minimum(np.searchsorted(seeds, own), len(seeds) - 1)] == own]
            if len(shared):
                order = np.argsort(own, kind="stable")
                ends = np.searchsorted(seeds, np.unique(shared)), np.searchsorted(seeds, np.unique(shared), "right")
                for k in {int(i) for x, y in zip(*ends, strict=True) for i in item[x:y]}:
                    found[k] = runs(of[k], own[order], order, size)
        return found


def runs(seeds: np.ndarray, own: np.ndarray, order: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of the longest runs of seeds that a and b share on a diagonal.

    `seeds` are those of a in order; `own` are those of b, sorted, and `order` their places. The places of b that have one
    seed of a are held at a time, never all pairs of places: a repeated line in both costs its runs alone.
    """
    found, low, high = [], np.searchsorted(own, seeds), np.searchsorted(own, seeds, "right")
    at = start = np.zeros(0, np.int64)  # places of b where runs stand at the last seed, ascending, and their first seed
    for p in range(len(seeds) + 1):
        here = order[low[p] : high[p]] if p < len(seeds) else at[:0]
        if not len(at) and not len(here):
            continue
        k = np.minimum(np.searchsorted(here, at + 1), max(0, len(here) - 1))
        on = here[k] == at + 1 if len(here) else np.zeros(len(at), bool)
        for q, s in zip(at[~on].tolist(), start[~on].tolist(), strict=True):
            found.append((s, q - (p - 1 - s), p - 1 - s + least))
        first = np.full(len(here), p)
        first[k[on]] = start[on]
        at, start = here, first
    return found


def tiles(a: np.ndarray, b: np.ndarray, pairs: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in a, place in b, words) from the pairs of places that share a seed of `least` words."""
    places = sorted({(q - p, p) for p, q in pairs})
    ends = [k for k in range(1, len(places)) if places[k] != (places[k - 1][0], places[k - 1][1] + 1)]
    return mark(a, b, [(places[x][1], places[x][1] + places[x][0], y - x - 1 + least) for x, y in zip([0, *ends], [*ends, len(places)], strict=True) if y > x], least)


def mark(a: np.ndarray, b: np.ndarray, matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in a, place in b, words) from matches of that form.

    Longer matches come first, then those earlier in a and in b. A match that overlaps marked words goes back with its
    free parts, as long as they have `least` words.
    """
    heap = [(-n, p, q) for p, q, n in matches]
    heapq.heapify(heap)
    used_a, used_b, found = np.zeros(len(a), bool), np.zeros(len(b), bool), []
    while heap and not used_a.all():
        n, p, q = heapq.heappop(heap)
        n = -n
        free = ~(used_a[p : p + n] | used_b[q : q + n]) & (a[p : p + n] == b[q : q + n])
        if free.all():
            used_a[p : p + n] = used_b[q : q + n] = True
            found.append((p, q, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for x, y in zip(edges[::2], edges[1::2], strict=True):
            if y - x >= least:
                heapq.heappush(heap, (int(x - y), p + int(x), q + int(x)))
    return found


def _bloom_places(seeds: np.ndarray, bits: int) -> np.ndarray:
    """Three places of each seed in a filter of `bits` bits (a power of two)."""
    shift = np.uint64(65 - bits.bit_length())
    return np.stack([seeds * np.uint64(m) >> shift for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)])


def _item_seeds(items: DataFrame, least: int) -> DataFrame:
    """(item, words, size, seed, n): the different seeds of each item, their words and how often they stand there, and the item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for item, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(x)
                size = min(least, len(w))
                s, n = np.unique(rolling(w, size) if size else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(s), pa.int64()), pa.array([len(w)] * len(s), pa.int64()), pa.array([size] * len(s), pa.int32()), pa.array(s.view(np.int64)), pa.array(n, pa.int64())], names=["item", "words", "size", "seed", "n"])

    return mapped(items.select("item", "text"), run, "item long, words long, size int, seed long, n long", __name__)


def _bloom(seeds: DataFrame, bits: int) -> np.ndarray:
    """The filter of all seeds; tasks give their own ones, which the driver joins one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = _bloom_places(b.column(0).to_numpy().view(np.uint64), bits).ravel()
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([own.tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in mapped(seeds.select("seed").coalesce(8), run, "bits binary", __name__).toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def _joined(thin: DataFrame, benchmark: DataFrame, least: int, coverage: float, item_id: str, text: str) -> DataFrame:
    """(key, item_id, item_words, n_tiles, covered_words, longest_tile, coverage) of texts and items; key is the text's MD5."""
    spark, folder = thin.sparkSession, shared_folder(thin.sparkSession, "decontam")

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    items = kept("items", _items(benchmark, item_id, text).withColumn("item", F.monotonically_increasing_id()))
    seeds = kept("seeds", _item_seeds(items, least))
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most `least`
    bits = min(BLOOM_BITS, max(1 << 16, 1 << (16 * seeds.count()).bit_length()))
    shared = spark.sparkContext.broadcast(_bloom(seeds, bits))  # of a bounded size
    keyed = thin.where("text is not null").select(F.md5("text").alias("key"), "text")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in slices(batches):
            for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(x)
                for size in sizes:
                    s = np.unique(rolling(w, size))
                    at = _bloom_places(s, bits)
                    s = s[(table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)]
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(s)), pa.array([size] * len(s), pa.int32()), pa.array(s.view(np.int64))], names=["key", "size", "seed"])

    # what the shared seeds can cover at most: pairs that can't reach the coverage, such as those with one common line, aren't tiled
    found = mapped(keyed, hits, "key string, size int, seed long", __name__).distinct().join(seeds, ["size", "seed"])
    met = found.groupBy("key", "item").agg(F.sum(F.col("n") * F.col("size")).alias("most"), F.max("words").alias("words")).where(F.col("most") >= F.lit(coverage) * F.col("words"))
    pairs = kept("pairs", met.select("key", "item"))
    texts = keyed.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    both = pairs.join(items.withColumnRenamed("text", "item_text"), "item").join(texts, "key").select("key", "item_id", "item_text", "text")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for key, item, item_text, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(key, *r, r[3] / r[1]) for r in _leaks(Seeds([(item, item_text)], least), x, coverage)]
            kinds = [pa.string(), *[pa.int64()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["key", *_FOUND])

    return mapped(both, tile, "key string, item_id long, item_words long, n_tiles long, covered_words long, longest_tile long, coverage double", __name__)


_FOUND = ["item_id", "item_words", "n_tiles", "covered_words", "longest_tile", "coverage"]


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """The different items that have a text."""
    return only(benchmark, item_id=item_id, text=text).where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()


def _large(benchmark: DataFrame, item_id: str, text: str, block: int, passes: int) -> bool:
    total = _items(benchmark, item_id, text).agg(F.sum(F.length("text"))).head()[0] or 0
    return total > block * passes


def _leaks(seeds: Seeds, text: str | None, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(item, its words, tiles, words covered, longest tile) of each item that leaks into the text."""
    w, out = words(text), []
    for k, matches in seeds.hits(w).items():
        item, a = seeds.items[k]
        found = mark(a, w, matches, seeds.least[k])
        covered = sum(n for *_, n in found)
        if found and covered >= coverage * len(a):
            out.append((item, len(a), len(found), covered, max(n for *_, n in found)))
    return sorted(out, key=lambda r: (r[0] is None, r))


def _blocks(benchmark: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple[int, str]]]:
    """The different items with a text, in blocks of about `size` characters, however often an item is repeated."""
    items = _items(benchmark, item_id, text)
    total = items.agg(F.sum(F.length("text"))).head()[0] or 0
    n = -(-total // size)
    for k in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted({(r["item_id"], r["text"]) for r in rows.collect()}, key=lambda x: (x[0] is None, x))


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", passes: int = PASSES) -> DataFrame:
    """A row for each document and item that leaks into it: doc_id, item_id, item_words, n_tiles, covered_words, longest_tile, coverage.

    Null texts leak nothing, nor do null items; items of fewer than `least` words leak where
    they stand as a whole. Texts of any length are read whole, a batch of bounded size at a time. Repeated documents give
    repeated rows; items repeated with id and text count once, a repeated id with another text is an item of its own.
    An empty benchmark or table gives no rows. Other columns are left out.
    """
    spark, thin = docs.sparkSession, only(docs, doc_id=doc_id, text=text)
    schema = T.StructType([thin.schema["doc_id"], *fields("item_id long, item_words long, n_tiles long, covered_words long, longest_tile long, coverage double")])
    if _large(benchmark, item_id, item_text, block, passes):
        found = _joined(thin, benchmark, least, coverage, item_id, item_text)
        return thin.select("doc_id", F.md5("text").alias("key")).join(found, "key").select("doc_id", *_FOUND)
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, item_id, item_text, block):
        shared = spark.sparkContext.broadcast(Seeds(items, least))  # a block has a bounded size

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                at, rows = [], []
                for i, x in enumerate(b.column(1).to_pylist()):
                    own = _leaks(shared.value, x, coverage)
                    at += [i] * len(own)
                    rows += own
                cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols, pa.array([r[3] / r[1] for r in rows], pa.float64())], names=schema.names)

        out = out.union(mapped(thin, run, schema, __name__))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block: int = BLOCK, text: str = "text", item_id: str = "item_id", item_text: str = "text", passes: int = PASSES) -> DataFrame:
    """The rows of `docs` into which no item leaks, with all columns; null texts stay, repeated rows stay repeated."""
    spark, out = docs.sparkSession, docs
    if _large(benchmark, item_id, item_text, block, passes):
        key = free_name("key", docs.columns)
        gone = _joined(only(docs, text=text), benchmark, least, coverage, item_id, item_text).select(F.col("key").alias(key)).distinct()
        return docs.withColumn(key, F.md5(F.col(f"`{text}`"))).join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    for items in _blocks(benchmark, item_id, item_text, block):
        shared = spark.sparkContext.broadcast(Seeds(items, least))  # a block has a bounded size

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                keep = [not _leaks(shared.value, x, coverage) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        out = mapped(out, run, docs.schema, __name__)
    return out
