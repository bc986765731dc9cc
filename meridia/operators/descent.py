"""Approximate nearest neighbours of vectors by descent on a graph: neighbours of neighbours are likely neighbours.

The first graph comes from blocks of rows that stand together in orders by random projections, in which neighbours are exact.
A round then lets each row's neighbours and some rows that have it as a neighbour meet, all pairs of them in one matrix product.
Rows that stand together in an order make a block: a task takes the meetings of a block's rows, and gets a vector once a block, in
single precision, however often it is met there. Only the pairs that improve a list most leave the task. Rounds are written to
the shared folder and go on until few lists change. Distances are made exact at the end, by blocks too.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.sources.folders import work_folder

#: Rows of a block of the first graph; the number of random orders; hyperplanes whose signs come first in an order.
BLOCK, TREES, PLANES = 128, 4, 16
#: Bytes of the vectors that a block's meetings take at most, and the most rows of a block; pairs that a task holds before it cuts them.
SEAT_BYTES, SEAT_ROWS, HELD = 200_000_000, 16_384, 2_000_000
_GRAPH = "id long, nbr_id long, dist double"


def _lists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b."""
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def _vectors(t: pa.Table | pa.RecordBatch, column: str, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), kind).reshape(t.num_rows, -1)


def _ids(t: pa.Table, column: str) -> np.ndarray:
    """A side of a group without rows has no columns."""
    return t.column(column).to_numpy() if t.num_rows else np.zeros(0, np.int64)


def _top(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id, ties by the smaller neighbour; pairs may repeat, and a pair that was there stays old, so that it isn't
    met again with others that were there. One shuffle serves both steps."""
    once = candidates.repartition("id").groupBy("id", "nbr_id").agg(F.min("dist").alias("dist"), F.max("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "nbr_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "nbr_id", "rank", "dist", "old")


def _seeds(table: DataFrame, k: int, width: int, n: int, tree: int, seed: int) -> DataFrame:
    """Exact neighbours within blocks of the order by signs of random projections, and then by one more projection."""
    rng = np.random.default_rng([seed, tree])
    planes = rng.normal(size=(width, PLANES + 1))
    bits = 1 << np.arange(PLANES - 1, -1, -1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _vectors(b, "v", np.float32).astype(float) @ planes
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array((p[:, :PLANES] > 0) @ bits, pa.int64()), pa.array(p[:, PLANES])], names=["id", "v", "code", "at"])

    parts = max(1, -(-n // (64 * BLOCK)))
    order = ["code", "at", "id"]
    dealt = table.mapInArrow(project, "id long, v binary, code long, at double").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b.select(["id", "v"]))
                size += b.num_rows
            while size >= 2 * BLOCK or b is None and size:
                rows = pa.Table.from_batches(held)
                cut = size if b is None and size < 2 * BLOCK else BLOCK
                yield from _block(rows.slice(0, cut))
                held, size = rows.slice(cut).to_batches(), size - cut

    def _block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        x, ids = _vectors(rows, "v", np.float32).astype(float), rows.column("id").to_numpy()
        d = _lists(x, x)
        d[ids[:, None] == ids[None]] = np.inf
        m = min(k, len(ids) - 1)
        if m > 0:
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            dist = np.take_along_axis(d, near, 1).ravel()
            good = np.isfinite(dist)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)[good]), pa.array(ids[near].ravel()[good]), pa.array(dist[good])], names=["id", "nbr_id", "dist"])

    return dealt.mapInArrow(nearest, _GRAPH)


def _placed(table: DataFrame, rows: int, n: int, width: int, seed: int) -> DataFrame:
    """The table with `block`: about `rows` rows that stand together in the order by signs of projections. A code with more is dealt by hash."""
    planes = np.random.default_rng([seed, TREES]).normal(size=(width, PLANES))
    bits = 1 << np.arange(PLANES - 1, -1, -1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = (_vectors(b, "v", np.float32) @ planes > 0) @ bits if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(code, pa.int64())], names=["id", "v", "code"])

    coded = table.mapInArrow(project, "id long, v binary, code long")
    starts, block, free = [], -1, 0
    for r in coded.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect():  # at most 2^PLANES rows
        cuts = -(-r["n"] // rows)
        if cuts > 1 or r["n"] > free:
            block, free = block + 1, rows
        starts.append((r["code"], block, cuts))
        block, free = block + cuts - 1, free - r["n"] if cuts == 1 else 0
    first = F.broadcast(table.sparkSession.createDataFrame(starts, "code long, start int, cuts int"))
    return coded.join(first, "code").select("id", "v", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("cuts"))).cast("int").alias("block"))


def _by_block(left: DataFrame, right: DataFrame, blocks: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Both sides of each block in one call, with of_ before the names of the right one; repartition() by a number isn't coalesced by size, as the work isn't in the bytes."""
    tasks = max(1, min(2 * blocks, 64 * left.sparkSession.sparkContext.defaultParallelism))
    right = right.select(*[F.col(c).alias(f"of_{c}") for c in right.columns])
    return left.repartition(tasks, "block").groupBy("block").cogroup(right.repartition(tasks, "of_block").groupBy("of_block")).applyInArrow(run, schema)


def _cut(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest different neighbours of each id among pairs (id, nbr_id, dist), in order."""
    of, to, dist = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((dist, to, of))
    of, to, dist = of[order], to[order], dist[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (to[1:] != to[:-1])
    of, to, dist = of[new], to[new], dist[new]
    order = np.lexsort((to, dist, of))
    of, to, dist = of[order], to[order], dist[order]
    near = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[near], to[near], dist[near]


def _round(graph: DataFrame, table: DataFrame, k: int, blocks: int, seed: int) -> DataFrame:
    """Pairs (id, nbr_id, dist) that improve id's list, from meetings in the lists of others.

    A row lets its k neighbours and at most k of the rows that have it as a neighbour meet, picked by hash; rows of which many
    have it as a neighbour are so met by some of them in each round. Of two that were in the list before, and met then,
    no pair is made, and rows with such members only have no meeting.
    """
    worst = graph.groupBy("id").agg(F.max("dist").alias("far"), F.count("*").alias("many")).withColumn("far", F.when(F.col("many") >= k, F.col("far")).otherwise(F.lit(float("inf")))).drop("many")
    forward = graph.select(F.col("id").alias("at"), F.col("nbr_id").alias("member"), "old")
    back = graph.select(F.col("nbr_id").alias("at"), F.col("id").alias("member"), "old")
    some = F.row_number().over(Window.partitionBy("at").orderBy(F.xxhash64("member", "at", F.lit(seed))))
    back = back.withColumn("r", some).where(F.col("r") <= k).drop("r")
    met = forward.union(back).groupBy("at").agg(F.collect_list(F.struct("member", "old")).alias("m")).where(F.exists("m", lambda s: ~s["old"]))  # at most 2 k
    seats = met.join(table.select(F.col("id").alias("at"), "block").hint("merge"), "at").select("block", "at", F.explode("m").alias("m")).select("block", "at", "m.member", "m.old")
    rows = table.join(worst.hint("merge"), "id", "left").select(F.col("id").alias("member"), "v", F.coalesce("far", F.lit(float("inf"))).alias("far"))
    needed = seats.select("block", "member").distinct().join(rows.hint("merge"), "member").select("block", "member", "v", "far")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        if a.num_rows:
            ids = b.column("of_member").to_numpy()
            order = np.argsort(ids)
            ids, far, x = ids[order], b.column("of_far").to_numpy()[order], _vectors(b, "of_v", np.float32)[order]
            at, member, old = (a.column(c).to_numpy(zero_copy_only=False) for c in ("at", "member", "old"))
            order = np.lexsort((old, member, at))  # of two seats the one that isn't old
            at, member, old = at[order], np.searchsorted(ids, member[order]), old[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (member[1:] != member[:-1])
            at, member, old = at[new], member[new], old[new]
            starts = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at))
            wide = int(np.diff(starts).max())
            for i in range(0, len(starts) - 1, 128):
                edges = starts[i : i + 129]
                own = slice(edges[0], edges[-1])
                row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                col = np.arange(edges[0], edges[-1]) - edges[row]
                p, seen, there = np.zeros((len(edges) - 1, wide), np.int64), np.ones((len(edges) - 1, wide), bool), np.zeros((len(edges) - 1, wide), bool)
                p[row, col], seen[row, col], there[row, col] = member[own], old[own], True
                v = x[p].astype(float)
                square = (v * v).sum(2)
                d = np.sqrt(np.maximum(square[:, :, None] + square[:, None] - 2 * v @ v.transpose(0, 2, 1), 0))
                wanted = (d < far[p][:, :, None]) & there[:, :, None] & there[:, None] & ~(seen[:, :, None] & seen[:, None]) & (p[:, :, None] != p[:, None])
                g, m, o = np.nonzero(wanted)
                held.append((ids[p[g, m]], ids[p[g, o]], d[g, m, o]))
                size += len(g)
                if size > HELD:
                    held = [_cut(held, k)]
                    size = len(held[0][0])
        return pa.table(dict(zip(("id", "nbr_id", "dist"), _cut(held, k))))

    return _by_block(seats, needed, blocks, meet, _GRAPH)


def nearest(points: DataFrame, k: int, rounds: int = 12, least_change: float = 0.002, slack: int | None = None, seed: int = 0) -> DataFrame:
    """(id, nbr_id, rank, dist): about the k nearest other rows of each row of (id long, features) by Euclidean distance.

    Lists are longer than k while rounds go on (by `slack`, the larger of 20 and k by default: longer ones find more), until less
    than `least_change` of their places change. Distances are exact; ties of distance go to the smaller id. Ids must differ; vectors have one length, rows
    without a vector are left out. Fewer than k + 1 rows give shorter lists, and one row or none gives no list.
    """
    spark, folder = points.sparkSession, work_folder(points, "descent")
    thin = points.where(F.col("features").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("f"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("f")
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([v.tobytes() for v in values], pa.binary())], names=["id", "v"])

    thin.mapInArrow(pack, "id long, v binary").write.parquet(f"{folder}/vectors")
    whole = spark.read.schema("id long, v binary").parquet(f"{folder}/vectors")
    names = itertools.count()

    def written(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(names)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _vectors(b, "v")
                x = x[np.isfinite(x).all(1)]
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "good": [len(x)], "top": [float(np.abs(x).max(initial=0))], "s": [x.sum(0).tolist()]})

    parts = whole.mapInArrow(sums, "n long, good long, top double, s array<double>").select("n", "good", "top", F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.max("top").alias("top"), F.sum("s").alias("s")).orderBy("i").collect()  # a row a dimension
    n, width = parts[0]["n"] if parts else 0, len(parts)
    if n < 2:
        return spark.createDataFrame([], "id long, nbr_id long, rank int, dist double")
    mean, scale = np.array([r["s"] for r in parts]) / max(parts[0]["good"], 1), parts[0]["top"] or 1.0

    def thin_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = ((_vectors(b, "v") - mean) / scale).astype(np.float32) if b.num_rows else np.zeros((0, width), np.float32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "v"])

    more = k + (max(20, k) if slack is None else slack)
    rows = max(64, min(SEAT_ROWS, SEAT_BYTES // (8 * more * width), -(-n // (2 * spark.sparkContext.defaultParallelism))))
    table = written(_placed(whole.mapInArrow(thin_out, "id long, v binary"), rows, n, width, seed))
    blocks = -(-n // rows)
    seeds = None
    for tree in range(TREES):
        one = _seeds(table.select("id", "v"), more, width, n, tree, seed)
        seeds = one if seeds is None else seeds.union(one)
    graph = written(_top(seeds.withColumn("old", F.lit(False)), more))
    for r in range(rounds):
        found = _round(graph, table, more, blocks, seed + r)
        graph = written(_top(graph.select("id", "nbr_id", "dist", F.lit(True).alias("old")).union(found.withColumn("old", F.lit(False))), more))
        if graph.where("NOT old").count() <= least_change * more * n:
            break
    return _exact(graph, whole, table.select("id", "block"), k, blocks)


def _exact(graph: DataFrame, whole: DataFrame, places: DataFrame, k: int, blocks: int) -> DataFrame:
    """The k nearest of each list by differences of the vectors as they were given, in place of the rounds' rounded distances.

    What may be among them by the error of single precision is measured.
    """
    edge = F.max(F.when(F.col("rank") <= k, F.col("dist"))).over(Window.partitionBy("id"))
    near = graph.withColumn("edge", edge).where(F.col("dist") <= F.col("edge") * (1 + 1e-4) + 1e-6)
    pairs = near.select("id", "nbr_id").join(places.hint("merge"), "id").select("block", "id", "nbr_id")
    needed = pairs.select("block", F.explode(F.array("id", "nbr_id")).alias("member")).distinct().join(whole.withColumnRenamed("id", "member").hint("merge"), "member").select("block", "member", "v")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        of, to, member = _ids(a, "id"), _ids(a, "nbr_id"), _ids(b, "of_member")
        dist = np.zeros(len(of))
        if len(of):
            order = np.argsort(member)
            x, member = _vectors(b, "of_v")[order], member[order]
            p, q = np.searchsorted(member, of), np.searchsorted(member, to)
            for i in range(0, len(of), 65_536):
                dist[i : i + 65_536] = np.sqrt(((x[p[i : i + 65_536]] - x[q[i : i + 65_536]]) ** 2).sum(1))
        of, to, dist = _cut([(of, to, dist)], k)
        return pa.table({"id": of, "nbr_id": to, "rank": pa.array(np.arange(len(of)) - np.searchsorted(of, of) + 1, pa.int32()), "dist": dist})

    return _by_block(pairs, needed, blocks, run, "id long, nbr_id long, rank int, dist double")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the share of exact neighbours among those found; a neighbour as near as the exact one of the last rank counts."""
    edge = exact.groupBy("id").agg(F.max("dist").alias("edge"), F.count("*").alias("n"))
    hit = found.join(edge, "id").groupBy("id").agg(F.least(F.count_if(F.col("dist") <= F.col("edge") * (1 + 1e-12)), F.max("n")).alias("hits"))
    return edge.join(hit, "id", "left").agg((F.sum(F.coalesce("hits", F.lit(0))) / F.sum("n")).alias("recall"))
