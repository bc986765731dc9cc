"""Exact nearest neighbours without a cross join, and what is predicted from them.

Points on the globe are taken by place: of many points on one place only the first k + 1 by id can be neighbours, and all of
them ask the same. Places are cut into cubes of their unit vectors: all places within one edge length lie in the 27 cubes
around a place, so one whose k-th distance is within it is done; the others go on with cubes of four times the edge, until
the cubes hold the globe. Vectors of many dimensions are held against blocks of vectors: each task multiplies its rows with
one block after the other and keeps k candidates a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.geo import haversine_km, inverse_distance, unit_vector
from meridia.operators.summary import quantiles
from meridia.sources.folders import work_folder

NEIGHBOURS = "id long, nbr_id long, rank int, dist double"


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id, ties by id; Spark keeps only k rows a partition before the shuffle of the window."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "nbr_id"))).where(F.col("rank") <= k)


def nearest_on_globe(points: DataFrame, k: int, at_least_km: float = 0.0, with_self: bool = False, first_edge_km: float | None = None, others: DataFrame | None = None) -> DataFrame:
    """(id, nbr_id, rank, dist) of the k nearest of (id, x, y), in km, among `others` (the points themselves by default).

    Neighbours nearer than `at_least_km` are passed over, and the point itself unless `with_self`. Points with a null
    coordinate are left out. Tables here grow with the points, so joins are merges: none of them is broadcast. A point with fewer than k candidates gets those that there are. Rounds are written to the
    shared folder, so no round computes the ones before again.
    """
    spark = points.sparkSession
    clean = lambda df: df.where("x is not null and y is not null").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    asked, folder = clean(points), work_folder(points, "neighbours")
    on_place = Window.partitionBy("x", "y").orderBy("id")

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    base = kept("others", clean(points if others is None else others).withColumn("r", F.row_number().over(on_place)).where(F.col("r") <= k + 1).select(F.col("id").alias("nbr_id"), F.col("x").alias("nx"), F.col("y").alias("ny")))
    n = base.count()
    if not n:
        return spark.createDataFrame([], NEIGHBOURS)
    places = rest = kept("rest-0", asked.select("x", "y").distinct().withColumn("place", F.monotonically_increasing_id()))
    done, step = None, 0
    edge_km = first_edge_km or max(1.0, at_least_km + 6371.0 * math.sqrt(4 * math.pi * (k + 2) / n))
    while True:
        last = edge_km >= 2 * 6371.0 or n * 27 * (edge_km / (2 * 6371.0)) ** 2 > n  # such cubes meet all places anyway
        if last:  # what is left meets all others, dealt over tasks
            parts = max(1, n // 4096)
            left = rest.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            met = left.join(base.withColumn("b", F.pmod(F.xxhash64("nbr_id"), F.lit(parts)).cast("int")).hint("merge"), "b")
        else:
            met = around(rest, edge_km).join(base.select("*", *cube("nx", "ny", edge_km)).hint("merge"), ["cx", "cy", "cz"])
        d = met.select(F.col("place").alias("id"), "nbr_id", haversine_km(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")).alias("dist"))
        d = d if last else d.where(F.col("dist") <= edge_km)  # what is farther isn't complete in the cubes, and would be sorted for nothing
        found = kept(f"found-{step}", _ranked(d.where(F.col("dist") >= at_least_km) if at_least_km > 0 else d, k + 1))
        if last:
            done = found if done is None else done.union(found)
            break
        full = found.groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") >= k + 1).select("id")
        part = found.join(full.hint("merge"), "id", "left_semi")
        done, step, edge_km = part if done is None else done.union(part), step + 1, edge_km * 4
        rest = kept(f"rest-{step}", rest.join(full.withColumnRenamed("id", "place").hint("merge"), "place", "left_anti"))
        if rest.isEmpty():
            break
    own = asked.join(places.hint("merge"), ["x", "y"]).select("id", "place").join(done.select(F.col("id").alias("place"), "nbr_id", "dist").hint("merge"), "place")
    return _ranked(own if with_self else own.where("id <> nbr_id"), k).select("id", "nbr_id", "rank", "dist")


def cube(x: str, y: str, edge_km: float) -> list[Column]:
    """The cube of a place's unit vector, for an edge whose arc is `edge_km`."""
    edge = 2 * math.sin(min(edge_km / 6371.0, math.pi) / 2) * (1 + 1e-9)  # as a chord
    return [F.floor(c / edge).cast("int").alias(n) for c, n in zip(unit_vector(F.col(x), F.col(y)), ("cx", "cy", "cz"))]


def around(df: DataFrame, edge_km: float) -> DataFrame:
    """Each row of (x, y) in its cube and the 26 around it."""
    out = df.select("*", *cube("x", "y", edge_km))
    for c in ("cx", "cy", "cz"):
        out = out.withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("o")).drop("o")
    return out


def near_pairs(left: DataFrame, right: DataFrame, reach_km: float) -> DataFrame:
    """The columns of both with `dist`, for points (x, y) and (nx, ny) within a reach, by cubes of that edge."""
    # a merge, as rows in 27 cubes look small enough to be broadcast
    both = around(left, reach_km).join(right.select("*", *cube("nx", "ny", reach_km)).hint("merge"), ["cx", "cy", "cz"]).drop("cx", "cy", "cz")
    return both.withColumn("dist", haversine_km(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).where(F.col("dist") <= reach_km)


#: Vectors of a block, and the bytes of its features; rows and columns of the pairs held at once.
VECTORS, VECTOR_BYTES = 131_072, 96_000_000
_ROWS, _COLS = 256, 2048


def _matrix(t: pa.Table) -> np.ndarray:
    """The column v, zeros without a sign, so that equal vectors have equal bytes."""
    values = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(t.num_rows, len(values) // t.num_rows) + 0.0


def _first_of_equal(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows without those that have `most` equal ones with smaller ids. Equal rows stand together in an order by a hash."""
    by_id = np.argsort(ids, kind="stable")
    odd = np.random.default_rng(0).integers(0, 2**62, x.shape[1]) * 2 + 1
    order = by_id[np.argsort((x[by_id].view(np.int64) * odd).sum(1), kind="stable")]
    new = np.append(True, (x[order[1:]] != x[order[:-1]]).any(1))
    starts = np.flatnonzero(new)
    return np.sort(order[np.arange(len(x)) - starts[np.cumsum(new) - 1] < most])


def _nearest_in(x: np.ndarray, y: np.ndarray, of: np.ndarray, ids: np.ndarray, m: int, with_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row of y, distance) of the m nearest in y of each row of x, ties by id; all are finite.

    Products in single precision, of vectors about their mean and within the unit ball, tell what may be near: what they put within twice their error
    of the m-th so far is measured by exact differences. Where those are too many, products in double precision choose first.
    """
    width, m = x.shape[1], min(m, len(y))
    centre = y.mean(0)
    scale = max(np.sqrt(((y - centre) ** 2).sum(1).max()), np.sqrt(((x - centre) ** 2).sum(1).max()), 1e-300)

    def sides(rows: np.ndarray) -> np.ndarray:
        return (rows - centre) / scale

    cy = sides(y)
    yy = (cy * cy).sum(1)
    # a product of (-2 x, 1) and (y, y y) is the squared distance less that of x from the mean
    thin = np.column_stack([cy, yy]).astype(np.float32)
    slack32, slack64 = 2.0**-22 * (width + 8), 2.0**-51 * (width + 8)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(x), _ROWS):
        cx = np.column_stack([-2 * sides(x[i : i + _ROWS]), np.ones(len(x[i : i + _ROWS]))])
        left, n = cx.astype(np.float32), len(cx)
        bound = np.full(n, np.inf)
        row, col, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(y), _COLS):
            part = thin[j : j + _COLS]
            d = left @ part.T
            if j == 0 or np.isinf(bound).any():
                top = np.partition(d, m - 1, axis=1)[:, m - 1] if part.shape[0] >= m else np.full(n, np.inf)
                bound = np.minimum(bound, top + 2.0 * slack32)
            hit = d <= np.nextafter(bound.astype(np.float32), np.float32(np.inf))[:, None]
            r, c = np.nonzero(hit) if np.count_nonzero(hit) > hit.size // 64 else _sparse(hit)
            value, slack = d[r, c].astype(float), slack32
            if len(r) > (64 + 4 * m) * n:  # too near for single precision
                d = cx @ np.column_stack([cy[j : j + _COLS], yy[j : j + _COLS]]).T
                top = np.partition(d, m - 1, axis=1)[:, m - 1] if part.shape[0] >= m else np.full(n, np.inf)
                r, c = np.nonzero(d <= np.minimum(bound, top + 2 * slack64)[:, None])
                value, slack = d[r, c], slack32
            row, col, near = np.concatenate([row, r]), np.concatenate([col, c + j]), np.concatenate([near, value])
            if len(row) >= n * m:  # the m-th so far, of those that are held
                order = np.lexsort((near, row))
                row, col, near = row[order], col[order], near[order]
                starts = np.searchsorted(row, np.arange(n))
                ends = np.append(starts[1:], len(row))
                full = ends - starts >= m
                bound[full] = np.minimum(bound[full], near[(starts + m - 1)[full]] + 2 * slack)
                keep = near <= bound[row]
                row, col, near = row[keep], col[keep], near[keep]
        q, exact = row + i, np.zeros(len(row))
        for j in range(0, len(row), 65_536):
            exact[j : j + 65_536] = np.sqrt(((x[q[j : j + 65_536]] - y[col[j : j + 65_536]]) ** 2).sum(1))
        there = np.isfinite(exact) & (with_self | (of[q] != ids[col]))
        q, col, exact = q[there], col[there], exact[there]
        order = np.lexsort((ids[col], exact, q))
        q, col, exact = q[order], col[order], exact[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < m
        out.append((q[first], col[first], exact[first]))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _sparse(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a mask with few true values: words of eight are looked at first."""
    n, wide = hit.shape
    if wide % 8:
        return np.nonzero(hit)
    words = np.flatnonzero(hit.view(np.uint64))
    at, bit = np.nonzero(hit.reshape(-1, 8)[words])
    return np.divmod(words[at] * 8 + bit, wide)


def nearest_vectors(points: DataFrame, k: int, with_self: bool = False, block: int | None = None, others: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """(id, nbr_id, rank, dist) of the k nearest of (id, features) by Euclidean distance, ties by id.

    Both sides are cut into blocks of about `block` vectors: by default at most 131,072 (fewer long ones), and at least 4,096 unless the
    session has more cores than pairs of blocks. A task holds one pair of blocks and gives k candidates a row, so a row is copied
    as often as there are blocks. Of equal vectors of a block only the first k + 1 by id are met. With `within` rows look among
    those with the same value of that column.
    """
    base = points if others is None else others
    cores = points.sparkSession.sparkContext.defaultParallelism
    size = base.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width")).head()
    n = size["n"]
    if not n:
        return points.sparkSession.createDataFrame([], NEIGHBOURS)
    most = max(256, min(VECTORS, VECTOR_BYTES // (8 * max(size["width"] or 1, 1)))) if block is None else block
    cuts = lambda rows: max(1, -(-rows // most), min(-(-rows // 4096), math.isqrt(8 * cores) + 1) if block is None else 1)
    parts = cuts(n)
    asking = parts if others is None else cuts(points.count())
    kind = F.lit("") if within is None else F.coalesce(F.col(within).cast("string"), F.lit("null"))
    cut = lambda df, own, number, other, every: df.where(F.col("features").isNotNull()).select(F.col("id").alias("id"), F.col("features").cast("array<double>").alias("v"), kind.alias("g"), F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(every - 1))).alias(other))
    left, right = cut(points, "b", asking, "o", parts), cut(base, "o", parts, "b", asking)
    m = k if with_self else k + 1

    def top(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if a.num_rows and b.num_rows:
            x, y, of, ids = _matrix(a), _matrix(b), a.column("id").to_numpy(), b.column("id").to_numpy()
            good, whole = np.isfinite(x).all(1), np.isfinite(y).all(1)
            x, of, y, ids = x[good], of[good], y[whole], ids[whole]
            if len(x) and len(y):
                some = _first_of_equal(y, ids, m)
                y, ids = y[some], ids[some]
                q, t, d = _nearest_in(x, y, of, ids, m, with_self)
                found = [of[q], ids[t], d]
        return pa.table({"id": pa.array(found[0], pa.int64()), "nbr_id": pa.array(found[1], pa.int64()), "dist": found[2]})

    tasks = max(1, min(4 * parts * asking, 16 * cores))  # repartition() by a number isn't coalesced by size, as the work isn't in the bytes
    keys = ["g", "b", "o"]
    deal = lambda df: df.repartition(tasks, *keys).groupBy(*keys)
    pairs = deal(left).cogroup(deal(right)).applyInArrow(top, "id long, nbr_id long, dist double")
    return _ranked(pairs, k).select("id", "nbr_id", "rank", "dist")


def weighted_prediction(knn: DataFrame, values: DataFrame, columns: list[str], power: float = 2.0, by: list[str] = ()) -> DataFrame:
    """Per id the mean of the neighbours' columns by inverse distance."""
    w = knn.withColumn("w", inverse_distance(F.col("dist"), power))
    joined = w.join(values.select(F.col("id").alias("nbr_id"), *columns).hint("merge"), "nbr_id")
    return joined.groupBy(*by, "id").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"pred_{c}") for c in columns])


def sweep_k(knn: DataFrame, values: DataFrame, truth: DataFrame, statistic: Column, columns: list[str], least: int, most: int, power: float = 2.0) -> DataFrame:
    """(k, total): the sum of a statistic of prediction and truth over all ids, for each k, from one table of ranks.

    A neighbour of rank r counts for all k from r on: running sums over ranks replace a search for each k.
    """
    w = knn.where(F.col("rank") <= most).withColumn("w", inverse_distance(F.col("dist"), power)).join(values.select(F.col("id").alias("nbr_id"), *columns).hint("merge"), "nbr_id")
    upto = Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = w.select("id", F.col("rank").alias("k"), *[(F.sum(F.col("w") * F.col(c)).over(upto) / F.sum("w").over(upto)).alias(f"pred_{c}") for c in columns])
    return run.where(F.col("k").between(least, most)).join(truth.hint("merge"), "id").withColumn("d", statistic).groupBy("k").agg(F.sum("d").alias("total"))


def kth_distance(knn: DataFrame, k: int, share: float = 0.95) -> DataFrame:
    """The percentile of the k-th neighbours' distances: a radius for density clustering."""
    q = quantiles(knn.where(F.col("rank") == k), "dist", [share])
    return knn.sparkSession.createDataFrame([(q[0],)], "eps double")


def nearest_label(asked: DataFrame, labelled: DataFrame, label: str) -> DataFrame:
    """(id, label) of the nearest labelled point on the globe."""
    one = nearest_on_globe(asked, 1, with_self=True, others=labelled)
    return one.join(labelled.select(F.col("id").alias("nbr_id"), label), "nbr_id").select("id", label)


def mean_distance(knn: DataFrame) -> DataFrame:
    """The mean of the points' mean distances to their neighbours."""
    return knn.groupBy("id").agg(F.avg("dist").alias("m")).agg(F.avg("m").alias("bandwidth"))


def within(points: DataFrame, radius_km: float) -> DataFrame:
    """Pairs (a, b), a < b, of points within a radius, by cubes of that edge."""
    p = points.where("x is not null and y is not null")
    left, right = p.select(F.col("id").alias("a"), "x", "y"), p.select(F.col("id").alias("b"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return near_pairs(left, right, radius_km).where("a < b").select("a", "b", "dist")
