"""Density: kernel sums, sampling weights, grids, thresholds and small bins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import kernels
from meridia.functions.geo import EARTH_KM, haversine_km, in_boxes
from meridia.operators import sums
from meridia.operators.summary import capped, quantiles
from meridia.sources.folders import work_folder

#: Kernel sums leave out points at which the gaussian is below exp(-36), or 2.4e-16.
CUT = 8.5


def kernel_sums(points: DataFrame, bandwidth: float = 0.03) -> DataFrame:
    """(id, density): the sum of exp(-d^2 / 2h^2) over all points, itself included, with d the central angle in radians.

    Only places within CUT bandwidths meet, in blocks, and each place comes once with its count; n points left
    out add less than n * 2.4e-16, which is below the rounding of a sum of n terms near 1. The rows are written, so
    that several uses of them compute the sums once.
    """
    p = points.where("x is not null and y is not null").withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double"))
    places = p.groupBy("x", "y").agg(F.count("*").alias("c"))
    found = sums.gaussian_on_globe(places, bandwidth, min(CUT * bandwidth, math.pi))
    out, folder = p.join(found.hint("merge"), ["x", "y"]).select("id", "density"), work_folder(p, "kernel")
    out.write.parquet(folder)
    return p.sparkSession.read.schema(out.schema).parquet(folder)


def kde_weights(kernel: DataFrame, power: float = 1.0, share: float = 0.95) -> DataFrame:
    """(id, weight): 1 / (density + 1e-5)^power, capped at a percentile."""
    w = kernel.select("id", (1.0 / F.pow(F.col("density") + 1e-5, F.lit(power))).alias("weight"))
    folder = work_folder(w, "weights")
    w.write.parquet(folder)  # the sums are computed once
    return capped(w.sparkSession.read.schema(w.schema).parquet(folder), "weight", share)


def cluster_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """(id, weight): 1 / (size of the cluster + 1e-5)."""
    sizes = labels.groupBy(label).agg(F.count("*").alias("n"))
    return labels.join(sizes, label).select("id", (1.0 / (F.col("n") + 1e-5)).alias("weight"))


def dbscan_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """Weights 1 / (size + 1e-5) scaled to 1..10; noise (label -1) gets the mean of the others."""
    sizes = labels.where(F.col(label) != -1).groupBy(label).agg(F.count("*").alias("n")).withColumn("w", 1.0 / (F.col("n") + 1e-5))
    ends = sizes.agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.sum(F.col("w") * F.col("n")).alias("s"), F.sum("n").alias("c"))
    span = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    scale = lambda w: F.coalesce(1 + 9 * (w - F.col("lo")) / span, F.lit(1.0))
    return labels.join(sizes, label, "left").crossJoin(F.broadcast(ends)).select("id", F.when(F.col("w").isNull(), scale(F.col("s") / F.col("c"))).otherwise(scale(F.col("w"))).alias("weight"))


def combined_weights(points: DataFrame, parts: list[DataFrame], boxes: list[tuple[float, float, float, float]] = (), scale: bool = False) -> DataFrame:
    """(id, weight): the product of the parts' weights, doubled for each focus box around the point; optionally scaled to 1..10."""
    out = points.select("id", F.pow(F.lit(2.0), in_boxes(F.col("x"), F.col("y"), list(boxes)).cast("double")).alias("weight"))
    for p in parts:
        out = out.join(p.withColumnRenamed("weight", "__w").hint("merge"), "id").select("id", (F.col("weight") * F.col("__w")).alias("weight"))
    if scale:
        ends = out.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
        out = out.crossJoin(F.broadcast(ends)).select("id", (1 + 9 * (F.col("weight") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("weight"))
    return out


def grid_density(points: DataFrame, cells: int = 100, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """(i, j, gx, gy, density) of a gaussian kernel estimate with Scott's factor on cells x cells places of the bounding box.

    With `weight`, points count by it, and Scott's factor takes the effective number of points (sum of weights squared over
    the sum of their squares). The places are a stated query set, held against all points: each task adds up its points for all places of a
    group as one product of two matrices after a change of axes, and gives a row for each place.
    """
    by = list(by)
    p = points.where("x is not null and y is not null").select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w")).where("w > 0")
    mean = lambda v: F.sum(F.col("w") * v) / F.sum("w")
    s = p.groupBy(*by).agg(F.sum("w").alias("n"), (F.sum("w") ** 2 / F.sum(F.col("w") ** 2)).alias("eff"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), mean(F.col("x")).alias("mx"), mean(F.col("y")).alias("my"))
    centred = p.join(F.broadcast(s) if not by else s, by) if by else p.crossJoin(F.broadcast(s))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    free = 1 - 1 / F.first("eff")  # of the unbiased covariance of weighted points
    v = centred.groupBy(*by).agg((mean(dx * dx) / free).alias("vx"), (mean(dy * dy) / free).alias("vy"), (mean(dx * dy) / free).alias("cv"))
    law = (s.join(v, by) if by else s.crossJoin(F.broadcast(v))).withColumn("f", F.pow("eff", F.lit(-1 / 6)) ** 2).withColumn("det", (F.col("vx") * F.col("vy") - F.col("cv") * F.col("cv")) * F.col("f") * F.col("f")).where(F.col("det") > 1e-9 * F.col("vx") * F.col("vy") * F.col("f") * F.col("f"))
    names = ["x0", "x1", "y0", "y1", "vx", "vy", "cv", "f", "det", "n"]
    # a place counts once with its weight; the work of a row isn't in its bytes, so tasks are given by number
    places = p if by else p.groupBy("x", "y").agg(F.sum("w").alias("w")).repartition(4 * points.sparkSession.sparkContext.defaultParallelism)
    rows = places.join(law.select(*by, *names), by) if by else places.crossJoin(F.broadcast(law.select(*names)))
    kinds = "".join(f"`{c}` {points.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{kinds}i int, j int, gx double, gy double, density double"

    def partial(batches):  # noqa: ANN001, ANN202
        held: dict[tuple, list] = {}
        for b in batches:
            for key, g in b.groupby(by, dropna=False, sort=False) if by else [((), b)]:
                key = key if isinstance(key, tuple) else (key,)
                x0, x1, y0, y1, vx, vy, cv, f, det, n = (float(g[c].iloc[0]) for c in names)
                gx, gy = (a + (z - a) * np.arange(cells) / (cells - 1) for a, z in ((x0, x1), (y0, y1)))
                if key not in held:
                    held[key] = [gx, gy, np.zeros((cells, cells))]
                for at in range(0, len(g), 256):
                    x, y, w = (g[c].to_numpy()[at : at + 256] for c in ("x", "y", "w"))
                    u, t = gx[:, None] - x, gy[:, None] - y
                    q = vy * f / det * (u * u)[:, None, :] - 2 * cv * f / det * u[:, None, :] * t[None] + vx * f / det * (t * t)[None]
                    held[key][2] += np.exp(-q / 2) @ (w / (2 * math.pi * math.sqrt(det) * n))
        i, j = (a.ravel() for a in np.meshgrid(np.arange(cells), np.arange(cells), indexing="ij"))
        for key, (gx, gy, total) in held.items():
            yield pd.DataFrame({**{c: [k] * len(i) for c, k in zip(by, key)}, "i": i, "j": j, "gx": gx[i], "gy": gy[j], "density": total.ravel()})

    return rows.mapInPandas(partial, schema).groupBy(*by, "i", "j").agg(F.first("gx").alias("gx"), F.first("gy").alias("gy"), F.sum("density").alias("density"))


def levels(grid: DataFrame, shares: list[float], by: list[str] = ()) -> DataFrame:
    """(share, level): the density at which the running sum over ascending densities reaches a share of the total."""
    by = list(by)
    w = Window.partitionBy(*by)
    run = grid.withColumn("c", F.sum("density").over(w.orderBy("density").rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.sum("density").over(w))
    return run.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).where(F.col("c") >= F.col("share") * F.col("t")).groupBy(*by, "share").agg(F.min("density").alias("level"))


def digitize(df: DataFrame, value: str, thresholds: list[float], name: str = "bin") -> DataFrame:
    """`bin`: how many of the thresholds are at or below the value."""
    return df.withColumn(name, F.aggregate(F.array(*[F.lit(float(t)) for t in thresholds]), F.lit(0), lambda s, t: s + (F.col(value) >= t).cast("int")))


def quantile_thresholds(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(i, threshold): the quantiles i / bins for i = 1 .. bins - 1."""
    q = quantiles(df, value, [i / bins for i in range(1, bins)])
    return df.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(q) if x is not None], "i int, threshold double")


def jenks_thresholds(df: DataFrame, value: str, classes: int) -> list[float]:
    """Natural breaks over all different values and their counts, which come to the driver."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    rows = v.groupBy("v").agg(F.count("*").alias("n")).toPandas().sort_values("v")
    return kernels.jenks(rows["v"].to_numpy(), rows["n"].to_numpy(), classes) if len(rows) else []


def to_cell(points: DataFrame, cells: int = 100) -> DataFrame:
    """`i`, `j` of the grid place at or before each point in the bounding box of all."""
    ends = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda c: F.floor((F.col(c) - F.col(f"{c}0")) * (cells - 1) / F.nullif(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(0.0))).cast("int")
    return points.crossJoin(F.broadcast(ends)).withColumn("i", at("x")).withColumn("j", at("y")).drop("x0", "x1", "y0", "y1")


def bin_centers(grid: DataFrame, thresholds: list[float]) -> DataFrame:
    """(bin, cx, cy): the mean place of the grid's places of each interval of densities."""
    return digitize(grid, "density", thresholds).groupBy("bin").agg(F.avg("gx").alias("cx"), F.avg("gy").alias("cy"))


def kde_bins(points: DataFrame, bins: int, weight: str | None = None, cells: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """All columns and `bin` of the points, and the bins' centers: by natural breaks of the density where a point stands.

    Bins with at most `most` points go to the nearest larger one, then those of one point. Points without coordinates have a
    null bin. ValueError if there is one bin only.
    """
    grid = grid_density(points, cells, weight=weight)
    thresholds = jenks_thresholds(grid, "density", bins)[1:-1]  # between classes
    own = to_cell(points, cells).join(grid.select("i", "j", "density"), ["i", "j"], "left")
    placed = digitize(own, "density", thresholds).drop("i", "j", "density")
    if placed.select("bin").where("bin is not null").distinct().count() < 2:
        raise ValueError("only one bin is found by densities")
    return merge_small_bins(merge_small_bins(placed, most), 1), bin_centers(grid, thresholds)


def threshold_clusters(points: DataFrame, kernel: DataFrame, percentiles: range = range(5, 90, 5)) -> DataFrame:
    """(percentile, threshold, silhouette) of points split at each percentile of their density, the best first.

    `kernel` is kernel_sums(points). Percentiles that leave one side empty are left out. Distances to all places are the
    definition: they are summed once, by the interval between thresholds in which the other place lies, and serve all splits.
    """
    cuts = quantiles(kernel, "density", [p / 100 for p in percentiles])
    if not cuts or cuts[0] is None:
        return points.sparkSession.createDataFrame([], "percentile int, threshold double, silhouette double")
    level = digitize(points.join(kernel.hint("merge"), "id"), "density", cuts, "kind")
    per = sums.in_plane(level.groupBy("x", "y", "kind").agg(F.count("*").alias("c")), len(cuts) + 1, lambda d: [np.sqrt(d)])
    per, sizes = per.alias("p"), level.groupBy("kind").agg(F.count("*").alias("n"))
    splits = sizes.crossJoin(points.sparkSession.range(len(cuts)).select(F.col("id").cast("int").alias("i"))).groupBy("i").agg(F.coalesce(F.sum(F.when(F.col("kind") > F.col("i"), F.col("n"))), F.lit(0)).alias("high"), F.sum("n").alias("all"))
    total = lambda of: F.aggregate(of, F.lit(0.0), lambda s, v: s + v)
    low, high = total(F.slice("sums", 1, F.col("i") + 1)), total(F.slice("sums", F.col("i") + 2, len(cuts) + 1))
    met = per.crossJoin(F.broadcast(splits)).withColumn("up", F.col("kind") > F.col("i")).withColumn("low", low).withColumn("far", high)  # a row a percentile
    n_own = F.when(F.col("up"), F.col("high")).otherwise(F.col("all") - F.col("high"))
    own, other = F.when(F.col("up"), F.col("far")).otherwise(F.col("low")), F.when(F.col("up"), F.col("low")).otherwise(F.col("far"))
    a, b = F.when(n_own > 1, own / (n_own - 1)), other / F.nullif(F.col("all") - n_own, F.lit(0))
    one = F.when(b.isNotNull(), F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)))
    found = met.groupBy("i").agg((F.sum(one * F.col("c")) / F.sum("c")).alias("silhouette"))
    names = points.sparkSession.createDataFrame([(i, p, float(cut)) for i, (p, cut) in enumerate(zip(percentiles, cuts))], "i int, percentile int, threshold double")
    return names.join(found, "i").where("silhouette is not null").select("percentile", "threshold", "silhouette").orderBy(F.col("silhouette").desc(), "percentile")


def centroids(points: DataFrame, by: str = "bin") -> DataFrame:
    return points.groupBy(by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))


def merge_small_bins(points: DataFrame, most: int = 5, by: str = "bin") -> DataFrame:
    """Bins with at most `most` points go to the bin with the nearest centroid among the larger ones, all at once."""
    c = centroids(points, by)
    small = c.where(F.col("n") <= most).select(F.col(by).alias("old"), F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    large = c.where(F.col("n") > most)
    d = haversine_km(F.col("sx"), F.col("sy"), F.col("cx"), F.col("cy"), 6371.009)
    to = small.crossJoin(large).withColumn("d", d).groupBy("old").agg(F.min_by(by, F.struct("d", by)).alias("new"))
    return points.join(to.withColumnRenamed("old", by), by, "left").withColumn(by, F.coalesce("new", by)).drop("new")


def line_centers(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Midpoints of `bins` equal parts between the extremes of a column."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", "b").select("bin", (F.col("a") + (F.col("bin") + 0.5) * (F.col("b") - F.col("a")) / bins).alias("center"))


def curve(df: DataFrame, value: str, places: int = 150) -> DataFrame:
    """A gaussian kernel curve with Scott's factor at places between the extremes: a fixed query set against all values."""
    s = df.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    h = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grid = s.select(F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("i"), "a", "b", "n", h.alias("h")).withColumn("at", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (places - 1))
    z = (F.col("at") - F.col(value)) / F.col("h")
    return df.where(F.col(value).isNotNull()).select(value).crossJoin(F.broadcast(grid)).groupBy("i", "at").agg(F.sum(F.exp(-z * z / 2) / (F.col("h") * F.col("n") * math.sqrt(2 * math.pi))).alias("density"))


def bandwidth_scores(points: DataFrame, bandwidths: list[float], folds: int = 5) -> DataFrame:
    """(bandwidth, score): the summed log likelihood of held-out points (fold: id modulo folds) under a plane gaussian kernel.

    The kernel reaches all points, so all count: blocks of places meet blocks, and a task gives a row for each place of one block,
    never a row a pair. Points of a fold on one place are one row with their count.
    """
    p = points.where("x is not null and y is not null").select("x", "y", F.pmod("id", F.lit(folds)).cast("int").alias("kind"))
    order = sorted(range(len(bandwidths)), key=lambda i: -bandwidths[i])

    def kernels_of(d: np.ndarray):  # noqa: ANN202
        """From the widest: where a kernel is that before to the power of 2, 4, 8 or 16, by squares instead of exponentials."""
        before, e = None, None
        for i in order:
            h = bandwidths[i]
            turns = math.log2((before / h) ** 2) if before else -1.0
            if turns in (0.0, 1.0, 2.0, 3.0, 4.0):
                for _ in range(int(turns)):
                    e *= e
            else:
                e = np.exp(d * (-1 / (2 * h * h)))
            before = h
            yield e

    per = sums.in_plane(p.groupBy("x", "y", "kind").agg(F.count("*").alias("c")), folds, kernels_of, len(bandwidths))
    size = p.groupBy("kind").agg(F.count("*").alias("own"))
    rows = per.join(F.broadcast(size), "kind").crossJoin(F.broadcast(size.agg(F.sum("own").alias("all"))))  # a row a fold

    def score(i: int, h: float) -> Column:
        others = F.aggregate(F.transform(F.slice("sums", i * folds + 1, folds), lambda v, k: F.when(k != F.col("kind"), v).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
        return F.sum(F.col("c") * F.log(others / (2 * math.pi * h * h * (F.col("all") - F.col("own"))) + 1e-300))

    pairs = F.arrays_zip(F.array(*[F.lit(float(h)) for h in bandwidths]).alias("bandwidth"), F.array(*[f"h{i}" for i in range(len(bandwidths))]).alias("score"))
    return rows.agg(*[score(order.index(i), h).alias(f"h{i}") for i, h in enumerate(bandwidths)]).select(F.explode(pairs).alias("z")).select("z.bandwidth", "z.score")
