"""Tables behind maps: variograms, kriging surfaces, regressions on density, hulls and clips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import kernels
from meridia.functions.geo import haversine_km, in_ring
from meridia.operators.neighbors import near_pairs, nearest_on_globe
from meridia.sources.folders import work_folder


def variogram(points: DataFrame, value: str, lag_km: float, lags: int) -> DataFrame:
    """(lag, n, gamma): half the mean squared difference of pairs by distance, up to lags * lag_km.

    Pairs within the reach meet by cubes of that edge and are summed where they meet. Points on one place are one row with their count,
    mean and squares about it, of which the sums over pairs of points follow; where ids are repeated, whose rows are no pairs, points
    meet one by one.
    """
    p = points.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(value).isNotNull()).select("id", "x", "y", F.col(value).cast("double").alias("z"))
    reach, lag = lag_km * lags, F.floor(F.col("dist") / lag_km).cast("int").alias("lag")
    if not p.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        right = p.select(F.col("id").alias("id2"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("z2"))
        pairs = near_pairs(p, right, reach).where((F.col("id") < F.col("id2")) & (F.col("dist") < reach))
        return pairs.groupBy(lag).agg(F.count("*").alias("n"), F.avg(0.5 * (F.col("z") - F.col("z2")) ** 2).alias("gamma"))
    found = p.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("c"), F.avg("z").alias("m"), (F.var_pop("z") * F.count("*")).alias("s"))
    folder = work_folder(points, "variogram")
    found.write.parquet(folder)
    places = points.sparkSession.read.schema(found.schema).parquet(folder)
    right = places.select(F.col("id").alias("id2"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("c").alias("c2"), F.col("m").alias("m2"), F.col("s").alias("s2"))
    met = near_pairs(places, right, reach).where((F.col("id") < F.col("id2")) & (F.col("dist") < reach))
    c, c2 = F.col("c"), F.col("c2")
    across = met.groupBy(lag).agg(F.sum(c * c2).alias("n"), F.sum(c * c2 * (F.col("m") - F.col("m2")) ** 2 + c * F.col("s2") + c2 * F.col("s")).alias("g"))
    alike = places.where("c > 1").withColumn("dist", haversine_km(F.col("x"), F.col("y"), F.col("x"), F.col("y"))).where(F.col("dist") < reach)
    within = alike.groupBy(lag).agg(F.sum((c * (c - 1) / 2).cast("long")).alias("n"), F.sum(c * F.col("s")).alias("g"))
    return across.union(within).groupBy("lag").agg(F.sum("n").alias("n"), (0.5 * F.sum("g") / F.sum("n")).alias("gamma"))


def cubic_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """b0..b3 of least squares on x, x^2, x^3 from one aggregation of power sums, and Pearson's r of x and y with its p-value."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = d.agg(F.count("*").alias("n"), *[F.sum(F.pow("x", F.lit(float(k)))).alias(f"s{k}") for k in range(7)], *[F.sum(F.pow("x", F.lit(float(k))) * F.col("y")).alias(f"t{k}") for k in range(4)], F.corr("x", "y").alias("r")).head()
    if s["n"] < 4:
        return df.sparkSession.createDataFrame([], "b0 double, b1 double, b2 double, b3 double, r double, p double")
    a = np.array([[s[f"s{i + j}"] for j in range(4)] for i in range(4)])
    b = np.linalg.lstsq(a, np.array([s[f"t{i}"] for i in range(4)]), rcond=None)[0]
    row = [*map(float, b), float(s["r"]) if s["r"] is not None else None, kernels.correlation_p(s["r"], s["n"])]
    return df.sparkSession.createDataFrame([row], "b0 double, b1 double, b2 double, b3 double, r double, p double")


def optimal_density(df: DataFrame, x: str, y: str, places: int = 1000) -> DataFrame:
    """(density, error): the knee of the cubic curve of y on x, at evenly spread places between the extremes of x.

    The curve is taken as falling and convex: the knee is the first place inside at which 1 - y - x, both scaled to 0 .. 1, has a
    local maximum from which it comes down by more than a step later. No such place, fewer than four rows or a flat curve: no row.
    """
    fitted = cubic_regression(df, x, y)
    ends = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    grid = df.sparkSession.range(places).select("id").crossJoin(F.broadcast(fitted)).crossJoin(F.broadcast(ends))  # a row each
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("id") / (places - 1)
    curve = grid.select("id", at.alias("x"), *(f"b{k}" for k in range(4))).select("id", "x", sum((F.col(f"b{k}") * F.pow("x", F.lit(float(k))) for k in range(1, 4)), F.col("b0")).alias("y"))
    flat = curve.agg(F.min("y").alias("low"), F.max("y").alias("high"))
    gap = 1 - (F.col("y") - F.col("low")) / (F.col("high") - F.col("low")) - F.col("id") / (places - 1)
    d = curve.crossJoin(F.broadcast(flat)).where("high > low").select("id", "x", "y", gap.alias("d"))
    w = Window.orderBy("id")  # over `places` rows
    later = F.min("d").over(w.rowsBetween(1, Window.unboundedFollowing))
    tops = d.select("*", F.lag("d").over(w).alias("before"), F.lead("d").over(w).alias("after"), later.alias("later"))
    found = tops.where((F.col("d") >= F.col("before")) & (F.col("d") >= F.col("after")) & (F.col("later") < F.col("d") - 1 / (places - 1)))
    return found.orderBy("id").limit(1).select(F.col("x").alias("density"), F.col("y").alias("error"))


def fit_variogram(table: DataFrame, lag_km: float) -> tuple[float, float, float]:
    """Nugget, sill and range (km) of a gaussian variogram, by least squares over the lags of variogram(), weighted by pairs.

    For each of 60 ranges the best nugget and sill follow from two sums; neither is negative. Without pairs: 0, 1 and a lag.
    """
    rows = table.where("lag is not null").orderBy("lag").collect()  # a row a lag
    if not rows:
        return 0.0, 1.0, lag_km
    d, g, w = (np.array([float(f(r)) for r in rows]) for f in (lambda r: (r["lag"] + 0.5) * lag_km, lambda r: r["gamma"], lambda r: r["n"]))
    best = (np.inf, 0.0, 1.0, lag_km)
    for reach in np.linspace(lag_km / 2, 2 * (d[-1] + lag_km), 60):
        s = 1 - np.exp(-((d / (reach * 4 / 7)) ** 2))
        a = np.column_stack([np.ones(len(d)), s]) * np.sqrt(w)[:, None]
        c = np.linalg.lstsq(a, g * np.sqrt(w), rcond=None)[0]
        if c.min() < 0:
            options = [(0.0, max(0.0, float((w * s * g).sum() / max((w * s * s).sum(), 1e-300)))), (max(0.0, float((w * g).sum() / w.sum())), 0.0)]
            c = min(options, key=lambda o: float((w * (o[0] + o[1] * s - g) ** 2).sum()))
        error = float((w * (c[0] + c[1] * s - g) ** 2).sum())
        if error < best[0] * (1 - 1e-9):
            best = (error, float(c[0]), float(c[0] + c[1]), float(reach))
    return best[1], max(best[2], 1e-12), best[3]


def kriging_surface(points: DataFrame, value: str, cells: int = 100, buffer: float = 0.1, neighbours: int = 32, lag_km: float = 100.0, lags: int = 10) -> DataFrame:
    """(gx, gy, estimate, variance) on a grid over the bounding box and a buffer, by ordinary kriging with a fitted gaussian variogram.

    Each place is estimated from its `neighbours` nearest points, whatever their number in all: a small system a place, solved
    on the executors. Points on one spot count as their mean; points with a null are left out.
    """
    spark, folder = points.sparkSession, work_folder(points, "kriging")
    p = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(value).isNotNull()).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(value).cast("double").alias("z"))
    p.groupBy("x", "y").agg(F.avg("z").alias("z")).withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{folder}/spots")
    spots = spark.read.schema("x double, y double, z double, id long").parquet(f"{folder}/spots")
    ends = spots.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).head()
    schema = "gx double, gy double, estimate double, variance double"
    if not ends["n"]:
        return spark.createDataFrame([], schema)
    nugget, sill, reach = fit_variogram(variogram(spots, "z", lag_km, lags), lag_km)
    bx, by = (ends["x1"] - ends["x0"]) * buffer, (ends["y1"] - ends["y0"]) * buffer
    step = lambda i, low, high: F.lit(low) + F.lit(high - low) * i / max(1, cells - 1)
    grid = spark.range(cells * cells).select("id", step(F.floor(F.col("id") / cells), ends["x0"] - bx, ends["x1"] + bx).alias("x"), step(F.col("id") % cells, ends["y0"] - by, ends["y1"] + by).alias("y"))
    knn = nearest_on_globe(grid, min(neighbours, ends["n"]), with_self=True, others=spots)
    near = knn.join(spots.select(F.col("id").alias("nbr_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), "z"), "nbr_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "nx", "ny", "z"))).alias("near"))
    flat = near.join(grid, "id").select("x", "y", "near.nx", "near.ny", "near.z")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for _, own in b.groupby(b["z"].map(len)):  # one number of neighbours, but for copies of a place
                for i in range(0, len(own), 256):
                    part = own.iloc[i : i + 256]
                    near = np.stack([np.stack(part["nx"].to_numpy()), np.stack(part["ny"].to_numpy())], axis=-1)
                    at = part[["x", "y"]].to_numpy(float)
                    e, v = kernels.krige(near, np.stack(part["z"].to_numpy()), at[:, None], sill, reach, nugget)
                    yield pd.DataFrame({"gx": at[:, 0], "gy": at[:, 1], "estimate": e[:, 0], "variance": np.maximum(v[:, 0], 0.0)})  # 0 may be off by rounding

    return flat.mapInPandas(run, schema)


def convex_hull(points: DataFrame, by: str) -> DataFrame:
    """(group, i, x, y): corners of each group's hull, from the smallest (x, y) on, against the clock; a place where it turns by less than 1e-9 isn't one.

    Each task reduces its points first, so no group is gathered whole.
    """

    def hull(p: np.ndarray) -> np.ndarray:
        p = np.unique(p, axis=0)
        if len(p) < 3:
            return p

        def turn(o, a, b):  # noqa: ANN001, ANN202
            u, v = a - o, b - o
            return (u[0] * v[1] - u[1] * v[0]) / (np.hypot(*u) * np.hypot(*v))

        def half(q):  # noqa: ANN001, ANN202
            out = []
            for a in q:
                while len(out) > 1 and turn(out[-2], out[-1], a) <= 1e-9:
                    out.pop()
                out.append(a)
            return out[:-1]

        return np.array(half(p) + half(p[::-1]))

    kind = points.schema[by].dataType.simpleString()

    def partial(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for k, g in b.groupby(by, dropna=False):
                h = hull(g[["x", "y"]].to_numpy())
                yield pd.DataFrame({by: k, "x": h[:, 0], "y": h[:, 1]})

    def final(key, g):  # noqa: ANN001, ANN202
        h = hull(g[["x", "y"]].to_numpy())
        return pd.DataFrame({by: key[0], "i": range(len(h)), "x": h[:, 0], "y": h[:, 1]})

    thin = points.where("x is not null and y is not null").select(by, F.col("x").cast("double"), F.col("y").cast("double"))
    return thin.mapInPandas(partial, f"`{by}` {kind}, x double, y double").groupBy(by).applyInPandas(final, f"`{by}` {kind}, i int, x double, y double")


def clip(points: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Points in any of the polygons."""
    inside = F.lit(False)
    for r in rings:
        inside = inside | in_ring(F.col("x"), F.col("y"), r)
    return points.where(inside)


def in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """All columns of `points` with statefp and name of each region around them; a point on a hole's inside is not in the region.

    Points and regions meet by cells of one degree of the regions' bounding boxes, and rays decide: corners are compared
    where they are stored, so regions may be many. A point in two parts of one region comes once.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    cells = lambda v: F.sequence(F.floor(F.array_min(v)).cast("int"), F.floor(F.array_max(v)).cast("int"))
    boxes = regions.where(F.size("ring") > 2).withColumn("cx", F.explode(cells(xs))).withColumn("cy", F.explode(cells(ys)))
    own = points.where("x is not null and y is not null").withColumn("cx", F.floor("x").cast("int")).withColumn("cy", F.floor("y").cast("int"))

    def inside(ring: Column) -> Column:
        after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
        crossed = lambda a, b: ((a["y"] > F.col("y")) != (b["y"] > F.col("y"))) & (F.col("x") < (b["x"] - a["x"]) * (F.col("y") - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])
        return F.aggregate(F.zip_with(ring, after, lambda a, b: F.coalesce(crossed(a, b), F.lit(False)).cast("int")), F.lit(0), lambda s, v: s + v) % 2 == 1

    met = own.join(boxes, ["cx", "cy"]).where(inside(F.col("ring")) & ~F.exists("holes", inside))
    return met.drop("cx", "cy", "part", "ring", "holes").distinct()


def named(regions: DataFrame, names: list[str]) -> DataFrame:
    """The regions of these names: those that a map highlights."""
    return regions.where(F.col("name").isin(names))
