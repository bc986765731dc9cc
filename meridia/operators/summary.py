"""Summaries of predictions, points and series."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import kernels
from meridia.functions.geo import haversine_km, unit_vector
from meridia.sources.folders import work_folder


def bootstrap(preds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per sample over its replicates: mean, median, deviation, interval and error of x and y; with `known` (one row a
    sample: sample, known_x, known_y) also the great-circle error of the mean."""
    n = F.sqrt(F.count("x"))
    sx, sy = F.stddev_samp("x"), F.stddev_samp("y")
    out = preds.groupBy("sample").agg(
        F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"), F.median("x").alias("x_median"), F.median("y").alias("y_median"),
        sx.alias("std_dev_x"), sy.alias("std_dev_y"), (1.96 * sx / n).alias("ci_95_x"), (1.96 * sy / n).alias("ci_95_y"),
        (1.96 * sx).alias("se_x"), (1.96 * sy).alias("se_y"), F.sqrt(sx * sx + sy * sy).alias("drms"),
    )
    if known is None:
        return out
    error = haversine_km(F.col("x_mean"), F.col("y_mean"), F.col("known_x"), F.col("known_y"))
    return out.join(known, "sample", "left").withColumn("haversine_error", error).drop("known_x", "known_y")


def geodesic_error(summary: DataFrame) -> DataFrame:
    """`geodesic_error`: the distance of (x_mean, y_mean) from (known_x, known_y) on the ellipsoid."""

    @F.pandas_udf("double")
    def km(a, b, c, d):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(kernels.geodesic_km(a, b, c, d))

    return summary.withColumn("geodesic_error", km("x_mean", "y_mean", "known_x", "known_y"))


def replicate_distances(e: DataFrame, by: list[str]) -> DataFrame:
    return e.groupBy(*by).agg(F.avg("km").alias("mean_dist"), F.median("km").alias("median_dist"), F.stddev_samp("km").alias("stdev_dist"))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column for each group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(value).alias("max"))


def bounding_box(points: DataFrame, by: list[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))


def spherical_mean(points: DataFrame, by: list[str] = ()) -> DataFrame:
    """The direction of the mean of the points' unit vectors."""
    u = unit_vector(F.col("x"), F.col("y"))
    m = points.groupBy(*by).agg(*[F.avg(c).alias(n) for c, n in zip(u, ("ux", "uy", "uz"))])
    return m.select(*by, F.degrees(F.atan2("uy", "ux")).alias("x"), F.degrees(F.atan2(F.col("uz"), F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")))).alias("y"))


def far_from_mean(points: DataFrame, by: list[str], threshold: float = 2.0) -> DataFrame:
    """Points whose plane distance from their group's mean point exceeds mean + threshold * deviation of those distances."""
    mean = points.groupBy(*by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = points.join(mean, by).withColumn("distance", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))
    limit = d.groupBy(*by).agg((F.avg("distance") + threshold * F.stddev_samp("distance")).alias("limit"))
    return d.join(limit, by).withColumn("is_outlier", F.coalesce(F.col("distance") > F.col("limit"), F.lit(False))).drop("mx", "my", "limit")


def mean_interval(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """The mean and its 95 % interval by Student's distribution; the quantiles are found for the group sizes that occur."""
    s = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))

    @F.pandas_udf("double")
    def quantile(n):  # noqa: ANN001, ANN202
        return n.map({k: kernels.t_quantile(0.975, k - 1) if k > 1 else float("nan") for k in set(n)})

    half = quantile("n") * F.col("sd") / F.sqrt("n")
    return s.select(*by, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def share_of_total(df: DataFrame, weight: str, total: int, by: str) -> DataFrame:
    """Per group int(weight * total / sum of weights): the samples that a region needs."""
    areas = df.groupBy(by).agg(F.sum(weight).alias("w"))
    every = areas.agg(F.sum("w").alias("all"))
    return areas.crossJoin(F.broadcast(every)).select(by, F.floor(F.col("w") * total / F.col("all")).cast("long").alias("required"))


def histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """Bins of equal width between the extremes: count, percent and cumulative percent."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    return counts.select("bin", "c", (100.0 * F.col("c") / F.col("n")).alias("percent"), (100.0 * F.sum("c").over(Window.orderBy("bin")) / F.col("n")).alias("cumulative"))


def rolling(series: DataFrame, value: str, order: str, width: int, by: list[str] = ()) -> DataFrame:
    """Trailing mean and population deviation of `width` values, fewer at the start."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)
    return series.withColumn("rolling_mean", F.avg(value).over(w)).withColumn("rolling_sd", F.stddev_pop(value).over(w))


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row for each key and metric."""
    return df.unpivot(keys, values, "metric", "value")


def z_scores(df: DataFrame, value: str, sample: bool = False) -> DataFrame:
    """`z`: the distance from the mean in deviations (population, or `sample`); the two numbers are broadcast."""
    s = df.agg(F.avg(value).alias("__m"), (F.stddev_samp(value) if sample else F.stddev_pop(value)).alias("__s"))
    return df.crossJoin(F.broadcast(s)).withColumn("z", (F.col(value) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))).drop("__m", "__s")


def min_max(df: DataFrame, value: str, low: float = 1.0, high: float = 10.0, name: str = "scaled") -> DataFrame:
    s = df.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    return df.crossJoin(F.broadcast(s)).withColumn(name, low + (high - low) * (F.col(value) - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0))).drop("__a", "__b")


def capped(df: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """Values above a percentile become that percentile."""
    top = quantiles(df, value, [share])[0]
    return df if top is None else df.withColumn(value, F.least(value, F.lit(top)))


def gradient_argmin(curve: DataFrame, x: str, y: str) -> DataFrame:
    """The x at which the discrete gradient of y (one-sided at the ends) is least: the elbow of a sweep."""
    w = Window.orderBy(x)
    up, down = F.lead(y).over(w), F.lag(y).over(w)
    g = F.when(down.isNull(), up - F.col(y)).when(up.isNull(), F.col(y) - down).otherwise((up - down) / 2)
    return curve.withColumn("gradient", g).agg(F.min_by(x, F.struct("gradient", x)).alias("best"), F.min("gradient").alias("gradient"))


def best(sweep: DataFrame, param: str, score: Column, largest: bool, by: list[str] = ()) -> DataFrame:
    """The parameter with the best score; the smallest of several."""
    return sweep.withColumn("__s", -score if largest else score).groupBy(*by).agg(F.min_by(param, F.struct("__s", param)).alias("best"))


def dissolve(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A row a group: mean_ and median_ of each column, and n."""
    return df.groupBy(*by).agg(*[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("median", F.median))], F.count("*").alias("n"))


def class_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each combination of the columns."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def flat_names(df: DataFrame, by: list[str], columns: list[str], kinds: tuple[str, ...] = ("mean", "median", "std")) -> DataFrame:
    """Several aggregates of several columns, each in one column called column_kind."""
    of = {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}
    return df.groupBy(*by).agg(*[of[k](c).alias(f"{c}_{k}") for c in columns for k in kinds])


#: Values up to which Spark's percentile is asked, or that are fetched from a narrow bin; bins of a round.
FEW, NARROW, BINS = 2_000_000, 10_000, 4096


def running_totals(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The rows with `name`: the sum of `value` over the rows of their group up to and including them, in an order.

    Rows are range-partitioned by group and order and written; each partition sums its own rows, on from the partitions before,
    so neither all rows nor a large group are in one task. Rows that are equal in all of the order are summed in any order.
    """
    spark, folder = df.sparkSession, work_folder(df, "totals")
    dealt = df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    dealt.write.parquet(folder)
    dealt = spark.read.schema(dealt.schema).parquet(folder)
    sums = dealt.groupBy("__part", *by).agg(F.sum(value).alias("__sum"))  # a row a partition, and one more a group
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    keys = ["__part", *by]
    starts = sums.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]
    own = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = dealt.withColumn(name, own).join(starts, functools.reduce(lambda x, y: x & y, same))
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before", *[f"__k{i}" for i in range(len(keys))])


def kept(df: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared folder and read again."""
    folder = work_folder(df, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def quantiles(df: DataFrame, value: str, shares: list[float], few: int = FEW, written: bool = False) -> list[float | None]:
    """The exact quantiles of a column, with linear interpolation; nulls don't count, and without values all are None.

    Up to `few` values are one aggregation. More are counted in bins between the extremes, then in finer bins of those that
    hold the wanted places, until such a bin has few values or one: no task holds all different values. Both ways give the
    same numbers; in both NaN counts as larger than all others. The values are written once to the shared folder, unless
    `df` is `written` itself.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    v = v if written else kept(v, "quantiles")
    if v.count() <= few:
        found = v.agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares])).alias("q")).head()["q"]
        return [None] * len(shares) if found is None else list(found)
    inf = float("inf")
    ends = v.agg(F.count("*").alias("n"), F.count_if(F.col("v") == -inf).alias("least"), F.count_if(F.col("v") == inf).alias("most"), F.count_if(F.isnan("v")).alias("nan")).head()
    n = ends["n"]
    if not n:
        return [None] * len(shares)
    places = {k for s in shares for k in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}
    first, last = ends["least"], n - ends["nan"] - ends["most"]  # the places of finite values
    found = {k: -inf if k < first else float("nan") if k >= n - ends["nan"] else inf for k in places if not first <= k < last}
    v = v.where((F.col("v") > -inf) & (F.col("v") < inf))
    found |= _places(v, sorted(k - first for k in places if first <= k < last), first)
    out = []
    for s in shares:
        k = s * (n - 1)
        a, b, part = found[math.floor(k)], found[math.ceil(k)], k - math.floor(k)
        out.append(a if a == b or not part else (1 - part) * a + part * b)
    return out


def _places(v: DataFrame, places: list[int], shift: int) -> dict[int, float]:
    """The finite values at places of their order, by the place plus `shift`."""
    if not places:
        return {}
    low, high = v.agg(F.min("v"), F.max("v")).head()
    open_parts, found = [(low, high, 0, places)], {}
    while open_parts:
        part, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (a, b, _, _) in enumerate(open_parts):  # at most two a share
            inside = F.col("v").between(a, b)
            part = F.when(inside, i).otherwise(part)
            width = b / BINS - a / BINS  # in this order it can't leave the range of numbers
            bin_ = F.when(inside, F.least(F.floor((F.col("v") / BINS - a / BINS) / width * BINS), F.lit(BINS - 1)) if width > 0 else F.lit(0)).otherwise(bin_)
        counts = v.select("v", part.alias("part"), bin_.alias("bin")).where("part is not null").groupBy("part", "bin").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("part", "bin").collect()  # at most BINS a part
        finer = []
        for i, (_, _, before, wanted) in enumerate(open_parts):
            for r in (r for r in counts if r["part"] == i):
                own = [k for k in wanted if before <= k < before + r["n"]]
                if own and r["a"] == r["b"]:
                    found |= {k + shift: r["a"] for k in own}
                elif own and r["n"] <= NARROW:
                    values = sorted(x["v"] for x in v.where(F.col("v").between(r["a"], r["b"])).collect())
                    found |= {k + shift: values[k - before] for k in own}
                elif own:
                    finer.append((r["a"], r["b"], before, own))
                before += r["n"]
        open_parts = finer
    return found
