"""The 27 error metrics of predicted coordinates, over a table or per group.

Input: pairs (x, y, px, py), longitude and latitude in degrees. Rows with a null are left out.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import kernels
from meridia.functions.geo import haversine_km
from meridia.operators.summary import kept, quantiles, running_totals

NAMES = ["root_mean_squared_error", "mean_dist", "median_dist", "stdev_dist", "kolmogorov_smirnov", "kolmogorov_smirnov_pval", "skewness", "rho", "rho_p", "spearman_corr_longitude", "spearman_corr_latitude", "spearman_pvalue_longitude", "spearman_pvalue_latitude", "pearson_corr_longitude", "pearson_corr_latitude", "pearson_pvalue_longitude", "pearson_pvalue_latitude", "mad_haversine", "coefficient_of_variation", "interquartile_range", "percentile_25", "percentile_50", "percentile_75", "percent_within_20km", "percent_within_50km", "percent_within_75km", "mean_absolute_z_score"]

#: Of the tail of the normal distribution.
_TAIL = kernels.scaled_erfc_polynomial()


def errors(pairs: DataFrame, compat: bool = False) -> DataFrame:
    """All columns and `km`, the great-circle error; rows with a null coordinate go. `compat` swaps the axes."""
    x, y, px, py = (F.col(c) for c in ("x", "y", "px", "py"))
    km = haversine_km(y, x, py, px) if compat else haversine_km(x, y, px, py)
    return pairs.where("x is not null and y is not null and px is not null and py is not null").withColumn("km", km)


def distance_metrics(e: DataFrame, by: list[str] = (), within_20km: float = 25.0) -> DataFrame:
    """Moments, percentiles and shares of `km`, a row for each group: two aggregations, no window over all rows.

    Without groups the percentiles come from quantiles(), as one task can't hold all errors.
    """
    by = list(by)
    e = e if by else kept(e.select("km"), "errors")
    given = None if by else quantiles(e, "km", [0.25, 0.5, 0.75], written=True)
    q = F.percentile("km", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) if by else F.first(F.array(*[F.lit(x).cast("double") for x in given]))
    away = F.median(F.abs(F.col("km") - F.col("q")[1])) if by else F.first(F.lit(None if given[1] is None else quantiles(e.select(F.abs(F.col("km") - given[1]).alias("d")), "d", [0.5], written=True)[0]).cast("double"))
    first = e.groupBy(*by).agg(
        F.count("km").alias("n"),
        F.sqrt(F.avg(F.col("km") * F.col("km"))).alias("root_mean_squared_error"),
        F.avg("km").alias("mean_dist"),
        F.stddev_pop("km").alias("stdev_dist"),
        q.alias("q"),
        *[(100 * F.avg((F.col("km") < limit).cast("double"))).alias(f"percent_within_{name}km") for name, limit in ((20, within_20km), (50, 50.0), (75, 75.0))],
    )
    joined = e.join(first, by) if by else e.crossJoin(F.broadcast(first))  # one row
    sd = F.nullif(F.col("stdev_dist"), F.lit(0.0))
    second = joined.groupBy(*by).agg(
        away.alias("mad_haversine"),
        F.avg(F.pow((F.col("km") - F.col("mean_dist")) / sd, F.lit(3.0))).alias("skewness"),
        F.avg(F.abs((F.col("km") - F.col("mean_dist")) / sd)).alias("mean_absolute_z_score"),
    )
    both = first.join(second, by) if by else first.crossJoin(F.broadcast(second))
    return both.select(*by, "n", "root_mean_squared_error", "mean_dist", F.col("q")[1].alias("median_dist"), "stdev_dist", "skewness", "mad_haversine", (F.col("stdev_dist") / F.nullif(F.col("mean_dist"), F.lit(0.0))).alias("coefficient_of_variation"), (F.col("q")[2] - F.col("q")[0]).alias("interquartile_range"), F.col("q")[0].alias("percentile_25"), F.col("q")[1].alias("percentile_50"), F.col("q")[2].alias("percentile_75"), "percent_within_20km", "percent_within_50km", "percent_within_75km", "mean_absolute_z_score")


def ranks(df: DataFrame, kinds: dict[str, list[str]], by: list[str] = ()) -> DataFrame:
    """(by, kind, value, rank): the average rank of each different value among those of the columns of its kind, within a group.

    Values are counted first, and all kinds are one table whose running totals need no window over all values.
    """
    by = list(by)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for k, cs in kinds.items() for c in cs]))
    counts = df.select(*by, cells.alias("cell")).select(*by, "cell.kind", "cell.value").groupBy(*by, "kind", "value").agg(F.count("*").alias("c"))
    upto = running_totals(counts, [*by, "kind"], ["value"], "c", "upto")
    return upto.select(*by, "kind", "value", (F.col("upto") - (F.col("c") - 1) / 2).alias("rank"))


def correlations(e: DataFrame, by: list[str] = ()) -> DataFrame:
    """Pearson and Spearman correlation for each axis, and Spearman's of both axes together."""
    by = list(by)
    axes = e.select(*by, *[F.col(c).alias(f"_{c}") for c in ("x", "y", "px", "py")])  # a group may be one of them
    found = ranks(axes, {"x": ["_x"], "y": ["_y"], "px": ["_px"], "py": ["_py"], "t": ["_x", "_y"], "p": ["_px", "_py"]}, by)

    def ranked(df: DataFrame, kind: str) -> DataFrame:
        own = found.where(F.col("kind") == kind).select(*by, F.col("value").alias(f"_{kind}"), F.col("rank").alias(f"rank_{kind}"))
        return df.join(own, [*by, f"_{kind}"])

    each = functools.reduce(ranked, ("x", "y", "px", "py"), axes)
    one = each.groupBy(*by).agg(F.corr("_x", "_px").alias("pearson_corr_longitude"), F.corr("_y", "_py").alias("pearson_corr_latitude"), F.corr("rank_x", "rank_px").alias("spearman_corr_longitude"), F.corr("rank_y", "rank_py").alias("spearman_corr_latitude"), F.count("*").alias("n"))
    flat = axes.select(*by, F.col("_x").alias("_t"), F.col("_px").alias("_p")).union(axes.select(*by, "_y", "_py"))
    two = ranked(ranked(flat, "t"), "p").groupBy(*by).agg(F.corr("rank_t", "rank_p").alias("rho"))
    return one.join(two, by) if by else one.crossJoin(F.broadcast(two))


def kolmogorov_smirnov(e: DataFrame, by: list[str] = ()) -> DataFrame:
    """The largest gap between the distribution of `km` and the normal one with its mean and population deviation.

    Errors are counted by value; running totals of the counts give how many are below a value and how many up to it, without
    a window over all of them.
    """
    by = list(by)
    stats = e.groupBy(*by).agg(F.avg("km").alias("m"), F.stddev_pop("km").alias("s"), F.count("km").alias("total"))
    counts = e.where("km is not null").groupBy(*by, "km").agg(F.count("*").alias("c"))
    placed = running_totals(counts, by, ["km"], "c", "upto")
    placed = placed.join(stats, by) if by else placed.crossJoin(F.broadcast(stats))  # one row
    cdf = _normal_cdf((F.col("km") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)))
    gaps = placed.select(*by, "total", F.greatest(F.col("upto") / F.col("total") - cdf, cdf - (F.col("upto") - F.col("c")) / F.col("total")).alias("gap"))
    return gaps.groupBy(*by).agg(F.max("gap").alias("kolmogorov_smirnov"), F.max("total").alias("n"))


def _normal_cdf(z: Column) -> Column:
    """The normal distribution, within 1e-14: a built-in error function is missing, so a polynomial stands for its tail."""
    a = F.abs(z) / (2**0.5)
    s = 4 / (a + 2) - 1
    tail = F.lit(0.0)
    for c in reversed(_TAIL):
        tail = tail * s + c
    tail = tail * F.exp(-a * a) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def joined_metrics(e: DataFrame, by: list[str] = (), within_20km: float = 25.0) -> DataFrame:
    """All metrics that need no p-value, a row for each group, and n."""
    by = list(by)
    out = distance_metrics(e, by, within_20km)
    for p in (correlations(e, by).drop("n"), kolmogorov_smirnov(e, by).drop("n")):
        out = out.join(p, by) if by else out.crossJoin(F.broadcast(p))  # one row
    return out


def all_metrics(pairs: DataFrame, by: list[str] = (), within_20km: float = 25.0, compat: bool = False) -> DataFrame:
    """All 27 metrics by name, a row for each group."""
    by = list(by)
    out = joined_metrics(errors(pairs, compat), by, within_20km)

    def p_values(batches):
        for d in batches:
            n = d["n"].to_numpy()
            for c, name, k in (("rho", "rho_p", 2 * n), *((f"{kind}_corr_{axis}", f"{kind}_pvalue_{axis}", n) for kind in ("spearman", "pearson") for axis in ("longitude", "latitude"))):
                d[name] = [kernels.correlation_p(r, int(m)) for r, m in zip(d[c], k)]
            d["kolmogorov_smirnov_pval"] = [kernels.kolmogorov_p(s, int(m)) for s, m in zip(d["kolmogorov_smirnov"], n)]
            yield d[[*by, *NAMES]].astype({c: float for c in NAMES})

    kinds = ", ".join([*(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in by), *(f"{n} double" for n in NAMES)])
    return out.mapInPandas(p_values, kinds)
