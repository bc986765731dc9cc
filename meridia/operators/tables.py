"""Tables behind maps and curves of a run: outliers, synthetic samples, densities, histories and times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.density import kernel_sums


def outlier_map(samples: DataFrame, outliers: DataFrame) -> DataFrame:
    """(id, x, y, status, spaces) of samples with coordinates: Outlier or Non-Outlier, and in which spaces, joined by commas."""
    of = outliers.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("space")), ",").alias("spaces"))
    rows = samples.where("x is not null and y is not null").select("id", "x", "y").join(of, "id", "left")
    return rows.select("id", "x", "y", F.when(F.col("spaces").isNull(), "Non-Outlier").otherwise("Outlier").alias("status"), F.coalesce("spaces", F.lit("")).alias("spaces"))


def oversampling_map(samples: DataFrame, synthetic: DataFrame, by: str) -> DataFrame:
    """(id, copy, x, y, group, origin) of original samples (copy 0) and synthetic ones, which have the group of their first parent."""
    old = samples.select("id", F.lit(0).alias("copy"), "x", "y", F.col(by).alias("group"), F.lit("original").alias("origin"))
    new = synthetic.join(samples.select("id", F.col(by).alias("group")), "id").select("id", F.col("copy").cast("int"), "x", "y", "group", F.lit("synthetic").alias("origin"))
    return old.union(new)


def density_map(points: DataFrame, bandwidth: float = 0.03) -> DataFrame:
    """(id, x, y, density, share) of points: the kernel sum at each, and its share of the largest."""
    rows = points.select("id", "x", "y").join(kernel_sums(points, bandwidth), "id")
    top = rows.agg(F.max("density").alias("top"))
    return rows.crossJoin(F.broadcast(top)).select("id", "x", "y", "density", (F.col("density") / F.col("top")).alias("share"))  # one row


def history(models: DataFrame) -> DataFrame:
    """(plan, epoch, loss, best) of fitted models: their validation losses, and whether an epoch has the smallest so far."""
    rows = models.select("plan", F.posexplode("curve").alias("epoch", "loss"))
    return rows.selectExpr("plan", "epoch", "loss", "loss <= min(loss) OVER (PARTITION BY plan ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best")


def times(timings: DataFrame) -> DataFrame:
    """(function, runs, total, mean, share) of (function, seconds), the longest first."""
    of = timings.groupBy("function").agg(F.count("*").alias("runs"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"))
    whole = of.agg(F.sum("total").alias("whole"))
    return of.crossJoin(F.broadcast(whole)).select("function", "runs", "total", "mean", (F.col("total") / F.col("whole")).alias("share")).orderBy(F.col("total").desc(), "function")  # one row
