"""Training losses over tables of scaled coordinates (tx, ty, px, py, w), and rules over loss series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.geo import haversine_km


def rmse(rows: DataFrame) -> DataFrame:
    """Mean weighted Euclidean distance."""
    d = F.sqrt((F.col("tx") - F.col("px")) ** 2 + (F.col("ty") - F.col("py")) ** 2)
    return rows.agg((F.sum(F.col("w") * d) / F.sum("w")).alias("loss"))


def rmse_batch(rows: DataFrame) -> DataFrame:
    """The mean distance times the mean weight, as training code that weighs whole batches has it."""
    d = F.sqrt((F.col("tx") - F.col("px")) ** 2 + (F.col("ty") - F.col("py")) ** 2)
    return rows.agg((F.avg(d) * F.avg("w")).alias("loss"))


def drms(rows: DataFrame) -> DataFrame:
    """Root of the weighted mean squared great-circle distance of coordinates in degrees."""
    d = haversine_km(F.col("tx"), F.col("ty"), F.col("px"), F.col("py"))
    return rows.agg(F.sqrt(F.avg(F.col("w") * d * d)).alias("loss"))


def huber(rows: DataFrame, delta: float = 0.5, smoothing: float = 0.1) -> DataFrame:
    """Weighted Huber loss; targets are moved towards their mean by `smoothing`. Rows with a null or NaN are left out."""
    c = ["tx", "ty", "px", "py", "w"]
    ok = rows
    for k in c:
        ok = ok.where(F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double")))
    m = ok.agg(F.avg("tx").alias("mx"), F.avg("ty").alias("my"))

    def one(t: str, p: str, mean: str):  # noqa: ANN202
        e = F.abs(F.col(t) * (1 - smoothing) + F.col(mean) * smoothing - F.col(p))
        return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))

    return ok.crossJoin(F.broadcast(m)).agg(F.avg(F.col("w") * (one("tx", "px", "mx") + one("ty", "py", "my")) / 2).alias("loss"))


def early_stopping(series: DataFrame, patience: int, by: list[str] = ()) -> DataFrame:
    """`best` so far, `waited` epochs since the last improvement (equal counts as one), and `stop` from the patience on."""
    w = Window.partitionBy(*by).orderBy("epoch")
    best = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = series.withColumn("better", (best.isNull() | (F.col("loss") <= best)).cast("int")).withColumn("best", F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(F.col("better") == 1, F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("waited", (F.col("epoch") - last).cast("long"))
    return s.withColumn("stop", F.col("waited") >= patience).drop("better")
