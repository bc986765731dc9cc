"""Writers. All of them write folders of part files, one for each task, so nothing goes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictions(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """sampleID, x, y as CSV with a header, a folder for each value of `by` (dataset, replicate)."""
    df.select(*by, F.col("sample").alias("sampleID"), "x", "y").write.mode("overwrite").partitionBy(*by).csv(path, header=True)


def metrics(df: DataFrame, path: str) -> None:
    """A JSON object a row."""
    df.write.mode("overwrite").json(path)


def replicate_metrics(df: DataFrame, path: str) -> None:
    """Metrics of each replicate, a JSON object in a folder of its own."""
    df.write.mode("overwrite").partitionBy("replicate").json(path)


def loss_curves(models: DataFrame, path: str) -> None:
    """The validation losses by epoch of each plan of train_all(), a JSON object each."""
    models.select("plan", "curve").write.mode("overwrite").json(path)


def dump(df: DataFrame, path: str, wanted: bool) -> None:
    """A table for debugging as CSV, if it is wanted; arrays become one text."""
    if wanted:
        flat = [F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes]
        df.select(*flat).write.mode("overwrite").csv(path, header=True)


def table(df: DataFrame, path: str) -> None:
    """Any flat table as CSV with a header: summaries, metrics by replicate."""
    df.write.mode("overwrite").csv(path, header=True)


def outlier_ids(df: DataFrame, path: str) -> None:
    """Sample ids, one a line, sorted over all part files."""
    df.select(F.col("sample").cast("string")).distinct().orderBy("sample").write.mode("overwrite").text(path)


def timings(df: DataFrame, path: str) -> None:
    """Appends (function, seconds)."""
    df.select(F.col("function").alias("Function Name"), F.col("seconds").alias("Execution Time")).write.mode("append").csv(path, header=True)


def study(trials: DataFrame, path: str) -> DataFrame:
    """All trials as CSV, and the best one as JSON, which is returned."""
    trials.write.mode("overwrite").csv(f"{path}/trials", header=True)
    best = trials.orderBy("loss", "plan").limit(1)
    best.write.mode("overwrite").json(f"{path}/best")
    return best


def models(df: DataFrame, path: str) -> None:
    """Fitted models as Parquet, a row each; read again with spark.read.parquet."""
    df.write.mode("overwrite").parquet(path)
