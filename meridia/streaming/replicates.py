"""Summaries of bootstrap replicates while their files land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema: str = "replicate int, sample string, x double, y double") -> DataFrame:
    """A stream over Parquet files as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def running_summary(stream: DataFrame) -> DataFrame:
    """Per sample: replicates so far, means, deviations and drms. The state is one row a sample, whatever the replicates."""
    sx, sy = F.stddev_samp("x"), F.stddev_samp("y")
    return stream.groupBy("sample").agg(F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"), sx.alias("std_dev_x"), sy.alias("std_dev_y"), F.sqrt(sx * sx + sy * sy).alias("drms"))


def start(summary: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the summary anew after each batch, and ends when all files that are there have been read."""
    return summary.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
