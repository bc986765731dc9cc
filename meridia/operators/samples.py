"""Samples: alignment of genotypes and coordinates, known and unknown ones, splits, and tables of predictions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.summary import running_totals
from meridia.sources.folders import work_folder


def align(genotyped: DataFrame, coords: DataFrame, keep_all: bool = False) -> DataFrame:
    """Genotyped samples with their coordinates; with `keep_all` also those without (null coordinates)."""
    return genotyped.join(coords, "sample", "left" if keep_all else "inner")


def mark_known(samples: DataFrame) -> DataFrame:
    """`is_known` says that both coordinates are there."""
    return samples.withColumn("is_known", F.col("x").isNotNull() & F.col("y").isNotNull())


def choose_unknown(samples: DataFrame, share: float, order: Column | None = None, seed: int = 0) -> DataFrame:
    """Marks exactly ceil(share * n) samples as unknown, in an order by hash (or as given), if all are known.

    Samples are numbered by range partitions, so neither a window nor a limit holds them in one task.
    """
    order = F.xxhash64("sample", F.lit(seed)) if order is None else order
    placed = samples.withColumn("__o", order)
    head = placed.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("open")).head()
    if head["open"] or not head["n"]:
        return mark_known(samples)
    k = -int(-share * head["n"] // 1)
    return numbered(placed, ["__o", "sample"], "__i").withColumn("is_known", F.col("__i") >= k).drop("__i", "__o")


def extract(samples: DataFrame, outliers: DataFrame) -> DataFrame:
    """`part` of each sample: known, unknown, or outlier if its id is among the outliers."""
    marked = mark_known(samples).join(outliers.select("sample").distinct().withColumn("__out", F.lit(True)), "sample", "left")
    return marked.withColumn("part", F.when(F.col("__out"), "outlier").when(F.col("is_known"), "known").otherwise("unknown")).drop("__out", "is_known")


def split(samples: DataFrame, train: float, val: float, order: Column, cluster: str = "cluster") -> DataFrame:
    """`split` (train, val, test) within each cluster by an order: shares train, val / 2, and the rest, without overlap."""
    placed = running_totals(samples.withColumn("__o", order).withColumn("__1", F.lit(1)), [cluster], ["__o", "sample"], "__1", "__i")
    sizes = samples.groupBy(F.col(cluster).alias("__cluster")).agg(F.count("*").alias("__n"))
    placed = placed.join(sizes, F.col(cluster).eqNullSafe(F.col("__cluster")))
    place = (F.col("__i") - 1) / F.col("__n")
    return placed.withColumn("split", F.when(place < train, "train").when(place < train + val / 2, "val").otherwise("test")).drop("__o", "__1", "__i", "__cluster", "__n")


def disjoint(a: DataFrame, b: DataFrame) -> bool:
    """Whether no sample is in both."""
    return a.select("sample").intersect(b.select("sample")).isEmpty()


def centroid_of_known(known: DataFrame) -> DataFrame:
    """One row a sample: the mean of its coordinates."""
    return known.groupBy("sample").agg(F.avg("x").alias("known_x"), F.avg("y").alias("known_y"))


def synchronise(known: DataFrame, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The three tables restricted to samples of all of them, and the common samples of a and b that aren't known."""
    common = a.select("sample").intersect(b.select("sample"))
    shared = common.join(known.select("sample"), "sample", "left_semi")
    return (*(t.join(shared, "sample", "left_semi") for t in (known, a, b)), common.join(known.select("sample"), "sample", "left_anti"))


def cap_per_sample(rows: DataFrame, most: int, order: Column) -> DataFrame:
    """At most `most` rows of each sample, the first by an order; the window keeps no more than that of each partition."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("sample").orderBy(order))).where(F.col("__r") <= most).drop("__r")


def plot_samples(rows: DataFrame, wanted: list[str] | int | None, seed: int = 0) -> DataFrame:
    """Rows of the wanted samples: all (None), a list, or a number of them drawn by hash."""
    if wanted is None:
        return rows
    if isinstance(wanted, int):
        return rows.join(rows.select("sample").distinct().orderBy(F.xxhash64("sample", F.lit(seed)), "sample").limit(wanted), "sample", "left_semi")
    return rows.where(F.col("sample").cast("string").isin([str(x) for x in wanted]))


def tagged_union(tables: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """All rows under one roof, with the name of their table; missing columns are null."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def by_position(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str]) -> DataFrame:
    """Left rows with the right row at the same place of its order."""
    return numbered(left, order_left, "__row").join(numbered(right, order_right, "__row"), "__row", "left").drop("__row")


def replicate_numbers(rows: DataFrame, order: Column, group: str = "config", cycle: int = 100) -> DataFrame:
    """`replicate` counts 1..cycle again and again within a group."""
    return rows.withColumn("replicate", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) % cycle + 1)


def same_keys(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Keys that only one side has: none if features and targets fit."""
    return features.select("sample").join(targets.select("sample"), "sample", "left_anti").withColumn("missing_in", F.lit("targets")).union(targets.select("sample").join(features.select("sample"), "sample", "left_anti").withColumn("missing_in", F.lit("features")))


def join_with_suffixes(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str]) -> DataFrame:
    """The inner join on a column; other columns that both sides have get a suffix each."""
    low = lambda df: {c.lower() for c in df.columns}
    both = (low(left) & low(right)) - {on.lower()}
    named = lambda df, s: df.select(*[F.col(f"`{c}`").alias(c + s if c.lower() in both else c) for c in df.columns])
    return named(left, suffixes[0]).join(named(right, suffixes[1]), on)


def shuffled(rows: DataFrame, seed: int, key: str = "sample") -> DataFrame:
    """The rows in an order by a hash of key and seed, range-partitioned: the same for the same seed."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key)


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Of each column: string, numeric or other."""
    kind = lambda t: "string" if t in ("string", "varchar", "char") else "numeric" if re.match("tinyint|smallint|int|bigint|float|double|decimal", t) else "other"
    return {c: kind(t) for c, t in df.dtypes}


def neighbour_count(rows: DataFrame, rule: str) -> int:
    """The whole part of the square root (`sqrt`) or the logarithm to base 2 (`log2`) of the number of rows."""
    if rule not in ("sqrt", "log2"):
        raise ValueError(f"sqrt or log2 is wanted, not {rule!r}")
    n = rows.count()
    return math.isqrt(n) if rule == "sqrt" else max(n, 1).bit_length() - 1


def numbered(rows: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """The rows with their place from 0 in an order, without one task for all: range partitions number their own rows, on from the rows before.

    The partitions are written to the shared folder, so both passes see the same ones. Ties have places in any order.
    """
    spark, folder = rows.sparkSession, work_folder(rows, "numbered")
    dealt = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt.write.parquet(folder)
    dealt = spark.read.schema(dealt.schema).parquet(folder)
    counts = sorted((r["__part"], r["n"]) for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row a partition
    starts, before = [], 0
    for part, n in counts:
        starts.append((part, before))
        before += n
    first = F.broadcast(spark.createDataFrame(starts, "__part int, __first long"))
    return dealt.join(first, "__part").withColumn(name, F.col("__first") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1).drop("__part", "__first")
