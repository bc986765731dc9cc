"""Views of the star-schema tables that stand in for samples, genotypes, replicates and series, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, g (nation), x and y from the key of each customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("g"), (((k * 3701) % 36000).cast("double") / 100 - 180).alias("x"), (((k * 1907) % 17000).cast("double") / 100 - 85).alias("y"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points with predictions px and py nearby."""
    i = F.col("id")
    return points(spark, sf_dir).withColumn("px", F.col("x") + ((i * 13) % 200 - 100).cast("double") / 100).withColumn("py", F.col("y") + ((i * 17) % 200 - 100).cast("double") / 100)


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points as sample, g, x, y; coordinates of every tenth are unknown."""
    p = points(spark, sf_dir)
    gone = F.col("id") % 10 == 0
    return p.select(F.col("id").alias("sample"), "g", F.when(~gone, F.col("x")).alias("x"), F.when(~gone, F.col("y")).alias("y"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, locus, a1, a2 from suppliers and parts; repeated pairs count once."""
    d = dosages(spark, sf_dir)
    return d.select("sample", "locus", F.when(F.col("dosage") >= 1, 1).when(F.col("dosage") == 0, 0).alias("a1"), F.when(F.col("dosage") == 2, 1).when(F.col("dosage") <= 1, 0).alias("a2"))


#: Rows of a partition of large tables, so that the memory of a task doesn't grow with them.
PART_ROWS = 1_000_000


def dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, locus, dosage (0, 1, 2 or null)."""
    li = table(spark, sf_dir, "lineitem")
    parts = -(-li.count() // PART_ROWS)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        li = li.repartition(parts, F.col("l_suppkey"), F.col("l_partkey"))
    d = F.max(F.when(F.col("l_orderkey") % 17 != 0, F.col("l_linenumber") % 3)).cast("int")
    return li.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("locus")).agg(d.alias("dosage"))


def boots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replicate, sample, tool, x, y from events."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("event"), (F.col("event_id") % 20).cast("int").alias("replicate"), u.alias("sample"), F.col("event_type").alias("tool"), ((u * 37 % 340 - 170).cast("double") + F.col("value") / 1000).alias("x"), ((u * 11 % 160 - 80).cast("double") + F.col("value") / 2000).alias("y"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, features, label of embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label"))


#: The same in SQL, as parts of a WITH clause.
SQL = {
    "p": "p AS (SELECT c_custkey AS id, c_nationkey AS g, CAST((c_custkey*3701)%36000 AS DOUBLE)/100-180 AS x, CAST((c_custkey*1907)%17000 AS DOUBLE)/100-85 AS y FROM customer)",
    "q": "q AS (SELECT *, x+CAST((id*13)%200-100 AS DOUBLE)/100 AS px, y+CAST((id*17)%200-100 AS DOUBLE)/100 AS py FROM p)",
    "e": "e AS (SELECT *, 2*6371.0*asin(sqrt(least(1.0, power(sin(radians(py-y)/2),2)+cos(radians(y))*cos(radians(py))*power(sin(radians(px-x)/2),2)))) AS km FROM q)",
    "h": "h AS (SELECT id AS sample, g, CASE WHEN id%10<>0 THEN x END AS x, CASE WHEN id%10<>0 THEN y END AS y FROM p)",
    "d": "d AS (SELECT l_suppkey AS sample, l_partkey AS locus, CAST(max(CASE WHEN l_orderkey%17<>0 THEN l_linenumber%3 END) AS INTEGER) AS dosage FROM lineitem GROUP BY 1, 2)",
    "b": "b AS (SELECT event_id AS event, CAST(event_id%20 AS INTEGER) AS replicate, user_id AS sample, event_type AS tool, CAST(user_id*37%340-170 AS DOUBLE)+value/1000 AS x, CAST(user_id*11%160-80 AS DOUBLE)+value/2000 AS y FROM events)",
    "v": "v AS (SELECT vec_id AS id, label, CAST(unnest(range(64)) AS INTEGER) AS k, CAST(unnest(embedding) AS DOUBLE) AS f FROM embeddings)",
}
