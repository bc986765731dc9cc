"""One row, id or payload that holds most of a table: samples keep their bounds, shards their sizes, and record ids stay unique."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import langid, quality, queries, sharding, textkit, warc


def test_shards_of_one_record_many_times(spark):
    few = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    hot = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = sharding.records(few.union(hot))
    total, draws = rows.agg(F.sum("size")).head()[0], 6912
    for seed in range(5):
        assert len(sharding._sample(rows, total, draws, seed)) <= 2 * draws  # what reaches the driver
    p = sharding.plan_records(rows, 24)
    found = sharding.assign_records(rows, p)
    size = Counter({r["shard"]: r["s"] for r in found.groupBy("shard").agg(F.sum("size").alias("s")).collect()})
    assert len(size) == 24 and max(size.values()) < 1.05 * total / 24
    slots = found.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in slots)
    widest = rows.groupBy(sharding._range_of(F.col("place"), p.splitters)).agg(F.sum("size").alias("s")).agg(F.max("s")).head()[0]
    assert widest <= 3 * total / (24 * 48)  # no range holds the hot record whole


def test_record_ids_over_many_archives(spark):
    rows = spark.range(20_000).repartition(8).select((F.col("id") % 5).alias("page_id"), F.lit("u").alias("url"), F.lit("a" * 1500).alias("html"))
    one = spark.createDataFrame([(9, "u", "b" * 1500), (8, "v", "b" * 1500), (7, "v", "b" * 1500)], "page_id long, url string, html string")
    folder = textkit.shared_folder(spark, "t")
    archives = warc.write(warc.records(rows.union(one)).repartition(8), folder)  # as if a broadcast join had left rows where they were
    found = warc.read(spark, folder, with_payload=False).where("last")
    assert archives.count() == 8
    n = found.agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("d")).head()
    assert n["n"] == n["d"] == 20_003
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in found.select("page_id", "record_type", "refers_to").distinct().collect()} == {(4, "response", None), *((k, "revisit", 4) for k in range(4)), (9, "response", None), (8, "revisit", 9), (7, "revisit", 9)}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    words = {"a": ["alpha", "beta", "gamma", "delta"], "b": ["uno", "dos", "tres", "cuatro"]}
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2]], 12)), "ab"[i % 2]) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_samples_of_one_id_many_times(spark, labelled):
    """A repeated row teaches once, so the model is that of the table without repeats, and the sample keeps its bound."""
    hot = labelled.union(labelled.where("doc_id = 12").crossJoin(spark.range(3000)).select("doc_id", "text", "lang"))
    a, b = langid.fit(labelled), langid.fit(hot)
    assert a.langs == b.langs and np.allclose(a.centroids, b.centroids) and np.allclose(a.least, b.least)
    marks = labelled.select("doc_id", (F.col("lang") == "a").cast("int").alias("quality"))
    many = marks.union(marks.where("doc_id = 12").crossJoin(spark.range(3000)).select("doc_id", "quality"))
    x, y = quality.fit(labelled, marks), quality.fit(hot, many)
    assert np.allclose(x.weights, y.weights) and x.bias == y.bias


def test_samples_keep_their_bound(spark, labelled, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "ftrl", lambda rows, y, *a: seen.append(len(rows)) or quality.Model(np.zeros(1 << quality.BITS, np.float32), 0.0))
    marks = labelled.select("doc_id", (F.col("lang") == "a").cast("int").alias("quality"))
    quality.fit(labelled, marks, rows=50)
    monkeypatch.setattr(langid, "_spherical", lambda x, k, seed: seen.append(len(x)) or x[:1])
    langid.fit(labelled, per_lang=40)
    assert seen == [50, 40, 40]


def test_bounds_of_draws():
    assert textkit.below(10, 5) == textkit.MASK
    for total in (10**6, 10**10, 10**15):
        share = textkit.below(8000, total) / textkit.MASK
        assert 8000 < share * total < 9000


def test_null_ids_are_not_held_out(spark):
    folder = textkit.shared_folder(spark, "t").removeprefix("file://")
    spark.createDataFrame([(None, "some text", "en", "s", 9), (3, "other text", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for query in (queries.op2_language_id, queries.op4_quality):
        assert {r["doc_id"]: r["held_out"] for r in query(spark, folder).collect()}[None] is False
