"""Sums over pairs of places in blocks against plain sums, whatever the blocks' sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.operators import clusters, density, neighbors, optics, sums
from meridia.plans import pipeline

PLACES = [(i, float(i * 37 % 360 - 180) + (i % 7) / 10, float(i * 53 % 171 - 85)) for i in range(90)] + [(1000 + i, 10.0 + i % 5 / 10, 20.0 + i % 3 / 10) for i in range(60)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(sums, "LEFT", 4)
    monkeypatch.setattr(sums, "RIGHT", 8)


@pytest.mark.parametrize("bandwidth", [0.03, 1.0])
def test_kernel_sums_in_small_blocks(spark, small_blocks, bandwidth):
    """Cubes with many places are cut on both sides, also where the reach is the globe."""
    points = spark.createDataFrame([*PLACES, (5000, None, 3.0)], "id long, x double, y double")
    got = {r["id"]: r["density"] for r in density.kernel_sums(points, bandwidth).collect()}
    lon, lat = np.radians([[p[1], p[2]] for p in PLACES]).T
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    want = np.exp(-((2 * np.arcsin(np.sqrt(np.minimum(h, 1)))) ** 2) / (2 * bandwidth**2)).sum(1)
    assert got.keys() == {p[0] for p in PLACES}
    assert max(abs(got[p[0]] - w) for p, w in zip(PLACES, want)) < 1e-12


def test_kernel_sums_are_dealt_over_tasks(spark):
    """A table of a few KB isn't summed by one task, as its pairs are many, and none of it is broadcast."""
    points = spark.range(3000).select("id", (F.col("id") * 3701 % 36000 / 100 - 180).alias("x"), (F.col("id") * 1907 % 17000 / 100 - 85).alias("y"))
    spots = points.select("x", "y", F.lit(1).cast("long").alias("c"))
    found = sums.gaussian_on_globe(spots, 0.03, 0.255)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    dealt = sums._tasks(spots, 10**6)
    assert dealt == 16 * spark.sparkContext.defaultParallelism


def test_silhouettes_of_all_splits_from_one_pass(spark, small_blocks):
    points = spark.createDataFrame(PLACES, "id long, x double, y double")
    kernel = points.select("id", (F.col("id") % 11 + F.col("y")).alias("density")).join(points.groupBy("x", "y").agg(F.min("id").alias("id")), "id", "left").select("id", "density")
    kernel = points.join(points.select("x", "y", "id").join(kernel, "id").groupBy("x", "y").agg(F.max("density").alias("density")), ["x", "y"]).select("id", "density")
    got = density.threshold_clusters(points, kernel, range(20, 90, 20)).collect()
    assert [r["percentile"] for r in sorted(got)] == [20, 40, 60, 80]
    for r in got:
        split = points.join(kernel, "id").select("id", (F.col("density") >= r["threshold"]).cast("int").alias("label"), F.array("x", "y").alias("features"))
        assert clusters.silhouette(split).head()[0] == pytest.approx(r["silhouette"], abs=1e-12)
    one = points.select("id", F.lit(1.0).alias("density"))
    assert density.threshold_clusters(points, one).count() == 0  # one side is empty


def test_bandwidth_scores_in_small_blocks(spark, small_blocks):
    points = spark.createDataFrame(PLACES, "id long, x double, y double")
    got = {r["bandwidth"]: r["score"] for r in density.bandwidth_scores(points, [5.0, 20.0], 3).collect()}
    x, y, fold = (np.array(v, float) for v in zip(*[(p[1], p[2], p[0] % 3) for p in PLACES]))
    d = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    for h, score in got.items():
        others = (np.exp(-d / (2 * h * h)) * (fold[:, None] != fold)).sum(1) / (2 * np.pi * h * h * (fold[:, None] != fold).sum(1))
        assert score == pytest.approx(np.log(others + 1e-300).sum(), rel=1e-12)


def test_neighbours_on_the_globe_broadcast_nothing(spark):
    """Small tables too: what is small here, or looks so before rows are copied to 27 cubes, grows with the points."""
    points = spark.range(400).select("id", (F.col("id") * 37 % 360 - 180.0).alias("x"), (F.col("id") * 53 % 170 - 85.0).alias("y"))
    for found in (neighbors.within(points, 300.0), neighbors.nearest_on_globe(points, 3)):
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_optics_broadcasts_nothing(spark):
    points = spark.range(300).select("id", (F.col("id") % 60 / 10.0).alias("x"), (F.col("id") % 7 / 10.0).alias("y"))
    assert "BroadcastExchange" not in optics.labels(optics.optics(points, 3, 40.0), 20.0)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_nearest_vectors_far_from_the_origin(spark, shift):
    """Distances and ties are those of exact differences, also where squares of the vectors have no digits left for them."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(150, 8)), rng.integers(0, 2, (150, 8))]) + shift
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, features array<double>")
    got = {(r["id"], r["rank"]): (r["nbr_id"], r["dist"]) for r in neighbors.nearest_vectors(rows, 4, block=100).collect()}
    for i, x in enumerate(v):
        d = np.sqrt(((v - x) ** 2).sum(1))
        d[i] = np.inf
        want = sorted((d[j], j) for j in range(len(v)))[:4]
        assert [got[i, r + 1][0] for r in range(4)] == [j for _, j in want]
        assert np.allclose([got[i, r + 1][1] for r in range(4)], [w for w, _ in want], rtol=1e-14, atol=0)


def test_samples_without_calls_at_the_picked_loci_stay_in_the_plan(spark):
    rows = [(s, f"L{10 * (s % 2) + i}", (s + i) % 3) for s in range(40) for i in range(8)]
    dosages = spark.createDataFrame(rows, "sample long, locus string, dosage int")
    coords = spark.createDataFrame([(s, float(s * 8 % 90) if s % 5 else None, float(s * 7 % 60) if s % 5 else None) for s in range(40)], "sample long, x double, y double")
    config = pipeline.Config(max_snps=1, nboots=1, n_bins=2, params={"width": 4, "layers": 1, "epochs": 1, "patience": 1, "lr": 1e-2, "l2": 0.0, "dropout": 0.0})
    assert pipeline.run(dosages, coords, config)["summary"].count() == 40  # half of them have no call at the one locus


def test_grid_counts_each_place_once(spark):
    """A thousand copies of a place are one row of the products, and the estimate is that of all rows."""
    points = spark.range(40_000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    grid = density.grid_density(points, 5)
    assert "RepartitionByExpression" in grid._jdf.queryExecution().optimizedPlan().toString() or "Repartition " in grid._jdf.queryExecution().optimizedPlan().toString()
    few = density.grid_density(points.where("id < 35"), 5, weight="x").count()
    assert few == 25 and grid.count() == 25


def test_copies_and_near_vectors_are_met_once_each(spark):
    """Of equal vectors the first by id are met, so copies make no square; what single precision can't tell apart is told by differences."""
    rng = np.random.default_rng(5)
    v = np.concatenate([np.repeat(rng.normal(size=(2, 6)), 150, axis=0), 3 + 1e-9 * rng.normal(size=(200, 6))])
    ids = rng.permutation(len(v)) + 7
    kept = neighbors._first_of_equal(v, ids, 4)
    assert len(kept) == 8 + 200 and set(ids[kept][kept < 150]) == set(np.sort(ids[:150])[:4])
    rows = [(int(i), x.tolist()) for i, x in zip(ids, v)] + [(9000, None), (9001, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    for block, others in ((None, None), (150, None), (None, df.where("id % 3 = 0"))):
        there = np.ones(len(v), bool) if others is None else ids % 3 == 0
        got = {(r["id"], r["rank"]): (r["nbr_id"], r["dist"]) for r in neighbors.nearest_vectors(df, 3, block=block, others=others).collect()}
        assert len(got) == 3 * len(v)
        for i, x in zip(ids, v):
            d = np.sqrt(((v - x) ** 2).sum(1))
            want = sorted((e, j) for e, j, t in zip(d, ids, there) if t and j != i)[:3]
            assert [got[i, r + 1][0] for r in range(3)] == [j for _, j in want]


def test_silhouette_meets_equal_rows_once(spark):
    """The mean is that of all rows, also far from the origin and beside near rows; equal rows of a cluster are one row of the products."""
    rng = np.random.default_rng(8)
    v = np.concatenate([np.repeat(rng.normal(size=(3, 5)), 40, axis=0), rng.normal(size=(60, 5)), 2 + 1e-9 * rng.normal(size=(50, 5))]) + 1e4
    kind = rng.integers(0, 3, len(v))
    kind[-1] = 7  # alone in its cluster
    df = spark.createDataFrame([(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(kind, v))], "id long, label int, features array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    want = []
    for i, c in enumerate(kind):
        n = (kind == c).sum()
        b = min(d[i, kind == o].mean() for o in set(kind) - {c})
        a = d[i, kind == c].sum() / (n - 1) if n > 1 else None
        want.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    for block in (None, 30):
        assert math.isclose(clusters.silhouette(df, block=block).head()[0], np.mean(want), abs_tol=1e-10)
    assert clusters.silhouette(df.where("label = 7")).head()[0] is None and clusters.silhouette(df.limit(0)).head()[0] is None
