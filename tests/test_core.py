"""Operators on fixtures, kernels against closed forms, invariants, and all queries with SQL against DuckDB."""

import gzip
import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridia import queries as Q
from meridia import queries_files, queries_parts, queries_scale  # noqa: F401  they register their queries
from meridia.functions import genetics, geo, kernels
from meridia.operators import clusters, density, embedding, genotype, metrics, model, neighbors, outliers, resample, samples, search, spatial, summary
from meridia.plans import options, pipeline
from meridia.sources import files, outputs, sinks
from meridia.streaming import replicates

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def numpy_metrics(x, y, px, py) -> pd.Series:
    """The distance metrics by numpy."""
    x, y, px, py = (np.radians(np.asarray(v, float)) for v in (x, y, px, py))
    h = np.sin((py - y) / 2) ** 2 + np.cos(y) * np.cos(py) * np.sin((px - x) / 2) ** 2
    e = 2 * 6371.0 * np.arcsin(np.sqrt(h))
    q = np.percentile(e, [25, 50, 75])
    return pd.Series({"root_mean_squared_error": np.sqrt((e**2).mean()), "mean_dist": e.mean(), "median_dist": q[1], "stdev_dist": e.std(), "percentile_25": q[0], "percentile_75": q[2], "mad_haversine": np.median(np.abs(e - q[1])), "percent_within_50km": 100 * (e < 50).mean(), "mean_absolute_z_score": np.abs((e - e.mean()) / e.std()).mean(), "skewness": (((e - e.mean()) / e.std()) ** 3).mean()})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


#: The others are run at a larger scale by the driver; these stand for each part.
COMPARED = ["haversine", "scale_and_back", "coordinate_validity", "iupac_codes", "mode_imputation", "mendelian_hybrids", "bootstrap_loci", "choose_unknown", "stratified_split", "synchronise_samples", "bootstrap_summary", "metrics_distance_by_group", "metrics_correlations", "knn_globe", "knn_globe_at_least", "knn_vectors", "optimal_k_sweep", "combined_weights", "dbscan_labels", "density_levels", "merge_small_bins", "synthetic_samples", "loss_functions", "early_stopping", "variogram", "polynomial_features", "search_space", "vcf_dosages", "coordinates_by_tabs", "prediction_files", "metric_files", "outlier_file", "study_files", "region_file", "points_in_regions", "k_sums_geographic", "k_sums_genetic", "silhouette_of_labels", "threshold_clusters", "metrics_without_p_values", "weighted_draws", "smote", "contours_by_sample", "join_with_suffixes", "outlier_map", "training_history"]


@pytest.mark.parametrize("name", COMPARED)
def test_query_against_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=str)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-7)) for p, q in zip(x, y)), (x, y)


def test_every_query_has_a_name_of_its_own():
    assert set(Q.ORACLE) <= set(Q.QUERIES) and len(Q.QUERIES) > 100


# ---- kernels ----


def test_gamma():
    for x in (0.1, 1.0, 5.0, 30.0):
        assert math.isclose(kernels.gamma_cdf(x, 1.0), 1 - math.exp(-x), abs_tol=1e-12)
    assert math.isclose(kernels.gamma_cdf(kernels.gamma_ppf(0.95, 2.5, 3.0), 2.5, 3.0), 0.95, abs_tol=1e-9)
    draws = np.random.default_rng(1).gamma(2.5, 1 / 3.0, 200_000)
    assert abs(kernels.gamma_shape(draws.mean(), np.log(draws).mean()) - 2.5) < 0.05
    assert math.isclose(kernels.digamma(1.0), -0.5772156649015329, abs_tol=1e-12) and math.isclose(kernels.trigamma(1.0), math.pi**2 / 6, abs_tol=1e-10)


def test_student_and_kolmogorov():
    assert math.isclose(kernels.t_quantile(0.975, 10), 2.2281388519649385, abs_tol=1e-9)
    assert math.isclose(kernels.t_two_sided(2.2281388519649385, 10), 0.05, abs_tol=1e-9)
    assert kernels.correlation_p(1.0, 10) == 0.0 and math.isnan(kernels.correlation_p(0.3, 2))
    assert kernels.kolmogorov_p(0.0, 100) == 1.0 and kernels.kolmogorov_p(0.5, 100) < 1e-6
    assert math.isclose(kernels.normal_quantile(0.975), 1.959963984540054, abs_tol=1e-9)


def test_geodesic():
    assert np.allclose(kernels.geodesic_km(0, 0, 0, 1), 110.574, atol=2e-3) and np.allclose(kernels.geodesic_km(0, 0, 1, 0), 111.319, atol=2e-3)
    assert kernels.geodesic_km(5, 5, 5, 5)[0] == 0 and 19900 < kernels.geodesic_km(0, 0, 179.9, 0.1)[0] < 20100


def test_jenks_and_knee():
    breaks = kernels.jenks(np.array([1.0, 2, 3, 10, 11, 12]), np.ones(6), 2)
    assert breaks == [1.0, 3.0, 12.0]
    assert kernels.knee(np.arange(1, 11), np.array([5, 8, 9, 9.2, 9.3, 9.4, 9.5, 9.6, 9.7, 9.8])) == 2


def test_kriging_reproduces_points():
    pts = np.array([[0.0, 0], [1, 0], [0, 1], [2, 2]])
    z, v = kernels.krige(pts, np.array([1.0, 2, 3, 4]), pts, 1.0, 200.0, 0.0)
    assert np.allclose(z, [1, 2, 3, 4], atol=1e-4)


def test_jenks_uses_all_values(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.exponential(size=2300), 5 + rng.exponential(size=200)])  # beyond 2,000 different values
    breaks = density.jenks_thresholds(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 3)
    s = np.sort(v)
    spread = lambda x: ((x - x.mean()) ** 2).sum()
    total = lambda i, j: spread(s[:i]) + spread(s[i:j]) + spread(s[j:])
    assert set(breaks) <= set(v) and breaks[0] == s[0] and breaks[-1] == s[-1]
    i, j = (int(np.searchsorted(s, b, "right")) for b in breaks[1:3])
    assert all(total(i, j) <= total(i + a, j + b) + 1e-9 for a in range(-40, 41, 4) for b in range(-40, 41, 4))


# ---- sources and sinks ----

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\ts4
1\t10\ta\tA\tG\t.\t.\t.\tGT:DP\t0/0:3\t0|1:2\t1/1:9\t./.:0
1\t20\tb\tC\tT\t.\t.\t.\tDP:GT\t3:0/.\t2:1|0\t9:1\t0:./.
1\t30\tc\tA\tG,T\t.\t.\t.\tGT\t0/2\t0/1\t1/1\t./.
1\t40\td\tA\t.\t.\t.\t.\tGT\t0/0\t0/0\t0/0\t./.
1\t50\te\tG\tC\t.\t.\t.\tGT\t0/0\t0/0\t0/1\t./.
"""


@pytest.mark.parametrize("packed", [False, True])
def test_vcf(spark, tmp_path, packed):
    path = tmp_path / ("m.vcf.gz" if packed else "m.vcf")
    path.write_bytes(gzip.compress(VCF[:200].encode()) + gzip.compress(VCF[200:].encode()) if packed else VCF.encode())
    rows = {(r["locus"], r["sample"]): r for r in files.vcf(spark, str(path)).collect()}
    assert {k[0] for k in rows} == {"1:10:a", "1:20:b", "1:50:e"} and len(rows) == 12
    assert [rows["1:10:a", s]["iupac"] for s in ("s1", "s2", "s3", "s4")] == ["A", "R", "G", "N"]
    b = rows["1:20:b", "s1"]
    assert (b["a1"], b["a2"], b["is_missing"], b["iupac"]) == (0, None, True, "N")
    assert rows["1:20:b", "s3"]["iupac"] == "T"  # one allele stands for both
    d = genotype.encode(files.vcf(spark, str(path)).select("sample", "locus", "a1", "a2"))
    kept = genotype.filter_allele_count(genotype.drop_empty_samples(d), 2)
    assert {r["locus"] for r in kept.collect()} == {"1:10:a", "1:20:b"} and "s4" not in {r["sample"] for r in kept.collect()}
    assert {r["dosage"] for r in genotype.impute(kept).collect()} <= {0, 1, 2}


def test_vcf_takes_apart_calls_without_patterns(spark, tmp_path):
    head = VCF.split("\n")[0] + "\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{i}" for i in range(8))
    cells = ["0|1", ".", "", "1|.", "./1:3", "0/1/1", "1", "x/0"]
    (tmp_path / "m.vcf").write_text(head + "\r\n1\t10\ta\tA\tG\t.\t.\t.\tGT:DP\t" + "\t".join(cells) + "\r\n")
    calls = files.vcf(spark, str(tmp_path / "m.vcf"))
    assert [(r["a1"], r["a2"]) for r in calls.orderBy("sample").collect()] == [(0, 1), (None, None), (None, None), (1, None), (None, 1), (0, 1), (1, 1), (None, 0)]
    plan = calls._jdf.queryExecution().optimizedPlan().toString()
    assert "[/|]" not in plan and "regexp_replace" not in plan and "NOT" in plan


@pytest.mark.parametrize("sep", [",", "\t", " "])
def test_coordinates(spark, tmp_path, sep):
    path = tmp_path / "c.txt"
    path.write_text("\n".join(sep.join(r) for r in (("id", "lon", "lat"), ("s1", "1.5", "2"), ("s2", "NaN", "3"), ("7", "4", "5"))))
    got = {r["sample"]: (r["x"], r["y"]) for r in files.coordinates(spark, str(path)).collect()}
    assert got == {"s1": (1.5, 2.0), "s2": (None, 3.0), "7": (4.0, 5.0)}
    with pytest.raises(ValueError):
        files.known_coordinates(spark, str(path))
    (tmp_path / "bad").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.coordinates(spark, str(tmp_path / "bad"))


def test_prediction_and_metric_files(spark, tmp_path):
    for name in ("d1", "d2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "p.csv").write_text("sampleID,x,y\na,1,2\nb,3,4\n")
    got = files.predictions(spark, f"file://{tmp_path}/*/p.csv").collect()
    assert sorted((r["sample"], r["dataset"]) for r in got) == [("a", "d1"), ("a", "d2"), ("b", "d1"), ("b", "d2")]
    (tmp_path / "run_outlier_yes_weighted_no_oversample_none_metrics.csv").write_text("m\n1\n")
    assert files.metric_files(spark, f"file://{tmp_path}/*_metrics.csv").head()["config"] == "yes_no_none"


def test_config_and_params(tmp_path):
    (tmp_path / "c.yaml").write_text("# c\nmin_mac: 2\nname: 'x'  # note\nflag: True\nnone: null\nlist: [1, 2]\n")
    assert files.config(str(tmp_path / "c.yaml")) == {"min_mac": 2, "name": "x", "flag": True, "none": None, "list": [1, 2]}
    (tmp_path / "p.json").write_text('{"learning_rate": 0.1, "width": 8}')
    assert files.best_params(str(tmp_path / "p.json")) == {"lr": 0.1, "width": 8}
    with pytest.raises(ValueError):
        pipeline.Config.of({"nothing": 1})
    with pytest.raises(ValueError):
        pipeline.Config(train_split=0.9, val_split=0.2)


def test_regions(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    shapes = [{"properties": {"STATEFP": f, "NAME": n}, "geometry": {"type": "Polygon", "coordinates": [square]}} for f, n in (("05", "A"), ("06", "B"))]
    (tmp_path / "r.json").write_text(json.dumps({"features": shapes}))
    got = files.regions(spark, str(tmp_path / "r.json"), "5").collect()
    assert [r["name"] for r in got] == ["A"] and len(got[0]["ring"]) == 5
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, None, 1.0)], "id long, x double, y double")
    assert [r["id"] for r in spatial.clip(pts, [[(0, 0), (2, 0), (2, 2), (0, 2)]]).collect()] == [1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0, 2.0, "val"), ("a", 3.0, 4.0, "test")], "sample string, x double, y double, dataset string")
    sinks.predictions(df, f"{tmp_path}/p", ["dataset"])
    assert spark.read.csv(f"{tmp_path}/p", header=True).count() == 2
    sinks.outlier_ids(df, f"{tmp_path}/o")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/o").collect()] == ["a", "b"]
    trials = spark.createDataFrame([(0, 2.0), (1, 1.0)], "plan long, loss double")
    assert sinks.study(trials, f"{tmp_path}/s").head()["plan"] == 1


# ---- operators ----


def test_expressions(spark):
    df = spark.createDataFrame([("A", "G"), ("G", "A"), ("T", "T"), (None, "A"), ("A", "X")], "a string, b string")
    assert [r[0] for r in df.select(genetics.iupac(F.col("a"), F.col("b"))).collect()] == ["R", "R", "T", "N", "N"]
    one = spark.range(1)
    km = one.select(geo.haversine_km(F.lit(-92.0), F.lit(35.0), F.lit(-92.0), F.lit(36.0))).head()[0]
    assert abs(km - 111.195) < 1e-2
    for mode, allowed in (("mendel", {0: {0}, 1: {0, 1}, 2: {1}, 3: {0, 1, 2}, 4: {1, 2}}), ("no_hets", None), ("hets_only", None)):
        got = spark.range(400).select((F.col("id") % 3).cast("int").alias("a"), (F.col("id") / 3 % 3).cast("int").alias("b"), ((F.col("id") * 37 % 100) / 100).alias("u"))
        for r in got.select("a", "b", genetics.hybrid(F.col("a"), F.col("b"), F.col("u"), mode).alias("c")).collect():
            assert r["c"] in (0, 1, 2)
            if mode == "mendel":
                gametes = {0: {0}, 1: {0, 1}, 2: {1}}
                assert r["c"] in {p + q for p in gametes[r["a"]] for q in gametes[r["b"]]}


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform([-170, -80, -1, -1], [170, 80, 1, 1], (300, 4))
    rows = [(*map(float, (x, y, x + dx, y + dy)),) for x, y, dx, dy in a] + [(None, 1.0, 1.0, 1.0)]
    got = metrics.all_metrics(spark.createDataFrame(rows, "x double, y double, px double, py double")).toPandas().iloc[0]
    want = numpy_metrics(a[:, 0], a[:, 1], a[:, 0] + a[:, 2], a[:, 1] + a[:, 3])
    assert list(got.index) == metrics.NAMES and len(metrics.NAMES) == 27
    assert np.allclose(got[want.index].astype(float), want, rtol=1e-9)
    assert 0 < got["kolmogorov_smirnov"] < 0.2


def test_nearest_neighbours_on_globe_are_exact(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal([10, 89.5], 1, (60, 2)), rng.uniform([-180, -90], [180, 90], (40, 2)), [[179.9, 0], [-179.9, 0], [0, -90]]])
    p[:, 1] = np.clip(p[:, 1], -90, 90)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(999, None, 1.0)], "id long, x double, y double")
    got = {(r["id"], r["rank"]): r["nbr_id"] for r in neighbors.nearest_on_globe(df, 4).collect()}
    r = np.radians(p)
    h = np.sin((r[:, None, 1] - r[None, :, 1]) / 2) ** 2 + np.cos(r[:, None, 1]) * np.cos(r[None, :, 1]) * np.sin((r[:, None, 0] - r[None, :, 0]) / 2) ** 2
    d = 2 * 6371 * np.arcsin(np.sqrt(np.minimum(1, h)))
    np.fill_diagonal(d, np.inf)
    for i in range(len(p)):
        for k in range(4):
            assert math.isclose(d[i, got[i, k + 1]], np.sort(d[i])[k], abs_tol=1e-6)


def test_vectors_in_blocks(spark):
    x = np.random.default_rng(5).normal(size=(90, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {(r["id"], r["rank"]): r["nbr_id"] for r in neighbors.nearest_vectors(df, 3, block=20).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert all([got[i, k + 1] for k in range(3)] == list(np.argsort(d[i])[:3]) for i in range(90))


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(200).select(F.col("id").alias("sample"), (F.col("id") % 3).alias("cluster"))
    got = samples.split(df, 0.6, 0.4, F.xxhash64("sample")).groupBy("split").count().collect()
    n = {r["split"]: r["count"] for r in got}
    assert sum(n.values()) == 200 and set(n) == {"train", "val", "test"} and abs(n["train"] - 120) <= 3


def test_two_blobs(spark):
    pts = [(i, 0.01 * (i % 8), 0.01 * (i // 8)) for i in range(60)] + [(100 + i, 50 + 0.01 * i, 10.0) for i in range(6)] + [(500, -120.0, -60.0)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in pts], "id long, x double, y double")
    labels = {r["id"]: r["label"] for r in clusters.dbscan(df, 5.0).collect()}
    assert {labels[i] for i in range(60)} == {0} and {labels[100 + i] for i in range(6)} == {100} and labels[500] == -1
    f = clusters.oversampling_factor(df.where("id <> 500").withColumn("g", F.when(F.col("id") < 60, 0).otherwise(1)), "g")
    assert {r["g"]: r["factor"] for r in f.collect()} == {0: 1, 1: 10}
    w = {r["id"]: r["weight"] for r in density.dbscan_weights(clusters.dbscan(df, 5.0)).collect()}
    assert math.isclose(w[0], 1.0) and math.isclose(w[100], 10.0) and 1 < w[500] < 10
    hull = spatial.convex_hull(df.where("id < 60").withColumn("g", F.lit(1)), "g").collect()
    assert len(hull) >= 4


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))], "id long, x double, y double")
    g = density.grid_density(df, 60).toPandas()
    cell = (g.gx.max() - g.gx.min()) / 59 * (g.gy.max() - g.gy.min()) / 59
    assert 0.9 < g.density.sum() * cell < 1.01


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3)) @ np.array([[3, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0.2, 0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    out, share = embedding.pca(df, 2)
    z = np.stack(out.orderBy("id").toPandas()["features"])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(z), np.abs((u * s)[:, :2]), atol=1e-8) and np.isclose(share.sum(), 1)
    m = np.stack(embedding.mds(df, 2).orderBy("id").toPandas()["features"])
    assert np.allclose(np.abs(m), np.abs(z), atol=1e-6)
    cats = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.integers(0, 3, (50, 4)))], "id long, features array<double>")
    coords, inertia = embedding.mca(cats, 2)
    assert coords.count() == 50 and np.isclose(inertia.sum(), 2, atol=0.2)
    _, basis, error = embedding.nmf(df.withColumn("features", F.transform("features", lambda v: F.abs(v))), 2)
    assert (basis >= 0).all() and error < np.linalg.norm(x)
    assert len(embedding.polynomial(df).head()["features"]) == 1 + 4 + 10
    assert embedding.kernel_pca(df, 2).count() == 80


def test_kernel_pca_and_scaling_use_all_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 3)) * [3, 1, 0.5]  # more rows than the 500 that were once drawn
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(3)
    square = ((x[:, None] - x[None]) ** 2).sum(2)
    j = np.eye(700) - 1 / 700
    for got, m in ((embedding.kernel_pca(df, 3, 0.2, size=150), j @ np.exp(-0.2 * square) @ j), (embedding.mds(df, 3), -0.5 * j @ square @ j)):
        values, vectors = np.linalg.eigh(m)
        want = vectors[:, ::-1][:, :3] * np.sqrt(values[::-1][:3])
        z = np.stack(got.orderBy("id").toPandas()["features"])
        assert np.allclose(np.abs(z), np.abs(want), atol=1e-6)


def _cline(spark, n=200, loci=60, swap=()):
    rng = np.random.default_rng(7)
    xy = rng.uniform([-10, 30], [10, 50], (n, 2))
    a, b, c = rng.normal(size=loci) * 0.3, rng.normal(size=loci) * 0.3, rng.normal(size=loci)
    p = 1 / (1 + np.exp(-(a * xy[:, :1] + b * (xy[:, 1:] - 40) + c)))
    g = rng.binomial(2, p)
    place = xy.copy()
    for i in swap:
        place[i] = [-xy[i, 0], 80 - xy[i, 1]]
    return place, g


def test_planted_outliers(spark):
    place, g = _cline(spark, swap=())
    far = np.argsort(-np.abs(place[:, 0]) - np.abs(place[:, 1] - 40))[:5]
    place[far, 0], place[far, 1] = -place[far, 0], 80 - place[far, 1]
    df = spark.createDataFrame([(i, float(x), float(y), [float(v) for v in r]) for i, ((x, y), r) in enumerate(zip(place, g))], "id long, x double, y double, features array<double>")
    found = {r["id"] for r in outliers.detect_outliers(df, "geographic", k=10, level=0.02, rounds=2).collect()}
    assert len(found & set(map(int, far))) >= 3 and len(found) < 30


def test_outlier_passes_go_on_until_one_is_empty(spark, monkeypatch):
    rows = spark.range(60).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"), F.array(F.lit(0.0)).alias("features"))
    # each pass finds the largest id that is left, down to 42
    monkeypatch.setattr(outliers, "detect", lambda left, *_, **__: left.crossJoin(left.agg(F.max("id").alias("top"))).select("id", ((F.col("id") == F.col("top")) & (F.col("id") >= 42)).alias("is_outlier")))
    assert sorted(r["id"] for r in outliers.detect_outliers(rows, "geographic").collect()) == list(range(42, 60))
    assert sorted(r["id"] for r in outliers.detect_outliers(rows, "geographic", rounds=2).collect()) == [58, 59]


def test_pipeline_on_a_cline(spark):
    place, g = _cline(spark)
    d = spark.createDataFrame([(f"s{i}", j, int(v)) for i, r in enumerate(g) for j, v in enumerate(r)], "sample string, locus int, dosage int")
    c = spark.createDataFrame([(f"s{i}", None if i % 10 == 0 else float(x), None if i % 10 == 0 else float(y)) for i, (x, y) in enumerate(place)], "sample string, x double, y double")
    out = pipeline.run(d, c, pipeline.Config(nboots=2, n_bins=3, params={"width": 32, "layers": 1, "epochs": 60, "patience": 15, "lr": 0.01}))
    s = out["summary"].toPandas().set_index("sample")
    errors = [float(np.hypot(s.x_mean[f"s{i}"] - place[i, 0], s.y_mean[f"s{i}"] - place[i, 1])) for i in range(0, 200, 10)]
    spread = [float(np.hypot(*(place[i] - place.mean(0)))) for i in range(0, 200, 10)]
    assert len(s) == 200 and np.mean(errors) < 0.7 * np.mean(spread)
    assert samples.disjoint(out["samples"].where("split = 'train'"), out["samples"].where("split <> 'train'"))


def test_perceptron_round_trip():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = x[:, :2] * 0.5 + 0.1
    net = model.Perceptron(4, 16, 1).fit(x[:250], y[:250], np.ones(250), x[250:], y[250:], 80)
    assert min(net.losses) < 0.15 and np.allclose(model.Perceptron.loads(net.dumps()).predict(x), net.predict(x))
    assert model.widths(4, 100, 3) == [3, 3, 3]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, x double, y double, features array<double>")
    assert neighbors.nearest_on_globe(empty, 3).count() == 0 and neighbors.nearest_vectors(empty, 3).count() == 0
    assert spatial.kriging_surface(empty.withColumn("v", F.lit(1.0)), "v").count() == 0
    assert metrics.all_metrics(empty.select("x", "y", F.col("x").alias("px"), F.col("y").alias("py")), ["x"]).count() == 0
    assert density.jenks_thresholds(empty, "x", 3) == []


def test_streaming_summary(spark, tmp_path):
    q = Q.tv.boots(spark, SF).select("replicate", "sample", "x", "y")
    for k in range(3):
        q.where(F.col("replicate") % 3 == k).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "replicate int, sample long, x double, y double"
    replicates.start(replicates.running_summary(replicates.read(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r["sample"]: r["x_mean"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["sample"]: r["x_mean"] for r in summary.bootstrap(q).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in got)


def test_area_of_a_square(spark):
    square = [(1, 0, -93.0, 35.0), (1, 1, -92.9, 35.0), (1, 2, -92.9, 35.1), (1, 3, -93.0, 35.1)]
    km2 = resample.ring_area_km2(spark.createDataFrame(square, "g int, i int, x double, y double"), "g").head()["km2"]
    assert abs(km2 - 0.1 * 110.94 * 0.1 * 91.23) < 0.3


def test_weighted_draws(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 3.0)], "id long, w double")
    got = resample.weighted_draws(df, "w", 4000, (F.col("draw") + 0.5) / 4000.0).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {2: 1000, 3: 3000}


def test_options():
    assert options.jobs("-1") == -1 and options.split("0.5") == 0.5 and options.seed(None) is None and options.embedding("MDS", 2) == "mds"
    for f, bad in ((options.jobs, 0), (options.positive_int, -1), (options.split, 1.0), (options.verbosity, 4), (options.weighting, "both"), (options.neighbours, 1), (options.level, 0), (options.positive_float, 0)):
        with pytest.raises(ValueError):
            f(bad)
    with pytest.raises(ValueError):
        options.color_scale(5, 5)


# ---- parts that have no SQL, against plain versions -------------------------------------------------------------------


def test_losses_and_gradients():
    rng = np.random.default_rng(0)
    y = rng.random((20, 2)) * 0.5 + 0.25
    out, w = y + rng.normal(0, 0.05, (20, 2)), rng.random(20) + 0.5
    for kind in model.LOSSES:
        _, g = model.loss_and_gradient(kind, out, y, w)
        for i, j in ((0, 0), (3, 1), (19, 0)):
            e = np.zeros_like(out)
            e[i, j] = 1e-6
            slope = (model.loss_and_gradient(kind, out + e, y, w)[0] - model.loss_and_gradient(kind, out - e, y, w)[0]) / 2e-6
            assert abs(slope - g[i, j]) < 1e-6 * max(1, abs(slope))
    with pytest.raises(ValueError):
        model.loss_and_gradient("other", out, y, w)
    assert model.hidden_layers(10) == (5, 5) and model.hidden_layers(1) == (1, 1)


def test_training_over_files_equals_arrays(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    rows = [(i, "val" if i % 4 == 0 else "train", v.tolist(), float(0.5 + 0.1 * v[0]), float(0.5 + 0.1 * v[1]), 1.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, split string, features array<double>, tx double, ty double, weight double")
    plans = spark.createDataFrame([(0, '{"width": 2, "layers": 2, "epochs": 40}'), (1, '{"width": 2, "layers": 2, "epochs": 40, "medians": [0.0]}')], "plan long, params string")
    for rows_a_file in (1000, 60):
        monkeypatch.setattr(model, "FILE_ROWS", rows_a_file)
        got = {r["plan"]: r for r in model.train_all(df, plans).collect()}
        assert got[0]["loss"] < 0.05 and len(got[1]["curve"]) == 1
    fitted = model.train_all(df, plans)
    seen = model.predict(df, fitted).where("plan = 0").collect()
    assert len(seen) == 400 and all(r["valid"] == (abs(r["x"]) <= 180 and abs(r["y"]) <= 90) for r in seen)


def test_search_goes_on_where_it_stopped(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, "val" if i % 4 == 0 else "train", v.tolist(), float(0.5 + 0.1 * v[0]), 0.5, 1.0) for i, v in enumerate(rng.normal(size=(80, 4)))]
    df = spark.createDataFrame(rows, "id long, split string, features array<double>, tx double, ty double, weight double")
    first = search.tune(df, 4, 10, f"file://{tmp_path}/s", epochs=2, parallel=4).collect()
    both = search.tune(df, 8, 10, f"file://{tmp_path}/s", epochs=2, parallel=4).collect()
    assert [tuple(r) for r in both[:4]] == [tuple(r) for r in first] and [r["plan"] for r in both] == list(range(8))


def test_suggestions_move_to_good_values():
    rng, bounds = np.random.default_rng(4), {"lr": ("log", 1e-4, 1e-1), "layers": ("int", 2, 20)}
    trials = [(abs(np.log10(lr) + 2) + abs(n - 5) / 10, {"lr": lr, "layers": n}) for lr in (1e-4, 1e-3, 9e-3, 1.1e-2, 5e-2, 1e-1) for n in (2, 5, 12, 20)]
    got = [search.suggest(trials, bounds, rng) for _ in range(40)]
    assert all(1e-4 <= g["lr"] <= 1e-1 and 2 <= g["layers"] <= 20 and isinstance(g["layers"], int) for g in got)
    assert np.median([abs(np.log10(g["lr"]) + 2) for g in got]) < 0.75 and np.median([g["layers"] for g in got]) < 11
    assert search.medians([[3, 1], [2, 4]]) == [] and search.medians([[3, 1], [2, 4], [5], [1, 1], [4, 2]]) == [3, 1.5]


def test_lle_unrolls_a_curve(spark):
    t = np.linspace(0, 1, 80)
    rows = [(int(i), [float(np.cos(4 * a)), float(np.sin(4 * a)), float(a)]) for i, a in enumerate(t)]
    made, error = embedding.lle(spark.createDataFrame(rows, "id long, features array<double>"), 6, 1)
    got = [r["features"][0] for r in made.orderBy("id").collect()]
    assert abs(np.corrcoef(got, t)[0, 1]) > 0.97 and error < 1e-3
    with pytest.raises(ValueError):
        embedding.lle(made, 6, 1, most=10)
    grid = embedding.lle_grid(spark.createDataFrame(rows, "id long, features array<double>"), [5, 6], [1], folds=2).collect()
    assert len(grid) == 2 and grid[0]["score"] >= grid[1]["score"]


def test_nmf_finds_its_factors(spark):
    rng = np.random.default_rng(5)
    x = rng.random((60, 2)) @ rng.random((2, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    _, basis, error = embedding.nmf(df, 2, rounds=40)
    assert basis.shape == (2, 12) and (basis >= 0).all() and error < 0.05 * np.linalg.norm(x)
    assert len(embedding.nmf(df, None, rounds=3)[1]) in (2, 3)


def test_kriging_and_its_variogram(spark):
    rng = np.random.default_rng(6)
    xy = rng.uniform(-10, 10, (300, 2))
    rows = [(i, float(a), float(b), float(a + 2 * b)) for i, (a, b) in enumerate(xy)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = spatial.kriging_surface(p, "z", 6, buffer=-0.1, neighbours=16).toPandas()
    assert len(got) == 36 and np.abs(got.estimate - (got.gx + 2 * got.gy)).max() < 2.5 and (got.variance > -1e-6).all()
    nugget, sill, reach = spatial.fit_variogram(spark.createDataFrame([(i, 100, float(2 + 5 * (1 - np.exp(-(((i + 0.5) * 100 / (500 * 4 / 7)) ** 2))))) for i in range(10)], "lag int, n long, gamma double"), 100.0)
    assert abs(nugget - 2) < 0.3 and abs(sill - 7) < 0.3 and abs(reach - 500) < 60
    assert spatial.kriging_surface(p.where("false"), "z", 6).count() == 0


def test_silhouette_against_numpy(spark):
    rng = np.random.default_rng(7)
    x, label = rng.normal(size=(50, 3)), rng.integers(0, 3, 50)
    label[0] = 9  # alone
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "id long, label int, features array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = []
    for i, c in enumerate(label):
        own = (label == c) & (np.arange(50) != i)
        b = min(d[i, label == k].mean() for k in set(label) - {c})
        want.append((b - d[i, own].mean()) / max(b, d[i, own].mean()) if own.any() else 0.0)
    for block in (2048, 7):
        assert abs(clusters.silhouette(df, block=block).head()[0] - np.mean(want)) < 1e-9
    assert clusters.silhouette(df.where("label = 1")).head()[0] is None


def test_neighbours_on_one_place_and_over_the_date_line(spark):
    rows = [(i, 10.0, 20.0) for i in range(40)] + [(100, 179.9, 0.0), (101, -179.9, 0.0), (102, 0.0, 90.0), (103, 90.0, 89.9), (104, None, 1.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    got = {}
    for r in neighbors.nearest_on_globe(p, 3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nbr_id"], r["dist"]))
    assert len(got) == 44 and [n for _, n, _ in sorted(got[0])] == [1, 2, 3] and [n for _, n, _ in sorted(got[2])] == [0, 1, 3]
    assert sorted(got[100])[0][1] == 101 and sorted(got[102])[0][1] == 103
    assert [r["nbr_id"] for r in neighbors.nearest_on_globe(p.where("id = 3"), 2, with_self=True, others=p).orderBy("rank").collect()] == [0, 1]


def test_numbered_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = {r["v"]: r["i"] for r in samples.numbered(df, ["v"]).collect()}
    assert got == {v: v for v in range(1000)}
    assert samples.numbered(df.where("false"), ["v"]).count() == 0


def test_outputs(spark, tmp_path):
    place = outputs.Layout(str(tmp_path), "t")
    assert place.path("models", "m") == f"{tmp_path}/models/t_m"
    with pytest.raises(ValueError):
        place.path("other", "m")
    log = outputs.logger("meridia-test", str(tmp_path / "log.txt"))
    log.info("hello")
    outputs.logger("meridia-test")
    assert "hello" in (tmp_path / "log.txt").read_text() and outputs.clock(3723.9) == "01:02:03"
    models = spark.createDataFrame([(0, [2.0, 1.0])], "plan long, curve array<double>")
    sinks.loss_curves(models, f"{tmp_path}/curves")
    assert spark.read.json(f"{tmp_path}/curves").head()["curve"] == [2.0, 1.0]


def test_embeddings_by_name(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.integers(0, 3, (30, 8)).astype(float))], "id long, features array<double>")
    for kind in ("none", "polynomial", "pca", "mca", "nmf", "kernelpca", "mds", "lle"):
        assert embedding.embed(df, kind, 2).count() == 30
    with pytest.raises(ValueError):
        embedding.embed(df, "tsne")


def test_gamma_law_of_arrays():
    x = np.array([np.nan, -1, 0, 0.1, 1, 5, 20, 200, np.inf])
    got = kernels.gamma_cdf_of(x, 2.5, 0.7)
    assert np.isnan(got[0]) and (np.diff(got[1:]) >= 0).all() and got[-1] == 1 and abs(kernels.gamma_cdf(kernels.gamma_ppf(0.3, 2.5, 0.7), 2.5, 0.7) - 0.3) < 1e-9


def test_quantiles_by_bins_equal_those_of_one_task(spark):
    rng = np.random.default_rng(10)
    values = np.concatenate([rng.lognormal(0, 4, 30_000), np.full(20_000, 3.25), rng.integers(0, 5, 1000)])
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.61803, 0.95, 1.0]
    got, plain = summary.quantiles(df, "v", shares, few=0), summary.quantiles(df, "v", shares)
    assert np.allclose(got, np.quantile(values, shares), rtol=1e-12) and np.allclose(got, plain, rtol=1e-12)
    assert summary.quantiles(df.where("v is null"), "v", [0.5]) == [None]
    assert summary.quantiles(df.where("v = 3.25"), "v", [0.3], few=0) == [3.25]


def test_dbscan_against_plain(spark):
    rng = np.random.default_rng(11)
    xy = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(5, 0.05, (40, 2)), rng.uniform(-10, 10, (60, 2)), np.tile([[8.0, 8.0]], (5, 1))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(999, None, 1.0)], "id long, x double, y double")
    rad = np.radians(xy)
    h = np.sin((rad[:, None, 1] - rad[:, 1]) / 2) ** 2 + np.cos(rad[:, None, 1]) * np.cos(rad[:, 1]) * np.sin((rad[:, None, 0] - rad[:, 0]) / 2) ** 2
    near = 2 * 6371.0 * np.arcsin(np.sqrt(h)) <= 40
    for least in (1, 2, 4, 12):
        core, label = near.sum(1) >= least, list(range(len(xy)))
        for _ in range(len(xy)):
            new = [min([label[j] for j in np.flatnonzero(near[i] & core)], default=label[i]) if core[i] else label[i] for i in range(len(xy))]
            if new == label:
                break
            label = new
        want = {i: label[i] if core[i] else next((label[j] for j in np.flatnonzero(near[i] & core)), -1) for i in range(len(xy))}
        assert {r["id"]: r["label"] for r in clusters.dbscan(df, 40.0, least).collect()} == want | {999: -1}
