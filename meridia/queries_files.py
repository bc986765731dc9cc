"""Queries that write the star-schema views in the formats of files, read them again and give what was read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import genotype, metrics, model, spatial, summary
from meridia.queries import _hav, _training, query
from meridia.sources import files, outputs, sinks, variants
from meridia.sources import testviews as tv
from meridia.sources.folders import work_folder


def _written(lines: DataFrame, name: str) -> str:
    """The path of the one-column table as text in a new folder of the shared folder."""
    path = f"{work_folder(lines, 'files')}/{name}"
    lines.write.text(path)
    return path


def _one(spark: SparkSession, text: str, name: str) -> str:
    return _written(spark.createDataFrame([(text,)], "value string"), name)


def _vcf(spark: SparkSession, sf_dir: str) -> str:
    """The dosages as VCF: a record a locus, a column a sample; every tenth locus has a record of three alleles, too."""
    d = tv.dosages(spark, sf_dir)
    samples = d.agg(F.sort_array(F.collect_set("sample")).alias("s"))
    gt = F.when(F.col("dosage") == 0, "0/0:9").when(F.col("dosage") == 1, "0|1:9").when(F.col("dosage") == 2, "1/1:9").otherwise("./.:.")
    places = samples.select(F.posexplode("s").alias("i", "sample"))
    calls = d.join(F.broadcast(places), "sample").groupBy("locus").agg(F.collect_list(F.struct("i", gt.alias("gt"))).alias("m")).withColumn("m", F.sort_array("m"))
    rows = calls.crossJoin(F.broadcast(samples.select(F.size("s").alias("n"))))
    rows = rows.select("locus", variants.columns(F.col("m"), F.col("n"), ".").alias("cells"), F.explode(F.when(F.col("locus") % 10 == 0, F.array(F.lit("G"), F.lit("G,T"))).otherwise(F.array(F.lit("G")))).alias("alt"))
    record = F.concat_ws("\t", F.lit("1"), F.col("locus").cast("string"), F.concat(F.lit("L"), F.col("locus")), F.lit("A"), "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DP"), "cells")
    head = samples.select(F.concat(F.lit("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), F.array_join(F.transform("s", lambda x: x.cast("string")), "\t")).alias("value"))
    return _written(head.union(rows.select(record)), "calls.vcf")


_GRID_OF_CALLS = "SELECT s.sample, l.locus, d.dosage FROM (SELECT DISTINCT sample FROM d) s CROSS JOIN (SELECT DISTINCT locus FROM d) l LEFT JOIN d ON d.sample = s.sample AND d.locus = l.locus"


@query("d", _GRID_OF_CALLS)
def vcf_dosages(spark, sf_dir):
    calls = files.vcf(spark, _vcf(spark, sf_dir))
    out = genotype.encode(calls.select("sample", "locus", "a1", "a2"))
    return out.select(F.col("sample").cast("long").alias("sample"), F.element_at(F.split("locus", ":"), 2).cast("long").alias("locus"), F.col("dosage").cast("int").alias("dosage"))


@query("d", f"""
WITH t AS ({_GRID_OF_CALLS})
SELECT sample, count(*) AS records, count(*) FILTER (dosage IS NULL) AS missing, count(*) FILTER (dosage = 1) AS r, count(*) FILTER (dosage = 0) AS a FROM t GROUP BY 1""")
def vcf_codes(spark, sf_dir):
    calls = files.vcf(spark, _vcf(spark, sf_dir))
    return calls.groupBy(F.col("sample").cast("long").alias("sample")).agg(F.count("*").alias("records"), F.count_if("is_missing").alias("missing"), F.count_if(F.col("iupac") == "R").alias("r"), F.count_if(F.col("iupac") == "A").alias("a"))


_COORDINATES = "SELECT CAST(sample AS VARCHAR) AS sample, R[x] AS x, R[y] AS y FROM h"


def _coordinates(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    h = tv.holed(spark, sf_dir)
    path = f"{work_folder(h, 'files')}/coordinates"
    h.select(F.col("sample").alias("sampleID"), "x", "y").write.csv(path, header=True, sep=sep)
    return files.coordinates(spark, path)


@query("p h", _COORDINATES)
def coordinates_by_commas(spark, sf_dir):
    return _coordinates(spark, sf_dir, ",")


@query("p h", _COORDINATES)
def coordinates_by_tabs(spark, sf_dir):
    return _coordinates(spark, sf_dir, "\t")


@query("p", "SELECT CAST(id AS VARCHAR) AS sample, R[x] AS x, R[y] AS y FROM p")
def known_coordinates(spark, sf_dir):
    p = tv.points(spark, sf_dir)
    path = f"{work_folder(p, 'files')}/known"
    p.select(F.col("id").alias("sampleID"), "x", "y").write.csv(path, header=True, sep=" ")
    return files.known_coordinates(spark, path)


@query("b", "SELECT 'dataset=' || tool AS dataset, CAST(sample AS VARCHAR) AS sample, count(*) AS n, R[sum(x)] AS sx, R[sum(y)] AS sy FROM b GROUP BY 1, 2")
def prediction_files(spark, sf_dir):
    b = tv.boots(spark, sf_dir).withColumnRenamed("tool", "dataset")
    path = f"{work_folder(b, 'files')}/predictions"
    sinks.predictions(b, path, ["dataset"])
    return files.predictions(spark, f"{path}/*/*.csv").groupBy("dataset", "sample").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("b p", f"""
WITH s AS (SELECT b.replicate, b.sample%3 AS c, {_hav('b.x', 'b.y', 'p.x', 'p.y')} AS km FROM b JOIN p ON p.id = b.sample)
SELECT CASE c WHEN 0 THEN 'yes_no_none' WHEN 1 THEN 'no_no_none' ELSE 'no_yes_kmeans' END AS config, replicate, R[avg(km)] AS mean_dist, R[median(km)] AS median_dist FROM s GROUP BY 1, 2""")
def metric_files(spark, sf_dir):
    known = tv.points(spark, sf_dir).select(F.col("id").alias("sample"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    b = tv.boots(spark, sf_dir).join(known, "sample").select("replicate", (F.col("sample") % 3).alias("c"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("kx").alias("x"), F.col("ky").alias("y"))
    m = metrics.distance_metrics(metrics.errors(b), ["c", "replicate"]).persist()
    base = f"{work_folder(b, 'files')}/metrics"
    for c, name in ((0, "outlier_yes_weighted_no_oversample_none"), (1, "outlier_no_weighted_no_oversample_none"), (2, "outlier_no_weighted_yes_oversample_kmeans")):
        sinks.table(m.where(F.col("c") == c).drop("c"), f"{base}/{name}")
    m.unpersist()
    return files.metric_files(spark, f"{base}/*/*.csv").select("config", F.col("replicate").cast("int").alias("replicate"), F.col("mean_dist").cast("double"), F.col("median_dist").cast("double"))


@query("b p", f"WITH s AS (SELECT b.replicate, {_hav('b.x', 'b.y', 'p.x', 'p.y')} AS km FROM b JOIN p ON p.id = b.sample) SELECT replicate, R[avg(km)] AS mean_dist, R[stddev_pop(km)] AS stdev_dist, count(*) AS n FROM s GROUP BY 1")
def replicate_metric_files(spark, sf_dir):
    known = tv.points(spark, sf_dir).select(F.col("id").alias("sample"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    b = tv.boots(spark, sf_dir).join(known, "sample").select("replicate", F.col("x").alias("px"), F.col("y").alias("py"), F.col("kx").alias("x"), F.col("ky").alias("y"))
    path = f"{work_folder(b, 'files')}/replicates"
    sinks.replicate_metrics(metrics.distance_metrics(metrics.errors(b), ["replicate"]), path)
    return spark.read.schema("mean_dist double, stdev_dist double, n long, replicate int").json(path).select("replicate", "mean_dist", "stdev_dist", "n")


@query("b", "SELECT sample, R[avg(x)] AS x_mean, R[median(y)] AS y_median, R[sqrt(var_samp(x)+var_samp(y))] AS drms FROM b GROUP BY 1")
def summary_file(spark, sf_dir):
    b = tv.boots(spark, sf_dir)
    path = f"{work_folder(b, 'files')}/summary"
    sinks.table(summary.bootstrap(b), path)
    return spark.read.csv(path, header=True).selectExpr("CAST(sample AS BIGINT) AS sample", "CAST(x_mean AS DOUBLE) AS x_mean", "CAST(y_median AS DOUBLE) AS y_median", "CAST(drms AS DOUBLE) AS drms")


@query("p", "SELECT row_number() OVER (ORDER BY CAST(id AS VARCHAR)) AS place, CAST(id AS VARCHAR) AS sample FROM p WHERE id%7 = 0")
def outlier_file(spark, sf_dir):
    found = tv.points(spark, sf_dir).where("id % 7 = 0").select(F.col("id").alias("sample"))
    path = f"{work_folder(found, 'files')}/outliers"
    sinks.outlier_ids(found.union(found), path)
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("sample"))
    return lines.selectExpr("row_number() OVER (ORDER BY regexp_extract(file, 'part-([0-9]+)', 1), at) + 0L AS place", "sample")


@query("", "SELECT * FROM (VALUES ('fit', 1), ('predict', 2)) AS t(name, n)")
def timing_file(spark, sf_dir):
    times, points = outputs.Timings(), tv.points(spark, sf_dir)
    for name, n in (("fit", 1), ("predict", 2)):
        for _ in range(n):
            with times.step(name):
                points.count()
    path = outputs.Layout(work_folder(points, "files")).path("benchmarking", "execution_times")
    sinks.timings(times.table(spark), path)
    read = spark.read.csv(path, header=True)
    return read.where(F.col("Execution Time").cast("double") > 0).groupBy(F.col("Function Name").alias("name")).agg(F.count("*").cast("int").alias("n"))


@query("", """
WITH t AS (SELECT trial AS plan, abs(((trial+1)*7919%10007)/10007.0-0.3) AS loss FROM (SELECT unnest(range(100)) AS trial))
SELECT 'trial' AS kind, plan, R[loss] AS loss FROM t UNION ALL SELECT 'best', plan, R[loss] FROM (SELECT * FROM t ORDER BY loss, plan LIMIT 1)""")
def study_files(spark, sf_dir):
    u = ((F.col("trial") + 1) * 7919 % 10007) / 10007.0
    trials = model.search_plans(spark, 100, 64).select(F.col("trial").alias("plan"), F.abs(u - 0.3).alias("loss"), "lr", "width")
    path = f"{work_folder(trials, 'files')}/study"
    sinks.study(trials, path)
    both = spark.read.csv(f"{path}/trials", header=True).select(F.lit("trial").alias("kind"), F.col("plan").cast("long"), F.col("loss").cast("double"))
    return both.union(spark.read.schema("plan long, loss double").json(f"{path}/best").select(F.lit("best"), "plan", "loss"))


@query("", "SELECT * FROM (VALUES ('min_mac', '2'), ('prefix', '\"run one\"'), ('verbose', 'true'), ('known_sample_data', 'null'), ('klim', '[2, 50]'), ('dropout_prop', '0.25'), ('lr', '0.001'), ('width', '64')) AS t(key, value)")
def configuration_files(spark, sf_dir):
    yaml = _one(spark, "# options\nmin_mac: 2\nprefix: 'run one'\nverbose: True\nknown_sample_data: None\nklim: [2, 50]  # range\n", "config.yaml")
    best = _one(spark, '{"learning_rate": 0.001, "width": 64, "dropout": 0.25}', "best.json")
    found = files.config(yaml, spark) | files.best_params(best, spark)
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in found.items()], "key string, value string")


def _squares(spark: SparkSession) -> str:
    """Three regions: a square, two squares in one, and a square with a hole."""
    square = lambda x, y, r: [[x - r, y - r], [x + r, y - r], [x + r, y + r], [x - r, y + r], [x - r, y - r]]
    shapes = [("5", "Plain", "Polygon", [square(-90.005, 30.005, 20)]), ("5", "Islands", "MultiPolygon", [[square(0.005, 0.005, 10)], [square(60.005, -40.005, 15)]]), ("48", "Ring", "Polygon", [square(100.005, 20.005, 30), square(100.005, 20.005, 12)]), ("48", "Spot", "Point", [1.0, 2.0])]
    features = [{"type": "Feature", "properties": {"STATEFP": s.zfill(2), "NAME": n}, "geometry": {"type": t, "coordinates": c}} for s, n, t, c in shapes]
    return _one(spark, json.dumps({"type": "FeatureCollection", "features": features}), "regions.geojson")


@query("", "SELECT * FROM (VALUES ('05', 'Plain', 0, 5, 0), ('05', 'Islands', 0, 5, 0), ('05', 'Islands', 1, 5, 0), ('48', 'Ring', 0, 5, 1)) AS t(statefp, name, part, corners, holes)")
def region_file(spark, sf_dir):
    return files.regions(spark, _squares(spark)).select("statefp", "name", "part", F.size("ring").alias("corners"), F.size("holes").alias("holes"))


_IN = "abs(x-({x}))<{r} AND abs(y-({y}))<{r}"


@query("p", f"""
SELECT id, 'Plain' AS name FROM p WHERE {_IN.format(x=-90.005, y=30.005, r=20)} UNION ALL
SELECT id, 'Islands' FROM p WHERE ({_IN.format(x=0.005, y=0.005, r=10)}) OR ({_IN.format(x=60.005, y=-40.005, r=15)}) UNION ALL
SELECT id, 'Ring' FROM p WHERE {_IN.format(x=100.005, y=20.005, r=30)} AND NOT ({_IN.format(x=100.005, y=20.005, r=12)})""")
def points_in_regions(spark, sf_dir):
    return spatial.in_regions(tv.points(spark, sf_dir), files.regions(spark, _squares(spark))).select("id", "name")


@query("p", f"SELECT name, count(*) AS n FROM (SELECT 'Islands' AS name FROM p WHERE ({_IN.format(x=0.005, y=0.005, r=10)}) OR ({_IN.format(x=60.005, y=-40.005, r=15)})) GROUP BY 1")
def named_regions_of_a_state(spark, sf_dir):
    found = spatial.named(files.regions(spark, _squares(spark), "5"), ["Islands", "Ring"])
    return spatial.in_regions(tv.points(spark, sf_dir), found).groupBy("name").agg(F.count("*").alias("n"))


@query("", "SELECT vec_id AS id, true AS same FROM embeddings e JOIN customer c ON c.c_custkey = e.vec_id")
def model_file(spark, sf_dir):
    rows = _training(spark, sf_dir)
    plans = spark.createDataFrame([(0, '{"width": 8, "layers": 2, "epochs": 3}')], "plan long, params string")
    fitted = model.train_all(rows, plans).persist()
    path = outputs.Layout(work_folder(rows, "files")).path("models", "perceptron")
    sinks.models(fitted, path)
    before, after = model.predict(rows, fitted), model.predict(rows, spark.read.parquet(path))
    fitted.unpersist()
    both = before.join(after.select("id", F.col("x").alias("x2"), F.col("y").alias("y2")), "id")
    return both.select("id", ((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))).alias("same"))


@query("", "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def debug_dump(spark, sf_dir):
    v = tv.vectors(spark, sf_dir)
    path = outputs.Layout(work_folder(v, "files")).path("data", "vectors")
    sinks.dump(v, path, False)
    sinks.dump(v, path, True)
    return spark.read.csv(path, header=True).select("id", F.size(F.split("features", ",")).alias("n"))


_PLACED = "SELECT s.sample, 'c' || (l.locus % 3) AS chrom, l.locus AS pos, d.dosage FROM (SELECT DISTINCT sample FROM d) s CROSS JOIN (SELECT DISTINCT locus FROM d) l LEFT JOIN d ON d.sample = s.sample AND d.locus = l.locus"


def _blocks(spark: SparkSession, sf_dir: str) -> str:
    """The calls as a folder of block-compressed VCF files with indexes; loci stand on three sequences."""
    calls = tv.calls(spark, sf_dir)
    names = [str(r["sample"]) for r in calls.select("sample").distinct().orderBy("sample").collect()]  # the columns of the header
    rows = calls.select(F.concat(F.lit("c"), F.col("locus") % 3).alias("chrom"), F.col("locus").alias("pos"), F.concat(F.lit("L"), "locus").alias("id"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), "sample", "a1", "a2")
    folder = f"{work_folder(calls, 'files')}/blocks"
    variants.write(variants.records(rows, names), variants.header(names), folder)
    return folder


@query("d", f"""
WITH t AS ({_PLACED})
SELECT chrom, sample, count(*) AS records, count(*) FILTER (dosage IS NULL) AS missing, CAST(sum(dosage) AS BIGINT) AS alternative, max(pos) AS last FROM t GROUP BY 1, 2""")
def vcf_blocks(spark, sf_dir):
    calls = variants.read(spark, _blocks(spark, sf_dir), range_bytes=1 << 18)
    return calls.groupBy("chrom", F.col("sample").cast("long").alias("sample")).agg(F.count("*").alias("records"), F.count_if("is_missing").alias("missing"), F.sum((F.col("a1") + F.col("a2")).cast("long")).alias("alternative"), F.max("pos").alias("last"))


_REGION = "chrom = 'c1' AND pos BETWEEN 40 AND 130"


@query("d", f"WITH t AS ({_PLACED}) SELECT sample, pos, dosage FROM t WHERE {_REGION} AND sample IN (1, 3, 5, 8)")
def vcf_region(spark, sf_dir):
    calls = variants.read(spark, _blocks(spark, sf_dir)).where(f"{_REGION} AND sample IN ('1', '3', '5', '8')")
    return calls.select(F.col("sample").cast("long").alias("sample"), "pos", (F.col("a1") + F.col("a2")).alias("dosage"))


@query("d", f"WITH t AS ({_PLACED}) SELECT chrom, pos, count(*) AS samples, CAST(sum(dosage) AS BIGINT) AS alternative FROM t WHERE chrom IN ('c0', 'c2') AND pos >= 60 GROUP BY 1, 2")
def vcf_joined(spark, sf_dir):
    folder = _blocks(spark, sf_dir)
    one = folder + ".vcf.gz"
    variants.joined(folder, one)
    calls = variants.read(spark, one, range_bytes=1 << 18).where("chrom IN ('c0', 'c2') AND pos >= 60")
    return calls.groupBy("chrom", "pos").agg(F.count("*").alias("samples"), F.sum((F.col("a1") + F.col("a2")).cast("long")).alias("alternative"))
