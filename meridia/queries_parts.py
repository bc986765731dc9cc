"""Queries of the parts that stand on several operators: bins, maps, histories, embeddings by name, joins by suffix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from meridia.operators import clusters, density, embedding, metrics, model, neighbors, resample, samples, search, summary, tables
from meridia.plans import pipeline
from meridia.queries import _GRID, _KDE, _hav, _placed, _training, query
from meridia.sources import testviews as tv
from meridia.sources.folders import work_folder

# ---- samples ----------------------------------------------------------------------------------------------------------


@query("p", "SELECT a.id AS id, R[a.x] AS x_left, R[b.x] AS x_right, a.g AS g_left, b.g AS g_right, R[b.km] AS km FROM p a JOIN (SELECT id, g, -x AS x, y+1 AS km FROM p WHERE id%3 = 0) b ON a.id = b.id")
def join_with_suffixes(spark, sf_dir):
    p = tv.points(spark, sf_dir).select("id", "g", "x")
    other = tv.points(spark, sf_dir).where("id % 3 = 0").select("id", "g", (-F.col("x")).alias("x"), (F.col("y") + 1).alias("km"))
    return samples.join_with_suffixes(p, other, "id", ("_left", "_right"))


@query("", "SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'string'), ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'string'), ('when', 'other')) AS t(name, kind)")
def column_kinds(spark, sf_dir):
    c = tv.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", F.current_timestamp().alias("when"))
    return spark.createDataFrame(list(samples.column_kinds(c).items()), "name string, kind string")


@query("p", "SELECT CAST(floor(sqrt(count(*))) AS INTEGER) AS by_root, CAST(floor(log2(count(*))) AS INTEGER) AS by_log FROM p")
def neighbour_counts(spark, sf_dir):
    p = tv.points(spark, sf_dir)
    return spark.createDataFrame([(samples.neighbour_count(p, "sqrt"), samples.neighbour_count(p, "log2"))], "by_root int, by_log int")


@query("p", "SELECT count(*) AS n, count(DISTINCT id) AS different, true AS same_order, true AS other_order FROM p")
def shuffled_samples(spark, sf_dir):
    p = tv.points(spark, sf_dir)

    def placed(seed: int, name: str):  # noqa: ANN202
        return samples.numbered(p.select("id", F.xxhash64("id", F.lit(seed)).alias("h")), ["h", "id"], name).select("id", name)

    both = placed(1, "one").join(placed(1, "again"), "id").join(placed(2, "other"), "id")
    same, other = F.bool_and(F.col("one") == F.col("again")), F.bool_or(F.col("one") != F.col("other"))
    return both.agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"), same.alias("same_order"), other.alias("other_order"))


@query("b", "SELECT tool, R[avg(x)] AS x_mean, R[median(x)] AS x_median, R[stddev_samp(x)] AS x_std, R[avg(y)] AS y_mean, R[median(y)] AS y_median, R[stddev_samp(y)] AS y_std FROM b GROUP BY 1")
def flat_names(spark, sf_dir):
    return summary.flat_names(tv.boots(spark, sf_dir), ["tool"], ["x", "y"])


# ---- densities and bins -------------------------------------------------------------------------------------------------


@query("p", """
WITH t AS (SELECT *, 1+id%5 AS w FROM p), s AS (SELECT sum(w) AS n, power(sum(w), 2)/sum(w*w) AS eff, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM t),
c AS (SELECT sum(w*(x-mx)*(x-mx))/any_value(n)/(1-1/any_value(eff)) AS vx, sum(w*(y-my)*(y-my))/any_value(n)/(1-1/any_value(eff)) AS vy, sum(w*(x-mx)*(y-my))/any_value(n)/(1-1/any_value(eff)) AS cv FROM t, s),
u AS (SELECT *, power(eff, -1/CAST(3 AS DOUBLE)) AS f, (vx*vy-cv*cv)*power(eff, -2/CAST(3 AS DOUBLE)) AS det FROM s, c),
g AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, x0+(x1-x0)*i/49 AS gx, y0+(y1-y0)*j/49 AS gy, u.* FROM u, (SELECT unnest(range(50)) AS i), (SELECT unnest(range(50)) AS j))
SELECT i, j, R[sum(w*exp(-((vy*(gx-x)*(gx-x)-2*cv*(gx-x)*(gy-y)+vx*(gy-y)*(gy-y))*f/det)/2)/(2*pi()*sqrt(det)*n))*1000] AS density FROM g, t GROUP BY 1, 2""")
def weighted_density_grid(spark, sf_dir):
    p = tv.points(spark, sf_dir).withColumn("w", 1 + F.col("id") % 5)
    return density.grid_density(p, 50, weight="w").select("i", "j", (F.col("density") * 1000).alias("density"))


@query("p", f"WITH {_GRID.format(n=100, m=99)} SELECT CAST(CAST(density*1000 >= 0.012 AS INTEGER)+CAST(density*1000 >= 0.016 AS INTEGER) AS INTEGER) AS bin, R[avg(gx)] AS cx, R[avg(gy)] AS cy FROM z GROUP BY 1")
def bin_centers(spark, sf_dir):
    return density.bin_centers(density.grid_density(tv.points(spark, sf_dir)), [1.2e-5, 1.6e-5])


@query("p", "SELECT count(*) AS n, true AS several, true AS all_large FROM p")
def kde_bins(spark, sf_dir):
    p = tv.points(spark, sf_dir)
    made, _ = density.kde_bins(p, 5)
    sizes = made.groupBy("bin").agg(F.count("*").alias("c"))
    return sizes.agg(F.sum("c").alias("n"), (F.count("*") > 1).alias("several"), (F.min("c") > 5).alias("all_large"))


_THRESHOLDS = f"""
WITH {_KDE}, c AS (SELECT CAST(unnest(range(5, 90, 5)) AS INTEGER) AS percentile, unnest(l) AS threshold FROM (SELECT quantile_cont(density, list_value({', '.join(f'{p}/100.0' for p in range(5, 90, 5))})) AS l FROM k)),
l AS (SELECT percentile, threshold, k.id, x, y, density >= threshold AS high FROM c, k JOIN p ON p.id = k.id),
d AS (SELECT a.percentile, any_value(a.threshold) AS threshold, a.id, a.high, b.high AS other, sum(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS s, count(*) AS n FROM l a JOIN l b ON a.percentile = b.percentile GROUP BY 1, 3, 4, 5),
m AS (SELECT percentile, any_value(threshold) AS threshold, id, max(CASE WHEN high = other AND n > 1 THEN s/(n-1) END) AS a, min(CASE WHEN high <> other THEN s/n END) AS b FROM d GROUP BY 1, 3)
SELECT percentile, R[any_value(threshold)] AS threshold, R[avg(coalesce((b-a)/greatest(a, b), 0))] AS silhouette FROM m GROUP BY 1 HAVING count(b) > 0"""


@query("p", _THRESHOLDS)
def threshold_clusters(spark, sf_dir):
    p = tv.points(spark, sf_dir)
    return density.threshold_clusters(p, density.kernel_sums(p))


@query("", "SELECT label, CAST(least(5, count(*)-1) AS INTEGER) AS k FROM embeddings GROUP BY 1")
def adaptive_neighbours(spark, sf_dir):
    return resample.adaptive_k(clusters.sizes(tv.vectors(spark, sf_dir)), "label")


# ---- maps, histories, times -----------------------------------------------------------------------------------------------


@query("p h", "SELECT sample AS id, R[x] AS x, R[y] AS y, CASE WHEN sample%7 = 0 OR sample%5 = 0 THEN 'Outlier' ELSE 'Non-Outlier' END AS status, CASE WHEN sample%35 = 0 THEN 'genetic,geographic' WHEN sample%7 = 0 THEN 'geographic' WHEN sample%5 = 0 THEN 'genetic' ELSE '' END AS spaces FROM h WHERE x IS NOT NULL")
def outlier_map(spark, sf_dir):
    h = tv.holed(spark, sf_dir).withColumnRenamed("sample", "id")
    found = h.where("id % 7 = 0").select("id", F.lit("geographic").alias("space")).union(h.where("id % 5 = 0").select("id", F.lit("genetic").alias("space")))
    return tables.outlier_map(h, found.union(found))


@query("p", f"""
WITH k AS (SELECT id, nbr_id, r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr_id) AS r FROM (SELECT a.id, b.id AS nbr_id, {_hav('a.x', 'a.y', 'b.x', 'b.y')} AS dist FROM p a, p b WHERE a.id <> b.id)) WHERE r <= 3),
l AS (SELECT *, CASE WHEN id%9 = 0 THEN 1 WHEN id%3 = 0 THEN 2 ELSE 3 END AS c FROM p), n AS (SELECT c, count(*) AS n FROM l GROUP BY 1), f AS (SELECT c, CAST(floor(max(n) OVER ()/n) AS BIGINT) AS factor FROM n),
s AS (SELECT l.*, CAST(unnest(range(1, factor)) AS INTEGER) AS copy FROM l JOIN f ON f.c = l.c WHERE factor > 1)
SELECT id, CAST(0 AS INTEGER) AS copy, R[x] AS x, R[y] AS y, CAST(c AS INTEGER) AS "group", 'original' AS origin FROM l
UNION ALL SELECT s.id, copy, R[(s.x+o.x)/2], R[(s.y+o.y)/2], CAST(c AS INTEGER), 'synthetic' FROM s JOIN k ON k.id = s.id AND r = (s.id+copy)%3+1 JOIN p o ON o.id = nbr_id""")
def oversampling_map(spark, sf_dir):
    p = tv.points(spark, sf_dir)
    c = p.withColumn("c", F.when(F.col("id") % 9 == 0, 1).when(F.col("id") % 3 == 0, 2).otherwise(3)).withColumn("weight", F.lit(1.0))
    made = clusters.synthetic(c, neighbors.nearest_on_globe(p, 3), clusters.oversampling_factor(c, "c"), "c")
    return tables.oversampling_map(c, made, "c")


@query("p", f"WITH {_KDE} SELECT p.id, R[x] AS x, R[y] AS y, R[density] AS density, R[density/max(density) OVER ()] AS share FROM p JOIN k ON k.id = p.id")
def density_map(spark, sf_dir):
    return tables.density_map(tv.points(spark, sf_dir))


@query("", "SELECT user_id AS plan, CAST(i AS INTEGER) AS epoch, R[loss] AS loss, loss <= min(loss) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS best FROM (SELECT user_id, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS i FROM events)")
def training_history(spark, sf_dir):
    curve = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"])
    return tables.history(tv.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("plan")).agg(curve.alias("curve")))


@query("", "SELECT event_type AS function, count(*) AS runs, R[sum(value)] AS total, R[avg(value)] AS mean, R[sum(value)/sum(sum(value)) OVER ()] AS share FROM events GROUP BY 1")
def times_table(spark, sf_dir):
    return tables.times(tv.table(spark, sf_dir, "events").select(F.col("event_type").alias("function"), F.col("value").alias("seconds")))


@query("", "SELECT trial AS plan, R[loss] AS loss, R[min(loss) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING)] AS best FROM (SELECT trial, abs(((trial+1)*7919%10007)/10007.0-0.3) AS loss FROM (SELECT unnest(range(100)) AS trial))")
def study_history(spark, sf_dir):
    u = ((F.col("trial") + 1) * 7919 % 10007) / 10007.0
    return search.best_so_far(model.search_plans(spark, 100, 64).select(F.col("trial").alias("plan"), F.abs(u - 0.3).alias("loss")))


@query("v", "WITH m AS (SELECT k, var_samp(f) AS s FROM v GROUP BY 1) SELECT CAST(64 AS INTEGER) AS axes, R[1.0] AS total, R[sum(s)] AS variance FROM m")
def explained_variance(spark, sf_dir):
    v = tv.vectors(spark, sf_dir)
    placed, shares = embedding.pca(v, 64)
    curve = embedding.explained(shares, v).agg(F.max("axis").alias("axes"), F.max("cumulative").alias("total"))
    spread = placed.select(F.posexplode("features").alias("k", "f")).groupBy("k").agg(F.var_samp("f").alias("s")).agg(F.sum("s").alias("variance"))
    return curve.crossJoin(F.broadcast(spread))  # one row


@query("v", "SELECT id, R[list_first(list(f ORDER BY k))] AS first, CAST(count(*) AS INTEGER) AS n FROM v GROUP BY 1")
def embedding_none(spark, sf_dir):
    return embedding.embed(tv.vectors(spark, sf_dir), "none").select("id", F.col("features")[0].alias("first"), F.size("features").alias("n"))


@query("", """
WITH s AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)
SELECT id, CAST(10 AS INTEGER) AS n, R[1+a+b+a*a+a*b+b*b+a*a*a+a*a*b+a*b*b+b*b*b] AS total, R[a*b*b] AS ninth FROM s""")
def polynomial_of_degree_three(spark, sf_dir):
    v = tv.vectors(spark, sf_dir).select("id", F.slice("features", 1, 2).alias("features"))
    p = embedding.polynomial(v, 3)
    return p.select("id", F.size("features").alias("n"), F.aggregate("features", F.lit(0.0), lambda s, x: s + x).alias("total"), F.col("features")[8].alias("ninth"))


@query()
def lle(spark, sf_dir):
    return embedding.lle(tv.vectors(spark, sf_dir), 8, 2)[0].select("id", F.col("features")[0].alias("l1"))


@query()
def nmf_by_error(spark, sf_dir):
    v = tv.vectors(spark, sf_dir).withColumn("features", F.transform("features", lambda x: F.abs(x)))
    _, basis, error = embedding.nmf(v, None, rounds=5)
    return spark.createDataFrame([(len(basis), float(error), bool((np.asarray(basis) >= 0).all()))], "k int, error double, positive boolean")


# ---- models and the plan ------------------------------------------------------------------------------------------------


@query("p v", "SELECT loss, count(*) AS n FROM (SELECT unnest(list_value('drms', 'huber', 'rmse')) AS loss), (SELECT DISTINCT id FROM v WHERE id IN (SELECT id FROM p)) GROUP BY 1")
def losses_in_training(spark, sf_dir):
    rows = _training(spark, sf_dir)
    plans = spark.createDataFrame([(i, f'{{"width": 16, "layers": 4, "epochs": 10, "loss_function": "{k}"}}') for i, k in enumerate(("drms", "huber", "rmse"))], "plan long, params string")
    names = F.element_at(F.create_map(*[F.lit(x) for pair in enumerate(("drms", "huber", "rmse")) for x in pair]), F.col("plan").cast("int"))
    return model.predict(rows, model.train_all(rows, plans)).where("x is not null").groupBy(names.alias("loss")).agg(F.count("*").alias("n"))


@query("d p", "SELECT count(DISTINCT sample) AS samples FROM d WHERE dosage IS NOT NULL AND sample IN (SELECT id FROM p)")
def whole_plan(spark, sf_dir):
    coords = tv.holed(spark, sf_dir).drop("g")
    few = tv.dosages(spark, sf_dir)
    config = pipeline.Config(max_snps=200, nboots=2, detect_outliers=True, k_range=(2, 10), weights=("kde", "cluster"), focus=((-100.0, 0.0, 0.0, 60.0),), oversample=True, params={"width": 32, "layers": 2, "epochs": 20, "patience": 5, "lr": 1e-2, "l2": 0.0, "dropout": 0.1})
    return pipeline.run(few, coords, config)["summary"].agg(F.count("*").alias("samples"))


@query()
def study(spark, sf_dir):
    rows = _training(spark, sf_dir)
    return search.tune(rows, 24, 64, work_folder(rows, "study"), epochs=10).select("plan", "loss", F.size("curve").alias("epochs"))


@query("p q e", f"SELECT CAST(id%3 AS INTEGER) AS part, R[avg(km)] AS mean_dist, R[quantile_cont(km, 0.75)] AS percentile_75 FROM e GROUP BY 1")
def metrics_of_parts(spark, sf_dir):
    e = metrics.errors(tv.pairs(spark, sf_dir)).withColumn("part", (F.col("id") % 3).cast("int"))
    return metrics.distance_metrics(e, ["part"]).select("part", "mean_dist", "percentile_75")
