"""Queries of operators for large tables: axes of wide genotypes, neighbours by descent, clusters at every radius."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.operators import descent, metrics, notches, optics, outliers, resample, spatial, summary, wide
from meridia.queries import ORACLE, _hav, _placed, query
from meridia.sources import shapefiles, sinks
from meridia.sources import testviews as tv
from meridia.sources.folders import work_folder

#: Points within 400 km, core distances for three points, and clusters at three radii.
_OPTICS = f"""
WITH c AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, {_hav('a.x', 'a.y', 'b.x', 'b.y')} AS d FROM p a, p b WHERE a.id <> b.id) WHERE d <= 400),
k AS (SELECT a AS id, d AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM c) WHERE r = 2),
e AS (SELECT CAST(unnest([150.0, 250.0, 400.0]) AS DOUBLE) AS radius),
co AS (SELECT radius, id, core FROM k, e WHERE core <= radius),
link AS (SELECT co.radius, c.a, c.b, c.d, co.core AS core_b FROM c JOIN co ON co.id = c.b AND c.d <= co.radius),
r AS (SELECT radius, id, id AS to_id FROM co UNION SELECT r.radius, r.id, l.a FROM r JOIN link l ON l.radius = r.radius AND l.b = r.to_id JOIN co ON co.radius = l.radius AND co.id = l.a),
own AS (SELECT radius, id, min(to_id) AS label FROM r GROUP BY 1, 2),
near AS (SELECT l.radius, l.a AS id, arg_min(own.label, struct_pack(w := greatest(l.core_b, l.d), b := l.b)) AS label FROM link l JOIN own ON own.radius = l.radius AND own.id = l.b GROUP BY 1, 2)
"""


@query("p", f"{_OPTICS} SELECT e.radius, p.id, CAST(coalesce(own.label, near.label, -1) AS BIGINT) AS label FROM p CROSS JOIN e LEFT JOIN own ON own.radius = e.radius AND own.id = p.id LEFT JOIN near ON near.radius = e.radius AND near.id = p.id", recursive=True)
def optics_labels(spark, sf_dir):
    found, out = optics.optics(tv.points(spark, sf_dir), 3, 400.0), None
    for km in (150.0, 250.0, 400.0):
        one = optics.labels(found, km).select(F.lit(km).alias("radius"), "id", "label")
        out = one if out is None else out.union(one)
    return out


@query("p", f"{_OPTICS}, l AS (SELECT p.id, coalesce(own.label, near.label, -1) AS label FROM p LEFT JOIN own ON own.radius = 250 AND own.id = p.id LEFT JOIN near ON near.radius = 250 AND near.id = p.id) SELECT id, CASE WHEN label = -1 THEN -1 ELSE dense_rank() OVER (PARTITION BY label = -1 ORDER BY label) - 1 END AS bin FROM l", recursive=True)
def optics_bins(spark, sf_dir):
    return optics.bins(tv.points(spark, sf_dir), 3, 250.0).select("id", "bin")


@query()
def pca_wide(spark, sf_dir):
    """Coordinates of the samples on the first ten axes of all loci."""
    return wide.embed(tv.dosages(spark, sf_dir), "pca", 10).samples


@query()
def mca_wide(spark, sf_dir):
    """Coordinates of the samples on the first five axes of all loci's categories."""
    return wide.embed(tv.dosages(spark, sf_dir), "mca", 5).samples


@query()
def knn_descent(spark, sf_dir):
    """About the ten nearest vectors of each."""
    return descent.nearest(tv.vectors(spark, sf_dir), 10)


@query()
def k_sums_descent(spark, sf_dir):
    """The sweep over numbers of neighbours with neighbours by descent."""
    return outliers.k_sums(_placed(spark, sf_dir), "geographic", 2, 20, approximate=True)


#: How often a row counts in each of 200 replicates, by plain draws, and the two rows around the median.
_WEIGHTED = f"""
WITH ch AS (SELECT k, sum(exp(-1.0) / f) OVER (ORDER BY k) AS upto FROM (SELECT k, CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE) AS f FROM range({notches.MOST}) t(k))),
u AS (SELECT g, id, km, r, CAST(((id + 1) % {notches.PRIME} * 7919 + (r + 1) * 104729 + (id % {notches.PRIME}) * r * 31) % {notches.PRIME} AS DOUBLE) / {notches.PRIME} AS u FROM e, range(200) t(r)),
w AS (SELECT g, id, km, r, (SELECT count(*) FROM ch WHERE upto <= u) AS w FROM u),
c AS (SELECT g, km, r, w, sum(w) OVER (PARTITION BY g, r ORDER BY km, id) AS upto, sum(w) OVER (PARTITION BY g, r) AS total FROM w),
m AS (SELECT g, r, min(km) FILTER (upto > floor(0.5 * (total - 1))) AS a, min(km) FILTER (upto > ceil(0.5 * (total - 1))) AS b, any_value(0.5 * (total - 1) - floor(0.5 * (total - 1))) AS f FROM c WHERE total > 0 GROUP BY 1, 2)
"""


@query("p q e", f"{_WEIGHTED} SELECT g, R[quantile_cont(a * (1 - f) + b * f, 0.025)] AS low, R[quantile_cont(a * (1 - f) + b * f, 0.975)] AS high, count(*) AS replicates FROM m GROUP BY g")
def bootstrap_notch(spark, sf_dir):
    """The interval of the median error of each group."""
    e = metrics.errors(tv.pairs(spark, sf_dir))
    return notches.notch(e, "id", "km", ["g"], replicates=200, draw="modulo")


_BOXES = "b AS (SELECT g, floor(avg(x)) + 0.005 AS cx, floor(avg(y)) + 0.005 AS cy FROM p GROUP BY 1)"


def _maps(spark, sf_dir):
    """A region a group around its points' centre, with a hole in every third, as two zipped shapefiles."""
    centre = lambda c: F.floor(F.avg(c)) + 0.005
    boxes = tv.points(spark, sf_dir).groupBy("g").agg(centre("x").alias("cx"), centre("y").alias("cy"))
    corner = lambda dx, dy: F.struct((F.col("cx") + dx).cast("double").alias("x"), (F.col("cy") + dy).cast("double").alias("y"))
    ring = lambda r, turns: F.array(*[corner(r * dx, r * dy) for dx, dy in turns])
    outer = ring(40, [(-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1)])
    hole = ring(15, [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)])
    named = F.create_map(F.lit("NAME"), F.col("g").cast("string"), F.lit("STATEFP"), F.lpad(F.col("g").cast("string"), 2, "0"))
    rows = boxes.select(F.concat(F.lit("map"), F.col("g") % 2).alias("layer"), named.alias("attributes"), F.when(F.col("g") % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))
    folder = f"{work_folder(rows, 'maps')}"
    shapefiles.write(rows, folder)
    return folder


@query("p", f"WITH {_BOXES} SELECT CAST(b.g AS VARCHAR) AS name, lpad(CAST(b.g AS VARCHAR), 2, '0') AS statefp, count(*) AS n FROM b JOIN p ON abs(p.x - cx) < 40 AND abs(p.y - cy) < 40 AND NOT (b.g % 3 = 0 AND abs(p.x - cx) < 15 AND abs(p.y - cy) < 15) GROUP BY 1, 2")
def points_in_shapefiles(spark, sf_dir):
    found = shapefiles.regions(spark, _maps(spark, sf_dir))
    inside = spatial.in_regions(tv.points(spark, sf_dir), found.select("name", "ring", "holes"))
    return inside.groupBy("name").agg(F.count("*").alias("n")).select("name", F.lpad("name", 2, "0").alias("statefp"), "n")


@query("p", f"WITH {_BOXES} SELECT lpad(CAST(g AS VARCHAR), 2, '0') AS statefp, CAST(g AS VARCHAR) AS name, 0 AS part, 5 AS corners, CASE WHEN g % 3 = 0 THEN 1 ELSE 0 END AS holes, R[cx - 40] AS west, R[cy + 40] AS north FROM b WHERE g = 3")
def shapefile_state(spark, sf_dir):
    found = shapefiles.regions(spark, _maps(spark, sf_dir), fips="3")
    return found.select("statefp", "name", "part", F.size("ring").alias("corners"), F.size("holes").alias("holes"), F.array_min(F.transform("ring", lambda p: p["x"])).alias("west"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("north"))


_CUBIC = ORACLE["cubic_regression"].partition(" t AS (SELECT abs(y)/90")[2]


@query("p q e", f"""
WITH t AS (SELECT abs(y)/90{_CUBIC.partition("SELECT (round(my")[0].rstrip()},
c AS (SELECT my-c1*m+c2*(b*m-a2)+c3*(g*m-a3-d*(b*m-a2)) AS b0, c1-c2*b+c3*(d*b-g) AS b1, c2-c3*d AS b2, c3 AS b3 FROM a, f1, f2, f3),
grid AS (SELECT i, lo + (hi - lo) * i / 999 AS x FROM range(1000) r(i), (SELECT min(x) AS lo, max(x) AS hi FROM t)),
yy AS (SELECT i, x, b0 + b1 * x + b2 * x * x + b3 * x * x * x AS y FROM grid, c), dd AS (SELECT i, x, y, 1 - (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) - i / 999.0 AS d FROM yy),
tops AS (SELECT *, lag(d) OVER (ORDER BY i) AS before, lead(d) OVER (ORDER BY i) AS after, min(d) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM dd)
SELECT R[x] AS density, R[y] AS error FROM tops WHERE d >= before AND d >= after AND later < d - 1 / 999.0 ORDER BY i LIMIT 1""", digits=6)
def optimal_density(spark, sf_dir):
    """The knee of the errors' cubic curve over the density."""
    e = metrics.errors(tv.pairs(spark, sf_dir)).withColumn("s", F.abs("y") / 90)
    return spatial.optimal_density(e, "s", "km")


_RANKED = ", ".join(f"rank() OVER (PARTITION BY g ORDER BY {c}) + (count(*) OVER (PARTITION BY g, {c}) - 1) / 2.0 AS r_{c}" for c in ("x", "px", "y", "py"))


@query("p q", f"""
WITH k AS (SELECT *, {_RANKED} FROM q), c AS (SELECT g, corr(x, px) AS pearson_corr_longitude, corr(y, py) AS pearson_corr_latitude, corr(r_x, r_px) AS spearman_corr_longitude, corr(r_y, r_py) AS spearman_corr_latitude FROM k GROUP BY 1),
u AS (SELECT metric, value FROM c UNPIVOT (value FOR metric IN (pearson_corr_longitude, pearson_corr_latitude, spearman_corr_longitude, spearman_corr_latitude)))
SELECT metric, count(*) AS count, R[avg(value)] AS mean, R[stddev_samp(value)] AS std, R[min(value)] AS min, R[quantile_cont(value, 0.25)] AS q25, R[quantile_cont(value, 0.5)] AS q50, R[quantile_cont(value, 0.75)] AS q75, R[max(value)] AS max FROM u GROUP BY 1""")
def correlation_distributions(spark, sf_dir):
    """How the correlations of each group are spread."""
    c = metrics.correlations(metrics.errors(tv.pairs(spark, sf_dir)), ["g"])
    names = ["pearson_corr_longitude", "pearson_corr_latitude", "spearman_corr_longitude", "spearman_corr_latitude"]
    return summary.describe(summary.long_form(c, ["g"], names), ["metric"], "value")


@query("", "SELECT user_id AS plan, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS epoch, R[value] AS loss FROM events")
def loss_curve_files(spark, sf_dir):
    """Curves written as JSON and read again."""
    curve = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"])
    curves = tv.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("plan")).agg(curve.alias("curve"))
    path = f"{work_folder(curves, 'files')}/curves"
    sinks.loss_curves(curves, path)
    return spark.read.schema("plan long, curve array<double>").json(path).select("plan", F.posexplode("curve").alias("epoch", "loss"))


@query()
def smoteenn(spark, sf_dir):
    """All vectors with synthetic ones of the smaller labels, less those among other labels."""
    return resample.smoteenn(tv.vectors(spark, sf_dir), "label").select("id", "copy", "label")
