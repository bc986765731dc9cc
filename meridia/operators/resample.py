"""Drawing, synthetic minority samples, boosted trees, areas, and tables of shapes of distributions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import kernels
from meridia.operators.neighbors import nearest_vectors
from meridia.operators.samples import numbered
from meridia.operators.summary import quantiles, running_totals


def weighted_draws(rows: DataFrame, weight: str, draws: int, uniform: Column, buckets: int = 1024, bucket: Column | None = None) -> DataFrame:
    """(draw, id): `draws` ids with replacement, each with a chance in proportion to its weight.

    `uniform` gives a number in [0, 1) from the column `draw`. Running sums are taken over buckets of ids and then within a
    bucket, so no window runs over all rows; a draw goes to its bucket first. `bucket` deals the ids, by their hash by default.
    """
    w = rows.select("id", F.col(weight).cast("double").alias("w")).where("w > 0").withColumn("bucket", F.pmod(F.xxhash64("id") if bucket is None else bucket, F.lit(buckets)).cast("int"))
    sums = w.groupBy("bucket").agg(F.sum("w").alias("s"))
    over = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    edges = sums.select("bucket", F.sum("s").over(over).alias("upper"), "s").withColumn("lower", F.col("upper") - F.col("s"))
    total = sums.agg(F.sum("s").alias("total"))
    d = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).select("draw", (uniform * F.col("total")).alias("u"))
    placed = d.join(F.broadcast(edges), (F.col("u") >= F.col("lower")) & (F.col("u") < F.col("upper"))).select("draw", "bucket", (F.col("u") - F.col("lower")).alias("v"))  # at most `buckets` rows
    within = w.select("id", "bucket", "w", F.sum("w").over(Window.partitionBy("bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).alias("top"))
    return placed.join(within, "bucket").where((F.col("v") < F.col("top")) & (F.col("v") >= F.col("top") - F.col("w"))).select("draw", "id")


def adaptive_k(sizes: DataFrame, label: str, k: int = 5) -> DataFrame:
    """(label, k): the neighbours that each class allows: at most `k`, and one less than its rows."""
    return sizes.select(label, F.least(F.lit(k), F.col("n") - 1).cast("int").alias("k"))


def smote(rows: DataFrame, label: str, copies: DataFrame, k: int = 5, share: Column | None = None) -> DataFrame:
    """(id, copy, label, features) of synthetic rows: features moved towards a neighbour of the same class by a share.

    `copies` has (label, copies) per class. Each copied class looks for its own neighbours, at most `k` and no more than it
    has; a class of one row gets none. `share`, in [0, 1), is by default a hash of id and copy.
    """
    few = rows.join(copies.where("copies > 0"), label)
    knn = nearest_vectors(few.select("id", "features", label), k, within=label).join(few.select(F.col("id").alias("nbr_id"), F.col("features").alias("nf")), "nbr_id")
    many = knn.groupBy("id").agg(F.max("rank").alias("m"))
    made = few.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).join(many, "id").withColumn("rank", ((F.col("id") + F.col("copy")) % F.col("m") + 1).cast("int"))
    share = F.pmod(F.xxhash64("id", "copy"), F.lit(10_000)) / 10_000.0 if share is None else share
    return made.join(knn.select("id", "rank", "nf"), ["id", "rank"]).withColumn("u", share).select("id", "copy", F.col(label), F.zip_with("features", "nf", lambda a, b: a + F.col("u") * (b - a)).alias("features"))


def edited(rows: DataFrame, label: str, k: int = 3) -> DataFrame:
    """Rows whose class is that of most of their k nearest neighbours (ties: the smaller class)."""
    votes = nearest_vectors(rows.select("id", "features"), k).join(rows.select(F.col("id").alias("nbr_id"), F.col(label).alias("v")), "nbr_id").groupBy("id", "v").agg(F.count("*").alias("c"))
    won = votes.groupBy("id").agg(F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("won"))
    return rows.join(won, "id").where(F.col(label) == F.col("won")).drop("won")


def smoteenn(rows: DataFrame, label: str, k: int = 5, edit_k: int = 3) -> DataFrame:
    """(id, copy, label, features): every class brought to the size of the largest by smote(), then what edited() leaves of all.

    Original rows have copy 0. Each row of a smaller class gets the same number of copies, and the first rows in an order by hash
    one more, until the sizes are equal; a class looks for at most `k` neighbours and no more than it has, and a class of
    one row gets no copies. Features are arrays of doubles, ids differ. An empty table gives an empty one.
    """
    base = rows.select("id", F.col(label).alias("label"), F.col("features").cast("array<double>").alias("features"))
    sizes = base.groupBy("label").agg(F.count("*").alias("n"))
    short = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("top")))).select("label", F.floor((F.col("top") - F.col("n")) / F.col("n")).alias("each"), ((F.col("top") - F.col("n")) % F.col("n")).alias("more"), "n")
    made = smote(base, "label", short.where("n > 1").select("label", (F.col("each") + F.when(F.col("more") > 0, 1).otherwise(0)).alias("copies")), k)
    placed = running_totals(base.select("id", "label", F.xxhash64("id").alias("h"), F.lit(1).alias("one")), ["label"], ["h", "id"], "one", "place").select("id", "place")
    limit = F.col("each") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)
    made = made.join(placed, "id").join(short, "label").where(F.col("copy") <= limit).select("id", "copy", "label", "features")
    whole = numbered(base.select("id", F.lit(0).alias("copy"), "label", "features").union(made), ["id", "copy"], "__n")
    left = edited(whole.select(F.col("__n").alias("id"), "label", "features"), "label", edit_k).select(F.col("id").alias("__n"))
    return whole.join(left, "__n").select("id", "copy", F.col("label").alias(label), "features")


def boosted(rows: DataFrame, test: DataFrame, rounds: int = 20, depth: int = 5, seed: int = 1) -> DataFrame:
    """(id, tx, ty) predicted by two forests of boosted trees, one an axis, fitted on (features, tx, ty, weight)."""
    vector = lambda df: df.withColumn("v", array_to_vector(F.col("features").cast("array<double>")))
    train, out = vector(rows).persist(), vector(test)
    for axis in ("tx", "ty"):
        out = GBTRegressor(featuresCol="v", labelCol=axis, weightCol="weight", predictionCol=f"p_{axis}", maxIter=rounds, maxDepth=depth, seed=seed).fit(train).transform(out)
    train.unpersist()
    return out.select("id", F.col("p_tx").alias("tx"), F.col("p_ty").alias("ty"))


def ring_area_km2(points: DataFrame, by: str, central: float = -93.0) -> DataFrame:
    """(group, km2): areas of rings given by (group, i, x, y), by transverse Mercator coordinates about a meridian (-93: zone 15) and the shoelace sum."""
    a, f, k0 = 6378.137, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    lat, lon = F.radians("y"), F.radians(F.col("x") - central)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(lat), F.lit(2.0)))
    t, c, q = F.pow(F.tan(lat), F.lit(2.0)), ep * F.pow(F.cos(lat), F.lit(2.0)), F.cos(lat) * lon
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * lat) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * lat) - (35 * e2**3 / 3072) * F.sin(6 * lat))
    east = k0 * n * (q + (1 - t + c) * F.pow(q, F.lit(3.0)) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(q, F.lit(5.0)) / 120)
    north = k0 * (m + n * F.tan(lat) * (q * q / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(q, F.lit(4.0)) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(q, F.lit(6.0)) / 720))
    p = points.select(by, "i", east.alias("e"), north.alias("n"))
    w = Window.partitionBy(by).orderBy("i")
    whole = Window.partitionBy(by).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda v: F.coalesce(F.lead(v).over(w), F.first(v).over(whole))
    cross = p.select(by, (F.col("e") * nxt("n") - nxt("e") * F.col("n")).alias("s"))
    return cross.groupBy(by).agg((F.abs(F.sum("s")) / 2).alias("km2"))


def box_statistics(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles, whisker ends (the farthest values within 1.5 interquartile ranges), the notch of the median, and values beyond."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = df.groupBy(*by).agg(q.alias("q"), F.count(value).alias("n"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.col(value).between(F.col("q")[0] - reach, F.col("q")[2] + reach)
    half = 1.57 * (F.first("q")[2] - F.first("q")[0]) / F.sqrt(F.first("n"))
    return df.join(s, by).groupBy(*by).agg(F.first("q")[0].alias("q25"), F.first("q")[1].alias("q50"), F.first("q")[2].alias("q75"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("beyond"), (F.first("q")[1] - half).alias("notch_low"), (F.first("q")[1] + half).alias("notch_high"))


def quantile_plot(df: DataFrame, value: str, places: int = 99) -> DataFrame:
    """(p, normal, observed): observed quantiles beside those of a normal law with the same mean and deviation."""
    ps = [(i + 1) / (places + 1) for i in range(places)]
    q = quantiles(df, value, ps)
    s = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).withColumn("q", F.array(*[F.lit(x).cast("double") for x in q]))
    z = F.array(*[F.lit(kernels.normal_quantile(p)) for p in ps])
    rows = s.select("m", "s", F.explode(F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), z.alias("z"), F.col("q"))).alias("r"))
    return rows.select("r.p", (F.col("m") + F.col("s") * F.col("r.z")).alias("normal"), F.col("r.q").alias("observed"))


def minority_distance(rows: DataFrame, label: str) -> DataFrame:
    """(id, distance): how far each row of the smallest class lies from that class' mean, by Euclidean distance."""
    small = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy("n", label).limit(1).select(label)
    own = rows.join(small, label, "left_semi").select("id", F.posexplode("features").alias("k", "v"))
    means = own.groupBy("k").agg(F.avg("v").alias("m"))
    return own.join(means, "k").groupBy("id").agg(F.sqrt(F.sum((F.col("v") - F.col("m")) ** 2)).alias("distance"))


