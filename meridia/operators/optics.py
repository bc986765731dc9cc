"""OPTICS on the globe: clusters at every radius from one forest of mutual reachability.

The core distance of a point is the radius within which it has `least` points, itself included; two points reach each other
at the largest of their core distances and their distance. The minimum spanning forest under that weight holds the clusters of
all radii: at a radius, points with a smaller core distance that its lighter edges connect are one cluster. The forest is
found by Borůvka's rounds as joins: every tree takes its lightest edge to another one, trees are merged, and edges within a
tree go; the number of trees at least halves with each round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.clusters import components
from meridia.operators.neighbors import near_pairs, nearest_on_globe
from meridia.operators.samples import numbered
from meridia.sources.folders import work_folder


@dataclass
class Reachability:
    """`points`: id and place; `places`: place, core (null beyond the largest radius); `near`: pairs of places (a, b, dist) in reach; `forest`: (a, b, weight)."""

    points: DataFrame
    places: DataFrame
    near: DataFrame
    forest: DataFrame
    most_km: float


def core_distances(places: DataFrame, least: int, most_km: float) -> DataFrame:
    """(place, core) of (id, x, y, c): c points stand on a place, and only the nearest least - 1 other places can matter."""
    if least <= 1:
        return places.select(F.col("id").alias("place"), F.lit(0.0).alias("core"))
    knn = nearest_on_globe(places.where(F.col("c") < least), least - 1, others=places.select("id", "x", "y"))
    within = F.sum("n").over(Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    met = knn.join(places.select(F.col("id").alias("nbr_id"), F.col("c").alias("n")).hint("merge"), "nbr_id").withColumn("n", within)
    far = met.join(places.select("id", "c").hint("merge"), "id").where(F.col("n") + F.col("c") >= least).groupBy("id").agg(F.min("dist").alias("far"))
    core = F.when(F.col("c") >= least, 0.0).when(F.col("far") <= most_km, F.col("far"))
    return places.join(far.hint("merge"), "id", "left").select(F.col("id").alias("place"), core.alias("core"))


def _forest(edges: DataFrame, folder: str) -> DataFrame:
    """The minimum spanning forest of (a, b, weight), a < b; ties of weight go to the smaller ends, so no cycle can close."""
    spark, step = edges.sparkSession, 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        df.write.parquet(f"{folder}/{step}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{step}")

    left = kept(edges.select("a", "b", "weight", F.col("a").alias("ta"), F.col("b").alias("tb")))  # with the trees of both ends
    taken = []
    while not left.isEmpty():
        e = F.struct("weight", "a", "b")
        sides = left.select(F.col("ta").alias("tree"), F.col("tb").alias("other"), e.alias("e")).union(left.select("tb", "ta", e))
        best = kept(sides.groupBy("tree").agg(F.min(F.struct("e", "other")).alias("m")).select("tree", "m.e", "m.other"))
        taken.append(best.select("e.a", "e.b", "e.weight").distinct())
        # each tree hangs on the one its edge leads to; of two that took the same edge the smaller is the root
        back = best.select(F.col("tree").alias("other"), F.col("e").alias("e2"))
        up = kept(best.join(back.hint("merge"), "other", "left").select("tree", F.when((F.col("e") == F.col("e2")) & (F.col("tree") < F.col("other")), F.col("tree")).otherwise(F.col("other")).alias("root")))
        while True:
            over = up.select(F.col("tree").alias("root"), F.col("root").alias("next"))
            new = kept(up.join(over.hint("merge"), "root").select("tree", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            up = new.select("tree", "root")
            if new.where("moved").isEmpty():
                break
        end = lambda t, r: up.select(F.col("tree").alias(t), F.col("root").alias(r)).hint("merge")  # noqa: B023, E731
        merged = left.join(end("ta", "ra"), "ta").join(end("tb", "rb"), "tb").where("ra <> rb")
        low, high = F.least("ra", "rb"), F.greatest("ra", "rb")
        # between two trees only the lightest edge can be taken
        left = kept(merged.groupBy(low.alias("ta"), high.alias("tb")).agg(F.min(e).alias("e")).select("e.a", "e.b", "e.weight", "ta", "tb"))
    if not taken:
        return edges.select("a", "b", "weight").limit(0)
    out = taken[0]
    for t in taken[1:]:
        out = out.union(t)
    return kept(out)


def optics(points: DataFrame, least: int = 4, most_km: float = 500.0) -> Reachability:
    """What labels() needs of (id, x, y), for all radii up to `most_km`.

    Points on one place are one row with their count, so a place with very many points is no pair. Points with a null
    coordinate are left out. All pairs of places within `most_km` are joined once, by cubes of that edge: the
    largest radius that is asked for should be given, not more.
    """
    spark, folder = points.sparkSession, work_folder(points, "optics")

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    known = points.where("x is not null and y is not null")
    spots = kept("spots", known.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("c")))
    of = points.select("id", "x", "y").join(spots.select("x", "y", F.col("id").alias("place")).hint("merge"), ["x", "y"], "left").select("id", "place")
    places = kept("places", core_distances(spots, least, most_km))
    a, b = spots.select(F.col("id").alias("a"), "x", "y"), spots.select(F.col("id").alias("b"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    near = kept("near", near_pairs(a, b, most_km).where("a < b").select("a", "b", "dist"))
    core = lambda name: places.select(F.col("place").alias(name), F.col("core").alias(f"core_{name}")).hint("merge")
    weighed = near.join(core("a"), "a").join(core("b"), "b").select("a", "b", F.greatest("dist", "core_a", "core_b").alias("weight"), (F.col("core_a").isNotNull() & F.col("core_b").isNotNull()).alias("both"))
    return Reachability(of, places, near, _forest(weighed.where("both").drop("both"), f"{folder}/forest"), most_km)


def labels(r: Reachability, radius_km: float) -> DataFrame:
    """(id, label) at a radius: the smallest id of the cluster's cores; -1 for noise.

    A point that is no core at that radius joins the cluster of the core that reaches it at the least distance (the larger
    of that core's core distance and their distance, ties by the smaller core), if that is within the radius.
    """
    if radius_km > r.most_km:
        raise ValueError(f"{radius_km} km are more than the {r.most_km} km that were prepared")
    cores = r.places.where(F.col("core") <= radius_km)
    tied = components(r.forest.where(F.col("weight") <= radius_km).select("a", "b"))
    core = cores.join(tied.withColumnRenamed("id", "place").hint("merge"), "place", "left").select("place", "core", F.coalesce("component", "place").alias("own"))
    in_reach = r.near.where(F.col("dist") <= radius_km)
    sides = in_reach.select("a", "b", "dist").union(in_reach.select("b", "a", "dist"))
    border = sides.join(core.select(F.col("place").alias("b"), "core", "own").hint("merge"), "b").groupBy(F.col("a").alias("place")).agg(F.min_by("own", F.struct(F.greatest("core", "dist"), F.col("b"))).alias("near"))
    placed = r.places.select("place").join(core.select("place", "own").hint("merge"), "place", "left").join(border.hint("merge"), "place", "left").select("place", F.coalesce("own", "near", F.lit(-1)).alias("label"))
    return r.points.join(placed.hint("merge"), "place", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def profile(r: Reachability, radii: list[float]) -> DataFrame:
    """(radius, clusters, noise): what labels() gives at each radius, from which one is chosen."""
    out = None
    for km in radii:
        found = labels(r, km).agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"), F.count_if(F.col("label") < 0).alias("noise")).select(F.lit(float(km)).alias("radius"), "clusters", "noise")
        out = found if out is None else out.union(found)
    return out


def bins(points: DataFrame, least: int = 4, radius_km: float = 500.0) -> DataFrame:
    """All columns of the points and `bin`: the number of their cluster from 0 in order of the clusters' smallest ids, -1 for noise."""
    found = labels(optics(points, least, radius_km), radius_km)
    numbers = numbered(found.where("label >= 0").select("label").distinct(), ["label"], "bin")
    placed = found.join(numbers.hint("merge"), "label", "left").select("id", F.coalesce("bin", F.lit(-1)).alias("bin"))
    return points.join(placed.hint("merge"), "id")
