"""Clusters: DBSCAN by connected components, k-means, silhouettes and the choice of k."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions.geo import EARTH_KM, unit_vector
from meridia.operators.neighbors import near_pairs
from meridia.sources.folders import work_folder


#: Nodes that a task ties to each other at once.
HELD_NODES = 200_000


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: each task ties what its rows connect to the smallest node, some 200,000 nodes at a time."""

    def run(batches):  # noqa: ANN001, ANN202
        above: dict = {}

        def top(x):  # noqa: ANN001, ANN202
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        def tied():  # noqa: ANN202
            pairs = [(top(x), x) for x in above]
            return pa.RecordBatch.from_arrays([pa.array([t for t, x in pairs if t != x], kind), pa.array([x for t, x in pairs if t != x], kind)], names=["a", "b"])

        kind = None
        for batch in batches:
            kind = kind or batch.schema.field("a").type
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                above.setdefault(x, x)
                above.setdefault(y, y)
                x, y = top(x), top(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
            if len(above) >= HELD_NODES:
                yield tied()
                above = {}
        if above:
            yield tied()

    return edges.select("a", "b").mapInArrow(run, T.StructType([T.StructField(c, edges.schema["a"].dataType) for c in "ab"]))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of the edges (a, b) reaches.

    Tasks first tie what their own edges connect. Then, round by round, each node is hooked to its first neighbour in an
    order (of ids at first, then by a new hash in each round, in which at most half of the nodes are expected to come before all
    of their neighbours), hooks are followed to their ends by doubling, and the ends' edges are tied again. So rounds grow with
    the logarithm of the nodes, on any graph. Tables between rounds are written to the shared folder; an edge of a node to
    itself gives that node a component of its own.
    """
    spark, folder, step = edges.sparkSession, work_folder(edges, "components"), 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        df.write.parquet(f"{folder}/{step}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{step}")

    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    left, roots, turn = kept(_stars(edges).distinct()), None, 0
    while not left.isEmpty():
        place = (lambda c: F.col(c)) if turn == 0 else (lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)), F.col(c)))
        both = left.union(left.select("b", "a")).toDF("id", "other")
        first = both.groupBy("id").agg(F.min_by("other", place("other")).alias("other"))
        up = kept(first.select("id", F.when(place("other") < place("id"), F.col("other")).otherwise(F.col("id")).alias("root")))
        while True:  # two steps at once, until nothing moves
            hop = lambda df, k: df.join(up.select(F.col("id").alias(f"r{k}"), F.col("root").alias(f"r{k + 1}")).hint("merge"), f"r{k}")  # noqa: B023, E731
            far = hop(hop(up.select("id", F.col("root").alias("r0")), 0), 1)
            moved = kept(far.select("id", F.col("r2").alias("root"), (F.col("r2") != F.col("r0")).alias("moved")))
            up = moved.select("id", "root")
            if moved.where("moved").isEmpty():
                break
        to = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        roots = up if roots is None else kept(roots.join(to.hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("root")))
        ends = left.join(up.select(F.col("id").alias("a"), F.col("root").alias("ra")).hint("merge"), "a").join(up.select(F.col("id").alias("b"), F.col("root").alias("rb")).hint("merge"), "b")
        ends = ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left, turn = kept(_stars(ends).distinct()), turn + 1
    if roots is None:
        return nodes.select("id", F.col("id").alias("component"))
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    return nodes.join(kept(roots.join(least.hint("merge"), "root").select("id", "component")).hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def dbscan(points: DataFrame, radius_km: float, least: int = 2) -> DataFrame:
    """(id, label): the smallest core id of a point's cluster; -1 for noise, and for points with a null coordinate.

    A core has at least `least` points within the radius, itself included. Cores in reach of each other are one cluster;
    another point joins the cluster of its smallest core in reach. Points on one place are one row with their count. All
    places of a cube whose diagonal is the radius are in reach of each other: where such a cube holds enough points, they
    are tied to its smallest one instead of in pairs, and two such cubes give one edge.
    """
    spark, folder = points.sparkSession, work_folder(points, "dbscan")

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    known = points.where("x is not null and y is not null")
    edge = 2 * math.sin(min(radius_km / EARTH_KM, math.pi) / 2) / math.sqrt(3) * (1 - 1e-9)
    cube = F.concat_ws(",", *[F.floor(c / edge).cast("string") for c in unit_vector(F.col("x"), F.col("y"))])
    places = known.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("c")).withColumn("cube", cube)
    full = places.groupBy("cube").agg(F.sum("c").alias("n"), F.min("id").alias("centre")).where(F.col("n") >= least)
    places = kept("places", places.join(full.select("cube", "centre"), "cube", "left").select("id", "x", "y", "c", F.when(F.col("centre").isNotNull(), F.col("cube")).alias("cube"), "centre"))
    left = places.select(F.col("id").alias("a"), "x", "y", F.col("c").alias("wa"), F.col("cube").alias("ca"))
    right = places.select(F.col("id").alias("b"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("c").alias("wb"), F.col("cube").alias("cb"))
    met = near_pairs(left, right, radius_km).where((F.col("a") < F.col("b")) & ~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)))
    both_full = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    key = lambda cube, own: F.when(both_full, F.col(cube)).otherwise(F.col(own).cast("string"))
    near = kept("near", met.groupBy(key("ca", "a").alias("ka"), key("cb", "b").alias("kb"), both_full.alias("cubes")).agg(F.min("a").alias("a"), F.min("b").alias("b"), F.first("wa").alias("wa"), F.first("wb").alias("wb")))
    single = near.where("not cubes")
    around = single.select(F.col("a").alias("id"), F.col("wb").alias("w")).union(single.select("b", "wa")).groupBy("id").agg(F.sum("w").alias("w"))
    cores = kept("cores", places.join(around, "id", "left").where(F.col("centre").isNotNull() | (F.col("c") + F.coalesce("w", F.lit(0)) >= least)).select("id"))
    inner = single.select("a", "b").join(cores.withColumnRenamed("id", "a"), "a", "left_semi").join(cores.withColumnRenamed("id", "b"), "b", "left_semi")
    inner = inner.select("a", "b").union(near.where("cubes").select("a", "b")).union(places.where("centre <> id").select(F.col("centre").alias("a"), F.col("id").alias("b")))
    core = kept("labels", cores.join(components(inner), "id", "left").select("id", F.coalesce("component", "id").alias("label")))
    sides = single.select("a", "b").union(single.select("b", "a"))
    border = sides.join(core.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min_by("label", "b").alias("near"))
    labelled = places.select("id", "x", "y").join(core, "id", "left").join(border, "id", "left").select("x", "y", F.coalesce("label", "near", F.lit(-1)).alias("label"))
    return points.select("id", "x", "y").join(labelled, ["x", "y"], "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def kmeans(points: DataFrame, k: int, features: str = "features", seed: int = 1) -> DataFrame:
    """All columns and `label` of k-means on an array column."""
    v = points.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="label").fit(v).transform(v).drop("__v")


def elbow(points: DataFrame, ks: list[int], features: str = "features", seed: int = 1) -> DataFrame:
    """(k, inertia) of a sweep."""
    v = points.select(array_to_vector(F.col(features).cast("array<double>")).alias("v")).persist()
    rows = [(k, float(KMeans(k=k, seed=seed, featuresCol="v").fit(v).summary.trainingCost)) for k in ks]
    v.unpersist()
    return points.sparkSession.createDataFrame(rows, "k int, inertia double")


#: Rows of a block of a silhouette, and the bytes of its features; rows and columns of the pairs held at once.
SILHOUETTE_ROWS, SILHOUETTE_BYTES = 65_536, 64_000_000
_ROWS, _COLS = 256, 1024


def _sums_to(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sums over y of Euclidean distances times weight (a column a cluster), for each row of x.

    Squares come from products of vectors about their mean; those with few digits left are taken from differences.
    """
    centre = y.mean(0)
    order = np.argsort(weight.argmax(1), kind="stable")  # a run of columns has few clusters
    y, weight = y[order], weight[order]
    cx, cy = x - centre, y - centre
    xx, yy = (cx * cx).sum(1), (cy * cy).sum(1)
    left, right = np.column_stack([-2 * cx, np.ones(len(x)), xx]), np.column_stack([cy, yy, np.ones(len(y))])
    some = [(slice(j, j + _COLS), np.flatnonzero(weight[j : j + _COLS].any(0)), yy[j : j + _COLS].max()) for j in range(0, len(y), _COLS)]
    some = [(to, kinds, np.ascontiguousarray(weight[to][:, kinds]), top) for to, kinds, top in some]
    out = np.zeros((len(x), weight.shape[1]))
    for i in range(0, len(x), _ROWS):
        part, far = left[i : i + _ROWS], xx[i : i + _ROWS].max()
        for to, kinds, own, top in some:
            d, least = part @ right[to].T, 1e-4 * (far + top)
            near = np.nonzero(~(d > least)) if not d.min() > least else (np.zeros(0, int),) * 2
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            for k in range(0, len(near[0]), 65_536):
                q, t = (v[k : k + 65_536] for v in near)
                d[q, t] = np.sqrt(((x[q + i] - y[t + to.start]) ** 2).sum(1))
            out[i : i + _ROWS, kinds] += d @ own
    return out


def silhouette(points: DataFrame, label: str = "label", features: str = "features", block: int | None = None) -> DataFrame:
    """The mean silhouette by Euclidean distance over all rows; a row alone in its cluster counts 0, one cluster alone gives null.

    Distances to all rows are the definition: equal rows of a cluster are one row with their count, blocks of them (of about `block`, by default
    65,536 or fewer long ones) meet blocks, and a task gives a row for each row of one block with its sums by cluster, never a row a pair.
    """
    spark, cores = points.sparkSession, points.sparkSession.sparkContext.defaultParallelism
    p = points.select(F.col(label).alias("label"), F.col(features).cast("array<double>").alias("v")).groupBy("label", "v").agg(F.count("*").alias("c")).withColumn("h", F.xxhash64("label", "v"))
    folder = work_folder(points, "silhouette")
    p.write.parquet(folder)
    p = spark.read.schema(p.schema).parquet(folder)
    size = p.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).head()
    n = max(1, size["n"])
    most = max(256, min(SILHOUETTE_ROWS, SILHOUETTE_BYTES // (8 * max(size["width"] or 1, 1))))
    parts = max(1, -(-n // most), min(-(-n // 2048), math.isqrt(8 * cores) + 1)) if block is None else -(-n // block)
    cut, every = F.pmod(F.col("h"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = p.select(F.monotonically_increasing_id().alias("row"), F.col("label").alias("label"), F.col("v").alias("v"), F.col("c").alias("c"), cut.alias("b")).withColumn("o", every)
    right = p.select(F.col("label").alias("of"), F.col("v").alias("w"), F.col("c").alias("many"), cut.alias("o2")).withColumn("b2", every)

    def matrix(t: pa.Table, column: str) -> np.ndarray:
        values = t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return values.reshape(t.num_rows, len(values) // t.num_rows)

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "label": (b if b.num_rows else a).column("of" if b.num_rows else "label").slice(0, 0), "c": pa.array([], pa.int64()), "to": (b if b.num_rows else a).column("of" if b.num_rows else "label").slice(0, 0), "s": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        coded = b.column("of").combine_chunks().dictionary_encode(null_encoding="encode")
        of, many, kinds = coded.indices.to_numpy(), b.column("many").to_numpy(), len(coded.dictionary)
        weight = np.zeros((len(of), kinds))
        weight[np.arange(len(of)), of] = many
        total = _sums_to(matrix(a, "v"), matrix(b, "w"), weight)
        each, to = pa.array(np.repeat(np.arange(a.num_rows), kinds)), pa.array(np.tile(np.arange(kinds), a.num_rows))
        own = a.select(["row", "label", "c"]).take(each)
        return own.append_column("to", coded.dictionary.take(to)).append_column("s", pa.array(total.ravel())).append_column("n", pa.array(np.tile(weight.sum(0).astype(np.int64), a.num_rows)))

    tasks = max(1, min(4 * parts * parts, 16 * cores))  # repartition() by a number isn't coalesced by size, as the work isn't in the bytes
    kind = p.schema["label"].dataType.simpleString()
    met = left.repartition(tasks, "b", "o").groupBy("b", "o").cogroup(right.repartition(tasks, "b2", "o2").groupBy("b2", "o2")).applyInArrow(sums, f"row long, label {kind}, c long, to {kind}, s double, n long")
    d = met.groupBy("row", "label", "c", "to").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("to")
    per = d.groupBy("row", "label", "c").agg(F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    s = F.when(F.col("b").isNotNull(), F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return per.agg((F.sum(s * F.col("c")) / F.sum(F.when(s.isNotNull(), F.col("c")))).alias("silhouette"))


def silhouette_k(points: DataFrame, ks: list[int], seed: int = 1) -> DataFrame:
    """(k, silhouette) of a sweep."""
    out = None
    for k in ks:
        one = silhouette(kmeans(points, k, seed=seed)).select(F.lit(k).alias("k"), "silhouette")
        out = one if out is None else out.union(one)
    return out


def sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("n"))


def median_genotypes(dosages: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, locus, median dosage) with labels (sample, cluster)."""
    return dosages.join(labels, "sample").groupBy("cluster", "locus").agg(F.median("dosage").alias("median"))


def oversampling_factor(samples: DataFrame, by: str) -> DataFrame:
    """(group, n, factor): the largest group's size divided by the group's, as a whole number."""
    n = samples.groupBy(by).agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("top"))
    return n.crossJoin(F.broadcast(top)).select(by, "n", F.floor(F.col("top") / F.col("n")).cast("long").alias("factor"))


def synthetic(samples: DataFrame, knn: DataFrame, factors: DataFrame, by: str) -> DataFrame:
    """(id, copy, nbr_id, x, y, weight): factor - 1 copies of each sample, halfway to a neighbour of its own.

    The neighbour of a copy is the one of rank (id + copy) modulo the sample's neighbours, plus 1: no random state.
    """
    copies = samples.join(factors.select(by, "factor"), by).where("factor > 1").withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("factor") - 1).cast("int"))))
    many = knn.groupBy("id").agg(F.max("rank").alias("k"))
    placed = copies.join(many, "id").withColumn("rank", ((F.col("id") + F.col("copy")) % F.col("k") + 1).cast("int")).join(knn.select("id", "rank", "nbr_id"), ["id", "rank"])
    other = samples.select(F.col("id").alias("nbr_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("weight").alias("nw"))
    half = lambda a, b: (F.col(a) + F.col(b)) / 2
    return placed.join(other, "nbr_id").select("id", "copy", "nbr_id", half("x", "nx").alias("x"), half("y", "ny").alias("y"), half("weight", "nw").alias("weight"))
