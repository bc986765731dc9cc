"""Outliers by nearest neighbours and a gamma law.

Geographic outliers: coordinates are predicted from genetic neighbours; genetic ones: genotypes from geographic neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import kernels
from meridia.functions.geo import haversine_km, inverse_distance, zero_floor
from meridia.operators import descent, neighbors
from meridia.sources.folders import work_folder


def dgeo(px: Column, py: Column, x: Column, y: Column, scale: float = 100.0) -> Column:
    """The great-circle distance of prediction and truth over a scale, floored."""
    return zero_floor(haversine_km(px, py, x, y) / scale, genetic=False)


def rescale(stats: DataFrame, most: float = 20.0) -> DataFrame:
    """`d` divided by the power of ten that brings its largest value to `most` or less."""
    top = stats.agg(F.max("d").alias("top"))
    factor = F.when(F.col("top") > most, F.pow(F.lit(10.0), F.ceil(F.log10(F.col("top") / most) - 1e-12).cast("double"))).otherwise(1.0)
    return stats.crossJoin(F.broadcast(top)).withColumn("d", F.col("d") / factor).drop("top")


def r_squared(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The squared correlation of prediction and truth for each dimension."""
    return rows.agg(*[F.pow(F.corr(p, t), F.lit(2.0)).alias(f"r2_{t}") for p, t in pairs])


def fit_gamma(stats: DataFrame) -> tuple[float, float]:
    """Shape and rate by maximum likelihood; only the mean and the mean logarithm come to the driver."""
    s = stats.where("d > 0").agg(F.avg("d").alias("m"), F.avg(F.log("d")).alias("l")).head()
    if s["m"] is None:
        return float("nan"), float("nan")
    k = kernels.gamma_shape(s["m"], s["l"])
    return k, k / s["m"]


def gamma_p(stats: DataFrame, shape: float, rate: float, level: float) -> DataFrame:
    """`p`: the upper tail of the law at `d`, and `is_outlier` below the level."""

    @F.pandas_udf("double")
    def tail(d: pd.Series) -> pd.Series:
        return pd.Series(1 - kernels.gamma_cdf_of(d.to_numpy(float), shape, rate))

    return stats.withColumn("p", tail("d")).withColumn("is_outlier", F.coalesce(F.col("p") < level, F.lit(False)))


def gamma_curve(spark, shape: float, rate: float, level: float, places: int = 1000) -> DataFrame:  # noqa: ANN001
    """(d, density, critical): the law's density up to beyond its critical value."""
    top = kernels.gamma_ppf(1 - level, shape, rate)
    d = F.col("id") * (1.5 * top / (places - 1))
    log = (shape - 1) * F.log(F.greatest(d, F.lit(1e-12))) - d * rate + (shape * math.log(rate) - math.lgamma(shape))
    return spark.range(places).select(d.alias("d"), F.exp(log).alias("density"), F.lit(top).alias("critical"))


#: Loci of a block.
BLOCK = 1024


def genotype_errors(samples: DataFrame, knn: DataFrame, ks: list[int], power: float = 2.0, block: int = BLOCK) -> DataFrame:
    """(id, k, d): the mean squared difference of each sample's features and those predicted from its k nearest, for each k.

    Of a sample with fewer neighbours all count. Features meet in blocks of loci, so a group is a sample's block with those of its
    neighbours, as many as ranks in `knn`; running sums over ranks, a matrix for all groups of one size, serve all k at once.
    """
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("features") - 1) / block).cast("int")), lambda b: F.slice("features", b * block + 1, F.lit(block))))
    pieces = samples.select("id", F.col("features").cast("array<double>").alias("features")).where(F.size("features") > 0).select("id", cut.alias("b", "f"))
    near = knn.select("id", "rank", inverse_distance(F.col("dist"), power).alias("w"), "nbr_id").join(pieces.select(F.col("id").alias("nbr_id"), "b", F.col("f").alias("nf")), "nbr_id")
    near = near.groupBy("id", "b").agg(F.array_sort(F.collect_list(F.struct("rank", "w", "nf"))).alias("near"))  # no longer than the ranks
    rows = near.join(pieces, ["id", "b"]).select("id", "f", F.transform("near", lambda r: r["w"]).alias("w"), F.transform("near", lambda r: r["nf"]).alias("nf"))

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            shape = pd.Series([(len(w), len(f)) for w, f in zip(b["w"], b["f"])], index=b.index, dtype=object)
            for (ranks, loci), at in shape.groupby(shape).groups.items():
                own = b.loc[at]
                for i in range(0, len(own), 64):
                    part = own.iloc[i : i + 64]
                    x = np.stack([np.concatenate(v.tolist()) for v in part["nf"]]).reshape(len(part), ranks, loci)
                    w = np.stack(part["w"].to_numpy())
                    f = np.stack(part["f"].to_numpy())
                    upto = np.cumsum(w[:, :, None] * x, axis=1) / np.cumsum(w, axis=1)[:, :, None]
                    d = ((upto - f[:, None]) ** 2).sum(2)[:, [min(k, ranks) - 1 for k in ks]]
                    yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), len(ks)), "k": np.tile(np.array(ks, np.int32), len(part)), "s": d.ravel(), "n": loci})

    sums = rows.mapInPandas(run, "id long, k int, s double, n long").groupBy("id", "k").agg((F.sum("s") / F.sum("n")).alias("d"))
    return sums.withColumn("d", zero_floor(F.col("d"), genetic=True))


def _genetic(samples: DataFrame, k: int, approximate: bool) -> DataFrame:
    """The k nearest samples by features: exact by blocks, or about those by descent, whose work grows with the rows alone."""
    return descent.nearest(samples, k) if approximate else neighbors.nearest_vectors(samples, k)


def k_sums(samples: DataFrame, space: str, least: int = 2, most: int = 50, min_km: float = 1.0, scale: float = 100.0, power: float = 2.0, approximate: bool = False, knn: DataFrame | None = None) -> DataFrame:
    """(k, total): the sum of the statistic over all samples for each number of neighbours, from one table of neighbours (`knn`, if it is there)."""
    if space == "geographic":
        knn = _genetic(samples, most, approximate) if knn is None else knn
        d = dgeo(F.col("pred_x"), F.col("pred_y"), F.col("x"), F.col("y"), scale)
        return neighbors.sweep_k(knn, samples, samples.select("id", "x", "y"), d, ["x", "y"], least, most, power)
    knn = neighbors.nearest_on_globe(samples, most, at_least_km=min_km) if knn is None else knn
    return genotype_errors(samples, knn, list(range(least, most + 1)), power).groupBy("k").agg(F.sum("d").alias("total"))


def best_k(samples: DataFrame, space: str, least: int = 2, most: int = 50, **options) -> int:  # noqa: ANN003
    """The k with the smallest sum, the smaller of several; `least` if there are no neighbours."""
    found = k_sums(samples, space, least, most, **options).orderBy("total", "k").head()
    return int(found["k"]) if found else least


def detect(samples: DataFrame, space: str, k: int, level: float, min_km: float = 1.0, scale: float = 100.0, power: float = 2.0, keep=None, approximate: bool = False, raw=None) -> DataFrame:  # noqa: ANN001
    """(id, d, p, is_outlier) of one pass over (id, x, y, features). Samples without neighbours aren't scored; `approximate` as in _genetic().

    `raw` gives (id, d) of the samples where neighbours are known.
    """
    if raw is None:
        knn = _genetic(samples, k, approximate) if space == "geographic" else neighbors.nearest_on_globe(samples, k, at_least_km=min_km)
        stats = _statistic(samples, knn, space, k, scale, power)
    else:
        stats = raw()
    stats = rescale(stats) if space == "geographic" else stats
    stats = keep(stats) if keep else stats
    shape, rate = fit_gamma(stats)
    return gamma_p(stats, shape, rate, level)


def _statistic(samples: DataFrame, knn: DataFrame, space: str, k: int, scale: float, power: float) -> DataFrame:
    """(id, d) of those that have neighbours, which are k at most."""
    if space == "geographic":
        pred = neighbors.weighted_prediction(knn, samples, ["x", "y"], power)
        return pred.join(samples, "id").select("id", dgeo(F.col("pred_x"), F.col("pred_y"), F.col("x"), F.col("y"), scale).alias("d"))
    return genotype_errors(samples, knn, [k], power).select("id", "d")


class _Lists:
    """Neighbours of samples of which some go: longer lists than needed, searched anew only for samples whose list has become too short.

    What is left of a list of the `long` nearest are the nearest that are left, so a pass takes statistics anew only for samples that
    had a neighbour among those that went last.
    """

    def __init__(self, samples: DataFrame, space: str, long: int, min_km: float, folder: str) -> None:
        self.samples, self.space, self.long, self.min_km, self.folder, self.written = samples, space, long, min_km, folder, 0
        self.table, self.raw = self.kept(self.nearest(samples, samples)), None

    def nearest(self, asking: DataFrame, others: DataFrame) -> DataFrame:
        if self.space == "geographic":
            return neighbors.nearest_vectors(asking, self.long, others=None if asking is others else others)
        return neighbors.nearest_on_globe(asking, self.long, at_least_km=self.min_km, others=None if asking is others else others)

    def kept(self, df: DataFrame) -> DataFrame:
        self.written += 1
        df.write.parquet(f"{self.folder}/lists-{self.written}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.folder}/lists-{self.written}")

    def after(self, gone: DataFrame, last: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(id) of the samples that are left and had one of `last` in their list, and their k nearest without all that are `gone`."""
        names = self.table.columns
        touched = self.kept(self.table.join(last.select(F.col("id").alias("nbr_id")), "nbr_id", "left_semi").select("id").distinct().join(gone, "id", "left_anti"))
        own = self.table.join(touched, "id", "left_semi")
        rest = own.join(gone.select(F.col("id").alias("nbr_id")), "nbr_id", "left_anti")
        sizes = own.groupBy("id").agg(F.count("*").alias("had")).join(rest.groupBy("id").agg(F.count("*").alias("has")), "id", "left")
        short = self.kept(sizes.where((F.col("had") >= self.long) & (F.coalesce("has", F.lit(0)) < k)).select("id"))
        if not short.isEmpty():
            left = self.samples.join(gone, "id", "left_anti")
            found = self.nearest(self.samples.join(short, "id", "left_semi"), left)
            self.table = self.kept(self.table.join(short, "id", "left_anti").select(names).union(found.select(names)))
            rest = self.table.join(touched, "id", "left_semi").join(gone.select(F.col("id").alias("nbr_id")), "nbr_id", "left_anti")
        order = Window.partitionBy("id").orderBy("rank")
        return touched, rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(names)

    def statistic(self, gone: DataFrame | None, last: DataFrame | None, k: int, scale: float = 100.0, power: float = 2.0) -> DataFrame:
        """(id, d) of the samples that are left, from those of the pass before."""
        if self.raw is None:
            raw = _statistic(self.samples, self.table.where(F.col("rank") <= k), self.space, k, scale, power)
        else:
            touched, near = self.after(gone, last, k)
            raw = self.raw.join(gone, "id", "left_anti").join(touched, "id", "left_anti").select("id", "d").union(_statistic(self.samples, near, self.space, k, scale, power))
        self.raw = self.kept(raw)
        return self.raw


def detect_outliers(samples: DataFrame, mode: str = "composite", k: int | None = None, level: float = 0.01, rounds: int | None = None, k_range: tuple[int, int] = (2, 50), **options) -> DataFrame:  # noqa: ANN003
    """(id, space) of the outliers: passes over the samples that are left, until one finds none.

    Without `k`, each space takes the best one of `k_range` over all samples first. There are at most half as many passes as
    samples; `rounds` stops them earlier. Exact neighbours are searched once a space, and a pass takes statistics anew only where a neighbour
    went. Each pass writes its statistic and what it found to the shared folder, and what
    passes found is read as one table, so plans don't grow with the passes.
    """
    spark, out = samples.sparkSession, None
    most = samples.count() // 2 if rounds is None else rounds
    for space in ("geographic", "genetic") if mode == "composite" else (mode,):
        left, folder = samples, work_folder(samples, f"outliers-{space}")

        def once(stats: DataFrame, r: int = 0) -> DataFrame:
            stats.write.parquet(f"{folder}/stats-{r}")  # noqa: B023
            return spark.read.schema(stats.schema).parquet(f"{folder}/stats-{r}")  # noqa: B023

        lists = None if options.get("approximate") else _Lists(samples, space, 2 * k + 8 if k else k_range[1] + 8, options.get("min_km", 1.0), folder)
        own_k = k or best_k(samples, space, *k_range, **options, **({"knn": lists.table.where(F.col("rank") <= k_range[1])} if lists else {}))
        law = {name: options[name] for name in ("scale", "power") if name in options}
        known = last = None
        for r in range(most):
            raw = None if lists is None else lambda known=known, last=last: lists.statistic(known, last, own_k, **law)  # noqa: B023
            found = detect(left, space, own_k, level, keep=lambda stats, r=r: once(stats, r), **options, raw=raw).where("is_outlier").select("id")
            found.write.parquet(f"{folder}/{r}")
            last = spark.read.schema(found.schema).parquet(f"{folder}/{r}")
            if last.isEmpty():
                break
            known = spark.read.schema(found.schema).parquet(*(f"{folder}/{i}" for i in range(r + 1)))
            left = samples.join(known, "id", "left_anti")
        else:
            r = most
        if r:
            part = spark.read.schema(found.schema).parquet(*(f"{folder}/{i}" for i in range(r))).withColumn("space", F.lit(space))
            out = part if out is None else out.union(part)
    return out.distinct() if out is not None else spark.createDataFrame([], "id long, space string")
