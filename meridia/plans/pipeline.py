"""From genotypes and coordinates to predicted origins: align, encode, filter, impute, split, train replicates, summarise."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.geo import scaled
from meridia.functions.genetics import hybrid
from meridia.operators import clusters, density, genotype, model, neighbors, outliers, samples, summary
from meridia.plans import options
from meridia.sources.folders import work_folder


@dataclass(frozen=True)
class Config:
    """Options, with the checks that the constructor makes."""

    min_mac: int = 2
    max_snps: int | None = None
    train_split: float = 0.75
    val_split: float = 0.25
    n_bins: int = 6
    nboots: int = 10
    seed: int = 0
    detect_outliers: bool = False
    significance: float = 0.01
    k: int | None = None
    k_range: tuple[int, int] = (2, 50)
    weights: tuple[str, ...] = ()
    focus: tuple[tuple[float, float, float, float], ...] = ()
    oversample: bool = False
    neighbours: str = "sqrt"
    loss: str = "rmse"
    strict: bool = False
    params: dict = field(default_factory=lambda: {"width": 64, "layers": 2, "epochs": 100, "patience": 20, "lr": 1e-2, "l2": 0.0, "dropout": 0.0})

    def __post_init__(self) -> None:
        if not (0 < self.train_split < 1 and 0 < self.val_split < 1 and self.train_split + self.val_split <= 1.0):
            raise ValueError("splits must be in (0, 1), and their sum at most 1")
        for name in ("min_mac", "n_bins", "nboots", *(["k"] if self.k is not None else [])):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a positive whole number")
        if not 0 < self.significance < 1:
            raise ValueError("significance must be in (0, 1)")
        options.neighbours(self.k_range[0])
        if self.k_range[0] > self.k_range[1]:
            raise ValueError("k_range must ascend")
        for kind in self.weights:
            options.one_of(kind, ("kde", "cluster", "dbscan"))
        options.one_of(self.loss, model.LOSSES)
        options.one_of(self.neighbours, ("sqrt", "log2"))
        if self.max_snps is not None and self.max_snps < 1:
            raise ValueError("max_snps must be positive")

    @classmethod
    def of(cls, options: dict) -> Config:
        """From a flat mapping; keys that aren't options are an error, and types are checked."""
        known = {f.name for f in fields(cls)}
        if unknown := set(options) - known:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**{**asdict(cls()), **options})


def weights(labelled: DataFrame, config: Config) -> DataFrame:
    """(id, weight) of known samples: the product of the parts that are asked for, doubled in focus boxes; 1 without any."""
    points, parts = labelled.select("id", "x", "y"), []
    for kind in config.weights:
        if kind == "kde":
            parts.append(density.kde_weights(density.kernel_sums(points)))
        elif kind == "cluster":
            parts.append(density.cluster_weights(labelled, "cluster"))
        else:
            eps = neighbors.kth_distance(neighbors.nearest_on_globe(points, 2), 2).head()["eps"] or 1.0
            parts.append(density.dbscan_weights(clusters.dbscan(points, float(eps), 2)))
    return density.combined_weights(points, parts, list(config.focus), scale=bool(parts))


def oversampled(split: DataFrame, config: Config) -> DataFrame:
    """The split with synthetic training samples of small clusters: between a sample and a near one of its cluster, with a child's genotypes."""
    train = split.where("split = 'train'")
    k = max(1, samples.neighbour_count(train, config.neighbours))
    knn = neighbors.nearest_on_globe(train.select("id", "x", "y"), k).join(train.select("id", F.col("cluster").alias("own")), "id").join(train.select(F.col("id").alias("nbr_id"), F.col("cluster").alias("other")), "nbr_id").where("own = other")
    knn = knn.select("id", "nbr_id", F.row_number().over(Window.partitionBy("id").orderBy("rank")).alias("rank"))
    made = clusters.synthetic(train, knn, clusters.oversampling_factor(train, "cluster"), "cluster")
    draw = lambda i: F.pmod(F.xxhash64("id", "copy", i), F.lit(10_000)) / 10_000.0
    both = made.join(train.select("id", "cluster", "sample", "features"), "id").join(train.select(F.col("id").alias("nbr_id"), F.col("features").alias("nf")), "nbr_id")
    pairs = F.arrays_zip(F.col("features").alias("a"), F.col("nf").alias("b"))
    child = F.transform(pairs, lambda p, i: F.coalesce(hybrid(p["a"], p["b"], draw(i)).cast("double"), p["a"]))
    new = both.select(F.xxhash64("id", "copy").alias("id"), "sample", "x", "y", child.alias("features"), "cluster", F.lit("train").alias("split"), "weight")
    return split.select(*new.columns).union(new)


def run(dosages: DataFrame, coords: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """Tables by name: outliers, samples (with split), models, predictions (plan = replicate) and summary.

    `dosages` has sample, locus, dosage; `coords` sample, x, y, where null coordinates are to be predicted.
    """
    aligned = samples.align(dosages.select("sample").distinct(), coords)
    d = genotype.drop_empty_samples(dosages.join(aligned.select("sample"), "sample", "left_semi"))
    called = d.select("sample")  # a sample without calls at the loci that are picked below is still one of the plan
    d = genotype.filter_allele_count(d, config.min_mac)
    if config.max_snps:
        d = genotype.pick_loci(d, config.max_snps, config.seed)
    wide = genotype.wide(genotype.impute(genotype.complete(d, called))).join(aligned, "sample").withColumn("id", F.xxhash64("sample"))
    folder = work_folder(wide, "pipeline")
    wide.write.parquet(f"{folder}/samples")
    wide = wide.sparkSession.read.schema(wide.schema).parquet(f"{folder}/samples")
    known = samples.mark_known(wide).where("is_known").drop("is_known")
    found = outliers.detect_outliers(known.select("id", "x", "y", "features"), k=config.k, level=config.significance, k_range=config.k_range) if config.detect_outliers else None
    if found is not None:
        known = known.join(found.select("id").distinct(), "id", "left_anti")
    points = known.withColumn("at", F.array("x", "y"))
    labelled = clusters.kmeans(points, config.n_bins, "at", config.seed).withColumnRenamed("label", "cluster").drop("at")
    tx, ty = scaled(F.col("x"), F.col("y"))
    split = samples.split(labelled, config.train_split, config.val_split, F.xxhash64("id", F.lit(config.seed))).join(weights(labelled, config), "id")
    split.write.parquet(f"{folder}/split")
    split = wide.sparkSession.read.schema(split.schema).parquet(f"{folder}/split")
    rows = (oversampled(split, config) if config.oversample else split).withColumn("tx", tx).withColumn("ty", ty)
    plans = wide.sparkSession.range(config.nboots).select(F.col("id").alias("plan"), F.lit(json.dumps(config.params | {"seed": config.seed, "loci": config.nboots > 1, "loss_function": config.loss})).alias("params"))
    models = model.train_all(rows, plans)
    models.write.parquet(f"{folder}/models")
    models = wide.sparkSession.read.schema(models.schema).parquet(f"{folder}/models")
    preds = model.predict(wide, models, config.strict).join(wide.select("id", "sample"), "id")
    boots = preds.select(F.col("sample"), "x", "y", F.col("plan").alias("replicate"))
    truth = wide.where("x is not null").select("sample", F.col("x").alias("known_x"), F.col("y").alias("known_y"))
    return {"outliers": found, "samples": split, "models": models, "predictions": boots, "summary": summary.bootstrap(boots, truth)}
