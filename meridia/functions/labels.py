"""Labels of metrics and configurations as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of metric keys; keys that are spelt wrong in stored tables are among them.
METRICS = {
    "mean_dist": "Mean Error",
    "median_dist": "Median Error",
    "stdev_dist": "StdDev of Error",
    "std_dist": "StdDev of Error",
    "percent_within_20km": "% Samples within 20 km",
    "percent_within_50km": "% Samples within 50 km",
    "percent_within_75km": "% Samples within 75 km",
    "mad_haversine": "Median Absolute Deviation",
    "coefficient_of_variation": "Coefficient of Variation",
    "coeffecient_of_variation": "Coefficient of Variation",
    "percentile_25": "25th Percentile of Error",
    "percentile_50": "50th Percentile of Error",
    "percentile_75": "75th Percentile of Error",
    "percentiles_75": "75th Percentile of Error",
    "pearson_corr_longitude": "$R^2$ (Longitude)",
    "pearson_corr_latitude": "$R^2$ (Latitude)",
    "spearman_corr_longitude": "Rho (Longitude)",
    "spearman_corr_latitude": "Rho (Latitude)",
    "skewness": "Skewness",
}

#: Configuration prefixes and what stands after the tool's name in their labels; later ones win.
CONFIGS = {
    "nn_base_unopt": "Base (Unoptimized)",
    "nn_base_opt": "Base",
    "nn_loss_opt": "+ Loss",
    "nn_sampler_opt": "+ Sampler",
    "nn_both_opt": "+ Loss + Sampler",
    "nn_base_smote_opt": "Base + Interpolation",
    "nn_loss_smote_opt": "Loss + Interpolation",
    "nn_sampler_smote_opt": "Sampler + Interpolation",
    "nn_both_smote_opt": "Loss + Sampler + Interpolation",
}


def metric(key: Column) -> Column:
    """The label of a metric key; other keys stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*METRICS.items())]), key), key)


#: Fixed value: results of the other tool that users compare with have this prefix.
OTHER = "locator"


def config_prefix(config: Column, tool: str, other: str = "Locator") -> Column:
    """`tool` and what the configuration's prefix stands for, or `other` for the other tool's; other configurations stay."""
    out = F.when(config.startswith(OTHER), other).otherwise(config)
    for prefix, label in CONFIGS.items():
        out = F.when(config.startswith(prefix), f"{tool} {label}").otherwise(out)
    return out


def config_parts(config: Column) -> Column:
    """Words for oversampling_weighting_outliers; a name without underscores stays, other forms give null."""
    p = F.split(config, "_")
    words = F.concat_ws(", ", F.when(p[0] == "kmeans", "Oversampling").otherwise("No Oversampling"), F.when(p[1] == "loss", "Weighted Loss").otherwise("No Weighted Loss"), F.when(p[2] == "true", "Outlier Detection").otherwise("No Outlier Detection"))
    return F.when(F.size(p) == 1, config).when(F.size(p) == 3, words)


def without(config: Column, part: str) -> Column:
    """Whether a label lacks a part; null labels do."""
    return F.coalesce(~config.contains(part), F.lit(True))
