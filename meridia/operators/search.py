"""Hyperparameter search: a tree of Parzen estimators with median pruning, in rounds of parallel trials that can be taken up again."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.model import train_all

#: Trials before the estimators are used, and candidates that they are asked for.
STARTUP, CANDIDATES = 10, 24
#: Trials that must have ended before their median stops others.
PRUNE_FROM = 5

TRIALS = "plan long, loss double, params string, curve array<double>"


def space(features: int) -> dict[str, tuple[str, float, float]]:
    """Of each parameter: its kind (log, int or float) and bounds."""
    return {"lr": ("log", 1e-4, 1e-1), "l2": ("log", 1e-5, 1e-1), "width": ("int", 8, max(9, features - 1)), "layers": ("int", 2, 20), "dropout": ("float", 0.0, 0.5)}


def _inner(kind: str, x: float) -> float:
    return math.log(x) if kind == "log" else float(x)


def _outer(kind: str, v: float, low: float, high: float) -> float:
    x = min(max(math.exp(v) if kind == "log" else v, low), high)
    return int(round(x)) if kind == "int" else x


def _density(at: np.ndarray, centres: np.ndarray, low: float, high: float) -> np.ndarray:
    """A mixture of gaussians at the trials' values, as wide as the gaps to their neighbours, and one as wide as the range."""
    c = np.sort(np.append(centres, (low + high) / 2))
    gaps = np.diff(np.concatenate([[low], c, [high]]))
    sd = np.clip(np.maximum(gaps[:-1], gaps[1:]), (high - low) / min(100, 1 + len(c)), high - low)
    return np.exp(-(((at[:, None] - c) / sd) ** 2) / 2) @ (1 / sd) / len(c) + 1e-300


def suggest(trials: list[tuple[float, dict]], bounds: dict[str, tuple[str, float, float]], rng: np.random.Generator) -> dict[str, float]:
    """The next parameters, from (loss, parameters) of those that ended: of 24 candidates near good ones, that which is least like bad ones."""
    done = sorted((t for t in trials if math.isfinite(t[0])), key=lambda t: t[0])
    out = {}
    good = min(max(1, math.ceil(0.1 * len(done))), 25)
    for name, (kind, low, high) in bounds.items():
        a, b = _inner(kind, low), _inner(kind, high)
        if len(done) < STARTUP:
            out[name] = _outer(kind, rng.uniform(a, b), low, high)
            continue
        values = np.array([_inner(kind, p[name]) for _, p in done])
        near, far = values[:good], values[good:]
        centre = rng.choice(np.append(near, (a + b) / 2), CANDIDATES)
        tried = np.clip(rng.normal(centre, (b - a) / max(2.0, math.sqrt(len(done)))), a, b)
        ratio = np.log(_density(tried, near, a, b)) - np.log(_density(tried, far, a, b))
        out[name] = _outer(kind, float(tried[ratio.argmax()]), low, high)
    return out


def medians(curves: list[list[float]]) -> list[float]:
    """By epoch the median of the best losses so far of the trials that came so far."""
    if len(curves) < PRUNE_FROM:
        return []
    best = [np.minimum.accumulate(c) for c in curves if len(c)]
    return [float(np.median([c[e] for c in best if len(c) > e])) for e in range(max((len(c) for c in best), default=0))]


def tune(rows: DataFrame, trials: int, features: int, folder: str, epochs: int = 50, parallel: int = 8, seed: int = 0, extra: dict | None = None) -> DataFrame:
    """(plan, loss, params, curve) of `trials` trials of train_all(); the smallest loss is the best.

    Rounds of `parallel` trials run at once, a task each, and are written to `folder`; a search that is called again with
    this folder goes on after its last round. The first trials are drawn from the space at random, later ones suggested.
    """
    spark, bounds = rows.sparkSession, space(features)
    found: list = []
    k = 0
    while len(found) < trials:
        path = f"{folder}/{k}"
        try:
            got = spark.read.schema(TRIALS).parquet(path).collect()
        except Exception as e:  # the round isn't there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rng = np.random.default_rng([seed, k])
            ended = [(r["loss"], json.loads(r["params"])) for r in found]
            limit = medians([list(r["curve"]) for r in found])
            own = [(len(found) + i, json.dumps(suggest(ended, bounds, rng) | {"epochs": epochs, "seed": seed, "medians": limit} | (extra or {}))) for i in range(min(parallel, trials - len(found)))]
            plans = spark.createDataFrame(own, "plan long, params string")
            train_all(rows, plans).select("plan", "loss", F.regexp_replace("params", r'"medians": \[[^\]]*\], ', "").alias("params"), "curve").write.parquet(path)
            got = spark.read.schema(TRIALS).parquet(path).collect()
        found += sorted(got, key=lambda r: r["plan"])
        k += 1
    return spark.createDataFrame(found, TRIALS)


def best_so_far(trials: DataFrame) -> DataFrame:
    """(plan, loss, best): the smallest loss up to each trial, the table behind a study's history."""
    return trials.selectExpr("plan", "loss", "min(loss) OVER (ORDER BY plan ROWS UNBOUNDED PRECEDING) AS best")
