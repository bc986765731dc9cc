"""Sums over all pairs of places, or all within a reach, without a row a pair: blocks of places meet, and a task gives a row a place.

Points on one place are one row with their count. A group holds at most LEFT places and RIGHT others, whatever the table's size,
and groups are dealt over a fixed number of tasks, so that small tables aren't read by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.geo import EARTH_KM
from meridia.operators.neighbors import around, cube
from meridia.sources.folders import work_folder

#: Places of a group that ask, and those that answer; rows and columns of the pairs held at once.
LEFT, RIGHT = 16_384, 131_072
_ROWS, _COLS = 32, 2048


def _tasks(df: DataFrame, groups: int) -> int:
    """Partitions for groups: several a core, so that those of unequal work even out."""
    return max(1, min(groups, 16 * df.sparkSession.sparkContext.defaultParallelism))


def _met(left: DataFrame, right: DataFrame, keys: list[str], groups: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The groups of both sides by keys; repartition() by a number isn't coalesced by size, as the work isn't in the bytes."""
    n, of = _tasks(left, groups), [f"of_{k}" for k in keys]
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *of).groupBy(*of)).applyInArrow(run, schema)


def _column(t: pa.Table, name: str) -> np.ndarray:
    """A side of a group without rows has no columns."""
    return t.column(name).to_numpy() if t.num_rows else np.zeros(0)


def gaussian_on_globe(places: DataFrame, bandwidth: float, reach: float) -> DataFrame:
    """(x, y, density) of places (x, y, c): the sum of c exp(-d^2 / 2h^2) over the places within `reach`, both in radians.

    Cubes of the unit vectors have an edge of the reach; a cube with many places is cut, as is what lies around it.
    """
    spark, folder, km, names = places.sparkSession, work_folder(places, "sums"), reach * EARTH_KM, ["cx", "cy", "cz"]

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    places = kept("places", places.select("x", "y", "c"))
    own = places.select("*", *cube("x", "y", km), F.xxhash64("x", "y").alias("h"))
    counts = kept("counts", own.groupBy(*names).agg(F.count("*").alias("n")))
    moved = counts
    for c in names:
        moved = moved.withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("o")).drop("o")
    met = moved.groupBy(*names).agg(F.sum("n").alias("m")).join(counts.hint("merge"), names)
    cut = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    cut = kept("cut", met.select(*names, cut("n", LEFT).alias("p"), cut("m", RIGHT).alias("q")))
    groups = cut.agg(F.sum(F.col("p") * F.col("q"))).head()[0] or 0
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = own.join(cut.hint("merge"), names).withColumn("b", F.pmod("h", F.col("p")).cast("int")).withColumn("o", upto("q")).select(*names, "b", "o", "x", "y")
    near = around(places, km).withColumn("h", F.xxhash64("x", "y")).join(cut.hint("merge"), names)
    right = near.withColumn("o", F.pmod("h", F.col("q")).cast("int")).withColumn("b", upto("p")).select(*[F.col(k).alias(f"of_{k}") for k in (*names, "b", "o", "x", "y", "c")])

    def unit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lon, lat = np.radians(x), np.radians(y)
        return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, c = _column(a, "x"), _column(a, "y"), _column(b, "of_c").astype(float)
        u, v = unit(x, y), unit(_column(b, "of_x"), _column(b, "of_y"))
        bands = np.floor((u[2] + 1) * (max(1.0, (a.num_rows / _ROWS) ** 0.5) / max(np.ptp(u[2]), 1e-9))) if a.num_rows else u[2]
        order = np.lexsort((x, bands))  # so that rows of a block stand near each other
        u = u[:, order]
        out, most, half = np.zeros(a.num_rows), (2 * np.sin(min(reach, np.pi) / 2)) ** 2 * (1 + 1e-9), -2 / (bandwidth * bandwidth)
        for i in range(0, a.num_rows, _ROWS):
            part = u[:, i : i + _ROWS, None]
            # what no row of the block can reach is left out before pairs are made
            gap = np.maximum(np.maximum(part.min(1) - v, v - part.max(1)), 0)
            at = np.flatnonzero((gap * gap).sum(0) <= most)
            for j in range(0, len(at), _COLS):
                some = at[j : j + _COLS]
                d = part[0] - v[0, some]
                d *= d
                for k in (1, 2):
                    e = part[k] - v[k, some]
                    e *= e
                    d += e
                far = d > most
                angle = np.arcsin(np.minimum(np.sqrt(d, out=d) / 2, 1))  # half the central angle; squares of differences keep the digits of near places
                angle *= angle
                angle *= half
                e = np.exp(angle, out=angle)
                e[far] = 0
                out[i : i + _ROWS] += e @ c[some]
        return pa.table({"x": x[order], "y": y[order], "density": out})

    return _met(left, right, [*names, "b", "o"], groups, run, "x double, y double, density double").groupBy("x", "y").agg(F.sum("density").alias("density"))


def in_plane(places: DataFrame, classes: int, kernels: Callable[[np.ndarray], Iterator[np.ndarray]], number: int = 1) -> DataFrame:
    """(x, y, kind, c, sums) of places (x, y, kind, c), with kinds from 0 to `classes` - 1: for each of `number` kernels, which a
    function gives of squared distances in the plane, and each kind the sum of c times the kernel over all places of that kind, kernel by kernel.

    All pairs are met, so time grows with the square of the different places; what a task holds doesn't.
    """
    folder = work_folder(places, "sums")
    thin = places.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("kind").cast("int").alias("kind"), F.col("c").cast("long").alias("c"), F.xxhash64("x", "y", "kind").alias("h"))
    thin.write.parquet(folder)
    thin = places.sparkSession.read.schema(thin.schema).parquet(folder)
    n = thin.count()
    p = max(1, -(-n // LEFT), min(-(-n // 512), 4 * places.sparkSession.sparkContext.defaultParallelism))
    q = max(1, -(-n // RIGHT))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cut = lambda k: F.pmod("h", F.lit(k)).cast("int")
    left = thin.withColumn("b", cut(p)).withColumn("o", every(q)).drop("h")
    right = thin.withColumn("o", cut(q)).withColumn("b", every(p)).select(*[F.col(k).alias(f"of_{k}") for k in ("b", "o", "x", "y", "kind", "c")])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        order = np.argsort(_column(b, "of_kind"), kind="stable")
        x, y, c = (_column(b, k)[order].astype(float) for k in ("of_x", "of_y", "of_c"))
        ends = np.searchsorted(_column(b, "of_kind")[order], np.arange(classes + 1))
        ax, ay = _column(a, "x"), _column(a, "y")
        out = np.zeros((a.num_rows, number, classes))
        for i in range(0, a.num_rows, _ROWS):
            px, py = ax[i : i + _ROWS, None], ay[i : i + _ROWS, None]
            for k in range(classes):
                for j in range(ends[k], ends[k + 1], _COLS):
                    at = slice(j, min(j + _COLS, ends[k + 1]))
                    d, e = px - x[at], py - y[at]
                    d *= d
                    e *= e
                    d += e
                    for m, value in enumerate(kernels(d)):
                        out[i : i + _ROWS, m, k] += value @ c[at]
        sums = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), number * classes).cast(pa.list_(pa.float64()))
        return pa.table([pa.array(_column(a, k), t) for k, t in (("x", pa.float64()), ("y", pa.float64()), ("kind", pa.int32()), ("c", pa.int64()))] + [sums], ["x", "y", "kind", "c", "sums"])

    met = _met(left, right, ["b", "o"], p * q, run, "x double, y double, kind int, c long, sums array<double>")
    if q == 1:
        return met
    each = F.array(*[F.sum(F.col("sums")[i]) for i in range(number * classes)])
    return met.groupBy("x", "y", "kind").agg(F.first("c").alias("c"), each.alias("sums"))
