"""Bootstrapped quantiles of large tables: the interval of a median without drawing a row twice.

In a replicate each row counts a Poisson number of times, which follows from a hash of its key and the replicate, so all
replicates are one pass and no rows are moved for them. Values are range-partitioned and sorted; a task sums the weights of its
part for each replicate, running sums over the parts tell in which part a replicate's quantile lies, and only there it is
looked up. Quantiles are exact: those of the table in which each row is repeated as often as it counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.summary import kept

#: Rows whose weights a task holds at once, and rows of a part.
HELD, PART_ROWS = 1024, 200_000
#: The prime modulus of plain draws, which any SQL engine repeats.
PRIME = 1_000_003
#: A row counts at most this often; a larger number has a chance of 1e-17.
MOST = 17
#: The chance of each number or less.
CHANCES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(MOST)])


def weights(keys: np.ndarray, replicates: int, seed: int, draw: str) -> np.ndarray:
    """How often each row (int64 key) counts in each replicate: rows x replicates, Poisson with mean 1."""
    r = np.arange(replicates, dtype=np.uint64)[None]
    if draw == "modulo":
        k = keys.astype(np.int64)[:, None]
        s = r.astype(np.int64)
        u = (((k + 1) % PRIME * 7919 + (s + 1) * 104729 + (k % PRIME) * s * 31 + seed) % PRIME) / PRIME
    else:  # the finaliser of splitmix64 on a stream a row
        z = (keys.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95)) ^ (np.uint64(seed) + (r + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(CHANCES, u, side="right").astype(np.int64)


def bootstrap(df: DataFrame, key: str, value: str, by: list[str] = (), share: float = 0.5, replicates: int = 1000, seed: int = 0, draw: str = "hash") -> DataFrame:
    """(by, replicate, q): the quantile of `value` in each replicate, with linear interpolation between neighbours.

    Null and NaN values don't count. A replicate in which no row of a group counts has no row. Keys are whole numbers; rows with one
    key count equally often, so keys should differ.
    """
    by = list(by)
    thin = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(key).cast("long").alias("__key"), F.col(value).cast("double").alias("__v"))
    order = [*by, "__v", "__key"]
    thin = kept(thin, "notches")
    placed = kept(thin.repartitionByRange(max(1, -(-thin.count() // PART_ROWS)), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "notches")
    groups = ["__part", *by]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    head = f"__part int{', ' + kinds if kinds else ''}"

    def sums(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(replicates, np.int64)
        for b in batches:
            keys = b.column("__key").to_numpy()
            for i in range(0, len(keys), HELD):
                total += weights(keys[i : i + HELD], replicates, seed, draw).sum(0)
        yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], pa.array([total.tobytes()], pa.binary())], names=[*groups, "w"])

    totals = kept(placed.groupBy(*groups).applyInArrow(sums, f"{head}, w binary"), "notches")

    def wanted(key: tuple, t: pa.Table) -> pa.Table:
        """Where the two places around the quantile lie: by part, replicate, place within the part."""
        t = t.sort_by("__part")
        w = np.stack([np.frombuffer(x, np.int64) for x in t.column("w").to_pylist()])
        upto = np.cumsum(w, axis=0)
        whole = upto[-1]
        some = np.flatnonzero(whole)
        at = share * (whole[some] - 1)
        parts, reps, places, shares, sides = [], [], [], [], []
        for side, place in ((0, np.floor(at)), (1, np.ceil(at))):
            place = place.astype(np.int64)
            i = (upto[:, some] <= place).sum(0)  # the first part that goes beyond the place
            parts.append(i)
            reps.append(some)
            places.append(place - (upto[i, some] - w[i, some]))
            shares.append(at - np.floor(at))
            sides.append(np.full(len(some), side))
        own = t.column("__part").take(pa.array(np.concatenate(parts)))
        return pa.table({"__part": own, **{c: pa.array([k.as_py()] * len(own), k.type) for c, k in zip(by, key)}, "replicate": pa.array(np.concatenate(reps), pa.int32()), "place": pa.array(np.concatenate(places)), "f": pa.array(np.concatenate(shares)), "side": pa.array(np.concatenate(sides), pa.int32())})

    asked = (totals.groupBy(*by) if by else totals.groupBy(F.lit(0).alias("__all"))).applyInArrow(wanted if by else lambda _, t: wanted((), t), f"{head}, replicate int, place long, f double, side int")

    def look(key: tuple, rows: pa.Table, ask: pa.Table) -> pa.Table:
        found = np.full(ask.num_rows, np.nan)
        if ask.num_rows:
            rows = rows.sort_by([("__v", "ascending"), ("__key", "ascending")])
            keys, v = rows.column("__key").to_numpy(), rows.column("__v").to_numpy()
            reps, places = ask.column("replicate").to_numpy(), ask.column("place").to_numpy()
            before, open_ = np.zeros(replicates, np.int64), np.ones(len(places), bool)
            for i in range(0, len(keys), HELD):
                upto = before + np.cumsum(weights(keys[i : i + HELD], replicates, seed, draw), axis=0)
                hit = np.flatnonzero(open_ & (upto[-1][reps] > places))
                for j in hit:
                    found[j] = v[i + np.searchsorted(upto[:, reps[j]], places[j], side="right")]
                open_[hit] = False
                before = upto[-1]
        return pa.table({**{c: ask.column(c) for c in by}, "replicate": ask.column("replicate"), "side": ask.column("side"), "f": ask.column("f"), "v": pa.array(found)})

    parted = placed.groupBy(*groups).cogroup(asked.groupBy(*groups)).applyInArrow(look, f"{kinds + ', ' if kinds else ''}replicate int, side int, f double, v double")
    low, high = (F.max(F.when(F.col("side") == s, F.col("v"))) for s in (0, 1))
    return parted.groupBy(*by, "replicate").agg(low.alias("a"), high.alias("b"), F.max("f").alias("f")).select(*by, "replicate", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("f")) + F.col("b") * F.col("f")).alias("q"))


def notch(df: DataFrame, key: str, value: str, by: list[str] = (), share: float = 0.5, level: float = 0.95, replicates: int = 1000, seed: int = 0, draw: str = "hash") -> DataFrame:
    """(by, low, high, replicates): the interval that holds the middle `level` of the replicates' quantiles. A row a group; no rows, no interval."""
    by = list(by)
    q = bootstrap(df, key, value, by, share, replicates, seed, draw)
    ends = F.percentile("q", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return q.groupBy(*by).agg(ends.alias("e"), F.count("*").alias("replicates")).select(*by, F.col("e")[0].alias("low"), F.col("e")[1].alias("high"), "replicates").where("replicates > 0")
