"""Product codes of vectors: integer k-means for each part of the vector, by Hamerly's bounds.

A vector becomes integers, is cut into parts of equal width, and each part is replaced by the index of the nearest entry
of that part's codebook. All sums and distances are exact integers, so results don't depend on how rows are dealt.

A round is one pass of Arrow batches over a table in the shared folder that holds, for each part of each row, its entry,
an upper bound of the distance to it and a lower bound of the distance to the second nearest. Bounds follow the entries'
movements, rounded outwards. Only where the upper bound isn't strictly below the lower one (or half the way to the next
entry) the distance is taken exactly, and only where that fails too all entries are scanned; ties go to the lower index.
A task also writes its sums and counts of each entry; they are aggregated by Spark, so codebooks, whose size follows from
the parameters and the vectors' length, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import dropped, fields, mapped, only, shared_folder

#: Relative room for the rounding of a square root and of an integer above 2^53.
_ROOM = 2.0**-50
#: Up to this many labels their sums are broadcast (some 40 bytes each); beyond that both sides are shuffled.
FEW_LABELS = 100_000


@dataclass
class Codebooks:
    scale: int
    width: int  # components of a vector
    entries: np.ndarray  # int64, parts x entries x components of a part
    scans: list[int] = field(default_factory=list)  # of each assignment: parts for which all entries were scanned

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: real(x.cast("double"))), F.lit(False))


def _most(width: int) -> int:
    """Integers are held within this, so that no squared distance leaves 64 bits."""
    return int((2.0**62 / max(1, width)) ** 0.5) // 2


def integers(values: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of rows of components as rows x parts x components; zeros fill the last part up."""
    n, width = values.shape
    most = _most(width)
    own = -(-width // parts)
    out = np.zeros((n, own * parts), np.int64)
    out[:, :width] = np.clip(np.floor(values.astype(np.float64) * scale), -most, most)
    return out.reshape(n, parts, own)


def _up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares) * (1 + _ROOM)


def _down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares) * (1 - _ROOM)


def _squares(x: np.ndarray, entries: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The squared distance of each part to its entry."""
    return ((x - entries[np.arange(x.shape[1]), own]) ** 2).sum(2)


class Bounds:
    """What a round needs of the codebooks before it (`old`, none at first) and now."""

    def __init__(self, entries: np.ndarray, old: np.ndarray | None):
        self.entries, self.first = entries, old is None
        parts, k, _ = entries.shape
        if k > 1:
            between = ((entries[:, :, None] - entries[:, None]) ** 2).sum(3).astype(np.float64)
            between[:, np.arange(k), np.arange(k)] = np.inf
            self.half = _down(between.min(2)) / 2
        else:
            self.half = np.full((parts, k), np.inf)
        if old is not None:
            self.moved = _up(((entries - old) ** 2).sum(2))
            others = np.where(np.eye(k, dtype=bool), 0.0, self.moved[:, None, :])
            self.others = others.max(2)  # the farthest movement of any other entry

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Changes entries and bounds of the parts in place; the number of parts for which all entries were scanned."""
        at = np.arange(x.shape[1])
        if self.first:
            far = np.ones(own.shape, bool)
        else:
            upper[:] = np.nextafter(upper + self.moved[at, own], np.inf)
            lower[:] = np.maximum(np.nextafter(lower - self.others[at, own], -np.inf), 0)
            least = np.maximum(lower, self.half[at, own])
            far = upper >= least
            if far.any():
                row, part = np.nonzero(far)
                mine = own[row, part]
                upper[row, part] = _up(((x[row, part] - self.entries[part, mine]) ** 2).sum(1))
                far = upper >= least
        row, part = np.nonzero(far)
        for i in range(0, len(row), 20_000):
            r, p = row[i : i + 20_000], part[i : i + 20_000]
            squares = ((x[r, p][:, None] - self.entries[p]) ** 2).sum(2)
            best = squares.argmin(1)  # the first of equals
            own[r, p], here = best, np.arange(len(r))
            upper[r, p] = _up(squares[here, best])
            rest = squares.astype(np.float64)
            rest[here, best] = np.inf
            lower[r, p] = _down(rest.min(1))
        return len(row)


def _fixed(array: pa.Array, kind: type, *shape: int) -> np.ndarray:
    """The bytes of a binary column without nulls as one matrix; a copy that may be changed."""
    joined = b"".join(array.to_pylist())
    return np.frombuffer(joined, kind).reshape(len(array), *shape).copy()


def _rows_of(matrix: np.ndarray) -> list[bytes]:
    flat = np.ascontiguousarray(matrix)
    size, data = flat[0].nbytes if len(flat) else 0, flat.tobytes()
    return [data[i * size : (i + 1) * size] for i in range(len(flat))]


def _parsed(df: DataFrame, vec_id: str, vector: str, label: str, parts: int, scale: int, width: int) -> DataFrame:
    """vec_id, label and the integers of each usable row; null where the row hasn't the ruling number of components."""
    thin = only(df, vec_id=vec_id, label=label, vector=vector).where(usable("vector"))
    thin = thin.select("vec_id", "label", F.when(F.size("vector") == width, F.col("vector").cast("array<double>")).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vector")
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            values = lists.filter(lists.is_valid()).flatten().to_numpy(zero_copy_only=False).reshape(int(there.sum()), width)
            found = iter(_rows_of(integers(values, parts, scale)))
            v = pa.array([next(found) if x else None for x in there], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), v], names=["vec_id", "label", "v"])

    return mapped(thin, run, T.StructType([thin.schema["vec_id"], thin.schema["label"], *fields("v binary")]), "vectorcodes")


def _start(df: DataFrame, vec_id: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the rows with the smallest ids (nulls last, then by components)."""
    thin = only(df, vec_id=vec_id, vector=vector).where(usable("vector"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = thin.orderBy(*order).limit(1).collect()
    width = len(first[0]["vector"]) if first else 0
    rows = thin.where(F.size("vector") == width).orderBy(*order).limit(entries).collect() if first else []
    values = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), width)
    return Codebooks(scale, width, integers(values, parts, scale).transpose(1, 0, 2))


def _round(table: DataFrame, bounds: Bounds, schema: T.StructType) -> DataFrame:
    """Rows of `kind` state (entries and bounds) and, at the end of each task, of kind sums (a row an entry, and the scans)."""
    parts, k, w = bounds.entries.shape
    sums = [T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.LongType()))]
    out = T.StructType([*fields("kind string"), schema["vec_id"], schema["label"], *fields("v binary, own binary, upper binary, lower binary"), *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, scans = np.zeros((parts * k, w), np.int64), np.zeros(parts * k, np.int64), 0
        kinds = None
        for b in batches:
            kinds = kinds or (b.schema.field("vec_id").type, b.schema.field("label").type)
            there = b.column("v").is_valid()
            rows = b.filter(there)
            x = _fixed(rows.column("v"), np.int64, parts, w)
            if bounds.first:
                own, upper, lower = np.zeros(x.shape[:2], np.uint16), np.zeros(x.shape[:2]), np.zeros(x.shape[:2])
            else:
                own, upper, lower = _fixed(rows.column("own"), np.uint16, parts), _fixed(rows.column("upper"), np.float64, parts), _fixed(rows.column("lower"), np.float64, parts)
            scans += bounds.assign(x, own, upper, lower)
            cell = (np.arange(parts) * k + own).ravel()
            np.add.at(total, cell, x.reshape(-1, w))
            n += np.bincount(cell, minlength=parts * k)
            unfit = b.filter(pc.invert(there))
            for part, state in ((rows, [_rows_of(own), _rows_of(upper), _rows_of(lower)]), (unfit, [[None] * unfit.num_rows] * 3)):
                if part.num_rows:
                    none = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(["state"] * none), part.column("vec_id"), part.column("label"), part.column("v"), *[pa.array(s, pa.binary()) for s in state], pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64()))],
                        names=out.names,
                    )
        used = np.nonzero(n)[0]
        if kinds and len(used):
            cells = [*used.tolist(), -1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["sums"] * len(cells)), pa.nulls(len(cells), kinds[0]), pa.nulls(len(cells), kinds[1]), *[pa.nulls(len(cells), pa.binary())] * 4, pa.array(cells, pa.int32()), pa.array([*n[used].tolist(), scans], pa.int64()), pa.array([*total[used].tolist(), []], pa.list_(pa.int64()))],
                names=out.names,
            )

    return mapped(table, run, out, "vectorcodes")


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """The table vec_id, label, code (two hexadecimal digits a part), error (squared distances, summed), and the codebooks.

    Rows without a vector, or with a component that is null or not finite, go. The usable row with the smallest id rules
    how many components there are; rows with another number stay with null code and error. A number that `parts` doesn't
    divide is filled up with zeros. Components whose integer is beyond +-sqrt(2^62 / components) / 2 are held there (for 64
    components: |x| above 32,768). Codebooks begin with the rows of the smallest ids (null ids last, equal ids by
    components), fewer entries if there are fewer rows; entries that no part takes stay as they are. Repeated rows each
    count and get the same code. An empty table gives an empty one. Up to 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries fit into two hexadecimal digits")
    spark = vectors.sparkSession
    books = _start(vectors, vec_id, vector, parts, entries, scale)
    table = _parsed(vectors, vec_id, vector, label, parts, scale, books.width)
    schema, old, written = table.schema, None, None
    final = shared_folder(spark, "vector-codes")
    if not books.entries.size:  # no row, or rows without components
        cells = books.entries.shape[1]
        table.select("vec_id", "label", F.when(F.col("v").isNotNull() & F.lit(cells > 0), "00" * parts).alias("code"), F.when(F.col("v").isNotNull(), F.lit(0).cast("long")).alias("error")).write.parquet(final)
    else:
        for _ in range(rounds):
            folder = shared_folder(spark, "vector-round")
            done = _round(table, Bounds(books.entries, old), schema)
            done.write.partitionBy("kind").parquet(folder)
            kept = spark.read.schema(done.schema).parquet(folder)
            if written:
                dropped(spark, written)
            table, written, old = kept.where("kind = 'state'").select("vec_id", "label", "v", "own", "upper", "lower"), folder, books.entries
            books.entries = _updated(kept.where("kind = 'sums'"), books)
        _coded(table, Bounds(books.entries, old), schema).write.parquet(final)
        if written:
            dropped(spark, written)
    kind = T.StructType([schema["vec_id"], schema["label"], *fields("code string, error long")])
    return spark.read.schema(kind).parquet(final), books


def _updated(sums: DataFrame, books: Codebooks) -> np.ndarray:
    """The floor of each entry's mean; the sums of all tasks are added by Spark."""
    parts, k, w = books.entries.shape
    new = books.entries.reshape(parts * k, w).copy()
    cells = sums.where("cell >= 0").select("cell", "n", F.posexplode("total").alias("at", "s")).groupBy("cell", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    for r in cells.collect():  # a row a component of an entry
        new[r["cell"], r["at"]] = r["s"] // r["n"]
    books.scans.append(sums.where("cell = -1").agg(F.sum("n")).head()[0] or 0)
    return new.reshape(parts, k, w)


def _coded(table: DataFrame, bounds: Bounds, schema: T.StructType) -> DataFrame:
    """The last assignment: codes and exact errors."""
    parts, _, w = bounds.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.column("v").is_valid()
            rows = b.filter(there)
            x = _fixed(rows.column("v"), np.int64, parts, w)
            if bounds.first:  # no round was asked for
                own, upper, lower = np.zeros(x.shape[:2], np.uint16), np.zeros(x.shape[:2]), np.zeros(x.shape[:2])
            else:
                own, upper, lower = _fixed(rows.column("own"), np.uint16, parts), _fixed(rows.column("upper"), np.float64, parts), _fixed(rows.column("lower"), np.float64, parts)
            bounds.assign(x, own, upper, lower)
            found = iter(zip([r.tobytes().hex() for r in own.astype(np.uint8)], _squares(x, bounds.entries, own).sum(1).tolist(), strict=True))
            made = [next(found) if t else (None, None) for t in there.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c for c, _ in made], pa.string()), pa.array([e for _, e in made], pa.int64())], names=["vec_id", "label", "code", "error"])

    return mapped(table, run, T.StructType([schema["vec_id"], schema["label"], *fields("code string, error long")]), "vectorcodes")


def decode(codes: DataFrame, books: Codebooks, code: str = "code", column: str = "vector") -> DataFrame:
    """The codes' vectors as doubles (components of the entries, divided by the scale); a null code gives null."""
    parts, _, w = books.entries.shape
    tables = [F.from_json(F.lit(str((e / books.scale).tolist())), "array<array<double>>") for e in books.entries]
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    whole = F.slice(F.concat(*[F.get(t, at(p)) for p, t in enumerate(tables)]), 1, books.width) if books.width else F.array().cast("array<double>")
    return codes.withColumn(column, F.when(F.col(code).isNotNull(), whole))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`label_error`: the error summed over rows of equal label, nulls together; null where all errors are, or beyond 64 bits."""
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")
