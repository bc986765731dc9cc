"""Principal axes of tables with more features than any machine holds products for: PCA and MCA of (sample, locus, dosage).

The matrix is cut into tiles of samples x loci, one byte a call, which stay where they are; only thin blocks of vectors
move. The axes come from a block Krylov range finder: a random start, products with the matrix and its transpose as joins of
tiles and blocks, each new block orthogonalised against all before by tall-skinny QR (Cholesky factors of summed Gram
matrices, done twice). The projection of the matrix on all blocks so far falls out of those sums, so the driver holds only
matrices of (vectors x vectors). It ends when the residuals of the wanted axes are small.

With up to HELD_ROWS samples, calls are kept as stripes of loci, missing ones left out, and the vectors of samples come to the
driver: a pass is one job, that of the matrix times its transpose. With up to GRAM_ROWS samples and few calls that product is
formed once, and passes run no jobs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import kernels
from meridia.operators.samples import numbered
from meridia.sources.folders import work_folder

#: Samples and loci of a tile: 4 MB of calls, 32 MB as numbers while it is multiplied.
ROWS, COLS = 2048, 2048
#: A tile is multiplied call by call if at most one place in so many has one.
SPARSE = 16
#: Samples up to which the driver holds some vectors with a number for each.
HELD_ROWS = 100_000
#: Samples and calls up to which the products of all samples are formed: 512 MB, and 12 bytes a call.
GRAM_ROWS, GRAM_CALLS = 8192, 8_000_000
#: Samples up to which those products are decomposed as a whole.
WHOLE_ROWS = 2000
#: Calls of a stripe of loci.
STRIPE_CALLS = 500_000
_BLOCK = "at long, m binary"


@dataclass
class Tiles:
    """`table`: rb, cb, rows, cols, codes (int8, -1 missing), stats (of the columns); `samples`: sample, i; `loci`: locus, j."""

    table: DataFrame
    samples: DataFrame
    loci: DataFrame
    n: int
    p: int
    kind: str  # pca or mca
    scale: float  # mca: all ones of the indicators

    def close(self) -> None:
        self.table.unpersist()


def dense(codes: bytes, rows: int, stats: bytes, kind: str, n: int, scale: float) -> np.ndarray:
    """The tile's part of the matrix: centred dosages, or standardised indicators of the dosages 0, 1 and 2."""
    x = np.frombuffer(codes, np.int8).reshape(rows, -1)
    s = np.frombuffer(stats)
    if kind == "pca":
        return np.where(x < 0, 0.0, x - s)
    mass = s / scale
    z = (x[:, :, None] == np.arange(3, dtype=np.int8)).reshape(rows, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(mass > 0, n**0.5 * (z / scale - mass / n) / np.sqrt(mass), 0.0)


def times(codes: bytes, rows: int, stats: bytes, kind: str, n: int, scale: float, v: np.ndarray, transposed: bool) -> np.ndarray:
    """The tile's part of the matrix (transposed: its transpose) times v; a tile with few calls is never made dense.

    Missing calls are 0 in a PCA. In an MCA they are the same in all rows, so that part is one row of numbers.
    """
    x = np.frombuffer(codes, np.int8)
    at = np.flatnonzero(x >= 0)
    if len(at) * SPARSE > len(x):
        a = dense(codes, rows, stats, kind, n, scale)
        return (a.T if transposed else a) @ v
    s, cols = np.frombuffer(stats), len(x) // rows
    r, c, code = at // cols, at % cols, x[at]
    if kind == "pca":
        a, same, width = code - s[c], None, cols
    else:
        mass, c, width = s / scale, 3 * c + code, 3 * cols
        root = np.sqrt(np.where(mass > 0, mass, np.inf))
        a, same = n**0.5 / scale / root[c], -(n**-0.5) * mass / root
    if transposed:
        out = _added(c, r, a, v, width)
        return out if same is None else out + same[:, None] * v.sum(0)
    out = _added(r, c, a, v, rows)
    return out if same is None else out + same @ v


def _added(to: np.ndarray, of: np.ndarray, a: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """The rows of v at `of` times a, added at the places `to` of a table of `size` rows."""
    out = np.zeros((size, v.shape[1]))
    if len(to):
        order = np.argsort(to, kind="stable")
        to = to[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        out[to[first]] = np.add.reduceat(v[of[order]] * a[order, None], first)
    return out


@dataclass
class Calls:
    """`table`: sample, locus, code, repeated pairs once; `samples`: sample, i; `loci`: locus, j. All written to `folder`."""

    table: DataFrame
    samples: DataFrame
    loci: DataFrame
    n: int
    p: int
    there: int  # calls that aren't null
    folder: str


def calls(dosages: DataFrame, kind: str = "pca") -> Calls:
    """Numbered samples and loci of (sample, locus, dosage). Of repeated pairs the largest counts."""
    spark = dosages.sparkSession
    folder = work_folder(dosages, "tiles")
    thin = dosages.groupBy("sample", "locus").agg(F.max("dosage").cast("int").alias("code"))
    thin.write.parquet(f"{folder}/calls")
    thin = spark.read.schema(thin.schema).parquet(f"{folder}/calls")
    low, high, there = thin.agg(F.min("code"), F.max("code"), F.count("code")).head()
    if low is not None and (low < 0 or high > (2 if kind == "mca" else 100)):
        raise ValueError(f"dosages from {low} to {high} are out of range")
    samples, loci = (numbered(thin.select(c).distinct(), [c], name) for c, name in (("sample", "i"), ("locus", "j")))
    samples.write.parquet(f"{folder}/samples")
    loci.write.parquet(f"{folder}/loci")
    samples, loci = spark.read.schema(samples.schema).parquet(f"{folder}/samples"), spark.read.schema(loci.schema).parquet(f"{folder}/loci")
    return Calls(thin, samples, loci, samples.count(), loci.count(), there, folder)


def tiles(c: Calls, kind: str = "pca", rows: int = ROWS, cols: int = COLS) -> Tiles:
    """Tiles of calls. Pairs that are not there are missing.

    Missing calls of a PCA stand for the mean of their locus, those of an MCA for no category; other dosages than 0, 1 and 2
    are an error in MCA, whole numbers up to 100 are taken by PCA. Loci without any call are columns of zeros.
    """
    spark, folder, thin, samples, loci, n, p = c.table.sparkSession, c.folder, c.table, c.samples, c.loci, c.n, c.p
    part = lambda c, size: (F.col(c) / size).cast("long")
    cells = thin.join(samples, "sample").join(loci, "locus").select(part("i", rows).alias("rb"), part("j", cols).alias("cb"), (F.col("i") % rows).cast("int").alias("r"), (F.col("j") % cols).cast("int").alias("c"), "code")
    down, across = -(-n // rows), -(-p // cols)
    # a tile without any call still has its place in the matrix
    places = spark.range(down * across).select((F.col("id") / F.lit(max(across, 1))).cast("long").alias("rb"), (F.col("id") % max(across, 1)).alias("cb"), F.lit(-1).alias("r"), F.lit(-1).alias("c"), F.lit(None).cast("int").alias("code"))
    cells = cells.union(places)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        rb, cb = (k.as_py() for k in key)
        have = min(rows, n - rb * rows), min(cols, p - cb * cols)
        x = np.full(have, -1, np.int8)
        t = t.filter(pc.greater_equal(t.column("r"), 0))
        code = t.column("code")
        x[t.column("r").to_numpy(), t.column("c").to_numpy()] = code.fill_null(-1).to_numpy()
        if kind == "pca":
            there = x >= 0
            sums = [there.sum(0), np.where(there, x, 0).sum(0, dtype=np.int64)]
        else:
            sums = [(x == k).sum(0) for k in range(3)]
        return pa.table({"rb": [rb], "cb": [cb], "rows": pa.array([have[0]], pa.int32()), "codes": pa.array([x.tobytes()], pa.binary()), "sums": pa.array([np.stack(sums).astype(np.int64).tobytes()], pa.binary())})

    packed = cells.groupBy("rb", "cb").applyInArrow(pack, "rb long, cb long, rows int, codes binary, sums binary")
    packed.write.parquet(f"{folder}/tiles")
    packed = spark.read.schema(packed.schema).parquet(f"{folder}/tiles")

    def stats(key: tuple, t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s, np.int64) for s in t.column("sums").to_pylist()], axis=0).reshape(2 if kind == "pca" else 3, -1)
        found = total[1] / np.maximum(total[0], 1) if kind == "pca" else total.T.ravel().astype(float)
        return pa.table({"scb": [key[0].as_py()], "stats": pa.array([found.tobytes()], pa.binary()), "ones": [float(total.sum())]})

    columns = packed.select("cb", "sums").groupBy("cb").applyInArrow(stats, "scb long, stats binary, ones double")
    columns.write.parquet(f"{folder}/stats")
    columns = spark.read.schema(columns.schema).parquet(f"{folder}/stats")
    scale = columns.agg(F.sum("ones")).head()[0] or 0.0
    whole = packed.drop("sums").join(columns.drop("ones"), packed["cb"] == columns["scb"]).drop("scb")
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism + packed.count() // 64, packed.count()))
    return Tiles(whole.repartition(parts, "rb", "cb").persist(StorageLevel.DISK_ONLY), samples, loci, n, p, kind, scale)


def _summed(parts: DataFrame, folder: str) -> DataFrame:
    """The sums of blocks of one place, written."""

    def total(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"at": [key[0].as_py()], "m": pa.array([np.sum([np.frombuffer(m) for m in t.column("m").to_pylist()], axis=0).tobytes()], pa.binary())})

    out = parts.groupBy("at").applyInArrow(total, _BLOCK)
    out.write.parquet(folder)
    return parts.sparkSession.read.schema(out.schema).parquet(folder)


def _product(t: Tiles, blocks: DataFrame, transposed: bool, folder: str) -> DataFrame:
    """The matrix (transposed: its transpose) times the blocks (at, m): blocks go to the tiles, tiles stay."""
    kind, n, scale = t.kind, t.n, t.scale
    mine, other = ("rb", "cb") if transposed else ("cb", "rb")
    sent = t.table.select("rb", "cb").join(blocks.select("at", "m"), F.col(mine) == F.col("at")).select(F.col("rb").alias("krb"), F.col("cb").alias("kcb"), "m")
    met = t.table.join(sent, (F.col("rb") == F.col("krb")) & (F.col("cb") == F.col("kcb"))).select(F.col(other).alias("at"), "rows", "codes", "stats", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                at, rows, codes, stats, m = (c[r].as_py() for c in b.columns)
                height = rows if transposed else len(codes) // rows * (1 if kind == "pca" else 3)
                yield _block([at], [times(codes, rows, stats, kind, n, scale, np.frombuffer(m).reshape(height, -1), transposed)])

    return _summed(met.mapInArrow(run, _BLOCK), folder)


def _block(at: list[int], matrices: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([np.ascontiguousarray(m).tobytes() for m in matrices], pa.binary())], names=["at", "m"])


_PAIRS = "at long, rows int, k binary, y binary"


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """at, rows, the basis and the new block of each row of a table of _PAIRS."""
    for at, rows, k, y in zip(*[b.column(c).to_pylist() for c in ("at", "rows", "k", "y")], strict=True):
        yield at, rows, np.frombuffer(k).reshape(rows, -1) if k else np.zeros((rows, 0)), np.frombuffer(y).reshape(rows, -1) if y else np.zeros((rows, 0))


def _gram(pairs: DataFrame) -> np.ndarray:
    """[K Y]'[K Y]: sums of each task are added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for _, _, k, y in _matrices(b):
                v = np.hstack([k, y])
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(len(total)), pa.int32()), "v": pa.array(total.tolist(), pa.list_(pa.float64()))})

    sums = pairs.mapInArrow(run, "row int, v array<double>").select("row", F.posexplode("v").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x"))
    found = sums.toPandas()  # vectors x vectors
    size = int(found["row"].max()) + 1 if len(found) else 0
    out = np.zeros((size, size))
    out[found["row"], found["col"]] = found["x"]
    return (out + out.T) / 2


def _factor(gram: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What K is multiplied with and taken off Y, what the rest is multiplied with to be orthonormal, and the rest's factor.

    Directions in which the rest is nothing but rounding are left out.
    """
    k, c, y = gram[:before, :before], gram[:before, before:], gram[before:, before:]
    minus = np.linalg.solve(k, c) if before else c
    rest = y - c.T @ minus
    values, vectors = np.linalg.eigh((rest + rest.T) / 2)
    kept = values > max(1e-14 * float(np.trace(y)), 1e-300)
    root = np.sqrt(values[kept])
    return minus, vectors[:, kept] / root, (vectors[:, kept] * root).T


def _orthonormal(pairs: DataFrame, before: int, new: Callable[[], str], gram: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """The pairs with Y made orthonormal and added to K, and the factor of what was new in Y. Done twice, as the first leaves rounding."""
    factor = None
    for last in (False, True):
        minus, times, r = _factor(_gram(pairs) if gram is None else gram, before)
        gram, factor = None, r if factor is None else r @ factor

        def run(batches: Iterator[pa.RecordBatch], minus: np.ndarray = minus, times: np.ndarray = times, last: bool = last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ks, ys = [], []
                for _, _, k, y in _matrices(b):
                    y = (y - k @ minus) @ times
                    ks.append(np.hstack([k, y]).tobytes() if last else np.ascontiguousarray(k).tobytes())
                    ys.append(np.ascontiguousarray(y).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("at"), b.column("rows"), pa.array(ks, pa.binary()), pa.array(ys, pa.binary())], names=["at", "rows", "k", "y"])

        pairs = _written(pairs.mapInArrow(run, _PAIRS), new())
        if not len(factor):
            break
    return pairs, factor


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def axes(t: Tiles, k: int, tolerance: float = 1e-8, passes: int = 60, extra: int = 8, seed: int = 0) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """The first k singular values, and the left and right axes as blocks (at, m) of samples and of loci.

    A block has `extra` vectors more than k; a pass is a product with the matrix's transpose and one with the matrix. It ends
    when the residual of each wanted axis of the matrix times its transpose is below `tolerance` times the largest
    eigenvalue, or when no direction is left; RuntimeError if `passes` don't do. The largest part of a right axis is positive.
    """
    spark, folder = t.table.sparkSession, work_folder(t.table, "axes")
    names = itertools.count()
    new = lambda: f"{folder}/{next(names)}"
    k = min(k, t.n, t.p * (3 if t.kind == "mca" else 1))
    width = min(t.n, k + extra)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys = [np.random.default_rng([seed, at]).normal(size=(rows, width)).tobytes() for at, rows in zip(b.column("at").to_pylist(), b.column("rows").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("rows"), pa.array([b""] * len(ys), pa.binary()), pa.array(ys, pa.binary())], names=["at", "rows", "k", "y"])

    stripes = t.table.select(F.col("rb").alias("at"), "rows").distinct()
    pairs, factor = _orthonormal(_written(stripes.mapInArrow(start, _PAIRS), new()), 0, new)
    used, fresh, known = 0, len(factor), np.zeros((0, 0))  # columns of K whose products are known, those added last, and K' M K
    for _ in range(passes):
        used += fresh
        back = _product(t, _product(t, pairs.select("at", F.col("y").alias("m")), True, new()), False, new())
        pairs = _written(pairs.select("at", "rows", "k").join(back.withColumnRenamed("m", "y"), "at").select("at", "rows", "k", "y"), new())
        gram = _gram(pairs)
        grown = np.zeros((used, used))
        grown[: used - fresh, : used - fresh] = known
        grown[:, used - fresh :] = gram[:used, used:]
        grown[used - fresh :, : used - fresh] = grown[: used - fresh, used - fresh :].T
        known = grown
        pairs, factor = _orthonormal(pairs, used, new, gram)
        values, w = np.linalg.eigh((known + known.T) / 2)
        values, w = np.maximum(values[::-1][:k], 0), w[:, ::-1][:, :k]
        residual = np.linalg.norm(factor @ w[used - fresh :], axis=0) if len(factor) else np.zeros(k)
        if not len(factor) or residual.max() <= tolerance * max(values[0], 1e-300):
            break
        fresh = len(factor)
    else:
        raise RuntimeError(f"axes: residual {residual.max():.1e} after {passes} passes")

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(at, basis[:, :used] @ w) for at, _, basis, _ in _matrices(b)]
            yield _block([at for at, _ in found], [m for _, m in found])

    sigma = np.sqrt(values)
    left = _written(pairs.mapInArrow(mixed, _BLOCK), new())
    right = _product(t, left, True, new())
    sign = _signs(right, k)
    inverse = np.divide(sign, sigma, out=np.zeros(k), where=sigma > 1e-12 * max(float(sigma[0]), 1e-300))
    return sigma, _scaled(left, sign, new()), _scaled(right, inverse, new())


def _signs(blocks: DataFrame, k: int) -> np.ndarray:
    """Of each column the sign of its largest part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column("m").to_pylist():
                v = np.frombuffer(m).reshape(-1, k)
                top = v[np.abs(v).argmax(0), np.arange(k)]
                yield pa.RecordBatch.from_pydict({"col": pa.array(range(k), pa.int32()), "x": pa.array(top)})

    found = blocks.mapInArrow(run, "col int, x double").groupBy("col").agg(F.max_by("x", F.abs("x")).alias("x")).collect()
    out = np.ones(k)
    for r in found:
        out[r["col"]] = -1.0 if r["x"] < 0 else 1.0
    return out


def _scaled(blocks: DataFrame, factor: np.ndarray, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _block(b.column("at").to_pylist(), [np.frombuffer(m).reshape(-1, len(factor)) * factor for m in b.column("m").to_pylist()])

    return _written(blocks.mapInArrow(run, _BLOCK), folder)


def _unpacked(blocks: DataFrame, names: DataFrame, key: str, number: str, size: int, factor: np.ndarray) -> DataFrame:
    """(key, features) of blocks of `size` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in zip(b.column("at").to_pylist(), b.column("m").to_pylist(), strict=True):
                v = np.frombuffer(m).reshape(-1, len(factor)) * factor
                yield pa.RecordBatch.from_pydict({"__i": pa.array(np.arange(len(v)) + at * size), "features": pa.array(v.tolist(), pa.list_(pa.float64()))})

    return names.join(blocks.mapInArrow(run, "__i long, features array<double>"), F.col(number) == F.col("__i")).select(key, "features")


def _squares(t: Tiles) -> float:
    """The sum of the squares of the whole matrix."""
    kind, n, scale = t.kind, t.n, t.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, codes, stats in zip(*[c.to_pylist() for c in b.columns], strict=True):
                yield pa.RecordBatch.from_pydict({"x": [float((dense(codes, rows, stats, kind, n, scale) ** 2).sum())]})

    return t.table.select("rows", "codes", "stats").mapInArrow(run, "x double").agg(F.sum("x")).head()[0] or 0.0


@dataclass
class Stripes:
    """`table`: stripe, ends, at, w, same, squares: of the columns of some loci where each ends, its samples (int32) and their numbers,
    a number that every sample has besides (MCA; else empty), and the sum of all squares."""

    table: DataFrame
    calls: Calls
    kind: str
    loci: int  # of a stripe
    many: int


_STRIPE = "stripe long, ends binary, at binary, w binary, same binary, squares double"


def stripes(c: Calls, kind: str, most: int = COLS) -> Stripes:
    """The matrix by stripes of at most `most` loci, without the calls that are missing."""
    spark, n, p, scale = c.table.sparkSession, c.n, c.p, float(c.there)
    size = max(1, min(most, STRIPE_CALLS * p // max(c.there, 1), -(-p // spark.sparkContext.defaultParallelism)))
    many = -(-p // size)
    cells = c.table.where("code is not null").join(c.samples, "sample").join(c.loci, "locus").select(F.floor(F.col("j") / size).alias("stripe"), F.col("i").cast("int").alias("i"), (F.col("j") % size).cast("int").alias("c"), "code")
    # a stripe without any call still has its place
    cells = cells.union(spark.range(many).select("id", F.lit(-1).alias("i"), F.lit(-1).alias("c"), F.lit(0).alias("code")))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        stripe = key[0].as_py()
        t = t.filter(pc.greater_equal(t.column("i"), 0))
        i, at, code = (t.column(x).to_numpy() for x in ("i", "c", "code"))
        width = min(size, p - stripe * size)
        if kind == "mca":
            at, width = 3 * at + code, 3 * width
        order = np.lexsort((i, at))
        i, at, code = i[order], at[order], code[order]
        have = np.bincount(at, minlength=width)
        if kind == "pca":
            w, same = code - (np.bincount(at, weights=code, minlength=width) / np.maximum(have, 1))[at], np.zeros(0)
            squares = float((w**2).sum())
        else:
            mass = have / scale
            root = np.sqrt(np.where(mass > 0, mass, np.inf))
            w, same = n**0.5 / scale / root[at], -(n**-0.5) * mass / root
            squares = float((n / root**2 * (have * (1 / scale - mass / n) ** 2 + (n - have) * (mass / n) ** 2)).sum())
        binary = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        return pa.table({"stripe": [stripe], "ends": binary(np.cumsum(have), np.int64), "at": binary(i, np.int32), "w": binary(w, float), "same": binary(same, float), "squares": [squares]})

    packed = cells.groupBy("stripe").applyInArrow(pack, _STRIPE)
    packed.write.parquet(f"{c.folder}/stripes")
    return Stripes(spark.read.schema(_STRIPE).parquet(f"{c.folder}/stripes"), c, kind, size, many)


def _across(ends: np.ndarray, at: np.ndarray, w: np.ndarray, same: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The transpose of a stripe times v."""
    starts, y = np.append(0, ends[:-1]), np.zeros((len(ends), v.shape[1]))
    some = ends > starts
    if some.any():
        y[some] = np.add.reduceat(w[:, None] * v[at], starts[some], axis=0)
    return y + same[:, None] * v.sum(0) if len(same) else y


def _back(ends: np.ndarray, at: np.ndarray, w: np.ndarray, same: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """A stripe times y."""
    spread = y[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))] * w[:, None]
    out = np.stack([np.bincount(at, weights=x, minlength=n) for x in spread.T], axis=1)
    return out + same @ y if len(same) else out


def _parts(ends: bytes, at: bytes, w: bytes, same: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ends, np.int64), np.frombuffer(at, np.int32), np.frombuffer(w), np.frombuffer(same)


def _read(b: pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Number and parts of the stripes of a batch."""
    for r in range(b.num_rows):
        yield b.column("stripe")[r].as_py(), _parts(*(b.column(c)[r].as_py() for c in ("ends", "at", "w", "same")))


def _squared(t: DataFrame, v: np.ndarray) -> np.ndarray:
    """The matrix times its transpose times v: a task sums its stripes, Spark the tasks' sums, which come by blocks of rows."""
    shared, n = t.sparkSession.sparkContext.broadcast(v), len(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for _, parts in _read(b):
                own = _back(*parts, _across(*parts, shared.value), n)
                total = own if total is None else total + own
        if total is not None:
            yield _block(list(range(0, n, 8192)), [total[a : a + 8192] for a in range(0, n, 8192)])

    def add(key: tuple, g: pa.Table) -> pa.Table:
        return pa.table({"at": [key[0].as_py()], "m": pa.array([np.sum([np.frombuffer(m) for m in g.column("m").to_pylist()], axis=0).tobytes()], pa.binary())})

    out = np.zeros_like(v)
    for r in t.select("stripe", "ends", "at", "w", "same").mapInArrow(run, _BLOCK).groupBy("at").applyInArrow(add, _BLOCK).collect():
        m = np.frombuffer(r["m"]).reshape(-1, v.shape[1])
        out[r["at"] : r["at"] + len(m)] = m
    shared.destroy()
    return out


def _products(t: DataFrame, n: int) -> np.ndarray:
    """The products of all samples, a task a block of them; all stripes go to every executor."""
    spark = t.sparkSession
    held = [tuple(bytes(x) for x in r) for r in t.select("ends", "at", "w", "same").toLocalIterator()]
    shared = spark.sparkContext.broadcast(held)
    size = max(1, min(512, -(-n // spark.sparkContext.defaultParallelism)))

    def rows(first: int) -> np.ndarray:
        last = min(n, first + size)
        out = np.zeros((last - first, n))
        flat, shift, whole = out.reshape(-1), np.zeros(n), 0.0
        for found in shared.value:
            ends, at, w, same = _parts(*found)
            have = np.diff(ends, prepend=0)
            col = np.repeat(np.arange(len(ends)), have)
            if len(at) * SPARSE > n * len(ends):  # made dense by some columns
                for c in range(0, len(ends), 1024):
                    a, b = (ends[c - 1] if c else 0), ends[min(c + 1024, len(ends)) - 1]
                    x = np.zeros((n, min(1024, len(ends) - c)))
                    x[at[a:b], col[a:b] - c] = w[a:b]
                    out += x[first:last] @ x.T
            else:
                mine = np.flatnonzero((at >= first) & (at < last))
                upto = np.cumsum(have[col[mine]])
                for a, b in itertools.pairwise(np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, 4_000_000)), len(mine)))):
                    one = mine[a:b]
                    many = have[col[one]]
                    other = np.repeat(ends[col[one]] - np.cumsum(many), many) + np.arange(many.sum())
                    one = np.repeat(one, many)
                    np.add.at(flat, (at[one].astype(np.int64) - first) * n + at[other], w[one] * w[other])
            if len(same):
                shift += np.bincount(at, weights=w * same[col], minlength=n)
                whole += same @ same
        return out + shift[first:last, None] + shift + whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column("id").to_pylist():
                yield _block([first], [rows(first)])

    out = np.zeros((n, n))
    for r in spark.range(0, n, size, -(-n // size)).mapInArrow(run, _BLOCK).toLocalIterator(prefetchPartitions=True):
        m = np.frombuffer(r["m"]).reshape(-1, n)
        out[r["at"] : r["at"] + len(m)] = m
    shared.destroy()
    return out


def held_axes(t: Stripes, k: int, tolerance: float = 1e-8, passes: int = 500, extra: int = 8) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """As axes(): singular values, left axes as an array, and right axes as blocks, from stripes."""
    spark, n = t.table.sparkSession, t.calls.n
    k = min(k, n, t.calls.p * (3 if t.kind == "mca" else 1))
    if n <= GRAM_ROWS and t.calls.there <= GRAM_CALLS:
        g = _products(t.table, n)
        if n <= WHOLE_ROWS:
            values, left = np.linalg.eigh((g + g.T) / 2)
            values, left = values[::-1][:k], left[:, ::-1][:, :k]
        else:
            values, left = kernels.leading(lambda v: g @ v, n, k, min(n, k + extra), tolerance, passes, 40)
    else:
        spread = t.table.repartition(min(t.many, 2 * spark.sparkContext.defaultParallelism), "stripe").persist(StorageLevel.DISK_ONLY)
        try:
            values, left = kernels.leading(lambda v: _squared(spread, v), n, k, min(n, k + extra), tolerance, passes)
        finally:
            spread.unpersist()
    sigma = np.sqrt(np.maximum(values, 0))
    shared = spark.sparkContext.broadcast(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stripe, parts in _read(b):
                yield _block([stripe], [_across(*parts, shared.value)])

    right = _written(t.table.select("stripe", "ends", "at", "w", "same").mapInArrow(run, _BLOCK), f"{t.calls.folder}/right")
    sign = _signs(right, k)
    inverse = np.divide(sign, sigma, out=np.zeros(k), where=sigma > 1e-12 * max(float(sigma[0]), 1e-300))
    return sigma, left * sign, _scaled(right, inverse, f"{t.calls.folder}/scaled")


@dataclass
class Embedding:
    """`samples`: sample, features (its coordinates); `loci`: locus, features (the right axes; of an MCA three a category in turn)."""

    samples: DataFrame
    loci: DataFrame
    singular: np.ndarray
    shares: np.ndarray  # of each axis in the sum of squares; the inertia of an MCA


def embed(dosages: DataFrame, kind: str = "pca", k: int = 10, tolerance: float = 1e-8, rows: int = ROWS, cols: int = COLS) -> Embedding:
    """PCA or MCA of (sample, locus, dosage) with any number of samples and loci; the shares are those of all axes, not only of k.

    An empty table, and one without any variation, give no axes.
    """
    empty = lambda c: dosages.select(c, F.array().cast("array<double>").alias("features")).distinct()
    none = lambda: Embedding(empty("sample"), empty("locus"), np.zeros(0), np.zeros(0))
    found = calls(dosages, kind)
    if not found.n or not found.p:
        return none()
    own = lambda sigma: sigma * (found.n**0.5 if kind == "mca" else 1.0)
    if found.n <= HELD_ROWS:
        s = stripes(found, kind, cols)
        whole = s.table.agg(F.sum("squares")).head()[0]
        if not whole:
            return none()
        sigma, left, right = held_axes(s, k, tolerance)
        samples, size = _looked_up(found.samples, left * own(sigma)), s.loci
    else:
        t = tiles(found, kind, rows, cols)
        try:
            whole = _squares(t)
            if not whole:
                return none()
            sigma, left, right = axes(t, k, tolerance)
        finally:
            t.close()
        samples, size = _unpacked(left, found.samples, "sample", "i", rows, own(sigma)), cols
    if kind == "pca":
        loci = _unpacked(right, found.loci, "locus", "j", size, np.ones(len(sigma)))
    else:
        each = _unpacked(right, found.loci.withColumn("category", F.explode(F.array(*[F.lit(c) for c in range(3)]))).withColumn("j3", 3 * F.col("j") + F.col("category")).select(F.struct("locus", "category").alias("locus"), "j3"), "locus", "j3", 3 * size, np.ones(len(sigma)))
        loci = each.groupBy("locus.locus").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("locus.category", "features"))), lambda x: x["features"])).alias("features"))
    shares = sigma**2 / whole if kind == "pca" else sigma**2
    return Embedding(samples, loci, sigma, shares)


def _looked_up(samples: DataFrame, rows: np.ndarray) -> DataFrame:
    """(sample, features) by the samples' numbers."""
    shared = samples.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value[b.column("i").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column("sample"), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["sample", "features"])

    return samples.select("sample", "i").mapInArrow(run, f"sample {samples.schema['sample'].dataType.simpleString()}, features array<double>")
