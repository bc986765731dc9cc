"""A coordinate regressor: a small perceptron in numpy, trained in one task a replicate or trial, applied in parallel.

Training rows are written once to the shared folder, in files of random rows; a task goes through the files in a new order
each epoch, so the training table may be of any size. Small tables stay in its memory.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.geo import on_globe, unscaled
from meridia.sources.folders import work_folder

#: Rows of a file of training rows, and the bytes of rows that a task keeps between epochs.
FILE_ROWS, CACHE_BYTES = 20_000, 256_000_000
#: Bytes of models that are broadcast at once.
MODEL_BYTES = 64_000_000
LOSSES = ("rmse", "drms", "huber")


def widths(inputs: int, width: int, layers: int, factor: float = 0.8) -> list[int]:
    """Hidden widths; the first shrinks by `factor` until it is below the number of inputs."""
    while width >= max(inputs, 2) and width > 1:
        width = int(width * factor)
    return [max(1, width)] * max(1, layers)


def hidden_layers(layers: int) -> tuple[int, int]:
    """How many hidden layers stand before the dropout and after it: the first one and half of the others less one, then half of them."""
    return 1 + max(0, layers // 2 - 1), -(-layers // 2)


def loss_and_gradient(kind: str, out: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """A loss of scaled coordinates and its gradient by `out`.

    rmse: the mean distance by weight; drms: the root of the weighted mean squared great-circle distance in km; huber: of
    targets moved by a tenth towards their mean, with delta 0.5.
    """
    if kind == "rmse":
        diff = out - y
        d = np.sqrt((diff**2).sum(1, keepdims=True) + 1e-12)
        share = w[:, None] / max(w.sum(), 1e-12)
        return float((d * share).sum()), diff / d * share
    if kind == "drms":
        scale = np.array([360.0, 180.0]) * np.pi / 180
        lon1, lat1 = ((out - [0.5, 0.5]) * scale).T
        lon2, lat2 = ((y - [0.5, 0.5]) * scale).T
        dlon, dlat = lon1 - lon2, lat1 - lat2
        h = np.clip(np.sin(dlat / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(dlon / 2) ** 2, 0, 1 - 1e-12)
        km = 2 * 6371.0 * np.arcsin(np.sqrt(h))
        loss = float(np.sqrt((w * km**2).mean()))
        by_h = np.where(h < 1e-14, 2 * 6371.0**2, km * 6371.0 / np.sqrt(np.maximum(h * (1 - h), 1e-28)))
        by_out = np.column_stack([0.5 * np.cos(lat1) * np.cos(lat2) * np.sin(dlon), 0.5 * np.sin(dlat) - np.sin(lat1) * np.cos(lat2) * np.sin(dlon / 2) ** 2])
        return loss, (w * by_h)[:, None] * by_out * scale / (len(out) * max(loss, 1e-9))
    if kind == "huber":
        diff = out - (0.9 * y + 0.1 * y.mean(0))
        e = np.abs(diff)
        each = np.where(e <= 0.5, 0.5 * e * e, 0.5 * (e - 0.25))
        return float((w[:, None] * each).mean()), w[:, None] * np.clip(diff, -0.5, 0.5) / diff.size
    raise ValueError(f"unknown loss {kind!r}")


Chunks = Callable[[np.random.Generator | None], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


class Perceptron:
    """Batch normalisation, linear layers with ELU between and two outputs; Adam, dropout, early stopping on a validation loss."""

    def __init__(self, inputs: int, width: int = 64, layers: int = 2, dropout: float = 0.0, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.dropped, after = hidden_layers(layers)
        sizes = [inputs, *widths(inputs, width, self.dropped + after), 2]
        self.w = [self.rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.dropout = dropout
        self.mean, self.var = np.zeros(inputs), np.ones(inputs)  # of the normalisation, as training goes on
        self.gain, self.shift = np.ones(inputs), np.zeros(inputs)
        self.y_mean, self.y_sd = np.zeros(2), np.ones(2)  # outputs are standardised
        self.losses: list[float] = []

    def _normal(self, x: np.ndarray, train: bool) -> np.ndarray:
        if train and len(x) > 1:  # a single row has no deviation
            m, v = x.mean(0), x.var(0)
            self.mean, self.var = 0.9 * self.mean + 0.1 * m, 0.9 * self.var + 0.1 * v * len(x) / (len(x) - 1)
            return (x - m) / np.sqrt(v + 1e-5)
        return (x - self.mean) / np.sqrt(self.var + 1e-5)

    def _forward(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, list, np.ndarray]:
        z0, kept = self._normal(x, train), []
        h = z0 * self.gain + self.shift
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            z = h @ w + b
            last = i == len(self.w) - 1
            out = z if last else np.where(z > 0, z, np.expm1(np.minimum(z, 0)))
            mask = (self.rng.random(out.shape) >= self.dropout) / (1 - self.dropout) if train and self.dropout and i == self.dropped - 1 and not last else None
            kept.append((h, z, mask))
            h = out if mask is None else out * mask
        return h, kept, z0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0] * self.y_sd + self.y_mean

    def _backward(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, loss: str) -> list[np.ndarray]:
        out, kept, z0 = self._forward(x, train=True)
        g = loss_and_gradient(loss, out * self.y_sd + self.y_mean, y, weight)[1] * self.y_sd
        g = g / max(float(self.y_sd.max()), 1e-9) if loss != "drms" else g
        gw, gb = [], []
        for k in range(len(self.w) - 1, -1, -1):
            h, z, mask = kept[k]
            if k < len(self.w) - 1:
                g = (g if mask is None else g * mask) * np.where(z > 0, 1, np.exp(np.minimum(z, 0)))
            gw.append(h.T @ g + l2 * self.w[k])
            gb.append(g.sum(0))
            g = g @ self.w[k].T
        return [*gw[::-1], *gb[::-1], (g * z0).sum(0), g.sum(0)]

    def _params(self) -> list[np.ndarray]:
        return [*self.w, *self.b, self.gain, self.shift]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, xv: np.ndarray, yv: np.ndarray, epochs: int = 200, patience: int = 20, lr: float = 1e-2, l2: float = 0.0, batch: int = 64, loss: str = "rmse") -> Perceptron:
        """Trains on arrays; fit_chunks() says how."""
        return self.fit_chunks(lambda _: iter([(x, y, weight)]), lambda _: iter([(xv, yv, np.ones(len(xv)))]), epochs, patience, lr, l2, batch, loss)

    def fit_chunks(self, rows: Chunks, held: Chunks, epochs: int = 200, patience: int = 20, lr: float = 1e-2, l2: float = 0.0, batch: int = 64, loss: str = "rmse", medians: list[float] = ()) -> Perceptron:
        """Trains on chunks of rows (x, y, weight) in a new order each epoch, until the loss of the `held` rows hasn't fallen for `patience` epochs.

        The step is halved three times meanwhile. `medians`: a run whose best loss is above the median of an epoch ends there.
        The parameters of the best epoch stay.
        """
        n, s1, s2, t1, t2 = 0, 0.0, 0.0, 0.0, 0.0
        for x, y, _ in rows(None):
            n, s1, s2, t1, t2 = n + len(x), s1 + x.sum(0), s2 + (x**2).sum(0), t1 + y.sum(0), t2 + (y**2).sum(0)
        if not n:
            return self
        self.mean, self.var = s1 / n, np.maximum(s2 / n - (s1 / n) ** 2, 1e-12)
        self.y_mean, self.y_sd = t1 / n, np.sqrt(np.maximum(t2 / n - (t1 / n) ** 2, 1e-18))
        params = self._params()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        state = lambda: [p.copy() for p in (*params, self.mean, self.var)]
        best, since, saved = np.inf, 0, state()
        for epoch in range(epochs):
            for x, y, weight in rows(self.rng):
                order = self.rng.permutation(len(x))
                for at in range(0, len(x), batch):
                    i = order[at : at + batch]
                    grads = self._backward(x[i], y[i], weight[i], l2, loss)
                    norm = np.sqrt(sum((q**2).sum() for q in grads))
                    t += 1
                    for j, q in enumerate(grads):
                        q = q * min(1.0, 5.0 / max(norm, 1e-12))
                        m[j], v[j] = 0.9 * m[j] + 0.1 * q, 0.999 * v[j] + 0.001 * q * q
                        params[j] -= lr * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
            seen, total = 0, 0.0
            for x, y, weight in held(None):
                if len(x):
                    one = loss_and_gradient(loss, self.predict(x), y, weight)[0]
                    seen, total = seen + len(x), total + len(x) * (one * one if loss == "drms" else one)
            now = (total / seen) ** (0.5 if loss == "drms" else 1) if seen else 0.0
            self.losses.append(float(now))
            if now <= best:
                best, since, saved = now, 0, state()
            else:
                since += 1
                if since >= patience:
                    break
                if since % max(1, patience // 3) == 0:
                    lr /= 2
            if epoch < len(medians) and best > medians[epoch]:
                break
        for p, q in zip(params, saved):
            p[...] = q
        self.mean, self.var = saved[-2:]
        return self

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, mean=self.mean, var=self.var, gain=self.gain, shift=self.shift, y_mean=self.y_mean, y_sd=self.y_sd, **{f"w{i}": w for i, w in enumerate(self.w)}, **{f"b{i}": b for i, b in enumerate(self.b)})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Perceptron:
        z = np.load(io.BytesIO(data))
        n = sum(k[0] == "w" for k in z.files)
        out = cls.__new__(cls)
        out.w, out.b, out.dropout, out.dropped, out.losses = [z[f"w{i}"] for i in range(n)], [z[f"b{i}"] for i in range(n)], 0.0, 0, []
        for k in ("mean", "var", "gain", "shift", "y_mean", "y_sd"):
            setattr(out, k, z[k])
        return out


class _Rows:
    """The rows of a split in the files of a folder, read chunk by chunk; all are kept if they are few."""

    def __init__(self, folder: str, split: str, columns: np.ndarray | None):
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        self.fs, self.columns, self.split, self.kept = fs, columns, split, {}
        self.files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
        self.room = CACHE_BYTES

    def __call__(self, rng: np.random.Generator | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k in rng.permutation(len(self.files)) if rng else range(len(self.files)):
            yield self._chunk(int(k))

    def _chunk(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k in self.kept:
            return self.kept[k]
        with self.fs.open_input_file(self.files[k]) as f:
            d = pq.ParquetFile(f).read(["split", "features", "tx", "ty", "weight"]).to_pandas()
        d = d[d["split"] == self.split]
        x = np.stack(d["features"].to_numpy()).astype(float) if len(d) else np.zeros((0, len(self.columns) if self.columns is not None else 1))
        x = x if self.columns is None or not len(d) else x[:, self.columns]
        out = x, d[["tx", "ty"]].to_numpy(float), d["weight"].to_numpy(float)
        if x.nbytes <= self.room:
            self.kept[k], self.room = out, self.room - x.nbytes
        return out


def train_all(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan, loss, params, columns, model, curve) for each row of `plans` (plan long, params JSON: width, layers, dropout, lr, l2, epochs, patience, seed, loci, loss_function, medians).

    `rows` has id, split, features, tx, ty (scaled) and weight. A task trains one plan on all training rows, in mini-batches;
    `loci`, if true, draws the features with replacement by the seed. `curve` are the validation losses by epoch.
    """
    spark, folder = rows.sparkSession, work_folder(rows, "training")
    thin = rows.where("split in ('train', 'val') and tx is not null and ty is not null").select("id", "split", F.col("features").cast("array<double>").alias("features"), "tx", "ty", F.col("weight").cast("double").alias("weight"))
    files = max(1, -(-thin.count() // FILE_ROWS))
    thin.repartition(files, F.xxhash64("id")).sortWithinPartitions("id").write.parquet(folder)
    first = spark.read.parquet(folder).select(F.size("features").alias("n")).head()
    inputs = first["n"] if first else 1

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for plan, params in zip(b["plan"], b["params"]):
                p = json.loads(params)
                seed = int(p.get("seed", 0)) + int(plan)
                cols = np.random.default_rng(seed).integers(0, inputs, inputs) if p.get("loci") else np.arange(inputs)
                net = Perceptron(inputs, int(p.get("width", 64)), int(p.get("layers", 2)), float(p.get("dropout", 0)), seed)
                net.fit_chunks(_Rows(folder, "train", cols), _Rows(folder, "val", cols), int(p.get("epochs", 100)), int(p.get("patience", 20)), float(p.get("lr", 1e-2)), float(p.get("l2", 0)), int(p.get("batch", 64)), p.get("loss_function", "rmse"), p.get("medians", ()))
                yield pd.DataFrame({"plan": [plan], "loss": [min(net.losses, default=float("nan"))], "params": [params], "columns": [cols.tolist()], "model": [net.dumps()], "curve": [net.losses]})

    n = max(1, plans.count())
    return plans.repartition(n, "plan").mapInPandas(run, "plan long, loss double, params string, columns array<int>, model binary, curve array<double>")


def predict(rows: DataFrame, models: DataFrame, strict: bool = False) -> DataFrame:
    """(plan, id, x, y, valid): coordinates in degrees by each model, and whether they are on the globe.

    Coordinates off the globe stay as they are; with `strict` they are an error. Models go to the executors in groups of at
    most MODEL_BYTES.
    """
    found = [r.asDict() for r in models.select("plan", F.length("model").alias("bytes")).orderBy("plan").collect()]
    groups, size = [[]], 0
    for r in found:
        if groups[-1] and size + r["bytes"] > MODEL_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(r["plan"])
        size += r["bytes"]
    out = None
    for plans in groups:
        fitted = models.where(F.col("plan").isin(plans)).select("plan", "columns", "model").toPandas()
        shared = rows.sparkSession.sparkContext.broadcast(fitted)

        def run(batches, shared=shared):  # noqa: ANN001, ANN202
            nets = [(p, np.asarray(c, int), Perceptron.loads(m)) for p, c, m in shared.value.itertuples(index=False)]
            for b in batches:
                if len(b):
                    x = np.stack(b["features"].to_numpy())
                    for p, c, net in nets:
                        z = net.predict(x[:, c])
                        yield pd.DataFrame({"plan": p, "id": b["id"], "u": z[:, 0], "v": z[:, 1]})

        one = rows.select("id", F.col("features").cast("array<double>").alias("features")).mapInPandas(run, "plan long, id long, u double, v double")
        out = one if out is None else out.union(one)
    x, y = unscaled(F.col("u"), F.col("v"))
    valid = on_globe(x, y)
    if strict:
        valid = F.when(valid, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("predicted coordinates are off the globe: "), x.cast("string"), F.lit(", "), y.cast("string"))).cast("boolean"))
    return out.select("plan", "id", x.alias("x"), y.alias("y"), valid.alias("valid"))


def search_plans(spark, trials: int, features: int) -> DataFrame:  # noqa: ANN001
    """(trial, lr, l2, width, layers, dropout): candidates from a fixed low-discrepancy rule that any SQL engine repeats."""
    t = spark.range(trials).withColumnRenamed("id", "trial")
    u = lambda k: ((F.col("trial") + 1) * k % 10007) / 10007.0
    return t.select("trial", F.pow(F.lit(10.0), -4 + 3 * u(7919)).alias("lr"), F.pow(F.lit(10.0), -5 + 4 * u(6101)).alias("l2"), (8 + F.floor(u(4801) * (features - 8))).cast("long").alias("width"), (2 + F.floor(u(3571) * 19)).cast("long").alias("layers"), (u(2791) * 0.5).alias("dropout"))
