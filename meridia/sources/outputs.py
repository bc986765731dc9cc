"""Where a run's output goes: folders, the log and the times of its steps."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folders of a run's output.
FOLDERS = [
    "benchmarking",
    "bootstrap",
    "bootstrap_metrics",
    "bootstrap_predictions",
    "data",
    "logfiles",
    "models",
    "optimize",
    "plots",
    "plots/shapefile",
    "predictions",
    "test",
    "training",
    "validation",
]


class Layout:
    """Paths below an output folder, with a prefix before each name; writers make the folders when they write."""

    def __init__(self, base: str, prefix: str = "run"):
        self.base, self.prefix = base.rstrip("/"), prefix

    def path(self, folder: str, name: str) -> str:
        if folder not in FOLDERS:
            raise ValueError(f"{folder} isn't an output folder")
        return f"{self.base}/{folder}/{self.prefix}_{name}"


def logger(name: str, path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger of the driver that writes to the console and, if given, to a file of this machine; calling again replaces its handlers."""
    log = logging.getLogger(name)
    log.setLevel(level)
    log.propagate = False
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    return log


class Timings:
    """Seconds of named steps. Work that is only planned takes none: time what runs, such as writes."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - began))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "function string, seconds double")


def clock(seconds: float) -> str:
    """HH:MM:SS."""
    whole = int(seconds)
    return f"{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}"
