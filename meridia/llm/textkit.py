"""What several text operators share: shared folders, white-space chunks and bounded memo tables."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows that a worker turns into Python strings at once; a batch of long texts stays small.
SLICE_ROWS = 64
#: Rows and bytes of an Arrow batch between Spark and a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16_000_000

#: The White_Space property of Unicode (str.split also splits at U+001C to U+001F, which lack it).
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_NOT_WHITE = re.compile(f"[^{WHITE_SPACE}]+")
_SEPARATOR_CONTROLS = re.compile(r"[\x1c-\x1f]")


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is this machine alone (tests), a folder of this machine is made and set as
    checkpoint folder; on a cluster RuntimeError says what is missing, as executors would write where none can read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_meridia_shared", None)
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="meridia-shared-")
            spark._meridia_shared = base
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """The URI of a new folder for `label` in the shared folder."""
    base = shared_base(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + os.path.abspath(base)}/{label}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Collects garbage and gives memory that this process doesn't use back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # small blocks stay with the process otherwise; only some C libraries have it
    if trim is not None:
        trim(0)


def dropped(spark: SparkSession, *folders: str) -> None:
    """Removes folders of the shared folder that no table reads any more.

    Shuffle files and broadcasts of the steps that wrote them go when the driver collects its garbage, which is asked for; its
    Python part gives back what samples and models took.
    """
    jvm = spark._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    give_back()
    jvm.System.gc()


def chunks(text: str) -> list[str]:
    """The maximal runs of characters without the White_Space property."""
    if _SEPARATOR_CONTROLS.search(text):
        return _NOT_WHITE.findall(text)
    return text.split()


#: A plain word of Latin letters and the signs after it; tokenizers split these two everywhere.
_WORD_AND_SIGNS = re.compile("([a-z\\u00df-\\u00f6\\u00f8-\\u00ff]+)([.,;:!?*#%&$|]*)")


def word_and_signs(chunk: str) -> tuple[str, str] | None:
    """The lower-case letters of a chunk and the signs after them, if it is of that kind."""
    found = _WORD_AND_SIGNS.fullmatch(chunk.lower())
    return found.groups() if found else None


#: By owner: what empties its tables.
_TABLES: dict[str, list[Callable[[], object]]] = {}


def owned(owner: str, empty: Callable[[], object]) -> None:
    """Registers how to empty a table of an operator."""
    _TABLES.setdefault(owner, []).append(empty)


def claim(owner: str) -> None:
    """Empties the tables of all other operators and gives their memory back: a worker that goes on to another one doesn't keep them."""
    others = [o for o in _TABLES if o != owner]
    for other in others:
        for empty in _TABLES.pop(other):
            empty()
    if others:
        give_back()


class Memo(dict):
    """A table from chunks to values that is emptied when it is full, so its memory is bounded; long chunks aren't kept."""

    def __init__(self, make: Callable[[str], object], limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, chunk: str):
        value = self.make(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = value
        return value


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, owner: str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of at most BATCH_ROWS rows and about BATCH_BYTES, in workers that keep only the owner's tables.

    Spark reads both sizes from the session when the result runs, so they are set there and stay so.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def owning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        yield from run(batches)

    return df.mapInArrow(owning, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def free_name(wanted: str, taken: list[str]) -> str:
    """`wanted`, or with underscores before it until no column of `taken` has that name (Spark ignores case)."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names (new=old); all others are left out, so clashing names do no harm."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


#: Of a 64-bit hash, the bits that make a number from 0.
MASK = (1 << 63) - 1


def below(wanted: int, total: int) -> int:
    """A bound that some more than `wanted` of `total` rows' hashes (from 0 to MASK) are expected to lie below; all, where there are few."""
    share = (wanted + 6 * wanted**0.5 + 20) / max(total, 1)
    return MASK if share >= 1 else int(MASK * share)


_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(ddl: str) -> list[T.StructField]:
    """Nullable fields of simple types, without a session."""
    return [T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(","))]
