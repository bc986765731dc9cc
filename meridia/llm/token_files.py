"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A data set is a folder of shards in ascending order of document id. Shard k has three flat little-endian files:

* ids-k.bin: the token ids of its documents, one after the other, 16 bits wide where the vocabulary allows, else 32;
* offsets-k.bin: signed 64-bit, rows + 1 positions in ids-k.bin, in tokens, the first 0;
* keys-k.bin: signed 64-bit document ids. Rows with a null id come first; the manifest counts them.

manifest.parquet has a row for each shard: its rows, tokens, null ids, and its base: the tokens of all shards before
it, a prefix sum. A global position is base + offset. Readers map the files into memory where the folder is mounted,
and else read the ranges that they need.

A shard's task writes under a name of its own and then renames, so a task that runs again after a lost executor
replaces its files by equal ones; nothing is kept on a machine's own disk.
"""

from __future__ import annotations

import functools
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import NORMALIZER
from .textkit import chunks, mapped, Memo, only, owned, slices, word_and_signs

#: Words whose ids a worker keeps, some 150 MB.
WORDS = 600_000
#: Bytes of text that a shard holds, about.
SHARD_BYTES = 16_000_000
#: The parts that a text is split into, each for itself, by files of the kind that is read here.
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
MANIFEST = "shard int, dtype string, n_rows long, n_tokens long, n_null_ids long"


@functools.lru_cache(2)
def _tokenizer(path: str) -> Memo:
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    model = library.model
    encode = lambda x: np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    plain = lambda x: np.array([t.id for t in model.tokenize(x)], "<u4").tobytes() if x.isascii() and x.isalpha() else encode(x)
    words = Memo(plain, WORDS)  # ASCII letters are their own byte symbols: the library's model takes them as they are

    def chunk_bytes(chunk: str) -> bytes:
        parts = word_and_signs(chunk)
        return encode(chunk) if parts is None else words[parts[0]] + words[parts[1]] if parts[1] else words[parts[0]]

    owned(__name__, _tokenizer.cache_clear)
    return Memo(chunk_bytes, 400_000)


def token_bytes(path: str, text: str | None) -> bytes:
    """The library's ids of `text`, as little-endian 32-bit integers; null counts as empty.

    The library is asked for each chunk between white space, for plain words and the signs after them one by one, and
    the answers are kept: a vocabulary of this kind drops white space and splits words from signs, so the ids of a text
    are those of its parts.
    """
    return b"".join(map(_tokenizer(path).__getitem__, chunks(text))) if text else b""


def _check_kind(path: str) -> int:
    """The number of ids; raises ValueError if texts can't be encoded by their words, signs apart, in lower case.

    The file's own parts say so: its normaliser lowers letters, its pre-tokenizer drops white space and splits letters from
    signs, and no added token holds white space or is found in normalised text.
    """
    spec = json.load(open(path, encoding="utf-8"))
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    apart = spec["normalizer"] == NORMALIZER and len(splits) == 2 and splits[0] == _SPLIT and splits[1]["type"] == "ByteLevel" and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
    added = any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].isascii() or any(x.isspace() for x in t["content"]) or t["content"][:1].isalnum() for t in spec["added_tokens"])
    if not apart or added or spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or spec["post_processor"]:
        raise ValueError(f"{path}: its texts can't be encoded by words: normaliser, pre-tokenizer, added tokens or model are of another kind")
    return Tokenizer.from_file(path).get_vocab_size()


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Writes under another name first, so that no reader ever sees a part of a file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, path)


def write(docs: DataFrame, path: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes the whole texts of `docs`, appends `end_id` to each, writes the files and returns the manifest.

    Null and empty texts have just the end id. Repeated document ids stay as rows of their own, in order of their text.
    An empty table makes a data set without tokens. Other columns are left out. Unless `shards` says how many, there are as
    many as SHARD_BYTES of text each need, so a shard doesn't grow with the data.
    """
    spark = docs.sparkSession
    dtype = "<u2" if max(_check_kind(path), end_id + 1) <= 1 << 16 else "<u4"
    shards = shards or 1 + (only(docs, text=text).agg(F.sum(F.octet_length("text"))).head()[0] or 0) // SHARD_BYTES
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    thin = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    thin = thin.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        end, shard, own = np.array([end_id], "<u4").tobytes(), None, uuid.uuid4().hex
        keys, ends, nulls, total, out = io.BytesIO(), [0], 0, 0, None
        for b in slices(batches):
            if out is None:
                shard = b.column(2)[0].as_py()
                out = fs.open_output_stream(f"{root}/.ids-{shard}-{own}")
            for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(token_bytes(path, x) + end, "<u4")
                out.write(ids.astype(dtype).tobytes())
                total += len(ids)
                ends.append(total)
                nulls += key is None
                keys.write((key or 0).to_bytes(8, "little", signed=True))
        if out is None:
            return
        out.close()
        fs.move(f"{root}/.ids-{shard}-{own}", f"{root}/ids-{shard}.bin")
        _put(fs, f"{root}/offsets-{shard}.bin", np.array(ends, "<i8").tobytes())
        _put(fs, f"{root}/keys-{shard}.bin", keys.getvalue())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "dtype": [dtype], "n_rows": [len(ends) - 1], "n_tokens": [total], "n_null_ids": [nulls]})

    # One small row for each shard, kept as a table: the prefix sums need no driver and the files are written once.
    mapped(thin, run, MANIFEST, __name__).write.mode("overwrite").parquet(f"{folder}/shards.parquet")
    parts = spark.read.schema(MANIFEST).parquet(f"{folder}/shards.parquet")
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts.withColumn("base", base).write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, base long").parquet(f"{folder}/manifest.parquet")


class _Flat:
    """A flat file of numbers: mapped into memory where the folder is mounted, else read by ranges."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str):
        self.dtype, self.map, self.file = np.dtype(dtype), None, None
        if not isinstance(fs, pafs.LocalFileSystem):
            self.file = fs.open_input_file(path)
        elif fs.get_file_info(path).size:
            self.map = np.memmap(path, dtype, "r")

    def __getitem__(self, of: slice) -> np.ndarray:
        if self.file is not None:
            w = self.dtype.itemsize
            return np.frombuffer(self.file.read_at((of.stop - of.start) * w, of.start * w), self.dtype)
        return np.zeros(0, self.dtype) if self.map is None else self.map[of]


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (the tokens of all documents before it), n_tokens, ids_crc32 and, if asked, ids.

    A data set of an empty table gives no rows; repeated and null document ids come back as they were written. ids_crc32 is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers, whatever the file's width.
    """
    parts = manifest(spark, folder)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for s in b.to_pylist():
                ids, ends, names = (_Flat(fs, f"{root}/{name}-{s['shard']}.bin", kind) for name, kind in (("ids", s["dtype"]), ("offsets", "<i8"), ("keys", "<i8")))
                for i in range(0, s["n_rows"], 256):
                    to = min(i + 256, s["n_rows"])
                    at, keys = ends[i : to + 1], names[i:to]
                    block = ids[int(at[0]) : int(at[-1])].astype("<u4")
                    own = [block[x - at[0] : y - at[0]] for x, y in zip(at[:-1], at[1:], strict=True)]
                    cols = {
                        "doc_id": pa.array([None if k < s["n_null_ids"] else int(keys[k - i]) for k in range(i, to)], pa.int64()),
                        "start": pa.array(at[:-1] + s["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    return mapped(parts.repartition(n, "shard"), run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids, __name__)
