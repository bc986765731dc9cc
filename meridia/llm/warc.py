"""WARC archives, written with revisit records for equal payloads and read as a table of chunks.

Each record is a gzip member of its own. A response holds an HTTP header and the payload; a revisit holds the HTTP
header alone and names the response that has the same payload. The reader streams: it holds one chunk of a payload
at a time and carries its SHA-1 and length on from chunk to chunk, so a record of any size needs no more memory.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import mapped, only, slices

#: Payload bytes of a chunk.
CHUNK = 1 << 18
#: Shortest payload that is worth a revisit record.
REVISIT_BYTES = 1000
#: Parts over which the rows of a repeated payload are spread when they look up their response.
SALTS = 16

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long, revisit boolean"
_CHUNKS = "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, chunk binary, bytes_so_far long, digest_so_far string, last boolean, payload_bytes long, payload_digest string"


def records(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """A row for each row of `pages`, with its payload in UTF-8, its digest, and the response that it revisits if any.

    Null payloads count as empty. Of the rows with equal payloads (by length and SHA-1) of at least `least` bytes, those
    with the largest key are responses and the others revisit it; rows with a null key are revisits if any other has a
    key. All shorter payloads are responses. `named` marks the records of a payload whose response is a single row, which revisits can
    name by its record id; where rows that repeat have the largest key, all of them are responses, and revisits name them by
    key and digest. Other columns are left out.
    """
    body = F.coalesce(F.encode(F.col("payload"), "UTF-8"), F.lit(b""))
    rows = only(pages, page_id=key, url=url, payload=payload).select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    # Repeated payloads only, a row each: partial sums before the shuffle keep a hot payload small.
    long = rows.where(F.col("payload_bytes") >= least).groupBy("payload_bytes", "payload_digest", "page_id").agg(F.count("*").alias("copies"))
    repeated = long.groupBy("payload_bytes", "payload_digest").agg(F.max("page_id").alias("first"), F.max_by("copies", "page_id").alias("copies"), F.sum("copies").alias("n")).where("n > 1 and first is not null").drop("n")
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Short payloads revisit nothing: they are dealt by their key, not by their few digests.
    salt = F.when(F.col("payload_bytes") >= least, F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).otherwise(-1 - F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)).cast("int"))
    joined = rows.withColumn("salt", salt).join(salted, ["payload_bytes", "payload_digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"), (F.coalesce(F.col("copies") == 1, F.lit(False)) & F.col("first").isNotNull()).alias("named"))


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"


def _head(r: dict, own: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if r['revisit'] else 'response'}", f"WARC-Record-ID: {_record_id(own)}", "WARC-Date: 2020-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-X-Payload-Length: {r['payload_bytes']}"]
    if r["url"] is not None:
        lines.append("WARC-Target-URI: " + r["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if r["page_id"] is not None:
        lines.append(f"WARC-X-Key: {r['page_id']}")
    if r["revisit"]:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-X-Refers-To-Key: {r['refers_to']}"]
        if r["named"]:
            lines.append(f"WARC-Refers-To: {_record_id(f"{r['refers_to']}/{r['payload_digest']}")}")
    lines.append(f"Content-Length: {len(http) + (0 if r['revisit'] else r['payload_bytes'])}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write(found: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Writes the rows of records() as one archive a partition, and returns the table of archives (path, n_records).

    A task writes under a name of its own and renames in the end, so that it can run again. A single response that others revisit
    has a record id made of its key and digest; all other records, among them responses that are repeated rows, have ids
    made of the archive's name and their place in it, so a record id is never given twice, in whatever archives rows are. An empty table gives no
    archive; rows of null keys or urls have no such field.
    """
    spark = found.sparkSession
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, n, out = uuid.uuid4().hex, 0, None
        for b in slices(batches):
            out = out or fs.open_output_stream(f"{root}/.{name}")
            for r in b.to_pylist():
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                own = f"{r['page_id']}/{r['payload_digest']}" if r["named"] and not r["revisit"] else f"{name}/{n}"
                out.write(member.compress(_head(r, own)))
                body = memoryview(b"" if r["revisit"] else r["payload"])
                for at in range(0, len(body), CHUNK):
                    out.write(member.compress(body[at : at + CHUNK]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                n += 1
        if out is not None:
            out.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}.warc.gz")
            yield pa.RecordBatch.from_pydict({"path": [f"{name}.warc.gz"], "n_records": pa.array([n], pa.int64())})

    # The table of archives names one file for each partition, whatever attempts left behind.
    mapped(found, run, "path string, n_records long", __name__).write.mode("overwrite").parquet(f"{folder}/archives.parquet")
    return spark.read.schema("path string, n_records long").parquet(f"{folder}/archives.parquet")


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        k, _, v = line.partition(b":")
        found[k.decode().lower()] = v.strip().decode()
    return found


def stream_chunks(raw: io.RawIOBase, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunks of an archive's records, in order; each record has at least one, its last one marked.

    Raises ValueError on a broken archive or a payload that differs from its digest.
    """
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), CHUNK)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _fields(stream)
        left = int(head["content-length"])
        at = int(head.get("warc-x-key", 0)) if "warc-x-key" in head else None
        kind, own = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
        if left and head.get("content-type", "").startswith("application/http"):
            while left:
                line = stream.readline()
                left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break
        sha, n, k = hashlib.sha1(), 0, 0
        base = {"record_id": head["warc-record-id"], "page_id": at, "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": int(x) if (x := head.get("warc-x-refers-to-key")) else None}
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError(f"{base['record_id']}: the archive ends within the record")
            left -= len(data)
            sha.update(data)
            n += len(data)
            last = not left
            if last and kind != "revisit" and own and sha.hexdigest() != own:
                raise ValueError(f"{base['record_id']}: the payload differs from its digest")
            yield base | {"chunk_no": k, "chunk": data, "bytes_so_far": n, "digest_so_far": sha.hexdigest(), "last": last, "payload_bytes": (int(head["warc-x-payload-length"]) if kind == "revisit" else n) if last else None, "payload_digest": (own if kind == "revisit" else sha.hexdigest()) if last else None}
            k += 1
            if last:
                break


def read(spark: SparkSession, folder: str, chunk: int = CHUNK, with_payload: bool = True) -> DataFrame:
    """A row for each chunk of each record: record, chunk number, bytes, and length and SHA-1 so far.

    The row of the last chunk has payload_bytes and payload_digest of the full payload (of a revisit: the payload that
    it stands for). Without `with_payload` the bytes are left out. Archives are read in parallel, a file a task at least.
    """
    parts = spark.read.schema("path string, n_records long").parquet(f"{folder}/archives.parquet")
    kind = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    for c in stream_chunks(raw, chunk):
                        held.append(c if with_payload else c | {"chunk": None})
                        size += len(c["chunk"]) if with_payload else 100
                        if size >= 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(held, kind)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    return mapped(parts.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path"), run, _CHUNKS, __name__)
