"""TIFF as media columns: bytes stored as grey pages, and TIFF files read as a row for each page.

The reader walks the image directories and decodes PackBits, LZW or deflate strips and tiles, undoes the horizontal
predictor, and gives the samples of one page at a time. It reads samples of 1, 2, 4, 8 and 16 bits, in pixels or in planes;
other kinds, and pages of more than PAGE_BYTES samples, are errors of their row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import fields, mapped, only, slices

#: Fixed values of the TIFF format: compression codes and sizes of the field types.
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
_OLD_DEFLATE = 32946
_TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_TYPE_CODES = {1: "B", 3: "H", 4: "I"}

#: Payloads are padded with PAD to a positive multiple of WIDTH, a row of samples.
WIDTH, PAD = 576, 255
PAGE_ROWS, STRIP_ROWS = 256, 64
#: Largest page that is decoded, in bytes of samples, and most pages of a file.
PAGE_BYTES, FILE_PAGES = 1 << 28, 1 << 16


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of 3 bytes or more are packed, the rest are literals."""
    out, at, n = bytearray(), 0, len(data)
    literal = bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while at < n:
        run = 1
        while at + run < n and run < 128 and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            flush()
            out += bytes((257 - run, data[at]))
        else:
            literal += data[at : at + run]
        at += run
    flush()
    return bytes(out)


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """The bytes of a PackBits stream, or the first `most` and a few more."""
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        k = data[at]
        if k < 128:
            out += data[at + 1 : at + 2 + k]
            at += 2 + k
        else:
            if k > 128:
                out += data[at + 1 : at + 2] * (257 - k)
            at += 1 + (k > 128)
    return bytes(out)


_CLEAR, _END = 256, 257


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes grow one early."""
    out, acc, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    table = {bytes([i]): i for i in range(256)}
    free, word = 258, b""
    put(_CLEAR)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = free
        free += 1
        if free == 1 << width and width < 12:
            width += 1
        elif free == 4094:
            put(_CLEAR)
            table, free, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = data[k : k + 1]
    if word:
        put(table[word])
        free += 1
        if free == 1 << width and width < 12:
            width += 1
    put(_END)
    if bits:
        out.append(acc << 8 - bits & 255)
    return bytes(out)


def unlzw(data: bytes, most: int | None = None) -> bytes:
    """The bytes of a stream of lzw(), or the first `most` and a few more."""
    out, acc, bits, width = bytearray(), 0, 0, 9
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last = list(start), b""
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = acc >> bits
            acc &= (1 << bits) - 1
            if code == _END:
                return bytes(out)
            if code == _CLEAR:
                table, width, last = list(start), 9, b""
                continue
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("broken LZW data")
            out += entry
            if most is not None and len(out) >= most:
                return bytes(out)
            if last:
                table.append(last + entry[:1])
            last = entry
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return bytes(out)


def _squeeze(data: bytes, compression: str) -> bytes:
    return {"none": bytes, "lzw": lzw, "packbits": pack_bits, "deflate": lambda d: zlib.compress(d, 1)}[compression](data)


def _expand(data: bytes, code: int, need: int) -> bytes:
    """The first `need` bytes at least; what follows them isn't expanded."""
    if code in (CODES["deflate"], _OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, need))
    decode = {CODES["none"]: lambda d, _: d, CODES["lzw"]: unlzw, CODES["packbits"]: unpack_bits}.get(code)
    if decode is None:
        raise ValueError(f"compression {code} isn't supported")
    return decode(data, need)


def _samples(data: bytes, rows: int, across: int, bits: int, kind: np.dtype) -> np.ndarray:
    """Rows of `across` samples; those of less than 8 bits are packed, each row from a new byte."""
    if bits >= 8:
        return np.frombuffer(data, kind, rows * across).reshape(rows, across)
    packed = np.frombuffer(data, np.uint8, rows * -(-across * bits // 8)).reshape(rows, -1)
    single = np.unpackbits(packed, axis=1).reshape(rows, -1, bits)
    return (single @ (1 << np.arange(bits)[::-1])).astype(kind)[:, :across]


def encode(samples: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, compression: str = "deflate", predictor: int = 2) -> bytes:
    """A TIFF of grey 8-bit pages that hold the samples, rows of `width`, in order. Their number must be a positive multiple of `width`."""
    if not samples or len(samples) % width:
        raise ValueError(f"the samples must fill rows of {width}")
    grid = np.frombuffer(samples, np.uint8).reshape(-1, width)
    if predictor == 2:
        grid = np.concatenate([grid[:, :1], np.diff(grid, axis=1)], axis=1)
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for top in range(0, len(grid), page_rows):
        page = grid[top : top + page_rows]
        strips = [_squeeze(page[k : k + strip_rows].tobytes(), compression) for k in range(0, len(page), strip_rows)]
        starts = []
        for s in strips:
            starts.append(len(out))
            out += s
        out += b"\0" * (len(out) % 2)
        many = len(strips) > 1
        lists = len(out)
        if many:
            out += struct.pack(f"<{2 * len(strips)}I", *starts, *map(len, strips))
        entries = [(256, 4, 1, width), (257, 4, 1, len(page)), (258, 3, 1, 8), (259, 3, 1, CODES[compression]), (262, 3, 1, 1), (273, 4, len(strips), lists if many else starts[0]), (277, 3, 1, 1), (278, 4, 1, strip_rows), (279, 4, len(strips), lists + 4 * len(strips) if many else len(strips[0])), (284, 3, 1, 1), (317, 3, 1, predictor)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries))
        for tag, kind, n, value in entries:
            out += struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or len(seen) >= FILE_PAGES:
            raise ValueError("the image directories form a loop, or are too many")
        seen.add(at)
        tags: dict[int, list[int]] = {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in _TYPE_CODES:
                where = at + 10 + 12 * k
                if count * _TYPE_BYTES[kind] > len(data):
                    raise ValueError("a field is longer than the file")
                if count * _TYPE_BYTES[kind] > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = list(struct.unpack_from(f"{order}{count}{_TYPE_CODES[kind]}", data, where))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def pages(data: bytes) -> Iterator[tuple[dict[str, int], bytes]]:
    """Facts and samples (rows, then pixels, then channels; 16-bit ones little-endian) of each page, one at a time."""
    for order, tags in _directories(data):
        one = lambda tag, default: tags.get(tag, [default])[0]
        width, height, spp, code, predictor = one(256, 0), one(257, 0), one(277, 1), one(259, 1), one(317, 1)
        bits, planar = one(258, 1), one(284, 1)
        if bits not in (1, 2, 4, 8, 16) or len({*tags.get(258, [bits])}) > 1 or planar not in (1, 2) or predictor not in ((1, 2) if bits >= 8 else (1,)):
            raise ValueError(f"{tags.get(258, [bits])} bits, planar {planar}, predictor {predictor}: not supported")
        kind = np.dtype(np.uint8 if bits <= 8 else order + "u2")
        if width * height * spp * kind.itemsize > PAGE_BYTES:
            raise ValueError(f"{width} x {height} x {spp} samples are more than a page may have")
        tiled = 322 in tags
        w, h = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
        starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        across, down = -(-width // w), -(-height // h)
        if w * h * spp * kind.itemsize > PAGE_BYTES:
            raise ValueError(f"{w} x {h} samples are more than a tile may have")
        channels = 1 if planar == 2 else spp  # of a strip or tile
        grid = np.zeros((height, width, spp), kind.newbyteorder("<"))
        for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
            plane, k = divmod(k, across * down)
            y, x = k // across * h, k % across * w
            rows = h if tiled else min(h, height - y)
            raw = _expand(data[start : start + size], code, rows * -(-w * channels * bits // 8))
            block = _samples(raw, rows, w * channels, bits, kind).reshape(rows, w, channels)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            part = grid[y : y + rows, x : x + w, plane : plane + channels]
            part[:] = block[: part.shape[0], : part.shape[1]]
        yield {"width": width, "height": height, "channels": spp, "bits": bits, "compression": code, "predictor": predictor}, grid.tobytes()


def store(docs: DataFrame, text: str = "text", media: str = "media", size: str = "n_bytes", compression: str | None = "deflate", predictor: int = 2) -> DataFrame:
    """All columns of `docs`, `size` (UTF-8 bytes of the text) and `media`: its bytes, padded, as a TIFF.

    Null texts count as empty; those are one row of padding. Equal texts give equal bytes. Repeated rows stay, an empty
    table gives no rows. Columns called as the new ones are replaced. Without a `compression`, the CRC-32 of the bytes picks
    one for each row: LZW or PackBits for 1 of 16 each, else deflate.
    """
    keep = docs.drop(media, size)
    schema = T.StructType([*keep.schema.fields, T.StructField(size, T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [(x or "").encode() for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            kinds = [compression or {0: "lzw", 1: "packbits"}.get(zlib.crc32(x) % 16, "deflate") for x in raw]
            made = [encode(x.ljust(max(1, -(-len(x) // WIDTH)) * WIDTH, bytes([PAD])), compression=c, predictor=predictor) for x, c in zip(raw, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in raw], pa.int64()), pa.array(made, pa.binary())], names=[*b.schema.names, size, media])

    return mapped(keep, run, schema, __name__)


_PAGE = fields("media_bytes long, media_sha256 string, page int, n_pages int, width int, height int, channels int, bits int, compression int, predictor int, pixels binary, error string")
_PAGE_ARROW = [("media_bytes", pa.int64()), ("media_sha256", pa.string()), *((n, pa.int32()) for n in ("page", "n_pages", "width", "height", "channels", "bits", "compression", "predictor")), ("pixels", pa.binary()), ("error", pa.string())]


def explode_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each page of the TIFF in `media`, with all other columns of `df`; the pages of a row stay together, in order.

    A null gives no row. A file that can't be read, or whose pages are larger than PAGE_BYTES, gives one row with `error`
    set and null pixels. Repeated rows give repeated pages, an empty table none. Columns of `df` called as one of the new
    ones are replaced.
    """
    others = [c for c in df.columns if c.lower() != media.lower() and c.lower() not in {n for n, _ in _PAGE_ARROW}]
    keep = df.select(*others, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            rows, at = [], []
            for i, data in enumerate(b.column(len(others)).to_pylist()):
                if data is None:
                    continue
                base, own = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}, []
                try:
                    for facts, pixels in pages(data):
                        own.append(base | facts | {"page": len(own), "pixels": pixels, "error": None})
                except (ValueError, struct.error, zlib.error, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError) as e:
                    own = [base | {"page": 0, "error": f"{type(e).__name__}: {e}"[:200]}]
                rows += [r | {"n_pages": len(own)} for r in own]
                at += [i] * len(own)
            columns = [c.take(pa.array(at, pa.int64())) for c in b.columns[: len(others)]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r.get(n) for r in rows], k) for n, k in _PAGE_ARROW)], names=[*others, *(n for n, _ in _PAGE_ARROW)])

    return mapped(keep, run, T.StructType([*keep.schema.fields[: len(others)], *_PAGE]), __name__)


def fold_pages(found: DataFrame) -> DataFrame:
    """The digest of each document's pages, in one pass over the rows of explode_pages() as they come.

    payload_sha256 and tail_crc32 (the last 32 bytes) are of the samples of all pages in order, and `feature` tells of
    them: pages, mean and deviation in hundredths, and a histogram of 16 bins in parts of 1000.
    """
    thin = found.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "n_pages", "pixels", "error")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hist = tail = None
        total = 0
        for b in batches:
            rows = []
            for doc, n, media_n, media_sha, page, n_pages, pixels, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if error is not None:
                    raise ValueError(f"document {doc}: {error}")
                if page == 0:
                    sha, hist, tail, total = hashlib.sha256(), np.zeros(256, np.int64), b"", 0
                sha.update(pixels)
                hist += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                total += len(pixels)
                tail = (tail + pixels)[-32:] if len(pixels) < 32 else pixels[-32:]
                if page == n_pages - 1:
                    s1, s2 = int(hist @ np.arange(256)), int(hist @ np.arange(256) ** 2)
                    spread = round(100 * (max(0, s2 / total - (s1 / total) ** 2)) ** 0.5)
                    bins = ",".join(str(1000 * int(x) // total) for x in hist.reshape(16, 16).sum(1))
                    rows.append((doc, n, total, sha.hexdigest(), zlib.crc32(tail), media_n, media_sha, f"pages={n_pages};mean={round(100 * s1 / total)};spread={spread};bins={bins}"))
            if rows:
                kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = T.StructType([thin.schema["doc_id"], *fields("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")])
    return mapped(thin, run, schema, __name__)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", compression: str | None = "deflate") -> DataFrame:
    """store(), explode_pages() and fold_pages() one after the other; no shuffle."""
    return fold_pages(explode_pages(store(only(docs, doc_id=doc_id, text=text), compression=compression).select("doc_id", "n_bytes", "media")))
