"""Shapefiles in zip archives: polygons with their attributes, in degrees.

An archive holds any number of .shp files with a .dbf of attributes and a .prj of the coordinate system each; Spark reads
archives as binary files, one a task, so maps in many archives are read in parallel and from any store.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.projections import to_degrees

# Fixed values of the format.
MAGIC, VERSION, HEADER = 9994, 1000, 100
POLYGONS = {5, 15, 25}  # plain, with heights, with measures: all begin alike

_RING = "array<struct<x: double, y: double>>"
SCHEMA = f"layer string, record long, attributes map<string, string>, part int, ring {_RING}, holes array<{_RING}>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ARROW = pa.schema([("layer", pa.string()), ("record", pa.int64()), ("attributes", pa.map_(pa.string(), pa.string())), ("part", pa.int32()), ("ring", pa.list_(_POINT)), ("holes", pa.list_(pa.list_(_POINT)))])


def shapes(data: bytes) -> Iterator[list[np.ndarray]]:
    """For each record its rings as n x 2 coordinates; none where it isn't a polygon."""
    if len(data) < HEADER or struct.unpack_from(">i", data)[0] != MAGIC:
        raise ValueError("not a .shp file")
    at, end = HEADER, min(len(data), 2 * struct.unpack_from(">i", data, 24)[0])
    while at + 8 <= end:
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        kind = struct.unpack_from("<i", data, at + 8)[0]
        rings: list[np.ndarray] = []
        if kind in POLYGONS:
            parts, points = struct.unpack_from("<2i", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
            xy = np.frombuffer(data, "<f8", 2 * points, at + 52 + 4 * parts).reshape(-1, 2)
            rings = [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        yield rings
        at += 8 + size


def attributes(data: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """For each record of a .dbf its fields as text without padding; empty ones are null."""
    rows, start, width = struct.unpack_from("<IHH", data, 4)
    names, sizes, at = [], [], 32
    while data[at] != 0x0D:
        names.append(data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"))
        sizes.append(data[at + 16])
        at += 32
    for k in range(rows):
        at, found = start + k * width + 1, {}
        for name, size in zip(names, sizes, strict=True):
            found[name] = data[at : at + size].strip(b" \0").decode(encoding, "replace") or None
            at += size
        yield found


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def _inside(ring: np.ndarray, place: np.ndarray) -> bool:
    (x, y), (u, v) = ring[:-1].T, ring[1:].T
    over = (y > place[1]) != (v > place[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = x + (place[1] - y) * (u - x) / (v - y)
    return bool((over & (place[0] < cut)).sum() % 2)


def parts(rings: list[np.ndarray]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Outer rings (clockwise) with their holes (the other way round); a hole that lies in none is an outer ring."""
    rings = [r for r in rings if len(r) >= 4]
    outer = [(r, []) for r in rings if _area(r) <= 0]
    for r in (r for r in rings if _area(r) > 0):
        around = [o for o in outer if _inside(o[0], r[0])]
        if around:
            min(around, key=lambda o: abs(_area(o[0])))[1].append(r)
        else:
            outer.append((r, []))
    return outer


def _rows(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        by_name = {n.lower(): n for n in z.namelist()}
        for low, name in sorted(by_name.items()):
            if not low.endswith(".shp"):
                continue
            text = lambda kind: z.read(by_name[low[:-4] + kind]) if low[:-4] + kind in by_name else None  # noqa: B023, E731
            prj, table, coding = text(".prj"), text(".dbf"), text(".cpg")
            turn = to_degrees(prj.decode("utf-8", "replace") if prj else None)
            known = attributes(table, (coding or b"utf-8").decode("ascii", "ignore").strip() or "utf-8") if table else iter(())
            point = lambda r: [{"x": float(x), "y": float(y)} for x, y in zip(*turn(r[:, 0], r[:, 1]), strict=True)]  # noqa: B023, E731
            for record, rings in enumerate(shapes(z.read(name))):
                own = next(known, {})
                for k, (ring, holes) in enumerate(parts(rings)):
                    yield {"layer": name[:-4], "record": record, "attributes": list(own.items()), "part": k, "ring": point(ring), "holes": [point(h) for h in holes]}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(layer, record, attributes, part, ring, holes) of the polygons of zip archives, a row for each outer ring, in degrees.

    Coordinates follow the .prj: degrees, transverse Mercator or spherical Mercator; another projection is an error that names
    it. The datum stays as it is. Points and lines give no row. Files of one archive go together by name, whatever their case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                held: list[dict] = []
                for row in _rows(content.as_py()):
                    held.append(row)
                    if len(held) >= 256:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def regions(spark: SparkSession, path: str, fips: str | None = None) -> DataFrame:
    """(statefp, name, part, ring, holes) as files.regions() has them, from zipped shapefiles; `fips` keeps one state."""
    named = lambda key: F.element_at(F.map_filter("attributes", lambda k, _: F.upper(k) == key), F.element_at(F.map_keys(F.map_filter("attributes", lambda k, _: F.upper(k) == key)), 1))
    has = lambda key: F.size(F.map_filter("attributes", lambda k, _: F.upper(k) == key)) > 0
    out = read(spark, path).select(F.when(has("STATEFP"), named("STATEFP")).alias("statefp"), F.when(has("NAME"), named("NAME")).alias("name"), "part", "ring", "holes")
    return out if fips is None else out.where(F.col("statefp") == F.lpad(F.lit(str(fips)), 2, "0"))


def packed(polygons: list[tuple[dict[str, str], list[list[tuple[float, float]]]]], prj: str | None = None, name: str = "map") -> bytes:
    """The zip archive of polygons: attributes, and rings (closed; clockwise ones are outer). For maps that fit into memory."""
    records, box = [], [np.inf, np.inf, -np.inf, -np.inf]
    for _, rings in polygons:
        xy = np.array([p for r in rings for p in r], "<f8").reshape(-1, 2)
        own = [*xy.min(0), *xy.max(0)]
        box = [*np.minimum(box[:2], own[:2]), *np.maximum(box[2:], own[2:])]
        starts = np.cumsum([0, *(len(r) for r in rings)])[:-1]
        records.append(struct.pack("<i4d2i", 5, *own, len(rings), len(xy)) + struct.pack(f"<{len(rings)}i", *starts) + xy.tobytes())
    body = b"".join(struct.pack(">2i", k + 1, len(r) // 2) + r for k, r in enumerate(records))
    head = struct.pack(">7i", MAGIC, 0, 0, 0, 0, 0, (HEADER + len(body)) // 2) + struct.pack("<2i4d4d", VERSION, 5, *(box if records else [0.0] * 4), 0, 0, 0, 0)
    names = sorted({k for a, _ in polygons for k in a})
    sizes = [max([1, *(len((a.get(n) or "").encode()) for a, _ in polygons)]) for n in names]
    fields = b"".join(n.encode("ascii")[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([s]) + bytes(15) for n, s in zip(names, sizes, strict=True))
    table = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(polygons), 32 + len(fields) + 1, 1 + sum(sizes)) + fields + b"\r"
    table += b"".join(b" " + b"".join((a.get(n) or "").encode().ljust(s) for n, s in zip(names, sizes, strict=True)) for a, _ in polygons) + b"\x1a"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for kind, data in ((".shp", head + body), (".dbf", table), (".cpg", b"UTF-8"), *([(".prj", prj.encode())] if prj else [])):
            z.writestr(name + kind, data)
    return out.getvalue()


def write(rows: DataFrame, folder: str, prj: str | None = None) -> DataFrame:
    """Writes (layer, attributes, rings) as a zip archive a layer and returns the table of their paths; a task holds one layer.

    Rings are arrays of (x, y), closed, the outer ones clockwise. Archives are written under another name first.
    """
    import pyarrow.fs as pafs

    def run(key: tuple, t: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        layer = key[0].as_py()
        polygons = [(dict(r["attributes"]), [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]) for r in t.to_pylist()]
        with fs.open_output_stream(f"{root}/.{layer}.zip", compression=None) as out:
            out.write(packed(polygons, prj, layer))
        fs.move(f"{root}/.{layer}.zip", f"{root}/{layer}.zip")
        return pa.table({"path": [f"{folder}/{layer}.zip"]})

    done = rows.select("layer", "attributes", "rings").groupBy("layer").applyInArrow(run, "path string")
    return done.sparkSession.createDataFrame([tuple(r) for r in done.collect()], "path string")  # a row a layer
