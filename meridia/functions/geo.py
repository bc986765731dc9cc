"""Column expressions on coordinates in degrees and on distances in kilometres. All stay in whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radii of the sphere, in km: for errors, and the mean earth radius that is used between centroids.
EARTH_KM = 6371.0
MEAN_EARTH_KM = 6371.009


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; null if any coordinate is null."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * radius)


def scaled(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude scaled from the ranges of the globe to 0..1."""
    return (lon + 180.0) / 360.0, (lat + 90.0) / 180.0


def unscaled(x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse of scaled()."""
    return x * 360.0 - 180.0, y * 180.0 - 90.0


def on_globe(lon: Column, lat: Column) -> Column:
    """Whether both coordinates are there and in range."""
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def zero_floor(d: Column, genetic: bool) -> Column:
    """Distances close to zero become 1e-6 (genetic) or 1e-8 (geographic)."""
    return F.when(F.abs(d) <= 1e-8, F.lit(1e-6 if genetic else 1e-8)).otherwise(d)


def inverse_distance(d: Column, power: float) -> Column:
    """Weight of a neighbour."""
    return 1.0 / F.pow(d + 1e-8, F.lit(float(power)))


def next_hundred(x: Column) -> Column:
    return F.ceil(x / 100) * 100


def p_label(p: Column) -> Column:
    return F.when(p < 0.0001, "< 0.0001").when(p < 0.001, "< 0.001").otherwise(F.concat(F.lit("= "), F.format_string("%.3f", p)))


def in_boxes(lon: Column, lat: Column, boxes: list[tuple[float, float, float, float]]) -> Column:
    """In how many of the boxes (lon_min, lon_max, lat_min, lat_max) a point lies, edges included."""
    hits = [F.coalesce((lon.between(a, b) & lat.between(c, d)).cast("int"), F.lit(0)) for a, b, c, d in boxes]
    return reduce(lambda x, y: x + y, hits, F.lit(0))


def in_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in the polygon of the ring, by counting crossings of a ray; points within 1e-9 of its border do."""
    crossings, border = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        if length:
            away = F.abs((lat - y1) * (x2 - x1) - (lon - x1) * (y2 - y1)) / length
            along = ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / length
            border = border | ((away <= 1e-9) & along.between(-1e-9, length + 1e-9))
        if y1 != y2:
            low, high = min(y1, y2), max(y1, y2)
            crossings = crossings + ((lat >= low) & (lat < high) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)).cast("int")
    return border | (crossings % 2 == 1)


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))
