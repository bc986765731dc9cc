"""Transverse Mercator both ways, and the plane coordinates of a .prj text as longitude and latitude."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: A place in the plane or on the globe: arrays of x (or longitude) and y (or latitude).
Places = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class TransverseMercator:
    """A projection on an ellipsoid (axis a in metres, flattening f) around a meridian, by Krüger's series in the third flattening.

    Within some 4,000 km of the meridian both ways are exact to less than a micrometre.
    """

    meridian: float
    latitude: float = 0.0
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 0.0
    a: float = 6378137.0
    f: float = 1 / 298.257223563

    @property
    def _n(self) -> float:
        return self.f / (2 - self.f)

    @property
    def _radius(self) -> float:
        n2 = self._n**2
        return self.a / (1 + self._n) * (1 + n2 / 4 + n2**2 / 64 + n2**3 / 256)

    @property
    def _to(self) -> list[float]:
        n = self._n
        return [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630,
            61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880,
            49561 * n**4 / 161280 - 179 * n**5 / 168,
            34729 * n**5 / 80640,
        ]

    def _conformal(self, lat: np.ndarray) -> np.ndarray:
        """The tangent of the conformal latitude."""
        e = math.sqrt(self.f * (2 - self.f))
        s = np.sin(lat)
        return np.sinh(np.arctanh(s) - e * np.arctanh(e * s))

    def _plane(self, lat: np.ndarray, lon: np.ndarray) -> Places:
        t = self._conformal(lat)
        xi, eta = np.arctan2(t, np.cos(lon)), np.arcsinh(np.sin(lon) / np.hypot(t, np.cos(lon)))
        return (
            eta + sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(self._to, 1)),
            xi + sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(self._to, 1)),
        )

    def forward(self, lon: np.ndarray, lat: np.ndarray) -> Places:
        x, y = self._plane(np.radians(lat), np.radians(np.asarray(lon, float) - self.meridian))
        _, y0 = self._plane(np.radians(np.float64(self.latitude)), np.float64(0))
        return self.easting + self.scale * self._radius * x, self.northing + self.scale * self._radius * (y - y0)

    def inverse(self, x: np.ndarray, y: np.ndarray) -> Places:
        """Longitude and latitude: the series is turned around by steps of Newton's kind, and so is the conformal latitude."""
        _, y0 = self._plane(np.radians(np.float64(self.latitude)), np.float64(0))
        to_eta = (np.asarray(x, float) - self.easting) / (self.scale * self._radius)
        to_xi = (np.asarray(y, float) - self.northing) / (self.scale * self._radius) + y0
        z, goal = to_xi + 1j * to_eta, to_xi + 1j * to_eta
        for _ in range(6):  # the series is that of the complex sine
            value = z + sum(c * np.sin(2 * j * z) for j, c in enumerate(self._to, 1))
            slope = 1 + sum(2 * j * c * np.cos(2 * j * z) for j, c in enumerate(self._to, 1))
            z = z - (value - goal) / slope
        xi, eta = z.real, z.imag
        wanted = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))
        lon = np.arctan2(np.sinh(eta), np.cos(xi))
        e2 = self.f * (2 - self.f)
        tan = wanted / (1 - e2)
        for _ in range(6):
            t = self._conformal(np.arctan(tan))
            tan = tan + (wanted - t) / np.hypot(1, t) * (1 + (1 - e2) * tan**2) / ((1 - e2) * np.hypot(1, tan))
        return (np.degrees(lon) + self.meridian + 180) % 360 - 180, np.degrees(np.arctan(tan))


def utm(zone: int, south: bool = False) -> TransverseMercator:
    return TransverseMercator(6 * zone - 183, northing=10_000_000.0 if south else 0.0)


def to_degrees(prj: str | None) -> Callable[[np.ndarray, np.ndarray], Places]:
    """From the coordinates that a .prj text describes to longitude and latitude of its own datum (none is shifted).

    Without a text, and for a geographic system, they are degrees already. ValueError names any projection but the
    transverse Mercator and the Mercator on the sphere.
    """
    if not prj or prj.strip().upper().startswith("GEOGCS"):
        return lambda x, y: (x, y)
    kind = re.search(r'PROJECTION\s*\[\s*"([^"]+)"', prj)
    own = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\s*\[\s*"([^"]+)"\s*,\s*([-+.\deE]+)', prj)}
    ball = re.search(r'SPHEROID\s*\[\s*"[^"]*"\s*,\s*([-+.\deE]+)\s*,\s*([-+.\deE]+)', prj)
    a, turned = (float(ball[1]), float(ball[2])) if ball else (6378137.0, 298.257223563)
    units = re.findall(r'UNIT\s*\[\s*"[^"]*"\s*,\s*([-+.\deE]+)', prj)
    unit = float(units[-1]) if units else 1.0  # the last is that of the plane
    name = kind[1].lower() if kind else ""
    if name == "transverse_mercator":
        tm = TransverseMercator(own.get("central_meridian", 0.0), own.get("latitude_of_origin", 0.0), own.get("scale_factor", 1.0), own.get("false_easting", 0.0) * unit, own.get("false_northing", 0.0) * unit, a, 1 / turned if turned else 0.0)
        return lambda x, y: tm.inverse(np.asarray(x) * unit, np.asarray(y) * unit)
    if name in ("mercator_auxiliary_sphere", "popular_visualisation_pseudo_mercator"):
        return lambda x, y: (np.degrees((np.asarray(x) * unit - own.get("false_easting", 0.0)) / a) + own.get("central_meridian", 0.0), np.degrees(np.arctan(np.sinh((np.asarray(y) * unit - own.get("false_northing", 0.0)) / a))))
    raise ValueError(f"the projection {kind[1] if kind else prj[:40]!r} isn't known")
