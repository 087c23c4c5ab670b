"""Datum shifts: degrees on one ellipsoid to degrees on another, as Column maths.

Degrees become geocentric coordinates, these are shifted, turned and scaled by the seven
parameters of a Helmert transform (position vector convention), and become degrees again.
The way back to degrees uses Bowring's formula, whose error near the ground is far below
a millimetre. Heights are taken as 0 unless given.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    semi_major: float
    inverse_flattening: float

    @property
    def e2(self) -> float:
        f = 1.0 / self.inverse_flattening
        return f * (2.0 - f)

    @property
    def semi_minor(self) -> float:
        return self.semi_major * (1.0 - 1.0 / self.inverse_flattening)


@dataclass(frozen=True)
class Helmert:
    """Shifts in metres, rotations in arc seconds (position vector), scale in parts per million."""

    tx: float
    ty: float
    tz: float
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    ppm: float = 0.0


# Published ellipsoids and the published transform of the Korean 1985 datum.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
GRS80 = Ellipsoid(6378137.0, 298.257222101)
BESSEL = Ellipsoid(6377397.155, 299.1528128)
KOREA_1985 = Helmert(-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)

Point = tuple[Column, Column, Column]


def to_geocentric(lon: Column, lat: Column, on: Ellipsoid, height: Column | None = None) -> Point:
    """Degrees and height to X, Y, Z in metres."""
    h = F.lit(0.0) if height is None else height
    sin, cos = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    across = F.lit(on.semi_major) / F.sqrt(F.lit(1.0) - F.lit(on.e2) * sin * sin)
    flat = (across + h) * cos
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), (across * F.lit(1.0 - on.e2) + h) * sin


def helmert(point: Point, by: Helmert) -> Point:
    """Seven-parameter transform of geocentric coordinates."""
    x, y, z = point
    scale = F.lit(1.0 + by.ppm * 1e-6)
    rx, ry, rz = (F.lit(math.radians(r / 3600.0)) for r in (by.rx, by.ry, by.rz))
    return (
        F.lit(by.tx) + scale * (x - rz * y + ry * z),
        F.lit(by.ty) + scale * (rz * x + y - rx * z),
        F.lit(by.tz) + scale * (-ry * x + rx * y + z),
    )


def to_degrees(point: Point, on: Ellipsoid) -> tuple[Column, Column]:
    """X, Y, Z to (longitude, latitude)."""
    x, y, z = point
    flat = F.sqrt(x * x + y * y)
    turn = F.atan2(z * F.lit(on.semi_major), flat * F.lit(on.semi_minor))
    second = on.e2 / (1.0 - on.e2)
    up = z + F.lit(second * on.semi_minor) * F.pow(F.sin(turn), F.lit(3.0))
    out = flat - F.lit(on.e2 * on.semi_major) * F.pow(F.cos(turn), F.lit(3.0))
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(up, out))


def shift_datum(
    lon: Column, lat: Column, by: Helmert = KOREA_1985, on: Ellipsoid = BESSEL, to: Ellipsoid = WGS84
) -> tuple[Column, Column]:
    """Degrees on the ellipsoid ``on`` to degrees on ``to``."""
    return to_degrees(helmert(to_geocentric(lon, lat, on), by), to)
