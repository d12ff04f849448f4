"""Local metric coordinates on WGS84 as column expressions, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
B = A * (1 - FLAT)
EP2 = E2 / (1 - E2)
#: Height given to points; origins lie at 0.
POINT_HEIGHT = 46.0


def _ecef(lon: Column, lat: Column, h: Column | float) -> tuple[Column, Column, Column]:
    lam, phi = F.radians(lon), F.radians(lat)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + h) * F.sin(phi)


def to_local(lon: Column, lat: Column, height: Column | float, lon0: Column, lat0: Column, height0: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """East, north and up, in metres, of a point seen from an origin."""
    x, y, z = (p - o for p, o in zip(_ecef(lon, lat, height), _ecef(lon0, lat0, height0), strict=True))
    lam, phi = F.radians(lon0), F.radians(lat0)
    east = -F.sin(lam) * x + F.cos(lam) * y
    north = -F.sin(phi) * F.cos(lam) * x - F.sin(phi) * F.sin(lam) * y + F.cos(phi) * z
    return east, north, F.cos(phi) * F.cos(lam) * x + F.cos(phi) * F.sin(lam) * y + F.sin(phi) * z


def from_local(east: Column, north: Column, up: Column, lon0: Column, lat0: Column, height0: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height of local coordinates, in closed form with one Bowring step.

    The height is taken along the normal, which holds at the poles too.
    """
    lam, phi = F.radians(lon0), F.radians(lat0)
    x0, y0, z0 = _ecef(lon0, lat0, height0)
    x = x0 - F.sin(lam) * east - F.sin(phi) * F.cos(lam) * north + F.cos(phi) * F.cos(lam) * up
    y = y0 + F.cos(lam) * east - F.sin(phi) * F.sin(lam) * north + F.cos(phi) * F.sin(lam) * up
    z = z0 + F.cos(phi) * north + F.sin(phi) * up
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, p * B)
    lat = F.atan2(z + EP2 * B * F.pow(F.sin(theta), 3), p - E2 * A * F.pow(F.cos(theta), 3))
    height = p * F.cos(lat) + z * F.sin(lat) - A * F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), height


def to_enu(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """East and north, in metres, of a point at the fixed height seen from an origin."""
    return to_local(lon, lat, POINT_HEIGHT, lon0, lat0)[:2]


def to_geodetic(east: Column, north: Column, lon0: Column, lat0: Column, up: Column | float = POINT_HEIGHT) -> tuple[Column, Column]:
    """Longitude and latitude of local coordinates; ``up`` is the fixed height by default."""
    return from_local(east, north, up if isinstance(up, Column) else F.lit(up), lon0, lat0)[:2]
