"""Transverse Mercator on the WGS 84 ellipsoid as column arithmetic: series in the third flattening, to its sixth power."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84's equatorial radius and flattening, and the scale and false origin of UTM's zones.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: The series' coefficients by powers of n, 1 to 6, for each multiple of the angle.
_FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
_BACK = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
ALPHA = [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in _FORWARD]
BETA = [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in _BACK]
#: Rounds that bring a conformal latitude back; each gains two digits or more.
ROUNDS = 6


def zone_meridian(zone: int) -> float:
    """The central meridian of a UTM zone, in degrees."""
    return 6.0 * zone - 183.0


def project(lon: Column, lat: Column, meridian: float, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) in metres of longitudes and latitudes in degrees, on UTM's scale and false origin. Good within some 30 degrees of the meridian."""
    phi, lam = F.radians(lat), F.radians(lon - F.lit(float(meridian)))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    y = xi + sum((F.lit(a) * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(ALPHA, 1)), F.lit(0.0))
    x = eta + sum((F.lit(a) * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(ALPHA, 1)), F.lit(0.0))
    return F.lit(FALSE_EAST) + F.lit(SCALE * _A) * x, F.lit(FALSE_NORTH if south else 0.0) + F.lit(SCALE * _A) * y


def unproject(east: Column, north: Column, meridian: float, south: bool = False) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees: the inverse of project."""
    y, x = (north - F.lit(FALSE_NORTH if south else 0.0)) / F.lit(SCALE * _A), (east - F.lit(FALSE_EAST)) / F.lit(SCALE * _A)
    xi = y - sum((F.lit(b) * F.sin(2 * k * y) * F.cosh(2 * k * x) for k, b in enumerate(BETA, 1)), F.lit(0.0))
    eta = x - sum((F.lit(b) * F.cos(2 * k * y) * F.sinh(2 * k * x) for k, b in enumerate(BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    start = F.atanh(F.sin(chi))
    # the isometric latitude less the ellipsoid's part: iterated in an array of one, so that each round's value is computed once
    sine = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.sin(chi), lambda s, _: F.tanh(start + F.lit(_E) * F.atanh(F.lit(_E) * s)))
    return F.lit(float(meridian)) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(F.asin(sine))
