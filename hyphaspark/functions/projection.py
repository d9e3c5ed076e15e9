"""Map projections as Column arithmetic: WGS84 to UTM zone 32N and back (Krueger series), to Web
Mercator and to the Goode homolosine projection (its Mollweide part)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
SCALE = 0.9996 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECC = 2 * math.sqrt(_N) / (1 + _N)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
LON0, EAST0 = 9.0, 500000.0


def utm_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST0 + SCALE * x, SCALE * y


def utm_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    xi, eta = y / SCALE, (x - EAST0) / SCALE
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), LON0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))


def mercator_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    return _A * F.radians(lon), _A * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2), F.degrees(x / _A)


def homolosine_forward(lat: Column, lon: Column, lobe: float = 30.0, steps: int = 8) -> tuple[Column, Column]:
    """Interrupted homolosine north of 40 deg 44': a Mollweide lobe around ``lobe``, shifted to meet the
    sinusoidal part. The auxiliary angle takes a fixed number of Newton steps."""
    phi = F.radians(lat)
    goal = math.pi * F.sin(phi)
    newton = lambda t, _: t - (2 * t + F.sin(2 * t) - goal) / (2 + 2 * F.cos(2 * t))
    theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), phi, newton)
    x = _A * (math.radians(lobe) + 2 * math.sqrt(2) / math.pi * F.radians(lon - lobe) * F.cos(theta))
    return x, _A * (math.sqrt(2) * F.sin(theta) - 0.0528035274542)
