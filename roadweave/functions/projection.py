"""Map projections to UTM zone 32 (EPSG:25832) as Column arithmetic.

Forward and inverse transverse Mercator use the Krüger n-series to order 4 on the GRS80 ellipsoid,
accurate to well under a millimetre inside the zone. No datum shift is applied.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: GRS80 ellipsoid, UTM zone 32, sphere of the web map
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
UTM_K0 = 0.9996
UTM_LON0 = 9.0
UTM_EASTING = 500000.0
WEB_RADIUS = 6378137.0

_N = GRS80_F / (2 - GRS80_F)
_E = math.sqrt(GRS80_F * (2 - GRS80_F))
_RECT = GRS80_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def lonlat_to_utm(p: Column) -> Column:
    phi, lam = F.radians(p["y"]), F.radians(p["x"] - UTM_LON0)
    tau = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(tau, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + tau * tau))
    north, east = xi, eta
    for k, a in enumerate(_ALPHA, 1):
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return F.struct((UTM_EASTING + UTM_K0 * _RECT * east).alias("x"), (UTM_K0 * _RECT * north).alias("y"))


def utm_to_lonlat(p: Column) -> Column:
    xi0, eta0 = p["y"] / (UTM_K0 * _RECT), (p["x"] - UTM_EASTING) / (UTM_K0 * _RECT)
    xi, eta = xi0, eta0
    for k, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - b * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for k, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * k * chi)
    lam = F.atan2(F.sinh(eta), F.cos(xi))
    return F.struct((UTM_LON0 + F.degrees(lam)).alias("x"), F.degrees(phi).alias("y"))


def web_to_lonlat(p: Column) -> Column:
    return F.struct(
        F.degrees(p["x"] / WEB_RADIUS).alias("x"),
        F.degrees(2 * F.atan(F.exp(p["y"] / WEB_RADIUS)) - math.pi / 2).alias("y"),
    )


_TO_LONLAT = {4326: lambda p: p, 3857: web_to_lonlat, 25832: utm_to_lonlat}
_FROM_LONLAT = {4326: lambda p: p, 25832: lonlat_to_utm}


def _chain(first, second):
    return lambda p: second(first(p))


def reproject(df: DataFrame, to_srid: int = 25832, pts: str = "pts", srid: str = "srid") -> DataFrame:
    """Bring every line to one coordinate system; the srid column tells where it comes from.

    Rows already there are untouched. A system that cannot be handled keeps its row and its srid
    (the caller sees it in the srid column), as the checks in the source workflow do.
    """
    if to_srid not in _FROM_LONLAT:
        raise ValueError(f"cannot reproject to EPSG:{to_srid}")
    finish = _FROM_LONLAT[to_srid]
    line, code = F.col(pts), F.col(srid)
    moved, known = None, []
    for source, start in _TO_LONLAT.items():
        if source == to_srid:
            continue
        known.append(source)
        step = F.transform(line, _chain(start, finish))
        moved = F.when(code == source, step) if moved is None else moved.when(code == source, step)
    return df.withColumns(
        {pts: moved.otherwise(line), srid: F.when(code.isin(known), F.lit(to_srid)).otherwise(code)}
    )
