"""Web-Mercator tiles, quantisation and geodesy as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values of the data model.
ZOOM = 14
EXTENT = 65535
MAX_LATITUDE = 85.05112878
EARTH_RADIUS = 6378137.0
TILES = 1 << ZOOM


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def mercator_x(lon) -> Column:
    """Fraction of the world's width, 0 to 1."""
    return (_c(lon) + 180.0) / 360.0


def mercator_y(lat) -> Column:
    """Fraction of the world's height from the north, 0 to 1."""
    held = F.greatest(F.least(_c(lat), F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    r = F.radians(held)
    return (F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / math.pi) / 2.0


def longitude(x) -> Column:
    return _c(x) * 360.0 - 180.0


def latitude(y) -> Column:
    return F.degrees(2.0 * F.atan(F.exp(math.pi * (1.0 - 2.0 * _c(y)))) - math.pi / 2.0)


def metres(x, y) -> tuple[Column, Column]:
    """EPSG:3857 of world fractions."""
    around = 2 * math.pi * EARTH_RADIUS
    return (_c(x) - 0.5) * around, (0.5 - _c(y)) * around


def tile(fraction) -> Column:
    """Tile number on one axis at the model's zoom."""
    return F.greatest(F.least(F.floor(_c(fraction) * TILES), F.lit(TILES - 1)), F.lit(0)).cast("int")


def quantise(fraction, tile_number) -> Column:
    """Place inside a tile, half to even."""
    return F.greatest(F.least(F.rint((_c(fraction) * TILES - tile_number) * EXTENT), F.lit(float(EXTENT))), F.lit(0.0)).cast("int")


def dequantise(q, tile_number) -> Column:
    return (q / float(EXTENT) + tile_number) / float(TILES)


def cell(fraction) -> Column:
    """Quantisation cell on one axis: where two ends are the same node."""
    number = tile(fraction)
    return number.cast("long") * EXTENT + quantise(fraction, number)


def crossings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Sorted fractions strictly inside (0, 1) where a segment crosses tile borders."""

    def axis(a: Column, b: Column) -> Column:
        low, high = F.least(a, b) * TILES, F.greatest(a, b) * TILES
        first, last = (F.floor(low) + 1).cast("long"), (F.ceil(high) - 1).cast("long")
        lines = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda n: (n / float(TILES) - a) / (b - a))

    both = F.array_distinct(F.concat(axis(x0, x1), axis(y0, y1)))
    return F.array_sort(F.filter(both, lambda t: (t > 0) & (t < 1)))


def ground_length(lons: Column, lats: Column) -> Column:
    """Metres of a polyline given as two arrays: projected length times the cosine at each midpoint."""
    around = 2 * math.pi * EARTH_RADIUS
    pairs = F.arrays_zip(lons.alias("lon"), lats.alias("lat"))

    def piece(i: Column) -> Column:
        a, b = F.element_at(pairs, i), F.element_at(pairs, i + 1)
        ya, yb = mercator_y(a["lat"]), mercator_y(b["lat"])
        flat = F.hypot((mercator_x(b["lon"]) - mercator_x(a["lon"])) * around, (yb - ya) * around)
        return flat * F.cos(F.radians(latitude((ya + yb) / 2)))

    steps = F.when(F.size(pairs) > 1, F.sequence(F.lit(1), F.size(pairs) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(steps, piece), F.lit(0.0), lambda a, b: a + b)


def ground_length_of_fractions(xs: Column, ys: Column) -> Column:
    """Metres of a polyline given as fractions of the world's width and height."""
    around = 2 * math.pi * EARTH_RADIUS

    def piece(i: Column) -> Column:
        flat = F.hypot((F.element_at(xs, i + 1) - F.element_at(xs, i)) * around, (F.element_at(ys, i + 1) - F.element_at(ys, i)) * around)
        return flat * F.cos(F.radians(latitude((F.element_at(ys, i) + F.element_at(ys, i + 1)) / 2)))

    steps = F.when(F.size(xs) > 1, F.sequence(F.lit(1), F.size(xs) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(steps, piece), F.lit(0.0), lambda a, b: a + b)


# --- coordinate systems -------------------------------------------------------

# The WGS 84 ellipsoid and the transverse Mercator scale of a UTM zone.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_MERIDIAN = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to the fourth order, forward and back.
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


def _zone(code: int) -> tuple[int, bool] | None:
    """UTM zone and whether it is southern, of an EPSG code on WGS 84 or ETRS89."""
    if 32601 <= code <= 32660:
        return code - 32600, False
    if 32701 <= code <= 32760:
        return code - 32700, True
    if 25828 <= code <= 25838:
        return code - 25800, False
    return None


def _epsg(crs: str) -> int:
    head, _, code = crs.partition(":")
    if head.upper() != "EPSG" or not code.isdigit():
        raise ValueError(f"'{crs}' is not an EPSG code")
    return int(code)


def to_degrees(crs: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of source coordinates: EPSG:4326, 4258, 3857 and the UTM zones of WGS 84 and ETRS89."""
    code = _epsg(crs)
    if code in (4326, 4258):
        return x, y
    if code == 3857:
        around = 2 * math.pi * EARTH_RADIUS
        return longitude(x / around + 0.5), latitude(0.5 - y / around)
    if (zone := _zone(code)) is None:
        raise ValueError(f"EPSG:{code} is not known")
    xi, eta = (y - (10_000_000.0 if zone[1] else 0.0)) / (_K0 * _MERIDIAN), (x - 500_000.0) / (_K0 * _MERIDIAN)
    xi_, eta_ = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi_, eta_ = xi_ - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta), eta_ - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    # Conformal to geodetic latitude: three steps of the fixed point settle to less than a nanodegree.
    e = math.sqrt(_F * (2 - _F))
    phi = chi
    for _ in range(5):
        phi = 2 * F.atan(F.tan(math.pi / 4 + chi / 2) * F.pow((1 + e * F.sin(phi)) / (1 - e * F.sin(phi)), F.lit(e / 2))) - math.pi / 2
    return F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_))) + (zone[0] * 6 - 183), F.degrees(phi)


def from_degrees(crs: str, lon: Column, lat: Column) -> tuple[Column, Column]:
    """The way back of ``to_degrees``."""
    code = _epsg(crs)
    if code in (4326, 4258):
        return lon, lat
    if code == 3857:
        return metres(mercator_x(lon), mercator_y(lat))
    if (zone := _zone(code)) is None:
        raise ValueError(f"EPSG:{code} is not known")
    e = math.sqrt(_F * (2 - _F))
    phi, lam = F.radians(lat), F.radians(lon - (zone[0] * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x, y = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _K0 * _MERIDIAN * x + 500_000.0, _K0 * _MERIDIAN * y + (10_000_000.0 if zone[1] else 0.0)
