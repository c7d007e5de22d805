"""Geometry on coordinate columns: expressions only, in doubles; metres and milliseconds are truncated where they become integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
KM_M, MILE_M = 1000.0, 1609.344
#: The step of a 32-bit float at 1, the tolerance of equal points.
EPSILON = 1.1920929e-7


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres, as a double."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def haversine_whole_m(lat1, lon1, lat2, lon2) -> Column:
    return F.floor(haversine_m(lat1, lon1, lat2, lon2)).cast("long")


def distance_to_box_m(lat, lon, min_lat, min_lon, max_lat, max_lon) -> Column:
    """From a point to the nearest point of a box; 0 inside."""
    lat, lon = _c(lat), _c(lon)
    return haversine_m(lat, lon, F.greatest(_c(min_lat), F.least(_c(max_lat), lat)), F.greatest(_c(min_lon), F.least(_c(max_lon), lon)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Degrees clockwise from north, in -180..180."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)))


def turn_angle(bearing_in, bearing_out) -> Column:
    """Whole degrees in -180..179, right turns positive; 0 goes straight on."""
    x = _c(bearing_out) - _c(bearing_in) + F.lit(540.0)
    return (x - F.floor(x / 360.0) * 360.0 - 180.0).cast("int")


def turn_penalty_ms(angle, most_ms) -> Column:
    """Grows with the square of the angle beyond 30 degrees, up to most_ms at a reversal."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(_c(angle).cast("double")) - 30.0) / 150.0))
    return F.floor(t * t * _c(most_ms)).cast("long")


def project(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """The fraction 0..1 along a-b nearest to the point, on a plane scaled by the cosine of the mean latitude."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(_c, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    k = F.cos(F.radians((a_lat + b_lat) / 2))
    dx, dy = (b_lon - a_lon) * k, b_lat - a_lat
    n = dx * dx + dy * dy
    t = ((lon - a_lon) * k * dx + (lat - a_lat) * dy) / F.when(n > 0, n).otherwise(F.lit(1.0))
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))).otherwise(F.lit(0.0))


def same_point(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    return (F.abs(lat1 - lat2) <= EPSILON) & (F.abs(lon1 - lon2) <= EPSILON)


def cross(ox, oy, ax, ay, bx, by) -> Column:
    """Twice the signed area of the triangle o, a, b; positive when it turns left."""
    ox, oy, ax, ay, bx, by = map(_c, (ox, oy, ax, ay, bx, by))
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def _spread(x: Column) -> Column:
    """The low 32 bits of a long, a zero bit between each two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(lat, lon) -> Column:
    """A Z-order key: latitude and longitude scaled to 31 bits each and interleaved, latitude in the even bits, so that keys stay positive."""
    top = float((1 << 31) - 1)
    x = F.floor((_c(lat) + 90.0) / 180.0 * top).cast("long")
    y = F.floor((_c(lon) + 180.0) / 360.0 * top).cast("long")
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def cell(lat, lon, size: float) -> Column:
    """(row, column) of a raster of square cells over the globe, clamped to it."""
    rows, columns = round(180 / size), round(360 / size)
    place = lambda x, shift, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((_c(x) + shift) / size))).cast("int")
    return F.struct(place(lat, 90.0, rows).alias("row"), place(lon, 180.0, columns).alias("col"))


def in_unit(metres, unit) -> Column:
    """Metres in km or mi."""
    return _c(metres) / F.when(_c(unit) == "mi", F.lit(MILE_M)).otherwise(F.lit(KM_M))


def range_of(value, unit) -> Column:
    """An isochrone's range in metres (km, mi) or milliseconds (min)."""
    return F.floor(_c(value) * F.when(_c(unit) == "km", F.lit(KM_M)).when(_c(unit) == "mi", F.lit(MILE_M)).otherwise(F.lit(60_000.0))).cast("long")


def box(lats: Column, lons: Column) -> Column:
    """The bounds of arrays of coordinates."""
    return F.struct(F.array_min(lats).alias("min_lat"), F.array_min(lons).alias("min_lon"), F.array_max(lats).alias("max_lat"), F.array_max(lons).alias("max_lon"))
