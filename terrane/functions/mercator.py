"""Integer Web-Mercator: the world is 2**32 units wide. Column expressions, and the same on Python numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the coordinate system.
MAP_WIDTH = 4294967294.9999
EARTH_CIRCUMFERENCE = 40075016.68558
MIN_LAT, MAX_LAT = -85.0511287798066, 85.05112877980659


def half_up(a: Column) -> Column:
    return F.floor(a + 0.5)


def x_from_lon(lon: Column) -> Column:
    return half_up(F.lit(MAP_WIDTH) * lon / 360).cast("int")


def y_from_lat(lat: Column) -> Column:
    """Latitudes beyond the square world are moved to its edge."""
    at = F.least(F.greatest(lat, F.lit(MIN_LAT)), F.lit(MAX_LAT))
    return half_up(F.ln(F.tan((at + 90) * F.pi() / 360)) * (F.lit(MAP_WIDTH / 2) / F.pi())).cast("int")


def lon_from_x(x: Column) -> Column:
    return x.cast("double") * 360 / F.lit(MAP_WIDTH)


def lat_from_y(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y.cast("double") * F.pi() * 2 / F.lit(MAP_WIDTH)))) * 2 - 90


def scale(y: Column) -> Column:
    """How much longer a metre is at y than at the equator."""
    return F.cosh(y.cast("double") * 2 * F.pi() / F.lit(MAP_WIDTH))


def meters_per_unit(y: Column) -> Column:
    return F.lit(EARTH_CIRCUMFERENCE / MAP_WIDTH) / scale(y)


def units_from_meters(m: Column, y: Column) -> Column:
    return m * F.lit(MAP_WIDTH / EARTH_CIRCUMFERENCE) * scale(y)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres: planar distance at the scale of the middle."""
    dx, dy = x2.cast("double") - x1.cast("double"), y2.cast("double") - y1.cast("double")
    return F.sqrt(dx * dx + dy * dy) * meters_per_unit((y1.cast("double") + y2.cast("double")) / 2)


# The same on Python numbers, for literals.


def lon_to_x(lon: float) -> int:
    if not -180 <= lon <= 180:
        raise ValueError(f"longitude {lon} is not within -180 and 180")
    return math.floor(MAP_WIDTH * lon / 360 + 0.5)


def lat_to_y(lat: float) -> int:
    if not -90 <= lat <= 90:
        raise ValueError(f"latitude {lat} is not within -90 and 90")
    lat = min(max(lat, MIN_LAT), MAX_LAT)
    return math.floor(math.log(math.tan((lat + 90) * math.pi / 360)) * (MAP_WIDTH / 2 / math.pi) + 0.5)


def x_to_lon(x: float) -> float:
    return x * 360 / MAP_WIDTH


def y_to_lat(y: float) -> float:
    return math.degrees(math.atan(math.exp(y * math.pi * 2 / MAP_WIDTH))) * 2 - 90


def scale_at(y: float) -> float:
    return math.cosh(y * 2 * math.pi / MAP_WIDTH)


def units_at(meters: float, y: float) -> float:
    return meters * MAP_WIDTH / EARTH_CIRCUMFERENCE * scale_at(y)


def meters_at(y: float) -> float:
    return EARTH_CIRCUMFERENCE / MAP_WIDTH / scale_at(y)
