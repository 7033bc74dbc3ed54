"""Helpers on vertex arrays (arrays of structs of x and y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mercator as M


def bounds(xy: Column) -> Column:
    """A struct of min_x, min_y, max_x, max_y; of nulls for no vertices."""
    xs, ys = F.transform(xy, lambda p: p.x), F.transform(xy, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def is_closed(xy: Column) -> Column:
    """Whether the first and the last vertex are the same place; false for no vertices."""
    return F.coalesce(F.get(xy, F.lit(0)) == F.get(xy, F.size(xy) - 1), F.lit(False))


def repaired(xy: Column, missing_x: Column, missing_y: Column) -> Column:
    """The vertices, those at a place that stands for a missing one moved to the last one before that isn't missing, or, at the start, to the first one that
    isn't. Null if all are missing."""
    lost = lambda p: (p.x == missing_x) & (p.y == missing_y)
    first = F.get(F.filter(xy, lambda p: ~lost(p)), F.lit(0))
    start = F.slice(xy, 1, 0)
    filled = F.aggregate(xy, start, lambda done, p: F.concat(done, F.array(F.when(~lost(p), p).otherwise(F.coalesce(F.get(done, F.size(done) - 1), first)))))
    return F.when(first.isNotNull(), filled)


def long_steps(xy: Column) -> Column:
    """How many vertices are more than a signed 16-bit step, in x or in y, from the one before."""
    far = lambda a, b: (b < F.lit(-32768)) | (b > F.lit(32767)) if a is None else far(None, b - a)
    n = F.greatest(F.size(xy) - 1, F.lit(1))
    step = lambda i: F.when(far(F.get(xy, i - 1).x.cast("long"), F.get(xy, i).x.cast("long")) | far(F.get(xy, i - 1).y.cast("long"), F.get(xy, i).y.cast("long")), 1).otherwise(0)
    return F.when(F.size(xy) > 1, F.aggregate(F.transform(F.sequence(F.lit(1), n), step), F.lit(0), lambda s, v: s + v)).otherwise(0)


def to_lonlat(xy: Column, digits: int = 7) -> Column:
    """Vertices in degrees: structs of lon and lat, rounded to so many digits."""
    return F.transform(xy, lambda p: F.struct(F.round(M.lon_from_x(p.x), digits).alias("lon"), F.round(M.lat_from_y(p.y), digits).alias("lat")))


def from_lonlat(spots: Column) -> Column:
    """Structs of lon and lat as vertices."""
    return F.transform(spots, lambda p: F.struct(M.x_from_lon(p.lon).alias("x"), M.y_from_lat(p.lat).alias("y")))
