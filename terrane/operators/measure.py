"""Lengths and areas as expressions over vertex arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import mercator as M
from terrane.sources.dataset import Dataset

from .assembly import area_rings


def pairs(xy: Column, value) -> Column:
    """``value(p, q)`` for every two vertices that follow each other."""
    n = F.size(xy)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: value(F.get(xy, i - 1), F.get(xy, i))))


def length_m(xy: Column, is_area: Column) -> Column:
    """Metres along a way; 0 for areas and for what isn't a way."""
    parts = pairs(xy, lambda p, q: M.distance(p.x, p.y, q.x, q.y))
    return F.when(is_area, F.lit(0.0)).otherwise(F.coalesce(F.aggregate(parts, F.lit(0.0), lambda s, d: s + F.coalesce(d, F.lit(0.0))), F.lit(0.0)))


def planar_area2(xy: Column) -> Column:
    """Twice the signed area of a ring, exact within the 64-bit range; coordinates are taken relative to the first vertex."""
    o = F.get(xy, F.lit(0))
    cross = lambda p, q: (p.x.cast("long") - o.x) * (q.y.cast("long") - o.y) - (q.x.cast("long") - o.x) * (p.y.cast("long") - o.y)
    return F.coalesce(F.aggregate(pairs(xy, cross), F.lit(0).cast("long"), lambda s, d: s + d), F.lit(0).cast("long"))


def area_m2(xy: Column, is_area: Column, min_y: Column, max_y: Column) -> Column:
    """Square metres of an area way, at the scale of the middle of its box; 0 otherwise."""
    m = M.meters_per_unit(F.floor((min_y.cast("double") + max_y.cast("double")) / 2))
    return F.when(is_area & xy.isNotNull(), F.abs(planar_area2(xy)) / 2.0 * m * m).otherwise(F.lit(0.0))


def areas_m2(data: Dataset, rows: DataFrame) -> DataFrame:
    """(fid, m2) of all ``rows``: square metres of area ways and area relations (shells less holes), at the scale of the middle of their boxes; 0 for
    others."""
    m = M.meters_per_unit(F.floor((F.col("min_y").cast("double") + F.col("max_y").cast("double")) / 2))
    ways = rows.filter("ftype < 2").select("fid", area_m2(F.col("xy"), F.col("is_area"), F.col("min_y"), F.col("max_y")).alias("m2"))
    rel = rows.filter("ftype = 2")
    # shells and holes turn in any direction, so each ring says which it is
    rings = area_rings(data, rel).select("fid", F.abs(planar_area2(F.col("xy"))).alias("a2"), "hole")
    sums = rings.groupBy("fid").agg(F.sum(F.when(F.col("hole"), -F.col("a2")).otherwise(F.col("a2"))).alias("a2"))
    out = rel.join(sums, "fid", "left").select("fid", F.coalesce(F.col("a2") / 2.0 * m * m, F.lit(0.0)).alias("m2"))
    return ways.unionByName(out)
