"""Set-at-a-time spatial joins: features meet by tiles of about their size, then by box, then exactly."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import shapes
from terrane.functions.shapes import Shape
from terrane.plans.fast import crossings
from terrane.sources.dataset import Dataset

from .assembly import area_rings


#: The finest zoom level of the grids in which boxes meet.
FINEST = 12


def _level() -> Column:
    """The finest level whose tiles are no smaller than a row's box, so that the box touches four of them at most."""
    size = F.greatest(F.col("max_x").cast("long") - F.col("min_x"), F.col("max_y").cast("long") - F.col("min_y"))
    return F.least(F.lit(FINEST), 32 - F.length(F.bin(size)))


def _place(v: Column, zoom: Column) -> Column:
    """A column or a row of tiles, from a coordinate counted from the left or the upper edge of the world."""
    return F.call_function("shiftright", v, 32 - zoom)


def _across(x: Column) -> Column:
    return x.cast("long") + (1 << 31)


def _down(y: Column) -> Column:
    return ((1 << 31) - 1) - y.cast("long")


def _number(column: Column, row: Column, zoom: Column) -> Column:
    return zoom.cast("long") * (1 << 26) + F.call_function("shiftleft", row, zoom) + column


def _cell(x: Column, y: Column, zoom: Column) -> Column:
    return _number(_place(_across(x), zoom), _place(_down(y), zoom), zoom)


def _cells(zoom: Column) -> Column:
    """The tiles of a level that a row's box touches."""
    columns = F.sequence(_place(_across(F.col("min_x")), zoom), _place(_across(F.col("max_x")), zoom))
    rows = F.sequence(_place(_down(F.col("max_y")), zoom), _place(_down(F.col("min_y")), zoom))
    return F.flatten(F.transform(columns, lambda c: F.transform(rows, lambda r: _number(c, r, zoom))))


def _spread(df: DataFrame) -> DataFrame:
    """A row for each tile that a box touches at its own level (``own``) and at the coarser ones: no more than four a level, however large the box."""
    at = F.flatten(F.transform(F.sequence(F.lit(0), F.col("level")), lambda z: F.transform(_cells(z), lambda c: F.struct(c.alias("cell"), z.alias("zoom"), (z == F.col("level")).alias("own")))))
    return df.withColumn("level", _level()).withColumn("at", F.explode(at)).drop("level")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows by cell, in as many partitions as shuffles have: few bytes meet in very many pairs, so AQE's sizes say nothing about the work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell")


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows (columns prefixed l_ and r_) whose boxes touch, each once. They meet at the level of the larger one, and count in one
    tile only: that of the lower left corner of what the boxes share, so no distinct is needed."""
    side = lambda df, p: _dealt(_spread(df.filter("min_x is not null")).select("at.cell", F.col("at.own").alias(p + "own"), F.col("at.zoom").alias(p + "zoom"), *[F.col(c).alias(p + c) for c in df.columns]))
    a, b = side(left, "l_"), side(right, "r_").drop("r_zoom")
    # two joins: a filter after one would first pair all rows of coarse tiles at which neither side has boxes of its own
    both = a.filter("l_own").join(b, "cell").unionByName(a.filter("not l_own").join(b.filter("r_own"), "cell"))
    c = {n: (F.col(f"l_{n}"), F.col(f"r_{n}")) for n in ("min_x", "min_y", "max_x", "max_y")}
    touch = (c["min_x"][0] <= c["max_x"][1]) & (c["min_x"][1] <= c["max_x"][0]) & (c["min_y"][0] <= c["max_y"][1]) & (c["min_y"][1] <= c["max_y"][0])
    home = _cell(F.greatest(*c["min_x"]), F.greatest(*c["min_y"]), F.col("l_zoom"))
    return both.filter(touch & (F.col("cell") == home)).drop("cell", "l_own", "r_own", "l_zoom")


def _is_box(x: list[Column], y: list[Column]) -> Column:
    """Whether five vertices draw a row's box, in either direction from any corner."""
    upright = lambda first: reduce(and_, [(x if (k % 2 == 0) == first else y)[k] == (x if (k % 2 == 0) == first else y)[k + 1] for k in range(4)])
    corners = (F.least(x[0], x[2]) == F.col("min_x")) & (F.greatest(x[0], x[2]) == F.col("max_x")) & (F.least(y[0], y[2]) == F.col("min_y")) & (F.greatest(y[0], y[2]) == F.col("max_y"))
    return F.coalesce((x[0] == x[4]) & (y[0] == y[4]) & (upright(True) | upright(False)) & (x[0] != x[2]) & (y[0] != y[2]) & corners, F.lit(False))


def _box_ring() -> Column:
    """Whether a ring is its box."""
    v = [F.get(F.col("xy"), F.lit(k)) for k in range(5)]
    return (F.size("xy") == 5) & _is_box([p.x for p in v], [p.y for p in v])


def _box_shape() -> Column:
    """Whether a flat shape is its box."""
    at = lambda k: F.get(F.col("shape"), F.lit(k))
    return (F.size("shape") == 12) & (at(0) == shapes.SHELL) & (at(1) == 5) & _is_box([at(2 + 2 * k) for k in range(5)], [at(3 + 2 * k) for k in range(5)])


def _of_boxes(predicate: str) -> Column:
    """A predicate of two rectangles whose boxes touch."""
    c = lambda side, n: F.col(f"{side}_{n}")
    held = lambda a, b: (c(a, "min_x") >= c(b, "min_x")) & (c(a, "max_x") <= c(b, "max_x")) & (c(a, "min_y") >= c(b, "min_y")) & (c(a, "max_y") <= c(b, "max_y"))
    deep = (c("l", "min_x") < c("r", "max_x")) & (c("l", "max_x") > c("r", "min_x")) & (c("l", "min_y") < c("r", "max_y")) & (c("l", "max_y") > c("r", "min_y"))
    if predicate in ("contains", "covers"):
        return held("r", "l")
    if predicate in ("within", "covered_by"):
        return held("l", "r")
    return {"intersects": F.lit(True), "touches": ~deep, "overlaps": deep & ~held("l", "r") & ~held("r", "l"), "crosses": F.lit(False)}[predicate]


def _alike(df: DataFrame, *by: str) -> DataFrame:
    """One row for all rows with the same ``by``, and their ``fids``: what coincides is compared once."""
    return df.groupBy(*by).agg(F.collect_list("fid").alias("fids"))


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects") -> DataFrame:
    """(left_fid, right_fid) for which ``predicate(left, right)`` holds. Both sides: fid, a box, a flat shape.

    Shapes that coincide meet once, and their pairs are spread afterwards. Rectangles along the axes are decided by expressions, other pairs by shapes."""
    test = shapes.PREDICATES[predicate]
    if predicate == "disjoint":
        raise ValueError("disjoint features don't meet; take the complement of intersects")

    @F.pandas_udf("boolean")
    def holds(a: pd.Series, b: pd.Series) -> pd.Series:
        made: dict = {}  # a shape that meets many others is made once a batch

        def shape(flat):
            key = flat.tobytes()
            if key not in made:
                made[key] = Shape.of_flat(flat)
            return made[key]

        return pd.Series([bool(test(shape(x), shape(y))) for x, y in zip(a, b)], dtype=bool)

    edges = ["min_x", "min_y", "max_x", "max_y"]
    cols = ["fids", *edges, "shape"]
    a, b = (_alike(df.filter("shape is not null"), *edges, "shape").withColumn("boxed", _box_shape()) for df in (left, right))
    boxes, others = ([df.filter(c).select(cols) for df in (a, b)] for c in ("boxed", "not boxed"))
    plain = candidate_pairs(*(df.drop("shape") for df in boxes)).filter(_of_boxes(predicate)).select("l_fids", "r_fids")
    drawn = candidate_pairs(others[0], b.select(cols)).unionByName(candidate_pairs(boxes[0], others[1]))
    met = plain.unionByName(drawn.filter(holds("l_shape", "r_shape")).select("l_fids", "r_fids"))
    return met.select(F.explode("l_fids").alias("left_fid"), "r_fids").select("left_fid", F.explode("r_fids").alias("right_fid"))


def points_in_areas(points: DataFrame, areas: DataFrame, data: Dataset | None = None) -> DataFrame:
    """(point_fid, area_fid): even-odd, in expressions only. ``points``: fid, x, y; ``areas``: fid and closed xy rings; with ``data``, area
    relations (ftype 2) too, whose rings are assembled before: a point is inside if an odd number of them is around it.

    Places and rings that coincide meet once, and are spread afterwards. Rectangles need no edges."""
    px, py = F.col("x").cast("long"), F.col("y").cast("long")
    at = F.transform(F.sequence(F.lit(0), F.lit(FINEST)), lambda z: _cell(F.col("x"), F.col("y"), z))
    spots = _alike(points.filter("x is not null and y is not null"), "x", "y").withColumnRenamed("fids", "points")
    p = _dealt(spots.withColumn("cell", F.explode(at)))
    edges = {"min_x": F.array_min("xy.x"), "min_y": F.array_min("xy.y"), "max_x": F.array_max("xy.x"), "max_y": F.array_max("xy.y")}

    def around(rings: DataFrame) -> DataFrame:
        """Places and the rings around them. Rings meet them at their own level only."""
        boxed = rings.withColumns(edges).filter("min_x is not null").withColumns({"level": _level(), "boxed": _box_ring()})
        own = boxed.withColumn("cell", F.explode(_cells(F.col("level")))).withColumn("xy", F.when(~F.col("boxed"), F.col("xy"))).drop("level")
        near = (px >= F.col("min_x")) & (px <= F.col("max_x")) & (py >= F.col("min_y")) & (py <= F.col("max_y"))
        inside = F.when(F.col("boxed"), (px < F.col("max_x")) & (py < F.col("max_y"))).otherwise(crossings(F.col("xy"), px, py) % 2 == 1)
        return p.join(_dealt(own), "cell").filter(near).filter(inside)

    ways = areas if data is None else areas.filter("ftype < 2")
    met = around(_alike(ways.filter("xy is not null"), "xy"))
    out = met.select("points", F.explode("fids").alias("area_fid")).select(F.explode("points").alias("point_fid"), "area_fid")
    if data is None:
        return out
    # a ring that a relation has an even number of times counts as none
    rings = area_rings(data, areas.filter("ftype = 2")).groupBy("fid", "xy").agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")
    odd = around(rings).groupBy("x", "y", F.col("fid").alias("area_fid")).agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return out.unionByName(odd.join(spots, ["x", "y"]).select(F.explode("points").alias("point_fid"), "area_fid"))
