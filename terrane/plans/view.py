"""Lazy, immutable collections of features. Every narrowing returns a new view; ``df`` lowers a view to a DataFrame."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import ids, shapes
from terrane.functions import mercator as M
from terrane.functions.box import Box
from terrane.functions.shapes import Shape

from . import fast, goql


@lru_cache(maxsize=64)
def _prepared(flat: tuple) -> Shape:
    """A test shape, made once in a worker, with its index of edges."""
    return Shape.of_flat(flat)


def matches(test, shape: Shape):
    """A predicate over flat shapes, ``test(candidate, shape)``; Arrow batches go to Python only for what the plain predicates
    before it leave. Null for no candidate."""
    flat = tuple(shape.flat())

    @F.pandas_udf("boolean")
    def run(candidates: pd.Series) -> pd.Series:
        other = _prepared(flat)
        return pd.Series([None if c is None else bool(test(Shape.of_flat(c), other)) for c in candidates], dtype="boolean")

    return run


@dataclass(frozen=True)
class Kernel:
    """A predicate over shapes. ``verdict``: an expression that is true or false where no shape is needed, else null; for ``decided`` types of
    features it is never null."""

    test: object
    shape: Shape
    verdict: Column | None = None
    decided: frozenset = frozenset()
    #: (data, relations) -> (fid) of the relations for which it holds, where rings are enough; else their whole shapes are tested
    relations: object = None


@dataclass(frozen=True)
class View:
    data: object
    categories: frozenset = goql.ALL
    ftypes: frozenset = frozenset((0, 1, 2))
    #: plain predicates, in the order in which they are tested
    predicates: tuple[Column, ...] = ()
    #: predicates over shapes, tested last
    kernels: tuple = ()
    #: rows that the view is restricted to (members, nodes, parents); default: all features
    source: DataFrame | None = None
    strict_parity: bool = False

    # ----------------------------------------------------------------------------------------------------------- narrowing

    def select(self, query: str) -> View:
        """Features that match a tag query, too."""
        parsed = goql.parse(query, self.strict_parity)
        left = self.categories & goql.types_of(parsed)
        if not left:
            return self.nothing()
        column = goql.compile_query(parsed, self.data.tag, F.col("category"))
        plain = all(not s.clauses and s.types == goql.types_of(parsed) for s in parsed)
        return replace(self, categories=left, predicates=self.predicates if plain else (*self.predicates, column))

    def _typed(self, ftype: int, query: str | None) -> View:
        out = replace(self, ftypes=self.ftypes & {ftype})
        return out.select(query) if query else out

    def nodes(self, query: str | None = None) -> View:
        return self._typed(ids.NODE, query)

    def ways(self, query: str | None = None) -> View:
        """All ways, areas included (the letter w of the query language leaves areas out)."""
        return self._typed(ids.WAY, query)

    def relations(self, query: str | None = None) -> View:
        return self._typed(ids.RELATION, query)

    def within_box(self, box: Box) -> View:
        """Features whose box touches ``box``; several boxes must all be touched."""
        return replace(self, predicates=(*self.predicates, self.data.touching(box))) if box.parts() else self.nothing()

    def filter(self, predicate: Column, *, types: str | None = None, box: Box | None = None) -> View:
        """Features for which a predicate holds. Hints that spare it work: ``types`` (letters of n, w, a, r) and a ``box``, outside of which
        it holds for none."""
        out = replace(self, categories=self.categories & frozenset(types)) if types is not None else self
        out = out.within_box(box) if box is not None else out
        return replace(out, predicates=(*out.predicates, predicate))

    def accept(self, test, columns: list[str], *, types: str | None = None, box: Box | None = None) -> View:
        """Features for which a Python function holds: it gets a pandas frame of ``columns``, a batch at a time, and returns booleans. Hints as for
        ``filter``. An error in it fails the query."""

        @F.pandas_udf("boolean")
        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(test(rows)).astype("boolean")

        return self.filter(F.coalesce(run(F.struct(*columns)), F.lit(False)), types=types, box=box)

    def nothing(self) -> View:
        return replace(self, categories=frozenset())

    def both(self, other: View) -> View:
        """Features of both views."""
        if self.source is None and other.source is None:
            return replace(self, categories=self.categories & other.categories, ftypes=self.ftypes & other.ftypes, predicates=self.predicates + other.predicates, kernels=self.kernels + other.kernels)
        return replace(self, source=self.df().join(other.df().select("fid"), "fid", "left_semi"), predicates=(), kernels=())

    # ------------------------------------------------------------------------------------------------------------- spatial

    def _spatial(self, name: str, shape: Shape, box: Column | None, categories=goql.ALL, ftypes=(0, 1, 2)) -> View:
        kept = replace(self, categories=self.categories & frozenset(categories), ftypes=self.ftypes & frozenset(ftypes))
        return replace(kept, predicates=kept.predicates + ((box,) if box is not None else ()), kernels=(*kept.kernels, Kernel(shapes.PREDICATES[name], shape, fast.by_tiles(name, shape))))

    def _touching(self, shape: Shape) -> Column:
        return self.data.touching(shape.bounds) if not shape.is_empty else F.lit(False)

    def intersecting(self, shape: Shape) -> View:
        return self._spatial("intersects", shape, self._touching(shape))

    def disjoint(self, shape: Shape) -> View:
        """No box can prune here."""
        return self._spatial("disjoint", shape, None)

    def _inside(self, name: str, shape: Shape) -> View:
        if shape.is_mixed:
            return self.nothing()
        cats, types = {2: ("nwar", (0, 1, 2)), 1: ("nwr", (0, 1, 2)), 0: ("nwar", (0, 2))}.get(shape.dimension, ("", ()))
        return self._spatial(name, shape, shape.bounds.encloses() & self._touching(shape), cats, types)

    def within(self, shape: Shape) -> View:
        return self._inside("within", shape)

    def covered_by(self, shape: Shape) -> View:
        return self._inside("covered_by", shape)

    def _around(self, shape: Shape) -> Column:
        b = shape.bounds
        return (F.col("min_x") <= b.min_x) & (F.col("max_x") >= b.max_x) & (F.col("min_y") <= b.min_y) & (F.col("max_y") >= b.max_y)

    def containing(self, shape: Shape) -> View:
        return self._spatial("contains", shape, self._around(shape)) if not shape.is_empty else self.nothing()

    def containing_xy(self, x: int, y: int) -> View:
        """Areas whose rings have an odd number of edges to the right of the point (edges are half-open at their upper end)."""
        kernel = Kernel(_odd, Shape.point(x, y), fast.odd(x, y), frozenset((0, 1)), lambda data, rel: _rings_around(data, rel, x, y))
        return replace(self, categories=self.categories & {"a"}, predicates=(*self.predicates, self._around(Shape.point(x, y)) & self._touching(Shape.point(x, y))), kernels=(*self.kernels, kernel))

    def containing_lonlat(self, lon: float, lat: float) -> View:
        return self.containing_xy(M.lon_to_x(lon), M.lat_to_y(lat))

    def crossing(self, shape: Shape) -> View:
        if shape.is_mixed or shape.is_empty:
            return self.nothing()
        return self._spatial("crosses", shape, self._touching(shape), {2: "nwr"}.get(shape.dimension, "nwar"), (1, 2) if shape.dimension == 0 else (0, 1, 2))

    def touching(self, shape: Shape) -> View:
        if shape.is_mixed or shape.is_empty:
            return self.nothing()
        return self._spatial("touches", shape, self._touching(shape), "nwar", (1, 2) if shape.dimension == 0 else (0, 1, 2))

    def overlapping(self, shape: Shape) -> View:
        if shape.is_mixed or shape.is_empty:
            return self.nothing()
        return self._spatial("overlaps", shape, self._touching(shape), {0: "nr", 1: "wr", 2: "ar"}[shape.dimension])

    def max_meters_from_xy(self, meters: float, x: int, y: int) -> View:
        """Nearer than ``meters``, at the scale of the point's latitude."""
        units = M.units_at(meters, y)
        kernel = Kernel(_nearer(units), Shape.point(x, y), fast.distance(x, y) < units, frozenset((0, 1)))
        return replace(self, predicates=(*self.predicates, self.data.touching(Box.around(math.ceil(units), x, y))), kernels=(*self.kernels, kernel))

    def max_meters_from_lonlat(self, meters: float, lon: float, lat: float) -> View:
        return self.max_meters_from_xy(meters, M.lon_to_x(lon), M.lat_to_y(lat))

    def max_meters_from(self, meters: float, shape: Shape) -> View:
        b = shape.bounds
        units = M.units_at(meters, (b.min_y + b.max_y) / 2)
        return replace(self, predicates=(*self.predicates, self.data.touching(b.buffer(math.ceil(units)))), kernels=(*self.kernels, Kernel(_nearer(units), shape)))

    def connected_to(self, shape_or_fid) -> View:
        """Features that share a vertex with a shape, or with a feature (its fid), which isn't part of the result. Only features whose box touches
        that of the shape or feature have their vertices looked at."""
        from terrane.operators import topology

        if isinstance(shape_or_fid, int):
            source = self.data.features.filter(F.col("fid") == shape_or_fid)
            r = source.select("min_x", "min_y", "max_x", "max_y").first()
            if r is None or r[0] is None:
                return self.nothing()
            keys = topology.vertices(self.data, source, shape_or_fid & 3 == ids.RELATION).select("xy_key")
            near, rest = Box(*r), self.filter(F.col("fid") != shape_or_fid)
        elif shape_or_fid.is_empty:
            return self.nothing()
        else:
            keys = self.data.spark.createDataFrame([(ids.pack(x, y),) for x, y in set(shape_or_fid.vertices())], "xy_key long")
            near, rest = shape_or_fid.bounds, self
        rest = rest.within_box(near)
        rows = rest.df()
        shared = topology.vertices(self.data, rows, ids.RELATION in rest.ftypes and bool(rest.categories & {"a", "r"})).join(keys.distinct(), "xy_key", "left_semi").select("fid").distinct()
        return replace(rest, source=rows.join(shared, "fid", "left_semi"), predicates=(), kernels=())

    # ------------------------------------------------------------------------------------------------------------ topology

    def _restricted(self, rows: DataFrame) -> View:
        return replace(self, source=self._plain().join(rows.select("fid").distinct(), "fid", "left_semi"), predicates=())

    def nodes_of(self, way_id: int) -> View:
        w = self.data.way_nodes.filter((F.col("way_id") == way_id) & F.col("node_id").isNotNull())
        return self.nodes()._restricted(w.select(ids.fid(F.lit(ids.NODE), F.col("node_id")).alias("fid")))

    def members_of(self, rel_id: int, role: str | None = None) -> View:
        """Members of a relation; with ``role``, those that have it."""
        m = self.data.members.filter(F.col("rel_id") == rel_id)
        m = m if role is None else m.filter(F.col("role") == role)
        return self._restricted(m.select(ids.fid(F.col("member_type"), F.col("member_id")).alias("fid")))

    def parents_of(self, ftype: int, id_: int) -> View:
        from terrane.operators import topology

        return self._restricted(topology.parents(self.data).filter(F.col("child") == ids.make_fid(ftype, id_)).select(F.col("parent").alias("fid")))

    # ----------------------------------------------------------------------------------------------------------- terminals

    def _plain(self) -> DataFrame:
        rows = self.source if self.source is not None else self.data.features
        if not self.categories or not self.ftypes:
            return rows.filter(F.lit(False))
        if self.categories != goql.ALL:
            rows = rows.filter(F.col("category").isin(*sorted(self.categories)))
        if len(self.ftypes) < 3:
            rows = rows.filter(F.col("ftype").isin(*sorted(self.ftypes)))
        for p in self.predicates:
            rows = rows.filter(p)
        return rows

    def df(self) -> DataFrame:
        rows = self._plain()
        open_ = []
        for k in self.kernels:
            if k.verdict is not None and self.ftypes <= k.decided:
                rows = rows.filter(k.verdict)  # no shape is needed at all
            elif k.relations is not None:
                rel = rows.filter("ftype = 2")
                rows = rows.filter("ftype < 2").filter(k.verdict).unionByName(rel.join(k.relations(self.data, rel), "fid", "left_semi"))
            else:
                rows = rows if k.verdict is None else rows.filter(F.coalesce(k.verdict, F.lit(True)))
                open_.append(k)
        if not open_:
            return rows
        from terrane.operators.assembly import with_shapes

        drawn = with_shapes(self.data, rows, self.categories, self.ftypes)
        for k in open_:
            if k.verdict is None:
                drawn = drawn.filter(matches(k.test, k.shape)("shape"))
            else:  # what is decided goes by without its shape
                drawn = drawn.filter(F.coalesce(k.verdict, matches(k.test, k.shape)(F.when(k.verdict.isNull(), F.col("shape")))))
        return drawn.drop("shape")

    def count(self) -> int:
        return self.df().count()

    def first(self):
        """The feature of least fid; None if there is none."""
        return self.df().orderBy("fid").first()

    def is_empty(self) -> bool:
        return self.df().isEmpty()

    def to_list(self) -> list:
        return self.df().collect()

    def __iter__(self):
        return self.df().toLocalIterator()

    def get(self, ftype: int, id_: int):
        """The feature with a type and an id; None if there is none."""
        return self.filter((F.col("ftype") == ftype) & (F.col("id") == id_)).first()

    def contains(self, fid: int) -> bool:
        return not self.filter(F.col("fid") == fid).is_empty()

    def bounds(self) -> Box:
        r = self.df().agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
        return Box.empty() if r[0] is None else Box(*r)


def _odd(candidate: Shape, point: Shape) -> bool:
    px, py = point.points[0]
    odd = False
    for a, b in candidate.segments():
        if (a[1] <= py) != (b[1] <= py):
            # to the right of the point, exactly
            t = (px - a[0]) * (b[1] - a[1]) - (py - a[1]) * (b[0] - a[0])
            odd ^= t < 0 if b[1] > a[1] else t > 0
    return odd


def _rings_around(data, relations: DataFrame, x: int, y: int) -> DataFrame:
    """(fid) of area relations an odd number of whose rings is around a point."""
    from terrane.operators.assembly import area_rings

    around = fast.crossings(F.col("xy"), F.lit(x).cast("long"), F.lit(y).cast("long")) % 2 == 1
    return area_rings(data, relations).filter(around).groupBy("fid").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("fid")


def _nearer(units: float):
    return lambda candidate, shape: candidate.distance(shape) < units
