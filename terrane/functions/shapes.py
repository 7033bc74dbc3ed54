"""Shapes: points, lines and polygons of integer coordinates; exact relations between them (DE-9IM), distances, texts.

In a table a shape is an array of ints, part after part: kind (0 point, 1 line, 2 shell, 3 hole of the shell before), number of
points, x, y, x, y, ...
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from fractions import Fraction
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .box import Box
from .mercator import lat_to_y, lon_to_x

POINT, LINE, SHELL, HOLE = range(4)
XY = tuple[int, int]


@dataclass(frozen=True)
class Shape:
    points: tuple[XY, ...] = ()
    lines: tuple[tuple[XY, ...], ...] = ()
    #: shell and holes, each closed
    polygons: tuple[tuple[tuple[XY, ...], ...], ...] = field(default=())

    @property
    def is_empty(self) -> bool:
        return not (self.points or self.lines or self.polygons)

    @property
    def dimension(self) -> int:
        return 2 if self.polygons else 1 if self.lines else 0 if self.points else -1

    @property
    def is_mixed(self) -> bool:
        """A collection of parts of different dimensions."""
        return sum(map(bool, (self.points, self.lines, self.polygons))) > 1

    def vertices(self) -> list[XY]:
        return [*self.points, *(p for line in self.lines for p in line), *(p for poly in self.polygons for ring in poly for p in ring)]

    def segments(self) -> list[tuple[XY, XY]]:
        chains = [*self.lines, *(ring for poly in self.polygons for ring in poly)]
        return [(a, b) for c in chains for a, b in zip(c, c[1:]) if a != b]

    @cached_property
    def located(self) -> _Located:
        """Made once for a shape that many others are tested against."""
        return _Located(self)

    @cached_property
    def edges(self) -> _Edges:
        return _Edges(self.segments())

    @cached_property
    def bounds(self) -> Box:
        v = self.vertices()
        return Box(min(x for x, _ in v), min(y for _, y in v), max(x for x, _ in v), max(y for _, y in v)) if v else Box.empty()

    @classmethod
    def point(cls, x: int, y: int) -> Shape:
        return cls(points=((x, y),))

    @classmethod
    def at_lonlat(cls, lon: float, lat: float) -> Shape:
        return cls.point(lon_to_x(lon), lat_to_y(lat))

    @classmethod
    def line(cls, *p: XY) -> Shape:
        return cls(lines=(tuple(p),))

    @classmethod
    def polygon(cls, *rings) -> Shape:
        closed = [tuple(r) if r[0] == r[-1] else (*r, r[0]) for r in rings]
        return cls(polygons=(tuple(closed),))

    @classmethod
    def of_box(cls, b: Box) -> Shape:
        return cls.polygon([(b.min_x, b.min_y), (b.max_x, b.min_y), (b.max_x, b.max_y), (b.min_x, b.max_y)])

    # ------------------------------------------------------------------------------------------------- flat and text forms

    def flat(self) -> list[int]:
        parts = [(POINT, (p,)) for p in self.points] + [(LINE, line) for line in self.lines] + [(SHELL if k == 0 else HOLE, ring) for poly in self.polygons for k, ring in enumerate(poly)]
        return [n for kind, pts in parts for n in (kind, len(pts), *(c for p in pts for c in p))]

    @classmethod
    def of_flat(cls, flat) -> Shape:
        points, lines, polygons, i = [], [], [], 0
        flat = [int(n) for n in flat]
        while i < len(flat):
            kind, n = flat[i : i + 2]
            xy = flat[i + 2 : i + 2 + 2 * n]
            pts = tuple(zip(xy[::2], xy[1::2]))
            if kind == POINT:
                points += pts
            elif kind == LINE:
                lines.append(pts)
            elif kind == SHELL:
                polygons.append([pts])
            else:
                polygons[-1].append(pts)
            i += 2 + 2 * n
        return cls(tuple(points), tuple(lines), tuple(tuple(p) for p in polygons))

    def wkt(self) -> str:
        text = lambda pts: "(" + ", ".join(f"{x} {y}" for x, y in pts) + ")"
        poly = lambda p: "(" + ", ".join(map(text, p)) + ")"
        kinds = [("POINT", [f"({x} {y})" for x, y in self.points]), ("LINESTRING", [text(x) for x in self.lines]), ("POLYGON", [poly(p) for p in self.polygons])]
        parts = []
        for name, items in kinds:
            if len(items) == 1:
                parts.append(f"{name} {items[0]}")
            elif items:
                parts.append(f"MULTI{name} ({', '.join(items)})")
        return parts[0] if len(parts) == 1 else f"GEOMETRYCOLLECTION ({', '.join(parts)})" if parts else "GEOMETRYCOLLECTION EMPTY"

    @classmethod
    def of_wkt(cls, text: str) -> Shape:
        """Coordinates are rounded half up to whole units."""
        tokens = re.findall(r"[A-Za-z]+|[(),]|-?[0-9.]+(?:[eE][-+]?[0-9]+)?", text)
        at = 0

        def nested():
            nonlocal at
            if tokens[at].upper() == "EMPTY":
                at += 1
                return []
            at += 1  # (
            out = []
            while tokens[at] != ")":
                if tokens[at] == ",":
                    at += 1
                elif tokens[at] == "(":
                    out.append(nested())
                elif tokens[at][0].isalpha():
                    out.append(shape())
                else:
                    out.append(tuple(math.floor(float(t) + 0.5) for t in tokens[at : at + 2]))
                    at += 2
            at += 1
            return out

        def shape():
            nonlocal at
            name = tokens[at].upper()
            at += 1
            body = nested()
            poly = lambda p: tuple(tuple(r) for r in p)
            if name == "POINT":
                return cls(points=tuple(body))
            if name == "LINESTRING":
                return cls(lines=(tuple(body),) if body else ())
            if name == "POLYGON":
                return cls(polygons=(poly(body),) if body else ())
            if name == "MULTIPOINT":
                return cls(points=tuple(p[0] if isinstance(p, list) else p for p in body))
            if name == "MULTILINESTRING":
                return cls(lines=tuple(tuple(x) for x in body))
            if name == "MULTIPOLYGON":
                return cls(polygons=tuple(poly(p) for p in body))
            if name == "GEOMETRYCOLLECTION":
                return merge(body)
            raise ValueError(f"unknown geometry {name}")

        return shape()

    # ------------------------------------------------------------------------------------------------------------ measures

    def planar_area(self) -> float:
        ring = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
        return sum(ring(p[0]) - sum(map(ring, p[1:])) for p in self.polygons)

    def distance(self, o: Shape) -> float:
        """Planar distance of the nearest points; 0 if they intersect."""
        if self.is_empty or o.is_empty:
            return math.inf
        if intersects(self, o):
            return 0.0
        best = math.inf
        for a, b in ((self, o), (o, self)):
            segs = b.segments() + [(p, p) for p in b.points]
            best = min(best, min((_point_segment(p, s) for p in a.vertices() for s in segs), default=math.inf))
        return best


def merge(shapes) -> Shape:
    shapes = list(shapes)
    return Shape(tuple(p for s in shapes for p in s.points), tuple(x for s in shapes for x in s.lines), tuple(x for s in shapes for x in s.polygons))


def _point_segment(p, s) -> float:
    (px, py), ((ax, ay), (bx, by)) = p, s
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = 0.0 if not n else min(1.0, max(0.0, ((px - ax) * dx + (py - ay) * dy) / n))
    return math.hypot(ax + t * dx - px, ay + t * dy - py)


# --------------------------------------------------------------------------------------------------------- exact relations


def _turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _within_box(p, a, b) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _on(p, a, b) -> bool:
    return _within_box(p, a, b) and _turn(a, b, p) == 0


def _cuts(s, t) -> list:
    """Points at which segment t cuts segment s."""
    (a, b), (c, d) = s, t
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return []
    denominator = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    if denominator == 0:
        return [p for p in (c, d) if _on(p, a, b)]
    n = (c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])
    m = (c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])
    if denominator < 0:
        n, m, denominator = -n, -m, -denominator
    if not (0 <= n <= denominator and 0 <= m <= denominator):
        return []
    t = Fraction(n, denominator)
    x, y = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
    return [(int(x) if x.denominator == 1 else x, int(y) if y.denominator == 1 else y)]


#: Segments from which on they are kept as columns, too.
MANY = 48


class _Edges:
    """Segments, found by place. Many of them are compared at once as whole numbers; of what is left, all tests are exact."""

    def __init__(self, segs: list):
        self.segs = segs
        if len(segs) >= MANY:
            self.ends = np.array([(*a, *b) for a, b in segs], np.int64).T
            ax, ay, bx, by = self.ends
            self.low_x, self.high_x, self.low_y, self.high_y = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)

    def near(self, a, b) -> list:
        """Numbers of the segments whose boxes touch the box of two points (of whole numbers or fractions)."""
        low_x, high_x = math.ceil(min(a[0], b[0])), math.floor(max(a[0], b[0]))
        low_y, high_y = math.ceil(min(a[1], b[1])), math.floor(max(a[1], b[1]))
        # whole numbers l, h and a fraction p: l <= p is l <= floor(p), and p <= h is ceil(p) <= h
        if len(self.segs) >= MANY:
            return np.flatnonzero((self.low_x <= high_x) & (self.high_x >= low_x) & (self.low_y <= high_y) & (self.high_y >= low_y)).tolist()
        return [i for i, ((ax, ay), (bx, by)) in enumerate(self.segs) if (ax <= high_x or bx <= high_x) and (ax >= low_x or bx >= low_x) and (ay <= high_y or by <= high_y) and (ay >= low_y or by >= low_y)]

    def on(self, p) -> bool:
        return any(_on(p, *self.segs[i]) for i in self.near(p, p))

    def astride(self, p, axis: int) -> list:
        """Segments with one end beyond p along an axis (a whole number along it counts as not beyond)."""
        at = math.floor(p[axis])
        if len(self.segs) >= MANY:
            return [self.segs[i] for i in np.flatnonzero((self.ends[axis] <= at) != (self.ends[axis + 2] <= at))]
        return [s for s in self.segs if (s[0][axis] <= at) != (s[1][axis] <= at)]


class _Located:
    """Where points are with respect to a shape."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.rings = _Edges([(a, b) for poly in shape.polygons for ring in poly for a, b in zip(ring, ring[1:]) if a != b])
        self.chains = _Edges([(a, b) for line in shape.lines for a, b in zip(line, line[1:]) if a != b])
        ends = Counter(e for line in shape.lines for e in (line[0], line[-1]))
        self.ends = {p for p, n in ends.items() if n % 2}
        self.points = set(shape.points)

    def inside(self, p) -> bool:
        odd = False
        for a, b in self.rings.astride(p, 1):
            t = _turn(a, b, p)
            if t and (t > 0) == (b[1] > a[1]):
                odd = not odd
        return odd

    def at(self, p) -> int:
        """0 interior, 1 boundary, 2 exterior"""
        edge = self.rings.on(p)
        if not edge and self.inside(p):
            return 0
        if p in self.points or self.chains.on(p):
            return 1 if p in self.ends and p not in self.points else 0
        return 1 if edge else 2

    def sides(self, m, d) -> tuple[int, int]:
        """Interior (0) or exterior (2) of the polygons on either side of a piece with middle m and direction d."""
        flip = d[0] == 0
        px, py = (m[1], m[0]) if flip else m
        above = level = 0
        for a, b in self.rings.astride(m, 1 if flip else 0):
            (ax, ay), (bx, by) = ((a[1], a[0]), (b[1], b[0])) if flip else (a, b)
            s = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
            if bx < ax:
                s = -s
            if s < 0:
                above += 1
            elif s == 0:
                level += 1
        return (0 if above % 2 else 2), (0 if (above + level) % 2 else 2)


def relate(a: Shape, b: Shape) -> str:
    """The intersection matrix of a and b: dimensions (F, 0, 1, 2) of II IB IE BI BB BE EI EB EE. Exact for any integers.

    All segments are cut at all crossings; end points, middles and both sides of the pieces are then located in both shapes."""
    grid = [[-1] * 3 for _ in range(3)]
    grid[2][2] = 2
    la, lb = a.located, b.located

    def seen(i, j, dim):
        grid[i][j] = max(grid[i][j], dim)

    every = a.edges.segs + b.edges.segs
    found = _Edges(every)
    nodes = {*a.points, *b.points, *(p for s in every for p in s)}
    pieces: dict = {}
    for i, s in enumerate(every):
        (p, q) = s
        dx, dy = q[0] - p[0], q[1] - p[1]
        on = {p, q, *(x for j in found.near(p, q) if j != i for x in _cuts(s, every[j])), *(x for x in (*a.points, *b.points) if _on(x, p, q))}
        nodes |= on
        chain = sorted(on, key=lambda r: (r[0] - p[0]) * dx + (r[1] - p[1]) * dy)
        for u, v in zip(chain, chain[1:]):
            pieces[min(u, v), max(u, v)] = (dx, dy)
    for p in nodes:
        seen(la.at(p), lb.at(p), 0)
    for (u, v), d in pieces.items():
        m = (Fraction(u[0] + v[0]) / 2, Fraction(u[1] + v[1]) / 2)
        seen(la.at(m), lb.at(m), 1)
        for i, j in zip(la.sides(m, d), lb.sides(m, d)):
            seen(i, j, 2)
    return "".join("F" if n < 0 else str(n) for row in grid for n in row)


def _near(a: Shape, b: Shape) -> bool:
    return a.bounds.intersects(b.bounds)


def intersects(a: Shape, b: Shape) -> bool:
    """Whether they share a point; without the whole matrix."""
    if a.is_empty or b.is_empty or not _near(a, b):
        return False
    box = b.bounds
    for i in a.edges.near((box.min_x, box.min_y), (box.max_x, box.max_y)):
        s = a.edges.segs[i]
        if any(_cuts(s, b.edges.segs[j]) for j in b.edges.near(*s)):
            return True
    la, lb = a.located, b.located
    return any(lb.at(p) < 2 for p in _samples(a)) or any(la.at(p) < 2 for p in _samples(b))


def _samples(s: Shape):
    """A vertex of every part; enough where no segments cross."""
    return [*s.points, *(x[0] for x in s.lines), *(ring[0] for poly in s.polygons for ring in poly)]


def disjoint(a: Shape, b: Shape) -> bool:
    return not intersects(a, b)


def _matrix(a, b) -> str | None:
    return relate(a, b) if not a.is_empty and not b.is_empty and _near(a, b) else None


def contains(a: Shape, b: Shape) -> bool:
    m = _matrix(a, b)
    return m is not None and m[0] != "F" and m[6] == m[7] == "F"


def within(a: Shape, b: Shape) -> bool:
    return contains(b, a)


def covers(a: Shape, b: Shape) -> bool:
    m = _matrix(a, b)
    return m is not None and m[6] == m[7] == "F" and any(m[i] != "F" for i in (0, 1, 3, 4))


def covered_by(a: Shape, b: Shape) -> bool:
    return covers(b, a)


def touches(a: Shape, b: Shape) -> bool:
    m = _matrix(a, b)
    return m is not None and m[0] == "F" and any(m[i] != "F" for i in (1, 3, 4))


def crosses(a: Shape, b: Shape) -> bool:
    m = _matrix(a, b)
    if m is None or a.is_mixed or b.is_mixed:
        return False
    if a.dimension == b.dimension:
        return a.dimension == 1 and m[0] == "0"
    return m[0] != "F" and m[2 if a.dimension < b.dimension else 6] != "F"


def overlaps(a: Shape, b: Shape) -> bool:
    m = _matrix(a, b)
    if m is None or a.dimension != b.dimension or a.is_mixed or b.is_mixed:
        return False
    return m[0] == ("1" if a.dimension == 1 else m[0]) and m[0] != "F" and m[2] != "F" and m[6] != "F"


PREDICATES = {f.__name__: f for f in (intersects, disjoint, contains, within, covers, covered_by, touches, crosses, overlaps)}


# ------------------------------------------------------------------------------------------------------------ as columns


def drawn_shape(xy: Column, ftype: Column, is_area: Column) -> Column:
    """The flat shape of a node or a way."""
    kind = F.when(ftype == 0, POINT).when(is_area, SHELL).otherwise(LINE)
    return F.concat(F.array(kind, F.size(xy)), F.flatten(F.transform(xy, lambda p: F.array(p.x, p.y))))
