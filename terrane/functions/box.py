"""Boxes of integer coordinates, as values for planning and as column predicates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mercator as M

LOW, HIGH = -(1 << 31), (1 << 31) - 1


def _wrap(x: int) -> int:
    return (x - LOW) % (1 << 32) + LOW


@dataclass(frozen=True)
class Box:
    """Closed. A box whose min_x is above its max_x crosses the antimeridian; one whose min_y is above its max_y is empty."""

    min_x: int
    min_y: int
    max_x: int
    max_y: int

    @classmethod
    def of_wsen(cls, west: float, south: float, east: float, north: float) -> Box:
        return cls(M.lon_to_x(west), M.lat_to_y(south), M.lon_to_x(east), M.lat_to_y(north))

    @classmethod
    def parse(cls, text: str) -> Box:
        """``west,south,east,north`` in degrees."""
        parts = [float(p) for p in text.split(",")]
        if len(parts) != 4 or parts[1] > parts[3]:
            raise ValueError(f"not west,south,east,north: {text!r}")
        return cls.of_wsen(*parts)

    @classmethod
    def around(cls, units: int, x: int, y: int) -> Box:
        return cls(x, y, x, y).buffer(units)

    @classmethod
    def meters_around(cls, meters: float, x: int, y: int) -> Box:
        return cls.around(math.ceil(M.units_at(meters, y)), x, y)

    @classmethod
    def world(cls) -> Box:
        return cls(LOW, LOW, HIGH, HIGH)

    @classmethod
    def empty(cls) -> Box:
        return cls(HIGH, HIGH, LOW, LOW)

    @property
    def is_empty(self) -> bool:
        return self.min_y > self.max_y

    @property
    def wraps(self) -> bool:
        return self.min_x > self.max_x and not self.is_empty

    def parts(self) -> list[Box]:
        """Without wrapping: none, one or two boxes."""
        if self.is_empty:
            return []
        return [Box(self.min_x, self.min_y, HIGH, self.max_y), Box(LOW, self.min_y, self.max_x, self.max_y)] if self.wraps else [self]

    def buffer(self, units: int) -> Box:
        """Wider on all sides; stops at the poles and wraps round the world."""
        if self.is_empty:
            return self
        low, high = max(self.min_y - units, LOW), min(self.max_y + units, HIGH)
        width = (self.max_x - self.min_x) % (1 << 32) + 1 + 2 * units
        if width >= 1 << 32 or width <= 0:
            return Box(LOW, low, HIGH, high)
        return Box(_wrap(self.min_x - units), low, _wrap(self.max_x + units), high)

    def translate(self, dx: int, dy: int) -> Box:
        return Box(_wrap(self.min_x + dx), min(max(self.min_y + dy, LOW), HIGH), _wrap(self.max_x + dx), min(max(self.max_y + dy, LOW), HIGH))

    def contains(self, x: int, y: int) -> bool:
        return any(p.min_x <= x <= p.max_x and p.min_y <= y <= p.max_y for p in self.parts())

    def contains_box(self, o: Box) -> bool:
        return not o.is_empty and all(any(p.min_x <= q.min_x and q.max_x <= p.max_x and p.min_y <= q.min_y and q.max_y <= p.max_y for p in self.parts()) for q in o.parts())

    def intersects(self, o: Box) -> bool:
        return any(p.min_x <= q.max_x and q.min_x <= p.max_x and p.min_y <= q.max_y and q.min_y <= p.max_y for p in self.parts() for q in o.parts())

    def intersection(self, o: Box) -> Box:
        """The common part; of two, if a box wraps, the wider one."""
        both = [Box(max(p.min_x, q.min_x), max(p.min_y, q.min_y), min(p.max_x, q.max_x), min(p.max_y, q.max_y)) for p in self.parts() for q in o.parts() if p.intersects(q)]
        return max(both, key=lambda b: b.max_x - b.min_x, default=Box.empty())

    def union(self, o: Box) -> Box:
        if self.is_empty or o.is_empty:
            return o if self.is_empty else self
        return Box(min(self.min_x, o.min_x), min(self.min_y, o.min_y), max(self.max_x, o.max_x), max(self.max_y, o.max_y))

    def overlaps(self) -> Column:
        """Rows whose min_x, min_y, max_x, max_y touch the box: plain comparisons, which the scan can use."""
        out = F.lit(False)
        for k, p in enumerate(self.parts()):
            c = (F.col("min_x") <= p.max_x) & (F.col("max_x") >= p.min_x) & (F.col("min_y") <= p.max_y) & (F.col("max_y") >= p.min_y)
            out = c if k == 0 else out | c
        return out

    def encloses(self) -> Column:
        """Rows whose box is wholly inside."""
        out = F.lit(False)
        for k, p in enumerate(self.parts()):
            c = (F.col("min_x") >= p.min_x) & (F.col("max_x") <= p.max_x) & (F.col("min_y") >= p.min_y) & (F.col("max_y") <= p.max_y)
            out = c if k == 0 else out | c
        return out
