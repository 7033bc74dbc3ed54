"""Quadtree tiles packed in an int (zoom: 4 bits, row: 12 bits, column: 12 bits), and curves to sort by."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ZOOM = 12


def column_at(x: Column, zoom: int) -> Column:
    return F.shiftright(x.cast("long") + F.lit(1 << 31), 32 - zoom).cast("int")


def row_at(y: Column, zoom: int) -> Column:
    return F.shiftright(F.lit((1 << 31) - 1) - y.cast("long"), 32 - zoom).cast("int")


def tile_at(x: Column, y: Column, zoom: int = MAX_ZOOM) -> Column:
    return F.lit(zoom << 24).bitwiseOR(F.shiftleft(row_at(y, zoom), 12)).bitwiseOR(column_at(x, zoom))


def parent(tile: Column, zoom: int) -> Column:
    """The tile of a smaller zoom level that holds this one."""
    delta = F.shiftrightunsigned(tile, 24).bitwiseAND(F.lit(15)) - zoom
    row, col = F.shiftright(tile, 12).bitwiseAND(F.lit(4095)), tile.bitwiseAND(F.lit(4095))
    by = F.pow(F.lit(2.0), delta)
    return F.lit(zoom << 24).bitwiseOR((F.floor(row / by) * 4096).cast("int")).bitwiseOR(F.floor(col / by).cast("int"))


def _interleave(a: Column, bits: int) -> Column:
    out = F.lit(0)
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(a, i).bitwiseAND(F.lit(1)), 2 * i))
    return out


def morton(col: Column, row: Column, bits: int = 16) -> Column:
    return _interleave(col, bits).bitwiseOR(F.shiftleft(_interleave(row, bits), 1))


@lru_cache(maxsize=None)
def _curve_steps(bits: int) -> list[int]:
    """For a way of turning the curve (bit 1: flipped, bit 0: transposed) and so many bits of a column and of a row, in this order: the place among the
    cells of these bits, and below it, in two bits, how the curve is turned within the cell."""
    out = []
    for turned in range(4):
        for cell in range(1 << 2 * bits):
            state, d = turned, 0
            for i in range(bits - 1, -1, -1):
                flip, x, y = state >> 1, cell >> bits + i & 1, cell >> i & 1
                rx, ry = (y ^ flip, x ^ flip) if state & 1 else (x ^ flip, y ^ flip)
                d = d << 2 | rx * 3 ^ ry
                state ^= (3 if rx else 1) if not ry else 0
            out.append(d << 2 | state)
    return out


def hilbert(col: Column, row: Column, bits: int = MAX_ZOOM) -> Column:
    """The place of a cell on the Hilbert curve of 2**bits rows and columns: steps of three bits at most, looked up from the highest down."""
    out, turned, rest = F.lit(0).cast("long"), F.lit(0), bits
    while rest:
        n = min(rest, 3)
        rest -= n
        part = lambda v: F.shiftright(v.cast("int"), rest).bitwiseAND(F.lit((1 << n) - 1))  # noqa: B023, E731
        step = F.get(F.lit(_curve_steps(n)), F.shiftleft(turned, 2 * n).bitwiseOR(F.shiftleft(part(col), n)).bitwiseOR(part(row)))
        out, turned = F.shiftleft(out, 2 * n).bitwiseOR(F.shiftright(step, 2).cast("long")), step.bitwiseAND(F.lit(3))
    return out


@dataclass(frozen=True)
class Tile:
    """One tile, for planning."""

    zoom: int
    col: int
    row: int

    @classmethod
    def of(cls, x: int, y: int, zoom: int = MAX_ZOOM) -> Tile:
        return cls(zoom, (x + (1 << 31)) >> (32 - zoom), ((1 << 31) - 1 - y) >> (32 - zoom))

    @classmethod
    def unpack(cls, number: int) -> Tile:
        return cls(number >> 24 & 15, number & 4095, number >> 12 & 4095)

    @classmethod
    def parse(cls, text: str) -> Tile | None:
        """``zoom/column/row``, or ``column/row`` at the highest zoom; None if it isn't a tile."""
        parts = text.split("/")
        if len(parts) not in (2, 3) or not all(p.isdigit() for p in parts):
            return None
        zoom, col, row = [MAX_ZOOM, *map(int, parts)][-3:]
        return cls(zoom, col, row) if zoom <= MAX_ZOOM and max(col, row) < 1 << zoom else None

    def __int__(self) -> int:
        return self.zoom << 24 | self.row << 12 | self.col

    def __str__(self) -> str:
        return f"{self.zoom}/{self.col}/{self.row}"

    @property
    def bounds(self) -> tuple[int, int, int, int]:
        """min_x, min_y, max_x, max_y"""
        size = 1 << (32 - self.zoom)
        left, bottom = self.col * size - (1 << 31), (1 << 31) - (self.row + 1) * size
        return left, bottom, left + size - 1, bottom + size - 1

    def parent(self, zoom: int) -> Tile:
        return Tile(zoom, self.col >> (self.zoom - zoom), self.row >> (self.zoom - zoom))

    def neighbor(self, east: int, north: int) -> Tile:
        """Wraps at the edges of the world."""
        mask = (1 << self.zoom) - 1
        return Tile(self.zoom, self.col + east & mask, self.row - north & mask)

    def children(self) -> list[Tile]:
        return [Tile(self.zoom + 1, 2 * self.col + i, 2 * self.row + j) for j in (0, 1) for i in (0, 1)]


def covering_size(box, zoom: int) -> int:
    """How many tiles ``covering`` lists for all parts of a box."""
    ends = [(Tile.of(p.min_x, p.max_y, zoom), Tile.of(p.max_x, p.min_y, zoom)) for p in box.parts()]
    return sum((b.row - a.row + 1) * (b.col - a.col + 1) for a, b in ends)


def covering(min_x: int, min_y: int, max_x: int, max_y: int, zoom: int) -> list[Tile]:
    """All tiles of a zoom level that a box touches."""
    a, b = Tile.of(min_x, max_y, zoom), Tile.of(max_x, min_y, zoom)
    return [Tile(zoom, c, r) for r in range(a.row, b.row + 1) for c in range(a.col, b.col + 1)]
