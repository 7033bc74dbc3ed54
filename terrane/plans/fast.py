"""Deciding spatial predicates without shapes: by tiles that lie wholly inside or outside a polygon, and by expressions over vertices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import tiles
from terrane.functions.shapes import Shape, _turn
from terrane.functions.tiles import Tile

#: Tiles that a polygon is cut into at most.
MOST_TILES = 400
#: What a predicate of (candidate, polygon) is for candidates that lie strictly inside the polygon; outside, only disjoint holds.
INSIDE = {"intersects": True, "within": True, "covered_by": True, "disjoint": False, "contains": False, "covers": False, "touches": False, "crosses": False, "overlaps": False}


def _cut_by(tile: Tile, shape: Shape) -> bool:
    """Whether a ring's edge meets the closed square of a tile."""
    left, bottom, right, top = tile.bounds
    corners = [(left, bottom), (right, bottom), (right, top), (left, top)]
    edges = shape.located.rings
    for i in edges.near((left, bottom), (right, top)):
        turns = [_turn(*edges.segs[i], c) for c in corners]
        if min(turns) <= 0 <= max(turns):
            return True
    return False


def classify(shape: Shape, most: int = MOST_TILES) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """Tiles, by zoom level, that no edge of a polygon meets: those inside it, and those outside it. Together with tiles that edges meet, at most about
    ``most``, they cover its box."""
    inside: dict[int, list[int]] = {}
    outside: dict[int, list[int]] = {}
    b = shape.bounds
    zoom = next((z for z in range(tiles.MAX_ZOOM, 0, -1) if Tile.of(b.min_x, b.max_y, z) == Tile.of(b.max_x, b.min_y, z)), 0)
    front, done = [Tile.of(b.min_x, b.max_y, zoom)], 0
    while front:
        cut = []
        for t in front:
            if _cut_by(t, shape):
                cut.append(t)
            else:
                left, bottom, _, _ = t.bounds
                (inside if shape.located.inside((left, bottom)) else outside).setdefault(t.zoom, []).append(int(t))
                done += 1
        if not cut or cut[0].zoom == tiles.MAX_ZOOM or done + 4 * len(cut) > most:
            break
        front = [c for t in cut for c in t.children()]
    return inside, outside


def _within_tiles(sets: dict[int, list[int]]) -> Column:
    """Whether a row's whole box lies in one of the tiles."""
    out = F.lit(False)
    for z, listed in sorted(sets.items()):
        a, b = tiles.tile_at(F.col("min_x"), F.col("max_y"), z), tiles.tile_at(F.col("max_x"), F.col("min_y"), z)
        out = out | ((a == b) & a.isin(listed))
    return out


def by_tiles(name: str, shape: Shape) -> Column | None:
    """True or false for nodes and ways that tiles decide, else null; None if there is nothing to gain."""
    if name not in INSIDE or shape.dimension != 2 or shape.is_mixed:
        return None
    inside, outside = classify(shape)
    if not inside and not outside:
        return None
    drawn = F.col("ftype") < 2  # a relation's shape may be empty
    return F.when(drawn & F.coalesce(_within_tiles(inside), F.lit(False)), F.lit(INSIDE[name])).when(drawn & F.coalesce(_within_tiles(outside), F.lit(False)), F.lit(name == "disjoint"))


def crossings(xy: Column, px: Column, py: Column) -> Column:
    """How many edges of a ring are to the right of a point (whole numbers, as bigint); edges are half-open at their upper end."""

    def right_of(i):
        q, r = F.get(xy, i - 1), F.get(xy, i)
        up = r.y > q.y
        t = (px - q.x) * (r.y.cast("long") - q.y) - (py - q.y) * (r.x.cast("long") - q.x)
        return F.when(((q.y <= py) != (r.y <= py)) & F.when(up, t < 0).otherwise(t > 0), 1).otherwise(0)

    return F.when(F.size(xy) > 1, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.size(xy) - 1, F.lit(1))), right_of), F.lit(0), lambda s, v: s + v)).otherwise(0)


def odd(x: int, y: int) -> Column:
    """For ways, whether a point lies in their area; null for relations."""
    here = crossings(F.col("xy"), F.lit(x).cast("long"), F.lit(y).cast("long")) % 2 == 1
    return F.when(F.col("ftype") == 1, F.coalesce(F.col("is_area") & here, F.lit(False))).when(F.col("ftype") == 0, F.lit(False))


def distance(x: int, y: int) -> Column:
    """For nodes and ways, the planar distance of their nearest point (0 within an area); null for relations."""
    px, py = F.lit(float(x)), F.lit(float(y))

    def to_segment(i):
        q, r = F.get("xy", i - 1), F.get("xy", i)
        qx, qy = q.x.cast("double"), q.y.cast("double")
        dx, dy = r.x.cast("double") - qx, r.y.cast("double") - qy
        n = dx * dx + dy * dy
        t = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - qx) * dx + (py - qy) * dy) / n)))
        return F.hypot(qx + t * dx - px, qy + t * dy - py)

    line = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("xy") - 1, F.lit(1))), to_segment))
    first = F.get("xy", F.lit(0))
    point = F.hypot(first.x.cast("double") - px, first.y.cast("double") - py)
    return F.when(F.col("ftype") == 0, point).when(odd(x, y), F.lit(0.0)).when(F.col("ftype") == 1, F.when(F.size("xy") > 1, line).otherwise(point))
