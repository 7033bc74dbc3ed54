import math
import random

import pytest

from terrane.functions import heading
from terrane.functions import mercator as M
from terrane.functions.box import HIGH, LOW, Box
from terrane.functions.shapes import PREDICATES, Shape, relate
from terrane.functions.tiles import Tile, covering
from terrane.operators.assembly import build_polygons, chain_rings
from terrane.sources import export, poly, texts


def _shapes(n, seed):
    """Shapes on a coarse grid, so that they touch and overlap exactly."""
    rng = random.Random(seed)
    p = lambda: (rng.randrange(9), rng.randrange(9))
    out = []
    while len(out) < n:
        k = rng.randrange(5)
        if k == 0:
            out.append(Shape.point(*p()))
        elif k == 1:
            a, b, c = p(), p(), p()
            if len({a, b, c}) == 3:
                out.append(Shape.line(a, b, c))
        elif k == 2:
            a, b, c = p(), p(), p()
            if (b[0] - a[0]) * (c[1] - a[1]) != (b[1] - a[1]) * (c[0] - a[0]):
                out.append(Shape.polygon([a, b, c]))
        else:
            x, y, w, h = rng.randrange(6), rng.randrange(6), rng.randint(1, 4), rng.randint(1, 4)
            ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
            hole = [(x + 1, y + 1), (x + 2, y + 1), (x + 2, y + 2), (x + 1, y + 2)]
            out.append(Shape.polygon(ring, hole) if k == 4 and w > 3 and h > 3 else Shape.polygon(ring))
    return out


def test_relate_against_jts(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    geoms = [(s, reader.read(s.wkt())) for s in _shapes(40, 1)]
    names = {"intersects": "intersects", "contains": "contains", "within": "within", "covers": "covers", "covered_by": "coveredBy", "touches": "touches", "crosses": "crosses", "overlaps": "overlaps"}
    for a, ga in geoms:
        for b, gb in geoms[::3]:
            assert relate(a, b) == ga.relate(gb).toString(), (a.wkt(), b.wkt())
            for mine, theirs in names.items():
                assert PREDICATES[mine](a, b) == getattr(ga, theirs)(gb), (mine, a.wkt(), b.wkt())
            assert math.isclose(a.distance(b), ga.distance(gb), abs_tol=1e-9)


def test_text_forms():
    for s in _shapes(60, 2):
        assert Shape.of_wkt(s.wkt()) == s and Shape.of_flat(s.flat()) == s
    assert Shape.of_wkt("GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1.5 2))") == Shape(points=((1, 2),), lines=(((0, 0), (2, 2)),))
    assert Shape.of_wkt("MULTIPOINT ((1 2), (3 4))").points == ((1, 2), (3, 4)) and Shape.of_wkt("POLYGON EMPTY").is_empty


def test_projection():
    for lon, lat in [(0, 0), (7.5, 47.25), (-179.9999999, -85), (179.9999999, 85), (13.3777, 52.5163)]:
        assert abs(M.x_to_lon(M.lon_to_x(lon)) - lon) < 1e-7 and abs(M.y_to_lat(M.lat_to_y(lat)) - lat) < 1e-7
    assert M.lon_to_x(180) == HIGH and M.lon_to_x(-180) in (LOW, LOW + 1)
    with pytest.raises(ValueError):
        M.lon_to_x(181)


def test_boxes():
    a, wrap = Box(0, 0, 10, 10), Box(HIGH - 5, 0, LOW + 5, 10)
    assert wrap.contains(HIGH, 5) and wrap.contains(LOW, 5) and not wrap.contains(0, 5) and len(wrap.parts()) == 2
    assert a.intersects(Box(10, 10, 20, 20)) and not a.intersects(Box(11, 0, 20, 20)) and not a.intersects(Box.empty())
    assert a.intersection(Box(5, 5, 20, 20)) == Box(5, 5, 10, 10) and a.buffer(3) == Box(-3, -3, 13, 13)
    assert Box(HIGH - 1, HIGH - 1, HIGH, HIGH).buffer(4) == Box(HIGH - 5, HIGH - 5, LOW + 3, HIGH)
    assert a.union(Box.empty()) == a and a.translate(5, -5) == Box(5, -5, 15, 5) and Box.parse("7,47,8,48").contains(M.lon_to_x(7.5), M.lat_to_y(47.5))


def test_tiles():
    t = Tile.of(M.lon_to_x(7.5), M.lat_to_y(47.5))
    assert Tile.unpack(int(t)) == t and Tile.parse(str(t)) == t and Tile.parse("13/1/1") is None and Tile.parse("3/8/0") is None
    left, bottom, right, top = t.bounds
    assert left <= M.lon_to_x(7.5) <= right and bottom <= M.lat_to_y(47.5) <= top
    assert t.parent(4) in [c.parent(4) for c in t.parent(11).children()] and t.neighbor(1, 0).neighbor(-1, 0) == t and len(covering(*t.bounds, 12)) == 1
    assert Tile(1, 0, 0).neighbor(-1, 1) == Tile(1, 1, 1)


def test_rings():
    assert len(chain_rings([[(0, 0), (4, 0), (4, 4)], [(0, 0), (0, 4), (4, 4)], [(9, 9), (10, 10)]])) == 1
    s = build_polygons([[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]], [[(2, 2), (3, 2), (3, 3), (2, 3), (2, 2)], [(20, 20), (21, 20), (21, 21), (20, 20)]])
    assert [len(p) for p in s.polygons] == [2] and s.planar_area() == 80
    assert build_polygons([], [[(2, 2), (3, 2), (3, 3), (2, 2)]]).is_empty


def test_overlapping_holes_are_merged(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    rng = random.Random(3)
    shell = [(0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 0)]
    for _ in range(25):
        inner, jts = [], None
        for _ in range(rng.randint(2, 6)):
            x, y, w, h = rng.randint(1, 80) * 10, rng.randint(1, 80) * 10, rng.randint(1, 18) * 10, rng.randint(1, 18) * 10
            ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)] if rng.random() < 0.6 else [(x, y), (x + w, y), (x, y + h), (x, y)]
            inner.append(ring)
            g = reader.read(Shape.polygon(ring).wkt())
            jts = g if jts is None else jts.union(g)
        built = build_polygons([shell], inner)
        assert abs(built.planar_area() - (10**6 - jts.getArea())) < 0.5 * sum(len(r) for p in built.polygons for r in p) * 40, (inner, built.wkt())
    ring = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    frame = [ring(10, 10, 80, 10), ring(10, 80, 80, 10), ring(10, 10, 10, 80), ring(80, 10, 10, 80)]
    built = build_polygons([shell], frame)  # an island within merged holes
    assert sorted(len(p) for p in built.polygons) == [1, 2] and built.planar_area() == 10**6 - 6400 + 3600
    assert [len(p) for p in build_polygons([shell], [ring(10, 10, 5, 5), ring(15, 15, 5, 5)]).polygons] == [3]  # they share a point only


def test_poly_files():
    s = Shape.polygon([(0, 0), (9, 0), (9, 9), (0, 9)], [(2, 2), (3, 2), (3, 3)])
    assert poly.read_poly(poly.write_poly(s)) == s
    far = Shape.polygon([(M.lon_to_x(7.1234567), M.lat_to_y(47.7654321)), (M.lon_to_x(8), M.lat_to_y(47)), (M.lon_to_x(-170.5), M.lat_to_y(80))])
    assert poly.read_poly(poly.write_poly(far, transform=poly.to_degrees()), poly.to_units) == far
    assert len(poly.read_poly("x\na\n 0 0\n 1E1 0\n 1E1 1E1\nEND\nEND\n").polygons) == 1
    for bad in ("x\na\n 0 0\n 1 x\nEND\nEND", "x\na\n 0 0\n 1 1\nEND\nEND", "x\na\n 0 0\n 1 1\n 2 0\n"):
        with pytest.raises(poly.PolyError):
            poly.read_poly(bad)


def test_small_formats():
    assert texts.parse_tags('a=1, b="x, y", "c d"=no') == {"a": "1", "b": "x, y", "c d": "no"}
    assert texts.parse_fab("// note\nset1:\n  k=v\nquery: w[k]\n  set1: true\n") == [("set1", "", [("", "k=v", [])]), ("query", "w[k]", [("set1", "true", [])])]
    m = export.MapMaker()
    m.add(Shape.point(0, 0), tooltip="</script>", url="https://example.com", color="red")
    m.add(Box(0, 0, 10, 10))
    assert "</script>\"" not in m.html() and "fitBounds" in m.html() and "setView" in export.MapMaker().html()
    assert heading.from_degrees(350) == "N" and heading.reversed_("NE") == "SW" and heading.turned("E", 90) == "S" and heading.project(90, 2)[0] == pytest.approx(2)
