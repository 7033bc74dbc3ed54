import math
import random
import re
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from terrane.functions import coordinates, heading, ids, strings, tags, tiles
from terrane.functions.box import Box
from terrane.functions.shapes import Shape, intersects, within
from terrane.functions.tiles import Tile
from terrane.operators import assembly, topology
from terrane.plans import fast, queries
from terrane.sources import dataset, derived, export, texts
from terrane.streaming import filters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """The derived features, laid out on disk as a data set."""
    path = str(tmp_path_factory.mktemp("features") / "set")
    dataset.write(derived.load(spark, SF), path, promote=["highway"])
    return dataset.open_dataset(spark, path)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(map(repr, pdf.astype(object).where(pdf.notna(), None).values.tolist()))


NAMES = ["g7_compare", "g16_merged", "g18_polyform", "flagship_slow_streets", "p1_intersecting_roads", "p6_crossing_roads", "p8_overlapping", "p5_points_in_areas", "p5_points_in_relations", "p5_containing_relations", "p7_touching", "p7_touching_point",
         "p10_max_meters_areas", "p12_connected", "p16_within", "p16_disjoint", "j6_parents", "j11_flatten_chain", "s8_nested_boxes", "s5_audit", "s10_geojson", "m4_polygons", "m5_collections", "m9_area", "m9_area_relations",
         "m16_headings", "m17_repaired", "a8_cube", "x1_accessors", "x8_flags", "x12_decimals", "x13_texts", "g11_ends_with", "g22_role", "t3_accept"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(queries.SQL[name]).df())


@pytest.mark.parametrize("name", ["f6_filter", "j2_feature_nodes", "j11_flatten"])
def test_whole_tables_against_sql(spark, duck, name):
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(queries.SQL[name]).df())


def test_whole_tables_against_brute_force(spark):
    features = derived.load(spark, SF).features.filter("ftype = 1").collect()
    vertices = sorted((r.id, k, p.x, p.y) for r in features for k, p in enumerate(r.xy))
    got = queries.QUERIES["j1_way_nodes"](spark, SF).collect()
    assert sorted((r.way_id, r.seq, r.x, r.y) for r in got) == vertices and any(r.fid is None for r in got)
    boxes = [(r.fid, r.min_x, r.min_y, r.max_x, r.max_y) for r in features if r.category == "a" and "building" in r.tags]
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    got = queries.QUERIES["j12_spatial_join"](spark, SF).collect()
    assert sorted((r.left_fid, r.right_fid) for r in got) == want and len(want) > len(boxes)


def test_categories_partition(data):
    w = data.world()
    assert sum(w.select(c).count() for c in "nwar") == w.count() == w.select("*").count()
    assert w.ways().count() == w.select("w").count() + w.ways("a").count()


def test_box_prunes(spark, data):
    df = data.world().select("w[highway=primary]").within_box(Box.of_wsen(7.5, 47.3, 8.3, 47.9)).df()
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*category", plan) and re.search(r"PartitionFilters: \[.*folder#\d+ IN", plan), plan
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(min_x", plan) and "tag_highway" in plan.split("PushedFilters", 1)[1], plan


def test_spatial_invariants(data):
    box = Box.of_wsen(7.5, 47.3, 8.3, 47.9)
    a = data.world().ways("a[building]")
    shape = Shape.of_box(box)
    all_, hit = {r.fid for r in a.df().collect()}, {r.fid for r in a.intersecting(shape).df().collect()}
    assert hit | {r.fid for r in a.disjoint(shape).df().collect()} == all_ and {r.fid for r in a.within(shape).df().collect()} <= hit
    mid = (box.min_x + box.max_x) // 2
    halves = [Box(box.min_x, box.min_y, mid, box.max_y), Box(mid, box.min_y, box.max_x, box.max_y)]
    assert hit == set().union(*({r.fid for r in a.intersecting(Shape.of_box(h)).df().collect()} for h in halves))


def test_members_and_parents_agree(data):
    m = topology.members(data).select(F.col("fid").alias("child"), ids.fid(F.lit(2), F.col("rel_id")).alias("parent")).distinct()
    p = topology.parents(data).filter(ids.fid_type(F.col("parent")) == 2)
    assert m.exceptAll(p).isEmpty() and p.exceptAll(m).isEmpty() and dataset.audit(data).isEmpty()


def test_flatten_at_any_depth(spark):
    """24 relations in each other, the last of which holds a node and the first one again."""
    nested = [(k, 2, k + 1) for k in range(1, 25)] + [(25, 0, 7), (25, 2, 1)]
    data = SimpleNamespace(members=spark.createDataFrame(nested, "rel_id long, member_type int, member_id long"))
    root = spark.createDataFrame([(ids.make_fid(2, 1), 2, 1)], "fid long, ftype int, id long")
    held = sorted(r.fid for r in assembly.flatten_members(data, root).collect())
    assert held == sorted([ids.make_fid(0, 7), *(ids.make_fid(2, k) for k in range(1, 26))])


def test_boxes_at_any_depth(spark):
    """30 relations in each other: the outermost has the box of the node that the innermost holds."""
    drawn = [(0, 7, False, {}, [(5, -6)])] + [(2, k, False, {}, None) for k in range(1, 32)]
    features = spark.createDataFrame(drawn, "ftype tinyint, id long, is_area boolean, tags map<string,string>, xy array<struct<x:int,y:int>>")
    nested = [(k, 0, 2, k + 1, "") for k in range(1, 30)] + [(30, 0, 0, 7, "")]
    members = spark.createDataFrame(nested, "rel_id long, seq int, member_type tinyint, member_id long, role string")
    nodes = spark.createDataFrame([], "way_id long, seq int, node_id long, x int, y int")
    got = {r.id: (r.min_x, r.min_y, r.max_x, r.max_y) for r in dataset.complete(spark, features, nodes, members, nested=True).features.filter("ftype = 2").collect()}
    assert got == {k: (5, -6, 5, -6) for k in range(1, 31)} | {31: (None,) * 4}


def test_folders_hold_whole_boxes(spark, data, tmp_path):
    """At any zoom of the folders, what touches a box is found, whatever crosses the edges of tiles."""
    boxes = [Box.of_wsen(7.5, 47.3, 8.3, 47.9), Box.of_wsen(7.03, 47.81, 7.0301, 47.82), Box.world(), Box.of_wsen(170, 40, -170, 50)]
    want = [sorted(r.fid for r in derived.load(spark, SF).world().within_box(b).df().collect()) for b in boxes]
    for zoom in (0, 8, 12):
        dataset.write(derived.load(spark, SF), str(tmp_path / str(zoom)), zoom=zoom)
        laid = dataset.open_dataset(spark, str(tmp_path / str(zoom)))
        assert [sorted(r.fid for r in laid.world().within_box(b).df().collect()) for b in boxes] == want
        assert laid.features.select("folder").distinct().count() > (1 if zoom else 0)
    top, listed = dataset.folders(Box.world(), 12, 100)
    assert top == 3 and len(listed) == 1 + 4 + 16 + 64


def test_tiles_decide_like_shapes():
    rng = random.Random(5)
    for _ in range(12):
        at = sorted((rng.uniform(0, 6.28), rng.randint(10**6, 3 * 10**7)) for _ in range(rng.randint(3, 90)))
        shape = Shape.polygon([(90_000_000 + int(math.cos(a) * r), 650_000_000 + int(math.sin(a) * r)) for a, r in at])
        inside, outside = fast.classify(shape)
        assert inside or outside
        for sets, wanted in ((inside, True), (outside, False)):
            for number in [n for z in sets.values() for n in z]:
                left, bottom, right, top = Tile.unpack(number).bounds
                for _ in range(3):
                    x, y = rng.randint(left, right), rng.randint(bottom, top)
                    w, h = rng.randint(0, right - x), rng.randint(0, top - y)
                    box = Shape.of_box(Box(x, y, x + w, y + h)) if w and h else Shape.point(x, y)
                    assert within(box, shape) == intersects(box, shape) == wanted


def test_accept_and_hints(data):
    w = data.world()
    assert w.filter(F.lit(True), types="n").count() == w.nodes().count() and w.accept(lambda r: [False] * len(r), ["id"]).is_empty()
    with pytest.raises(Exception, match="own error"):
        w.accept(_fails, ["id"]).count()
    assert w.members_of(2001, role="inner").count() < w.members_of(2001).count() or w.members_of(2001).count() == 0


def _fails(rows):
    raise ValueError("own error")


def test_maps_have_a_limit(data):
    m = export.MapMaker()
    with pytest.raises(ValueError, match="more than 5"):
        m.add_features(data.world().nodes().df(), most=5)
    m.add_features(data.world().nodes().df(), most=1000)
    assert len(m.markers) == 160


def test_vertex_helpers(spark):
    xy = lambda *p: [{"x": a, "y": b} for a, b in p]
    rows = [(xy((0, 0), (5, 6), (0, 0), (9, 40_000), (5, 6)),), (xy((0, 0), (0, 0)),), ([],), (xy((5, 6), (5, 6)),)]
    df = spark.createDataFrame(rows, "xy array<struct<x:int,y:int>>")
    fixed, b = coordinates.repaired(F.col("xy"), F.lit(0), F.lit(0)), coordinates.bounds(F.col("xy"))
    got = df.select(fixed.alias("r"), coordinates.is_closed(F.col("xy")).alias("c"), coordinates.long_steps(F.col("xy")).alias("n"), b.alias("b")).collect()
    assert [None if r.r is None else [tuple(p) for p in r.r] for r in got] == [[(5, 6), (5, 6), (5, 6), (9, 40_000), (5, 6)], None, None, [(5, 6), (5, 6)]]
    assert [r.c for r in got] == [False, True, False, True] and [r.n for r in got] == [2, 0, 0, 0] and tuple(got[0].b) == (0, 0, 9, 40_000)


def test_text_helpers(spark):
    df = spark.createDataFrame([("Kirchäckerstraße 7",), ("  Ñandú's \"x\"\t",), ("",), (None,)], "t string")
    t = F.col("t")
    got = df.select(strings.key_of(t).alias("k"), strings.json_escaped(t).alias("j"), strings.upper_first(t).alias("u"), strings.is_ascii(t).alias("a"), strings.cleaned(t).alias("c"), strings.escaped(t).alias("e"), strings.longest_common_of(t, F.lit("an'dust")).alias("l")).collect()
    assert [r.k for r in got] == ["kirchaeckerstrasse-7", "nandu-s-x", "", None] and [r.a for r in got] == [False, False, True, False]
    assert got[1].j == "  Ñandú's \\\"x\\\"\\t" and got[1].c.endswith(" ") and got[1].e.endswith("\\t") and got[0].u.startswith("K") and [r.l for r in got] == [2, 2, 0, None]
    d = spark.createDataFrame([(x,) for x in ("1.50", "-0.0", "10", "1e5", "7.", "100.00", None)], "v string").select(tags.decimal_text(F.col("v")).alias("d")).collect()
    assert [r.d for r in d] == ["1.5", "0", "10", None, None, "100", None]
    assert texts.parse_tags('a=1, b="1", c=2.5, d=true', typed=True) == {"a": 1, "b": "1", "c": 2.5, "d": True}
    names = spark.createDataFrame([("N", 0.0), ("SW", 90.0), ("x", 1.0)], "n string, d double").select(heading.turned_by(F.col("n"), F.col("d")).alias("t"), heading.reversed_of(F.col("n")).alias("r"), heading.projected(F.lit(90.0), F.lit(2.0), F.lit(1.0), F.lit(1.0)).alias("p")).collect()
    assert [(r.t, r.r) for r in names] == [("N", "S"), ("NW", "NE"), (None, None)] and round(names[0].p.x, 9) == 3


def test_lookup_and_terminals(data):
    w = data.world()
    assert w.get(0, 1)["category"] == "n" and w.get(2, 99999) is None and w.nodes().first()["fid"] == 4 and not w.contains(123456789)
    assert w.select("n").select("w").is_empty() and w.nothing().count() == 0 and w.nodes_of(10**9).is_empty()
    assert w.nodes().bounds().contains_box(w.nodes("n[shop]").bounds()) and len(list(w.members_of(1001).nodes())) == 0


def test_relations_have_shapes(data):
    world = Shape.of_box(Box.world())
    assert data.world().relations("a").within(world).count() == 25 and data.world().relations("r").intersecting(world).count() == 30


def test_functions(spark):
    row = spark.range(1).select(tiles.hilbert(F.lit(0), F.lit(0)).alias("h"), tiles.morton(F.lit(3), F.lit(5)).alias("m"), tags.number(F.lit(" -.5x")).alias("n"), tags.number(F.lit("--2")).alias("none"), ids.fid_from_text(F.lit("way/7")).alias("f"), ids.fid_from_text(F.lit("x/7")).alias("bad")).first()
    assert (row.h, row.m, row.n, row.none, row.f, row.bad) == (0, 0b100111, -0.5, None, 29, None)
    cells = spark.range(256).select(tiles.hilbert((F.col("id") % 16).cast("int"), (F.col("id") / 16).cast("int"), 4).alias("h"), F.col("id")).orderBy("h").collect()
    at = [(r.id % 16, r.id // 16) for r in cells]
    assert [r.h for r in cells] == list(range(256)) and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(at, at[1:]))


def test_failing_predicate_surfaces(data):
    with pytest.raises(Exception, match="broken"):
        data.world().nodes().filter(F.raise_error(F.lit("broken")).isNull()).count()


def test_geojson(data):
    rows = export.to_geojson(data.world().select("w[highway=motorway]").df()).take(3)
    import json

    assert all(json.loads(r.value)["geometry"]["type"] == "LineString" for r in rows)


def test_stream(spark, data, tmp_path):
    flat = data.features.select("fid", "category", "tags", "min_x", "min_y", "max_x", "max_y")
    flat.repartition(2).write.parquet(str(tmp_path / "in"))
    live = filters.select(spark.readStream.schema(flat.schema).parquet(str(tmp_path / "in")), "w[highway=primary]")
    q = live.writeStream.format("memory").queryName("primary_roads").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("primary_roads").count() == data.world().select("w[highway=primary]").count()
