"""Features derived from a star schema of parquet tables, by integer arithmetic on their keys.

Depots (suppliers) and shops (customers) are nodes, orders are roads through the depots of their items, parts are rectangular
buildings, nations and regions are relations, and every brand is a multipolygon of its parts' rectangles. In large tables ids of roads, buildings and
the ways of multipolygons overlap; each kind is a layer of its own, and members name theirs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import mercator as M
from terrane.functions.ids import NODE, RELATION, WAY

from .dataset import Dataset, complete


def _tags(**tags: Column) -> Column:
    """A map of the tags that aren't null."""
    pairs = F.array(*[F.struct(F.lit(k.replace("__", ":")).alias("k"), v.cast("string").alias("v")) for k, v in tags.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p.v.isNotNull()))


def _spot(k: Column, a: int, b: int, c: int, d: int) -> tuple[Column, Column]:
    lon = F.lit(7.0) + ((k * a + c) % 20000) / F.lit(10000.0)
    lat = F.lit(47.0) + ((k * b + d) % 15000) / F.lit(10000.0)
    return M.x_from_lon(lon), M.y_from_lat(lat)


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def _rows(df: DataFrame, layer: str, ftype: int, is_area: bool, id_: Column, tags: Column, xy: Column) -> DataFrame:
    return df.select(F.lit(layer).alias("layer"), F.lit(ftype).cast("tinyint").alias("ftype"), id_.cast("long").alias("id"), F.lit(is_area).alias("is_area"), tags.alias("tags"), xy.alias("xy"))


_POINTS = "array<struct<x:int,y:int>>"


_PLANS: dict = {}


def load(spark: SparkSession, sf_dir: str) -> Dataset:
    """The feature tables; lazy, nothing is read here but schemas. The plan (not the data) is kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANS:
        _PLANS.clear()
        _PLANS[key] = _plan(spark, sf_dir)
    return _PLANS[key]


def _plan(spark: SparkSession, sf_dir: str) -> Dataset:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sup, cust, part = t("supplier"), t("customer"), t("part")
    k = F.col("s_suppkey")
    x, y = _spot(k, 7919, 104729, 0, 0)
    depots = sup.select((k + 1).alias("node_id"), x.alias("x"), y.alias("y"), "s_suppkey", "s_name", "s_nationkey")
    depot_rows = _rows(depots, "depot", NODE, False, F.col("node_id"), _tags(amenity=F.lit("depot"), name=F.col("s_name")), F.array(_point(F.col("x"), F.col("y"))))
    k = F.col("c_custkey")
    x, y = _spot(k, 7919, 104729, 0, 0)
    wheelchair = F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no")
    shop_rows = _rows(cust, "shop", NODE, False, k + 1000001, _tags(shop=F.lower("c_mktsegment"), name=F.col("c_name"), wheelchair=wheelchair), F.array(_point(x, y)))

    # roads
    items = t("lineitem").join(depots, F.col("l_suppkey") == F.col("s_suppkey"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    w = Window.partitionBy("way_id")
    vertices = items.withColumn("way_id", F.col("l_orderkey") + 1).select("way_id", (F.row_number().over(w.orderBy(*order)) - 1).alias("seq"), "node_id", "x", "y", (F.min("l_suppkey").over(w) < F.max("l_suppkey").over(w)).alias("moves"))
    road_nodes = vertices.filter("moves").select("way_id", "seq", "node_id", "x", "y")
    lines = road_nodes.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v.x.alias("x"), v.y.alias("y"))).alias("xy"))
    o = F.col("o_orderkey")
    pick = lambda n, *values: reduce(lambda c, v: c.when(n == v[0], v[1]), values[1:], F.when(n == values[0][0], values[0][1]))
    highway = pick(F.substring("o_orderpriority", 1, 1), ("1", "motorway"), ("2", "primary"), ("3", "secondary"), ("4", "residential"), ("5", "no"))
    maxspeed = pick(o % 6, (0, "30"), (1, "50 mph"), (2, "83.13"), (3, "none"), (4, "130"))
    bridge = pick(o % 7, (0, "yes"), (1, "no"))
    roads = t("orders").join(lines, o + 1 == F.col("way_id"))
    road_rows = _rows(roads, "road", WAY, False, F.col("way_id"), _tags(highway=highway, maxspeed=maxspeed, bridge=bridge), F.col("xy"))

    # buildings
    k = F.col("p_partkey")
    x, y = _spot(k, 7907, 104723, 137, 61)
    half = F.col("p_size") * 20000
    box = part.select("p_partkey", "p_brand", "p_name", "p_size", (x - half).alias("x1"), (y - half).alias("y1"), (x + half).alias("x2"), (y + half).alias("y2"), x.alias("cx"), y.alias("cy"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ring = F.array(_point(x1, y1), _point(x2, y1), _point(x2, y2), _point(x1, y2), _point(x1, y1))
    building_rows = _rows(box, "building", WAY, True, k + 1000001, _tags(building=F.lit("yes"), brand=F.col("p_brand"), building__levels=F.col("p_size"), name=F.col("p_name")), ring)

    # the ways of multipolygons
    no_tags = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    halves = [
        _rows(box, "half", WAY, False, k * 2 + 2000001, no_tags, F.array(_point(x1, y1), _point(x2, y1), _point(x2, y2))),
        _rows(box, "half", WAY, False, k * 2 + 2000002, no_tags, F.array(_point(x2, y2), _point(x1, y2), _point(x1, y1))),
    ]
    q, cx, cy = F.col("p_size") * 10000, F.col("cx"), F.col("cy")
    holes = box.filter("p_size >= 40")
    hole_ring = F.array(_point(cx - q, cy - q), _point(cx + q, cy - q), _point(cx + q, cy + q), _point(cx - q, cy + q), _point(cx - q, cy - q))
    hole_rows = _rows(holes, "hole", WAY, False, k + 3000001, no_tags, hole_ring)

    # relations and members
    nation, region = t("nation"), t("region")
    brand_id = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long") + 2000
    none = F.lit(None).cast(_POINTS)
    relation_rows = [
        _rows(nation, "nation", RELATION, False, F.col("n_nationkey") + 1, _tags(type=F.lit("collection"), name=F.col("n_name")), none),
        _rows(region, "region", RELATION, False, F.col("r_regionkey") + 1001, _tags(type=F.lit("collection"), name=F.col("r_name")), none),
        _rows(part.select("p_brand").distinct(), "brand", RELATION, True, brand_id, _tags(type=F.lit("multipolygon"), brand=F.col("p_brand")), none),
    ]
    member = lambda df, rel, layer, kind, id_, role: df.select(rel.cast("long").alias("rel_id"), F.lit(layer).alias("layer"), F.lit(kind).cast("tinyint").alias("member_type"), id_.cast("long").alias("member_id"), F.lit(role).alias("role"))
    members = [
        member(sup, F.col("s_nationkey") + 1, "depot", NODE, F.col("s_suppkey") + 1, "depot"),
        member(cust, F.col("c_nationkey") + 1, "shop", NODE, F.col("c_custkey") + 1000001, ""),
        member(nation, F.col("n_regionkey") + 1001, "nation", RELATION, F.col("n_nationkey") + 1, "subarea"),
        member(part, brand_id, "half", WAY, k * 2 + 2000001, "outer"),
        member(part, brand_id, "half", WAY, k * 2 + 2000002, "outer"),
        member(part.filter("p_size >= 40"), brand_id, "hole", WAY, k + 3000001, "inner"),
    ]
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    members = union(members)
    w = Window.partitionBy("rel_id").orderBy("role", "member_type", "member_id")
    members = members.select("rel_id", (F.row_number().over(w) - 1).alias("seq"), "layer", "member_type", "member_id", "role")
    drawn = union([building_rows, *halves, hole_rows])
    way_nodes = drawn.select(F.col("id").alias("way_id"), F.posexplode("xy").alias("seq", "p")).select("way_id", "seq", F.lit(None).cast("long").alias("node_id"), "p.x", "p.y")
    features = union([depot_rows, shop_rows, road_rows, drawn, *relation_rows])
    return complete(spark, features, road_nodes.unionByName(way_nodes), members, nested=True, held=union([depot_rows, shop_rows, *halves, hole_rows]))
