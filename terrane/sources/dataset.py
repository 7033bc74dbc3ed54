"""A data set: three tables.

    features(fid, layer, ftype, id, category, is_area, tags, x, y, min_x, min_y, max_x, max_y, xy, tile)
    way_nodes(way_id, seq, node_id, x, y, xy_key)
    members(rel_id, seq, layer, member_type, member_id, role)

Ids are those of a layer: features of several layers can have the same one. A member is the feature of its own layer; without layers, all are "".

On disk, features are partitioned by category and by the smallest tile (up to a zoom level) that holds their whole box, and sorted along a Hilbert
curve. What touches a box is in the tiles that touch the box, so boxes become partition filters as well as pushed comparisons;
keys that queries ask for often can be kept as columns of their own, whose predicates reach the scan (predicates on map entries
don't).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import ids, tiles
from terrane.functions.box import Box

from .lineage import cut, ensure_checkpoint_dir

#: The highest zoom of tiles that are folders.
FOLDER_ZOOM = 6
#: Folder tiles that a partition filter lists at most; larger boxes leave the highest zooms out, all of whose tiles are then read.
MOST_FOLDERS = 2_000
PROMOTED = "tag_"


@dataclass(frozen=True)
class Dataset:
    spark: SparkSession
    features: DataFrame
    way_nodes: DataFrame
    members: DataFrame
    #: the highest zoom of the folders of ``features``; None: there are none
    folder_zoom: int | None = None
    #: the nodes and ways among which all members are, if they are fewer than ``features``
    held: DataFrame | None = None

    def touching(self, box: Box) -> Column:
        """Features whose box touches ``box``: four comparisons, and folders where there are any."""
        if self.folder_zoom is None:
            return box.overlaps()
        return box.overlaps() & folder_filter(box, self.folder_zoom)

    def tag(self, key: str) -> Column:
        """The value of a key, from its own column if it has one."""
        name = PROMOTED + key
        return F.col(f"`{name}`") if name in self.features.columns else F.try_element_at("tags", F.lit(key))

    def world(self):
        from terrane.plans.view import View

        return View(self)


def nested_relations(child: DataFrame) -> DataFrame:
    """(above, below), ids of relations that hold others directly or through others, at any depth, each pair once. ``child``: (rel_id, child). A
    relation that holds itself through others is a pair, too.

    Pairs are joined with pairs, so that the depth that is covered doubles with each round, until a round finds none; relations of relations are
    few. Every round but the last is kept in the checkpoint folder."""
    every = child.filter(ids.fid_type(F.col("child")) == ids.RELATION).select(F.col("rel_id").alias("above"), ids.fid_id(F.col("child")).alias("below")).distinct()
    while True:
        further = every.select(F.col("above").alias("below"), F.col("below").alias("next"))
        found = every.join(further, "below").select("above", F.col("next").alias("below")).distinct().join(every, ["above", "below"], "left_anti")
        if found.isEmpty():
            return every
        every = cut(every.unionByName(found))


def _layered(df: DataFrame) -> DataFrame:
    return df if "layer" in df.columns else df.withColumn("layer", F.lit(""))


def complete(spark: SparkSession, features: DataFrame, way_nodes: DataFrame, members: DataFrame, nested: bool = False, held: DataFrame | None = None) -> Dataset:
    """Add what follows from the rest: ids, categories, boxes (of relations: of all their members), centres, tiles.

    features: ftype, id, is_area, tags, xy (null for relations). ``nested``: relations can be members of relations. Features and members both have
    a layer, or neither has. ``held``: the features among which all members that aren't relations are, if it is known that others aren't members."""
    boxes_of = lambda df: _layered(df).withColumn("fid", ids.fid(F.col("ftype"), F.col("id"))).withColumns({"min_x": F.array_min("xy.x"), "min_y": F.array_min("xy.y"), "max_x": F.array_max("xy.x"), "max_y": F.array_max("xy.y")})
    boxed, members = boxes_of(features), _layered(members)
    drawn = boxed.filter("ftype < 2")
    child = members.withColumn("child", ids.fid(F.col("member_type"), F.col("member_id"))).select("rel_id", "layer", "child")
    edges = ["min_x", "min_y", "max_x", "max_y"]
    fold = [F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")]
    among = drawn if held is None else boxes_of(held).filter("ftype < 2")
    boxes = child.join(among.select("layer", F.col("fid").alias("child"), *edges), ["layer", "child"]).groupBy("rel_id").agg(*fold)
    if nested:
        held = nested_relations(child)
        boxes = boxes.unionByName(held.join(boxes, F.col("below") == F.col("rel_id")).drop("rel_id", "below").withColumnRenamed("above", "rel_id")).groupBy("rel_id").agg(*fold)
    rel = boxed.filter("ftype = 2").drop(*edges).join(boxes, F.col("id") == F.col("rel_id"), "left").drop("rel_id")
    both = drawn.unionByName(rel)
    category = F.when(F.col("is_area"), "a").otherwise(F.element_at(F.array(F.lit("n"), F.lit("w"), F.lit("r")), F.col("ftype") + 1))
    both = both.withColumns({"category": category, "x": F.expr("cast((cast(min_x as bigint) + max_x) div 2 as int)"), "y": F.expr("cast((cast(min_y as bigint) + max_y) div 2 as int)")})
    both = both.withColumn("tile", tiles.tile_at(F.col("x"), F.col("y")))
    cols = ["fid", "layer", "ftype", "id", "category", "is_area", "tags", "x", "y", *edges, "xy", "tile"]
    return Dataset(spark, both.select(*cols), way_nodes.withColumn("seq", F.col("seq").cast("int")).withColumn("xy_key", ids.pack_xy(F.col("x"), F.col("y"))), members.withColumn("seq", F.col("seq").cast("int")), held=None if held is None else among)


def pooled(rows: DataFrame) -> DataFrame:
    """``rows`` with, for each, the vertices of all rows of its fid: what several rows draw under one id belongs to one feature."""
    return rows.withColumn("xy", F.flatten(F.array_sort(F.collect_list("xy").over(Window.partitionBy("fid")))))


def folder_of(zoom: int) -> Column:
    """The smallest tile, up to a zoom level, that holds a row's whole box; null without a box."""
    corner = lambda z: (tiles.tile_at(F.col("min_x"), F.col("max_y"), z), tiles.tile_at(F.col("max_x"), F.col("min_y"), z))
    return F.coalesce(*[F.when(a == b, a) for a, b in map(corner, range(zoom, -1, -1))])


def folders(box: Box, zoom: int, most: int = MOST_FOLDERS) -> tuple[int, list[int]]:
    """(highest zoom that is listed, the tiles of all zooms up to it that touch a box)."""
    out, top = [], -1
    for z in range(zoom + 1):
        here = {int(t) for p in box.parts() for t in tiles.covering(p.min_x, p.min_y, p.max_x, p.max_y, z)} if tiles.covering_size(box, z) <= most - len(out) else None
        if here is None:
            break
        out, top = out + sorted(here), z
    return top, out


def folder_filter(box: Box, zoom: int) -> Column:
    """A partition filter for what can touch a box. The zoom is in the upper bits of a tile, so zooms that aren't listed are a range."""
    top, listed = folders(box, zoom)
    folder = F.col("folder")
    return folder.isin(listed) if top == zoom else folder.isin(listed) | (folder >= (top + 1) << 24)


def write(data: Dataset, path: str, promote: Sequence[str] = (), partitions: int | None = None, mode: str = "error", zoom: int = FOLDER_ZOOM) -> None:
    """Lay a data set out: one range partition of the Hilbert curve after another. ``zoom``: the highest of the folders' tiles."""
    n = partitions or int(data.spark.conf.get("spark.sql.shuffle.partitions"))
    f = data.features.drop("folder").withColumns({PROMOTED + k: F.try_element_at("tags", F.lit(k)) for k in promote})
    curve = tiles.hilbert(F.col("tile").bitwiseAND(F.lit(4095)), F.shiftright("tile", 12).bitwiseAND(F.lit(4095)))
    f = f.withColumn("hilbert", curve).withColumn("folder", folder_of(zoom))
    f.repartitionByRange(n, "category", "folder", "hilbert").sortWithinPartitions("category", "folder", "hilbert").write.mode(mode).partitionBy("category", "folder").parquet(f"{path}/features")
    data.way_nodes.repartitionByRange(n, "xy_key").sortWithinPartitions("xy_key").write.mode(mode).parquet(f"{path}/way_nodes")
    data.members.write.mode(mode).parquet(f"{path}/members")
    data.spark.range(1).select(F.lit(zoom).alias("folder_zoom")).coalesce(1).write.mode(mode).parquet(f"{path}/layout")


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    """What ``write`` has laid out, from any file system that Spark reads."""
    zoom = spark.read.parquet(f"{path}/layout").first()["folder_zoom"]
    return Dataset(spark, _layered(spark.read.parquet(f"{path}/features")), spark.read.parquet(f"{path}/way_nodes"), _layered(spark.read.parquet(f"{path}/members")), zoom)


def audit(data: Dataset) -> DataFrame:
    """(problem, fid): members and way nodes that refer to nothing, and nodes that aren't where ways have them. A way is missing if it has a vertex that no
    way of its id has in that place: another one of the same id doesn't stand for it."""
    f = data.features.select("fid")
    lost = lambda df, name: df.join(f, "fid", "left_anti").select(F.lit(name).alias("problem"), "fid").distinct()
    at = data.way_nodes.filter("node_id is not null").select(ids.fid(F.lit(ids.NODE), F.col("node_id")).alias("fid"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    moved = at.join(data.features.filter("ftype = 0").select("fid", "x", "y"), "fid").filter("x <> vx or y <> vy").select(F.lit("moved node").alias("problem"), "fid").distinct()
    drawn = data.features.filter("ftype = 1").select("fid", "xy")
    ways = data.way_nodes.select(ids.fid(F.lit(ids.WAY), F.col("way_id")).alias("way"), "seq", "x", "y")
    there = (F.col("way") == F.col("fid")) & (F.get("xy", F.col("seq")).x == F.col("x")) & (F.get("xy", F.col("seq")).y == F.col("y"))
    gone = ways.join(drawn, there, "left_anti").select(F.lit("missing way").alias("problem"), F.col("way").alias("fid")).distinct()
    return (
        lost(data.members.select(ids.fid(F.col("member_type"), F.col("member_id")).alias("fid")), "missing member")
        .unionByName(lost(data.members.select(ids.fid(F.lit(ids.RELATION), F.col("rel_id")).alias("fid")), "missing relation"))
        .unionByName(lost(at.select("fid"), "missing node"))
        .unionByName(gone)
        .unionByName(moved)
    )


_LAID_OUT: dict = {}


def _layout_key(data: Dataset, name: str, promote: Sequence[str], zoom: int) -> tuple:
    sc = data.spark.sparkContext
    return sc.applicationId, id(data.spark), sc.getCheckpointDir(), name, tuple(promote), zoom


def laid_out_already(data: Dataset, name: str, promote: Sequence[str] = (), zoom: int = FOLDER_ZOOM) -> Dataset:
    """What ``laid_out`` has written in this session, else ``data`` itself: for what reads whole kinds of features once, for which a layout of all of
    them isn't worth its time."""
    return _LAID_OUT.get(_layout_key(data, name, promote, zoom), data)


def laid_out(data: Dataset, name: str, promote: Sequence[str] = (), zoom: int = FOLDER_ZOOM) -> Dataset:
    """``data`` written into the checkpoint folder and opened from there; once in a session for each name."""
    ensure_checkpoint_dir(data.spark)
    key = _layout_key(data, name, promote, zoom)
    if key not in _LAID_OUT:
        path = f"{data.spark.sparkContext.getCheckpointDir()}/layout-{uuid.uuid4().hex}"
        write(data, path, promote, zoom=zoom)
        _LAID_OUT[key] = open_dataset(data.spark, path)
    return _LAID_OUT[key]
