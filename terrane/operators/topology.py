"""Topology as joins over whole tables: nodes of ways, members, parents, shared vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import ids
from terrane.sources.dataset import Dataset

from .assembly import flatten_members


def way_nodes(data: Dataset, ways: DataFrame | None = None) -> DataFrame:
    """(way_id, seq, fid, x, y) of every vertex in order; fid is null for a vertex that isn't a feature."""
    rows = data.way_nodes if ways is None else data.way_nodes.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi")
    return rows.select("way_id", "seq", F.when(F.col("node_id").isNotNull(), ids.fid(F.lit(ids.NODE), F.col("node_id"))).alias("fid"), "x", "y")


def feature_nodes(data: Dataset, nodes: DataFrame) -> DataFrame:
    """(way_id, seq, fid): vertices that are features of ``nodes``."""
    return way_nodes(data).filter("fid is not null").join(nodes.select("fid"), "fid").select("way_id", "seq", "fid")


def members(data: Dataset, rows: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """(rel_id, seq, role, fid) of members that are features (of ``rows``); with ``role``, of those that have it. A member is one row, however many
    features have its id."""
    m = data.members.select("rel_id", "seq", "role", ids.fid(F.col("member_type"), F.col("member_id")).alias("fid"))
    m = m if role is None else m.filter(F.col("role") == role)
    return m.join((data.features if rows is None else rows).select("fid"), "fid", "left_semi").select("rel_id", "seq", "role", "fid")


def with_flags(data: Dataset, rows: DataFrame) -> DataFrame:
    """``rows`` with type (a name) and belongs_to_relation."""
    held = data.members.select(ids.fid(F.col("member_type"), F.col("member_id")).alias("fid"), F.lit(True).alias("belongs_to_relation")).distinct()
    out = rows.join(held, "fid", "left")
    return out.withColumns({"type": ids.type_name(F.col("ftype")), "belongs_to_relation": F.coalesce("belongs_to_relation", F.lit(False))})


def parents(data: Dataset) -> DataFrame:
    """(child, parent), both fids: ways of nodes and relations of members, each once."""
    ways = data.way_nodes.filter("node_id is not null").select(ids.fid(F.lit(ids.NODE), F.col("node_id")).alias("child"), ids.fid(F.lit(ids.WAY), F.col("way_id")).alias("parent"))
    rels = data.members.select(ids.fid(F.col("member_type"), F.col("member_id")).alias("child"), ids.fid(F.lit(ids.RELATION), F.col("rel_id")).alias("parent"))
    return ways.unionByName(rels).distinct()


def ways_through(data: Dataset, x: int, y: int) -> DataFrame:
    """(way_id) of ways with a vertex at exactly (x, y)."""
    return data.way_nodes.filter(F.col("xy_key") == ids.pack(x, y)).select("way_id").distinct()


def vertices(data: Dataset, rows: DataFrame | None = None, relations: bool = True) -> DataFrame:
    """(fid, xy_key): the distinct vertices of every feature (of ``rows``); of a relation, those of all it holds. ``relations``: whether there
    can be any."""
    spots = lambda df: df.select("fid", F.explode(F.array_distinct("xy")).alias("p")).select("fid", ids.pack_xy(F.col("p.x"), F.col("p.y")).alias("xy_key"))
    rows = data.features if rows is None else rows
    if not relations:
        return spots(rows.filter("ftype < 2"))
    held = flatten_members(data, rows).join(data.features.filter("ftype < 2").select("fid", "xy"), "fid").select(F.col("root").alias("fid"), "xy")
    return spots(rows.filter("ftype < 2")).unionByName(spots(held).distinct())


def connected(data: Dataset, left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_fid, right_fid) of different features that share a vertex: an equi-join on packed coordinates."""
    v = vertices(data)
    a = v.join(left.select("fid"), "fid", "left_semi").select(F.col("fid").alias("left_fid"), "xy_key")
    b = v.join(right.select("fid"), "fid", "left_semi").select(F.col("fid").alias("right_fid"), "xy_key")
    return a.join(b, "xy_key").filter("left_fid <> right_fid").select("left_fid", "right_fid").distinct()
