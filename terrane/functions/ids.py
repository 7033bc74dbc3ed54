"""Typed feature ids, packed coordinates and type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE, WAY, RELATION = 0, 1, 2
TYPE_NAMES = ("node", "way", "relation")


def fid(ftype: Column, id_: Column) -> Column:
    return F.shiftleft(id_.cast("long"), 2).bitwiseOR(ftype.cast("long"))


def fid_type(f: Column) -> Column:
    return f.bitwiseAND(F.lit(3)).cast("int")


def fid_id(f: Column) -> Column:
    return F.shiftright(f, 2)


def fid_text(f: Column) -> Column:
    """``node/123``"""
    return F.concat(type_name(fid_type(f)), F.lit("/"), fid_id(f).cast("string"))


def fid_from_text(s: Column) -> Column:
    kind = F.array_position(F.array(*map(F.lit, TYPE_NAMES)), F.regexp_extract(s, r"^(node|way|relation)/([0-9]+)$", 1)) - 1
    return F.when(kind >= 0, fid(kind, F.regexp_extract(s, r"^(node|way|relation)/([0-9]+)$", 2).try_cast("long")))


def type_name(ftype: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPE_NAMES)), (ftype + 1).cast("int"))


def pack_xy(x: Column, y: Column) -> Column:
    return F.shiftleft(y.cast("long"), 32).bitwiseOR(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def packed_x(p: Column) -> Column:
    return F.shiftright(F.shiftleft(p, 32), 32).cast("int")


def packed_y(p: Column) -> Column:
    return F.shiftright(p, 32).cast("int")


def pack(x: int, y: int) -> int:
    return (y << 32) | (x & 0xFFFFFFFF)


def make_fid(ftype: int, id_: int) -> int:
    return id_ << 2 | ftype
