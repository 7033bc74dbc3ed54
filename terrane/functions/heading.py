"""Compass headings, and projecting from a point by bearing and distance (planar units): on Python values, and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def from_degrees(degrees: float) -> str:
    return NAMES[int((degrees % 360 + 22.5) / 45) % 8]


def degrees(name: str) -> int:
    return NAMES.index(name) * 45


def reversed_(name: str) -> str:
    return NAMES[(NAMES.index(name) + 4) % 8]


def turned(name: str, by: float) -> str:
    return from_degrees(degrees(name) + by)


def project(angle: float, distance: float, x: float = 0.0, y: float = 0.0) -> tuple[float, float]:
    r = math.radians(angle)
    return x + math.sin(r) * distance, y + math.cos(r) * distance


# The same as columns.


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees from 0 (north) clockwise to below 360, of the way from one point to another; null if they are the same."""
    dx, dy = x2.cast("double") - x1.cast("double"), y2.cast("double") - y1.cast("double")
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0)))


def name_of(degrees: Column) -> Column:
    """The nearest of the eight names."""
    at = F.floor((F.pmod(degrees, F.lit(360.0)) + 22.5) / 45).cast("int") % 8
    return F.when(degrees.isNotNull(), F.element_at(F.array(*map(F.lit, NAMES)), at + 1))


def degrees_of(name: Column) -> Column:
    """The degrees of a name; null if it is none of the eight."""
    at = F.array_position(F.array(*map(F.lit, NAMES)), name)
    return F.when(at > 0, (at - 1).cast("int") * 45)


def reversed_of(name: Column) -> Column:
    return turned_by(name, F.lit(180.0))


def turned_by(name: Column, degrees: Column) -> Column:
    return name_of(degrees_of(name) + degrees)


def projected(angle: Column, distance: Column, x: Column, y: Column) -> Column:
    """A struct of x and y (doubles): the point at a bearing and a distance."""
    r = F.radians(angle)
    return F.struct((x + F.sin(r) * distance).alias("x"), (y + F.cos(r) * distance).alias("y"))
