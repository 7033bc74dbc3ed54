"""Results as GeoJSON rows and as HTML maps."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import mercator as M
from terrane.functions.box import Box
from terrane.functions.shapes import Shape


def geometry_json(xy: Column, ftype: Column, is_area: Column, digits: int = 7) -> Column:
    """The GeoJSON geometry of a node or a way."""
    spots = F.transform(xy, lambda p: F.array(F.round(M.lon_from_x(p.x), digits), F.round(M.lat_from_y(p.y), digits)))
    text = F.to_json(spots)
    return (
        F.when(ftype == 0, F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(F.get(spots, F.lit(0))), F.lit("}")))
        .when(is_area, F.concat(F.lit('{"type":"Polygon","coordinates":['), text, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"type":"LineString","coordinates":'), text, F.lit("}")))
    )


def to_geojson(rows: DataFrame) -> DataFrame:
    """(value) one GeoJSON feature per node or way: ``df.write.text`` gives newline-delimited GeoJSON."""
    geometry = geometry_json(F.col("xy"), F.col("ftype"), F.col("is_area"))
    return rows.filter("ftype < 2").select(F.concat(F.lit('{"type":"Feature","id":'), F.col("fid").cast("string"), F.lit(',"properties":'), F.to_json("tags"), F.lit(',"geometry":'), geometry, F.lit("}")).alias("value"))


def _lonlat(p) -> list[float]:
    return [round(M.y_to_lat(p[1]), 7), round(M.x_to_lon(p[0]), 7)]


@dataclass
class Marker:
    shape: Shape
    tooltip: str | None = None
    url: str | None = None
    options: dict = field(default_factory=dict)

    def script(self) -> str:
        opts = json.dumps(self.options)
        out = [f"L.circleMarker({json.dumps(_lonlat(p))},{opts})" for p in self.shape.points]
        out += [f"L.polyline({json.dumps([_lonlat(p) for p in line])},{opts})" for line in self.shape.lines]
        out += [f"L.polygon({json.dumps([[_lonlat(p) for p in ring] for ring in poly])},{opts})" for poly in self.shape.polygons]
        tail = f".bindTooltip({_literal(self.tooltip)})" if self.tooltip else ""
        tail += f".on('click',()=>window.open({_literal(self.url)}))" if self.url else ""
        return "\n".join(f"{x}{tail}.addTo(map);" for x in out)


def _literal(value) -> str:
    """A JavaScript literal that can't end a script element."""
    return json.dumps(value).replace("</", "<\\/")


class MapMaker:
    """A page with a Leaflet map of shapes and boxes, fitted to what is on it."""

    def __init__(self, title: str = "Map", tiles: str = "https://tile.openstreetmap.org/{z}/{x}/{y}.png"):
        self.title, self.tiles, self.markers = title, tiles, []

    def add(self, item: Shape | Box, tooltip: str | None = None, url: str | None = None, color: str | None = None, **options) -> Marker:
        shape = Shape.of_box(item) if isinstance(item, Box) else item
        self.markers.append(m := Marker(shape, tooltip, url, ({"color": color} if color else {}) | options))
        return m

    def add_features(self, rows: DataFrame, most: int = 10_000, **options) -> None:
        """Nodes and ways of a result that is small enough to be looked at; more than ``most`` are an error."""
        found = rows.filter("ftype < 2").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} features for a map; narrow the query or raise the limit")
        for r in found:
            pts = [(p["x"], p["y"]) for p in r["xy"]]
            shape = Shape.point(*pts[0]) if r["ftype"] == 0 else Shape.polygon(pts) if r["is_area"] else Shape.line(*pts)
            self.add(shape, html.escape(r["tags"].get("name", "")) or None, **options)

    def html(self) -> str:
        bounds = Box.empty()
        for m in self.markers:
            bounds = bounds.union(m.shape.bounds)
        fit = "map.setView([0,0],1);" if bounds.is_empty else f"map.fitBounds([{_lonlat((bounds.min_x, bounds.min_y))},{_lonlat((bounds.max_x, bounds.max_y))}]);"
        body = "\n".join(m.script() for m in self.markers)
        return f"""<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{html.escape(self.title)}</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet/dist/leaflet.css"><script src="https://unpkg.com/leaflet/dist/leaflet.js"></script>
<style>html,body,#map{{height:100%;margin:0}}</style></head><body><div id="map"></div><script>
const map=L.map('map');L.tileLayer({_literal(self.tiles)}).addTo(map);
{body}
{fit}
</script></body></html>
"""
