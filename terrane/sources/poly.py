"""Polygon files: a name, then rings (a name, ``x y`` lines, END), then END; rings whose names start with ``!`` are holes."""

from __future__ import annotations

from collections.abc import Callable

from terrane.functions import mercator as M
from terrane.functions.shapes import Shape


class PolyError(ValueError):
    def __init__(self, line: int, message: str):
        super().__init__(f"line {line}: {message}")


def identity(x: float, y: float) -> tuple[float, float]:
    return x, y


def to_units(lon: float, lat: float) -> tuple[int, int]:
    """Degrees in a file as coordinates."""
    return M.lon_to_x(lon), M.lat_to_y(lat)


def to_degrees(digits: int = 9) -> Callable[[float, float], tuple]:
    """Coordinates as degrees in a file, rounded to so many digits (nine lead back to the same place)."""
    return lambda x, y: (round(M.x_to_lon(x), digits), round(M.y_to_lat(y), digits))


def _whole(v: float) -> float:
    return int(v) if v == int(v) else v


def read_poly(text: str, transform: Callable[[float, float], tuple] = identity) -> Shape:
    """Rings are closed if they aren't; each hole goes to the shell that holds its first vertex. A number that can't be read is an
    error, as is a ring of fewer than three points."""
    lines = text.splitlines()
    shells, holes, i = [], [], 1  # the first line is the file's name
    while True:
        while i < len(lines) and not lines[i].strip():
            i += 1
        if i >= len(lines):
            raise PolyError(i + 1, "END expected")
        name = lines[i].strip()
        if name == "END":
            break
        ring, i = [], i + 1
        while i < len(lines) and lines[i].strip() != "END":
            words = lines[i].split()
            if words:
                try:
                    x, y = map(float, words)
                except ValueError:
                    raise PolyError(i + 1, f"two numbers expected: {lines[i].strip()!r}") from None
                ring.append(tuple(map(_whole, transform(x, y))))
            i += 1
        if i >= len(lines):
            raise PolyError(i + 1, f"END of ring {name} expected")
        i += 1
        if ring and ring[0] != ring[-1]:
            ring.append(ring[0])
        if len(ring) < 4:
            raise PolyError(i, f"ring {name} has fewer than three points")
        (holes if name.startswith("!") else shells).append(tuple(ring))
    polygons = [[s] for s in shells]
    for hole in holes:
        home = next((p for p in polygons if Shape(polygons=((p[0],),)).located.at(hole[0]) < 2), None)
        if home is None:
            raise PolyError(len(lines), "a hole lies in no ring")
        home.append(hole)
    return Shape(polygons=tuple(map(tuple, polygons)))


def write_poly(shape: Shape, name: str = "polygon", transform: Callable[[float, float], tuple] = identity) -> str:
    """The text of a polygon file; rings are called area, area2, ... and !hole, !hole2, ..."""
    out, count = [name], {"area": 0, "!hole": 0}
    for poly in shape.polygons:
        for k, ring in enumerate(poly):
            kind = "!hole" if k else "area"
            count[kind] += 1
            out.append(kind + (str(count[kind]) if count[kind] > 1 else ""))
            out += ["   {!r} {!r}".format(*transform(x, y)) for x, y in ring]
            out.append("END")
    return "\n".join([*out, "END", ""])
