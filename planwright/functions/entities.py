"""Points and boxes of drawing entities, thirteen kinds, as column expressions.

An entity is a struct column of the type ``SHAPE``; what its kind doesn't use is null. Points with a null coordinate don't count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planwright.functions import geometry as G

_P = "struct<x:double,y:double>"
SHAPE = (
    f"struct<type:string,start:{_P},end:{_P},vertices:array<{_P}>,closed:boolean,position:{_P},center:{_P},radius:double,major:{_P},ratio:double,corners:array<{_P}>,"
    f"control:array<{_P}>,fit:array<{_P}>,loops:array<struct<polyline:array<{_P}>,edges:array<struct<start:{_P},end:{_P},center:{_P},control:array<{_P}>>>>>,marks:array<{_P}>,text:string,width:double>"
)
#: The longest side of an entity that counts, and a letter's width in heights.
LONGEST, LETTER = 100_000.0, 0.7
_TEXTS = ("TEXT", "MTEXT", "ATTDEF")


def _list(points: Column) -> Column:
    return F.filter(F.coalesce(points, F.array().cast(f"array<{_P}>")), lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())


def _some(*points: Column) -> Column:
    return _list(F.array(*points))


def _both(*lists: Column) -> Column:
    return F.concat(*map(_list, lists))


def _middle(a: Column, b: Column) -> Column:
    return G.point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)


def _middles(points: Column, closed: Column) -> Column:
    """Of neighbours, and of the last and the first where the line is closed."""
    n = F.size(points)
    between = F.when(n > 1, F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), _middle))
    around = F.when((n > 1) & F.coalesce(closed, F.lit(False)), F.array(_middle(F.try_element_at(points, F.lit(-1)), F.try_element_at(points, F.lit(1)))))
    return _both(between, around)


def _hatch(e: Column) -> Column:
    edge = lambda d: F.concat(_some(d["start"], d["end"], d["center"]), _list(d["control"]))
    empty = F.array().cast(f"array<{_P}>")
    loop = lambda c: F.concat(_list(c["polyline"]), F.flatten(F.transform(F.coalesce(c["edges"], F.slice(e["loops"][0]["edges"], 1, 0)), edge)))
    return F.coalesce(F.flatten(F.transform(e["loops"], lambda c: F.coalesce(loop(c), _list(c["polyline"])))), empty)


def _at(e: Column) -> Column:
    return _some(F.coalesce(e["position"], e["center"], e["start"]))


def _or_place(points: Column, e: Column) -> Column:
    return F.when(F.size(points) > 0, points).otherwise(_at(e))


def _around(c: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    return G.point(c["x"] + dx, c["y"] + dy), G.point(c["x"] - dx, c["y"] - dy)


def points(e: Column, longest: float | None = LONGEST) -> Column:
    """Its representative points; none at all if they span more than ``longest`` on an axis. An unknown kind, or one without points of its own, has its place."""
    ratio = F.coalesce(e["ratio"], F.lit(1.0))
    ellipse = _some(e["center"], *_around(e["center"], e["major"]["x"], e["major"]["y"]), *_around(e["center"], -e["major"]["y"] * ratio, e["major"]["x"] * ratio))
    kind = e["type"]
    own = (
        F.when(kind == "LINE", F.when(e["start"].isNotNull() & e["end"].isNotNull(), _some(e["start"], e["end"])).otherwise(_some(F.lit(None).cast(_P))))
        .when(kind.isin("LWPOLYLINE", "POLYLINE"), _list(e["vertices"]))
        .when(kind == "SOLID", _list(e["corners"]))
        .when(kind == "ELLIPSE", F.when(e["major"].isNotNull(), ellipse).otherwise(_some(F.lit(None).cast(_P))))
        .when(kind == "SPLINE", _both(e["control"], e["fit"]))
        .when(kind == "HATCH", _hatch(e))
        .when(kind == "DIMENSION", _list(e["marks"]))
        .otherwise(_at(e))
    )
    return _within(_or_place(own, e), longest)


def dense_points(e: Column) -> Column:
    """Points with the middles of straight pieces and the ends of a circle's axes; whatever they span."""
    kind, c, r = e["type"], e["center"], e["radius"]
    circle = F.concat(_at(e), F.when(r.isNotNull(), _some(*_around(c, r, F.lit(0.0)), *_around(c, F.lit(0.0), r))).otherwise(_some(F.lit(None).cast(_P))))
    line = F.when(e["start"].isNotNull() & e["end"].isNotNull(), _some(e["start"], e["end"], _middle(e["start"], e["end"]))).otherwise(_some(F.lit(None).cast(_P)))
    own = (
        F.when(kind == "LINE", line)
        .when(kind.isin("LWPOLYLINE", "POLYLINE"), F.concat(_list(e["vertices"]), _middles(_list(e["vertices"]), e["closed"])))
        .when(kind == "CIRCLE", circle)
        .when(kind == "ELLIPSE", F.concat(_at(e), F.when(e["major"].isNotNull(), _some(*_around(c, e["major"]["x"], e["major"]["y"]))).otherwise(_some(F.lit(None).cast(_P)))))
        .when(kind == "SOLID", _list(e["corners"]))
        .when(kind == "SPLINE", _both(e["control"], e["fit"]))
        .when(kind == "HATCH", _hatch(e))
        .when(kind == "DIMENSION", _list(e["marks"]))
        .otherwise(_at(e))
    )
    return _or_place(own, e)


def _within(points_: Column, longest: float | None) -> Column:
    if longest is None:
        return points_
    b = G.ring_box(points_)
    wide = (b["max_x"] - b["min_x"] > longest) | (b["max_y"] - b["min_y"] > longest)
    return F.when(F.coalesce(wide, F.lit(False)), F.filter(points_, lambda p: F.lit(False))).otherwise(points_)


def box(e: Column) -> Column:
    """The box for searches: of circles by their radius, of texts by their width (null or 0: a letter is 0.7 heights wide; ``radius`` is the height), of the rest by their points. Null without any."""
    kind, c, r = e["type"], e["center"], F.coalesce(e["radius"], F.lit(0.0))
    at = F.coalesce(e["start"], e["position"])
    letters = F.char_length(F.coalesce(e["text"], F.lit(""))) * r * LETTER
    wide = F.when(F.coalesce(e["width"], F.lit(0.0)) != 0, e["width"]).otherwise(letters)
    found = points(e, None)
    return (
        F.when((kind == "CIRCLE") & c.isNotNull(), G.box(c["x"] - r, c["y"] - r, c["x"] + r, c["y"] + r))
        .when(kind.isin(*_TEXTS) & at.isNotNull(), G.box(at["x"], at["y"], at["x"] + wide, at["y"] + r))
        .when(F.size(found) > 0, G.ring_box(found))
    )
