"""Faces of plane linework as joins: segments are cut where they meet, half-edges find the next one around their face, and faces are the cycles.

A drawing's lines are dealt to tiles; what hangs together within one tile is found there in numpy, many tiles at once. Of the rest, lines are dealt to cells,
half-edges to their corners, and cycles are found as components; so no task holds a drawing or a face.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators import tile_faces
from planwright.operators.graph import connected_components
from planwright.operators.spatial import box_join
from planwright.staging import staged

ENDS = ("x1", "y1", "x2", "y2")
#: A tile with more lines isn't looked at as a whole; all of them are left to the joins.
IN_TILE = 200_000
#: What rows of ``tiled`` are.
FACE, OPEN, SEEN = 0, 1, 2


def _box(*columns: str) -> Column:
    return G.box(*(F.col(c) for c in columns))


def segment_box(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    return G.box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def _on(x: Column, y: Column, p: str) -> Column:
    """Whether a point lies on the segment whose columns have the prefix ``p``."""
    x1, y1, x2, y2 = (F.col(p + e) for e in ENDS)
    straight = F.abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) < 1e-9
    return straight & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))


def noded(segments: DataFrame, keys: list[str], cell: float, digits: int = 6) -> DataFrame:
    """(keys, ax, ay, bx, by): the pieces of the segments between all points where those of equal ``keys`` cross, touch or overlap; each piece once, a before b.

    Coordinates are rounded to ``digits``; segments without length and null ones are left out.
    """
    flat = segments.select(*keys, *((F.round(e, digits) + F.lit(0.0)).alias(e) for e in ENDS)).where("x1 is not null and y1 is not null and x2 is not null and y2 is not null and (x1 <> x2 or y1 <> y2)")
    turn = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    flat = flat.select(*keys, *(F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(ENDS, ("x2", "y2", "x1", "y1"), strict=True))).distinct()
    flat = staged(flat.withColumn("seg", F.monotonically_increasing_id()).withColumn("box", segment_box()), "segments")
    left = flat.select(*keys, F.col("seg").alias("i"), F.col("box").alias("ibox"), *(F.col(e).alias("i" + e) for e in ENDS))
    right = flat.select(*keys, F.col("seg").alias("j"), F.col("box").alias("jbox"), *(F.col(e).alias("j" + e) for e in ENDS))
    met = box_join(left, right, "ibox", "jbox", cell, F.col("i") < F.col("j"), keys=tuple(keys))
    ix, iy, jx, jy = (F.col(f"{p}{c}2") - F.col(f"{p}{c}1") for p in "ij" for c in "xy")
    det = ix * jy - iy * jx
    dx, dy = F.col("jx1") - F.col("ix1"), F.col("jy1") - F.col("iy1")
    t, u = (dx * jy - dy * jx) / F.when(F.abs(det) > 1e-12, det), (dx * iy - dy * ix) / F.when(F.abs(det) > 1e-12, det)
    inside = t.between(-1e-9, 1 + 1e-9) & u.between(-1e-9, 1 + 1e-9)
    at = G.point(F.round(F.col("ix1") + t * ix, digits) + 0.0, F.round(F.col("iy1") + t * iy, digits) + 0.0)
    none = F.lit(None).cast("struct<x:double,y:double>")
    cuts = [F.struct(F.col(s).alias("seg"), F.when(inside, at).otherwise(none).alias("p")) for s in "ij"]
    for own, other in ("ij", "ji"):  # of parallel ones the ends of the one that lie on the other
        for e in "12":
            x, y = F.col(f"{other}x{e}"), F.col(f"{other}y{e}")
            cuts.append(F.struct(F.col(own).alias("seg"), F.when((F.abs(det) <= 1e-12) & _on(x, y, own), G.point(x, y)).otherwise(none).alias("p")))
    found = met.select(F.explode(F.array(*cuts)).alias("c")).select("c.*").where("p is not null")
    ends = flat.select("seg", F.explode(F.array(G.point(F.col("x1"), F.col("y1")), G.point(F.col("x2"), F.col("y2")))).alias("p"))
    points = ends.unionByName(found).distinct()
    along = Window.partitionBy("seg").orderBy("p.x", "p.y")
    pieces = points.withColumn("q", F.lead("p").over(along)).where("q is not null")
    return pieces.join(flat.select("seg", *keys), "seg").select(*keys, F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by")).distinct()


def half_edges(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, face, ax, ay, bx, by): both ways along every piece, with the face on its left; a face is named by one of its half-edges.

    From the end of a half-edge the way goes on along the piece that is next to the right of the way back.
    """
    back = pieces.select(*keys, F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    half = staged(pieces.unionByName(back).withColumn("half", F.monotonically_increasing_id()), "half-edges")
    corner = Window.partitionBy(*keys, "ax", "ay").orderBy(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")))
    every = corner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # of the pieces around a corner the one before, of the first the last
    turned = half.select(*keys, F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("ox"), F.col("by").alias("oy"), F.coalesce(F.lag("half").over(corner), F.last("half").over(every)).alias("next"))
    there = reduce(Column.__and__, (half[k] == turned[k] for k in keys), (half["bx"] == turned["cx"]) & (half["by"] == turned["cy"]) & (half["ax"] == turned["ox"]) & (half["ay"] == turned["oy"]))
    steps = half.join(turned, there)
    root = connected_components(steps.select(half["half"].alias("src"), turned["next"].alias("dst")))
    return half.join(root.withColumnsRenamed({"node": "half", "component": "face"}), "half").select(*keys, "face", "ax", "ay", "bx", "by")


def face_table(half: DataFrame, keys: list[str], least: float = 0.1) -> DataFrame:
    """(keys, face, area, cx, cy, points, box): the inner faces of area ``least`` and more; outer ones run clockwise and go."""
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    sums = half.groupBy(*keys, "face").agg(
        (F.sum(cross) / 2).alias("area"), F.sum((F.col("ax") + F.col("bx")) * cross).alias("sx"), F.sum((F.col("ay") + F.col("by")) * cross).alias("sy"), F.count("*").cast("int").alias("points"),
        *(f(c).alias(n) for n, f, c in (("lx", F.min, "ax"), ("ly", F.min, "ay"), ("hx", F.max, "ax"), ("hy", F.max, "ay"))),
    )
    inner = sums.where(F.col("area") >= least)
    return inner.select(*keys, "face", "area", (F.col("sx") / (6 * F.col("area"))).alias("cx"), (F.col("sy") / (6 * F.col("area"))).alias("cy"), "points", _box("lx", "ly", "hx", "hy").alias("box"))


def bridges(pieces: DataFrame, keys: list[str], gap: float, cell: float) -> DataFrame:
    """(keys, x1, y1, x2, y2): from every loose end to the nearest point of another piece at most ``gap`` away (of equally near ones the least)."""
    ends = pieces.select(*keys, F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(pieces.select(*keys, F.col("bx").alias("x"), F.col("by").alias("y")))
    loose = ends.groupBy(*keys, "x", "y").agg(F.count("*").alias("n")).where("n = 1").withColumn("own", _box("x", "y", "x", "y"))
    lines = pieces.withColumn("box", segment_box("ax", "ay", "bx", "by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)))
    foot = G.point(F.col("ax") + t * dx, F.col("ay") + t * dy)
    other = ~(((F.col("x") == F.col("ax")) & (F.col("y") == F.col("ay"))) | ((F.col("x") == F.col("bx")) & (F.col("y") == F.col("by"))))
    met = box_join(loose.drop("n"), lines, "own", "box", cell, other, gap, tuple(keys)).withColumn("foot", foot)
    far = F.hypot(F.col("foot.x") - F.col("x"), F.col("foot.y") - F.col("y"))
    best = met.where(far <= gap).groupBy(*keys, "x", "y").agg(F.min(F.struct(far.alias("far"), "foot")).alias("m"))
    return best.select(*keys, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("m.foot.x").alias("x2"), F.col("m.foot.y").alias("y2"))


def _apart(x: Column, y: Column, p: str) -> Column:
    """Distance of a point from the segment whose columns have the prefix ``p``."""
    x1, y1, x2, y2 = (F.col(p + e) for e in ENDS)
    dx, dy = x2 - x1, y2 - y1
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / F.when(long > 0, long)))).otherwise(0.0)
    return F.hypot(x1 + t * dx - x, y1 + t * dy - y)


def votes(faces: DataFrame, half: DataFrame, lines: DataFrame, keys: list[str], near: float, cell: float) -> DataFrame:
    """(face, layer, votes): for each face the layer that most of the ``lines`` (keys, line, layer, x1, y1, x2, y2) less than ``near`` from it have; of equal ones the least.

    A line counts once for a face, whether it lies along its border or inside it. Lines without a layer don't vote.
    """
    border = half.join(faces.select("face"), "face", "left_semi").select(*keys, "face", F.col("ax").alias("fx1"), F.col("ay").alias("fy1"), F.col("bx").alias("fx2"), F.col("by").alias("fy2"))
    border = border.withColumn("fbox", segment_box("fx1", "fy1", "fx2", "fy2"))
    own = lines.where("layer is not null").select(*keys, "line", "layer", *(F.col(e).alias("l" + e) for e in ENDS)).withColumn("lbox", segment_box("lx1", "ly1", "lx2", "ly2"))
    away = F.least(*(_apart(F.col(f"lx{e}"), F.col(f"ly{e}"), "f") for e in "12"), *(_apart(F.col(f"fx{e}"), F.col(f"fy{e}"), "l") for e in "12"))
    touch = box_join(own, border, "lbox", "fbox", cell, away < near, near, tuple(keys)).select("face", "line", "layer")
    # a line that has its beginning inside: an odd number of borders lies to its right
    at = own.select(*keys, "line", "layer", F.col("lx1").alias("px"), F.col("ly1").alias("py")).withColumn("pbox", _box("px", "py", "px", "py"))
    within = box_join(at, faces.select(*keys, "face", "box"), "pbox", "box", cell, keys=tuple(keys)).select(*keys, "face", "line", "layer", "px", "py")
    crossed = within.join(border.select("face", "fx1", "fy1", "fx2", "fy2"), "face").where(((F.col("fy1") > F.col("py")) != (F.col("fy2") > F.col("py"))) & (F.col("px") < F.col("fx1") + (F.col("py") - F.col("fy1")) / (F.col("fy2") - F.col("fy1")) * (F.col("fx2") - F.col("fx1"))))
    inside = crossed.groupBy("face", "line", "layer").agg(F.count("*").alias("n")).where("n % 2 = 1").select("face", "line", "layer")
    counted = touch.unionByName(inside).distinct().groupBy("face", "layer").agg(F.count("*").alias("votes"))
    first = Window.partitionBy("face").orderBy(F.desc("votes"), "layer")
    return counted.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def tiled(lines: DataFrame, keys: list[str], cell: float, least: float, near: float = 0.0) -> DataFrame:
    """(keys, kind, area, cx, cy, points, layer, votes, line, x1 ...): the inner faces of what hangs together within one tile, and the lines that are left.

    Rows are FACE, with the layer of most lines less than ``near`` from it or inside (if ``lines`` have a line and a layer), or OPEN: lines that hang together with one that
    touches several tiles, or of a tile that is too full; or SEEN: other lines that may be near or inside a face of open ones that is narrower and lower than a tile. Each
    line is shuffled about once, and each OPEN or SEEN one may come from several tiles.
    """
    side, votes = tile_faces.TILE, "line" in lines.columns
    size = cell * side
    extra = ["line", "layer"] if votes else []
    on = lambda c: F.explode(F.sequence(F.floor((F.least(f"{c}1", f"{c}2") - near) / size), F.floor((F.greatest(f"{c}1", f"{c}2") + near) / size)))
    sound = lines.select(*keys, *extra, *ENDS).where(" and ".join(f"{e} is not null" for e in ENDS))
    dealt = sound.withColumn("_tx", on("x")).withColumn("_ty", on("y"))
    dealt = dealt.repartition(*keys, "_tx", "_ty").sortWithinPartitions(*keys, "_tx", "_ty")
    kind = {f.name: f.dataType for f in lines.schema.fields}
    found = [("kind", "int"), ("area", "double"), ("cx", "double"), ("cy", "double"), ("points", "int"), *([("votes", "long")] if votes else [])]
    schema = ", ".join([*(f"`{k}` {kind[k].simpleString()}" for k in [*keys, *extra]), *(f"{e} double" for e in ENDS), *(f"{n} {t}" for n, t in found)])
    named = [*keys, *extra, *ENDS, *(n for n, _ in found)]

    def left(rows: pa.Table, what: np.ndarray) -> pa.RecordBatch:
        own = rows.select([*keys, *extra, *ENDS]).combine_chunks()
        empty = [pa.nulls(len(own), {"int": pa.int32(), "long": pa.int64()}.get(t, pa.float64())) for _, t in found[1:]]
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in own.columns), pa.array(what, pa.int32()), *empty], named)

    def whole(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of whole tiles, each from one of ``first`` on."""
        tile = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(rows)]))
        s = np.column_stack([rows.column(e).to_numpy() for e in ENDS])
        origin = np.column_stack([rows.column(c).to_numpy()[first] for c in ("_tx", "_ty")])
        reach = tile_faces.boxes(s, near)
        crossing = (np.floor(reach[:, :2] / size) != np.floor(reach[:, 2:] / size)).any(axis=1) | (np.bincount(tile)[tile] > IN_TILE)
        flat = np.round(s, tile_faces.DIGITS) + 0.0
        turn = (flat[:, 0] > flat[:, 2]) | ((flat[:, 0] == flat[:, 2]) & (flat[:, 1] > flat[:, 3]))
        flat[turn] = flat[turn][:, [2, 3, 0, 1]]
        once, which = tile_faces._firsts(tile, *flat.T)
        beyond = np.bincount(which, crossing, len(once)) > 0
        open_, i, j = tile_faces.open_rows(tile[once], flat[once], beyond, origin, cell, side)
        long = (flat[once, :2] != flat[once, 2:]).any(axis=1)  # what has no length has no faces
        closed = np.flatnonzero(~open_ & long)
        place = np.full(len(once), -1)
        place[closed] = np.arange(len(closed))
        both = (place[i] >= 0) & (place[j] >= 0)
        faces, border, face = tile_faces.faces_of(tile[once][closed], flat[once][closed], place[i[both]], place[j[both]], least)
        n = len(faces["area"])
        columns = [rows.column(k).combine_chunks().take(pa.array(first[faces["tile"]])) for k in keys]
        if votes:
            layer, line = (rows.column(c).combine_chunks().dictionary_encode() for c in ("layer", "line"))
            names = layer.dictionary.to_pylist()
            rank = np.empty(len(names), np.int64)
            rank[sorted(range(len(names)), key=lambda k: names[k].encode() if isinstance(names[k], str) else names[k])] = np.arange(len(names))
            known = np.flatnonzero(layer.is_valid().to_numpy(zero_copy_only=False))
            code = rank[layer.indices.fill_null(0).to_numpy()[known]] if len(known) else known
            own, of = tile_faces.near_or_inside(tile[known], s[known], faces, border, face, origin, cell, side, near)
            each = np.unique(np.stack([of, code[own], line.indices.fill_null(-1).to_numpy()[known][own]], axis=1), axis=0)
            told, count = np.unique(each[:, :2], axis=0, return_counts=True)
            told, count = (x[np.lexsort((told[:, 1], -count, told[:, 0]))] for x in (told, count))
            told, count = (x[np.r_[True, told[1:, 0] != told[:-1, 0]][: len(told)]] for x in (told, count))
            most, voted = np.zeros(n, np.int64), np.zeros(n, bool)
            most[told[:, 0]], voted[told[:, 0]] = count, True
            back = np.argsort(rank)
            best = np.zeros(n, np.int64)
            best[told[:, 0]] = back[told[:, 1]] if len(told) else 0
            kinds = [rows.schema.field(c).type for c in extra]
            columns += [pa.nulls(n, kinds[0]), layer.dictionary.take(pa.array(best, mask=~voted))]
        columns += [pa.nulls(n, pa.float64())] * 4 + [pa.array(np.full(n, FACE), pa.int32()), *(pa.array(faces[c]) for c in ("area", "cx", "cy")), pa.array(faces["points"], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns + ([pa.array(most)] if votes else []), named)
        what = np.where(open_[which], OPEN, FACE)
        if votes:
            for t in np.unique(tile[what == OPEN]).tolist():
                at = slice(first[t], first[t + 1] if t + 1 < len(first) else len(rows))
                seen = tile_faces.in_sight(reach[at], reach[at][what[at] == OPEN])
                what[at] = np.where(seen & (what[at] == FACE), SEEN, what[at])
        some = np.flatnonzero(what != FACE)
        yield left(rows.take(pa.array(some)), what[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        full = None  # the tile whose first rows were too many
        told = lambda rows, k: tuple(rows.column(c)[k].as_py() for c in [*keys, "_tx", "_ty"])
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if not len(rows):
                continue
            new = np.zeros(len(rows), bool)
            new[0] = True
            for c in [*keys, "_tx", "_ty"]:
                code = rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            first = np.flatnonzero(new)
            if full is not None and told(rows, 0) == full:
                end = first[1] if len(first) > 1 else len(rows)
                yield left(rows.slice(0, end), np.full(end, OPEN))
                rows, first = rows.slice(end), first[1:] - end
            if len(first) > 1:
                full = None
                yield from whole(rows.slice(0, first[-1]), first[:-1])
                rows = rows.slice(first[-1])
            held = rows if len(rows) else None
            if len(rows) > IN_TILE:
                full, held = told(rows, 0), None
                yield left(rows, np.full(len(rows), OPEN))
        if held is not None:
            yield from whole(held.combine_chunks(), np.zeros(1, np.int64))

    return dealt.mapInArrow(run, schema)


def all_faces(segments: DataFrame, keys: list[str], cell: float, least: float = 0.1) -> DataFrame:
    """(keys, area, cx, cy, points): the inner faces of area ``least`` and more of the ``segments`` (keys, x1, y1, x2, y2) of equal ``keys``."""
    parts = staged(tiled(segments.select(*keys, *ENDS), keys, cell, least), "tiles")
    half = staged(half_edges(noded(parts.where(F.col("kind") == OPEN), keys, cell), keys), "half-edges")
    columns = [*keys, "area", "cx", "cy", "points"]
    return parts.where(F.col("kind") == FACE).select(*columns).unionByName(face_table(half, keys, least).select(*columns))


def build_regions(lines: DataFrame, keys: list[str], cell: float, gap: float = 0.1, near: float = 0.1, least: float = 0.1) -> DataFrame:
    """(keys, face, area, cx, cy, points, layer, votes): the regions that the ``lines`` of equal ``keys`` enclose, each with the layer that its lines vote for (UNKNOWN without any).

    Where a drawing encloses nothing, its loose ends are joined to what lies at most ``gap`` from them, and it is tried again. ``lines``: keys (not null), line, layer, x1, y1, x2, y2.
    Rings within rings are regions of their own, and the outer one's area counts them in.
    """
    lines = staged(lines, "lines")
    parts = staged(tiled(lines, keys, cell, least, near), "tiles")
    own, columns = parts.where(F.col("kind") == FACE), [*keys, "line", "layer", *ENDS]
    half = staged(half_edges(noded(parts.where(F.col("kind") == OPEN), keys, cell), keys), "half-edges")
    faces = staged(face_table(half, keys, least), "faces")
    lone = staged(lines.select(*keys).distinct().join(own.select(*keys).unionByName(faces.select(*keys)).distinct(), keys, "left_anti"), "without-faces")
    # all lines count for a face as large as a tile, and few for the others
    size = cell * tile_faces.TILE
    large = not faces.where((F.col("box.max_x") - F.col("box.min_x") >= size) | (F.col("box.max_y") - F.col("box.min_y") >= size)).isEmpty()
    voters = lines if large else parts.where(F.col("kind") != FACE).select(*columns).distinct()
    if not lone.isEmpty():
        bare = staged(lines.join(lone, keys, "left_semi").select(*columns), "lines-without-faces")
        closing = staged(bridges(staged(noded(bare, keys, cell), "pieces"), keys, gap, cell), "bridges")
        again = bare.join(closing.select(*keys).distinct(), keys, "left_semi").select(*keys, *ENDS).unionByName(closing)
        more = staged(half_edges(noded(again, keys, cell), keys), "half-edges")
        # names of the second pass must not be those of the first
        more = more.withColumn("face", -1 - F.col("face"))
        faces = staged(faces.unionByName(face_table(more, keys, least)), "faces")
        half = half.unionByName(more)
        voters = voters.unionByName(bare).distinct()
    told = votes(faces, half, voters, keys, near, cell)
    out = faces.join(told, "face", "left").withColumn("face", 2 * F.col("face") + 1)
    named = own.select(*keys, (2 * F.monotonically_increasing_id()).alias("face"), "area", "cx", "cy", "points", "layer", "votes")
    out = out.select(*named.columns).unionByName(named)
    return out.withColumn("layer", F.coalesce("layer", F.lit("UNKNOWN"))).withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))
