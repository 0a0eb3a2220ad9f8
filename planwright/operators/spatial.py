"""Spatial joins by a grid: a range join becomes an equi-join on cells, then the exact predicate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from planwright.functions import geometry as G
from planwright.operators.graph import connected_components
from planwright.staging import staged


def _cells(b: Column, cell: float, margin: float = 0.0) -> Column:
    low = lambda c: F.floor((c - margin) / cell)
    high = lambda c: F.floor((c + margin) / cell)
    xs, ys = F.sequence(low(b["min_x"]), high(b["max_x"])), F.sequence(low(b["min_y"]), high(b["max_y"]))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def box_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float, on: Column | None = None, margin: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose boxes (the left one grown by ``margin``) meet, edges included, and of which ``on`` holds.

    Both sides are dealt to the cells that their boxes touch and joined by cell (and by equal ``keys``); of the cells that a
    pair shares only the lowest counts, so pairs come once. Invalid (null) boxes match nothing. The cell size is a matter
    of speed: about the size of a common box.
    """
    a = left.where(F.col(left_box).isNotNull()).withColumn("_cell", F.explode(_cells(F.col(left_box), cell, margin)))
    b = right.where(F.col(right_box).isNotNull()).withColumn("_cell", F.explode(_cells(F.col(right_box), cell)))
    grown, other = G.grow(F.col(left_box), margin), F.col(right_box)
    first = (F.col("_cell.cx") == F.greatest(F.floor(grown["min_x"] / cell), F.floor(other["min_x"] / cell))) & (F.col("_cell.cy") == F.greatest(F.floor(grown["min_y"] / cell), F.floor(other["min_y"] / cell)))
    joined = a.join(b, ["_cell", *keys]).where(first & G.boxes_meet(grown, other))
    return (joined.where(on) if on is not None else joined).drop("_cell")


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, box: str, cell: float, margin: float = 0.0) -> DataFrame:
    """(point, box) pairs where the box, grown by ``margin``, has the point."""
    p = points.withColumn("_at", G.box(F.col(x), F.col(y), F.col(x), F.col(y)))
    return box_join(p, boxes, "_at", box, cell, margin=margin).drop("_at")


def box_semi_join(left: DataFrame, right: DataFrame, key: str, left_box: str, right_box: str, cell: float) -> DataFrame:
    """Rows of ``left`` (unique ``key``) whose box meets any of the right."""
    hits = box_join(left.select(key, left_box), right.select(right_box), left_box, right_box, cell).select(key).distinct()
    return left.join(hits, key, "left_semi")


#: Anchors up to this number are sent to all tasks; of so few every point meets all.
SENT, FEW = 10_000, 64
#: Places that are held against anchors together.
STRETCH = 512


def _nearest_of_counted(places: DataFrame, there: DataFrame, keys: list[str], anchor: str) -> DataFrame:
    """(keys, x, y, ``anchor``): for each of ``places`` the nearest of the anchors ``there`` (keys, _ax, _ay, _a), as many as the caller has counted; null if its keys have none.

    Places are put in order and taken in stretches. Of two anchors the one that is nearer to all corners of a stretch's box is nearer to all places in it, so
    few anchors are left for places far away.
    """
    held: dict[tuple, list[tuple]] = {}
    for r in there.select(*keys, "_ax", "_ay", "_a").collect():
        held.setdefault(tuple(r[: len(keys)]), []).append((float(r["_ax"]), float(r["_ay"]), r["_a"]))
    sets = {k: (np.array([a[:2] for a in sorted(v, key=lambda a: a[2])]), [a[2] for a in sorted(v, key=lambda a: a[2])]) for k, v in held.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * b.num_rows
            p = np.stack([b.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1)], axis=1).reshape(-1, 2)
            found: list = [None] * b.num_rows
            lo = 0
            while lo < b.num_rows:
                hi = lo + 1
                while hi < min(lo + STRETCH, b.num_rows) and own[hi] == own[lo]:
                    hi += 1
                if own[lo] in sets:
                    at, ids = sets[own[lo]]
                    found[lo:hi] = [ids[k] for k in _nearest_in(p[lo:hi], at)]
                lo = hi
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys) + 2)), pa.array(found, kind)], [*keys, "x", "y", anchor])

    fields = S.StructType([*(places.schema[c] for c in (*keys, "x", "y")), S.StructField(anchor, there.schema["_a"].dataType)])
    kind = to_arrow_type(fields[anchor].dataType)
    return places.select(*keys, "x", "y").repartitionByRange(*keys, "x", "y").sortWithinPartitions(*keys, "x", "y").mapInArrow(run, fields)


def _nearest_in(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place in ``at`` of the nearest to each of ``p``; of equally near ones the first."""
    (x1, y1), (x2, y2) = p.min(axis=0), p.max(axis=0)
    corners = np.array([(x1, y1), (x1, y2), (x2, y1), (x2, y2)])
    d = ((corners[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
    pivots = np.unique(np.r_[d.argmin(axis=1), d.sum(axis=0).argmin()])
    slack = 1e-9 * d.max()  # rounding must not rule out the nearest
    left = np.flatnonzero(~(d[:, None, :] > d[:, pivots, None] + slack).all(axis=0).any(axis=0))
    far = (p[:, 0, None] - at[left, 0]) ** 2 + (p[:, 1, None] - at[left, 1]) ** 2
    return left[far.argmin(axis=1)]


def nearest_points(points: DataFrame, anchors: DataFrame, key: str, anchor: str, cell: float, growth: int = 8, keys: tuple[str, ...] = ()) -> DataFrame:
    """(``key``, ``keys``, ``anchor``): of the anchors of equal ``keys`` the one nearest to each point (columns x and y; ``key`` is unique); of equally near ones the least. None if there are none.

    Points and anchors of one place are looked at once. Anchors are put into their own and the eight cells around it and meet the points there by an equi-join. What is found within
    one cell's size is the nearest; the other places are left for the next round, with cells ``growth`` times as large and as many anchors
    in each. Up to ``SENT`` places of anchors, what the first round leaves meets them in numpy, by stretches of places that lie together. No side is broadcast unless it has been counted.
    """
    kind = anchors.schema[anchor].dataType
    there = staged(anchors.groupBy(*keys, F.col("x").alias("_ax"), F.col("y").alias("_ay")).agg(F.min(anchor).alias("_a")).where("_ax is not null and _ay is not null"), "anchors")
    span = there.agg(F.max("_ax") - F.min("_ax"), F.max("_ay") - F.min("_ay"), F.min("_ax"), F.max("_ax"), F.min("_ay"), F.max("_ay"), F.count(F.lit(1))).first()
    if span[0] is None:
        return points.select(key, *keys, F.lit(None).cast(kind).alias(anchor))
    sent = lambda df: F.broadcast(df) if span[6] <= SENT else df.hint("merge")
    left = staged(points.where("x is not null and y is not null").select(*keys, "x", "y").distinct(), "places")
    reach = left.agg(F.max(F.greatest(F.abs(F.col("x") - span[2]), F.abs(F.col("x") - span[3]), F.abs(F.col("y") - span[4]), F.abs(F.col("y") - span[5])))).first()[0] or 0.0
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    far = (F.col("x") - F.col("_ax")) ** 2 + (F.col("y") - F.col("_ay")) ** 2
    nearest = F.min(F.struct(far.alias("d"), F.col("_a").alias("a"))).alias("m")
    done, last = None, False
    while not last:
        if done is not None and FEW < span[6] <= SENT:
            done = done.unionByName(_nearest_of_counted(left, there, list(keys), anchor))
            break
        last = span[6] <= FEW or cell > 2 * (reach + span[0] + span[1])  # every anchor is then within a cell of every point
        if last:
            met = left.join(sent(there), list(keys)) if keys else left.crossJoin(sent(there))
        else:
            spread = there.withColumn("_d", F.explode(around)).select(*keys, "_ax", "_ay", "_a", (F.floor(F.col("_ax") / cell) + F.col("_d.a")).alias("_cx"), (F.floor(F.col("_ay") / cell) + F.col("_d.b")).alias("_cy"))
            met = left.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)}).join(sent(spread), [*keys, "_cx", "_cy"])
        best = staged(met.groupBy(*keys, "x", "y").agg(nearest), "nearest")
        found = best if last else best.where(F.col("m.d") <= cell * cell)
        found = found.select(*keys, "x", "y", F.col("m.a").alias(anchor))
        done = found if done is None else done.unionByName(found)
        if not last:
            left = staged(left.join(found.select(*keys, "x", "y").hint("merge"), [*keys, "x", "y"], "left_anti"), "places-left")
            last = left.isEmpty()
        cell *= growth
    return points.select(key, *keys, "x", "y").join(done.hint("merge"), [*keys, "x", "y"], "left").select(key, *keys, anchor)


def merged_boxes(boxes: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, id, box): ``boxes`` (keys, id, box) joined until none of equal keys overlap much (``geometry.overlaps_much``); a joined box has its least id.

    In each round all boxes that hang together by such overlaps become their union at once, so neither the order of rows nor of ids matters. Ids are unique; null boxes go.

    All boxes meet each other once. Later only boxes that the round before made can overlap others, so these meet each other and the boxes around them, which are looked up once
    for a wide margin, and again where a box outgrows it. The rest isn't dealt to cells again.
    """
    first = staged(boxes.where(F.col("box").isNotNull()).select(*keys, "id", "box"), "boxes")
    ends = G.box(F.min("box.min_x"), F.min("box.min_y"), F.max("box.max_x"), F.max("box.max_y"))
    wide = F.greatest(F.lit(float(cell)), F.col("box.max_x") - F.col("box.min_x"), F.col("box.max_y") - F.col("box.min_y"))
    around = G.box(F.col("box.min_x") - wide, F.col("box.min_y") - wide, F.col("box.max_x") + wide, F.col("box.max_y") + wide)

    def overlaps(some: DataFrame, of: DataFrame, on: Column) -> DataFrame:
        other = of.select(*keys, F.col("id").alias("other_id"), F.col("box").alias("other")).hint("merge")
        return staged(box_join(some.select(*keys, "id", "box"), other, "box", "other", cell, on & G.overlaps_much(F.col("box"), F.col("other")), keys=tuple(keys)), "overlaps")

    def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
        return rows.join(ids.select("id").hint("merge"), "id", "left_anti").select(*rows.columns)

    pairs = overlaps(first, first, F.col("id") < F.col("other_id"))
    # taken: the ids of ``first`` that are in a joined box; near: others that a joined box may meet
    taken = made = near = None
    while not pairs.isEmpty():
        root = connected_components(pairs, "id", "other_id").select(F.col("node").alias("id"), F.col("component").alias("root"))
        met = staged(pairs.select(*keys, "id", "box").union(pairs.select(*keys, "other_id", "other")).dropDuplicates(["id"]), "met")
        taken = met.select("id") if taken is None else taken.union(met.select("id"))
        taken = staged(taken.distinct(), "taken")
        # where the boxes around are known, as of those that were joined
        homes = met.withColumn("home", F.lit(None).cast(first.schema["box"].dataType)) if made is None else met.join(made.select("id", "home").hint("merge"), "id", "left")
        new = homes.join(root.hint("merge"), "id").groupBy(*keys, F.col("root").alias("id")).agg(ends.alias("box"), F.min("home").alias("home"))
        known = reduce(Column.__and__, (op(F.col(f"box.{c}"), F.col(f"home.{c}")) for c, op in (("min_x", Column.__ge__), ("min_y", Column.__ge__), ("max_x", Column.__le__), ("max_y", Column.__le__))))
        new = staged(new.withColumn("known", F.coalesce(known, F.lit(False))).withColumn("home", F.when(F.col("known"), F.col("home")).otherwise(around)), "joined")
        asked = new.where("not known").select(*keys, F.col("home").alias("other"))
        if not asked.isEmpty():
            seen = box_join(first, asked.hint("merge"), "box", "other", cell, keys=tuple(keys)).select(*keys, "id", "box")
            seen = staged(seen, "seen")  # or what is taken would be left out of all boxes first
            near = (seen if near is None else near.union(seen)).dropDuplicates(["id"])
        near = staged(without(near, taken), "near")
        made = new.drop("known") if made is None else without(made, met).unionByName(new.drop("known"))
        made = staged(made, "made")
        pairs = overlaps(new, made.select(*keys, "id", "box").union(near), F.col("id") != F.col("other_id"))
    if made is None:
        return first
    return without(first, taken).unionByName(made.select(*keys, "id", "box"))
