"""Region finders: boxes of drawings around labels, for all labels of all drawings in one plan.

Seeds are rows (seed_id, keys, x, y). What depends on the drawing alone, or on a slot that many seeds share, is found once and joined to them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators import kernels
from planwright.operators.occupancy import cell_components, sampled_cells
from planwright.operators.ordering import counted_side, group_percentiles
from planwright.operators.spatial import box_join
from planwright.staging import staged

EDGES = ("min_x", "min_y", "max_x", "max_y")


def _flat_box() -> Column:
    return G.box(*(F.col(c) for c in EDGES))


def points_in(boxes: DataFrame, points: DataFrame, box_id: str, keys: list[str], tile: float) -> DataFrame:
    """(box_id, n, lx, ly, hx, hy): how many ``points`` (keys, x, y) lie in each of ``boxes`` (box_id, keys, min_x ...), edges included, and their extent.

    Points are summed up by tiles once. Tiles inside a box count as a whole, so only those on its border meet their points; a large box
    doesn't meet all that is in it. Boxes without points have no row.
    """
    at = lambda c: F.floor(F.col(c) / tile)
    placed = points.where("x is not null and y is not null").select(*keys, "x", "y", at("x").alias("tx"), at("y").alias("ty"))
    stats = [F.count("*").alias("n"), F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("hx"), F.max("y").alias("hy")]
    tiles = placed.groupBy(*keys, "tx", "ty").agg(*stats)
    sound = boxes.select(box_id, *keys, *EDGES).where("min_x <= max_x and min_y <= max_y")
    # by columns, then by rows: no array of all tiles of a box
    spread = sound.withColumn("tx", F.explode(F.sequence(at("min_x"), at("max_x")))).withColumn("ty", F.explode(F.sequence(at("min_y"), at("max_y"))))
    inside = reduce(Column.__and__, ((F.col(f"t{c}") * tile >= F.col(f"min_{c}")) & ((F.col(f"t{c}") + 1) * tile <= F.col(f"max_{c}")) for c in "xy"))
    whole = spread.where(inside).join(tiles.hint("merge"), [*keys, "tx", "ty"]).select(box_id, "n", "lx", "ly", "hx", "hy")
    edge = spread.where(~inside).join(placed.hint("merge"), [*keys, "tx", "ty"]).where("x between min_x and max_x and y between min_y and max_y")
    edge = edge.select(box_id, F.lit(1).cast("long").alias("n"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    return whole.unionByName(edge).groupBy(box_id).agg(F.sum("n").alias("n"), F.min("lx").alias("lx"), F.min("ly").alias("ly"), F.max("hx").alias("hx"), F.max("hy").alias("hy"))


# ---------------------------------------------------------------- what is seen from a label


def isovists(segments: DataFrame, seeds: DataFrame, keys: list[str], radius: float, rays: int = 360, first: float | None = None) -> DataFrame:
    """(seed_id, ray, distance): how far each of ``rays`` rays from a seed runs until a segment of its drawing stops it, at most ``radius``; then a circular 11-tap median.

    A segment is taken to the rays between its ends as seen from the seed, so rays and segments meet by number. The reach grows fourfold from ``first`` (a
    sixteenth of the radius if not given): what stops a ray within the reach is the nearest, and only seeds with rays left look farther.
    """
    reach = min(radius, first or radius / 16)
    step = 2 * math.pi / rays
    lines = segments.select(*keys, "x1", "y1", "x2", "y2").where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    lines = staged(lines.withColumn("box", G.box(F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"))), "segments")
    seeds = staged(seeds.select("seed_id", *keys, "x", "y"), "seeds")
    left = seeds.withColumn("open", F.sequence(F.lit(0), F.lit(rays - 1)))
    done: DataFrame | None = None
    while True:
        own = left.withColumn("here", G.box(F.col("x"), F.col("y"), F.col("x"), F.col("y")))
        met = box_join(own, lines, "here", "box", 2 * reach, margin=reach, keys=tuple(keys))
        ax, ay, bx, by = F.col("x1") - F.col("x"), F.col("y1") - F.col("y"), F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
        met = met.select("seed_id", "open", ax.alias("ax"), ay.alias("ay"), (bx - ax).alias("ex"), (by - ay).alias("ey"), F.atan2(ay, ax).alias("a"), F.atan2(by, bx).alias("b"))
        turn = F.pmod(F.col("b") - F.col("a") + 2 * math.pi, F.lit(2 * math.pi))
        met = met.select("*", F.when(turn <= math.pi, F.col("a")).otherwise(F.col("b")).alias("from"), F.when(turn <= math.pi, turn).otherwise(2 * math.pi - turn).alias("wide"))
        begin = F.floor(F.col("from") / step) - 1
        seen = F.transform(F.sequence(begin, F.ceil((F.col("from") + F.col("wide")) / step) + 1), lambda r: F.pmod(r, F.lit(rays)).cast("int"))
        each = met.withColumn("ray", F.explode(F.array_intersect(seen, F.col("open"))))
        dx, dy = F.cos(F.col("ray") * step), F.sin(F.col("ray") * step)
        det = dx * F.col("ey") - dy * F.col("ex")
        sound = F.when(F.abs(det) > 1e-12, det)
        t, u = (F.col("ax") * F.col("ey") - F.col("ay") * F.col("ex")) / sound, (F.col("ax") * dy - F.col("ay") * dx) / sound
        hits = each.select("seed_id", "ray", t.alias("t"), u.alias("u")).where(F.col("t").between(0, reach) & F.col("u").between(0, 1)).groupBy("seed_id", "ray").agg(F.min("t").alias("d"))
        hits = staged(hits, "hits")
        done = hits if done is None else done.union(hits)
        if reach >= radius:
            break
        stopped = hits.groupBy("seed_id").agg(F.collect_list("ray").alias("stopped"))  # as many as rays
        left = left.join(stopped, "seed_id", "left").withColumn("open", F.array_except("open", F.coalesce("stopped", F.array().cast("array<int>")))).drop("stopped").where(F.size("open") > 0)
        left = staged(left, "open-rays")
        if left.isEmpty():
            break
        reach = min(radius, reach * 4)
    near = seeds.select("seed_id", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))).alias("ray")).join(done, ["seed_id", "ray"], "left")
    near = near.select("seed_id", F.struct("ray", F.coalesce("d", F.lit(radius)).alias("d")).alias("r")).groupBy("seed_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    # one array of rays a seed: the median of each and the five on either side
    ring = F.transform(F.sequence(F.lit(0), F.lit(rays - 1)), lambda k: F.struct(k.alias("ray"), F.sort_array(F.transform(F.sequence(F.lit(-5), F.lit(5)), lambda s: F.col("r")[F.pmod(k + s, F.lit(rays)).cast("int")]["d"]))[5].alias("distance")))
    return near.select("seed_id", F.explode(ring).alias("m")).select("seed_id", "m.ray", "m.distance")


def isovist_boxes(seen: DataFrame, seeds: DataFrame, radius: float, least: float, steps: int = 3, rays: int = 360) -> DataFrame:
    """(seed_id, keys, step, min_x ...): boxes about the seeds as wide and high as what is seen, then half as large again each step.

    Half width and height are the farthest any ray reaches along the axis, at least ``least`` and at most ``radius``.
    """
    angle = F.col("ray") * (2 * math.pi / rays)
    half = lambda f: F.least(F.lit(radius), F.greatest(F.lit(least), F.max(F.abs(F.col("distance") * f(angle)))))
    size = seen.groupBy("seed_id").agg(half(F.cos).alias("dx"), half(F.sin).alias("dy"))
    each = seeds.join(size, "seed_id").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    grown = F.pow(F.lit(1.5), F.col("step"))
    keep = [c for c in seeds.columns if c not in ("x", "y")]
    return each.select(*keep, "step", *((F.col(c) + sign * F.col(f"d{c}") * grown).alias(f"{n}_{c}") for n, sign in (("min", -1), ("max", 1)) for c in "xy"))


# ---------------------------------------------------------------- slots


def slots(segments: DataFrame, seeds: DataFrame, keys: list[str], bins: int = 400) -> DataFrame:
    """(seed_id, min_x ...): the slot of each seed, of the sweeps y-x-y and x-y-x the larger (the first, if alike).

    A sweep counts the ends of the segments in bins along one axis and takes the stretch about the seed that wide gaps bound; the next one, along the other
    axis, counts only segments that meet this stretch. Seeds of one stretch share what follows. Seeds of drawings without segments have none.
    """
    ends = segments.groupBy(*keys).agg(*(f(g(f"{k}1"), g(f"{k}2")).alias(f"{n}_{k}") for k in "xy" for n, f, g in (("lo", F.least, F.min), ("hi", F.greatest, F.max))))
    find = kernels.slot_udf(max(3, bins // 40))
    lines = staged(segments.select(*keys, "x1", "y1", "x2", "y2"), "segments")

    def sweep(axes: str) -> DataFrame:
        state = seeds.select("seed_id", *keys, "x", "y").join(ends, keys)
        found: dict[str, str] = {}
        by = [*keys, "lo_x", "hi_x", "lo_y", "hi_y"]  # the drawing, then the stretches so far
        for i, k in enumerate(axes):
            state = staged(state, "sweep")
            # segments are counted by the number of their stretch, not by all that makes it
            places = staged(state.select(*by).distinct().withColumn("place", F.monotonically_increasing_id()), "places")
            rows = lines.join(places, keys)
            for j, other in enumerate(axes[:i]):
                last = axes[:i].rfind(other) == j
                if last:
                    rows = rows.where((F.greatest(f"{other}1", f"{other}2") >= F.col(f"s{j}_low")) & (F.least(f"{other}1", f"{other}2") <= F.col(f"s{j}_high")))
            hist = kernels.histogram(rows, [f"{k}1", f"{k}2"], F.col(f"lo_{k}"), F.col(f"hi_{k}"), bins, ["place"])
            told = state.join(places.join(hist, "place"), by).withColumn("s", find("hist", F.col(k), "low", "width"))
            state = told.select(*state.columns, F.col("s.low").alias(f"s{i}_low"), F.col("s.high").alias(f"s{i}_high"))
            by = [*by, f"s{i}_low", f"s{i}_high"]
            found[k] = f"s{i}"
        return state.select("seed_id", G.box(*(F.col(f"{found[c]}_{e}") for e in ("low", "high") for c in "xy")).alias(axes))

    both = sweep("yxy").join(sweep("xyx"), "seed_id")
    larger = F.when(G.box_area(F.col("xyx")) > G.box_area(F.col("yxy")), F.col("xyx")).otherwise(F.col("yxy"))
    # few rows, which callers read several times
    return staged(both.select("seed_id", larger.alias("b")).select("seed_id", "b.*"), "seed-slots")


def refined(segments: DataFrame, found: DataFrame, keys: list[str], cell: float, least_cells: int = 30, least_side: float = 5000.0, share: float = 0.8) -> DataFrame:
    """``found`` (seed_id, keys, x, y, min_x ...) with its slot drawn in to the smallest component of the slot's linework whose box has the seed.

    Linework is laid on cells that begin at the slot's corner and hang together by their sides; components of few cells or short sides don't count, and the slot
    stays where the component's box is not under ``share`` of its area. Slots that seeds share are looked at once.
    """
    places = staged(found.select(*keys, *EDGES).distinct().where("max_x > min_x and max_y > min_y").withColumn("slot", F.monotonically_increasing_id()), "slots")
    # a segment counts where it touches the slot; only what lies in the slot is laid on cells
    inside = (F.greatest("x1", "x2") >= F.col("min_x")) & (F.least("x1", "x2") <= F.col("max_x")) & (F.greatest("y1", "y2") >= F.col("min_y")) & (F.least("y1", "y2") <= F.col("max_y"))
    own = segments.select(*keys, "x1", "y1", "x2", "y2").join(places, keys).where(inside)
    moved = own.select("slot", *EDGES, *((F.col(f"{c}{e}") - F.col(f"min_{c}")).alias(f"{c}{e}") for e in "12" for c in "xy"))
    count = lambda c: F.greatest(F.lit(2), F.ceil((F.col(f"max_{c}") - F.col(f"min_{c}")) / cell))
    cells = sampled_cells(moved, ["slot"], cell, cell).join(places, "slot").where((F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < count("x")) & (F.col("cy") < count("y")))
    parts = cell_components(staged(cells.select("slot", "cx", "cy"), "cells"), ["slot"], diagonal=False)
    boxes = parts.groupBy("slot", "component").agg(F.count("*").alias("cells"), F.min("cx").alias("x1"), F.min("cy").alias("y1"), F.max("cx").alias("x2"), F.max("cy").alias("y2"))
    large = boxes.where((F.col("cells") >= least_cells) & ((F.col("x2") - F.col("x1") + 1) * cell >= least_side) & ((F.col("y2") - F.col("y1") + 1) * cell >= least_side))
    placed = large.join(places, "slot").select(*keys, *EDGES, *((F.col(f"min_{c}") + (F.col(f"{c}{n}") + extra) * cell).alias(f"p{e}_{c}") for n, extra, e in (("1", 0, "min"), ("2", 1, "max")) for c in "xy"))
    small = F.struct(((F.col("pmax_x") - F.col("pmin_x")) * (F.col("pmax_y") - F.col("pmin_y"))).alias("area"), "pmin_x", "pmin_y", "pmax_x", "pmax_y")
    hit = found.join(placed, [*keys, *EDGES]).where("x between pmin_x and pmax_x and y between pmin_y and pmax_y").groupBy("seed_id").agg(F.min(small).alias("p"))
    hit = staged(hit, "hits")  # a row a seed: the components aren't found again for every use
    whole = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    out = found.join(hit, "seed_id", "left").withColumn("_in", F.coalesce(F.col("p.area") < share * whole, F.lit(False)))
    return out.select(*[c for c in found.columns if c not in EDGES], *(F.when(F.col("_in"), F.col(f"p.p{c}")).otherwise(F.col(c)).alias(c) for c in EDGES))


def tightened(found: DataFrame, points: DataFrame, keys: list[str], tile: float) -> DataFrame:
    """``found`` (seed_id, keys, min_x ...) with each box drawn in to the points inside it; one without points stays."""
    places = staged(found.select(*keys, *EDGES).distinct().withColumn("slot", F.monotonically_increasing_id()), "slots")
    extent = staged(points_in(places, points, "slot", keys, tile), "extents")
    known = places.join(extent, "slot", "left").drop("slot", "n")
    same = found.join(known, [*keys, *EDGES], "left")
    return same.select(*[c for c in found.columns if c not in EDGES], *(F.coalesce(e, c).alias(c) for e, c in zip(("lx", "ly", "hx", "hy"), EDGES, strict=True)))


# ---------------------------------------------------------------- candidates


def counted(candidates: DataFrame, points: DataFrame, keys: list[str], tile: float) -> DataFrame:
    """``candidates`` with n (points inside), aspect, area and density; boxes that several share are counted once."""
    places = staged(candidates.select(*keys, *EDGES).distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    n = staged(points_in(places, points, "place", keys, tile).select("place", "n"), "counts")
    known = places.join(n.hint("merge"), "place", "left").select(*keys, *EDGES, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    area = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    out = candidates.join(known.hint("merge"), [*keys, *EDGES])
    return out.withColumn("aspect", F.when(h > 1e-9, w / F.when(h > 1e-9, h))).withColumn("area", area).withColumn("density", F.col("n") / (area + 1e-9))


def sound(candidates: DataFrame, least: int, low: float, high: float, relax: bool) -> DataFrame:
    """Counted ``candidates`` of each seed with an aspect within ``low`` and ``high`` and ``least`` points.

    With ``relax``, a seed that has none keeps those with a third of the points (20 at least) and an aspect of 0.1 to 12, and if it has none of these either, all.
    """
    fits = lambda a, b, n: F.coalesce(F.col("aspect").between(a, b) & (F.col("n") >= n), F.lit(False))
    strict = fits(low, high, least)
    if not relax:
        return candidates.where(strict)
    loose = fits(min(0.10, low), max(12.0, high), max(20, least // 3))
    rank = F.when(strict, 0).when(loose, 1).otherwise(2)
    best = Window.partitionBy("seed_id")
    return candidates.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(best)).where("_rank = _best").drop("_rank", "_best")


def kept_best(candidates: DataFrame, order: list[Column], most_alike: float, most: int) -> DataFrame:
    """(seed_id, rank, the rest of ``candidates``): of each seed's candidates in this order those whose IoU with all kept before is under ``most_alike``, ``most`` of them.

    A seed has as many candidates as its finders gave, a few; they are folded in one array a seed.
    """
    place = F.row_number().over(Window.partitionBy("seed_id").orderBy(*order, *EDGES))
    rest = [c for c in candidates.columns if c != "seed_id"]
    rows = candidates.withColumn("_at", place).groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("_at", *rest))).alias("b"))
    kept = rows.select("seed_id", F.posexplode(F.slice(kernels.suppress(F.col("b"), most_alike), 1, most)).alias("rank", "k"))
    return kept.select("seed_id", (F.col("rank") + 1).alias("rank"), *(F.col(f"k.{c}").alias(c) for c in rest))


# ---------------------------------------------------------------- composite rank

#: Weights of having the label, of likeness to the box one scale up, of smallness, of structure inside, of occupied cells, and of each other label inside.
HAS_LABEL, STABLE, SMALL, STRUCTURE, FILLED, OTHER_LABELS = 0.12, 0.30, 0.10, 0.22, 0.26, 0.32


def scored(candidates: DataFrame, seeds: DataFrame, structure: DataFrame, keys: list[str], tile: float) -> DataFrame:
    """``candidates`` (seed_id, keys, scale, min_x ..., fill, whole, bonus) with labels (other seeds inside), structured and score.

    ``whole`` is the drawing's area, ``bonus`` what the shape adds. A box is held against the one of the next larger scale of its seed; the label counts as inside up to a cell away.
    """
    places = staged(candidates.select(*keys, *EDGES).distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    count = lambda points, name: points_in(places, points, "place", keys, tile).select("place", F.col("n").alias(name))
    known = places.join(count(seeds.select(*keys, "x", "y"), "_labels").hint("merge"), "place", "left").join(count(structure, "_structure").hint("merge"), "place", "left").drop("place")
    rows = candidates.join(known.hint("merge"), [*keys, *EDGES]).join(seeds.select("seed_id", F.col("x").alias("_x"), F.col("y").alias("_y")).hint("merge"), "seed_id")
    inside = F.col("_x").between(F.col("min_x"), F.col("max_x")) & F.col("_y").between(F.col("min_y"), F.col("max_y"))
    near = F.col("_x").between(F.col("min_x") - F.col("scale"), F.col("max_x") + F.col("scale")) & F.col("_y").between(F.col("min_y") - F.col("scale"), F.col("max_y") + F.col("scale"))
    before = F.lag(_flat_box()).over(Window.partitionBy("seed_id").orderBy(F.desc("scale")))  # one row a scale
    rows = rows.withColumn("_before", before).withColumn("labels", F.coalesce("_labels", F.lit(0).cast("long")) - inside.cast("long"))
    rows = rows.withColumn("structured", F.coalesce(F.col("_structure") > 0, F.lit(False)))
    score = (
        HAS_LABEL * near.cast("double")
        + STABLE * F.coalesce(G.iou(_flat_box(), F.col("_before")), F.lit(0.0))
        - SMALL * G.box_area(_flat_box()) / F.greatest(F.lit(1.0), F.col("whole"))
        + STRUCTURE * F.col("structured").cast("double")
        + FILLED * F.col("fill")
        + F.col("bonus")
        - OTHER_LABELS * F.col("labels")
    )
    return rows.withColumn("score", score).drop("_labels", "_structure", "_before", "_x", "_y")


def partitioned(candidates: DataFrame, owned: DataFrame, local: float, least: int = 20) -> DataFrame:
    """``candidates`` (seed_id, scale, min_x ...) drawn in to the points of their own label: the first to the 99th percentile of those inside, with a margin.

    ``owned``: seed_id, x, y: points by the label that is nearest to them. A box stays where fewer than ``least`` of its label's points are inside, or where what is left would be
    under 12 % or over 105 % of it.
    """
    owned = staged(owned.select("seed_id", "x", "y"), "owned")
    many = owned.groupBy("seed_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("seed_id")
    boxes = staged(candidates.select("seed_id", "scale", *EDGES).join(many.hint("merge"), "seed_id", "left_semi"), "owners")
    own = owned.join(counted_side(boxes), "seed_id").where("x between min_x and max_x and y between min_y and max_y")
    ends = group_percentiles(own, ["seed_id", "scale"], {c: (f"min_{c}", f"max_{c}") for c in "xy"}, {"_min": 0.01, "_max": 0.99}, "_n")
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    pad = F.greatest(F.lit(2 * local), 0.015 * side)
    drawn = candidates.join(ends.hint("merge"), ["seed_id", "scale"], "left").withColumn("_pad", pad)
    new = G.box(F.col("_min_x") - F.col("_pad"), F.col("_min_y") - F.col("_pad"), F.col("_max_x") + F.col("_pad"), F.col("_max_y") + F.col("_pad"))
    base = G.box_area(_flat_box())
    fits = (F.col("_n") >= least) & (G.box_area(F.col("_new")) >= 0.12 * base) & (G.box_area(F.col("_new")) <= 1.05 * base)
    drawn = drawn.withColumn("_new", new).withColumn("_fits", F.coalesce(fits, F.lit(False)))
    return drawn.select(*[c for c in candidates.columns if c not in EDGES], *(F.when(F.col("_fits"), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in EDGES))
