"""Layouts cut into chunks: communities of growing resolution, else a cut across the main axis, until parts are small or compact.

Layouts up to a checked number of nodes are cut whole, each in one task; larger ones by staged rounds over all their parts at once. Both follow
one rule and give the same chunks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.operators.community import communities, plain_communities
from planwright.operators.graph import connected_components
from planwright.staging import staged

#: Share of the median area under which a node is noise; least share of the layout's area that communities are tried on, that their second
#: largest must have, that is cut across its axis, that a chunk must have, and above which a chunk is never a wall; the resolution's step and end; depth.
NOISE, TRY, SECOND, CUT, KEEP, HALL, MOST_TWICE_RESOLUTION, DEPTH = 0.2, 0.04, 0.015, 0.03, 0.005, 0.035, 6, 10
#: A part is cut if it is this many times as long as wide, or fills less of its turned box; a wall fills or rounds less than this.
LONG, LOOSE, WALL = 1.9, 0.65, 0.10
#: A layout with more nodes is cut by rounds of joins.
ONE_TASK = 20_000
#: Lengths are compared after rounding, so that the order in which sums were made doesn't matter.
DIGITS = 5


class _Shape:
    """Main axis and spans of a part's corner points."""

    def __init__(self, points: np.ndarray) -> None:
        self.mean = points.mean(axis=0)
        x, y = (points - self.mean).T
        self.angle = 0.5 * math.atan2(2 * (x * y).mean(), (x * x).mean() - (y * y).mean())
        turned = self.turned(points)
        self.spans = (turned.max(axis=0) - turned.min(axis=0)).round(DIGITS)

    def turned(self, points: np.ndarray) -> np.ndarray:
        x, y = (points - self.mean).T
        c, s = math.cos(self.angle), math.sin(self.angle)
        return np.stack([x * c + y * s, y * c - x * s], axis=1).round(DIGITS)


def plain_chunks(nodes: dict[int, tuple[float, float, float, float, np.ndarray]], edges: list[tuple[int, int, int]]) -> list[list[int]]:
    """The chunks of one layout, by their least nodes; ``nodes``: number -> (area, perimeter, x, y, corner points)."""
    whole, middle = sum(n[0] for n in nodes.values()), float(np.median([n[0] for n in nodes.values()])) if nodes else 0.0
    kept = {k for k, n in nodes.items() if n[0] >= NOISE * middle}
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for u, v, w in edges:
        if u in kept and v in kept:
            near[u].append((v, w))
            near[v].append((u, w))

    def parts(some: set[int]) -> list[set[int]]:
        out, left = [], set(some)
        while left:
            seen = work = {left.pop()}
            while work:
                work = {v for u in work for v, _ in near[u] if v in some} - seen
                seen = seen | work
            left -= seen
            out.append(seen)
        return out

    work, done = [(p, 2, 0) for p in parts(kept)], []
    while work:
        block, resolution, depth = work.pop()
        if len(block) <= 1 or depth > DEPTH:
            done.append(block)
            continue
        area = sum(nodes[n][0] for n in block)
        if area > TRY * whole and resolution + 1 <= MOST_TWICE_RESOLUTION:
            home = plain_communities([(u, v, w) for u in block for v, w in near[u] if u < v and v in block], block, resolution + 1)
            found: dict[int, set[int]] = defaultdict(set)
            for n, c in home.items():
                found[c].add(n)
            areas = sorted((sum(nodes[n][0] for n in c) for c in found.values()), reverse=True)
            if len(areas) > 1 and areas[1] > SECOND * whole:
                work += [(p, resolution + 1, depth + 1) for c in found.values() for p in parts(c)]
                continue
        shape = _Shape(np.concatenate([nodes[n][4] for n in sorted(block)]))
        a, b = shape.spans
        if area > CUT * whole and (max(a, b) / (min(a, b) + 1e-9) > LONG or area / (a * b + 1e-9) < LOOSE):
            order = sorted(block)
            along = shape.turned(np.array([nodes[n][2:4] for n in order]))[:, 0 if a > b else 1]
            low = along <= np.median(along)
            if low.all():
                low = np.arange(len(order)) < len(order) // 2
            work += [(p, 2, depth + 1) for side in (True, False) for p in parts({n for n, s in zip(order, low, strict=True) if s == side})]
            continue
        done.append(block)
    out = []
    for block in done:
        area = sum(nodes[n][0] for n in block)
        round_ = sum(4 * math.pi * nodes[n][0] ** 2 / (nodes[n][1] ** 2 + 1e-9) for n in block) / (area + 1e-9)
        a, b = _Shape(np.concatenate([nodes[n][4] for n in sorted(block)])).spans
        wall = round(round_, DIGITS) < WALL or area / (a * b + 1e-9) < WALL
        if area >= KEEP * whole and (area > HALL * whole or not wall):
            out.append(sorted(block))
    return sorted(out)


def chunk_layouts(nodes: DataFrame, edges: DataFrame, overlap: int = 0, one_task: int = ONE_TASK) -> DataFrame:
    """(layout, chunk, node, is_core): the chunks of each layout, numbered from 0 by their least nodes.

    ``nodes``: layout, node, area, perimeter, x, y (of the centroid), ring (array of points x, y, the first one again at the end). ``edges``: layout, src, dst, weight
    (integer), each once. Nodes far smaller than the median are noise; parts that are large are split into communities while the second largest is worth it, else
    cut at the median of their longer axis if they are long or fill little of their box. Small chunks and walls go. With ``overlap``, nodes
    so many edges away join a chunk as non-core. Layouts of over ``one_task`` nodes are cut by rounds of joins.
    """
    edges = edges.select("layout", "src", "dst", F.col("weight").cast("long").alias("weight"))
    count = nodes.groupBy("layout").agg(F.count("*").alias("n"))
    large = staged(count.where(F.col("n") > one_task).select("layout"), "large-layouts")
    small = _small(nodes.join(large, "layout", "left_anti"), edges.join(large, "layout", "left_anti"))
    core = small if large.isEmpty() else small.unionByName(_rounds(nodes.join(large, "layout", "left_semi"), edges.join(large, "layout", "left_semi")))
    # chunks are named by their least node until here
    first = Window.partitionBy("layout").orderBy("least")
    named = core.select("layout", "least").distinct().withColumn("chunk", (F.row_number().over(first) - 1).cast("int"))
    core = core.join(named, ["layout", "least"]).select("layout", "chunk", "node")
    if not overlap:
        return core.withColumn("is_core", F.lit(True))
    core = staged(core, "chunks")
    kept = _without_noise(nodes).select("layout", "node")
    steps = edges.select("layout", F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select("layout", "dst", "src"))
    steps = steps.join(kept, ["layout", "node"], "left_semi").join(kept.withColumnRenamed("node", "next"), ["layout", "next"], "left_semi")
    found = core
    for _ in range(overlap):
        found = found.union(found.join(steps, ["layout", "node"]).select("layout", "chunk", F.col("next").alias("node"))).distinct()
    mine = core.withColumn("is_core", F.lit(True))
    return found.join(mine, ["layout", "chunk", "node"], "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))


def _without_noise(nodes: DataFrame) -> DataFrame:
    limits = nodes.groupBy("layout").agg(F.percentile("area", F.lit(0.5)).alias("_middle"), F.sum("area").alias("whole"))
    return nodes.join(limits, "layout").where(F.col("area") >= NOISE * F.col("_middle")).drop("_middle")


def _small(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kind = nodes.schema["layout"].dataType.simpleString()
    corners = F.flatten(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    own = nodes.groupBy("layout").agg(F.collect_list(F.struct("node", "area", "perimeter", "x", "y", corners.alias("ring"))).alias("n"))
    lines = edges.groupBy(F.col("layout").alias("of")).agg(F.collect_list(F.struct("src", "dst", "weight")).alias("e"))
    both = own.join(lines, own["layout"] == lines["of"], "left").select("layout", "n", "e")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, least, node = [], [], []
            for k in range(b.num_rows):
                n, e = b.column(1)[k].values, b.column(2)[k].values
                columns = [n.field(i).to_pylist() for i in range(5)]
                rings, starts = n.field(5).values.to_numpy(zero_copy_only=False), n.field(5).offsets.to_numpy()
                held = {row[0]: (*row[1:], rings[starts[i] : starts[i + 1]].reshape(-1, 2)) for i, row in enumerate(zip(*columns, strict=True))}
                for part in plain_chunks(held, [] if e is None else list(zip(*(e.field(i).to_pylist() for i in range(3)), strict=True))):
                    of += [k] * len(part)
                    least += [part[0]] * len(part)
                    node += part
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(least, pa.int64()), pa.array(node, pa.int64())], ["layout", "least", "node"])

    return both.mapInArrow(cut, f"layout {kind}, least long, node long")


def _split(rows: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``block``, the least node of what hangs together within equal (layout, ``by``)."""
    end = lambda name, part: rows.select("layout", F.col("node").alias(name), F.col(by).alias(part))
    inner = edges.join(end("src", "_a"), ["layout", "src"]).join(end("dst", "_b"), ["layout", "dst"]).where(F.col("_a") == F.col("_b"))
    found = connected_components(inner.select(F.struct("layout", F.col("src").alias("node")).alias("src"), F.struct("layout", F.col("dst").alias("node")).alias("dst")))
    found = found.select("node.layout", "node.node", F.col("component.node").alias("_least"))
    return rows.join(found, ["layout", "node"], "left").withColumn("block", F.coalesce("_least", "node")).drop("_least")


def _turned(axis: str) -> tuple[Column, Column]:
    """Coordinates of a point struct column along and across the main axis of its part."""
    x, y = F.col(f"{axis}.x") - F.col("mx"), F.col(f"{axis}.y") - F.col("my")
    c, s = F.cos("angle"), F.sin("angle")
    return F.round(x * c + y * s, DIGITS), F.round(y * c - x * s, DIGITS)


def _shapes(rows: DataFrame) -> DataFrame:
    """(layout, block, size, area, mx, my, angle, a, b): counts, main axis and spans of each part."""
    points = rows.select("layout", "block", F.explode("ring").alias("p"))
    mean = points.groupBy("layout", "block").agg(F.avg("p.x").alias("mx"), F.avg("p.y").alias("my"))
    x, y = F.col("p.x") - F.col("mx"), F.col("p.y") - F.col("my")
    angle = 0.5 * F.atan2(2 * F.avg(x * y), F.avg(x * x) - F.avg(y * y))
    axis = staged(points.join(mean, ["layout", "block"]).groupBy("layout", "block", "mx", "my").agg(angle.alias("angle")), "axes")
    along, across = _turned("p")
    spans = points.join(axis, ["layout", "block"]).groupBy("layout", "block", "mx", "my", "angle").agg(F.round(F.max(along) - F.min(along), DIGITS).alias("a"), F.round(F.max(across) - F.min(across), DIGITS).alias("b"))
    sizes = rows.groupBy("layout", "block").agg(F.count("*").alias("size"), F.sum("area").alias("part_area"))
    return staged(spans.join(sizes, ["layout", "block"]), "shapes")


def _rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(layout, least, node) of the chunks, by rounds over all parts at once."""
    edges = staged(edges, "edges")
    kept = staged(_without_noise(nodes), "nodes")
    work = staged(_split(kept.withColumn("_all", F.lit(0)), edges, "_all").drop("_all").withColumn("resolution", F.lit(2)), "parts")
    done: DataFrame | None = None
    keys = ["layout", "block"]
    for depth in range(DEPTH + 2):
        shape = _shapes(work)
        told = work.join(shape, keys)
        open_ = (F.col("size") > 1) & F.lit(depth <= DEPTH)
        tried = told.where(open_ & (F.col("part_area") > TRY * F.col("whole")) & (F.col("resolution") + 1 <= MOST_TWICE_RESOLUTION))
        tried = tried.select("layout", F.struct("layout", "block").alias("part"), "block", "node", "area", "whole", (F.col("resolution") + 1).alias("twice_resolution"))
        tried = staged(tried, "tried")
        end = lambda name, part, t=tried: t.select("layout", F.col("node").alias(name), F.col("part").alias(part))
        inner = edges.join(end("src", "_a"), ["layout", "src"]).join(end("dst", "_b"), ["layout", "dst"]).where(F.col("_a") == F.col("_b"))
        home = communities(tried.select(F.col("part").alias("block"), "node", "twice_resolution"), inner.select(F.col("_a").alias("block"), "src", "dst", "weight"))
        home = home.select(F.col("block.layout").alias("layout"), F.col("block.block").alias("block"), "node", "community")
        areas = home.join(tried.select(*keys, "node", "area", "whole"), [*keys, "node"]).groupBy(*keys, "whole", "community").agg(F.sum("area").alias("s"))
        second = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("s"), "community"))
        worth = areas.withColumn("_k", second).where((F.col("_k") == 2) & (F.col("s") > SECOND * F.col("whole"))).select(*keys)
        home = staged(home.join(worth, keys, "left_semi").withColumnRenamed("community", "side"), "communities")
        by_community = told.join(home, [*keys, "node"])
        rest = told.join(worth, keys, "left_anti")
        long = F.greatest("a", "b") / (F.least("a", "b") + 1e-9) > LONG
        loose = F.col("part_area") / (F.col("a") * F.col("b") + 1e-9) < LOOSE
        cut = open_ & (F.col("part_area") > CUT * F.col("whole")) & (long | loose)
        along, across = _turned("_c")
        placed = rest.where(cut).withColumn("_c", F.struct("x", "y")).withColumn("_at", F.when(F.col("a") > F.col("b"), along).otherwise(across))
        middle = placed.groupBy(*keys).agg(F.percentile("_at", F.lit(0.5)).alias("_mid"), F.max("_at").alias("_top"))
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("node"))
        # points that are all alike are halved by number; only these parts need one
        alike = placed.join(middle.where("_top <= _mid"), keys).withColumn("side", F.when(number <= F.floor(F.col("size") / 2), 0).otherwise(1).cast("long"))
        apart = placed.join(middle.where("_top > _mid"), keys).withColumn("side", (F.col("_at") > F.col("_mid")).cast("long"))
        columns = [*kept.columns, "block", "side"]
        turned = apart.select(*columns).unionByName(alike.select(*columns)).withColumn("resolution", F.lit(2))
        ended = rest.where(~cut).select("layout", "block", "node", "area", "perimeter", "whole", "part_area", "a", "b")
        ended = staged(ended, "ended")
        done = ended if done is None else done.unionByName(ended)
        again = staged(by_community.select(*columns, (F.col("resolution") + 1).alias("resolution")).unionByName(turned).withColumn("_part", F.struct("block", "side")).drop("block", "side"), "again")
        if again.isEmpty():
            break
        work = staged(_split(again, edges, "_part").drop("_part"), "parts")
    round_ = F.sum(4 * math.pi * F.col("area") ** 2 / (F.col("perimeter") ** 2 + 1e-9)) / (F.col("part_area") + 1e-9)
    chunks = done.groupBy("layout", "block", "whole", "part_area", "a", "b").agg(round_.alias("round"))
    wall = (F.round("round", DIGITS) < WALL) | (F.col("part_area") / (F.col("a") * F.col("b") + 1e-9) < WALL)
    good = chunks.where((F.col("part_area") >= KEEP * F.col("whole")) & ((F.col("part_area") > HALL * F.col("whole")) | ~wall))
    return done.join(good.select("layout", "block"), ["layout", "block"], "left_semi").select("layout", F.col("block").alias("least"), "node")
