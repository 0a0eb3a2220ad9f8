"""Louvain communities of weighted graphs, many at a time, with one rule of moves wherever they run.

A round finds for every node the neighbouring community that it would gain most by joining. Of the moves that touch a community, as the one left or the one
joined, only the best counts, and a move is made if it is the best in both: so no two moves of a round bear on each other, their
gains add up, and modularity never falls. When nothing moves, communities become nodes of the next level. Gains are integers (weights are
integers, resolutions halves), so ties and results are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from planwright.staging import discard, staged


def plain_communities(edges: Iterable[tuple[int, int, int]], nodes: Iterable[int], twice_resolution: int) -> dict[int, int]:
    """Node -> least node of its community, for a graph that fits one task."""
    near: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for u, v, w in edges:
        near[u][v] += w
        near[v][u] += w
    members = {n: [n] for n in nodes}
    degree = {n: sum(near[n].values()) for n in members}
    total = sum(degree.values())
    while True:
        home = {n: n for n in members}
        weight = dict(degree)  # of communities
        moved = False
        while True:
            best: dict[int, tuple[int, int]] = {}  # community -> (gain, -node) of the best move that touches it
            moves: dict[int, tuple[int, int, int]] = {}
            for u in members:
                a, to = home[u], defaultdict(int)
                for v, w in near[u].items():
                    if v != u:
                        to[home[v]] += w
                gains = [(2 * total * (w - to.get(a, 0)) - twice_resolution * degree[u] * (weight[b] - weight[a] + degree[u]), -b) for b, w in to.items() if b != a]
                gain, b = max(gains, default=(0, 0))
                if gain > 0:
                    moves[u] = (gain, a, -b)
                    for c in (a, -b):
                        best[c] = max(best.get(c, (0, 0)), (gain, -u))
            chosen = [(u, a, b) for u, (_, a, b) in moves.items() if best[a][1] == best[b][1] == -u]
            if not chosen:
                break
            for u, a, b in chosen:
                home[u] = b
                weight[a] -= degree[u]
                weight[b] += degree[u]
            moved = True
        if not moved:
            return {m: min(found) for found in members.values() for m in found}
        joined: dict[int, list[int]] = defaultdict(list)
        for n, found in members.items():
            joined[home[n]] += found
        up: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for u, to in near.items():
            for v, w in to.items():
                up[home[u]][home[v]] += w
        degree = {c: weight[c] for c in joined}
        members, near = joined, up


_WIDE = "decimal(38,0)"
#: Blocks of up to this number of nodes and edges are dealt with whole, many in one task.
ONE_TASK = 20_000


def block_communities(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``communities`` of blocks of which most are small: those of up to ``one_task`` nodes and edges are found whole, the others by rounds of joins. Both follow one rule.

    Every node is an end of one of the ``edges``, or alone.
    """
    own = nodes.groupBy("block").agg(F.count("*").alias("n"), F.first("twice_resolution").alias("twice_resolution"))
    size = edges.groupBy("block").agg(F.count("*").alias("m"))
    told = staged(own.join(size, "block", "left"), "block-sizes")
    large = told.where(F.greatest("n", F.coalesce("m", F.lit(0))) > one_task).select("block")
    some = edges if large.isEmpty() else edges.join(large, "block", "left_anti")
    rows = some.groupBy("block").agg(F.collect_list(F.struct("src", "dst", "weight")).alias("e")).join(told.select("block", "twice_resolution"), "block")
    kind = nodes.schema["block"].dataType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = b.column(1).offsets.to_numpy()
            src, dst, weight = (b.column(1).values.field(i).to_pylist() for i in range(3))
            of, found, home = [], [], []
            for k, twice in enumerate(b.column(2).to_pylist()):
                lo, hi = int(starts[k]), int(starts[k + 1])
                got = plain_communities(list(zip(src[lo:hi], dst[lo:hi], weight[lo:hi], strict=True)), {*src[lo:hi], *dst[lo:hi]}, twice)
                of += [k] * len(got)
                found += got
                home += got.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(found, pa.int64()), pa.array(home, pa.int64())], ["block", "node", "community"])

    out = rows.select("block", "e", "twice_resolution").mapInArrow(find, f"block {kind.simpleString()}, node long, community long")
    alone = nodes.join(edges.select("block", F.explode(F.array("src", "dst")).alias("node")), ["block", "node"], "left_anti").select("block", "node", F.col("node").alias("community"))
    out = out.unionByName(alone if large.isEmpty() else alone.join(large, "block", "left_anti"))
    return out if large.isEmpty() else out.unionByName(communities(nodes.join(large, "block", "left_semi"), edges.join(large, "block", "left_semi")))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(block, node, community): the communities of each block's graph, named by their least node.

    ``nodes``: block, node, twice_resolution (int, the same within a block). ``edges``: block, src, dst, weight (positive integer), each edge once, both ends
    of the block, no loops; several edges between two nodes add up. A node without edges is a community. Every round is a few joins by (block, node) and
    (block, community), staged; only the numbers of moves reach the driver.
    """
    both = edges.select("block", F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("w"))
    both = both.union(both.select("block", "v", "u", "w")).groupBy("block", "u", "v").agg(F.sum("w").alias("w"))
    links = staged(both, "links")
    degree = links.groupBy("block", F.col("u").alias("node")).agg(F.sum("w").alias("degree"))
    total = degree.groupBy("block").agg(F.sum("degree").alias("total"))
    base = nodes.join(degree, ["block", "node"], "left").join(total, "block", "left").select("block", "node", "twice_resolution", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    state = staged(base.withColumn("home", F.col("node")), "homes")
    named = state.select("block", "node", F.col("node").alias("top"))
    named = staged(named, "names")
    while True:
        state, moved = _level(state, links)
        if not moved:
            break
        named = staged(named.join(state.select("block", F.col("node").alias("top"), "home"), ["block", "top"]).select("block", "node", F.col("home").alias("top")), "names")
        side = lambda end, name: state.select("block", F.col("node").alias(end), F.col("home").alias(name))
        links = staged(links.join(side("u", "a"), ["block", "u"]).join(side("v", "b"), ["block", "v"]).groupBy("block", F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")), "links")
        grown = state.groupBy("block", "home").agg(F.sum("degree").alias("degree"), F.first("total").alias("total"), F.first("twice_resolution").alias("twice_resolution"))
        state = staged(grown.select("block", F.col("home").alias("node"), "twice_resolution", "degree", "total", "home"), "homes")
    least = named.groupBy("block", "top").agg(F.min("node").alias("community"))
    return named.join(least, ["block", "top"]).select("block", "node", "community")


def _level(state: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """(state after rounds of moves until none is left, whether there was any)"""
    moved, own = False, None
    big = lambda c: F.col(c).cast(_WIDE)
    while True:
        weight = state.groupBy("block", "home").agg(F.sum("degree").alias("weight"))
        to = links.where("u <> v").join(state.select("block", F.col("node").alias("v"), F.col("home").alias("b")), ["block", "v"]).groupBy("block", "u", "b").agg(F.sum("w").alias("w"))
        mine = state.select("block", F.col("node").alias("u"), F.col("home").alias("a"), "degree", "total", "twice_resolution")
        seen = to.join(mine, ["block", "u"])
        inside = seen.where("a = b").select("block", "u", F.col("w").alias("own"))
        of = lambda c, name: weight.select("block", F.col("home").alias(c), F.col("weight").alias(name))
        asked = seen.where("a <> b").join(inside, ["block", "u"], "left").join(of("a", "ka"), ["block", "a"]).join(of("b", "kb"), ["block", "b"])
        gain = 2 * big("total") * (big("w") - F.coalesce("own", F.lit(0)).cast(_WIDE)) - big("twice_resolution") * big("degree") * (big("kb") - big("ka") + big("degree"))
        best = asked.select("block", "u", "a", "b", gain.cast(_WIDE).alias("gain")).where("gain > 0").groupBy("block", "u", "a").agg(F.max(F.struct("gain", (-F.col("b")).alias("minus"))).alias("m"))
        moves = staged(best.select("block", "u", "a", (-F.col("m.minus")).alias("b"), "m.gain"), "moves")
        touched = moves.select("block", "u", "gain", F.explode(F.array("a", "b")).alias("c")).groupBy("block", "c").agg(F.max(F.struct("gain", (-F.col("u")).alias("minus"))).alias("m"))
        both = touched.groupBy("block", (-F.col("m.minus")).alias("u")).agg(F.count("*").alias("n")).where("n = 2")
        chosen = moves.join(both, ["block", "u"], "left_semi").select("block", F.col("u").alias("node"), "b")
        told = Observation()
        after = staged(state.join(chosen, ["block", "node"], "left").observe(told, F.count("b").alias("n")).withColumn("home", F.coalesce("b", "home")).drop("b"), "homes")
        discard(moves)
        if own is not None:
            discard(own)
        if not told.get["n"]:
            return after, moved
        state = own = after
        moved = True


def modularity(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """(block, modularity) of a partition (block, node, community) at the blocks' resolution."""
    e = edges.select("block", "src", "dst", "weight")
    half = e.select("block", F.col("src").alias("node"), "weight").union(e.select("block", "dst", "weight"))
    total = e.groupBy("block").agg(F.sum("weight").alias("m"))
    degree = half.join(found, ["block", "node"]).groupBy("block", "community").agg(F.sum("weight").alias("k"))
    side = lambda end, name: found.select("block", F.col("node").alias(end), F.col("community").alias(name))
    inside = e.join(side("src", "a"), ["block", "src"]).join(side("dst", "b"), ["block", "dst"]).where("a = b").groupBy("block", F.col("a").alias("community")).agg(F.sum("weight").alias("l"))
    of = degree.join(inside, ["block", "community"], "left").join(total, "block").join(nodes.groupBy("block").agg((F.first("twice_resolution") / 2).alias("r")), "block")
    return of.groupBy("block").agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.col("r") * (F.col("k") / (2 * F.col("m"))) ** 2).alias("modularity"))
