"""Graph operators over edge tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from planwright.staging import discard, staged


#: Tables of more rows are not broadcast.
SENT = 100_000
#: Components of up to this number of edges are found in one task.
ONE_TASK = 100_000


def unsent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` for a join that shuffles it, unless it is known to have few ``rows``: a table that grows isn't gathered on the driver, however small its files are."""
    return df if rows is not None and rows <= SENT else df.hint("merge")


def _sorts(kind: S.DataType) -> bool:
    """Whether Python orders values of ``kind``, as ``_key`` shows them, as Spark does."""
    return all(_sorts(f.dataType) for f in kind.fields) if isinstance(kind, S.StructType) else isinstance(kind, (S.ByteType, S.ShortType, S.IntegerType, S.LongType, S.StringType))


def _key(value: object) -> object:
    """``value`` as something that has a hash and an order, nulls first."""
    return tuple((x is not None, _key(x) if x is not None else 0) for x in value.values()) if isinstance(value, dict) else value


def _few_components(edges: DataFrame) -> DataFrame:
    """(node, component) of ``edges`` (u, v), in one task; the caller has bounded them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[object, int] = {}
        shown, root = [], []

        def number(x: object) -> int:
            k = place.setdefault(_key(x), len(root))
            if k == len(root):
                shown.append(x)
                root.append(k)
            return k

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = find(number(u)), find(number(v))
                root[a] = c
        if kind is None:
            return
        least: dict[int, tuple[object, int]] = {}
        for key, k in place.items():
            top = find(k)
            least[top] = min(least.get(top, (key, k)), (key, k))
        for lo in range(0, len(shown), 10_000):
            some = range(lo, min(lo + 10_000, len(shown)))
            yield pa.RecordBatch.from_arrays([pa.array([shown[k] for k in some], kind), pa.array([shown[least[find(k)][1]] for k in some], kind)], ["node", "component"])

    node = edges.schema["u"].dataType
    return edges.select("u", "v").repartition(1).mapInArrow(run, S.StructType([S.StructField("node", node), S.StructField("component", node)]))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of an undirected edge table; a component is named by its least node.

    Alternating large-star and small-star steps: every round hangs each node's neighbours on the least node known to it, so
    the number of rounds grows with the logarithm of a component's size. The edges are staged once, and so is each round (its count
    and hash are gathered while it is written); that keeps plans short and lets a lost executor's part be read again. A round
    goes once the next one is written. Loops, repeated edges and null ends are ignored, except that a node whose only
    edges are loops is its own component. Raises if ``rounds`` rounds don't end. Up to ``one_task`` edges, as counted, need no rounds: one task finds
    the same.
    """

    def kept(found: DataFrame) -> tuple[DataFrame, tuple]:
        told = Observation()
        out = staged(found.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), "edges")
        return out, (told.get["n"], told.get["hash"])

    u, v = F.col(src), F.col(dst)
    clean = edges.where(u.isNotNull() & v.isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    whole, mark = kept(clean.distinct())
    if mark[0] <= one_task and _sorts(whole.schema["u"].dataType):
        return _few_components(whole)
    now, seen = whole.where("u <> v"), None
    last = None
    for _ in range(rounds):
        if mark == seen or not mark[0]:
            break
        n = mark[0]
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(unsent(least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(unsent(least, n), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()
        seen = mark
        now, mark = kept(small)
        if last is not None:
            discard(last)
        last = now
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).union(whole.where("u = v"))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, far): steps from each of ``sources`` (source) to every node that an undirected edge table (src, dst) leads to.

    All sources walk at once, a staged round of joins for each step; ``edges`` has each edge once, both ends different.
    """
    both = staged(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "both-ways")
    n = both.count()
    front = staged(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("far")).distinct(), "front")
    seen = [front]
    while True:
        near = front.join(unsent(both, n), front["node"] == both["src"]).select("source", F.col("dst").alias("node"), (F.col("far") + 1).alias("far")).distinct()
        for old in seen[-2:]:  # a neighbour is at most one step nearer or farther
            near = near.join(unsent(old.select("source", "node"), n), ["source", "node"], "left_anti")
        front = staged(near, "front")
        if front.isEmpty():
            return reduce(DataFrame.union, seen)
        seen.append(front)


def diameters(edges: DataFrame) -> DataFrame:
    """(component, nodes, diameter) of every component of an undirected edge table (src, dst; each edge once, no loops).

    Two sweeps give each component a lower bound and a node near its middle. From there nodes are taken level by level, the farthest first: what lies
    beyond is at most twice the level, so most components end after a level or two.
    """
    edges = staged(edges.select("src", "dst"), "edges")
    n = edges.count()
    home = staged(connected_components(edges), "components")
    far = lambda found: found.join(unsent(home, n), "node").groupBy("source", "component").agg(F.max(F.struct("far", (-F.col("node")).alias("least"))).alias("m"))
    ends = staged(far(distances(edges, home.select(F.col("component").alias("source")).distinct())).select("component", (-F.col("m.least")).alias("a")), "ends")
    from_a = staged(distances(edges, ends.select(F.col("a").alias("source"))), "from-a")
    other = staged(far(from_a).select("component", F.col("m.far").alias("low"), (-F.col("m.least")).alias("b")), "others")
    from_b = distances(edges, other.select(F.col("b").alias("source")))
    both = from_a.select("node", F.col("far").alias("fa")).join(unsent(from_b.select("node", F.col("far").alias("fb")), n), "node").join(unsent(home, n), "node")
    middle = both.groupBy("component").agg(F.min(F.struct(F.greatest("fa", "fb").alias("f"), "node"))["node"].alias("u"))
    levels = staged(distances(edges, middle.select(F.col("u").alias("source"))).select("node", "far").join(unsent(home, n), "node"), "levels")
    size = home.groupBy("component").agg(F.count("*").alias("nodes"))
    state = staged(levels.groupBy("component").agg(F.max("far").alias("level")).join(unsent(other.select("component", "low"), n), "component"), "state")
    done: list[DataFrame] = []
    while True:
        ended = state.where("level <= 1 or low >= 2 * level")
        # of the nodes from a level down no two are over twice the level apart
        done.append(ended.select("component", F.greatest("low", "level").alias("diameter")))
        open_ = staged(state.where("not (level <= 1 or low >= 2 * level)"), "open")
        if open_.isEmpty():
            break
        asked = levels.join(unsent(open_.select("component", F.col("level").alias("far")), n), ["component", "far"])
        reach = distances(edges, asked.select(F.col("node").alias("source"))).groupBy("source").agg(F.max("far").alias("most"))
        best = reach.join(unsent(home, n), reach["source"] == home["node"]).groupBy("component").agg(F.max("most").alias("most"))
        state = staged(open_.join(unsent(best, n), "component").select("component", (F.col("level") - 1).alias("level"), F.greatest("low", "most").alias("low")), "state")
    return reduce(DataFrame.union, done).join(unsent(size, n), "component").select("component", "nodes", "diameter")


def articulation_points(edges: DataFrame) -> DataFrame:
    """(node): the nodes whose removal parts their component, of an undirected edge table (src, dst; each edge once, no loops).

    Of a spanning tree from each component's least node, nodes are numbered so that whatever is below a node follows it. Tree edges that one cycle runs through are
    joined by where the other edges below them reach; components of that relation are the blocks, and a node on two of them is one.
    """
    edges = staged(edges.select("src", "dst"), "edges")
    n = edges.count()
    both = edges.union(edges.select("dst", "src"))
    home = connected_components(edges)
    level = distances(edges, home.select(F.col("component").alias("source")).distinct()).select(F.col("source").alias("root"), "node", "far")
    level = staged(level, "levels")
    up = both.join(unsent(level.select(F.col("node").alias("src"), F.col("far").alias("f")), n), "src").join(unsent(level.select(F.col("node").alias("dst"), F.col("far").alias("g")), n), "dst").where("g = f - 1")
    parent = up.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"))
    tree = staged(level.join(unsent(parent, n), "node", "left"), "tree")
    depth = tree.agg(F.max("far")).first()[0]
    if depth is None:
        return edges.select(F.col("src").alias("node")).limit(0)
    sizes: list[DataFrame] = []
    for k in range(depth, -1, -1):  # from the leaves up
        own = tree.where(F.col("far") == k)
        if sizes:
            below = sizes[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("below"))
            own = own.join(unsent(below, n), "node", "left")
        else:
            own = own.withColumn("below", F.lit(None).cast("long"))
        sizes.append(staged(own.withColumn("size", 1 + F.coalesce("below", F.lit(0).cast("long"))).drop("below"), "sizes"))
    sizes.reverse()
    top = _numbered_roots(sizes[0])
    numbered = [staged(top, "numbers")]
    for own in sizes[1:]:  # from the roots down: after the parent come its children's nodes, child by child
        before = F.coalesce(F.sum("size").over(Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
        above = numbered[-1].select(F.col("node").alias("parent"), F.col("pre").alias("above"))
        numbered.append(staged(own.withColumn("before", before).join(unsent(above, n), "parent").withColumn("pre", F.col("above") + 1 + F.col("before")).select(*top.columns), "numbers"))
    nodes = staged(reduce(DataFrame.unionByName, numbered), "numbered")
    end = lambda name: nodes.select(F.col("node").alias(name), F.col("pre").alias(f"{name}_pre"), F.col("size").alias(f"{name}_size"), F.col("parent").alias(f"{name}_parent"))
    others = both.join(unsent(end("src"), n), "src").join(unsent(end("dst"), n), "dst").where("(src_parent is null or src_parent <> dst) and (dst_parent is null or dst_parent <> src)")
    others = staged(others, "other-edges")
    reach = others.groupBy(F.col("src").alias("node")).agg(F.min("dst_pre").alias("low"), F.max("dst_pre").alias("high"))
    own = nodes.join(unsent(reach, n), "node", "left").select("node", "parent", "far", "pre", "size", F.least("pre", F.coalesce("low", "pre")).alias("low"), F.greatest("pre", F.coalesce("high", "pre")).alias("high"))
    own = staged(own, "reach")
    lows: list[DataFrame] = []
    for k in range(depth, -1, -1):
        here = own.where(F.col("far") == k)
        if lows:
            below = lows[-1].groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
            here = here.join(unsent(below, n), "node", "left").withColumns({"low": F.least("low", F.coalesce("l", "low")), "high": F.greatest("high", F.coalesce("h", "high"))}).drop("l", "h")
        lows.append(staged(here, "lows"))
    spans = reduce(DataFrame.unionByName, lows)
    # a tree edge is named by its lower node
    across = others.where("src_pre + src_size <= dst_pre").select("src", "dst")
    above = spans.where("parent is not null").select("node", "parent", "low", "high").join(unsent(end("parent"), n), "parent").where("parent_parent is not null and (low < parent_pre or high >= parent_pre + parent_size)")
    joined = across.union(above.select("node", "parent"))
    block = connected_components(joined.select(F.col("src").alias("src"), F.col("dst").alias("dst"))).withColumnsRenamed({"node": "lower", "component": "block"})
    lines = nodes.where("parent is not null").select(F.col("node").alias("lower"), "parent").join(unsent(block, n), "lower", "left").withColumn("block", F.coalesce("block", "lower"))
    touched = lines.select(F.col("lower").alias("node"), "block").union(lines.select("parent", "block"))
    return touched.groupBy("node").agg(F.count_distinct("block").alias("n")).where("n > 1").select("node")


def _numbered_roots(roots: DataFrame) -> DataFrame:
    """Roots of many components, each numbered after all nodes of those before it: sums by runs, not in one task."""
    from planwright.operators.ordering import sorted_runs

    runs = sorted_runs(roots, ["node"], "roots")
    sums = runs.groupBy("_run").agg(F.sum("size").alias("_sum"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    sums = sums.select("_run", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_before"))
    within = Window.partitionBy("_run").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    own = runs.withColumn("_own", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))).join(sums, "_run")
    return own.withColumn("pre", F.col("_own") + F.col("_before")).select(*roots.columns, "pre")
