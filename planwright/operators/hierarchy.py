"""Hierarchical clusters of points: spanning trees of reachability with stable clusters, and Ward's linkage by mutual neighbours."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.graph import connected_components
from planwright.operators.nearby import AXES, BLOCK, SLACK, blocks, by_rows, distances, gaps, near_pairs, nearest, neighbours, points_of
from planwright.staging import staged

#: Edges or clusters up to this number are finished in one task.
ONE_TASK = 200_000


def in_one_task(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` of all rows at once; the caller has bounded them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(batches)
        if found:
            yield f(pd.concat(found, ignore_index=True))

    return df.repartition(1).mapInPandas(run, schema)


def _tree(p: np.ndarray, core: np.ndarray, ids: np.ndarray) -> list[tuple[float, int, int]]:
    """The least spanning tree by (reachability rounded to nine digits, lesser id, greater id): in each round every part takes its least edge out."""
    order = np.argsort(ids)
    p, core, ids = p[order], core[order], ids[order]
    n, out = len(p), []
    w = np.empty((n, n))
    for lo in range(0, n, 256):
        w[lo : lo + 256] = np.maximum(np.maximum(core[lo : lo + 256, None], core), distances(p[lo : lo + 256], p)).round(9)
    np.fill_diagonal(w, np.inf)
    part, to = np.arange(n), w.argmin(axis=1)  # of equal ones the least id, which gives the least pair too
    while n > 1 and part.max() > 0:
        far, low, high = w[np.arange(n), to], np.minimum(np.arange(n), to), np.maximum(np.arange(n), to)
        by = np.lexsort((high, low, far, part))
        first = by[np.r_[True, np.diff(part[by]) > 0]]
        root = np.arange(part.max() + 1)

        def find(k: int, root: np.ndarray = root) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for k in first.tolist():
            a, b = find(part[low[k]]), find(part[high[k]])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((float(far[k]), int(ids[low[k]]), int(ids[high[k]])))
        part = np.unique(np.array([find(k) for k in range(len(root))]), return_inverse=True)[1][part]
        stale = np.flatnonzero(part[to] == part)  # the others' least edges still lead out
        for lo in range(0, len(stale), 256):
            some = stale[lo : lo + 256]
            own = np.where(part[some, None] == part, np.inf, w[some])
            w[some], to[some] = own, own.argmin(axis=1)
    return out


def kruskal(edges: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """The edges of the least spanning forest, ascending."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for w, a, b in sorted(set(edges)):
        u, v = find(a), find(b)
        if u != v:
            root[u] = v
            out.append((w, a, b))
    return out


def spanning_forest(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """The least spanning forest of (w, a, b) by that order: by Borůvka's rounds while edges are many, the rest in one task.

    In each round every component takes its least edge out; those that are taken join components, and edges within one go.
    """
    left = staged(edges.distinct().select("w", "a", "b", F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    taken: DataFrame | None = None
    while (count := left.count()) > one_task:
        edge = F.struct("w", "a", "b", "u", "v")
        least = left.select(F.explode(F.array("u", "v")).alias("c"), edge.alias("e")).groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        least = staged(least, "least-edges")
        taken = least.select("w", "a", "b") if taken is None else taken.union(least.select("w", "a", "b"))
        root = staged(connected_components(least, "u", "v"), "joined")
        side = lambda end: root.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))  # noqa: E731, B023
        inner = left.join(side("u"), "u").join(side("v"), "v").where("_u <> _v")
        left = staged(inner.select("w", "a", "b", F.col("_u").alias("u"), F.col("_v").alias("v")), "edges")
    if not count:
        return left.select("w", "a", "b") if taken is None else taken

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        ends = {(u, v, w, a, b) for w, a, b, u, v in rows.itertuples(index=False)}
        known = {(w, a, b): (u, v) for u, v, w, a, b in ends}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for e in sorted(known):
            u, v = map(find, known[e])
            if u != v:
                root[u] = v
                out.append(e)
        return pd.DataFrame(out, columns=["w", "a", "b"])

    rest = in_one_task(left.select("w", "a", "b", "u", "v"), finish, "w double, a long, b long")  # at most one_task rows
    return rest if taken is None else taken.union(rest)


def reachability_tree(points: DataFrame, samples: int = 3, block: int = BLOCK, one_task: int = ONE_TASK) -> DataFrame:
    """(w, a, b): the least spanning tree of ``points`` (id, x, y, z; all places different) under mutual reachability, with ``far`` the core distances joined by the caller.

    ``points`` have core, their distance to the ``samples``-th point, themselves the first. The tree of all points lies within the trees of the blocks and the forests between pairs of blocks. Edges up to a
    reach are found first, so only points near another block meet it; the reach grows while the points don't hang together, and then only points
    outside the largest part meet blocks again.
    """
    held = blocks(points, ["core"], block)
    schema, kinds = "w double, a long, b long", [pa.float64(), pa.int64(), pa.int64()]

    def flat(found: list[tuple[float, int, int]]) -> list:
        return [list(c) for c in zip(*found, strict=True)] if found else [[], [], []]

    def tree(row: dict) -> list:
        return flat(_tree(points_of(row), np.asarray(row["core"], float), np.asarray(row["ids"])))

    def cross(row: dict) -> list:
        sides = [[points_of(row, o), *(np.asarray(row[o + c]) for c in ("core", "ids", "parts"))] for o in ("", "o_")]
        for k in (0, 1):  # points that nothing within the reach can join
            near = gaps(sides[k][0], sides[1 - k][0]) if len(sides[1 - k][0]) else np.full(len(sides[k][0]), np.inf)
            some = np.flatnonzero(np.maximum(near, sides[k][1]) <= row["reach"] + SLACK)
            some = some[np.argsort(sides[k][2][some])]
            sides[k] = [c[some] for c in sides[k]]
        return flat(_cross_forest(*sides, row["reach"]))

    own = staged(by_rows(held, tree, schema, kinds), "own-trees")
    size = held.agg(F.count(F.lit(1)), F.min("box.min_x"), F.max("box.max_x"), F.min("box.min_y"), F.max("box.max_y"), F.min("low"), F.max("high")).first()
    if size[0] <= 1:
        return own
    across = float(np.sqrt(sum((size[i + 1] - size[i]) ** 2 for i in (1, 3, 5)))) + 1.0
    reach = float(own.agg(F.percentile_approx("w", 0.9)).first()[0] or across / 64) + 1e-9
    # first all points are parts of their own, and blocks meet the blocks after them
    held = held.withColumn("parts", F.col("ids"))
    apart, edges = None, own
    while True:
        pairs = near_pairs((held if apart is None else apart).withColumn("reach", F.lit(min(reach, across))), held, "reach")
        pairs = pairs.where("block < o_block" if apart is None else "block <> o_block")
        edges = staged(spanning_forest(edges.union(by_rows(pairs, cross, schema, kinds)), one_task), "forest")
        if reach >= across:
            return edges
        short = edges.where(F.col("w") <= reach)
        root = staged(connected_components(short, "a", "b"), "hang-together")
        each = held.select("block", F.posexplode(F.arrays_zip("ids", *AXES, "core")).alias("at", "p")).select("block", "at", "p.*")
        each = staged(each.join(root.withColumnRenamed("node", "ids").hint("merge"), "ids", "left").withColumn("parts", F.coalesce("component", "ids")).drop("component"), "parts")
        largest = each.groupBy("parts").agg(F.count("*").alias("n")).agg(F.max_by("parts", F.struct("n", "parts")), F.count("*")).first()
        if largest[1] <= 1:
            return short
        # then points of other parts than the largest meet all blocks: what joins two points of one part is found
        arrays = F.array_sort(F.collect_list(F.struct("at", "ids", *AXES, "core", "parts"))).alias("p")
        box = G.box(F.min("x"), F.min("y"), F.max("x"), F.max("y")).alias("box")
        whole = lambda rows: rows.groupBy("block").agg(box, F.min("z").alias("low"), F.max("z").alias("high"), arrays).select("block", "box", "low", "high", *(F.col(f"p.{c}").alias(c) for c in ("ids", *AXES, "core", "parts")))
        held, apart = staged(whole(each), "blocks-parts"), staged(whole(each.where(F.col("parts") != largest[0])), "apart")
        reach *= 2


def _cross_forest(a: list[np.ndarray], b: list[np.ndarray], reach: float) -> list[tuple[float, int, int]]:
    """The least spanning forest of the edges up to ``reach`` between points of ``a`` and of ``b`` (each places, core, ids ascending, parts), where each part is one node."""
    (p, p_core, p_ids, p_parts), (q, q_core, q_ids, q_parts) = a, b
    m, n = len(p), len(q)
    if not m or not n:
        return []
    w = np.maximum(np.maximum(p_core[:, None], q_core[None, :]).astype(float), distances(p, q)).round(9)
    w[w > reach] = np.inf
    part = np.unique(np.concatenate([p_parts, q_parts]), return_inverse=True)[1]
    ids, out = np.concatenate([p_ids, q_ids]), []
    while True:
        w[part[:m, None] == part[None, m:]] = np.inf
        # of equal ones the least id, which gives the least pair too
        to = np.concatenate([m + w.argmin(axis=1), w.argmin(axis=0)])
        far = np.concatenate([w.min(axis=1), w.min(axis=0)])
        some = np.flatnonzero(np.isfinite(far))
        if not len(some):
            return out
        low, high = np.minimum(ids[some], ids[to[some]]), np.maximum(ids[some], ids[to[some]])
        by = np.lexsort((high, low, far[some], part[some]))
        first = by[np.r_[True, np.diff(part[some][by]) > 0]]
        root = list(range(int(part.max()) + 1))

        def find(k: int, root: list[int] = root) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for k in first.tolist():
            u, v = find(int(part[some[k]])), find(int(part[to[some[k]]]))
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((float(far[some[k]]), int(low[k]), int(high[k])))
        part = np.unique(np.array([find(k) for k in range(len(root))]), return_inverse=True)[1][part]


def stable_clusters(n: list[int], edges: list[tuple[float, int, int]], least: int) -> dict[int, int]:
    """Point -> the least point of its cluster, or -1: of the tree's splits into parts of ``least`` points and more the most stable ones, never the whole.

    Lambda is one over the edge's length. A cluster's stability adds up, over its points, how much lambda passes from where the cluster begins to where the
    point leaves it; parents give way to children that are together more stable.
    """
    at = {x: k for k, x in enumerate(sorted(n))}
    points = sorted(n)
    total = len(points)
    top = list(range(total))  # root of each set -> its node in the tree of merges
    root = list(range(total))
    left, right, height, size = [-1] * total, [-1] * total, [0.0] * total, [1] * total

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for w, a, b in sorted(edges):
        u, v = find(at[a]), find(at[b])
        if u != v:
            left.append(top[u])
            right.append(top[v])
            height.append(w)
            size.append(size[top[u]] + size[top[v]])
            root[u] = v
            top[v] = len(left) - 1
    heads = sorted({top[find(k)] for k in range(total)}) if total else []
    birth, stability, parent, members = [], [], [], defaultdict(list)

    def begin(of: int, lam: float) -> int:
        birth.append(lam)
        stability.append(0.0)
        parent.append(of)
        return len(birth) - 1

    def leaves(node: int) -> list[int]:
        out, work = [], [node]
        while work:
            x = work.pop()
            if left[x] < 0:
                out.append(x)
            else:
                work += [left[x], right[x]]
        return out

    work = [(h, begin(-1, 0.0)) for h in heads if size[h] >= least]
    whole = len(work) if len(heads) == 1 else 0
    while work:
        node, c = work.pop()
        if left[node] < 0:
            members[c].append(node)
            continue
        lam = 1 / max(height[node], 1e-12)
        kids = (left[node], right[node])
        if all(size[k] >= least for k in kids):
            stability[c] += size[node] * (lam - birth[c])
            work += [(k, begin(c, lam)) for k in kids]
            continue
        for k in kids:
            if size[k] >= least:
                work.append((k, c))
            else:
                members[c] += leaves(k)
                stability[c] += size[k] * (lam - birth[c])
    chosen, below = [False] * len(birth), defaultdict(float)
    for c in range(len(birth) - 1, -1, -1):
        chosen[c] = stability[c] >= below[c] and not (whole and c == 0)
        best = max(stability[c], below[c]) if not (whole and c == 0) else below[c]
        if parent[c] >= 0:
            below[parent[c]] += best
    out = dict.fromkeys(points, -1)
    held = defaultdict(list)
    for c in range(len(birth)):
        home, up = -1, c
        while up >= 0:
            home = up if chosen[up] else home
            up = parent[up]
        if home >= 0:
            held[home] += members[c]
    for found in held.values():
        low = points[min(found)]
        for k in found:
            out[points[k]] = low
    return out


def density_clusters(points: DataFrame, least: int = 3, samples: int = 3, block: int = BLOCK, one_task: int = ONE_TASK) -> DataFrame:
    """(id, cluster_id): hierarchical density clusters of ``points`` (id, x, y, z), named by their least id; -1 for noise. Fewer than three points are all cluster 0.

    Points of one place are one in the search, and come back as points at their core distance. The tree is found from pairs of near blocks; what is
    left for one task is its merges: as many rows as there are points, each three numbers. Null ids and places have to be left out before.
    """
    points = staged(points.select("id", *AXES), "points")
    if points.limit(3).count() < 3:
        return points.select("id", F.lit(0).cast("long").alias("cluster_id"))
    places = staged(points.groupBy(*AXES).agg(F.min("id").alias("id"), F.count("*").alias("copies")), "places")
    core = _core(places, samples, block)
    core = staged(places.join(core, "id"), "cores")
    tree = reachability_tree(core.select("id", *AXES, "core"), samples, block, one_task)
    same = points.withColumnRenamed("id", "b").join(core.select(F.col("id").alias("a"), *AXES, "core"), list(AXES)).where("a <> b").select(F.col("core").alias("w"), "a", "b")

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        found = stable_clusters(sorted({*rows["a"], *rows["b"]}), list(rows[["w", "a", "b"]].itertuples(index=False, name=None)), least)
        return pd.DataFrame({"id": list(found), "cluster_id": list(found.values())})

    return in_one_task(tree.union(same), label, "id long, cluster_id long")


def _core(places: DataFrame, samples: int, block: int) -> DataFrame:
    """(id, core): the distance of the ``samples``-th point, itself and its copies counted first; of fewer points the farthest."""
    held = blocks(places, ["copies"], block)
    out, need = None, F.lit(samples) - F.col("copies")
    if samples > 1:
        # the k-th other place is asked for where k places are enough whatever their copies
        each = (F.try_element_at("found", F.lit(k))[c].alias(f"{c}{k}") for k in range(1, samples) for c in ("far", "other"))
        out = neighbours(held, samples - 1).select("id", *each)
    told = places.select("id", "copies")
    if out is None:
        return told.select("id", F.lit(0.0).alias("core"))
    told = told.join(out, "id")
    core, have = F.lit(None).cast("double"), F.lit(0).cast("long")
    for k in range(1, samples):
        told = told.join(places.select(F.col("id").alias(f"other{k}"), F.col("copies").alias(f"copies{k}")), f"other{k}", "left")
        have = have + F.coalesce(f"copies{k}", F.lit(0).cast("long"))
        core = F.coalesce(core, F.when(have >= need, F.col(f"far{k}")))
    farthest = F.greatest(*(F.coalesce(f"far{k}", F.lit(0.0)) for k in range(1, samples)), F.lit(0.0))
    return told.select("id", F.when(need <= 0, 0.0).otherwise(F.coalesce(core, farthest)).alias("core"))


def plain_ward(clusters: dict[int, tuple[float, np.ndarray]], threshold: float) -> dict[int, int]:
    """Cluster -> the least of those that it is merged with: rounds of mutual nearest ones, as below."""
    home = {c: c for c in clusters}
    now = {c: (float(w), np.asarray(p, float)) for c, (w, p) in clusters.items()}
    while len(now) > 1:
        ids = np.array(sorted(now))
        w, p = np.array([now[c][0] for c in ids]), np.array([now[c][1] for c in ids])
        near, far = np.empty(len(ids), np.int64), np.empty(len(ids))
        for lo in range(0, len(ids), 256):  # never all pairs at once
            own = slice(lo, lo + 256)
            d = (distances(p[own], p) * np.sqrt(2 * w[own, None] * w[None, :] / (w[own, None] + w[None, :]))).round(9)
            rows = np.arange(len(d))
            d[rows, lo + rows] = np.inf
            near[own] = d.argmin(axis=1)
            far[own] = d[rows, near[own]]
        joined = [(i, j) for i, j in enumerate(near.tolist()) if i < j and near[j] == i and far[i] <= threshold]
        if not joined:
            break
        for i, j in joined:
            a, b = int(ids[i]), int(ids[j])
            total = now[a][0] + now[b][0]
            now[a] = (total, (now[a][1] * now[a][0] + now[b][1] * now[b][0]) / total)
            del now[b]
            home[b] = a
    for c in sorted(home):
        home[c] = home[home[c]]
    return home


def ward_clusters(points: DataFrame, threshold: float, block: int = BLOCK, one_task: int = 16_000) -> DataFrame:
    """(id, cluster_id): Ward's linkage of ``points`` (id, x, y, z) up to a height of ``threshold``, named by the least id. Fewer than three points are all cluster 0.

    Clusters that are each other's nearest are merged at once, which Ward's linkage allows: no later merge comes between them. Each round looks for the nearest
    by blocks. With at most ``one_task`` clusters left, one task goes on. Points of one place are one cluster from the start.
    """
    points = staged(points.select("id", *AXES), "points")
    if points.limit(3).count() < 3:
        return points.select("id", F.lit(0).cast("long").alias("cluster_id"))
    now = points.groupBy(*AXES).agg(F.min("id").alias("id"), F.count("*").cast("double").alias("mass"))
    now = staged(now.select("id", *AXES, "mass"), "clusters")
    same = points.withColumnRenamed("id", "own").join(now.select("id", *AXES), list(AXES)).select("own", "id")
    named = staged(same, "names")
    while now.count() > one_task:
        near = staged(nearest(blocks(now, ["mass"], block), 1, "mass"), "nearest")
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = staged(near.where(F.col("far") <= threshold).join(back, ["id", "other"]).where("id < other").select("id", "other"), "pairs")
        if pairs.isEmpty():
            break
        to = pairs.select(F.col("other").alias("id"), F.col("id").alias("into"))
        into = F.coalesce("into", "id")
        mean = [(F.sum(F.col(c) * F.col("mass")) / F.sum("mass")).alias(c) for c in AXES]
        now = staged(now.join(to, "id", "left").groupBy(into.alias("id")).agg(*mean, F.sum("mass").alias("mass")), "clusters")
        named = staged(named.join(to, "id", "left").select("own", into.alias("id")), "names")
    else:

        def finish(rows: pd.DataFrame) -> pd.DataFrame:
            found = plain_ward({r.id: (r.mass, np.array([r.x, r.y, r.z])) for r in rows.itertuples()}, threshold)
            return pd.DataFrame({"id": list(found), "into": list(found.values())})

        last = in_one_task(now, finish, "id long, into long")  # at most one_task rows
        named = named.join(last, "id").select("own", F.col("into").alias("id"))
    return named.select(F.col("own").alias("id"), F.col("id").alias("cluster_id"))
