"""Dual-tree Lloyd: exact k-means rounds over integer vectors.

Vectors are filed in blocks, each with a cover tree that is built once and staged. Every round grows a small cover tree over the
centroids, and both trees are walked together: a pair of nodes goes when its least possible distance is above what
another pair is sure to reach. A node that has one centroid left is summed whole, from running sums; leaves that have several
compare them exactly. Bounds are floating point with a margin, so they only save work: who is nearest is decided by integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.staging import staged

#: Vectors of one cover tree; a task holds one block at a time.
BLOCK = 2048
#: Nodes with fewer vectors are not divided, smaller children share a leaf.
LEAF = 12
#: Components up to this are compared in 64 bits (64 * (2 * 2^27)^2 * 2 < 2^63 for 64 components); others as Python integers.
NARROW = 1 << 27
#: Relative margin of the bounds.
MARGIN = 1e-9
#: Sums travel as digits of so many bits.
DIGIT = 40


def quantised(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers where all are narrow, else as Python integers."""
    x = vectors.astype(np.float64)
    if not x.size or np.abs(x).max() * scale <= NARROW - 1:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[floor(Fraction(float(v)) * scale) for v in row] for row in x], dtype=object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all of ``b``; both of one kind."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


class CoverTree:
    """Node ``i`` holds rows ``begin[i]`` to ``end[i]`` of ``rows``, all within ``radius[i]`` of row ``centre[i]``; its children are ``kids[i]``.

    A child's rows lie within half its parent's radius (rounded up to a power of two) of its centre, centres of children are
    farther apart than that, and the parent's centre is a child's. Children with few rows share one leaf about the parent's centre.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        x = points.astype(np.float64)
        self.order: list[int] = []
        self.begin, self.end, self.centre, self.radius, self.kids = [], [], [], [], []
        if len(x):
            self._grow(x, np.arange(len(x)), 0, np.sqrt(((x - x[0]) ** 2).sum(axis=1)), leaf)
        place = np.empty(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        self.centre = [int(place[c]) for c in self.centre]

    def _grow(self, x: np.ndarray, rows: np.ndarray, centre: int, far: np.ndarray, leaf: int) -> int:
        me = len(self.begin)
        self.begin.append(len(self.order))
        self.end.append(0)
        self.centre.append(centre)
        self.radius.append(float(far.max()) * (1 + MARGIN))
        self.kids.append([])
        if len(rows) <= leaf or not far.max():
            self.order += rows.tolist()
        else:
            reach = 2.0 ** (np.ceil(np.log2(far.max())) - 1)
            rest, crumbs, here, near = np.ones(len(rows), bool), [], centre, far
            while True:
                mine = rest & (near <= reach)
                rest &= ~mine
                if mine.sum() < leaf:
                    crumbs.append(np.flatnonzero(mine))
                else:
                    self.kids[me].append(self._grow(x, rows[mine], here, near[mine], leaf))
                if not rest.any():
                    break
                here = int(rows[np.argmax(rest)])
                near = np.full(len(rows), np.inf)
                near[rest] = np.sqrt(((x[rows[rest]] - x[here]) ** 2).sum(axis=1))
            if crumbs:
                few = np.concatenate(crumbs)
                if self.kids[me]:
                    self.kids[me].append(len(self.begin))
                    self.begin.append(len(self.order))
                    self.centre.append(centre)
                    self.radius.append(float(far[few].max()) * (1 + MARGIN))
                    self.kids.append([])
                    self.end.append(len(self.order) + len(few))
                self.order += rows[few].tolist()
        self.end[me] = len(self.order)
        return me


class Block:
    """Vectors in the order of their tree, with running sums."""

    def __init__(self, ids: list, vectors: np.ndarray) -> None:
        self.tree = CoverTree(vectors) if vectors.dtype != object else None
        order = self.tree.order if self.tree else range(len(ids))
        self.ids, self.vectors = [ids[i] for i in order], vectors[list(order)]

    def sums(self) -> np.ndarray:
        return np.vstack([np.zeros((1, self.vectors.shape[1]), np.int64), np.cumsum(self.vectors, axis=0)])


def pairs(block: Block, centroids: np.ndarray, over: CoverTree) -> Iterator[tuple[int, int, list[int]]]:
    """(begin, end, candidates) that cover the block: each row's nearest centroids are among its candidates."""
    tree, rows = block.tree, block.vectors.astype(np.float64)
    at = centroids.astype(np.float64)
    stack = [(0, [0])]
    while stack:
        node, cands = stack.pop()
        centre, r = rows[tree.centre[node]], tree.radius[node]
        while True:
            own = [over.order[over.centre[c]] for c in cands]
            near = np.sqrt(((at[own] - centre) ** 2).sum(axis=1))
            radii = np.array([over.radius[c] for c in cands])
            sure = near.min() + r
            kept = np.flatnonzero(near - r - radii <= sure * (1 + MARGIN) + MARGIN)
            wide = [c for c in (cands[i] for i in kept) if over.end[c] - over.begin[c] > 1]
            cands = [cands[i] for i in kept]
            # the larger node opens first; a leaf opens all that is over the centroids
            if not wide or (tree.kids[node] and max(over.radius[c] for c in wide) < r):
                break
            opened = max(wide, key=lambda c: over.radius[c])
            cands = [c for c in cands if c != opened] + (over.kids[opened] or [opened])
            if not over.kids[opened]:
                break
        if len(cands) == 1 and over.end[cands[0]] - over.begin[cands[0]] == 1:
            yield tree.begin[node], tree.end[node], [over.order[over.begin[cands[0]]]]
        elif tree.kids[node]:
            stack += [(kid, cands) for kid in tree.kids[node]]
        else:
            yield tree.begin[node], tree.end[node], sorted(over.order[i] for c in cands for i in range(over.begin[c], over.end[c]))


def assigned(block: Block, centroids: list[list[int]], whole: bool) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray | None]]:
    """(begin, end, cluster of each row, squared distance of each row) over the block; with ``whole``, a range of one cluster may come as its number alone."""
    wide = [k for k, c in enumerate(centroids) if max(map(abs, c)) > NARROW]
    if block.tree is None or wide:
        exact = squared(block.vectors.astype(object), np.array(centroids, dtype=object))
        best = np.array([min(range(len(centroids)), key=lambda k: (row[k], k)) for row in exact])
        yield 0, len(best), best, exact[np.arange(len(best)), best]
        return
    c = np.array(centroids, dtype=np.int64)
    for begin, end, cands in pairs(block, c, CoverTree(c, leaf=1)):
        if whole and len(cands) == 1:
            yield begin, end, cands[0], None
            continue
        exact = squared(block.vectors[begin:end], c[cands])
        best = exact.argmin(axis=1)  # the first of equal ones has the smallest number
        yield begin, end, np.array(cands)[best], exact[np.arange(end - begin), best]


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(vec_id, embedding) of vectors with ``dims`` finite components."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & finite
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))


def forest(vectors: DataFrame, scale: int, block: int = BLOCK) -> DataFrame:
    """Blocks of (ids, components, kind): rows in the order of their cover tree, and the tree's arrays."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def out(ids: list, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            narrow = np.abs(rows).max(axis=1) * scale <= NARROW - 1
            for pick in (narrow, ~narrow):
                if pick.any():
                    chosen = np.flatnonzero(pick)
                    b = Block([ids[i] for i in chosen], quantised(rows[chosen], scale))
                    t = b.tree
                    numbers = [[], [], [], [], []] if t is None else [t.begin, t.end, t.centre, [len(k) for k in t.kids], [x for k in t.kids for x in k]]
                    flat = b.vectors.astype(np.int32).tobytes() if t else ";".join(",".join(map(str, r)) for r in b.vectors).encode()
                    values = [[b.ids], [flat], [t is not None], *[[n] for n in numbers], [[] if t is None else t.radius]]
                    kinds = [pa.list_(pa.int64()), pa.binary(), pa.bool_(), *[pa.list_(pa.int32())] * 5, pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], FOREST)

        for b in batches:
            ids += b.column(0).to_pylist()
            lists = b.column(1)
            if b.num_rows:
                held.append(lists.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            while len(ids) >= block:
                rows = np.concatenate(held)
                yield from out(ids[:block], rows[:block])
                ids, held = ids[block:], [rows[block:]]
        if ids:
            yield from out(ids, np.concatenate(held))

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(file, ", ".join(f"{n} {k}" for n, k in zip(FOREST, ("array<long>", "binary", "boolean", *["array<int>"] * 5, "array<double>"), strict=True)))


FOREST = ["ids", "components", "narrow", "begins", "ends", "centres", "kid_counts", "kids", "radii"]


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            b = Block.__new__(Block)
            b.ids = row["ids"]
            if row["narrow"]:
                b.vectors = np.frombuffer(row["components"], np.int32).reshape(-1, dims).astype(np.int64)
                t = b.tree = CoverTree.__new__(CoverTree)
                t.begin, t.end, t.centre, t.radius = row["begins"], row["ends"], row["centres"], row["radii"]
                cuts = np.cumsum([0, *row["kid_counts"]])
                t.kids = [row["kids"][a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            else:
                b.tree, b.vectors = None, np.array([[int(x) for x in r.split(",")] for r in row["components"].decode().split(";")], dtype=object)
            yield b


def digits(value: int) -> list[int]:
    """``value`` in digits of DIGIT bits, lowest first, each with its sign."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << DIGIT) - 1)))
        rest >>= DIGIT
    return out


def moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of the exact means; one without vectors stays."""
    k, dims = len(centroids), len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, dims + 1), dtype=object)  # the last column counts
        for b in blocks(batches, dims):
            sums = b.sums() if b.tree else None
            for begin, end, cluster, _ in assigned(b, centroids, True):
                if isinstance(cluster, int):
                    totals[cluster, :dims] += (sums[end] - sums[begin]).astype(object)
                    totals[cluster, dims] += end - begin
                    continue
                for c in np.unique(cluster):
                    rows = b.vectors[begin:end][cluster == c]
                    totals[c, :dims] += rows.sum(axis=0).astype(object)
                    totals[c, dims] += len(rows)
        found = [(c, d, n, x) for c in range(k) for d in range(dims + 1) for n, x in enumerate(digits(int(totals[c, d])))]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "digit", "value"])

    told = trees.mapInArrow(add, "cluster int, dim int, digit int, value long").groupBy("cluster", "dim", "digit").agg(F.sum("value").alias("value"))
    totals = [[0] * (dims + 1) for _ in range(k)]
    for c, d, n, x in told.collect():  # clusters times components times digits, however many vectors there are
        totals[c][d] += x << (DIGIT * n)
    return [[s // t[dims] for s in t[:dims]] if t[dims] else list(old) for t, old in zip(totals, centroids, strict=True)]


def cluster_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null, NaN or infinite; each component becomes floor(scale * x). Centroids start as
    the vectors with the smallest sha256 of ``1:<id>`` (equal ids: by components); a vector with a null id is clustered but starts
    none, and fewer vectors than ``clusters`` make fewer. Of equally near centroids the smaller number wins. A distance or inertia
    beyond a long is null (what is nearest is still exact); one such distance makes the inertia of its cluster and of all null. Repeated
    rows count each time; no kept vector (or none with an id) gives no rows. Other columns aren't read. The driver holds centroids and their sums alone.
    """
    spark = rows.sparkSession
    vectors = kept_vectors(rows, id_col, vector_col, dims)
    first = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)).orderBy("h", "embedding").limit(clusters).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = [[int(v) for v in quantised(np.array([r["embedding"]]), scale)[0]] for r in first]
    trees = staged(forest(vectors, scale, block), "forest")
    for _ in range(rounds):
        centroids = moved(trees, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, dims):
            for begin, end, cluster, far in assigned(b, centroids, False):
                told = [int(x) if x < 1 << 63 else None for x in far]
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[begin:end], pa.int64()), pa.array(cluster, pa.int32()), pa.array(told, pa.int64())], ["vec_id", "cluster", "distance"])

    ends = staged(trees.mapInArrow(last, "vec_id long, cluster int, distance long"), "assigned")
    per = ends.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    within = {r["cluster"]: None if r["beyond"] else int(r["s"]) for r in per}
    total = None if None in within.values() else sum(within.values())
    told = [(c, fits(s), fits(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in within.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ends.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row per cluster
