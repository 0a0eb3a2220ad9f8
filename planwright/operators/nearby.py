"""Exact neighbours of points in three dimensions, by blocks of points that lie together.

Points are put in the order of a space-filling curve and cut into blocks of equal size, so a crowded place makes more blocks, not a larger one. Pairs of
blocks whose boxes are near enough meet by a box join, and are compared whole in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.ordering import sorted_runs
from planwright.operators.spatial import box_join
from planwright.staging import staged

#: Points of a block.
BLOCK = 1024
AXES = ("x", "y", "z")


def reduced(vectors: DataFrame, id_col: str, vector_col: str, digits: int = 6) -> DataFrame:
    """(id, x, y, z): unit vectors on their three main axes, rounded; an axis points where its largest component is positive.

    Means and products of components are added up in tasks and in Spark; the driver gets one matrix of the vectors' width. Null vectors and those without
    a length are left out; vectors of one table have one width.
    """
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def unit(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        size = np.sqrt((m * m).sum(axis=1))
        sound = np.isfinite(size) & (size > 0)
        return sound, m[sound] / size[sound, None]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                _, m = unit(b)
                own = np.hstack([m, np.ones((len(m), 1))])
                total = own.T @ own + (0 if total is None else total)
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    told = rows.mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    kind = rows.schema["id"].dataType.simpleString()
    if not told:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, x double, y double, z double")
    n = max(r["i"] for r in told) + 1
    s = np.zeros((n, n))
    for r in told:
        s[r["i"], r["j"]] = r["s"]
    count = max(1.0, s[-1, -1])
    mean = s[:-1, -1] / count
    _, axes = np.linalg.eigh(s[:-1, :-1] / count - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :3]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    axes = np.hstack([axes, np.zeros((len(axes), 3 - axes.shape[1]))])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sound, m = unit(b)
                p = ((m - mean) @ axes).round(digits) + 0.0
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(sound)), *(pa.array(p[:, k]) for k in range(3))], ["id", *AXES])

    return rows.mapInArrow(turn, f"id {kind}, x double, y double, z double")


def blocks(points: DataFrame, extra: list[str], size: int = BLOCK) -> DataFrame:
    """(block, box, low, high, ids, x, y, z, ``extra``): blocks of ``points`` (id long, x, y, z) with arrays of their columns."""
    ends = points.agg(*(f(c).alias(f"{n}{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max)))).first()
    bits = 10
    code = F.lit(0).cast("long")
    for k, c in enumerate(AXES):
        low, span = ends[f"lo{c}"] or 0.0, max((ends[f"hi{c}"] or 0.0) - (ends[f"lo{c}"] or 0.0), 1e-12)
        step = F.least(F.floor((F.col(c) - low) / span * (1 << bits)), F.lit((1 << bits) - 1))
        for i in range(bits):
            code = code + F.shiftleft(F.shiftright(step, i).bitwiseAND(1), 3 * i + k)
    runs = sorted_runs(points.select("id", *AXES, *extra, code.alias("_code")), ["_code", "id"], "curve")
    own = runs.groupBy((F.shiftleft(F.col("_run").cast("long"), 32) + F.floor(F.col("_place") / size)).alias("block"))
    held = own.agg(F.collect_list(F.struct("id", *AXES, *extra)).alias("p"))
    side = lambda f, c: f(F.transform("p", lambda p: p[c]))
    box = G.box(side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y"))
    return staged(held.select("block", box.alias("box"), side(F.array_min, "z").alias("low"), side(F.array_max, "z").alias("high"), F.col("p.id").alias("ids"), *(F.col(f"p.{c}").alias(c) for c in (*AXES, *extra))), "blocks")


def near_pairs(left: DataFrame, right: DataFrame, reach: str) -> DataFrame:
    """Rows of ``left`` with those of ``right`` (columns prefixed by o_) whose boxes are at most ``reach`` (a column of ``left``) apart."""
    other = right.select(*(F.col(c).alias(f"o_{c}") for c in right.columns))
    grown = left.withColumn("_grown", G.grow(F.col("box"), F.col(reach)))
    wide = F.greatest(F.col("_grown.max_x") - F.col("_grown.min_x"), F.col("_grown.max_y") - F.col("_grown.min_y"))
    cell = max(grown.agg(F.percentile_approx(wide, 0.9)).first()[0] or 0.0, 1e-9)
    apart = [F.greatest(F.col(f"box.min_{k}") - F.col(f"o_box.max_{k}"), F.col(f"o_box.min_{k}") - F.col(f"box.max_{k}"), F.lit(0.0)) for k in "xy"]
    apart.append(F.greatest(F.col("low") - F.col("o_high"), F.col("o_low") - F.col("high"), F.lit(0.0)))
    near = F.sqrt(sum(a * a for a in apart)) <= F.col(reach)
    return box_join(grown, other, "_grown", "o_box", cell, near).drop("_grown")


def points_of(row: dict, prefix: str = "") -> np.ndarray:
    return np.stack([np.asarray(row[prefix + c], float) for c in AXES], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(out, out=out)


#: More than distances differ by when they are rounded to nine digits.
SLACK = 2e-9


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How far each of ``p`` is from the box around ``q``."""
    out = np.maximum(np.maximum(q.min(axis=0) - p, p - q.max(axis=0)), 0.0)
    return np.sqrt((out * out).sum(axis=1))


def by_rows(df: DataFrame, f: Callable[[dict], list[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """``f`` of each row, as rows of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                columns = f(b.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return df.mapInArrow(run, schema)


def nearest(held: DataFrame, k: int, scale: str | None = None) -> DataFrame:
    """(id, far, other): of each point of ``held`` (blocks) the ``k``-th nearest other point and its distance; null if there are fewer."""
    last = F.try_element_at("found", F.lit(k))
    return neighbours(held, k, scale).select("id", last["far"].alias("far"), last["other"].alias("other"))


def neighbours(held: DataFrame, k: int, scale: str | None = None) -> DataFrame:
    """(id, found): of each point of ``held`` (blocks) the ``k`` nearest other points, nearest first, as structs of far and other; fewer if there are fewer.

    With ``scale``, an array column of cluster sizes, distances are those of Ward's linkage: sqrt(2 a b / (a + b)) times the distance of the centres. Of equally far
    points the least id is nearer. A block first looks into itself; what it finds bounds how far away the blocks lie that it meets.
    """

    def weigh(d: np.ndarray, a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray:
        return d if a is None else d * np.sqrt(2 * a[:, None] * b[None, :] / (a[:, None] + b[None, :]))

    def best(d: np.ndarray, ids: np.ndarray, some: int) -> list[list[tuple[float, int]]]:
        """Of each row of ``d`` the least, of equal ones that of the least id: one pass over the rows for each."""
        order = np.argsort(ids)
        d, ids, rows = d.round(9)[:, order], ids[order], np.arange(len(d))
        out: list[list[tuple[float, int]]] = [[] for _ in rows]
        for _ in range(min(some, d.shape[1])):
            at = d.argmin(axis=1)
            for found, far, other in zip(out, d[rows, at].tolist(), ids[at].tolist(), strict=True):
                if far < np.inf:
                    found.append((far, other))
            d[rows, at] = np.inf
        return out

    def own(row: dict) -> list:
        p, ids = points_of(row), np.asarray(row["ids"])
        w = np.asarray(row[scale], float) if scale else None
        d = weigh(distances(p, p), w, w)
        np.fill_diagonal(d, np.inf)
        found = best(d, ids, k)
        return [ids, found, [f[-1][0] if len(f) == k else float("inf") for f in found]]

    pair = pa.list_(pa.struct([("far", pa.float64()), ("other", pa.int64())]))
    tuples = lambda found: [[{"far": a, "other": b} for a, b in f] for f in found]
    self_ = staged(by_rows(held, lambda r: (lambda o: [o[0], tuples(o[1]), o[2]])(own(r)), "id long, found array<struct<far:double,other:long>>, bound double", [pa.int64(), pair, pa.float64()]), "own-neighbours")
    # the bound of a point goes back to its block
    each = held.select("block", F.posexplode("ids").alias("at", "id")).join(self_.select("id", "bound"), "id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "bound"))).alias("b"))
    extent = held.agg(F.min("box.min_x"), F.max("box.max_x"), F.min("box.min_y"), F.max("box.max_y"), F.min("low"), F.max("high")).first()
    across = 1.0 if extent[0] is None else float(np.sqrt(sum((extent[i + 1] - extent[i]) ** 2 for i in (0, 2, 4)))) + 1.0
    # Ward's factor is at least sqrt(2 a / (a + 1)), 1 for single points
    bounded = held.join(each.select("block", F.col("b.bound").alias("bounds")), "block").withColumn("reach", F.least(F.array_max("bounds"), F.lit(across)))
    pairs = near_pairs(bounded, held, "reach").where("block <> o_block")

    def cross(row: dict) -> list:
        p, q, ids, o_ids = points_of(row), points_of(row, "o_"), np.asarray(row["ids"]), np.asarray(row["o_ids"])
        a, b = (np.asarray(row[scale], float), np.asarray(row[f"o_{scale}"], float)) if scale else (None, None)
        limit = np.asarray(row["bounds"], float)
        # points whose bound doesn't reach the other block, and points of it that no bound reaches, aren't compared
        least = 1.0 if a is None else np.sqrt(2 * a * b.min() / (a + b.min()))
        some = np.flatnonzero(gaps(p, q) * least <= limit + SLACK)
        if not len(some):
            return [some, []]
        p, ids, limit, a = p[some], ids[some], limit[some], None if a is None else a[some]
        there = np.flatnonzero(gaps(q, p) * (1.0 if a is None else np.sqrt(2 * b * a.min() / (b + a.min()))) <= limit.max() + SLACK)
        if not len(there):
            return [there, []]
        d = weigh(distances(p, q[there]), a, None if b is None else b[there])
        d[d.round(9) > limit[:, None]] = np.inf
        some = np.flatnonzero(np.isfinite(d).any(axis=1))
        return [ids[some], tuples(best(d[some], o_ids[there], k))]

    met = by_rows(pairs, cross, "id long, found array<struct<far:double,other:long>>", [pa.int64(), pair])
    return self_.select("id", "found").unionByName(met).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def near_links(vectors: DataFrame, eps: float, block: int = 2048) -> DataFrame:
    """(src, dst): links that join whatever pairs of ``vectors`` (id long, v array<double>) of one width at most ``eps`` apart join; fewer than all such pairs.

    Blocks of vectors meet whole; of a pair of blocks each vector gives at most one link, to the least id that it hangs together with there. Blocks whose first coordinates are
    further apart than ``eps`` don't meet. Pairs near the limit are measured component by component. Null vectors and those with null or non-finite components have no link.
    """
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = staged(vectors.where(F.col("v").isNotNull() & (F.size("v") > 0) & sound).select("id", "v", F.size("v").alias("width"), F.col("v")[0].alias("first")), "vectors")
    runs = sorted_runs(rows, ["width", "first", "id"], "runs")
    held = runs.groupBy("width", (F.shiftleft(F.col("_run").cast("long"), 32) + F.floor(F.col("_place") / block)).alias("block")).agg(F.min("first").alias("low"), F.max("first").alias("high"), F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"))
    held = staged(held, "blocks")
    told = held.select("width", "block", "low", "high")  # a row for each block
    other = told.select("width", *(F.col(c).alias(f"o_{c}") for c in ("block", "low", "high")))
    # a margin for how differences are rounded; what is farther apart is told in the block
    pairs = told.join(other, "width").where((F.col("block") <= F.col("o_block")) & (F.col("low") <= F.col("o_high") + eps * 1.000001) & (F.col("o_low") <= F.col("high") + eps * 1.000001)).select("width", "block", "o_block")
    right = held.select("width", F.col("block").alias("o_block"), F.col("ids").alias("o_ids"), F.col("vs").alias("o_vs"))
    met = pairs.repartition("block", "o_block").join(held.select("width", "block", "ids", "vs").hint("merge"), ["width", "block"]).join(right.hint("merge"), ["width", "o_block"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                a_ids, a, o_ids, o = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(1, 5))
                width = b.column(0)[k].as_py()
                src, dst = _linked(a_ids, a.reshape(-1, width), o_ids, o.reshape(-1, width), eps)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return met.select("width", "ids", "vs", "o_ids", "o_vs").mapInArrow(links, "src long, dst long")


def _linked(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Each id with the least that it hangs together with by pairs of ``a`` and ``b`` at most ``eps`` apart, if that is another."""
    with np.errstate(all="ignore"):
        aa, bb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
        square = aa + bb - 2 * (a @ b.T)
        slack = 1e-9 * (aa + bb) + 1e-12
        near = square < eps * eps - slack
        i, j = np.nonzero(~near & ~(square > eps * eps + slack))
        for at in range(0, len(i), 1 << 14):  # too near the limit for that: added up one after the other
            x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            near[x, y] = np.sqrt(np.cumsum((a[x] - b[y]) ** 2, axis=1)[:, -1]) <= eps
    i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, left, right = near[np.ix_(i, j)], a_ids[i].copy(), b_ids[j].copy()
    most = np.iinfo(np.int64).max
    while len(i):
        new_right = np.minimum(right, np.where(near, left[:, None], most).min(axis=0))
        new_left = np.minimum(left, np.where(near, new_right[None, :], most).min(axis=1))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    src, dst = np.concatenate([a_ids[i], b_ids[j]]), np.concatenate([left, right])
    return src[src != dst], dst[src != dst]
