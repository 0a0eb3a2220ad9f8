"""Exact top-k by inner product over norm-sorted vectors.

Vectors are laid out by descending length in blocks, rotated into the axes of a singular value decomposition, so that
their first coordinates carry most of an inner product. A block of queries meets blocks of candidates in that order: a
query is done with a slice once its k-th best score so far is no less than its length times that of the longest vector to
come. Within a block the first coordinates give partial sums, and by Cauchy-Schwarz what is left is at most the product of
the lengths of the remaining parts; only candidates that may still reach the k-th best are scored, in exact integers (doubles
while products of lengths stay below 2^52, Python integers beyond). The longest block goes first: what it gives rules out pairs of blocks before
their vectors are shipped, and vectors are shipped as whole numbers of as few bytes as they fit in.

The rotation only orders the work: it is fitted on a bounded sample, and bounds are widened for rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwright.staging import staged

SCALE, BLOCK, QUERY_BLOCK, SLICE_BLOCKS = 256, 2048, 1024, 32
#: Vectors that the rotation is fitted on, at most about.
ROTATION_SAMPLE = 4096
#: Coordinates of the partial sums, as a share of all.
HEAD = 0.25
#: Below any score: of those kept as longs, of those kept as Python integers.
NOTHING, BELOW_ALL = -(1 << 62), -(1 << 2200)


def _rotation(vectors: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """For each dimension the axes by falling share of a sample's squared length."""
    n = vectors.count()
    share = min(1.0, ROTATION_SAMPLE / max(1, n))
    weigh = lambda x: x / max(1.0, np.abs(x).max())  # noqa: E731  # squares stay finite
    rows = vectors.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * ROTATION_SAMPLE).select("v").collect()
    out = {}
    for d in dims:
        x = np.array([weigh(np.array(r["v"])) for r in rows if len(r["v"]) == d], np.float64).reshape(-1, d)
        out[d] = np.linalg.svd(x, full_matrices=True)[2] if len(x) else np.eye(d)
    return out


def _narrow(v: np.ndarray, scale: int) -> bytes:
    """Components as whole numbers of two or four bytes where they fit (a block has one width), else as they are; the first byte tells."""
    with np.errstate(over="ignore"):
        x = np.rint(v * scale)
        most = np.abs(x).max(initial=0)
    return b"2" + x.astype("<i2").tobytes() if most < 1 << 15 else b"4" + x.astype("<i4").tobytes() if most < 1 << 31 else b"8" + v.astype("<f8").tobytes()


def _widen(data: bytes, d: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, the same times ``scale`` and rounded)"""
    if data[:1] == b"8":
        raw = np.frombuffer(data, "<f8", offset=1).reshape(-1, d)
        return raw, np.rint(raw * scale)
    x = np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).reshape(-1, d).astype(np.float64)
    return x / scale, x


def _pack(names: list[str], size: int, scale: int):
    """Rows of one dimension -> rows of blocks; a task's rows come in the order of the sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list]] = []

        def block() -> pa.RecordBatch:
            ids = np.array([r[0] for r in held], "<i8")
            v = np.array([r[1] for r in held], "<f8")
            with np.errstate(over="ignore"):
                top = float(np.sqrt((v**2).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), pa.array([top]), pa.array([ids.tobytes()], pa.binary()), pa.array([_narrow(v, scale)], pa.binary())], names)

        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (len(held) == size or len(held[0][1]) != len(v)):
                    yield block()
                    held = []
                held.append((key, v))
        if held:
            yield block()

    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row's candidates: highest score, then smallest id."""
    if scores.dtype == object:
        order = np.array([sorted(range(len(r)), key=lambda i: (-r[i], j[i]))[:k] for r, j in zip(scores.tolist(), ids.tolist(), strict=True)])
    else:
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.rint(v * scale)
    return np.array([[int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(x, y, strict=True)] for x, y in zip(v.tolist(), scaled.tolist(), strict=True)], object).reshape(v.shape)


def _order(score: int) -> bytes:
    """Bytes in the order of scores; one and the same for all that fit in a long."""
    if -(1 << 63) <= score < 1 << 63:
        return b"\x80"
    size = (score.bit_length() + 8) // 8
    digits = abs(score).to_bytes(size, "big")
    return b"\x81" + size.to_bytes(2, "big") + digits if score > 0 else b"\x7f" + bytes(255 - x for x in size.to_bytes(2, "big") + digits)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """For each row whose id is divisible by ``every``, the ``k`` rows of highest inner product with it.

    Components are floor(scale * x). Returns query_id, rank (from 1), ``id_col`` and score (long); ties go to the smaller id.
    Fewer candidates than k: all of them. Vectors that are null, empty, or hold a null or non-finite component, and null ids
    take no part; vectors meet only those of as many components. Scores are exact at any length: a score beyond a long is ranked as
    any other, and given as null. An id names a row: rows of the query's id aren't its candidates, and repeated rows of
    another id are candidates each; repeated queries give their rows once. Further columns are ignored.
    """
    # long components are whole numbers after scaling, and stay as they are so that none overflows
    v = F.transform(vector_col, lambda x: F.when(F.abs(x.cast("double")) * scale < float(1 << 52), F.floor(x.cast("double") * scale).cast("double") / scale).otherwise(x.cast("double")))
    fine = F.size(vector_col).cast("long") > 0
    fine &= F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = staged(rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    names = ["dims", "top", "ids", "data"]
    kinds = "dims int, top double, ids binary, data binary"
    # longest first, dealt over tasks by length; equal vectors are told apart by a hash, so none piles up
    ordered = rows.withColumn("mix", F.xxhash64("id", "v")).repartitionByRange(F.size("v"), F.desc("norm"), "mix").sortWithinPartitions(F.size("v"), F.desc("norm"), "mix").select("id", "v")
    blocks = ordered.mapInArrow(_pack(names, BLOCK, scale), kinds)
    asked = rows.where(F.col("id") % every == 0).select("id", "v").distinct()
    asked = asked.repartitionByRange(F.size("v"), "id").sortWithinPartitions(F.size("v"), "id").mapInArrow(_pack(names, QUERY_BLOCK, scale), kinds)
    asked = staged(asked.withColumn("q", F.monotonically_increasing_id()), "query-blocks")
    blocks = staged(blocks.withColumn("b", F.monotonically_increasing_id()), "blocks")
    dims = [r[0] for r in blocks.select("dims").distinct().collect()]
    turn = vectors.sparkSession.sparkContext.broadcast(_rotation(rows, dims))
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        least_of = lambda a: BELOW_ALL if a.dtype == object else NOTHING

        def out() -> pa.RecordBatch:
            ids, best, found = state["ids"], state["best"], state["found"]
            real = (best > least_of(best)).astype(bool).ravel()
            scores = [int(x) for x in best.ravel()[real]]
            order = [_order(x) for x in scores]
            scores = [x if o == b"\x80" else None for x, o in zip(scores, order, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(int(real.sum()), state["q"], np.int64)), pa.array(np.repeat(ids, k)[real]), pa.array(found.ravel()[real]), pa.array(scores, pa.int64()), pa.array(order, pa.binary()), pa.array(np.repeat(state["norm"], k)[real])], ["q", "query_id", "cand", "score", "size", "norm"])

        np.seterr(over="ignore", invalid="ignore")
        for b in batches:
            for q, s, kind, d, _, ids, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(ids, "<i8")
                raw, x = _widen(data, d, scale)
                if kind == 0:
                    if state:
                        yield out()
                    axes = turn.value[d]
                    n = max(1, round(d * HEAD))
                    turned = x @ axes.T
                    state = {"q": q, "ids": ids, "raw": raw, "x": x, "head": turned[:, :n], "rest": np.sqrt((turned[:, n:] ** 2).sum(axis=1)), "norm": np.sqrt((turned**2).sum(axis=1)), "axes": axes, "n": n}
                    state |= {"best": np.full((len(ids), k), NOTHING), "found": np.zeros((len(ids), k), np.int64)}
                    continue
                turned = x @ state["axes"].T
                n, norm = state["n"], np.sqrt((turned**2).sum(axis=1))
                most = float(state["norm"].max() * norm.max())
                # doubles are exact to 2^53; beyond that scores are Python integers
                large, huge = not most < 1 << 52, not most < 1e300
                if large and state["best"].dtype != object:
                    state["best"] = state["best"].astype(object)
                    state["best"][state["best"] == NOTHING] = BELOW_ALL
                nothing = least_of(state["best"])
                least = np.array([float(t) if abs(t) < 1 << 1000 else math.copysign(math.inf, 1 if t > 0 else -1) for t in state["best"][:, -1].tolist()]) if nothing == BELOW_ALL else state["best"][:, -1].astype(np.float64)
                slack = 1 + 1e-6 * state["norm"] * norm.max()
                live = np.arange(len(least)) if huge else np.flatnonzero(state["norm"] * norm.max() + slack >= least)
                if not len(live):
                    continue
                rest = np.sqrt((turned[:, n:] ** 2).sum(axis=1))
                bound = state["head"][live] @ turned[:, :n].T + state["rest"][live][:, None] * rest[None, :]
                may = np.ones(bound.shape, bool) if huge else bound + slack[live][:, None] >= least[live][:, None]
                wanted = np.flatnonzero(may.any(axis=0))
                if not len(wanted):
                    continue
                if large:
                    score = _whole(state["raw"][live], scale) @ _whole(raw[wanted], scale).T
                else:
                    score = (state["x"][live] @ x[wanted].T).astype(np.int64)
                    score = score.astype(object) if nothing == BELOW_ALL else score
                score[state["ids"][live][:, None] == ids[wanted][None, :]] = nothing
                if score.shape[1] > k and nothing == NOTHING:
                    part = np.partition(score, -k, axis=1)[:, -k]
                    rows_, cols = np.nonzero(score >= np.maximum(part, state["best"][live][:, -1])[:, None])
                    many = np.bincount(rows_, minlength=len(live)).max(initial=0)
                    at = np.arange(len(rows_)) - np.searchsorted(rows_, rows_)
                    s2, i2 = np.full((len(live), many), NOTHING), np.zeros((len(live), many), np.int64)
                    s2[rows_, at], i2[rows_, at] = score[rows_, cols], ids[wanted][cols]
                else:
                    s2, i2 = score, np.broadcast_to(ids[wanted], score.shape)
                state["best"][live], state["found"][live] = _best(np.hstack([state["best"][live], s2]), np.hstack([state["found"][live], i2]), k)
        if state:
            yield out()

    def meet(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
        """Scores of the pairs (q, b, slice) of query blocks and candidate blocks; a slice of a query block is one task's."""
        send = candidates.join(pairs, "b").select("q", "slice", F.lit(1).alias("kind"), "dims", "top", "ids", "data")
        send = send.unionByName(asked.join(pairs.select("q", "slice").distinct(), "q").select("q", "slice", F.lit(0).alias("kind"), "dims", "top", "ids", "data"))
        dealt = send.repartition("q", "slice").sortWithinPartitions("q", "slice", "kind", F.desc("top"))
        return dealt.mapInArrow(search, "q long, query_id long, cand long, score long, size binary, norm double")

    first, found = search_pairs(blocks, asked, meet, k, scale)
    by = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("score"), "cand")
    found = first.unionByName(found)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", F.col("cand").alias(id_col), "score")


def search_pairs(blocks: DataFrame, asked: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame], k: int, scale: int) -> tuple[DataFrame, DataFrame]:
    """(what the longest block of each dimension gives, what the rest does).

    The longest vectors come first, one block for each number of components; what they give bounds every query's k-th score from below. Of the rest only pairs of
    blocks go on whose longest vectors' product reaches the least of these bounds, so what is shipped shrinks with how the lengths vary. Pairs are made from metadata alone.
    """
    heads = asked.select("q", F.col("dims").alias("q_dims"), (F.length("ids") / 8).cast("long").alias("many"))
    longest = blocks.groupBy("dims").agg(F.max(F.struct("top", "b"))["b"].alias("b"))
    longest = staged(longest, "longest-blocks")
    ahead = longest.join(heads, F.col("dims") == F.col("q_dims")).select("q", "b", F.lit(0).alias("slice"))
    first = staged(meet(blocks, staged(ahead, "first-pairs")), "first-scores")
    # a query's k-th score over its own length is what a candidate's length has to reach; a query without length ties with all
    each = first.groupBy("q", "query_id").agg(F.count("score").alias("n"), F.min("score").alias("least"), F.max("norm").alias("norm"))
    floor = each.where((F.col("n") >= k) & (F.col("norm") > 0)).groupBy("q").agg(F.count("*").alias("full"), F.min(F.col("least") / F.col("norm")).alias("least"))
    told = heads.join(floor, "q", "left").select("q", "q_dims", F.when(F.col("full") == F.col("many"), F.col("least")).alias("floor"))
    rest = blocks.select("b", "dims", "top").join(longest.select("b"), "b", "left_anti")
    slices = max(1, blocks.count() // SLICE_BLOCKS)
    # slices hold blocks of all lengths, so that each begins with long ones
    reach = F.col("top") * float(scale) * (1 + 1e-9) + 1e-6
    met = (F.col("dims") == F.col("q_dims")) & (F.col("floor").isNull() | (reach >= F.col("floor")))
    pairs = rest.join(told, met).select("q", "b", F.pmod(F.xxhash64("b"), F.lit(slices)).cast("int").alias("slice"))
    return first, meet(blocks, staged(pairs, "pairs"))
