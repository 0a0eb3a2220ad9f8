"""Dual-tree rounds against plain Lloyd rounds in Python integers, the trees' own laws, and odd vectors."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from planwright.llm import clustering, queries


def plain(rows, dims=64, scale=64, clusters=16, rounds=3):
    """(vec_id, vector) to the query's rows."""
    vs = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    firsts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in vs if i is not None)
    cs = [v for _, v in firsts[:clusters]]
    if not cs:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for _ in range(rounds):
        held = [[] for _ in cs]
        for _, v in vs:
            held[min(range(len(cs)), key=lambda k: (far(v, cs[k]), k))].append(v)
        cs = [[sum(x) // len(h) for x in zip(*h, strict=True)] if h else c for h, c in zip(held, cs, strict=True)]
    got = [(i, *min((far(v, c), k) for k, c in enumerate(cs))) for i, v in vs]
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    per = {k: None if any(d >= 1 << 63 for _, d, c in got if c == k) else sum(d for _, d, c in got if c == k) for k in range(len(cs))}
    whole = None if None in per.values() else sum(per.values())
    return [(i, k, fits(d), fits(per[k]), fits(whole), hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for i, d, k in got]


def same(df, rows, **how):
    show = lambda found: sorted(map(str, map(tuple, found)))
    assert show(df.collect()) == show(plain(rows, **how))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    same(queries.op13_clustering(spark, sf), [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()])


def test_cover_tree_laws():
    rng = np.random.default_rng(0)
    for points in (rng.integers(-9, 9, (500, 3)), np.repeat(rng.integers(-50, 50, (40, 5)), 9, axis=0), rng.integers(-100, 100, (300, 64)), np.zeros((30, 2), int)):
        t = clustering.CoverTree(points)
        rows = points[t.order].astype(float)
        assert sorted(t.order) == list(range(len(points))) and (t.begin[0], t.end[0]) == (0, len(points))
        for i, kids in enumerate(t.kids):
            far = np.sqrt(((rows[t.begin[i] : t.end[i]] - rows[t.centre[i]]) ** 2).sum(axis=1))
            assert far.max() <= t.radius[i]
            if kids:
                assert sorted((t.begin[k], t.end[k]) for k in kids)[0][0] == t.begin[i] and sum(t.end[k] - t.begin[k] for k in kids) == t.end[i] - t.begin[i]
                own = {t.centre[k] for k in kids}
                reach = 2.0 ** (np.ceil(np.log2(far.max())) - 1)
                assert all(np.sqrt(((rows[a] - rows[b]) ** 2).sum()) > reach for a in own for b in own if a < b)


def test_pairs_leave_out_only_what_is_farther():
    """And on vectors that lie in clusters most are settled above the leaves."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-900, 900, (8, 16))
    points = np.vstack([m + rng.integers(-9, 10, (200, 16)) for m in middles])
    block = clustering.Block(list(range(len(points))), points)
    compared = 0
    for begin, end, cands in clustering.pairs(block, middles, clustering.CoverTree(middles, leaf=1)):
        exact = clustering.squared(block.vectors[begin:end], middles)
        assert all((exact.min(axis=1) == exact[:, cands].min(axis=1)).tolist())
        compared += (end - begin) * len(cands) * (len(cands) > 1)
    assert compared < len(points)


@pytest.mark.parametrize("seed", [1, 2])
def test_small_grids_with_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), [rng.randint(-2, 2) / 2 for _ in range(3)]) for _ in range(400)]  # ids repeat, many ties and copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    same(clustering.cluster_vectors(df, dims=3, scale=2, clusters=7, rounds=4, block=64), rows, dims=3, scale=2, clusters=7, rounds=4)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (None, [9.0, 9.0]), (7, [3e38, -3e38]), (8, [-0.01, 5e6]), (9, [])]
    rows += [(100 + k, [k / 7, -k / 3]) for k in range(50)] + [(1000, [2.0, 2.0])] * 200
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, ids int")
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    same(clustering.cluster_vectors(df, dims=2, block=32), rounded, dims=2)
    few = df.where("vec_id < 2 or vec_id = 8")
    same(clustering.cluster_vectors(few, dims=2), [r for r in rounded if r[0] in (1, 8)], dims=2)
    assert clustering.cluster_vectors(df.limit(0)).collect() == [] and clustering.cluster_vectors(df, dims=64).collect() == []
