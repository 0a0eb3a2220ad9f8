"""Neighbours, spanning trees, density clusters and Ward's linkage against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from planwright.operators import hierarchy, nearby
from planwright.plans import registry, shapes  # noqa: F401

POINTS = "id long, x double, y double, z double"


def crowd(seed, n, copies=0):
    rng = random.Random(seed)
    middles = [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-2, 2)) for _ in range(6)]
    rows = [(k, *(round(rng.gauss(c, 0.4), 3) for c in rng.choice(middles))) for k in range(n - n // 10)]
    rows += [(k, *(round(rng.uniform(-30, 30), 3) for _ in range(3))) for k in range(n - n // 10, n)]
    return rows + [(n + k, *rows[0][1:]) for k in range(copies)]


def matrix(rows):
    p = np.array([r[1:] for r in rows])
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))


def test_nearest(spark):
    rows = crowd(1, 260)
    held = nearby.blocks(spark.createDataFrame(rows, POINTS), [], 32)
    assert held.count() >= 8
    d = matrix(rows).round(9)
    for k in (1, 3):
        got = {r.id: (r.far, r.other) for r in nearby.nearest(held, k).collect()}
        for i in range(len(rows)):
            want = sorted((d[i, j], j) for j in range(len(rows)) if j != i)[k - 1]
            assert abs(got[i][0] - want[0]) < 1e-9 and got[i][1] == want[1]


def plain_tree(rows, samples):
    d = matrix(rows)
    core = np.sort(d, axis=1)[:, min(samples, len(rows)) - 1]
    w = np.maximum(np.maximum(core[:, None], core[None]), d).round(9)
    ids = [r[0] for r in rows]
    return hierarchy.kruskal([(float(w[i, j]), min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(rows)) for j in range(i)])


def plain_labels(ids, tree, least):
    """The same clusters from the definition, by taking the longest edges out of sets."""
    order = sorted(tree)

    def split(some):
        """The two sides of the last merge within ``some`` and its height."""
        last = max(e for e in order if e[1] in some and e[2] in some)
        sides, links = [], defaultdict(set)
        for w, a, b in order:
            if a in some and b in some and (w, a, b) != last:
                links[a].add(b)
                links[b].add(a)
        for start in last[1:]:
            seen, work = {start}, [start]
            while work:
                for x in links[work.pop()] - seen:
                    seen.add(x)
                    work.append(x)
            sides.append(frozenset(seen))
        return sides, 1 / max(last[0], 1e-12)

    def cluster(some, birth):
        """(stability, best clusters) below and with this one."""
        now, score = some, 0.0
        while True:
            if len(now) == 1:
                return score, (score, [some])
            sides, lam = split(now)
            big = [s for s in sides if len(s) >= least]
            score += sum(len(s) for s in sides if len(s) < least) * (lam - birth)
            if len(big) == 2:
                score += len(now) * (lam - birth)
                below = [cluster(s, lam)[1] for s in big]
                inner = sum(b[0] for b in below)
                return score, ((score, [some]) if score >= inner else (inner, below[0][1] + below[1][1]))
            if not big:
                return score, (score, [some])
            now = big[0]

    now, out = frozenset(ids), dict.fromkeys(ids, -1)
    while len(now) > 1:  # the whole is never a cluster
        sides, lam = split(now)
        big = [s for s in sides if len(s) >= least]
        if len(big) == 2:
            for s in big:
                for c in cluster(s, lam)[1][1]:
                    for x in c:
                        out[x] = min(c)
            break
        if not big:
            break
        now = big[0]
    return out


@pytest.mark.parametrize("seed, n, copies, task", [(2, 150, 0, 10**6), (3, 120, 7, 60), (4, 90, 2, 10**6)])
def test_density_clusters(spark, seed, n, copies, task):
    rows = crowd(seed, n, copies)
    got = {r.id: r.cluster_id for r in hierarchy.density_clusters(spark.createDataFrame(rows, POINTS), block=24, one_task=task).collect()}
    own = {}
    for r in rows:
        own.setdefault(r[1:], r[0])
    places = [(k, *p) for p, k in own.items()]
    d = matrix(rows)
    core = {r[0]: float(np.sort(d[i])[2]) for i, r in enumerate(rows)}
    w = matrix(places)
    tree = hierarchy.kruskal([(round(max(core[places[i][0]], core[places[j][0]], w[i, j]), 9), min(places[i][0], places[j][0]), max(places[i][0], places[j][0])) for i in range(len(places)) for j in range(i)])
    tree += [(core[r[0]], own[r[1:]], r[0]) for r in rows if own[r[1:]] != r[0]]
    assert got == plain_labels([r[0] for r in rows], tree, 3)
    assert len(set(got.values())) > 3


def test_ward_rounds_equal_plain_and_heights(spark):
    rows = crowd(5, 140, 3)
    df = spark.createDataFrame(rows, POINTS)
    one = {r.id: r.cluster_id for r in hierarchy.ward_clusters(df, 3.0).collect()}
    many = {r.id: r.cluster_id for r in hierarchy.ward_clusters(df, 3.0, block=24, one_task=20).collect()}
    # Ward by the textbook: always the closest two
    now = {r[0]: (1.0, np.array(r[1:])) for r in rows}
    home = {r[0]: [r[0]] for r in rows}
    while True:
        best = min(((round(float(np.sqrt(2 * now[a][0] * now[b][0] / (now[a][0] + now[b][0])) * np.sqrt(((now[a][1] - now[b][1]) ** 2).sum())), 9), a, b) for a in now for b in now if a < b), default=(9e9, 0, 0))
        if best[0] > 3.0:
            break
        _, a, b = best
        n = now[a][0] + now[b][0]
        now[a] = (n, (now[a][1] * now[a][0] + now[b][1] * now[b][0]) / n)
        home[a] += home.pop(b)
        del now[b]
    want = {x: min(found) for found in home.values() for x in found}
    assert one == many == want and 3 < len(home) < 60


def test_few_points(spark):
    two = spark.createDataFrame(crowd(1, 2), POINTS)
    assert {r.cluster_id for r in hierarchy.density_clusters(two).collect()} == {0} == {r.cluster_id for r in hierarchy.ward_clusters(two, 1.0).collect()}
    same = spark.createDataFrame([(k, 1.0, 1.0, 1.0) for k in range(9)], POINTS)
    assert {r.cluster_id for r in hierarchy.ward_clusters(same, 1.0).collect()} == {0}
    assert len(hierarchy.density_clusters(same).collect()) == 9


def test_reduction_keeps_the_main_axes(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8)) * np.array([9, 1, 5, 0.1, 0.1, 3, 0.1, 0.1]) + 1
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)] + [(900, None), (901, [0.0] * 8)], "vec_id long, embedding array<double>")
    got = {r.id: (r.x, r.y, r.z) for r in nearby.reduced(df, "vec_id", "embedding").collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    centred = unit - unit.mean(axis=0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    want = np.abs(centred @ axes[:3].T)
    assert sorted(got) == list(range(200)) and np.abs(np.abs(np.array([got[k] for k in range(200)])) - want).max() < 1e-5


def test_queries_cover_the_table(spark):
    for name in ("c1_hdbscan", "c1_ward"):
        rows = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert len(rows) == 500 == len({r.vec_id for r in rows})
