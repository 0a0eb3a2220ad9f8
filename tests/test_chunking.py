"""Communities and chunks: rounds of joins against plain loops, and the laws that they keep."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from planwright.operators import chunking, community


def quality(edges, home, r):
    m = sum(w for *_, w in edges)
    inside, degree = defaultdict(int), defaultdict(int)
    for u, v, w in edges:
        degree[home[u]] += w
        degree[home[v]] += w
        inside[home[u]] += w * (home[u] == home[v])
    return sum(inside[c] / m - r * (k / (2 * m)) ** 2 for c, k in degree.items())


def planted(rng, groups, size, inside=0.5, across=0.02):
    n = groups * size
    return [(a, b, rng.choice((1, 10))) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else across)]


def test_plain_communities_find_planted_ones():
    rng = random.Random(1)
    for r in (2, 3):
        edges = planted(rng, 5, 14)
        home = community.plain_communities(edges, range(70), r)
        assert quality(edges, home, r / 2) >= quality(edges, {n: n // 14 - n // 14 % 1 for n in range(70)}, r / 2) - 1e-9
        assert all(home[n] <= n and home[home[n]] == home[n] for n in range(70))


def test_modularity_never_falls():
    """Each level's partition is at least as good as the one before: the end is no worse than all alone, and no single move is left that gains."""
    rng = random.Random(2)
    for _ in range(10):
        edges = [(a, b, w) for a, b, w in planted(rng, 4, 8, 0.4, 0.1)]
        nodes = sorted({x for e in edges for x in e[:2]})
        home = community.plain_communities(edges, nodes, 2)
        assert quality(edges, home, 1.0) >= quality(edges, {n: n for n in nodes}, 1.0)
        whole = sorted(set(home.values()))
        for a in whole:  # no two communities would gain by joining
            for b in whole:
                if a < b:
                    assert quality(edges, {n: a if c == b else c for n, c in home.items()}, 1.0) <= quality(edges, home, 1.0) + 1e-12


def test_joins_give_the_plain_communities(spark):
    rng = random.Random(3)
    blocks = {7: (planted(rng, 3, 9), 27, 3), 8: (planted(rng, 2, 6, 0.9, 0.05), 14, 2), 9: ([(0, 1, 1)], 3, 4)}
    nodes = [(b, n, r) for b, (_, size, r) in blocks.items() for n in range(size)]
    edges = [(b, *e) for b, (found, _, _) in blocks.items() for e in found]
    n = spark.createDataFrame(nodes, "block long, node long, twice_resolution int")
    e = spark.createDataFrame(edges, "block long, src long, dst long, weight long")
    found = community.communities(n, e)
    got = {(r.block, r.node): r.community for r in found.collect()}
    want = {(b, k): c for b, (es, size, r) in blocks.items() for k, c in community.plain_communities(es, range(size), r).items()}
    assert got == want
    told = {r.block: r.modularity for r in community.modularity(n, e, found).collect()}
    for b, (es, size, r) in blocks.items():
        assert abs(told[b] - quality(es, {k: want[b, k] for k in range(size)}, r / 2)) < 1e-9


def rooms(rng, blocks, layout):
    """Rooms of squares in a row of halls, with thin walls and specks between them."""
    nodes, edges, at = [], [], 0
    for k in range(blocks):
        wide, high = rng.randrange(2, 7), rng.randrange(2, 5)
        first = len(nodes)
        for i in range(wide):
            for j in range(high):
                x, y, s = at + 10.0 * i, 10.0 * j + 3 * k, 9.0 + rng.random()
                nodes.append((layout, first + i * high + j, s * s, 4 * s, x + s / 2, y + s / 2, [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]))
                if j:
                    edges.append((layout, first + i * high + j - 1, first + i * high + j, 10))
                if i:
                    edges.append((layout, first + (i - 1) * high + j, first + i * high + j, 10))
        if first:
            edges.append((layout, first - 1, first, 1))
        at += 10 * wide + 40
    n = len(nodes)
    nodes.append((layout, n, 1.0, 4.0, 0.0, 0.0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]))  # a speck
    length = 3000.0
    nodes.append((layout, n + 1, length * 0.02, 2 * length, length / 2, 99.0, [(0.0, 99.0), (length, 99.0), (length, 99.02), (0.0, 99.02), (0.0, 99.0)]))  # a wall
    edges.append((layout, 0, n, 1))
    return nodes, edges


NODES = "layout long, node long, area double, perimeter double, x double, y double, ring array<struct<x:double,y:double>>"
EDGES = "layout long, src long, dst long, weight long"


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(4)
    made = [rooms(rng, b, layout) for layout, b in ((1, 5), (2, 2), (3, 8))]
    nodes, edges = [n for m in made for n in m[0]], [e for m in made for e in m[1]]
    return nodes, edges, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_rounds_give_the_plain_chunks(drawn):
    nodes, edges, n, e = drawn
    rows = lambda df: sorted(map(tuple, df.collect()))
    small = rows(chunking.chunk_layouts(n, e))
    assert small == rows(chunking.chunk_layouts(n, e, one_task=0))
    assert small == rows(chunking.chunk_layouts(n, e, one_task=40))
    want = []
    for layout in (1, 2, 3):
        own = {r[1]: (*r[2:6], np.array(r[6])) for r in nodes if r[0] == layout}
        parts = chunking.plain_chunks(own, [x[1:] for x in edges if x[0] == layout])
        want += [(layout, k, m, True) for k, p in enumerate(parts) for m in p]
    assert small == sorted(want) and len({r[:2] for r in small}) > 6


def test_laws_of_chunks(drawn):
    nodes, edges, n, e = drawn
    got = chunking.chunk_layouts(n, e).collect()
    for layout in (1, 2, 3):
        own = {r[1]: r for r in nodes if r[0] == layout}
        whole = sum(r[2] for r in own.values())
        speck, wall = sorted(own)[-2:]
        held = [r.node for r in got if r.layout == layout]
        assert len(held) == len(set(held)) and speck not in held and wall not in held
        for chunk in {r.chunk for r in got if r.layout == layout}:
            part = [r.node for r in got if r.layout == layout and r.chunk == chunk]
            assert sum(own[k][2] for k in part) >= chunking.KEEP * whole
            assert math.isfinite(sum(own[k][2] for k in part))


def test_overlap_adds_neighbours(drawn):
    nodes, edges, n, e = drawn
    core = {(r.layout, r.chunk, r.node) for r in chunking.chunk_layouts(n, e).collect()}
    wide = chunking.chunk_layouts(n, e, overlap=1).collect()
    assert {(r.layout, r.chunk, r.node) for r in wide if r.is_core} == core
    noise = {(layout, max(r[1] for r in nodes if r[0] == layout) - 1) for layout in (1, 2, 3)}
    near = {(a, c, v) for a, c, u in core for layout, s, d, _ in edges if layout == a for u2, v in ((s, d), (d, s)) if u2 == u and (a, v) not in noise}
    assert {(r.layout, r.chunk, r.node) for r in wide} == {x for x in core | near if x[1] is not None}


def test_empty(spark):
    assert chunking.chunk_layouts(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)).collect() == []
