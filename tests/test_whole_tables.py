"""Queries that SQL can't express, whole results against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwright.operators import kernels
from planwright.operators.chunking import plain_chunks
from planwright.operators.community import plain_communities
from planwright.operators.graph import connected_components
from planwright.operators.spatial import nearest_points
from planwright.plans import registry, shapes
from planwright.plans.joins import region_graph
from planwright.sources.drawings import drawing

SF = "/root/testdata/sf0.001"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def test_suppression(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        x, y = rng.randrange(200), rng.randrange(200)
        rows.append((k % 3, k, float(rng.randrange(5)), (float(x), float(y), float(x + rng.randrange(5, 60)), float(y + rng.randrange(5, 60)))))
    boxes = spark.createDataFrame(rows, "file_id long, region_id long, order double, box struct<min_x:double,min_y:double,max_x:double,max_y:double>")
    got = {tuple(r) for r in shapes.suppressed(boxes, 0.3, 32.0).collect()}
    want = set()
    for file in range(3):
        kept = []
        for _, k, _, b in sorted((r for r in rows if r[0] == file), key=lambda r: (r[2], r[1])):
            if all(iou(b, o) < 0.3 for o in kept):
                kept.append(b)
                want.add((file, k))
    assert got == want and len(want) < 250


def test_nearest_points(spark):
    rng = random.Random(9)
    points = [(k, float(rng.randrange(-3000, 3000)), float(rng.randrange(-50, 50))) for k in range(300)]
    anchors = [(k, float(rng.randrange(-20, 900)), float(rng.randrange(-50, 50))) for k in range(40)] + [(900, 5.0, 5.0), (901, 5.0, 5.0)]
    p, a = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(anchors, "anchor long, x double, y double")
    got = dict(map(tuple, nearest_points(p, a, "id", "anchor", 16.0).collect()))
    assert got == {k: min(((x - ax) ** 2 + (y - ay) ** 2, n) for n, ax, ay in anchors)[1] for k, x, y in points}
    assert set(dict(map(tuple, nearest_points(p, a.where("false"), "id", "anchor", 16.0).collect())).values()) == {None}


def test_kmeans_chunks(spark):
    got = registry.QUERIES["r4_kmeans_chunks"](spark, SF).collect()
    nodes = {r.region_id: r for r in drawing(spark, SF, "regions").collect()}
    assert {r.node for r in got} == set(nodes)
    by = {}
    for r in got:
        if r.is_core:
            by.setdefault(r.layout, {}).setdefault(r.chunk, []).append((nodes[r.node].x0, nodes[r.node].y0))
    own = {(r.layout, r.node): r.chunk for r in got if r.is_core}
    edges = {(e.src, e.dst) for e in region_graph(drawing(spark, SF, "regions"), 250.0).collect()}
    beside = {(la, b, c) for s, d in edges for a, b in ((s, d), (d, s)) for (la, n), c in own.items() if n == a and own.get((la, b), c) != c}
    assert {(r.layout, r.node, r.chunk) for r in got if not r.is_core} == beside and len(beside) > 5
    for chunks in by.values():
        centre = {c: (sum(x for x, _ in p) / len(p), sum(y for _, y in p) / len(p)) for c, p in chunks.items()}
        for c, p in chunks.items():  # a fixed point: every node is in the chunk of its nearest centre
            for x, y in p:
                far = {k: (x - u) ** 2 + (y - v) ** 2 for k, (u, v) in centre.items()}
                assert far[c] <= min(far.values()) + 1e-6


def test_merged_boxes(spark):
    """Of the whole table against rounds of all pairs."""
    got = {(r.layout, r.min_x, r.min_y, r.max_x, r.max_y) for r in registry.QUERIES["u5_merged_boxes"](spark, SF).collect()}

    def much(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        small = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
        return w > 0 and h > 0 and w * h >= 0.05 * small and w >= 0.15 * min(a[2] - a[0], b[2] - b[0]) and h >= 0.15 * min(a[3] - a[1], b[3] - b[1])

    layouts, want = {}, set()
    for r in drawing(spark, SF, "regions").collect():
        layouts.setdefault(r.file_id * 8 + r.layout_id, []).append((r.x0 - 25, r.y0 - 25, r.x0 + r.w + 25, r.y0 + r.h + 25))
    for layout, now in layouts.items():
        while True:
            parts = []
            for b in now:
                near = [p for p in parts if any(much(b, c) for c in p)]
                parts = [p for p in parts if p not in near] + [[b, *(c for p in near for c in p)]]
            joined = [(min(c[0] for c in p), min(c[1] for c in p), max(c[2] for c in p), max(c[3] for c in p)) for p in parts]
            if len(joined) == len(now):
                break
            now = joined
        want |= {(layout, *b) for b in now}
    assert got == want and len(got) < 1500



def test_components_raise_if_they_do_not_end(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long")
    with pytest.raises(RuntimeError):
        connected_components(path, rounds=1)
    assert {r.component for r in connected_components(path).collect()} == {0}


#: Compared with a plain version over the whole table elsewhere.
COMPARED = {"c1_hdbscan", "c1_ward", "g16_diameter", "q1_region_matches", "q5_isovist_matches", "q13_region_build", "k12_scored_candidates", "q4_scaled_matches", "r1_polygonise", "r3_communities", "r3_recursive_chunks", "r4_kmeans_chunks", "r12_seed_fill", "u5_merged_boxes"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - COMPARED))
def test_whole_result(spark, name):
    """Queries without SQL run to the end, and give the same rows twice."""
    q = registry.QUERIES[name]
    first = sorted(map(str, q(spark, SF).collect()))
    assert first == sorted(map(str, q(spark, SF).collect()))


def test_kmeans_of_few_nodes(spark):
    one = spark.createDataFrame([(1, 5, 0.0, 0.0)], "layout long, node long, x double, y double")
    assert kernels.kmeans_chunks(one, "layout").collect()[0].chunk == 0


def test_region_chunks_and_communities(spark):
    """Of all layouts of the table, against the plain loops."""
    nodes, edges = shapes.region_layouts(spark, SF)
    own, links = {}, {}
    for r in nodes.collect():
        own.setdefault(r.layout, {})[r.node] = (r.area, r.perimeter, r.x, r.y, np.array([tuple(p) for p in r.ring]))
    for r in edges.collect():
        links.setdefault(r.layout, []).append((r.src, r.dst, r.weight))
    home = {n: c for k, e in links.items() for n, c in plain_communities(e, own[k], 3).items()}
    got = registry.QUERIES["r3_communities"](spark, SF).collect()
    assert {r.node: r.community for r in got} == home and len(set(home.values())) < len(home) / 2
    core = sorted((k, i, n) for k, ns in own.items() for i, part in enumerate(plain_chunks(ns, links[k])) for n in part)
    found = registry.QUERIES["r3_recursive_chunks"](spark, SF).collect()
    assert sorted((r.layout, r.chunk, r.node) for r in found if r.is_core) == core and any(not r.is_core for r in found)
