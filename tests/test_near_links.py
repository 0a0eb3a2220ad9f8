"""Clusters of near vectors, found block by block, against all pairs."""

import math
import random

from planwright.operators import graph, nearby
from planwright.plans import shapes


def test_dbscan_by_blocks(spark):
    rng = random.Random(7)
    rows = [(k, [rng.choice([0.0, 3.0, 9.0]) + rng.gauss(0, 0.4) for _ in range(4)]) for k in range(220)]
    # pairs at the limit and just beyond it, one beside another's width, and what has no distance
    rows += [(300, [100.0, 0.0, 0.0, 0.0]), (301, [100.5, 0.0, 0.0, 0.0]), (302, [101.0000001, 0.0, 0.0, 0.0]), (303, [100.5]), (304, [100.6])]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [math.nan] * 4), (403, [math.inf] * 4), (404, [math.inf] * 4), (405, [1e200] * 4), (406, [1e200] * 4), (407, [1e200] * 3 + [-1e200])]
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    joined = set()
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and len(a) == len(b) and None not in a + b and math.sqrt(sum((x - y) ** 2 if abs(x - y) < 1e150 else math.inf for x, y in zip(a, b, strict=True))) <= 0.5:
                joined |= {i, j}
                u, v = sorted((find(i), find(j)))
                root[v] = u
    want = {k: find(k) if k in joined else -1 for k in root}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert dict(map(tuple, shapes.dbscan(df, 0.5).collect())) == want and len(set(want.values())) > 5
    links = nearby.near_links(df.selectExpr("vec_id as id", "embedding as v"), 0.5, block=16)
    found = {r.node: r.component for r in graph.connected_components(links).collect()}
    assert found == {k: v for k, v in want.items() if v >= 0}


def test_copies_give_a_link_each_not_all_pairs(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(500)], "id long, v array<double>").repartition(3)
    assert nearby.near_links(df, 0.1, block=4096).distinct().count() <= 3 * 500
