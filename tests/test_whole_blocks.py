"""Small blocks are dealt with whole, many in a task; results are those of the general way."""

import random

import numpy as np
from pyspark.sql import functions as F

from planwright.operators.community import block_communities, plain_communities
from planwright.operators.kernels import kmeans


def plain_kmeans(xy, k, rounds):
    """Every point against every centre."""
    centres, far = [xy[0]], ((xy - xy[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        centres.append(xy[far.argmax()])
        far = np.minimum(far, ((xy - centres[-1]) ** 2).sum(axis=1))
    c, own = np.array(centres), None
    for _ in range(rounds):
        new = ((xy[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        if own is not None and (new == own).all():
            break
        own = new
        n = np.bincount(own, minlength=k)
        mean = np.stack([np.bincount(own, xy[:, i], minlength=k) for i in (0, 1)], axis=1) / np.maximum(n, 1)[:, None]
        c = np.where(n[:, None] > 0, mean, c)
    return own


def test_kmeans_looks_at_near_centres_only_and_finds_the_same():
    rng = np.random.default_rng(2)
    for n, wide in ((2500, 90), (700, 4000), (40, 3), (2, 1), (1, 1)):
        xy = rng.integers(0, wide, (n, 2)).astype(float)
        for k in {min(n, max(2, n // 30)), n}:
            assert (kmeans(xy, k, 50) == plain_kmeans(xy, k, 50)).all()


def test_blocks_of_few_nodes_are_found_whole(spark):
    rng = random.Random(1)
    edges = sorted({(b, *sorted(rng.sample(range(b * 100, b * 100 + 12), 2))) for b in range(6) for _ in range(25)})
    edges = spark.createDataFrame([(*e, rng.choice([1, 10])) for e in edges], "block long, src long, dst long, weight long")
    nodes = edges.select("block", F.explode(F.array("src", "dst")).alias("node")).distinct().unionByName(spark.createDataFrame([(9, 950)], "block long, node long")).withColumn("twice_resolution", F.lit(3))
    want = []
    for b in range(6):
        own = [tuple(r) for r in edges.where(f"block = {b}").select("src", "dst", "weight").collect()]
        want += [(b, n, c) for n, c in plain_communities(own, {n for e in own for n in e[:2]}, 3).items()]
    assert sorted(map(tuple, block_communities(nodes, edges).select("block", "node", "community").collect())) == sorted([*want, (9, 950, 950)])
