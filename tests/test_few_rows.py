"""Steps that take few rows in one task, or many rows of one place once, give what the general way gives."""

import random

from pyspark.sql import functions as F

from planwright.operators.graph import connected_components
from planwright.operators.spatial import nearest_points


def test_components_of_few_edges_are_those_of_rounds(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [("a", 7, 7), ("b", None, 3)]
    edges = spark.createDataFrame(rows, "f string, s long, d long")
    whole = edges.select(F.col("s").alias("src"), F.col("d").alias("dst"))
    held = edges.where("d is not null and s is not null").select(*(F.struct("f", F.col(c).alias("n")).alias(n) for c, n in (("s", "src"), ("d", "dst"))))
    for e in (whole, held):
        few, many = (sorted(map(str, connected_components(e, one_task=n).collect())) for n in (1000, 0))
        assert few == many and few


def test_points_and_anchors_of_one_place_meet_once(spark):
    points = spark.createDataFrame([(k, k % 2, float(k % 7), float(k % 5)) for k in range(4000)] + [(9000, 0, None, 1.0), (9001, 5, 1.0, 1.0)], "id long, f int, x double, y double")
    anchors = [(k, k % 2, float(k % 90 * 3), float(k % 70)) for k in range(3000, 0, -1)]
    found = nearest_points(points, spark.createDataFrame(anchors, "a long, f int, x double, y double"), "id", "a", 4.0, keys=("f",))
    want = {}
    for r in points.collect():
        near = [((r.x - x) ** 2 + (r.y - y) ** 2, a) for a, f, x, y in anchors if f == r.f] if r.x is not None and (r.id < 100 or r.id >= 9000) else None
        if near is not None:
            want[r.id] = min(near)[1] if near else None
    got = {r.id: r.a for r in found.collect()}
    assert len(got) == 4002 and got[9000] is None and got[9001] is None and all(got[k] == v for k, v in want.items())
    one = nearest_points(points, spark.createDataFrame(anchors[:3], "a long, f int, x double, y double"), "id", "a", 4.0, keys=("f",)).collect()
    assert {r.a for r in one if r.id < 4000} <= {2998, 2999, 3000} and len(one) == 4002
