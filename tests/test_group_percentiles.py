import random

from pyspark.sql import functions as F

from planwright.operators import spatial
from planwright.operators.ordering import group_percentiles


def test_percentiles_of_groups(spark):
    rng = random.Random(4)
    rows = [(k, 0.0, 100.0, v, float(rng.randrange(3))) for k, n in ((1, 1), (2, 2), (3, 700), (4, 300)) for v in (rng.choice([rng.uniform(0, 100), 50.0, 0.0, 100.0]) for _ in range(n))]
    rows += [(5, 7.0, 7.0, 7.0, 1.0)] * 5
    df = spark.createDataFrame(rows, "k long, low double, high double, a double, b double")
    got = group_percentiles(df, ["k"], {"a": ("low", "high"), "b": ("low", "high")}, {"p1": 0.01, "p50": 0.5, "p99": 0.99}, "n", bins=8)
    want = df.groupBy("k").agg(F.count("*").alias("n"), *(F.percentile(c, p).alias(f"p{int(100 * p)}_{c}") for c in "ab" for p in (0.01, 0.5, 0.99)))
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nearest_of_counted_anchors(spark, monkeypatch):
    rng = random.Random(5)
    anchors = [(f, 100 * f + k, float(rng.randrange(60)), float(rng.randrange(60))) for f in (0, 1) for k in range(90)] + [(2, 999, None, 1.0)]
    points = [(i, rng.randrange(4), float(rng.randrange(-50, 90)), float(rng.randrange(60))) for i in range(700)]
    points += [(1000 + i, i % 2, 1e5 + 900.0 * i, float(rng.randrange(60))) for i in range(700)]
    a = spark.createDataFrame(anchors, "f int, anchor long, x double, y double")
    p = spark.createDataFrame(points, "id long, f int, x double, y double")
    used = []
    inner = spatial._nearest_of_counted
    monkeypatch.setattr(spatial, "_nearest_of_counted", lambda *args: used.append(1) or inner(*args))
    got = {r.id: r.anchor for r in spatial.nearest_points(p, a, "id", "anchor", 4.0, keys=("f",)).collect()}
    for i, f, x, y in points:
        own = [((x - c) ** 2 + (y - d) ** 2, k) for g, k, c, d in anchors if g == f and c is not None]
        assert got[i] == (min(own)[1] if own else None)
    assert used
