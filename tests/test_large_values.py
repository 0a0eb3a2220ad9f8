"""What only larger tables bring: numbers beyond an integer, values and groups that are too many for one task."""

import random

from pyspark.sql import functions as F

from planwright.operators.ordering import exact_percentiles
from planwright.plans import layouts

REGIONS = "region_id long, file_id long, layout_id long, chunk_id long, x0 double, y0 double, w double, h double"


def test_areas_beyond_an_integer(spark):
    rows = [(1, 0, 0, 0, 0.0, 0.0, 1.0, 1.0), (2, 0, 0, 1, 9e6, 4000.0, 2.0, 1.0), (3, 0, 1, 0, 9e9, 0.0, 2.0, 2.0)]
    got = {r.layout_id: r for r in layouts.layouts(spark.createDataFrame(rows, REGIONS)).collect()}
    assert got[0].px_area == 4500001.0 * (2510 - 509) and got[0].px_max_x == 4500001
    assert got[1].px_min_x == 4_500_000_000 and got[1].px_area == 1.0


def test_percentiles_without_all_values_in_one_task(spark):
    rng = random.Random(4)
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.77, "e": 1.0}
    for rows in ([rng.choice([None, 1.5, -0.0, rng.gauss(0, 9)]) for _ in range(997)], [7.0], [1.0, 2.0], [None], []):
        df = spark.createDataFrame([(v,) for v in rows], "v double").repartition(5)
        want = df.agg(*(F.percentile("v", p).alias(n) for n, p in shares.items()))
        got = exact_percentiles(df, "v", shares)
        assert got.collect() == want.collect()
    # the old plan merged a map of all values in one task
    plan = layouts.prune_iqr(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
