"""Faces by joins against the walk around faces, regions with votes and closed gaps."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planwright.operators import faces, kernels
from planwright.plans import registry, shapes

SF = "/root/testdata/sf0.001"
LINES = "file_id int, line long, layer string, x1 double, y1 double, x2 double, y2 double"


def told(df, *keys):
    return Counter((*(r[k] for k in keys), round(r.area, 3), round(r.cx, 2) + 0.0, round(r.cy, 2) + 0.0, r.points) for r in df.collect())


def by_joins(df, keys, cell):
    return faces.face_table(faces.half_edges(faces.noded(df, keys, cell), keys), keys)


def test_whole_layers(spark):
    got = registry.QUERIES["r1_polygonise"](spark, SF)
    s = shapes.segments(spark, SF).withColumn("group_id", F.concat_ws("/", F.col("file_id").cast("string"), "layer"))
    want = told(kernels.polygonise(s, "group_id"), "group_id")
    assert told(got, "group_id") == want and sum(want.values()) > 1400


@pytest.mark.parametrize("seed", [1, 2])
def test_random_linework(spark, seed):
    """Slanted, crossing, touching and overlapping lines, in two drawings."""
    rng = random.Random(seed)
    rows = []
    for k in range(90):
        x, y = rng.randrange(0, 60), rng.randrange(0, 60)
        rows.append((k % 2, k, "a", float(x), float(y), float(x + rng.randrange(-25, 26)), float(y + rng.randrange(-25, 26))))
    rows += [(0, 900, "a", 0.0, 0.0, 60.0, 0.0), (0, 901, "a", 20.0, 0.0, 40.0, 0.0), (0, 902, "a", 5.0, 5.0, 5.0, 5.0), (1, 903, "a", None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, LINES)
    clean = df.where("x1 is not null and (x1 <> x2 or y1 <> y2)")
    assert told(by_joins(df, ["file_id"], 9.0), "file_id") == told(kernels.polygonise(clean, "file_id"), "file_id")


def square(file, line, layer, x, y, s, gap=0.0):
    return [(file, line, layer, x, y, x + s, y), (file, line + 1, layer, x + s, y, x + s, y + s), (file, line + 2, layer, x + s, y + s, x, y + s), (file, line + 3, layer, x, y + s, x, y + gap)]


def test_votes_and_gaps(spark):
    rows = square(0, 0, "wall", 0.0, 0.0, 10.0) + [(0, 10, "hatch", 2.0, 2.0, 3.0, 3.0), (0, 11, "hatch", 4.0, 4.0, 5.0, 5.0), (0, 12, "far", 40.0, 40.0, 50.0, 50.0), (0, 13, None, 1.0, 1.0, 2.0, 1.0)]
    rows += square(0, 20, "b", 20.0, 0.0, 5.0)[:3] + [(0, 23, "a", 20.0, 5.0, 20.0, 0.0), (0, 24, "a", 21.0, 5.0, 22.0, 5.0), (0, 25, "a", 23.0, 4.95, 24.0, 4.95)]
    rows += square(1, 30, "open", 0.0, 0.0, 8.0, gap=0.06) + square(2, 40, "open", 0.0, 0.0, 8.0, gap=0.6)
    got = {(r.file_id, round(r.area, 1)): (r.layer, r.votes) for r in faces.build_regions(spark.createDataFrame(rows, LINES), ["file_id"], 4.0).collect()}
    assert got == {(0, 100.0): ("wall", 4), (0, 25.0): ("a", 3), (1, 64.0): ("open", 4)}


def test_nothing_to_enclose(spark):
    df = spark.createDataFrame([(0, 1, "a", 0.0, 0.0, 1.0, 1.0)], LINES)
    assert faces.build_regions(df, ["file_id"], 4.0).collect() == [] == faces.build_regions(df.limit(0), ["file_id"], 4.0).collect()


def test_regions_of_the_whole_table(spark):
    got = registry.QUERIES["q13_region_build"](spark, SF).collect()
    s = shapes.segments(spark, SF).withColumn("file", F.col("file_id"))
    want = kernels.polygonise(s, "file").collect()
    assert Counter((r.file_id, round(r.area, 2)) for r in got) == Counter((r.file, round(r.area, 2)) for r in want)
    assert all(r.votes >= 1 and r.layer != "UNKNOWN" for r in got)
