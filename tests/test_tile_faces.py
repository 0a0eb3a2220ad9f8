"""Faces found within tiles against those found by joins alone."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planwright.operators import faces, tile_faces

LINES = "file_id int, line long, layer string, x1 double, y1 double, x2 double, y2 double"


def linework(seed):
    """Boxes and slanted lines over several tiles of 32, some of them large; one layer and one coordinate are null."""
    rng = random.Random(seed)
    rows, line = [], 0

    def add(file, x1, y1, x2, y2, layer=None):
        nonlocal line
        rows.append((file, line, layer or rng.choice(["a", "b", "c"]), float(x1), float(y1), float(x2), float(y2)))
        line += 1

    for _ in range(60):
        file, x, y, w, h = rng.randrange(2), rng.randrange(-40, 100), rng.randrange(-40, 100), rng.randrange(1, 9), rng.randrange(1, 9)
        corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        for k in range(4):
            add(file, *corners[k], *corners[(k + 1) % 4])
    for _ in range(60):
        x, y = rng.uniform(-40, 100), rng.uniform(-40, 100)
        add(rng.randrange(2), x, y, x + rng.uniform(-6, 6), y + rng.uniform(-6, 6))
    if seed == 2:  # a face that is wider than a tile
        for a, b in (((-50, -50), (110, -50)), ((110, -50), (110, 105)), ((110, 105), (-50, 105)), ((-50, 105), (-50, -50))):
            add(0, *a, *b, "frame")
    return [*rows, (0, 900, None, 3.0, 3.0, 5.0, 3.0), (0, 901, "a", None, 1.0, 2.0, 3.0), (0, 902, "z", 7.0, 7.0, 7.0, 7.0), rows[0]]


def told(df):
    return Counter((r.file_id, round(r.area, 3), round(r.cx, 2) + 0.0, round(r.cy, 2) + 0.0, r.points, *((r.layer, r.votes) if "votes" in r else ())) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_tiles_find_what_joins_find(spark, monkeypatch, seed):
    monkeypatch.setattr(tile_faces, "TILE", 8)
    df = spark.createDataFrame(linework(seed), LINES)
    rows = faces.tiled(df, ["file_id"], 4.0, 0.1, 0.1).collect()
    kinds = Counter(r.kind for r in rows)
    assert kinds[faces.FACE] > 20 and kinds[faces.OPEN] > 20  # neither way finds all of it
    built, plain = told(faces.build_regions(df, ["file_id"], 4.0)), told(faces.all_faces(df, ["file_id"], 4.0))
    monkeypatch.setattr(faces, "IN_TILE", 0)
    assert {r.kind for r in faces.tiled(df, ["file_id"], 4.0, 0.1, 0.1).collect()} == {faces.OPEN}
    assert told(faces.build_regions(df, ["file_id"], 4.0)) == built and told(faces.all_faces(df, ["file_id"], 4.0)) == plain
    assert sum(built.values()) == sum(plain.values()) > 60


def test_lines_within_one_tile_are_not_left_to_joins(spark):
    rows = [(0, 4 * k + s, "a", 20.0 * k + a, 50.0 + b, 20.0 * k + c, 50.0 + d) for k in range(1, 60) for s, (a, b, c, d) in enumerate([(0, 0, 9, 0), (9, 0, 9, 7), (9, 7, 0, 7), (0, 7, 0, 0)])]
    found = faces.tiled(spark.createDataFrame(rows, LINES), ["file_id"], 20.0, 0.1, 0.1).groupBy("kind").agg(F.count("*").alias("n"), F.min("votes").alias("votes")).collect()
    assert [tuple(r) for r in found] == [(faces.FACE, 59, 4)]
