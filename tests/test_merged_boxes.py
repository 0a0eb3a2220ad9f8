from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators import spatial


def test_later_rounds_look_at_joined_boxes_only(spark, monkeypatch):
    """A box that each round makes larger, at last far beyond where it began, among many that nothing overlaps."""
    chain = [(0, 0, 10, 10), (7, 7, 17, 17), (12, -8, 22, 6), (19, 10, 33, 24), (25, -14, 39, 0), (24, 1, 3034, 9), (2900, 12, 2920, 22)]
    alone = [(20 * k, 100_000, 20 * k + 9, 100_009) for k in range(300)]
    rows = [(1, k, *map(float, b)) for k, b in enumerate(chain + alone)] + [(2, 1000 + k, *map(float, b)) for k, b in enumerate(chain[2:])]
    boxes = spark.createDataFrame(rows, "layout long, id long, a double, b double, c double, d double").select("layout", "id", G.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box"))
    sides, join = [], spatial.box_join

    def counted(left, right, *args, **kwargs):
        sides.append([left.count(), right.count()])
        return join(left, right, *args, **kwargs)

    monkeypatch.setattr(spatial, "box_join", counted)
    got = {(r.layout, r.id, *r.box) for r in spatial.merged_boxes(boxes, ["layout"], 10.0).collect()}
    assert got == {(1, 0, 0.0, -14.0, 3034.0, 24.0)} | {(la, k, *b) for la, k, *b in rows if k >= len(chain)}
    whole = sum(n > 250 for pair in sides for n in pair)
    assert whole <= 5 < len(sides)  # not both sides of every round
