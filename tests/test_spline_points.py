"""Spline points, each in a row of its own that is compiled."""

from planwright.plans import finding, registry

SF = "/root/testdata/sf0.001"


def test_spline_points_are_compiled(spark):
    plan = registry.QUERIES["m26_spline_points"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    point = lambda x: (float(x), 2.0 * x)
    rows = [(1, [point(0), point(3)], [point(9)] * 3), (2, [point(1)], [point(0), point(4), point(5)]), (3, None, [point(5)]), (4, [], []), (5, [], [point(k) for k in range(40)])]
    kind = "array<struct<x:double,y:double>>"
    got = finding.spline_points(spark.createDataFrame(rows, f"k long, fit {kind}, control {kind}"), "fit", "control").collect()
    by = {k: [tuple(r.p) for r in sorted(got, key=lambda r: r.i) if r.k == k] for k in range(1, 6)}
    assert by[1] == [point(0), point(3)] and by[3] == [point(5)] and by[4] == []
    assert len(by[2]) == 24 and by[2][0] == point(0) and by[2][-1] == point(5) and all(abs(y - 2 * x) < 1e-9 for x, y in by[2])
    assert len(by[5]) == 180 and abs(by[5][90][0] - 90 * 39 / 179) < 1e-9
