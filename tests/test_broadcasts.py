"""Tables that grow are shuffled into joins, not gathered on the driver."""

from planwright.operators import graph


def test_only_small_tables_may_be_broadcast(spark, monkeypatch):
    left = spark.range(10)
    plan = lambda *rows: left.join(graph.unsent(spark.range(10), *rows), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan() and "SortMergeJoin" in plan(graph.SENT + 1) and "BroadcastHashJoin" in plan(graph.SENT)
    # the same results by both kinds of join
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (7, 8), (8, 9)], "src long, dst long")
    show = lambda: (sorted(map(tuple, graph.diameters(edges).collect())), sorted(map(tuple, graph.articulation_points(edges).collect())))
    sent = show()
    monkeypatch.setattr(graph, "SENT", 0)
    assert show() == sent == ([(1, 4, 2), (7, 3, 2)], [(2,), (8,)])
