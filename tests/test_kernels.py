import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.functions import text as T
from planwright.operators import blocks, graph, kernels, ordering, spatial
from planwright.plans import layouts, shapes, tasks
from planwright.sources import dxf, files


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_boxes(spark):
    box = lambda *b: G.box(*map(float, b))
    assert one(spark, G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, G.iou(box(0, 0, 1, 1), box(1, 0, 2, 1))) == 0
    assert one(spark, G.boxes_meet(box(0, 0, 1, 1), box(1, 0, 2, 1)))
    assert one(spark, G.ring_area(G.rectangle(0.0, 0.0, 1.0, 1.0))) == 1.0
    assert one(spark, G.ring_area(F.array(G.point(0.0, 0.0), G.point(1.0, 1.0)))) == 0.0
    assert one(spark, G.to_pixels(F.array(G.point(-0.9, 0.0)), 0.0, 0.0, 1.0)[0]["x"]) == 0
    p = one(spark, G.apply_matrix(G.insert_matrix(10.0, 0.0, 2.0, 2.0, float(np.pi / 2)), 1.0, 0.0))
    assert (p.x, p.y) == (pytest.approx(10), pytest.approx(2))


def test_text(spark):
    assert one(spark, T.decode_mtext(F.lit(r"\A1;{hi}\Pthere"))) == "hi\nthere"
    assert one(spark, T.decode_mtext(F.lit(r"\S1^2; \U+4E2D\U+zz"))) == "1/2 中\\U+zz"
    assert one(spark, T.decode_mtext(F.lit(None).cast("string"))) == ""
    assert one(spark, T.match_form(F.lit(" Straße\t Ａ "))) == "strasse a"
    assert one(spark, T.loose_form(F.lit("Ａ1 ∼ B_2〜C至d－e — f–G"))) == "a1b2cdef–g"
    assert one(spark, T.loose_form(F.lit(None).cast("string"))) is None
    assert T.keyword_pattern("a b") == "a.*b" and T.keyword_pattern("(x") == r"\(x"


def test_small_outlier_lists(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 900.0), ("b", 1.0), ("b", 1.0), ("b", 1.0), ("b", 9.0)], "k string, v double")
    got = {(r.k, r.v): r.is_outlier for r in layouts.high_outliers(rows, "k", "v").collect()}
    assert not got["a", 900.0] and got["b", 9.0] and not got["b", 1.0]


def test_latest_batch(spark):
    m = spark.sql("select 'f' f, timestamp_seconds(s) created_at, s from values (0), (60), (61), (121) t(s)")
    assert sorted(r.s for r in layouts.latest_batch(m, ["f"]).collect()) == [61, 121]


def test_few_vectors_are_one_cluster(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [9.0, 9.0])], "vec_id long, embedding array<double>")
    assert {r.cluster_id for r in shapes.dbscan(v, 0.1).collect()} == {0}


boxes = st.lists(st.tuples(*[st.integers(0, 30)] * 2, *[st.integers(1, 12)] * 2).map(lambda t: [float(t[0]), float(t[1]), float(t[0] + t[2]), float(t[1] + t[3])]), max_size=15)


def test_slots():
    hist = np.zeros(60, int)
    hist[10:20] = 50
    hist[35:50] = 40
    assert kernels.slot_1d(hist, 12.0, 0.0, 1.0, 5) == (10.0, 20.0)
    assert kernels.slot_1d(hist, 30.0, 0.0, 1.0, 5) == (35.0, 50.0)
    assert kernels.slot_1d(np.zeros(9, int), 1.0, 0.0, 1.0, 3) == (0.0, 9.0)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(7, 7), (400, 400)]
    root = {n: n for x in e for n in x}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in e:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in root}


def test_box_join_is_exact_and_without_repeats(spark):
    rng = np.random.default_rng(4)
    make = lambda n: [(i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.integers(0, 60, (n, 4)))]
    a, b = make(60), make(70)
    frame = lambda rows, p: spark.createDataFrame(rows, "id long, min_x double, min_y double, max_x double, max_y double").select(F.col("id").alias(p), F.struct("min_x", "min_y", "max_x", "max_y").alias(p + "b"))
    got = sorted((r.a, r.b) for r in spatial.box_join(frame(a, "a"), frame(b, "b"), "ab", "bb", 11.0, margin=2.0).collect())
    want = sorted((i, j) for i, *p in a for j, *q in b if p[0] - 2 <= q[2] and p[2] + 2 >= q[0] and p[1] - 2 <= q[3] and p[3] + 2 >= q[1])
    assert got == want


def test_polygonise(spark):
    square = [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0), (2, -1, 2, 5), (0, 2, 1, 2)]
    s = spark.createDataFrame([("f", *map(float, r)) for r in square], "k string, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.area, r.cx, r.cy) for r in kernels.polygonise(s, "k").collect())
    assert got == [(8.0, pytest.approx(1.0), pytest.approx(2.0)), (8.0, pytest.approx(3.0), pytest.approx(2.0))]


def test_blocks_beyond_the_depth_are_dropped(spark):
    kind = "root_id long, type string, name string, x double, y double, x_scale double, y_scale double, rotation double"
    top = spark.createDataFrame([(1, "INSERT", "A", 1.0, 0.0, None, None, None)], kind)
    defs = spark.createDataFrame([("A", "LINE", None, 1.0, 1.0, None, None, None), ("A", "INSERT", "A", 1.0, 0.0, None, None, None)], "block string, " + kind.removeprefix("root_id long, "))
    got = sorted((r.depth, r.x) for r in blocks.expand_blocks(top, defs, max_depth=3).collect())
    assert got == [(1, 2.0), (2, 3.0), (3, 4.0)]


def test_row_numbers(spark):
    rows = ordering.with_row_number(spark.range(100).select((F.col("id") * 37 % 101).alias("v")), ["v"], "i").orderBy("v").collect()
    assert [r.i for r in rows] == list(range(100))


def test_tasks(spark):
    t = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 7)], "plan long, task long")
    n = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 3, 1), (2, 7, 99)], "plan long, task long, needed long")
    assert {(r.plan, r.task, r.level) for r in tasks.levels(t, n).collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 7, 0)}
    with pytest.raises(ValueError):
        tasks.levels(t, n.union(spark.createDataFrame([(1, 1, 3)], n.schema)))
    p = spark.createDataFrame([(1, 1, "crop", "of {{task_2_result}} {{task_1_result}}"), (1, 2, "crop", None), (2, 1, "list", "")], "plan long, task long, tool string, arguments string")
    assert [tuple(r) for r in tasks.placeholder_needs(p).collect()] == [(1, 1, 2)]
    every, needs = tasks.with_prerequisites(p, spark.createDataFrame([("crop", "list")], "tool string, before string"))
    assert {(r.plan, r.task, r.tool) for r in every.collect()} == {(1, 0, "list"), (1, 1, "crop"), (1, 2, "crop"), (2, 1, "list")}
    assert {tuple(r) for r in needs.collect()} == {(1, 1, 0), (1, 2, 0)}



DXF = "0\nSECTION\n2\nTABLES\n0\nLAYER\n2\nWALL\n62\n-3\n70\n1\n6\nCONT\n0\nENDSEC\n0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nB1\n0\nLINE\n8\n0\n10\n0\n20\n0\n11\n1\n21\n0\n0\nENDBLK\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nLINE\n5\nA1\n8\nWALL\n10\n0\n20\n0\n11\n3\n21\n4\n0\nARC\n8\nWALL\n10\n0\n20\n0\n40\n2\n50\n350\n51\n10\n0\nMTEXT\n8\nT\n10\n1\n20\n2\n3\n长\n1\n文\n0\nENDSEC\n0\nEOF\n"


def test_dxf(spark, tmp_path):
    (tmp_path / "a.dxf").write_bytes(DXF.encode("gbk"))
    (tmp_path / "b.DXF").write_text("no tags at all")
    r = dxf.read_dxf(spark, str(tmp_path)).cache()
    assert sorted(x.type for x in dxf.entities(r).collect()) == ["ARC", "LINE", "MTEXT"]
    assert [x.text for x in r.where("type = 'MTEXT'").collect()] == ["长文"]
    layer = dxf.layers(r).first()
    assert (layer.name, layer.color, layer.is_off, layer.is_frozen, layer.is_locked) == ("WALL", 3, True, True, False)
    assert [x.block for x in r.where("section = 'BLOCKS' and type = 'LINE'").collect()] == ["B1"]
    assert dxf.lines(r).where("layer = 'WALL'").count() == 1 + 36 - 36  # pieces of so small an arc are under the least length


def test_cad_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"entities":[{"type":"TEXT","text":"a","insertionPoint":{"x":1,"y":2}}],"blocks":{"B":[{"type":"LINE","start":{"x":3,"y":4}}],"C":{"entities":[{"type":"CIRCLE","center":{"x":5,"y":6}}]}}}')
    (tmp_path / "bad.json").write_text("{")
    got = sorted((x.type, x.block, x.x) for x in files.canonical_entities(files.read_cad_json(spark, str(tmp_path))).collect() if True)
    assert got == [("CIRCLE", "C", 5.0), ("LINE", "B", 3.0), ("TEXT", None, 1.0)]


def test_faces_of_regions_that_touch(spark):
    sf = "/root/testdata/sf0.01"
    whole = shapes.segments(spark, sf).withColumn("group_id", F.concat_ws("/", F.col("file_id").cast("string"), "layer"))
    plain = lambda df: sorted((r.group_id, round(r.cx, 6), round(r.cy, 6), round(r.area, 6), r.points) for r in df.collect())
    got, want = plain(shapes.r1_polygonise(spark, sf)), plain(kernels.polygonise(whole, "group_id"))
    assert got == want and len(got) > 15_000
