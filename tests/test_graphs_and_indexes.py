"""Diameters and articulation points, the vector index, heartbeats and entity points against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwright.functions import entities
from planwright.operators import graph, kernels
from planwright.plans import registry, shapes
from planwright.sources import vector_index
from planwright.streaming import events

SF = "/root/testdata/sf0.001"


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def far(start, without=None):
        seen, now = {start: 0}, [start]
        while now:
            now = [m for n in now for m in near[n] if m not in seen and m != without and not seen.update({m: seen[n] + 1})]
        return seen

    parts, left = [], set(near)
    while left:
        seen = far(min(left))
        left -= set(seen)
        parts.append(sorted(seen))
    wide = {p[0]: (len(p), max(max(far(n).values()) for n in p)) for p in parts}
    cut = set()
    for p in parts:
        for n in p:
            rest = [m for m in p if m != n]
            if rest and len(far(rest[0], n)) < len(rest):
                cut.add(n)
    return wide, cut


def random_graph(rng):
    edges = set()
    for base, n, extra in ((0, 30, 4), (100, 24, 20), (200, 14, 0), (300, 2, 0), (400, 9, 40)):
        edges |= {(base + rng.randrange(max(0, k - 3), k), base + k) for k in range(1, n)}
        edges |= {tuple(sorted((base + a, base + b))) for a, b in (rng.sample(range(n), 2) for _ in range(extra))}
    return sorted(edges)


def test_diameters_and_articulation_points(spark):
    edges = random_graph(random.Random(1))
    df = spark.createDataFrame(edges, "src long, dst long")
    wide, cut = plain(edges)
    assert {r.component: (r.nodes, r.diameter) for r in graph.diameters(df).collect()} == wide
    assert {r.node for r in graph.articulation_points(df).collect()} == cut and len(cut) > 10


def test_topology_of_the_whole_table(spark):
    got = {r.component: (r.diameter, r.articulation_points) for r in registry.QUERIES["g16_diameter"](spark, SF).collect()}
    want = {r.component: (r.diameter, r.articulation_points) for r in kernels.topology(shapes.component_edges(spark, SF), "component").collect()}
    assert got == want and len(got) > 5


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.articulation_points(none).collect() == []


def test_laplacian_encodings_are_eigenvectors(spark):
    edges = random_graph(random.Random(2))
    df = spark.createDataFrame([(a // 100, a, b) for a, b in edges], "part long, src long, dst long")
    got = {}
    for r in kernels.laplacian_encodings(df, "part").collect():
        got.setdefault(r.part, {})[r.node] = np.array(r.encoding)
    for part, rows in got.items():
        nodes = sorted(rows)
        a = np.array([[float((min(u, v), max(u, v)) in set(edges)) for v in nodes] for u in nodes])
        s = 1 / np.sqrt(a.sum(axis=1))
        lap = np.eye(len(nodes)) - s[:, None] * a * s[None]
        v = np.stack([rows[n] for n in nodes])
        many = min(8, len(nodes) - 1)
        low = v[:, :many].T @ lap @ v[:, :many]
        assert np.abs(lap @ v[:, :many] - v[:, :many] * np.diag(low)).max() < 1e-6, part
        assert np.allclose(np.diag(low), np.linalg.eigvalsh(lap)[1 : many + 1], atol=1e-9) and not v[:, many:].any()


def test_vector_index_is_exact_and_prunes(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 16))
    m = np.repeat(middles, 20, axis=0) + 0.05 * rng.normal(size=(600, 16))
    rows = [(k, v.tolist(), f"s{k}") for k, v in enumerate(m)] + [(900, None, "x"), (901, [0.0] * 16, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, source string")
    vector_index.write_index(df, str(tmp_path), cells=24, keep=("source",))
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for at in (0, 77, 599):
        found, cells = vector_index.search_index(spark, str(tmp_path), (m[at] * 3).tolist(), 7)
        score = unit @ unit[at]
        want = sorted(range(600), key=lambda k: (-score[k], k))[:7]
        got = found.collect()
        assert [r.id for r in got] == want and np.allclose([r.score for r in got], score[want]) and got[0].source == f"s{at}"
        assert 0 < len(cells) <= 12  # of 24
    assert vector_index.search_index(spark, str(tmp_path), [0.0] * 16, 7)[0].collect() == []
    all_, cells = vector_index.search_index(spark, str(tmp_path), m[0].tolist(), 10_000)
    assert all_.count() == 600


def test_heartbeats_while_idle(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "run string")
    rows.coalesce(1).write.mode("overwrite").parquet(str(source))
    beats = events.heartbeats(spark.readStream.schema("run string").parquet(str(source)), "run", 400)
    q = beats.writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until:
            got = spark.table("beats").collect()
            if all(sum(r.key == k and r.kind == "idle" for r in got) >= 2 for k in "ab"):
                break
            time.sleep(0.5)
    finally:
        q.stop()
    for k, n in (("a", 2), ("b", 1)):
        own = [r for r in got if r.key == k]
        assert (own[0].kind, own[0].seen, own[0].beats) == ("events", n, 0)
        assert [r.beats for r in own[1:]] == list(range(1, len(own))) and {r.kind for r in own[1:]} == {"idle"} and len(own) >= 3


def test_entities_without_their_points(spark):
    rows = [(k, (kind, *[None] * 15, None)) for k, kind in enumerate(["LINE", "HATCH", "SPLINE", "ELLIPSE", "DIMENSION", None, "CIRCLE", "LWPOLYLINE"])]
    rows.append((50, ("MTEXT", None, None, None, None, (1.0, 2.0), None, 2.0, None, None, None, None, None, None, None, "abcde", None)))
    rows.append((51, ("HATCH", None, None, None, None, (7.0, 8.0), None, None, None, None, None, None, None, [([(1.0, None), (3.0, 4.0)], None), (None, [((5.0, 6.0), None, None, None)])], None, None, None)))
    df = spark.createDataFrame(rows, f"k long, e {entities.SHAPE}")
    got = {r.k: r for r in df.select("k", entities.points(F.col("e")).alias("p"), entities.dense_points(F.col("e")).alias("d"), entities.box(F.col("e")).alias("b")).collect()}
    assert all(got[k].p == [] == got[k].d and got[k].b is None for k in range(8))
    assert tuple(got[50].b) == (1.0, 2.0, 1.0 + 5 * 2 * 0.7, 4.0)
    assert [tuple(p) for p in got[51].p] == [(3.0, 4.0), (5.0, 6.0)] and tuple(got[51].b) == (3.0, 4.0, 5.0, 6.0)


@pytest.mark.parametrize("name", ["m12_entity_points", "m13_dense_points"])
def test_kinds_are_all_there(spark, name):
    kinds = shapes.shapes_of_parts(spark, SF).select("k", "e.type")
    assert registry.QUERIES[name](spark, SF).join(kinds, "k").select("type").distinct().count() == 14
