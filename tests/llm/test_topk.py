"""Pairs of blocks that are shipped, and whole tables against all products."""

import numpy as np

from planwright.llm import queries, topk

KIND = "vec_id long, embedding array<double>"


def plain(rows, k=5, every=50, scale=256):
    ids = np.array([r[0] for r in rows])
    x = np.floor(np.array([r[1] for r in rows]) * scale).astype(np.int64)
    out = set()
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out |= {(int(ids[q]), n + 1, int(ids[i]), int(s[i])) for n, i in enumerate(order)}
    return out


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    assert {tuple(r) for r in queries.op4_top_k(spark, "/root/testdata/sf0.001").collect()} == plain(rows)


def test_shipped_pairs_grow_slower_than_the_square(spark, monkeypatch):
    """With lengths that vary, twice and four times the vectors: all results are right, and the pairs don't grow with the square."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    shipped = []
    real = topk.search_pairs

    def counted(blocks, asked, meet, k, scale):
        def told(candidates, pairs):
            shipped[-1] += pairs.count()
            return meet(candidates, pairs)

        shipped.append(0)
        return real(blocks, asked, told, k, scale)

    monkeypatch.setattr(topk, "search_pairs", counted)
    rng = np.random.default_rng(4)
    sizes = (600, 2400)
    for n in sizes:
        v = rng.normal(size=(n, 8))
        v *= (rng.pareto(1.5, size=n)[:, None] + 0.05) / np.linalg.norm(v, axis=1)[:, None]
        rows = [(k, r.tolist()) for k, r in enumerate(v)]
        got = {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, KIND)).collect()}
        assert got == plain(rows)
    whole = [(n // 32) * -(-(n // 50) // 8) for n in sizes]
    assert shipped[1] / shipped[0] < 0.75 * whole[1] / whole[0] and shipped[1] < 0.6 * whole[1]


def test_payload_is_as_narrow_as_it_can_be():
    for v, first in (([[1.5, -2.0]], b"2"), ([[300.0, 1.0]], b"4"), ([[1e12, 0.25]], b"8")):
        data = topk._narrow(np.array(v), 256)
        raw, x = topk._widen(data, 2, 256)
        assert data[:1] == first and np.array_equal(raw, v) and np.array_equal(x, np.rint(np.array(v) * 256))
