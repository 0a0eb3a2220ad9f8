import hashlib

import numpy as np

from planwright.llm import media as M


def texture(seed, n=96):
    rng = np.random.default_rng(seed)
    a = rng.random((n, n))
    for _ in range(3):
        a = (np.roll(a, 1, 0) + np.roll(a, -1, 0) + np.roll(a, 1, 1) + np.roll(a, -1, 1) + 2 * a) / 6
    a -= a.min()
    return 255 * a / a.max()


def test_finds_crops_and_edits(spark):
    rows, base = [], [texture(s, 128) for s in range(12)]
    for k, a in enumerate(base):
        rows.append((k, bytearray(M.write_pgm(a))))
    rows.append((100, bytearray(M.write_pgm(base[0][20:110, 30:120]))))  # crop
    edited = base[1].copy()
    edited[:30, :40] = 10
    rows.append((101, bytearray(M.write_pgm(np.clip(edited * 0.9 + 12, 0, 255)))))  # painted over, paler
    rows.append((102, bytearray(M.write_pgm(np.rot90(base[2])))))
    rows += [(103, bytearray(M.write_pgm(base[3]))), (104, None), (105, bytearray(b"")), (None, bytearray(b"P5 junk"))]
    got = {r.vec_id: r for r in M.find_copies(spark.createDataFrame(rows, "vec_id long, media binary"), "vec_id", "media").collect()}
    assert len(got) == len(rows)
    assert got[100].component_id == 0 and got[101].component_id == 1 and got[102].component_id == 2 and got[103].component_id == 3
    assert all(got[k].component_id == k for k in range(12)) and got[104].component_id == 104 and got[105].n_corners is None


def test_vectors_as_media(spark):
    v = np.random.default_rng(1).normal(0, 0.12, (3, 64))
    rows = [(0, v[0].tolist()), (1, (v[0] + 0.001).tolist()), (2, v[1].tolist()), (3, v[2].tolist()), (4, None)]
    media = M.render_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.vec_id: r.component_id for r in M.find_copies(media, "vec_id", "media").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def brute_force(media, agree=M.AGREEING):
    """Component of each id by comparing all pairs that meet in enough entries."""
    found = {k: M.describe(M.read_image(bytes(d))[None])[0] for k, d in media}
    entries = {k: set(M.table_keys(f).ravel().tolist()) for k, f in found.items()}
    order = sorted(found, key=lambda k: hashlib.sha256(dict(media)[k]).digest())
    root = {k: k for k in order}
    pairs = [(b, a) for i, a in enumerate(order) for b in order[i + 1 :] if len(entries[a] & entries[b]) >= M.MEETINGS and M.agreeing(found[b], found[a]) >= agree]
    for _ in order:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return root, len(pairs)


def near_copies(spark, n, noise):
    """Vectors of the table, and copies of every third with noise of so much of their length."""
    found = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").limit(n).collect()]
    rng = np.random.default_rng(5)
    copies = [(10_000 + k, (np.array(v) + noise * rng.normal(0, 1 / len(v) ** 0.5, len(v))).tolist()) for k, v in found[::3]]
    return spark.createDataFrame(found + copies, "vec_id long, embedding array<double>"), copies


def test_all_pairs_that_meet_are_compared(spark):
    vectors, copies = near_copies(spark, 120, 0.1)
    media = M.render_vectors(vectors).cache()
    want, links = brute_force([(r.vec_id, bytes(r.media)) for r in media.collect()])
    got = M.find_copies(media.repartition(7), "vec_id", "media").collect()
    assert {r.vec_id: r.component_id for r in got} == want and len(set(want.values())) < 125 and links >= 38
    again = M.find_copies(media.repartition(2), "vec_id", "media").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_unrelated_pictures_stay_apart_and_near_copies_are_found(spark):
    """Against all pairs, whether they meet in table entries or not."""
    vectors, copies = near_copies(spark, 500, 0.15)
    media = M.render_vectors(vectors).cache()
    got = {r.vec_id: r.component_id for r in M.find_copies(media, "vec_id", "media").collect()}
    assert sum(got[k] != k for k in got if k < 10_000) < 5  # unrelated by their vectors
    seen = {r.vec_id: M.describe(M.read_image(bytes(r.media))[None])[0] for r in media.collect()}
    agree = [(k - 10_000, k) for k, _ in copies if M.agreeing(seen[k - 10_000], seen[k]) >= M.AGREEING]
    assert len(agree) > 0.9 * len(copies) and np.mean([got[a] == got[b] for a, b in agree]) >= 0.9
    some = list(seen)[:150]
    assert all(M.agreeing(seen[a], seen[b]) < M.AGREEING for a in some for b in some if a < b)


def test_odd_media(spark):
    """Repeated ids and rows, a common picture, clashing names, nulls, a tiny and a plain picture."""
    a, b = (bytearray(M.write_pgm(texture(k, 80))) for k in (70, 71))
    plain, tiny = bytearray(M.write_pgm(np.full((80, 80), 9.0))), bytearray(M.write_pgm(np.ones((3, 2))))
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, b, "x"), (3, plain, "y"), (4, tiny, "z"), (None, a, "x"), (None, None, None)] + [(50 + k, plain, "y") for k in range(200)]
    got = M.find_copies(spark.createDataFrame(rows, "id long, media binary, key string"), "id", "media").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add(r.component_id)
    assert by[1] == {1} and by[2] == {1} and by[4] == {4} and {x for k in range(200) for x in by[50 + k]} == {3} == by[3]
    assert by[None] == {1, None}


def test_corners_of_a_pale_part_are_kept():
    a = texture(40, 200)
    a[:, 100:] = 120 + (a[:, 100:] - 128) * 0.3  # the strongest corners are all in the left half
    whole, part = M.describe(a[None])[0], M.describe(a[20:180, 110:190][None])[0]
    assert M.agreeing(whole, part) >= M.AGREEING and (whole["x"] > 110).sum() > 20


def test_pairs_without_common_bands_and_all_links_are_found(spark, monkeypatch):
    """Every pair that agrees is linked, whatever bands they share, and n_links counts each; in few and in many blocks."""
    vectors, copies = near_copies(spark, 45, 0.3)
    vectors = vectors.unionAll(spark.createDataFrame([(20_000 + k, (np.array(v) * (1 + k / 50) + 0.001 * k).tolist()) for k, (_, v) in enumerate(copies[:1] * 8)], vectors.schema))
    media = M.render_vectors(vectors).cache()
    found = {r.vec_id: M.describe(M.read_image(bytes(r.media))[None])[0] for r in media.collect()}
    data = {r.vec_id: hashlib.sha256(r.media).digest() for r in media.collect()}
    first = {d: min(k for k in data if data[k] == d) for d in data.values()}
    order = sorted(first.values(), key=lambda k: data[k])
    links = [(a, b) for i, b in enumerate(order) for a in order[i + 1 :] if M.agreeing(found[a], found[b]) >= M.AGREEING]
    few = [(a, b) for a, b in links if len(set(M.table_keys(found[a]).ravel().tolist()) & set(M.table_keys(found[b]).ravel().tolist())) < M.MEETINGS]
    assert len(few) >= 3 and len(links) >= 40
    root = {k: k for k in order}
    for _ in order:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = {k: (root[first[data[k]]], sum(first[data[k]] in pair for pair in links)) for k in data}
    for block in (M.LEAST_BLOCK, 150):
        monkeypatch.setattr(M, "LEAST_BLOCK", block)
        assert {r.vec_id: (r.component_id, r.n_links) for r in M.find_copies(media, "vec_id", "media").collect()} == want


def test_large_pictures_are_compared_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    f = [np.zeros(n, M.FEATURE) for n in (50, 3, 70, 9)]
    for x in f:
        x["bits"] = rng.integers(0, 256, (len(x), 32))
    f[2]["bits"][5:12] = f[0]["bits"][20:27]
    f[3]["bits"][:4] = f[0]["bits"][:4]
    monkeypatch.setattr(M, "ROWS", 16)
    monkeypatch.setattr(M, "COLUMNS", 24)
    x, of = np.concatenate(f), np.repeat(np.arange(4), [len(p) for p in f])
    assert sorted(M._may_link(x, of, x, of, 5)) == [(0, 0), (0, 2), (2, 0), (2, 2), (3, 3)]
