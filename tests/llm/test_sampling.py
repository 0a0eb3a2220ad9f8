"""Samples of different texts, whatever is repeated, and models that learn from them."""

import random

import numpy as np

from planwright.llm import langid, quality, sampling

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n, letters=LETTERS):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_copies_do_not_starve_a_sample(spark):
    rng = random.Random(1)
    rows = [("en", "one row that is everywhere")] * 20_000 + [("en", words(rng, 12)) for _ in range(500)] + [("de", None), (None, "no class"), ("fr", "seul")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = sampling.bounded_sample(df, "lang", 150, "text")
    assert 110 < len(set(got["en"])) == len(got["en"]) <= 225 and got["fr"] == ["seul"] and set(got) == {"en", "fr"}
    assert sampling.bounded_sample(df.repartition(7), "lang", 150, "text") == got
    assert sampling.bounded_sample(df.limit(0), "lang", 150, "text") == {}
    assert set(sampling.bounded_sample(df, "lang", 150, "text", most_classes=1)) == {"en"}


def test_long_texts_train(spark):
    rng = random.Random(2)
    rows = [("en", words(rng, 30_000)) for _ in range(4)] + [("el", words(rng, 30_000, "αβγδεζηθικλ")) for _ in range(4)]
    df = spark.createDataFrame([(k, t, c) for k, (c, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = sampling.bounded_sample(df, "lang", 50, "text")
    assert {len(v) for v in got.values()} == {4} and all(10_000 < len(t.encode()) <= sampling.SAMPLE_TEXT_BYTES for v in got.values() for t in v)
    found = langid.identify_languages(df).collect()
    assert {r.lang_pred for r in found[:4]} == {"en"} and {r.lang_pred for r in found[4:]} == {"el"}


def test_sparse_steps_give_the_same():
    rng = random.Random(3)
    samples = {c: [words(rng, 60, a).encode() for _ in range(6)] for c, a in (("a", "abcdef"), ("b", "defghi"), ("c", LETTERS))}
    texts = [words(rng, 20).encode(), b"", b"abc", "é".encode() * 9]
    dense, sparse = langid.grow(samples), langid.grow(samples, most_cells=1)
    assert isinstance(sparse.step, langid.Sparse) and sparse.order == dense.order == langid.ORDER
    assert np.array_equal(dense.bits(texts), sparse.bits(texts))


def test_quality_learns_from_different_texts(spark):
    rng = random.Random(4)
    good = lambda: " ".join(words(rng, 9).capitalize() + "." for _ in range(6))
    bad = lambda: " ".join(rng.choice(["$$", "##!!", "BUY", "NOW", "|", "<>", "x"]) for _ in range(60))
    rows = [(k, good()) for k in range(150)] + [(1000 + k, bad()) for k in range(150)] + [(None, "This text is everywhere. It has copies.")] * 6000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.judge_quality(df, sample_docs=100).collect()
    assert np.mean([r.quality_keep for r in got if r.doc_id is not None and r.doc_id < 1000]) > 0.95
    assert np.mean([r.quality_keep for r in got if r.doc_id is not None and r.doc_id >= 1000]) < 0.05
