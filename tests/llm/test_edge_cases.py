"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import base64
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from planwright.llm import bpe, langid, media, packing, quality, sampling, simhash, suffixdedup, topk, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, score double, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    long = "ab cd! " * 30_000
    rows = [(1, "hello there world", "en", 1.0, "x"), (1, "hello there world", "en", 1.0, "x"), (2, None, "en", None, None), (3, "", None, 2.0, "y"), (None, "no id é", "fr", 0.0, None), (4, long, "en", None, "z"), (5, "12 34 --", "de", None, None), (6, "\t\n ", "fr", None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


RANKS = P.path("byte_bpe_50k.tiktoken")


def test_bpe_equals_the_library(odd, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(odd, RANKS, P.PATTERN, with_ids=True).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    for r in odd.collect():
        t = r.text or ""
        assert by[r.doc_id].ids == enc.encode_ordinary(t) and by[r.doc_id].n_tokens == len(by[r.doc_id].ids)
        assert by[r.doc_id].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_documents(none, RANKS, P.PATTERN).count() == 0


def test_prefixes_append_and_edit():
    v = bpe.Vocabulary.from_file(RANKS)
    rng = random.Random(1)
    for _ in range(40):
        text = bytes(rng.choice(b"the ing  abc") for _ in range(40))
        p = bpe.Prefixes(v, text[:11])
        p.append(text[11:])
        assert p.ids() == v.merged(text) and all(p.ids(n) == v.merged(text[:n]) for n in (1, 7, 23))
        a, b = sorted(rng.sample(range(40), 2))
        p.replace(a, b, b"zing")
        assert p.text == text[:a] + b"zing" + text[b:] and p.ids() == v.merged(p.text) and bpe.decode(v, p.ids()) == p.text


def test_packing_cuts_into_powers_of_two(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(odd, P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length in {1 << b for b in range(12)} for r in rows)
    for r in odd.where("doc_id = 4 or doc_id = 3 or doc_id is null").collect():
        own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.start)
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert [i for x in own for i in x.ids] == ids and all(x.doc_tokens == len(ids) for x in own)
        assert all(x.ids_crc32 == zlib.crc32(np.asarray(x.ids, "<u4").tobytes()) for x in own)
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert packing.binary_lengths(5000) == [2048, 2048, 512, 256, 128, 8]


def test_special_strings_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    s = packing.IdStream(P.path("byte_bpe_50k.json"), P.PATTERN)
    for text in ("a <|endoftext|> b", "  two  spaces\n\n x", "\u00a0x \u3000y", "naïve 中文 😀"):
        assert np.frombuffer(s.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_language_trees_are_exact():
    rng = random.Random(2)
    samples = {k: [bytes(rng.choice(letters) for _ in range(60)) for _ in range(4)] for k, letters in (("a", b"xyz "), ("b", b"xyw."))}
    trees = langid.grow(samples, 3)

    def bits(text, lang):
        counts, border = {}, object()
        for t in samples[lang]:
            x = [border] * 3 + list(t)
            for i in range(3, len(x)):
                for d in range(4):
                    c = counts.setdefault(tuple(x[i - d : i]), {})
                    c[x[i]] = c.get(x[i], 0) + 1
        x, total = [border] * 3 + list(text), 0.0
        for i in range(3, len(x)):
            for d in range(3, -1, -1):
                c = counts.get(tuple(x[i - d : i]))
                if c:
                    n, t = sum(c.values()), len(c)
                    if x[i] in c:
                        total -= np.log2(c[x[i]] / (n + t))
                        break
                    total -= np.log2(t / (n + t))
            else:
                total += 8
        return total

    texts = [b"xyzzy", b"w", "é?".encode(), bytes(rng.choice(b"xyzw ") for _ in range(200))]
    assert np.allclose(trees.bits(texts), [[bits(t, k) for k in "ab"] for t in texts], rtol=1e-5)
    assert np.allclose(trees._long(texts[3], 17), trees.bits(texts)[3], rtol=1e-6)


def test_languages(spark, odd, none):
    got = langid.identify_languages(odd).collect()
    assert len(got) == odd.count() and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 5, 6))
    assert all(0 <= r.score <= 1 for r in got) and langid.identify_languages(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.identify_languages(docs).where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() / found.count() > 0.9


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/a", "allow"), ("net", "/es/ab", "block")]


def test_urls(spark):
    urls = [None, "nothing", "http://", "HTTP://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/q", "http://example.com", "x://net/es/", "x://a.net/es/abc", "x://a.net/es/b", "x://net/es/ac", "x://b.net/es", "x://notnet/es/", "x://.com/", "x://a..com/#/en/", "x://" + "a." * 3000 + "com/"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")] * 3 + [(None, urls[4], "h")]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), spark.createDataFrame(RULES, "host string, path string, verdict string"), rows_per_slice=2).collect()

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = "".join(c.lower() if c.isascii() else c for c in rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))])
        tail = rest[len(host) :]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")

    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted((str(i), h, p, str(r), v) for i, u, _ in rows for h, p, r, v in [judge(u)])
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), empty).count() == len(rows)


def test_top_k(spark):
    rng = np.random.default_rng(6)
    v = [(i, (rng.normal(0, 1, 8) * (1 + i % 5)).tolist(), "s") for i in range(400)]
    v += [(1000 + i, v[7][1], "s") for i in range(30)] + [(2000, None, "s"), (2050, [float("nan")] * 8, "s"), (2100, [1.0, None] * 4, "s"), (None, v[0][1], "s"), (2150, [1.0, 2.0], "s")]
    got = topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>, score string")).collect()
    e = {i: np.floor(256 * np.array(x)).astype(int) for i, x, _ in v if i is not None and x and None not in x and np.isfinite(x).all()}
    want = []
    for q in (i for i in e if i % 50 == 0):
        best = sorted((-int(e[q] @ e[c]), c) for c in e if c != q and len(e[c]) == len(e[q]))[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_fingerprints():
    def plain(text):
        w = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))

    for t in ("", "One", "One TWO", "one two three", "É a b\x0bc d\u00a0e a b c d", "x " * 50):
        assert simhash.fingerprint(t) == plain(t)
    assert simhash.fingerprint(None) == 0


def test_near_duplicates(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id in (2, 3, 6)} == {2}
    assert simhash.near_duplicates(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in docs}
    root = {d: d for d in fp}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {d: (f"{fp[d]:016x}", find(d)) for d in fp}


def test_every_link_is_found():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = [base]
    for k in range(3):
        x = base.copy()
        for _ in range(k + 1):
            x ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
        near.append(x)
    p = np.unique(np.concatenate(near))
    row, key, own = simhash.keys(p)
    by = np.argsort(key, kind="stable")
    found = {frozenset((int(a), int(b))) for x, y in simhash.links(key[by], p[row][by], own[by]) for a, b in zip(x, y, strict=True)}
    want = {frozenset((int(a), int(b))) for i, a in enumerate(p) for b in p[i + 1 :][np.bitwise_count(p[i + 1 :] ^ a) <= 3]}
    assert found == want


def test_quality(spark, odd, none):
    got = quality.judge_quality(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() == odd.count()
    assert not any(r.quality_keep for r in got.where("doc_id in (2, 3, 6)").collect())
    assert quality.judge_quality(none).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.judge_quality(docs.select("doc_id", "text")).join(labels, "doc_id").collect()
    assert np.mean([r.quality_keep for r in found if r.quality == 1]) > 0.98 and np.mean([r.quality_keep for r in found if r.quality == 0]) < 0.05


def test_weak_labels_find_the_better_labellers():
    rng = np.random.default_rng(1)
    true = rng.random(4000) < 0.7
    say = [np.where(rng.random(4000) < acc, true, ~true) for acc in (0.95, 0.9, 0.85, 0.6)]
    patterns = ["".join("g" if v[i] else "b" for v in say) for i in range(4000)]
    counts = {p: patterns.count(p) for p in set(patterns)}
    posterior = quality.fit_votes(counts)
    assert np.mean([(posterior[p] >= 0.5) == t for p, t in zip(patterns, true, strict=True)]) > 0.93
    assert quality.fit_votes({}) == {}


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (4, 0), (1, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, labels)
    assert got.count() == odd.count() and got.where("score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(none, labels.where("false")).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels, "doc_id").select("doc_id", "text")
    found = toxicity.score_toxicity(docs, labels, sample_docs=400).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted for r in found if r.toxic == 1]) > 0.7 and np.mean([r.predicted for r in found if r.toxic == 0]) < 0.1


def test_kernel_by_recursion_equals_its_definition():
    from itertools import combinations

    def vector(u):
        out = {}
        for i, j, k in combinations(range(len(u)), 3):
            key = u[i] + u[j] + u[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    for u in ("ABCD", "AABBA", "TRASHTRASH"):
        assert toxicity.norms([u])[0] == pytest.approx(sum(x * x for x in vector(u).values()) ** 0.5, rel=1e-5)
    z = toxicity.vectors(["TRASH"])
    a, b = vector("TRXASH"), vector("TRASH")
    want = sum(a[k] * b.get(k, 0) for k in a) / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
    assert toxicity.kernels(["TRXASH"], z)[0, 0] == pytest.approx(want, rel=1e-5)
    assert "idiot" in toxicity.text_words("an i d i o t here")


def test_suffix_dedup_and_media(odd, none, spark):
    assert suffixdedup.remove_repeats(odd).count() == odd.count()
    assert media.find_copies(spark.createDataFrame([], "vec_id long, media binary"), "vec_id", "media").count() == 0


def test_folds(spark):
    rows = spark.range(50).select("id", sampling.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.createDataFrame([(None,)], "id long").select(sampling.held_out("id").alias("h"), F.lit(1)).first().h is False


def test_top_k_of_long_vectors(spark):
    rng = np.random.default_rng(8)
    v = [(i, (rng.normal(0, 1, 6) * 10.0 ** (i % 7 * 2)).tolist()) for i in range(300)]
    v += [(1000 + i, (rng.normal(0, 1, 6) * s).tolist()) for i, s in enumerate((1e17, 1e40, 1e200, 1e306, 1e307))]
    got = topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect()
    e = {i: [math.floor(256 * Fraction(c)) for c in x] for i, x in v}
    want = []
    for q in (i for i in e if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(e[q], e[c], strict=True)), c) for c in e if c != q)[:5]
        want += [(q, k + 1, c, -s if -(1 << 63) <= -s < 1 << 63 else None) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
