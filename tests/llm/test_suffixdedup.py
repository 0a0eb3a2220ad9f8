import hashlib
import random

from planwright.llm import suffixdedup as S


def brute(texts, length):
    where = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            where.setdefault(t[s : s + length], []).append((i, s))
    gone = [bytearray(len(t)) for t in texts]
    for found in where.values():
        if len(found) > 1:
            for i, s in found:
                gone[i][s : s + length] = b"\1" * length
    out = []
    for t, g in zip(texts, gone, strict=True):
        left = bytes(c for c, x in zip(t, g, strict=True) if not x)
        out.append((len(t), sum(g), sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1])), hashlib.sha256(left).hexdigest()))
    return out


def corpus(rng, n, letters):
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(10, 120))) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p[a : a + rng.randrange(5, 100)] + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))
        texts.append(t)
    return texts + [texts[0], "", "a" * 200, "ab" * 90, "é" * 50]


def test_equals_brute_force(spark):
    for seed, letters, length in ((1, "abcdefgh é", 24), (2, "ab", 20), (3, "xyz\n", 33)):
        texts = corpus(random.Random(seed), 60, letters)
        docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "y")], "doc_id long, text string, n_spans string")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs, length=length, gram=4).collect()}
        want = brute([t.encode() for t in texts], length)
        assert got[None] == (0, 0, 0, hashlib.sha256(b"").hexdigest())
        assert [got[i] for i in range(len(texts))] == want


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(5)
    entries = [(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))), b"", i, 5, 4, 5) for i in range(300)]
    runs = [sorted(entries[k::7]) for k in range(7)]
    merged = list(S.LoserTree([S.read_run(S.front_code(r)) for r in runs]))
    assert [e[0] for _, e in merged] == sorted(e[0] for e in entries)
    for (_, a), (k, b) in zip(merged, merged[1:], strict=False):
        assert k == S.shared(a[0], b[0])


def test_any_column_name_and_long_strings(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(75_000))
    names = "text_key removed spans sha left_text whole_sha row tid n_removed".split()
    rows = [(1, "x" + long + "y", *names), (2, "zz" + long, *names), (3, long[:60_000], *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = S.remove_repeats(docs, length=70_000)
    got = {r.doc_id: r for r in out.collect()}
    assert {k: (r.n_removed, r.n_spans) for k, r in got.items()} == {1: (75_000, 1), 2: (75_000, 1), 3: (0, 0)}
    assert all(r[n] == n for r in got.values() for n in names if n != "n_removed") and "text" not in out.columns
    kept = {r.doc_id: r.text for r in S.remove_repeats(docs, length=70_000, with_text=True).collect()}
    assert kept == {1: "xy", 2: "zz", 3: long[:60_000]}
