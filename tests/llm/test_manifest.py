"""The manifest against a plain build of the same trees, and odd rows."""

import collections
import hashlib
import zlib

import pytest

from planwright.llm import manifest, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        a = i // 16 * 16
        out.append((level[a:i], level[i + 1 : a + 16]))
        i //= 16
    return out


def brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        own = leaf(r, r.text)
        hit = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, own, leaf(r, r.text.translate(LOWER)) if hit else own, r.doc_id))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in sorted(groups[k])]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    for j, k in enumerate(names):
        for i, (*_, own, shown, doc) in enumerate(sorted(groups[k])):
            way = path(trees[k], i) + path(top, j)
            now = shown
            for left, right in way:
                now = digest(*left, now, *right)
            yield doc, own, trees[k][-1][0], top[-1][0], digest(*(x for a, b in way for x in a + b)), now, now == top[-1][0], k


def same(df, rows):
    show = lambda found: sorted(map(str, map(tuple, found)))
    assert show(df.collect()) == show(brute(rows))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    got = queries.op11_manifest(spark, f"/root/testdata/{sf}")
    same(got, spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect())
    assert 0 < got.where("verified").count() < got.count()


def test_odd_rows(spark):
    rows = [(i, f"Text {i}", "en", "big", i, "x", 0) for i in range(300)]  # three levels
    rows += [(7, "SAME", "en", "big", 4, None, 1)] * 40 + [(None, None, None, None, None, None, None)] * 2
    rows += [(1, "", "en", "", 0, "y", 2), (2, "Ünï " * 40_000, None, "long", None, "z", 3), (5, None, "de", "one", 1, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int")
    same(manifest.manifest(docs), docs.collect())


def test_edges(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    assert manifest.manifest(spark.createDataFrame([], kind)).collect() == []
    one = spark.createDataFrame([(5, "Only", None, "s", 4)], kind)
    same(manifest.manifest(one), one.collect())
    for n in (15, 16, 17, 256, 257):
        docs = spark.createDataFrame([(i, "T", "en", "s", i) for i in range(n)], kind)
        same(manifest.manifest(docs), docs.collect())
    many = spark.createDataFrame([(i, "T", "en", f"s{i}", i) for i in range(300)], kind)  # lone leaves under a high tree
    same(manifest.manifest(many), many.collect())


def test_store_is_levelled(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    manifest.build(docs, path=str(tmp_path / "store"))
    low = spark.read.parquet(str(tmp_path / "store/leaves/level=0"))
    high = spark.read.parquet(str(tmp_path / "store/leaves/level=1"))
    assert low.count() == docs.count() and 0 < high.count() < low.count() and "children" in high.columns
    assert spark.read.parquet(str(tmp_path / "store/sources")).where("total = 1").count() == 1
