"""Each stage of the pipeline on its own input, against plain versions."""

import random
import zlib

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planwright.llm import quality, simhash, toxicity
from planwright.sources.tables import table

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark):
    docs = table(spark, SF, "documents").cache()
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["quality", "toxicity", "near-dedup", "suffix-dedup", "packing"]

    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in quality.judge_quality(docs).collect() if r.quality_keep}
    assert rows(good) == [r for r in rows(docs) if r[0] in kept] and len(kept) > 100

    clean = stages["toxicity"](spark, good, SF)
    kept = {r.doc_id for r in toxicity.score_toxicity(good, table(spark, SF, "labels")).collect() if r.predicted == 0}
    assert clean.columns == docs.columns and rows(clean) == [r for r in rows(good) if r[0] in kept]

    one = stages["near-dedup"](spark, docs, SF)
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
    root = {d: d for d in fp}
    for _ in fp:
        before = dict(root)
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(root.values())

    cut = stages["suffix-dedup"](spark, docs, SF)
    assert cut.columns == docs.columns
    raw = {r.doc_id: r.text.encode() for r in docs.collect()}
    seen = {}
    for d, t in raw.items():
        for s in range(len(t) - C.PASSAGE_BYTES + 1):
            seen.setdefault(t[s : s + C.PASSAGE_BYTES], []).append((d, s))
    gone = {d: np.zeros(len(t), bool) for d, t in raw.items()}
    for found in seen.values():
        if len(found) > 1:
            for d, s in found:
                gone[d][s : s + C.PASSAGE_BYTES] = True
    left = {d: bytes(np.frombuffer(t, np.uint8)[~gone[d]]) for d, t in raw.items()}
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got == {d: t.decode("utf-8", "ignore") for d, t in left.items() if t or not raw[d]}

    packed = stages["packing"](spark, docs, SF).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in docs.limit(20).collect():
        ids = np.array(t.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        own = sorted((p for p in packed if p.doc_id == r.doc_id), key=lambda p: p.start)
        assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own] and sum(p.length for p in own) == len(ids)


def test_run(spark):
    """The packed documents are those that all stages keep, and every piece of theirs is there."""
    packed = C.run(spark, SF).collect()
    docs = table(spark, SF, "documents")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in packed} == set(left) and len(left) > 50
    by = {}
    for r in packed:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for pieces in by.values():
        assert [a for a, _, _ in sorted(pieces)] == [sum(n for b, n, _ in pieces if b < a) for a, _, _ in sorted(pieces)] and sum(n for _, n, _ in pieces) == pieces[0][2]


def test_passages_of_fifty_words_go(spark):
    """Passages of 51 to 60 short words that several documents share; documents that share nothing stay as they are."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (51, 55, 60)]
    rows = [(k, f"{text(80)} {passages[k % 3]} {text(70)}") for k in range(30)] + [(100 + k, text(150)) for k in range(20)]
    got = {r.doc_id: r.text for r in dict(C.STAGES)["suffix-dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert len(got) == 50 and not any(p[5:-5] in t for p in passages for t in got.values())
    assert all(got[k] == t for k, t in rows if k >= 100) and all(len(got[k]) > 700 for k in range(30))


def test_stages_take_odd_rows(spark):
    """Nulls, empty and repeated rows, ids that repeat or are null, a column of a clashing name, and empty tables."""
    prose = "The sea was calm that day, and we went out early with the boats. " * 4
    rows = [(1, prose, "a", 1.5), (1, prose, "a", 1.5), (1, prose + "Another day came after it, and all of us slept.", "a", 1.5), (None, prose, None, None), (None, None, None, None), (3, "", "b", 0.0), (4, None, "b", 0.0), (5, "é 中文", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert stage(spark, docs.where("false"), SF).count() == 0
        if name == "packing":
            assert {r.doc_id for r in got} == {1, 3, 4, 5, None} and sum(r.start == 0 for r in got) == len(rows)
            continue
        assert out.columns == docs.columns and {tuple(r)[0::2] for r in got} <= {r[0::2] for r in rows}
        if name == "near-dedup":  # of equal texts one row; the empty ones are alike too
            assert [r.text for r in got].count(prose) <= 1 and sum(not r.text for r in got) == 1 and any(r.text == "é 中文" for r in got)
        if name == "suffix-dedup":
            assert not any(r.text == prose for r in got) and sum(not r.text for r in got) == 3


NAMES = "text_key removed spans sha left_text whole_sha row number group first draw votes tid copies begin end cover fp h at far near n_bytes c0 _planwright_row"


def test_stages_take_any_column_name(spark):
    """Further columns may have the names that the operators use inside."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    shared, long = text(60), text(60_000)
    texts = [f"{text(30)} {shared} {text(20)}" for _ in range(6)] + [long, long + " and more.", None, ""]
    names = [n for n in NAMES.split() if n != "n_bytes"]
    rows = [(k, t, "s", *(f"{n}{k}" for n in names)) for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *(f"{n} string" for n in names)]))
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
        if name == "near-dedup":
            assert [r.doc_id for r in got if r.doc_id >= 8] == [8] and len([r for r in got if r.doc_id in (6, 7)]) <= 2
        if name == "suffix-dedup":
            assert not any(shared in (r.text or "") or long in (r.text or "") for r in got)


def test_survivors_do_not_depend_on_partitions(spark):
    rows = [(k % 3 or None, f"the same words stand here in every row {k % 2}", str(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = [rows_of(dict(C.STAGES)["near-dedup"](spark, df.repartition(n).sortWithinPartitions(F.desc("extra")), SF)) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) <= 2


rows_of = rows
