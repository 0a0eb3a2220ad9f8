"""Quality classification from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. How often each combination of votes occurs
is counted over all documents; expectation-maximisation on these counts estimates how each labeller votes on good and on
bad documents and how common these are. The posterior of a document's votes is its weak label, and the labels of a
bounded sample train a linear scorer on hashed features, which judges every document, also those that no labeller knows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

BAD, GOOD, NONE = "b", "g", "-"
#: Hashed features: runs of four character classes, and word and line traits.
GRAMS, TRAITS = 4096, 512
SAMPLE_DOCS = 3000

_CLASSES = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = 0 if _c in " \t\r\x0b\x0c" else 1 if _c == "\n" else 2 if "a" <= _c <= "z" else 3 if "A" <= _c <= "Z" else 4 if "0" <= _c <= "9" else 5 if _c in ".,;:?'\"-()" else 6 if _b < 128 else 7


@dataclass
class Traits:
    words: int
    symbols: float  # of all characters, those neither letters, digits, white space nor common marks
    capitals: float  # of all words, those of over one letter in capitals
    repeats: float  # of all words, those equal to the word before
    distinct: float  # of all words
    bars: float  # of all words, those that are one mark
    ends: float  # of all words, those that end a sentence
    shouts: float  # of all words, those that end in !! or the like
    tails: float  # of all words, those that end in two symbols or more


_TAIL = re.compile(r"[#$%&*|^~<>=+]{2,}(?:\s|$)")
_SYMBOLS, _SHOUT = re.compile(r"[#$%&*|^~<>{}\[\]\\`!]"), re.compile(r"[!?]{2,}(?:\s|$)")


def traits(text: str) -> Traits:
    words = text.split()
    n = len(words)
    many = max(1, n)
    return Traits(
        n,
        len(_SYMBOLS.findall(text)) / max(1, len(text)),
        sum(len(w) > 1 and w.isupper() for w in words) / many,
        sum(map(eq, words, words[1:])) / many,
        len(set(words)) / many,
        sum(len(w) == 1 and not w.isalnum() for w in words) / many,
        sum(w[-1] in ".?!" for w in words) / many,
        len(_SHOUT.findall(text)) / many,
        len(_TAIL.findall(text)) / many,
    )


def _vote(bad: bool, good: bool) -> str:
    return BAD if bad else GOOD if good else NONE


#: name -> vote. Each looks at one trait and keeps silent between its two bounds; a few words are no ground for "bad".
LABELLERS: dict[str, Callable[[Traits], str]] = {
    "symbols": lambda t: _vote(t.words >= 5 and t.symbols > 0.02, t.words > 0 and t.symbols < 0.004),
    "capitals": lambda t: _vote(t.words * t.capitals >= 4 and t.capitals > 0.15, t.words > 0 and t.capitals < 0.05),
    "repeats": lambda t: _vote(t.words * t.repeats >= 4 and t.repeats > 0.08, t.words > 0 and t.repeats < 0.02),
    "distinct": lambda t: _vote(t.words >= 20 and t.distinct < 0.25, t.words >= 5 and t.distinct > 0.4),
    "bars": lambda t: _vote(t.words * t.bars >= 4 and t.bars > 0.04, False),
    "sentences": lambda t: _vote(t.words >= 80 and t.ends < 0.012, t.words > 0 and 0.03 < t.ends < 0.5),
    "shouts": lambda t: _vote(t.words * t.shouts >= 4 and t.shouts > 0.04, False),
    "tails": lambda t: _vote(t.words * t.tails >= 4 and t.tails > 0.04, False),
    "length": lambda t: _vote(t.words == 0, t.words >= 5),
}


def votes(t: Traits) -> str:
    return "".join(f(t) for f in LABELLERS.values())


def fit_votes(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """The probability that a document with these votes is good, for each combination of votes.

    Expectation-maximisation over (prior; for each labeller the chances of its three votes on good and on bad documents),
    begun at labellers that are right more often than wrong.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    weight = np.array([counts[p] for p in patterns], float)
    seen = np.array([[[c == v for v in (GOOD, BAD, NONE)] for c in p] for p in patterns], float)  # [pattern, labeller, vote]
    up, down = seen[:, :, 0].sum(axis=1), seen[:, :, 1].sum(axis=1)
    good = np.clip(0.7 + 0.05 * up - 0.45 * down, 0.02, 0.98)
    for _ in range(rounds):
        prior = np.clip((weight * good).sum() / weight.sum(), 0.01, 0.99)
        rate = [(np.einsum("p,plv->lv", weight * q, seen) + 1) / ((weight * q).sum() + 3) for q in (good, 1 - good)]
        log = np.log(prior) - np.log1p(-prior) + np.einsum("plv,lv->p", seen, np.log(rate[0]) - np.log(rate[1]))
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return dict(zip(patterns, new.tolist(), strict=True))


def features(text: str, t: Traits) -> np.ndarray:
    """Square roots of the shares of hashed class runs, then hashed traits in steps."""
    c = _CLASSES[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)].astype(np.int32)
    out = np.zeros(GRAMS + TRAITS, np.float32)
    if len(c) > 3:
        codes = ((c[:-3] * 8 + c[1:-2]) * 8 + c[2:-1]) * 8 + c[3:]
        out[:GRAMS] = np.sqrt(np.bincount(codes, minlength=GRAMS) / len(codes))
    for name in ("symbols", "capitals", "repeats", "distinct", "bars", "ends", "shouts", "tails"):
        step = int(min(15, 40 * getattr(t, name)))
        out[GRAMS + zlib.crc32(f"{name}:{step}".encode()) % TRAITS] += 0.5
    return out


def fit_scorer(rows: np.ndarray, label: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the constant."""
    x = np.hstack([rows, np.ones((len(rows), 1), np.float32)]).astype(np.float32)
    label = label.astype(np.float32)
    share = np.clip(label.mean(), 0.02, 0.98)
    weight = label * 0.5 / share + (1 - label) * 0.5 / (1 - share)  # both classes count alike
    w, before, rate = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), np.float32(4.0 / max(1e-9, float((x * x).sum(axis=1).mean())))
    for k in range(rounds):
        v = w + (w - before) * np.float32(k / (k + 3))
        p = (1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))).astype(np.float32)
        before, w = w, v - rate * (x.T @ (weight * (p - label)) / np.float32(len(x)) + np.float32(penalty) * v)
    return w


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Judge each row's whole text; every column of ``docs`` is kept.

    Added: quality_posterior (of the labellers' votes), quality_score (the scorer's, 0 to 1) and quality_keep (it is
    ``threshold`` or more). Vote counts are over all rows; the scorer learns from about ``sample_docs`` rows, half
    likely good and half likely bad (texts over 64 KiB aren't drawn, but judged). Null texts count as empty; texts without words
    are rejected with score 0. Rows may repeat; added columns replace those of the same name. Nothing to learn from: the score is the posterior.
    """
    spark = docs.sparkSession

    def pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(traits(t or "")) for t in b.column(0).to_pylist()], pa.string()), b.column(1)], ["votes", "draw"])

    # equal texts have one number, so copies are drawn together
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 30))
    counted = docs.select(text_col, draw).mapInArrow(pattern, "votes string, draw long").groupBy("votes").agg(F.count(F.lit(1)), F.approx_count_distinct("draw", 0.02))
    # at most three votes to the power of the number of labellers
    told_counts = counted.collect()
    counts, different = ({r[0]: r[i] for r in told_counts} for i in (1, 2))
    posterior = fit_votes(counts)
    likely = {side: sum(n for p, n in different.items() if (posterior[p] >= 0.5) == side) for side in (True, False)}
    shares = {side: min(1.0, sample_docs / 2 / max(1, n)) for side, n in likely.items()}
    told = spark.sparkContext.broadcast((posterior, shares))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = told.value
        for b in batches:
            rows = []
            for text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = traits(text)
                if (p := known[votes(t)]) is not None and at / float(1 << 30) < part[p >= 0.5]:
                    f = features(text, t)
                    own = np.flatnonzero(f).astype(np.int16)
                    rows.append((at, p, own.tobytes(), f[own].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.binary(), pa.binary()))], ["draw", "posterior", "places", "values"])

    # rows that neither share can take stay in the JVM; of a drawn text only its features are sent, and copies once
    drawn = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), draw.alias("draw")).where(F.col("draw") < max(shares.values()) * (1 << 30))
    drawn = drawn.mapInArrow(rows_of, "draw long, posterior double, places binary, values binary").dropDuplicates(["draw", "places", "values"]).collect()
    drawn = sorted(drawn, key=lambda r: (r["draw"], bytes(r["places"]), bytes(r["values"])))
    weights = None
    if drawn and 0.02 < (mean := float(np.mean([r["posterior"] for r in drawn]))) < 0.98 and mean:
        table = np.zeros((len(drawn), GRAMS + TRAITS), np.float32)
        for k, r in enumerate(drawn):
            table[k, np.frombuffer(r["places"], np.int16)] = np.frombuffer(r["values"], np.float32)
        weights = fit_scorer(table, np.array([r["posterior"] for r in drawn]))
    model = spark.sparkContext.broadcast((posterior, weights))
    added = {"quality_posterior", "quality_score", "quality_keep"}
    kept = [c for c in docs.columns if c not in added]
    at_text = kept.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = model.value
        for b in batches:
            belief, score = [], []
            for text in b.column(at_text).to_pylist():
                t = traits(text or "")
                p = known.get(votes(t), 0.5) if t.words else 0.0
                belief.append(p)
                score.append(0.0 if not t.words else p if w is None else float(1 / (1 + np.exp(-np.clip(features(text, t) @ w[:-1] + w[-1], -30, 30)))))
            keep = [s >= threshold for s in score]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(belief, pa.float64()), pa.array(score, pa.float64()), pa.array(keep, pa.bool_())], [*b.schema.names, "quality_posterior", "quality_score", "quality_keep"])

    schema = StructType([*docs.select(*kept).schema.fields, StructField("quality_posterior", DoubleType()), StructField("quality_score", DoubleType()), StructField("quality_keep", BooleanType())])
    return docs.select(*kept).mapInArrow(judge, schema)
