"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Unit of judgement: a word in lower case, or the joined letters of a word that is written with
spaces between its characters. The kernel of two units compares all subsequences of three characters, each weighed by
DECAY to the length that it spans, so an insult with characters put in or left out still shares most subsequences with
the plain one. Landmarks are units of both kinds from the labelled texts; the machine is linear in the kernel values to the
landmarks, whitened by the inverse root of the landmarks' own kernel. As such a machine's value is an inner product
with one vector over the space of subsequences, that vector is worked out once and long texts are scored in one pass.

A text is judged by the values of its units: the highest three, how many are above zero, and how many units there are. Labels
are of whole texts: which units speak for toxic texts is found by strings of letters that come back in ever different
toxic texts far more often than the share of toxic texts explains. Scores are fitted on values from machines that
haven't seen the text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import combinations
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from planwright.llm.sampling import SAMPLE_TEXT_BYTES, held_out, learnable, passage

DECAY, SHORTEST, LONGEST = 0.6, 3, 20
LANDMARKS, SAMPLE_DOCS, THRESHOLD = 192, 1200, 0.3
#: Classes of characters: a to z, digits, marks, and other letters by their code point.
BASE, DIGIT, MARK, OTHERS = 40, 27, 28, 29

_SPACED = re.compile(r"(?<!\S)(?:\w[ .\-_*]){3,}\w(?!\w)")
_WORD = re.compile(r"\S+")


def _plain(ch: str) -> int:
    """a to z of either case; digits; other letters by a hash of their lower case; everything else."""
    low = ch.lower()[0]
    if "a" <= low <= "z":
        return ord(low) - 96
    if low.isalpha():
        return OTHERS + ord(low) % (BASE - OTHERS)
    return DIGIT if low.isdigit() else MARK


class _Codes(dict):
    def __missing__(self, ch: int) -> int:
        self[ch] = out = _plain(chr(ch)) + 64
        return out


_CODES = _Codes()
_LETTER = re.compile(r"\w")


def units(words: list[str]) -> dict[str, list[str]]:
    """For each word its units: strings over the classes of characters (from @ on), cut at LONGEST with half overlap."""
    out = {}
    for w in words:
        u = w.translate(_CODES).strip(chr(64 + MARK))
        if len(u) < SHORTEST:
            out[w] = []
        elif len(u) <= LONGEST:
            out[w] = [u]
        else:
            out[w] = [u[i : i + LONGEST] for i in range(0, len(u) - LONGEST // 2, LONGEST // 2)]
    return out


def text_words(text: str) -> list[str]:
    """White-space words, and words that are spelled out with single characters, joined."""
    found = text.split()
    if " " in text:
        found += ["".join(_LETTER.findall(m)) for m in _SPACED.findall(text)]
    return found


def _table(group: list[str]) -> np.ndarray:
    return (np.frombuffer("".join(group).encode("latin-1"), np.uint8).reshape(len(group), -1) - 64).astype(np.int32)


def subsequences(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes [unit, triple] and weights [triple] of units of one length."""
    c = _table(group)
    triples = list(combinations(range(c.shape[1]), 3))
    i, j, k = np.array(triples).T
    return (c[:, i] * BASE + c[:, j]) * BASE + c[:, k], (DECAY ** (k - i + 1)).astype(np.float32)


def norms(group: list[str]) -> np.ndarray:
    """Root of the kernel of each unit with itself, by the kernel's recursion over pairs of positions."""
    c = _table(group)
    n, size = c.shape
    same = (c[:, :, None] == c[:, None, :]).astype(np.float32)
    ending = same * np.float32(DECAY**2)  # sum over common subsequences that end at (i, j)
    for _ in range(2):
        before = np.zeros((n, size + 1, size + 1), np.float32)
        for i in range(size):
            for_row = np.zeros(n, np.float32)
            for j in range(size):
                for_row = for_row * np.float32(DECAY) + ending[:, i, j]
                before[:, i + 1, j + 1] = before[:, i, j + 1] * np.float32(DECAY) + for_row
        ending = same * np.float32(DECAY**2) * before[:, :-1, :-1]
    return np.sqrt(np.maximum(ending.sum(axis=(1, 2)), 1e-12))


@dataclass
class Machine:
    direction: np.ndarray  # over the subsequences
    constant: float
    weights: np.ndarray | None = None  # of a text's features

    def values(self, found: list[str]) -> np.ndarray:
        """The machine's value of each unit."""
        out = np.zeros(len(found), np.float32)
        by = defaultdict(list)
        for k, u in enumerate(found):
            by[len(u)].append(k)
        for at in by.values():
            for lo in range(0, len(at), 1024):
                part = [found[k] for k in at[lo : lo + 1024]]
                c, w = subsequences(part)
                out[at[lo : lo + 1024]] = (self.direction[c] @ w) / norms(part) + self.constant
        return out

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(found @ self.weights, -30, 30)))


#: The value of a text that lacks units, and the value beyond which a unit is counted.
NOTHING, CLEAR = -2.0, 0.6


def text_features(values: list[float]) -> list[float]:
    """Of a text whose distinct units have these values: the highest three within bounds, how many are clear, and how many there are."""
    top = sorted(nlargest(3, values), reverse=True)
    top += [NOTHING] * (3 - len(top))
    out = [1.0, *(min(1.0, max(-0.5, v)) for v in top), 0.0, log1p(len(values))]
    if top[0] > CLEAR:
        out[4] = log1p(sum(v > CLEAR for v in values))
    return out


def vectors(found: list[str]) -> np.ndarray:
    """Normalised subsequence vectors [subsequence, unit] of a few units."""
    out = np.zeros((BASE**3, len(found)), np.float32)
    for k, u in enumerate(found):
        c, w = subsequences([u])
        np.add.at(out[:, k], c[0], w / norms([u])[0])
    return out


def kernels(found: list[str], landmarks: np.ndarray) -> np.ndarray:
    """[unit, landmark]: normalised kernel values to the landmarks, given by their ``vectors``."""
    out = np.zeros((len(found), landmarks.shape[1]), np.float32)
    by = defaultdict(list)
    for k, u in enumerate(found):
        by[len(u)].append(k)
    for at in by.values():
        for lo in range(0, len(at), 512):
            part = [found[k] for k in at[lo : lo + 512]]
            c, w = subsequences(part)
            total = np.zeros((len(part), out.shape[1]), np.float32)
            for t in range(len(w)):
                total += w[t] * landmarks[c[:, t]]
            out[at[lo : lo + 512]] = total / norms(part)[:, None]
    return out


def _machine(z: np.ndarray, found: list[str], label: np.ndarray, weight: np.ndarray, penalty: float = 2e-5) -> tuple[np.ndarray, float]:
    """Squared-hinge machine on whitened kernel values to the landmarks ``z``; both classes weigh alike. Newton steps."""
    values, axes = np.linalg.eigh((z.T @ z).astype(np.float64))
    white = axes / np.sqrt(np.maximum(values, 1e-3))
    x = np.hstack([kernels(found, z) @ white, np.ones((len(found), 1))])
    y, w = np.where(label, 1.0, -1.0), np.zeros(x.shape[1])
    weight = np.where(label, 0.5 * weight / weight[label].sum(), 0.5 * weight / weight[~label].sum())
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-8
    for _ in range(30):
        margin = 1 - y * (x @ w)
        on = margin > 0
        gradient = ridge * w - x[on].T @ (weight[on] * y[on] * margin[on])
        step = np.linalg.solve((x[on].T * weight[on]) @ x[on] + np.diag(ridge), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return (z @ (white @ w[:-1])).astype(np.float32), float(w[-1])


def _distinct_texts(per: list[list[str]]) -> list[int]:
    """Texts that aren't near copies of ones before: of each the least hashes of two units side by side are kept."""
    seen: dict[int, set[int]] = defaultdict(set)
    out = []
    for k, units_ in enumerate(per):
        least = sorted({zlib.crc32(f"{a} {b}".encode()) for a, b in zip(units_, units_[1:], strict=False)})[:32]
        met = Counter(t for h in least for t in seen[h])
        if not met or max(met.values()) < max(2, len(least) // 4):
            out.append(k)
        for h in least:
            seen[h].add(k)
    return out


def _strings(unit: str, sizes: tuple[int, ...] = (4, 5, 6, 7)) -> set[str]:
    """Strings of letters that a unit holds; at its ends its border counts as a letter."""
    whole = f"<{unit}>"
    return {whole[i : i + n] for n in sizes for i in range(len(whole) - n + 1)} | {whole}


class _Evidence:
    """For each text the strings that one, two and three or more of its units hold; only strings of three or more toxic texts."""

    def __init__(self, toxic: list[list[str]], clean: list[list[str]]):
        # strings are counted by a hash first, so that the many that come once or twice are never held together
        places = np.zeros(1 << 22, np.uint16)
        for found in toxic:
            here = {g for u in set(found) for g in _strings(u)}
            at = np.unique(np.fromiter((zlib.crc32(g.encode("latin-1")) & 0x3FFFFF for g in here), np.int64, len(here)))
            places[at] = np.minimum(places[at], 65_000) + 1
        first: Counter = Counter()
        for found in toxic:
            first.update({g for u in set(found) for g in _strings(u) if places[zlib.crc32(g.encode("latin-1")) & 0x3FFFFF] >= 3})
        del places
        number = {g: i for i, g in enumerate(sorted(g for g, n in first.items() if n >= 3))}
        del first
        self.size, self.of = len(number), {}
        none = np.zeros(0, np.int32)
        self.levels = []
        for texts in (clean, toxic):
            rows = []
            for found in texts:
                for u in (own := set(found)):
                    if u not in self.of:
                        self.of[u] = np.array([number[g] for g in _strings(u) if g in number], np.int32)
                held, times = np.unique(np.concatenate([none, *(self.of[u] for u in own)]), return_counts=True)
                rows.append([held[times > level] for level in range(3)])
            self.levels.append(rows)
        self.toxic, self.novel = toxic, set(_distinct_texts(toxic))

    def marks(self, toxic: list[int], clean: list[int]) -> Counter:
        """Units of these toxic texts that hold a telling string, with the number of the texts that they are in.

        Of the texts of which so many units hold a string, are there more toxic ones than their share explains? Told by a binomial tail,
        with as many tries as there are strings.
        """
        toxic = [k for k in toxic if k in self.novel]
        share = len(toxic) / max(1, len(toxic) + len(clean))
        telling = np.zeros(self.size, bool)
        for level in range(3):
            no, yes = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(self.levels[kind][k][level] for k in of)]), minlength=self.size) for kind, of in ((0, clean), (1, toxic)))
            tried = np.flatnonzero(yes >= 3)
            for g, k, n in zip(tried.tolist(), yes[tried].tolist(), (yes + no)[tried].tolist(), strict=True):
                if k > 2 * share * n and log(len(tried)) + _tail(n, k, share) < log(0.05):
                    telling[g] = True
        chosen = {u for k in toxic for u in self.toxic[k]}
        chosen = {u for u in chosen if telling[self.of[u]].any()}
        beside: dict[str, set] = defaultdict(set)
        texts_of: Counter = Counter()
        for found in (self.toxic[k] for k in toxic):
            for k, u in enumerate(found):
                if u in chosen:
                    beside[u].add((found[k - 1] if k else "", found[k + 1] if k + 1 < len(found) else ""))
            texts_of.update(chosen.intersection(found))
        # a passage that several texts copy has the same neighbours each time
        return Counter({u: n for u, n in texts_of.items() if len(beside[u]) >= 0.6 * n})


def _tail(n: int, k: int, p: float) -> float:
    """Logarithm of the chance of k or more of n at ``p`` each (a bound by relative entropy)."""
    q = k / n
    return -n * (q * log(q / p) + ((1 - q) * log((1 - q) / (1 - p)) if q < 1 else 0.0))


def _fit(toxic: list[list[str]], clean: list[list[str]], marks: Counter, landmarks: int) -> Machine | None:
    negative = Counter(u for found in clean for u in set(found))
    if not marks or not negative:
        return None
    positive = sorted(marks, key=lambda u: (-marks[u], u))
    common = sorted(negative, key=lambda u: (-negative[u], u))
    against = list(dict.fromkeys(common[:: max(1, len(common) // 2000)] + [u for u in positive if u in negative]))
    half = landmarks // 2
    z = vectors(positive[:half] + against[:: max(1, len(against) // half)][:half])
    for _ in range(2):
        found = positive + against
        # a mark weighs as many texts as it is in; so do clean units, but in proportion to the kinds' texts
        weight = np.array([float(marks[u]) for u in positive] + [1.0 + (negative[u] * len(toxic) / max(1, len(clean)) if u in marks else 0.0) for u in against])
        machine = Machine(*_machine(z, found, np.arange(len(found)) < len(positive), weight))
        value = machine.values(common)
        against = list(dict.fromkeys(against + [common[k] for k in np.argsort(-value, kind="stable")[:1000]]))
    return machine


def train(toxic: list[str], clean: list[str], share: float | None = None, landmarks: int = LANDMARKS, folds: int = 3) -> Machine | None:
    """None if no units speak for toxic texts. ``share`` is that of toxic texts where the samples were drawn from."""
    groups, of = [], {}
    for texts in (toxic, clean):
        cut = []
        for t in sorted(set(texts), key=lambda t: (zlib.crc32(t.encode("utf-8", "replace")), t)):
            words = text_words(t)
            of.update(units(list(set(words).difference(of))))
            cut.append([u for w in words for u in of[w]])
        groups.append(cut)
    del of
    evidence = _Evidence(*groups)

    def machine_of(chosen: list[list[int]]) -> Machine | None:
        return _fit(*([g[k] for k in c] for g, c in zip(groups, chosen, strict=True)), evidence.marks(*chosen), landmarks)

    machine = machine_of([list(range(len(g))) for g in groups])
    if machine is None:
        return None
    rows, label = [], []
    for fold in range(folds):
        other = machine_of([[k for k in range(len(g)) if k % folds != fold] for g in groups]) or machine
        for kind, g in ((1.0, groups[0]), (0.0, groups[1])):
            own = g[fold::folds]
            distinct = list({u for x in own for u in x})
            value = dict(zip(distinct, other.values(distinct).tolist(), strict=True))
            rows += [text_features([value[u] for u in set(x)]) for x in own]
            label += [kind] * len(own)
    machine.weights = _logistic(np.array(rows), np.array(label), len(groups[0]) / max(1, sum(map(len, groups))) if share is None else share)
    return machine


def _logistic(x: np.ndarray, y: np.ndarray, share: float, penalty: float = 2e-4) -> np.ndarray:
    """Weights that make features a probability, where a ``share`` of all is toxic."""
    weight = np.where(y > 0, share / max(1.0, y.sum()), (1 - share) / max(1.0, (1 - y).sum()))
    y = np.where(y > 0, 0.98, 0.02)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (weight * p * (1 - p))) @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


class Scorer:
    """Scores texts; the values of words seen lately are kept."""

    LIMIT = 300_000

    def __init__(self, machine: Machine | None):
        self.machine, self.now, self.old = machine, {}, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.machine is None:
            return np.zeros(len(texts))
        if len(self.now) > self.LIMIT:
            self.now, self.old = {}, self.now
        words = [text_words(t) if t else [] for t in texts]
        distinct = [set(x) for x in words]
        new = {w for x in distinct for w in x}.difference(self.now)
        for w in new.intersection(self.old):
            self.now[w] = self.old[w]
        new = sorted(new.difference(self.old))
        cut = units(new)
        flat = [u for w in new for u in cut[w]]
        value, at = self.machine.values(flat).tolist(), 0
        for w in new:
            n = len(cut[w])
            self.now[w] = max(value[at : at + n]) if n else None
            at += n
        get = self.now.__getitem__
        return self.machine.score(np.array([text_features([v for v in map(get, x) if v is not None]) for x in distinct]).reshape(len(texts), -1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_text_bytes: int = SAMPLE_TEXT_BYTES) -> Machine | None:
    """Train on about ``sample_docs`` labelled ids of either kind outside the held-out fold.

    An id that has several texts gives one of them; of a text of over ``sample_text_bytes`` bytes a passage of that size is learned.
    """
    marked = labels.where(learnable(id_col)).select(id_col, label_col).where(f"`{label_col}` in (0, 1)").distinct()
    counts = {r[0]: r[1] for r in marked.groupBy(label_col).count().collect()}
    # ids are drawn before texts are looked up, so no text is shuffled; the drawn ids are about twice the sample at most
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col(label_col) == c, min(1.0, 1.2 * sample_docs / n) * (1 << 30)) for c, n in counts.items()], F.lit(0.0))
    drawn = marked.withColumn("_draw", draw).where(F.col("_draw") < share)
    drawn = drawn.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), "_draw")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), "_id")
    rows = rows.groupBy("_label", "_id").agg(F.min("_draw").alias("_draw"), F.min(passage("_text", sample_text_bytes)).alias("text"))
    found: dict[int, list[tuple[int, str]]] = {0: [], 1: []}
    for label, order, text in rows.select("_label", "_draw", "text").collect():
        found[label].append((order, text))
    toxic, clean = ([t for _, t in sorted(found[c])[:sample_docs]] for c in (1, 0))
    return train(toxic, clean, counts.get(1, 0) / max(1, sum(counts.values())))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Score each row's whole text; every column of ``docs`` is kept (those of the added names are replaced).

    Added: held_out, score (0 to 1), predicted (1 if score >= ``threshold``). Null and empty texts score as texts without
    units. Rows may repeat; an id with both labels counts for both. Nothing to learn from: all scores are 0.
    """
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample_docs=sample_docs))
    added = ["held_out", "score", "predicted"]
    kept = [c for c in docs.columns if c not in added]
    at_text = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = scorer.scores(part.column(at_text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"), pa.int32())], [*part.schema.names, "score", "predicted"])

    rows = docs.select(*kept, held_out(id_col).alias("held_out"))
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(run, schema)
