"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``order`` bytes deep, with the counts of the bytes that followed each
(from a bounded sample; frozen afterwards). A byte costs -log2 c/(n+t) bits in the longest context that knows it, and
-log2 t/(n+t) bits for each longer context that had to be left (n bytes seen there, t different ones; escape method C,
without exclusions). A text's language is the one whose tree codes it in the fewest bits.

The trees are laid over each other: one trie over all languages, with a column of costs for each, so that a text is
walked once. A cost that a language's own tree lacks is worked out when the tables are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.llm.sampling import MOST_CLASSES, SAMPLE_TEXT_BYTES, bounded_sample, held_out, learnable

ORDER, DOCS_PER_LANGUAGE, MOST_CELLS = 4, 150, 24_000_000


class Sparse:
    """The same as a dense table of steps, found by bisection; for tries of many cells."""

    def __init__(self, nodes: np.ndarray, symbols: np.ndarray, to: np.ndarray, base: int):
        key = nodes.astype(np.int64) * base + symbols
        by = np.argsort(key)
        self.key, self.to, self.base = key[by], to[by].astype(np.int32), base

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        key = at[0].astype(np.int64) * self.base + at[1]
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[found] == key, self.to[found], 0).astype(np.int32)


@dataclass
class Trees:
    languages: list[str]
    order: int
    symbol: np.ndarray  # of each byte value; 0 is the border between texts
    step: np.ndarray | Sparse  # [node, symbol] -> node, 0 if there is none; node 1 is the root
    cost: np.ndarray  # [node, language]: bits of the node's last byte after the bytes before it
    leave: np.ndarray  # [node, language]: bits to leave the node as a context

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]: code length of each text under each language's tree."""
        out = np.zeros((len(texts), len(self.languages)))
        most, at = max(200_000, 4_000_000 // max(1, len(self.languages))), 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to]) <= most):
                n, to = n + len(texts[to]), to + 1
            if to == at + 1 and n > most:
                out[at] = self._long(texts[at], most)
            else:
                out[at:to] = self._run(texts[at:to])
            at = to
        return out

    def _long(self, text: bytes, most: int) -> np.ndarray:
        total = self._run([text[:most]])[0]
        for at in range(most, len(text), most):
            total += self._run([text[at - self.order : at + most]], skip=self.order)[0]
        return total

    def _run(self, texts: list[bytes], skip: int = 0) -> np.ndarray:
        k = self.order
        s = self.symbol[np.frombuffer(b"".join(b"\0" * k + t for t in texts), np.uint8)]
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes + k) - sizes - k
        for i in range(k):
            s[begins + i] = 0
        n = len(s)
        nodes = [np.ones(n, np.int32)]
        for d in range(1, k + 2):
            nodes.append(self.step[nodes[-1][: n - d + 1], s[d - 1 :]] if n >= d else np.zeros(0, np.int32))
        real = np.ones(n, bool)
        for i in range(k + skip):
            real[begins + i] = False
        cost = np.zeros((n, len(self.languages)), np.float32)
        left = np.flatnonzero(real)
        for d in range(k + 1, 0, -1):
            found = nodes[d][left - d + 1]
            hit = found > 0
            cost[left[hit]] += self.cost[found[hit]]
            left = left[~hit]
            if d > 1:
                cost[left] += self.leave[nodes[d - 1][left - d + 1]]
        cost[left] += self.leave[1] + 8
        total = np.add.reduceat(cost, begins, axis=0, dtype=np.float64)
        return total


def grow(samples: dict[str, list[bytes]], order: int = ORDER, most_cells: int = MOST_CELLS) -> Trees:
    """Count contexts of all samples; a trie of over ``most_cells`` cells has its steps in a sorted list, which gives the same."""
    languages = sorted(samples)
    seen = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            seen[np.frombuffer(t, np.uint8)] = True
    base = int(seen.sum()) + 2  # 0: border, base - 1: bytes never seen
    symbol = np.full(256, base - 1, np.int16)
    symbol[seen] = np.arange(1, base - 1)
    streams = []
    for lang in languages:
        border = np.zeros(order, np.int64)
        streams.append(np.concatenate([x for t in samples[lang] for x in (border, symbol[np.frombuffer(t, np.uint8)].astype(np.int64))] or [border]))
    codes, counts = [np.zeros(1, np.int64)], [np.array([[len(s) for s in streams]], np.float64)]
    for d in range(1, order + 2):
        per = []
        for s in streams:
            c = np.zeros(max(0, len(s) - d + 1), np.int64)
            for i in range(d):
                c = c * base + s[i : len(s) - d + 1 + i]
            per.append(np.unique(c[c % base > 0], return_counts=True))
        own = np.unique(np.concatenate([p[0] for p in per]))
        # a context may hold borders, so those are kept as nodes too, as far as something follows them
        table = np.zeros((len(own), len(languages)))
        for k, (c, n) in enumerate(per):
            table[np.searchsorted(own, c), k] = n
        codes.append(own)
        counts.append(table)
    # prefixes that end in a border are contexts as well
    for d in range(order, 0, -1):
        need = np.unique(codes[d + 1] // base)
        new = np.setdiff1d(need, codes[d])
        merged = np.concatenate([codes[d], new])
        by = np.argsort(merged)
        codes[d] = merged[by]
        counts[d] = np.concatenate([counts[d], np.zeros((len(new), len(languages)))])[by]
    first = np.cumsum([1, *map(len, codes)])  # node number of the first of each depth
    dense = first[order + 1] * base <= most_cells
    step = np.zeros((first[order + 1], base), np.int32) if dense else None
    links: list[tuple[np.ndarray, ...]] = []
    total = first[order + 2]
    cost = np.zeros((total, len(languages)), np.float32)
    leave = np.zeros((total, len(languages)), np.float32)
    below = None
    for d in range(1, order + 2):
        parent = np.searchsorted(codes[d - 1], codes[d] // base)
        nodes = first[d] + np.arange(len(codes[d]))
        if dense:
            step[first[d - 1] + parent, codes[d] % base] = nodes
        else:
            links.append((first[d - 1] + parent, codes[d] % base, nodes))
        n = np.zeros((len(codes[d - 1]), len(languages)))
        t = np.zeros_like(n)
        np.add.at(n, parent, counts[d])
        np.add.at(t, parent, counts[d] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(n > 0, -np.log2(t / (n + t)), 0)
            own = -np.log2(counts[d] / (n + t)[parent])
        leave[first[d - 1] + np.arange(len(out))] = out
        if d == 1:
            shorter = np.full((len(codes[1]), len(languages)), 8.0)
        else:
            at = np.searchsorted(codes[d - 1], codes[d] % base ** (d - 1))
            at = np.minimum(at, len(codes[d - 1]) - 1)
            known = codes[d - 1][at] == codes[d] % base ** (d - 1)
            shorter = np.where(known[:, None], below[at], 8.0)
        below = np.where(counts[d] > 0, own, out[parent] + shorter)
        cost[nodes] = below
    if not dense:
        step = Sparse(*(np.concatenate(x) for x in zip(*links, strict=True)), base)
    return Trees(languages, order, symbol, step, cost, leave)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER, sample_text_bytes: int = SAMPLE_TEXT_BYTES, most_languages: int = MOST_CLASSES) -> DataFrame:
    """Predict the language of each whole text; one row for each row.

    Trees are grown from about ``docs_per_language`` different texts of each of the ``most_languages`` most frequent languages, outside the held-out
    fold; of texts of over ``sample_text_bytes`` bytes from a passage of that size (``sampling.bounded_sample``). Returns ``id_col``, held_out, lang_pred, score (the posterior of equally likely languages), bits_per_byte.
    Null texts and texts without a letter, and all texts if there is nothing to learn from, give ``und`` with score 0.
    Equal code lengths: the first language in byte order. Rows may repeat; further columns are ignored.
    """
    spark = docs.sparkSession
    sample = bounded_sample(docs.where(learnable(id_col)).select(id_col, text_col, lang_col), lang_col, docs_per_language, text_col, sample_text_bytes, most_languages)
    model = spark.sparkContext.broadcast(grow({str(k): [t.encode("utf-8", "replace") for t in v] for k, v in sample.items()}, order) if sample else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts, letters = part.column(1).to_pylist(), part.column(3).to_pylist()
                known = [k for k, x in enumerate(letters) if x and trees]
                pred, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
                if known:
                    raw = [texts[k].encode("utf-8", "replace") for k in known]
                    bits = trees.bits(raw)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(bits)), best]
                    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    for i, k in enumerate(known):
                        pred[k], score[k], rate[k] = trees.languages[best[i]], float(share[i]), float(least[i] / len(raw[i]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(pred), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names)

    names = [id_col, "held_out", "lang_pred", "score", "bits_per_byte"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")
