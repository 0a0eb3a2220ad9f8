"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding: the token t for which the
encoding of what is before it ends in a token u such that u and t stand side by side in the encoding of their own
two strings. ``Prefixes`` stores that last token for each prefix. Reading the chain backwards gives the encoding of
any prefix; appending bytes only adds entries, and an edit keeps every entry before it. ``encode_pieces`` fills the same
tables for many pieces at once, one column for each prefix length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planwright.llm.pieces import PieceCache


class Vocabulary:
    """Ranks of byte strings: the id of a token is its rank, and a lower rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # an automaton whose states are the beginnings of tokens: the longest that a string ends with
        self._heads = {t[:k] for t in ranks for k in range(len(t) + 1)}
        self._numbers, self._names = {b"": 0}, [b""]
        #: For each state the (length, token) of the tokens that it ends with, longest first; and as rows of arrays.
        self.outs: list[tuple[tuple[int, int], ...]] = [()]
        self.out_rows = np.zeros((4096, 16, 2), np.int32)
        #: Steps taken so far: state and byte to state (-1: not taken yet).
        self.steps = np.full((4096, 256), -1, np.int32)
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int32)
        for t, i in ranks.items():
            self.lengths[i] = len(t)
        # which tokens stand side by side, by a hash of the two: the pair, and the answer
        self._pairs, self._answers = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.strings = {v: k for k, v in ranks.items()}
        self._beside: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._edges: tuple[dict, dict] = ({}, {})

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, text: bytes, below: int = 1 << 60) -> list[int]:
        """The encoding by its definition: merge the adjacent pair of least rank (less than ``below``), leftmost first, until none is left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        to = int(self.steps[state, byte])
        if to < 0:
            name = self._names[state] + bytes((byte,))
            while name not in self._heads:
                name = name[1:]
            to = self._numbers.get(name, -1)
            if to < 0:
                to = self._numbers[name] = len(self._names)
                self._names.append(name)
                found = tuple((k, self.ranks[name[-k:]]) for k in range(len(name), 0, -1) if name[-k:] in self.ranks)
                self.outs.append(found)
                if to == len(self.steps):
                    self.steps = np.concatenate([self.steps, np.full_like(self.steps, -1)])
                    self.out_rows = np.concatenate([self.out_rows, np.zeros_like(self.out_rows)])
                if len(found) > self.out_rows.shape[1]:
                    self.out_rows = np.concatenate([self.out_rows, np.zeros((len(self.out_rows), len(found), 2), np.int32)], axis=1)
                if found:
                    self.out_rows[to, : len(found)] = found
            self.steps[state, byte] = to
        return to

    def step_all(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        to = self.steps[states, data]
        new = to < 0
        if new.any():
            for x in np.unique(states[new].astype(np.int64) << 8 | data[new]).tolist():
                self.step(x >> 8, x & 255)
            to = self.steps[states, data]
        return to

    def beside_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``beside`` of many pairs."""
        pair = a.astype(np.int64) << 32 | b
        at = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        out, new = self._answers[at], self._pairs[at] != pair
        if new.any():
            own, back = np.unique(pair[new], return_inverse=True)
            told = np.array([self.beside(x >> 32, x & 0xFFFFFFFF) for x in own.tolist()])
            out[new] = told[back]
            self._pairs[at[new]], self._answers[at[new]] = pair[new], out[new]
        return out

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for one byte and for a string that merges don't reach."""
        if token not in self._halves:
            text, parts = self.strings[token], []
            if len(text) > 1:
                parts = self.merged(text, below=token)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at the left (0) or right (1) end of a token while it is merged, from one byte up, with their ranks."""
        kept = self._edges[side].get(token)
        if kept is None:
            halves = self.halves(token)
            below = self.edge(halves[side], side) if halves else []
            kept = self._edges[side][token] = [*below, (self.strings[token], token if len(self.strings[token]) > 1 else -1)]
        return kept

    def beside(self, a: int, b: int) -> bool:
        """Does the encoding of the two strings together keep the two tokens?

        Merges go by rank, so at any time one known part of ``a`` touches one known part of ``b``. The tokens stay apart
        if at no time the merge of these two comes before the next merges of either; of equal ranks the left goes first.
        """
        kept = self._beside.get((a, b))
        if kept is None:
            left, right, get, end = self.edge(a, 1), self.edge(b, 0), self.ranks.get, 1 << 60
            i = j = 0
            while True:
                over = get(left[i][0] + right[j][0], end)
                next_left = left[i + 1][1] if i + 1 < len(left) else end
                next_right = right[j + 1][1] if j + 1 < len(right) else end
                kept = not (over < next_left and over <= next_right and over < end)
                if not kept or next_left == next_right == end:
                    break
                if next_left <= next_right:
                    i += 1
                else:
                    j += 1
            if len(self._beside) > 500_000:
                self._beside.clear()
            self._beside[a, b] = kept
        return kept


class Prefixes:
    """A growing byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last, self.states = vocabulary, b"", [-1], [0]
        self.append(text)

    def append(self, more: bytes) -> None:
        """Exact: entries of earlier prefixes stand."""
        self.text += more
        for byte in more:
            self.states.append(self.vocabulary.step(self.states[-1], byte))
            self.last.append(last_token(self.vocabulary, self.states[-1], len(self.last), self.last))

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of text[begin:end]; only prefixes that end after ``begin`` are computed again."""
        tail = new + self.text[end:]
        self.text, self.last, self.states = self.text[:begin], self.last[: begin + 1], self.states[: begin + 1]
        self.append(tail)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes (all, if None)."""
        at, out = len(self.text) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.strings[out[-1]])
        return out[::-1]


def last_token(v: Vocabulary, state: int, end: int, last: list[int]) -> int:
    """The one token that can end the encoding of a string's first ``end`` bytes, after which the automaton is in ``state``, given those of all shorter prefixes."""
    known = v._beside
    for size, t in v.outs[state]:
        if size == end:
            return t
        before = last[end - size]
        kept = known.get((before, t))
        if kept or kept is None and v.beside(before, t):
            return t
    raise ValueError(f"byte {end - 1} has no token")


#: Pieces of more bytes are encoded one by one.
LONGEST = 48


def encode_pieces(v: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """The encoding of each piece."""
    out = [[t] if (t := v.ranks.get(p)) is not None or not p else None if len(p) <= LONGEST else Prefixes(v, p).ids() for p in pieces]
    rows = sorted((k for k, x in enumerate(out) if x is None), key=lambda k: -len(pieces[k]))
    for lo in range(0, len(rows), 32_768):
        part = rows[lo : lo + 32_768]
        size = np.array([len(pieces[k]) for k in part])
        longest = int(size[0])
        data = np.frombuffer(b"".join([pieces[k].ljust(longest, b"\0") for k in part]), np.uint8).reshape(len(part), longest)
        last = np.zeros((len(part), longest + 1), np.int32)
        state = np.zeros(len(part), np.int32)
        alive = np.searchsorted(-size, -np.arange(longest + 1), side="right")  # rows of so many bytes, which come first
        for end in range(1, longest + 1):
            n = alive[end]
            state = v.step_all(state[:n], data[:n, end - 1])
            left, rank = np.arange(n), 0
            while len(left):
                if rank == v.out_rows.shape[1] or not (found := v.out_rows[state[left], rank])[:, 0].all():
                    raise ValueError("a byte has no token")
                begin, t = end - found[:, 0], found[:, 1]
                good = begin == 0
                inner = np.flatnonzero(~good)
                good[inner] = v.beside_all(last[left[inner], begin[inner]], t[inner])
                last[left[good], end] = t[good]
                left, rank = left[~good], rank + 1
        at, chain, row = size.copy(), [], np.arange(len(part))
        while len(row):
            t = last[row, at[row]]
            chain.append((row, t))
            at[row] -= v.lengths[t]
            row = row[at[row] > 0]
        row, t = (np.concatenate([c[i] for c in reversed(chain)]) for i in (0, 1))
        by = np.argsort(row, kind="stable")
        t, cuts = t[by].tolist(), np.searchsorted(row[by], np.arange(len(part) + 1)).tolist()
        for k, a, z in zip(part, cuts, cuts[1:], strict=False):
            out[k] = t[a:z]
    return out


def decode(vocabulary: Vocabulary, ids: list[int]) -> bytes:
    return b"".join(map(vocabulary.strings.__getitem__, ids))


class TextCoder:
    """Encodes whole texts, each match of ``pattern`` separately, and decodes the ids."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.decimal = {i: str(i) for i in vocabulary.strings}
        self.cache = PieceCache(pattern, self._pieces, self._join, limit=400_000)

    def _pieces(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        ids, name, text = encode_pieces(self.vocabulary, [p.encode("utf-8", "replace") for p in pieces]), self.decimal.__getitem__, self.vocabulary.strings.__getitem__
        return [(" ".join(map(name, x)), b"".join(map(text, x))) for x in ids]

    @staticmethod
    def _join(parts: list[tuple[str, bytes]]) -> tuple[str, bytes]:
        return " ".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the decimal ids joined by one space, SHA-256 of the decoded bytes."""
        out = []
        for values in self._values(texts):
            ids, text = self._join(values)
            out.append((ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for x in values for i in x[0].split()] for values in self._values(texts)]

    def _values(self, texts: list[str]) -> Iterator[list[tuple[str, bytes]]]:
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < 2_000_000):
                size, to = size + len(texts[to]), to + 1
            yield from self.cache.values(texts[at:to])
            at = to


_coders: dict[tuple[str, str], TextCoder] = {}


def coder(path: str, pattern: str) -> TextCoder:
    """One for each Python worker, which keeps it between tasks."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = TextCoder(Vocabulary.from_file(path), pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text (null: empty) and decode the ids again; one row for each row, in one pass without a shuffle.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if ``with_ids``. Empty texts have
    no ids, and the digests of the empty string. Ids and rows may repeat or be null; further columns are ignored.
    ``ranks_path`` is a vocabulary file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n, ids, out = zip(*c.digests(texts), strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(out)]
                if with_ids:
                    columns.append(pa.array(c.encode(texts), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)
