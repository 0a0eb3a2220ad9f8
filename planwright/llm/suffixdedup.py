"""Repeated byte strings by a sparse suffix array that is merged with knowledge of common prefixes.

A string of ``length`` bytes that starts at s is filed under its anchor: the position of the least hash among the GRAM-byte
strings that start in its first WINDOW positions (the leftmost, if equal). The anchor depends on the string's bytes alone, so equal
strings have anchors at equal offsets, and one anchor serves a run of consecutive starts. Only suffixes that begin at
anchors are sorted, about one in WINDOW / 2 bytes, and of these only such whose first length - WINDOW + 1 bytes, which
every string filed there has, occur twice by a hash.

Each task sorts its suffixes and sends them out as front-coded runs (length of the prefix shared with the one before, then the
rest). Receivers merge runs with a loser tree that keeps, for every run's head, the prefix known to be shared with the last
winner; longer known prefixes win without looking at a byte, equal ones are compared from there on. The merge yields the
suffix order and the common prefixes of neighbours. A string at offset o before its anchor is repeated if another anchor has
at least length - o bytes to the right and o bytes to the left in common; both are read off the sorted right and left contexts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.staging import discard, staged

LENGTH, WINDOW, GRAM = 400, 200, 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of contexts that a task holds before it sends a run, and that a receiver should hold.
RUN_BYTES, PART_BYTES = 24_000_000, 24_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


class _Hashes:
    """Hashes of all substrings of a text: differences of a polynomial prefix sum, shifted to one place."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, text: bytes):
        n = len(text)
        if len(_Hashes.powers) <= n:
            size = max(1 << 16, 2 * n)
            with np.errstate(over="ignore"):
                for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                    setattr(_Hashes, name, np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)], dtype=np.uint64))
        b = _mix(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(0x51ED27))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * _Hashes.powers[:n], dtype=np.uint64)])

    def of(self, begin: np.ndarray | slice, size: int) -> np.ndarray:
        if isinstance(begin, slice):
            n = len(self.sums) - size
            return _mix((self.sums[size:] - self.sums[:n]) * _Hashes.inverses[:n])
        return _mix((self.sums[begin + size] - self.sums[begin]) * _Hashes.inverses[begin])


def anchors(text: bytes, length: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, hash of what all strings filed there begin with from the anchor on)."""
    starts = len(text) - length + 1
    if starts < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashes = _Hashes(text)
    g = hashes.of(slice(None), gram)[: starts + window - 1]
    value = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while span * 2 <= window:  # minima over spans that double, then two that overlap
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    if span < window:
        value = np.minimum(value[: -(window - span)], value[window - span :])
    at = (value[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], starts] - 1
    return at[first], first, last, hashes.of(at[first], length - window + 1).view(np.int64)


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # the first difference is in [low, high)
    while high - low > 8:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while a[low] == b[low]:
        low += 1
    return low


Entry = tuple[bytes, bytes, int, int, int, int]  # right context, left context (reversed), text, anchor, first and last start
_HEAD = struct.Struct("<IIIqqII")


def front_code(entries: list[Entry]) -> bytes:
    """A sorted run: for each suffix the prefix shared with the one before, then the rest."""
    out, before = [], b""
    for right, left, tid, at, first, last in entries:
        k = shared(before, right)
        out.append(_HEAD.pack(k, len(right) - k, len(left), tid, at, at - first, at - last))
        out += (right[k:], left)
        before = right
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, Entry]]:
    """(prefix shared with the one before, entry)"""
    at, before, size = 0, b"", _HEAD.size
    while at < len(run):
        k, rest, left, tid, anchor, far, near = _HEAD.unpack_from(run, at)
        at += size
        before = before[:k] + run[at : at + rest]
        at += rest
        yield k, (before, run[at : at + left], tid, anchor, anchor - far, anchor - near)
        at += left


class LoserTree:
    """Merges sorted runs. Every head knows the prefix that it shares with the last winner."""

    def __init__(self, runs: list[Iterator[tuple[int, Entry]]]):
        self.runs, k = runs, len(runs)
        self.head: list[Entry | None] = [None] * k
        self.known = [0] * k
        for i in range(k):
            self._next(i)
            self.known[i] = 0
        self.size = k
        self.tree = [-1] * max(1, k)  # tree[0]: the winner; others: losers
        for i in range(k):
            self._enter(i)

    def _next(self, i: int) -> None:
        found = next(self.runs[i], None)
        self.known[i], self.head[i] = found if found else (0, None)

    def _beats(self, a: int, b: int) -> bool:
        """Does run a's head come first? The loser's known prefix becomes that shared with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None
        if self.known[a] != self.known[b]:
            return self.known[a] > self.known[b]
        k = shared(x[0], y[0], self.known[a])
        first = k == len(x[0]) or k < len(y[0]) and x[0][k] < y[0][k]
        self.known[b if first else a] = k
        return first

    def _enter(self, i: int) -> None:
        """Build up: losers wait in empty places."""
        node = (i + self.size) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple[int, Entry]]:
        while self.size and self.head[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.known[i], self.head[i]
            self._next(i)
            node = (i + self.size) // 2
            while node:
                if self._beats(self.tree[node], i):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.tree[0] = i


def repeated(group: list[tuple[int, Entry]], length: int) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end) of the bytes covered by repeated strings of anchors whose right contexts begin alike, in suffix order."""
    kinds: dict[tuple[bytes, bytes], list[int]] = {}
    for i, (_, e) in enumerate(group):
        kinds.setdefault((e[0], e[1]), []).append(i)
    single = []
    for same in kinds.values():
        if len(same) > 1:  # equal contexts hold equal strings
            for i in same:
                _, _, tid, at, first, last = group[i][1]
                yield tid, first, last + length
        else:
            single.append(same[0])
    if not single or len(kinds) == 1:
        return
    # one of each kind, in suffix order, with the prefix shared with the one before
    firsts = sorted(same[0] for same in kinds.values())
    prefix, low, mark = [], length, 0
    for i, (k, _) in enumerate(group):
        low = min(low, k) if i else 0
        if mark < len(firsts) and firsts[mark] == i:
            prefix.append(low)
            low, mark = length, mark + 1
    entries = [group[i][1] for i in firsts]
    alone = {group[i][1][2:4] for i in single}
    if len(entries) == 2:
        left = shared(entries[0][1], entries[1][1])
        levels = [(prefix[1], np.array([left, left]))]
    else:
        levels = _best_left(prefix, [e[1] for e in entries])
    at, most, least = (np.array(x) for x in zip(*((e[3], e[3] - e[4], e[3] - e[5]) for e in entries), strict=True))
    begin, end = at.copy(), at.copy()
    for level, left in levels:
        far, near = np.minimum(left, most), np.maximum(length - level, least)
        good = near <= far  # such a run covers its anchor, so all runs of one anchor make one interval
        begin[good] = np.minimum(begin[good], (at - far)[good])
        end[good] = np.maximum(end[good], (at - near)[good] + length)
    for i in np.flatnonzero(end > begin).tolist():
        if entries[i][2:4] in alone:
            yield entries[i][2], int(begin[i]), int(end[i])


def _best_left(prefix: list[int], lefts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """For each level of common prefixes to the right: the level, and each entry's longest common left context with another that
    shares it (-1: no other does)."""
    order = sorted(range(len(lefts)), key=lefts.__getitem__)
    common = np.array([0] + [shared(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    table = [common]  # minima over spans of a power of two
    while 2 << (len(table) - 1) <= len(common):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    right = np.array(prefix)
    right[0] = -1
    for level in np.unique(right[1:])[::-1].tolist():
        cluster = np.cumsum(right < level)
        by = np.lexsort((rank, cluster))
        near = np.flatnonzero(cluster[by][1:] == cluster[by][:-1])
        if not len(near):
            continue
        a, b = rank[by[near]] + 1, rank[by[near + 1]] + 1  # the least of common[a:b]
        bits = np.floor(np.log2(b - a)).astype(np.int64)
        least = np.empty(len(near), np.int64)
        for k in np.unique(bits).tolist():
            m = bits == k
            least[m] = np.minimum(table[k][a[m]], table[k][b[m] - (1 << k)])
        best = np.full(len(prefix), -1)
        np.maximum.at(best, by[near], least)
        np.maximum.at(best, by[near + 1], least)
        yield level, best


def _spans(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int | None = None, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Remove every byte of each whole text that a string of ``length`` bytes covers which also starts anywhere else.

    Texts are UTF-8 bytes (null: empty); strings never cross documents and are judged on the input. Every column of ``docs`` but the text
    is kept, whatever its name, and n_bytes, n_removed, n_spans and kept_sha256 are added (replacing those of the same name); ``with_text`` keeps
    the text too, as what is left of it (a character that a cut goes through is dropped). Texts shorter than ``length`` come back
    as they are; a text that occurs twice loses everything. Repeated rows count as copies; ids may be null or repeat.
    """
    window = window or max(1, length // 2)
    reach = length - window + 1
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    # equal texts are one from here on
    key = F.unhex(F.substring(F.sha2(F.encode(text_col, "UTF-8"), 256), 1, 32))
    long_enough = docs.where(F.octet_length(text_col) >= length).select(key.alias("text_key"), F.col(text_col).alias("text"))
    texts = staged(long_enough.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies")).withColumn("tid", F.monotonically_increasing_id()), "texts")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                tids, texts_ = (b.column(i).slice(at, 256).to_pylist() for i in (0, 1))
                parts = [(np.full(len(p), tid), p, f, e, h) for tid, t in zip(tids, texts_, strict=True) for p, f, e, h in [anchors(t.encode("utf-8", "replace"), length, window, gram)]]
                tid, p, f, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(tid), pa.array(p.astype(np.int32)), pa.array((p - f).astype(np.int32)), pa.array((p - e).astype(np.int32))], ["h", "tid", "at", "far", "near"])

    filed = staged(texts.select("tid", "text").mapInArrow(file, "h long, tid long, at int, far int, near int"), "anchors")
    twice = staged(filed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-anchors")
    wanted = staged(filed.join(twice, "h").groupBy("tid").agg(F.collect_list(F.struct("at", "far", "near", "h")).alias("anchors")), "wanted")
    # what no later step reads goes at once: anchors are many times as many as the repeated ones
    discard(filed)
    discard(twice)
    total = wanted.agg(F.sum(F.size("anchors"))).first()[0] or 0
    parts = max(1, total * (length + window) // PART_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Entry]] = {}
        size = 0

        def runs() -> Iterator[pa.RecordBatch]:
            for part, entries in held.items():
                entries.sort()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([front_code(entries)], pa.binary())], ["part", "run"])

        for b in batches:
            for tid, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode("utf-8", "replace")
                for x in found:
                    at, far, near = x["at"], x["far"], x["near"]
                    entry = (raw[at : at - near + length], raw[at - far : at][::-1], tid, at, at - far, at - near)
                    held.setdefault(x["h"] % parts, []).append(entry)
                    size += length + far + 200
                if size > RUN_BYTES:
                    yield from runs()
                    held, size = {}, 0
        yield from runs()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, int, int]] = []
            group: list[tuple[int, Entry]] = []
            for k, e in LoserTree([read_run(r) for r in runs]):
                if k < reach and group:
                    if len(group) > 1:
                        out += repeated(group, length)
                    group = []
                    if len(out) > 50_000:
                        yield batch(out)
                        out = []
                group.append((k, e))
            if len(group) > 1:
                out += repeated(group, length)
            yield batch(out)

        def batch(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["tid", "begin", "end"])

        part, runs = None, []
        for b in batches:
            for p, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part and runs:
                    yield from found(runs)
                    runs = []
                part = p
                runs.append(run)
        if runs:
            yield from found(runs)

    sent = texts.select("tid", "text").join(wanted, "tid").mapInArrow(send, "part long, run binary")
    merged = sent.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "tid long, begin long, end long")
    whole = texts.where("copies > 1").select("tid", F.lit(0).cast("long").alias("begin"), F.octet_length("text").cast("long").alias("end"))
    cover = staged(merged.unionByName(whole).groupBy("tid").agg(F.collect_set(F.struct("begin", "end")).alias("cover")), "cover")
    discard(wanted)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text_key, text, cover_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode("utf-8", "replace")
                spans = _spans([(x["begin"], x["end"]) for x in cover_])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                left = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                rows.append((text_key, len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["text_key", "removed", "spans", "sha", "left_text"])

    told = staged(texts.select("tid", "text_key", "text").join(cover, "tid").select("text_key", "text", "cover").mapInArrow(cut, "text_key binary, removed long, spans long, sha string, left_text string"), "cut")
    discard(texts)
    discard(cover)
    # the rows' own columns travel in one struct, so that no name of theirs can clash
    keep = [c for c in docs.columns if c not in added and (with_text or c != text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)
    rows = docs.select(own.alias("row"), key.alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("whole_sha"))
    shown = [F.coalesce("left_text", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in keep]
    out = rows.join(told, "text_key", "left")
    none = F.lit(0).cast("long")
    return out.select(*shown, "n_bytes", F.coalesce("removed", none).alias("n_removed"), F.coalesce("spans", none).alias("n_spans"), F.coalesce("sha", "whole_sha").alias("kept_sha256"))
