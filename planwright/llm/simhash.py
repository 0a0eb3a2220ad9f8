"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

The binary Golay code has 4096 codewords of 23 bits, and every 23-bit string is within 3 bits of exactly one. A
fingerprint's 64 bits are cut into three segments. If two fingerprints differ in at most 3 bits, then leaving out the
segment with most errors leaves two with at most one error each. If u and v differ in at most one bit of a segment, the
codeword nearest to u is within 4 bits of v; so u's nearest codeword index is among the few (5.3 on average) that v's
segment decodes to within 4 bits. For each pair of segments a fingerprint is entered under its own two codeword indices,
and looked up under nearby ones; whatever meets under a key is verified by counting differing bits. Of the first two
segments all pairs of nearby indices are looked up. Where one of these has two errors or more, the other and the third have one
at most between them, so for the other two pairs one index of each looked-up key is the fingerprint's own.

Equal fingerprints are one class from the start, so copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.operators.graph import connected_components
from planwright.staging import staged

BITS_APART, WIDTHS = 3, (22, 21, 21)
_GENERATOR = 0b101011100011  # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_BYTE_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values of the text's shingles; 0 for a text without words."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space count
    n = len(found)
    if not n:
        return 0
    whole, h = b" ".join(found), xxhash.xxh64_intdigest
    if n <= words:
        values = [h(whole, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = [0, *(ends[: n - words] + 1).tolist()]
        values = [h(whole[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    raw = np.array(values, "<u8").view(np.uint8).reshape(-1, 8)
    set_bits = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return sum(1 << i for i in np.flatnonzero(2 * set_bits > len(values)).tolist())


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """syndromes of 23 single bits; for each syndrome the error patterns of weight up to 4 (offsets, patterns), lightest first."""
    single = []
    for bit in range(23):
        v = 1 << bit
        for top in range(22, 10, -1):
            if v >> top & 1:
                v ^= _GENERATOR << (top - 11)
        single.append(v)
    patterns = [(0, 0)]
    level = [(0, 0, -1)]
    for _ in range(4):
        level = [(e | 1 << b, s ^ single[b], b) for e, s, last in level for b in range(last + 1, 23)]
        patterns += [(e, s) for e, s, _ in level]
    e, s = np.array(patterns, np.int64).T
    by = np.lexsort((np.bitwise_count(e), s))
    return np.array(single, np.int64), np.searchsorted(s[by], np.arange(2049)), e[by]


def decode(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, indices of codewords within 4 bits of each segment, and whether it is the nearest one."""
    single, offsets, patterns = golay()
    syndrome = np.zeros(len(segment), np.int64)
    for bit in range(23):
        syndrome ^= np.where(segment >> bit & 1, single[bit], 0)
    begin, size = offsets[syndrome], offsets[syndrome + 1] - offsets[syndrome]
    row = np.repeat(np.arange(len(segment)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return row, (segment[row] ^ patterns[begin[row] + at]) >> 11, at == 0


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number, key, is it the fingerprint's own) for the three pairs of segments."""
    segments, at = [], 0
    for w in WIDTHS:
        segments.append((prints >> np.uint64(at) & np.uint64((1 << w) - 1)).astype(np.int64))
        at += w
    near = [decode(s) for s in segments]
    out = []
    for kind, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (row_a, index_a, own_a), (row_b, index_b, own_b) = near[a], near[b]
        first = np.searchsorted(row_b, np.arange(len(prints) + 1))
        size = (first[1:] - first[:-1])[row_a]
        left = np.repeat(np.arange(len(row_a)), size)
        right = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + first[row_a[left]]
        if kind:
            some = own_a[left] | own_b[right]
            left, right = left[some], right[some]
        out.append((row_a[left], kind << 24 | index_a[left] << 12 | index_b[right], own_a[left] & own_b[right]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links(key: np.ndarray, prints: np.ndarray, own: np.ndarray, most: int = 48) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at most BITS_APART bits apart that meet under a key (rows sorted by key); of a large group only enough
    of them to connect whatever all of them would."""
    out, starts = [], np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    small = np.repeat(size <= most, size)
    k, p, o = key[small], prints[small], own[small]
    for d in range(1, int(size[size <= most].max(initial=1))):
        near = np.flatnonzero((k[d:] == k[:-d]) & (o[d:] | o[:-d]))
        near = near[np.bitwise_count(p[near] ^ p[near + d]) <= BITS_APART]
        out.append((p[near], p[near + d]))
    for at, n in zip(starts[size > most].tolist(), size[size > most].tolist(), strict=True):
        p, o = prints[at : at + n], own[at : at + n]
        label = np.arange(n)
        for i in np.flatnonzero(o).tolist():
            near = np.flatnonzero(np.bitwise_count(p ^ p[i]) <= BITS_APART)
            near = near[label[near] != label[i]]
            if len(near):
                old, first = np.unique(label[near], return_index=True)
                out.append((np.repeat(p[i], len(old)), p[near[first]]))
                label[np.isin(label, old)] = label[i]
    return out


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """(src, dst): enough links between different fingerprints (column fp, long) to connect all that are linked."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                p = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                row, key, own = keys(p.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array((key << 1 | own).astype(np.int32)), pa.array(p[row])], ["entry", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            entry, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            pairs = links(entry >> 1, fp.view(np.uint64), (entry & 1).astype(bool))
            a, b = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["src", "dst"])

        for b in batches:
            part = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
            last = int(np.searchsorted(part[0] >> 1, part[0][-1] >> 1)) if len(part[0]) else 0
            if not last:  # all of one key, which may go on
                held.append(part)
                continue
            yield found([*held, tuple(x[:last] for x in part)])
            held = [tuple(x[last:] for x in part)]
        if held:
            yield found(held)

    entered = prints.select("fp").distinct().mapInArrow(enter, "entry int, fp long")
    # a key is 26 bits and shares an int with the mark of the own entry; a task gets its keys one after another
    return entered.repartition(F.shiftright("entry", 1)).sortWithinPartitions("entry").mapInArrow(meet, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of each row under links between fingerprints that differ in at most 3 bits.

    Returns ``id_col``, fingerprint (16 lowercase hex digits), component_id (the smallest id that links lead to, the row's
    own included) and copies (rows of the same fingerprint), one row for each row. Texts without words and null texts have
    fingerprint zero and are linked like any other. Null ids are passed over as component ids; a component of null ids
    only has a null id. Rows may repeat; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                fp = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    prints = staged(docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long"), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")), "classes")
    roots = connected_components(link_fingerprints(classes))
    rooted = staged(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("root")), "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(least, "root").select("fp", "copies", "component_id"), "components")
    return prints.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")
