"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the longest length as fit, then
one for each bit that is set in what is left, longest first. Pieces of equal length form a bucket; each piece is a
sequence of its bucket's length, so no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST, END_ID = 2048, 1


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, none above ``longest``, in falling order, that sum to n."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def byte_names() -> dict[int, str]:
    """The characters by which a byte-level vocabulary file writes bytes: printable ones stand for themselves, others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}


def ranks_of(tokenizer_path: str) -> dict[bytes, int] | None:
    """The ids of a byte-level vocabulary file by byte string, if they also tell the order of its merges; else None."""
    with open(tokenizer_path, encoding="utf-8") as f:
        told = json.load(f)
    model, bytes_of = told["model"], {c: b for b, c in byte_names().items()}
    added = {t["content"] for t in told.get("added_tokens", ())}
    plain = {t: i for t, i in model["vocab"].items() if t not in added}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
    order = [plain.get(m, -1) for m in merges]
    whole = not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback"))
    single = set(bytes_of) <= set(plain) and len(plain) == 256 + len(merges)
    steps = (told.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not told["pre_tokenizer"].get("add_prefix_space") and not told.get("normalizer")
    if not (whole and single and steps and order == sorted(set(order)) and all(set(t) <= set(bytes_of) for t in plain)):
        return None
    return {bytes(bytes_of[c] for c in t): i for t, i in plain.items()}


class IdStream:
    """The tokenizer's ids of whole texts; where its vocabulary allows, by a coder that merges by rank and gives the same ids."""

    def __init__(self, tokenizer_path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = ranks_of(tokenizer_path)
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        if self.encode is None or any(s in text for s in self.specials):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.encode(text)).tobytes()


_streams: dict[tuple[str, str], IdStream] = {}


def id_stream(tokenizer_path: str, pattern: str) -> IdStream:
    key = tokenizer_path, pattern
    if key not in _streams:
        _streams[key] = IdStream(*key)
    return _streams[key]


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack the tokens of each whole text (null: empty), followed by ``end_id``, into sequences of a power of two each.

    ``pattern`` is that by which the tokenizer splits text before its merges. Returns one row for each piece: ``id_col``,
    start (tokens of its document before it), length, ids_crc32, doc_tokens, sequence_id (unique), offset (0), and the
    ids if ``with_ids``. Every document has at least the end token, so empty ones give one piece of length 1. Ids and rows
    may repeat or be null (each row is a document); further columns are ignored. One pass, no shuffle; sequence ids
    count up within each task's part of the ids, and come out alike when a task is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, end = id_stream(tokenizer_path, pattern), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = stream.ids(text or "") + end
                    start, n = 0, len(ids) // 4
                    for length in binary_lengths(n, longest):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((k, start, length, zlib.crc32(own), n, own))
                        start += length
                k, *numbers, own = zip(*rows, strict=True)
                columns = [part.column(0).take(pa.array(k)), *(pa.array(x, pa.int64()) for x in numbers)]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(id_col, text_col).mapInArrow(run, schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
