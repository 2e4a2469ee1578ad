"""Token ids of every text by a public byte-level BPE (problem 6), and token counts (problem 7).

Texts of up to `split_chars` are encoded where they lie, without a shuffle. Longer ones become a tree: they are cut where
the tokenizer's pattern splits in any case (before a single blank between two non-blanks), and a stretch the pattern does
not split is cut in pieces at any character. All parts are encoded in parallel, as rows of their own. Parts of one unsplit
stretch are then concatenated pairwise: a window around the join is encoded again and doubled until its first and last
token agree with those already there. A token sequence is the BPE encoding of its bytes when every adjacent pair is the
encoding of its own bytes, so agreement on both sides makes the result equal to encoding the stretch at once.
"""

from __future__ import annotations

import base64
import sys
import types as pytypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT_CHARS = 8_192
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Kinds of part: text the pattern splits as usual, the begin of an unsplit stretch, its continuation.
TEXT, HEAD, TAIL = 0, 1, 2


def encoding(path: str):
    """The tokenizer at path, loaded once in each Python process."""
    import tiktoken

    kept = sys.modules.setdefault("_lodestone_tokenizers", pytypes.ModuleType("_lodestone_tokenizers"))
    if path not in kept.__dict__:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept.__dict__[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept.__dict__[path]


def _safe_cut(text: str, at: int) -> bool:
    return text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def parts_of(text: str, most: int) -> Iterator[tuple[int, str]]:
    """(kind, part) in order; a part has at most `most` characters."""
    pos, n = 0, len(text)
    while n - pos > most:
        at = text.rfind(" ", pos + 1, pos + most)
        while at > 0 and not _safe_cut(text, at):
            at = text.rfind(" ", pos + 1, at)
        if at > 0:
            yield TEXT, text[pos:at]
            pos = at
            continue
        at = text.find(" ", pos + most)
        while 0 <= at < n - 1 and not _safe_cut(text, at):
            at = text.find(" ", at + 1)
        end = at if 0 <= at < n - 1 else n
        yield from _pieces(text, pos, end, most)
        pos = end
    if n > pos:
        yield TEXT, text[pos:]


def _pieces(text: str, pos: int, end: int, most: int) -> Iterator[tuple[int, str]]:
    """Parts of a stretch without a safe cut. A group of pieces must not end in white space, since the pattern looks at the
    character after it; white space at the end of a group is therefore given piece by piece."""
    import regex

    start = solid = pos  # the group so far is text[start:last], without white space at its end text[start:solid]
    spaces: list[tuple[int, int]] = []

    def close() -> Iterator[tuple[int, str]]:
        if solid > start:
            yield TEXT, text[start:solid]
        for a, b in spaces:
            yield HEAD, text[a:b]

    for m in regex.finditer(PATTERN, text, pos=pos, endpos=len(text)):
        a, b = m.span()
        if a >= end:
            break
        if b - start > most:
            yield from close()
            start = solid = a
            spaces = []
        if b - a > most:
            for k in range(a, b, most):
                yield HEAD if k == a else TAIL, text[k : min(k + most, b)]
            start = solid = b
        elif m.group().isspace():
            spaces.append((a, b))
        else:
            solid = b
            spaces = []
    yield from close()


def join_ids(left: np.ndarray, right: np.ndarray, enc) -> np.ndarray:
    """The encoding of the bytes of two adjacent parts of one unsplit stretch."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    k = 4
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        window = enc.decode_bytes([*left[-a:].tolist(), *right[:b].tolist()])
        ids = np.asarray(enc._encode_single_piece(window), dtype=np.int32)
        if (a == len(left) or ids[0] == left[-a]) and (b == len(right) or ids[-1] == right[b - 1]):
            return np.concatenate([left[:-a], ids, right[b:]])
        k *= 2


def concat_tree(parts: list[tuple[int, np.ndarray]], enc) -> np.ndarray:
    """Ids of a whole text from the (kind, ids) of its parts in order."""
    done: list[np.ndarray] = []
    run: list[np.ndarray] = []

    def close() -> None:
        while len(run) > 1:
            run[:] = [join_ids(run[i], run[i + 1], enc) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
        done.extend(run)
        run.clear()

    for kind, ids in parts:
        if kind != TAIL:
            close()
        if kind == TEXT:
            done.append(ids)
        else:
            run.append(ids)
    close()
    return np.concatenate(done) if done else np.empty(0, np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _short(path: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            ids = [enc.encode_to_numpy(t) if t else np.empty(0, np.int32) for t in batch.column("_t").to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int32()) if count_only else _lists(ids)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), out], names=["_id", "ids"])

    return run


def _cut(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row_id, text in zip(batch.column("_key"), batch.column("_id"), batch.column("_t").to_pylist()):
                parts = list(parts_of(text, most))
                for i in range(0, len(parts), 256):
                    some = parts[i : i + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key.as_py()] * len(some), pa.int64()),
                            pa.array([row_id.as_py()] * len(some), batch.schema.field("_id").type),
                            pa.array(range(i, i + len(some)), pa.int32()),
                            pa.array([k for k, _ in some], pa.int32()),
                            pa.array([p for _, p in some], pa.string()),
                        ],
                        names=["_key", "_id", "_seq", "_kind", "_t"],
                    )

    return run


def _encode_parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            ids = [
                enc.encode_to_numpy(t) if kind == TEXT else np.asarray(enc._encode_single_piece(t.encode()), dtype=np.int32)
                for kind, t in zip(batch.column("_kind").to_pylist(), batch.column("_t").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_key", "_id", "_seq", "_kind")), _lists(ids)], names=["_key", "_id", "_seq", "_kind", "ids"])

    return run


def _concat(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            ids = [
                concat_tree([(p["_kind"], np.asarray(p["ids"], dtype=np.int32)) for p in parts], enc)
                for parts in batch.column("_parts").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), _lists(ids)], names=["_id", "ids"])

    return run


def encode_texts(docs: DataFrame, row_id: str, text: str, path: str = TOKENIZER, split_chars: int = SPLIT_CHARS, count_only: bool = False) -> DataFrame:
    """(row_id, ids) for each row of docs, or (row_id, n_tokens) with count_only. No special tokens.

    Empty and null texts have an empty list (0 tokens); blanks are tokens like others. Repeated rows, rows with the same id
    and null ids each give a row. Other columns, whatever their names, are not read.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    slim = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_t"))
    size: Column = F.coalesce(F.length("_t"), F.lit(0))
    short = slim.where(size <= split_chars).mapInArrow(_short(path, count_only), f"_id {kind}, ids {'int' if count_only else 'array<int>'}")
    # ids of rows follow from file splits, so a task that runs again makes the same ones
    long = slim.where(size > split_chars).select(F.monotonically_increasing_id().alias("_key"), "_id", "_t")
    parts = long.mapInArrow(_cut(split_chars), f"_key long, _id {kind}, _seq int, _kind int, _t string").repartition("_key", "_seq")
    coded = parts.mapInArrow(_encode_parts(path), f"_key long, _id {kind}, _seq int, _kind int, ids array<int>")
    whole = coded.groupBy("_key").agg(F.first("_id").alias("_id"), F.sort_array(F.collect_list(F.struct("_seq", "_kind", "ids"))).alias("_parts"))
    joined = whole.select("_id", "_parts").mapInArrow(_concat(path), f"_id {kind}, ids array<int>")
    if count_only:
        joined = joined.select("_id", F.size("ids").alias("ids"))
    return short.unionByName(joined).select(F.col("_id").alias(row_id), F.col("ids").alias("n_tokens" if count_only else "ids"))
