"""Texts as sets of hashed words or word runs, with their segment popcounts and grid coordinates.

Rarity of elements is read from a sketch: SKETCH counters, each the number of sets that hold an element of its bucket. The sketch
covers all sets, its size doesn't grow with them, and any order taken from it is one order for all sets, which is what a
prefix join needs; collisions cost time, never a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 256
SEGMENTS = 16
SKETCH_BITS = 18
SKETCH = 1 << SKETCH_BITS
PAIRED = 32
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class _Letters(dict):
    """For str.translate: letters and digits stay, every other character becomes a blank."""

    def __missing__(self, code: int) -> int:
        value = self[code] = code if chr(code).isalnum() else 32
        return value


_LETTERS = _Letters()


def words_of(text: str) -> list[str]:
    """The words of text, its longest runs of letters and digits, in lower case."""
    return text.lower().translate(_LETTERS).split()


class _Hashes(dict):
    """64-bit digests of words, kept while they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def elements(words: list[str], run: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `run` consecutive words."""
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    x = h[: len(h) - run + 1]
    for k in range(1, run):
        x = _mixed(x) + h[k : len(h) - run + 1 + k]
    return np.unique(_mixed(x))


def popcounts(els: np.ndarray) -> int:
    """Bit counts of SEGMENTS segments of the fingerprint that has one bit for each element, 4 bits each, packed in 64 bits.

    A count beyond 15 stays 15, which can only lessen the Manhattan distance of two fingerprints.
    """
    counts = np.minimum(np.bincount((els & np.uint64(SEGMENTS - 1)).astype(np.int64), minlength=SEGMENTS), 15).astype(np.uint64)
    return int(np.bitwise_or.reduce(counts << (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(4))).astype(np.int64))


def slot_segments(els: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> bytes:
    """For each of SLOTS slots the one segment, of 256, in which the fingerprint has a bit.

    A slot's bit is the least of the set's elements in an order of its own (min-hash), so a slot is equal in two sets with the
    probability of their Jaccard similarity.
    """
    low = np.full(SLOTS, 0xFFFFFFFF, dtype=np.uint32)
    x = (els >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, ((x[i : i + 2048, None] ^ seeds[1]) * seeds[0]).min(axis=0))
    return ((low * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = _mixed(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64)).astype(np.uint32)
    return x[:SLOTS] | np.uint32(1), x[SLOTS:]


def _describe(run: int, least_words: int, least_elements: int, slots: bool, keep_elements: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seeds = _Hashes(), _seeds()
        for batch in batches:
            kept, n, digest, pops, segs, lists = [], [], [], [], [], []
            for i, text in enumerate(batch.column("_t").to_pylist()):
                words = words_of(text)
                if len(words) < max(least_words, run):
                    continue
                els = elements(words, run, hashes)
                if len(els) < least_elements:
                    continue
                kept.append(i)
                n.append(len(els))
                digest.append(hashlib.blake2b(els.tobytes(), digest_size=16).digest())
                pops.append(popcounts(els))
                segs.append(slot_segments(els, seeds) if slots else None)
                lists.append(els.astype(np.int64))
            ends = np.zeros(len(kept) + 1, dtype=np.int32)
            if keep_elements:
                np.cumsum(n, out=ends[1:])
            flat = np.concatenate(lists) if keep_elements and lists else np.empty(0, np.int64)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(at), batch.column("_side").take(at), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(pops, pa.int64()), pa.array(segs, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["id", "side", "n", "digest", "pops", "slots", "els"],
            )

    return go


def described(df: DataFrame, row_id: str, text: str, run: int, least_words: int = 0, least_elements: int = 1, slots: bool = False, keep_elements: bool = False, side: Column | None = None) -> DataFrame:
    """(id, side, n, digest, pops, slots, els) of each text that is long enough: a flag of the caller, size, digest, segment
    popcounts, grid coordinates and elements of its set. Null texts and null ids give no row."""
    slim = df.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).cast("long").alias("_id"), F.col(text).alias("_t"), (F.lit(True) if side is None else side).alias("_side"))
    return slim.mapInArrow(_describe(run, least_words, least_elements, slots, keep_elements), "id long, side boolean, n int, digest binary, pops long, slots binary, els array<long>")


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(flat values as unsigned, where each row's begin and the last ones end) of a list column without nulls."""
    col = batch.column(name)
    ends = np.asarray(col.offsets)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), ends - ends[0]


def bucket(els: np.ndarray) -> np.ndarray:
    return (els >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def element_sketch(sets: DataFrame) -> np.ndarray:
    """For each bucket of elements how many elements of `sets` (column els) fall in it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            held += np.bincount(bucket(_lists(batch, "els")[0]), minlength=SKETCH)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["b", "c"])

    rows = sets.select("els").mapInArrow(go, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(SKETCH, dtype=np.int64)
    counts[rows["b"].to_numpy()] = rows["c"].to_numpy()
    return counts


def prefix_cells(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(cell, id, side, n, pops): the grid cells of each set, such that two sets with Jaccard similarity of num/den or more share one.

    Two such sets have ceil(num/den * n) elements or more in common, n being the size of either. In one order of all elements,
    the first k of the common ones stand among the first n - ceil(num/den * n) + k of each. Sets of up to PAIRED elements
    are entered under each pair of these (k = 2), which few unrelated sets share; longer ones, whose pairs would be too many,
    under each single one (k = 1), and sets that may have partners of both kinds are entered under both.
    """
    counts = sets.sparkSession.sparkContext.broadcast(element_sketch(sets))
    both = PAIRED * num // den

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = counts.value
        for batch in batches:
            flat, ends = _lists(batch, "els")
            cells, rows = [], []
            for i in range(batch.num_rows):
                els = flat[ends[i] : ends[i + 1]]
                n = len(els)
                head = els[np.lexsort((els, share[bucket(els)]))][: n + (-n * num) // den + 2]
                mine = []
                if n <= PAIRED:
                    j, k = np.triu_indices(len(head), 1)
                    mine.append(_mixed(head[j]) + head[k])
                if n >= both:
                    mine.append(_mixed(_mixed(head[: n + (-n * num) // den + 1])))
                cells += mine
                rows.append(sum(map(len, mine)))
            at = pa.array(np.repeat(np.arange(batch.num_rows), rows) if rows else np.empty(0, np.int64))
            flat = np.concatenate(cells).view(np.int64) if cells else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), *(batch.column(c).take(at) for c in ("id", "side", "n", "pops"))], names=["cell", "id", "side", "n", "pops"])

    return sets.select("id", "side", "n", "pops", "els").mapInArrow(go, "cell long, id long, side boolean, n int, pops long")
