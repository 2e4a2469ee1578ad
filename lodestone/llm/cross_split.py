"""Records of evaluation splits that also stand in training (problem 4).

Records are normalised to their words and cut into chunks where a rolling hash of the last WINDOW words says so, so that an edit changes
the chunks around it and no others. Chunk digests are joined across splits, and the lengths of shared chunks are summed: over
all of training to the overlap fraction of a record, over one training record to that of a pair. Records that count only if
wholly equal (id, sexpr) are one chunk each.

A question may differ from its like in a quarter of its words, in any order, so that no chunk is sure to survive. The pairs that share
a chunk are therefore joined by a second stage, the exact one: pairs that share two of their rarest words, which none that is
near-same can lack (`prefix_cells`). Chunks that too many records have find no pairs by themselves, but count in all lengths. All pairs are then verified on their whole sets of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.words import key128, word_string
from lodestone.llm.near_dups import candidates, classes, named
from lodestone.llm.sets import _Hashes, elements, popcounts, prefix_cells, words_of
from lodestone.session import cut

# Markers of failure instead of an S-expression, in any case.
FAILURES = ("null", "@bad_expression")
WINDOW = 2
BASE = 31
CUT = 2
MOST_MET = 10_000
LEAST_WORDS = 5


class _Values(dict):
    """The number by which a word enters the rolling hash: the first 32 bits of its MD5 digest."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
        return value


def chunks_of(words: list[str], values: dict) -> list[list[str]]:
    """words cut after each place where the rolling hash of the WINDOW words up to it is a multiple of CUT."""
    out, held, rolled = [], [], 0
    gone = BASE**WINDOW
    for i, w in enumerate(words):
        rolled = rolled * BASE + values[w] - (gone * values[words[i - WINDOW]] if i >= WINDOW else 0)
        held.append(w)
        if rolled % CUT == 0:
            out.append(held)
            held = []
    return out + [held] if held else out


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, values = _Hashes(), _Values()
    for batch in batches:
        rows = []
        for i, (row_id, side, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "side", "_t")))):
            words = words_of(text)
            if words:
                els, parts = elements(words, 1, hashes), chunks_of(words, values)
                digests = [np.uint64(xxhash.xxh3_64_intdigest(" ".join(p))).astype(np.int64) for p in parts]
                digest = hashlib.blake2b(els.tobytes(), digest_size=16).digest()
                rows.append((row_id, side, len(els), digest, popcounts(els), els.astype(np.int64), len(words), digests, [len(p) for p in parts]))
        cols = list(zip(*rows)) or [()] * 9
        kinds = pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "side", "n", "digest", "pops", "els", "words", "chunks", "lengths"])


def cut_records(qa: DataFrame) -> DataFrame:
    """The questions of train (side true), dev and test rows as sets and as chunks; null and wordless ones give no row."""
    split = F.lower(F.trim("split"))
    rows = qa.where(split.isin("train", "dev", "test") & F.col("question").isNotNull() & F.col("sample_no").isNotNull())
    slim = rows.select(F.col("sample_no").cast("long").alias("id"), (split == "train").alias("side"), F.col("question").alias("_t"))
    return slim.mapInArrow(_cut_records, "id long, side boolean, n int, digest binary, pops long, els array<long>, words int, chunks array<long>, lengths array<int>")


def _chunk_rows(records: DataFrame, *keep: str) -> DataFrame:
    return records.select("id", "side", *keep, F.explode(F.arrays_zip("chunks", "lengths")).alias("c")).select("id", "side", *keep, F.col("c.chunks").alias("cell"), F.col("c.lengths").alias("len"))


def overlap_fractions(qa: DataFrame) -> DataFrame:
    """(sample_no, overlap) of every dev and test row whose question has words: the share of its words in chunks that also stand
    in a question of train."""
    return _fractions(cut(cut_records(qa), "records"))


def _fractions(records: DataFrame) -> DataFrame:
    chunks = _chunk_rows(records, "words")
    known = chunks.where("side").select("cell").distinct()
    shared = chunks.where("NOT side").join(known, "cell", "left_semi").groupBy("id").agg(F.sum("len").alias("shared"))
    held = records.where("NOT side").select("id", "words").distinct()
    return held.join(shared, "id", "left").select(F.col("id").alias("sample_no"), (F.coalesce("shared", F.lit(0)) / F.col("words")).alias("overlap"))


def _chunk_pairs(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of train and other sets that share a chunk; a chunk that more than MOST_MET pairs share finds none."""
    cells = _chunk_rows(reps, "n", "pops").drop("len").distinct()
    met = cells.groupBy("cell").agg(F.sum(F.col("side").cast("long")).alias("t"), F.count("*").alias("all"))
    useful = met.where((F.col("t") > 0) & (F.col("t") < F.col("all")) & (F.col("t") * (F.col("all") - F.col("t")) <= MOST_MET)).select("cell")
    cells = cut(cells.join(useful.hint("merge"), "cell"), "chunks")
    return candidates(named(cells.where("side"), "a"), named(cells.where("NOT side"), "b"), F.lit(True), num, den)


def _prefix_pairs(reps: DataFrame, num: int, den: int) -> DataFrame:
    cells = cut(prefix_cells(reps, num, den), "cells")
    return candidates(named(cells.where("side"), "a"), named(cells.where("NOT side"), "b"), F.lit(True), num, den)


STAGES = {"chunks": _chunk_pairs, "prefix": _prefix_pairs}


def question_overlaps(records: DataFrame, num: int = 3, den: int = 4, stages: tuple[str, ...] = ("chunks", "prefix")) -> DataFrame:
    """(train_no, eval_no, shared, n_train, n_eval, overlap): words shared by near-same questions, their numbers of different words,
    and the share of the evaluated question's words in chunks that the other has too.

    Equal sets of one side are compared once, by their smallest sample_no, and the result is then spread over all of them. The
    overlap is that of these.
    """
    sets = records.where(F.col("n") >= LEAST_WORDS)
    reps = cut(classes(sets, "side"), "record-classes")
    found = reduce(DataFrame.unionByName, [STAGES[s](reps, num, den) for s in stages]).distinct()
    a = reps.where("side").select(F.col("id").alias("a"), F.col("els").alias("ea"), F.col("chunks").alias("ca"), F.col("digest").alias("da"))
    b = reps.where("NOT side").select(F.col("id").alias("b"), F.col("els").alias("eb"), F.arrays_zip("chunks", "lengths").alias("cb"), F.col("words"), F.col("digest").alias("db"))
    both = found.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    inside = F.aggregate(F.filter("cb", lambda c: F.array_contains("ca", c.chunks)), F.lit(0), lambda s, c: s + c.lengths) / F.col("words")
    near = both.select("da", "db", F.size(F.array_intersect("ea", "eb")).alias("shared"), F.size("ea").alias("n_train"), F.size("eb").alias("n_eval"), inside.alias("overlap"))
    near = near.where((F.col("n_train") + F.col("n_eval") - F.col("shared")) * num <= F.col("shared") * den)
    members = sets.select("id", "side", "digest").distinct()
    spread = near.join(members.where("side").select(F.col("digest").alias("da"), F.col("id").alias("train_no")), "da")
    spread = spread.join(members.where("NOT side").select(F.col("digest").alias("db"), F.col("id").alias("eval_no")), "db")
    return spread.select("train_no", "eval_no", "shared", "n_train", "n_eval", "overlap")


def _equal(qa: DataFrame) -> DataFrame:
    """(train_no, eval_no, by) of rows whose id or sexpr is one equal chunk; null, wordless and failed fields have none."""
    split = F.lower(F.trim("split"))
    failed = F.lower(F.trim("sexpr")).isin(*FAILURES)
    fields = F.array(*[F.struct(F.lit(by).alias("by"), word_string(f).alias("w")) for by, f in (("id", F.col("id")), ("sexpr", F.when(~failed, F.col("sexpr"))))])
    rows = qa.where(split.isin("train", "dev", "test")).select("sample_no", (split == "train").alias("side"), F.explode(fields).alias("f"))
    rows = rows.where("f.w <> ''").select("sample_no", "side", "f.by", key128("f.w").alias("chunk"))
    train, held = rows.where("side").select("by", "chunk", F.col("sample_no").alias("train_no")), rows.where("NOT side").select("by", "chunk", F.col("sample_no").alias("eval_no"))
    return train.join(held, ["by", "chunk"]).select("train_no", "eval_no", "by")


def overlaps(qa: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(train_no, eval_no, by): each pair of a train row and a dev or test row, once for each reason question, id or sexpr.

    Null, wordless and failed fields give no pair, nor do rows of other splits; split names are compared without case.
    """
    records = cut(cut_records(qa), "records") if records is None else records
    return question_overlaps(records).select("train_no", "eval_no", F.lit("question").alias("by")).unionByName(_equal(qa))


def overlap_pairs(qa: DataFrame) -> DataFrame:
    """(a_no, b_no), the smaller first, of each overlapping pair."""
    return overlaps(qa).select(F.least("train_no", "eval_no").alias("a_no"), F.greatest("train_no", "eval_no").alias("b_no")).distinct()


def overlap_report(qa: DataFrame) -> DataFrame:
    """(split, dataset, by, samples, pairs, mean_overlap): dev and test samples that also stand in train, per split, dataset and
    reason, with the mean overlap fraction of their questions (null where none has words)."""
    records = cut(cut_records(qa), "records")
    about = qa.select(F.col("sample_no").alias("eval_no"), F.lower(F.trim("split")).alias("split"), F.lower(F.trim("dataset")).alias("dataset")).distinct()
    per = overlaps(qa, records).groupBy("eval_no", "by").agg(F.count("*").alias("pairs")).join(about, "eval_no")
    per = per.join(_fractions(records).withColumnRenamed("sample_no", "eval_no"), "eval_no", "left")
    return per.groupBy("split", "dataset", "by").agg(F.count("*").alias("samples"), F.sum("pairs").alias("pairs"), F.round(F.avg("overlap"), 6).alias("mean_overlap"))
