"""Vector similarity: exact top-k in blocks of queries, cosine, and lexical fallbacks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4_096


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _block_scores(queries, k: int | None, least: float, cosine: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("v"))
            row_ids = batch.column("id").to_numpy(zero_copy_only=False)
            s = (_unit(q) @ _unit(m).T) if cosine else q @ m.T
            if k is not None and k < s.shape[1]:
                bar = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]  # a batch's k best, with all ties of the last
                at = np.nonzero((s >= bar) & (s >= least))
            else:
                at = np.nonzero(s >= least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[0]]), pa.array(row_ids[at[1]]), pa.array(s[at])], names=["query_id", "id", "score"])

    return go


def scores(rows: DataFrame, queries: DataFrame, k: int | None = None, least: float = float("-inf"), cosine: bool = False) -> DataFrame:
    """(query_id, id, score) of queries (id, v) against rows (id, v): the k best of each query that reach `least`, or all.

    Queries go out in blocks of QUERY_BLOCK vectors, a fixed size; each batch of rows is cut to its k best per query before
    anything is shuffled. Ties go to the lower id. Null vectors take no part.
    """
    spark = rows.sparkSession
    q = queries.where("v IS NOT NULL")
    total = q.count()
    parts = None
    numbered = q.withColumn("_n", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // QUERY_BLOCK)))))
    for b in range(max(1, -(-total // QUERY_BLOCK))):
        block = numbered.where(F.col("_n") == b).select("id", "v").toArrow()
        m = _matrix(block.column("v")) if block.num_rows else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast((block.column("id").to_numpy(), m))
        part = rows.where("v IS NOT NULL").select("id", "v").mapInArrow(_block_scores(sent, k, least, cosine), "query_id long, id long, score double")
        parts = part if parts is None else parts.unionAll(part)
    if k is None:
        return parts
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return parts.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def chosen(candidates: DataFrame, index_top: DataFrame, least: float, k: int) -> DataFrame:
    """(query_id, id, score, place): candidates (query_id, id) with their index score, 0 if the index gave none, that reach
    `least`, best first."""
    s = candidates.join(index_top, ["query_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).where(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return s.withColumn("place", place).where(F.col("place") <= k).select("query_id", "id", "score", "place")


def lexical(query: Column, candidate: Column) -> Column:
    """0.8 if the candidate holds the query, 0.5 if it holds any of its words, else 0.1."""
    c = F.lower(F.translate(F.regexp_replace(candidate, r"\(R |\)", ""), "_.", "  "))
    q = F.lower(query)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    return F.when(c.contains(q), 0.8).when(F.exists(words, lambda w: c.contains(w)), 0.5).otherwise(0.1)


# Last parts of relations that hold times.
TIME_PARTS = ("from", "end_date", "from_date", "start_date", "to", "date_written", "year")


def time_relation(relation: Column) -> Column:
    return F.element_at(F.split(relation, r"\."), -1).isin(*TIME_PARTS)
