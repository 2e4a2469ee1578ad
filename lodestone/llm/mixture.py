"""Mixing sources to target weights (problem 7).

Each source's texts are put into shards and, inside a shard, in seeded order into blocks of equally many tokens.
Sainte-Lague apportionment gives every source, then every shard of a source, its whole number of blocks; the blocks taken are
those first in a seeded order, and a source that needs more blocks than it has takes all of them as often as needed, at
most max_repeats times.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tokens import TOKENIZER, encode_texts
from lodestone.session import cut

SHARD_TOKENS = 200_000_000
MOST_SHARDS = 2_048
BLOCKS = 4_096
LEAST_BLOCK = 256
TEXTS_A_BLOCK = 2


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), none beyond its cap; equal quotients go to the earlier entry."""
    w, c = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = int(min(seats, c[w > 0].sum()))
    if seats <= 0:
        return [0] * len(w)
    low, high = 0.0, float(w.max()) * 2  # quotient bars: all seats and more, none

    def at(bar: float) -> np.ndarray:
        return np.minimum(np.where(w > 0, np.floor((w / bar + 1) / 2), 0), c).astype(np.int64)

    for _ in range(200):
        bar = (low + high) / 2
        if bar in (low, high):
            break
        low, high = (low, bar) if at(bar).sum() <= seats else (bar, high)
    given = at(high)
    heap = [(-w[i] / (2 * given[i] + 1), i) for i in range(len(w)) if w[i] > 0 and given[i] < c[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < c[i]:
            heapq.heappush(heap, (-w[i] / (2 * given[i] + 1), i))
    return given.tolist()


def source_name(source: Column) -> Column:
    return F.lower(F.trim(source))


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the texts in the mixture.

    Sources are compared without case and outer blanks; texts of a null or unlisted source and texts without tokens are left
    out. total_tokens defaults to the largest total at which every listed source that has texts still reaches its share;
    with a larger one, sources at their cap fall short. Sources without texts get nothing. Repeated rows are texts of their
    own. targets is a configuration of few rows and is read by the driver, as are the tokens per shard, of which there are
    at most MOST_SHARDS for a source.
    """
    spark = docs.sparkSession
    wanted = targets.select(source_name(F.col("source")).alias("src"), "target_share", "max_repeats").where("src IS NOT NULL AND target_share > 0")
    wanted = wanted.groupBy("src").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("reps"))
    goal = {r.src: (r.share, int(r.reps or 1)) for r in wanted.collect()}
    sources = sorted(goal)
    named = docs.select(F.struct("doc_id", source_name(F.col("source")).alias("src")).alias("k"), "text").where(F.col("k.src").isin(sources))
    sized = encode_texts(named, "k", "text", path, count_only=True).where("n_tokens > 0").select("k.doc_id", "k.src", F.col("n_tokens").cast("long").alias("n_tokens"))
    sized = cut(sized, "sized")
    found = sized.groupBy("src").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("texts")).collect()
    have, texts = {r.src: r.n for r in found}, sum(r.texts for r in found)
    with_texts = [s for s in sources if have.get(s, 0) > 0]
    if not with_texts:
        return sized.select("doc_id", F.col("src").alias("source"), "n_tokens", F.lit(0).alias("copies")).where("false")
    fair = int(min(have[s] * goal[s][1] / goal[s][0] for s in with_texts))
    total = fair if total_tokens is None else total_tokens
    least = max(LEAST_BLOCK, TEXTS_A_BLOCK * sum(have.values()) // texts)
    block = int(max(min(total // BLOCKS, SHARD_TOKENS // 64), least))
    shards = {s: int(min(max(have[s] // SHARD_TOKENS, 1), MOST_SHARDS)) for s in with_texts}
    n_shards = F.create_map(*[F.lit(x) for s in with_texts for x in (s, shards[s])])[F.col("src")]
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n_shards).cast("int"))
    counts = sharded.groupBy("src", "shard").agg(F.sum("n_tokens").alias("n")).orderBy("src", "shard").collect()
    pieces = {(r.src, r.shard): (r.n, max(1, round(r.n / block))) for r in counts}
    caps = {s: math.ceil(have[s] * goal[s][1] / block) for s in with_texts}
    filled = sum(goal[s][0] for s in with_texts)  # what sources without texts would have got stays unfilled
    seats = sainte_lague([goal[s][0] for s in with_texts], max(1, round(total * filled / block)), [caps[s] for s in with_texts])
    plan = []
    for s, seats_of in zip(with_texts, seats):
        own = [k for k in pieces if k[0] == s]
        # the last block of a shard is spread over the others, so they may weigh a little more or less than `block`
        take = round(seats_of * block * sum(pieces[k][1] for k in own) / have[s])
        quotas = sainte_lague([pieces[k][0] for k in own], take, [pieces[k][1] * goal[s][1] for k in own])
        plan += [(s, k[1], pieces[k][0], pieces[k][1], _stride(pieces[k][1]), q, goal[s][1]) for k, q in zip(own, quotas)]
    plan_df = spark.createDataFrame(plan, "src string, shard int, shard_tokens long, blocks long, stride long, quota long, reps int")
    inside = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = sharded.join(F.broadcast(plan_df), ["src", "shard"]).withColumn("start", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    placed = placed.withColumn("block", F.expr("CAST(floor(CAST(start AS DOUBLE) * blocks / shard_tokens) AS LONG)"))
    # seeded order of a shard's blocks: multiples of a stride that shares no divisor with their number
    placed = placed.withColumn("place", F.expr(f"pmod(block * stride + pmod(xxhash64({seed + 2}, shard), blocks), blocks)"))
    in_turn = Window.partitionBy("src", "shard").orderBy("place", "start", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("before", F.sum("n_tokens").over(in_turn) - F.col("n_tokens")).withColumn("due", F.expr("quota * shard_tokens div blocks"))
    # whole rounds over the shard, then blocks in turn; the last block taken ends with the text that fills the quota
    copies = F.least(F.expr("due div shard_tokens + IF(before < due % shard_tokens, 1, 0)"), F.col("reps")).cast("int")
    return placed.select("doc_id", F.col("src").alias("source"), "n_tokens", copies.alias("copies")).where("copies > 0")


def _stride(blocks: int) -> int:
    """A number next to the golden section of blocks that shares no divisor with it."""
    stride = max(1, round(blocks * 0.6180339887))
    while math.gcd(stride, blocks) > 1:
        stride += 1
    return stride


def reached_shares(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_texts, most_copies) for each listed source, also those without texts."""
    mixed = mixture(docs, targets, **options)
    per = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count("*").alias("n_texts"), F.max("copies").alias("most_copies"))
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share").where("source IS NOT NULL")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"))
    out = wanted.join(per, "source", "left").na.fill(0, ["n_tokens", "n_texts", "most_copies"])
    share = F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # one row per listed source
    return out.select("source", "target_share", F.coalesce(share, F.lit(0.0)).alias("actual_share"), "n_tokens", "n_texts", "most_copies")
