"""Batch algebra over rows with an explicit index column idx: selection, column-wise union, repetition, chunks, padding and
length-balanced partitions."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scans import running_sum
from lodestone.session import cut

C = F.col


def numbered(df: DataFrame, *order: Column | str, start: int = 0, name: str = "idx") -> DataFrame:
    """df with consecutive numbers in the given order, without a window over all rows: rows are range-partitioned, numbered in
    each partition, and each partition's offset, one number for each, is added."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("n")).orderBy("_p").collect()
    offset, offsets = start, {}
    for r in sizes:
        offsets[r["_p"]] = offset
        offset += r["n"]
    if not offsets:
        return placed.drop("_m").withColumn(name, F.lit(0).cast("long"))
    table = df.sparkSession.createDataFrame(list(offsets.items()), "_p long, _o long")
    return placed.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(table), "_p").withColumn(name, C("_o") + C("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_o")


def select_indices(df: DataFrame, indices: list[int]) -> DataFrame:
    """Rows at the given indices, in that order and with repeats, numbered anew. The list is the caller's and travels whole."""
    picks = df.sparkSession.createDataFrame([(i, p) for p, i in enumerate(indices)], "idx long, _new long")
    return picks.join(df, "idx").drop("idx").withColumnRenamed("_new", "idx")


def sliced(df: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    return df.where((C("idx") >= start) & (C("idx") < stop) & ((C("idx") - start) % step == 0))


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both, joined row by row; a column both have must be equal in every row, or the query fails."""
    shared = [c for c in b.columns if c in a.columns and c != "idx"]
    renamed = b.withColumnsRenamed({c: f"_b_{c}" for c in shared})
    joined = a.join(renamed, "idx")
    for c in shared:
        same = C(c).eqNullSafe(C(f"_b_{c}"))
        joined = joined.withColumn(c, F.when(same, C(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType)))
    return joined.drop(*[f"_b_{c}" for c in shared])


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a, then of b, whose indices follow those of a."""
    return a.unionByName(b.withColumn("idx", C("idx") + a.count()))


def repeated(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Each row `times` times, next to each other or in whole rounds."""
    n = df.count()
    rows = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.withColumn("idx", C("idx") * times + C("_k") if interleave else C("_k") * n + C("idx")).drop("_k")


def repeated_each(df: DataFrame, count: Column) -> DataFrame:
    """Each row as often as count says, with the place of the copy as rep; rows with 0 vanish."""
    return df.where(count > 0).withColumn("rep", F.explode(F.sequence(F.lit(0), count - 1)))


def chunked(df: DataFrame, chunks: int) -> DataFrame:
    """chunk: which of `chunks` runs of equal size (the last may be smaller) a row is in."""
    size = -(-max(1, df.count()) // chunks)
    return df.withColumn("chunk", F.floor(C("idx") / size).cast("int"))


def split(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(C("idx") / size).cast("int"))


def padded(df: DataFrame, divisor: int) -> DataFrame:
    """Rows from the head are added, round and round, until the number of rows is a multiple of divisor."""
    n = df.count()
    extra = -n % divisor
    if not n or not extra:
        return df
    rounds = -(-extra // n)
    more = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_j", C("_k") * n + C("idx")).where(C("_j") < extra)
    return df.unionByName(more.withColumn("idx", C("_j") + n).drop("_k", "_j"))


def unpadded(df: DataFrame, pad: int) -> DataFrame:
    return df.where(C("idx") < df.count() - pad)


def reordered(df: DataFrame, new_index: Column) -> DataFrame:
    return df.withColumn("idx", new_index)


def folded(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """Runs of `size` rows as one row of arrays."""
    rows = F.sort_array(F.collect_list(F.struct("idx", *columns)))
    g = df.groupBy(F.floor(C("idx") / size).alias("_g")).agg(rows.alias("_r"))
    return g.select(C("_g").cast("long").alias("idx"), *[C(f"_r.{c}").alias(c) for c in columns])


def unfolded(df: DataFrame, size: int, *columns: str) -> DataFrame:
    g = df.select("idx", F.posexplode(F.arrays_zip(*columns)).alias("_i", "_x"))
    return g.select((C("idx") * size + C("_i")).alias("idx"), *[C(f"_x.{c}").alias(c) for c in columns])


def mini_batches(df: DataFrame, size: int, seed: int, epochs: int = 1) -> DataFrame:
    """(epoch, batch): a seeded order of the rows for each epoch, cut in batches; a last one of fewer rows is left out."""
    out = None
    n = df.count() // size * size
    for e in range(epochs):
        part = numbered(df.withColumn("_h", F.xxhash64(F.lit(seed + e), "idx")), "_h", "idx", name="_n").where(C("_n") < n)
        part = part.withColumn("epoch", F.lit(e)).withColumn("batch", F.floor(C("_n") / size).cast("int")).drop("_h", "_n")
        out = part if out is None else out.unionByName(part)
    return out


def balanced_partitions(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Indices in k parts of nearly equal total length by largest differencing (Karmarkar-Karp).

    Partial solutions with the largest spread are merged first, heavy parts of one with light parts of the other. With
    equal_size every part has as many items; their number must be a multiple of k.
    """
    if equal_size and len(lengths) % k:
        raise ValueError("the number of items is no multiple of k")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size:
        starts = [[(lengths[i], [i]) for i in order[a : a + k]] for a in range(0, len(order), k)]
    else:
        starts = [[(0, [])] * (k - 1) + [(lengths[i], [i])] for i in order]
    heap = []
    for at, parts in enumerate(starts):
        parts = sorted(parts, key=lambda p: -p[0])
        heap.append((-(parts[0][0] - parts[-1][0]), at, parts))
    heapq.heapify(heap)
    at = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: -p[0])
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), at, merged))
        at += 1
    return [sorted(p[1]) for p in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy_partitions(lengths: list[int], k: int) -> list[list[int]]:
    """Each item, in the order given, goes to the lightest part; ties to the first."""
    parts: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, i) for i in range(k)]
    for j, n in enumerate(lengths):
        total, i = heapq.heappop(heap)
        parts[i].append(j)
        heapq.heappush(heap, (total + n, i))
    return parts


def balanced(df: DataFrame, batch: str, length: str, k: int, greedy: bool = False) -> DataFrame:
    """part: which of k parts of its batch a row is in. A batch is a training batch, of bounded size; batches run in parallel."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        lens = pdf[length].astype(int).tolist()
        parts = greedy_partitions(lens, k) if greedy else balanced_partitions(lens, k)
        where = {i: p for p, items in enumerate(parts) for i in items}
        return pdf.assign(part=[where[i] for i in range(len(pdf))])

    slim = df.select("idx", batch, length)
    return slim.groupBy(batch).applyInPandas(one, slim.schema.simpleString()[7:-1].replace(":", " ") + ", part int")


def micro_batches(df: DataFrame, batch: str, length: str, most_tokens: int) -> DataFrame:
    """(micro, place): rows of a batch in micro-batches of about most_tokens or fewer, heaviest (by sum of squares) first."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        lens = pdf[length].astype(int).tolist()
        k = max(1, min(len(lens), -(-sum(lens) // most_tokens)))
        parts = sorted(balanced_partitions(lens, k), key=lambda p: (-sum(lens[i] ** 2 for i in p), p))
        rows = [(i, m, j) for m, p in enumerate(parts) for j, i in enumerate(p)]
        return pdf.iloc[[r[0] for r in rows]].assign(micro=[r[1] for r in rows], place=[r[2] for r in rows])

    slim = df.select("idx", batch, length)
    return slim.groupBy(batch).applyInPandas(one, slim.schema.simpleString()[7:-1].replace(":", " ") + ", micro int, place int")


def imbalance(df: DataFrame, batch: str, part: str, length: str) -> DataFrame:
    per = df.groupBy(batch, part).agg(F.sum(length).alias("t"))
    return per.groupBy(batch).agg(F.min("t").alias("least"), F.max("t").alias("most"), F.avg("t").alias("mean"), (F.max("t") - F.min("t")).alias("spread"))


def padded_array(x: Column, size: int, left: bool, fill: Column) -> Column:
    """x cut or filled to `size` elements; left fills (and cuts) at the front."""
    room = F.greatest(F.lit(size) - F.size(x), F.lit(0))
    pad = F.array_repeat(fill, room)
    kept = F.when(F.size(x) > size, F.slice(x, F.when(F.lit(left), F.size(x) - size + 1).otherwise(1), F.lit(size))).otherwise(x)
    return F.concat(pad, kept) if left else F.concat(kept, pad)


def positions(mask: Column) -> Column:
    """Place of each valid token from 0; invalid ones before the first get 0."""
    return F.zip_with(running_sum(mask), mask, lambda s, m: (F.greatest(s - 1, F.lit(0.0)) * m).cast("int"))


def windowed_truncation(x: Column, most: int, side: str) -> Column:
    """x cut to `most` elements: left keeps the end, right the begin, middle both ends."""
    n = F.size(x)
    half = most // 2
    cut_x = {"left": F.slice(x, n - most + 1, F.lit(most)), "right": F.slice(x, F.lit(1), F.lit(most)), "middle": F.concat(F.slice(x, F.lit(1), F.lit(half)), F.slice(x, n - (most - half) + 1, F.lit(most - half)))}[side]
    return F.when(n > most, cut_x).otherwise(x)
