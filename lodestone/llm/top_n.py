"""Top N rows of every group (problem 1).

Two stages: each group is hashed into subgroups, rows are ranked in each subgroup and N kept, then the survivors of a
group are ranked. No task ever holds a whole hot group: a subgroup's rows are cut to N before the shuffle (window group
limit), so the second stage sees at most N x subgroups rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBGROUPS = 32


def top_n_per_group(df: DataFrame, group: Column, order: list[Column], row_id: str, n: int, subgroups: int = SUBGROUPS) -> DataFrame:
    """row_id of the first n rows of every group by `order` and then row_id, with their `rank` from 1.

    Rows whose group is null belong to none. Repeated rows count singly; an empty table gives no rows. Only the group's
    16-byte digest, the order columns and row_id are shuffled. Other columns, whatever their names, are not read.
    """
    names = [f"_o{i}" for i in range(len(order))]
    slim = df.where(group.isNotNull()).select(
        F.unhex(F.md5(group)).alias("_g"), F.col(row_id).alias(row_id), *[o.alias(x) for o, x in zip(order, names)]
    )
    salted = slim.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(subgroups)).cast("int"))
    by = [*[F.col(x).asc_nulls_last() for x in names], F.col(row_id).asc_nulls_last()]
    first = Window.partitionBy("_g", "_salt").orderBy(*by)
    last = Window.partitionBy("_g").orderBy(*by)
    kept = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    return kept.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n).select(row_id, "rank")


def best_entries(entries: DataFrame, n: int = 3) -> DataFrame:
    """The n best-scored dump entries of every input, as (entry_id, rank).

    A null or blank input forms no group; null and NaN scores are never kept; higher score first (-0.0 equals 0.0), then
    lower step (null last), then lower entry_id.
    """
    scored = entries.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("input").rlike(r"[^\s\p{Z}]"))
    # + 0.0 turns -0.0 into 0.0; negation makes ascending order best first
    return top_n_per_group(scored, F.col("input"), [0.0 - (F.col("score") + 0.0), F.col("step")], "entry_id", n)
