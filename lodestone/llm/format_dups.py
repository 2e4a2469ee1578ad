"""Records that differ only in formatting (problem 3).

Hot keys are found exactly from partial counts; their rows go through a salted two-level minimum, all other keys through
a one-level shuffle. The representative of a record is its smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.words import key128, word_string
from lodestone.session import cut

SALTS = 64
LEAST_HOT = 1_000
MOST_HOT_KEYS = 10_000


def dump_records(lines: DataFrame) -> DataFrame:
    """(line_id, key) of every line that is a JSON object whose input and output are both non-null.

    Null, blank and cut lines and other JSON give no row. Member order, spacing and escapes don't matter; key is a digest
    of the words of input and of output.
    """
    text = F.trim(F.translate("line", "\t\r\n", "   "))
    parsed = F.from_json("line", "input STRING, output STRING, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(text.startswith("{") & text.endswith("}")).select("line_id", parsed.alias("r"))
    return rows.where("r._bad IS NULL AND r.input IS NOT NULL AND r.output IS NOT NULL").select(
        "line_id", key128(word_string(F.col("r.input")), word_string(F.col("r.output"))).alias("key")
    )


def collapse(rows: DataFrame, key: str, row_id: str) -> DataFrame:
    """(keep_id, row_id) for every row: keep_id is the smallest row_id with the same key. Null keys give no row.

    rows is read twice, so it should be a table. A key is hot from max(LEAST_HOT, rows / MOST_HOT_KEYS) rows on, so at most
    MOST_HOT_KEYS hot keys exist, however large the table is; only these are broadcast.
    """
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(row_id).alias("_id"))
    bar = max(LEAST_HOT, -(-rows.count() // MOST_HOT_KEYS))
    hot_keys = rows.groupBy("_k").count().where(F.col("count") >= bar).select("_k")
    hot_rows = rows.join(F.broadcast(hot_keys), "_k", "left_semi")
    salted = hot_rows.groupBy("_k", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("_s")).agg(F.min("_id").alias("_m"))
    keep = salted.groupBy("_k").agg(F.min("_m").alias("keep_id"))
    hot = rows.join(F.broadcast(keep), "_k").select("keep_id", F.col("_id").alias(row_id))
    rest = rows.join(F.broadcast(hot_keys), "_k", "left_anti")
    rest = rest.select(F.min("_id").over(Window.partitionBy("_k")).alias("keep_id"), F.col("_id").alias(row_id))
    return hot.unionByName(rest)


def duplicate_lines(lines: DataFrame) -> DataFrame:
    """(keep_id, line_id), one row for each further line of a record."""
    return collapse(cut(dump_records(lines), "records"), "key", "line_id").where("line_id <> keep_id")


def record_copies(lines: DataFrame) -> DataFrame:
    """(keep_id, copies), one row for each record."""
    return collapse(cut(dump_records(lines), "records"), "key", "line_id").groupBy("keep_id").agg(F.count("*").alias("copies"))
