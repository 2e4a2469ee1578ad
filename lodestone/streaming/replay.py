"""Action streams: windowed counts of late data, and the join-chain rule as keyed state.

Batch and stream use the same expressions; only the chain rule needs state that a window can't hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.validators import MOST_CHAIN

CHAIN_SCHEMA = "sample_no long, i int, depth int, kept boolean"


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; events later than the watermark are left out in a stream."""
    if events.isStreaming:  # event time must carry a zone
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _chain(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    expr, rel, depth = state.get if state.exists else ("", "", 0)
    for pdf in frames:
        out = []
        for r in pdf.sort_values("i").itertuples():
            if not r.expr:
                expr, rel, depth = "", "", 0
                continue
            same = depth > 0 and expr == r.expr
            again = same and rel == r.rel
            depth = depth + 1 if same else 1
            expr, rel = r.expr, r.rel
            out.append((int(key[0]), int(r.i), depth, depth <= MOST_CHAIN and not again))
        state.update((expr, rel, depth))
        yield pd.DataFrame(out, columns=["sample_no", "i", "depth", "kept"])


def chains(calls: DataFrame) -> DataFrame:
    """Stream of (sample_no, i, depth, kept) for the JOINs of a stream (sample_no, i, f) of function calls, whose calls of one sample
    come in order: the state is the last expression, its relation and how many JOINs stand on it."""
    join = F.col("f").rlike(r"= JOIN\('.*', expression\d*\)$")
    rows = calls.select("sample_no", "i", F.when(join, F.regexp_extract("f", r", (expression\d*)\)$", 1)).otherwise("").alias("expr"), F.when(join, F.regexp_extract("f", r"JOIN\('(.*?)',", 1)).otherwise("").alias("rel"))
    return rows.groupBy("sample_no").applyInPandasWithState(_chain, CHAIN_SCHEMA, "expr string, rel string, depth int", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All a stream gives from what lies there now, written to folder and read as a table."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", folder + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
