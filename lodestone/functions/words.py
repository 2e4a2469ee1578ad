"""Words of a text: its longest runs of letters and digits of any script, compared without case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def word_string(text: Column) -> Column:
    """The words of text in order, joined by one space; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def key128(*parts: Column) -> Column:
    """16-byte digest that stands for the given strings in shuffles. Nulls make it null."""
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.md5(F.concat(*sized)))
