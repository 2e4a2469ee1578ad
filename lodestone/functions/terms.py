"""Types of terms: numbers, times, languages and the three entity classifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
MID = r"^[mg]\.[A-Za-z0-9_]+$"
MID_LOOSE = r"^[mg]\.\w+$"


def as_number(lex: Column) -> Column:
    """The number a literal's text stands for, null if it is none."""
    return F.when(lex.rlike(NUMBER), F.trim(lex).cast("double"))


def padded_time(lex: Column) -> Column:
    """Date or time text with a missing month and day filled in and without a zone, since zones of dates are not shifted."""
    bare = F.regexp_replace(F.trim(lex), r"(Z|[+-]\d{2}:\d{2})$", "")
    return (
        F.when(bare.rlike(r"^\d{4}$"), F.concat(bare, F.lit("-01-01")))
        .when(bare.rlike(r"^\d{4}-\d{2}$"), F.concat(bare, F.lit("-01")))
        .when(bare.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), bare)
    )


def as_time(lex: Column) -> Column:
    return padded_time(lex).try_cast("timestamp")


def time_bound(text: str) -> str | None:
    """as_time's padding of a constant."""
    bare = re.sub(r"(Z|[+-]\d{2}:\d{2})$", "", text.strip())
    if re.fullmatch(r"\d{4}", bare):
        return bare + "-01-01"
    if re.fullmatch(r"\d{4}-\d{2}", bare):
        return bare + "-01"
    return bare if re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ].*)?", bare) else None


def english(term: Column) -> Column:
    """Terms that are no literal, or a literal without language or in English."""
    return ~term.startswith('"') | ~term.rlike(r'"@[A-Za-z-]+$') | term.rlike(r'(?i)"@en(-[a-z-]*)?$')


def literal_text(value: Column, dtype: Column) -> Column:
    """Typed literal as written in a query: dates, years and months without a zone get -08:00, dateTime doesn't."""
    zoned = value.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    local = F.regexp_extract(dtype, r"([A-Za-z]+)$", 1)
    text = F.when(local.isin("date", "gYear", "gYearMonth") & ~zoned, F.concat(value, F.lit("-08:00"))).otherwise(value)
    return F.concat(F.lit('"'), text, F.lit('"^^<'), dtype, F.lit(">"))


def compare_literal(value: Column) -> Column:
    """The typed literal a comparison makes of a bare value: a float if it has a point, else an integer."""
    typed = F.concat(value, F.when(value.contains("."), F.lit("^^http://www.w3.org/2001/XMLSchema#float")).otherwise(F.lit("^^http://www.w3.org/2001/XMLSchema#integer")))
    return F.when(value.contains("^^"), value).otherwise(typed)
