"""Validity of logical forms, queries, literals and rollouts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.terms import MID_LOOSE
from lodestone.functions.text import bound, holds_any, occurrences, strip

# Operators of the logical form language and its bounds.
OPERATORS = ("JOIN", "AND", "ARGMAX", "ARGMIN", "COUNT", "TC", "le", "ge", "lt", "gt", "R")
MOST_LENGTH, MOST_DEPTH, MOST_JOINS, MOST_ANDS, MOST_CHAIN = 1000, 10, 5, 3, 3
TIMEOUTS = ("hyt00", "cl066", "timeout")
RELATION = r"^\w+\.\w+\.\w+$"
# Properties too common to be asked for without a constant.
COMMON = ("rdfs:label", "rdfs:comment", "foaf:name", "dc:title", "skos:prefLabel", "owl:sameAs")
NUMERIC_TYPES, TIME_TYPES = ("integer", "int", "float", "double", "decimal"), ("date", "datetime", "gyear", "gyearmonth")
NUMERIC = r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"
TEMPORAL = r"^(\d{4}(-(0[1-9]|1[0-2]))?(-(0[1-9]|[12]\d|3[01]))?|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?)$"


def _found(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull())


def depth(x: Column) -> Column:
    """Greatest nesting of parentheses, by one pass over the brackets only."""
    steps = F.transform(F.regexp_extract_all(x, F.lit(r"[()]"), F.lit(0)), lambda c: F.when(c == "(", 1).otherwise(-1))
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), lambda a, s: F.struct((a.at + s).alias("at"), F.greatest(a.most, a.at + s).alias("most")))
    return walk.most


def form_errors(x: Column) -> Column:
    """Errors of an S-expression that make it unusable."""
    bad = F.lower(F.trim(x)).isin("@bad_expression", "null")
    ops = F.regexp_extract_all(x, F.lit(r"\(\s*(\w+)"), F.lit(1))
    empty = x.isNull() | (F.trim(x) == "")
    return F.when(empty, F.array(F.lit("empty"))).when(bad, F.array(F.lit("bad_marker"))).otherwise(_found(
        (F.length(x) > MOST_LENGTH, "too_long"), (F.regexp_count(x, F.lit(r"\(")) != F.regexp_count(x, F.lit(r"\)")), "unbalanced"),
        (depth(x) > MOST_DEPTH, "too_deep"), (F.exists(ops, lambda o: ~o.isin(*OPERATORS)), "unknown_operator")))


def form_warnings(x: Column) -> Column:
    """What makes an S-expression suspicious or costly."""
    ids = F.regexp_extract_all(x, F.lit(r"[\s(]([mg]\.[^\s()]+)"), F.lit(1))
    rels = F.regexp_extract_all(x, F.lit(r"(?:JOIN|R|le|lt|ge|gt)\s+([^\s()]+)"), F.lit(1))
    return _found(
        (F.exists(ids, lambda i: ~i.rlike(MID_LOOSE)), "entity_format"), (F.exists(rels, lambda r: ~r.rlike(RELATION)), "relation_format"),
        (F.regexp_count(x, F.lit("JOIN")) > MOST_JOINS, "many_joins"), (F.regexp_count(x, F.lit("AND")) > MOST_ANDS, "many_ands"), (x.rlike(r"\?\w+\s+\?\w+"), "two_variables"))


def suggestion(x: Column) -> Column:
    """A repair: missing brackets are closed, superfluous ones at the end cut off; null where none is known."""
    gap = F.regexp_count(x, F.lit(r"\(")) - F.regexp_count(x, F.lit(r"\)"))
    return F.when(gap > 0, F.concat(x, F.repeat(F.lit(")"), gap))).when((gap < 0) & x.rlike(r"\)$"), F.regexp_replace(x, r"\)$", ""))


def unrestricted(q: Column) -> Column:
    """Patterns of a query that would match nearly every fact. Blanks between the parts of a pattern may be missing."""
    var, end = r"[?$]\w+\s*", r"\s*(\.|\}|;|\s|$)"
    common = "|".join(c.replace(".", r"\.") for c in COMMON)
    body = F.regexp_extract(q, r"(?is)WHERE\s*\{(.*)\}", 1)
    # the optional label and the conditions are no substance
    bare = F.regexp_replace(F.regexp_replace(body, r"(?is)OPTIONAL\s*\{[^{}]*\}", " "), r"(?is)FILTER\s*\([^()]*(\([^()]*\)[^()]*)*\)", " ")
    held = F.lower(body).contains("rdf:type") | body.contains(" a ") | F.lower(body).contains("filter") | (occurrences(body, ".") > 1)
    return _found(
        (q.rlike(rf"(?i){var}{var}[?$]\w+{end}"), "three_variables"), (body.rlike(rf"(?i){var}(a|rdf:type)\s*[?$]\w+{end}"), "any_type"),
        (body.rlike(rf"(?i){var}({common})\s*[?$]\w+{end}") & ~held, "common_property"), (q.rlike(r"(?is)WHERE\s*\{.*\}") & ~body.contains("ns:"), "no_constant"), (F.length(F.trim(bare)) < 10, "no_substance"))


def _typed_ok(value: Column, dtype: Column) -> Column:
    local = F.lower(F.regexp_extract(dtype, r"(?:#|xsd:)?([A-Za-z]+)>?$", 1))
    text = F.regexp_replace(F.trim(value), r'^"+|"+$', "")
    return F.when(local.isin(*NUMERIC_TYPES), text.rlike(NUMERIC)).when(local.isin(*TIME_TYPES), text.rlike(TEMPORAL)).otherwise(False)


def compare_value_ok(x: Column) -> Column:
    """Whether x can be compared with: a number or a time, typed or not, and no entity."""
    s = F.trim(x)
    typed = s.contains("^^")
    parts = F.split(s, r"\^\^", 2)
    return F.when(s.isNull() | (s == "") | s.rlike(r"^[mg]\."), False).when(typed, _typed_ok(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(s.rlike(NUMERIC) | s.rlike(TEMPORAL))


def join_literal_ok(x: Column) -> Column:
    """Whether x is a typed literal to start from; unquoted paths are none."""
    s = F.trim(x)
    parts = F.split(s, r"\^\^", 2)
    left = F.trim(F.get(parts, F.lit(0)))
    path = left.contains("/") & ~(left.startswith('"') & left.endswith('"'))
    return F.when(~s.contains("^^") | path, False).otherwise(_typed_ok(left, F.get(parts, F.lit(1))))


def timeout(x: Column) -> Column:
    return holds_any(x, TIMEOUTS)


def is_math(x: Column) -> Column:
    """Calculations instead of values; typed literals are none."""
    return ~x.contains("^^") & (x.contains("^") | x.contains("*"))


# Beginnings of messages that stand for an empty result, and words that make a message worth keeping.
EMPTY_MESSAGES = ("No results found", "Found 0 results", "Execution failed", "No valid actions found", "Failed to process actions", "Failed to build function sequence", "S-Expression generation failed", "S-Expression validation failed")
KEPT_LONG = r"(?i)debugging|information|useful|details|context|background"
KEPT_SHORT = r"(?i)error|failed|invalid|syntax|connection|timeout"


def empty_result(x: Column) -> Column:
    ids = x.rlike(r"[mg]\.[A-Za-z0-9_]+")
    found = F.lit(False)
    for m in EMPTY_MESSAGES[1:]:
        found = found | x.contains(m)
    long_kept = (F.length(x) > 200) & (ids | x.rlike(KEPT_LONG))
    return F.when(x.contains(EMPTY_MESSAGES[0]), ~long_kept).when(found, True).when(ids, False).otherwise((F.length(x) < 200) & ~x.rlike(KEPT_SHORT))


TAGS = ("think", "action", "information", "answer")


def repeats_beyond(words: Column, share: float) -> Column:
    """Whether one word makes up more than `share` of the words. Such a word's run in the sorted words covers a multiple of
    share times their number, so only the words at these few places are counted."""

    def look(s: Column) -> Column:
        step = F.greatest(F.floor(F.size(s) * share).cast("int"), F.lit(1))
        return F.exists(F.sequence(step, F.greatest(F.size(s), step), step), lambda i: F.size(s) - F.size(F.array_remove(s, F.get(s, i - 1))) > F.size(s) * share)

    return bound(F.sort_array(words), look)


def rollout_errors(x: Column) -> Column:
    """Names of the error patterns of an output."""
    tags = [(occurrences(x, f"<{g}>") != occurrences(x, f"</{g}>"), f"unbalanced_{g}_tags") for g in TAGS]

    def look(t: Column) -> Column:
        repeats = bound(F.filter(F.split(t, r"\s+"), lambda w: w != ""), lambda w: (F.size(w) > 5) & repeats_beyond(w, 0.3))
        return _found(
            *tags, (x.contains("<answer></answer>") | x.contains("<answer> </answer>"), "empty_answer"), (t.endswith("<") | t.endswith("("), "incomplete_sequence"),
            (occurrences(x, "(") != occurrences(x, ")"), "unbalanced_parentheses"), (F.length(t) < 10, "too_short_response"), (repeats, "excessive_repetition"))

    return bound(strip(x), look)


def rollout_errors_sql(x: str) -> str:
    """The same for the checking engine."""
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    w = f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"
    n = lambda p: f"((len({x}) - len(replace({x}, '{p}', ''))) // {len(p)})"
    rows = [(f"{n(f'<{g}>')} <> {n(f'</{g}>')}", f"unbalanced_{g}_tags") for g in TAGS]
    rows += [
        (f"contains({x}, '<answer></answer>') OR contains({x}, '<answer> </answer>')", "empty_answer"), (f"{t} LIKE '%<' OR {t} LIKE '%('", "incomplete_sequence"), (f"{n('(')} <> {n(')')}", "unbalanced_parentheses"),
        (f"len({t}) < 10", "too_short_response"), (f"len({w}) > 5 AND list_max(map_values(list_histogram({w}))) > len({w}) * 0.3", "excessive_repetition")]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in rows) + "], lambda x: x IS NOT NULL)"
