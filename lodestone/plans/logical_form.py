"""Logical forms (S-expressions) planned into Spark joins.

Text is parsed to a tree, the tree is numbered into sub-programs, each sub-program adds triple patterns and conditions over
variables, variables are unified, and the patterns become joins whose columns are the variables. Two dialects hold all
differences in meaning: W (string prefixes, integer casts, one superlative row, exclusion of other variables) and G (double
casts, all superlative ties, exclusion of constants only).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.terms import as_number, as_time, english, time_bound
from lodestone.sources.triples import LABEL, TYPE, XSD, StarStore, by_predicate

ENTITY = re.compile(r"^[mg]\.")
PATH = re.compile(r"^[\w]*\.[\w]*\.[\w]*")
CLASS = re.compile(r"^[A-Za-z_]*\.[A-Za-z_]*")
COMPARE = {"le": "<=", "lt": "<", "ge": ">=", "gt": ">"}
NOW = "2015-08-10"  # fixed value: the day "now" stands for
LIMIT = 1000


class PlanError(ValueError):
    """The logical form has no plan: malformed, unbounded or disconnected."""


@dataclass(frozen=True)
class Dialect:
    name: str
    prefix_match: bool
    integer_cast: bool
    all_ties: bool
    exclude_variables: bool
    count_class: bool
    rejoin_tokens: bool
    relation_only_join: bool  # a JOIN without an object is passed over


W = Dialect("W", prefix_match=True, integer_cast=True, all_ties=False, exclude_variables=True, count_class=True, rejoin_tokens=True, relation_only_join=False)
G = Dialect("G", prefix_match=False, integer_cast=False, all_ties=True, exclude_variables=False, count_class=False, rejoin_tokens=False, relation_only_join=True)
DIALECTS = {"webqsp": W, "graphq": W, "cwq": W, "grailqa": G}


@dataclass
class Pattern:
    s: str
    p: str
    o: str
    prefix: bool = False  # o is a literal whose text the object's must start with
    compare: tuple[str, str] | None = None  # operator and value the object is held against


@dataclass
class Plan:
    patterns: list[Pattern] = field(default_factory=list)
    times: list[tuple[str, str, str, str, str]] = field(default_factory=list)  # variable, from, to, latest from, earliest to
    constants: list[str] = field(default_factory=list)
    order: tuple[str, bool] | None = None  # variable, descending
    count: bool = False
    target: str = "?x"


def parse(text: str) -> list:
    """Nested lists of an S-expression."""
    stack: list[list] = [[]]
    for token in re.findall(r"\(|\)|\"[^\"]*\"\S*?(?=[\s)]|$)|[^\s()]+", text):
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) == 1:
                raise PlanError(f"unbalanced: {text}")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(token)
    if len(stack) != 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list) or not stack[0][0]:
        raise PlanError(f"not one expression: {text}")
    return stack[0][0]


def linearise(tree: list) -> list[list]:
    """Sub-programs in post-order; nested ones are named #k, reversed relations stay in place."""
    programs: list[list] = []

    def visit(node: list) -> str:
        args = [visit(a) if isinstance(a, list) and a[:1] != ["R"] else a for a in node]
        programs.append(args)
        return f"#{len(programs) - 1}"

    visit(tree)
    return programs


def relation(r: str | list) -> tuple[str, bool]:
    """(name, whether reversed)"""
    if isinstance(r, list):
        if len(r) != 2 or r[0] != "R":
            raise PlanError(f"not a relation: {r}")
        return r[1], True
    return r, False


def opposite(rel: str, dialect: Dialect) -> tuple[str, str]:
    """(relation of the begin, relation of the end) for the relation a time constraint names."""
    last = rel.rsplit(".", 1)[-1]
    if dialect.name == "G":
        return rel, (rel[: -len("from")] + "to") if rel.endswith("from") else (rel[: -len("from_date")] + "to_date")
    if last == "from":
        return rel, rel.replace("from", "to")
    if last == "end_date":
        begin = rel.replace("end_date", "start_date")
        return begin, begin.replace("start_date", "end_date")
    return rel, rel.replace(last, "to_date")


def literal(value: str, dialect: Dialect) -> str:
    """Term string of a literal in a logical form. Zones of dates are shifted on neither side, so none is added here."""
    if "^^" not in value:
        return value if value.startswith('"') else f'"{value}"'
    text, dtype = value.split("^^", 1)
    text = text.strip('"')
    dtype = dtype.strip("<>").replace("xsd:", XSD)
    return f'"{text}"^^{dtype}'


def plan(sexpr: str, dialect: Dialect = W) -> Plan:
    tree = parse(sexpr)
    if tree[0] in ("ARGMAX", "ARGMIN") and len(tree) == 3 and isinstance(tree[2], list) and tree[2][0] == "JOIN":
        tree = [*tree[:2], *_path(tree[2])]
    programs = linearise(tree)
    roots: dict[int, int] = {}

    def root(i: int) -> int:
        while i in roots:
            i = roots[i]
        return i

    def unify(i: int, j: int) -> None:
        a, b = sorted((root(i), root(j)))
        if a != b:
            roots[b] = a

    out = Plan()
    consumed = {int(a[1:]) for p in programs if p[0] in COMPARE for a in p[1:2] if isinstance(a, str) and a.startswith("#")}
    for i, p in enumerate(programs):
        v, op = f"?x{i}", p[0]
        if op == "JOIN":
            if len(p) == 2 and dialect.relation_only_join:
                continue
            if len(p) < 3:
                raise PlanError(f"JOIN needs a relation and an object: {p}")
            if i in consumed or (PATH.match(str(p[2])) and "^^" not in p[2] and not p[2].startswith(('"', "#")) and not ENTITY.match(p[2])):
                continue  # a relation path; the comparison that names it adds its patterns
            name, reverse = relation(p[1])
            if p[2].startswith("#"):
                obj = f"?x{p[2][1:]}"
            elif ENTITY.match(p[2]):
                obj = p[2]
                if obj not in out.constants:
                    out.constants.append(obj)
            elif CLASS.match(p[2]) and "^^" not in p[2] and not p[2].startswith('"'):
                obj = p[2]
            else:
                obj = literal(" ".join(p[2:]) if dialect.rejoin_tokens else p[2], dialect)
            prefix = dialect.prefix_match and obj.startswith('"') and ("^^" not in obj or obj.endswith("#dateTime"))
            out.patterns.append(Pattern(obj, name, v) if reverse else Pattern(v, name, obj, prefix=prefix))
        elif op == "AND":
            a, b = (p[1], p[2]) if len(p) == 3 else (None, None)
            if len(p) > 3:  # a class and several conditions: all variables are one
                variables = [x for x in p[1:] if x.startswith("#")]
                for x in variables:
                    unify(i, int(x[1:]))
                for x in p[1:]:
                    if not x.startswith("#"):
                        out.patterns.append(Pattern(v, TYPE, x))
                continue
            if a is None:
                raise PlanError(f"AND needs two operands: {p}")
            if not b.startswith("#"):
                a, b = b, a
            if not b.startswith("#"):
                continue  # neither is a variable: dropped
            unify(i, int(b[1:]))
            if a.startswith("#"):
                unify(i, int(a[1:]))
            else:
                out.patterns.append(Pattern(v, TYPE, a))
        elif op in COMPARE:
            if len(p) != 3:
                raise PlanError(f"a comparison needs a relation and a value: {p}")
            held = (COMPARE[op], p[2])
            if isinstance(p[1], str) and p[1].startswith("#"):
                ref = programs[int(p[1][1:])]
                if ref[0] != "JOIN" or len(ref) < 3:
                    raise PlanError(f"cannot compare the result of {ref}")
                (r1, back1), (r2, back2) = relation(ref[1]), relation(ref[2])
                mid, y = f"?cvt{i}", f"?y{i}"
                out.patterns.append(Pattern(mid, r1, v) if back1 else Pattern(v, r1, mid))
                out.patterns.append(Pattern(y, r2, mid) if back2 else Pattern(mid, r2, y, compare=held))
            else:
                name, reverse = relation(p[1])
                if reverse:
                    raise PlanError(f"cannot compare along a reversed relation: {p}")
                out.patterns.append(Pattern(v, name, f"?y{i}", compare=held))
        elif op == "TC":
            if len(p) != 4 or not p[1].startswith("#"):
                raise PlanError(f"TC needs an expression, a relation and a year: {p}")
            unify(i, int(p[1][1:]))
            begin, end = opposite(relation(p[2])[0], dialect)
            year = p[3].split("^^")[0].strip('"')
            now = year == "NOW" or (dialect.name == "W" and year == "now")
            out.times.append((v, begin, end, NOW if now else f"{year}-12-31", NOW if now else f"{year}-01-01"))
        elif op in ("ARGMAX", "ARGMIN"):
            if p[1].startswith("#"):
                unify(i, int(p[1][1:]))
            else:
                out.patterns.append(Pattern(v, TYPE, p[1]))
            at = v
            for j, r in enumerate(p[2:]):
                name, reverse = relation(r)
                nxt = "?sk0" if j == len(p) - 3 else f"?c{j}"
                out.patterns.append(Pattern(nxt, name, at) if reverse else Pattern(at, name, nxt))
                at = nxt
            out.order = ("?sk0", op == "ARGMAX")
        elif op == "COUNT":
            out.count = True
            if p[1].startswith("#"):
                unify(i, int(p[1][1:]))
            elif dialect.count_class:
                out.patterns.append(Pattern(v, TYPE, p[1]))
            else:
                raise PlanError(f"COUNT needs an expression: {p}")
        else:
            raise PlanError(f"unknown operator {op}")

    def name(term: str) -> str:
        if not re.match(r"^\?x\d+$", term):
            return term
        r = root(int(term[2:]))
        return "?x" if r == root(len(programs) - 1) else f"?x{r}"

    for pat in out.patterns:
        pat.s, pat.o = name(pat.s), name(pat.o)
    out.times = [(name(t[0]), *t[1:]) for t in out.times]
    check_bounded(out)
    return out


def _path(node: list) -> list:
    """Relations along nested JOINs."""
    found = []
    for e in node[1:]:
        found += _path(e) if isinstance(e, list) and e[0] == "JOIN" else [e]
    return found


def check_bounded(p: Plan) -> None:
    """Refuse plans that would scan without any constant term or join without a shared variable."""
    if not p.patterns:
        raise PlanError("no substantive pattern")
    if all(x.s.startswith("?") and x.o.startswith("?") and not x.compare for x in p.patterns) and not p.order:
        raise PlanError("no constant term")
    seen = {v for v in (p.patterns[0].s, p.patterns[0].o) if v.startswith("?")}
    rest = p.patterns[1:]
    while rest:
        near = [x for x in rest if {x.s, x.o} & seen]
        if not near:
            raise PlanError("patterns share no variable")
        for x in near:
            seen |= {v for v in (x.s, x.o) if v.startswith("?")}
            rest.remove(x)
    if p.target not in seen:
        raise PlanError("the asked variable is not bound")


def compared(lex: Column, op: str, value: str, dialect: Dialect) -> Column:
    """Comparison of an object's text with a value; null (the row is dropped) where the types don't fit."""
    raw = value.split("^^")[0].strip('"')
    if dialect.integer_cast and re.match(r"\d+", value):
        left = F.when(lex.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(lex).cast("double"))
        if not re.fullmatch(r"[+-]?\d+(\.\d+)?", raw):
            return F.lit(None).cast("boolean")
        right = F.lit(float(raw))
    elif re.fullmatch(r"-?\d+(\.\d+)?", raw):
        left, right = as_number(lex), F.lit(float(raw))
    else:
        left, right = as_time(lex), F.lit(time_bound(raw)).cast("timestamp")
    return {"<=": left <= right, "<": left < right, ">=": left >= right, ">": left > right}[op]


def _scan(facts: DataFrame | StarStore, pat: Pattern, dialect: Dialect, order: str | None) -> DataFrame:
    rows = by_predicate(facts, pat.p)
    out: list[Column] = []
    if pat.s.startswith("?"):
        out.append(F.col("s").alias(pat.s))
    else:
        rows = rows.where(F.col("s") == pat.s)
    if pat.o.startswith("?"):
        if pat.compare:
            rows = rows.where(compared(F.col("lex"), *pat.compare, dialect))
        out.append(F.col("o").alias(pat.o))
        if pat.o == order:
            out += [as_number(F.col("lex")).alias("_num"), as_time(F.col("lex")).alias("_time")]
    elif pat.prefix:
        text = re.match(r'^"(.*)"', pat.o, re.DOTALL).group(1)
        rows = rows.where((F.col("kind") == "literal") & F.col("lex").startswith(text))
    else:
        rows = rows.where(F.col("o") == pat.o)
    if pat.s == pat.o:
        rows = rows.where(F.col("s") == F.col("o"))
        out = out[:1]
    return rows.select(*out)


def bindings(facts: DataFrame | StarStore, p: Plan, dialect: Dialect = W) -> DataFrame:
    """One column per variable, conditions applied, before projection."""
    order = p.order[0] if p.order else None
    rest = sorted(p.patterns, key=lambda x: (x.s.startswith("?") + x.o.startswith("?"), x.compare is None))
    df = _scan(facts, rest.pop(0), dialect, order)
    while rest:
        nxt = next(x for x in rest if {x.s, x.o} & set(df.columns))
        rest.remove(nxt)
        side = _scan(facts, nxt, dialect, order)
        df = df.join(side, [c for c in side.columns if c in df.columns and not c.startswith("_")])
    for var, begin, end, latest, earliest in p.times:
        spans = by_predicate(facts, begin, end).groupBy(F.col("s").alias(var)).agg(
            F.count(F.when(F.col("p") == begin, 1)).alias("_nf"), F.min(F.when(F.col("p") == begin, as_time(F.col("lex")))).alias("_f"),
            F.count(F.when(F.col("p") == end, 1)).alias("_nt"), F.max(F.when(F.col("p") == end, as_time(F.col("lex")))).alias("_t"))
        df = df.join(spans, var, "left").where(
            ((F.coalesce("_nf", F.lit(0)) == 0) | (F.col("_f") <= F.lit(latest).cast("timestamp")))
            & ((F.coalesce("_nt", F.lit(0)) == 0) | (F.col("_t") >= F.lit(earliest).cast("timestamp")))).drop("_nf", "_f", "_nt", "_t")
    for c in p.constants:
        df = df.where(F.col("?x") != c)
    if dialect.exclude_variables:
        for v in df.columns:
            if v.startswith("?") and v != "?x" and not v.startswith("?sk"):
                df = df.where(F.col("?x") != F.col(v))
    return df.where(english(F.col("?x")))


def evaluate(facts: DataFrame | StarStore, sexpr: str, dialect: Dialect = W, labels: bool = True, limit: int | None = LIMIT) -> DataFrame:
    """(x, name) of a logical form, or (n) for a COUNT; distinct, in order of x and name, at most `limit` rows.

    The result limit is part of the language (superlatives have none); pass None to lift it.
    """
    p = plan(sexpr, dialect)
    df = bindings(facts, p, dialect)
    if p.count:
        return df.agg(F.countDistinct("?x").alias("n"))
    if p.order:
        key = [F.col(c).desc_nulls_last() if p.order[1] else F.col(c).asc_nulls_last() for c in ("_num", "_time")]
        if dialect.all_ties:
            best = df.orderBy(*key).limit(1).select(F.col("_num").alias("_bn"), F.col("_time").alias("_bt"))
            df = df.join(F.broadcast(best), F.col("_num").eqNullSafe(F.col("_bn")) & F.col("_time").eqNullSafe(F.col("_bt")))
        else:
            df = df.orderBy(*key, F.col("?x")).limit(1)
    x = df.select(F.col("?x").alias("x")).distinct()
    if not labels:
        return x if p.order or limit is None else x.orderBy("x").limit(limit)
    names = by_predicate(facts, LABEL).where((F.col("kind") == "literal") & F.col("lang").rlike("(?i)^en(-.*)?$")).select(F.col("s").alias("x"), F.col("lex").alias("name"))
    out = x.join(names, "x", "left").distinct()
    return out if p.order or limit is None else out.orderBy("x", "name").limit(limit)
