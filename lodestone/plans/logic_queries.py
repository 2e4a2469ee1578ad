"""Queries of the logical-form language (Q) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans import functions_list
from lodestone.plans.logical_form import G, PlanError, W, evaluate, linearise, opposite, parse, plan
from lodestone.sources.triples import STAR_SQL, StarStore, by_predicate
from lodestone.session import table

XSD = "http://www.w3.org/2001/XMLSchema#"
_EN = "regexp_matches(lang, '^[eE][nN](-.*)?$')"
_LABELS = f"""LEFT JOIN (SELECT s, lex AS name FROM f WHERE p = 'rdfs:label' AND kind = 'literal' AND {_EN}) l ON l.s = x"""
_NUM = "CASE WHEN regexp_matches(lex, '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN CAST(trim(lex) AS DOUBLE) END"
_INT = "CASE WHEN regexp_matches(lex, '^\\s*[+-]?\\d+\\s*$') THEN CAST(trim(lex) AS DOUBLE) END"
_TIME = "TRY_CAST(CASE WHEN regexp_matches(lex, '^\\d{4}$') THEN lex || '-01-01' WHEN regexp_matches(lex, '^\\d{4}-\\d{2}$') THEN lex || '-01' WHEN regexp_matches(lex, '^\\d{4}-\\d{2}-\\d{2}') THEN lex END AS TIMESTAMP)"


def _answer(x: str, limit: bool = True) -> str:
    return f"WITH {STAR_SQL}, x AS (SELECT DISTINCT x FROM ({x})) SELECT DISTINCT x, name FROM x {_LABELS}" + (" ORDER BY x, name NULLS FIRST LIMIT 1000" if limit else "")


def _tc(x: str, year_from: str, year_to: str) -> str:
    return f"""SELECT x FROM ({x}) b WHERE
 (NOT EXISTS (SELECT 1 FROM f WHERE s = x AND p = 'order.order.from') OR EXISTS (SELECT 1 FROM f WHERE s = x AND p = 'order.order.from' AND {_TIME} <= TIMESTAMP '{year_from}'))
 AND (NOT EXISTS (SELECT 1 FROM f WHERE s = x AND p = 'order.order.to') OR EXISTS (SELECT 1 FROM f WHERE s = x AND p = 'order.order.to' AND {_TIME} >= TIMESTAMP '{year_to}'))"""


def _s(p: str, o: str) -> str:
    return f"SELECT s AS x FROM f WHERE p = '{p}' AND o = '{o}'"


_N3, _STATUS = _s("customer.customer.nation", "m.n3"), _s("order.order.status", "m.st_F")
# name: (logical form, dialect, SQL of x)
FORMS: dict[str, tuple] = {
    "q02_join_forward": ("(JOIN customer.customer.nation m.n3)", W, _N3),
    "q03_join_reverse": ("(JOIN (R nation.nation.region) m.n3)", W, "SELECT o AS x FROM f WHERE s = 'm.n3' AND p = 'nation.nation.region'"),
    "q04_join_chain": ("(JOIN order.order.customer (JOIN customer.customer.nation m.n3))", W, f"SELECT s AS x FROM f JOIN ({_N3}) c ON o = c.x WHERE p = 'order.order.customer'"),
    "q05_join_class": ("(JOIN type.object.type nation.region)", W, _s("type.object.type", "nation.region")),
    "q05_join_typed_literal": (f'(JOIN order.order.date "1996-01-02"^^<{XSD}date>)', W, _s("order.order.date", f'"1996-01-02"^^{XSD}date')),
    "q06_literal_prefix_w": ('(JOIN order.order.priority "1-U")', W, "SELECT s AS x FROM f WHERE p = 'order.order.priority' AND kind = 'literal' AND starts_with(lex, '1-U')"),
    "q06_literal_exact_g": ('(JOIN order.order.priority "1-URGENT")', G, _s("order.order.priority", '"1-URGENT"')),
    "q08_relation_only_g": ("(AND (JOIN customer.customer.nation m.n3) (JOIN customer.customer.balance))", G, _N3),
    "q09_and_intersect_w": ("(AND (JOIN customer.customer.nation m.n3) (JOIN (R order.order.customer) (JOIN order.order.status m.st_F)))", W, f"SELECT n.x FROM ({_N3}) n JOIN f o ON o.o = n.x AND o.p = 'order.order.customer' JOIN ({_STATUS}) t ON t.x = o.s"),
    "q09_and_intersect_g": ("(AND (JOIN customer.customer.segment m.seg_building) (JOIN customer.customer.nation m.n3))", G, f"{_N3} INTERSECT {_s('customer.customer.segment', 'm.seg_building')}"),
    "q10_and_class": ("(AND nation.nation (JOIN nation.nation.region m.r1))", W, _s("nation.nation.region", "m.r1") + " INTERSECT " + _s("type.object.type", "nation.nation")),
    "q11_compare": (f"(AND customer.customer (ge customer.customer.balance 9000.5^^{XSD}double))", G, f"SELECT s AS x FROM f WHERE p = 'customer.customer.balance' AND {_NUM} >= 9000.5"),
    "q11a_compare_integer_w": ("(AND order.order (lt order.order.total_whole 20000))", W, f"SELECT s AS x FROM f WHERE p = 'order.order.total_whole' AND {_INT} < 20000"),
    "q11b_compare_double_g": ("(AND order.order (lt order.order.total 2500))", G, f"SELECT s AS x FROM f WHERE p = 'order.order.total' AND {_NUM} < 2500"),
    "q11_compare_two_hop": ("(AND order.order (gt (JOIN order.order.customer customer.customer.balance) 9900))", G, f"SELECT a.s AS x FROM f a JOIN (SELECT s, lex FROM f WHERE p = 'customer.customer.balance') b ON a.o = b.s WHERE a.p = 'order.order.customer' AND {_NUM.replace('lex', 'b.lex')} > 9900"),
    "q11_compare_date": (f"(AND order.order (ge order.order.date 1998-07-01^^{XSD}date))", G, f"SELECT s AS x FROM f WHERE p = 'order.order.date' AND {_TIME} >= TIMESTAMP '1998-07-01'"),
    "q12_time_constraint_w": ("(TC (JOIN order.order.status m.st_F) order.order.from 1994)", W, _tc(_STATUS, "1994-12-31", "1994-01-01")),
    "q12_time_constraint_g": ("(TC (JOIN order.order.customer (JOIN customer.customer.nation m.n3)) order.order.from 1996)", G, _tc(f"SELECT s AS x FROM f JOIN ({_N3}) c ON o = c.x WHERE p = 'order.order.customer'", "1996-12-31", "1996-01-01")),
    "q12_time_now": ("(TC (JOIN order.order.status m.st_P) order.order.from NOW)", W, _tc(_s("order.order.status", "m.st_P"), "2015-08-10", "2015-08-10")),
    "q16_distinct_labels": ("(JOIN (R order.order.customer) (JOIN order.order.status m.st_P))", W, f"SELECT o AS x FROM f JOIN ({_s('order.order.status', 'm.st_P')}) t ON t.x = s WHERE p = 'order.order.customer'"),
    "q17_optional_label": ("(JOIN customer.customer.segment m.seg_building)", W, _s("customer.customer.segment", "m.seg_building")),
    "q18_exclusion_w": ("(JOIN nation.nation.neighbour (JOIN nation.nation.neighbour m.n6))", W, "SELECT b.s AS x FROM f a JOIN f b ON b.o = a.s WHERE a.p = 'nation.nation.neighbour' AND b.p = 'nation.nation.neighbour' AND a.o = 'm.n6' AND b.s <> 'm.n6' AND b.s <> a.s"),
    "q18_exclusion_g": ("(JOIN nation.nation.neighbour (JOIN nation.nation.neighbour m.n6))", G, "SELECT b.s AS x FROM f a JOIN f b ON b.o = a.s WHERE a.p = 'nation.nation.neighbour' AND b.p = 'nation.nation.neighbour' AND a.o = 'm.n6' AND b.s <> 'm.n6'"),
    "q19_language_filter": ("(JOIN (R rdfs:label) (JOIN customer.customer.nation m.n3))", W, f"SELECT o AS x FROM f JOIN ({_N3}) c ON s = c.x WHERE p = 'rdfs:label' AND {_EN}"),
    "q20_limit": ("(JOIN type.object.type order.order)", W, _s("type.object.type", "order.order")),
    "q23_unify_three": ("(AND customer.customer (AND (JOIN customer.customer.nation m.n3) (AND (JOIN customer.customer.segment m.seg_building) (JOIN (R order.order.customer) (JOIN order.order.status m.st_O)))))", W, f"{_N3} INTERSECT {_s('customer.customer.segment', 'm.seg_building')} INTERSECT SELECT o FROM f JOIN ({_s('order.order.status', 'm.st_O')}) t ON t.x = s WHERE p = 'order.order.customer'"),
}


def _best(x: str, rel: str, desc: bool, ties: bool) -> str:
    key = f"{_NUM} {'DESC' if desc else 'ASC'} NULLS LAST, {_TIME} {'DESC' if desc else 'ASC'} NULLS LAST"
    rank = f"rank() OVER (ORDER BY {key})" if ties else f"row_number() OVER (ORDER BY {key}, x)"
    return _answer(f"SELECT x FROM (SELECT x, {rank} AS r FROM ({x}) b JOIN (SELECT s, lex FROM f WHERE p = '{rel}') a ON a.s = b.x) WHERE r = 1", limit=False)


BESTS: dict[str, tuple] = {
    "q13_argmax_w": ("(ARGMAX (JOIN customer.customer.nation m.n3) customer.customer.balance)", W, _best(_N3, "customer.customer.balance", True, False)),
    "q13a_argmin_ties_g": ("(ARGMIN (JOIN order.order.status m.st_O) order.order.date)", G, _best(_s("order.order.status", "m.st_O"), "order.order.date", False, True)),
    "q13b_argmax_path_w": ("(ARGMAX nation.nation (JOIN (R customer.customer.nation) customer.customer.balance))", W,
        _answer(f"SELECT o AS x FROM (SELECT c.o, row_number() OVER (ORDER BY {_NUM.replace('lex', 'b.lex')} DESC NULLS LAST, c.o) AS r FROM f c JOIN f b ON b.s = c.s WHERE c.p = 'customer.customer.nation' AND b.p = 'customer.customer.balance' AND c.o <> c.s AND c.o <> b.o) WHERE r = 1", limit=False)),
    "q13c_argmin_class_w": ("(ARGMIN customer.customer customer.customer.balance)", W, _best(_s("type.object.type", "customer.customer"), "customer.customer.balance", False, False)),
}
COUNTS: dict[str, tuple] = {
    "q14_count": ("(COUNT (JOIN customer.customer.nation m.n3))", W, f"WITH {STAR_SQL} SELECT count(DISTINCT x) AS n FROM ({_N3})"),
    "q14_count_class_w": ("(COUNT nation.region)", W, f"WITH {STAR_SQL} SELECT count(DISTINCT x) AS n FROM ({_s('type.object.type', 'nation.region')})"),
    "q14_count_chain_g": ("(COUNT (JOIN order.order.customer (JOIN customer.customer.nation m.n3)))", G, f"WITH {STAR_SQL} SELECT count(DISTINCT s) AS n FROM f JOIN ({_N3}) c ON o = c.x WHERE p = 'order.order.customer'"),
}
# Forms without a plan, and why.
UNPLANNED = ["(ge (COUNT (JOIN a.b.c m.x)) 3)", "(JOIN a.b.c", "(AND a.b c.d)", "(FOO a b)", "(JOIN a.b.c d.e.f)"]
OPPOSITES = [("a.b.from", "W", "a.b.from", "a.b.to"), ("a.b.end_date", "W", "a.b.start_date", "a.b.end_date"), ("a.b.from_date", "W", "a.b.from_date", "a.b.to_date"),
             ("a.b.from", "G", "a.b.from", "a.b.to"), ("a.b.from_date", "G", "a.b.from_date", "a.b.to_date")]


def _plannable(s: str) -> bool:
    try:
        plan(s, G)
        return True
    except PlanError:
        return False


def start(facts: DataFrame | StarStore, entity: str) -> DataFrame:
    """START: the constant itself, with its first English label."""
    named = by_predicate(facts, "rdfs:label").where((F.col("s") == entity) & F.col("lang").rlike("(?i)^en")).agg(F.min("lex").alias("name"))
    return named.select(F.lit(entity).alias("x"), "name")


def _form(name: str, forms: dict):
    text, dialect, _ = forms[name]
    return lambda s, d: evaluate(StarStore(s, d), text, dialect)


def stop(s: SparkSession, d: str) -> DataFrame:
    """A function list, made an S-expression and answered."""
    lines = ["expression1 = START('m.n3')", "expression1 = JOIN('customer.customer.nation', expression1)", "expression2 = START('m.seg_building')", "expression2 = JOIN('customer.customer.segment', expression2)", "expression1 = AND(expression1, expression2)", "expression1 = STOP(expression1)"]
    return evaluate(StarStore(s, d), functions_list.to_sexpr(lines), W)


def shapes(qa: DataFrame) -> DataFrame:
    """(sample_no, depth, balanced, programs, operators) of each S-expression, by expressions only."""
    text = F.col("sexpr")
    steps = F.transform(F.filter(F.split(text, ""), lambda c: c.isin("(", ")")), lambda c: F.when(c == "(", 1).otherwise(-1))
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"), F.lit(0).alias("least")), lambda a, x: F.struct((a.at + x).alias("at"), F.greatest(a.most, a.at + x).alias("most"), F.least(a.least, a.at + x).alias("least")))
    rows = qa.where(text.isNotNull()).select("sample_no", "sexpr", walk.alias("w"))
    return rows.select(
        "sample_no", F.col("w.most").alias("depth"), ((F.col("w.at") == 0) & (F.col("w.least") >= 0)).alias("balanced"),
        F.expr(r"regexp_count(sexpr, '\\((?!R )')").alias("programs"), F.concat_ws(" ", F.expr(r"regexp_extract_all(sexpr, '\\((\\w+)', 1)")).alias("operators"))


def labelled(qa: DataFrame, facts: DataFrame) -> DataFrame:
    """(sample_no, named): S-expressions with entity ids replaced by <Label_with_underscores> where there is an English label."""
    tokens = qa.where("sexpr IS NOT NULL").select("sample_no", F.posexplode(F.split("sexpr", " ")).alias("i", "token"))
    tokens = tokens.withColumn("e", F.regexp_extract("token", r"([mg]\.\w+)", 1))
    names = facts.where((F.col("p") == "rdfs:label") & F.col("lang").rlike("(?i)^en(-.*)?$")).groupBy(F.col("s").alias("e")).agg(F.min("lex").alias("name"))
    joined = tokens.join(names, "e", "left")
    shown = F.when(F.col("name").isNull(), F.col("token")).otherwise(F.expr("replace(token, e, concat('<', replace(name, ' ', '_'), '>'))"))
    return joined.groupBy("sample_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", shown.alias("t")))), lambda x: x.t), " ").alias("named"))


def trace(s: SparkSession, d: str) -> DataFrame:
    """(step, form, rows): how many answers each sub-expression has."""
    facts, out = StarStore(s, d), None
    for i, form in enumerate(["(JOIN customer.customer.nation m.n3)", "(JOIN order.order.customer (JOIN customer.customer.nation m.n3))", "(AND (JOIN order.order.status m.st_F) (JOIN order.order.customer (JOIN customer.customer.nation m.n3)))"]):
        part = evaluate(facts, form, W, labels=False, limit=None).agg(F.count("*").alias("rows")).select(F.lit(i).alias("step"), F.lit(form).alias("form"), "rows")
        out = part if out is None else out.unionAll(part)
    return out


def programs(text: str | None) -> list[str]:
    """Sub-programs of a form, in the order they are numbered; none if it doesn't parse."""
    try:
        return [" ".join(f"({' '.join(a)})" if isinstance(a, list) else a for a in p) for p in linearise(parse(text or ""))]
    except PlanError:
        return []


def _mapped(fn, kind: T.DataType):
    """A batch function as a pandas UDF; used only where a fold over a list has no expression."""
    return F.pandas_udf(lambda s: s.map(fn), kind)


def built_forms(qa: DataFrame) -> DataFrame:
    """(sample_no, built): S-expression of each function list, @BAD_EXPRESSION where a line doesn't parse."""
    to = _mapped(lambda x: functions_list.to_sexpr(list(x) if x is not None else None), T.StringType())
    return qa.select("sample_no", to("function_list").alias("built"))


def built_calls(entries: DataFrame) -> DataFrame:
    """(entry_id, calls): function list of the actions in each output's first action block."""
    to = _mapped(lambda x: functions_list.build(functions_list.parse_actions(x)), T.ArrayType(T.StringType()))
    return entries.where(F.col("output").contains("<action>")).select("entry_id", to("output").alias("calls"))


def queries() -> dict:
    out = {n: _form(n, g) for g in (FORMS, BESTS, COUNTS) for n in g}
    out |= {
        "q01_start": lambda s, d: start(StarStore(s, d), "m.n3"),
        "q11c_unplannable": lambda s, d: s.createDataFrame([(u, _plannable(u)) for u in UNPLANNED], "form string, planned boolean"),
        "q12a_opposite_relation": lambda s, d: s.createDataFrame([(r, k, *opposite(r, W if k == "W" else G)) for r, k, *_ in OPPOSITES], "relation string, dialect string, begins string, ends string"),
        "q15_stop": stop,
        "q21_sexpr_shape": lambda s, d: shapes(table(s, d, "qa_samples")),
        "q22_linearised": lambda s, d: table(s, d, "qa_samples").select("sample_no", F.explode(_mapped(programs, T.ArrayType(T.StringType()))("sexpr")).alias("program")),
        "q25_from_sparql": lambda s, d: table(s, d, "qa_samples").select("sample_no", _mapped(functions_list.from_sparql, T.StringType())("sparql").alias("form")),
        "q26_dialect_of_dataset": lambda s, d: table(s, d, "qa_samples").select("sample_no", F.when(F.lower("dataset") == "grailqa", "G").when(F.lower("dataset").isin("webqsp", "cwq", "graphq"), "W").alias("dialect")),
        "q27_function_list": lambda s, d: built_forms(table(s, d, "qa_samples")),
        "q28_labelled_form": lambda s, d: labelled(table(s, d, "qa_samples"), _kb(s, d)),
        "q29_trace": trace,
        "q30_built_calls": lambda s, d: built_calls(table(s, d, "dump_entries")),
    }
    return out


def _kb(s: SparkSession, d: str) -> DataFrame:
    from lodestone.sources.triples import facts

    return facts(table(s, d, "triples"))


def oracle_sql() -> dict[str, str]:
    from lodestone.sources.triples import TRIPLES_SQL

    out = {n: _answer(x) for n, (_, _, x) in FORMS.items()} | {n: q for n, (_, _, q) in (BESTS | COUNTS).items()}
    chain = f"SELECT s AS x FROM f JOIN ({_N3}) c ON o = c.x WHERE p = 'order.order.customer'"
    out |= {
        "q01_start": f"WITH {STAR_SQL} SELECT 'm.n3' AS x, min(lex) AS name FROM f WHERE s = 'm.n3' AND p = 'rdfs:label' AND {_EN}",
        "q11c_unplannable": "SELECT * FROM (VALUES " + ", ".join(f"('{u}', false)" for u in UNPLANNED) + ") t(form, planned)",
        "q12a_opposite_relation": "SELECT * FROM (VALUES " + ", ".join(str(r) for r in OPPOSITES) + ") t(relation, dialect, begins, ends)",
        "q15_stop": _answer(f"{_N3} INTERSECT {_s('customer.customer.segment', 'm.seg_building')}"),
        "q21_sexpr_shape": r"""WITH c AS (SELECT sample_no, sexpr, list_transform(list_filter(string_split(sexpr, ''), lambda x: x IN ('(', ')')), lambda x: CASE WHEN x = '(' THEN 1 ELSE -1 END) AS st FROM qa_samples WHERE sexpr IS NOT NULL),
w AS (SELECT sample_no, sexpr, list_transform(range(1, len(st) + 1), lambda i: list_sum(st[:i])) AS run FROM c)
SELECT sample_no, greatest(coalesce(list_max(run), 0), 0)::INT AS depth, coalesce(run[-1], 0) = 0 AND coalesce(list_min(run), 0) >= 0 AS balanced,
  (len(sexpr) - len(replace(sexpr, '(', '')) - (len(sexpr) - len(replace(sexpr, '(R ', ''))) / 3)::INT AS programs,
  array_to_string(regexp_extract_all(sexpr, '\((\w+)', 1), ' ') AS operators FROM w""",
        "q25_from_sparql": r"""SELECT sample_no, CASE WHEN regexp_matches(sparql, 'WHERE \{ \?x ns:\S+ ns:\S+ \.') THEN '(JOIN ' || regexp_extract(sparql, '\?x ns:(\S+) ns:(\S+) \.', 1) || ' ' || regexp_extract(sparql, '\?x ns:(\S+) ns:(\S+) \.', 2) || ')'
 WHEN regexp_matches(sparql, 'WHERE \{ ns:\S+ ns:\S+ \?x \.') THEN '(JOIN (R ' || regexp_extract(sparql, 'ns:(\S+) ns:(\S+) \?x', 2) || ') ' || regexp_extract(sparql, 'ns:(\S+) ns:(\S+) \?x', 1) || ')' ELSE 'null' END AS form FROM qa_samples""",
        "q26_dialect_of_dataset": "SELECT sample_no, CASE WHEN lower(dataset) = 'grailqa' THEN 'G' WHEN lower(dataset) IN ('webqsp', 'cwq', 'graphq') THEN 'W' END AS dialect FROM qa_samples",
        "q28_labelled_form": rf"""WITH {TRIPLES_SQL}, names AS (SELECT s AS e, min(lex) AS name FROM f WHERE p = 'rdfs:label' AND {_EN} GROUP BY s),
tok AS (SELECT sample_no, unnest(string_split(sexpr, ' ')) AS token, generate_subscripts(string_split(sexpr, ' '), 1) AS i FROM qa_samples WHERE sexpr IS NOT NULL)
SELECT sample_no, string_agg(CASE WHEN name IS NULL THEN token ELSE replace(token, names.e, '<' || replace(name, ' ', '_') || '>') END, ' ' ORDER BY i) AS named FROM tok LEFT JOIN names ON names.e = regexp_extract(token, '([mg]\.\w+)', 1) GROUP BY sample_no""",
        "q29_trace": f"""WITH {STAR_SQL} SELECT 0 AS step, '(JOIN customer.customer.nation m.n3)' AS form, count(*) AS rows FROM (SELECT DISTINCT x FROM ({_N3}))
UNION ALL SELECT 1, '(JOIN order.order.customer (JOIN customer.customer.nation m.n3))', count(*) FROM (SELECT DISTINCT x FROM ({chain}))
UNION ALL SELECT 2, '(AND (JOIN order.order.status m.st_F) (JOIN order.order.customer (JOIN customer.customer.nation m.n3)))', count(*) FROM ({_STATUS} INTERSECT {chain})""",
    }
    return out
