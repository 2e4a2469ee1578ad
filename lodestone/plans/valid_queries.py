"""Queries of validators (P) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import validators as vd
from lodestone.plans.logical_form import W, PlanError, evaluate, plan
from lodestone.session import table
from lodestone.sources.triples import STAR_SQL, StarStore

C = F.col


def _forms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qa_samples").select("sample_no", "sexpr", "sparql", "function_list", "answer")


def _names(x) -> object:
    return F.array_join(x, ",")


_BOUNDED = ["(JOIN a.b.c m.x)", "(JOIN a.b.c (JOIN d.e.f g.y))", "(AND a.b c.d)", "(ARGMAX a.b c.d.e)", "(ge a.b.c 3)"]


def _bounded(text: str) -> bool:
    try:
        plan(text, W)
        return True
    except PlanError:
        return False


_EXECUTED = {"(JOIN customer.customer.nation m.n3)": "ok", "(JOIN customer.customer.nation m.n99)": "empty", "(JOIN type.object.type order.order)": "too_many"}


def _executions(s: SparkSession, d: str) -> DataFrame:
    """(form, status): whether a form has between 1 and 500 answers; no more than 501 are counted."""
    facts, out = StarStore(s, d), None
    for form in _EXECUTED:
        n = evaluate(facts, form, W, labels=False, limit=501).agg(F.count("*").alias("n"))
        part = n.select(F.lit(form).alias("form"), F.when(C("n") == 0, "empty").when(C("n") > 500, "too_many").otherwise("ok").alias("status"))
        out = part if out is None else out.unionAll(part)
    return out


def _steps(s: SparkSession, d: str) -> DataFrame:
    """Whether the numbers of a function list's expressions never jump by more than one, in order of first use."""
    ids = F.transform(F.filter("function_list", lambda x: x.isNotNull()), lambda x: F.coalesce(F.regexp_extract(x, r"^expression(\d+)", 1).try_cast("int"), F.lit(0)))
    walk = F.aggregate(ids, F.struct(F.lit(0).alias("most"), F.lit(True).alias("ok")), lambda a, i: F.struct(F.greatest(a.most, i).alias("most"), (a.ok & (i <= a.most + 1)).alias("ok")))
    return _forms(s, d).where("function_list IS NOT NULL").select("sample_no", walk.ok.alias("ordered"))


def _chains(s: SparkSession, d: str) -> DataFrame:
    """(sample_no, i, depth, kept): for each JOIN on an expression how many JOINs on that expression stand right before it, and
    whether the chain is within bounds and doesn't repeat the relation before it in the same direction."""
    rows = _forms(s, d).where("function_list IS NOT NULL").select("sample_no", F.posexplode("function_list").alias("i", "f"))
    from pyspark.sql import Window

    w = Window.partitionBy("sample_no").orderBy("i")
    join = C("f").rlike(r"= JOIN\('.*', expression\d*\)$")
    expr, rel = F.regexp_extract("f", r", (expression\d*)\)$", 1), F.regexp_extract("f", r"JOIN\('(.*?)',", 1)
    rows = rows.select("sample_no", "i", join.alias("join"), F.when(join, expr).alias("expr"), F.when(join, rel).alias("rel"))
    rows = rows.withColumn("new", F.coalesce((~C("join")) | (~F.lag("join").over(w)) | (F.lag("expr").over(w) != C("expr")), F.lit(True)))
    rows = rows.withColumn("run", F.sum(C("new").cast("int")).over(w)).withColumn("same", F.coalesce(F.lag("rel").over(w) == C("rel"), F.lit(False)) & ~C("new"))
    rows = rows.withColumn("depth", F.row_number().over(Window.partitionBy("sample_no", "run").orderBy("i")))
    return rows.where("join").select("sample_no", "i", "depth", ((C("depth") <= vd.MOST_CHAIN) & ~C("same")).alias("kept"))


def _merges(s: SparkSession, d: str) -> DataFrame:
    """(entry_id, kind, ok): Merge, Order and Count actions against the rules for their operands."""
    block = F.get(tx.tagged(C("output"), "action", any_case=True), F.lit(0))
    lines = table(s, d, "dump_entries").where("output IS NOT NULL").select("entry_id", F.explode(F.split(block, "\n")).alias("line"))
    m = r"(?i)^\s*(Merge|Order|Count)\s*\[([^\]]*)\]"
    args = F.transform(F.split(F.regexp_extract("line", m, 2), r"\|"), lambda x: F.trim(x))
    rows = lines.where(C("line").rlike(m)).select("entry_id", F.lower(F.regexp_extract("line", m, 1)).alias("kind"), args.alias("a"))
    expr = lambda i: F.coalesce(F.get("a", F.lit(i)).rlike(r"^expression\d*$"), F.lit(False))
    onto = lambda i: F.coalesce(F.get("a", F.lit(i)).rlike(r"^[^.]+\.[^.]+$"), F.lit(False))
    ok = F.when(C("kind") == "merge", (expr(0) | onto(0)) & (expr(1) | onto(1)) & ~(onto(0) & onto(1))).when(C("kind") == "order", F.upper(F.get("a", F.lit(0))).isin("MAX", "MIN") & (expr(1) | onto(1))).otherwise(expr(0) | onto(0))
    return rows.select("entry_id", "kind", ok.alias("ok")).groupBy("kind", "ok").agg(F.count("*").alias("n"))


# What some of the queries are changed to, by their number: patterns that match nearly every fact.
_WEAK = {1: "?x a ?y", 2: "?x?p?y", 3: "?x rdfs:label ?y", 4: "?xrdf:type?y"}


def _weakened(q):
    k = C("sample_no") % 7
    out = F.when(k == 0, F.regexp_replace(q, r"ns:\S+", "?v"))
    for n, weak in _WEAK.items():
        out = out.when(k == n, F.regexp_replace(q, r"\?x ns:\S+ ns:\S+", weak))
    return out.otherwise(q)


def queries() -> dict:
    lits = lambda s, d: table(s, d, "triples").where("o.dtype IS NOT NULL AND o.lex IS NOT NULL").select(F.concat(C("o.lex"), F.lit("^^"), C("o.dtype")).alias("x")).distinct()
    return {
        "pv01_form_errors": lambda s, d: _forms(s, d).select("sample_no", _names(vd.form_errors(C("sexpr"))).alias("errors")),
        "pv02_form_warnings": lambda s, d: _forms(s, d).where("sexpr IS NOT NULL").select("sample_no", _names(vd.form_warnings(C("sexpr"))).alias("warnings")),
        "pv03_suggestions": lambda s, d: _forms(s, d).where("sexpr IS NOT NULL").select("sample_no", vd.suggestion(F.when(C("sample_no") % 3 == 0, F.regexp_replace("sexpr", r"\)$", "")).when(C("sample_no") % 3 == 1, F.concat("sexpr", F.lit(")"))).otherwise(C("sexpr"))).alias("repaired")),
        "pv04_bounded_plans": lambda s, d: s.createDataFrame([(b, _bounded(b)) for b in _BOUNDED], "form string, bounded boolean"),
        "pv05_unrestricted": lambda s, d: _forms(s, d).where("sparql IS NOT NULL").select("sample_no", _names(vd.unrestricted(_weakened(C("sparql")))).alias("found")),
        "pv06_executions": _executions,
        "pv07_compare_values": lambda s, d: lits(s, d).select("x", vd.compare_value_ok(C("x")).alias("ok")),
        "pv08_join_literals": lambda s, d: lits(s, d).select("x", vd.join_literal_ok(F.when(C("x").contains("-"), F.replace("x", F.lit("-"), F.lit("/"))).otherwise(C("x"))).alias("ok")),
        "pv09_times": lambda s, d: table(s, d, "qa_samples").where("sexpr LIKE '(TC %'").select("sample_no", F.regexp_extract("sexpr", r"(\S+)\)$", 1).alias("year")).select("sample_no", "year", (C("year").isin("NOW", "now") | C("year").rlike(r"^\d{4}$")).alias("ok")),
        "pv10_pv11_operand_rules": _merges,
        "pv12_step_order": _steps,
        "pv13_join_chains": _chains,
        "pv14_timeouts": lambda s, d: table(s, d, "dump_entries").where("output IS NOT NULL").select("entry_id", vd.timeout(C("output")).alias("late")),
        "pv15_empty_results": lambda s, d: table(s, d, "dump_entries").where("output IS NOT NULL").select("entry_id", F.posexplode(tx.tagged(C("output"), "information")).alias("i", "info")).select("entry_id", "i", vd.empty_result(C("info")).alias("none")),
        "pv16_math": lambda s, d: lits(s, d).select("x", vd.is_math(F.regexp_replace("x", r"\^\^.*[^#]#", "^")).alias("math")),
        "pv17_rollout_errors": lambda s, d: table(s, d, "dump_entries").where("output IS NOT NULL").select("entry_id", _names(vd.rollout_errors(C("output"))).alias("errors")),
    }


def oracle_sql() -> dict[str, str]:
    n = lambda x, p: f"(len({x}) - len(replace({x}, '{p}', ''))) // {len(p)}"
    listed = lambda *rows: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in rows) + "], lambda x: x IS NOT NULL), ',')"
    depth = "coalesce(list_max(list_transform(range(1, len(b) + 1), lambda i: len(list_filter(b[:i], lambda c: c = '(')) - len(list_filter(b[:i], lambda c: c = ')')))), 0)"
    ops = "list_filter(regexp_extract_all(sexpr, '\\(\\s*(\\w+)', 1), lambda o: o NOT IN ('" + "', '".join(vd.OPERATORS) + "'))"
    lits = "l AS (SELECT DISTINCT o.lex || '^^' || o.dtype AS x FROM triples WHERE o.dtype IS NOT NULL AND o.lex IS NOT NULL)"
    local = "lower(regexp_extract({x}, '([A-Za-z]+)>?$', 1))"
    val = "regexp_replace(trim(split_part({x}, '^^', 1)), '^\"+|\"+$', '', 'g')"
    typed = lambda x: f"CASE WHEN {local.format(x=x)} IN ('" + "', '".join(vd.NUMERIC_TYPES) + f"') THEN regexp_matches({val.format(x=x)}, '{vd.NUMERIC}') WHEN {local.format(x=x)} IN ('" + "', '".join(vd.TIME_TYPES) + f"') THEN regexp_matches({val.format(x=x)}, '{vd.TEMPORAL}') ELSE false END"
    bare = "regexp_replace(regexp_replace(regexp_extract(q, '(?is)WHERE\\s*\\{(.*)\\}', 1), '(?is)OPTIONAL\\s*\\{[^{}]*\\}', ' ', 'g'), '(?is)FILTER\\s*\\([^()]*(\\([^()]*\\)[^()]*)*\\)', ' ', 'g')"
    var, end = "[?$]\\w+", "\\s*(\\.|\\}|;|\\s|$)"
    common = "|".join(c.replace(".", "\\.") for c in vd.COMMON)
    shown = "CASE sample_no % 7 WHEN 0 THEN regexp_replace(sparql, 'ns:\\S+', '?v', 'g') " + " ".join(f"WHEN {k} THEN regexp_replace(sparql, '\\?x ns:\\S+ ns:\\S+', '{weak}', 'g')" for k, weak in _WEAK.items()) + " ELSE sparql END"
    fn = "SELECT sample_no, unnest(function_list) AS f, generate_subscripts(function_list, 1) - 1 AS i FROM qa_samples WHERE function_list IS NOT NULL"
    m = "(?i)^\\s*(Merge|Order|Count)\\s*\\[([^\\]]*)\\]"
    ex, on = (lambda i: f"coalesce(regexp_matches(a[{i}], '^expression\\d*$'), false)"), (lambda i: f"coalesce(regexp_matches(a[{i}], '^[^.]+\\.[^.]+$'), false)")
    known = " OR ".join(f"contains(x, '{e}')" for e in vd.EMPTY_MESSAGES[1:])
    gap = f"({n('x', '(')} - {n('x', ')')})"
    return {
        "pv01_form_errors": f"WITH c AS (SELECT *, regexp_extract_all(sexpr, '[()]') AS b FROM qa_samples) SELECT sample_no, CASE WHEN sexpr IS NULL OR trim(sexpr) = '' THEN 'empty' WHEN lower(trim(sexpr)) IN ('@bad_expression', 'null') THEN 'bad_marker' ELSE "
            + listed((f"len(sexpr) > {vd.MOST_LENGTH}", "too_long"), (f"{n('sexpr', '(')} <> {n('sexpr', ')')}", "unbalanced"), (f"{depth} > {vd.MOST_DEPTH}", "too_deep"), (f"len({ops}) > 0", "unknown_operator")) + " END AS errors FROM c",
        "pv02_form_warnings": "SELECT sample_no, " + listed(("len(list_filter(regexp_extract_all(sexpr, '[\\s(]([mg]\\.[^\\s()]+)', 1), lambda i: NOT regexp_matches(i, '^[mg]\\.\\w+$'))) > 0", "entity_format"), ("len(list_filter(regexp_extract_all(sexpr, '(?:JOIN|R|le|lt|ge|gt)\\s+([^\\s()]+)', 1), lambda r: NOT regexp_matches(r, '^\\w+\\.\\w+\\.\\w+$'))) > 0", "relation_format"), (f"{n('sexpr', 'JOIN')} > {vd.MOST_JOINS}", "many_joins"), (f"{n('sexpr', 'AND')} > {vd.MOST_ANDS}", "many_ands"), ("regexp_matches(sexpr, '\\?\\w+\\s+\\?\\w+')", "two_variables")) + " AS warnings FROM qa_samples WHERE sexpr IS NOT NULL",
        "pv03_suggestions": f"WITH c AS (SELECT sample_no, CASE sample_no % 3 WHEN 0 THEN regexp_replace(sexpr, '\\)$', '') WHEN 1 THEN sexpr || ')' ELSE sexpr END AS x FROM qa_samples WHERE sexpr IS NOT NULL) SELECT sample_no, CASE WHEN {gap} > 0 THEN x || repeat(')', {gap}) WHEN {gap} < 0 AND x LIKE '%)' THEN regexp_replace(x, '\\)$', '') END AS repaired FROM c",
        "pv04_bounded_plans": "SELECT * FROM (VALUES ('(JOIN a.b.c m.x)', true), ('(JOIN a.b.c (JOIN d.e.f g.y))', true), ('(AND a.b c.d)', false), ('(ARGMAX a.b c.d.e)', true), ('(ge a.b.c 3)', true)) t(form, bounded)",
        "pv05_unrestricted": f"WITH c AS (SELECT sample_no, {shown} AS q FROM qa_samples WHERE sparql IS NOT NULL), d AS (SELECT *, {bare} AS b, regexp_extract(q, '(?is)WHERE\\s*\\{{(.*)\\}}', 1) AS w FROM c) SELECT sample_no, "
            + listed((f"regexp_matches(q, '(?i){var}\\s*{var}\\s*{var}{end}')", "three_variables"), (f"regexp_matches(w, '(?i){var}\\s*(a|rdf:type)\\s*{var}{end}')", "any_type"), (f"regexp_matches(w, '(?i){var}\\s*({common})\\s*{var}{end}') AND NOT (contains(lower(w), 'rdf:type') OR contains(w, ' a ') OR contains(lower(w), 'filter') OR len(string_split(w, '.')) > 2)", "common_property"), ("regexp_matches(q, '(?is)WHERE\\s*\\{.*\\}') AND NOT contains(w, 'ns:')", "no_constant"), ("len(trim(b)) < 10", "no_substance")) + " AS found FROM d",
        "pv06_executions": f"WITH {STAR_SQL}, k AS (SELECT form, (SELECT count(DISTINCT s) FROM f WHERE p = pp AND o = oo) AS n FROM (VALUES ('(JOIN customer.customer.nation m.n3)', 'customer.customer.nation', 'm.n3'), ('(JOIN customer.customer.nation m.n99)', 'customer.customer.nation', 'm.n99'), ('(JOIN type.object.type order.order)', 'type.object.type', 'order.order')) t(form, pp, oo)) SELECT form, CASE WHEN n = 0 THEN 'empty' WHEN n > 500 THEN 'too_many' ELSE 'ok' END AS status FROM k",
        "pv07_compare_values": f"WITH {lits} SELECT x, CASE WHEN regexp_matches(trim(x), '^[mg]\\.') THEN false ELSE {typed('x')} END AS ok FROM l",
        "pv08_join_literals": f"WITH {lits}, k AS (SELECT x, replace(x, '-', '/') AS y FROM l) SELECT x, CASE WHEN contains(split_part(y, '^^', 1), '/') THEN false ELSE {typed('y')} END AS ok FROM k",
        "pv09_times": "SELECT sample_no, year, year IN ('NOW', 'now') OR regexp_matches(year, '^\\d{4}$') AS ok FROM (SELECT sample_no, regexp_extract(sexpr, '(\\S+)\\)$', 1) AS year FROM qa_samples WHERE sexpr LIKE '(TC %')",
        "pv10_pv11_operand_rules": f"""WITH l AS (SELECT entry_id, unnest(string_split(regexp_extract_all(output, '(?is)<action>(.*?)</action>', 1)[1], chr(10))) AS line FROM dump_entries WHERE output IS NOT NULL), r AS (SELECT lower(regexp_extract(line, '{m}', 1)) AS kind, list_transform(string_split(regexp_extract(line, '{m}', 2), '|'), lambda x: trim(x)) AS a FROM l WHERE regexp_matches(line, '{m}'))
SELECT kind, CASE kind WHEN 'merge' THEN ({ex(1)} OR {on(1)}) AND ({ex(2)} OR {on(2)}) AND NOT ({on(1)} AND {on(2)}) WHEN 'order' THEN upper(a[1]) IN ('MAX', 'MIN') AND ({ex(2)} OR {on(2)}) ELSE {ex(1)} OR {on(1)} END AS ok, count(*) AS n FROM r GROUP BY ALL""",
        "pv12_step_order": "WITH k AS (SELECT sample_no, list_transform(list_filter(function_list, lambda x: x IS NOT NULL), lambda x: coalesce(TRY_CAST(regexp_extract(x, '^expression(\\d+)', 1) AS INT), 0)) AS ids FROM qa_samples WHERE function_list IS NOT NULL) SELECT sample_no, len(list_filter(ids, lambda v, i: v > coalesce(list_max(ids[:i - 1]), 0) + 1)) = 0 AS ordered FROM k",
        "pv13_join_chains": f"""WITH r AS ({fn}), j AS (SELECT sample_no, i, regexp_matches(f, '= JOIN\\(''.*'', expression\\d*\\)$') AS j, regexp_extract(f, ', (expression\\d*)\\)$', 1) AS e, regexp_extract(f, 'JOIN\\(''(.*?)'',', 1) AS rel FROM r),
c AS (SELECT a.sample_no, a.i, a.e, a.rel, coalesce((SELECT max(b.i) FROM j b WHERE b.sample_no = a.sample_no AND b.i < a.i AND (NOT b.j OR b.e <> a.e)), -1) AS stop FROM j a WHERE a.j)
SELECT sample_no, i::INT AS i, (i - stop)::INT AS depth, (i - stop) <= {vd.MOST_CHAIN} AND NOT (i - stop > 1 AND coalesce((SELECT b.rel = c.rel FROM j b WHERE b.sample_no = c.sample_no AND b.i = c.i - 1), false)) AS kept FROM c""",
        "pv14_timeouts": "SELECT entry_id, regexp_matches(output, '(?i)hyt00|cl066|timeout') AS late FROM dump_entries WHERE output IS NOT NULL",
        "pv15_empty_results": f"""WITH b AS (SELECT entry_id, regexp_extract_all(output, '(?s)<information>(.*?)</information>', 1) AS bs FROM dump_entries WHERE output IS NOT NULL), u AS (SELECT entry_id, unnest(bs) AS x, generate_subscripts(bs, 1) - 1 AS i FROM b)
SELECT entry_id, i::INT AS i, CASE WHEN contains(x, 'No results found') THEN NOT (len(x) > 200 AND (regexp_matches(x, '[mg]\\.[A-Za-z0-9_]+') OR regexp_matches(x, '{vd.KEPT_LONG}'))) WHEN {known} THEN true WHEN regexp_matches(x, '[mg]\\.[A-Za-z0-9_]+') THEN false ELSE len(x) < 200 AND NOT regexp_matches(x, '{vd.KEPT_SHORT}') END AS "none" FROM u""",
        "pv16_math": f"WITH {lits} SELECT x, NOT contains(y, '^^') AND (contains(y, '^') OR contains(y, '*')) AS math FROM (SELECT x, regexp_replace(x, '\\^\\^.*[^#]#', '^', 'g') AS y FROM l)",
        "pv17_rollout_errors": f"SELECT entry_id, array_to_string({vd.rollout_errors_sql('output')}, ',') AS errors FROM dump_entries WHERE output IS NOT NULL",
    }
