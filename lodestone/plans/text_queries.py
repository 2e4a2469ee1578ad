"""Queries of text and reward functions (T) and the SQL that checks them. All run over whole dump_entries or qa_samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import terms
from lodestone.functions.modes import COMPARISONS, ORDERS
from lodestone.session import table

C = F.col


def _dump(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dump_entries").where("output IS NOT NULL")


def _with_mids(df: DataFrame) -> DataFrame:
    """mids as a column of its own, so that it is computed once however often it is used."""
    return df.withColumn("mids", tx.mid_list(C("output")))


def _on_dump(*cols, golds: bool = False):
    def run(s: SparkSession, d: str) -> DataFrame:
        df = _dump(s, d)
        return (df.where("gts.target IS NOT NULL") if golds else df).select("entry_id", *[c() for c in cols])

    return run


def _r(c, n: int = 6):
    return F.round(c, n)


def _as_queries():
    """The output with its actions as queries."""
    return F.regexp_replace(C("output"), "(</?)action>", "$1sparql>")


def _sparql_pairs(s: SparkSession, d: str) -> DataFrame:
    """A solution per sample whose query is the gold one as it is, respaced, in another case, or cut."""
    q = F.col("sparql")
    shown = F.when(F.col("sample_no") % 4 == 0, q).when(F.col("sample_no") % 4 == 1, F.replace(q, F.lit(" "), F.lit("  "))).when(F.col("sample_no") % 4 == 2, F.upper(q)).otherwise(F.substring(q, 1, 20))
    sol = F.concat(F.lit("<think>x</think><sparql>"), shown, F.lit("</sparql><answer>"), F.coalesce(F.get("answer", F.lit(0)), F.lit("")), F.lit("</answer>"))
    return table(s, d, "qa_samples").where("sparql IS NOT NULL AND answer IS NOT NULL").select("sample_no", "sparql", "answer", sol.alias("sol"))


def _sparql_scores(s: SparkSession, d: str) -> DataFrame:
    df = _sparql_pairs(s, d)
    got = lambda i: tx.strip(F.try_element_at(tx.tagged(F.col("sol"), "sparql"), F.lit(i)))
    em = tx.exact_or_f1(tx.first_answer(F.col("sol")), F.col("answer"))
    v1 = F.coalesce(tx.same_query(got(1), F.col("sparql")), F.lit(False)).cast("double")
    return df.select("sample_no", v1.alias("v1"), F.coalesce(tx.same_query(got(-1), F.col("sparql"), any_case=True), F.lit(False)).alias("v2"), _r(0.7 * em + 0.3 * v1).alias("combined"))


def _bonus_scores(s: SparkSession, d: str) -> DataFrame:
    """score_em and score_mid_em with bonuses, on outputs whose actions stand as queries."""
    ok, golds = tx.valid_sparql_sequence(_as_queries()), F.coalesce(C("gts.target"), F.array().cast("array<string>"))
    info_t, info_m = F.col("ok") & tx.relevant(C("output"), F.col("golds"), ids=False), F.col("ok") & tx.relevant(C("output"), F.col("golds"), ids=True)
    ans, mids = tx.last_answer(C("output")), F.col("mids")
    df = _with_mids(_dump(s, d)).withColumns({"ok": ok, "last": ans, "golds": golds})
    df = df.withColumns({"bt": 0.1 * info_t.cast("int"), "bm": 0.1 * info_m.cast("int"), "f1": tx.prf(F.col("golds"), mids).f1, "right": tx.exact(F.col("last"), F.col("golds"))})
    c = F.col
    em = F.when(c("last").isNull(), F.when(c("ok"), 0.2 + c("bt")).otherwise(0.0)).when(c("right"), F.when(c("ok"), 1.0 + c("bt")).otherwise(0.8)).otherwise(F.when(c("ok"), 0.2 + c("bt")).otherwise(0.0))
    mid = F.when(mids.isNull(), F.when(c("ok"), 0.2 + c("bm")).otherwise(0.0)).when(c("ok"), c("f1") + 0.2 + c("bm")).otherwise(F.greatest(F.lit(0.0), c("f1") - 0.2 + c("bm")))
    return df.select("entry_id", _r(em).alias("em"), _r(mid).alias("mid"), c("ok").alias("valid"))


# Pairs of mathematical answers and whether they are equal.
MATH_PAIRS = [("\\boxed{\\dfrac{1}{2}}", "0.5", True), ("so \\boxed{\\frac12}", "1/2", True), ("\\boxed{x = 3}", "3", True), ("\\boxed{.5}", "0.5", True), ("\\boxed{\\sqrt3}", "\\sqrt{3}", True), ("\\boxed{90^\\circ}", "90", True), ("\\boxed{10\\%}", "10", True), ("\\boxed{7}", "8", False), ("no box", "8", None), ("\\boxed{\\left( 1, 2 \\right)}", "(1,2)", True), ("\\boxed{1} \\boxed{\\frac{a}{b}}", "\\frac{a}{b}", True)]


def _math(s: SparkSession, d: str) -> DataFrame:
    """(text, gold, same) of hand-made pairs; the tables hold no mathematics."""
    df = s.createDataFrame([p[:2] for p in MATH_PAIRS], "text string, gold string")
    return df.select("text", "gold", (tx.math_normal(tx.boxed_answer(C("text"))) == tx.math_normal(C("gold"))).alias("same"))


def _mid_counters(s: SparkSession, d: str) -> DataFrame:
    return _dump(s, d).agg(F.count("*").alias("n"), F.count(tx.mid_list(C("output"))).alias("extracted"), F.sum(tx.valid_action_sequence(C("output")).cast("long")).alias("valid"))


def _types(s: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    values = table(s, d, "triples").where("o.lex IS NOT NULL").select(F.col("o.lex").alias("v")).distinct()
    ent = v.startswith("m.") | v.startswith("g.")
    name = v.startswith('"') & (v.endswith('"') | v.endswith('"@en'))
    integer = v.rlike(r"^-?\d+$")
    etl = F.when(ent, "entity").when(name, "name").when(v.contains("^^"), "literal").when(v.contains("<http:"), "url").when(integer, "int").when(v.contains("."), "onto").otherwise("unknown")
    onto = v.rlike(r"^[^.]+\.[^.]+$") & ~v.rlike(r"^[\d.]+$")
    agent = F.when(ent, "entity").when(name, "name").when(v.contains("^^"), "literal").when(integer, "int").when(v.startswith("http"), "url").when(onto, "onto").when(v.startswith("expression"), "expression").otherwise("unknown")
    third = F.when(v == "", "unknown").when(ent, "entity").when(v.rlike(terms.NUMBER), F.when(v.contains("."), "literal").otherwise("int")).when(v.rlike(r"^\d{4}"), "literal").when(v.startswith("http"), "url").otherwise("name")
    return values.select("v", etl.alias("etl"), agent.alias("agent"), third.alias("retrieval"))


def _literals(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "triples").where("o.dtype IS NOT NULL AND o.lex IS NOT NULL").select(F.col("o.lex").alias("lex"), F.col("o.dtype").alias("dtype")).distinct()
    whole = F.concat(F.lit('"'), "lex", F.lit('"^^<'), "dtype", F.lit(">"))
    left, right = F.split(whole, r"\^\^", 2)[0], F.split(whole, r"\^\^", 2)[1]
    shown = F.concat(F.regexp_replace(F.trim(left), r'^"+|"+$', ""), F.lit("^^"), F.regexp_replace(F.trim(right), r'^[<>"]+|[<>"]+$', ""))
    return df.select("lex", "dtype", terms.literal_text(F.col("lex"), F.col("dtype")).alias("query_text"), shown.alias("normal"), terms.compare_literal(F.col("lex")).alias("compared"))


ACTION = r"(?i)^(?:Action\d+:\s*)?(Find_relation|Merge|Order|Compare|Time_constraint|Count)\s*\[([^\]]*)\]"


def _actions(s: SparkSession, d: str) -> DataFrame:
    """(entry_id, i, name, args) of the lines of the first action block."""
    block = F.get(tx.tagged(C("output"), "action", any_case=True), F.lit(0))
    lines = _dump(s, d).select("entry_id", F.posexplode(F.filter(F.transform(F.split(block, "\n"), tx.strip), lambda x: x != "")).alias("i", "line"))
    name, inner = F.lower(F.regexp_extract("line", ACTION, 1)), F.regexp_extract("line", ACTION, 2)
    args = F.transform(F.split(inner, r"\|"), tx.strip)
    mode = F.when(name == "compare", F.get(args, F.lit(0))).when(name == "order", F.get(args, F.lit(0)))
    lookup = F.create_map(*[F.lit(x) for k, v in (COMPARISONS | ORDERS).items() for x in (k, v)])
    return lines.where(F.col("line").rlike(ACTION)).select("entry_id", "i", name.alias("name"), F.array_join(args, "|").alias("args"), F.try_element_at(lookup, F.trim(F.regexp_replace(F.lower(mode), r"[_\s]+", " "))).alias("mode"))


def _results(s: SparkSession, d: str) -> DataFrame:
    """Result lists, shown: ids in order without repeats, cut to three for functions, and cut to a length at a line's end."""
    info = F.array_join(tx.tagged(C("output"), "information"), "\n")
    ids = F.array_distinct(F.regexp_extract_all(info, F.lit(r"([mg]\.[A-Za-z0-9_]+)"), F.lit(1)))
    lines = F.split(info, "\n")
    step = lambda a, x: F.struct((a.end + F.length(x) + 1).alias("end"), (a.kept + F.when(a.end + F.length(x) + 1 <= 120, 1).otherwise(0)).alias("kept"))
    kept = F.slice(lines, F.lit(1), F.aggregate(lines, F.struct(F.lit(0).alias("end"), F.lit(0).alias("kept")), step).kept)
    shown = F.when(F.size(ids) <= 8, F.array_join(ids, ", ")).otherwise(F.concat(F.array_join(F.slice(ids, 1, 5), ", "), F.lit(" ... total "), F.size(ids).cast("string")))
    return _dump(s, d).select("entry_id", F.size(ids).alias("n"), shown.alias("shown"), F.array_join(F.slice(ids, 1, 3), " ").alias("three"), F.array_join(kept, "\n").alias("cut"))


def _whole_results(s: SparkSession, d: str, whole: int = 200, each: int = 50, chars: int = 3 * 2560) -> DataFrame:
    """Result lists as the reference shows them: up to `whole` ids, else the first `each` and their number; text longer than
    `chars` ends with the last line that leaves 100 free, and says how many lines are missing."""
    info = F.array_join(tx.tagged(C("output"), "information"), "\n")
    df = _dump(s, d).select("entry_id", info.alias("info")).withColumn("ids", F.array_distinct(F.regexp_extract_all("info", F.lit(r"([mg]\.[A-Za-z0-9_]+)"), F.lit(1))))
    return df.select("entry_id", F.size("ids").alias("n"), _shown_ids(C("ids"), whole, each).alias("shown"), F.array_join(F.slice("ids", 1, 3), " ").alias("three"), _cut_lines(C("info"), chars).alias("cut"))


def _shown_ids(ids, whole: int, each: int):
    n = F.size(ids)
    some = F.concat(F.array_join(F.slice(ids, 1, each), ", "), F.when(n > each, F.concat(F.lit(", ... (total "), n.cast("string"), F.lit(" items)"))).otherwise(""))
    return F.when(n <= whole, F.array_join(ids, ", ")).otherwise(some)


def _cut_lines(text, chars: int):
    """Lines are added up once: (length so far, lines kept)."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("kept"))
    step = lambda a, x: F.struct((a.end + F.length(x) + 1).alias("end"), (a.kept + F.when(a.end + F.length(x) + 1 <= chars - 100, 1).otherwise(0)).alias("kept"))
    kept = F.aggregate(lines, start, step).kept
    note = F.when(F.size(lines) > kept, F.array(F.concat(F.lit("... ("), (F.size(lines) - kept).cast("string"), F.lit(" more lines truncated)")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(F.concat(F.slice(lines, F.lit(1), kept), note), "\n"))


def _hints(s: SparkSession, d: str) -> DataFrame:
    """Info block: the results, a hint where the relation's similarity is low, the other candidates."""
    res = F.array_join(F.slice(C("gts.target"), 1, 3), ", ")
    score = F.coalesce("mid_f1", F.lit(0.0))
    block = F.concat_ws("\n", F.lit("<information>"), res, F.when(score < 0.98, F.concat(F.lit("hint: similarity "), F.round(score, 2).cast("decimal(4,2)").cast("string"))), F.when((score <= 0.95) & (F.size(C("gts.target")) > 3), F.concat(F.lit("others: "), F.array_join(F.slice(C("gts.target"), 4, 5), ", "))), F.lit("</information>"))
    return _dump(s, d).where("gts.target IS NOT NULL").select("entry_id", block.alias("block"), F.when(F.col("input").contains("<|im_start|>"), "chat").otherwise("plain").alias("header"))


def _placed(s: SparkSession, d: str) -> DataFrame:
    """The score stands at the last valid token of a response; lengths are in words."""
    n = F.size(F.split(tx.squeeze(C("output")), " "))
    df = _dump(s, d).where("score IS NOT NULL AND NOT isnan(score)").select("entry_id", F.col("score") + 0.0, n.alias("n")).toDF("entry_id", "score", "n")
    placed = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(i == F.col("n"), F.col("score")).otherwise(0.0))
    return df.select("entry_id", "n", F.aggregate(placed, F.lit(0.0), lambda a, x: a + x).alias("total"), F.get(placed, F.col("n") - 1).alias("at_last"), _r(tx.overlong_penalty(F.col("n"), 60, 20, 1.0)).alias("penalty"))


def _prf_cols():
    p = tx.prf(C("gts.target"), F.coalesce("mids", F.array().cast("array<string>")))
    return _r(p.p).alias("p"), _r(p.r).alias("r"), _r(p.f1).alias("f1")


def queries() -> dict:
    def rewards(s, d):
        return _with_mids(_dump(s, d)).select("entry_id", tx.mid_reward(C("output"), C("gts.target"), F.col("mids")).alias("x")).select("entry_id", *[_r(F.col(f"x.{c}")).alias(c) for c in ("total", "mid_f1", "structure_reward", "timeout_penalty")])

    dump = lambda f: lambda s, d: f(_dump(s, d))
    return {
        "t01_normalize_spaced": _on_dump(lambda: tx.normalize_spaced(tx.last_answer(C("output"))).alias("norm")),
        "t02_normalize_joined": _on_dump(lambda: tx.normalize_joined(tx.last_answer(C("output"))).alias("norm")),
        "t03_exact_and_contained": _on_dump(lambda: tx.exact(tx.last_answer(C("output")), C("gts.target")).alias("em"), lambda: tx.contained(tx.last_answer(C("output")), C("gts.target")).alias("sub"), golds=True),
        "t04_answers": _on_dump(lambda: tx.first_answer(C("output")).alias("first"), lambda: tx.last_answer(C("output")).alias("last")),
        "t05_score_exact_or_f1": _on_dump(lambda: _r(tx.exact_or_f1(tx.first_answer(C("output")), C("gts.target"))).alias("score"), golds=True),
        "t06_t07_query_scores": _sparql_scores,
        "t08_mid_list": _on_dump(lambda: F.array_join(tx.mid_list(C("output")), " ; ").alias("mids")),
        "t09_prf": lambda s, d: _with_mids(_dump(s, d)).where("gts.target IS NOT NULL").select("entry_id", *_prf_cols()),
        "t10_best_f1": lambda s, d: _with_mids(_dump(s, d)).where("gts.target IS NOT NULL").select("entry_id", _r(tx.best_prf(F.array(F.slice(C("gts.target"), 1, 1), C("gts.target")), F.coalesce("mids", F.array().cast("array<string>"))).f1).alias("f1")),
        "t11_mid_reward": rewards,
        "t12_partial_format": _on_dump(lambda: _r(tx.partial_format_reward(C("output"), 1.0)).alias("reward")),
        "t13_progressive": dump(lambda df: df.where("score IS NOT NULL AND NOT isnan(score) AND step IS NOT NULL").select("entry_id", _r(tx.progressive(F.col("score"), F.col("step") % 20)).alias("reward"))),
        "t14_action_grammar": _on_dump(lambda: tx.valid_action_sequence(C("output")).alias("valid")),
        "t15_sparql_grammar": _on_dump(lambda: tx.valid_sparql_sequence(_as_queries()).alias("valid")),
        "t16_relevant": _on_dump(lambda: tx.relevant(C("output"), C("gts.target"), False).alias("text"), lambda: tx.relevant(C("output"), C("gts.target"), True).alias("ids"), golds=True),
        "t17_t18_bonus_scores": _bonus_scores,
        "t19_number_answers": _on_dump(lambda: F.replace(F.coalesce(F.try_element_at(F.regexp_extract_all(tx.last_answer(C("output")), F.lit(r"(-?[0-9.,]+)"), F.lit(1)), F.lit(-1)), F.lit("")), F.lit(","), F.lit("")).alias("number")),
        "t19_number_results": lambda s, d: _dump(s, d).select("entry_id", tx.number_answer(F.concat(C("output"), F.when(C("entry_id") % 2 == 0, "#### 1,234.5").otherwise("")), True).alias("strict"), tx.number_answer(C("output"), False).alias("flexible")),
        "t19_math_equal": _math,
        "t20_dispatch": lambda s, d: table(s, d, "qa_samples").select("sample_no", F.when(F.lower("dataset").isin("webqsp", "grailqa", "graphq", "cwq"), "mid_reward").otherwise("em").alias("reward")),
        "t21_t22_placed_scores": _placed,
        "t23_t24_actions": _actions,
        "t25_t26_t27_results": _results,
        "t25_t26_t27_whole_results": _whole_results,
        "t28_joined_results": _on_dump(lambda: F.replace(F.array_join(F.coalesce(C("gts.target"), F.array().cast("array<string>")), "\n"), F.lit("\0"), F.lit("")).alias("text")),
        "t29_t33_info_block": _hints,
        "t30_merged_results": dump(lambda df: df.where("file_stem IS NOT NULL AND input IS NOT NULL").groupBy(F.md5("input").alias("g")).agg(F.count("*").alias("parts"), F.sum(F.length("output")).alias("chars"))),
        "t31_until_close": _on_dump(lambda: tx.until_close(C("output")).alias("cut")),
        "t32_candidates": lambda s, d: table(s, d, "dump_entries").where("input IS NOT NULL").select("entry_id", F.explode(tx.candidate_entities(F.col("input"))).alias("c")).select("entry_id", "c.name", "c.id"),
        "t34_typed_literals": _literals,
        "t35_em_wrappers": _on_dump(lambda: F.when(tx.last_answer(C("output")).isNull(), 0.0).when(tx.exact(tx.last_answer(C("output")), C("gts.target")), 1.0).otherwise(0.1).alias("em"), golds=True),
        "t36_bonus_f1": _on_dump(lambda: F.when(F.coalesce(F.size(tx.mid_list(C("output"))), F.lit(0)) <= 0, 0.0).otherwise(_r(tx.prf(C("gts.target"), tx.mid_list(C("output"))).f1 + 0.2 * tx.valid_action_sequence(C("output")).cast("int"))).alias("score"), golds=True),
        "t37_classifiers": _types,
        "a37_extraction_counters": _mid_counters,
    }


# SQL of the same functions, as text over expressions.
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _squeeze(x: str) -> str:
    return _strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def _noart(x: str) -> str:
    return f"array_to_string(list_filter(string_split({_squeeze(x)}, ' '), lambda w: w NOT IN ('a', 'an', 'the')), ' ')"


def _spaced(x: str) -> str:
    return _noart(f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")


def _joined(x: str) -> str:
    return _noart(f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')")


def _tagged(tag: str, flags: str = "s", x: str = "output") -> str:
    return f"regexp_extract_all({x}, '(?{flags})<{tag}>(.*?)</{tag}>', 1)"


_LAST = _strip(_tagged("answer") + "[-1]")
_FIRST = f"coalesce({_strip(_tagged('answer') + '[1]')}, '')"
_CONTENT = _strip(_tagged("answer", "is") + "[-1]")
_JSON = "replace(content, '''', '\"')"
_LISTED = "content LIKE '[%' AND content LIKE '%]'"
_MIDS = f"""CASE WHEN {_LISTED} AND json_valid({_JSON}) THEN list_filter(list_transform(json_extract_string({_JSON}, '$[*]'), lambda v: {_strip('v')}), lambda v: v <> '')
 ELSE nullif(list_filter(regexp_split_to_array(CASE WHEN {_LISTED} THEN {_JSON} ELSE content END, '\\s+'), lambda v: v <> ''), []) END"""
_D = f"d AS (SELECT *, gts.target AS gold, {_LAST} AS last, {_FIRST} AS first, {_CONTENT} AS content FROM dump_entries WHERE output IS NOT NULL), m AS (SELECT *, {_MIDS} AS mids FROM d)"


def _f1(g: str, p: str) -> str:
    hit = f"len(list_intersect(list_distinct({g}), list_distinct({p})))::DOUBLE"
    return f"CASE WHEN coalesce(len({g}), 0) = 0 THEN (coalesce(len({p}), 0) = 0)::INT::DOUBLE WHEN coalesce(len({p}), 0) = 0 THEN 0.0 WHEN {hit} = 0 THEN 0.0 ELSE 2 * {hit} / (len(list_distinct({g})) + len(list_distinct({p}))) END"


def _token_f1(p: str, g: str) -> str:
    w = lambda t: f"list_filter(list_distinct(regexp_split_to_array({t}, '\\s+')), lambda w: w <> '')"
    hit = f"len(list_intersect({w(p)}, {w(g)}))::DOUBLE"
    return f"CASE WHEN len({w(p)}) = 0 OR len({w(g)}) = 0 THEN 0.0 ELSE 2 * {hit} / (len({w(p)}) + len({w(g)})) END"


def _exact_or_f1(p: str, gs: str) -> str:
    return f"CASE WHEN coalesce({p}, '') = '' THEN 0.0 WHEN list_contains(list_transform({gs}, lambda g: {_spaced('g')}), {_spaced(p)}) THEN 1.0 ELSE coalesce(list_max(list_transform({gs}, lambda g: {_token_f1(_spaced(p), _spaced('g'))})), 0.0) END"


def _encode(x: str, middle: str) -> str:
    for i, t in enumerate(("think", middle, "information", "answer")):
        x = f"replace(replace({x}, '<{t}>', chr({1 + 2 * i})), '</{t}>', chr({2 + 2 * i}))"
    return x


_UNMARKED = "regexp_replace(output, '(?s)^.*?<\\|im_start\\|>assistant\\s*', '')"
_VALID = f"regexp_matches({_encode(_UNMARKED, 'action')}, '{tx.ACTION_GRAMMAR}')"
_VALID2 = f"(regexp_matches(output, '<\\|im_start\\|>assistant') AND regexp_matches({_encode(_UNMARKED, 'action')}, '{tx.SPARQL_GRAMMAR}'))"
_COUNT = lambda t: f"(len(output) - len(replace(output, '{t}', ''))) // {len(t)}"
_BAL = " + ".join(f"(CASE WHEN {_COUNT(f'<{t}>')} > 0 AND {_COUNT(f'</{t}>')} > 0 THEN (CASE WHEN {_COUNT(f'<{t}>')} = {_COUNT(f'</{t}>')} THEN 1.0 ELSE 0.5 END) WHEN {_COUNT(f'<{t}>')} > 0 OR {_COUNT(f'</{t}>')} > 0 THEN 0.2 ELSE 0.0 END)" for t in tx.TAGS)
_PARTIAL = f"({_BAL})::DOUBLE / 4 * 0.3"
_EM = f"len(list_filter(gold, lambda g: {_joined('g')} = {_joined('last')})) > 0"
_REL_T = f"len(list_filter({_tagged('information')}, lambda b: len(list_filter(gold, lambda g: contains({_joined('b')}, {_joined('g')}))) > 0)) > 0"
_REL_M = f"len(list_filter({_tagged('information')}, lambda b: len(list_filter(gold, lambda g: contains(b, g))) > 0)) > 0"
_GOLDS = f"list_filter(list_transform(coalesce(gold, []), lambda v: {_strip('v')}), lambda v: v <> '')"
_N = f"len(string_split({_squeeze('output')}, ' '))"


_KEY = r"trim(regexp_replace(lower(args[1]), '[_\s]+', ' ', 'g'))"


def _map(pairs: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def oracle_sql() -> dict[str, str]:
    w = f"WITH {_D} "
    gold = "WHERE gold IS NOT NULL"
    pred = "coalesce(mids, [])"
    fmt = f"CASE WHEN f1 > 0 THEN (CASE WHEN valid THEN 0.1 ELSE partial * 0.1 END) ELSE 0.0 END"
    ids = r"list_distinct(regexp_extract_all(info, '([mg]\.[A-Za-z0-9_]+)', 1))"
    first_seen = r"""list_filter(al, lambda x, i: list_position(al, x) = i)"""
    action = r"(?i)^(?:Action\d+:\s*)?(Find_relation|Merge|Order|Compare|Time_constraint|Count)\s*\[([^\]]*)\]"
    v = "v"
    ent, name, integer = "(v LIKE 'm.%' OR v LIKE 'g.%')", "(v LIKE '\"%' AND (v LIKE '%\"' OR v LIKE '%\"@en'))", r"regexp_matches(v, '^-?\d+$')"
    return {
        "t01_normalize_spaced": w + f"SELECT entry_id, {_spaced('last')} AS norm FROM d",
        "t02_normalize_joined": w + f"SELECT entry_id, CASE WHEN last IS NOT NULL THEN {_joined('last')} END AS norm FROM d",
        "t03_exact_and_contained": w + f"SELECT entry_id, CASE WHEN last IS NOT NULL OR len(gold) = 0 THEN {_EM} END AS em, CASE WHEN last IS NOT NULL OR len(gold) = 0 THEN len(list_filter(gold, lambda g: contains({_joined('last')}, {_joined('g')}))) > 0 END AS sub FROM d {gold}",
        "t04_answers": w + "SELECT entry_id, first, last FROM d",
        "t05_score_exact_or_f1": w + f"SELECT entry_id, round({_exact_or_f1('first', 'gold')}, 6) AS score FROM d {gold}",
        "t06_t07_query_scores": f"""WITH p AS (SELECT sample_no, sparql, answer, coalesce(answer[1], '') AS a, CASE sample_no % 4 WHEN 0 THEN sparql WHEN 1 THEN replace(sparql, ' ', '  ') WHEN 2 THEN upper(sparql) ELSE substr(sparql, 1, 20) END AS got FROM qa_samples WHERE sparql IS NOT NULL AND answer IS NOT NULL)
SELECT sample_no, ({_squeeze('got')} = {_squeeze('sparql')})::INT::DOUBLE AS v1, lower({_squeeze('got')}) = lower({_squeeze('sparql')}) AS v2, round(0.7 * {_exact_or_f1(_strip('a'), 'answer')} + 0.3 * ({_squeeze('got')} = {_squeeze('sparql')})::INT, 6) AS combined FROM p""",
        "t08_mid_list": w + "SELECT entry_id, CASE WHEN mids IS NOT NULL THEN array_to_string(mids, ' ; ') END AS mids FROM m",
        "t09_prf": w + f"""SELECT entry_id, round(CASE WHEN len(gold) = 0 THEN (len({pred}) = 0)::INT WHEN len({pred}) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(gold), list_distinct({pred})))::DOUBLE / len(list_distinct({pred})) END, 6)::DOUBLE AS p,
 round(CASE WHEN len(gold) = 0 THEN 1.0 WHEN len({pred}) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(gold), list_distinct({pred})))::DOUBLE / len(list_distinct(gold)) END, 6)::DOUBLE AS r, round({_f1('gold', pred)}, 6) AS f1 FROM m {gold}""",
        "t10_best_f1": w + f"SELECT entry_id, round(CASE WHEN len(gold) = 0 THEN {_f1('gold', pred)} ELSE greatest({_f1('gold[1:1]', pred)}, {_f1('gold', pred)}) END, 6) AS f1 FROM m {gold}",
        "t11_mid_reward": w + f""", x AS (SELECT *, {_f1(_GOLDS, 'mids')} AS f1, {_VALID} AS valid, {_PARTIAL} AS partial FROM m), y AS (SELECT *, {fmt} AS fmt, regexp_matches(output, '(?i)hyt00|timeout') AS late FROM x)
SELECT entry_id, round(CASE WHEN late THEN -1.0 WHEN mids IS NULL THEN 0.0 ELSE f1 + fmt END, 6)::DOUBLE AS total, round(CASE WHEN late OR mids IS NULL THEN 0.0 ELSE f1 END, 6)::DOUBLE AS mid_f1, round(CASE WHEN late OR mids IS NULL THEN 0.0 ELSE fmt END, 6)::DOUBLE AS structure_reward, CASE WHEN late THEN -1.0::DOUBLE ELSE 0.0 END AS timeout_penalty FROM y""",
        "t12_partial_format": w + f"SELECT entry_id, round({_PARTIAL}, 6) AS reward FROM d",
        "t13_progressive": w + "SELECT entry_id, round(score * CASE WHEN step % 20 <= 0 THEN 1.0::DOUBLE WHEN step % 20 <= 10 THEN 0.1::DOUBLE + (step % 20)::DOUBLE / 10 * 0.9::DOUBLE ELSE 1.0 END, 6) AS reward FROM d WHERE score IS NOT NULL AND NOT isnan(score) AND step IS NOT NULL",
        "t14_action_grammar": w + f"SELECT entry_id, {_VALID} AS valid FROM d",
        "t15_sparql_grammar": w + f"SELECT entry_id, {_VALID2} AS valid FROM d",
        "t16_relevant": w + f"SELECT entry_id, {_REL_T} AS text, {_REL_M} AS ids FROM d {gold}",
        "t17_t18_bonus_scores": w + f""", x AS (SELECT * REPLACE (coalesce(gold, []) AS gold), {_VALID2} AS ok FROM m), y AS (SELECT *, (ok AND {_REL_T})::INT * 0.1::DOUBLE AS bt, (ok AND {_REL_M})::INT * 0.1::DOUBLE AS bm, {_f1('gold', 'mids')} AS f1 FROM x)
SELECT entry_id, round(CASE WHEN last IS NULL THEN CASE WHEN ok THEN 0.2 + bt ELSE 0 END WHEN {_EM} THEN CASE WHEN ok THEN 1 + bt ELSE 0.8 END ELSE CASE WHEN ok THEN 0.2 + bt ELSE 0 END END, 6)::DOUBLE AS em,
 round(CASE WHEN mids IS NULL THEN CASE WHEN ok THEN 0.2 + bm ELSE 0 END WHEN ok THEN f1 + 0.2 + bm ELSE greatest(0, f1 - 0.2 + bm) END, 6)::DOUBLE AS mid, ok AS valid FROM y""",
        "t19_number_answers": w + "SELECT entry_id, replace(coalesce(regexp_extract_all(last, '(-?[0-9.,]+)', 1)[-1], ''), ',', '') AS number FROM d",
        "t19_number_results": w + f"""SELECT entry_id, replace(regexp_extract_all(right(output || CASE WHEN entry_id % 2 = 0 THEN '#### 1,234.5' ELSE '' END, 300), '#### {tx.NUMBER}', 1)[-1], ',', '') AS strict,
 coalesce(list_filter(regexp_extract_all(right(output, 300), '{tx.NUMBER}', 1), lambda v: v <> '.')[-1], regexp_extract_all(right(output, 300), '{tx.NUMBER}', 1)[1]) AS flexible FROM d""",
        "t19_math_equal": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{g}', {'NULL' if v is None else str(v).lower()})" for a, g, v in MATH_PAIRS) + ") t(text, gold, same)",
        "t20_dispatch": "SELECT sample_no, CASE WHEN lower(dataset) IN ('webqsp', 'grailqa', 'graphq', 'cwq') THEN 'mid_reward' ELSE 'em' END AS reward FROM qa_samples",
        "t21_t22_placed_scores": w + f"SELECT entry_id, {_N}::INT AS n, score + 0.0 AS total, score + 0.0 AS at_last, round(least(-({_N} - 40)::DOUBLE / 20, 0.0), 6) AS penalty FROM d WHERE score IS NOT NULL AND NOT isnan(score)",
        "t23_t24_actions": w + f""", b AS (SELECT entry_id, list_filter(list_transform(string_split({_tagged('action', 'is')}[1], chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ls FROM d),
l AS (SELECT entry_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM b), a AS (SELECT entry_id, i::INT AS i, lower(regexp_extract(line, '{action}', 1)) AS name, list_transform(string_split(regexp_extract(line, '{action}', 2), '|'), lambda x: {_strip('x')}) AS args FROM l WHERE regexp_matches(line, '{action}'))
SELECT entry_id, i, name, array_to_string(args, '|') AS args, CASE WHEN name IN ('compare', 'order') THEN {_map(COMPARISONS | ORDERS, _KEY)} END AS mode FROM a""",
        "t25_t26_t27_results": w + f""", i AS (SELECT entry_id, array_to_string({_tagged('information')}, chr(10)) AS info FROM d), k AS (SELECT *, regexp_extract_all(info, '([mg]\\.[A-Za-z0-9_]+)', 1) AS al, string_split(info, chr(10)) AS ls FROM i), j AS (SELECT *, {first_seen} AS ids FROM k)
SELECT entry_id, len(ids)::INT AS n, CASE WHEN len(ids) <= 8 THEN array_to_string(ids, ', ') ELSE array_to_string(ids[1:5], ', ') || ' ... total ' || len(ids) END AS shown, array_to_string(ids[1:3], ' ') AS three,
 array_to_string(list_filter(ls, lambda x, i: list_sum(list_transform(ls[1:i], lambda y: len(y) + 1)) <= 120), chr(10)) AS cut FROM j""",
        "t25_t26_t27_whole_results": w + f""", i AS (SELECT entry_id, array_to_string({_tagged('information')}, chr(10)) AS info FROM d), k AS (SELECT *, regexp_extract_all(info, '([mg]\\.[A-Za-z0-9_]+)', 1) AS al, string_split(info, chr(10)) AS ls FROM i), j AS (SELECT *, {first_seen} AS ids FROM k),
c AS (SELECT *, len(list_filter(ls, lambda x, i: list_sum(list_transform(ls[1:i], lambda y: len(y) + 1)) <= 3 * 2560 - 100)) AS kept FROM j)
SELECT entry_id, len(ids)::INT AS n, CASE WHEN len(ids) <= 200 THEN array_to_string(ids, ', ') ELSE array_to_string(ids[1:50], ', ') || ', ... (total ' || len(ids) || ' items)' END AS shown, array_to_string(ids[1:3], ' ') AS three,
 CASE WHEN len(info) <= 3 * 2560 THEN info ELSE array_to_string(ls[1:kept] || ['... (' || (len(ls) - kept) || ' more lines truncated)'], chr(10)) END AS cut FROM c""",
        "t28_joined_results": w + "SELECT entry_id, replace(array_to_string(coalesce(gold, []), chr(10)), chr(0), '') AS text FROM d",
        "t29_t33_info_block": w + f"""SELECT entry_id, concat_ws(chr(10), '<information>', array_to_string(gold[1:3], ', '), CASE WHEN s < 0.98 THEN 'hint: similarity ' || CAST(round(s, 2)::DECIMAL(4,2) AS VARCHAR) END, CASE WHEN s <= 0.95 AND len(gold) > 3 THEN 'others: ' || array_to_string(gold[4:8], ', ') END, '</information>') AS block,
 CASE WHEN contains(input, '<|im_start|>') THEN 'chat' ELSE 'plain' END AS header FROM (SELECT *, coalesce(mid_f1, 0.0) AS s FROM d) {gold}""",
        "t30_merged_results": w + "SELECT md5(input) AS g, count(*) AS parts, sum(len(output))::BIGINT AS chars FROM d WHERE file_stem IS NOT NULL AND input IS NOT NULL GROUP BY g",
        "t31_until_close": w + "SELECT entry_id, CASE WHEN contains(output, '</action>') THEN substr(output, 1, strpos(output, '</action>') + 8) WHEN contains(output, '</answer>') THEN substr(output, 1, strpos(output, '</answer>') + 8) ELSE output END AS cut FROM d",
        "t32_candidates": r"""WITH i AS (SELECT entry_id, regexp_extract(input, '(?s)(?:Candidate Entities|Entities):\s*\[(.*?)\]', 1) AS x FROM dump_entries WHERE input IS NOT NULL)
SELECT entry_id, unnest(regexp_extract_all(x, '''([^'']+)''\s*\(([^)]+)\)', 1)) AS name, unnest(regexp_extract_all(x, '''([^'']+)''\s*\(([^)]+)\)', 2)) AS id FROM i""",
        "t34_typed_literals": r"""SELECT DISTINCT lex, dtype, '"' || lex || CASE WHEN regexp_extract(dtype, '([A-Za-z]+)$', 1) IN ('date', 'gYear', 'gYearMonth') AND NOT regexp_matches(lex, '(Z|[+-]\d{2}:\d{2})$') THEN '-08:00' ELSE '' END || '"^^<' || dtype || '>' AS query_text,
 lex || '^^' || dtype AS normal, CASE WHEN contains(lex, '^^') THEN lex WHEN contains(lex, '.') THEN lex || '^^http://www.w3.org/2001/XMLSchema#float' ELSE lex || '^^http://www.w3.org/2001/XMLSchema#integer' END AS compared
FROM (SELECT o.lex AS lex, o.dtype AS dtype FROM triples) WHERE dtype IS NOT NULL AND lex IS NOT NULL""",
        "t35_em_wrappers": w + f"SELECT entry_id, CASE WHEN last IS NULL THEN 0.0::DOUBLE WHEN {_EM} THEN 1.0 ELSE 0.1 END AS em FROM d {gold}",
        "t36_bonus_f1": w + f"SELECT entry_id, CASE WHEN coalesce(len(mids), 0) = 0 THEN 0.0 ELSE round({_f1('gold', 'mids')} + 0.2::DOUBLE * ({_VALID})::INT, 6) END AS score FROM m {gold}",
        "t37_classifiers": rf"""SELECT v, CASE WHEN {ent} THEN 'entity' WHEN {name} THEN 'name' WHEN contains(v, '^^') THEN 'literal' WHEN contains(v, '<http:') THEN 'url' WHEN {integer} THEN 'int' WHEN contains(v, '.') THEN 'onto' ELSE 'unknown' END AS etl,
 CASE WHEN {ent} THEN 'entity' WHEN {name} THEN 'name' WHEN contains(v, '^^') THEN 'literal' WHEN {integer} THEN 'int' WHEN v LIKE 'http%' THEN 'url' WHEN regexp_matches(v, '^[^.]+\.[^.]+$') AND NOT regexp_matches(v, '^[\d.]+$') THEN 'onto' WHEN v LIKE 'expression%' THEN 'expression' ELSE 'unknown' END AS agent,
 CASE WHEN v = '' THEN 'unknown' WHEN {ent} THEN 'entity' WHEN regexp_matches(v, '^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$') THEN CASE WHEN contains(v, '.') THEN 'literal' ELSE 'int' END WHEN regexp_matches(v, '^\d{{4}}') THEN 'literal' WHEN v LIKE 'http%' THEN 'url' ELSE 'name' END AS retrieval
FROM (SELECT DISTINCT o.lex AS v FROM triples WHERE o.lex IS NOT NULL)""",
        "a37_extraction_counters": w + f"SELECT count(*) AS n, count(mids) AS extracted, sum(({_VALID})::INT)::BIGINT AS valid FROM m",
    }
