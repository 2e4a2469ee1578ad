"""Queries of batch algebra (D), dataset preparation (E), sources and sinks (IO) and streams, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import batch as b
from lodestone.operators import etl, vectors
from lodestone.functions import text as tx
from lodestone.plans import valid_queries
from lodestone.session import scratch, table
from lodestone.sources import files
from lodestone.streaming import replay

C = F.col


def batch(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(C("c_custkey").alias("idx"), C("c_acctbal").alias("x"), C("c_mktsegment").alias("g"))


def _lens(s: SparkSession, d: str) -> DataFrame:
    """Rows of a training batch: 256 orders, with a length of 16 to 1039."""
    return table(s, d, "orders").select(C("o_orderkey").alias("idx"), F.floor(C("o_orderkey") / 256).alias("batch"), (16 + C("o_orderkey") * 7919 % 1024).alias("len"))


def _cols(s: SparkSession, d: str) -> DataFrame:
    left = batch(s, d)
    return b.union_columns(left, left.select("idx", "g", (C("x") * 2).alias("y")))


def _arrays(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.expr("transform(sequence(1, CAST(event_id % 7 + 1 AS INT)), i -> CAST((event_id * i) % 10 AS INT))").alias("a"))


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _truncated(s: SparkSession, d: str) -> DataFrame:
    return _arrays(s, d).withColumns({k: b.windowed_truncation(C("a"), 4, k) for k in ("left", "right", "middle")}).select("event_id", *[_joined(k).alias(k) for k in ("left", "right", "middle")])


def _padded(s: SparkSession, d: str) -> DataFrame:
    df = _arrays(s, d).withColumns({"l": b.padded_array(C("a"), 5, True, F.lit(-1)), "r": b.padded_array(C("a"), 5, False, F.lit(-1))})
    df = df.withColumn("m", F.transform("l", lambda x: (x >= 0).cast("int"))).withColumn("p", b.positions(C("m")))
    return df.select("event_id", *[_joined(k).alias(k) for k in ("l", "r", "m", "p")])


def _state(s: SparkSession, d: str) -> DataFrame:
    """Prompt and response with a parallel mask that leaves information out."""
    parts = etl.message_parts(C("output"))
    df = table(s, d, "dump_entries").where("output IS NOT NULL").select("entry_id", parts.alias("p"))
    size = F.transform("p", lambda x: F.size(F.split(tx.squeeze(x.content), " ")))
    df = df.select("entry_id", F.aggregate(size, F.lit(0), lambda a, n: a + n).alias("total"), F.aggregate(F.zip_with(size, F.transform("p", lambda x: x.loss_mask), lambda n, m: n * m), F.lit(0), lambda a, n: a + n).alias("trained"))
    return df


def _greedy(s: SparkSession, d: str) -> DataFrame:
    return b.imbalance(b.balanced(_lens(s, d), "batch", "len", 8, greedy=True), "batch", "part", "len").select("batch", "spread")


def _entries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dump_entries")


def _qa(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qa_samples")


def _fl():
    return F.coalesce("function_list", F.array().cast("array<string>"))


def _hints(s: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.lit("Intro\n\nQuestion: "), F.coalesce("question", F.lit("")))
    h = F.array_join(etl.action_lines(_fl()), "\n")
    return _qa(s, d).select("sample_no", *[F.md5(etl.add_hint(p, h, k)).alias(k) for k in ("reference", "hidden", "example")], (etl.clean_hints(etl.add_hint(p, h, "reference")) == tx.strip(F.regexp_replace(p, r"\n{3,}", "\n\n"))).alias("clean"))


def _statuses(s: SparkSession, d: str) -> DataFrame:
    status = F.when(C("question").isNull() | (F.trim("question") == ""), "skipped").when(F.size(_fl()) <= 0, "without_hint").otherwise("with_hint")
    return _qa(s, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def _messages(s: SparkSession, d: str) -> DataFrame:
    df = _entries(s, d).where("output IS NOT NULL").select("entry_id", F.posexplode(etl.message_parts(C("output"))).alias("i", "m"))
    return df.select("entry_id", "i", "m.role", F.md5("m.content").alias("content"), "m.loss_mask")


def _mask_share(s: SparkSession, d: str) -> DataFrame:
    return _messages(s, d).groupBy("role").agg(F.count("*").alias("n"), F.sum("loss_mask").alias("trained"))


def _strided(s: SparkSession, d: str) -> DataFrame:
    """Every (n / 100)-th entry by file and line, 100 at most: the sample is the feature."""
    df = b.numbered(_entries(s, d).select("entry_id", F.coalesce("file_stem", F.lit("")).alias("f"), F.coalesce("line_no", F.lit(-1)).alias("l")), "f", "l", "entry_id")
    step = max(1, df.count() // 100)
    return df.where((C("idx") % step == 0) & (C("idx") < step * 100)).select("entry_id", (C("idx") / step).cast("int").alias("place"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """(input, chosen, rejected): best and worst scored output of each prompt whose scores differ."""
    df = _entries(s, d).where("input IS NOT NULL AND output IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").withColumn("score", C("score") + 0.0)
    g = df.groupBy(F.md5("input").alias("prompt")).agg(F.max(F.struct("score", (-C("entry_id")).alias("i"))).alias("hi"), F.min(F.struct("score", C("entry_id").alias("i"))).alias("lo"))
    return g.where("hi.score > lo.score").select("prompt", (-C("hi.i")).alias("chosen"), C("lo.i").alias("rejected"))


def _dump_round_trip(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s, "dump-lines")
    table(s, d, "dump_lines").where("line IS NOT NULL AND file_stem IS NOT NULL").select("file_stem", F.translate("line", "\r\n", "  ").alias("value")).write.partitionBy("file_stem").text(folder)
    rows = files.read_dumps(s, folder)
    return rows.groupBy("file_stem").agg(F.count("*").alias("n"), F.count("input").alias("inputs"), F.count("output").alias("outputs"), F.round(F.sum("score"), 4).alias("score"))


def _jsonl(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s, "steps")
    files.write_dumps(_entries(s, d).where("step IS NOT NULL").select("entry_id", "input", "output", "step"), folder)
    back = s.read.schema("entry_id LONG, input STRING, output STRING, step INT").json(folder)
    return back.groupBy("step").agg(F.count("*").alias("n"), F.sum(F.length("output")).alias("chars"), F.min("entry_id").alias("first"))


def _array_file(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s, "array")
    table(s, d, "nation").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).write.text(folder)
    return files.read_json_array(s, folder, "n_nationkey INT, n_name STRING")


def _parquet(s: SparkSession, d: str) -> DataFrame:
    a, z = scratch(s, "a"), scratch(s, "z")
    n = table(s, d, "nation")
    n.where("n_nationkey < 10").write.parquet(a)
    n.where("n_nationkey >= 10").write.parquet(z)
    return s.read.parquet(a, z)


def _roles(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s, "roles")
    table(s, d, "relations").select(F.concat_ws(" ", F.split("relation", r"\.")[0], "relation", "list_name").alias("value")).write.text(folder)
    return files.read_roles(s, folder)


def _previous(s: SparkSession, d: str) -> DataFrame:
    qa = _qa(s, d)
    key = F.coalesce(F.when(F.trim("question") != "", C("question")), C("id"))
    old = qa.where("split = 'train'").select(key.alias("key"), F.size(etl.entities(_fl())).alias("n"))
    return files.from_previous(qa.select("sample_no", "question", "id"), old, key, "n").select("sample_no", "n")


def _dialogue(s: SparkSession, d: str) -> DataFrame:
    """The 50 dialogues a log keeps: those with special actions first."""
    special = C("output").rlike(r"(?i)(Compare|Time_constraint|Count)\s*\[").cast("int")
    return _entries(s, d).where("output IS NOT NULL").select("entry_id", special.alias("special")).orderBy(C("special").desc(), "entry_id").limit(50)


def _stats(s: SparkSession, d: str) -> DataFrame:
    df = _entries(s, d).where("mid_f1 IS NOT NULL AND NOT isnan(mid_f1) AND step IS NOT NULL")
    return df.groupBy("step", F.floor(C("mid_f1") * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.round("mid_f1", 2).cast("string"))), " ").alias("seen"))


def _passages(s: SparkSession, d: str, chars: int | None = None) -> DataFrame:
    """The three hits of each query in order, with their whole text; chars: with its first characters only."""
    rows = table(s, d, "embeddings").select(C("vec_id").alias("id"), C("embedding").alias("v"))
    top = vectors.scores(rows, rows.where("id % 20 = 0"), 3)
    docs = table(s, d, "documents").select(C("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    if chars is not None:
        docs = docs.withColumn("t", F.substring("t", 1, chars))
    joined = top.join(docs, "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-C("score")).alias("k"), "id", "t"))).alias("r"))
    return joined.select("query_id", F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(": "), x.t)), "\n").alias("passages"))


def _rewritten(s: SparkSession, d: str) -> DataFrame:
    fold = F.pandas_udf(lambda x: x.map(lambda v: etl.rewritten_hints(list(v) if v is not None else None)), T.StringType())
    return _qa(s, d).select("sample_no", fold("function_list").alias("hint"))


def _metrics_sink(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s, "metrics")
    m = _entries(s, d).groupBy("step").agg(F.count("*").alias("n"))
    m.write.json(folder)
    return s.read.schema("step INT, n LONG").json(folder)


def _stream_source(s: SparkSession, df: DataFrame, label: str) -> DataFrame:
    folder = scratch(s, label)
    df.write.parquet(folder)
    return s.readStream.schema(df.schema).parquet(folder)


def _stream_chains(s: SparkSession, d: str) -> DataFrame:
    calls = _qa(s, d).where("function_list IS NOT NULL").select("sample_no", F.posexplode("function_list").alias("i", "f"))
    return replay.drained(replay.chains(_stream_source(s, calls, "calls")), scratch(s, "chains"))


def _stream_windows(s: SparkSession, d: str) -> DataFrame:
    return replay.windowed(table(s, d, "events").select("ts", "event_type", "value")).withColumn("total", F.round("total", 3))


def queries() -> dict:
    return {
        "d01_select_rename": lambda s, d: batch(s, d).select("idx", "x").withColumnRenamed("x", "value"),
        "d02_select_indices": lambda s, d: b.select_indices(batch(s, d), [5, 3, 3, 100, 0]),
        "d02_select_mask": lambda s, d: batch(s, d).where(C("x") > 0),
        "d03_slice": lambda s, d: b.sliced(batch(s, d), 10, 1000, 7),
        "d04_union_columns": _cols,
        "d05_concat": lambda s, d: b.concat(batch(s, d), batch(s, d).where("x > 0")),
        "d06_repeat_interleave": lambda s, d: b.repeated(batch(s, d), 3),
        "d06_repeat_stack": lambda s, d: b.repeated(batch(s, d), 3, interleave=False),
        "d07_repeat_each": lambda s, d: b.repeated_each(batch(s, d), (C("idx") % 3).cast("int")).select("idx", "rep"),
        "d08_chunk": lambda s, d: b.chunked(batch(s, d), 7).select("idx", "chunk"),
        "d08_split": lambda s, d: b.split(batch(s, d), 64).select("idx", "chunk"),
        "d09_pad": lambda s, d: b.padded(batch(s, d), 32),
        "d09_unpad": lambda s, d: b.unpadded(b.padded(batch(s, d), 32), 4),
        "d10_reorder": lambda s, d: b.reordered(batch(s, d), F.lit(10_000_000) - C("idx")),
        "d11_fold": lambda s, d: b.folded(batch(s, d), 4, "x", "g").select("idx", F.array_join("g", ",").alias("g")),
        "d11_unfold": lambda s, d: b.unfolded(b.folded(batch(s, d), 4, "x", "g"), 4, "x", "g"),
        "d12_mini_batches": lambda s, d: b.mini_batches(batch(s, d), 64, 7, 2).select("idx", "epoch", "batch"),
        "d13_balanced": lambda s, d: b.balanced(_lens(s, d), "batch", "len", 8),
        "d13_greedy_spread": _greedy,
        "d14_imbalance": lambda s, d: b.imbalance(_lens(s, d).withColumn("part", C("idx") % 8), "batch", "part", "len"),
        "d15_micro_batches": lambda s, d: b.micro_batches(_lens(s, d), "batch", "len", 16_384),
        "d16_lists_of_rows": lambda s, d: batch(s, d).groupBy("g").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("idx")), 1, 5), ",").alias("first")),
        "d17_pad_and_positions": _padded,
        "d18_masked_concat": _state,
        "d19_curriculum": lambda s, d: b.numbered(_qa(s, d).select("sample_no", F.size(_fl()).alias("hard")), "hard", "sample_no").select("sample_no", "hard", "idx"),
        "e01_scratchpad": lambda s, d: _qa(s, d).select("sample_no", F.md5(etl.scratchpad(_fl())).alias("pad"), F.array_join(F.transform(etl.entities(_fl()), lambda e: e.id), " ").alias("ids")),
        "e02_prompt": lambda s, d: _qa(s, d).select("sample_no", etl.prompt(etl.with_mark(F.coalesce("question", F.lit(""))), etl.entities(_fl()), F.lower("dataset")).alias("prompt")),
        "e03_response": lambda s, d: _qa(s, d).select("sample_no", etl.response(_fl(), F.coalesce("answer", F.array().cast("array<string>"))).alias("response")),
        "e04_rl_records": lambda s, d: etl.rl_records(_qa(s, d)).select("sample_no", "data_source", "extra_info.original_question", "extra_info.n_entities", F.size("reward_model.ground_truth.target").alias("n_target"), "reward_model.ground_truth.sexpr"),
        "e05_rewritten_hints": _rewritten,
        "e06_hints": _hints,
        "e07_statuses": _statuses,
        "e08_clean_prompts": lambda s, d: _entries(s, d).where("input IS NOT NULL").select("entry_id", etl.clean_hints(C("input")).alias("clean")),
        "e09_messages": _messages,
        "e10_metric_filter": lambda s, d: etl.by_metrics(_entries(s, d), 0.5, 0.1, 0.5).select("entry_id", "file_stem", "line_no"),
        "e11_strided_sample": _strided,
        "e12_not_overlong": lambda s, d: _entries(s, d).where(F.size(F.split(tx.squeeze(C("input")), " ")) <= 40).select("entry_id"),
        "e13_truncation": _truncated,
        "e14_unwrapped": lambda s, d: _qa(s, d).select("sample_no", F.when(F.size("answer") == 1, F.get("answer", F.lit(0))).otherwise(F.array_join("answer", "|")).alias("answer")),
        "e15_loss_mask": _mask_share,
        "e16_webqsp_records": lambda s, d: etl.rl_records(_qa(s, d).where("lower(dataset) = 'webqsp' AND question IS NOT NULL")).select("sample_no", "extra_info.original_question", F.size("reward_model.ground_truth.candidate_entities").alias("n")),
        "e17_preference_pairs": _pairs,
        "e18_sft_records": lambda s, d: etl.sft_records(_entries(s, d)).select("entry_id", F.size("messages").alias("n"), "reward", "extra_info.step"),
        "io01_json_array": _array_file,
        "io02_dump_files": _dump_round_trip,
        "io03_io04_parquet": _parquet,
        "io05_step_files": _jsonl,
        "io06_tolerant_json": lambda s, d: table(s, d, "events").select("event_id", files.tolerant(F.when(C("event_id") % 5 == 0, F.concat(F.lit("x"), "props")).otherwise(C("props")), "k LONG").alias("t")).select("event_id", C("t.value.k").alias("k"), C("t.raw").alias("raw")),
        "io07_roles": _roles,
        "io13_from_previous": _previous,
        "io14_metrics_file": _metrics_sink,
        "io15_appended": lambda s, d: _qa(s, d).where("split = 'dev'").select("sample_no", "split").unionByName(_qa(s, d).where("split = 'test'").select("sample_no", F.lit("generated").alias("split"))),
        "io16_passages": lambda s, d: _passages(s, d, 40),
        "io16_whole_passages": _passages,
        "io17_dialogue_log": _dialogue,
        "io18_statistics": _stats,
        "s01_windows": _stream_windows,
        "s02_stream_chains": _stream_chains,
    }


_B = "b AS (SELECT c_custkey AS idx, c_acctbal AS x, c_mktsegment AS g FROM customer), n AS (SELECT count(*) AS n FROM b)"
_L = "l AS (SELECT o_orderkey AS idx, o_orderkey // 256 AS batch, 16 + o_orderkey * 7919 % 1024 AS len FROM orders)"
_A = "a AS (SELECT event_id, list_transform(range(1, (event_id % 7 + 2)::BIGINT), lambda i: (event_id * i) % 10) AS a FROM events)"


def _action_sql() -> str:
    """SQL of the action line of f at step i."""
    g = lambda k, j: "regexp_extract(f, '" + etl._PATTERNS[k].replace("'", "''") + f"', {j})"
    e = g("START", 1)
    words = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in etl.MODE_WORDS.items())
    title = "array_to_string(list_transform(string_split(translate({0}, '._', '  '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')".format(e)
    shown = f"CASE WHEN contains({e}, '.') AND NOT regexp_matches({e}, '^[mg]\\.') AND NOT contains({e}, '^^') AND NOT starts_with({e}, '\"') THEN {title} ELSE {e} END"
    args = {"START": shown, "JOIN": g("JOIN", 1), "AND": g("AND", 1) + " || ' | ' || " + g("AND", 2), "ARG": g("ARG", 1) + " || ' | ' || " + g("ARG", 2), "CMP": f"CASE {g('CMP', 1)} {words} ELSE {g('CMP', 1)} END || ' | ' || " + g("CMP", 2), "TC": g("TC", 1) + " || ' | ' || " + g("TC", 2), "COUNT": g("COUNT", 1), "STOP": g("STOP", 1)}
    kind = "regexp_extract(f, '= (START|JOIN|AND|ARG|CMP|TC|COUNT|STOP)\\(', 1)"
    return "CASE " + kind + " " + " ".join(f"WHEN '{k}' THEN 'Action' || i || ': {etl.ACTION_OF[k]} [ ' || {a} || ' ]'" for k, a in args.items()) + " END"


def _qa_sql() -> str:
    """CTEs s (steps), p (per sample: lines, pad, ids)."""
    start, tc = etl._PATTERNS["START"].replace("'", "''"), etl._PATTERNS["TC"].replace("'", "''")
    e = f"regexp_extract(f, '{start}', 1)"
    title = f"array_to_string(list_transform(string_split(translate({e}, '._', '  '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    name = f"CASE WHEN contains(f, '= TC(') THEN regexp_extract(f, '{tc}', 2) WHEN contains({e}, '.') AND NOT regexp_matches({e}, '^[mg]\\.') AND NOT contains({e}, '^^') AND NOT starts_with({e}, '\"') THEN {title} ELSE {e} END"
    return f"""u AS (SELECT sample_no, unnest(function_list) AS f, generate_subscripts(function_list, 1) AS i FROM qa_samples WHERE function_list IS NOT NULL),
s AS (SELECT sample_no, i, f, {_action_sql()} AS line, CASE WHEN contains(f, '= START(') THEN {e} WHEN contains(f, '= TC(') AND regexp_extract(f, '{tc}', 2) <> 'NOW' THEN regexp_extract(f, '{tc}', 2) END AS id, {name} AS name FROM u),
p AS (SELECT sample_no, string_agg(line, chr(10) ORDER BY i) AS lines, string_agg(coalesce(line, '') || chr(10) || 'Observation' || i || ': ' || f, chr(10) ORDER BY i) AS pad, string_agg(id, ' ' ORDER BY i) FILTER (id IS NOT NULL) AS ids, count(id) AS n_ids, list({{'name': name, 'id': id}} ORDER BY i) FILTER (id IS NOT NULL) AS ents FROM s GROUP BY sample_no),
q AS (SELECT t.*, coalesce(lines, '') AS lines, coalesce(pad, '') AS pad, coalesce(ids, '') AS ids, coalesce(n_ids, 0) AS n_ids, coalesce(ents, []) AS ents, CASE WHEN coalesce(question, '') <> '' AND question NOT LIKE '%?' THEN question || '?' ELSE coalesce(question, '') END AS asked FROM qa_samples t LEFT JOIN p USING (sample_no))"""


_TIGHT = "regexp_replace(output, '(?i)(</(?:think|action|answer)>)\\s+(<(?:think|action|answer)>)', '\\1\\2', 'g')"
_MSG = f"""c AS (SELECT entry_id, list_filter(list_transform(string_split(regexp_replace({_TIGHT}, '(?is)(<information>.*?</information>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps, output FROM dump_entries WHERE output IS NOT NULL),
k AS (SELECT entry_id, CASE WHEN len(ps) > 0 THEN ps ELSE [output] END AS ps FROM c),
m AS (SELECT entry_id, unnest(ps) AS content, generate_subscripts(ps, 1) - 1 AS i FROM k), r AS (SELECT entry_id, i::INT AS i, CASE WHEN regexp_matches(content, '(?is)^<information>.*</information>$') THEN 'tool' ELSE 'assistant' END AS role, content FROM m)"""
_CLEAN = """regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)\\*\\*Reference Action Sequence \\(for guidance\\):\\*\\*.*?\\n---\\n', '', 'g'), '(?is)\\*\\*Example Solution Approach:\\*\\*.*?(?:\\n\\n|\\n---\\n)', '', 'g'), '(?i)\\[HINT_PLACEHOLDER:.*?\\]', '', 'g'), chr(10) || '{a}', ''), '{a}', ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"""


def oracle_sql() -> dict[str, str]:
    w = f"WITH {_B} "
    qa = f"WITH {_qa_sql()} "
    offered = " || ".join(
        f"(CASE WHEN {'lower(dataset) NOT IN (' + chr(39) + 'webqsp' + chr(39) + ')' if n in ('Compare', 'Count') else 'lower(dataset) NOT IN (' + chr(39) + 'grailqa' + chr(39) + ', ' + chr(39) + 'graphq' + chr(39) + ')' if n == 'Time_constraint' else 'true'} THEN '* {n} {a}' || chr(10) ELSE '' END)" for n, a in etl.OFFERED.items())
    shown = "array_to_string(list_transform(ents[1:10], lambda e: '''' || e.name || ''' (' || e.id || ')'), ', ')"
    tail = f"chr(10) || '{etl.AFTER}'"
    hint = lambda block: f"md5('Intro' || chr(10) || chr(10) || {block} || 'Question: ' || coalesce(question, '') || {tail})"
    cutx = lambda x: f"array_to_string({x}, ',')"
    passages = "s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 3)"
    return {
        "d01_select_rename": w + "SELECT idx, x AS value FROM b",
        "d02_select_indices": w + "SELECT p::BIGINT AS idx, x, g FROM (VALUES (0, 5), (1, 3), (2, 3), (3, 100), (4, 0)) t(p, i) JOIN b ON b.idx = i",
        "d02_select_mask": w + "SELECT * FROM b WHERE x > 0",
        "d03_slice": w + "SELECT * FROM b WHERE idx >= 10 AND idx < 1000 AND (idx - 10) % 7 = 0",
        "d04_union_columns": w + "SELECT idx, x, g, x * 2 AS y FROM b",
        "d05_concat": w + "SELECT * FROM b UNION ALL SELECT idx + n, x, g FROM b, n WHERE x > 0",
        "d06_repeat_interleave": w + "SELECT idx * 3 + k AS idx, x, g FROM b, (SELECT unnest(range(3)) AS k)",
        "d06_repeat_stack": w + "SELECT k * n + idx AS idx, x, g FROM b, n, (SELECT unnest(range(3)) AS k)",
        "d07_repeat_each": w + "SELECT idx, unnest(range(idx % 3))::INT AS rep FROM b",
        "d08_chunk": w + "SELECT idx, (idx // CAST(ceil(n / 7) AS BIGINT))::INT AS chunk FROM b, n",
        "d08_split": w + "SELECT idx, (idx // 64)::INT AS chunk FROM b",
        "d09_pad": w + "SELECT idx, x, g FROM b UNION ALL SELECT idx + n, x, g FROM b, n WHERE idx < (32 - n % 32) % 32",
        "d09_unpad": w + ", p AS (SELECT idx, x, g FROM b UNION ALL SELECT idx + n, x, g FROM b, n WHERE idx < (32 - n % 32) % 32) SELECT * FROM p WHERE idx < (SELECT count(*) FROM p) - 4",
        "d10_reorder": w + "SELECT 10000000 - idx AS idx, x, g FROM b",
        "d11_fold": w + "SELECT idx // 4 AS idx, string_agg(g, ',' ORDER BY b.idx) AS g FROM b GROUP BY b.idx // 4",
        "d11_unfold": w + "SELECT idx, x, g FROM b",
        "d13_greedy_spread": f"""WITH RECURSIVE {_L}, o AS (SELECT batch, len, row_number() OVER (PARTITION BY batch ORDER BY idx) AS k FROM l), g AS (SELECT batch, 0::BIGINT AS k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS t FROM (SELECT DISTINCT batch FROM l)
UNION ALL SELECT g.batch, o.k, list_transform(t, lambda v, i: v + CASE WHEN i = list_position(t, list_min(t)) THEN o.len ELSE 0 END) FROM g JOIN o ON o.batch = g.batch AND o.k = g.k + 1)
SELECT batch, CASE WHEN k >= 8 THEN list_max(t) - list_min(t) ELSE list_max(t[:k]) - list_min(t[:k]) END AS spread FROM g WHERE k = (SELECT max(k) FROM o WHERE o.batch = g.batch)""",
        "d14_imbalance": f"WITH {_L}, p AS (SELECT batch, idx % 8, sum(len) AS t FROM l GROUP BY batch, idx % 8) SELECT batch, min(t)::BIGINT AS least, max(t)::BIGINT AS most, avg(t) AS mean, (max(t) - min(t))::BIGINT AS spread FROM p GROUP BY batch",
        "d16_lists_of_rows": w + "SELECT g, count(*) AS n, array_to_string(list_sort(list(DISTINCT idx))[1:5], ',') AS first FROM b GROUP BY g",
        "d17_pad_and_positions": f"""WITH {_A}, p AS (SELECT event_id, list_concat(list_transform(range(greatest(5 - len(a), 0)), lambda i: -1), a[greatest(len(a) - 4, 1):]) AS l, list_concat(a[1:5], list_transform(range(greatest(5 - len(a), 0)), lambda i: -1)) AS r FROM a), m AS (SELECT *, list_transform(l, lambda x: (x >= 0)::INT) AS m FROM p)
SELECT event_id, {cutx('l')} AS l, {cutx('r')} AS r, {cutx('m')} AS m, {cutx('list_transform(m, lambda x, i: greatest(list_sum(m[1:i]) - 1, 0) * x)')} AS p FROM m""",
        "d18_masked_concat": f"WITH {_MSG}, z AS (SELECT entry_id, role, len(string_split(regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), ' ')) AS n FROM r) SELECT entry_id, sum(n)::INT AS total, sum(CASE WHEN role = 'tool' THEN 0 ELSE n END)::INT AS trained FROM z GROUP BY entry_id",
        "d19_curriculum": "SELECT sample_no, hard, row_number() OVER (ORDER BY hard, sample_no) - 1 AS idx FROM (SELECT sample_no, coalesce(len(function_list), 0)::INT AS hard FROM qa_samples)",
        "e01_scratchpad": qa + "SELECT sample_no, md5(pad) AS pad, ids FROM q",
        "e02_prompt": qa + f"""SELECT sample_no, 'Answer with one action at a time.' || chr(10) || rtrim({offered}, chr(10)) || chr(10) || CASE WHEN n_ids > 0 THEN 'Candidate Entities: [' || {shown} || CASE WHEN n_ids > 50 THEN ', ...' ELSE '' END || ']' ELSE 'Entities: []' END || chr(10) || 'Question: ' || asked AS prompt FROM q""",
        "e03_response": qa + "SELECT sample_no, '<think>' || chr(10) || 'The steps follow from the question.' || chr(10) || '</think>' || chr(10) || chr(10) || '<action>' || chr(10) || lines || chr(10) || '</action>' || chr(10) || chr(10) || '<answer>' || chr(10) || coalesce(array_to_string(answer, ', '), '') || chr(10) || '</answer>' AS response FROM q",
        "e04_rl_records": qa + "SELECT sample_no, lower(dataset) AS data_source, asked AS original_question, n_ids::INT AS n_entities, coalesce(len(answer), 0)::INT AS n_target, sexpr FROM q",
        "e06_hints": qa + f"""SELECT sample_no, {hint(f"chr(10) || '{etl.REFERENCE}' || chr(10) || lines || chr(10) || chr(10) || '---' || chr(10) || chr(10)")} AS reference, {hint("chr(10) || '[HINT_PLACEHOLDER: ' || lines || ']' || chr(10) || chr(10)")} AS hidden, {hint(f"chr(10) || '{etl.EXAMPLE}' || chr(10) || lines || chr(10) || chr(10)")} AS example, true AS clean FROM q""",
        "e07_statuses": "SELECT CASE WHEN question IS NULL OR trim(question) = '' THEN 'skipped' WHEN coalesce(len(function_list), 0) = 0 THEN 'without_hint' ELSE 'with_hint' END AS status, count(*) AS n FROM qa_samples GROUP BY 1",
        "e08_clean_prompts": "SELECT entry_id, " + _CLEAN.format(x="input", a=etl.AFTER) + " AS clean FROM dump_entries WHERE input IS NOT NULL",
        "e09_messages": f"WITH {_MSG} SELECT entry_id, i, role, md5(content) AS content, CASE WHEN role = 'tool' THEN 0 ELSE 1 END AS loss_mask FROM r",
        "e10_metric_filter": "SELECT entry_id, file_stem, line_no FROM dump_entries WHERE mid_f1 >= 0.5 AND abs(structure_reward - 0.1) <= 1e-6 AND NOT isnan(score) AND score >= 0.5",
        "e11_strided_sample": "WITH o AS (SELECT entry_id, row_number() OVER (ORDER BY coalesce(file_stem, ''), coalesce(line_no, -1), entry_id) - 1 AS k, greatest(count(*) OVER () // 100, 1) AS st FROM dump_entries) SELECT entry_id, (k // st)::INT AS place FROM o WHERE k % st = 0 AND k < st * 100",
        "e12_not_overlong": "SELECT entry_id FROM dump_entries WHERE len(string_split(regexp_replace(regexp_replace(input, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), ' ')) <= 40",
        "e13_truncation": f"WITH {_A} SELECT event_id, {cutx('CASE WHEN len(a) > 4 THEN a[len(a) - 3:] ELSE a END')} AS left, {cutx('a[1:4]')} AS right, {cutx('CASE WHEN len(a) > 4 THEN list_concat(a[1:2], a[len(a) - 1:]) ELSE a END')} AS middle FROM a".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'),
        "e14_unwrapped": "SELECT sample_no, array_to_string(answer, '|') AS answer FROM qa_samples",
        "e15_loss_mask": f"WITH {_MSG} SELECT role, count(*) AS n, sum((role <> 'tool')::INT)::BIGINT AS trained FROM r GROUP BY role",
        "e16_webqsp_records": qa + "SELECT sample_no, asked AS original_question, n_ids::INT AS n FROM q WHERE lower(dataset) = 'webqsp' AND question IS NOT NULL",
        "e17_preference_pairs": "WITH d AS (SELECT md5(input) AS prompt, entry_id, score + 0.0 AS score FROM dump_entries WHERE input IS NOT NULL AND output IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)), o AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, entry_id) AS h, row_number() OVER (PARTITION BY prompt ORDER BY score, entry_id) AS l FROM d) SELECT a.prompt, a.entry_id AS chosen, b.entry_id AS rejected FROM o a JOIN o b ON a.prompt = b.prompt AND a.h = 1 AND b.l = 1 WHERE a.score > b.score",
        "e18_sft_records": f"WITH {_MSG}, z AS (SELECT entry_id, count(*) AS n FROM r GROUP BY entry_id) SELECT entry_id, (coalesce(n, 1) + 1)::INT AS n, CASE WHEN NOT isnan(score) THEN score END AS reward, step FROM dump_entries LEFT JOIN z USING (entry_id)",
        "io01_json_array": "SELECT n_nationkey, n_name FROM nation",
        "io02_dump_files": "WITH l AS (SELECT file_stem, line FROM dump_lines WHERE line IS NOT NULL AND file_stem IS NOT NULL AND json_valid(line)), o AS (SELECT * FROM l WHERE json_type(line) = 'OBJECT') SELECT file_stem, count(*) AS n, count(json_extract_string(line, '$.input')) AS inputs, count(json_extract_string(line, '$.output')) AS outputs, round(sum(CAST(json_extract_string(line, '$.score') AS DOUBLE)), 4) AS score FROM o GROUP BY file_stem",
        "io03_io04_parquet": "SELECT * FROM nation",
        "io05_step_files": "SELECT step, count(*) AS n, sum(len(output))::BIGINT AS chars, min(entry_id) AS first FROM dump_entries WHERE step IS NOT NULL GROUP BY step",
        "io06_tolerant_json": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 5 = 0 THEN 'x' || props END AS raw FROM events",
        "io07_roles": "SELECT relation AS role, split_part(relation, '.', 1) AS domain, list_name AS range FROM relations WHERE NOT contains(relation, ' ') UNION ALL SELECT string_split(split_part(relation, '.', 1) || ' ' || relation || ' ' || list_name, ' ')[2], string_split(split_part(relation, '.', 1), ' ')[1], string_split(split_part(relation, '.', 1) || ' ' || relation || ' ' || list_name, ' ')[3] FROM relations WHERE contains(relation, ' ')",
        "io13_from_previous": qa + ", k AS (SELECT sample_no, coalesce(CASE WHEN trim(question) <> '' THEN question END, id) AS key, split, n_ids FROM q), o AS (SELECT key, min(n_ids) AS n FROM k WHERE split = 'train' GROUP BY key) SELECT sample_no, n::INT AS n FROM k LEFT JOIN o USING (key)",
        "io14_metrics_file": "SELECT step, count(*) AS n FROM dump_entries GROUP BY step",
        "io15_appended": "SELECT sample_no, CASE WHEN split = 'test' THEN 'generated' ELSE split END AS split FROM qa_samples WHERE split IN ('dev', 'test')",
        "io16_passages": f"WITH {passages} SELECT query_id, string_agg('Doc ' || p || ': ' || t, chr(10) ORDER BY p) AS passages FROM (SELECT query_id, substr(coalesce(text, ''), 1, 40) AS t, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS p FROM t JOIN documents ON doc_id = id) GROUP BY query_id",
        "io16_whole_passages": f"WITH {passages} SELECT query_id, string_agg('Doc ' || p || ': ' || t, chr(10) ORDER BY p) AS passages FROM (SELECT query_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS p FROM t JOIN documents ON doc_id = id) GROUP BY query_id",
        "io17_dialogue_log": "SELECT entry_id, regexp_matches(output, '(?i)(Compare|Time_constraint|Count)\\s*\\[')::INT AS special FROM dump_entries WHERE output IS NOT NULL ORDER BY special DESC, entry_id LIMIT 50",
        "io18_statistics": "SELECT step, floor(mid_f1 * 10)::INT AS bin, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(round(mid_f1, 2) AS VARCHAR))), ' ') AS seen FROM dump_entries WHERE mid_f1 IS NOT NULL AND NOT isnan(mid_f1) AND step IS NOT NULL GROUP BY 1, 2",
        "s01_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
        "s02_stream_chains": valid_queries.oracle_sql()["pv13_join_chains"],
    }
