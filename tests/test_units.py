"""Single rules on small hand-made inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import validators as vd
from lodestone.operators import batch as b
from lodestone.operators import etl, rollout
from lodestone.plans import functions_list as fl
from lodestone.plans.logical_form import G, PlanError, W, evaluate, linearise, parse, plan
from lodestone.sources import files
from lodestone.sources.triples import facts
from lodestone.streaming import replay

TRIPLES = "triple_id LONG, s STRING, p STRING, o STRUCT<kind: STRING, lex: STRING, dtype: STRING, lang: STRING>"


@pytest.fixture(scope="module")
def kb(spark):
    e = lambda x: ("entity", x, None, None)
    lit = lambda x, t=None, lang=None: ("literal", x, t, lang)
    rows = [
        ("m.a", "p.q.r", e("m.b")), ("m.c", "p.q.r", e("m.b")), ("m.b", "p.q.r", e("m.b")), ("m.a", "p.q.n", lit("5", "#integer")), ("m.c", "p.q.n", lit("5.0", "#double")),
        ("m.a", "rdfs:label", lit("A", None, "en")), ("m.a", "rdfs:label", lit("Alpha", None, "EN-gb")), ("m.a", "rdfs:label", lit("Ah", None, "de")), ("m.a", "type.object.type", ("class", "x.y", None, None)),
        ("m.a", "p.t.from", lit("1990", "#gYear")), ("m.c", "p.t.from", lit("some day", "#date")), ("m.a", "p.t.to", lit("2000-05", "#gYearMonth")), ("m.a", "p.q.r", e("m.b")), ("m.c", "p.q.name", lit("abcdef")), (None, "p.q.r", e("m.b")),
    ]
    return facts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], TRIPLES))


def xs(df):
    return sorted(r.x for r in df.select("x").distinct().collect())


def test_join_excludes_the_constant_and_repeats_count_once(kb):
    assert xs(evaluate(kb, "(JOIN p.q.r m.b)", W)) == ["m.a", "m.c"]
    assert [r.n for r in evaluate(kb, "(COUNT (JOIN p.q.r m.b))", W).collect()] == [2]


def test_every_english_label_is_a_row(kb):
    assert sorted((r.x, r.name) for r in evaluate(kb, "(AND x.y (JOIN p.q.r m.b))", W).collect()) == [("m.a", "A"), ("m.a", "Alpha")]


def test_compare_casts_differ_by_dialect(kb):
    assert xs(evaluate(kb, "(AND x.y (ge p.q.n 5))", W)) == ["m.a"]
    assert xs(evaluate(kb, "(ge p.q.n 5)", W)) == ["m.a"]
    assert xs(evaluate(kb, "(ge p.q.n 5)", G)) == ["m.a", "m.c"]


def test_unparsable_time_drops_and_missing_time_keeps(kb):
    assert xs(evaluate(kb, "(TC (JOIN p.q.r m.b) p.t.from 1995)", W)) == ["m.a"]
    assert xs(evaluate(kb, "(TC (JOIN p.q.r m.b) p.t.from 1980)", W)) == []


def test_prefix_is_for_one_dialect(kb):
    assert xs(evaluate(kb, '(JOIN p.q.name "abc")', W)) == ["m.c"]
    assert xs(evaluate(kb, '(JOIN p.q.name "abc")', G)) == []


def test_superlative_ties(kb):
    assert xs(evaluate(kb, "(ARGMAX (JOIN p.q.r m.b) p.q.n)", W)) == ["m.a"]
    assert xs(evaluate(kb, "(ARGMAX (JOIN p.q.r m.b) p.q.n)", G)) == ["m.a", "m.c"]


@pytest.mark.parametrize("bad", ["", "(", "(JOIN a)", "(X a b)", "(AND a.b c.d)", "(JOIN a b))"])
def test_malformed_forms_have_no_plan(bad):
    with pytest.raises(PlanError):
        plan(bad, W)


def test_linearise_numbers_in_post_order():
    assert linearise(parse("(AND (JOIN (R r2) (JOIN r1 m.e)) cls)")) == [["JOIN", "r1", "m.e"], ["JOIN", ["R", "r2"], "#0"], ["AND", "#1", "cls"]]


def test_function_lists():
    lines = ["expression1 = START('m.a')", "expression1 = JOIN('(R p.q.r)', expression1)", "expression1 = COUNT(expression1)", "expression1 = STOP(expression1)"]
    assert fl.to_sexpr(lines) == "(COUNT (JOIN (R p.q.r) m.a))"
    assert fl.to_sexpr(["__import__('os')"]) == fl.to_sexpr(None) == fl.to_sexpr(["expression1 = JOIN('p', expression2)"]) == fl.BAD
    calls = fl.build(fl.parse_actions("<action>\nFind_relation [ m.a | p.q.r ]\nAction2: compare [ less than | p.q.n | 4.5 ]\nMerge [ expression1 | expression2 ]\nnonsense\n</action>"))
    assert calls[-2:] == ["expression1 = AND(expression1, expression2)", "expression1 = STOP(expression1)"]
    assert fl.to_sexpr(calls) == "(AND (JOIN p.q.r m.a) (lt p.q.n 4.5^^http://www.w3.org/2001/XMLSchema#float))"


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in cols.items()])


def test_tag_grammars(spark):
    good = "<|im_start|>assistant\n<think>a</think><action>b</action><information>c</information> free <think>d</think><answer>e</answer>"
    rows = {"good": good, "text": good.replace("</think><action>", "</think>x<action>"), "open": good[:-9], "two": good + "<answer>f</answer>"}
    got = spark.createDataFrame(list(rows.items()), "k string, x string").select("k", tx.valid_action_sequence(F.col("x")).alias("v")).collect()
    assert {r.k: r.v for r in got} == {"good": True, "text": False, "open": False, "two": False}


def test_mid_list_and_f1(spark):
    rows = [("a", "<answer>['m.1', 'm.2']</answer>", ["m.1", "m.2"]), ("b", "<answer>x</answer><ANSWER> m.1  m.3 </ANSWER>", ["m.1", "m.3"]), ("c", "<answer></answer>", None), ("d", "none", None), ("e", "<answer>[m.1]</answer>", ["[m.1]"])]
    got = {r.k: r.m for r in spark.createDataFrame([r[:2] for r in rows], "k string, x string").select("k", tx.mid_list(F.col("x")).alias("m")).collect()}
    assert got == {r[0]: r[2] for r in rows}
    r = one(spark, g=["m.1", "m.2"], p=["m.1", "m.1"]).select(tx.prf(F.col("g"), F.col("p")).alias("s")).first().s
    assert (r.p, r.r, round(r.f1, 6)) == (1.0, 0.5, round(2 / 3, 6))


def test_rollout_errors_of_repetition(spark):
    r = one(spark, x="a a a b c d").select(vd.rollout_errors(F.col("x")).alias("e")).first()
    assert r.e == ["excessive_repetition"]
    for text, share, beyond in (("b a b c b", 0.59, True), ("b a b c b", 0.6, False), ("a b c d e f g h i z z z", 0.2, True), ("a b c d", 0.25, False), ("a", 0.5, True)):
        assert one(spark, x=text).select(vd.repeats_beyond(F.split("x", " "), share).alias("v")).first().v is beyond


def test_eos_masks_of_the_documentation(spark):
    got = one(spark, t=[20, 10, 34, 1, 0, 0, 0]).select(rollout.eos_mask(F.col("t"), 1).alias("m")).first().m
    assert got == [1, 1, 1, 1, 0, 0, 0]


def test_rloo_variants_agree_beyond_one(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", 2.0), (4, "b", 5.0)], "i int, uid string, score double")
    x = {r.i: r.adv for r in rollout.rloo(df).collect()}
    y = {r.i: r.adv for r in rollout.rloo(df, vectorised=True).collect()}
    assert all(abs(x[i] - y[i]) < 1e-9 for i in (1, 2, 3)) and (x[4], y[4]) == (5.0, 0.0)


def test_opo_of_groups_without_length(spark):
    rows = [(1, "a", 1.0, 0), (2, "b", 1.0, 0), (3, "b", 0.5, 0), (4, "c", 1.0, 3), (5, "c", 0.0, 1)]
    got = {r.i: r.adv for r in rollout.opo(spark.createDataFrame(rows, "i int, uid string, score double, len int")).collect()}
    assert (got[1], got[4], got[5]) == (1.0, 0.25, -0.75) and got[2] != got[2] and got[3] != got[3]


def test_column_union_refuses_different_values(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "idx long, x double")
    assert b.union_columns(a, a.withColumn("y", F.lit(1))).count() == 2
    with pytest.raises(Exception, match="differs"):
        b.union_columns(a, a.withColumn("x", F.col("x") + 1)).collect()


def test_pad_then_unpad_is_the_same(spark):
    df = spark.range(5).select(F.col("id").alias("idx"))
    padded = b.padded(df, 12)
    assert padded.count() == 12 and b.unpadded(padded, 7).count() == 5
    assert b.padded(df.where("idx < 0"), 4).count() == 0


def test_numbered_is_consecutive(spark):
    df = b.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), "k")
    assert [(r.k, r.idx) for r in df.orderBy("k").collect()] == [(i, i) for i in range(1000)]
    assert b.numbered(spark.range(0).select(F.col("id").alias("k")), "k").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=60), st.integers(1, 8))
def test_balanced_partitions_cover_all(lengths, k):
    parts = b.balanced_partitions(lengths, k)
    assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
    assert len(parts) == k
    padded = lengths + [1] * (-len(lengths) % k)
    assert {len(p) for p in b.balanced_partitions(padded, k, equal_size=True)} == {len(padded) // k}


def test_hint_fold():
    fs = ["expression1 = START('m.a')", "expression1 = JOIN('(R p.q.r)', expression1)", "expression2 = START('x.y')", "expression1 = AND(expression1, expression2)", "expression3 = START('12')", "expression3 = CMP('lt', 'p.q.n', expression3)", "expression1 = STOP(expression1)"]
    assert etl.rewritten_hints(fs).splitlines() == ["Find_relation [ m.a | p.q.r ]", "Merge [ expression1 | x.y ]", "Compare [ lt | p.q.n | 12 ]"]
    assert etl.rewritten_hints(None) == ""


def test_messages_mask_information(spark):
    r = one(spark, x="<think>a</think>\n<action>b</action>\n<information>c</information>\n<answer>d</answer>").select(etl.message_parts(F.col("x")).alias("m")).first().m
    assert [(p.role, p.content, p.loss_mask) for p in r] == [("assistant", "<think>a</think><action>b</action>", 1), ("tool", "<information>c</information>", 0), ("assistant", "<answer>d</answer>", 1)]


def test_dump_files_skip_what_is_malformed(spark, tmp_path):
    (tmp_path / "10.jsonl").write_text('{"input": "a", "output": "b", "score": 1}\n\nnull\n[1]\n{"input": "cut\n')
    (tmp_path / "2.jsonl").write_text('{"output": "b", "input": "c", "extra": {"x": 1}}\n')
    rows = sorted((r.file_stem, r.input, r.score) for r in files.read_dumps(spark, str(tmp_path)).collect())
    assert rows == [("10", "a", 1.0), ("2", "c", None)]


def test_stream_counts_equal_batch_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = replay.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, replay.windowed(events).collect()))


def test_bootstrap_of_one_value_and_of_a_clear_majority(spark):
    import numpy as np

    assert rollout.bootstrap(np.full(5, 0.25), 3, {"max": np.max, "min": np.min}) == {"max": (0.25, 0.0), "min": (0.25, 0.0)}
    df = spark.createDataFrame([("s", "a", 1.0)] * 9 + [("s", "b", 0.0)], "source string, vote string, val double")
    got = {r.metric: r.value for r in rollout.bootstrap_majority(df, ["source"]).collect()}
    assert set(got) == {f"maj@{n}/{k}" for n in (2, 4, 8, 10) for k in ("mean", "std")}
    assert got["maj@10/mean"] > 0.99 and 0.8 < got["maj@2/mean"] < 1
    best = {r.metric: r.value for r in rollout.bootstrap_groups(df.select("source", "val"), ["source"]).collect()}
    assert best["best@10/mean"] > best["worst@10/mean"]


def test_bootstrap_draws_as_many_as_its_label_says(spark):
    """Exact chances: a vote of 50.5% of 20,000 wins 20,000 draws with 0.921 (4,096 draws: 0.739), one response in 20,000 is drawn with 0.632 (0.185)."""
    df = spark.range(20000).selectExpr("'s' AS source", "IF(id < 10100, 'a', 'b') AS vote", "IF(id < 10100, 1D, 0D) AS val")
    got = {r.metric: r.value for r in rollout.bootstrap_majority(df, ["source"]).collect()}
    assert abs(got["maj@20000/mean"] - 0.921) < 0.035 and abs(got["maj@2/mean"] - 0.505) < 0.06
    rare = spark.range(20000).selectExpr("'s' AS source", "IF(id = 7, 1D, IF(id = 8, -1D, 0D)) AS val")
    best = {r.metric: r.value for r in rollout.bootstrap_groups(rare, ["source"]).collect()}
    assert abs(best["best@20000/mean"] - 0.632) < 0.06 and abs(best["worst@20000/mean"] + 0.632) < 0.06


def test_bootstraps_replay_the_generator(spark):
    """Draw by draw over the group in order, with choice of one seeded generator."""
    from collections import defaultdict

    import numpy as np

    rng = np.random.RandomState(3)
    rows = [("s", "abcd"[rng.randint(4)], float(rng.randint(5)) / 4) for _ in range(37)] + [("t", "a", 0.5)]
    df = spark.createDataFrame(rows, "source string, vote string, val double")

    def voted(part):
        held = defaultdict(list)
        for _, vote, val in part:
            held[vote].append(val)
        most = max(held, key=lambda v: len(held[v]))
        return held[most][0]

    def replay(data, n, *reducers):
        np.random.seed(42)
        got = [[] for _ in reducers]
        for _ in range(1000):
            part = [data[i] for i in np.random.choice(len(data), size=n, replace=True)]
            for g, fn in zip(got, reducers):
                g.append(fn(part))
        return [x for g in got for x in (np.mean(g), np.std(g))]

    group = sorted(r for r in rows if r[0] == "s")
    values = sorted(r[2] for r in group)
    best = {(r.source, r.metric): r.value for r in rollout.bootstrap_groups(df.select("source", "val"), ["source"]).collect()}
    maj = {(r.source, r.metric): r.value for r in rollout.bootstrap_majority(df, ["source"]).collect()}
    for n in (2, 4, 8, 16, 32, 37):
        want = replay(values, n, max, min)
        assert [best["s", f"{k}@{n}/{m}"] for k in ("best", "worst") for m in ("mean", "std")] == pytest.approx(want)
        assert [maj["s", f"maj@{n}/{m}"] for m in ("mean", "std")] == pytest.approx(replay(group, n, voted))
    assert {s for s, _ in best} == {s for s, _ in maj} == {"s"}


def test_large_resamples_are_drawn_in_pieces(monkeypatch):
    whole = list(rollout._places(50))
    monkeypatch.setattr(rollout, "DRAWN", 16)
    for (n, name, places), (m, other, pieces) in zip(whole, rollout._places(50)):
        assert (n, name) == (m, other) and (places == pieces).all()


def test_recurrences_over_arrays(spark, monkeypatch):
    import numpy as np

    from lodestone.functions import scans
    from lodestone.operators import batch

    rng = np.random.RandomState(1)
    rows = [(i, rng.rand(n).tolist(), rng.rand(n).tolist()) for i, n in enumerate([0, 1, 5, 2000, 3, 0, 7])] + [(90, None, None), (91, [1.0], None)]
    df = spark.createDataFrame(rows, "id int, b array<double>, c array<double>")
    for cells in (1 << 20, 8):
        monkeypatch.setattr(scans, "CELLS", cells)
        got = {r.id: r.x for r in df.select("id", scans.from_the_end(F.col("b"), F.col("c")).alias("x")).collect()}
        assert got[90] is None and got[91] is None
        for i, b, c in rows[:-2]:
            want, x = [], 0.0
            for p, q in zip(b[::-1], c[::-1]):
                x = p + q * x
                want.append(x)
            assert got[i] == pytest.approx(want[::-1])
    masks = spark.createDataFrame([(1, [0, 1, 1, 0, 1]), (2, []), (3, [1] * 3)], "id int, m array<int>")
    assert {r.id: r.p for r in masks.select("id", batch.positions(F.col("m")).alias("p")).collect()} == {1: [0, 0, 1, 0, 2], 2: [], 3: [0, 1, 2]}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from lodestone import session

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Spark:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session._shared_folder(Spark())


def test_modes_in_words_are_kept():
    from lodestone.operators.etl import HintFold
    from lodestone.plans import functions_list as fl

    for words, mode in (("LESS EQUAL", "le"), ("GREATER EQUAL", "ge"), ("LESS_THAN", "lt"), ("greater  than", "gt"), ("<=", "le")):
        assert any(f"CMP('{mode}', 'a.b.c'" in x for x in fl.build(fl.parse_actions(f"<action>\nAction1: Compare [ {words} | a.b.c | 3 ]\n</action>")))
        assert HintFold([]).line(f"Action1: Compare [ {words} | a.b.c | 3 ]") == f"Compare [ {mode} | a.b.c | 3 ]"
    assert HintFold([]).line("Action1: Compare [ NOT EQUAL TO | a.b.c | 3 ]") == "Compare [ ne | a.b.c | 3 ]"
    assert HintFold([]).line("Action1: Order [ arg max | x | a.b.c ]") == "Order [ MAX | x | a.b.c ]"


def test_passages_hold_the_whole_text_of_their_hits(spark, sf_dir):
    from lodestone.plans import data_queries

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = data_queries.queries()["io16_whole_passages"](spark, sf_dir).collect()
    assert max(len(r.passages) for r in rows) > 3 * (40 + len("Doc 1: ")) + 2
    first = [r.passages.split("\nDoc 2: ")[0].removeprefix("Doc 1: ") for r in rows]
    assert set(first) <= set(text.values()) and max(map(len, first)) > 40


def test_result_lists_are_shown_to_their_limits(spark, tmp_path):
    from lodestone.plans import text_queries

    def shown(n, **limits):
        text = "<information>" + "\n".join(f"m.{i:03}" for i in range(n)) + "</information>"
        spark.createDataFrame([(1, text)], "entry_id long, output string").write.mode("overwrite").parquet(f"{tmp_path}/dump_entries.parquet")
        return (text_queries._whole_results(spark, str(tmp_path), **limits) if limits else text_queries.queries()["t25_t26_t27_whole_results"](spark, str(tmp_path))).first()

    for n in (9, 200):
        assert shown(n).shown == ", ".join(f"m.{i:03}" for i in range(n))
    assert shown(60).cut == "\n".join(f"m.{i:03}" for i in range(60))
    many = shown(201)
    assert many.shown == ", ".join(f"m.{i:03}" for i in range(50)) + ", ... (total 201 items)" and many.n == 201
    small = shown(30, whole=3, each=2, chars=118)
    assert small.shown == "m.000, m.001, ... (total 30 items)" and small.cut == "m.000\nm.001\nm.002\n... (27 more lines truncated)"
    assert shown(30, whole=3, each=2, chars=179).cut.count("m.") == 30


def test_bootstrap_reaches_the_extremes_of_many_values(spark):
    """20,000 different values: the largest is drawn by 20,000 draws with 0.632, and groups spread over tasks give the same."""
    df = spark.range(20000).selectExpr("'s' AS source", "IF(id = 7, 1000000D, IF(id = 8, -1000000D, id / 20000D)) AS val")
    df = df.unionAll(spark.range(50).selectExpr("CAST(NULL AS STRING)", "CAST(id % 9 AS DOUBLE)")).unionAll(spark.range(3).selectExpr("'t'", "CAST(id AS DOUBLE)"))
    held, spread = ({(r.source, r.n, r.metric): r.value for r in rollout.bootstrap_groups(df, ["source"], **k).collect()} for k in ({}, {"held": 8}))
    assert abs(held["s", 20000, "best@20000/mean"] / 1e6 - 0.632) < 0.06 and abs(held["s", 20000, "worst@20000/mean"] / 1e6 + 0.632) < 0.06
    assert len([k for k in held if k[0] is None]) == 6 * 4 and spread == pytest.approx(held)
