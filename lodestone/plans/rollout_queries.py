"""Queries of rollout analytics (A) and the SQL that checks them.

Group operators run over dump_entries (uid is the prompt), token operators over events: a row's mask covers event_id % 7 of 6
tokens, and the other arrays are simple functions of event_id and the token's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import validators as vd
from lodestone.operators import rollout as ro
from lodestone.session import table

T = 6
NUDGE = 1e-9
C = F.col
E = F.expr


def rollouts(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "dump_entries").where("input IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return df.select("entry_id", F.md5("input").alias("uid"), (C("score") + 0.0).alias("score"), F.coalesce(F.length("output"), F.lit(0)).alias("len"), "step", F.coalesce("file_stem", F.lit("")).alias("source"), F.coalesce("mid_f1", F.lit(0.0)).alias("mid_f1"), (C("entry_id") % 3).alias("pred"))


def _array(x: str):
    return E(f"transform(sequence(1, {T}), i -> CAST({x} AS DOUBLE))")


def tokens(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "events").select("event_id", C("user_id").alias("uid"), F.coalesce("value", F.lit(0.0)).alias("score"))
    return df.select("*", *[_array(x).alias(n) for n, x in _ARRAYS.items()])


_ARRAYS = {
    "m": "CASE WHEN i <= event_id % 7 THEN 1 ELSE 0 END",
    "r": "CASE WHEN i = event_id % 7 THEN score ELSE 0 END",
    "v": "CAST((event_id + i) % 9 AS DOUBLE) / 10",
    "old": "-CAST(1 + (event_id * i) % 5 AS DOUBLE) / 10",
    "new": "-CAST(1 + (event_id * i) % 7 AS DOUBLE) / 10",
    "ref": "-CAST(1 + (event_id + 2 * i) % 6 AS DOUBLE) / 10",
    "roll": "-CAST(1 + (event_id + i) % 8 AS DOUBLE) / 10",
    "adv": "CAST((event_id + i) % 9 AS DOUBLE) / 10 - 0.4",
    "pred": "CAST((event_id * i) % 10 AS DOUBLE) / 5",
    "returns": "CAST((event_id + 3 * i) % 11 AS DOUBLE) / 5",
}


def _r(x):
    """x to 6 places; the shift keeps exact halves from falling either way with the order of a sum."""
    return F.round(x + NUDGE, 6)


def _per_token(df: DataFrame, *arrays: str) -> DataFrame:
    """(event_id, i, arrays) with values rounded to 6 places."""
    return df.select("event_id", F.posexplode(F.arrays_zip(*arrays)).alias("i", "t")).select("event_id", (C("i") + 1).alias("i"), *[_r(C(f"t.{a}")).alias(a) for a in arrays])


def _adv(fn):
    return lambda s, d: fn(rollouts(s, d)).select("entry_id", _r(C("adv")).alias("adv"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r(C(c)).alias(c) if t == "double" else C(c) for c, t in df.dtypes])


def _losses(s: SparkSession, d: str) -> DataFrame:
    df, out = tokens(s, d), None
    df = df.withColumn("_l", F.zip_with("new", "old", lambda a, b: a - b))
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        part = ro.aggregate_loss(df, "_l", mode).select(F.lit(mode).alias("mode"), "loss")
        out = part if out is None else out.unionAll(part)
    return _rounded(out)


def _weights(s: SparkSession, d: str) -> DataFrame:
    out = None
    for level in ("token", "sequence", "geometric"):
        for mode in ("truncate", "mask"):
            part = _per_token(ro.importance_weights(tokens(s, d), level, mode, veto=0.55), "w").select(F.lit(level).alias("level"), F.lit(mode).alias("mode"), "event_id", "i", "w")
            out = part if out is None else out.unionAll(part)
    return out


def _masked(s: SparkSession, d: str) -> DataFrame:
    tok = tokens(s, d)
    white = ro.whitened(tok.withColumn("w", C("v")), "w")
    return _rounded(white.agg((F.sum(ro.masked_sum("v")) / (F.sum(ro.mask_size()) + 1e-8)).alias("mean"), F.sum(ro.masked_sum(F.transform("w", lambda x: x * x))).alias("white_squares"), F.sum(ro.mask_size()).alias("n")))


def _data_metrics(s: SparkSession, d: str) -> DataFrame:
    df = tokens(s, d).withColumns({"n": ro.mask_size(), "total": F.aggregate("r", F.lit(0.0), lambda a, x: a + x)})
    tok = df.select(F.explode(F.arrays_zip("m", "v", "returns", "adv")).alias("t")).where("t.m > 0").select("t.*")
    live = F.when(C("n") > 0, C("total"))
    rows = df.agg(F.avg(live).alias("score_mean"), F.max(live).alias("score_max"), F.min(live).alias("score_min"), F.avg("n").alias("length_mean"), F.max("n").alias("length_max"), F.min("n").alias("length_min"), F.avg((C("n") == T).cast("double")).alias("clip_ratio"), F.avg((C("n") == 0).cast("double")).alias("aborted_ratio"))
    var = tok.agg(F.avg("adv").alias("adv_mean"), F.max("adv").alias("adv_max"), F.min("adv").alias("adv_min"), F.avg("returns").alias("returns_mean"), F.avg("v").alias("values_mean"), (1 - F.var_samp(C("returns") - C("v")) / (F.var_samp("returns") + 1e-5)).alias("explained_var"))
    return _rounded(rows.withColumn("_one", F.lit(1)).join(F.broadcast(var.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def _validation(s: SparkSession, d: str) -> DataFrame:
    """(source, variable, metric, value): mean@N and std@N per prompt, then their mean over prompts of one N."""
    long = rollouts(s, d).select("source", "uid", F.stack(F.lit(2), F.lit("score"), C("score"), F.lit("mid_f1"), C("mid_f1")).alias("variable", "val"))
    per = long.groupBy("source", "variable", "uid").agg(F.count("*").alias("n"), F.avg("val").alias("mean"), F.stddev_pop("val").alias("std"))
    named = per.select("source", "variable", "n", F.stack(F.lit(2), F.lit("mean@"), C("mean"), F.lit("std@"), C("std")).alias("k", "x")).where("k = 'mean@' OR n > 1")
    return named.groupBy("source", "variable", F.concat("k", C("n").cast("string")).alias("metric")).agg(_r(F.avg("x")).alias("value"))


def _reduced(s: SparkSession, d: str) -> DataFrame:
    long = rollouts(s, d).select(F.stack(F.lit(3), F.lit("score/max"), C("score"), F.lit("score/min"), C("score"), F.lit("score/mean"), C("score")).alias("metric", "x"))
    pick = F.when(C("metric").contains("max"), F.max("x")).when(C("metric").contains("min"), F.min("x")).otherwise(F.avg("x"))
    return long.groupBy("metric").agg(F.max("x").alias("hi"), F.min("x").alias("lo"), F.avg("x").alias("mu")).select("metric", _r(F.when(C("metric").contains("max"), C("hi")).when(C("metric").contains("min"), C("lo")).otherwise(C("mu"))).alias("value"))


def _actions(s: SparkSession, d: str) -> DataFrame:
    """(step, attempts, successes, rate): an action succeeds if its output's information holds a result."""
    df = table(s, d, "dump_entries").where("output IS NOT NULL AND step IS NOT NULL")
    blocks = F.size(tx.tagged(C("output"), "action"))
    good = F.size(F.filter(tx.tagged(C("output"), "information"), lambda b: b.rlike(r"[mg]\.\w+")))
    return df.groupBy("step").agg(F.sum(blocks).alias("attempts"), F.sum(good).alias("successes")).select("step", "attempts", "successes", _r(F.when(C("attempts") > 0, C("successes") / C("attempts")).otherwise(0.0)).alias("rate"))


def _timeouts(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "dump_entries").where("output IS NOT NULL")
    hit = vd.timeout(C("output")).cast("long")
    return df.rollup("step").agg(F.sum(hit).alias("timeouts"), F.count("*").alias("n"), F.grouping("step").cast("int").alias("total"))


def _history(s: SparkSession, d: str) -> DataFrame:
    """(step, mean, max, min, std, recent): recent is the mean of the last 5 steps' means. Steps are few."""
    from pyspark.sql import Window

    per = rollouts(s, d).where("step IS NOT NULL").groupBy("step").agg(F.avg("score").alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.stddev_pop("score").alias("std"))
    return _rounded(per.withColumn("recent", F.avg("mean").over(Window.orderBy("step").rowsBetween(-4, 0))))


def _registry(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(n,) for n in sorted(ro.ESTIMATORS)], "estimator string")


def _kl_steps(s: SparkSession, d: str) -> DataFrame:
    v, rows = 0.1, []
    for i, current in enumerate((0.02, 0.2, 0.11, 0.1)):
        v = ro.kl_controller(v, current, 0.1, 256, 10_000)
        rows.append((i, round(v, 6)))
    return s.createDataFrame(rows, "step int, value double")


def queries() -> dict:
    tok = lambda fn: lambda s, d: _rounded(fn(tokens(s, d)))
    wts = lambda m: lambda s, d: ro.reweights(rollouts(s, d), m).select("entry_id", _r(C("weight")).alias("weight"))
    return {
        "a01_grpo": _adv(ro.grpo),
        "a01_grpo_unscaled": _adv(lambda df: ro.grpo(df, normalise=False)),
        "a02_grpo_vectorised": _adv(ro.grpo_floored),
        "a03_grpo_passk": _adv(lambda df: ro.grpo_passk(df, "entry_id")),
        "a04_reinforce_baseline": lambda s, d: _per_token(ro.reinforce_baseline(tokens(s, d)), "adv"),
        "a05_rloo": _adv(ro.rloo),
        "a05v_rloo_vectorised": _adv(lambda df: ro.rloo(df, vectorised=True)),
        "a06_opo": _adv(ro.opo),
        "a07_reinforce_plus": lambda s, d: _per_token(ro.reinforce_plus(tokens(s, d), 0.9), "adv"),
        "a08_remax": lambda s, d: _per_token(ro.remax(tokens(s, d), F.lit(0.5)), "adv", "returns"),
        "a09_gpg": _adv(ro.gpg),
        "a10_gae": lambda s, d: _per_token(ro.gae(tokens(s, d), 0.9, 0.8), "adv", "returns"),
        "a11_registry": _registry,
        "a12_weights_pow": wts("pow"),
        "a12_weights_max_min": wts("max_min"),
        "a12_weights_max_random": wts("max_random"),
        "a12_resampled": lambda s, d: ro.resampled(ro.reweights(rollouts(s, d), "pow"), "entry_id"),
        "a13_kl_reward": lambda s, d: _per_token(tokens(s, d).withColumn("kr", ro.zipped(lambda r, n, f, m: r - 0.1 * (n - f) * m, "r", "new", "ref", "m")), "kr"),
        "a14_kl_estimators": lambda s, d: _per_token(tokens(s, d).withColumns({k: ro.zipped(lambda n, f, k=k: ro.kl(k, n, f), "new", "ref") for k in ("k1", "abs", "k2", "k3")}), "k1", "abs", "k2", "k3"),
        "a15_kl_controller": _kl_steps,
        "a16_loss_modes": _losses,
        "a17_ppo_loss": tok(ro.ppo_loss),
        "a18_gspo_loss": tok(ro.gspo_loss),
        "a18_gpg_loss": tok(ro.gpg_loss),
        "a18_geo_mean_loss": tok(ro.geo_mean_loss),
        "a18_kl_cov_loss": tok(lambda df: ro.kl_cov_loss(df, "event_id")),
        "a18_clip_cov_loss": tok(lambda df: ro.clip_cov_loss(df, "event_id")),
        "a19_value_loss": tok(ro.value_loss),
        "a20_masked_stats": _masked,
        "a21_eos_mask": lambda s, d: _per_token(tokens(s, d).withColumn("eos", ro.eos_mask(E(f"transform(sequence(1, {T}), i -> CAST((event_id * i) % 5 AS INT))"), 0)), "eos"),
        "a22_importance_weights": _weights,
        "a23_importance_metrics": tok(lambda df: ro.importance_metrics(ro.importance_weights(df, "token", "truncate", veto=0.55))),
        "a24_mismatch": tok(ro.mismatch_metrics),
        "a25_data_metrics": _data_metrics,
        "a26_timing": tok(lambda df: df.agg((F.sum("score") / F.sum(ro.mask_size())).alias("per_token"), (F.sum(ro.mask_size()) / F.lit(60.0) / 8).alias("throughput"))),
        "a27_bootstrap": lambda s, d: _rounded(ro.bootstrap_groups(rollouts(s, d).select("source", "uid", C("score").alias("val")), ["source", "uid"])),
        "a29_bootstrap_majority": lambda s, d: _rounded(ro.bootstrap_majority(rollouts(s, d).select("source", C("pred").alias("vote"), C("score").alias("val")), ["source"])),
        "a28_majority": lambda s, d: ro.majority(rollouts(s, d), ["uid"], "pred", "score", "entry_id"),
        "a29_validation": _validation,
        "a30_reduced": _reduced,
        "a31_test_score": lambda s, d: _rounded(rollouts(s, d).groupBy("source", "uid").agg(F.avg("score").alias("m")).groupBy("source").agg(F.avg("m").alias("score"))),
        "a32_varied_groups": lambda s, d: ro.varied_groups(rollouts(s, d)).select("entry_id"),
        "a33_action_stats": _actions,
        "a34_timeouts": _timeouts,
        "a35_truncation": tok(lambda df: df.withColumn("n", ro.mask_size()).agg(F.avg((C("n") >= T).cast("double")).alias("clip_ratio"), F.avg("n").alias("mean_length"), F.avg(C("n") / T).alias("mean_ratio"), F.max("n").alias("longest"))),
        "a36_reward_history": _history,
        "a38_coverage": tok(lambda df: df.agg((F.sum(ro.masked_sum(F.transform("v", lambda v: (v > 0.2).cast("double")))) / F.sum(ro.mask_size())).alias("coverage"))),
        "a39_error_summary": lambda s, d: table(s, d, "dump_entries").where("output IS NOT NULL").select(F.explode(vd.rollout_errors(C("output"))).alias("error")).groupBy("error").agg(F.count("*").alias("n")),
    }


_R = """r AS (SELECT entry_id, md5(input) AS uid, score + 0.0 AS score, coalesce(len(output), 0) AS len, step, coalesce(file_stem, '') AS source, coalesce(mid_f1, 0.0) AS mid_f1, entry_id % 3 AS pred
FROM dump_entries WHERE input IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
g AS (SELECT uid, count(*) AS n, avg(score) AS mu, CASE WHEN count(*) > 1 THEN stddev_samp(score) END AS sd, sum(score) AS total, sum(len * score) / sum(len) AS opo, stddev_pop(score) AS sp FROM r GROUP BY uid)"""
_J = f"WITH {_R}, j AS (SELECT *, CASE WHEN n = 1 THEN 0.0 ELSE mu END AS mean0, CASE WHEN n = 1 THEN 1.0 ELSE sd END AS std0 FROM r JOIN g USING (uid)) "
_TOK = "e AS (SELECT event_id, user_id AS uid, coalesce(value, 0.0) AS score FROM events), t AS (SELECT event_id, uid, score, i, " + ", ".join(f'CAST({x} AS DOUBLE) AS "{n}"' for n, x in _ARRAYS.items()) + f" FROM e, (SELECT unnest(range(1, {T + 1})) AS i))"
_W = f"WITH {_TOK} "


def _white(x: str, source: str) -> str:
    return f"w AS (SELECT sum({x} * m) / (sum(m) + 1e-8) AS wm, sum(m) AS wn FROM {source}), w2 AS (SELECT wm, sum(({x} - wm) * ({x} - wm) * m) / (sum(m) + 1e-8) * any_value(wn) / (any_value(wn) - 1) AS wv FROM {source}, w GROUP BY wm)"


def _nudged(sql: str) -> str:
    """Every round(x, 6) as round((x) + NUDGE, 6)."""
    out, pos = "", 0
    while (at := sql.find("round(", pos)) >= 0:
        depth, i = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[at + 6 : i - 1]
        x, _, places = inner.rpartition(",")
        out += sql[pos:at] + (f"round(({_nudged(x)})::DOUBLE + {NUDGE}, 6)" if places.strip() == "6" else f"round({_nudged(x)},{places})")
        pos = i
    return out + sql[pos:]


def oracle_sql() -> dict[str, str]:
    return {k: _nudged(v) for k, v in _sql().items()}


def _sql() -> dict[str, str]:
    def mean(x: str) -> str:
        return f"round(sum(({x}) * m) / (sum(m) + 1e-8), 6)"

    ratio = "exp(greatest(least(new - old, 20.0), -20.0))"
    l1, l2 = f"(-adv * {ratio})", f"(-adv * greatest(least({ratio}, 1.2), 0.8))"
    c1 = f"greatest({l1}, {l2})"
    seq = "SELECT event_id, sum(m) AS n, sum(x * m) AS s FROM x GROUP BY event_id"
    held = "greatest(least(pred, v + 0.5), v - 0.5)"
    is_cte = f"""{_TOK}, q AS (SELECT event_id, sum((old - roll) * m) AS ls, sum((old - roll) * m) / (sum(m) + 1e-8) AS lm, max((old - roll < ln(0.55) AND m > 0)::INT) AS bad FROM t GROUP BY event_id)"""
    raw = {"token": "exp(old - roll)", "sequence": "exp(greatest(least(ls, 20.0), -20.0))", "geometric": "exp(lm)"}
    lim = {"truncate": lambda x: f"least({x}, 1.2)", "mask": lambda x: f"CASE WHEN {x} >= 1 / 1.2::DOUBLE AND {x} <= 1.2 THEN {x} ELSE 0.0 END"}
    upper, lower = "1.2::DOUBLE", "(1 / 1.2::DOUBLE)"
    errs = vd.rollout_errors_sql("output")
    adv = lambda x: _J + f"SELECT entry_id, round({x}, 6) AS adv FROM j"
    wt = lambda x: f"WITH {_R}, a AS (SELECT max(score) AS hi, min(score) AS lo FROM r) SELECT entry_id, round(greatest({x} + 1e-8, 1e-8), 6) AS weight FROM r, a"
    act = "regexp_extract_all(output, '(?s)<action>(.*?)</action>', 1)"
    info = "list_filter(regexp_extract_all(output, '(?s)<information>(.*?)</information>', 1), lambda b: regexp_matches(b, '[mg]\\.\\w+'))"
    return {
        "a01_grpo": adv("(score - mean0) / (std0 + 1e-6)"),
        "a01_grpo_unscaled": adv("score - mean0"),
        "a02_grpo_vectorised": adv("(score - mean0) / (CASE WHEN n = 1 THEN 1.0 ELSE sqrt(greatest(std0 * std0, 1e-6)) END + 1e-6)"),
        "a03_grpo_passk": _J + "SELECT entry_id, round(CASE WHEN k = 1 THEN (score - nxt) / (sd + 1e-6) ELSE 0.0 END, 6) AS adv FROM (SELECT *, row_number() OVER o AS k, lead(score) OVER o AS nxt FROM j WHERE n > 1 WINDOW o AS (PARTITION BY uid ORDER BY score DESC, entry_id))",
        "a04_reinforce_baseline": f"WITH {_TOK}, g AS (SELECT uid, CASE WHEN count(*) = 1 THEN 0.0 ELSE avg(score) END AS mu FROM e GROUP BY uid), x AS (SELECT event_id, i, m, (score - mu) * m AS a FROM t JOIN g USING (uid)), {_white('a', 'x')} SELECT event_id, i::INT AS i, round((a - wm) / sqrt(wv + 1e-8) * m, 6) AS adv FROM x, w2",
        "a05_rloo": adv("CASE WHEN n > 1 THEN (score - mu) * n / (n - 1) ELSE score END"),
        "a05v_rloo_vectorised": adv("(n * score - total) / greatest(n - 1, 1)"),
        "a06_opo": adv("score - CASE WHEN n = 1 THEN 0.0 ELSE opo END"),
        "a07_reinforce_plus": f"WITH {_TOK}, x AS (SELECT a.event_id, a.i, a.m, a.r + coalesce(sum(b.r * pow(0.9::DOUBLE, b.i - a.i)) FILTER (b.i > a.i AND b.m = 1), 0.0) AS a FROM t a JOIN t b ON a.event_id = b.event_id GROUP BY a.event_id, a.i, a.m, a.r), {_white('a', 'x')} SELECT event_id, i::INT AS i, round((a - wm) / sqrt(wv + 1e-8) * m, 6) AS adv FROM x, w2",
        "a08_remax": _W + "SELECT event_id, i::INT AS i, round(returns - 0.5 * m, 6) AS adv, round(returns, 6) AS returns FROM (SELECT event_id, i, m, sum(r * m) OVER (PARTITION BY event_id ORDER BY i DESC) AS returns FROM t)",
        "a09_gpg": _J + ", a AS (SELECT count(*) AS c, count(*) FILTER (score <> 0) AS h FROM r) SELECT entry_id, round(c::DOUBLE / greatest(h, 1) * (score - mean0), 6) AS adv FROM j, a",
        "a10_gae": f"WITH {_TOK}, dl AS (SELECT *, r + 0.9 * coalesce(lead(v * m) OVER (PARTITION BY event_id ORDER BY i), 0.0) - v AS delta FROM t), x AS (SELECT a.event_id, a.i, a.m, a.v, coalesce(sum(b.delta * pow(0.72::DOUBLE, b.i - a.i)) FILTER (b.i >= a.i AND b.m = 1 AND a.m = 1), 0.0) AS a FROM dl a JOIN dl b ON a.event_id = b.event_id GROUP BY a.event_id, a.i, a.m, a.v), {_white('a', 'x')} SELECT event_id, i::INT AS i, round((a - wm) / sqrt(wv + 1e-8), 6) AS adv, round(a + v, 6) AS returns FROM x, w2",
        "a11_registry": "SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in ("gae", "gpg", "grpo", "grpo_passk", "grpo_vectorized", "opo", "reinforce_plus_plus", "reinforce_plus_plus_baseline", "remax", "rloo", "rloo_vectorized")) + ") t(estimator)",
        "a12_weights_pow": wt("pow(abs(score), 2)"),
        "a12_weights_max_min": wt("CASE WHEN score = hi OR score = lo THEN 1.0::DOUBLE ELSE 0.0 END"),
        "a12_weights_max_random": wt("CASE WHEN score = hi THEN 0.4::DOUBLE ELSE 0.1 END"),
        "a13_kl_reward": _W + "SELECT event_id, i::INT AS i, round(r - 0.1 * (new - ref) * m, 6) AS kr FROM t",
        "a14_kl_estimators": _W + "SELECT event_id, i::INT AS i, round(new - ref, 6) AS k1, round(abs(new - ref), 6) AS abs, round(0.5 * (new - ref) * (new - ref), 6) AS k2, round(exp(ref - new) - (ref - new) - 1, 6) AS k3 FROM t",
        "a15_kl_controller": "WITH RECURSIVE k(step, value) AS (SELECT -1, 0.1::DOUBLE UNION ALL SELECT step + 1, value * (1 + greatest(least([0.02, 0.2, 0.11, 0.1][step + 2]::DOUBLE / 0.1 - 1, 0.2), -0.2) * 256 / 10000) FROM k WHERE step < 3) SELECT step, round(value, 6) AS value FROM k WHERE step >= 0",
        "a16_loss_modes": f"WITH {_TOK}, x AS (SELECT *, new - old AS x FROM t), q AS ({seq}) SELECT 'token-mean' AS mode, round(sum(s) / (sum(n) + 1e-8), 6) AS loss FROM q UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) FROM q UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / (n + 1e-8)), 6) FROM q UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / {T}, 6) FROM q",
        "a17_ppo_loss": _W + f"SELECT {mean(f'CASE WHEN adv < 0 THEN least(-adv * 3.0, {c1}) ELSE {c1} END')} AS loss, {mean(f'({l2} > {l1})::INT')} AS clipfrac, {mean('-(new - old)')} AS ppo_kl, {mean(f'({c1} > -adv * 3.0 AND adv < 0)::INT')} AS clipfrac_lower FROM t",
        "a18_gspo_loss": f"WITH {_TOK}, q AS (SELECT event_id, exp(least(sum((new - old) * m) / greatest(sum(m), 1), 10.0)) AS sr FROM t GROUP BY event_id), x AS (SELECT event_id, m, greatest(-adv * sr, -adv * greatest(least(sr, 1.2), 0.8)) AS x FROM t JOIN q USING (event_id)), y AS ({seq}) SELECT round(avg(s / (n + 1e-8)), 6) AS loss FROM y",
        "a18_gpg_loss": _W + f"SELECT {mean('-new * adv')} AS loss FROM t",
        "a18_geo_mean_loss": _W + "SELECT round(avg(-a * exp(k)), 6) AS loss FROM (SELECT event_id, sum(sign(adv) * least(sign(adv) * (new - old), sign(adv) * greatest(least(new - old, 0.2), -0.2)) * m) / (sum(m) + 1e-8) AS k, sum(adv * m) / (sum(m) + 1e-8) AS a FROM t GROUP BY event_id)",
        "a18_kl_cov_loss": f"WITH {_TOK}, u AS (SELECT *, avg(adv) OVER () AS ma, avg(new) OVER () AS mn, count(*) OVER () AS c FROM t WHERE m > 0), k AS (SELECT *, row_number() OVER (ORDER BY round((adv - ma) * (new - mn), 9) DESC, event_id, i) AS p FROM u) SELECT round(sum(-adv * exp(new - old) + CASE WHEN p <= greatest(floor(c * 0.01), 1) THEN abs(new - old) ELSE 0 END) / (count(*) + 1e-8), 6) AS loss FROM k",
        "a19_value_loss": _W + f"SELECT {mean(f'0.5 * greatest((pred - returns) * (pred - returns), ({held} - returns) * ({held} - returns))')} AS loss, {mean(f'(({held} - returns) * ({held} - returns) > (pred - returns) * (pred - returns))::INT')} AS clipfrac FROM t",
        "a20_masked_stats": f"WITH {_TOK}, {_white('v', 't')} SELECT round(any_value(wm), 6) AS mean, round(sum((v - wm) * (v - wm) / (wv + 1e-8) * m), 6) AS white_squares, sum(m) AS n FROM t, w2",
        "a21_eos_mask": _W + "SELECT event_id, i::INT AS i, (i <= coalesce(min(CASE WHEN (event_id * i) % 5 = 0 THEN i END) OVER (PARTITION BY event_id), 99))::INT::DOUBLE AS eos FROM t",
        "a22_importance_weights": f"WITH {is_cte} " + " UNION ALL ".join(f"SELECT '{lv}' AS level, '{md}' AS mode, event_id, i::INT AS i, round(CASE WHEN bad = 1 THEN 0.0 ELSE ({lim[md](raw[lv])}) * m END, 6)::DOUBLE AS w FROM t JOIN q USING (event_id)" for lv in raw for md in lim),
        "a23_importance_metrics": f"""WITH {is_cte}, k AS (SELECT exp(old - roll) AS x, greatest(least(exp(old - roll), {upper}), {lower}) AS c FROM t WHERE m > 0), s AS (SELECT event_id, sum(exp(old - roll) * m) / (sum(m) + 1e-8) AS s FROM t GROUP BY event_id),
 f AS (SELECT round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(min(x), 6) AS min, round(avg((x > {upper})::INT), 6) AS high, round(avg((x < {lower})::INT), 6) AS low, round(sqrt(greatest(avg(c * c) - avg(c) * avg(c), 0)), 6) AS std, round(avg(c) * avg(c) / avg(c * c), 6) AS ess, {', '.join(f'round(quantile_cont(x, {p}), 6) AS p{int(p * 100)}' for p in (0.25, 0.5, 0.75, 0.95, 0.99))} FROM k),
 h AS (SELECT round(avg(s), 6) AS seq_mean, round(stddev_samp(s), 6) AS seq_std, round(max(s), 6) AS seq_max, round(min(s), 6) AS seq_min, round(max(abs(s - 1)), 6) AS seq_max_deviation, round(avg(bad), 6) AS veto_fraction FROM s JOIN q USING (event_id)) SELECT * FROM f, h""",
        "a24_mismatch": f"""WITH {_TOK}, y AS (SELECT event_id, sum(old * m) / (sum(m) + 1e-8) AS t, sum(roll * m) / (sum(m) + 1e-8) AS r, sum((roll - old) * m) AS k, sum((exp(old - roll) - (old - roll) - 1) * m) AS k3, sum(m) AS n FROM t GROUP BY event_id)
 SELECT round(avg(exp(-t)), 6) AS training_ppl, round(avg(-t), 6) AS training_log_ppl, round(avg(exp(-r)), 6) AS rollout_ppl, round(avg(-r), 6) AS rollout_log_ppl, round(sum(k) / (sum(n) + 1e-8), 6) AS kl, round(sum(k3) / (sum(n) + 1e-8), 6) AS k3_kl, round(avg(r - t), 6) AS log_ppl_diff, round(avg(abs(r - t)), 6) AS log_ppl_abs_diff, round(max(r - t), 6) AS log_ppl_diff_max, round(min(r - t), 6) AS log_ppl_diff_min, round(avg(exp(r - t)), 6) AS ppl_ratio FROM y""",
        "a25_data_metrics": f"""WITH {_TOK}, y AS (SELECT event_id, sum(r) AS s, sum(m) AS n FROM t GROUP BY event_id), a AS (SELECT round(avg(s) FILTER (n > 0), 6) AS score_mean, round(max(s) FILTER (n > 0), 6) AS score_max, round(min(s) FILTER (n > 0), 6) AS score_min, round(avg(n), 6) AS length_mean, max(n) AS length_max, min(n) AS length_min, round(avg((n = {T})::INT), 6) AS clip_ratio, round(avg((n = 0)::INT), 6) AS aborted_ratio FROM y),
 b AS (SELECT round(avg(adv), 6) AS adv_mean, round(max(adv), 6) AS adv_max, round(min(adv), 6) AS adv_min, round(avg(returns), 6) AS returns_mean, round(avg(v), 6) AS values_mean, round(1 - var_samp(returns - v) / (var_samp(returns) + 1e-5), 6) AS explained_var FROM t WHERE m > 0) SELECT * FROM a, b""",
        "a26_timing": _W + "SELECT round((SELECT sum(score) FROM e) / sum(m), 6) AS per_token, round(sum(m) / 60.0::DOUBLE / 8, 6) AS throughput FROM t",
        "a28_majority": f"WITH {_R}, p AS (SELECT uid, pred, count(*) AS n, min(entry_id) AS f, arg_min(score, entry_id) AS v FROM r GROUP BY uid, pred) SELECT uid, pred AS vote, n, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) AS k FROM p) WHERE k = 1",
        "a29_validation": f"WITH {_R}, l AS (SELECT source, uid, 'score' AS variable, score AS val FROM r UNION ALL SELECT source, uid, 'mid_f1', mid_f1 FROM r), p AS (SELECT source, variable, uid, count(*) AS n, avg(val) AS mu, stddev_pop(val) AS sd FROM l GROUP BY ALL) SELECT source, variable, 'mean@' || n AS metric, round(avg(mu), 6) AS value FROM p GROUP BY source, variable, n UNION ALL SELECT source, variable, 'std@' || n, round(avg(sd), 6) FROM p WHERE n > 1 GROUP BY source, variable, n",
        "a30_reduced": f"WITH {_R} SELECT 'score/max' AS metric, round(max(score), 6) AS value FROM r UNION ALL SELECT 'score/min', round(min(score), 6) FROM r UNION ALL SELECT 'score/mean', round(avg(score), 6) FROM r",
        "a31_test_score": f"WITH {_R} SELECT source, round(avg(m), 6) AS score FROM (SELECT source, uid, avg(score) AS m FROM r GROUP BY ALL) GROUP BY source",
        "a32_varied_groups": f"WITH {_R} SELECT entry_id FROM r JOIN g USING (uid) WHERE sp > 0 OR n = 1",
        "a33_action_stats": f"SELECT step, a::BIGINT AS attempts, b::BIGINT AS successes, round(CASE WHEN a > 0 THEN b::DOUBLE / a ELSE 0.0 END, 6) AS rate FROM (SELECT step, sum(len({act})) AS a, sum(len({info})) AS b FROM dump_entries WHERE output IS NOT NULL AND step IS NOT NULL GROUP BY step)",
        "a34_timeouts": "SELECT step, sum(regexp_matches(output, '(?i)hyt00|cl066|timeout')::INT)::BIGINT AS timeouts, count(*) AS n, grouping(step)::INT AS total FROM dump_entries WHERE output IS NOT NULL GROUP BY ROLLUP (step)",
        "a35_truncation": _W + f"SELECT round(avg((n >= {T})::INT), 6) AS clip_ratio, round(avg(n), 6) AS mean_length, round(avg(n / {T}), 6) AS mean_ratio, max(n) AS longest FROM (SELECT sum(m) AS n FROM t GROUP BY event_id)",
        "a36_reward_history": f"WITH {_R}, p AS (SELECT step, avg(score) AS mu, max(score) AS hi, min(score) AS lo, stddev_pop(score) AS sd FROM r WHERE step IS NOT NULL GROUP BY step) SELECT step, round(mu, 6) AS mean, round(hi, 6) AS max, round(lo, 6) AS min, round(sd, 6) AS std, round(avg(mu) OVER (ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS recent FROM p",
        "a38_coverage": _W + "SELECT round(sum((v > 0.2)::INT * m) / sum(m), 6) AS coverage FROM t",
        "a39_error_summary": f"SELECT error, count(*) AS n FROM (SELECT unnest({errs}) AS error FROM dump_entries WHERE output IS NOT NULL) GROUP BY error",
    }
