"""Group-relative advantages, masked token statistics, policy losses and rollout metrics.

Rows are rollouts; token-level columns are arrays of one length. Group statistics are aggregated first and joined back, so a
group with a third of all rows is combined on the map side and split by adaptive execution, never held by one window task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scans import following, from_the_end
from lodestone.operators.batch import numbered
from lodestone.session import cut

EPS = 1e-6
DRAWN = 1 << 20
WHITEN_EPS = 1e-8
C = F.col


def with_groups(df: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """df with the group statistics of its key."""
    return df.join(df.groupBy(key).agg(*[a.alias(n) for n, a in aggs.items()]), key)


def with_total(df: DataFrame, **aggs: Column) -> DataFrame:
    """df with statistics of all its rows: one row, sent to every task."""
    total = df.agg(*[a.alias(n) for n, a in aggs.items()]).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def zipped(fn: Callable[..., Column], *arrays: str) -> Column:
    """Array of fn over the elements of several array columns."""
    return F.transform(F.arrays_zip(*arrays), lambda z: fn(*[z[a] for a in arrays]))


def masked_sum(x: Column | str, mask: str = "m") -> Column:
    """Sum where the mask is 1; what stands elsewhere, NaN too, has no effect."""
    x = C(x) if isinstance(x, str) else x
    return F.aggregate(F.zip_with(x, C(mask), lambda a, b: F.when(b > 0, a).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)


def mask_size(mask: str = "m") -> Column:
    return F.aggregate(mask, F.lit(0.0), lambda a, v: a + v)


# Outcome estimators: rows (uid, score) -> adv. A group of one has mean 0 and standard deviation 1 unless said otherwise.
def _moments(df: DataFrame) -> DataFrame:
    df = with_groups(df, "uid", _n=F.count("*"), _mu=F.avg("score"), _sd=F.stddev_samp("score"), _sum=F.sum("score"))
    return df.withColumn("_mean", F.when(C("_n") == 1, 0.0).otherwise(C("_mu"))).withColumn("_std", F.when(C("_n") == 1, 1.0).otherwise(C("_sd")))


def grpo(df: DataFrame, normalise: bool = True) -> DataFrame:
    d = C("score") - C("_mean")
    return _moments(df).withColumn("adv", d / (C("_std") + EPS) if normalise else d)


def grpo_floored(df: DataFrame) -> DataFrame:
    """As grpo, with variances below 1e-6 taken as 1e-6."""
    sd = F.when(C("_n") == 1, 1.0).otherwise(F.sqrt(F.greatest(C("_std") * C("_std"), F.lit(EPS))))
    return _moments(df).withColumn("adv", (C("score") - C("_mean")) / (sd + EPS))


def grpo_passk(df: DataFrame, row_id: str) -> DataFrame:
    """Only the best row of a group gets the lead over the second, by standard deviation; ties go to the lower id. Groups of one
    are left out."""
    best = F.max(F.struct("score", (-C(row_id)).alias("i")))
    top = df.groupBy("uid").agg(best.alias("_b"), F.stddev_samp("score").alias("_sd"), F.count("*").alias("_n"))
    top = top.where("_n > 1")
    joined = df.join(top, "uid")
    first = C(row_id) == -C("_b.i")
    second = joined.where(~first).groupBy("uid").agg(F.max("score").alias("_second"))
    return joined.join(second, "uid").withColumn("adv", F.when(first, (C("score") - C("_second")) / (C("_sd") + EPS)).otherwise(0.0))


def rloo(df: DataFrame, vectorised: bool = False) -> DataFrame:
    n = C("_n")
    if vectorised:
        adv = (n * C("score") - C("_sum")) / F.greatest(n - 1, F.lit(1))
    else:
        adv = F.when(n > 1, (C("score") - C("_mu")) * n / (n - 1)).otherwise(C("score"))
    return _moments(df).withColumn("adv", adv)


def opo(df: DataFrame) -> DataFrame:
    """The baseline weighs scores by length; a group of one has baseline 0. That of several rows without any length is NaN, as 0 / 0 is in the reference."""
    total = F.sum("len")
    d = with_groups(df, "uid", _n=F.count("*"), _b=F.when(total != 0, F.sum(C("len") * C("score")) / total).otherwise(float("nan")))
    return d.withColumn("adv", C("score") - F.when(C("_n") == 1, 0.0).otherwise(C("_b")))


def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    d = with_total(_moments(df), _all=F.count("*"), _hit=F.count(F.when(C("score") != 0, 1)))
    return d.withColumn("adv", C("_all") / F.greatest(C("_hit"), F.lit(1)) * (C("score") - C("_mean")) / f_norm)


# Token estimators: rows with arrays -> array adv.
def whitened(df: DataFrame, array: str, keep_outside: bool = False) -> DataFrame:
    """array minus its masked mean over all tokens, by its masked standard deviation (unbiased)."""
    rows = df.select(mask_size().alias("n"), masked_sum(array).alias("s"), masked_sum(F.transform(array, lambda x: x * x)).alias("q"))
    total = rows.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select("n", "s", "q", (C("s") / (C("n") + 1e-8)).alias("_wm"))
    spread = F.greatest(C("q") - 2 * C("_wm") * C("s") + C("n") * C("_wm") * C("_wm"), F.lit(0.0))
    moments = total.select("_wm", (spread / (C("n") + 1e-8) * C("n") / (C("n") - 1)).alias("_wv"), F.lit(1).alias("_one"))
    d = df.withColumn("_one", F.lit(1)).join(F.broadcast(moments), "_one")
    out = F.transform(array, lambda x: (x - C("_wm")) / F.sqrt(C("_wv") + WHITEN_EPS))
    if not keep_outside:
        out = F.zip_with(out, C("m"), lambda x, k: x * k)
    return d.withColumn(array, out).drop("_one", "_wm", "_wv")


def reinforce_baseline(df: DataFrame) -> DataFrame:
    d = _moments(df)
    d = d.withColumn("adv", F.transform("m", lambda k: (C("score") - C("_mean")) * k))
    return whitened(d, "adv")


def masked(array: str, x: Column | None = None) -> Column:
    """array where the mask is 1, else 0; what stands there, NaN too, has no effect."""
    return F.zip_with(C(array) if x is None else x, "m", lambda a, k: F.when(k > 0, a).otherwise(0.0))


def reinforce_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted return to the end, cut by the mask, then whitened."""
    d = df.withColumn("_run", from_the_end(masked("r"), F.transform("m", lambda k: gamma * k)))
    d = d.withColumn("adv", F.zip_with("r", following(C("_run")), lambda r, x: r + gamma * x)).drop("_run")
    return whitened(d, "adv")


def remax(df: DataFrame, baseline: Column) -> DataFrame:
    returns = from_the_end(masked("r"), F.transform("m", lambda _: F.lit(1.0)))
    return df.withColumn("returns", returns).withColumn("adv", F.zip_with("returns", "m", lambda x, k: x - baseline * k))


def gae(df: DataFrame, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """Generalised advantages by reverse recurrence, masked tokens passed over; returns before, advantages after whitening."""
    d = df.withColumn("_next", following(from_the_end(masked("v"), F.transform("m", lambda k: 1.0 - k))))
    delta = F.zip_with(F.zip_with("r", "v", lambda r, v: r - v), "_next", lambda x, n: x + gamma * n)
    d = d.withColumn("adv", from_the_end(masked("", delta), F.transform("m", lambda k: gamma * lam * k + 1.0 - k)))
    d = d.withColumn("returns", F.zip_with("adv", "v", lambda a, v: a + v)).drop("_next")
    return whitened(d, "adv", keep_outside=True)


ESTIMATORS: dict[str, Callable] = {
    "grpo": grpo, "grpo_vectorized": grpo_floored, "grpo_passk": grpo_passk, "rloo": rloo, "rloo_vectorized": lambda df: rloo(df, True), "opo": opo,
    "gpg": gpg, "reinforce_plus_plus": reinforce_plus, "reinforce_plus_plus_baseline": reinforce_baseline, "remax": remax, "gae": gae,
}


# Token expressions.
def clamp(x: Column, low: float | None, high: float | None) -> Column:
    x = F.greatest(x, F.lit(low)) if low is not None else x
    return F.least(x, F.lit(high)) if high is not None else x


def kl(kind: str, new: Column, ref: Column) -> Column:
    """Estimate of the divergence of one token; a trailing + changes gradients only."""
    kind = kind.rstrip("+")
    if kind in ("kl", "k1"):
        return new - ref
    if kind == "abs":
        return F.abs(new - ref)
    if kind in ("mse", "k2"):
        return 0.5 * (new - ref) * (new - ref)
    if kind in ("low_var_kl", "k3"):
        d = clamp(ref - new, -20.0, 20.0)
        return clamp(F.exp(d) - d - 1, -10.0, 10.0)
    raise ValueError(kind)


def kl_controller(value: float, current: float, target: float, n: int, horizon: int) -> float:
    return value * (1 + float(np.clip(current / target - 1, -0.2, 0.2)) * n / horizon)


def aggregate_loss(df: DataFrame, array: str, mode: str) -> DataFrame:
    """(loss) of a token loss array by one of the four modes."""
    s, n = masked_sum(array), mask_size()
    rows = df.select(s.alias("s"), n.alias("n"), F.size(array).alias("t"))
    if mode == "token-mean":
        return rows.agg((F.sum("s") / (F.sum("n") + 1e-8)).alias("loss"))
    if mode == "seq-mean-token-sum":
        return rows.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return rows.agg(F.avg(C("s") / (C("n") + 1e-8)).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return rows.agg((F.sum("s") / F.max("t")).alias("loss"))
    raise ValueError(mode)


def _means(df: DataFrame, **arrays: Column) -> DataFrame:
    """Masked mean over all tokens of each array."""
    d = df.select(mask_size().alias("_n"), *[masked_sum(a).alias(n) for n, a in arrays.items()])
    return d.agg(*[(F.sum(n) / (F.sum("_n") + 1e-8)).alias(n) for n in arrays])


def ppo_loss(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """(loss, clipfrac, ppo_kl, clipfrac_lower), token mean, of arrays old, new and adv."""
    f = lambda fn: zipped(fn, "old", "new", "adv")
    ratio = lambda o, n: F.exp(clamp(n - o, -20.0, 20.0))
    l1 = lambda o, n, a: -a * ratio(o, n)
    l2 = lambda o, n, a: -a * clamp(ratio(o, n), 1 - low, 1 + high)
    c1 = lambda o, n, a: F.greatest(l1(o, n, a), l2(o, n, a))
    pg = lambda o, n, a: F.when(a < 0, F.least(-a * dual, c1(o, n, a))).otherwise(c1(o, n, a))
    return _means(df, loss=f(pg), clipfrac=f(lambda o, n, a: (l2(o, n, a) > l1(o, n, a)).cast("double")), ppo_kl=f(lambda o, n, a: -clamp(n - o, -20.0, 20.0)), clipfrac_lower=f(lambda o, n, a: ((c1(o, n, a) > -a * dual) & (a < 0)).cast("double")))


def gspo_loss(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """(loss): one ratio per sequence, mean over tokens, then sequences."""
    seq = F.exp(clamp(masked_sum(F.zip_with("new", "old", lambda n, o: n - o)) / F.greatest(mask_size(), F.lit(1.0)), None, 10.0))
    d = df.withColumn("_r", seq).withColumn("_l", F.transform("adv", lambda a: F.greatest(-a * C("_r"), -a * clamp(C("_r"), 1 - low, 1 + high))))
    return aggregate_loss(d, "_l", "seq-mean-token-mean")


def gpg_loss(df: DataFrame) -> DataFrame:
    return aggregate_loss(df.withColumn("_l", F.zip_with("new", "adv", lambda n, a: -n * a)), "_l", "token-mean")


def geo_mean_loss(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """(loss): geometric mean of clipped token ratios per sequence times its mean advantage."""
    def least(n: Column, o: Column, a: Column) -> Column:
        s = F.signum(a)
        return s * F.least(s * (n - o), s * clamp(n - o, -low, high))

    n = mask_size() + 1e-8
    d = df.select((masked_sum(zipped(least, "new", "old", "adv")) / n).alias("k"), (masked_sum("adv") / n).alias("a"))
    return d.agg(F.avg(-C("a") * F.exp("k")).alias("loss"))


def kl_cov_loss(df: DataFrame, row_id: str, ratio: float = 0.01, coef: float = 1.0) -> DataFrame:
    """(loss): tokens with the largest covariance of advantage and log-probability pay their divergence. Ties go to the lower
    row and place. The share is kept by a global threshold, not by sorting all tokens in one task."""
    tok = df.select(row_id, F.posexplode(F.arrays_zip("m", "old", "new", "adv")).alias("i", "t")).where("t.m > 0").select(row_id, "i", "t.*")
    tok = with_total(tok, _ma=F.avg("adv"), _mn=F.avg("new"), _n=F.count("*")).withColumn("cov", (C("adv") - C("_ma")) * (C("new") - C("_mn")))
    cov = F.round("cov", 9)  # sums in another order must not change which token comes first
    k = F.greatest(F.floor(C("_n") * ratio), F.lit(1))
    paid = numbered(tok, cov.desc(), row_id, "i", name="_place").withColumn("_pay", C("_place") < k)
    loss = -C("adv") * F.exp(C("new") - C("old")) + F.when(C("_pay"), coef * F.abs(C("new") - C("old"))).otherwise(0.0)
    return paid.agg((F.sum(loss) / (F.count("*") + 1e-8)).alias("loss"))


def clip_cov_loss(df: DataFrame, row_id: str, ratio: float = 0.01, low: float = 1e-3, high: float = 5.0, clip: float = 0.2, seed: int = 0) -> DataFrame:
    """(loss, n_dropped): a seeded sample of unclipped tokens whose covariance lies in a band has no loss. Sampling is the
    feature; it keeps about `ratio` of all tokens at most."""
    tok = df.select(row_id, F.posexplode(F.arrays_zip("m", "old", "new", "adv")).alias("i", "t")).where("t.m > 0").select(row_id, "i", "t.*")
    tok = with_total(tok, _ma=F.avg("adv"), _mn=F.avg("new"), _n=F.count("*"))
    r = F.exp(C("new") - C("old"))
    l1, l2 = -C("adv") * r, -C("adv") * clamp(r, 1 - clip, 1 + clip)
    cov = (C("adv") - C("_ma")) * (C("new") - C("_mn"))
    tok = tok.withColumn("_in", (l2 <= l1) & (cov > low) & (cov < high)).withColumn("_l", F.greatest(l1, l2))
    share = F.greatest(F.floor(C("_n") * ratio), F.lit(1))
    order = F.when(C("_in"), 0).otherwise(1), F.xxhash64(F.lit(seed), row_id, "i"), C(row_id), C("i")
    placed = numbered(tok, *order, name="_place").withColumn("_drop", C("_in") & (C("_place") < share))
    return placed.agg((F.sum(F.when(C("_drop"), 0.0).otherwise(C("_l"))) / (F.count("*") + 1e-8)).alias("loss"), F.sum(C("_drop").cast("long")).alias("n_dropped"))


def value_loss(df: DataFrame, clip: float = 0.5) -> DataFrame:
    """(loss, clipfrac) of arrays pred, v and returns."""
    sq = lambda p, r: (p - r) * (p - r)
    held = lambda p, v: F.greatest(F.least(p, v + clip), v - clip)
    f = lambda fn: zipped(fn, "pred", "v", "returns")
    return _means(df, loss=f(lambda p, v, r: 0.5 * F.greatest(sq(p, r), sq(held(p, v), r))), clipfrac=f(lambda p, v, r: (sq(held(p, v), r) > sq(p, r)).cast("double")))


def importance_weights(df: DataFrame, level: str, mode: str, upper: float = 1.2, veto: float | None = 1e-4) -> DataFrame:
    """df with arrays raw (weights before any limit) and w (after limit, veto and mask) and the flag vetoed.

    level token, sequence (product of ratios) or geometric (their geometric mean); mode truncate or mask.
    """
    ratio = F.zip_with("old", "roll", lambda o, r: o - r)
    lower = 1 / upper
    d = df.withColumn("_lr", ratio)
    if level == "token":
        d = d.withColumn("raw", F.transform("_lr", lambda x: F.exp(clamp(x, -20.0, 20.0))))
    else:
        s = masked_sum("_lr")
        s = s / (mask_size() + 1e-8) if level == "geometric" else s
        d = d.withColumn("_s", s).withColumn("raw", F.transform("m", lambda _: F.exp(clamp(C("_s"), -20.0, 20.0))))
    bad = F.exists(F.arrays_zip("_lr", "m"), lambda z: (z._lr < float(np.log(veto))) & (z.m > 0)) if veto else F.lit(False)
    limit = (lambda x: clamp(x, None, upper)) if mode == "truncate" else (lambda x: F.when((x >= lower) & (x <= upper), x).otherwise(0.0))
    return d.withColumn("vetoed", bad).withColumn("w", F.zip_with("raw", "m", lambda x, k: F.when(C("vetoed"), 0.0).otherwise(limit(x) * k)))


def importance_metrics(df: DataFrame, upper: float = 1.2) -> DataFrame:
    """One row of statistics of token-level weights, from df with raw and vetoed."""
    lower = 1 / upper
    tok = df.select(F.explode(F.arrays_zip("raw", "m")).alias("t")).where("t.m > 0").select(C("t.raw").alias("x"))
    c = clamp(C("x"), lower, upper)
    q = lambda p: F.percentile("x", F.lit(p))
    flat = tok.agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"), F.avg((C("x") > upper).cast("double")).alias("high"), F.avg((C("x") < lower).cast("double")).alias("low"), F.sqrt(F.greatest(F.avg(c * c) - F.avg(c) * F.avg(c), F.lit(0.0))).alias("std"), (F.avg(c) * F.avg(c) / F.avg(c * c)).alias("ess"), *[q(p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.95, 0.99)])
    s = masked_sum("raw") / (mask_size() + 1e-8)
    seq = df.select(s.alias("s"), "vetoed").agg(F.avg("s").alias("seq_mean"), F.stddev_samp("s").alias("seq_std"), F.max("s").alias("seq_max"), F.min("s").alias("seq_min"), F.max(F.abs(C("s") - 1)).alias("seq_max_deviation"), F.avg(C("vetoed").cast("double")).alias("veto_fraction"))
    return flat.withColumn("_one", F.lit(1)).join(F.broadcast(seq.withColumn("_one", F.lit(1))), "_one").drop("_one")


def mismatch_metrics(df: DataFrame) -> DataFrame:
    n = mask_size() + 1e-8
    d = df.select((masked_sum("old") / n).alias("t"), (masked_sum("roll") / n).alias("r"), masked_sum(F.zip_with("roll", "old", lambda a, b: a - b)).alias("kl"), masked_sum(F.zip_with("old", "roll", lambda a, b: F.exp(a - b) - (a - b) - 1)).alias("k3"), mask_size().alias("n"))
    diff = C("r") - C("t")
    return d.agg(F.avg(F.exp(-C("t"))).alias("training_ppl"), F.avg(-C("t")).alias("training_log_ppl"), F.avg(F.exp(-C("r"))).alias("rollout_ppl"), F.avg(-C("r")).alias("rollout_log_ppl"), (F.sum("kl") / (F.sum("n") + 1e-8)).alias("kl"), (F.sum("k3") / (F.sum("n") + 1e-8)).alias("k3_kl"), F.avg(diff).alias("log_ppl_diff"), F.avg(F.abs(diff)).alias("log_ppl_abs_diff"), F.max(diff).alias("log_ppl_diff_max"), F.min(diff).alias("log_ppl_diff_min"), F.avg(F.exp(diff)).alias("ppl_ratio"))


def eos_mask(tokens: Column, eos: int) -> Column:
    """1 up to and with the first end token, 0 after it; all 1 if there is none."""
    at = F.array_position(tokens, F.lit(eos))
    return F.transform(tokens, lambda _, i: ((at == 0) | (i < at)).cast("int"))


def reweights(df: DataFrame, method: str, power: float = 2.0) -> DataFrame:
    """df with the sampling weight of each row."""
    d = with_total(df, _hi=F.max("score"), _lo=F.min("score"))
    w = {"pow": F.pow(F.abs("score"), F.lit(power)), "max_min": ((C("score") == C("_hi")) | (C("score") == C("_lo"))).cast("double"), "max_random": F.when(C("score") == C("_hi"), 0.4).otherwise(0.1)}[method]
    return d.withColumn("weight", F.greatest(w + 1e-8, F.lit(1e-8))).drop("_hi", "_lo")


def resampled(weighted: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """(row_id, copies): as many draws with replacement as there are rows, by weight.

    Systematic sampling: a row's copies are the whole numbers its stretch of the cumulative weight covers, so no task needs all
    rows; stretches follow from bucket totals, of which there are at most 256.
    """
    b = weighted.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(256)))
    totals = b.groupBy("_b").agg(F.sum("weight").alias("_w"), F.count("*").alias("_n"))
    before = totals.select("_b", (F.sum("_w").over(Window.orderBy("_b")) - C("_w")).alias("_before"), F.sum("_w").over(Window.partitionBy(F.lit(0))).alias("_all"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_rows"))
    inside = Window.partitionBy("_b").orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0)
    d = b.join(F.broadcast(before), "_b").withColumn("_to", C("_before") + F.sum("weight").over(inside))
    place = lambda x: F.floor(x / C("_all") * C("_rows") + 0.5)
    return d.select(row_id, (place(C("_to")) - place(C("_to") - C("weight"))).cast("int").alias("copies")).where("copies > 0")


def bootstrap(values: np.ndarray, size: int, reducers: dict[str, Callable], draws: int = 1000, seed: int = 42) -> dict[str, tuple[float, float]]:
    """(mean, standard deviation) of each reducer over seeded resamples with replacement."""
    rng = np.random.RandomState(seed)
    got: dict[str, list] = {n: [] for n in reducers}
    for _ in range(draws):
        part = values[rng.choice(len(values), size=size, replace=True)]
        for n, fn in reducers.items():
            got[n].append(fn(part))
    return {n: (float(np.mean(v)), float(np.std(v))) for n, v in got.items()}


@lru_cache(maxsize=128)
def _kept_resample(total: int, n: int, draws: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).choice(total, size=(draws, n), replace=True)


def _resamples(total: int, n: int, draws: int = 1000, seed: int = 42) -> Iterator[np.ndarray]:
    """The indices that `draws` calls of choice(total, n) of one seeded generator give, a block of resamples at a time. They are the
    same for all groups of one size; those of small groups are kept."""
    if n <= 32:
        yield _kept_resample(total, n, draws, seed)
        return
    rng = np.random.RandomState(seed)
    rows = max(1, DRAWN // n)
    for i in range(0, draws, rows):
        yield rng.choice(total, size=(min(rows, draws - i), n), replace=True)


def _sizes(total: int) -> Iterator[int]:
    """2, 4, 8, ... and total."""
    n = 2
    while n < total:
        yield n
        n *= 2
    yield total


def _places(total: int) -> Iterator[tuple[int, str, np.ndarray]]:
    """(n, best or worst, 1,000 places from 1 to total in the ordered group) for n of 2, 4, ... and all: the last and the first of
    the values drawn."""
    for n in _sizes(total):
        if n <= DRAWN:
            best, worst = (np.concatenate(x) for x in zip(*((x.max(axis=1), x.min(axis=1)) for x in _resamples(total, n))))
        else:  # a resample is drawn in pieces, by the same generator
            rng, best, worst = np.random.RandomState(42), np.zeros(1000, np.int64), np.full(1000, total)
            for i in range(1000):
                for at in range(0, n, DRAWN):
                    part = rng.choice(total, size=min(DRAWN, n - at), replace=True)
                    best[i], worst[i] = max(best[i], part.max()), min(worst[i], part.min())
        yield n, "best", best + 1
        yield n, "worst", worst + 1


def _per_group(rows: DataFrame, keys: list[str], columns: list[str], fn: Callable[..., Iterator[tuple[int, str, float]]]) -> DataFrame:
    """(keys, n, metric, value) of fn over the columns of each group, ordered by them. Groups are rows of arrays, so a task takes
    many small ones at once; they are spread over as many tasks as there are shuffle partitions, small as they may be."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.repartition(tasks, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_h"))
    slim = held.select(*keys, *[C(f"_h.{c}").alias(f"_{c}") for c in columns])
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", n long, metric string, value double"

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [list(fn(*(np.asarray(x) for x in arrays))) for arrays in zip(*(pdf[f"_{c}"] for c in columns))]
            out = pdf[keys].loc[pdf.index.repeat([len(f) for f in found])].reset_index(drop=True)
            flat = pd.DataFrame([x for f in found for x in f], columns=["n", "metric", "value"])
            yield pd.concat([out, flat], axis=1)

    return slim.mapInPandas(go, schema)


def bootstrap_groups(df: DataFrame, keys: list[str], held: int = 1 << 18) -> DataFrame:
    """(keys, n, metric, value): best and worst of subsets of 2, 4, ... and all values of each group.

    The draws are those of NumPy's generator with seed 42 over the group in ascending order of its values, the same for best
    and worst. A group is held as a histogram of its values with counts, into which indices are mapped: an unbounded group with few
    different scores stays small. Groups with more than `held` different values are ordered over many tasks, and each place is
    looked up where it lies; the values drawn are the same.
    """
    counts = cut(df.groupBy(*keys, "val").agg(F.count("*").alias("c")), "histogram")

    def stats(v: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, str, float]]:
        ends = np.cumsum(c)
        total = int(ends[-1])
        for n, name, places in _places(total) if total > 1 else ():
            red = v[np.searchsorted(ends, places)]
            yield total, f"{name}@{n}/mean", float(red.mean())
            yield total, f"{name}@{n}/std", float(red.std())

    large = counts.groupBy(*keys).agg(F.count("*").alias("_k"), F.sum("c").alias("n")).where(C("_k") > held)
    large = cut(large.withColumn("_g", F.monotonically_increasing_id()), "large")
    if large.isEmpty():
        return _per_group(counts, keys, ["val", "c"], stats)
    named = F.broadcast(large.select("_g", *[C(k).alias(f"_{i}") for i, k in enumerate(keys)]))
    same = reduce(Column.__and__, [C(k).eqNullSafe(C(f"_{i}")) for i, k in enumerate(keys)])
    rest = _per_group(counts.join(named, same, "left_anti"), keys, ["val", "c"], stats)
    drawn = _looked_up(counts.join(named, same).select("_g", "val", "c"), large.select("_g", "n"))
    stats = drawn.groupBy("_g", "_at").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    stats = stats.join(F.broadcast(large), "_g").select(*keys, "n", F.explode(F.array(*[F.struct(F.concat("_at", F.lit(f"/{m}")).alias("metric"), C(m).alias("value")) for m in ("mean", "std")])).alias("r"))
    return rest.unionByName(stats.select(*keys, "n", "r.*"))


def _looked_up(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(_g, _at, value): the values at the places of each group, found in cumulative counts of ranges of values.
    counts: _g, val, c; totals: _g, n."""
    order = ["_g", C("val").asc_nulls_last()]
    ranges = cut(counts.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_g", "_p").agg(F.sum("c").alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy("_g").orderBy("_p"))
    sizes = sizes.select("_g", C("_p").alias("_q"), (upto - C("_in")).alias("_before"), upto.alias("_upto"))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, total in zip(pdf["_g"], pdf["n"]):
                for n, name, at in _places(int(total)):
                    yield pd.DataFrame({"_g": g, "_at": f"{name}@{n}", "_place": at})

    def found(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame({"_g": [], "_at": [], "value": []})
        v = held["val"].to_numpy(float)
        o = np.argsort(v)
        at = np.searchsorted(np.cumsum(held["c"].to_numpy(np.int64)[o]), (wanted["_place"] - wanted["_before"]).to_numpy())
        return pd.DataFrame({"_g": wanted["_g"], "_at": wanted["_at"], "value": v[o][np.minimum(at, len(v) - 1)]})

    wanted = totals.mapInPandas(places, "_g long, _at string, _place double").join(sizes, "_g")
    wanted = wanted.where(((C("_place") > C("_before")) | (C("_before") == 0)) & (C("_place") <= C("_upto"))).select("_g", "_q", "_at", "_place", "_before")
    return wanted.groupBy("_g", "_q").cogroup(ranges.groupBy("_g", "_p")).applyInPandas(found, "_g long, _at string, value double")


def _first_of_most(votes: np.ndarray) -> np.ndarray:
    """For each row of votes the place where its most frequent vote stands first; among equals the one met first.
    A vote's last place less its first, in sorted order of (row, vote), is its number."""
    rows, n = votes.shape
    order = np.argsort(votes, axis=1, kind="stable")
    ranked = np.take_along_axis(votes, order, axis=1)
    new = np.ones((rows, n), bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, rows * n))
    first = order.ravel()[at]  # the sort is stable: a vote's first place comes first
    row = at // n
    score = times * np.int64(n) + (n - 1 - first)
    best = np.full(rows, -1, np.int64)
    np.maximum.at(best, row, score)
    return n - 1 - best % n


def bootstrap_majority(df: DataFrame, keys: list[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, n, metric, value): mean and deviation, over seeded resamples of 2, 4, ... and all responses of a group, of the score that
    the most frequent vote has first. df: keys, vote, val. Equal votes go to the one drawn first.

    The draws are those of NumPy's generator over the group in ascending order of vote and score. Responses with the same vote
    and score are one weighted entry, into which indices are mapped, so what a task holds grows with the different ones only.
    """
    counts = df.groupBy(*keys, "vote", "val").agg(F.count("*").alias("c"))

    def stats(vote: np.ndarray, val: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, str, float]]:
        code, ends = pd.factorize(vote, use_na_sentinel=False)[0], np.cumsum(c)
        total = int(ends[-1])
        for n in _sizes(total) if total > 1 else ():
            got = []
            for drawn in _resamples(total, n, draws, seed):
                entry = np.searchsorted(ends, drawn, side="right")
                first = _first_of_most(code[entry])
                got.append(val[entry[np.arange(len(entry)), first]])
            got = np.concatenate(got)
            yield total, f"maj@{n}/mean", float(got.mean())
            yield total, f"maj@{n}/std", float(got.std())

    return _per_group(counts, keys, ["vote", "val", "c"], stats)


def majority(df: DataFrame, keys: list[str], vote: str, val: str, order: str) -> DataFrame:
    """(keys, vote, n, value): the most frequent vote of a group, the one seen first among equals, with its first value."""
    per = df.groupBy(*keys, vote).agg(F.count("*").alias("n"), F.min(F.struct(order, val)).alias("first"))
    best = per.groupBy(*keys).agg(F.max(F.struct(C("n"), (-C(f"first.{order}")).alias("o"), C(vote).alias("vote"), C(f"first.{val}").alias("value"))).alias("b"))
    return best.select(*keys, "b.vote", "b.n", "b.value")


def varied_groups(df: DataFrame) -> DataFrame:
    """Rows of groups whose scores differ, or that have one row."""
    d = with_groups(df, "uid", _n=F.count("*"), _sd=F.stddev_pop("score"))
    return d.where((C("_sd") > 0) | (C("_n") == 1)).drop("_n", "_sd")
