"""Resampling, tests and multiple-testing control as grouped plans.

Draws are hashes of (seed, replicate, cell key), so a rerun or a lost executor gives the same
numbers and no generator state is shared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgrammar.operators.metrics import ranking_metrics
from pairgrammar.operators.ordered import ranked, running
from pairgrammar.operators.resampling import cells, replicate_metrics, row_key, subset_sums, weighted_means
from pairgrammar.session import cut_lineage


def _size(df: DataFrame) -> Column:
    return df.agg(F.count("*").alias("n")).scalar()


def _pairs(df: DataFrame, model: str, baseline: str, tie: str) -> DataFrame:
    rows = df.select(tie, "label", F.col(model).alias("m"), F.col(baseline).alias("b")).dropna(subset=["label", "m", "b"])
    return cut_lineage(rows)


def _observed(rows: DataFrame, metric: str) -> DataFrame:
    return _both_metrics(rows, []).filter(F.col("metric_name") == metric).withColumn("observed_diff", F.col("model_metric") - F.col("baseline_metric"))


def paired_bootstrap(df: DataFrame, model: str, baseline: str, metric: str = "auprc", n: int = 5000, seed: int = 11, tie: str = "seq_id") -> DataFrame:
    """Interval and p-value of a metric difference; a one-class resample counts as the observed difference."""
    rows = _pairs(df, model, baseline, tie)
    observed = _observed(rows, metric)
    per = replicate_metrics(rows, [], "poisson", n, seed, tie).filter(F.col("metric_name") == metric)
    d = F.coalesce(F.col("model_metric") - F.col("baseline_metric"), observed.select("observed_diff").scalar())
    summary = per.select(d.alias("d")).agg(
        F.percentile("d", F.lit(0.025)).alias("ci_low"), F.percentile("d", F.lit(0.975)).alias("ci_high"),
        ((F.count_if(F.col("d") <= 0) + 1) / (F.count("*") + 1)).alias("bootstrap_p_value"))
    return observed.withColumn("s", summary.select(F.struct("*")).scalar()).select(
        "metric_name", "model_metric", "baseline_metric", "observed_diff", "s.ci_low", "s.ci_high", "s.bootstrap_p_value")


def paired_permutation(df: DataFrame, model: str, baseline: str, metric: str = "auprc", n: int = 5000, seed: int = 11, tie: str = "seq_id") -> DataFrame:
    """Swap the two scores of a row at random; share of replicates at or above the observed difference."""
    rows = _pairs(df, model, baseline, tie)
    obs = _observed(rows, metric).select("observed_diff").scalar()
    per = replicate_metrics(rows, [], "swap", n, seed, tie).filter(F.col("metric_name") == metric)
    diffs = per.select((F.col("model_metric") - F.col("baseline_metric")).alias("diff"))
    # exact ties with the observed value must count, whatever the order of summation
    return diffs.agg(
        F.lit(metric).alias("metric_name"),
        F.first(obs).alias("observed_diff"),
        ((F.count_if(F.col("diff") >= obs - 1e-12) + 1) / (F.count("*") + 1)).alias("permutation_p_value"),
    )


def bootstrap_ci(df: DataFrame, score: str, metric: str = "auprc", n: int = 1000, seed: int = 11, tie: str = "seq_id") -> DataFrame:
    """Interval of one metric; one-class resamples are skipped."""
    per = replicate_metrics(_pairs(df, score, score, tie), [], "poisson", n, seed, tie).filter((F.col("metric_name") == metric) & F.col("model_metric").isNotNull())
    return per.agg(F.count("*").alias("used"), F.percentile("model_metric", F.lit(0.025)).alias("ci_low"), F.percentile("model_metric", F.lit(0.975)).alias("ci_high"))


def bh_fdr(df: DataFrame, p: str, order: list[str], name: str = "bh_fdr") -> DataFrame:
    """Benjamini-Hochberg adjustment over all rows; ``order`` breaks ties between equal p-values."""
    total = _size(df)
    first = ranked(df, [], [p, *order], "_rank").withColumn("_raw", F.col(p) * total / F.col("_rank"))
    out = running(first, [], ["-_rank"], {"_adj": ("min", F.col("_raw"))})
    return out.withColumn(name, F.least(F.greatest("_adj", F.lit(0.0)), F.lit(1.0))).drop("_rank", "_raw", "_adj")


def significant_win(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Interval above zero and p (or adjusted p) below ``alpha``."""
    above = F.col("ci_low") > 0
    return df.withColumn("significant_win", above & (F.col("permutation_p_value") < alpha)).withColumn(
        "significant_win_fdr", above & (F.col("bh_fdr") < alpha))


def claim_table(sig: DataFrame, preferred: list[str], keys=("split_name", "phase", "metric_name")) -> DataFrame:
    """Strongest preferred baseline per slice, else the strongest of any."""
    window = Window.partitionBy(*keys).orderBy(F.col("comparison_method").isin(preferred).desc(), F.col("baseline_metric").desc(), "comparison_method")
    best = sig.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")
    return best.withColumnRenamed("comparison_method", "best_baseline").withColumnRenamed("observed_diff", "lead")


FISHER_BLOCK = 4096  # tables weighed at once


def _log_steps(r: int, s: int, n: int, k: np.ndarray) -> np.ndarray:
    """Logarithm of weight(k + 1) / weight(k); r and s are the margins of a, n all rows."""
    return np.log(r - k) + np.log(s - k) - np.log(k + 1) - np.log(n - r - s + k + 1)


def _outward(r: int, s: int, n: int, start: int, end: int) -> float:
    """Weights of the tables from ``start`` on to ``end`` over that of ``start``, away from the mode.

    Ratios of neighbours fall on the way, so all that is left is below a geometric series: once that cannot
    change the sum, it stops.
    """
    total, log, k, way = 1.0, 0.0, start, 1 if end >= start else -1
    while k != end:
        at = np.arange(k, k + way * min(FISHER_BLOCK, abs(end - k)), way, dtype=float)
        steps = _log_steps(r, s, n, at) if way > 0 else -_log_steps(r, s, n, at - 1)
        logs = log + np.cumsum(steps)
        total += float(np.exp(logs).sum())
        log, k = float(logs[-1]), k + way * len(at)
        ratio = math.exp(min(steps[-1], 0.0))
        if ratio < 1 and math.exp(log) * ratio / (1 - ratio) < 1e-17 * total:
            break
    return total


def _log_between(r: int, s: int, n: int, start: int, end: int) -> float:
    """Logarithm of weight(end) / weight(start)."""
    low, high = min(start, end), max(start, end)
    if high - low <= 1 << 20:
        found = float(_log_steps(r, s, n, np.arange(low, high, dtype=float)).sum())
    else:
        weight = lambda k: -sum(math.lgamma(x + 1) for x in (k, r - k, s - k, n - r - s + k))
        found = weight(high) - weight(low)
    return found if end >= start else -found


def fisher_tail(a: int, b: int, c: int, d: int) -> float:
    """P(as many as ``a`` or more) in tables of the same margins."""
    r, s, n = a + b, a + c, a + b + c + d
    low, high = max(0, a - d), min(r, s)
    if a <= low:
        return 1.0
    mode = min(max((r + 1) * (s + 1) // (n + 2), low), high)
    total = _outward(r, s, n, mode, high) + _outward(r, s, n, mode, low) - 1.0
    if a > mode:
        return min(1.0, math.exp(_log_between(r, s, n, mode, a)) * _outward(r, s, n, a, high) / total)
    return max(0.0, 1.0 - math.exp(_log_between(r, s, n, mode, a - 1)) * _outward(r, s, n, a - 1, low) / total)


def fisher_greater(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One-sided Fisher exact test on columns a, b, c, d: one row a table.

    Weights are summed from the likeliest and from the observed table outward, until the rest is bounded below rounding:
    some standard deviations' worth of tables, not all that the margins allow. Null counts give null.
    """
    def tails(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in t) else fisher_tail(*map(int, t)) for t in zip(a, b, c, d)], dtype="float64")

    a, b, c, d = (F.col(x).cast("long") for x in "abcd")
    ad, bc = F.col("a").cast("double") * F.col("d"), F.col("b").cast("double") * F.col("c")
    odds = F.when((ad == 0) & (bc == 0), F.lit(float("nan"))).when(bc == 0, F.lit(float("inf"))).otherwise(ad / bc)
    return counts.select(*(keys or []), "a", "b", "c", "d", F.pandas_udf(tails, "double")(a, b, c, d).alias("p_value"), odds.alias("odds_ratio"))


def _normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)))


_EXACT_LENGTH = 1 << 22


def _exact_u_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) without ties, where the smaller side has at most 8 rows.

    The counts of subsets per U are the coefficients of a Gaussian binomial: one pass over an array
    for each factor, up to the middle of the symmetric distribution. Where that array would pass
    ``_EXACT_LENGTH`` numbers, U over the larger side is the sum of uniform draws, whose tail is closed.
    """
    m, n = min(n1, n2), max(n1, n2)
    least = math.ceil(u)
    if least <= 0:
        return 1.0
    if 2 * least <= m * n:
        return 1.0 - _exact_u_tail(n1, n2, m * n - least + 1)
    top = m * n - least  # by symmetry P(U <= top)
    if top < 0:
        return 0.0
    if top + 1 > _EXACT_LENGTH:
        x = (top + (m + 1) / 2) / (n + (m + 1) / 2)
        return sum((-1) ** k * math.comb(m, k) * max(0.0, x - k) ** m for k in range(m + 1)) / math.factorial(m)
    ways = np.zeros(top + 1)
    ways[0] = 1.0
    for i in range(1, m + 1):
        padded = np.concatenate([ways, np.zeros(-len(ways) % i)]).reshape(-1, i)
        ways = padded.cumsum(axis=0).ravel()[:top + 1]
        if n + i <= top:
            ways[n + i:] = ways[n + i:] - ways[:top + 1 - n - i].copy()
    return float(ways.sum() / math.comb(m + n, m))


def _u_p_value(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series) -> pd.Series:
    out = []
    for a, b, stat, tie in zip(n1, n2, u, ties):
        n = a + b
        if min(a, b) == 0:
            out.append(None)
        elif min(a, b) <= 8 and tie == 0:
            out.append(_exact_u_tail(int(a), int(b), stat))
        else:
            spread = math.sqrt(a * b / 12.0 * ((n + 1) - tie / (n * (n - 1.0))))
            out.append(0.5 * math.erfc((stat - a * b / 2.0 - 0.5) / spread / math.sqrt(2.0)) if spread > 0 else 1.0)
    return pd.Series(out, dtype="float64")


def mann_whitney(df: DataFrame, group: str, value: str, positive: str, negative: str, by: list[str] | None = None) -> DataFrame:
    """One-sided (greater) Mann-Whitney U with tie and continuity correction.

    Values are collapsed to distinct ones first; U needs only running counts over them. ``p_value_method``
    tells how the tail was summed: ``exact`` (without ties, smaller side of at most 8 rows), ``uniform_sum`` in its place where the
    table of counts would pass ``_EXACT_LENGTH``, ``normal`` otherwise, null where a side is empty.
    """
    by = by or []
    counts = df.filter(F.col(group).isin(positive, negative) & F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(
        F.count_if(F.col(group) == positive).alias("_a"), F.count_if(F.col(group) == negative).alias("_b"))
    run = running(counts, by, ["_v"], {"_below": ("sum", F.col("_b"))}, exclusive=True)
    t = (F.col("_a") + F.col("_b")).cast("double")
    sums = run.groupBy(*by).agg(
        F.sum("_a").alias("n_positive"), F.sum("_b").alias("n_negative"),
        F.sum(F.col("_a") * (F.coalesce("_below", F.lit(0)) + F.col("_b") / 2)).alias("u"),
        F.sum(t * t * t - t).alias("_ties"))
    p_value = F.pandas_udf(_u_p_value, "double")
    cells, least = F.col("n_positive") * F.col("n_negative"), F.ceil("u")
    table = F.when(2 * least <= cells, least).otherwise(cells - least + 1)
    smaller = F.least("n_positive", "n_negative")
    method = F.when(smaller == 0, None).when((smaller > 8) | (F.col("_ties") > 0), "normal").when(table > _EXACT_LENGTH, "uniform_sum").otherwise("exact")
    return sums.withColumns({
        "p_value": p_value(F.col("n_positive").cast("double"), F.col("n_negative").cast("double"), "u", "_ties"), "p_value_method": method}).drop("_ties")


def mean_diff_bootstrap(df: DataFrame, group: str, value: str, positive: str, negative: str, n: int = 10000, seed: int = 11, tie: str = "state_label") -> DataFrame:
    """Interval of the mean difference, resampled inside each group; a replicate without a group's rows is skipped."""
    rows = df.filter(F.col(group).isin(positive, negative)).select(F.col(group).alias("_g"), F.col(value).alias("_v"), row_key(tie).alias("_key"))
    means = weighted_means(cells(rows, ["_g", "_v"]), (positive, negative), n, seed)
    d = F.col("first") - F.col("second")
    return means.agg(F.count(d).alias("iterations"), F.percentile(d, F.lit(0.025)).alias("bootstrap_ci_low"), F.percentile(d, F.lit(0.975)).alias("bootstrap_ci_high"))


def mean_diff_permutation(df: DataFrame, group: str, value: str, positive: str, negative: str, n: int = 10000, seed: int = 11, tie: str = "state_label") -> DataFrame:
    """Label permutation of a mean difference (greater)."""
    rows = df.filter(F.col(group).isin(positive, negative) & F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"), row_key(tie).alias("_key"))
    s = rows.agg(
        F.count_if(F.col("_g") == positive).alias("p"), F.count("*").alias("n"), F.sum("_v").alias("total"),
        (F.avg(F.when(F.col("_g") == positive, F.col("_v"))) - F.avg(F.when(F.col("_g") == negative, F.col("_v")))).alias("observed")).first()
    if not s["p"] or s["p"] == s["n"]:
        return df.sparkSession.createDataFrame([(None, None)], "observed_diff double, permutation_p_value double")
    sums = subset_sums(cells(rows, ["_v"]), s["p"], s["n"], n, seed)
    d = F.col("subset_sum") / s["p"] - (F.lit(s["total"]) - F.col("subset_sum")) / (s["n"] - s["p"])
    return sums.agg(F.lit(s["observed"]).alias("observed_diff"), ((F.count_if(d >= s["observed"] - 1e-12) + 1) / (F.count("*") + 1)).alias("permutation_p_value"))


def jackknife(df: DataFrame, block: str, group: str, value: str, positive: str, negative: str) -> DataFrame:
    """Effect with each block left out, from totals minus block sums."""
    def sums(prefix: str) -> list[Column]:
        out = []
        for side, g in (("p", positive), ("q", negative)):
            hit = F.col(group) == g
            out += [F.count_if(hit).alias(f"{prefix}{side}n"), F.sum(F.when(hit, F.col(value)).otherwise(0.0)).alias(f"{prefix}{side}s")]
        return out

    total = df.agg(F.struct(*sums("t_")).alias("t")).scalar()
    per = df.filter(F.col(block).isNotNull()).groupBy(block).agg(*sums("")).withColumn("t", total)
    pn, qn = F.col("t.t_pn") - F.col("pn"), F.col("t.t_qn") - F.col("qn")
    pm, qm = (F.col("t.t_ps") - F.col("ps")) / pn, (F.col("t.t_qs") - F.col("qs")) / qn
    return per.filter((pn > 0) & (qn > 0)).select(
        F.col(block).alias("left_out"), pn.alias("positive_n"), qn.alias("negative_n"), pm.alias("positive_mean"), qm.alias("negative_mean"), (pm - qm).alias("effect"))


def jackknife_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.min("effect").alias("jackknife_min_effect"), F.avg(F.when(F.col("effect") > 0, 1.0).otherwise(0.0)).alias("jackknife_positive_fraction"))


def state_blocked_effect(scored: DataFrame, positive: str, negative: str, value: str = "score", n_bootstrap: int = 10000, n_permutations: int = 10000, seed: int = 11) -> DataFrame:
    """State-level effect with E13-E16 in one row."""
    states = cut_lineage(scored.groupBy("state_label").agg(F.min("element_type").alias("element_type"), F.min("chromosome").alias("chromosome"), F.avg(value).alias("mean_score")))
    args = ("element_type", "mean_score", positive, negative)
    means = states.agg(*[F.avg(F.when(F.col("element_type") == g, F.col("mean_score"))).alias(nm) for nm, g in (("positive_mean", positive), ("negative_mean", negative))])

    def one(table: DataFrame) -> Column:
        return table.select(F.struct("*").alias("s")).scalar()

    out = means.select(
        "*",
        one(mann_whitney(states, *args)).alias("mw"),
        one(mean_diff_bootstrap(states, *args, n=n_bootstrap, seed=seed)).alias("bs"),
        one(mean_diff_permutation(states, *args, n=n_permutations, seed=seed)).alias("pm"),
        one(jackknife_summary(jackknife(states, "chromosome", *args))).alias("jk"),
    )
    return out.select(
        "positive_mean", "negative_mean", F.col("mw.n_positive").alias("positive_states"), F.col("mw.n_negative").alias("negative_states"),
        (F.col("positive_mean") - F.col("negative_mean")).alias("effect"), F.try_divide("positive_mean", "negative_mean").alias("effect_ratio"),
        "bs.bootstrap_ci_low", "bs.bootstrap_ci_high", F.col("pm.permutation_p_value").alias("permutation_p_value"),
        F.col("mw.p_value").alias("mann_whitney_p_value"), "jk.jackknife_min_effect", "jk.jackknife_positive_fraction")


def _both_metrics(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """AUPRC and AUROC of columns ``m`` and ``b`` per group, one row per metric."""
    extra = [weight] if weight else []
    long = df.select(*by, "label", *extra, F.explode(F.array(F.struct(F.lit("m").alias("k"), F.col("m").alias("s")), F.struct(F.lit("b").alias("k"), F.col("b").alias("s")))).alias("x"))
    per = ranking_metrics(long.select(*by, "label", *extra, "x.k", "x.s"), "label", "s", [*by, "k"], weight)
    tall = per.select(*by, "k", F.explode(F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).alias("v")) for n in ("auprc", "auroc")])).alias("e")).select(*by, "k", "e.*")
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    return tall.groupBy(*by, "metric_name").agg(pick("m").alias("model_metric"), pick("b").alias("baseline_metric"))


def paired_tests(df: DataFrame, by: list[str], n_bootstrap: int = 5000, n_permutations: int = 5000, seed: int = 11, tie: str = "seq_id") -> DataFrame:
    """E6 + E7 for many comparisons at once. ``df``: by, seq_id, label, model score ``m``, baseline score ``b``."""
    rows = cut_lineage(df.select(*by, tie, "label", "m", "b").dropna())
    observed = _both_metrics(rows, by).withColumn("observed_diff", F.col("model_metric") - F.col("baseline_metric"))
    keys = [*by, "metric_name"]
    diff = (F.col("model_metric") - F.col("baseline_metric")).alias("d")
    boot = replicate_metrics(rows, by, "poisson", n_bootstrap, seed, tie).select(*keys, diff)
    perm = replicate_metrics(rows, by, "swap", n_permutations, seed, tie).select(*keys, diff)
    obs = observed.select(*keys, "observed_diff")
    d = F.coalesce("d", "observed_diff")
    boot = boot.join(obs, keys).groupBy(*keys).agg(
        F.percentile(d, F.lit(0.025)).alias("ci_low"), F.percentile(d, F.lit(0.975)).alias("ci_high"), ((F.count_if(d <= 0) + 1) / (F.count("*") + 1)).alias("bootstrap_p_value"))
    perm = perm.join(obs, keys).groupBy(*keys).agg(((F.count_if(F.col("d") >= F.col("observed_diff") - 1e-12) + 1) / (F.count("*") + 1)).alias("permutation_p_value"))
    return observed.join(boot, keys).join(perm, keys)
