"""Ranking, calibration and report metrics over scored rows.

Scores are collapsed to (group, score) counts before any ordering, so the sort works on
distinct scores only and rows are combined map-side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgrammar.operators.ordered import order_columns, ranked, running


def collapse(df: DataFrame, label: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    one = F.col(weight).cast("double") if weight else F.lit(1.0)
    positive = F.col(label) > 0.5
    return (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("_score"))
        .agg(F.sum(F.when(positive, one).otherwise(0.0)).alias("_pos"), F.sum(F.when(positive, 0.0).otherwise(one)).alias("_neg"))
    )


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None,
                    weight: str | None = None, strict: bool = False, ranges: int | None = None) -> DataFrame:
    """E1 + E2: AUROC (ties count half) and average precision per group.

    A group with one class gives null; with ``strict`` it is an error.
    """
    by = by or []
    counts = collapse(df, label, score, by, weight)
    ordered = running(counts, by, ["-_score"], {"_tp": ("sum", F.col("_pos")), "_fp": ("sum", F.col("_neg"))}, ranges=ranges)
    sums = ordered.groupBy(*by).agg(
        F.sum("_pos").alias("_p"),
        F.sum("_neg").alias("_n"),
        F.sum(F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("_ap"),
        F.sum(F.col("_pos") * (F.col("_fp") - F.col("_neg") / 2)).alias("_above"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    one_class = F.raise_error(F.lit("a group holds one class")).cast("double") if strict else F.lit(None).cast("double")
    return sums.select(
        *by,
        F.coalesce(F.col("_p") + F.col("_n"), F.lit(0.0)).cast("long").alias("n"),
        F.coalesce(F.col("_p"), F.lit(0.0)).cast("long").alias("positives"),
        F.when(both, F.col("_ap") / F.col("_p")).otherwise(one_class).alias("auprc"),
        F.when(both, 1.0 - F.col("_above") / (F.col("_p") * F.col("_n"))).otherwise(one_class).alias("auroc"),
    )


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Brier score, clipped NLL and balanced accuracy at 0.5."""
    by = by or []
    y, s = F.col(label).cast("double"), F.col(score)
    p = F.least(F.greatest(s, F.lit(1e-6)), F.lit(1 - 1e-6))
    hit = F.when(s >= 0.5, 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(
        F.avg((s - y) * (s - y)).alias("brier"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("nll"),
        ((F.avg(F.when(y > 0.5, hit)) + F.avg(F.when(y <= 0.5, 1 - hit))) / 2).alias("balanced_accuracy"),
    )


def calibration_error(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Expected calibration error on equal-width bins, last bin closed; scores outside 0..1 fall in no bin."""
    by = by or []
    inside = F.col(score).between(0.0, 1.0)
    cell = F.when(inside, F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))).alias("_bin")
    cells = df.groupBy(*by, cell).agg(
        F.count("*").alias("_n"), F.avg(score).alias("_conf"), F.avg(F.col(label).cast("double")).alias("_acc"))
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_conf") - F.col("_acc")) * F.col("_n")).otherwise(0.0)
    return cells.groupBy(*by).agg((F.sum(gap) / F.sum("_n")).alias("ece"))


def top_k_recall(df: DataFrame, label: str, score: str, k: int, tie: str = "seq_id") -> DataFrame:
    """E5: share of all positives found in the ``k`` best scores (0 without positives)."""
    best = df.orderBy(F.col(score).desc(), F.col(tie)).limit(k).agg(F.sum(label).alias("_hit"))
    total = df.agg(F.sum(label).alias("_all"))
    return best.select(F.when(F.coalesce(total.scalar(), F.lit(0)) > 0, F.col("_hit") / total.scalar()).otherwise(0.0).alias("recall"))


def metric_by(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """AUPRC and AUROC per stratum; strata with one class are left out."""
    return ranking_metrics(df, label, score, by).filter(F.col("auprc").isNotNull())


def long_scores(df: DataFrame, methods: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per (example, method); ``methods`` maps a method name to its score column."""
    pairs = F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).cast("double").alias("score")) for n, c in methods.items()])
    return df.select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.method", "_m.score")


def gains(metrics: DataFrame, by: list[str], value: str, model: str, baselines: list[str]) -> DataFrame:
    """Model minus each baseline, and the gain relative to it."""
    wide = metrics.groupBy(*by).pivot("method", [model, *baselines]).agg(F.first(value))
    out = [*by]
    for b in baselines:
        delta = F.col(model) - F.col(b)
        out += [delta.alias(f"gain_vs_{b}"), (delta / F.greatest(F.abs(F.col(b)), F.lit(1e-6))).alias(f"relative_gain_vs_{b}")]
    return wide.select(*out)


def check_metrics(observed: DataFrame, expected: DataFrame, keys: list[str], value: str, tol: float = 1e-3) -> DataFrame:
    """Golden check; missing rows on either side fail."""
    o, e = observed.select(*keys, F.col(value).alias("observed")), expected.select(*keys, F.col(value).alias("expected"))
    joined = o.join(e, keys, "full")
    return joined.withColumn("passes", F.coalesce(F.abs(F.col("observed") - F.col("expected")) <= tol, F.lit(False)))


def selective_risk(df: DataFrame, uncertainty: str = "score_std", correct: str = "correct", tie: str = "seq_id") -> DataFrame:
    """Accuracy among the most certain examples at every coverage."""
    total = df.agg(F.count("*").alias("n")).scalar()
    run = running(df.select(tie, uncertainty, F.col(correct).cast("double").alias(correct)), [], [uncertainty, tie],
                  {"kept": ("sum", F.lit(1).cast("long")), "_right": ("sum", F.col(correct))})
    return run.select(tie, "kept", (F.col("kept") / total).alias("coverage"), (F.col("_right") / F.col("kept")).alias("accuracy"))


def ranking_nll(df: DataFrame, group: str, label: str = "label", score: str = "score") -> DataFrame:
    """Listwise negative log likelihood over groups that hold both labels."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = df.select(group, F.col(label).cast("double").alias("_y"), F.ln(p / (1 - p)).alias("_z"))
    # logits lie within about +-13.9 because of the clip, so exp() needs no max shift
    per = rows.groupBy(group).agg(
        F.count("*").alias("_n"), F.sum("_y").alias("_pos"), F.sum(F.exp("_z")).alias("_z_sum"), F.sum(F.col("_y") * F.col("_z")).alias("_yz"))
    kept = per.filter((F.col("_n") >= 2) & (F.col("_pos") > 0) & (F.col("_pos") < F.col("_n")))
    loss = F.ln("_z_sum") - F.col("_yz") / F.col("_pos")
    return kept.agg(F.count("*").alias("groups"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("ranking_nll"))


def monotonicity(df: DataFrame, score: str, availability: str, tie: str = "seq_id") -> DataFrame:
    """Mean drop of the score along rising availability."""
    rows = ranked(df.select(tie, score, availability), [], [availability, tie], "_r")
    # the neighbour is found by rank, so no single task has to hold the whole order
    pairs = rows.select(F.explode(F.array(F.struct(F.col("_r").alias("slot"), F.lit(1).alias("side")),
                                          F.struct((F.col("_r") - 1).alias("slot"), F.lit(0).alias("side")))).alias("s"), F.col(score).alias("_v"))
    step = pairs.groupBy("s.slot").agg(F.max(F.when(F.col("s.side") == 0, F.col("_v"))).alias("_next"),
                                       F.max(F.when(F.col("s.side") == 1, F.col("_v"))).alias("_here"))
    deltas = step.filter(F.col("_next").isNotNull() & F.col("_here").isNotNull())
    return deltas.agg(F.coalesce(F.avg(F.greatest(F.col("_here") - F.col("_next"), F.lit(0.0))), F.lit(0.0)).alias("violation"))


def smoothness(curve: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Mean squared step of a landscape; a curve has as many points as there are gap bins."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order_columns([position])))
    return curve.withColumn("_d", step).groupBy(*by).agg(F.coalesce(F.avg(F.col("_d") * F.col("_d")), F.lit(0.0)).alias("roughness"))


def hardest(df: DataFrame, n: int = 8, label: str = "label", score: str = "full_score", tie: str = "seq_id") -> DataFrame:
    """Largest absolute error first."""
    return df.withColumn("error", F.abs(F.col(label) - F.col(score))).orderBy(F.col("error").desc(), F.col(tie)).limit(n)


def control_report(df: DataFrame, residual: Column, seed: int, label: str = "label", score: str = "full_score", tie: str = "seq_id") -> DataFrame:
    """AP of the residual score and of shuffled scores (hash-ordered exchange of scores)."""
    base = df.select(tie, label, score, residual.alias("_residual"))
    left = ranked(base.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(f"{seed}a"), F.col(tie)), 256)), [], ["_h"], "_r")
    right = ranked(base.select(F.col(score).alias("_shuffled"), F.sha2(F.concat_ws("|", F.lit(f"{seed}b"), F.col(tie)), 256).alias("_h")), [], ["_h"], "_r")
    mixed = left.drop("_h").join(right.drop("_h"), "_r")
    scored = long_scores(mixed, {"score": score, "residual": "_residual", "shuffled": "_shuffled"}, [label])
    return ranking_metrics(scored, label, "score", ["method"]).select("method", "auprc", "auroc")
