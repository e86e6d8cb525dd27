"""Evaluation reports over scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar.functions.keys import direction, parse_effect, parse_region
from pairgrammar.operators import intervals as N
from pairgrammar.operators import metrics as M
from pairgrammar.operators import selection as W
from pairgrammar.operators import stats as X
from pairgrammar.operators import summaries as D
from pairgrammar.operators.ordered import dedupe, ranked, top_per_group
from pairgrammar.session import cut_lineage, materialize

MODEL = "model"
OWN = {MODEL: "full_score", "availability_only": "availability_only_score", "additive_null": "additive_null_score"}
ENHANCER_LIKE = ["pELS", "dELS"]  # fixed classes of the enhancer-like group


def _one(df: DataFrame) -> Column:
    return df.select(F.struct("*").alias("s")).scalar()


def method_scores(preds: DataFrame, seeds: list[int], baselines: DataFrame | None = None) -> DataFrame:
    """Seed-averaged scores per slice and method, restricted to rows that every method of the slice scored.

    Averages are rounded to nine decimals: equal means must tie whatever the order of summation.

    ``preds``: phase, split_name, seed, seq_id, label and the three own scores. ``baselines``: split_name, method, seq_id, score.
    """
    slices = ["split_name", "phase"]
    wanted = preds.filter(F.col("seed").isin(seeds)).dropna(subset=["label"])
    active = wanted.groupBy(*slices).agg(F.count_distinct("seed").alias("_seeds"))
    per = wanted.groupBy(*slices, "seq_id", "label").agg(F.count_distinct("seed").alias("_have"), *[F.round(F.avg(c), 9).alias(c) for c in OWN.values()])
    mean = per.join(active, slices).filter(F.col("_have") == F.col("_seeds")).dropna(subset=list(OWN.values()))
    own = M.long_scores(mean, OWN, [*slices, "seq_id", "label"])
    if baselines is None:
        return own
    methods = baselines.groupBy("split_name").agg(F.count_distinct("method").alias("_methods"))
    scored = baselines.filter("score is not null")
    complete = scored.groupBy("split_name", "seq_id").agg(F.count_distinct("method").alias("_k")).join(methods, "split_name").filter("_k = _methods").select("split_name", "seq_id")
    covered = own.join(methods.select("split_name"), "split_name", "left_semi").join(complete, ["split_name", "seq_id"], "left_semi")
    alone = own.join(methods.select("split_name"), "split_name", "left_anti")
    kept = covered.unionByName(alone)
    extra = kept.filter(F.col("method") == MODEL).select(*slices, "seq_id", "label").join(scored.select("split_name", "seq_id", "method", "score"), ["split_name", "seq_id"])
    return kept.unionByName(extra.select(*slices, "seq_id", "label", "method", "score"))


SLICES = ["split_name", "phase"]


def significance_metrics(scores: DataFrame) -> DataFrame:
    """Ranking metrics of ``method_scores`` per slice and method."""
    return M.ranking_metrics(scores, "label", "score", [*SLICES, "method"])


def significance_tests(scores: DataFrame, n_bootstrap: int = 5000, n_permutations: int = 5000, seed: int = 11) -> DataFrame:
    """Paired tests of the model against every other method of a slice, with FDR and flags."""
    scores = cut_lineage(scores)
    model = scores.filter(F.col("method") == MODEL).select(*SLICES, "seq_id", "label", F.col("score").alias("m"))
    others = scores.filter(F.col("method") != MODEL).select(*SLICES, "seq_id", F.col("method").alias("comparison_method"), F.col("score").alias("b"))
    pairs = model.join(others, [*SLICES, "seq_id"])
    tests = cut_lineage(X.paired_tests(pairs, [*SLICES, "comparison_method"], n_bootstrap, n_permutations, seed))
    return X.significant_win(X.bh_fdr(tests, "permutation_p_value", [*SLICES, "metric_name", "comparison_method"]))


def missing_predictions(preds: DataFrame, seeds: list[int]) -> DataFrame:
    """Slices and seeds without any prediction."""
    asked = preds.select(*SLICES).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return asked.join(preds.select(*SLICES, "seed").distinct(), [*SLICES, "seed"], "left_anti").withColumn("reason", F.lit("missing_predictions"))


def evaluate_predictions(preds: DataFrame, gap_prediction: str | None = None) -> DataFrame:
    """One row with every metric and audit of a prediction table."""
    long = M.long_scores(preds, OWN, ["label"])
    m = M.ranking_metrics(long, "label", "score", ["method"])
    flat = m.agg(*[F.max(F.when(F.col("method") == k, F.col(v))).alias(f"{k}_{v}") for k in OWN for v in ("auprc", "auroc")])
    pieces = {
        "b": M.binary_metrics(preds, "label", "full_score"), "e": M.calibration_error(preds, "label", "full_score"),
        "g": D.availability_gap(W.strata(preds, "availability_signal")), "l": D.leakage_audit(preds),
    }
    if gap_prediction:
        pieces["s"] = D.spacing_metrics(preds, "edge_gap", gap_prediction)
    out = flat.withColumns({f"_{k}": _one(df) for k, df in pieces.items()})
    gain = lambda base: (F.col("model_auprc") - F.col(f"{base}_auprc")) / F.greatest(F.abs(F.col(f"{base}_auprc")), F.lit(1e-6))
    fields = [f"_{k}.{c}" for k, df in pieces.items() for c in df.columns]
    return out.select(*flat.columns, *fields, gain("availability_only").alias("relative_gain_vs_availability"), gain("additive_null").alias("relative_gain_vs_additive"))


def main_metrics(ledger: DataFrame, baselines: DataFrame, scenario: str) -> DataFrame:
    """Baseline rows plus the latest ledger row per phase, split and seed."""
    latest = dedupe(ledger.filter((F.col("scenario") == scenario) & F.col("metrics").isNotNull()), ["phase", "scenario", "split_name", "seed"], ["started_at", "run_id"], keep="last")
    names = ["auprc", "auroc", "ece", "best_valid_loss"]
    own = latest.select(F.col("phase").alias("method"), "phase", "scenario", "split_name", "seed", *[F.coalesce(F.try_element_at("metrics", F.lit(n)), F.lit(0.0)).alias(n) for n in names])
    base = baselines.select("method", F.lit("baseline").alias("phase"), F.lit(scenario).alias("scenario"), "split_name", *[F.coalesce(n, F.lit(0.0)).alias(n) if n in baselines.columns else F.lit(0.0).alias(n) for n in names])
    return own.unionByName(base, allowMissingColumns=True)


def artifact_inventory(grid: DataFrame, artifacts: DataFrame, overwrite: bool = False) -> DataFrame:
    """Status and blocked reason per requested (phase, split_name, seed).

    ``artifacts``: kind (checkpoint, predictions, train_bundle, valid_bundle), phase, split_name, seed (null for bundles), path, modified.
    """
    keys = ["phase", "split_name", "seed"]
    runs = artifacts.filter("kind IN ('checkpoint', 'predictions')")
    latest = runs.groupBy(*keys).pivot("kind", ["checkpoint", "predictions"]).agg(F.max_by("path", F.struct("modified", "path")))
    bundles = artifacts.filter("kind IN ('train_bundle', 'valid_bundle')").groupBy("phase", "split_name").agg((F.count_distinct("kind") == 2).alias("_bundles"))
    warm = runs.filter("kind = 'checkpoint' AND phase = 'phase4'").select("split_name", "seed").distinct().withColumn("_warm", F.lit(True))
    out = grid.join(latest, keys, "left").join(bundles, ["phase", "split_name"], "left").join(warm, ["split_name", "seed"], "left")
    ready, warm_ok = F.coalesce("_bundles", F.lit(False)), (F.col("phase") != "phase5") | F.coalesce("_warm", F.lit(False))
    blocked = F.when(~ready, "blocked_missing_bundles").when(~warm_ok, "blocked_missing_phase4_warm_start").otherwise("ready_to_train")
    have, scored = F.col("checkpoint").isNotNull(), F.col("predictions").isNotNull()
    status = blocked if overwrite else F.when(have & scored, "complete").when(have, "needs_prediction_regeneration").otherwise(blocked)
    reason = (F.when(F.col("status") == "blocked_missing_bundles", "missing_bundles").when(F.col("status") == "blocked_missing_phase4_warm_start", "missing_phase4_warm_start")
              .when(F.col("status") == "needs_prediction_regeneration", "missing_predictions_only").otherwise(""))
    return out.withColumn("status", status).select(*keys, "status", F.coalesce("checkpoint", F.lit("")).alias("checkpoint"), scored.alias("prediction_exists"), reason.alias("blocked_reason"))


def inventory_rollups(inventory: DataFrame) -> DataFrame:
    """Counts of an inventory's rows as ``measure``, ``value``, ``n``: all, by status, missing parts, ready and blocked by phase.

    Every row names the counts it belongs to, so one grouping with partial sums gives all of them; empty counts have no row.
    """
    status, none = F.col("status"), F.lit("")
    ready, blocked = status == "ready_to_train", status.startswith("blocked_")
    belongs = {
        "requested": (F.lit(True), none), "complete": (status == "complete", none), "ready_to_train": (ready, none), "blocked": (blocked, none),
        "missing_checkpoint": (F.col("checkpoint") == "", none), "missing_prediction": (~F.col("prediction_exists"), none), "status": (F.lit(True), status),
        "ready_to_train_by_phase": (ready, F.col("phase")), "blocked_by_phase": (blocked, F.col("phase"))}
    named = F.array(*[F.when(on, F.struct(F.lit(m).alias("measure"), v.alias("value"))) for m, (on, v) in belongs.items()])
    return inventory.select(F.explode(F.array_compact(named)).alias("e")).groupBy("e.measure", "e.value").agg(F.count("*").alias("n"))


def endogenous_evaluation(registry: DataFrame, status: DataFrame, scores: DataFrame, supported: DataFrame, threshold: float = 0.5) -> dict[str, DataFrame]:
    """L9 + E24: direction consistency per row, per target and per biosample (with a total row).

    ``registry``: registry_id, canonical_biosample, target_gene, enhancer_id, perturbation_descriptor.
    ``scores``: seq_id, seed, full_score. ``supported``: state_label. Its few distinct labels go to every task,
    as a shuffle by biosample would put all rows of one into one task.
    """
    effect, p = parse_effect("perturbation_descriptor")
    known = supported.select(F.col("state_label").alias("canonical_biosample")).distinct().withColumn("_known", F.lit(True))
    reg = registry.withColumns({"effect_size": effect, "effect_p_value": p, "seq_id": F.concat(F.lit("endogenous_confirmatory::"), "registry_id")}).join(F.broadcast(known), "canonical_biosample", "left")
    reg = reg.withColumns({"observed_direction": direction("effect_size"), "supported_state_label": F.coalesce("_known", F.lit(False))}).drop("_known")
    reg = reg.withColumns({"direction_evaluable": F.col("observed_direction") != "", "direction_significant": F.coalesce("effect_p_value", F.lit(1.0)) <= 0.05})
    n_seeds = scores.agg(F.count_distinct("seed").alias("n")).scalar()
    mean = scores.groupBy("seq_id").agg(F.count_distinct("seed").alias("_k"), F.avg("full_score").alias("full_score_mean"), F.coalesce(F.stddev_samp("full_score"), F.lit(0.0)).alias("full_score_std"))
    mean = mean.filter(F.col("_k") == n_seeds).drop("_k")
    rows = reg.filter("direction_evaluable").join(status.select("seq_id", "has_candidate", "pair_mode"), "seq_id", "left").join(mean, "seq_id", "left")
    rows = rows.withColumns({"has_candidate": F.coalesce("has_candidate", F.lit(False)), "scored": F.col("full_score_mean").isNotNull()})
    predicted = F.when(F.col("full_score_mean") >= threshold, "activating").when(F.col("scored"), "repressive").otherwise("")
    rows = rows.withColumn("predicted_direction", predicted)
    rows = rows.withColumns({
        "direction_consistent": F.when(F.col("scored"), F.col("predicted_direction") == F.col("observed_direction")),
        "coverage_note": F.when(~F.col("supported_state_label"), "unsupported_state_label").when(~F.col("has_candidate"), "no_candidate_pair").when(~F.col("scored"), "missing_prediction").otherwise("scored")})
    scored = rows.filter("scored")
    rate = lambda c: F.avg(F.col(c).cast("double"))
    target = scored.groupBy("canonical_biosample", "target_gene").agg(
        F.count("*").alias("n_rows"), F.count_distinct("enhancer_id").alias("n_unique_enhancers"), F.avg("effect_size").alias("mean_effect_size"), F.avg("full_score_mean").alias("mean_full_score"),
        rate("direction_consistent").alias("row_direction_consistency_rate"), F.array_join(F.array_sort(F.collect_set("pair_mode")), ",").alias("pair_modes"))
    target = target.withColumns({"observed_target_direction": direction("mean_effect_size"), "predicted_target_direction": F.when(F.col("mean_full_score") >= threshold, "activating").otherwise("repressive")})
    target = target.withColumn("target_consistent", F.col("observed_target_direction") == F.col("predicted_target_direction"))

    key = "canonical_biosample"
    one = D.summary_with_total(reg, key, registry_rows=F.count("*"), unique_targets=F.count_distinct("target_gene"), direction_evaluable_rows=F.count_if("direction_evaluable"),
                               supported_direction_rows=F.count_if(F.col("direction_evaluable") & F.col("supported_state_label")))
    two = D.summary_with_total(rows, key, candidate_rows=F.count_if("has_candidate"), scored_rows=F.count_if("scored"), direction_consistency_rate=rate("direction_consistent"), mean_full_score=F.avg("full_score_mean"))
    three = D.summary_with_total(target, key, target_consistency_rate=rate("target_consistent"))
    return {"rows": rows, "targets": target, "biosamples": one.join(two, key, "left").join(three, key, "left")}


def ccre_report(scored: DataFrame, registry: DataFrame, score: str = "score") -> dict[str, DataFrame]:
    """Per-state ranks and margins, winners with a high-confidence flag, contrast test and class table.

    ``scored``: seq_id, state_label, label, score. ``registry``: state_label, element_type (one row per state).
    """
    joined = scored.drop("element_type").join(registry.select("state_label", "element_type"), "state_label", "left")
    joined = joined.withColumn("ccre_group", F.when(F.col("element_type").isin(ENHANCER_LIKE), "enhancer_like").otherwise("other"))
    margins = W.group_margin(joined, ["state_label"], score, "state_margin")
    top = top_per_group(margins, ["state_label"], [f"-{score}", "seq_id"], 1)
    top = materialize(top)
    cut = D.quantiles(top, score, {"c": 0.75}).scalar()
    winners = top.withColumn("high_confidence_winner", F.col(score) >= cut)
    kinds = winners.agg(F.struct(
        F.count_distinct("ccre_group").alias("groups"), F.count_distinct("element_type").alias("types"), F.coalesce(F.bool_or(F.col("element_type") == "pELS"), F.lit(False)).alias("pels"))).scalar()
    common = winners.filter("element_type is not null").groupBy("element_type").agg(F.count("*").alias("n")).agg(F.max_by("element_type", F.struct("n", "element_type"))).scalar()
    contrast = F.when(F.col("_k.groups") >= 2, "enhancer_like").when(F.col("_k.pels") & (F.col("_k.types") >= 2), "pELS").when(F.col("_k.types") >= 2, common).otherwise("single_class_only")
    marked = winners.withColumn("_k", kinds).withColumn("contrast_class", contrast).drop("_k")
    hit = F.coalesce(F.when(F.col("contrast_class") == "enhancer_like", F.col("ccre_group") == "enhancer_like").otherwise(F.col("element_type") == F.col("contrast_class")), F.lit(False))
    test = X.fisher_greater(D.contingency(marked, F.col("high_confidence_winner"), hit, ["contrast_class"]), ["contrast_class"])
    accuracy = winners.agg(F.avg(F.when(F.col("label") > 0.5, 1.0).otherwise(0.0)).alias("state_winner_accuracy"), F.count_distinct("state_label").alias("n_states"))
    classes = winners.groupBy("element_type").agg(
        F.count_distinct("state_label").alias("n_states"), F.avg(score).alias("mean_score"),
        F.avg("state_margin").alias("mean_state_margin"), F.avg(F.when(F.col("label") > 0.5, 1.0).otherwise(0.0)).alias("correct_rate"))
    classes = classes.join(D.quantiles(winners, score, {"median_score": 0.5}, ["element_type"]), "element_type", "left")
    return {"winners": winners, "summary": accuracy, "contrast": test, "classes": classes}


def peak_overlap_report(rows: DataFrame, peaks: DataFrame, bin_size: int = N.BIN) -> DataFrame:
    """Enrichment of peak overlap among positives, for rows with one and with both TFs covered.

    ``rows``: seq_id, state_label (coordinates), left_tf, right_tf, label. ``peaks``: gene, chromosome, start, end.
    """
    chrom, start, end = parse_region("state_label")
    placed = rows.withColumns({"chromosome": chrom, "region_start": start, "region_end": end})
    flags = N.overlap_flags(placed, W.merge_intervals(peaks, ["gene", "chromosome"]), bin_size)
    metric = F.explode(F.array(
        F.struct(F.lit("any_tf_overlap").alias("metric"), F.lit(1).alias("need"), F.col("any_tf_overlap").alias("hit")),
        F.struct(F.lit("both_tf_overlap").alias("metric"), F.lit(2).alias("need"), F.col("both_tfs_overlap").alias("hit")))).alias("e")
    flags = cut_lineage(flags)
    tall = flags.select("label", "num_covered_tfs", metric).select("label", "num_covered_tfs", "e.*").filter(F.col("num_covered_tfs") >= F.col("need"))
    positive = F.col("label") > 0.5
    test = X.fisher_greater(D.contingency(tall, positive, F.col("hit"), ["metric"]), ["metric"])
    rates = tall.groupBy("metric").agg(F.count("*").alias("n_rows"), F.avg(F.when(positive, F.col("hit").cast("double"))).alias("positive_overlap_rate"), F.avg(F.when(~positive, F.col("hit").cast("double"))).alias("negative_overlap_rate"))
    return rates.join(test.select("metric", "odds_ratio", "p_value"), "metric")


def validation_suite(scored: DataFrame, registry: DataFrame, peaks: DataFrame, positive: str = "pELS", negative: str = "dELS", score: str = "score",
                     n_bootstrap: int = 10000, n_permutations: int = 10000, seed: int = 11) -> dict[str, DataFrame]:
    """Transfer report, state-blocked effect and peak overlap of one scored table."""
    typed = scored.drop("element_type").join(registry.select("state_label", "element_type"), "state_label", "left")
    return {
        **{f"ccre_{k}": v for k, v in ccre_report(scored, registry, score).items()},
        "state_blocked": X.state_blocked_effect(typed, positive, negative, score, n_bootstrap, n_permutations, seed),
        "peak_overlap": peak_overlap_report(scored, peaks),
    }


def direction_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AUPRC and AUROC of the activating direction."""
    scored = rows.filter("scored").withColumn("_y", F.when(F.col("observed_direction") == "activating", 1.0).otherwise(0.0))
    return M.ranking_metrics(scored, "_y", "full_score_mean", by or [])


def ranked_registry(registry: DataFrame) -> DataFrame:
    """Running number of a registry row inside its biosample."""
    return ranked(registry, ["canonical_biosample"], ["registry_id"], "priority_rank_within_biosample")
