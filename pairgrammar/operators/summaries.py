"""Grouped summaries (D)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgrammar import schema
from pairgrammar.functions.geometry import gap_index
from pairgrammar.functions.keys import is_reverse, strip_reverse
from pairgrammar.operators.ordered import ranked, running


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """D1."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def aggregate_regions(df: DataFrame) -> DataFrame:
    """Element summary from region rows."""
    named = df.withColumn("element_group", strip_reverse("name")).withColumn("is_reverse", is_reverse("name"))
    return named.groupBy("element_group").agg(
        F.min("chromosome").alias("chromosome"), F.min("region_start").alias("region_start"), F.max("region_end").alias("region_end"),
        F.count("*").alias("bed_rows"), F.count_if("is_reverse").alias("bed_reverse_rows"), F.count_if(~F.col("is_reverse")).alias("bed_forward_rows"),
        F.avg("activity_score").alias("mean_bed_activity"), F.stddev_samp("activity_score").alias("std_bed_activity"),
        (F.max("region_end") - F.min("region_start")).alias("element_width"))


def aggregate_replicates(df: DataFrame) -> DataFrame:
    """D3 + D4: replicate summary with the orientation means and their gap in the same aggregate."""
    named = df.withColumn("element_group", strip_reverse("name")).withColumn("is_reverse", is_reverse("name"))
    fwd, rev = F.avg(F.when(~F.col("is_reverse"), F.col("log2"))), F.avg(F.when(F.col("is_reverse"), F.col("log2")))
    return named.groupBy("element_group").agg(
        F.count("*").alias("tsv_rows"), F.count_distinct("replicate").alias("replicate_count"),
        F.min("replicate").alias("replicate_min"), F.max("replicate").alias("replicate_max"),
        F.avg("log2").alias("mean_log2_activity"), F.stddev_samp("log2").alias("std_log2_activity"),
        F.avg("ratio").alias("mean_ratio"), F.stddev_samp("ratio").alias("std_ratio"),
        F.min("n_obs_bc").alias("min_obs_bc"), F.avg("n_obs_bc").alias("mean_obs_bc"),
        F.count_if("is_reverse").alias("reverse_rows"), F.count_if(~F.col("is_reverse")).alias("forward_rows"),
        fwd.alias("forward_mean_log2"), rev.alias("reverse_mean_log2"), F.abs(fwd - rev).alias("orientation_gap_log2"))


def pivot_means(df: DataFrame, row: str, col: str, value: str, values: list) -> DataFrame:
    """Mean per row and column; the column values are given, so no extra pass finds them."""
    return df.groupBy(row).pivot(col, values).agg(F.avg(value))


def top_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    """Most frequent categories (for a heat map)."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), col).limit(n)


def distinct_counts(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Distinct values per column, blanks ignored."""
    return df.groupBy(*(by or [])).agg(*[F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(f"{c}_distinct") for c in cols])


def distinct_list(df: DataFrame, key: str, col: str, name: str = "values", sep: str = ",") -> DataFrame:
    """Sorted distinct strings per group; duplicates go before the lists are gathered."""
    return df.select(key, F.col(col).cast("string").alias(col)).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(col)), sep).alias(name))


def distinct_chunks(df: DataFrame, key: str, col: str, size: int = 1000, name: str = "values", sep: str = ",") -> DataFrame:
    """D7 for groups of any size: the sorted list in rows (key, ``chunk``, values) of ``size`` strings each.

    Lists of a group in the order of their chunks are its ``distinct_list``. Values are ranked by ranges, so a
    group is never one task. Nulls are no values; a group without others has no row.
    """
    values = df.select(key, F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull()).distinct()
    dealt = ranked(values, [key], [col], "_rank").withColumn("chunk", F.floor((F.col("_rank") - 1) / size).cast("long"))
    return dealt.groupBy(key, "chunk").agg(F.array_join(F.array_sort(F.collect_list(col)), sep).alias(name))


def quantiles(df: DataFrame, col: str, qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``qs``.

    Equal values are counted first and the two neighbouring ranks are found from running counts,
    so no task has to hold all values of a group.
    """
    by = by or []
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    run = running(counts, by, ["_v"], {"_upto": ("sum", F.col("_c"))})
    sizes = run.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(by)]).agg(F.max("_upto").alias("_n"))
    if by:
        same = " AND ".join(f"`{k}` <=> _g{i}" for i, k in enumerate(by))
        placed = run.join(sizes, F.expr(same))
    else:
        placed = run.withColumn("_n", sizes.scalar())
    aggs, out = [], []
    for i, (name, q) in enumerate(qs.items()):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        for side, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            holds = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
            aggs.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{side}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_f{i}"))
        out.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(name))
    return placed.groupBy(*by).agg(*aggs).select(*by, *out)


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min-max scaling over the frame, 0 when the range is below 1e-8."""
    ranges = df.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols]).alias("r")).scalar()
    out = df.withColumn("_r", ranges)
    scaled = {}
    for c in cols:
        lo, hi = F.col(f"_r.{c}.lo"), F.col(f"_r.{c}.hi")
        scaled[c] = F.when(hi - lo < 1e-8, 0.0).otherwise((F.col(c) - lo) / (hi - lo))
    return out.withColumns(scaled).drop("_r")


def support_score(df: DataFrame, name: str = "state_support_score") -> DataFrame:
    """Weighted support of the scaled fragment total and file count, clipped to 0..1."""
    scaled = minmax(df.withColumns({"_a": F.col("state_total_fragment_count").cast("double"), "_b": F.col("state_supporting_files").cast("double")}), ["_a", "_b"])
    return scaled.withColumn(name, F.least(F.greatest(0.7 * F.col("_a") + 0.3 * F.col("_b"), F.lit(0.0)), F.lit(1.0))).drop("_a", "_b")


def landscape(preds: DataFrame, gap: str = "edge_gap", score: str = "full_score") -> DataFrame:
    """Mean score per gap and orientation."""
    return preds.groupBy(F.col(gap).alias("gap"), "orientation").agg(F.avg(score).alias("score"))


def seed_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Spread of each metric over seeds per split."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    best = F.max_by("seed", F.struct(F.col("auprc"), -F.col("seed")))
    return runs.groupBy("split_name").agg(
        F.count_distinct("seed").alias("n_seeds"), F.array_join(F.array_sort(F.collect_set("seed")), ",").alias("seeds"), best.alias("best_seed_by_auprc"), *aggs)


def sem_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean with a normal 95% half width."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(half, F.lit(0.0)).alias("half_width"))


def contingency(df: DataFrame, row: Column, col: Column, by: list[str] | None = None) -> DataFrame:
    """2 x 2 counts."""
    return df.groupBy(*(by or [])).agg(
        F.count_if(row & col).alias("a"), F.count_if(row & ~col).alias("b"), F.count_if(~row & col).alias("c"), F.count_if(~row & ~col).alias("d"))


def binary_summary(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Size, positives, negatives and rate."""
    hit = F.col(label) > 0.5
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("positive_n"), F.count_if(~hit).alias("negative_n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("positive_rate"))


def qualify_states(df: DataFrame, state: str = "state_label", label: str = "label", evidence: str = "evidence_score") -> DataFrame:
    """Per-state counts with the verdict (two rows, both labels, varied evidence)."""
    ok = (F.col("n_rows") >= 2) & (F.col("positives") > 0) & (F.col("positives") < F.col("n_rows")) & (F.col("max_evidence") > F.col("min_evidence"))
    return df.groupBy(state).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(label) > 0.5).alias("positives"),
        F.min(evidence).alias("min_evidence"), F.max(evidence).alias("max_evidence")).withColumn("qualified", ok)


def ensemble(preds: DataFrame, keys: list[str], value: str, ddof: int = 0) -> DataFrame:
    """Mean and spread over seeds."""
    std = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    return preds.groupBy(*keys).agg(F.avg(value).alias("score_mean"), F.coalesce(std, F.lit(0.0)).alias("score_std"))


def summary_with_total(df: DataFrame, key: str, total: str = "ALL", **aggs: Column) -> DataFrame:
    """Detail rows and one grand total from a single rollup."""
    rolled = df.rollup(key).agg(F.grouping_id().alias("_g"), *[c.alias(n) for n, c in aggs.items()])
    return rolled.withColumn(key, F.when(F.col("_g") == 1, total).otherwise(F.col(key))).drop("_g")


def audit_layer(seqs: DataFrame, states: DataFrame, length: int = schema.WINDOW) -> DataFrame:
    """One-row self audit of a candidate layer."""
    ls, le, rs, re = (F.col(c) for c in ("left_anchor_start", "left_anchor_end", "right_anchor_start", "right_anchor_end"))
    bad = (ls < 0) | (le > length) | (rs < 0) | (re > length) | (ls >= le) | (rs >= re)
    overlap = F.greatest(F.lit(0), F.least(le, re) - F.greatest(ls, rs))
    centre = (rs + re) / 2.0 - (ls + le) / 2.0
    n_states = states.select(F.count_distinct("state_label").alias("n")).scalar()
    missing = seqs.join(states.select("state_label").distinct(), "state_label", "left_anti").agg(F.count("*").alias("n")).scalar()
    per_state = seqs.groupBy("state_label").agg(F.count("*").alias("n")).agg(F.struct(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k"))).scalar()
    out = seqs.agg(
        F.count("*").alias("num_sequences"), F.count_distinct("seq_id").alias("unique_seq_ids"),
        F.min(F.length("sequence")).alias("sequence_length_min"), F.max(F.length("sequence")).alias("sequence_length_max"),
        F.count_if(bad).alias("anchors_out_of_bounds"),
        F.max(F.abs(F.col("overlap_len") - overlap)).alias("overlap_max_abs_diff"),
        F.max(F.abs(F.col("edge_gap") - (rs - le))).alias("gap_max_abs_diff"),
        F.max(F.abs(F.col("center_distance") - centre)).alias("center_distance_max_abs_diff"))
    return out.withColumn("_s", per_state).select(
        "*", (F.col("num_sequences") - F.col("unique_seq_ids")).alias("duplicate_seq_ids"), n_states.alias("num_states"), missing.alias("missing_state_labels"),
        F.col("_s.k").alias("represented_states"), F.col("_s.lo").alias("rows_per_state_min"), F.col("_s.hi").alias("rows_per_state_max")).drop("_s")


def availability_gap(preds: DataFrame, score: str = "full_score", baseline: str = "availability_only_score", stratum: str = "availability_stratum") -> DataFrame:
    """Matched-stratum gain, mean and population spread over strata."""
    per = preds.groupBy(stratum).agg((F.avg(score) - F.avg(baseline)).alias("_gain"))
    return per.agg(F.coalesce(F.avg("_gain"), F.lit(0.0)).alias("matched_availability_gain_mean"), F.coalesce(F.stddev_pop("_gain"), F.lit(0.0)).alias("matched_availability_gain_std"))


def leakage_audit(preds: DataFrame) -> DataFrame:
    """D21."""
    cols = ["bridge_score", "bridge_score_interface_shuffle", "bridge_score_core_rerandomized"]
    b, s, r = (F.col(c) for c in schema.require_columns(preds, cols).select(*cols).columns)
    return preds.dropna(subset=cols).agg(
        F.coalesce(F.avg(b - s), F.lit(0.0)).alias("bridge_leakage_index"), F.coalesce(F.avg(F.abs(b - r)), F.lit(0.0)).alias("exclusive_core_sensitivity"))


def harmonic_fit(curve: DataFrame, by: list[str], position: str, value: str, period: float = schema.HELICAL_PERIOD) -> DataFrame:
    """First-harmonic least squares on a centred mean curve, by 2 x 2 normal equations."""
    means = curve.groupBy(*by).agg(F.avg(value).alias("_mean"))
    rows = curve.join(means, by) if by else curve.withColumn("_mean", means.scalar())
    y = F.col(value) - F.col("_mean")
    s, c = F.sin(F.col(position) * (2 * math.pi / period)), F.cos(F.col(position) * (2 * math.pi / period))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("points"), F.sum(s * s).alias("ss"), F.sum(c * c).alias("cc"), F.sum(s * c).alias("sc"),
        F.sum(s * y).alias("sy"), F.sum(c * y).alias("cy"), F.sum(y * y).alias("yy"))
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    a = F.when(F.abs(det) > 1e-12, (F.col("sy") * F.col("cc") - F.col("cy") * F.col("sc")) / det).otherwise(0.0)
    b = F.when(F.abs(det) > 1e-12, (F.col("cy") * F.col("ss") - F.col("sy") * F.col("sc")) / det).otherwise(0.0)
    fitted = sums.withColumn("sin_coef", a).withColumn("cos_coef", b)
    explained = F.col("sin_coef") * F.col("sy") + F.col("cos_coef") * F.col("cy")
    return fitted.select(
        *by, "points", "sin_coef", "cos_coef", F.sqrt(F.col("sin_coef") ** 2 + F.col("cos_coef") ** 2).alias("amplitude"),
        F.when(F.col("yy") > 0, explained / F.col("yy")).otherwise(0.0).alias("r_squared"))


def spacing_metrics(preds: DataFrame, gap: str, prediction: str) -> DataFrame:
    """Divergence and earth-mover distance of mean target and mean predicted gap bins (25 rows)."""
    bins = schema.GAP_MAX - schema.GAP_MIN + 1
    target = preds.groupBy(gap_index(gap).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("t"))
    predicted = preds.select(F.posexplode(prediction).alias("bin", "p")).groupBy("bin").agg(F.sum("p").alias("p"))
    every = preds.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = preds.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()
    rows = every.join(target, "bin", "left").join(predicted, "bin", "left").select(
        "bin", (F.coalesce("t", F.lit(0.0)) / n).alias("t"), (F.coalesce("p", F.lit(0.0)) / n).alias("p"))
    whole = Window.partitionBy()
    t, p = F.col("t") / F.greatest(F.sum("t").over(whole), F.lit(1e-6)), F.col("p") / F.greatest(F.sum("p").over(whole), F.lit(1e-6))
    scaled = rows.select("bin", t.alias("t"), p.alias("p"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cums = scaled.select("t", "p", (F.sum("t").over(upto) - F.sum("p").over(upto)).alias("_d"))
    out = cums.agg(F.sum(F.col("t") * F.ln((F.col("t") + 1e-8) / (F.col("p") + 1e-8))).alias("spacing_kl"), F.sum(F.abs("_d")).alias("spacing_emd"))
    return out.withColumn("helical_recovery", 1.0 / (1.0 + F.greatest("spacing_emd", F.lit(0.0)) + F.greatest("spacing_kl", F.lit(0.0))))


def mutual_information(df: DataFrame, cols: list[str], label: str, bins: int = 5, tie: str = "seq_id") -> DataFrame:
    """Equal-frequency binned mutual information of each feature with the label."""
    long = df.select(tie, label, *cols).unpivot([tie, label], cols, "feature", "value")
    placed = ranked(long, ["feature"], ["value", tie], "_r")
    total = df.agg(F.count("*").alias("n")).scalar()
    cells = placed.withColumn("_n", total).withColumn("_bin", F.floor((F.col("_r") - 1) * bins / F.col("_n")))
    joint = cells.groupBy("feature", "_bin", label).agg(F.count("*").alias("nxy"), F.first("_n").alias("n"))
    by_bin, by_label = Window.partitionBy("feature", "_bin"), Window.partitionBy("feature", label)
    parts = joint.select("*", F.sum("nxy").over(by_bin).alias("nx"), F.sum("nxy").over(by_label).alias("ny"))
    return parts.groupBy("feature").agg(F.sum(F.col("nxy") / F.col("n") * F.ln(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("mutual_information"))


def activity_margin(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """D26."""
    return df.groupBy(*keys).agg(F.count("*").alias("group_size"), F.max(value).alias("top_activity"), F.min(value).alias("bottom_activity"),
                                 (F.max(value) - F.min(value)).alias("activity_margin"))


def softmin(df: DataFrame, by: list[str], energy: str, temperature: float = 1.0) -> DataFrame:
    """Stable soft minimum per group in two aggregates."""
    t = max(temperature, 1e-6)
    z = -F.col(energy) / t
    top = df.groupBy(*by).agg(F.max(z).alias("_m"))
    rows = df.join(top, by)
    return rows.groupBy(*by).agg((-temperature * (F.ln(F.sum(F.exp(z - F.col("_m")))) + F.first("_m"))).alias("softmin"))


def dataset_rollup(df: DataFrame, keys: list[str], distinct: list[str]) -> DataFrame:
    """D28."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_distinct(F.nullif(F.col(c), F.lit(""))).alias(f"{c}_count") for c in distinct])
