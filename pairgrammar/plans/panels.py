"""Assay panels: MPRA, competition pairs and reporters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrammar.functions.keys import is_control, map_symbols, pair_key
from pairgrammar.functions.sequence import clean_sequence
from pairgrammar.operators import selection as W
from pairgrammar.operators import splits as P
from pairgrammar.operators import summaries as D
from pairgrammar.operators.joins import checked_join, grid, union_all
from pairgrammar.operators.ordered import ranked
from pairgrammar.session import cut_lineage


def mpra_panel(bed: DataFrame, tsv: DataFrame, biosample: str, low_q: float = 0.1, high_q: float = 0.9, min_replicates: int = 3, min_obs_bc: int = 10,
               max_std: float = 0.75, max_gap: float = 1.0) -> DataFrame:
    """Element panel with quality flag, quantile labels and activity rank (over all elements)."""
    merged = checked_join(D.aggregate_regions(bed), D.aggregate_replicates(tsv), ["element_group"], "one_to_one")
    quality = (
        ~is_control("element_group") & (F.col("replicate_count") >= min_replicates) & (F.col("min_obs_bc") >= min_obs_bc)
        & (F.coalesce("std_log2_activity", F.lit(0.0)) <= max_std) & (F.coalesce("orientation_gap_log2", F.lit(0.0)) <= max_gap))
    merged = merged.withColumn("passes_quality", quality)
    merged = cut_lineage(merged, 1)
    cut = D.quantiles(merged.filter("passes_quality"), "mean_log2_activity", {"lo": low_q, "hi": high_q}).select(F.struct("lo", "hi")).scalar()
    value = F.col("mean_log2_activity")
    labelled = merged.withColumn("_q", cut).withColumn("label", F.when(F.col("passes_quality") & (value <= F.col("_q.lo")), 0.0).when(F.col("passes_quality") & (value >= F.col("_q.hi")), 1.0))
    out = labelled.withColumns({"quantile_low": F.col("_q.lo"), "quantile_high": F.col("_q.hi"), "biosample_label": F.lit(biosample), "state_label": F.lit(biosample),
                                "seq_id": F.concat_ws("::", F.lit("external_mpra"), F.lit(biosample.lower()), "element_group"), "split_group": F.col("element_group")}).drop("_q")
    return ranked(out, [], ["-mean_log2_activity", "element_group"], "rank_desc")


def panel_splits(panel: DataFrame, biosamples: list[str]) -> DataFrame:
    """Default and held-out-biosample manifests of the labelled rows."""
    rows = panel.filter("label is not null")
    cols = ["seq_id", "split_name", "split", "group_value"]
    parts = [P.group_split(rows, "split_group", "default").select(*cols)] + [P.holdout_split(rows, "biosample_label", b).select(*cols) for b in biosamples]
    return union_all(*parts)


def panel_priority(panel: DataFrame) -> DataFrame:
    """Labelled rows ranked by activity inside their biosample."""
    return ranked(panel.filter("label is not null"), ["biosample_label"], ["-mean_log2_activity", "element_group"], "priority_rank_within_biosample")


def competition_frame(raw: DataFrame, tf_master: DataFrame) -> DataFrame:
    """Cleaned rows with mapped TFs and competition groups."""
    aliases = {"TRP53": "TP53"}
    mapped = map_symbols(map_symbols(raw, tf_master, "tf1_name", "left_tf", aliases), tf_master, "tf2_name", "right_tf", aliases)
    rows = mapped.filter("activity_score is not null").withColumn("sequence", clean_sequence("seq")).withColumn("tf_pair_label", F.concat_ws("::", "left_tf", "right_tf"))
    return rows.withColumn("pair_transfer_group", pair_key("left_tf", "right_tf")).withColumn("competition_group", F.concat_ws("::", "library_name", "actual_state", "pair_transfer_group"))


def competition_ranks(frame: DataFrame) -> DataFrame:
    """Group size and both activity ranks."""
    sized = W.group_size(frame, ["competition_group"])
    down = ranked(sized, ["competition_group"], ["-activity_score", "crs"], "activity_rank_desc")
    return ranked(down, ["competition_group"], ["activity_score", "crs"], "activity_rank_asc")


def competition_panel(frame: DataFrame) -> DataFrame:
    """Phase-4 rows (one best, one worst per group) and phase-5 rows (two each in larger groups)."""
    lib = F.replace("library_name", F.lit("."), F.lit("_"))
    parts = []
    for phase, adaptive in (("phase4", False), ("phase5", True)):
        rows = W.extrema(frame, ["competition_group"], "activity_score", "crs", adaptive)
        parts.append(rows.withColumns({
            "seq_id": F.concat_ws("::", F.lit(f"hematopoiesis::{phase}"), lib, "actual_state", F.col("crs").cast("string")), "label": F.col("derived_label"), "phase": F.lit(phase),
            "state_label": F.col("competition_group") if phase == "phase4" else F.concat_ws("::", F.lit("hematopoiesis"), "actual_state"), "split_group": F.col("competition_group"),
            "construction_mode": F.lit("observed_pair" if phase == "phase4" else "observed_pair_functional")}))
    return parts[0].unionByName(parts[1])


def competition_manifests(panel: DataFrame) -> DataFrame:
    """Unseen-pair and unseen-state manifests."""
    cols = ["seq_id", "split_name", "split", "group_value"]
    return P.group_split(panel, "pair_transfer_group", "unseen_pair").select(*cols).unionByName(P.group_split(panel, "actual_state", "unseen_state").select(*cols))


def group_summary(frame: DataFrame) -> DataFrame:
    """Size and activity margin per library, state and pair."""
    return D.activity_margin(frame, ["library_name", "actual_state", "pair_transfer_group"], "activity_score")


def extreme_state_labels(states: DataFrame) -> DataFrame:
    """G8 in L17: the states with the largest and the smallest summed vectors."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    sums = states.select("state_label", total("availability").alias("_a"), total("state").alias("_s"))
    high = sums.orderBy(F.col("_a").desc(), F.col("_s").desc(), "state_label").limit(1).select("state_label", F.lit("high").alias("state_mode"))
    low = sums.orderBy("_a", "_s", "state_label").limit(1).select("state_label", F.lit("low").alias("state_mode"))
    return high.unionByName(low)


def reporter_panel(constructs: DataFrame, states: DataFrame, valid_keys: list[str]) -> DataFrame:
    """Every construct in the high and the low state, labelled and manually split.

    ``constructs``: sequence_name, sequence, tf_pair_label, positive_in_high_state, composite_label.
    """
    both = grid(constructs, state_mode=["high", "low"]).join(F.broadcast(extreme_state_labels(states)), "state_mode")
    label = F.when(F.col("state_mode") == "high", F.col("positive_in_high_state").cast("double")).otherwise(0.0)
    name = F.lower(F.replace(F.replace("sequence_name", F.lit(" "), F.lit("_")), F.lit("#"), F.lit("")))
    rows = both.withColumns({"label": label, "seq_id": F.concat_ws("::", F.lit("reporter"), name, "state_mode"), "phase": F.lit("phase5")})
    split = F.when(F.concat_ws("::", "sequence_name", "state_mode").isin(valid_keys), "valid").otherwise("train")
    return checked_join(rows.withColumn("split", split), states.select("state_label", "availability", "state"), ["state_label"], "many_to_one", "left")


def candidate_pair_audit(panel: DataFrame) -> DataFrame:
    """Rows and positives per pair."""
    return panel.groupBy("tf_pair_label").agg(F.count("*").alias("rows"), F.count_if(F.col("label") > 0.5).alias("positives"))
