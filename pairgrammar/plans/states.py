"""Usage labels, regulatory-state layer, state data and candidate scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrammar import schema
from pairgrammar.functions.keys import calibration_set, derive_labels, exclude_imputed, keep_observed
from pairgrammar.functions.sequence import centered_window, embed, gc_content
from pairgrammar.operators import examples as E
from pairgrammar.operators import intervals as N
from pairgrammar.operators import motifs as M
from pairgrammar.operators import selection as W
from pairgrammar.operators import summaries as D
from pairgrammar.operators.joins import union_all
from pairgrammar.operators.ordered import dedupe, ranked, top_per_group
from pairgrammar.session import cut_lineage, materialize

LABEL_VERSION = "reference_pair_support_v1"
LABEL_SOURCE = "reference_pair_support"


def assign_usage_labels(df: DataFrame) -> DataFrame:
    """L4: phase-4 evidence, ranks and one winner per state; unqualified states drop out, imputed pairs score 0."""
    p4 = df.filter("phase = 'phase4'")
    rest = df.filter("phase IS DISTINCT FROM 'phase4'")
    if {"state_total_fragment_count", "state_supporting_files"} <= set(df.columns):
        p4 = D.support_score(p4)
    evidence = F.coalesce(F.col("pair_reference_supported").cast("double"), F.lit(0.0))
    tagged = p4.withColumns({"phase4_label_source": F.lit(LABEL_SOURCE), "phase4_label_version": F.lit(LABEL_VERSION)}).drop("label", "usage_label")
    observed = tagged.filter("construction_mode = 'observed_pair'").withColumns({"evidence_score": evidence, "evidence_supported": evidence})
    won = W.label_winners(observed).withColumn("label", F.col("usage_label"))
    imputed = tagged.filter("construction_mode = 'imputed_pair'").withColumns({
        "evidence_score": F.lit(0.0), "evidence_supported": F.lit(0.0), "usage_label": F.lit(0.0), "label": F.lit(0.0)})
    kept = imputed.join(won.select("state_label").distinct(), "state_label", "left_semi")
    return union_all(won, kept, rest)


def hydrate_states(states: DataFrame, chunks: DataFrame, chunk_size: int, window: int = schema.WINDOW, lengths: DataFrame | None = None) -> DataFrame:
    """States with the bases of their window and ``hydration_status``; ``lengths`` tells where chromosomes end."""
    start, end = centered_window("region_start", "region_end", window)
    placed = states.withColumns({"window_start": start, "window_end": end})
    return N.hydrate_windows(placed, chunks, window, chunk_size, key="state_label", lengths=lengths).withColumn("gc_content", gc_content("sequence"))


def rank_states(regions: DataFrame, fragments: DataFrame, max_regions: int | None, keep: int) -> DataFrame:
    """Sampled regions with their fragment support, best supported first."""
    sampled = W.sample_regions(regions, max_regions)
    per = N.count_overlaps(sampled, fragments, ["state_label"], extra=["file_id"])
    support = N.support_counts(per, ["state_label"])
    return W.top_rows(sampled.join(support, "state_label"), ["-total_fragment_count", "-supporting_files", "chromosome", "region_start"], keep)


def select_states(hydrated: DataFrame, hits: DataFrame, edges: DataFrame, max_states: int) -> DataFrame:
    """States with the most candidates, numbered from 0."""
    counts = M.hit_counts(hits, edges).withColumnRenamed("seq_id", "state_label")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("observed_monomer_candidate_count", "observed_pair_candidate_count")}
    best = W.top_rows(hydrated.join(counts, "state_label", "left").withColumns(zero), [
        "-observed_pair_candidate_count", "-observed_monomer_candidate_count", "-total_fragment_count", "-supporting_files", "chromosome", "region_start"], max_states)
    return ranked(best, [], ["-observed_pair_candidate_count", "-observed_monomer_candidate_count", "-total_fragment_count", "-supporting_files", "chromosome", "region_start"], "_n").withColumn(
        "state_index", F.col("_n") - 1).drop("_n")


def candidate_rows(states: DataFrame, hits: DataFrame, edges: DataFrame, consensus: DataFrame, max_pairs: int = 1, max_monomers: int = 1, impute: bool = True, window: int = schema.WINDOW) -> DataFrame:
    """Observed monomers (widest first), selected pairs, and imputed rows for states that have none.

    ``states``: state_label, sequence, state_index, chromosome and support columns. ``hits``: best
    hits with seq_id = state_label. ``edges``: left_tf, right_tf. ``consensus``: motif_id, consensus.
    """
    threshold = states.agg(F.percentile("total_fragment_count", F.lit(0.5)).alias("m")).scalar()
    base = states.select(
        "state_label", "sequence", "state_index", "chromosome", F.col("total_fragment_count").cast("double").alias("state_total_fragment_count"),
        F.col("supporting_files").cast("double").alias("state_supporting_files"), F.when(F.col("total_fragment_count") >= threshold, 1.0).otherwise(0.0).alias("label"))
    index = F.format_string("%05d", F.col("state_index"))

    def geometry(df: DataFrame) -> DataFrame:
        ls, le, rs, re = (F.col(c) for c in ("left_anchor_start", "left_anchor_end", "right_anchor_start", "right_anchor_end"))
        return df.withColumns({
            "center_distance": (rs + re) / 2.0 - (ls + le) / 2.0, "edge_gap": (rs - le).cast("double"),
            "overlap_len": F.greatest(F.lit(0), F.least(le, re) - F.greatest(ls, rs)).cast("double")})

    def finish(df: DataFrame, phase: str, mode: str) -> DataFrame:
        out = geometry(df).withColumns({"phase": F.lit(phase), "construction_mode": F.lit(mode), "tf_pair_label": F.concat_ws("::", "left_tf", "right_tf"), "split_group": F.col("chromosome")})
        cols = ["seq_id", "sequence", "state_label", "tf_pair_label", "left_tf", "right_tf", "left_anchor_start", "left_anchor_end", "right_anchor_start", "right_anchor_end", "orientation",
                "center_distance", "edge_gap", "overlap_len", "coarse_additive_score", "label", "phase", "construction_mode", "pair_reference_supported",
                "state_total_fragment_count", "state_supporting_files", "split_group", "chromosome"]
        return out.select(*[F.col(c).cast("long").alias(c) if c.endswith(("_start", "_end")) else F.col(c) for c in cols])

    none = F.lit(None).cast("double")
    best = hits.filter("hit_rank = 0").withColumn("_w", F.col("end") - F.col("start"))
    mono = top_per_group(best, ["seq_id"], ["-_w", "tf_id"], max_monomers).withColumnRenamed("seq_id", "state_label").join(base, "state_label")
    observed_mono = finish(mono.select(
        "*", F.concat_ws("::", F.lit("public::phase3"), "tf_id", index).alias("seq_id"), F.col("tf_id").alias("left_tf"), F.col("tf_id").alias("right_tf"),
        *[F.col(e).alias(f"{s}_anchor_{e}") for s in ("left", "right") for e in ("start", "end")], F.concat("strand", "strand").alias("orientation"),
        (F.col("_w") + F.col("label")).alias("coarse_additive_score"), none.alias("pair_reference_supported")), "phase3", "observed_monomer")

    picked = M.select_pairs(hits, edges, max(max_pairs, 2)).filter("pair_mode <> 'homotypic_fallback'").withColumnRenamed("seq_id", "state_label").join(base, "state_label")
    observed_pair = finish(picked.select(
        "*", F.concat_ws("::", F.lit("public::phase4"), "left_tf", "right_tf", index, F.format_string("%02d", F.col("pair_rank"))).alias("seq_id"),
        *[F.col(f"{s}_{e}").alias(f"{s}_anchor_{e}") for s in ("left", "right") for e in ("start", "end")],
        (F.col("width_sum") + F.col("label")).alias("coarse_additive_score"), F.col("reference_supported").cast("double").alias("pair_reference_supported")), "phase4", "observed_pair")
    out = observed_mono.unionByName(observed_pair)
    if not impute:
        return out

    n_edges = edges.agg(F.count("*").alias("n")).scalar()
    numbered = ranked(edges.select("left_tf", "right_tf").distinct(), [], ["left_tf", "right_tf"], "_e").withColumn("_e", F.col("_e") - 1)
    motifs = {s: consensus.select(F.col("motif_id").alias(f"{s}_tf"), F.col("consensus").alias(f"_{s}")) for s in ("left", "right")}
    pool = base.withColumn("_e", F.pmod(F.col("state_index"), n_edges)).join(numbered, "_e").join(motifs["left"], "left_tf").join(motifs["right"], "right_tf")
    ll, rl = F.length("_left"), F.length("_right")

    lone = pool.join(observed_mono.select("state_label").distinct(), "state_label", "left_anti")
    at = F.least(F.lit(24), F.greatest(F.lit(0), F.lit(window - 1) - ll))
    imputed_mono = finish(lone.select(
        "state_label", "state_index", "chromosome", "state_total_fragment_count", "state_supporting_files", "label", embed("sequence", "_left", at).alias("sequence"),
        F.concat_ws("::", F.lit("public::phase3"), "left_tf", F.lit("imputed"), index).alias("seq_id"), "left_tf", F.col("left_tf").alias("right_tf"),
        at.alias("left_anchor_start"), (at + ll).alias("left_anchor_end"), at.alias("right_anchor_start"), (at + ll).alias("right_anchor_end"), F.lit("++").alias("orientation"),
        (ll + F.col("label")).alias("coarse_additive_score"), none.alias("pair_reference_supported")), "phase3", "imputed_monomer")

    bare = pool.join(observed_pair.select("state_label").distinct(), "state_label", "left_anti")
    right_at = F.least(F.lit(16) + ll + 8, F.lit(window - 8) - rl)
    imputed_pair = finish(bare.select(
        "state_label", "state_index", "chromosome", "state_total_fragment_count", "state_supporting_files", "label",
        embed(embed("sequence", "_left", F.lit(16)), "_right", right_at).alias("sequence"),
        F.concat_ws("::", F.lit("public::phase4"), "left_tf", "right_tf", F.lit("imputed"), index).alias("seq_id"), "left_tf", "right_tf",
        F.lit(16).alias("left_anchor_start"), (ll + 16).alias("left_anchor_end"), right_at.alias("right_anchor_start"), (right_at + rl).alias("right_anchor_end"), F.lit("++").alias("orientation"),
        (ll + rl + F.col("label")).alias("coarse_additive_score"), none.alias("pair_reference_supported")), "phase4", "imputed_pair")
    return out.unionByName(imputed_mono).unionByName(imputed_pair)


def build_state_layer(regions: DataFrame, fragments: DataFrame, chunks: DataFrame, positions: DataFrame, edges: DataFrame, chunk_size: int,
                      max_regions: int | None = 4096, max_states: int = 256, multiplier: int = 4, max_pairs: int = 1, max_monomers: int = 1, impute: bool = True,
                      lengths: DataFrame | None = None) -> dict[str, DataFrame]:
    """Candidates, state features and audit from regions, fragments, genome chunks and motifs.

    ``lengths`` (chromosome, chromosome_length) keeps regions whose window passes a chromosome's end. States whose
    bases are not all there take no further part and come back as ``incomplete``.
    """
    ranked_states = rank_states(regions, fragments, max_regions, max(max_states * max(multiplier, 1), max_states))
    placed = cut_lineage(hydrate_states(ranked_states, chunks, chunk_size, lengths=lengths))
    genes = edges.select(F.explode(F.array("left_tf", "right_tf")).alias("motif_id")).distinct()
    used = materialize(positions.join(genes, "motif_id", "left_semi"))
    hydrated = placed.filter("hydration_status = 'complete'").drop("hydration_status")
    hits = materialize(M.scan_motifs(hydrated.select(F.col("state_label").alias("seq_id"), "sequence"), M.pwm_library(used), top_k=max(2, max_pairs)))
    selected = cut_lineage(select_states(hydrated, hits, edges, max_states))
    known = edges.join(used.select(F.col("motif_id").alias("left_tf")).distinct(), "left_tf", "left_semi").join(used.select(F.col("motif_id").alias("right_tf")).distinct(), "right_tf", "left_semi")
    rows = candidate_rows(selected, hits.join(selected.select(F.col("state_label").alias("seq_id")), "seq_id", "left_semi"), known.select("left_tf", "right_tf"), M.consensus(used), max_pairs, max_monomers, impute)
    labelled = cut_lineage(assign_usage_labels(cut_lineage(rows)))
    return {"candidates": labelled, "states": selected, "state_features": E.state_features(selected), "audit": D.audit_layer(labelled, selected),
            "incomplete": placed.filter("hydration_status <> 'complete'").select("state_label", "chromosome", "region_start", "region_end", "hydration_status")}


def best_file_prefix(per_file: DataFrame, scores: list[str]) -> DataFrame:
    """G9 in L5: the number of fragment files that gives the best layer."""
    return W.best_prefix(per_file, "file_id", scores)


def retain_qualified(df: DataFrame) -> DataFrame:
    """D16 in L6: phase-4 rows stay only in states that qualify on observed rows."""
    observed = df.filter("phase = 'phase4' AND construction_mode = 'observed_pair'")
    good = D.qualify_states(observed, evidence="evidence_supported").filter("qualified").select("state_label")
    p4 = df.filter("phase = 'phase4'").join(good, "state_label", "left_semi")
    return p4.unionByName(df.filter("phase IS DISTINCT FROM 'phase4'").select(*p4.columns))


def assay_subset(sequences: DataFrame, inventory: DataFrame, per_tf: int, per_pair: int) -> DataFrame:
    """F4 in L6: hash-ranked rows per TF or pair and label, for usable inventory rows only."""
    mono = inventory.filter("monomer_usable").select(F.concat_ws("::", "left_tf", "left_tf").alias("tf_pair_label")).distinct()
    pair = inventory.filter("pair_usable").select(F.concat_ws("::", "left_tf", "right_tf").alias("tf_pair_label")).distinct()
    one = W.ranked_head(sequences.filter("phase = 'phase1'").join(mono, "tf_pair_label", "left_semi"), ["tf_pair_label", "label"], per_tf)
    two = W.ranked_head(sequences.filter("phase = 'phase2'").join(pair, "tf_pair_label", "left_semi"), ["tf_pair_label", "label"], per_pair)
    return one.unionByName(two).withColumns({"construction_mode": F.lit("cap_selex_formal_subset"), "composite_label": F.lit(0.0)})


def prepare_state_data(sequences: DataFrame, states: DataFrame, assay: DataFrame | None = None, formal_only: bool = True, drop_imputed: bool = True) -> dict[str, DataFrame]:
    """Candidates joined to their state, labelled, filtered and united with the assay subset."""
    merged = derive_labels(sequences.join(dedupe(states, ["state_label"], ["state_label"]), "state_label"))
    merged = keep_observed(merged) if formal_only else merged
    merged = exclude_imputed(merged) if drop_imputed else merged
    merged = retain_qualified(merged) if "evidence_supported" in merged.columns else merged
    combined = union_all(assay, merged) if assay is not None else merged
    counts = combined.groupBy("phase").agg(F.count("*").alias("rows"))
    return {"candidates": merged, "formal": combined, "calibration": calibration_set(combined), "phase_counts": counts}


def is_fresh(spark, output: str, *inputs: str) -> bool:
    """Whether a stored table is newer than all of its inputs."""
    def stamp(path: str) -> int | None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None
    made = stamp(output)
    return made is not None and all((stamp(i) or 0) <= made for i in inputs)


def expanded_candidates(current: DataFrame, positions: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """``k`` observed pairs for every known state, labelled."""
    base = dedupe(current, ["state_label"], ["phase", "seq_id"]).select("state_label", "sequence", "state_total_fragment_count", "state_supporting_files", "chromosome")
    hits = materialize(M.scan_motifs(base.select(F.col("state_label").alias("seq_id"), "sequence"), edge_library(positions, edges), top_k=max(2, k)))
    indexed = ranked(base, [], ["state_label"], "_n")
    picked = M.select_pairs(hits, edges, max(k, 2)).filter("pair_mode <> 'homotypic_fallback'").withColumnRenamed("seq_id", "state_label").join(indexed, "state_label")
    rows = picked.select(
        F.concat_ws("::", F.lit("expanded::phase4"), "left_tf", "right_tf", F.format_string("%05d", F.col("_n") - 1), F.format_string("%02d", F.col("pair_rank"))).alias("seq_id"),
        "sequence", "state_label", F.concat_ws("::", "left_tf", "right_tf").alias("tf_pair_label"), "left_tf", "right_tf",
        *[F.col(f"{s}_{e}").cast("long").alias(f"{s}_anchor_{e}") for s in ("left", "right") for e in ("start", "end")],
        "orientation", "center_distance", "edge_gap", "overlap_len", F.col("width_sum").cast("double").alias("coarse_additive_score"), F.lit("phase4").alias("phase"),
        F.lit("observed_pair").alias("construction_mode"), "state_total_fragment_count", "state_supporting_files", F.col("reference_supported").cast("double").alias("pair_reference_supported"),
        F.col("chromosome").alias("split_group"), "chromosome")
    return assign_usage_labels(cut_lineage(rows))


def panel_candidates(candidates: DataFrame, state_features: DataFrame) -> DataFrame:
    """Observed phase-4 rows of a fresh layer with the features of their represented states."""
    rows = candidates.filter("phase = 'phase4' AND construction_mode = 'observed_pair'")
    return rows.join(dedupe(state_features, ["state_label"], ["state_label"]), "state_label")


def edge_library(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """Motif library of the genes of the reference edges."""
    genes = edges.select(F.explode(F.array("left_tf", "right_tf")).alias("motif_id")).distinct()
    return M.pwm_library(positions.join(genes, "motif_id", "left_semi"))


def functional_candidates(panel: DataFrame, positions: DataFrame | None, edges: DataFrame, top_k: int = 2, library: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One candidate pair per hydrated panel row, and the status of every row.

    ``library``: folder of a stored ``edge_library``, for callers that come batch by batch.
    """
    hits = materialize(M.scan_motifs(panel.select("seq_id", "sequence"), library or edge_library(positions, edges), top_k=top_k))
    chosen = cut_lineage(M.select_pairs(hits, edges, 1).drop("pair_rank"))
    gene_count = hits.groupBy("seq_id").agg(F.count_distinct("tf_id").alias("pair_hit_gene_count"))
    extra = [c for c in panel.columns if c not in chosen.columns or c == "seq_id"]
    rows = chosen.join(panel.select(*extra), "seq_id").join(gene_count, "seq_id").withColumn("tf_pair_label", F.concat_ws("::", "left_tf", "right_tf"))
    status = panel.select("seq_id").join(chosen.select("seq_id", "pair_mode", "reference_supported"), "seq_id", "left").select(
        "seq_id", F.col("pair_mode").isNotNull().alias("has_candidate"), F.coalesce("pair_mode", F.lit("")).alias("pair_mode"),
        F.coalesce(F.col("reference_supported").cast("double"), F.lit(0.0)).alias("pair_reference_supported"))
    return rows, status


