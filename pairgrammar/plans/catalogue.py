"""TF catalogue, assay harmonisation and inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar.functions.keys import coalesce_nonblank, download_url, pair_key, parse_run_names, run_file_name
from pairgrammar.operators.joins import priority_union
from pairgrammar.operators.ordered import dedupe, ranked

VALIDATION_GENES = ["TEAD4", "CLOCK", "GLI3", "RFX3", "PROX1", "HOX2"]  # fixed list of the validation flag


def build_tf_master(human: DataFrame, hocomoco: DataFrame, jaspar: DataFrame, tfclass: DataFrame | None = None,
                    cisbp: DataFrame | None = None, assay_pairs: DataFrame | None = None) -> DataFrame:
    """L1: one row per human TF with family, motif and flags, and a sequential id.

    ``human``: gene_symbol, ensembl_id, is_tf, dbd_family, binding_mode.
    """
    def upper(df: DataFrame) -> DataFrame:
        return df.withColumn("gene_symbol", F.upper("gene_symbol"))

    def side(df: DataFrame | None, tag: str, order: list[str], cols: list[str]) -> DataFrame | None:
        if df is None:
            return None
        ties = [c for c in cols if c not in order]  # rows alike in the order differ in what is kept
        best = dedupe(upper(df), ["gene_symbol"], [*order, *ties])
        return best.select("gene_symbol", *[F.col(c).alias(f"{tag}_{c}") for c in cols])

    base = dedupe(upper(human).filter(F.upper(F.col("is_tf").cast("string")) == "YES"), ["gene_symbol"], ["ensembl_id", "dbd_family", "binding_mode"])
    sides = [
        side(hocomoco, "h", ["quality", "-model_length", "motif_id"], ["motif_id", "motif_source", "tf_family", "tf_subfamily", "uniprot_id"]),
        side(jaspar, "j", ["-model_length", "motif_id"], ["motif_id", "motif_source"]),
        side(tfclass, "t", ["family", "subfamily"], ["family", "subfamily", "paralog_group"]),
        side(cisbp, "c", ["motif_id"], ["motif_id", "source_type", "family"]),
    ]
    joined = reduce(lambda a, b: a.join(b, "gene_symbol", "left"), [s for s in sides if s is not None], base)
    have = set(joined.columns)

    def first(*names: str) -> Column:
        return coalesce_nonblank(*[n for n in names if n in have])

    out = joined.select(
        "gene_symbol", "ensembl_id", F.coalesce("h_uniprot_id", F.lit("")).alias("uniprot_id"),
        first("t_family", "h_tf_family", "c_family", "dbd_family").alias("family"),
        first("t_subfamily", "h_tf_subfamily", "binding_mode", "t_family", "h_tf_family", "c_family", "dbd_family").alias("subfamily"),
        first("t_paralog_group", "h_tf_subfamily", "dbd_family", "gene_symbol").alias("paralog_group"),
        first("h_motif_source", "j_motif_source", "c_source_type").alias("motif_source"), first("h_motif_id", "j_motif_id", "c_motif_id").alias("motif_id"),
        F.lit("RNA,accessibility").alias("availability_proxy_sources"), F.lit(False).alias("is_in_state_layer"), F.col("gene_symbol").isin(VALIDATION_GENES).alias("is_in_orthogonal_validation"))
    if assay_pairs is not None:
        seen = assay_pairs.select(F.explode(F.array(F.upper("left_tf"), F.upper("right_tf"))).alias("gene_symbol")).distinct().withColumn("is_in_assay", F.lit(True))
        out = out.join(seen, "gene_symbol", "left").withColumn("is_in_assay", F.coalesce("is_in_assay", F.lit(False)))
    return ranked(out, [], ["gene_symbol"], "_n").withColumn("tf_id", F.format_string("TF_%05d", "_n")).drop("_n")


def _present(df: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_ok``: the named file exists."""
    known = files.select(F.col("file_name").alias(column)).distinct().withColumn(f"{column}_ok", F.lit(True))
    return df.join(known, column, "left").withColumn(f"{column}_ok", F.coalesce(f"{column}_ok", F.lit(False)))


def curated_inventory(curated: DataFrame, files: DataFrame) -> DataFrame:
    """L2: usability and support of every curated row. ``curated`` comes from ``parse_curated_pairs``."""
    def baseline(side: str) -> Column:
        p = F.coalesce(f"tf{side}_seq_prefix", F.lit(""))
        return F.when(p != "", F.concat(p, F.lit("0u_sig.seq"))).otherwise("")

    rows = curated.withColumns({"left_baseline_file": baseline("1"), "right_baseline_file": baseline("2")})
    for c in ("left_seq_file", "right_seq_file", "left_baseline_file", "right_baseline_file"):
        rows = _present(rows, files, c)
    pair_files = F.array_compact(F.array(*[F.when(F.col(f"{s}_seq_file_ok"), F.col(f"{s}_seq_file")) for s in ("left", "right")]))
    candidates = F.array_compact(F.array(*[F.when(F.col(f"{c}_ok"), F.col(c)) for c in ("left_baseline_file", "right_baseline_file", "left_seq_file", "right_seq_file")]))
    rows = rows.withColumns({"pair_files": pair_files}).withColumn("baseline_candidates", F.array_except(candidates, "pair_files"))
    lb, rb = F.col("left_baseline_file_ok"), F.col("right_baseline_file_ok")
    monomer = ~F.col("is_pair") & (F.size("pair_files") > 0) & (lb | rb)
    usable = F.col("is_pair") & (F.size("pair_files") > 0) & (F.size("baseline_candidates") > 0)
    support = (
        F.when(usable & lb & rb, "paired_plus_both_baselines").when(usable & lb, "paired_plus_left_baseline").when(usable & rb, "paired_plus_right_baseline")
        .when(usable, "paired_plus_treated_proxy").when(monomer, "monomer_treated_plus_baseline").otherwise(""))
    return rows.select(
        F.col("hgnc_pair").alias("pair_name"), "left_tf", "right_tf", "is_pair", F.when(F.col("left_tf") != F.col("right_tf"), "heterodimer").otherwise("homodimer").alias("pair_type"),
        F.array_join("pair_files", ";").alias("pair_file"), F.size("pair_files").alias("num_pair_files"), monomer.alias("monomer_usable"), usable.alias("pair_usable"), support.alias("support_type"),
        "pair_files", F.get("baseline_candidates", F.lit(0)).alias("negative_file"),
        F.when(F.col("left_seq_file_ok"), F.col("left_seq_file")).otherwise(F.col("right_seq_file")).alias("monomer_positive"),
        F.when(lb, F.col("left_baseline_file")).otherwise(F.col("right_baseline_file")).alias("monomer_negative"))


def tf_files(curated: DataFrame, files: DataFrame) -> DataFrame:
    """L2: first existing baseline and treated file per TF (by name)."""
    def baseline(side: str) -> Column:
        return F.concat(F.coalesce(f"tf{side}_seq_prefix", F.lit("")), F.lit("0u_sig.seq"))
    entries = curated.select(F.explode(F.array(*[
        F.struct(F.col(f"{s}_tf").alias("tf"), f.alias("file"), F.lit(kind).alias("kind"))
        for s, i in (("left", "1"), ("right", "2")) for f, kind in ((baseline(i), "baseline"), (F.col(f"{s}_seq_file"), "treated"))])).alias("e")).select("e.*")
    found = entries.join(files.select(F.col("file_name").alias("file")).distinct(), "file")
    return found.groupBy("tf").agg(*[F.min(F.when(F.col("kind") == k, F.col("file"))).alias(f"{k}_file") for k in ("baseline", "treated")])


def secondary_inventory(pairs: DataFrame, files: DataFrame, registry: DataFrame, tag: str, proxy: bool) -> DataFrame:
    """L2: rows of a second source (pair_name, left_tf, right_tf, pair_file); ``proxy`` also accepts treated files as negatives."""
    rows = _present(pairs, files, "pair_file")
    for s in ("left", "right"):
        rows = rows.join(registry.select(F.col("tf").alias(f"{s}_tf"), F.col("baseline_file").alias(f"{s}_baseline"), F.col("treated_file").alias(f"{s}_treated")), f"{s}_tf", "left")
    names = ["left_baseline", "right_baseline"] + (["left_treated", "right_treated"] if proxy else [])
    negatives = F.filter(F.array_compact(F.array(*[F.col(c) for c in names])), lambda f: f != F.col("pair_file")) if proxy else F.array_compact(F.array(*[F.col(c) for c in names]))
    lb, rb = F.col("left_baseline").isNotNull(), F.col("right_baseline").isNotNull()
    usable = F.col("pair_file_ok") & (F.size("_neg") > 0)
    if proxy:
        support = F.when(lb & rb, f"{tag}_pair_plus_both_baselines").when(lb | rb, f"{tag}_pair_plus_one_baseline").when(F.size("_neg") > 0, f"{tag}_pair_plus_treated_proxy").otherwise("")
    else:
        support = F.when(usable & lb & rb, f"{tag}_pair_plus_both_baselines").when(usable & lb, f"{tag}_pair_plus_left_baseline").when(usable, f"{tag}_pair_plus_right_baseline").otherwise("")
    return rows.withColumn("_neg", negatives).select(
        "pair_name", "left_tf", "right_tf", F.lit(True).alias("is_pair"), F.when(F.col("left_tf") != F.col("right_tf"), "heterodimer").otherwise("homodimer").alias("pair_type"),
        F.when(F.col("pair_file_ok"), F.col("pair_file")).otherwise("").alias("pair_file"), F.col("pair_file_ok").cast("int").alias("num_pair_files"), F.lit(False).alias("monomer_usable"),
        usable.alias("pair_usable"), support.alias("support_type"), F.array("pair_file").alias("pair_files"), F.get("_neg", F.lit(0)).alias("negative_file"))


def harmonize_assay(curated: DataFrame, files: DataFrame, lines: DataFrame, secondary: DataFrame | None = None, tertiary: DataFrame | None = None) -> dict[str, DataFrame]:
    """L2: inventory, labelled sequences, reference edges and acceptance counts.

    ``files``: file_name. ``lines``: sequence_file, seq_index, sequence (A7). File existence and
    file content are joins, so nothing depends on the number of files.
    """
    first = curated_inventory(curated, files)
    registry = tf_files(curated, files)
    others = []
    for src, tag, proxy in ((secondary, "secondary", False), (tertiary, "ena", True)):
        if src is not None:
            others.append(secondary_inventory(src, files, registry, tag, proxy))
    inventory = priority_union(first, *others)
    mono = inventory.filter("monomer_usable").select(
        "pair_name", "left_tf", "right_tf", F.lit("phase1").alias("phase"), F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), F.lit("treated").alias("role"), F.col("monomer_positive").alias("sequence_file")),
            F.struct(F.lit(0.0).alias("label"), F.lit("baseline").alias("role"), F.col("monomer_negative").alias("sequence_file")))).alias("f"))
    pos = inventory.filter("pair_usable").select(
        "pair_name", "left_tf", "right_tf", F.lit("phase2").alias("phase"),
        F.explode(F.concat(
            F.transform("pair_files", lambda p: F.struct(F.lit(1.0).alias("label"), F.concat(F.lit("paired::"), F.regexp_replace(p, r"\.[^.]*$", "")).alias("role"), p.alias("sequence_file"))),
            F.array(F.struct(F.lit(0.0).alias("label"), F.lit("baseline").alias("role"), F.col("negative_file").alias("sequence_file"))))).alias("f"))
    wanted = mono.unionByName(pos).select("pair_name", "left_tf", "right_tf", "phase", "f.*")
    head = F.when(F.col("phase") == "phase1", F.concat_ws("::", "phase", "left_tf")).otherwise(F.concat_ws("::", "phase", "left_tf", "right_tf"))
    sequences = wanted.join(lines, "sequence_file").select(
        F.concat_ws("::", head, "role", F.col("seq_index").cast("string")).alias("seq_id"), "sequence", "label", "phase",
        F.when(F.col("phase") == "phase1", F.concat_ws("::", "left_tf", "left_tf")).otherwise(F.concat_ws("::", "left_tf", "right_tf")).alias("tf_pair_label"),
        F.lit("in_vitro").alias("state_label"), F.when(F.col("phase") == "phase1", "monomer").otherwise("pair").alias("element_type"), "pair_name", "role", "sequence_file")
    edges = inventory.filter("pair_usable").select("left_tf", "right_tf").distinct()
    counts = inventory.agg(F.count("*").alias("inventory_rows"), F.count_if("pair_usable").alias("usable_pair_rows"), F.count_if("monomer_usable").alias("usable_monomer_rows"))
    acceptance = counts.withColumn("reference_edges", edges.agg(F.count("*")).scalar())
    return {"inventory": inventory, "sequences": sequences, "reference_graph": edges, "acceptance": acceptance}


def run_inventory(reports: DataFrame) -> DataFrame:
    """L3: run report to pair, round and file per run; rows without any file name drop out."""
    named = reports.withColumn("file_name", run_file_name("submitted_ftp", "fastq_ftp", "experiment_title")).filter("file_name <> ''")
    good, _ = parse_run_names(named)
    return good.withColumns({"submitted_url": download_url("submitted_ftp"), "fastq_url": download_url("fastq_ftp"),
                             "submitted_bytes": F.coalesce("submitted_bytes", F.lit(0)), "fastq_bytes": F.coalesce("fastq_bytes", F.lit(0))})


def pair_targets(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """L3: every edge with its run count and its best run."""
    counts = runs.groupBy("pair_key").agg(F.count("*").alias("ena_run_count"))
    best = dedupe(runs, ["pair_key"], ["-submitted_bytes", "-fastq_bytes", "run_accession"])
    best = best.select("pair_key", "pair_name", "run_accession", "sig_file_name", "submitted_url", "round_label", "plate", "seq_prefix")
    out = edges.withColumn("pair_key", pair_key("left_tf", "right_tf")).join(counts, "pair_key", "left").join(best, "pair_key", "left")
    return out.withColumn("ena_run_count", F.coalesce("ena_run_count", F.lit(0)).cast("long"))


def build_inventories(reports: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """L3: both inventories in one call."""
    runs = run_inventory(reports)
    return {"runs": runs, "targets": pair_targets(runs, edges)}


def readiness(acceptance: DataFrame, states: DataFrame | None = None, minimum_edges: int = 1, minimum_pairs: int = 1) -> DataFrame:
    """One row per gate with its verdict."""
    gate = acceptance.select(F.lit("assay").alias("gate"), ((F.col("reference_edges") >= minimum_edges) & (F.col("usable_pair_rows") >= minimum_pairs)).alias("ready"))
    if states is None:
        return gate
    state_gate = states.agg(F.count("*").alias("n"), F.count_distinct("state_label").alias("k")).select(F.lit("state_layer").alias("gate"), ((F.col("n") > 0) & (F.col("k") > 0)).alias("ready"))
    return gate.unionByName(state_gate)


def assert_ready(gates: DataFrame) -> None:
    """Error naming the gates that fail."""
    bad = [r["gate"] for r in gates.filter(~F.col("ready")).collect()]
    if bad:
        raise RuntimeError(f"not ready: {', '.join(sorted(bad))}")


def source_registry(manifest: DataFrame) -> DataFrame:
    """Sources by phase, type and required flag."""
    return manifest.groupBy("phase", "source_type").agg(F.count("*").alias("n"), F.count_if(F.lower(F.col("required").cast("string")).isin("true", "yes", "1")).alias("required_n"))
