"""Per-sequence jobs: shuffles, edits, example tables, state features and candidate rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar import schema
from pairgrammar.functions.geometry import compatibility, gap_one_hot, geometry_vector
from pairgrammar.functions.keys import _c, draw
from pairgrammar.functions.sequence import (
    embed, gc_content, interface_bounds, interface_tensor, let, offset_slice, one_hot, shape_tracks)
from pairgrammar.operators.ordered import ranked
from pairgrammar.operators.summaries import minmax
from pairgrammar.session import dealt


def _seeded(key: str, seed: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{key}".encode()).digest()[:8], "big"))


def _euler_shuffle(text: str, rng: np.random.Generator) -> str:
    """Random sequence with the same dinucleotide counts and the same two ends.

    For each base a random last exit is drawn until the exits lead to the final base; the other
    exits are permuted freely and the walk is then forced.
    """
    if len(text) < 3 or set(text) - set("ACGT"):
        return text
    exits: dict[str, list[str]] = {}
    for a, b in zip(text, text[1:]):
        exits.setdefault(a, []).append(b)
    end = text[-1]
    while True:
        last = {a: out[rng.integers(len(out))] for a, out in exits.items() if a != end}
        if all(_leads_to(a, last, end) for a in last):
            break
    order = {}
    for a, out in exits.items():
        rest = list(out)
        if a in last:
            rest.remove(last[a])
        rng.shuffle(rest)
        order[a] = iter(rest + ([last[a]] if a in last else []))
    walk = [text[0]]
    for _ in range(len(text) - 1):
        walk.append(next(order[walk[-1]]))
    return "".join(walk)


def _leads_to(start: str, last: dict[str, str], end: str) -> bool:
    for _ in range(len(last) + 1):
        if start == end:
            return True
        start = last[start]
    return False


def shuffle_dinucleotide(df: DataFrame, seed: int, out: str = "shuffled", seq: str = "sequence", key: str = "seq_id") -> DataFrame:
    """I4: dinucleotide-preserving shuffle, seeded by (seed, id), so retries agree."""
    @F.pandas_udf("string")
    def run(keys: pd.Series, seqs: pd.Series) -> pd.Series:
        return pd.Series([_euler_shuffle(s, _seeded(k, seed)) for k, s in zip(keys, seqs)])
    return df.withColumn(out, run(key, seq))


def shuffle_interface(df: DataFrame, seed: int, out: str = "sequence_interface_shuffle", flank: int = schema.FLANK, key: str = "seq_id") -> DataFrame:
    """I4: shuffle only the interface between the anchors."""
    start, end = interface_bounds("left_start", "left_end", "right_start", "right_end", flank)
    n = F.length("sequence")
    a, b = F.least(start, n).cast("int"), F.least(end, n).cast("int")
    cut = df.withColumns({"_a": a, "_b": b})
    cut = cut.withColumn("_region", F.substring("sequence", F.col("_a") + 1, F.greatest(F.col("_b") - F.col("_a"), F.lit(0))))
    mixed = shuffle_dinucleotide(cut, seed, "_mixed", "_region", key)
    text = F.concat(F.substring("sequence", F.lit(1), F.col("_a")), F.col("_mixed"), F.substring("sequence", F.col("_b") + 1, n))
    return mixed.withColumn(out, text).drop("_a", "_b", "_region", "_mixed")


def dinucleotide_counts(df: DataFrame, seq: str = "sequence", key: str = "seq_id") -> DataFrame:
    """I4: counts per sequence and dinucleotide."""
    pairs = df.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - 1, F.lit(1))), lambda i: F.substring(F.col(seq), i, F.lit(2)))).alias("pair"))
    return pairs.filter(F.length("pair") == 2).groupBy(key, "pair").agg(F.count("*").alias("n"))


def _replace_span(seq: Column, start: Column, end: Column, base) -> Column:
    """``seq`` with ``base(i)`` at the places from ``start`` up to ``end``; nothing is done at any other place."""
    a, b = F.greatest(start, F.lit(0)).cast("int"), F.least(end, F.length(seq)).cast("int")
    drawn = F.array_join(F.transform(F.sequence(a, b - 1), base), "")
    some = start.isNotNull() & end.isNotNull() & (b > a)
    return F.when(some, F.concat(F.substring(seq, F.lit(1), a), drawn, F.substring(seq, b + 1, F.length(seq)))).otherwise(seq)


def rerandomize_cores(df: DataFrame, seed: int, out: str = "sequence_core_rerandomized", key: str = "seq_id") -> DataFrame:
    """A hash-drawn base at every position only one anchor covers."""
    ls, le, rs, re = (F.col(c) for c in ("left_start", "left_end", "right_start", "right_end"))
    bound = F.struct(ls.alias("a"), F.least(le, F.greatest(ls, rs)).alias("b"), F.greatest(rs, F.least(le, re)).alias("c"), re.alias("d"), F.col(key).alias("k"), F.col("sequence").alias("s"))
    letters = F.array(*[F.lit(b) for b in "ACGT"])

    def body(v: Column) -> Column:
        base = lambda i: F.get(letters, draw(4, F.lit(seed), v["k"], i).cast("int"))
        return let(_replace_span(v["s"], v["a"], v["b"], base), lambda s: _replace_span(s, v["c"], v["d"], base))  # one letter a place, whichever span
    return df.withColumn(out, let(bound, body))


def randomize_region(df: DataFrame, start: str, end: str, seed: int, out: str = "sequence_randomized", key: str = "seq_id") -> DataFrame:
    """GC-matched random bases in a region."""
    bound = F.struct(_c(start).alias("a"), _c(end).alias("b"), F.col(key).alias("k"), F.col("sequence").alias("s"), gc_content("sequence").alias("gc"))

    def body(v: Column) -> Column:
        def base(i: Column) -> Column:
            return let(draw(1_000_000, F.lit(seed), v["k"], i) / 1e6, lambda u: F.when(u < (1 - v["gc"]) / 2, "A").when(u < 0.5, "C").when(u < 0.5 + v["gc"] / 2, "G").otherwise("T"))
        return _replace_span(v["s"], v["a"], v["b"], base)
    return df.withColumn(out, let(bound, body))


def single_edits(df: DataFrame) -> DataFrame:
    """Every single-base change between the anchors."""
    lo, hi = F.least("left_end", "right_start"), F.greatest("left_end", "right_start")
    spots = df.filter(hi > lo).withColumn("position", F.explode(F.sequence(lo, hi - 1)))
    ref = spots.withColumn("ref_base", F.substring("sequence", (F.col("position") + 1).cast("int"), F.lit(1)))
    alts = ref.withColumn("alt_base", F.explode(F.array(*[F.lit(b) for b in "ACGT"]))).filter("alt_base <> ref_base")
    return alts.withColumn("edited_sequence", F.overlay("sequence", "alt_base", (F.col("position") + 1).cast("int")))


def rank_edits(scored: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """High-low margin of each edit and its drop from the unedited margin.

    ``scored``: keys, position, alt_base, state_mode (high or low), full_score. ``baseline``: keys, state_mode, full_score.
    """
    def margin(df: DataFrame, by: list[str], name: str) -> DataFrame:
        pick = lambda mode: F.max(F.when(F.col("state_mode") == mode, F.col("full_score")))
        return df.groupBy(*by).agg((pick("high") - pick("low")).alias(name))
    edits = margin(dealt(scored, *keys), [*keys, "position", "alt_base"], "high_low_margin")
    # an unedited row per key is held, edits pass by: these are never the side that is gathered or sorted
    return edits.join(margin(dealt(baseline, *keys), keys, "_base").hint("shuffle_hash"), keys).withColumn("margin_drop", F.col("_base") - F.col("high_low_margin")).drop("_base")


def gap_grid(df: DataFrame, gaps: list[int], seed: int) -> DataFrame:
    """Move the right motif to each gap on a randomised background; impossible gaps are skipped."""
    n = F.length("sequence")
    base = df.withColumns({
        "left_motif": F.substring("sequence", (F.col("left_start") + 1).cast("int"), (F.col("left_end") - F.col("left_start")).cast("int")),
        "right_motif": F.substring("sequence", (F.col("right_start") + 1).cast("int"), (F.col("right_end") - F.col("right_start")).cast("int")),
        "gap": F.explode(F.array(*[F.lit(g) for g in gaps])),
    })
    at = F.col("left_end") + F.col("gap")
    ok = base.withColumn("new_right_start", at).filter((at >= F.col("left_end") + 1) & (at + F.length("right_motif") <= n - 1))
    ok = ok.withColumn("_k", F.concat_ws("|", "seq_id", F.col("gap").cast("string")))
    one = randomize_region(ok, "left_start", "left_end", seed, "_one", "_k").drop("sequence").withColumnRenamed("_one", "sequence")
    two = randomize_region(one, "right_start", "right_end", seed + 1, "_two", "_k")
    return two.withColumn("edited_sequence", embed(embed("_two", "left_motif", "left_start"), "right_motif", "new_right_start")).drop("sequence", "_two", "_k")


def anchor_tensor(start: str, end: str) -> Column:
    """Five shifted 24-base windows around an anchor as one-hot plus shape tracks."""
    centre = F.floor((_c(start) + _c(end)) / 2)
    return F.array(*[
        F.concat(one_hot(offset_slice("sequence", centre + o, schema.ANCHOR_WINDOW)), shape_tracks(offset_slice("sequence", centre + o, schema.ANCHOR_WINDOW)))
        for o in schema.OFFSETS])


def index_maps(tf_master: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted distinct values per column with a 0-based id, in long form."""
    values = tf_master.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])).alias("e")).select("e.*").distinct()
    return ranked(values, ["field"], ["value"], "_r").select("field", "value", (F.col("_r") - 1).alias("index"))


def build_examples(pairs: DataFrame, seed: int = 11) -> DataFrame:
    """I8: model-ready arrays per window: tensors, controls, targets and metadata.

    ``pairs``: seq_id, sequence, label, anchor positions, orientation and geometry columns.
    """
    spans = ("left_start", "left_end", "right_start", "right_end")
    rows = rerandomize_cores(shuffle_interface(pairs, seed), seed)
    vector = geometry_vector("center_distance", "edge_gap", "overlap_len", "orientation")
    return rows.select(
        *pairs.columns,
        one_hot("sequence").alias("window_one_hot"),
        anchor_tensor("left_start", "left_end").alias("left_anchor_offsets"),
        anchor_tensor("right_start", "right_end").alias("right_anchor_offsets"),
        F.array(*vector).alias("geometry_features"),
        interface_tensor("sequence", *spans).alias("interface_tensor"),
        interface_tensor("sequence_interface_shuffle", *spans).alias("interface_tensor_shuffle"),
        interface_tensor("sequence_core_rerandomized", *spans).alias("interface_tensor_core_rerandomized"),
        gap_one_hot("edge_gap").alias("spacing_target"),
        F.transform(F.array(*[F.lit(o) for o in schema.ORIENTATIONS]), lambda o: F.when(o == F.col("orientation"), 1.0).otherwise(0.0)).alias("orientation_target"),
        compatibility("overlap_len").alias("compatibility"),
    )


def baseline_features(examples: DataFrame) -> DataFrame:
    """First, mean and sample spread of the geometry vector and the interface mass."""
    g = F.col("geometry_features")
    n = F.size(g)
    mean = F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / n
    spread = let(F.struct(g.alias("g"), mean.alias("m")), lambda v: F.sqrt(F.aggregate(v["g"], F.lit(0.0), lambda a, x: a + (x - v["m"]) * (x - v["m"])) / (F.size(v["g"]) - 1)))
    keep = [c for c in examples.columns if c in ("seq_id", "label", "phase", "split", "left_tf", "right_tf")]
    out = examples.select(*keep, g[0].alias("geom_0"), mean.alias("geom_mean"), spread.alias("geom_std"), *(["interface_tensor"] if "interface_tensor" in examples.columns else []))
    if "interface_tensor" in examples.columns:
        mass = F.aggregate(F.flatten("interface_tensor"), F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("interface_mass", mass).drop("interface_tensor")
    return out


STATE_ELEMENTS = ["pELS", "dELS", "CA", "CA-CTCF", "CA-TF", "TF"]  # fixed order of the element one-hot


def state_features(states: DataFrame) -> DataFrame:
    """Scaled counts, width, GC, sex chromosome and element one-hot per state."""
    scaled = minmax(states.select(
        "state_label", "chromosome", "element_type", "gc_content",
        *[F.col(c).cast("double").alias(c) for c in ("total_fragment_count", "supporting_files", "width")]), ["total_fragment_count", "supporting_files", "width"])
    flags = [F.when(F.col("element_type") == e, 1.0).otherwise(0.0).alias(f"state_{i}") for i, e in enumerate(STATE_ELEMENTS, start=3)]
    return scaled.select(
        "state_label", F.col("total_fragment_count").alias("availability_0"), F.col("supporting_files").alias("availability_1"),
        F.col("width").alias("state_0"), F.col("gc_content").alias("state_1"), F.when(F.col("chromosome").isin("chrX", "chrY"), 1.0).otherwise(0.0).alias("state_2"), *flags)


def one_hot_states(labels: DataFrame, label: str = "state_label", width: int = 16) -> DataFrame:
    """Index and one-hot availability per distinct state."""
    idx = ranked(labels.select(label).distinct(), [], [label], "_r").withColumn("state_index", F.col("_r") - 1).drop("_r")
    return idx.withColumn("availability", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == F.col("state_index"), 1.0).otherwise(0.0)))
