"""Motif matrices, scans and hit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgrammar.functions.keys import pair_key
from pairgrammar.operators.ordered import ranked, top_per_group
from pairgrammar.session import materialize, scratch_path
from pairgrammar.sources.blocks import listed_files, open_file, qualified

PSEUDOCOUNT = 1e-3
BACKGROUND = 0.25
MAX_CELLS = 4_000_000  # matrix cells a scanning task holds at a time
TASK_HITS = 1 << 15  # hits of which a task pairs the nearest
HEAD = 4  # matrix columns looked up at once


def consensus(positions: DataFrame, key: str = "motif_id") -> DataFrame:
    """Most frequent base per position (ties A<C<G<T), joined in order. A motif has tens of positions."""
    best = F.greatest("A", "C", "G", "T")
    base = F.when(F.col("A") == best, "A").when(F.col("C") == best, "C").when(F.col("G") == best, "G").otherwise("T")
    per = positions.select(key, "position", base.alias("b")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "b"))).alias("_p"))
    return per.select(key, F.array_join(F.transform("_p", lambda p: p["b"]), "").alias("consensus"))


def build_pwm(positions: DataFrame, key: str = "motif_id") -> DataFrame:
    """Log-odds rows per motif position."""
    total = sum((F.col(b) for b in "CGT"), F.col("A")) + 4 * PSEUDOCOUNT
    return positions.select(key, "position", *[F.log2((F.col(b) + PSEUDOCOUNT) / total / BACKGROUND).alias(b) for b in "ACGT"])


def motif_stats(pwm: DataFrame, key: str = "motif_id") -> DataFrame:
    """Length, consensus score and cutoff per motif."""
    best = F.sum(F.greatest("A", "C", "G", "T"))
    return pwm.groupBy(key).agg(F.count("*").alias("motif_len"), best.alias("consensus_score"), F.greatest(F.lit(1.5), 0.55 * best).alias("cutoff"))


def pwm_library(positions: DataFrame, key: str = "motif_id", cutoff: float | None = None) -> DataFrame:
    """One row per motif: id, cutoff and the flattened matrix (positions x ACGT)."""
    pwm = build_pwm(positions, key)
    best = F.sum(F.greatest("A", "C", "G", "T"))  # as in motif_stats, in the same reading
    packed = pwm.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "A", "C", "G", "T"))).alias("_p"), F.greatest(F.lit(1.5), 0.55 * best).alias("cutoff"))
    flat = packed.select(F.col(key).alias("tf_id"), F.flatten(F.transform("_p", lambda p: F.array(p["A"], p["C"], p["G"], p["T"]))).alias("matrix"), "cutoff")
    return flat if cutoff is None else flat.withColumn("cutoff", F.lit(float(cutoff)))


_CODE = np.full(256, 4, dtype=np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def _heads(codes: np.ndarray, size: int) -> np.ndarray:
    """Number of the ``size`` letters (an N is a fifth one) from each place on."""
    out = np.zeros(max(0, len(codes) - size + 1), dtype=np.int64)
    for j in range(size):
        out = out * 5 + codes[j:j + len(out)]
    return out


def _hits(codes: np.ndarray, heads: np.ndarray, fits: np.ndarray, table: np.ndarray, size: int, cutoff: float, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores at or above the cutoff.

    The first ``size`` columns are one look-up; a place goes on only while its score and the best of all
    further columns can still reach the cutoff. Columns are added in their order, so scores are those of a full sum.
    """
    m = len(table)
    first = np.zeros(1)
    for j in range(size):
        first = (first[:, None] + table[j]).ravel()
    rest = np.append(np.cumsum(table.max(axis=1)[::-1])[::-1], 0.0)  # best of the columns from each on
    least = cutoff - 10.0 ** -digits - 1e-9
    score = first[heads[:len(fits)]]
    at = np.flatnonzero(fits & (score + rest[size] >= least))
    score = score[at]
    for j in range(size, m):
        score = score + table[j][codes[at + j]]
        if j % 2 and j + 1 < m:
            go = score + rest[j + 1] >= least
            at, score = at[go], score[go]
    score = np.round(score, digits)
    kept = score >= cutoff
    return at[kept], score[kept]


def _scan_batch(pdf: pd.DataFrame, motifs: list, top_k: int, digits: int, has_allowed: bool) -> pd.DataFrame:
    """Score all sequences of a batch, laid end to end, against each matrix; what a width and the places share is made once."""
    raw = [s.encode("ascii", "replace") for s in pdf["sequence"]]
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    codes = _CODE[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(raw)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(raw) else np.zeros(0, dtype=np.int64)
    local = np.arange(len(codes)) - first[owner]
    allowed = [set(a) for a in pdf["allowed"]] if has_allowed else None
    heads = {k: _heads(codes, k) for k in range(1, HEAD + 1)}
    inside: dict[int, np.ndarray] = {}
    out = []
    for tf_id, matrix, cutoff in motifs:
        m = matrix.shape[0]
        places = len(codes) - m + 1
        if places <= 0 or not m:
            continue
        if m not in inside:
            inside[m] = local[:places] + m <= lengths[owner[:places]]
        fits = inside[m]
        if allowed is not None:
            member = np.fromiter((tf_id in a for a in allowed), dtype=bool, count=len(allowed))
            fits = fits & member[owner[:places]]
        padded = np.hstack([matrix, np.zeros((m, 1))])  # an N scores 0
        flipped = np.hstack([matrix[::-1, ::-1], np.zeros((m, 1))])
        parts = []
        for strand, table in ((0, padded), (1, flipped)):
            at, score = _hits(codes, heads[min(m, HEAD)], fits, table, min(m, HEAD), cutoff, digits)
            parts.append((at, np.full(len(at), strand), score))
        at, strand, score = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((2 * local[at] + strand, -score, owner[at]))
        at, strand, score = at[order], strand[order], score[order]
        seq = owner[at]
        rank = np.arange(len(seq)) - np.searchsorted(seq, seq, side="left")
        keep = rank < top_k
        out.append(pd.DataFrame({
            "seq": seq[keep], "tf_id": tf_id, "start": local[at[keep]].astype("int32"), "end": (local[at[keep]] + m).astype("int32"),
            "strand": np.where(strand[keep] == 0, "+", "-"), "score": score[keep], "hit_rank": rank[keep].astype("int32")}))
    if not out:
        return pd.DataFrame(columns=["seq_id", "tf_id", "start", "end", "strand", "score", "hit_rank"])
    hits = pd.concat(out, ignore_index=True)
    hits.insert(0, "seq_id", pdf["seq_id"].to_numpy()[hits.pop("seq").to_numpy()])
    return hits


HITS = T.StructType([
    T.StructField("seq_id", T.StringType()), T.StructField("tf_id", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("strand", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("hit_rank", T.IntegerType()),
])


def store_library(library: DataFrame) -> str:
    """Folder of a motif library that scanning tasks read; a caller that scans more than once stores it once."""
    path = scratch_path(library.sparkSession, "library")
    library.select("tf_id", "matrix", F.col("cutoff").cast("double").alias("cutoff")).write.parquet(path)
    return path


def _stored_motifs(path: str) -> Iterator[list]:
    """Motifs of a stored library in lists of at most ``MAX_CELLS`` cells (a larger motif is one list)."""
    held, cells = [], 0
    for file, _, size in listed_files(path):
        if not file.endswith(".parquet") or not size:
            continue
        with open_file(path, file) as source:
            for batch in pq.ParquetFile(source).iter_batches(1024, columns=["tf_id", "matrix", "cutoff"]):
                for tf_id, matrix, cutoff in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and cells + len(matrix) > MAX_CELLS:
                        yield held
                        held, cells = [], 0
                    held.append((tf_id, np.array(matrix, dtype=float).reshape(-1, 4), cutoff))
                    cells += len(matrix)
    if held:
        yield held


def scan_motifs(seqs: DataFrame, library: DataFrame | str, top_k: int = 24, allowed: str | None = None, digits: int = 6) -> DataFrame:
    """Hits of every (allowed) motif on both strands, best ``top_k`` per sequence and motif.

    Map-only over the sequences. The library is a table (or the folder of a stored one) that the tasks
    read: one of at most ``MAX_CELLS`` cells once a task, a larger one piece by piece for each batch.
    """
    rows = seqs.select("seq_id", "sequence", *([F.col(allowed).alias("allowed")] if allowed else [])).filter("sequence is not null")
    path = qualified(rows.sparkSession, library if isinstance(library, str) else store_library(library))

    def run(batches):
        pieces = _stored_motifs(path)
        begun = [p for _, p in zip(range(2), pieces)]
        pieces.close()
        whole = begun if len(begun) < 2 else None
        for pdf in batches:
            for motifs in whole if whole is not None else _stored_motifs(path):
                yield _scan_batch(pdf, motifs, top_k, digits, allowed is not None)

    return rows.mapInPandas(run, HITS)


def hit_counts(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Monomer and pair candidate counts per sequence.

    Pairs without support count once each, so their number is n(n-1)/2; only supported pairs
    (found through the edge list) are formed.
    """
    per_gene = materialize(hits.groupBy("seq_id", "tf_id").agg(F.count("*").alias("k")))
    base = per_gene.groupBy("seq_id").agg(F.count("*").alias("g"))
    links = edges.select(F.least("left_tf", "right_tf").alias("a"), F.greatest("left_tf", "right_tf").alias("b")).filter("a <> b").distinct()
    left = per_gene.select("seq_id", F.col("tf_id").alias("a"), F.col("k").alias("ka")).join(links, "a")
    supported = left.join(per_gene.select("seq_id", F.col("tf_id").alias("b"), F.col("k").alias("kb")), ["seq_id", "b"])
    extra = supported.groupBy("seq_id").agg(F.sum(F.col("ka") * F.col("kb") - 1).alias("extra"))
    return base.join(extra, "seq_id", "left").select(
        "seq_id", F.col("g").alias("observed_monomer_candidate_count"),
        ((F.col("g") * (F.col("g") - 1) / 2).cast("long") + F.coalesce("extra", F.lit(0))).alias("observed_pair_candidate_count"))


PAIR_ORDER = ["-reference_supported", "-width_sum", "gap_penalty", "overlap_len", "rank_sum", "left_tf", "right_tf", "left_rank"]


def _pair_columns(prefer_gap: float):
    l, r = F.col("l"), F.col("r")
    gap = r["start"] - l["end"]
    return [
        "seq_id", l["tf_id"].alias("left_tf"), r["tf_id"].alias("right_tf"),
        l["start"].alias("left_start"), l["end"].alias("left_end"), r["start"].alias("right_start"), r["end"].alias("right_end"),
        F.concat(l["strand"], r["strand"]).alias("orientation"), l["score"].alias("left_score"), r["score"].alias("right_score"),
        l["hit_rank"].alias("left_rank"), r["hit_rank"].alias("right_rank"),
        ((r["start"] + r["end"]) / 2.0 - (l["start"] + l["end"]) / 2.0).alias("center_distance"), gap.cast("double").alias("edge_gap"),
        F.greatest(F.lit(0), F.least(l["end"], r["end"]) - F.greatest(l["start"], r["start"])).cast("double").alias("overlap_len"),
        (l["end"] - l["start"] + r["end"] - r["start"]).alias("width_sum"), F.abs(gap - prefer_gap).cast("double").alias("gap_penalty"),
        (l["hit_rank"] + r["hit_rank"]).alias("rank_sum"),
    ]


def _wanted_classes(units: DataFrame, need: int) -> DataFrame:
    """(seq_id, left_width, right_width) of the widest sums that hold ``need`` pairs; all, if there are fewer.

    ``units``: seq_id, width, unit; pairs join different units. A sequence has as many classes as its motifs have
    lengths, and their pairs are counted, never formed.
    """
    sizes = units.distinct().groupBy("seq_id", "width").agg(F.count("*").alias("k"))
    other = sizes.select("seq_id", F.col("width").alias("wide"), F.col("k").alias("j"))
    both = sizes.join(other, "seq_id").filter("wide >= width")
    # a unit may have hits of several widths: it makes no pair with itself
    sure = F.when(F.col("wide") == F.col("width"), F.col("k") * (F.col("k") - 1) / 2).otherwise(F.col("k") * F.col("j") - F.least("k", "j"))
    counted = both.select("seq_id", "width", "wide", (-(F.col("width") + F.col("wide"))).alias("total"), sure.alias("sure"))
    above = Window.partitionBy("seq_id").orderBy("total").rangeBetween(Window.unboundedPreceding, -1)
    kept = counted.withColumn("found", F.coalesce(F.sum("sure").over(above), F.lit(0))).filter(F.col("found") < need)
    pairs = F.explode(F.array_distinct(F.array(F.struct(F.col("width").alias("l"), F.col("wide").alias("r")), F.struct(F.col("wide").alias("l"), F.col("width").alias("r"))))).alias("p")
    return kept.select("seq_id", pairs).select("seq_id", F.col("p.l").alias("left_width"), F.col("p.r").alias("right_width"))


def _nearest_pairs(hits: DataFrame, classes: DataFrame, reach: int, top_bit: Column, gap: float, tasks: int) -> DataFrame:
    """(seq_id, l, r): of every hit, the ``reach`` best partners on either side of where its gap would be kept, in each width class.

    ``hits``: seq_id, order, h; a pair's left hit has the smaller ``order``. Two orders differ first in one
    bit, where the left one has 0: the pair meets in that bit's block and nowhere else. In a block
    partners lie in line by start, and each asking hit takes what lies next to its place: a two-sided as-of join.
    Blocks are dealt to so many ``tasks``: their rows hold lists, of which many pack into few bytes.
    """
    width = F.col("h.end") - F.col("h.start")
    levels = F.explode(F.sequence(F.lit(0), top_bit)).alias("bit")
    side = lambda rows, value: rows.select("*", levels).filter((F.expr("shiftright(order, bit)") % 2) == value).withColumn("block", F.expr("shiftright(order, bit + 1)"))
    asking = hits.withColumn("left_width", width).join(classes, ["seq_id", "left_width"])
    asking = side(asking, 0).select("seq_id", F.col("right_width").alias("width"), "bit", "block", (F.col("h.end") + gap).alias("at"), F.lit(0).alias("kind"), F.col("h").alias("l"))
    answers = hits.withColumn("right_width", width).join(classes.select("seq_id", "right_width").distinct(), ["seq_id", "right_width"])
    answers = side(answers, 1).select("seq_id", F.col("right_width").alias("width"), "bit", "block", F.col("h.start").cast("double").alias("at"), F.lit(1).alias("kind"), F.col("h").alias("r"))
    keys = ["seq_id", "width", "bit", "block"]
    rank, tf = F.col("r.hit_rank"), F.col("r.tf_id")
    block = Window.partitionBy(*keys)
    down, up = block.orderBy(F.desc("at"), rank, tf), block.orderBy("at", rank, tf)  # partners before a place, and from it on, best first
    line = lambda order: F.filter(F.array(*[F.lead("r", i).over(order) if i else F.col("r") for i in range(reach)]), lambda x: x.isNotNull())
    answers = answers.repartition(tasks, *keys).withColumn("before", line(down)).withColumn("behind", line(up))
    every = asking.unionByName(answers, allowMissingColumns=True).repartition(tasks, *keys)
    until = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    rising, falling = block.orderBy("at", "kind", F.desc(rank), F.desc(tf)), block.orderBy(F.desc("at"), F.desc("kind"), F.desc(rank), F.desc(tf))
    met = every.select(
        "seq_id", "kind", "l", F.last("before", ignorenulls=True).over(until(rising)).alias("before"), F.last("behind", ignorenulls=True).over(until(falling)).alias("behind")).filter("kind = 0")
    none = F.array().cast(answers.schema["before"].dataType)
    return met.select("seq_id", "l", F.explode(F.concat(F.coalesce("before", none), F.coalesce("behind", none))).alias("r"))


def select_pairs(hits: DataFrame, edges: DataFrame, per_seq: int = 1, prefer_gap: float = 6.0) -> DataFrame:
    """Best ``per_seq`` anchor pairs per sequence; reference pairs first, then other gene pairs, then one gene with itself.

    Supported pairs come from a join over the edge list. Sequences with too few of them search the
    rest in their widest classes for the partners nearest to the preferred gap; no list of a sequence's hits is gathered
    and not all pairs are formed. A sequence of one gene pairs its hits, the better one on the left.
    """
    hits = materialize(hits)
    packed = hits.select("seq_id", "tf_id", F.struct("tf_id", "start", "end", "strand", "score", "hit_rank").alias("h"))
    links = edges.select(F.least("left_tf", "right_tf").alias("a"), F.greatest("left_tf", "right_tf").alias("b")).filter("a <> b").distinct()
    left = packed.select("seq_id", F.col("tf_id").alias("a"), F.col("h").alias("l")).join(links, "a")
    right = packed.select("seq_id", F.col("tf_id").alias("b"), F.col("h").alias("r"))
    supported = left.join(right, ["seq_id", "b"]).select(*_pair_columns(prefer_gap)).withColumn("reference_supported", F.lit(1)).withColumn("pair_mode", F.lit("heterotypic_reference"))
    supported = materialize(top_per_group(supported, ["seq_id"], PAIR_ORDER, per_seq))
    full = supported.groupBy("seq_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= per_seq)

    short = packed.join(full.select("seq_id"), "seq_id", "left_anti")
    genes = ranked(hits.select("tf_id").distinct(), [], ["tf_id"], "_gene")
    own = Window.partitionBy("seq_id")
    order = F.when(F.min("tf_id").over(own) == F.max("tf_id").over(own), F.col("h.hit_rank").cast("long")).otherwise(F.col("_gene"))
    rows = materialize(short.join(genes, "tf_id").select("seq_id", order.alias("order"), "h"))
    top_bit = hits.agg(F.floor(F.log2(F.greatest(F.count_distinct("tf_id"), F.max("hit_rank"), F.lit(1)))).cast("int")).scalar()
    # all supported pairs of such a sequence are known and fewer than per_seq: so many more are searched
    reach = 2 * per_seq - 1
    classes = materialize(_wanted_classes(rows.select("seq_id", (F.col("h.end") - F.col("h.start")).alias("width"), F.col("order").alias("unit")), reach))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_HITS))
    rest = _nearest_pairs(rows, classes, reach, top_bit, prefer_gap, tasks).select(*_pair_columns(prefer_gap))
    known = supported.select("seq_id", "left_tf", "right_tf").distinct()
    mode = F.when(F.col("left_tf") == F.col("right_tf"), "homotypic_fallback").otherwise("heterotypic_fallback")
    rest = rest.join(known, ["seq_id", "left_tf", "right_tf"], "left_anti").withColumn("reference_supported", F.lit(0)).withColumn("pair_mode", mode)
    return top_per_group(supported.unionByName(rest), ["seq_id"], PAIR_ORDER, per_seq, name="pair_rank", keep_rank=True).withColumn("pair_rank", F.col("pair_rank") - 1)


def ranked_anchors(anchors: DataFrame, limit: int) -> DataFrame:
    return top_per_group(anchors, ["seq_id"], ["-score", "tf_id", "start", "strand"], limit, name="_r", keep_rank=True)


def generate_pairs(anchors: DataFrame, k: int = 64) -> DataFrame:
    """C10 + G5: best ``k`` unordered anchor pairs per sequence by additive score.

    With anchors ranked by score, pair (i, j) has i*j - i(i+1)/2 pairs at or above it (itself
    included), so only pairs where that count is at most ``k`` can be among the best ``k``. This is
    exact, needs the best k+1 anchors only and forms O(k log k) pairs instead of all.
    """
    top = materialize(ranked_anchors(anchors, k + 1))
    partners = F.sequence(F.col("_r") + 1, F.floor((F.lit(k) + F.col("_r") * (F.col("_r") + 1) / 2) / F.col("_r")).cast("int"))
    has = F.floor((F.lit(k) + F.col("_r") * (F.col("_r") + 1) / 2) / F.col("_r")) >= F.col("_r") + 1
    cols = ["tf_id", "start", "end", "strand", "score"]
    left = top.filter(has).select("seq_id", F.col("_r").alias("i"), F.explode(partners).alias("j"), F.struct(*cols).alias("l"))
    right = top.select("seq_id", F.col("_r").alias("j"), F.struct(*cols).alias("r"))
    pairs = left.join(right, ["seq_id", "j"]).withColumn("coarse_additive_score", F.round(F.col("l.score") + F.col("r.score"), 6))
    best = top_per_group(pairs, ["seq_id"], ["-coarse_additive_score", "i", "j"], k, name="_p", keep_rank=True)
    return best.select(*anchor_pair_columns("::pair::"))


def anchor_pair_columns(token: str) -> list:
    l, r = F.col("l"), F.col("r")
    return [
        "seq_id", F.concat("seq_id", F.lit(token), (F.col("_p") - 1).cast("string")).alias("pair_id"),
        l["tf_id"].alias("left_tf"), r["tf_id"].alias("right_tf"),
        l["start"].alias("left_start"), l["end"].alias("left_end"), r["start"].alias("right_start"), r["end"].alias("right_end"),
        F.concat(l["strand"], r["strand"]).alias("orientation"),
        ((r["start"] + r["end"]) / 2.0 - (l["start"] + l["end"]) / 2.0).alias("center_distance"),
        (r["start"] - l["end"]).cast("double").alias("edge_gap"),
        F.greatest(F.lit(0), F.least(l["end"], r["end"]) - F.greatest(l["start"], r["start"])).cast("double").alias("overlap_len"),
        "coarse_additive_score",
    ]


def targeted_pairs(anchors: DataFrame, targets: DataFrame, per_side: int = 2, k: int = 64) -> DataFrame:
    """C11: best anchors of the target's left TF with the best of its right TF; one TF twice uses its best anchor.

    ``targets``: seq_id, left_tf, right_tf. At most ``per_side`` squared pairs per sequence are formed.
    """
    top = materialize(top_per_group(anchors, ["seq_id", "tf_id"], ["-score", "start", "strand"], per_side, name="_r", keep_rank=True))
    cols = ["tf_id", "start", "end", "strand", "score"]
    side = lambda name: top.select("seq_id", F.col("tf_id").alias(f"{name}_tf"), F.col("_r").alias(f"_{name}"), F.struct(*cols).alias(name[0]))
    two = targets.join(side("left"), ["seq_id", "left_tf"]).join(side("right"), ["seq_id", "right_tf"])
    two = two.filter((F.col("left_tf") != F.col("right_tf")) | ((F.col("_left") == 1) & (F.col("_right") == 1)))
    two = two.drop("left_tf", "right_tf").withColumn("coarse_additive_score", F.round(F.col("l.score") + F.col("r.score"), 6))
    best = top_per_group(two, ["seq_id"], ["-coarse_additive_score", "_left", "_right"], k, name="_p", keep_rank=True)
    return best.select(*anchor_pair_columns("::target::"))


def build_candidates(windows: DataFrame, tf_master: DataFrame, library: DataFrame, top_k_anchors: int = 24, top_k_pairs: int = 64):
    """Anchors and pairs of labelled windows; declared anchors win, then targeted pairs, then all pairs."""
    tokens = F.filter(F.split("tf_pair_label", "::"), lambda t: t != "")
    genes = tf_master.groupBy("gene_symbol").agg(F.max("tf_id").alias("tf_id"))
    named = windows.withColumn("_left", F.get(tokens, F.lit(0))).withColumn("_right", F.get(tokens, F.size(tokens) - 1)).withColumn("_size", F.size(tokens))
    for s in ("left", "right"):
        named = named.join(genes.select(F.col("gene_symbol").alias(f"_{s}"), F.col("tf_id").alias(f"_{s}_id")), f"_{s}", "left")
    named = named.withColumn("_allowed", F.array_distinct(F.array_compact(F.array("_left_id", "_right_id"))))
    named = materialize(named)
    anchors = materialize(scan_motifs(named, library, top_k_anchors, allowed="_allowed"))
    anchor_cols = ["left_anchor_start", "left_anchor_end", "right_anchor_start", "right_anchor_end"]
    declared = None
    rest = named
    if set(anchor_cols) <= set(windows.columns):
        known = F.lit(True)
        for c in anchor_cols:
            known = known & F.col(c).isNotNull()
        declared = named.filter(known).select(
            "seq_id", F.concat("seq_id", F.lit("::direct")).alias("pair_id"),
            F.coalesce("_left_id", F.lit("")).alias("left_tf"), F.coalesce("_right_id", F.lit("")).alias("right_tf"),
            *[F.col(f"{s}_anchor_{e}").cast("int").alias(f"{s}_{e}") for s in ("left", "right") for e in ("start", "end")],
            "orientation", *[F.col(c).cast("double").alias(c) for c in ("center_distance", "edge_gap", "overlap_len")],
            F.coalesce(F.col("coarse_additive_score").cast("double"), F.lit(0.0)).alias("coarse_additive_score"))
        rest = named.filter(~known)
    targets = rest.filter("_size >= 2 and _left_id is not null and _right_id is not null").select(
        "seq_id", F.col("_left_id").alias("left_tf"), F.col("_right_id").alias("right_tf"))
    direct = targeted_pairs(anchors, targets, min(top_k_anchors, 2), top_k_pairs)
    if declared is not None:
        direct = declared.unionByName(direct)
    direct = materialize(direct)
    fallback = generate_pairs(anchors.join(direct.select("seq_id").distinct(), "seq_id", "left_anti"), top_k_pairs)
    pairs = direct.unionByName(fallback).dropDuplicates(["seq_id", "left_tf", "right_tf", "left_start", "right_start", "orientation"])
    return anchors, pairs


def resolve_pair(windows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Best stored pair of a window in either order, else the window's own anchors."""
    stored = pairs.withColumn("_key", pair_key("left_tf", "right_tf"))
    best = top_per_group(stored, ["seq_id", "_key"], ["-coarse_additive_score", "pair_id"], 1)
    fields = ["left_start", "left_end", "right_start", "right_end", "orientation", "center_distance", "edge_gap", "overlap_len"]
    slim = best.select("seq_id", "_key", *[F.col(f).alias(f"_{f}") for f in fields])
    out = windows.withColumn("_key", pair_key("left_tf_id", "right_tf_id")).join(slim, ["seq_id", "_key"], "left")
    own = {"left_start": "left_anchor_start", "left_end": "left_anchor_end", "right_start": "right_anchor_start", "right_end": "right_anchor_end"}
    have = set(windows.columns)

    def pick(f: str):
        alt = own.get(f, f)
        return F.coalesce(F.col(f"_{f}"), F.col(alt)) if alt in have else F.col(f"_{f}")

    out = out.withColumns({f"pair_{f}": pick(f) for f in fields})
    return out.drop("_key", *[f"_{f}" for f in fields]).filter("pair_left_start is not null and pair_right_start is not null")
