"""Interval joins through fixed bins.

Both sides are exploded over the bins they touch and joined on (chromosome, bin). A pair that
shares several bins is kept only in the first shared one. Bins that hold very many rows are
split: the point side gets a salt from its hash and the region side is copied per salt. Plain counts
need no join: see ``count_marked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar.operators.ordered import RANGE_ROWS, running
from pairgrammar.session import cut_lineage, materialize, stored

BIN = 100_000


def _bins(df: DataFrame, start: str, end: str, size: int, prefix: str) -> DataFrame:
    first = F.floor(F.col(start) / size).cast("long")
    last = F.floor(F.greatest(F.col(end) - 1, F.col(start)) / size).cast("long")
    return df.withColumn(f"_{prefix}_bin", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_pairs(regions: DataFrame, fragments: DataFrame, bin_size: int = BIN, salts: int = 1,
                  region_cols=("region_start", "region_end"), fragment_cols=("start", "end"), on: list[str] | None = None) -> DataFrame:
    """Every overlapping (region, fragment) pair once; half-open test."""
    on = on or ["chromosome"]
    rs, re = region_cols
    fs, fe = fragment_cols
    left = _bins(regions, rs, re, bin_size, "r").withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    right = _bins(fragments.filter(F.col(fe) > F.col(fs)), fs, fe, bin_size, "f")
    right = right.withColumn("_salt", (F.pmod(F.xxhash64(fs, fe), F.lit(salts))).cast("int") if salts > 1 else F.lit(0))
    joined = left.join(right, [*on, "_bin", "_salt"])
    hit = (F.col(rs) < F.col(fe)) & (F.col(re) > F.col(fs)) & (F.col("_bin") == F.greatest("_r_bin", "_f_bin"))
    return joined.filter(hit).drop("_bin", "_salt", "_r_bin", "_f_bin")


def overlap_marks(fragments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many fragments start and end at a place: ``chromosome``, ``by``, ``at``, ``order``, ``started``, ``ended``.

    Marks of several sets of fragments add up to those of all, in any order. Ends come before a region's bounds at the
    same place, starts behind them. Empty fragments and those without a chromosome have none.
    """
    by = by or []
    places = F.explode(F.array(
        F.struct(F.col("start").cast("long").alias("at"), F.lit(2).alias("order"), F.lit(1).alias("started"), F.lit(0).alias("ended")),
        F.struct(F.col("end").cast("long").alias("at"), F.lit(0).alias("order"), F.lit(0).alias("started"), F.lit(1).alias("ended")))).alias("p")
    return merge_marks(fragments.filter((F.col("end") > F.col("start")) & F.col("chromosome").isNotNull()).select("chromosome", *by, places).select("chromosome", *by, "p.*"), by)


def merge_marks(marks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Marks of several sets of fragments as one, with partial sums in the tasks."""
    return marks.groupBy("chromosome", *(by or []), "at", "order").agg(F.sum("started").alias("started"), F.sum("ended").alias("ended"))


def count_marked(regions: DataFrame, marks: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """``keys``, ``by``, ``fragment_count`` of every region, and every value of ``by`` on its chromosome, from fragments' marks.

    The fragments that begin before a region's end, less those that end by its start: two running
    totals along the chromosome, whatever is crowded and however many hits there are. Groups with no mark are left out.
    With ``by`` the marks are counted per chromosome and value: if none has more of them, and of bounds, than a range, the totals
    are plain windows.
    """
    by = by or []
    marks = stored(marks, "marks") if by else cut_lineage(marks)
    slim = regions.filter("chromosome is not null").select(*dict.fromkeys([*keys, "chromosome", "region_start", "region_end"]))
    bounds = F.explode(F.array(
        F.struct(F.col("region_end").cast("long").alias("at"), F.lit(1).alias("_side")), F.struct(F.col("region_start").cast("long").alias("at"), F.lit(-1).alias("_side")))).alias("p")
    asked, ranges = slim, None
    if by:
        groups = materialize(marks.groupBy("chromosome", *by).agg(F.count("*").alias("_marks")))
        asked = slim.join(groups.drop("_marks"), "chromosome")
        most = groups.agg(F.max("_marks")).first()[0] or 0
        if most <= RANGE_ROWS:
            most += 2 * (slim.groupBy("chromosome").count().agg(F.max("count")).first()[0] or 0)
        ranges = 1 if most <= RANGE_ROWS else None
    zero = F.lit(0).cast("long")
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    asked = asked.select(F.col("chromosome").alias("_c"), *by, *[F.col(k).alias(n) for k, n in named.items()], bounds).select(
        "_c", *by, "p.at", F.lit(1).alias("order"), zero.alias("started"), zero.alias("ended"), *named.values(), "p._side")
    both = marks.withColumnRenamed("chromosome", "_c").unionByName(asked, allowMissingColumns=True)
    run = running(both, ["_c", *by], ["at", "order"], {"_begun": ("sum", F.col("started")), "_over": ("sum", F.col("ended"))}, ranges=ranges)
    return run.filter("_side is not null").groupBy(*[F.col(n).alias(k) for k, n in named.items()], *by).agg(
        F.sum(F.when(F.col("_side") > 0, F.col("_begun")).otherwise(-F.col("_over"))).cast("long").alias("fragment_count"))


def count_overlaps(regions: DataFrame, fragments: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Fragments per region; regions without a hit count 0. A region's end is not before its start.

    Per ``extra`` column the counts of each of its values, where there are any; pairs without a hit are left out.
    No hit is formed: see ``count_marked``.
    """
    hits = count_marked(regions, overlap_marks(fragments, extra), keys, extra)
    if extra:
        return hits.filter("fragment_count > 0")
    return regions.join(hits, keys, "left").withColumn("fragment_count", F.coalesce("fragment_count", F.lit(0)).cast("long"))


def overlap_flags(rows: DataFrame, peaks: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Coverage and overlap flags of both TFs of a row against gene-specific merged peaks.

    ``rows``: seq_id, chromosome, region_start, region_end, left_tf, right_tf.
    ``peaks``: gene, chromosome, start, end (merged per gene and chromosome).
    """
    peaks, rows = cut_lineage(peaks), cut_lineage(rows)
    sides = rows.select(
        "chromosome", "region_start", "region_end",
        F.explode(F.array("left_tf", "right_tf")).alias("gene")).distinct()
    genes = peaks.select("gene").distinct().withColumn("_covered", F.lit(True))
    hits = overlap_pairs(sides, peaks, bin_size, on=["chromosome", "gene"]).select("chromosome", "region_start", "region_end", "gene").distinct().withColumn("_hit", F.lit(True))
    out = rows
    for side in ("left", "right"):
        cov = genes.select(F.col("gene").alias(f"{side}_tf"), F.col("_covered").alias(f"{side}_tf_covered"))
        hit = hits.select("chromosome", "region_start", "region_end", F.col("gene").alias(f"{side}_tf"), F.col("_hit").alias(f"{side}_tf_overlap"))
        out = out.join(cov, f"{side}_tf", "left").join(hit, ["chromosome", "region_start", "region_end", f"{side}_tf"], "left")
    flags = [f"{s}_tf_{k}" for s in ("left", "right") for k in ("covered", "overlap")]
    out = out.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})
    return out.withColumns({
        "num_covered_tfs": F.col("left_tf_covered").cast("int") + F.col("right_tf_covered").cast("int"),
        "any_tf_overlap": F.col("left_tf_overlap") | F.col("right_tf_overlap"),
        "both_tfs_overlap": F.col("left_tf_overlap") & F.col("right_tf_overlap"),
    })


def hydrate_windows(regions: DataFrame, chunks: DataFrame, length: int, chunk_size: int, key: str = "seq_id", lengths: DataFrame | None = None) -> DataFrame:
    """Bases of each ``window_start``-based window from a chunked genome table.

    Every chunk is placed by its own start. A window is ``complete`` when its chunks hold all bases it
    has inside the chromosome, and there is one; else it is ``incomplete`` and has no sequence. Bases before the
    chromosome's start are N, and so are those past its end if ``lengths`` (chromosome,
    chromosome_length) tells where that is. A window touches few chunks, so the gathered list is short.
    """
    placed = regions.select(key, "chromosome", F.col("window_start").cast("long").alias("_w"))
    placed = placed.withColumn("_end", F.col("_w") + length)
    if lengths is not None:
        known = lengths.select("chromosome", F.col("chromosome_length").cast("long").alias("_len"))
        placed = placed.join(known, "chromosome", "left").withColumn("_end", F.coalesce(F.least("_end", "_len"), "_end")).drop("_len")
    placed = placed.withColumn("_from", F.greatest("_w", F.lit(0).cast("long")))
    inside = F.greatest(F.col("_end") - F.col("_from"), F.lit(0).cast("long"))
    need = placed.filter("_end > _from").withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("_from") / chunk_size).cast("long"), F.floor((F.col("_end") - 1) / chunk_size).cast("long"))))
    parts = need.join(chunks.select("chromosome", "chunk_id", F.col("start").cast("long").alias("start"), "bases"), ["chromosome", "chunk_id"])
    low, high = F.greatest("_from", "start"), F.least("_end", F.col("start") + F.length("bases"))
    cut = parts.filter(high > low).select(key, low.alias("at"), F.substring("bases", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("bases"))
    joined = cut.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("at", "bases"))).alias("_p"))
    held = F.aggregate("_p", F.lit(0).cast("long"), lambda n, p: n + F.length(p["bases"]))
    left = F.repeat(F.lit("N"), F.least(F.col("_from") - F.col("_w"), F.lit(length)).cast("int"))
    text = F.rpad(F.concat(left, F.upper(F.array_join(F.transform("_p", lambda p: p["bases"]), ""))), length, "N")
    out = placed.join(joined, key, "left").withColumn("_p", F.coalesce("_p", F.array().cast("array<struct<at:bigint,bases:string>>")))
    whole = out.filter((held == inside) & (inside > 0)).select(key, text.alias("sequence"))
    return regions.join(whole, key, "left").withColumn(
        "hydration_status", F.when(F.col("sequence").isNotNull(), "complete").otherwise("incomplete"))


def support_counts(per_file: DataFrame, keys: list[str]) -> DataFrame:
    """Total fragments and number of supporting files per region."""
    return per_file.groupBy(*keys).agg(
        F.sum("fragment_count").alias("total_fragment_count"), F.count_if(F.col("fragment_count") > 0).alias("supporting_files"))


def in_bounds(start: Column, end: Column, length: int) -> Column:
    return (start >= 0) & (end <= length) & (start < end)
