"""Group ranks, winners, extrema, merges and picks (window and top-k operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar import schema
from pairgrammar.functions.keys import format_region, hash_rank
from pairgrammar.operators.ordered import Order, dedupe, order_columns, ranked, running, top_per_group


def group_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """group aggregates attached to every row; partial sums first, so a hot group stays cheap."""
    stats = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, by)


def group_size(df: DataFrame, by: list[str], name: str = "group_size") -> DataFrame:
    return group_stats(df, by, **{name: F.count("*")})


def group_margin(df: DataFrame, by: list[str], value: str, name: str = "group_margin") -> DataFrame:
    return group_stats(df, by, **{name: F.max(value) - F.min(value)})


def ranked_head(df: DataFrame, by: list[str], n: int, key: str = "seq_id") -> DataFrame:
    """deterministic top ``n`` per group in hash order of the key."""
    return top_per_group(df.withColumn("_h", hash_rank(key)), by, ["_h", key], n).drop("_h")


def label_winners(df: DataFrame, state: str = "state_label", score: str = "evidence_score", supported: str = "evidence_supported", tie: str = "seq_id") -> DataFrame:
    """winner per competition; only states with a unique top, both kinds of support and two rows qualify."""
    tops = df.groupBy(state, score).agg(F.count("*").alias("_n"), F.count_if(F.col(supported) > 0).alias("_s"))
    # counts per distinct score keep a hot state from being gathered in one task
    per = tops.groupBy(state).agg(
        F.sum("_n").alias("_rows"), F.sum("_s").alias("_sup"), F.max(F.struct(F.col(score).alias("v"), F.col("_n").alias("n"))).alias("_top"), F.min(score).alias("_low"))
    ok = per.filter((F.col("_rows") >= 2) & (F.col("_top.n") == 1) & (F.col("_top.v") > F.col("_low")) & (F.col("_sup") > 0) & (F.col("_sup") < F.col("_rows")))
    kept = df.join(ok.select(state, F.col("_top.v").alias("_best")), state)
    return ranked(kept, [state], [f"-{score}", tie], "evidence_rank").withColumn(
        "usage_label", F.when(F.col(score) == F.col("_best"), 1.0).otherwise(0.0)).drop("_best")


def extrema(df: DataFrame, by: list[str], value: str, tie: str, adaptive: bool = False) -> DataFrame:
    """best row as positive and worst as negative per group (two each from size 4 on when ``adaptive``).

    Flat and single-row groups drop out.
    """
    stats = df.groupBy(*by).agg(F.count("*").alias("_size"), F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    good = stats.filter((F.col("_size") >= 2) & (F.col("_hi") > F.col("_lo"))).select(*by, "_size")
    take = F.when(F.col("_size") >= 4, 2).otherwise(1) if adaptive else F.lit(1)
    deepest = 2 if adaptive else 1
    rows = df.join(good, by)
    top = top_per_group(rows, by, [f"-{value}", tie], deepest, keep_rank=True).withColumn("derived_label", F.lit(1.0))
    low = top_per_group(rows, by, [value, f"-{tie}"], deepest, keep_rank=True).withColumn("derived_label", F.lit(0.0))
    return top.unionByName(low).filter(F.col("_rn") <= take).drop("_rn", "_size")


def merge_intervals(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """merge overlapping or touching intervals per key."""
    spans = df.filter(F.col(end) > F.col(start)).groupBy(*by, start).agg(F.max(end).alias(end))
    seen = running(spans, by, [start], {"_seen": ("max", F.col(end))}, exclusive=True)
    flagged = seen.withColumn("_new", F.when(F.col("_seen").isNull() | (F.col(start) > F.col("_seen")), 1).otherwise(0))
    islands = running(flagged, by, [start], {"_island": ("sum", F.col("_new"))})
    return islands.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def strata(df: DataFrame, value: str, q: int = 5, tie: str = "seq_id", name: str = "availability_stratum") -> DataFrame:
    """quantile strata of the first-come rank, as a closed form of the rank."""
    n = df.agg(F.count("*").alias("n")).scalar()
    bins = F.least(F.lit(q).cast("long"), n)
    rank = F.col("_r")
    cut = F.when(n > 1, F.greatest(F.floor(((rank - 1) * bins + n - 2) / (n - 1)) - 1, F.lit(0))).otherwise(0)
    return ranked(df, [], [value, tie], "_r").withColumn(name, cut.cast("long")).drop("_r")


def round_robin(df: DataFrame, by: list[str], order: Order, n: int) -> DataFrame:
    """take rows in turn across the groups until ``n`` are picked."""
    first = top_per_group(df, by, order, n, keep_rank=True)
    return first.orderBy("_rn", *by).limit(n).drop("_rn")


def top_rows(df: DataFrame, order: Order, n: int) -> DataFrame:
    """G1."""
    return df.orderBy(*order_columns(order)).limit(n)


def sample_regions(regions: DataFrame, k: int | None) -> DataFrame:
    """Best ``k`` regions by element priority, then hash; all, if ``k`` is None."""
    priority = F.lit(schema.OTHER_PRIORITY)
    for name, value in schema.ELEMENT_PRIORITY.items():
        priority = F.when(F.col("element_type") == name, value).otherwise(priority)
    wide = regions.filter(F.col("region_end") > F.col("region_start")).select(
        "*",
        format_region("chromosome", "region_start", "region_end").alias("state_label"),
        (F.col("region_end") - F.col("region_start")).alias("width"),
        priority.alias("_priority"),
        hash_rank("screen_id", "encode_id", "chromosome", "region_start", "region_end").alias("_hash"),
    )
    return (wide if k is None else top_rows(wide, ["_priority", "_hash"], k)).drop("_priority", "_hash")


def diverse_pick(df: DataFrame, by: str, order: Order, n: int) -> DataFrame:
    """The first row of every group, then the rest in order, up to ``n``."""
    deep = top_per_group(df, [by], order, n, keep_rank=True)
    return deep.orderBy(F.col("_rn") > 1, *order_columns(order)).limit(n).drop("_rn")


def pick_case(df: DataFrame, score: Column, pool: Column, tie: str = "seq_id") -> DataFrame:
    """Best row of a target pool, or of the whole frame when the pool is empty."""
    return df.withColumn("case_score", score).orderBy(pool.desc(), F.col("case_score").desc(), F.col(tie)).limit(1)


def extreme_states(df: DataFrame, state: str, value: str) -> DataFrame:
    """States with the highest and the lowest mean value."""
    means = df.groupBy(state).agg(F.avg(value).alias("mean_value"))
    high = means.orderBy(F.col("mean_value").desc(), state).limit(1).withColumn("extreme", F.lit("high"))
    low = means.orderBy("mean_value", F.col(state).desc()).limit(1).withColumn("extreme", F.lit("low"))
    return high.unionByName(low)


def dynamic_pair(df: DataFrame, pair: str, position: str, value: str, minimum: int = 100) -> DataFrame:
    """Pair with the widest and most varied curve among pairs with enough rows."""
    curve = df.groupBy(pair, position).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"))
    per = curve.groupBy(pair).agg(F.sum("_n").alias("rows"), (F.max("_m") - F.min("_m")).alias("span"), F.coalesce(F.stddev_samp("_m"), F.lit(0.0)).alias("spread"))
    return per.filter(F.col("rows") >= minimum).withColumn("dynamics", F.col("span") + F.col("spread")).orderBy(F.col("dynamics").desc(), pair).limit(1)


def widest_margin(df: DataFrame, pair: str, position: str, label: str, value: str, minimum: int = 4) -> DataFrame:
    """Pair with the widest positive-negative margin over at least ``minimum`` positions."""
    per = df.groupBy(pair).agg(
        F.count_distinct(position).alias("positions"),
        (F.avg(F.when(F.col(label) > 0.5, F.col(value))) - F.avg(F.when(F.col(label) <= 0.5, F.col(value)))).alias("margin"))
    return per.filter((F.col("positions") >= minimum) & F.col("margin").isNotNull()).orderBy(F.col("margin").desc(), pair).limit(1)


def best_prefix(counts: DataFrame, order: str, scores: list[str]) -> DataFrame:
    """Best cumulative prefix of the files, fewest files on ties.

    ``counts`` has one row per file; ``scores`` are per-file amounts compared in order.
    """
    totals = running(
        counts.select(F.col(order), *[F.col(s).alias(f"_{s}") for s in scores]), [], [order], {s: ("sum", F.col(f"_{s}")) for s in scores})
    totals = totals.select(order, *scores)
    return totals.orderBy(*[F.col(s).desc() for s in scores], order).limit(1)


def diverse_tfs(tf_master: DataFrame, per_family: int = 2, families: int = 6, fallback: int = 8) -> DataFrame:
    """At most two per family over the first families; the first rows when no family is known."""
    known = tf_master.filter(F.coalesce("family", F.lit("")) != "")
    picked = known.select("family").distinct().orderBy("family").limit(families)
    capped = top_per_group(known.join(F.broadcast(picked), "family"), ["family"], ["tf_id"], per_family)
    none_known = known.agg(F.count("*").alias("n")).scalar() == 0
    rest = tf_master.filter(none_known).orderBy("tf_id").limit(fallback)
    return capped.unionByName(rest)


def best_per_group(df: DataFrame, by: list[str], order: Order) -> DataFrame:
    """D5."""
    return dedupe(df, by, order)
