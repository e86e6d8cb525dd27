"""Running totals and ranks that survive a hot group.

A window over one key sorts the whole key in one task. Where the input may be large, Spark's range
partitioning by (group, order, row number) deals the rows into ranges of about ``RANGE_ROWS``, so
that even one repeated key is cut; rows are windowed per (group, range) and shifted by the totals
of the earlier ranges. Rows that fit one range, by their count, are the plain window. Both order
nulls as Spark does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgrammar.session import cut_lineage, leaf_bytes, materialize, shared_dir, shuffles

Order = list  # column names; a leading "-" means descending

RANGE_ROWS = 1 << 20
SMALL_BYTES = 64 << 20  # inputs read from less than this are counted before they are stored


def order_columns(order: Order) -> list[Column]:
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def with_ranges(df: DataFrame, by: list[str], order: Order, ranges: int, name: str = "_range", tie: str = "_tie") -> DataFrame:
    """Add an order-preserving range number and a row number that breaks ties, kept in a checkpoint.

    The checkpoint makes both readings of the ranges agree, whatever is computed again.
    """
    shared_dir(df.sparkSession)
    numbered = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(ranges, *[F.col(c).asc() for c in by], *order_columns(order), F.col(tie))
    return dealt.withColumn(name, F.spark_partition_id()).checkpoint()


def _sized(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows, stored if they are many or a shuffle made them, and the number of ranges they need.

    The count decides, not the size of the files: few bytes may hold or become any number of rows.
    What tasks derive from little alone is counted first (a job that reads hardly a column).
    """
    if leaf_bytes(df) <= SMALL_BYTES and not shuffles(df) and df.count() <= RANGE_ROWS:
        return df, 1
    df = materialize(df)
    return df, max(1, -(-df.count() // RANGE_ROWS))


_COMBINE = {"sum": "{0} + {1}", "max": "greatest({0}, {1})", "min": "least({0}, {1})"}


def running(
    df: DataFrame,
    by: list[str],
    order: Order,
    measures: dict[str, tuple[str, Column]],
    exclusive: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` per group in the given order.

    ``measures`` maps a result name to (kind, column). ``exclusive`` leaves the row itself out.
    ``ranges`` fixes the number of ranges. Rows with equal keys come in any order.
    """
    kinds = [k for k, _ in measures.values()]
    df = cut_lineage(df)
    columns = df.columns
    if ranges is None:
        df, ranges = _sized(df)
    end = -1 if exclusive else 0
    given = df.select("*", *[c.alias(f"_m{i}") for i, (_, c) in enumerate(measures.values())])
    if ranges == 1:
        frame = Window.partitionBy(*by).orderBy(*order_columns(order)).rowsBetween(Window.unboundedPreceding, end)
        return given.select(*columns, *[F.expr(f"{k}(_m{i})").over(frame).alias(n) for i, (n, k) in enumerate(zip(measures, kinds))])
    ranged = with_ranges(given, by, order, ranges)
    frame = Window.partitionBy(*by, "_range").orderBy(*order_columns(order), "_tie").rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy("_k_range").rowsBetween(Window.unboundedPreceding, -1)

    local = ranged.select("*", *[F.expr(f"{k}(_m{i})").over(frame).alias(f"_l{i}") for i, k in enumerate(kinds)])
    groups = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)] + [F.col("_range").alias("_k_range")]
    totals = ranged.groupBy(*groups).agg(*[F.expr(f"{k}(_m{i})").alias(f"_t{i}") for i, k in enumerate(kinds)])
    keys = [*[f"_k{i}" for i in range(len(by))], "_k_range"]
    shifts = totals.select(*keys, *[F.expr(f"{k}(_t{i})").over(before).alias(f"_o{i}") for i, k in enumerate(kinds)])
    # null-safe keys: groups may be null
    same = " AND ".join([f"`{c}` <=> _k{i}" for i, c in enumerate(by)] + ["_range <=> _k_range"])
    out = local.join(shifts, F.expr(same), "left")
    merged = [
        F.expr(f"CASE WHEN _l{i} IS NULL THEN _o{i} WHEN _o{i} IS NULL THEN _l{i} ELSE {_COMBINE[k].format(f'_l{i}', f'_o{i}')} END").alias(n)
        for i, (n, k) in enumerate(zip(measures, kinds))]
    return out.select(*columns, *merged)


def ranked(df: DataFrame, by: list[str], order: Order, name: str, ranges: int | None = None) -> DataFrame:
    """sequential rank from 1 in the given order, safe for a hot group."""
    return running(df, by, order, {name: ("sum", F.lit(1).cast("long"))}, ranges=ranges)


def top_per_group(df: DataFrame, by: list[str], order: Order, n: int, name: str = "_rn", keep_rank: bool = False) -> DataFrame:
    """First ``n`` rows per group; Spark prunes to ``n`` per task before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order_columns(order))
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return out if keep_rank else out.drop(name)


def dedupe(df: DataFrame, key: list[str], order: Order, keep: str = "first") -> DataFrame:
    """keep the first or last row per key in an explicit order."""
    if keep == "last":
        order = [o[1:] if o.startswith("-") else f"-{o}" for o in order]
    return top_per_group(df, key, order, 1)
