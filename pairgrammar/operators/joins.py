"""Keyed joins: enrichment, validation, set membership and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar.functions.keys import pair_key
from pairgrammar.operators.ordered import dedupe


def attach_state(seqs: DataFrame, states: DataFrame, tie: list[str]) -> DataFrame:
    """Inner join to state features, one row per state."""
    return seqs.join(dedupe(states, ["state_label"], tie), "state_label")


def enrich(base: DataFrame, key: str, **sources: DataFrame) -> DataFrame:
    """Chain of left joins; columns of each source get its name as suffix."""
    def add(df: DataFrame, item) -> DataFrame:
        name, src = item
        return df.join(src.select(key, *[F.col(c).alias(f"{c}_{name}") for c in src.columns if c != key]), key, "left")
    return reduce(add, sources.items(), base)


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left lookup. Spark broadcasts the dimension when its size allows."""
    return df.join(dim, key, "left")


def keep_known(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """C4."""
    return df.join(keys.select(*on), on, "left_semi")


def drop_known(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """C5."""
    return df.join(keys.select(*on), on, "left_anti")


def align_seeds(preds: DataFrame, seeds: list[int], keys: list[str], values: list[str]) -> DataFrame:
    """C6 + D17: examples that every seed scored, with the mean of each score (one shuffle)."""
    wanted = preds.filter(F.col("seed").isin(seeds))
    agg = wanted.groupBy(*keys).agg(F.count_distinct("seed").alias("_n"), *[F.avg(v).alias(v) for v in values])
    return agg.filter(F.col("_n") == len(set(seeds))).drop("_n")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], validate: str = "one_to_one", how: str = "inner") -> DataFrame:
    """Join that fails at run time when a side breaks the promised cardinality."""
    def unique(df: DataFrame, side: str) -> DataFrame:
        counts = df.groupBy(*on).agg(F.count("*").alias("_copies"), F.first(F.struct(*[F.col(c) for c in df.columns if c not in on])).alias("_row"))
        ok = F.when(F.col("_copies") == 1, F.col("_row")).otherwise(
            F.raise_error(F.lit(f"{side} keys are not unique")).cast(counts.schema["_row"].dataType))
        return counts.select(*on, ok.alias("_row")).select(*on, "_row.*")

    left = unique(left, "left") if validate == "one_to_one" else left
    return left.join(unique(right, "right"), on, how)


def grid(df: DataFrame, **dims: list) -> DataFrame:
    """Every row times every listed value, by exploding literal lists."""
    for name, values in dims.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def attach_metadata(preds: DataFrame, meta: DataFrame, key: str = "seq_id") -> DataFrame:
    """C14: metadata by key; columns the predictions already have win."""
    extra = [c for c in meta.columns if c not in preds.columns]
    return preds.join(meta.select(key, *extra), key, "left")


def apply_manifest(df: DataFrame, manifest: DataFrame, group: Column, default: Column) -> DataFrame:
    """Split by example id, else by group, else by hash."""
    by_id = dedupe(manifest.filter(F.col("seq_id").isNotNull()), ["seq_id"], ["split"]).select("seq_id", F.col("split").alias("_by_id"))
    by_group = dedupe(manifest.filter(F.col("group_value").isNotNull()), ["group_value"], ["seq_id"]).select(
        F.col("group_value").alias("_group"), F.col("split").alias("_by_group"))
    out = df.withColumn("_group", group).join(by_id, "seq_id", "left").join(by_group, "_group", "left")
    return out.withColumn("split", F.coalesce("_by_id", "_by_group", default)).drop("_by_id", "_by_group", "_group")


def priority_union(primary: DataFrame, *others: DataFrame) -> DataFrame:
    """C17: later sources only add pairs whose name and unordered key the primary lacks."""
    names = primary.select("pair_name").distinct()
    keys = primary.select(pair_key("left_tf", "right_tf").alias("_key")).distinct()
    out = primary
    for i, other in enumerate(others):
        fresh = other.join(names, "pair_name", "left_anti")
        if i > 0:  # the second source is matched by name only
            fresh = fresh.withColumn("_key", pair_key("left_tf", "right_tf")).join(keys, "_key", "left_anti").drop("_key")
        out = out.unionByName(fresh, allowMissingColumns=True)
    return out


def missing_slices(requested: DataFrame, available: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """C18."""
    return requested.join(available.select(*keys).distinct(), keys, "left_anti").withColumn("reason", F.lit(reason))


def reference_support(pairs: DataFrame, edges: DataFrame, name: str = "reference_supported") -> DataFrame:
    """Whether the unordered pair is a reference edge."""
    known = edges.select(pair_key("left_tf", "right_tf").alias("_key")).distinct().withColumn(name, F.lit(True))
    out = pairs.withColumn("_key", pair_key("left_tf", "right_tf")).join(known, "_key", "left").drop("_key")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def union_all(*dfs: DataFrame) -> DataFrame:
    """H1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def tagged_union(tag: str, **dfs: DataFrame) -> DataFrame:
    """H1: union with the part name in a column."""
    return union_all(*[df.withColumn(tag, F.lit(name)) for name, df in dfs.items()])


def key_union(df: DataFrame, a: str, b: str, name: str = "key") -> DataFrame:
    """H3: distinct values of two key columns."""
    return df.select(F.explode(F.array(a, b)).alias(name)).filter(F.col(name).isNotNull()).distinct()


def missing_keys(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """H4."""
    return expected.select(*on).distinct().join(actual.select(*on), on, "left_anti")


def common_keys(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """H5."""
    return a.select(*on).intersect(b.select(*on))


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """H6."""
    return df.unpivot(ids, values, variable, value)


def flatten_metrics(df: DataFrame, column: str, phase: str) -> DataFrame:
    """H7: JSON phase -> feature group -> method -> metrics, one row per method that has an AUPRC."""
    parsed = F.from_json(column, "map<string,map<string,map<string,map<string,double>>>>")
    groups = df.select(*[c for c in df.columns if c != column], F.explode(F.try_element_at(parsed, F.lit(phase))).alias("feature_group", "_methods"))
    methods = groups.select("*", F.explode("_methods").alias("estimator", "_metrics")).drop("_methods")
    names = ["auprc", "auroc", "balanced_accuracy", "brier", "ece", "nll"]
    return methods.filter(F.map_contains_key("_metrics", "auprc")).select(
        "*", F.lit(phase).alias("phase"), F.concat_ws("/", "feature_group", "estimator").alias("method"),
        *[F.try_element_at("_metrics", F.lit(n)).alias(n) for n in names]).drop("_metrics")
