"""Scoring hooks, robustness transforms, partition-function scores and linear baselines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar.functions.keys import draw
from pairgrammar.operators.metrics import binary_metrics, ranking_metrics


def score_table(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """User scoring function over Arrow batches; whatever it closes over travels with the task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def _noise(level: float, seed: int, key: str) -> Callable[[Column, Column], Column]:
    """Normal-like noise from two hash draws (Box-Muller)."""
    def at(x: Column, i: Column) -> Column:
        u = (draw(1_000_000, F.lit(f"{seed}a"), key, i) + 1) / 1_000_001.0
        v = draw(1_000_000, F.lit(f"{seed}b"), key, i) / 1e6
        return F.greatest(x + level * F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v), F.lit(0.0))
    return at


def _roll(col: str, by: int) -> Column:
    n = F.size(col)
    k = F.pmod(F.lit(by), n).cast("int")
    return F.concat(F.slice(col, n - k + 1, k), F.slice(col, F.lit(1), n - k))


def perturb(df: DataFrame, assay: str, seed: int = 11, key: str = "seq_id") -> DataFrame:
    """One robustness transform of an example table (arrays: availability, state, offsets, interface tensors)."""
    have = set(df.columns)
    if assay.startswith("availability_noise_") and "availability" in have:
        return df.withColumn("availability", F.transform("availability", _noise(float(assay.rsplit("_", 1)[1]), seed, key)))
    if assay == "state_corruption" and "state" in have:
        order = F.array_sort(F.transform("state", lambda x, i: F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), i.cast("string")), 256).alias("h"), x.alias("x"))))
        return df.withColumn("state", F.transform(order, lambda s: s["x"]))
    shift = {"anchor_shift": 1, "interface_shuffle_stress": 2}.get(assay, 0)
    out = df
    if shift and {"left_anchor_offsets", "right_anchor_offsets"} <= have:
        out = out.withColumns({"left_anchor_offsets": _roll("left_anchor_offsets", shift), "right_anchor_offsets": _roll("right_anchor_offsets", -shift)})
    swaps = {"interface_shuffle": ["interface_tensor_shuffle"], "interface_shuffle_stress": ["interface_tensor_core_rerandomized", "interface_tensor_shuffle"]}.get(assay, [])
    for name in swaps:
        if name in have:
            return out.withColumn("interface_tensor", F.col(name))
    return out


ASSAYS = ["baseline", "availability_noise_0.05", "availability_noise_0.10", "availability_noise_0.20", "state_corruption", "anchor_shift", "interface_shuffle", "interface_shuffle_stress"]


def robustness_report(df: DataFrame, score: Callable[[DataFrame], DataFrame], assays: list[str] | None = None, seed: int = 11) -> DataFrame:
    """Metrics of ``score(perturbed)`` (label, score) per assay."""
    parts = [score(perturb(df, a, seed)).select("label", "score", F.lit(a).alias("assay")) for a in (assays or ASSAYS)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return ranking_metrics(both, "label", "score", ["assay"]).join(binary_metrics(both, "label", "score", ["assay"]), "assay")


def usage_score(df: DataFrame, bias: float = 0.0, w_mono: float = 0.0, w_gain: float = 0.0, w_drive: float = 0.0, state_bias: Column | None = None) -> DataFrame:
    """Partition-function score from left, right and residual energies, with its two reference variants.

    Raw weights pass through softplus.
    """
    soft = lambda w: math.log1p(math.exp(w))
    left, right, residual = F.col("left_energy"), F.col("right_energy"), F.col("state_residual")
    comp = F.coalesce("compatibility", F.lit(1.0)) if "compatibility" in df.columns else F.lit(1.0)
    extra = state_bias if state_bias is not None else F.lit(0.0)

    def logits(res: Column) -> tuple[Column, Column, Column]:
        mono = F.log1p(F.exp(-left) + F.exp(-right))
        gain = F.ln(F.exp(mono) + comp * F.exp(-(left + right + res))) - mono
        drive = comp * F.tanh(-res)
        return mono, gain, bias + soft(w_mono) * mono + soft(w_gain) * gain + soft(w_drive) * drive + extra

    sig = lambda z: 1 / (1 + F.exp(-z))
    mono, gain, z = logits(residual)
    _, _, z0 = logits(F.lit(0.0))
    intrinsic = F.col("left_intrinsic") + F.col("right_intrinsic") if "left_intrinsic" in df.columns else left + right
    return df.withColumns({
        "log_z_mono": mono, "cooperative_gain": gain, "signed_pair_gain": gain * F.tanh(-residual), "full_score": sig(z),
        "availability_only_score": sig(z0), "additive_null_score": sig(-intrinsic)})


def fit_classifier(df: DataFrame, features: list[str], label: str = "label", split: str = "split", reg: float = 0.0) -> DataFrame:
    """Logistic baseline trained on the train rows; held-out AUPRC and AUROC per split."""
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df.select(*features, label, split))
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, maxIter=50).fit(data.filter(F.col(split) == "train"))
    scored = model.transform(data).withColumn("score", vector_to_array("probability")[1])
    return ranking_metrics(scored, label, "score", [split])


def fit_component(df: DataFrame, features: list[str], target: str, split: str = "split", reg: float = 1.0) -> DataFrame:
    """Ridge recovery of a component; correlation per split."""
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df.select(*features, target, split))
    model = LinearRegression(featuresCol="_x", labelCol=target, regParam=reg, elasticNetParam=0.0).fit(data.filter(F.col(split) == "train"))
    return model.transform(data).groupBy(split).agg(F.count("*").alias("n"), F.corr("prediction", target).alias("correlation"))
