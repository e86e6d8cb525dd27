"""Pair geometry and basis expansions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar import schema
from pairgrammar.functions.keys import _c


def helical_basis(distance, order: int = 2, period: float = schema.HELICAL_PERIOD) -> list[Column]:
    """Sin and cos of the first ``order`` harmonics."""
    out = []
    for k in range(1, order + 1):
        angle = _c(distance) * (2.0 * math.pi * k / period)
        out += [F.sin(angle), F.cos(angle)]
    return out


def spline_basis(distance, bins: int = 8, low: float = -4.0, high: float = 20.0) -> list[Column]:
    """Triangular basis on evenly spaced knots."""
    scale = max((high - low) / bins, 1e-6)
    knots = [low + i * (high - low) / (bins - 1) for i in range(bins)]
    return [F.greatest(1.0 - F.abs(_c(distance) - F.lit(k)) / scale, F.lit(0.0)) for k in knots]


def geometry_vector(distance, gap, overlap, orientation, order: int = 2, bins: int = 8) -> list[Column]:
    """Distance, gap, overlap, orientation one-hot, helical and spline terms."""
    hot = [F.when(_c(orientation) == o, 1.0).otherwise(0.0) for o in schema.ORIENTATIONS]
    base = [_c(x).cast("double") for x in (distance, gap, overlap)]
    return base + hot + helical_basis(distance, order) + spline_basis(distance, bins)


def geometry_dim(order: int = 2, bins: int = 8) -> int:
    return 3 + 4 + 2 * order + bins


def geometry_features(pairs: DataFrame, order: int = 2, bins: int = 8) -> DataFrame:
    """``geom_0..`` columns per pair."""
    vector = geometry_vector("center_distance", "edge_gap", "overlap_len", "orientation", order, bins)
    return pairs.select("seq_id", "pair_id", *[v.alias(f"geom_{i}") for i, v in enumerate(vector)])


def gap_index(gap) -> Column:
    """Half-even rounding, clamped to the gap bins."""
    rounded = F.bround(_c(gap).cast("double"), 0).cast("int")
    return F.least(F.greatest(rounded, F.lit(schema.GAP_MIN)), F.lit(schema.GAP_MAX)) - schema.GAP_MIN


def gap_one_hot(gap) -> Column:
    """25-wide one-hot of the gap."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(schema.GAP_MAX - schema.GAP_MIN)),
        lambda i: F.when(i == gap_index(gap), 1.0).otherwise(0.0),
    )


def pair_geometry(l: dict[str, str], r: dict[str, str]) -> dict[str, Column]:
    """Geometry of two anchors; each side maps start, end, strand, score to columns."""
    ls, le, rs, re = (_c(x) for x in (l["start"], l["end"], r["start"], r["end"]))
    return {
        "orientation": F.concat(_c(l["strand"]), _c(r["strand"])),
        "center_distance": ((rs + re) / 2.0 - (ls + le) / 2.0).cast("double"),
        "edge_gap": (rs - le).cast("double"),
        "overlap_len": F.greatest(F.lit(0), F.least(le, re) - F.greatest(ls, rs)).cast("double"),
        "coarse_additive_score": _c(l["score"]) + _c(r["score"]),
    }


def compatibility(overlap) -> Column:
    """B27."""
    return F.exp(-F.greatest(F.lit(0.0), _c(overlap) - 4.0))
