"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrammar.views import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return fn
    return register


def r6(col: Column | str, name: str | None = None) -> Column:
    """Six decimals, negative zero folded."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name or col) if (name or isinstance(col, str)) else out


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to six decimals and widen integers."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)
