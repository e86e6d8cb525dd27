"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ITEM_BLOCK = 4096
QUERY_BLOCK = 1024
FIRST_DEPTH = 16
LARGEST = 2.0**53  # scaled components saturate here, as doubles beyond are no longer every integer
LONG = 2**63 - 1


def scaled(vectors: DataFrame, key: str, vector: str, factor: int = 1024) -> DataFrame:
    """``id`` and the integer vector ``v`` = floor(factor * x); rows with a null key, a null vector or a component that is null or not finite go.

    Scaled components saturate at 2^53.
    """
    x = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return x.where(F.col("id").isNotNull() & F.col("x").isNotNull() & fine).select("id", F.transform("x", lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c * float(factor))))).alias("v"))


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)[rows] if width else np.zeros((len(rows), 0), np.int64)


def _exact(items: np.ndarray, queries: np.ndarray) -> np.ndarray | type:
    """Numbers in which every sum is exact: doubles where they hold it, else Python's integers."""
    most = lambda m: int(np.abs(m.astype(object)).max()) if m.size else 0
    return np.float64 if most(items) * most(queries) * max(1, items.shape[1]) < 2**53 else object


def threshold_top_k(ids: np.ndarray, items: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, item id, score) of each query's k best items, smaller ids first among equals.

    The lists of all dimensions are read side by side, from the end that a query's sign prefers. An
    item that no list has shown yet scores at most the sum of what the lists show now; once the kth
    best score is above that, nothing unseen can enter, not even as a tie. Depth doubles.
    """
    n, kind = len(ids), _exact(items, queries)
    items, queries = items.astype(kind), queries.astype(kind)
    order = np.argsort(items.astype(np.float64), axis=0, kind="stable") if kind is np.float64 else np.argsort(items, axis=0)
    ranked = np.take_along_axis(items, order, axis=0)
    up, down = np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)
    depths = []
    while not depths or depths[-1] < n:
        depths.append(min(n, FIRST_DEPTH << len(depths)))
    bounds = [up @ ranked[n - d] + down @ ranked[d - 1] for d in depths]
    out = []
    for q in range(len(query_ids)):
        rise, fall = np.flatnonzero(up[q]), np.flatnonzero(down[q])
        seen = ids == query_ids[q]
        best_ids, best, before = np.zeros(0, ids.dtype), np.zeros(0, kind), 0
        for step, d in enumerate(depths):
            if d == n:
                fresh = np.flatnonzero(~seen)
            else:
                shown = np.zeros(n, bool)
                shown[order[n - d:n - before][:, rise]] = True
                shown[order[before:d][:, fall]] = True
                fresh = np.flatnonzero(shown & ~seen)
                seen |= shown
            best_ids, best = np.concatenate([best_ids, ids[fresh]]), np.concatenate([best, items[fresh] @ queries[q]])
            if len(best) > 2 * k:
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
            if len(best) >= k and np.sort(best)[-k] > bounds[step][q]:
                break
            before = d
        top = np.lexsort((best_ids, -best))[:k]
        out += [(int(query_ids[q]), int(best_ids[i]), max(-LONG, min(LONG, int(best[i])))) for i in top]
    return out


def top_k(items: DataFrame, queries: DataFrame, k: int = 10, item_block: int = ITEM_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k items with the largest inner products.

    Both inputs hold ``id`` and ``v`` (see ``scaled``). Items are dealt into blocks by hash; a block
    of items meets a block of queries in one task, which runs the threshold algorithm, and the
    blocks' winners are ranked. An item with the query's id is the query's own and takes no part;
    repeated rows are candidates each, a repeated query id asks with its smallest vector. Vectors of
    another length than the query's are no candidates. Ties go to the smaller id; fewer than k
    candidates are all returned; empty inputs give no rows.
    """
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    parts, asks = max(1, -(-items.count() // item_block)), max(1, -(-queries.count() // query_block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = items.select("id", "v", deal(parts).alias("part"), every(asks).alias("ask"))
    right = queries.select("id", "v", deal(asks).alias("ask"), every(parts).alias("part"))

    def work(own: pa.Table, ask: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        sizes = [np.array(t.column("v").combine_chunks().value_lengths().to_pylist(), np.int64) for t in (own, ask)]
        for width in np.unique(sizes[1]):
            at = [np.flatnonzero(s == width) for s in sizes]
            if len(at[0]):
                pick = [t.take(pa.array(a)) for t, a in zip((own, ask), at)]
                data = [_matrix(t.column("v"), np.arange(t.num_rows), int(width)) for t in pick]
                rows += threshold_top_k(pick[0].column("id").to_numpy(), data[0], pick[1].column("id").to_numpy(), data[1], k)
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols)})

    found = left.groupBy("part", "ask").cogroup(right.groupBy("part", "ask")).applyInArrow(work, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
