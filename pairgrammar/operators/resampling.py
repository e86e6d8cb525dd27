"""Resampling without a row for every replicate and draw, and without a draw for every row.

Rows that a statistic cannot tell apart are one cell with a count. How often a replicate draws a cell
is one number, made from a hash of (seed, replicate, cell key) inside the task that holds the cell, so
nothing but sums per replicate leaves a task, and work goes with the number of distinct cells.

* Bootstraps weigh rows by Poisson draws of mean one: a cell of n rows has mean n.
* Swaps exchange two scores of a row or not: of n rows, a binomial number.
* Subsets of a fixed size split by hypergeometric draws: down a tree over blocks of cells, then over cells.

A count is drawn as its powers of two, each by one threshold table for all cells. Metrics of ordered scores are
summed range by range in score order: first the ranges' totals per replicate, then each range shifted
by the totals above it. A score may lie in several ranges: it is summed in the last one, to which the others pass their part.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgrammar.functions.keys import hash_bucket
from pairgrammar.session import materialize, shared_dir

PRIME = 2**31 - 1
STEP = 48271  # a primitive root of the prime, as in the common minimal generator
LEVEL_STEP, ITEM_STEP = 69621, 39373  # apart, the keys of a cell's powers of two, and of its single rows
TOP_LEVEL = 30  # larger counts take several draws of this power of two
LIGHT = 8  # in subsets, a cell of so few rows draws a number for each
TASK_CELLS = 200_000_000  # cells times replicates a task, about
CHUNK, ROWS = 256, 256  # replicates and cells held as one matrix, which stays in a core's cache
BLOCK = 64  # cells drawn at once
SHORT = 16  # thresholds compared one by one
NUMPY_LIMIT = 10**9  # what numpy's hypergeometric draws take on either side


def row_key(*parts) -> Column:
    """A row's number below ``PRIME``, from its key."""
    return hash_bucket(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), PRIME)


def constants(seed: int, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    part = lambda r, c: int(hashlib.sha256(f"{seed}|{r}|{c}".encode()).hexdigest()[:8], 16)
    numbers = range(1, replicates + 1)
    return np.array([1 + part(r, "a") % (PRIME - 1) for r in numbers], np.int64), np.array([part(r, "b") % PRIME for r in numbers], np.int64)


def numbers(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Uniform numbers below ``PRIME``: a row for each key, a column for each replicate.

    ``((x * x) * STEP + x) % PRIME`` of ``x = keys * a + b``. The prime is one less than a power of two, so a remainder
    is the sum of a number's lower and higher bits; only the last one has to be the least.
    """
    x = _folded(_folded(keys[:, None] * a + b))
    z = _folded(x * x)
    z *= STEP
    z += x
    z = _folded(z)
    z -= PRIME * (z >= PRIME)
    return z


def _folded(x: np.ndarray) -> np.ndarray:
    """A number with the same remainder by ``PRIME``: at most 2^32 from one below 2^63, at most 2^31 from that."""
    high = x >> 31
    x &= PRIME
    x += high
    return x


def _above(table: np.ndarray, z: np.ndarray) -> np.ndarray:
    """How many of the sorted thresholds each number reaches; a short table is compared one threshold at a time."""
    if len(table) > SHORT:
        return np.searchsorted(table, z.ravel(), "right").reshape(z.shape)
    out = np.zeros(z.shape, np.int8)
    for t in table:
        out += z >= t
    return out


@lru_cache(maxsize=None)
def thresholds(kind: str, level: int) -> tuple[int, np.ndarray]:
    """Least draw of 2^level rows and the numbers from which the draws above it begin.

    ``poisson``: mean 2^level; ``swap``: each row with probability one half. What is rarer than the numbers' grain is left out.
    """
    n = 1 << level
    if kind == "poisson" and not level:
        return 0, np.array([int(PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(10)])
    if kind == "swap" and not level:
        return 0, np.array([PRIME // 2 + 1])
    mid, reach = (n, 12 * math.sqrt(n) + 20) if kind == "poisson" else (n // 2, 6 * math.sqrt(n) + 10)
    low, high = max(0, int(mid - reach)), int(mid + reach) if kind == "poisson" else min(n, int(mid + reach))
    k = np.arange(low + 1, high + 1, dtype=float)
    log = np.concatenate([[0.0], np.cumsum(np.log(n / k) if kind == "poisson" else np.log((n - k + 1) / k))])
    weight = np.exp(log - log.max())
    table = (PRIME * (np.cumsum(weight) / weight.sum())[:-1]).astype(np.int64)
    first, last = np.searchsorted(table, 1), np.searchsorted(table, PRIME)
    return low + int(first), table[first:last]


def draws(kind: str, keys: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many rows of each cell a replicate draws: the sum over the powers of two in its count."""
    out = np.zeros((len(keys), len(a)))
    for level in range(int(counts.max(initial=0)).bit_length()):
        if level > TOP_LEVEL:
            break
        at = np.flatnonzero(counts >> level & 1) if level < TOP_LEVEL else np.flatnonzero(counts >> level)
        if not len(at):
            continue
        low, table = thresholds(kind, level)
        for again in range(int((counts[at] >> level).max()) if level == TOP_LEVEL else 1):
            some = at if level < TOP_LEVEL else at[counts[at] >> level > again]
            shifted = (keys[some] + (level + again) * LEVEL_STEP) % PRIME
            for lo in range(0, len(some), BLOCK):
                out[some[lo:lo + BLOCK]] += low + _above(table, numbers(shifted[lo:lo + BLOCK], a, b))
    return out


def cells(rows: DataFrame, by: list[str], key: str = "_key") -> DataFrame:
    """Rows alike in ``by`` as one cell: its count ``_count`` and its smallest key, partial sums first."""
    return rows.groupBy(*by).agg(F.count("*").alias("_count"), F.min(key).alias(key))


def _sums(score: np.ndarray, label: np.ndarray, key: np.ndarray, count: np.ndarray, first: np.ndarray, kind: str, a: np.ndarray, b: np.ndarray,
          before: np.ndarray | None, carried: np.ndarray | None = None, goes_on: bool = False, ahead_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per list (2) and replicate: weights of positives and negatives, average-precision and pair sums; and the last score's weights.

    With ``ahead_only`` the two sums stay zero: what lies ahead of other ranges are the weights alone.

    Cells come in descending score order. ``before``: the weights (2, 2, replicates) of all higher scores;
    ``carried``: those of the first score in earlier ranges. A last score that ``goes_on`` is summed elsewhere.
    """
    out, last = np.zeros((2, 4, len(a))), np.zeros((2, 2, len(a)))
    starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]])) if len(score) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(score))
    for lo in range(0, len(a), CHUNK):
        cols = slice(lo, lo + CHUNK)
        ahead = np.zeros((2, 2, len(a[cols]))) if before is None else before[:, :, cols].copy()
        g = 0
        while g < len(starts):
            h = max(g + 1, int(np.searchsorted(ends, starts[g] + ROWS, "right")))
            held = np.zeros((2, 2, h - g, len(a[cols])))
            seen = np.zeros((2, 2, h - g), bool)  # groups with a cell of a list and label
            for at in range(int(starts[g]), int(ends[h - 1]), ROWS):  # one repeated score may be long
                rows = slice(at, min(at + ROWS, int(ends[h - 1])))
                drawn = draws(kind, key[rows], count[rows], a[cols], b[cols])
                group = np.searchsorted(starts[g:h], np.arange(rows.start, rows.stop), "right") - 1
                for side, mine in enumerate((first[rows], ~first[rows])):
                    if kind == "swap":  # a row is in both lists
                        weights, mine = np.where(mine[:, None], count[rows][:, None] - drawn, drawn), np.ones(len(mine), bool)
                    else:
                        weights = drawn
                    for sign, on in enumerate((label[rows] > 0.5, label[rows] <= 0.5)):
                        some = np.flatnonzero(mine & on)
                        if not len(some):
                            continue
                        cut = np.flatnonzero(np.concatenate([[True], np.diff(group[some]) > 0]))
                        to = group[some[cut]]
                        held[side, sign, to] += weights[some] if len(cut) == len(some) else np.add.reduceat(weights[some], cut, axis=0)
                        seen[side, sign, to] = True
            out[:, :2, cols] += held.sum(axis=2)
            if h == len(starts):
                last[:, :, cols] = held[:, :, -1]
            if ahead_only:
                g = h
                continue
            if g == 0 and carried is not None:
                held[:, :, 0] += carried[:, :, cols]
                seen[:, :, 0] = True
            if h == len(starts) and goes_on:
                held, seen = held[:, :, :-1], seen[:, :, :-1]
            for side in (0, 1):
                some = np.flatnonzero(seen[side].any(axis=0))
                if not len(some):
                    continue
                pos, neg = held[side][:, some]
                tp, fp = ahead[side, 0] + pos.cumsum(axis=0), ahead[side, 1] + neg.cumsum(axis=0)
                ahead[side, 0], ahead[side, 1] = tp[-1], fp[-1]
                hits = np.flatnonzero(seen[side, 0, some])  # the others add nothing
                pos, neg, tp, fp = pos[hits], neg[hits], tp[hits], fp[hits]
                out[side, 2, cols] += (pos * tp / np.maximum(tp + fp, 1e-300)).sum(axis=0)
                out[side, 3, cols] += (pos * (fp - neg / 2)).sum(axis=0)
            g = h
    return out, last


_SIDES = ("m_pos", "m_neg", "b_pos", "b_neg")
_FIELDS = [f"{side}_{name}" for side in ("m", "b") for name in ("pos", "neg", "ap", "above")]


def replicate_metrics(rows: DataFrame, by: list[str], kind: str, replicates: int, seed: int, tie: str) -> DataFrame:
    """AUPRC and AUROC of both scores in every replicate: by, replicate, metric_name, model_metric, baseline_metric.

    ``rows``: by, label and the scores ``m`` and ``b`` (no nulls). ``kind``: ``poisson`` weighs rows,
    ``swap`` exchanges the two scores of a row or not. A replicate with one class has null metrics.
    Rows alike in group, label and both scores are one cell. Cells in score order are cut into ranges of equal
    size even inside one score.
    """
    same = cells(rows.select(*by, F.col("label").cast("double").alias("label"), F.col("m").cast("double").alias("m"), F.col("b").cast("double").alias("b"), row_key(tie).alias("_key")), [*by, "label", "m", "b"])
    entries = same.select(*by, "label", "_key", "_count", F.explode(F.array(
        F.struct(F.col("m").alias("_score"), F.lit(True).alias("_first")), F.struct(F.col("b").alias("_score"), F.lit(False).alias("_first")))).alias("e"))
    entries = materialize(entries.select(*by, "label", "_key", "_count", "e.*"))
    total = entries.count()
    ranges = max(1, -(-total * replicates // TASK_CELLS))
    if ranges > 1:
        shared_dir(rows.sparkSession)
        order = [*[F.col(c).asc() for c in by], F.col("_score").desc(), F.col("_key"), F.col("_first"), F.col("label")]
        entries = entries.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    else:
        entries = entries.withColumn("_range", F.lit(0))
    keys = ["_range", *by]
    # dealt by an explicit number: the rows are few bytes for their work, and adapted plans would put them into few tasks
    tasks = 2 * max(ranges, rows.sparkSession.sparkContext.defaultParallelism)
    entries = entries.repartition(tasks, *keys)
    types = [f for f in entries.schema.fields if f.name in keys]
    heads = sorted(types, key=lambda f: keys.index(f.name))
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([*heads, *[T.StructField(n, array) for n in _FIELDS]])
    ends = T.StructType([*heads, T.StructField("top", T.DoubleType()), T.StructField("low", T.DoubleType()), *[T.StructField(n, array) for n in _SIDES], *[T.StructField(f"last_{n}", array) for n in _SIDES]])

    def work(table: pa.Table, before: np.ndarray | None = None, carried: np.ndarray | None = None, goes_on: bool = False, only_ends: bool = False) -> pa.Table:
        a, b = constants(seed, replicates)
        data = {c: table[c].to_numpy() for c in ("_score", "label", "_key", "_count", "_first")}
        order = np.argsort(-data["_score"], kind="stable")
        score = data["_score"][order]
        sums, last = _sums(score, *[data[c][order] for c in ("label", "_key", "_count")], data["_first"][order].astype(bool), kind, a, b, before, carried, goes_on, only_ends)
        head = [table[k].slice(0, 1) for k in keys]
        if only_ends:
            found = [*sums[:, :2].reshape(4, -1), *last.reshape(4, -1)]
            return pa.table([*head, pa.array([score[0]]), pa.array([score[-1]]), *[pa.array([s], pa.list_(pa.float64())) for s in found]], names=ends.names)
        return pa.table([*head, *[pa.array([s], pa.list_(pa.float64())) for s in sums.reshape(8, -1)]], names=schema.names)

    if ranges == 1:
        found = entries.groupBy(*keys).applyInArrow(lambda t: work(t), schema)
    else:
        partial = entries.groupBy(*keys).applyInArrow(lambda t: work(t, only_ends=True), ends)
        lasts = [f"last_{n}" for n in _SIDES]
        tall = partial.select(*keys, "top", "low", F.posexplode(F.arrays_zip(*_SIDES, *lasts)).alias("_r", "e")).select(*keys, "top", "low", "_r", "e.*")
        along = Window.partitionBy(*by, "_r").orderBy("_range")
        above = along.rowsBetween(Window.unboundedPreceding, -1)
        alike = Window.partitionBy(*by, "_r", "low").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        tall = tall.select("*", *[F.sum(n).over(alike).alias(f"so_far_{n}") for n in lasts])
        open_ = F.lag("low").over(along) == F.col("top")
        carry = [F.coalesce(F.when(open_, F.lag(f"so_far_last_{n}").over(along)), F.lit(0.0)).alias(f"carried_{n}") for n in _SIDES]
        shift = tall.select(*keys, "_r", F.coalesce(F.lead("top").over(along) == F.col("low"), F.lit(False)).alias("goes_on"), *carry, *[F.coalesce(F.sum(n).over(above), F.lit(0.0)).alias(n) for n in _SIDES])
        # what lies above the first score leaves out what earlier ranges hold of this score itself
        shift = shift.withColumns({n: F.col(n) - F.col(f"carried_{n}") for n in _SIDES})
        names = [*_SIDES, *[f"carried_{n}" for n in _SIDES]]
        shift = shift.groupBy(*keys).agg(F.bool_or("goes_on").alias("goes_on"), F.array_sort(F.collect_list(F.struct("_r", *names))).alias("s")).select(*keys, "goes_on", *[F.col(f"s.{n}").alias(n) for n in names]).repartition(tasks, *keys)

        def shifted(left: pa.Table, right: pa.Table) -> pa.Table:
            before, carried = (np.array([right[n].to_pylist()[0] for n in names[i:i + 4]]).reshape(2, 2, -1) for i in (0, 4))
            return work(left, before, carried, right["goes_on"][0].as_py())

        found = entries.groupBy(*keys).cogroup(shift.groupBy(*keys)).applyInArrow(shifted, schema)
    tall = found.select(*by, F.posexplode(F.arrays_zip(*_FIELDS)).alias("_r", "e")).select(*by, (F.col("_r") + 1).cast("long").alias("replicate"), "e.*")
    sums = tall.groupBy(*by, "replicate").agg(*[F.sum(n).alias(n) for n in _FIELDS])

    def metric(side: str, name: str) -> Column:
        p, n = F.col(f"{side}_pos"), F.col(f"{side}_neg")
        return F.when((p > 0) & (n > 0), F.col(f"{side}_ap") / p if name == "auprc" else 1.0 - F.col(f"{side}_above") / (p * n))

    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric_name"), metric("m", n).alias("model_metric"), metric("b", n).alias("baseline_metric")) for n in ("auprc", "auroc")])).alias("e")
    return sums.select(*by, "replicate", pairs).select(*by, "replicate", "e.*")


def weighted_means(same: DataFrame, groups: tuple[str, str], replicates: int, seed: int) -> DataFrame:
    """Poisson-weighted means of two groups per replicate: replicate, first, second. ``same``: cells of _g, _v with _key, _count."""
    def run(batches):
        a, b = constants(seed, replicates)
        sums = np.zeros((4, replicates))
        for batch in batches:
            g, v, key, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for at in range(0, len(v), ROWS):
                part = slice(at, at + ROWS)
                for lo in range(0, replicates, CHUNK):
                    w = draws("poisson", key[part], count[part], a[lo:lo + CHUNK], b[lo:lo + CHUNK])
                    for i, name in enumerate(groups):
                        on = (g[part] == name).astype(float)
                        sums[2 * i, lo:lo + CHUNK] += (on * v[part]) @ w
                        sums[2 * i + 1, lo:lo + CHUNK] += on @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1)), *map(pa.array, sums)], ["replicate", "s1", "n1", "s2", "n2"])

    found = same.filter("_v is not null").select("_g", F.col("_v").cast("double"), "_key", "_count").mapInArrow(run, "replicate long, s1 double, n1 double, s2 double, n2 double")
    sums = found.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("s1", "n1", "s2", "n2")])
    return sums.select("replicate", F.try_divide("s1", "n1").alias("first"), F.try_divide("s2", "n2").alias("second"))


def _log_factorial(x: np.ndarray) -> np.ndarray:
    small = np.cumsum(np.log(np.maximum(np.arange(32.0), 1)))
    y = np.maximum(x, 32.0)
    series = (y + 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return np.where(x < 32, small[np.clip(x, 0, 31).astype(int)], series)


def hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: np.ndarray) -> np.ndarray:
    """How many of ``good`` are among ``sample`` rows of all ``good + bad``, for each replicate.

    Beyond numpy's limit: few rows are drawn one by one, more by a ratio of uniforms under the same weights.
    """
    if good < NUMPY_LIMIT and bad < NUMPY_LIMIT:
        return draw.hypergeometric(good, bad, sample)
    total = good + bad
    flipped = sample > total - sample  # the rows left out are a sample as well
    m = np.where(flipped, total - sample, sample)
    out = np.zeros(len(sample), np.int64)
    few = m < 16
    for i in range(int(m[few].max(initial=0))):
        out += few & (i < m) & (draw.random(len(m)) * (total - i) < good - out)
    least, most = min(good, bad), max(good, bad)
    left = np.flatnonzero(~few)
    share = least / total
    while len(left):
        n = m[left].astype(float)
        mean = n * share
        spread = np.sqrt((total - n) * n * share * (1 - share) / (total - 1) + 0.5)
        width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
        weight = lambda k: -(_log_factorial(k) + _log_factorial(least - k) + _log_factorial(n - k) + _log_factorial(most - n + k))  # noqa: B023, E731
        mode = np.floor((n + 1) * (least + 1) / (total + 2))
        u, v = 1 - draw.random(len(left)), draw.random(len(left))
        k = np.floor(mean + 0.5 + width * (v - 0.5) / u)
        inside = (k >= np.maximum(0, n - most)) & (k <= np.minimum(n, least))
        safe = np.where(inside, k, mode)
        taken = inside & (2 * np.log(u) <= weight(safe) - weight(mode))
        out[left[taken]] = safe[taken] if good <= bad else n[taken] - safe[taken]
        left = left[~taken]
    return np.where(flipped, good - out, out)


def tree_shares(totals: np.ndarray, sample: np.ndarray, seed: tuple, only: int | None = None) -> np.ndarray:
    """How many of the sample fall to each part (rows: parts), or to part ``only``: halves split by hypergeometric draws.

    A node's draws depend on the seed and the node alone, so every task walks to its own part and agrees with all others.
    """
    ahead = np.concatenate([[0], np.cumsum(totals)])
    out = np.zeros((len(totals), len(sample)) if only is None else len(sample), np.int64)
    todo = [(1, 0, len(totals), sample)]
    while todo:
        node, low, high, share = todo.pop()
        if high - low == 1:
            if only is None:
                out[low] = share
            else:
                out = share
            continue
        mid = (low + high) // 2
        left = hypergeometric(np.random.default_rng([*seed, node]), int(ahead[mid] - ahead[low]), int(ahead[high] - ahead[mid]), share)
        if only is None or only < mid:
            todo.append((2 * node, low, mid, left))
        if only is None or only >= mid:
            todo.append((2 * node + 1, mid, high, share - left))
    return out


def subset_of(value: np.ndarray, key: np.ndarray, count: np.ndarray, sample: np.ndarray, seed: int, block: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of values over a random subset of ``sample`` rows of the cells, per replicate.

    Heavy cells take their part of the subset and share it by a tree; each row of a cell of at most ``LIGHT`` rows has a number of
    its own, and the smallest numbers are taken.
    """
    light = count <= LIGHT
    heavy = np.flatnonzero(~light)
    out, rest = np.zeros(len(sample)), sample
    n_light = int(count[light].sum())
    if len(heavy):
        many = int(count[heavy].sum())
        own = hypergeometric(np.random.default_rng([seed, block, 0]), many, n_light, sample)
        rest = sample - own
        for lo in range(0, len(sample), CHUNK):
            share = tree_shares(count[heavy], own[lo:lo + CHUNK], (seed, block, 1 + lo))
            out[lo:lo + CHUNK] += value[heavy] @ share
    if n_light:
        v, k = np.repeat(value[light], count[light]), np.repeat(key[light], count[light])
        k = (k + (np.arange(len(v)) - np.repeat(np.cumsum(count[light]) - count[light], count[light])) * ITEM_STEP) % PRIME
        order = np.argsort(k, kind="stable")
        v, k = v[order], k[order]
        for r in range(len(sample)):
            z = numbers(k, a[r:r + 1], b[r:r + 1])[:, 0]
            out[r] += v[np.argsort(z, kind="stable")[:rest[r]]].sum()
    return out


def subset_sums(same: DataFrame, size: int, total: int, replicates: int, seed: int) -> DataFrame:
    """Sum of ``_v`` over a random subset of ``size`` of the ``total`` rows per replicate: replicate, subset_sum.

    ``same``: cells of _v with _key and _count. Cells are dealt into blocks by key; a tree of hypergeometric draws
    splits each replicate's subset over the blocks, so every subset is as likely as any other, at any total.
    """
    same = materialize(same.select(F.col("_v").cast("double").alias("_v"), "_key", "_count"))
    weight = same.agg(F.count("*"), F.sum(F.when(F.col("_count") <= LIGHT, F.col("_count")).otherwise(1))).first()
    blocks = max(1, -(-int(weight[1] or 0) * replicates // TASK_CELLS))
    dealt = same.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int"))
    counts = {r["_block"]: int(r["n"]) for r in dealt.groupBy("_block").agg(F.sum("_count").alias("n")).collect()}  # one number a block
    totals = np.array([counts.get(i, 0) for i in range(blocks)], np.int64)

    def work(table: pa.Table) -> pa.Table:
        a, b = constants(seed, replicates)
        v, key, count = (table[c].to_numpy() for c in ("_v", "_key", "_count"))
        order = np.lexsort((v, key))
        block = table["_block"][0].as_py()
        share = tree_shares(totals, np.full(replicates, size, np.int64), (seed, blocks), block)
        return pa.table({"replicate": np.arange(1, replicates + 1), "s": subset_of(v[order], key[order], count[order], share, seed, block, a, b)})

    found = dealt.groupBy("_block").applyInArrow(work, "replicate long, s double")
    return found.groupBy("replicate").agg(F.sum("s").alias("subset_sum"))
