"""Benchmark passages in documents: q-gram lemma filter in diagonal bands, banded alignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgrammar.llm.common import map_texts
from pairgrammar.session import scratch_path

Q = 8  # a power of two, for doubling the hash
EDITS = 0.1  # edits a character of the item
ITEM_CHARS = 4 << 20  # characters of the items that travel with one pass
_BASE = 0x9E3779B97F4A7C15
_BLOOM_BITS = 22
MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("end_char", T.LongType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("end_char", pa.int64())]))


def canonical(text: str) -> str:
    """Lower case, one blank for white space."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters from each position, by doubling."""
    h, size, power = chars.astype(np.uint64) + np.uint64(1), 1, _BASE
    while size < q:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % 2**64
        size *= 2
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _BLOOM_BITS)


def budget(size: int, q: int = Q, rate: float = EDITS) -> int:
    """Edits allowed in a passage: the rate, or as many as leave one shared q-gram for sure."""
    return max(0, min(int(size * rate), (size - q) // q))


def index(items: list[tuple[int, str]], q: int = Q, rate: float = EDITS) -> dict:
    """Q-grams of all items in hash order, with item and position. Items under q characters are left out."""
    kept = [(i, x) for i, x in ((i, codes(canonical(t))) for i, t in items) if len(x) >= q]
    grams = [gram_hashes(x, q) for _, x in kept]
    flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    size = np.array([len(x) for _, x in kept], np.int64)
    edits = np.array([budget(n, q, rate) for n in size], np.int64)
    bloom = np.zeros(1 << _BLOOM_BITS, bool)
    bloom[_slot(flat)] = True
    return {
        "q": q, "ids": [i for i, _ in kept], "chars": [x for _, x in kept], "size": size, "edits": edits,
        "step": np.maximum(16, edits + 1), "least": size - q + 1 - edits * q, "bloom": bloom, "hash": flat[order],
        "item": np.repeat(np.arange(len(kept)), [len(g) for g in grams])[order],
        "at": (np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64))[order]}


def banded_edits(item: np.ndarray, windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between the item and a stretch of each window, and where in the window it ends.

    Cell (i, e) pairs the item's first i characters with a stretch that ends at i + e; only the
    diagonals 0 <= e < width are kept. The stretch may start on any of them.
    """
    cost = np.zeros((len(windows), width), np.int32)
    ramp = np.arange(width, dtype=np.int32)
    for i, c in enumerate(item):
        new = cost + (windows[:, i:i + width] != c)
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
    best = cost.argmin(axis=1)
    return cost[np.arange(len(windows)), best], best + len(item)


def find(texts: list[bytes | None], model: dict) -> list[list[dict]]:
    """For each text the items it holds within their edit budgets, with the fewest edits and the end of that passage."""
    out: list[list[dict]] = [[] for _ in texts]
    clean = [canonical(t.decode("utf-8", "replace")) if t else "" for t in texts]
    q = model["q"]
    if not len(model["hash"]) or not any(clean):
        return out
    gap = "\x00" * q
    chars = codes(gap.join(clean) + gap)
    sizes = np.array([len(t) for t in clean], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + q)[:-1]])
    grams = gram_hashes(chars, q)
    place = np.flatnonzero(model["bloom"][_slot(grams)])
    low = np.searchsorted(model["hash"], grams[place], "left")
    runs = np.searchsorted(model["hash"], grams[place], "right") - low
    place, low, runs = place[runs > 0], low[runs > 0], runs[runs > 0]
    if not len(place):
        return out
    # one row for each shared q-gram: document, item, diagonal
    spot = np.repeat(low - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
    place = np.repeat(place, runs)
    doc = np.searchsorted(starts, place, "right") - 1
    item = model["item"][spot]
    shift = int(model["size"].max()) + 1
    diagonal = place - starts[doc] - model["at"][spot] + shift
    cell = diagonal // model["step"][item]
    pair = doc * len(model["ids"]) + item
    order = np.lexsort((cell, pair))
    pair, cell = pair[order], cell[order]
    head = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (cell[1:] != cell[:-1])]))
    count = np.diff(np.append(head, len(pair)))
    pair, cell = pair[head], cell[head]
    # a band is two neighbouring cells, so bands overlap by half and a passage lies whole in one
    both = count.copy()
    beside = np.flatnonzero((np.diff(cell) == 1) & (np.diff(pair) == 0))
    both[beside] += count[beside + 1]
    alone = np.ones(len(cell), bool)
    alone[beside + 1] = False
    pair, cell = np.concatenate([pair, pair[alone]]), np.concatenate([cell, cell[alone] - 1])
    both = np.concatenate([both, count[alone]])
    good = np.flatnonzero(both >= model["least"][pair % len(model["ids"])])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    groups: dict[int, list[tuple[int, int]]] = {}
    for i in good:
        d, x = divmod(int(pair[i]), len(model["ids"]))
        step = int(model["step"][x])
        start = int(cell[i]) * step - shift
        groups.setdefault(x, []).append((d, start))
    for x, found in groups.items():
        own, edits, step = model["chars"][x], int(model["edits"][x]), int(model["step"][x])
        width = 2 * step + 2 * edits
        windows = np.zeros((len(found), len(own) + width), np.uint32)
        for row, (d, start) in enumerate(found):
            start -= edits
            a, b = max(0, start), min(int(sizes[d]), start + windows.shape[1])
            if b > a:
                windows[row, a - start:b - start] = chars[starts[d] + a:starts[d] + b]
        for lo in range(0, len(found), 256):
            cost, end = banded_edits(own, windows[lo:lo + 256], width)
            for row in np.flatnonzero(cost <= edits):
                d, start = found[lo + row]
                value = (int(cost[row]), start - edits + int(end[row]))
                best[d, x] = min(best.get((d, x), value), value)
    for (d, x), (edits, end) in sorted(best.items()):
        out[d].append({"item_id": model["ids"][x], "edits": edits, "end_char": end})
    return out


def passes(items: DataFrame, item_id: str = "item_id", item_text: str = "text", rate: float = EDITS) -> list[Callable[[], dict]]:
    """Makers of the indexes of all items, each over at most about ``ITEM_CHARS`` characters, so what the driver holds and the tasks get is bounded."""
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    count = max(1, -(-total // ITEM_CHARS))

    def maker(part: DataFrame) -> Callable[[], dict]:
        return lambda: index(sorted((r["id"], r["text"]) for r in part.toLocalIterator()), rate=rate)

    return [maker(rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == n)) for n in range(count)]


def _screen(docs: DataFrame, shared, keep: list[str], text: str) -> DataFrame:
    def make():
        own = shared.value
        return lambda texts: [pa.array(find(texts, own), _ARROW)]

    return map_texts(docs, text, keep, [T.StructField("matches", MATCHES)], make)


def _one_by_one(docs: DataFrame, makers: list[Callable[[], dict]], work: Callable[[DataFrame, object], DataFrame], follow: bool) -> list[DataFrame]:
    """Results of all passes, each built, sent out, stored and released before the next one; one pass alone is not stored.

    With ``follow`` a pass works on what the one before it left.
    """
    spark, out = docs.sparkSession, []
    for make in makers:
        shared = spark.sparkContext.broadcast(make())
        found = work(docs, shared)
        if len(makers) > 1:
            path = scratch_path(spark, "decontaminated")
            found.write.parquet(path)
            shared.unpersist()
            found = spark.read.parquet(path)
        docs = found if follow else docs
        out.append(found)
    return out


def contaminated(docs: DataFrame, makers: list[Callable[[], dict]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item it holds: the key, ``item_id``, ``edits``, ``end_char``.

    A document holds an item if some stretch of it, whole texts compared in lower case with one blank
    for white space, is within ``EDITS`` edits a character of the item. Items that are null, have a
    null id or fewer than ``Q`` characters match nothing; null and empty documents hold nothing;
    repeated rows are judged alike, and so are null keys. ``end_char`` counts the compared text. An empty table gives no rows.
    """
    def work(rows: DataFrame, shared) -> DataFrame:
        return _screen(rows, shared, [key], text).where(F.size("matches") > 0).select(F.col(f"row.{key}"), F.inline("matches"))

    found = _one_by_one(docs, makers, work, False)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def uncontaminated(docs: DataFrame, makers: list[Callable[[], dict]], text: str = "text") -> DataFrame:
    """The documents that hold no item (see ``contaminated``), with all their columns."""
    columns = docs.columns
    return _one_by_one(docs, makers, lambda rows, shared: _screen(rows, shared, columns, text).where(F.size("matches") == 0).select("row.*"), True)[-1]
