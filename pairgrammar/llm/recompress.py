"""Long passages that repeat across documents, by recompression: equal words are parsed into equal symbols, whatever is around."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgrammar.llm.common import map_texts, small_batches
from pairgrammar.llm.jaccard import _Hashes

WINDOW = 13
STEM = 10  # words that name a window without a symbol of its own; the rest verify it
SLICE_WORDS = 1 << 19  # words parsed at once
CHUNK_WORDS = 1 << 18  # longer texts are parsed in overlapping chunks
PART_BYTES = 24 << 20  # bytes of text whose symbols meet in one task, about
NEVER = np.iinfo(np.int64).max  # the order of a null key: after all others
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
FIELDS = "part int, done boolean, rank array<long>, ident array<long>, at array<int>, shape array<int>, key array<long>, rest array<short>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Names:
    """Number of any range of a word sequence: equal ranges have equal numbers, wherever they lie."""

    def __init__(self, words: np.ndarray) -> None:
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(_BASE, len(words)), dtype=np.uint64)])
        self.back = powers(_BACK, len(words) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def split_round(name: np.ndarray) -> np.ndarray:
    """Where a new symbol begins once runs of one symbol, and then pairs of a left and a right symbol, are each one symbol.

    A symbol is left or right by a bit of its name, so pairs cannot overlap, and whether two
    neighbours part depends on their names alone.
    """
    right = (mixed(name) >> np.uint64(63)).astype(bool)
    cut = np.ones(len(name), bool)
    cut[1:] = (name[1:] != name[:-1]) & ~(~right[:-1] & right[1:])
    return cut


def parse(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, first and past-last word of what settles each symbol, after two rounds of runs and pairs.

    A symbol of the second round is settled by itself, the first-round symbol on either side and one
    more word on either side: where these words come again, the symbol comes again at the same place.
    Its name is the number of these words with its own place and size among them.
    """
    n, names = len(words), Names(words)
    low = np.flatnonzero(split_round(words))
    low_end = np.append(low[1:], n)
    top = np.flatnonzero(split_round(names.of(low, low_end)))  # places among the first-round symbols
    top_end = np.append(top[1:], len(low))
    inner = (top > 0) & (top_end < len(low))
    inner[inner] = (low[top[inner] - 1] > 0) & (low_end[top_end[inner]] < n)
    top, top_end = top[inner], top_end[inner]
    first, past = low[top - 1] - 1, low_end[top_end] + 1
    own = (low[top] - first).astype(np.uint64) << np.uint64(32) | (low[top_end] - first).astype(np.uint64)
    return mixed(names.of(first, past) ^ own), first, past


def stretch(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of start, start + 1, ... (``count`` of each) in a row, and the place each comes from."""
    owner = np.repeat(np.arange(len(start)), count)
    return start[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner], owner


def anchors(words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window's anchor, as key, first window, number of windows, words before the settling ones, and how many settle.

    A window is known by the symbol with the least name among those that its own words settle; equal
    windows so have equal anchors at equal places. Neighbouring windows mostly share one. A window
    that settles no symbol, as in long runs, is an anchor by itself: its first ``STEM`` words.
    """
    name, first, past = parse(words)
    before = np.cumsum(np.bincount(first + 1, minlength=len(words) + 2))  # symbols whose settling words start earlier
    within = np.cumsum(np.bincount(past, minlength=len(words) + 2))
    low, high = before[start], within[start + WINDOW]
    best, some = low.copy(), high > low
    value = np.zeros(len(start), np.uint64)
    value[some] = name[low[some]]
    ask, step = np.flatnonzero(high > low + 1), 1
    while len(ask):
        other = name[low[ask] + step]
        better = other < value[ask]
        best[ask[better]], value[ask[better]] = low[ask[better]] + step, other[better]
        step += 1
        ask = ask[high[ask] > low[ask] + step]
    at, pick = start[some], best[some]
    new = np.ones(len(pick), bool)
    new[1:] = pick[1:] != pick[:-1]
    head = np.flatnonzero(new)
    count, symbol = np.diff(np.append(head, len(pick))), pick[head]
    alone = start[~some]
    key = np.concatenate([name[symbol], mixed(Names(words).of(alone, alone + STEM) + np.uint64(1))])
    begin = np.concatenate([at[head], alone])
    count = np.concatenate([count, np.ones(len(alone), np.int64)])
    left = np.concatenate([first[symbol] - at[head], np.zeros(len(alone), np.int64)])
    size = np.concatenate([past[symbol] - first[symbol], np.full(len(alone), STEM, np.int64)])
    order = np.argsort(begin, kind="stable")
    return key[order], begin[order], count[order], left[order], size[order]


def repeated(key: np.ndarray) -> np.ndarray:
    """Places of keys that come more than once."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    same[:-1] |= same[1:]
    return order[same]


def taken(window: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows come in a document of a smaller rank as well."""
    order = np.lexsort((rank, window))
    new = np.ones(len(window), bool)
    new[1:] = window[order[1:]] != window[order[:-1]]
    least = rank[order[np.maximum.accumulate(np.where(new, np.arange(len(window)), 0))]]
    out = np.zeros(len(window), bool)
    out[order] = rank[order] > least
    return out


def joined(place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one owner: first window, words covered, owner."""
    new = np.ones(len(place), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    return place[head], np.diff(np.append(head, len(place))) + WINDOW - 1, owner[head]


def summarise(words: list[np.ndarray], rank: np.ndarray, ident: np.ndarray, base: np.ndarray, parts: int) -> list[pa.RecordBatch]:
    """What a slice of texts sends: a row of lists for each part, and the windows that the slice itself decides.

    Of a window that comes in several documents of the slice only the smallest document's is sent, as all
    others are known to be taken: a passage of any number of copies sends one row a slice.
    """
    size = np.array([len(w) for w in words])
    flat = np.concatenate([np.append(w, np.uint64(0)) for w in words])
    start = np.cumsum(size + 1) - size - 1
    windows, _ = stretch(start, np.maximum(size - WINDOW + 1, 0))
    key, begin, count, left, width = anchors(flat, windows)
    owner = np.searchsorted(start, begin, "right") - 1
    place = (begin - start[owner] + base[owner]).astype(np.int32)
    out, sends = [], np.ones(len(key), bool)
    again = np.sort(repeated(key))
    if len(again):
        spot, of = stretch(begin[again], count[again])
        of = again[of]
        gone = taken(mixed(Names(flat).of(spot, spot + WINDOW) ^ key[of]), rank[owner[of]])
        sends[again] = False
        sends[of[~gone]] = True
        at, covered, of = joined(spot[gone], owner[of[gone]])
        if len(at):
            cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(at))
            who = of[cut[:-1]]
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, t))
            none = lambda t: pa.nulls(len(who), pa.list_(t))
            deal = (mixed(ident[who].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(deal), pa.array([True] * len(who)), lists(rank[of], pa.int64()), lists(ident[of], pa.int64()), lists((at - start[of] + base[of]).astype(np.int32), pa.int32()),
                 lists(covered.astype(np.int32), pa.int32()), none(pa.int64()), none(pa.int16())], NAMES))
    keep = np.flatnonzero(sends)
    part = (key[keep] % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    keep, part = keep[order], part[order]
    if not len(keep):
        return out
    more = count[keep] + WINDOW - 1 - width[keep]  # words beside the settling ones
    spot, of = stretch(np.zeros(len(keep), np.int64), more)
    rest = (flat[begin[keep][of] + spot + np.where(spot < left[keep][of], 0, width[keep][of])] >> np.uint64(48)).astype(np.uint16).view(np.int16)
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(keep))
    ends = np.concatenate([[0], np.cumsum(more)])[cut]
    lists = lambda x, t, c=cut: pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(x, t))
    own = owner[keep]
    shape = (count[keep] << 16 | left[keep] << 8 | width[keep]).astype(np.int32)
    out.append(pa.RecordBatch.from_arrays(
        [pa.array(part[cut[:-1]]), pa.array([False] * (len(cut) - 1)), lists(rank[own], pa.int64()), lists(ident[own], pa.int64()), lists(place[keep], pa.int32()),
         lists(shape, pa.int32()), lists(key[keep].view(np.int64), pa.int64()), lists(rest, pa.int16(), ends)], NAMES))
    return out


NAMES = ["part", "done", "rank", "ident", "at", "shape", "key", "rest"]


def judge(rank: np.ndarray, ident: np.ndarray, place: np.ndarray, shape: np.ndarray, key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Taken ranges (rank, ident, first word, words) of the anchors of one part: shared names reveal, the words around them verify."""
    count, left, width = shape >> 16, shape >> 8 & 255, shape & 255
    more = count + WINDOW - 1 - width
    offset = np.cumsum(more) - more
    again = np.sort(repeated(key))
    again = again[np.lexsort((place[again], ident[again], rank[again]))]
    step, of = stretch(np.zeros(len(again), np.int64), count[again])
    of = again[of]
    window = key[of].view(np.uint64)
    around = rest.view(np.uint16).astype(np.uint64) + np.uint64(1)
    for i in range(WINDOW):  # the words beside the settling ones, from the window's own first
        has = step + i < step + WINDOW - width[of]
        spot = offset[of[has]] + step[has] + i
        window[has] = mixed(window[has] + around[spot])
    # a window that starts later has fewer words before the settling ones: that number is part of what it is
    window = mixed(window ^ (left[of] - step).astype(np.uint64) << np.uint64(56))
    gone = taken(window, rank[of])
    at, covered, of = joined(place[of[gone]] + step[gone], of[gone])
    return rank[of], ident[of], at, covered


def taken_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """``ident``, ``rank``, ``start``, ``words``: ranges of taken windows of the rows (``rank``, ``ident``, ``text``)."""
    def run(batches):
        hashes = _Hashes()
        held, total = [], 0

        def flush():
            words, rank, ident, base = zip(*held)
            yield from summarise(list(words), np.array(rank, np.int64), np.array(ident, np.int64), np.array(base, np.int64), parts)

        for batch in batches:
            for rank, ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                found = (text.as_py() or b"").split()
                if len(found) < WINDOW:
                    continue
                words = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
                for base in range(0, len(words) - WINDOW + 1, CHUNK_WORDS):
                    held.append((words[base:base + CHUNK_WORDS + WINDOW - 1], rank, ident, base))
                    total += len(held[-1][0])
                    if total >= SLICE_WORDS:
                        yield from flush()
                        held, total = [], 0
                        pa.default_memory_pool().release_unused()
        if held:
            yield from flush()

    def decide(group: pa.Table) -> pa.Table:
        flat = lambda rows, c: pa.chunked_array(rows.column(c)).combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
        done, open_ = group.filter(group.column("done")), group.filter(pa.compute.invert(group.column("done")))
        found = [[flat(done, c) for c in ("rank", "ident", "at", "shape")]]
        if open_.num_rows:
            found.append(judge(*[flat(open_, c) for c in ("rank", "ident", "at")], flat(open_, "shape").astype(np.int64), flat(open_, "key"), flat(open_, "rest")))
        rank, ident, at, words = (np.concatenate(c) for c in zip(*found))
        return pa.table({"rank": pa.array(rank, pa.int64()), "ident": pa.array(ident, pa.int64()), "start": pa.array(at, pa.int32()), "words": pa.array(words, pa.int32())})

    sent = docs.select("rank", "ident", "text").mapInArrow(run, FIELDS)
    return sent.groupBy("part").applyInArrow(decide, "rank long, ident long, start int, words int")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_removed``, ``kept_sha256`` of every row; ``kept`` holds the words that stay, one blank between.

    Words are cut at blank and tab to carriage return. A word goes if a run of ``WINDOW`` words over it also starts in
    a document of a smaller key; runs are judged on the input.

    Every round names runs of a symbol and pairs of a left and a right symbol; the names are numbers of what they stand
    for, so that all tasks name alike. Symbols of the second round, with what settles them, are dealt by name; those
    that are shared reveal candidates, whose other words verify each window (a name of 64 bits and 16 bits for each of
    at least three words beside it). One exchange decides all windows; a second one takes the ranges to the texts.

    Null and empty texts have no words. A null key is larger than all and takes nothing from equal ones; rows that
    repeat a key take nothing from each other. Texts of any length are parsed whole, in overlapping chunks. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(int(NEVER))).alias("rank"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("ident", F.xxhash64("key", "text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = taken_ranges(rows, max(1, -(-size // PART_BYTES)))
    ranges = ranges.groupBy("ident", "rank").agg(F.collect_set(F.shiftleft(F.col("start").cast("long"), 32) + F.col("words")).alias("gone"))
    found = rows.join(ranges, ["ident", "rank"], "left").select("key", "gone", "text")

    def run(batches):
        for batch in batches:
            counts, removed, digests, kept = [], [], [], []
            for gone, value in zip(batch.column(1), batch.column(2).cast(pa.binary())):
                words = value.as_py().split()
                counts.append(len(words))
                if gone.is_valid:
                    code = gone.values.to_numpy()
                    start, change = code >> 32, np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + (code & 0xFFFFFFFF), -1)
                    stays = np.cumsum(change)[:-1] == 0
                    words = [words[i] for i in np.flatnonzero(stays)]
                kept.append(b" ".join(words))
                removed.append(counts[-1] - len(words))
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])
    return found.mapInArrow(run, schema).withColumnRenamed("key", key)
