"""The tree of ``suffixtree`` over a large corpus: chunks of numbered words ask for the counts they need.

Texts are cut into words once and kept as chunks: the words' numbers, and a dictionary of their hashes. Whatever a
chunk must know of the whole corpus (how often a word, or a word after a context, was learned; what stays of a
context) it asks by key, once for each distinct key. Keys are dealt to parts by hash, a part adds up what the
chunks send and answers each of them. Chunks and answers are bucketed alike, so neither texts nor
places are exchanged; only keys and counts are, and nothing that grows with the corpus is gathered or broadcast.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgrammar.llm import suffixtree as st
from pairgrammar.llm.common import slices
from pairgrammar.session import leaf_bytes, scratch_path

CHUNK = 3 << 19  # tokens of a chunk; more only if one text has more
PART_KEYS = 1 << 21  # tokens for each part of the keys
BUCKET_BYTES = 4 << 20  # input for each bucket of chunks
# kinds of questions: counts of words, of classes after d classes (CLASS + d), of words after d words (LONGER + d), what stays of contexts of d words (KEPT + d)
WORDS, CLASS, LONGER, KEPT = 0, 0, 10, 20
PIECE = 1 << 21  # bytes of text that are cut into words at once; more only for a longer word
_SPREAD, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_LETTER = np.random.default_rng(64).integers(1, 1 << 64, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95 ^ 6  # leaves 3 by 4: then 1 - base has the least factors of 2


def planes(x: np.ndarray) -> bytes:
    """Numbers (not negative) byte by byte: the lowest bytes of all, then the next; high bytes pack to nothing."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """The partition of ``buckets`` to which Spark deals a long."""
    def turned(v, by):
        return v << np.uint32(by) | v >> np.uint32(32 - by)

    h = np.full(len(x), 42, np.uint32)
    for word in (x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF):
        h ^= turned(word.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for by, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> np.uint32(by)) * np.uint32(times)
    return h.view(np.int32).astype(np.int64) % buckets


def named_for(bucket: int, buckets: int, start: int = 0) -> int:
    """A number from ``start`` on that Spark deals to a bucket."""
    while True:
        hit = np.flatnonzero(bucket_of(np.arange(start, start + 8 * buckets), buckets) == bucket)
        if len(hit):
            return start + int(hit[0])
        start += 8 * buckets


def by_hash(keys: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and the sorted keys. ``shift``: leading bits that are alike in most of them.

    Numbers sort much faster than places do, so the place stands in a key's low bits; the few
    keys that differ in no other bits are put right afterwards.
    """
    low = np.uint64(max(1, len(keys) - 1).bit_length())
    top = (keys << np.uint64(shift)) >> low << low | np.arange(len(keys), dtype=np.uint64)
    top.sort()
    order = (top & (np.uint64(1) << low) - np.uint64(1)).astype(np.int64)
    ranked = keys[order]
    wrong = np.flatnonzero(ranked[1:] < ranked[:-1])
    if len(wrong) > 1000:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    top >>= low
    for i in wrong.tolist():
        lo, hi = np.searchsorted(top, top[i], "left"), np.searchsorted(top, top[i], "right")
        order[lo:hi] = order[lo:hi][np.argsort(keys[order[lo:hi]], kind="stable")]
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
    return order, ranked


def distinct(keys: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and each one's place among them."""
    order, ranked = by_hash(keys, shift)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    spot = np.empty(len(keys), np.int32)
    spot[order] = np.cumsum(fresh) - 1
    return ranked[fresh], spot


def grouped(own: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair's place among the distinct ones, and for each of these a place where it stands."""
    size = [max(1, int(x.max(initial=0))).bit_length() for x in (own, symbol)] + [max(1, len(own) - 1).bit_length()]
    if sum(size) <= 64:
        pair = own.astype(np.uint64) << np.uint64(size[1] + size[2]) | symbol.astype(np.uint64) << np.uint64(size[2]) | np.arange(len(own), dtype=np.uint64)
        pair.sort()
        order = (pair & np.uint64((1 << size[2]) - 1)).astype(np.int64)
        pair >>= np.uint64(size[2])
    else:
        order = np.lexsort((symbol, own))
        pair = np.zeros(len(own), np.uint64)
        pair[1:] = np.cumsum((own[order][1:] != own[order][:-1]) | (symbol[order][1:] != symbol[order][:-1]))
    fresh = np.ones(len(pair), bool)
    fresh[1:] = pair[1:] != pair[:-1]
    spot = np.empty(len(pair), np.int32)
    spot[order] = np.cumsum(fresh) - 1
    return spot, order[fresh]


class Finder:
    """Where numbers stand in a sorted list; most are found by one look into a table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.shift = keys, np.uint64(64 - min(24, max(10, len(keys).bit_length() + 3)))
        slot = self._slot(keys)
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.table[slot] = np.arange(len(keys), dtype=np.int32)
        self.shared = np.zeros(len(self.table), bool)
        self.shared[slot[self.table[slot] != np.arange(len(keys))]] = True

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """-1 for what is not there."""
        if not len(self.keys):
            return np.full(len(asked), -1, np.int32)
        slot = self._slot(asked)
        spot = self.table[slot]
        hit = np.flatnonzero(spot >= 0)
        other = hit[self.keys[spot[hit]] != asked[hit]]
        spot[other] = -1
        again = other[self.shared[slot[other]]]
        place = np.minimum(np.searchsorted(self.keys, asked[again]), len(self.keys) - 1)
        spot[again] = np.where(self.keys[place] == asked[again], place, -1)
        return spot


class Cutter:
    """Cuts texts into words as ``tokens`` does: a hash of each word's bytes, and its last three bytes below their number, 4 at most."""

    def __init__(self) -> None:
        self.power = self.back = np.zeros(0, np.uint64)

    def cut(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and tail of all words in a row, and how many each text has."""
        data = b" ".join([b"", *[t or b"" for t in texts], b""]).lower()
        bounds = np.cumsum([1] + [len(t or b"") + 1 for t in texts])
        found, at = [], 0
        while at < len(data) - 1:
            end = len(data) - 1
            if end - at > PIECE:
                end = re.compile(rb"[ \t-\r]").search(data, at + PIECE).start()
            found.append((at, *self._words(np.frombuffer(data, np.uint8, end + 1 - at, at))))
            at = end
        start = np.concatenate([f[1] + f[0] for f in found])
        return np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found]), np.diff(np.searchsorted(start, bounds))

    def _words(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(x) > len(self.power):
            self.power, self.back = [np.multiply.accumulate(np.full(len(x), b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        blank = _BLANK[x]  # at both ends
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        sums = np.cumsum(_LETTER[x] * self.power[:len(x)])
        h = st._mixed((sums[end - 1] - sums[start - 1]) * self.back[start])
        size, last = np.minimum(end - start, 4), x.astype(np.int32)
        tail = last[end - 1] | np.where(size > 1, last[end - 2] << 8, 0) | np.where(size > 2, last[np.maximum(end - 3, 0)] << 16, 0) | size.astype(np.int32) << 24
        return start, h, tail.astype(np.int32)


def _cut(tail: np.ndarray, size: int) -> np.ndarray:
    """Tails of at most ``size`` bytes."""
    return np.where(tail >> 24 > size, size << 24 | tail & (1 << 8 * size) - 1, tail)


def make_chunks(rows: DataFrame, buckets: int) -> DataFrame:
    """Texts (``key``, ``held_out``, ``text``) as chunks: one row holds many texts, each word as its place in the chunk's sorted hashes."""
    def run(batches):
        at, k, cutter = TaskContext.get().partitionId(), 0, Cutter()
        words, sizes, held, keys, count = [], [], [], [], 0

        def chunk():
            nonlocal k
            h, rank = distinct(np.concatenate([w[0] for w in words]))
            tail = np.zeros(len(h), np.int32)
            tail[rank] = np.concatenate([w[1] for w in words])
            counts = np.bincount(rank[np.repeat(~np.array(held, bool), np.concatenate(sizes))], minlength=len(h))
            # a task's chunks go to buckets side by side
            name = named_for((3 * at + k) % buckets, buckets, at << 40 | k << 24)
            k += 1
            values = pa.chunked_array(keys).combine_chunks()
            values = values if isinstance(values, pa.Array) else values.chunk(0)
            return pa.RecordBatch.from_arrays([
                pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.array([len(rank)]), pa.array([sum(not x for x in held)]),
                *[pa.array([x], pa.binary()) for x in (planes(rank), planes(np.concatenate(sizes)), planes(np.array(held, np.int64)), h.tobytes(), planes(tail), planes(counts))]],
                ["chunk", "keys", "tokens", "texts", "ids", "sizes", "held", "h", "tail", "counts"])

        for batch in batches:
            for part, texts in slices(batch, batch.column(2)):
                keys.append(part.column(0))
                held += part.column(1).to_pylist()
                *own, size = cutter.cut(texts)
                words.append(own)
                sizes.append(size)
                count += len(own[0])
                if count >= CHUNK:
                    yield chunk()
                    words, sizes, held, keys, count = [], [], [], [], 0
        if keys:
            yield chunk()

    kind = T.ArrayType(rows.schema["key"].dataType)
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("keys", kind), T.StructField("tokens", T.LongType()), T.StructField("texts", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("ids", "sizes", "held", "h", "tail", "counts")]])
    return rows.select("key", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Bucketed:
    """Tables in buckets by chunk, so that they are joined where they lie."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.names = spark, buckets, []

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        self.names.append(f"{name}_{uuid.uuid4().hex}")
        rows.write.format("parquet").bucketBy(self.buckets, "chunk").option("path", scratch_path(self.spark, name)).option("compression", "zstd").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def drop(self) -> None:
        """Forget the names; the files lie in the scratch folder like all others."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


class Classes:
    """``suffixtree.Classes`` by hash and tail."""

    def __init__(self, groups: list[np.ndarray]) -> None:
        self.groups, self.first = [np.sort(g) for g in groups], np.cumsum([st.OTHER + 1, *map(len, groups)])
        self.size = int(self.first[-1])

    def of(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        kind = np.full(len(h), st.OTHER, np.int64)
        for group, first, asked in reversed(list(zip(self.groups, self.first, (h, _cut(tail, 3), _cut(tail, 2), _cut(tail, 1))))):
            spot = st.lookup(group, np.arange(first, first + len(group)), asked)
            kind = np.where(spot >= 0, spot, kind)
        return kind


def find_classes(words: DataFrame, learned: int) -> Classes:
    """As ``suffixtree.find_classes``, of rows of ``h``, ``tail`` and ``learned``."""
    least = max(20.0, learned * st.CLASS_SHARE)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                h, tail, n = np.frombuffer(row["h"], np.uint64), unplaned(row["tail"]).astype(np.int64), unplaned(row["n"]).astype(np.int64)
                often = n >= least
                end, at = np.unique(_cut(tail[~often & (n > 0)], 3), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(int(often.sum()), np.int64), end])), pa.array(np.concatenate([h[often].view(np.int64), np.zeros(len(end), np.int64)])), pa.array(np.concatenate([n[often], np.bincount(at, n[~often & (n > 0)], len(end)).astype(np.int64)]))], ["end", "h", "n"])

    table = words.mapInArrow(run, "end long, h long, n long").groupBy("end", "h").agg(F.sum("n").alias("n")).toArrow()
    end, h, n = [table[c].to_numpy().astype(np.int64) for c in ("end", "h", "n")]
    groups = [h[end == 0].view(np.uint64)]
    end, n = end[end > 0], n[end > 0]
    for size in (3, 2, 1):
        end, at = np.unique(_cut(end, size), return_inverse=True)
        n = np.bincount(at, n, len(end))
        groups.append(end[n >= least])
        end, n = end[n < least], n[n < least]
    return Classes(groups)


class Chunk:
    """A chunk's places (start, words and end of each text in a row), and what was answered to it."""

    def __init__(self, row: dict) -> None:
        self.name, self.row = row["chunk"], row
        self.h, self.tail = np.frombuffer(row["h"], np.uint64), unplaned(row["tail"]).astype(np.int64)
        self.sizes, self.held = unplaned(row["sizes"]).astype(np.int64), unplaned(row["held"]).astype(bool)
        ids = unplaned(row["ids"]).astype(np.int32)
        full = self.sizes + 2
        self.first = np.cumsum(full) - full
        self.owner = np.repeat(np.arange(len(full), dtype=np.int32), full)
        self.place = np.arange(len(self.owner), dtype=np.int64) - self.first[self.owner]
        self.is_end = np.zeros(len(self.owner), bool)
        self.is_end[self.first + full - 1] = True
        self.word = (self.place > 0) & ~self.is_end
        self.learns = ~self.held[self.owner]
        self.id = np.zeros(len(self.owner), np.int32)
        self.id[self.word] = ids
        self.told = {}
        for table in [x for step, x in row.items() if step.startswith("a_") and x]:
            for x in sorted(table, key=lambda x: (x["kind"], x["part"])):
                self.told.setdefault(x["kind"], []).append((x["a"], x["b"]))

    def counts(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[unplaned(a).astype(np.int64) for a, _ in self.told.get(kind, [])]])

    def saved(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[np.frombuffer(b, np.float64) for _, b in self.told.get(kind, [])]])

    def symbols(self, classes: Classes) -> np.ndarray:
        out = np.where(self.is_end, st.END, st.START)
        out[self.word] = classes.of(self.h, self.tail)[self.id[self.word]]
        return out


class Level:
    """Contexts of ``depth`` words that come ``LEAST`` times, at their places in a chunk.

    ``at``: the places; ``total``: how often the context was learned; ``own``: the number of the
    context among ``contexts``, in their order; ``keys``: distinct contexts with the word that
    follows, sorted; ``spot``: the place's among them; ``n``: how often it was learned, once that is told.
    """

    def __init__(self, chunk: Chunk, below: Level | None) -> None:
        self.depth = below.depth + 1 if below else 1
        if below is None:
            self.contexts, count = chunk.h, chunk.counts(WORDS)
            at = np.flatnonzero(chunk.place > 1).astype(np.int32)
            own = chunk.id[at - 1]
        else:
            self.contexts, count = below.keys, below.told
            at = below.at[below.n >= st.LEAST]  # the word that ends the context
            own = below.spot[below.n >= st.LEAST]
            inside = chunk.word[at]
            at, own = at[inside] + 1, own[inside]
        self.count = count
        often = count[own] >= st.LEAST
        self.at, self.own = at[often], own[often]
        self.total = count[self.own]
        # what follows: a word's number, or one more than the last for the end
        symbol = np.where(chunk.is_end[self.at], np.int32(len(chunk.h)), chunk.id[self.at])
        spot, first = grouped(self.own, symbol)
        own, code = self.own[first], np.append(chunk.h, np.uint64(st.END))[symbol[first]]
        start = self.contexts[own] if below else st.lengthened(np.zeros(len(own), np.int64), chunk.h[own].view(np.int64)).view(np.uint64)
        order, self.keys = by_hash(st.lengthened(start.view(np.int64), code.view(np.int64)).view(np.uint64))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.spot = rank[spot]
        self.told = chunk.counts(LONGER + self.depth)
        self.n = self.told[self.spot] if len(self.told) else np.zeros(len(self.at), np.int64)

    def local(self, chunk: Chunk) -> np.ndarray:
        """How often each of ``keys`` comes in texts of the chunk that are learned from."""
        return np.bincount(self.spot[chunk.learns[self.at]], minlength=len(self.keys))

    def found(self, at: np.ndarray) -> np.ndarray:
        """Where places stand in ``at``; all of them do."""
        return np.searchsorted(self.at, at)

    def sums(self, chunk: Chunk, below: Level | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The contexts; for each the chunk's share of its distinct followers, and of the sum of n log(n / m), m being the suffix's count."""
        use = chunk.learns[self.at]
        own, n = self.own[use], self.n[use]
        which = np.flatnonzero(np.bincount(self.own, minlength=len(self.contexts)))
        kinds = np.bincount(own, 1 / n, len(self.contexts))[which]
        saved = np.bincount(own, np.log(n / below.n[below.found(self.at[use])]), len(self.contexts))[which] if below else np.zeros(len(which))
        return self.contexts[which], kinds, saved

    def kept(self, chunk: Chunk, below: Level | None) -> tuple[np.ndarray, np.ndarray]:
        """Which places have a context that stays, and the distinct followers of each place's context."""
        at = (np.cumsum(np.bincount(self.own, minlength=len(self.contexts)) > 0) - 1)[self.own]
        kinds, saved = chunk.counts(KEPT + self.depth), chunk.saved(KEPT + self.depth)
        if below is None:
            return np.ones(len(self.at), bool), kinds[at]
        # the context without its oldest word is the one that the newest word was read after
        suffix = below.total[below.found(self.at)]
        return saved[at] + self.total * np.log(suffix / self.total) >= st.GAIN, kinds[at]


def levels(chunk: Chunk, depth: int) -> list[Level]:
    out: list[Level] = []
    for _ in range(depth):
        out.append(Level(chunk, out[-1] if out else None))
    return out


def questions(chunk: Chunk, step: int, groups: list[np.ndarray], allowed: np.ndarray | None) -> Iterator[tuple]:
    """(kind, sorted keys, what the chunk knows of them twice) of each step but the one for words."""
    known = levels(chunk, min(step, st.DEPTH))
    if step <= st.DEPTH:
        yield LONGER + step, known[-1].keys, known[-1].local(chunk), None
    if step > 1:
        d = step - 1
        yield KEPT + d, *known[d - 1].sums(chunk, known[d - 2] if d > 1 else None)
    del known
    if step == 1 or step <= st.DEPTH and len(allowed):
        key, n = class_keys(chunk, groups, step, allowed)
        key = key.astype(np.uint64) * _SPREAD
        order = np.argsort(key)
        yield CLASS + step, key[order], n[order], None


def ask(chunks: DataFrame, step: int, bits: int, shared=None) -> DataFrame:
    """Rows of questions: one for each chunk, kind and part of the keys. ``shared``: the classes, and the contexts of classes to count."""
    if step == 0:
        chunks = chunks.select("chunk", "h", "tail", "counts")
    names = [named_for(i, 1 << bits) for i in range(1 << bits)]

    def run(batches):
        for row in each_row(batches):
            name = row["chunk"]
            if step:
                asked = questions(Chunk(row), step, *shared.value)
            else:
                asked = [(WORDS, np.frombuffer(row["h"], np.uint64), unplaned(row["counts"]), unplaned(row["tail"]))]
            del row
            for kind, keys, a, b in asked:
                edges = [0, *np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(keys)]
                out = []
                for i in range(1 << bits):
                    cut = slice(edges[i], edges[i + 1])
                    if edges[i] < edges[i + 1]:
                        pack = planes if kind < KEPT else lambda x: x.tobytes()
                        gaps = np.diff(keys[cut] - (np.uint64(i) << np.uint64(64 - bits)), prepend=np.uint64(0))
                        out.append((names[i], i, name, kind, planes(gaps), pack(a[cut]), None if b is None else pack(b[cut])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["name", "part", "chunk", "kind", "keys", "a", "b"])

    return chunks.drop("keys").mapInArrow(run, "name long, part int, chunk long, kind int, keys binary, a binary, b binary")


def each_row(batches) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            # keys of texts may be of any kind: they stay as they are
            yield {c: b.column(c)[i].as_py() if c != "keys" else b.column(c).slice(i, 1).flatten() for c in b.schema.names}


def answer(asked: DataFrame, bits: int) -> DataFrame:
    """Answers to the rows of ``ask``, dealt by part: the sums over all chunks, in the order of each question's keys.

    Of words also one row for each task (``chunk`` null) with their hashes, tails and counts; of classes
    nothing but such rows.
    """
    def run(batches):
        rows = [tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows)]
        rows.sort(key=lambda r: r[2:4] + r[1:2])  # sums of fractions shall not depend on the order of arrival
        for kind in sorted({r[3] for r in rows}):
            own = [r for r in rows if r[3] == kind]
            parts = [np.cumsum(unplaned(r[4]), dtype=np.uint64) + (np.uint64(r[1]) << np.uint64(64 - bits)) for r in own]
            keys, spot = distinct(np.concatenate(parts), bits)
            edges = np.cumsum([0, *map(len, parts)])
            told = []
            if kind < KEPT:
                sums = np.bincount(spot, np.concatenate([unplaned(r[5]).astype(float) for r in own]), len(keys)).astype(np.int64)
                told = [(planes(sums[spot[lo:hi]]), None) for lo, hi in zip(edges, edges[1:])]
            else:
                kinds, saved = [np.bincount(spot, np.concatenate([np.frombuffer(r[c], np.float64) for r in own]), len(keys)) for c in (5, 6)]
                kinds = np.rint(kinds).astype(np.int64)
                told = [(planes(kinds[spot[lo:hi]]), saved[spot[lo:hi]].tobytes()) for lo, hi in zip(edges, edges[1:])]
            for r, (a, b) in zip(own, told if kind == WORDS or kind > LONGER else []):
                yield named([(r[2], kind, r[1], a, b, None, None, None)])
            if kind == WORDS:
                tail = np.zeros(len(keys), np.int64)
                tail[spot] = np.concatenate([unplaned(r[6]).astype(np.int64) for r in own])
                yield named([(None, kind, 0, planes(sums), planes(tail), keys.tobytes(), int(sums.sum()), int((sums > 0).sum()))])
            elif kind < LONGER:
                yield named([(None, kind, 0, planes(sums), None, keys.tobytes(), None, None)])

    def named(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["chunk", "kind", "part", "a", "b", "h", "learned", "words"])

    return asked.repartition(1 << bits, "name").mapInArrow(run, "chunk long, kind int, part int, a binary, b binary, h binary, learned long, words long")


def class_counts(answers: DataFrame) -> np.ndarray:
    """Context, symbol, count (three rows) of class contexts over all chunks, of which there are boundedly many."""
    table = answers.where("chunk is null").select("h", "a").toArrow()
    key = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in table["h"].to_pylist()]])
    n = np.concatenate([np.zeros(0, np.int64), *[unplaned(x).astype(np.int64) for x in table["a"].to_pylist()]])
    key = (key * _BACK).astype(np.int64)
    order = np.argsort(key)
    return np.stack([key[order] >> st.BITS, key[order] & st._MASK, n[order]])


def class_keys(chunk: Chunk, groups: list[np.ndarray], depth: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's class contexts of one length with the class that follows, and how often each comes in texts to learn from."""
    classes = Classes(groups)
    symbols, place = chunk.symbols(classes)[chunk.learns], chunk.place[chunk.learns]
    if depth == 1:
        use = np.flatnonzero(place >= 1)
        pairs = np.bincount(symbols[use - 1] * classes.size + symbols[use], minlength=1)
        seen = np.flatnonzero(pairs)
        return (seen // classes.size | 1 << 48) << st.BITS | seen % classes.size, pairs[seen]
    code = st.contexts(symbols, depth)
    use = np.flatnonzero(place >= depth)
    use = use[Finder(allowed).find(code[use]) >= 0]
    key, spot = distinct((code[use] << st.BITS | symbols[use]).view(np.uint64))
    return key, np.bincount(spot, minlength=len(key))


def follow(symbols: np.ndarray, place: np.ndarray, tree: dict, nodes: Finder, keys: Finder) -> np.ndarray:
    """As ``suffixtree.follow``."""
    value = np.zeros(len(symbols))
    left = np.flatnonzero(place >= 1)
    for d in range(st.DEPTH, -1, -1):
        code = st.contexts(symbols, d)[left]
        node = nodes.find(code)
        node[place[left] < d] = -1
        held = np.flatnonzero(node >= 0)
        spot = keys.find(code[held] << st.BITS | symbols[left[held]])
        seen = spot >= 0
        value[left[held[seen]]] += tree["logp"][spot[seen]]
        value[left[held[~seen]]] += tree["rest"][node[held[~seen]]]
        rest = np.ones(len(left), bool)
        rest[held[seen]] = False
        left = left[rest]
    value[left] += tree["flat"]
    return value


class ClassTree:
    """As ``suffixtree.learn_tree``, one length after the other."""

    def __init__(self, classes: Classes) -> None:
        self.classes, self.found, self.least, self.allowed = classes, [], 0.0, None

    def add(self, part: np.ndarray) -> None:
        """Counts of the next length; ``allowed`` are the contexts of the length after that."""
        if not self.found:
            # every symbol follows one symbol, so the pairs also tell how often it comes at all
            symbol, inverse = np.unique(part[1], return_inverse=True)
            self.found.append(np.stack([np.zeros(len(symbol), np.int64), symbol, np.bincount(inverse, weights=part[2], minlength=len(symbol)).astype(np.int64)]))
            self.least = max(30.0, st.CONTEXT_SHARE * part[2].sum())
            first, inverse = np.unique(part[0], return_inverse=True)
            part = part[:, np.bincount(inverse, weights=part[2], minlength=len(first))[inverse] >= self.least] if len(first) else part
        self.found.append(part)
        often = (part[2] >= self.least) & (part[1] != st.END)
        self.allowed = np.unique(st.longer(part[0][often], part[1][often]))

    def grown(self) -> dict:
        return st.grow(*np.concatenate(self.found, axis=1), symbols=self.classes.size)


def chunk_scores(chunk: Chunk, finders: list[Finder], groups: list[np.ndarray], tree: dict, inside: np.ndarray, scale: float, texts: int) -> list[np.ndarray]:
    """Tokens, known tokens, base and score of each text of a chunk."""
    symbols, learned, word = chunk.symbols(Classes(groups)), chunk.counts(WORDS), chunk.word
    size, last = len(chunk.sizes), math.log10(texts + 0.5) - scale
    step = follow(symbols, chunk.place, tree, *finders)
    ids, owner, seen = chunk.id[word], chunk.owner[word], np.log10(learned + 0.5)
    log = seen[ids]
    base = np.bincount(owner, log, size) - chunk.sizes * scale + last
    near = np.bincount(owner, (learned > 0)[ids], size).astype(np.int64) + (texts > 0)
    step[word] += log - inside[symbols[word]]
    prob = np.exp(step * math.log(10.0))
    within, below = np.zeros(len(step), bool), None
    for level in levels(chunk, st.DEPTH):
        stays, kinds = level.kept(chunk, below)
        at = level.at[stays]
        prob[at] = (level.n[stays] + kinds[stays] * prob[at]) / (level.total[stays] + kinds[stays])
        within[at] = True
        below = level
    step[within] = np.log10(prob[within])
    return [chunk.sizes + 1, near, base, np.bincount(chunk.owner, step, size)]


def many(chunks: DataFrame) -> tuple[int, int]:
    """Tokens, and texts to learn from, of all chunks."""
    facts = chunks.agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).first()
    return facts["tokens"] or 0, facts["texts"] or 0


def buckets_for(rows: DataFrame) -> int:
    spark, size = rows.sparkSession, leaf_bytes(rows)
    if size >= 1 << 46:  # Spark does not know the size
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(1 << 14, max(2 * spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))


def score(store: Bucketed, chunks: DataFrame, key: T.DataType, total: int, texts: int) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, as ``suffixtree.score`` has them."""
    spark, sc = store.spark, store.spark.sparkContext
    bits = max(4, math.ceil(math.log2(max(1, total / PART_KEYS))))
    path = scratch_path(spark, "words")
    answer(ask(chunks, 0, bits), bits).write.option("compression", "zstd").parquet(path)
    first = spark.read.parquet(path)
    words = first.where("chunk is null").select("h", F.col("b").alias("tail"), F.col("a").alias("n"))
    facts = first.agg(F.sum("learned").alias("learned"), F.sum("words").alias("words")).first()
    n, v = (facts["learned"] or 0) + texts, (facts["words"] or 0) + (texts > 0)
    scale = math.log10(n + 0.5 * (v + 1))
    classes = find_classes(words, facts["learned"] or 0)
    groups = classes.groups

    def by_kind(batches):
        for b in batches:
            for row in b.to_pylist():
                own, count = Classes(groups), unplaned(row["n"])
                kind = own.of(np.frombuffer(row["h"], np.uint64), unplaned(row["tail"]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(own.size)), pa.array(np.bincount(kind, count, own.size).astype(np.int64)), pa.array(np.bincount(kind, count > 0, own.size).astype(np.int64))], ["kind", "tokens", "words"])

    inside = np.full(classes.size, math.log10(0.5))  # log10 of each class's normaliser
    for r in words.mapInArrow(by_kind, "kind long, tokens long, words long").groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        inside[r["kind"]] = math.log10(r["tokens"] + 0.5 * (r["words"] + 1))

    def kept(answers: DataFrame, name: str) -> DataFrame:
        own = answers.where("chunk is not null").repartition(store.buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "a", "b")).alias(name))
        return store.keep(own, name)

    grown, told = ClassTree(classes), kept(first, "a_0")
    for step in range(1, st.DEPTH + 2):
        # answers are joined first: chunks are long rows
        known = chunks.join(told.hint("shuffle_hash"), "chunk", "left")
        path = scratch_path(spark, f"answers-{step}")
        answer(ask(known, step, bits, sc.broadcast((groups, grown.allowed))), bits).write.option("compression", "zstd").parquet(path)
        answers = spark.read.parquet(path)
        if step <= st.DEPTH:
            grown.add(class_counts(answers))
        told = told.join(kept(answers, f"a_{step}"), "chunk", "left")
    known = chunks.join(told.hint("shuffle_hash"), "chunk", "left")
    shared = sc.broadcast((groups, grown.grown(), inside, scale, texts))

    def run(batches):
        finders = None
        for row in each_row(batches):
            finders = finders or [Finder(shared.value[1][c]) for c in ("nodes", "key")]
            chunk = Chunk(row)
            given = [pa.array(x) for x in chunk_scores(chunk, finders, *shared.value)]
            yield pa.RecordBatch.from_arrays([row["keys"], pa.array(chunk.held), given[0], given[1], pa.array(np.full(len(chunk.held), n)), given[2], given[3]], names)

    names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [key, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    path = scratch_path(spark, "scores")
    known.mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in zip(names, kinds)])).write.parquet(path)
    store.drop()
    return spark.read.parquet(path)
