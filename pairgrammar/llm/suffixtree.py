"""Language-model scores from a probabilistic suffix tree over words, and over word classes below it."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgrammar.llm.common import map_texts, remainder_is_one, slices, small_batches, tokens
from pairgrammar.session import scratch_path

DEPTH = 3  # classes of the longest context
CLASS_SHARE = 2e-3  # a word or an ending with so large a share of all tokens is a class: at most 4 / CLASS_SHARE
CONTEXT_SHARE = 1e-4  # a context must precede so large a share of all tokens: at most 1 / CONTEXT_SHARE for a length
GAIN = 12.0  # nats that a context must save over its suffix on the training text
LEAST = 30  # times that a context of words must come, at any corpus size
SLOT_BITS = 27  # a filter of contexts has so many slots: beyond, it lets more through, but loses none
FREQUENT = 1 << 20  # words whose counts travel to every task, at most
HEAD = 1 << 23  # counts of words after contexts that travel to every task, at most: the largest
SMALL = 1 << 20  # tokens up to which the tree over words is kept in tables; beyond, texts ask for what they need (``wordtree``)
BITS = 12
START, END, OTHER = 1, 2, 3  # before a text, after it, a word of no class of its own
_MASK = (1 << BITS) - 1


class Classes:
    """Class of a word: its own, or that of its last three, two or one bytes, or ``OTHER``."""

    def __init__(self, maps: list[dict[bytes, int]]) -> None:
        self.maps, self.size = maps, OTHER + 1 + sum(map(len, maps))

    @staticmethod
    def named(groups: list[list[bytes]]) -> Classes:
        maps, n = [], OTHER
        for group in groups:
            maps.append({w: n + 1 + i for i, w in enumerate(sorted(group))})
            n += len(group)
        return Classes(maps)

    def of(self, word: bytes) -> int:
        whole, three, two, one = self.maps
        return whole.get(word) or three.get(word[-3:]) or two.get(word[-2:]) or one.get(word[-1:]) or OTHER


def sequence(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, classes and end of all texts in a row; each symbol's place in its text; each symbol's text."""
    size = np.array([len(t) + 2 for t in texts], np.int64)
    symbols = np.empty(int(size.sum()), np.int64)
    first = np.cumsum(size) - size
    symbols[first], symbols[first + size - 1] = START, END
    owner = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(symbols)) - first[owner]
    inside = np.ones(len(symbols), bool)
    inside[first] = inside[first + size - 1] = False
    symbols[inside] = np.concatenate(texts) if texts else []
    return symbols, place, owner


def contexts(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Code of the ``depth`` symbols before each place: the last lowest, above them how many."""
    code = np.full(len(symbols), depth << 48, np.int64)
    for d in range(1, depth + 1):
        code[d:] |= symbols[:-d] << (BITS * (d - 1))
    return code


def shorter(context: np.ndarray) -> np.ndarray:
    """Contexts (not empty) without their oldest symbol."""
    depth = context >> 48
    return (context & ((1 << (BITS * (depth - 1))) - 1)) | (depth - 1) << 48


def longer(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Contexts with one more symbol read."""
    return ((context & ((1 << 48) - 1)) << BITS | symbol) | ((context >> 48) + 1) << 48


def grow(context: np.ndarray, symbol: np.ndarray, count: np.ndarray, symbols: int, gain: float = GAIN) -> dict:
    """The tree: retained contexts, log10 probabilities of what follows them, and what is left to their suffixes.

    A context stays if its next-symbol distribution saves at least ``gain`` nats over its suffix's on
    what was counted, or if a longer one that stays ends in it. After a context seen N times
    with T distinct followers, a symbol seen n times has (n + T p) / (N + T), where p is its probability
    after the suffix; below the empty context all symbols are alike.
    """
    key = context << BITS | symbol
    order = np.argsort(key, kind="stable")
    key, context, symbol, count = key[order], context[order], symbol[order], count[order].astype(float)
    nodes, first, kinds = np.unique(context, return_index=True, return_counts=True)
    total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
    node = np.repeat(np.arange(len(nodes)), kinds)
    prob, saved = np.zeros(len(key)), np.zeros(len(nodes))
    depth = context >> 48
    for d in range(DEPTH + 1):
        at = np.flatnonzero(depth == d)
        if not len(at):
            continue
        below = np.full(len(at), 1 / symbols)
        if d:
            spot = np.searchsorted(key, shorter(context[at]) << BITS | symbol[at])
            below = prob[spot]
            plain = count[at] / total[node[at]] / (count[spot] / total[node[spot]])
            saved += np.bincount(node[at], weights=count[at] * np.log(plain), minlength=len(nodes))
        prob[at] = (count[at] + kinds[node[at]] * below) / (total[node[at]] + kinds[node[at]])
    keep = set(nodes[(saved >= gain) | (nodes == 0)].tolist())
    for _ in range(DEPTH):
        keep |= set(shorter(np.array([c for c in keep if c], np.int64)).tolist()) if any(keep) else set()
    stays = np.isin(nodes, np.array(sorted(keep), np.int64))
    return {"nodes": nodes[stays], "rest": np.log10(kinds[stays] / (total[stays] + kinds[stays])), "key": key[stays[node]], "logp": np.log10(prob[stays[node]]), "flat": -math.log10(symbols)}


def follow(symbols: np.ndarray, place: np.ndarray, tree: dict) -> np.ndarray:
    """Log10 probability of each symbol after the longest retained suffix of what precedes it; 0 for starts."""
    value = np.zeros(len(symbols))
    left = np.flatnonzero(place >= 1)
    for d in range(DEPTH, -1, -1):
        if not len(left) or not len(tree["nodes"]):
            break
        at = left[place[left] >= d]
        code = contexts(symbols, d)[at]
        node = np.minimum(np.searchsorted(tree["nodes"], code), len(tree["nodes"]) - 1)
        held = tree["nodes"][node] == code
        at, node, code = at[held], node[held], code[held]
        key = code << BITS | symbols[at]
        spot = np.minimum(np.searchsorted(tree["key"], key), len(tree["key"]) - 1)
        seen = tree["key"][spot] == key
        value[at[seen]] += tree["logp"][spot[seen]]
        value[at[~seen]] += tree["rest"][node[~seen]]
        done = np.zeros(len(symbols), bool)
        done[at[seen]] = True
        left = left[~done[left]]
    value[left] += tree["flat"]
    return value


def _word_hash(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


class _Places(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


class _Words:
    """What a task knows about the words it has met: class, learned count (-1: to be joined), hash."""

    LIMIT = 200_000

    def __init__(self, classes: Classes, h: np.ndarray | None = None, learned: np.ndarray | None = None) -> None:
        self.classes, self.h, self.learned = classes, h, learned
        self.clear()

    def clear(self) -> None:
        self.place = _Places()
        self.kind, self.count, self.code = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.place) > self.LIMIT:
            self.clear()
        before, find = len(self.place), self.place.__getitem__
        found = [np.fromiter(map(find, words), np.int64, len(words)) for words in texts]
        fresh = list(islice(self.place, before, None))
        self.kind = np.concatenate([self.kind, np.array(list(map(self.classes.of, fresh)), np.int64)])
        if self.h is not None:
            code, count = np.array(list(map(_word_hash, fresh)), np.int64), np.full(len(fresh), -1, np.int64)
            if len(self.h) and len(fresh):
                spot = np.minimum(np.searchsorted(self.h, code), len(self.h) - 1)
                count = np.where(self.h[spot] == code, self.learned[spot], -1)
            self.code, self.count = np.concatenate([self.code, code]), np.concatenate([self.count, count])
        return found


def count_words(rows: DataFrame) -> DataFrame:
    """``word``, ``total``, ``learned`` (times in texts to learn from), summed in the tasks before the shuffle."""
    def run(batches):
        own, other = Counter(), Counter()  # of texts to learn from, of held-out ones

        def flush():
            words = [*own, *other]
            learned = [*own.values(), *[0] * len(other)]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*own.values(), *other.values()], pa.int64()), pa.array(learned, pa.int64())], ["word", "total", "learned"])
            own.clear()
            other.clear()
            return batch
        for batch in batches:
            for part, texts in slices(batch, batch.column(0)):
                for text, held in zip(texts, part.column(1).to_pylist()):
                    (other if held else own).update(tokens(text))
                if len(own) + len(other) > _Words.LIMIT:
                    yield flush()
        yield flush()

    counted = rows.select("text", "held_out").mapInArrow(run, "word binary, total long, learned long")
    return counted.groupBy("word").agg(F.sum("total").alias("total"), F.sum("learned").alias("learned"))


def find_classes(words: DataFrame, learned: int) -> Classes:
    """Words and endings with a share of at least ``CLASS_SHARE``; an ending counts the words without a class so far."""
    least = max(20.0, learned * CLASS_SHARE)
    used = words.where("learned > 0")
    whole = [bytes(r["word"]) for r in used.where(F.col("learned") >= least).collect()]
    rest, endings = used.where(F.col("learned") < least).select(F.col("word").alias("end"), F.col("learned").alias("n")), []
    for size in (3, 2, 1):
        cut = F.when(F.length("end") > size, F.substring("end", F.length("end") - size + 1, F.lit(size))).otherwise(F.col("end"))
        rest = rest.groupBy(cut.alias("end")).agg(F.sum("n").alias("n"))
        endings.append([bytes(r["end"]) for r in rest.where(F.col("n") >= least).collect()])
        rest = rest.where(F.col("n") < least)
    return Classes.named([whole, *endings])


def count_contexts(rows: DataFrame, classes: Classes, depth: int, allowed: np.ndarray) -> DataFrame:
    """(context, symbol, n) for the ``allowed`` contexts of one length, over all rows, summed in the tasks first."""
    shared = rows.sparkSession.sparkContext.broadcast((classes.maps, allowed))

    def run(batches):
        known, keys, counts, held = None, [], [], 0
        for batch in batches:
            if known is None:
                own, fine = shared.value
                known = _Words(Classes(own))
            for _, texts in slices(batch, batch.column(0)):
                at = known.look([tokens(t) for t in texts])
                symbols, place, _ = sequence([known.kind[a] for a in at])
                code = contexts(symbols, depth)
                use = (place >= max(1, depth)) & (fine[np.minimum(np.searchsorted(fine, code), len(fine) - 1)] == code)
                key, n = np.unique(code[use] << BITS | symbols[use], return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > 4_000_000:
                    keys, counts = _merged(keys, counts)
                    held = len(keys[0])
                    if held > 2_000_000:
                        yield _rows(keys[0], counts[0])
                        keys, counts, held = [], [], 0
        if keys:
            keys, counts = _merged(keys, counts)
            yield _rows(keys[0], counts[0])

    return rows.select("text").mapInArrow(run, "context long, symbol long, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return [key], [np.bincount(inverse, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)]


def _rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key >> BITS), pa.array(key & _MASK), pa.array(n)], ["context", "symbol", "n"])


def count_pairs(rows: DataFrame, classes: Classes) -> DataFrame:
    """(context, symbol, n) for all contexts of one symbol: a task adds up one table of all pairs of classes."""
    shared, size = rows.sparkSession.sparkContext.broadcast(classes.maps), classes.size

    def run(batches):
        known, pairs = None, np.zeros(size * size, np.int64)
        for batch in batches:
            known = known or _Words(Classes(shared.value))
            for _, texts in slices(batch, batch.column(0)):
                symbols, place, _ = sequence([known.kind[a] for a in known.look([tokens(t) for t in texts])])
                use = np.flatnonzero(place >= 1)
                pairs += np.bincount(symbols[use - 1] * size + symbols[use], minlength=size * size)
        seen = np.flatnonzero(pairs)
        yield _rows((seen // size | 1 << 48) << BITS | seen % size, pairs[seen])

    return rows.select("text").mapInArrow(run, "context long, symbol long, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def lengthened(ctx: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hash of contexts (0: the empty one) with one more word read."""
    return _mixed(_mixed(ctx.view(np.uint64)) + symbol.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).view(np.int64)


def word_contexts(code: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``DEPTH`` words: hash of the words before each place, and where there are so many."""
    out, h = [], np.zeros(len(code), np.int64)
    for d in range(1, DEPTH + 1):
        h = np.concatenate([h[:1], lengthened(h[:-1], code[:-1])])
        out.append((h, place > d))
    return out


def make_filter(contexts_: DataFrame) -> np.ndarray:
    """Bitmap of the slots of column ``ctx``, of fixed size."""
    slot = F.shiftrightunsigned("ctx", 64 - SLOT_BITS)
    bits = contexts_.groupBy(F.shiftright(slot, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(ctx, {64 - SLOT_BITS}) % 64 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << (SLOT_BITS - 6), np.uint64)
    out[bits["i"].to_numpy()] = bits["v"].to_numpy().view(np.uint64)
    return out


def packed(bits: np.ndarray) -> bytes:
    """A bitmap for the way to the tasks: most of it is empty."""
    return zlib.compress(bits.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint64)


def passes(bits: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    slot = ctx.view(np.uint64) >> np.uint64(64 - SLOT_BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def word_codes(at: list[np.ndarray], known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, with 0 before each and ``END`` behind it, and each one's place in its text."""
    code, place, _ = sequence([known.code[a] for a in at])
    code[place == 0] = 0
    return code, place


def count_followers(rows: DataFrame, depth: int, bits: np.ndarray) -> DataFrame:
    """(ctx, sfx, symbol, n) for contexts of ``depth`` words that pass; ``sfx`` is the context without its oldest word, of one word there is none."""
    shared = rows.sparkSession.sparkContext.broadcast(packed(bits))
    names = ["ctx", "symbol", "n", "sfx"][:3 if depth == 1 else 4]

    def run(batches):
        known, own = _Words(Classes([{}] * 4), np.zeros(0, np.int64), np.zeros(0, np.int64)), unpacked(shared.value)
        kept, held = [], 0

        def merged():
            parts = [np.concatenate(c) for c in zip(*kept)]
            key = _mixed(parts[0].view(np.uint64) ^ _mixed(parts[1].view(np.uint64)))
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=parts[2], minlength=len(first)).astype(np.int64)
            order = np.argsort(parts[0][first], kind="stable")  # rows of a context in a row: they pack better
            ctx, symbol, _, *sfx = [p[first[order]] for p in parts]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (ctx, symbol, n[order], *sfx)], names)

        for batch in batches:
            for _, texts in slices(batch, batch.column(0)):
                code, place = word_codes(known.look([tokens(t) for t in texts]), known)
                found = word_contexts(code, place)
                ctx, use = found[depth - 1]
                use = use & passes(own, ctx)
                sfx = [found[depth - 2][0][use]] if depth > 1 else []
                kept.append((ctx[use], code[use], np.ones(int(use.sum()), np.int64), *sfx))
                held += len(kept[-1][0])
                if held > 2_000_000:
                    yield merged()
                    kept, held = [], 0
        if kept:
            yield merged()

    counted = rows.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return counted.groupBy("ctx", "symbol").agg(F.sum("n").alias("n"), *[F.first("sfx").alias("sfx") for c in names[3:]])


def _longer_rows(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(lengthened(*(c.to_numpy() for c in b.columns)))], ["ctx"])


def grow_words(rows: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame, list[np.ndarray]]:
    """The tree over words as tables: (ctx, symbol, n), (ctx, total, kinds); and a filter of the contexts of each length.

    A context of words is counted if it comes ``LEAST`` times, whatever the corpus' size. One word stays as
    it is; longer ones stay if they save ``GAIN`` nats over the context without their oldest word. A context
    comes as often as its newest word follows the rest of it, so that the counts of one length tell exactly
    which contexts of the next are to be counted.
    """
    spark = rows.sparkSession

    bits = make_filter(counts.where(F.col("learned") >= LEAST).select(F.lit(0).cast("long").alias("ctx"), "h").mapInArrow(_longer_rows, "ctx long"))
    edges, nodes, filters, below = None, None, [], None
    for depth in range(1, DEPTH + 1):
        path = scratch_path(spark, f"followers-{depth}")
        count_followers(rows, depth, bits).write.parquet(path)
        own = spark.read.parquet(path)
        often = own.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), *[F.first(c).alias(c) for c in own.columns[3:]]).where(F.col("total") >= LEAST)
        bits = make_filter(own.where((F.col("n") >= LEAST) & (F.col("symbol") != END)).select("ctx", "symbol").mapInArrow(_longer_rows, "ctx long"))
        stays = often
        if below is not None:
            plain = own.join(often.select("ctx"), "ctx", "left_semi").join(below[0].select(F.col("ctx").alias("sfx"), "symbol", F.col("n").alias("m")), ["sfx", "symbol"])
            saved = plain.groupBy("ctx").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("m"))).alias("saved"))
            stays = often.join(saved, "ctx").join(below[1].select(F.col("ctx").alias("sfx"), F.col("total").alias("all")), "sfx").where(F.col("saved") + F.col("total") * F.log(F.col("all") / F.col("total")) >= GAIN)
        path = scratch_path(spark, f"nodes-{depth}")
        stays.select("ctx", "total", "kinds").write.parquet(path)
        kept = spark.read.parquet(path)
        filters.append(make_filter(kept))
        mine = own.join(kept.select("ctx"), "ctx", "left_semi").select("ctx", "symbol", "n")
        edges, nodes = (mine, kept) if edges is None else (edges.unionByName(mine), nodes.unionByName(kept))
        below = own, often
    return edges, nodes, filters


def lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values by sorted keys; -1 for a key that is not there."""
    if not len(keys):
        return np.full(len(asked), -1, np.int64)
    spot = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[spot] == asked, values[spot].astype(np.int64), -1)


def largest(rows: DataFrame, count: str, limit: int) -> tuple[int, DataFrame]:
    """The least count such that at most ``limit`` rows have it or more, and these rows."""
    top, least = 1 << 16, 1 << 16
    for r in sorted(rows.groupBy(F.least(count, F.lit(top)).alias("c")).count().collect(), key=lambda r: -r["c"]):
        limit -= r["count"]
        if limit < 0:
            least = r["c"] + 1
            break
        least = r["c"]
    else:
        least = 1
    return least, rows.where(F.col(count) >= least) if least <= top else rows.where("false")


class TreeHead:
    """The part of the tree over words that every task has: its largest counts, exact within the bounds they give.

    ``whole``: a context that is not here is not in the tree. ``least``: a word follows a context less often
    than that if its count is not here; if that is 2 at most, a text that was learned from knows it: once.
    """

    def __init__(self, filters: list[bytes], least: int, key: np.ndarray, n: np.ndarray, whole: bool, ctx: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
        self.filters, self.least, self.key, self.n, self.whole, self.ctx, self.total, self.kinds = [unpacked(f) for f in filters], least, key, n, whole, ctx, total, kinds

    @staticmethod
    def gather(edges: DataFrame, nodes: DataFrame, filters: list[np.ndarray]) -> tuple:
        """What a head is made of, of bounded size."""
        def keyed(batches):
            for b in batches:
                key = lengthened(b.column(0).to_numpy(), b.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(2)], ["key", "n"])

        def by_key(table, *names):
            order = np.argsort(table[names[0]].to_numpy())
            columns = [table[c].to_numpy()[order] for c in names]
            return [columns[0], *[c.astype(np.int32 if c.max(initial=0) < 1 << 31 else np.int64) for c in columns[1:]]]

        least, most = largest(edges, "n", HEAD)
        key, n = by_key(most.mapInArrow(keyed, "key long, n long").toArrow(), "key", "n")
        floor, most = largest(nodes, "total", HEAD >> 3)
        return [packed(f) for f in filters], least, key, n, floor <= LEAST, *by_key(most.toArrow(), "ctx", "total", "kinds")

    def climb(self, code: np.ndarray, place: np.ndarray, start: np.ndarray, sure: np.ndarray, learned: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Gain of each place by what is here, the places for which more is to be asked, and their contexts.

        ``start``: log10 probability by the class tree, where it is ``sure``.
        """
        ask, found, prob = np.zeros(len(code), bool), [], np.power(10.0, start)
        once = 1 if learned and self.least <= 2 else 0 if self.least <= 1 else -1
        for (ctx, use), bits in zip(word_contexts(code, place), self.filters):
            use = use & passes(bits, ctx)
            at = np.flatnonzero(use)
            total = lookup(self.ctx, self.total, ctx[at])
            if self.whole:
                use[at[total < 0]] = False
                at, total = at[total >= 0], total[total >= 0]
            kinds = lookup(self.ctx, self.kinds, ctx[at])
            n = lookup(self.key, self.n, lengthened(ctx[at], code[at]))
            n = np.where(n < 0, once, n)
            prob[at] = (n + kinds * prob[at]) / np.maximum(total + kinds, 1)
            ask[at] |= (n < 0) | (total < 0)
            found.append((ctx, use))
        within = np.logical_or.reduce([use for _, use in found])
        ask |= within & ~sure
        gain = np.zeros(len(code))
        done = within & ~ask
        gain[done] = np.log10(prob[done]) - start[done]
        return gain, ask, found


def word_gain(scored: DataFrame, counts: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``row_id``, ``gain``: log10 of what the contexts of words make of the class tree's probability, summed over a text.

    After a context seen N times with T distinct followers a word seen n times has (n + T p) / (N + T), where
    p is its probability after the next shorter context that stays, at last the class tree's.
    """
    at = scored.select("row_id", F.posexplode(F.arrays_zip("symbol", "place", "p", *[f"c{d}" for d in range(1, DEPTH + 1)])).alias("pos", "x")).select("row_id", "pos", "x.*")
    asked = at.select("row_id", "pos", "symbol", "p", "place", F.posexplode(F.array(*[f"c{d}" for d in range(1, DEPTH + 1)])).alias("d", "ctx")).where("ctx is not null")
    # most counts are of words that no place asks for: they stay where they are
    shared = scored.sparkSession.sparkContext.broadcast(packed(make_filter(asked.select("ctx", "symbol").mapInArrow(_longer_rows, "ctx long"))))

    def wanted(batches):
        bits = unpacked(shared.value)
        for b in batches:
            yield b.filter(pa.array(passes(bits, lengthened(b.column(0).to_numpy(), b.column(1).to_numpy()))))

    found = edges.select("ctx", "symbol", "n").mapInArrow(wanted, "ctx long, symbol long, n long")
    met = asked.join(nodes, "ctx").join(found, ["ctx", "symbol"], "left")
    seen = met.groupBy("row_id", "pos").agg(
        F.first("symbol").alias("symbol"), F.first("p").alias("p"), F.first("place").alias("known"),
        *[F.max(F.when(F.col("d") == d, F.struct("total", "kinds", F.coalesce("n", F.lit(0)).alias("n")))).alias(f"x{d}") for d in range(DEPTH)])
    rare = counts.select(F.col("h").alias("symbol"), "learned")
    seen = seen.where("known").select("*", F.lit(None).cast("long").alias("learned")).unionByName(seen.where("not known").join(rare, "symbol", "left").select(*seen.columns, "learned"))
    start = F.when(F.col("known"), F.col("p")).otherwise(F.col("p") + F.log10(F.coalesce("learned", F.lit(0)) + 0.5))
    prob = F.pow(F.lit(10.0), start)
    for d in range(DEPTH):
        x = F.col(f"x{d}")
        prob = F.when(x.isNull(), prob).otherwise((x["n"] + x["kinds"] * prob) / (x["total"] + x["kinds"]))
    return seen.groupBy("row_id").agg(F.sum(F.log10(prob) - start).alias("gain"))


def learn_tree(rows: DataFrame, classes: Classes) -> dict:
    """Count contexts length by length: one is counted if it is frequent, as all that it begins with are."""
    table = count_pairs(rows, classes).toArrow()
    part = np.stack([table[c].to_numpy() for c in ("context", "symbol", "n")]).astype(np.int64)
    # every symbol follows one symbol, so the pairs also tell how often it comes at all
    symbol, inverse = np.unique(part[1], return_inverse=True)
    alone = np.stack([np.zeros(len(symbol), np.int64), symbol, np.bincount(inverse, weights=part[2], minlength=len(symbol)).astype(np.int64)])
    least = max(30.0, CONTEXT_SHARE * part[2].sum())
    first, inverse = np.unique(part[0], return_inverse=True)
    part = part[:, np.bincount(inverse, weights=part[2], minlength=len(first))[inverse] >= least] if len(first) else part
    found = [alone, part]
    for depth in range(2, DEPTH + 1):
        often = (part[2] >= least) & (part[1] != END)
        allowed = np.unique(longer(part[0][often], part[1][often]))
        if not len(allowed):
            break
        table = count_contexts(rows, classes, depth, allowed).toArrow()
        part = np.stack([table[c].to_numpy() for c in ("context", "symbol", "n")]).astype(np.int64)
        found.append(part)
    return grow(*np.concatenate(found, axis=1), symbols=classes.size)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    Learns from the texts whose crc32 remainder by 5 is not 1. A text's tokens are its words (A-Z lowered)
    and one end; null and empty texts are the end alone. ``base_score`` is the smoothed unigram's log10
    probability. For ``score`` a suffix tree predicts each token's class from the classes before it,
    and the word follows from its class: (c + 0.5) / (C + 0.5 (K + 1)), where C and K are the
    class's tokens and distinct words. On this rests the suffix tree over words (``grow_words``), which
    grows with the corpus: its largest counts travel to the tasks (``TreeHead``), places that need others
    are joined by context hash. The vocabulary, the classes and all contexts are counted over
    the whole corpus. Counts of frequent words travel to the tasks; those of all others are joined
    by word hash, one row for each text and word. Beyond ``SMALL`` tokens the same scores come from
    ``wordtree``, without tables of places. Rows with a null key are learned from;
    repeated rows count as often as they come; an empty table gives no rows.
    """
    from pairgrammar.llm import wordtree

    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), remainder_is_one(key, 5).alias("held_out"), F.col(text).alias("text"))
    store = wordtree.Bucketed(spark, wordtree.buckets_for(docs))
    chunks = store.keep(wordtree.make_chunks(rows, store.buckets), "chunks")
    total, learned_texts = wordtree.many(chunks)
    if total > SMALL:
        scores = wordtree.score(store, chunks, rows.schema["key"].dataType, total, learned_texts)
        return scores.select(F.col("key").alias(key), *scores.columns[1:])
    store.drop()
    path = scratch_path(spark, "words")
    count_words(rows).write.parquet(path)
    words = spark.read.parquet(path)
    facts = words.agg(F.sum("total").alias("total"), F.sum("learned").alias("learned"), F.count_if(F.col("learned") > 0).alias("kinds")).first()
    training = rows.where(~F.col("held_out"))
    texts = training.count()
    n, v = (facts["learned"] or 0) + texts, facts["kinds"] + (texts > 0)
    scale = math.log10(n + 0.5 * (v + 1))
    classes = find_classes(words, facts["learned"] or 0)
    tree = learn_tree(training, classes)

    def described(batches):
        for b in batches:
            data = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_word_hash, data)), pa.int64()), pa.array(list(map(classes.of, data)), pa.int64()), *b.columns[1:]], ["h", "kind", "total", "learned"])

    path = scratch_path(spark, "counts")
    words.select("word", "total", "learned").mapInArrow(described, "h long, kind long, total long, learned long").write.parquet(path)
    counts = spark.read.parquet(path)
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("learned").alias("tokens"), F.count_if(F.col("learned") > 0).alias("words")).collect()}
    inside = np.zeros(classes.size)  # log10 of each class's normaliser
    for k in range(OTHER, classes.size):
        r = sums.get(k)
        inside[k] = math.log10((r["tokens"] if r else 0) + 0.5 * ((r["words"] if r else 0) + 1))
    frequent = F.col("total") >= max(2.0, (facts["total"] or 0) / FREQUENT)
    head = counts.where(frequent).select("h", "learned").toArrow().sort_by("h")
    edges, nodes, filters = grow_words(training, counts)
    shared = spark.sparkContext.broadcast((classes.maps, tree, inside, head["h"].to_numpy(), head["learned"].to_numpy(), TreeHead.gather(edges, nodes, filters)))

    def make(of_training):
        maps, own_tree, norm, h, learned, top = shared.value
        top = TreeHead(*top)
        known = _Words(Classes(maps), h, learned)
        last = math.log10(texts + 0.5) - scale

        def work(given):
            at = known.look([tokens(t) for t in given])
            symbols, place, owner = sequence([known.kind[a] for a in at])
            word = symbols >= OTHER
            step = follow(symbols, place, own_tree)
            code, _ = word_codes(at, known)
            count = np.full(len(code), 0, np.int64)
            count[word] = np.concatenate([known.count[a] for a in at]) if at else 0
            # log10 probability by the class tree; of words to be joined, without their count
            p = step.copy()
            p[word] += np.where(count[word] >= 0, np.log10(np.maximum(count[word], 0) + 0.5), 0) - norm[symbols[word]]
            gain, asked, found = top.climb(code, place, p, count >= 0, of_training)
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[asked], minlength=len(given)))]), pa.int32())
            lists = [pa.array(code[asked]), pa.array(count[asked] >= 0), pa.array(p[asked]), *[pa.array(c[asked], mask=~use[asked]) for c, use in found]]
            step[word] += scale - norm[symbols[word]]
            step[symbols == END] -= last
            step += gain
            lift = np.bincount(owner, weights=step, minlength=len(given))
            base, near, tails, times = [], [], [], []
            for a in at:
                count = known.count[a]
                met = count >= 0
                near.append(int((count > 0).sum()) + (texts > 0))
                base.append(float(np.log10(count[met] + 0.5).sum()) - len(a) * scale + last)
                tail, k = np.unique(known.code[a[~met]], return_counts=True)
                tails.append(tail)
                times.append(k)
            return [
                pa.array([len(a) + 1 for a in at], pa.int64()), pa.array(near, pa.int64()), pa.array(base, pa.float64()), pa.array(lift, pa.float64()),
                pa.array(tails, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64())),
                *[pa.ListArray.from_arrays(cuts, x) for x in lists]]
        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("near", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("lift", T.DoubleType()), T.StructField("h", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))]
    fields += [T.StructField("symbol", T.ArrayType(T.LongType())), T.StructField("place", T.ArrayType(T.BooleanType())), T.StructField("p", T.ArrayType(T.DoubleType())), *[T.StructField(f"c{d}", T.ArrayType(T.LongType())) for d in range(1, DEPTH + 1)]]
    path = scratch_path(spark, "scored")
    numbered = rows.withColumn("row_id", F.monotonically_increasing_id())
    # a text that was learned from knows that its own words were counted, so these texts go by themselves
    parts = [
        map_texts(part, "text", ["row_id", "key", "held_out"], fields, partial(make, of_training)).select("row.*", *[f.name for f in fields])
        for part, of_training in ((numbered.where(~F.col("held_out")), True), (numbered.where("held_out").withColumn("row_id", -1 - F.col("row_id")), False))]
    parts[0].unionByName(parts[1]).write.parquet(path)
    scored = spark.read.parquet(path)
    rare = scored.select("row_id", F.inline(F.arrays_zip("h", "times"))).join(counts.where(~frequent).select("h", "learned"), "h")
    found = rare.groupBy("row_id").agg(F.sum(F.when(F.col("learned") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("learned") + 0.5)).alias("logs"))
    base = F.col("base") + F.coalesce("logs", F.lit(0.0))
    gain = word_gain(scored, counts, edges, nodes)
    return scored.join(found, "row_id", "left").join(gain, "row_id", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("near") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("lift") + F.coalesce("gain", F.lit(0.0))).alias("score"))
