"""Exact Jaccard self-join of word n-gram sets through a token-group matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgrammar.llm.common import map_texts, slices, small_batches, tokens
from pairgrammar.llm.components import components
from pairgrammar.session import scratch_path

GROUP, GROUP_TOKENS = 512, 1 << 19  # documents and tokens a group, about
ASKING = 512  # queries that meet a group in one task, about
SLOTS = 1 << 20  # key slots that sift the rows whose sets are needed
COMMON = 1 << 18  # tokens that are known as common, at most
HELD = 3_000_000  # distinct tokens that a task counts before it passes the repeated ones on
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class _Hashes(dict):
    """Hash of each word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; a shorter text is one run; none without words."""
    found = tokens(text)
    if not found:
        return np.zeros(0, np.int64)
    h = np.array(list(map(hashes.__getitem__, found)), np.uint64)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i:len(h) - size + 1 + i]) * np.uint64(_MIX[i % len(_MIX)])
        out ^= out >> np.uint64(31)
    return np.unique(out.view(np.int64))


def least_overlap(size, percent: int):
    """Fewest tokens a set of ``size`` shares with any set that it links with."""
    return -(-size * percent // 100)


def spare(size):
    """Extra prefix tokens; so many more than one must be shared as well."""
    return size // 20


def prefix(found: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's first tokens in the common order (rare tokens first, each kind by hash), and which are common.

    Two sets that link share at least 1 + the smaller ``spare`` of their prefixes.
    """
    size = len(found)
    many = size - least_overlap(size, percent) + 1 + spare(size)
    often = np.zeros(size, bool)
    if len(common):
        often = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    pick = np.concatenate([np.flatnonzero(~often), np.flatnonzero(often)])[:many]
    return found[pick], often[pick]


def linked_within(members: list[np.ndarray], asking: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (place in asking, place in members) whose sets link."""
    if not members:
        return []
    size = np.array([len(m) for m in members])
    flat, owner = np.concatenate(members), np.repeat(np.arange(len(members)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for i, q in enumerate(asking):
        low, high = np.searchsorted(flat, q, "left"), np.searchsorted(flat, q, "right")
        runs = high - low
        spots = np.repeat(low - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        shared = np.bincount(owner[spots], minlength=len(members))
        out += [(i, int(j)) for j in np.flatnonzero((shared > 0) & (100 * shared >= percent * (len(q) + size - shared)))]
    return out


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``n_links`` of every row.

    A text's set holds its distinct runs of ``words`` words (A-Z lowered); a text with fewer words is
    one run. Two documents link if 100 * shared >= percent * united; the join is exact but for equal
    64-bit hashes. Equal sets become one class first. Classes are dealt into groups of about
    ``GROUP`` by their smallest shared token, so similar ones meet; the matrix holds, for each token,
    the groups whose members have it in their prefix. A class opens a group only if the prefix tokens it
    shares with the group's union reach the bound that any linked member would give. Only then are
    sets compared, hot groups against blocks of at most about ``ASKING`` classes.

    ``component_id`` is the smallest key reachable by links, ``n_links`` the number of other rows
    linked directly. Null and empty texts, or texts of white space, have no shingles and no links.
    Keys must be unique integers; rows with a null key have a null component and no links, and rows
    that repeat a key take part each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    def summarise(batches):
        hashes = _Hashes()
        seen: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def rows_of(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["key", "n", "sig", "token", "times"])

        def repeated() -> pa.RecordBatch:
            value, place = np.unique(np.concatenate(seen), return_inverse=True)
            count = np.bincount(place, weights=np.concatenate(times)).astype(np.int64)
            seen[:], times[:] = [value], [count]
            often = count > 1
            return rows_of([[None] * int(often.sum())] * 3 + [value[often], count[often]])

        for batch in batches:
            for part, texts in slices(batch, batch.column(1)):
                sets = [shingles(t, words, hashes) for t in texts]
                sigs = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield rows_of([part.column(0).to_pylist(), [len(s) for s in sets], sigs, [None] * len(sets), [None] * len(sets)])
                value, count = np.unique(np.concatenate(sets), return_counts=True)
                seen.append(value)
                times.append(count)
                if sum(map(len, seen)) > HELD:
                    yield repeated()
                    seen.clear()
                    times.clear()
        if seen:
            yield repeated()

    first = stored(docs.mapInArrow(summarise, "key long, n long, sig binary, token long, times long"), "sets")
    summary = first.where("token is null").select("key", "n", "sig")

    # common tokens come last in the order of prefixes; which ones are is a matter of cost, never of the
    # result: the tokens that most texts have, by counts within tasks that cover all texts
    counts = first.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") > 32)
    common = np.array(sorted(r["token"] for r in counts.orderBy(F.desc("times"), "token").limit(COMMON).select("token").collect()), np.int64)
    shared = spark.sparkContext.broadcast(common)

    # one row for each distinct set
    classes = (
        summary.where("sig is not null and key is not null")
        .groupBy("sig").agg(F.min("key").alias("q"), F.first("n").alias("n"), F.count("*").alias("copies")))
    classes = stored(classes, "classes")

    def first_tokens():
        hashes, often = _Hashes(), shared.value

        def work(texts):
            made = [prefix(s, often, percent) if len(s) else (s, np.zeros(0, bool)) for s in (shingles(t, words, hashes) for t in texts)]
            ends = np.concatenate([[0], np.cumsum([len(t) for t, _ in made])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([t for t, _ in made]))), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([o for _, o in made])))]
        return work

    prefixes = map_texts(docs.where("key is not null"), "text", ["key"], [T.StructField("token", T.ArrayType(T.LongType())), T.StructField("common", T.ArrayType(T.BooleanType()))], first_tokens)
    rows = prefixes.select(F.col("row.key").alias("q"), F.inline(F.arrays_zip("token", "common")))
    # a token of one document links nothing; a common one is known to be shared and need not be counted
    alone = Window.partitionBy("token", F.when(F.col("common"), F.col("q")))
    rows = rows.withColumn("times", F.count("*").over(alone)).where("common or times > 1").select("token", "q")
    rows = stored(rows.join(classes.select("q", "n"), "q"), "prefixes")

    # similar sets have the same smallest shared token: they make a group, dealt out if it is large
    grouped = rows.groupBy("q").agg(F.min("token").alias("low"), F.first("n").alias("n"))
    heaps = grouped.groupBy("low").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS)).alias("parts"))
    grouped = stored(grouped.join(heaps, "low").select("q", F.xxhash64("low", F.pmod(F.xxhash64("q", F.lit(1)), "parts")).alias("grp")), "groups")
    rows = rows.join(grouped, "q")

    matrix = rows.groupBy("token", F.col("grp").alias("at")).agg(F.count("*").alias("has"), F.min("n").alias("least"), F.max("n").alias("most"))
    meet = rows.join(matrix, "token").where(
        ((F.col("grp") < F.col("at")) | ((F.col("grp") == F.col("at")) & (F.col("has") > 1)))
        & (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least")))
    opened = stored(
        meet.groupBy("q", "grp", "at").agg(F.count("*").alias("overlap"), F.min(F.least("n", "least")).alias("small"))
        .where(F.col("overlap") >= 1 + F.floor(F.col("small") / 20)).select("q", "at"), "opened")

    # the sets of classes that open a group or belong to an opened one; rows without a part are mostly
    # sifted out by a slot of their key, of which there are at most SLOTS
    blocks = opened.groupBy("at").agg(F.ceil(F.count("*") / ASKING).alias("blocks"))
    about = classes.select("q", "sig", "copies")
    own = grouped.withColumnRenamed("grp", "at").join(blocks, "at").join(about, "q").select("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "q", "sig", "copies")
    ask = opened.join(blocks, "at").join(about, "q").select("at", F.pmod(F.xxhash64("q", F.lit(2)), "blocks").alias("block"), "q", "sig", "copies")

    def full_sets():
        hashes = _Hashes()

        def work(texts):
            found = [shingles(t, words, hashes).tobytes() for t in texts]
            return [pa.array(map(xxhash.xxh3_128_digest, found), pa.binary()), pa.array(found, pa.binary())]
        return work

    slot = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(SLOTS)).alias("slot")
    slots = own.select("q").union(ask.select("q")).select(slot("q")).distinct()
    wanted = docs.select("key", "text", slot("key")).join(F.broadcast(slots), "slot", "left_semi")
    sets = map_texts(wanted, "text", ["key"], [T.StructField("sig", T.BinaryType()), T.StructField("found", T.BinaryType())], full_sets)
    sets = stored(sets.select(F.col("row.key").alias("q"), "sig", "found"), "full")
    with_sets = lambda rows_: rows_.join(sets, ["q", "sig"]).select("at", "block", "q", "copies", "found")
    own, ask = with_sets(own), with_sets(ask).toDF("at", "block", "q", "copies", "found")

    def verify(group: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        for t in (group, asked):
            each = {q: (n, b) for q, n, b in zip(*t.select(["q", "copies", "found"]).to_pydict().values())}  # repeated rows once
            parts.append((list(each), [n for n, _ in each.values()], [np.frombuffer(b, np.int64) for _, b in each.values()]))
        (mid, mcopies, msets), (aid, acopies, asets) = parts
        in_group = set(mid)
        parent: dict[int, int] = {}
        links: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in linked_within(msets, asets, percent):
            a, m = aid[i], mid[j]
            if a == m:
                continue
            links[a] = links.get(a, 0) + mcopies[j]
            if a not in in_group:  # else the other side asks too
                links[m] = links.get(m, 0) + acopies[i]
            x, y = sorted((root(a), root(m)))
            parent[y] = x
        return pa.table({"a": pa.array(list(parent), pa.int64()), "b": pa.array([root(x) for x in parent], pa.int64()), "links": pa.array([links.get(x, 0) for x in parent], pa.int64())})

    edges = stored(own.groupBy("at", "block").cogroup(ask.groupBy("at", "block")).applyInArrow(verify, "a long, b long, links long"), "links")
    labels = components(edges)
    degrees = edges.groupBy(F.col("a").alias("q")).agg(F.sum("links").alias("links"))
    known = (
        classes.select("sig", "q", "copies").join(labels.withColumnRenamed("node", "q"), "q", "left").join(degrees, "q", "left")
        .select("sig", F.coalesce("label", "q").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    linkable = F.col("key").isNotNull()
    return summary.select("key", "n", F.when(linkable, F.col("sig")).alias("sig")).join(known, "sig", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("label", "key").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
