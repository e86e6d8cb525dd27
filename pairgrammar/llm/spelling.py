"""Spelling variants: words one edit apart, found by pairs of trie nodes around a skipped or inserted place."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrammar.llm.common import slices, small_batches
from pairgrammar.session import scratch_path

DROP_ONE_IN = 199  # of the runs of a document, by their hash, so many lose one letter
LEAST_LENGTH, LEAST_TIMES, RATIO = 6, 5, 5
HELD = 200_000  # distinct words that a task counts before it passes them on
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(doc_id: int | None, text: bytes) -> Counter:
    """Times of each word of a text: runs of letters, A-Z lowered, one in ``DROP_ONE_IN`` without one of its letters."""
    found = Counter(LETTERS.findall(text.lower().decode("utf-8", "replace")))
    out: Counter = Counter()
    prefix = "" if doc_id is None else str(doc_id)
    for run, times in found.items():
        h = zlib.crc32(f"{prefix}:{run}".encode())
        if h % DROP_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_LENGTH:
            out[run] += times
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``word``, ``n`` over all texts (columns ``key``, ``text``), summed in the tasks before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part, texts in slices(batch, batch.column(1)):
                for key, text in zip(part.column(0).to_pylist(), texts):
                    if text:
                        held.update(words_of(key, text))
                if len(held) > HELD:
                    yield flush()
        yield flush()

    return docs.select("key", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ordered(rows: DataFrame, name: str) -> DataFrame:
    """Rows in ranges by ``word``, each sorted and stored, with ``place`` (in word order) and the range's number ``part``."""
    path = scratch_path(rows.sparkSession, name)
    rows = rows.repartitionByRange("word").sortWithinPartitions("word").withColumn("place", F.monotonically_increasing_id())
    rows.withColumn("part", F.shiftright("place", 33)).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def common(a: str, b: str) -> int:
    """How many letters two words begin alike."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


class TrieNumbers:
    """Numbers of trie nodes, given out while sorted words pass by: a word shares the nodes of what it begins like the last one.

    Ranges are numbered side by side. The nodes of a range's last word get a number that the next
    range can name as well, so that a node whose words reach into the next range has one number.
    """

    def __init__(self, bounds: list[tuple[int, str, str]]) -> None:
        self.parts = [p for p, _, _ in bounds]
        self.first, self.last = [f for _, f, _ in bounds], [l for _, _, l in bounds]
        self.inside = [common(f, l) for f, l in zip(self.first, self.last)]
        self.before = [0] + [common(l, f) for l, f in zip(self.last, self.first[1:])]
        self.at = -1

    def _edge(self, range_: int, depth: int) -> int:
        return -(range_ << 31 | depth) - 1

    def _origin(self, depth: int) -> int:
        """The range in which a node begins that reaches into this one."""
        q = self.at - 1
        while self.inside[q] >= depth and self.before[q] >= depth:
            q -= 1
        return q

    def nodes(self, part: int, word: str) -> list[int]:
        """Numbers of the word's prefixes from the empty one (0) to the whole."""
        if self.at < 0 or self.parts[self.at] != part:
            self.at, self.fresh = self.parts.index(part), 0
            self.path, self.word = [0] + [self._edge(self._origin(i), i) for i in range(1, self.before[self.at] + 1)], word
            shared = self.before[self.at]
        else:
            shared = common(self.word, word)
        path, to_last = self.path[:shared + 1], common(word, self.last[self.at])
        for depth in range(shared + 1, len(word) + 1):
            if depth <= to_last:
                path.append(self._edge(self.at, depth))
            else:
                self.fresh += 1
                path.append(self.at << 40 | self.fresh)
        self.path, self.word = path, word
        return path


def number_nodes(rows: DataFrame) -> DataFrame:
    """``id``, ``nodes``, ``fresh`` of rows made by ``ordered``: trie nodes of all prefixes; which letters differ from the one before."""
    ends = rows.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last")).orderBy("part").collect()  # one row a range
    bounds = [(r["part"], r["first"], r["last"]) for r in ends]

    def run(batches):
        trie = TrieNumbers(bounds)
        for batch in batches:
            words = batch.column(2).to_pylist()
            nodes = [trie.nodes(p, w) for p, w in zip(batch.column(1).to_pylist(), words)]
            fresh = [[i == 0 or w[i] != w[i - 1] for i in range(len(w))] for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.list_(pa.int64())), pa.array(fresh, pa.list_(pa.bool_()))], ["id", "nodes", "fresh"])

    return rows.select("id", "part", "word").repartition("part").sortWithinPartitions("part", "word").mapInArrow(run, "id long, nodes array<long>, fresh array<boolean>")


def near_words(words: DataFrame) -> DataFrame:
    """``id``, ``n_near``, ``best`` (n and negative id of the near word of largest n, then smallest) of words that have near ones.

    ``words`` holds ``id`` (in word order), ``word``, ``n``, ``part``. A word gives its pairs (prefix node, suffix
    node) around every letter, and around every gap. Words that share a pair around a letter differ in that letter;
    a word's pair around a gap that equals another's around a letter is that word without the letter. In a row of equal
    letters only the first is skipped for the latter, so that each pair of words is met once. All words at a pair around a
    letter differ in it, so a pair holds at most one word for each of the alphabet's 90 letters, and one more.
    """
    ahead = number_nodes(words)
    back = number_nodes(ordered(words.select("id", F.reverse("word").alias("word")), "reversed")).select("id", F.col("nodes").alias("suffix"))
    both = words.select("id", "n").join(ahead, "id").join(back, "id")
    length = F.size("fresh")
    skipped = both.select("id", "n", F.lit(True).alias("skip"), F.inline(F.arrays_zip(F.slice("nodes", 1, length).alias("a"), F.reverse(F.slice("suffix", 1, length)).alias("b"), "fresh")))
    gaps = both.select("id", "n", F.lit(False).alias("skip"), F.inline(F.arrays_zip(F.col("nodes").alias("a"), F.reverse("suffix").alias("b")))).withColumn("fresh", F.lit(False))
    member = F.struct("n", (-F.col("id")).alias("back"), "skip", "fresh")
    met = skipped.unionByName(gaps).groupBy("a", "b").agg(F.collect_list(member).alias("m")).where(F.size("m") > 1)
    rank = lambda ms: F.array_max(F.transform(ms, lambda m: F.struct(m["n"].alias("n"), m["back"].alias("back"))))
    each = met.select("m", F.explode("m").alias("me"))
    mates = F.filter("m", lambda m: F.when(F.col("me.skip"), (m["skip"] & (m["back"] != F.col("me.back"))) | (~m["skip"] & F.col("me.fresh"))).otherwise(m["fresh"]))
    return each.select((-F.col("me.back")).alias("id"), mates.alias("mates")).where(F.size("mates") > 0).groupBy("id").agg(F.sum(F.size("mates")).cast("long").alias("n_near"), F.max(rank(F.col("mates"))).alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """``id``, ``root`` of every row (``id``, ``form``): the end of its chain. Every round doubles the reach of all; chains cannot close, as n grows."""
    spark = forms.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "roots")
        df.write.parquet(path)
        return spark.read.parquet(path)

    roots = stored(forms.select("id", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while roots.where("moved").limit(1).count():
        further = roots.select(F.col("id").alias("root"), F.col("root").alias("far"))
        roots = stored(roots.join(further, "root", "left").select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
    return roots.select("id", "root")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of at least 6 letters that comes 5 times.

    Words are runs of letters of whole texts (A-Z lowered); by the hash of document key and run, one run in 199 loses a
    letter. Two words are near if one letter was put in, left out or replaced. A word's form is its near word of largest
    ``n`` (ties: the smallest), if that is at least five times its own; its root is the last of the chain of forms.

    The vocabulary is range-partitioned; forward and reversed trie nodes are numbered in its order, and integer pairs
    of nodes are joined. Null and empty texts have no words; a null key reads as the empty text in the hash; repeated
    rows count each; words of any length take part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "vocabulary")
    count_words(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))).where(F.col("n") >= LEAST_TIMES).write.parquet(path)
    words = ordered(spark.read.parquet(path), "words").withColumnRenamed("place", "id")
    path = scratch_path(spark, "near")
    near_words(words).write.parquet(path)
    near = spark.read.parquet(path)
    forms = near.join(words.select("id", "n"), "id").where(F.col("best.n") >= RATIO * F.col("n")).select("id", (-F.col("best.back")).alias("form"), F.col("best.n").alias("form_n"))
    named = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    chains = forms.join(follow(forms), "id").join(named("form"), "form").join(named("root"), "root")
    return words.join(near.select("id", "n_near"), "id", "left").join(chains, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
