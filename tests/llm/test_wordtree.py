"""Chunks that ask for counts against the tables of counts, and their parts against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgrammar.llm import suffixtree, wordtree
from pairgrammar.llm.common import tokens


def test_many_texts_are_scored_without_tables_of_places(spark, odd, monkeypatch):
    """Beyond ``SMALL`` tokens nothing is joined by place, and the scores are those of the tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 1500).alias("text")).repartition(3)
    docs = docs.unionByName(odd.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    order = lambda rows: sorted(rows, key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    want = order(suffixtree.score(docs).collect())
    monkeypatch.setattr(suffixtree, "SMALL", 0)
    monkeypatch.setattr(wordtree, "CHUNK", 5000)
    monkeypatch.setattr(suffixtree, "word_gain", None)
    got = order(suffixtree.score(docs).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert [a[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")] == [b[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")]
        assert (a["base_score"], a["score"]) == pytest.approx((b["base_score"], b["score"]), rel=1e-9)


def test_words_are_cut_as_tokens_are(monkeypatch):
    draw = random.Random(8)
    texts = [None, b"", b" \t", "Ünter A-Z\x0b\x0c\r\n  Ab ab AB".encode(), b"x" * 500 + b" y"] + [bytes(draw.choice(b"aAbB \n\xc3\xa9") for _ in range(draw.randrange(300))) for _ in range(80)]
    words = [tokens(t) for t in texts]
    flat = [w for t in words for w in t]
    for piece in (1 << 21, 64):
        monkeypatch.setattr(wordtree, "PIECE", piece)
        h, tail, size = wordtree.Cutter().cut(texts)
        assert size.tolist() == [len(t) for t in words]
        assert tail.tolist() == [min(len(w), 4) << 24 | int.from_bytes(w[-3:], "big") for w in flat]
        assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_orders_and_packing():
    draw = np.random.default_rng(3)
    keys = draw.integers(0, 1 << 64, 3000, dtype=np.uint64)
    near = np.concatenate([keys, keys[:200] ^ np.uint64(1), keys[:500]])
    for x in (near, near[:1], near[:0], near % np.uint64(50)):
        order, ranked = wordtree.by_hash(x)
        assert sorted(order.tolist()) == list(range(len(x))) and ranked.tolist() == sorted(x.tolist())
        found, spot = wordtree.distinct(x)
        assert found.tolist() == sorted(set(x.tolist())) and found[spot].tolist() == x.tolist()
        assert wordtree.unplaned(wordtree.planes(x)).tolist() == x.tolist()
    own, symbol = draw.integers(0, 40, 500), draw.integers(0, 9, 500)
    for scale in (1, 1 << 40):
        spot, first = wordtree.grouped(own * scale, symbol * scale)
        assert (own[first][spot] == own).all() and (symbol[first][spot] == symbol).all() and len(first) == len(set(zip(own.tolist(), symbol.tolist())))
    kept = np.unique(near)[::2]
    spot = wordtree.Finder(kept).find(near)
    assert [kept[s] == x if s >= 0 else x not in kept for s, x in zip(spot.tolist(), near)].count(False) == 0


def test_buckets_are_those_of_spark(spark):
    x = np.array([0, 1, -1, 5 << 40, (1 << 62) + 17, -(1 << 50)])
    want = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "v long").select(F.pmod(F.hash("v"), F.lit(13)).cast("long")).collect()]
    assert wordtree.bucket_of(x, 13).tolist() == want
    assert wordtree.bucket_of(np.array([wordtree.named_for(5, 7, 900)]), 7).tolist() == [5]
