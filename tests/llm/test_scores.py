"""Language, quality and language-model scores against plain versions."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgrammar.llm import langid, quality, suffixtree


def phrases(text, training):
    """Greedy longest matches against the substrings of a text; a byte never seen is a phrase."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in training and text[i:j] in training:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases_are_longest_matches():
    draw = random.Random(3)
    word = lambda letters, k: bytes(draw.choice(letters) for _ in range(k))
    samples = {"x": word(b"abc", 60), "y": word(b"bcd ", 80)}
    model = langid.build_model(samples)
    texts = [word(b"abcdz ", draw.randint(1, langid.STRIP)) for _ in range(40)] + [word(b"abcd", 3 * langid.STRIP + 5)]
    got = langid.phrase_counts(texts, model)
    for text, row in zip(texts, got):
        strips = [text[i:i + langid.STRIP] for i in range(0, len(text), langid.STRIP)]
        assert row.tolist() == [sum(phrases(s, samples[k]) for s in strips) for k in ("x", "y")]


def test_languages_of_odd_rows(odd):
    model = langid.learn(odd)
    rows = langid.identify(odd, model, odd.columns).collect()
    assert len(rows) == 13
    by = {r["row"]["doc_id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in (2, 3, 5, 7)] == ["und"] * 4 and by[2]["score"] == 0.0
    assert by[6]["lang_pred"] == "fr" and by[0]["lang_pred"] == "en" == by[None]["lang_pred"]
    assert by[4]["row"]["matches"] == "m"


def test_nothing_to_learn_from(spark, odd):
    none = odd.where("false")
    assert langid.identify(none, langid.learn(none), ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(none), ["doc_id"]).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in quality.rate(odd, quality.learn(odd, labels), ["doc_id"]).collect()} == {(0.5, 1)}
    assert suffixtree.score(none).count() == 0


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(1)
    model = {"weight": draw.normal(size=quality.WIDTH) / 4, "shift": 0.2, "turn": draw.normal(size=(2, 2))}
    text = b"One line here.\n\nSecond, longer line of words words!\nx | y | z"
    rows, size = quality.document_features(text)
    unary = rows @ model["weight"] + model["shift"]
    weight = {}
    for path in itertools.product((0, 1), repeat=len(unary)):
        weight[path] = math.exp(sum(u * y for u, y in zip(unary, path)) + sum(model["turn"][a][b] for a, b in zip(path, path[1:])))
    total = sum(weight.values())
    want = sum(sum(w for p, w in weight.items() if p[i]) / total * n for i, n in enumerate(size)) / size.sum()
    assert quality.good_share(text, model) == pytest.approx(want)


def test_gradient_raises_likelihood_and_separates():
    good = [(b"It was a fine day.\nThe sun shone on the house.", 1)] * 20
    bad = [(b"WIN | NOW | $$$ | 77\n%%% | 99 | @@", 0)] * 20
    model = quality.fit(good + bad, rounds=60)
    assert quality.good_share(good[0][0], model) > 0.9 > 0.1 > quality.good_share(bad[0][0], model)
    assert 0 <= quality.good_share(None, model) <= 1 and quality.good_share(None, model) == quality.good_share(b"", model)
    assert quality.fit(good) is None


@pytest.mark.parametrize("table", ["documents"])
def test_held_out_accuracy(spark, table):
    docs = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    lang = [r["row"]["lang"] == r["lang_pred"] for r in langid.identify(docs, langid.learn(docs), ["doc_id", "lang"]).collect() if held(r["row"]["doc_id"])]
    assert sum(lang) / len(lang) > 0.98
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rated = quality.rate(docs, quality.learn(docs, labels), ["doc_id"]).collect()
    right = [r["predicted"] == truth[r["row"]["doc_id"]] for r in rated if r["row"]["doc_id"] in truth and held(r["row"]["doc_id"])]
    assert sum(right) / len(right) > 0.97


def test_suffix_tree_by_hand():
    """Next-symbol probabilities of a grown tree sum to one and follow the longest retained suffix."""
    draw = random.Random(5)
    texts = []
    for _ in range(200):
        out = [draw.choice((4, 5))]
        while len(out) < 12:
            out.append({4: 5, 5: 4}[out[-1]] if draw.random() < 0.9 else draw.choice((4, 5, 6)))
            out[-1] = 4 if out[-1] == 6 and draw.random() < 0.5 else out[-1]
            out = [4 if x == 6 else x for x in out]
        texts.append(np.array(out))
    symbols, place, _ = suffixtree.sequence(texts)
    parts = []
    for d in range(suffixtree.DEPTH + 1):
        code = suffixtree.contexts(symbols, d)[place >= max(1, d)]
        key, n = np.unique(code << suffixtree.BITS | symbols[place >= max(1, d)], return_counts=True)
        parts.append(np.stack([key >> suffixtree.BITS, key & 0xFFF, n]))
    tree = suffixtree.grow(*np.concatenate(parts, axis=1), symbols=7)
    assert 1 < len(tree["nodes"]) and 0 in tree["nodes"]
    for node in tree["nodes"].tolist():
        if node:
            assert suffixtree.shorter(np.array([node]))[0] in tree["nodes"]
    for before in ([4], [5, 4], [4, 5, 5], [6, 6]):
        total = 0.0
        for nxt in range(7):
            s = np.array([suffixtree.START, *before, nxt])
            total += 10 ** suffixtree.follow(s, np.arange(len(s)), tree)[-1]
        assert total == pytest.approx(1.0)


def test_unigram_base(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    words = lambda t: (t or "").encode().lower().split()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    seen, ends = Counter(), 0
    for r in rows:
        if not held(r["doc_id"]):
            seen.update(words(r["text"]))
            ends += 1
    n, v = sum(seen.values()) + ends, len(seen) + 1
    prob = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((str(r["doc_id"]), held(r["doc_id"]), len(words(r["text"])) + 1, sum(seen[w] > 0 for w in words(r["text"])) + 1, n, round(sum(prob(seen[w]) for w in words(r["text"])) + prob(ends), 6)) for r in rows)
    got = suffixtree.score(odd).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_tree_beats_the_base_on_held_out_text(spark):
    rows = [r for r in suffixtree.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_contexts_of_rare_words_are_retained(spark):
    """A phrase of words too rare for a class of their own: its share sinks as other text is added, its contexts stay."""
    draw = random.Random(7)
    noise = lambda k: " ".join(f"n{draw.randrange(40)}" for _ in range(k))
    texts = ["qualm zebu yonder vixen"] * 40 + [noise(2500) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "qualm zebu yonder vixen") for i in range(9)] + [(2000 + i, "zebu qualm vixen yonder") for i in range(9)]
    got = {r["doc_id"]: r for r in suffixtree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = lambda lo: [got[i]["score"] - got[i]["base_score"] for i in range(lo, lo + 9) if got[i]["held_out"]]
    assert held(1000) and held(2000) and min(held(1000)) > max(held(2000)) + 2


def test_only_frequent_contexts_are_counted(spark, monkeypatch):
    """Words that come often, in pairs that do not: no pair of them is counted as a context."""
    draw, seen, plain = random.Random(11), {}, suffixtree.count_followers
    monkeypatch.setattr(suffixtree, "count_followers", lambda rows, depth, bits: seen.setdefault(depth, plain(rows, depth, bits)))
    texts = [" ".join(f"n{draw.randrange(60)}" for _ in range(100)) for _ in range(60)] + ["qualm zebu yonder vixen"] * 40
    suffixtree.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert seen[1].count() > 1000 and seen[2].count() == 3 and seen[3].count() == 2


@pytest.mark.parametrize("head", [0, 64, 4096])
def test_the_tree_that_travels_gives_what_the_joined_one_gives(spark, monkeypatch, head):
    """Scores do not depend on how many counts travel to the tasks: none, some of them, or all."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 1500).alias("text"))
    want = {r["doc_id"]: r["score"] for r in suffixtree.score(docs).collect()}
    monkeypatch.setattr(suffixtree, "HEAD", head)
    got = {r["doc_id"]: r["score"] for r in suffixtree.score(docs).collect()}
    assert got == pytest.approx(want, rel=1e-9)
