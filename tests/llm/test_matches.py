"""Searches, joins, packing and the pipeline against plain versions."""

import random

import numpy as np
import pytest

import corpus_pipeline
from pairgrammar.llm import decontaminate, jaccard, packing, topk
from pairgrammar.llm.components import components


def test_threshold_algorithm_equals_sorting():
    draw = np.random.default_rng(7)
    for dims, n in ((1, 5), (3, 40), (8, 300)):
        items = draw.integers(-9, 10, (n, dims))
        ids = draw.permutation(n) * 3
        queries = draw.integers(-9, 10, (6, dims))
        queries[0] = 0
        asking = np.array([*ids[:3], 1, 2, 4])
        got = topk.threshold_top_k(ids, items, asking, queries, 4)
        for q, v in zip(asking, queries):
            want = sorted((-int(x @ v), int(i)) for i, x in zip(ids, items) if i != q)[:4]
            assert [(-s, i) for a, i, s in got if a == q] == want


def test_top_k_frame(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, -2.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (100, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [-0.0001, 1e9])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, v string")
    items = topk.scaled(frame, "vec_id", "embedding")
    got = topk.top_k(items, items.where("id % 100 = 0"), k=3, item_block=2, query_block=1).orderBy("query_id", "rank").collect()
    vectors = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i in (0, 1, 2, 100, 8)}
    want = []
    for q in (0, 100):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert [tuple(r) for r in got] == want
    assert topk.top_k(items.where("false"), items.where("false")).count() == 0


def test_top_k_beyond_a_long(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [1e12, 2e12]), (100, [0.5, 1e-3])]
    items = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = [tuple(r) for r in topk.top_k(items, items.where("id % 100 = 0"), k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (100, 1, 0, 2**53 * 513), (100, 2, 1, 2**53 * 512 + 1024)]


def test_many_items_lose_no_match():
    """More documents times items than fit beside a place in one number."""
    draw = random.Random(11)
    items = [(i, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))) for i in range(136_000)]
    model = decontaminate.index(items)
    docs = [b"nothing here to see"] * 998 + [f"some words and {items[5][1]} more".encode(), f"the end holds {items[-1][1]} at last".encode()]
    found = decontaminate.find(docs, model)
    assert [[m["item_id"] for m in f] for f in found[-2:]] == [[5], [135_999]] and not any(found[:-2])


def sets_of(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_links(rows, words, percent):
    sets = [sets_of(t, words) for _, t in rows]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (key, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        out.append((key, len(sets[i]), min((rows[j][0] for j in reach), default=None) if key is not None else None, len(links[i])))
    return sorted(out, key=str)


def edited(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_links_equal_all_pairs(spark, monkeypatch, words, percent):
    monkeypatch.setattr(jaccard, "GROUP", 8)
    monkeypatch.setattr(jaccard, "ASKING", 8)
    draw = random.Random(words)
    base = [[f"w{draw.randrange(500)}" for _ in range(n)] for n in (30, 120, 400)]
    rows = []
    for i in range(150):
        rows.append((1000 - i, edited(draw, base[i % 3], draw.choice((0, 0, 1, 2, 3, 5)))))
    shared = " ".join(f"common{i}" for i in range(12))
    rows += [(2000 + i, f"{shared} {edited(draw, base[1], 60)}") for i in range(20)]
    rows += [(3000, None), (3001, ""), (3002, "a b"), (3003, "A b"), (None, "a b"), (3004, "one"), (3005, " \t")]
    frame = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, n long, q long, sig string")
    got = sorted((tuple(r) for r in jaccard.link(frame, words=words, percent=percent).collect()), key=str)
    assert got == plain_links(rows, words, percent)


def test_links_of_no_rows(spark, odd):
    assert jaccard.link(odd.where("false")).count() == 0
    assert len(jaccard.link(odd).collect()) == 13


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3), (5, 9)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(edges).collect()} == {**{i: 100 for i in range(100, 141)}, 5: 5, 9: 5}


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_found_items_equal_full_alignment():
    draw = random.Random(11)
    text = lambda n: "".join(draw.choice("abcdefgh  ") for _ in range(n))
    items = [(i, decontaminate.canonical("x" + text(n) + "y")) for i, n in enumerate((20, 45, 80, 130, 200))] + [(9, "tiny"), (10, "")]
    model = decontaminate.index(items)
    docs, kept = [], {i: t for i, t in items if len(t) >= decontaminate.Q}
    for _ in range(60):
        body = text(draw.randint(0, 200))
        for i in draw.sample(sorted(kept), draw.randint(0, 2)):
            part = list(kept[i])
            for _ in range(draw.randint(0, decontaminate.budget(len(part)) + 2)):
                at = draw.randrange(len(part))
                part[at:at + draw.choice((0, 1))] = draw.choice(("", "z", "q"))
            body += "".join(part) + text(draw.randint(0, 60))
        docs.append(decontaminate.canonical(body))
    got = decontaminate.find([d.encode() for d in docs] + [None, b""], model)
    assert got[-2:] == [[], []]
    for doc, found in zip(docs, got):
        want = {i: e for i, t in kept.items() if (e := fewest_edits(t, doc)) <= decontaminate.budget(len(t))}
        assert {f["item_id"]: f["edits"] for f in found} == want
        assert all(0 <= f["end_char"] <= len(doc) for f in found)


def test_contaminated_rows(spark, odd, monkeypatch):
    items = spark.createDataFrame([(1, "THE cat of\nthe house and the dog."), (2, None), (None, "les chats de la maison"), (3, "no such passage anywhere"), (4, "chats de la maison et le")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 40)
    models = decontaminate.passes(items)
    assert len(models) > 1
    assert sorted(tuple(r)[:3] for r in decontaminate.contaminated(odd, models).collect()) == [(0, 1, 0), (1, 1, 0), (6, 4, 0), (10, 4, 0), (10, 4, 0)]
    kept = decontaminate.uncontaminated(odd, models)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "4", "5", "7", "8", "9", "None"]
    assert decontaminate.uncontaminated(odd, decontaminate.passes(items.where("false"))).count() == 13


def plain_best_fit(sizes, sources, clusters, capacity, same):
    """Of all bins in reach, the fullest that is compatible."""
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters):
        fit = [(capacity - b["used"], i) for i, b in enumerate(bins) if b["used"] + n <= capacity and b["sources"].count(s) < same and c not in b["clusters"]]
        best = min(r for r, _ in fit) if fit else None
        out.append(None if best is None else best)
        yield_bin = next((b for r, i in fit if r == best for b in [bins[i]]), None)
        if yield_bin is None:
            bins.append(yield_bin := {"used": 0, "sources": [], "clusters": []})
        yield_bin["used"] += n
        yield_bin["sources"].append(s)
        yield_bin["clusters"].append(c)
    return out


def test_best_fit_takes_the_tightest_compatible_bin():
    draw = random.Random(4)
    for _ in range(50):
        n = draw.randint(1, 60)
        sizes = sorted((draw.randint(1, 40) for _ in range(n)), reverse=True)
        sources, clusters = [draw.choice("abc") for _ in range(n)], [draw.choice((i, 0, 1)) for i in range(n)]
        spots = packing.best_fit(sizes, sources, clusters, 50, 2)
        used, content = {}, {}
        for (b, o), size, s, c in zip(spots, sizes, sources, clusters):
            # replay: the residual chosen is the least among the compatible bins
            fit = [50 - u for x, u in used.items() if u + size <= 50 and [y for y, _ in content[x]].count(s) < 2 and c not in [z for _, z in content[x]]]
            assert (50 - used[b] == min(fit)) if b in used else not fit
            assert o == used.get(b, 0)
            used[b] = o + size
            content.setdefault(b, []).append((s, c))
        assert max(used.values()) <= 50


def test_every_token_has_one_place(spark, odd):
    sized = odd.select("doc_id", "source", packing.word_count(odd["text"]).alias("n_tokens"), odd["text"].alias("cluster"))
    rows = packing.pack(sized, capacity=100, same_source=3).collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        assert (r["bin"] is None) == (r["n_tokens"] == 0)
    assert total == {r["doc_id"]: sum(len((x["text"] or "").split()) for x in odd.collect() if x["doc_id"] == r["doc_id"]) for r in odd.collect()}
    bins = {}
    for r in rows:
        if r["bin"] is not None:
            bins.setdefault(r["bin"], []).append((r["offset"], r["n_tokens"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 100
    assert packing.pack(sized.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    assert all(len(b) <= len(a) for a, b in zip(seen, seen[1:]))
    given = sorted(seen[1].items())
    leaders = {k for k, _, c, _ in plain_links(given, 5, 80) if c == k}
    assert set(seen[2]) == leaders
    items = [decontaminate.canonical(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [k for k, t in seen[3].items() if any(i in decontaminate.canonical(t) for i in items)]
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in placed} == set(seen[3])


def test_repeated_and_null_ids_lose_their_copies(spark):
    """One row of a group stays, whatever its id; an id with two texts loses only the one that is a copy."""
    text = "the quick brown fox jumps over the lazy dog and runs away from all of them again and again until night"
    other = "a second text of its own about boats and rivers which nobody else has written down in these rows so far"
    third = "yet another one that speaks of mountains and snow with enough words to make shingles of five of them"
    rows = [(5, text), (5, text), (None, text), (3, text), (7, other), (7, third), (8, third), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, number long")
    got = corpus_pipeline.distinct(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, text), (7, other), (7, third), (None, None), (9, ""), (9, "")], key=str)


def test_stages_take_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, "/root/testdata/sf0.001")
            assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)
