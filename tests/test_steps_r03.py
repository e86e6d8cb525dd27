"""Steps that findings of round 3 name: they read once, and touch no more places or rows than they need."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairgrammar import views
from pairgrammar.functions import keys as K
from pairgrammar.functions import sequence as S
from pairgrammar.operators import examples as E
from pairgrammar.operators import graph
from pairgrammar.operators import intervals as N
from pairgrammar.operators import motifs as M
from pairgrammar.operators import ordered

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_motif_library_reads_no_text_again(spark):
    found = views.motif_positions(spark, SMALL)
    library = M.pwm_library(found)
    assert "regexp_replace" not in plan(library) and "regexp_replace" not in plan(views.tf_genes(spark, SMALL, found))
    assert "Join" not in plan(library)
    cutoffs = {r.motif_id: r.cutoff for r in M.motif_stats(M.build_pwm(found)).collect()}
    assert cutoffs and all(abs(r.cutoff - cutoffs[r.tf_id]) < 1e-9 for r in library.collect())
    assert {r.cutoff for r in M.pwm_library(found, cutoff=2.5).collect()} == {2.5}


SPANS = [(2, 5, 7, 9), (0, 6, 3, 9), (7, 9, 2, 5), (-3, 4, 8, 40), (3, 3, 5, 4), (None, 4, 2, 6), (2, 5, None, None)]


def spans(spark, text="ACGTNACGTA"):
    rows = [(f"k{i}", text, *span) for i, span in enumerate(SPANS)]
    return spark.createDataFrame(rows, "seq_id string, sequence string, left_start long, left_end long, right_start long, right_end long")


def within(i, a, b):
    return a is not None and b is not None and a <= i < b


def test_masks_and_tensors_test_no_place_against_the_bounds(spark):
    names = ("left_start", "left_end", "right_start", "right_end")
    rows = spans(spark).select(*names, S.region_masks(*names, length=10).alias("m"), F.slice(S.interface_tensor("sequence", *names, length=10), 1, 5).alias("t"))
    assert "lambda" not in plan(spans(spark).select(S.region_masks(*names, length=10)))
    least, most = (lambda *x: min(v for v in x if v is not None)), (lambda *x: max(v for v in x if v is not None))
    for r in rows.collect():
        ls, le, rs, re = r[:4]
        if None not in r[:4]:
            wanted = [(most(ls, rs), least(le, re)), (least(le, re), most(ls, rs)), (most(le - 4, ls), le), (rs, least(rs + 4, re))]
            assert r.m == [[float(within(i, *w)) for i in range(10)] for w in wanted]
            cores = [(ls, le if rs >= le else most(ls, rs)), (rs if rs >= le else least(le, re), re)]
            assert r.t == [[float(c == b and not any(within(i, *x) for x in cores)) for i, c in enumerate("ACGTNACGTA")] for b in "ACGTN"]


def test_random_bases_are_made_for_the_places_of_a_region_only(spark):
    done = E.randomize_region(spans(spark), "left_start", "left_end", 11)
    assert "split(" not in plan(done)
    gc = 4 / 10
    for r in done.collect():
        want = list(r.sequence)
        for i in range(len(want)):
            if within(i, r.left_start, r.left_end):
                u = int(hashlib.sha256(f"11|{r.seq_id}|{i}".encode()).hexdigest()[:15], 16) % 1_000_000 / 1e6
                want[i] = "A" if u < (1 - gc) / 2 else "C" if u < 0.5 else "G" if u < 0.5 + gc / 2 else "T"
        assert r.sequence_randomized == "".join(want)
    whole = {tuple(r[:2]): r for r in E.rerandomize_cores(spans(spark), 11, "out").collect()}
    for (key, text), r in whole.items():
        ls, le, rs, re = (r[n] for n in ("left_start", "left_end", "right_start", "right_end"))
        if None not in (ls, le, rs, re):
            cores = [(ls, min(le, max(ls, rs))), (max(rs, min(le, re)), re)]
            assert r.out == "".join("ACGT"[int(hashlib.sha256(f"11|{key}|{i}".encode()).hexdigest()[:15], 16) % 4] if any(within(i, *c) for c in cores) else x for i, x in enumerate(text))


@pytest.mark.parametrize("hot", [False, True])
def test_only_a_crowded_chromosome_is_cut_into_ranges(spark, monkeypatch, hot):
    cut, plain = [], ordered.with_ranges
    monkeypatch.setattr(ordered, "with_ranges", lambda *args, **more: cut.append(1) or plain(*args, **more))
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    monkeypatch.setattr(ordered, "SMALL_BYTES", 0)
    monkeypatch.setattr(N, "RANGE_ROWS", 100, raising=False)
    pieces = [(f"c{i % 20 if not hot or i % 2 else 0}", (i * 37) % 400, (i * 37) % 400 + i % 50, i % 3) for i in range(600)]
    places = [(f"r{i}", f"c{i % 21}", (i * 53) % 380, (i * 53) % 380 + 40) for i in range(60)]
    fragments = spark.createDataFrame(pieces, "chromosome string, start long, end long, file_id int")
    regions = spark.createDataFrame(places, "state_label string, chromosome string, region_start long, region_end long")
    got = {(r.state_label, r.file_id): r.fragment_count for r in N.count_overlaps(regions, fragments, ["state_label"], ["file_id"]).collect()}
    want = {}
    for label, chromosome, a, b in places:
        for c, start, end, file in pieces:
            if c == chromosome and start < end and a < end and b > start:
                want[label, file] = want.get((label, file), 0) + 1
    assert got == want and bool(cut) == hot


def test_rounds_of_a_graph_compare_numbers(spark, monkeypatch):
    seen, plain = [], graph.with_lowest
    monkeypatch.setattr(graph, "with_lowest", lambda edges, *rest: seen.append(edges.schema["u"].dataType.typeName()) or plain(edges, *rest))
    edges = [("b", "c"), ("c", "d"), ("d", "b"), ("x", "y"), ("y", "z"), ("s", "s"), (None, "q"), ("B", "é"), *[("hub", f"n{i}") for i in range(300)]]
    frame = spark.createDataFrame(edges, "left_tf string, right_tf string")
    found = {r.component: (r.nodes, r.non_bipartite) for r in graph.identifiability_components(frame).collect()}
    assert found == {"b": (3, True), "x": (3, False), "s": (1, True), "B": (2, False), "hub": (301, False)}
    named = {r.node: r.component for r in graph.connected_components(frame).collect()}
    assert {named[k] for k in "bcd"} == {"b"} and named["s"] == "s" and named["é"] == "B" and named["n7"] == "hub" and "q" not in named
    assert seen and set(seen) == {"long"}


def test_edits_are_dealt_once_and_never_broadcast(spark):
    scored = spark.range(2000).selectExpr("concat('k', id % 40) AS seq_id", "id % 50 AS position", "'A' AS alt_base", "explode(array('high', 'low')) AS state_mode", "IF(state_mode = 'high', 2D, 0.5D) AS full_score")
    base = spark.range(40).selectExpr("concat('k', id) AS seq_id", "explode(array('high', 'low')) AS state_mode", "IF(state_mode = 'high', 3D, 0.5D) AS full_score")
    out = E.rank_edits(scored, base, ["seq_id"])
    steps = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in steps and "Broadcast" not in steps and steps.count("Exchange hashpartitioning") == 2
    assert {(r.high_low_margin, r.margin_drop) for r in out.collect()} == {(1.5, 1.0)} and out.count() == 200


def test_nearest_pairs_are_dealt_by_the_number_of_hits(spark, monkeypatch):
    tasks, plain = [], M._nearest_pairs
    monkeypatch.setattr(M, "TASK_HITS", 10)
    monkeypatch.setattr(M, "_nearest_pairs", lambda *args: tasks.append(args[5]) or plain(*args))
    hits = spark.range(300).selectExpr("concat('s', id % 50) AS seq_id", "concat('g', id % 6) AS tf_id", "int(id % 60) AS start", "int(id % 60 + 6) AS end", "'+' AS strand", "1D AS score", "0 AS hit_rank")
    edges = spark.createDataFrame([("x", "y")], "left_tf string, right_tf string")
    assert M.select_pairs(hits, edges, 2).count() > 0 and tasks == [30]


def test_slugs_of_texts_need_no_regular_expression(spark):
    assert "regexp_replace" not in plan(entry.queries()["stable_slug"](spark, SMALL))
    texts = ["", None, "---", " -A_b.C- ", "Ünïcode Straße", "a--b - c", "x\u00a0y\u2028Z\U0001f600", "\x1c\x1f\x85q\x00r\n", "a" + "-" * 3000 + "b\n--", "default"]
    want = sorted(re.sub("[^A-Za-z0-9._-]+", "-", t or "").strip("-").lower() or "default" for t in texts)
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(r.slug for r in K.text_slugs(rows, "text").collect()) == want
    assert sorted(r.slug for r in rows.select(K.slug("text").alias("slug")).collect()) == want
