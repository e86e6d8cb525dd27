"""Edge cases with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pairgrammar.functions import geometry as G
from pairgrammar.functions import keys as K
from pairgrammar.functions import sequence as S
from pairgrammar.operators import graph, intervals, metrics, motifs, selection, splits, stats
from pairgrammar.plans import states as layers


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_hash_bucket_and_split(spark):
    df = spark.createDataFrame([("a",), ("GLI3::RFX3",), ("chr1",), ("xyz",)], "k string")
    got = [tuple(r) for r in df.select(K.hash_bucket("k", 1000), splits.assign_split("k")).collect()]
    assert got == [(610, "train"), (104, "train"), (325, "train"), (241, "train")]


def test_scalar_expressions(spark):
    row = spark.range(1).select(
        S.pad_or_crop(F.lit("ACG"), 6).alias("a"), S.pad_or_crop(F.lit("ACGTA"), 8).alias("b"), S.pad_or_crop(F.lit("ACGTACG"), 4).alias("c"),
        S.reverse_complement(S.reverse_complement(F.lit("ACGTNacgtn"))).alias("d"), G.gap_index(F.lit(-9.0)).alias("e"), G.gap_index(F.lit(0.5)).alias("f"), G.gap_index(F.lit(30.0)).alias("g"),
        K.direction(F.lit(-0.3)).alias("h"), K.direction(F.lit(0.0)).alias("i"), K.direction(F.lit(None).cast("double")).alias("j"),
        K.canonical_biosample(F.lit("K562 and HepG2 mix"), ["K562", "HepG2", "WTC11"]).alias("k"),
        K.parse_effect(F.lit("guide_x_-0.5_0.01"))[0].alias("l"), K.parse_effect(F.lit("bad"))[0].alias("m"),
        S.clean_sequence(F.lit("aaACGXTaa"), 4).alias("n"), S.gc_content(F.lit("GGCA")).alias("o")).first()
    assert tuple(row) == ("NACGNN", "NACGTANN", "CGTA", "ACGTNacgtn", 0, 4, 24, "activating", "", "", "HepG2", -0.5, None, "ACGN", 0.75)


def test_pair_geometry(spark):
    df = spark.createDataFrame([(10, 16, "+", 1.0, 20, 28, "-", 2.0)], "a int, b int, s string, x double, c int, d int, t string, y double")
    g = G.pair_geometry({"start": "a", "end": "b", "strand": "s", "score": "x"}, {"start": "c", "end": "d", "strand": "t", "score": "y"})
    assert tuple(df.select(*g.values()).first()) == ("+-", 11.0, 4.0, 0.0, 3.0)


def test_embed_out_of_bounds(spark):
    df = spark.createDataFrame([("ACGT", 3)], "sequence string, at int")
    with pytest.raises(Exception, match="out of bounds"):
        df.select(S.embed("sequence", F.lit("GG"), "at")).collect()


def test_merge_intervals(spark):
    rows = [("chr1", 1, 5), ("chr1", 5, 8), ("chr1", 10, 12), ("chr1", 11, 15)]
    df = spark.createDataFrame(rows, "chromosome string, start long, end long")
    assert values(selection.merge_intervals(df, ["chromosome"])) == [("chr1", 1, 8), ("chr1", 10, 15)]


@pytest.mark.parametrize("size", [1, 100, 1000])
def test_overlap_count_does_not_depend_on_bins(spark, size):
    regions = spark.createDataFrame([("r0", "c", 0, 10), ("r1", "c", 95, 305)], "region_id string, chromosome string, region_start long, region_end long")
    frags = spark.createDataFrame([("c", 10, 12), ("c", 9, 10), ("c", 0, 1), ("c", 3, 3), ("c", 90, 310)], "chromosome string, start long, end long")
    out = intervals.overlap_pairs(regions, frags, size, salts=2).groupBy("region_id").count()
    assert values(out) == [("r0", 2), ("r1", 1)] == values(intervals.count_overlaps(regions, frags, ["region_id"]).select("region_id", "fragment_count"))


def test_hydrated_windows_at_the_ends(spark):
    chunks = spark.createDataFrame([("c", 0, 0, "acgta"), ("c", 1, 5, "ccc"), ("d", 1, 5, "ggggg")], "chromosome string, chunk_id long, start long, bases string")
    lengths = spark.createDataFrame([("c", 8), ("d", 10)], "chromosome string, chromosome_length long")
    at = [("in", "c", 2), ("before", "c", -2), ("past", "c", 6), ("at_end", "c", 8), ("behind", "c", 20), ("lost", "d", 3), ("far", "c", -4)]
    regions = spark.createDataFrame(at, "seq_id string, chromosome string, window_start long")
    out = intervals.hydrate_windows(regions, chunks, 4, 5, lengths=lengths)
    assert {r["seq_id"]: (r["sequence"], r["hydration_status"]) for r in out.collect()} == {
        "in": ("GTAC", "complete"), "before": ("NNAC", "complete"), "past": ("CCNN", "complete"), "at_end": (None, "incomplete"),
        "behind": (None, "incomplete"), "lost": (None, "incomplete"), "far": (None, "incomplete")}
    states = regions.filter("seq_id in ('past', 'behind')").select(F.col("seq_id").alias("state_label"), "chromosome", (F.col("window_start") + 1).alias("region_start"), (F.col("window_start") + 3).alias("region_end"))
    kept = layers.hydrate_states(states, chunks, 5, 4, lengths)
    assert values(kept.select("state_label", "hydration_status")) == [("behind", "incomplete"), ("past", "complete")]


def test_consensus_tie_and_equal_length_motifs(spark):
    pos = spark.createDataFrame([("m", 0, 5.0, 5.0, 0.0, 0.0), ("m", 1, 0.0, 0.0, 1.0, 9.0)], "motif_id string, position int, A double, C double, G double, T double")
    assert motifs.consensus(pos).first()["consensus"] == "AT"
    two = spark.createDataFrame([(m, i, *[9.0 if b == s[i] else 0.0 for b in "ACGT"]) for m, s in (("p", "ACCG"), ("q", "TTGA")) for i in range(4)], pos.schema)
    hits = motifs.scan_motifs(spark.createDataFrame([("s", "GGACCGTTGAGG")], "seq_id string, sequence string"), motifs.pwm_library(two), 1)
    assert {(r["tf_id"], r["start"], r["strand"]) for r in hits.collect()} == {("p", 2, "+"), ("q", 6, "+")}


def test_scan_tie_prefers_plus_strand(spark):
    pos = spark.createDataFrame([("m", i, *[9.0 if b == "ACGT"[i] else 0.0 for b in "ACGT"]) for i in range(4)], "motif_id string, position int, A double, C double, G double, T double")
    hits = motifs.scan_motifs(spark.createDataFrame([("s", "TTTACGTTTT")], "seq_id string, sequence string"), motifs.pwm_library(pos), 2)
    assert [(r["start"], r["strand"]) for r in hits.orderBy("hit_rank").collect()] == [(3, "+"), (3, "-")]


def test_ranking_metrics(spark):
    tie = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5)], "label double, score double")
    assert metrics.ranking_metrics(tie).first()["auroc"] == 0.5
    step = spark.createDataFrame([(1.0, 0.9), (0.0, 0.8), (1.0, 0.7)], "label double, score double")
    assert metrics.ranking_metrics(step).first()["auprc"] == pytest.approx(0.8333333)
    one = spark.createDataFrame([(1.0, 0.9), (1.0, 0.8)], "label double, score double")
    assert metrics.ranking_metrics(one).first()["auroc"] is None
    with pytest.raises(Exception, match="one class"):
        metrics.ranking_metrics(one, strict=True).collect()


def test_bh_fisher_mann_whitney(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert [round(r["bh_fdr"], 6) for r in stats.bh_fdr(p, "p", ["k"]).orderBy("k").collect()] == [0.03, 0.04, 0.04]
    f = stats.fisher_greater(spark.createDataFrame([(3, 0, 0, 3)], "a long, b long, c long, d long")).first()
    assert f["p_value"] == pytest.approx(0.05) and f["odds_ratio"] == float("inf")
    mw = spark.createDataFrame([("p", 3.0), ("p", 4.0), ("q", 1.0), ("q", 2.0)], "g string, v double")
    assert stats.mann_whitney(mw, "g", "v", "p", "q").first()["p_value"] == pytest.approx(1 / 6)


def test_fisher_tail_against_all_tables():
    from math import comb
    for a, b, c, d in ((3, 0, 0, 3), (0, 4, 5, 1), (5, 5, 5, 5), (12, 3, 2, 30), (0, 0, 3, 2), (40, 400, 3, 900), (1, 0, 0, 0), (0, 0, 0, 0), (700, 5, 800, 6)):
        r, s, n = a + b, a + c, a + b + c + d
        ways = {k: comb(r, k) * comb(n - r, s - k) for k in range(max(0, a - d), min(r, s) + 1)}
        assert stats.fisher_tail(a, b, c, d) == pytest.approx(sum(w for k, w in ways.items() if k >= a) / sum(ways.values()), rel=1e-10)


def test_fisher_tail_of_large_margins(spark):
    import math
    import time
    start = time.perf_counter()
    for shift in (0, 10_000, -10_000, 40_000):
        k = 50_000_000
        p = stats.fisher_tail(k + shift, k - shift, k - shift, k + shift)
        z = (shift - 0.5) / math.sqrt(k / 4)  # the variance of a is n / 16 with all margins n / 2
        assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=5e-3, abs=1e-20)
    assert 0 <= stats.fisher_tail(10**8, 1, 1, 10**8) < 1e-300
    assert time.perf_counter() - start < 10
    rows = spark.createDataFrame([("x", 3, 0, 0, 3), ("y", None, 1, 1, 1), (None, 1, 2, 3, 4)], "k string, a long, b long, c long, d long")
    found = {r["k"]: r["p_value"] for r in stats.fisher_greater(rows, ["k"]).collect()}
    assert found["x"] == pytest.approx(0.05) and found["y"] is None and 0 < found[None] < 1


def test_exact_u_tail_against_all_subsets():
    from itertools import combinations
    for n1, n2 in ((2, 3), (3, 4), (5, 2)):
        us = [sum(1 for i in pick for j in set(range(n1 + n2)) - set(pick) if i > j) for pick in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            assert stats._exact_u_tail(n1, n2, u) == pytest.approx(sum(x >= u for x in us) / len(us))


def test_strata(spark):
    df = spark.createDataFrame([(f"s{i}", float(i)) for i in range(1, 8)], "seq_id string, v double")
    assert [r[0] for r in selection.strata(df, "v").orderBy("v").select("availability_stratum").collect()] == [0, 0, 1, 2, 3, 4, 4]


def test_winner_states(spark):
    rows = [("A", "a1", 1.0), ("A", "a2", 0.0), ("A", "a3", 0.0), ("B", "b1", 1.0), ("B", "b2", 1.0), ("B", "b3", 0.0), ("C", "c1", 0.0), ("C", "c2", 0.0)]
    df = spark.createDataFrame([(s, i, e, e) for s, i, e in rows], "state_label string, seq_id string, evidence_score double, evidence_supported double")
    assert values(selection.label_winners(df).select("seq_id", "usage_label")) == [("a1", 1.0), ("a2", 0.0), ("a3", 0.0)]


def test_extrema_drops_flat_groups(spark):
    df = spark.createDataFrame([("f", 1, 5.0), ("f", 2, 5.0), ("g", 3, 1.0), ("g", 4, 2.0)], "grp string, id int, v double")
    assert values(selection.extrema(df, ["grp"], "v", "id").select("id", "derived_label")) == [(3, 0.0), (4, 1.0)]


def test_odd_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("d", "d")]
    out = graph.identifiability_components(spark.createDataFrame(edges, "left_tf string, right_tf string"))
    assert values(out.select("component", "nodes", "non_bipartite")) == [("a", 3, False), ("d", 1, True), ("x", 3, True)]


def test_competition_split_fills_empty_sets(spark):
    keys = [k for k in (f"k{i}" for i in range(400)) if _split(k) == "train"][:3]
    out = splits.competition_split(spark.createDataFrame([(k, i) for k in keys for i in range(2)], "g string, i int"), "g")
    assert sorted(r["split"] for r in out.select("g", "split").distinct().collect()) == ["test", "train", "valid"]


def _split(key):
    import hashlib
    b = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % 1000
    return "train" if b < 700 else "valid" if b < 850 else "test"


def test_assert_disjoint(spark):
    bad = spark.createDataFrame([("a", "train"), ("a", "test")], "seq_id string, split string")
    with pytest.raises(ValueError):
        splits.assert_disjoint(bad)


def test_rank_test_tells_how_its_tail_was_summed(spark, monkeypatch):
    def methods(p, q):
        rows = [("p", float(v)) for v in p] + [("q", float(v)) for v in q]
        return stats.mann_whitney(spark.createDataFrame(rows, "g string, v double"), "g", "v", "p", "q").first()["p_value_method"]
    assert methods(range(0, 6, 2), range(1, 31, 2)) == "exact"
    assert methods([1, 2], [2, 3]) == "normal" and methods(range(0, 40, 2), range(1, 41, 2)) == "normal"
    assert methods([1, 2], []) is None
    monkeypatch.setattr(stats, "_EXACT_LENGTH", 4)
    assert methods([15, 17], range(0, 40, 2)) == "uniform_sum"
