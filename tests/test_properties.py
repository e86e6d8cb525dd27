"""Operators against brute force on small random data."""

import hashlib
import inspect
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgrammar.operators import examples, graph, intervals, joins, motifs, ordered, resampling, selection, splits, stats, summaries
from pairgrammar.queries import plans
from pairgrammar.queries.catalog import QUERIES
from pairgrammar.streaming import jobs


def test_ranges_give_plain_window_results(spark):
    """A hot group, nulls in group and keys, both directions, cut into many ranges."""
    rnd = random.Random(3)
    some = lambda v: None if rnd.random() < 0.2 else v
    rows = [(some("hot" if i % 3 else f"g{i % 7}"), some(rnd.randrange(40)), some(f"n{rnd.randrange(9)}"), f"id{i:04d}", some(float(rnd.randrange(100)))) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, n string, id string, v double")
    measures = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "r": ("sum", F.lit(1))}
    for order in (["-k", "id"], ["k", "-n", "id"], ["-n", "k", "-id"]):
        for exclusive in (False, True):
            cut = ordered.running(df, ["g"], order, measures, exclusive=exclusive, ranges=23).select("id", *measures)
            plain = ordered.running(df, ["g"], order, measures, exclusive=exclusive, ranges=1).select("id", *measures)
            assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
    ranges = ordered.with_ranges(df, ["g"], ["-k", "id"], 40).groupBy("g").agg(F.count_distinct("_range").alias("n"))
    assert {r["g"]: r["n"] for r in ranges.collect()}["hot"] > 10


def test_one_repeated_key_is_cut(spark):
    df = spark.range(4000).select(F.lit("x").alias("g"), F.lit(1).alias("k"), F.col("id"))
    sizes = [r["count"] for r in ordered.with_ranges(df, ["g"], ["k"], 10).groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1200
    assert sorted(r["r"] for r in ordered.ranked(df, ["g"], ["k"], "r", ranges=10).collect()) == list(range(1, 4001))


def test_rows_decide_on_ranges(spark, monkeypatch, tmp_path):
    """A small file that becomes many rows is cut; lists in chunks put together are the whole list."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    path = str(tmp_path / "few")
    spark.createDataFrame([("x", 900), ("y", 3)], "g string, n int").coalesce(1).write.parquet(path)
    many = spark.read.parquet(path).select("g", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    assert ordered._sized(many)[1] == 10 and ordered._sized(spark.read.parquet(path))[1] == 1
    got = ordered.ranked(many, ["g"], ["-k"], "r")
    assert {(r["g"], r["k"], r["r"]) for r in got.collect()} == {(g, k, n + 1 - k) for g, n in (("x", 900), ("y", 3)) for k in range(1, n + 1)}
    values = many.withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    whole = {r["g"]: r["values"] for r in summaries.distinct_list(values, "g", "k").collect()}
    chunks = summaries.distinct_chunks(values, "g", "k", 50).collect()
    assert max(len(r["values"].split(",")) for r in chunks) == 50
    for g in "xy":
        assert ",".join(r["values"] for r in sorted(chunks, key=lambda r: r["chunk"]) if r["g"] == g) == whole[g]
    assert summaries.distinct_chunks(values.where("k is null"), "g", "k").count() == 0


def test_six_families_of_odd_windows(spark):
    """Missing phases and states: a window is in the families of its phase alone, a missing state is the text nan."""
    rows = [("a", "phase2", "T1::T2", "s", "en"), ("b", "phase3", "T1::T2", None, "fr"), ("c", None, None, "s", None), ("d", "phase5", "T1::T9", "s", "en")]
    w = spark.createDataFrame(rows, "seq_id string, phase string, tf_pair_label string, state_label string, chromosome string")
    tfs = spark.createDataFrame([("T1", "F", "S", ""), ("T2", "F", "R", "P")], "gene_symbol string, family string, subfamily string, paralog_group string")
    got = {(r["seq_id"], r["split_name"]): r["group_value"] for r in splits.all_splits(w, tfs).collect()}
    pairs = ["seen", "unseen_pair", "unseen_family", "unseen_subfamily"]
    assert sorted(got) == sorted([(i, n) for i in "ad" for n in pairs] + [(i, "unseen_state") for i in "bd"] + [(i, "sequence_locus") for i in "abcd"])
    assert got["b", "unseen_state"] == got["c", "sequence_locus"] == "nan" and got["a", "seen"] == "a" and got["a", "unseen_family"].startswith("F::F::paralog::")


def test_overlap_counts_in_one_crowded_bin(spark):
    rnd = random.Random(8)
    frags = [("c1" if rnd.random() < 0.9 else "c2", (a := rnd.randrange(60)), a + rnd.randrange(0, 9)) for _ in range(800)] + [(None, 1, 5)]
    regions = [(i, rnd.choice(["c1", "c2", "c3"]), (a := rnd.randrange(60)), a + rnd.randrange(0, 12)) for i in range(60)]
    got = intervals.count_overlaps(spark.createDataFrame(regions, "region_id int, chromosome string, region_start long, region_end long"), spark.createDataFrame(frags, "chromosome string, start long, end long"), ["region_id"])
    want = {i: sum(c == k and s < b and e > a and e > s for k, s, e in frags) for i, c, a, b in regions}
    assert {r["region_id"]: r["fragment_count"] for r in got.collect()} == want
    # per file, and with one crowded place: no join of hits in the plan
    files = [(*f, i % 3) for i, f in enumerate(frags)] + [("c1", 10, 12, 7)] * 500
    per = intervals.count_overlaps(spark.createDataFrame(regions, "region_id int, chromosome string, region_start long, region_end long"), spark.createDataFrame(files, "chromosome string, start long, end long, file_id int"), ["region_id"], ["file_id"])
    assert {(r["region_id"], r["file_id"]): r["fragment_count"] for r in per.collect()} == {
        (i, f): n for i, c, a, b in regions for f in (0, 1, 2, 7) if (n := sum(c == k and s < b and e > a and e > s and f == g for k, s, e, g in files))}
    assert "_bin" not in per._jdf.queryExecution().optimizedPlan().toString()


def _anchors(n_seq, per):
    rnd = random.Random(5)
    return [(f"s{s}", f"t{rnd.randrange(5)}", a, a + 6, rnd.choice("+-"), round(rnd.random() * 3, 1)) for s in range(n_seq) for a in rnd.sample(range(80), per)]


@pytest.mark.parametrize("k", [1, 2, 5, 64])
def test_generated_pairs_equal_all_pairs(spark, k):
    rows = _anchors(4, 12)
    df = spark.createDataFrame(rows, "seq_id string, tf_id string, start int, end int, strand string, score double")
    got = {r["pair_id"]: r["coarse_additive_score"] for r in motifs.generate_pairs(df, k).collect()}
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[5], r[1], r[2], r[4]))
        sums = sorted((round(a[5] + b[5], 6) for a, b in itertools.combinations(mine, 2)), reverse=True)[:k]
        assert [got[f"{s}::pair::{i}"] for i in range(len(sums))] == sums
    assert len(got) == 4 * min(k, 66)


def test_selected_pairs_equal_all_pairs(spark):
    rnd = random.Random(9)
    hits, widths = [], {f"t{i}": rnd.choice([6, 7, 8]) for i in range(8)}
    for s in range(6):
        for t in rnd.sample(sorted(widths), 1 if s == 0 else 6):
            for rank in range(2):
                a = rnd.randrange(80)
                hits.append((f"s{s}", t, a, a + widths[t], rnd.choice("+-"), 1.0, rank))
    edges = [("t0", "t1"), ("t3", "t2"), ("t5", "t5")]
    df = spark.createDataFrame(hits, "seq_id string, tf_id string, start int, end int, strand string, score double, hit_rank int")
    out = motifs.select_pairs(df, spark.createDataFrame(edges, "left_tf string, right_tf string"), 3)
    got = {}
    for r in out.orderBy("seq_id", "pair_rank").collect():
        got.setdefault(r["seq_id"], []).append((r["left_tf"], r["right_tf"], r["left_start"], r["right_start"]))
    known = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    for s in {h[0] for h in hits}:
        mine = [h for h in hits if h[0] == s]
        pairs = [(a, b) for a in mine for b in mine if a[1] < b[1]] or [(a, b) for a in mine for b in mine if a[6] < b[6]]
        def order(p):
            a, b = p
            return (-((a[1], b[1]) in known), -(a[3] - a[2] + b[3] - b[2]), abs(b[2] - a[3] - 6), max(0, min(a[3], b[3]) - max(a[2], b[2])), a[6] + b[6], a[1], b[1], a[6])
        assert got[s] == [(a[1], b[1], a[2], b[2]) for a, b in sorted(pairs, key=order)[:3]]


def test_pairs_are_found_without_python(spark):
    """Many genes of one width, so that partners are searched by place; ties in place; hits of one gene only; and a plan of the JVM alone."""
    rnd = random.Random(12)
    hits = []
    for s in range(12):
        for t in range(rnd.choice((1, 2, 9, 30))):
            for rank in range(rnd.choice((1, 2, 5))):
                a = rnd.randrange(12) * 3
                hits.append((f"s{s}", f"t{t:02d}", a, a + (7 if t % 5 else 8), rnd.choice("+-"), 1.0, rank))
    edges = [("t00", "t01"), ("t05", "t02"), ("t03", "t03")]
    df = spark.createDataFrame(hits, "seq_id string, tf_id string, start int, end int, strand string, score double, hit_rank int")
    known = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    for n in (1, 4):
        out = motifs.select_pairs(df, spark.createDataFrame(edges, "left_tf string, right_tf string"), n)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
        got = {}
        for r in out.orderBy("seq_id", "pair_rank").collect():
            got.setdefault(r["seq_id"], []).append((r["left_tf"], r["right_tf"], r["left_start"], r["right_start"], r["left_rank"], r["right_rank"]))
        for s in {h[0] for h in hits}:
            mine = [h for h in hits if h[0] == s]
            pairs = [(a, b) for a in mine for b in mine if a[1] < b[1]] or [(a, b) for a in mine for b in mine if a[6] < b[6]]
            def order(p):
                a, b = p
                return (-((a[1], b[1]) in known), -(a[3] - a[2] + b[3] - b[2]), abs(b[2] - a[3] - 6), max(0, min(a[3], b[3]) - max(a[2], b[2])), a[6] + b[6], a[1], b[1], a[6])
            assert got.get(s, []) == [(a[1], b[1], a[2], b[2], a[6], b[6]) for a, b in sorted(pairs, key=order)[:n]]


def test_hubs_stay_spread(spark):
    """A star with nearly all edges on one node: no task holds more than a quarter of the rows, and components are right."""
    star = [("hub", f"n{i:05d}") for i in range(6000)] + [(f"x{i}", f"x{i + 1}") for i in range(20)] + [("n00003", "tail")]
    edges = spark.createDataFrame(star, "left_tf string, right_tf string").repartition(8)
    both = edges.select(F.col("left_tf").alias("u"), F.col("right_tf").alias("v")).unionByName(edges.select(F.col("right_tf").alias("u"), F.col("left_tf").alias("v")))
    near = graph.with_lowest(both, F.min("v"), 2 * len(star))
    sizes = [r["count"] for r in near.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2 * len(star) and max(sizes) <= sum(sizes) / 4
    assert {(r["u"], r["m"]) for r in near.select("u", "m").distinct().collect()} >= {("hub", "n00000"), ("tail", "n00003"), ("n00003", "hub"), ("x0", "x1")}
    found = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert {n for n, c in found.items() if c == "hub"} == {"hub", "tail", *[f"n{i:05d}" for i in range(6000)]} and {found[f"x{i}"] for i in range(21)} == {"x0"}


def test_scan_equals_naive_scan(spark):
    rnd = random.Random(1)
    seqs = [(f"s{i}", "".join(rnd.choice("ACGTN") for _ in range(rnd.choice([3, 20, 31])))) for i in range(8)]
    mats = {m: [[rnd.randrange(1, 9) for _ in range(4)] for _ in range(w)] for m, w in (("a", 4), ("b", 4), ("c", 5))}
    pos = spark.createDataFrame([(m, i, *map(float, r)) for m, rows in mats.items() for i, r in enumerate(rows)], "motif_id string, position int, A double, C double, G double, T double")
    lib = motifs.pwm_library(pos, cutoff=0.2)
    got = sorted((r["seq_id"], r["tf_id"], r["hit_rank"], r["start"], r["strand"]) for r in motifs.scan_motifs(spark.createDataFrame(seqs, "seq_id string, sequence string"), lib, 3).collect())
    table = {r["tf_id"]: r["matrix"] for r in lib.collect()}
    flip = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}
    want = []
    for sid, seq in seqs:
        for m, flat in table.items():
            w, found = len(flat) // 4, []
            for p in range(len(seq) - w + 1):
                win = seq[p:p + w]
                for strand, text in (("+", win), ("-", "".join(flip[c] for c in reversed(win)))):
                    score = round(sum(flat[4 * j + "ACGT".index(c)] for j, c in enumerate(text) if c != "N"), 6)
                    if score >= 0.2:
                        found.append((-score, p, strand))
            want += [(sid, m, i, p, st) for i, (_, p, st) in enumerate(sorted(found)[:3])]
    assert got == sorted(want)


def test_shuffle_keeps_ends_counts_and_is_repeatable(spark):
    rnd = random.Random(2)
    seqs = [(f"s{i}", "".join(rnd.choice("ACGT") for _ in range(60))) for i in range(20)] + [("n", "ACGNNACG"), ("t", "AC")]
    df = spark.createDataFrame(seqs, "seq_id string, sequence string")
    one = {r["seq_id"]: r["shuffled"] for r in examples.shuffle_dinucleotide(df, 7).collect()}
    two = {r["seq_id"]: r["shuffled"] for r in examples.shuffle_dinucleotide(df.repartition(5), 7).collect()}
    assert one == two and one["n"] == "ACGNNACG"
    assert sum(one[i] != s for i, s in seqs) > 15
    for i, s in seqs:
        count = lambda t: sorted(t[j:j + 2] for j in range(len(t) - 1))
        assert (one[i][0], one[i][-1], count(one[i])) == (s[0], s[-1], count(s))


def test_checked_join_rejects_duplicates(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([("a", 3)], "k string, y int")
    assert joins.checked_join(left, right, ["k"], "many_to_one").count() == 2
    with pytest.raises(Exception, match="not unique"):
        joins.checked_join(left, right, ["k"], "one_to_one").collect()


def test_bootstrap_does_not_depend_on_partitions(spark):
    rnd = random.Random(4)
    rows = [(f"s{i}", float(rnd.random() < 0.4), round(rnd.random(), 2), round(rnd.random(), 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "seq_id string, label double, m double, b double")
    one = stats.paired_bootstrap(df, "m", "b", "auroc", 10, 3).first()
    assert one == stats.paired_bootstrap(df.repartition(7), "m", "b", "auroc", 10, 3).first()


def test_repeated_stream_batch_counts_once(spark, tmp_path):
    store, src = str(tmp_path / "store"), str(tmp_path / "src")
    spark.createDataFrame([("a", "x"), ("b", "y")], "seq_id string, sequence string").write.parquet(src)
    status = lambda df: df.select("seq_id", F.lit(True).alias("has_candidate"), F.lit("m").alias("pair_mode"), F.lit(0.0).alias("pair_reference_supported"))
    for checkpoint in ("c1", "c2"):  # a lost checkpoint replays batch 0
        stream = spark.readStream.schema("seq_id string, sequence string").parquet(src)
        jobs.stream_candidates(stream, store, str(tmp_path / checkpoint), status).awaitTermination()
    assert jobs.read_store(spark, store, jobs.CANDIDATE_STATUS).count() == 2
    assert spark.read.parquet(store).count() == 2


def _feed(spark, rows, schema, path, parts):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_do_not_grow_with_batches(spark, tmp_path):
    """Tops keep at most 2 k rows, seen ids need no store, marks add up; the session's state store setting stays."""
    rnd = random.Random(6)
    before = spark.conf.get(jobs.PROVIDER, "")
    regions = [(f"S{i % 90}", f"E{i % 90}", f"c{i % 90 % 3}", i % 90 * 10, i % 90 * 10 + 5, ("pELS", "dELS", "other")[i % 90 % 3]) for i in range(200)]
    rnd.shuffle(regions)
    schema = "screen_id string, encode_id string, chromosome string, region_start long, region_end long, element_type string"
    top = str(tmp_path / "top")
    jobs.stream_top_regions(_feed(spark, regions, schema, str(tmp_path / "r"), 12), 7, top, str(tmp_path / "cr")).awaitTermination()
    assert spark.read.parquet(top).count() <= 14 and len(list((tmp_path / "top").glob("batch_id=*"))) == 2
    want = selection.sample_regions(spark.createDataFrame(list(set(regions)), schema), 7).select("state_label")
    assert {r[0] for r in jobs.read_top_regions(spark, top).select("state_label").collect()} == {r[0] for r in want.collect()}
    ids = [(f"id{i % 40}", "x") for i in range(120)]
    status = lambda df: df.select("seq_id", F.lit(True).alias("has_candidate"), F.lit("m").alias("pair_mode"), F.lit(0.0).alias("pair_reference_supported"))
    store = str(tmp_path / "store")
    jobs.stream_candidates(_feed(spark, ids, "seq_id string, sequence string", str(tmp_path / "i"), 9), store, str(tmp_path / "ci"), status).awaitTermination()
    assert spark.read.parquet(store).count() == 40
    frags = [("c1", a := rnd.randrange(50), a + rnd.randrange(0, 9)) for _ in range(300)] + [("c1", 20, 21)] * 300
    spans = [(f"r{i}", "c1", i * 3, i * 3 + 4) for i in range(18)]
    marks = str(tmp_path / "marks")
    jobs.stream_overlaps(_feed(spark, frags, "chromosome string, start long, end long", str(tmp_path / "f"), 6), marks, str(tmp_path / "cf")).awaitTermination()
    assert max(r["count"] for r in spark.read.parquet(marks).groupBy("batch_id").count().collect()) <= 120
    got = jobs.read_overlaps(spark, marks, spark.createDataFrame(spans, "region_id string, chromosome string, region_start long, region_end long"))
    assert {r["region_id"]: r["fragment_count"] for r in got.collect()} == {i: n for i, _, a, b in spans if (n := sum(s < b and e > a and e > s for _, s, e in frags))}
    assert spark.conf.get(jobs.PROVIDER, "") == before


def test_replicates_do_not_depend_on_ranges(spark, monkeypatch):
    """Scores that repeat, one score of all rows, and one score in each list, cut into many ranges: the same metrics."""
    rnd = random.Random(21)
    mixed = [("g" + str(i % 2), f"s{i}", float(rnd.random() < 0.4), rnd.randrange(12) / 12, rnd.randrange(12) / 12) for i in range(120)]
    alike = [("g0", f"s{i}", float(i % 3 == 0), 0.5, i / 200) for i in range(90)]
    flat = [("g0", f"s{i}", float(i % 3 == 0), 0.5, 0.5 if i % 4 else 0.25) for i in range(90)]
    for rows, size in ((mixed, 36), (alike, 18), (flat, 18)):
        df = spark.createDataFrame(rows, "g string, seq_id string, label double, m double, b double")
        for kind in ("poisson", "swap"):
            found = []
            for limit in (10**9, 300, 40):
                monkeypatch.setattr(resampling, "TASK_CELLS", limit)
                out = resampling.replicate_metrics(df, ["g"], kind, 9, 5, "seq_id").collect()
                found.append(sorted((r["g"], r["replicate"], r["metric_name"], round(r["model_metric"], 9), round(r["baseline_metric"], 9)) for r in out))
            assert found[0] == found[1] == found[2] and len(found[0]) == size


def test_weighted_cells_equal_their_rows():
    """What a replicate makes of cells equals sorting the rows that it drew."""
    rnd = np.random.default_rng(3)
    score, label, count = np.sort(rnd.integers(0, 6, 40) / 6)[::-1], rnd.integers(0, 2, 40).astype(float), rnd.integers(1, 30, 40)
    key, first = rnd.integers(0, resampling.PRIME, 40), rnd.random(40) < 0.5
    a, b = resampling.constants(5, 7)
    for kind in ("poisson", "swap"):
        drawn = resampling.draws(kind, key, count, a, b)
        got, _ = resampling._sums(score, label, key, count, first, kind, a, b, None)
        own = first[:, None]
        weights = (np.where(own, count[:, None] - drawn, drawn), np.where(own, drawn, count[:, None] - drawn)) if kind == "swap" else (drawn * own, drawn * ~own)
        for side, w in enumerate(weights):
            for r in range(7):
                pos, neg = w[:, r] * (label > 0.5), w[:, r] * (label <= 0.5)
                tp, fp = np.array([pos[score >= s].sum() for s in score]), np.array([neg[score >= s].sum() for s in score])
                equal = np.array([neg[score == s].sum() for s in score])
                want = [pos.sum(), neg.sum(), (pos * tp / np.maximum(tp + fp, 1)).sum(), (pos * (fp - equal / 2)).sum()]
                assert got[side, :, r] == pytest.approx(want)


@pytest.mark.parametrize("kind", ["poisson", "swap"])
def test_cell_draws_have_the_law_of_their_rows(kind):
    a, b = resampling.constants(9, 4000)
    for count in (1, 2, 7, 64, 1000, 12345, 3 * 10**9):
        got = resampling.draws(kind, np.array([12345 + count % 1000]), np.array([count]), a, b)[0]
        mean, var = (count, count) if kind == "poisson" else (count / 2, count / 4)
        assert abs(got.mean() - mean) < 5 * (var / 4000) ** 0.5 and 0.85 < got.var() / var < 1.15
        assert got.min() >= 0 and (kind == "poisson" or got.max() <= count)
    assert resampling.thresholds("poisson", 0)[1].tolist() == [int(resampling.PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(10)]


def test_hypergeometric_beyond_numpy(monkeypatch):
    """The own draws against numpy's law where both work, and moments where only they do."""
    for good, bad, size in ((30, 50, 25), (7, 400, 60), (400, 7, 390), (50, 50, 3), (1000, 3000, 900)):
        exact = np.array([math.comb(good, k) * math.comb(bad, size - k) / math.comb(good + bad, size) for k in range(min(good, size) + 1) if size - k <= bad])
        low = max(0, size - bad)
        with monkeypatch.context() as m:
            m.setattr(resampling, "NUMPY_LIMIT", 0)
            got = resampling.hypergeometric(np.random.default_rng(1), good, bad, np.full(40000, size))
        seen = np.bincount(got - low, minlength=len(exact))[:len(exact)] / 40000
        assert len(exact) >= got.max() - low + 1 and np.abs(seen - exact).max() < 0.012
    good, bad, size = 4 * 10**9, 10**10, 3 * 10**9
    got = resampling.hypergeometric(np.random.default_rng(2), good, bad, np.full(4000, size))
    p, n = good / (good + bad), good + bad
    var = size * p * (1 - p) * (n - size) / (n - 1)
    assert abs(got.mean() - size * p) < 5 * (var / 4000) ** 0.5 and 0.85 < got.var() / var < 1.15


def test_subsets_of_counted_cells(spark, monkeypatch):
    """Every subset has the asked size; sums over billions of rows, given by counts, have the permutation's moments."""
    rnd = random.Random(8)
    rows = spark.createDataFrame([(1.0, rnd.randrange(10**6), c) for c in (1, 1, 3, 8, 9, 50, 200) * 5], "_v double, _key long, _count long")
    total = 5 * (1 + 1 + 3 + 8 + 9 + 50 + 200)
    for limit in (10**9, 200):
        monkeypatch.setattr(resampling, "TASK_CELLS", limit)
        assert {r["subset_sum"] for r in resampling.subset_sums(rows, 431, total, 9, 5).collect()} == {431.0}
    counts = [rnd.randrange(1, 10**8) for _ in range(300)] + [1, 2, 5]
    values = [rnd.random() for _ in counts]
    n = sum(counts)
    assert n > 10**10
    frame = spark.createDataFrame([(v, rnd.randrange(10**9), c) for v, c in zip(values, counts)], "_v double, _key long, _count long")
    mean = sum(v * c for v, c in zip(values, counts)) / n
    spread = sum((v - mean) ** 2 * c for v, c in zip(values, counts)) / n
    size = n // 3
    for limit in (10**9, 30000):  # one block, many blocks
        monkeypatch.setattr(resampling, "TASK_CELLS", limit)
        got = np.array([r["subset_sum"] for r in resampling.subset_sums(frame, size, n, 1000, 5).collect()])
        var = size * spread * (n - size) / (n - 1)
        assert len(got) == 1000 and abs(got.mean() - size * mean) < 5 * (var / 1000) ** 0.5 and 0.8 < got.var() / var < 1.2


def test_layer_regions_lie_in_every_step_of_every_document(spark):
    sizes = {0: 0, 1: 1, 2: 50, 3: 51, 4: 299, 5: 300, 6: 301, 7: 650, 8: 900}
    seqs = spark.createDataFrame([(d, "A" * n) for d, n in sizes.items()], "doc_id long, bases string")
    rows = plans.layer_regions(seqs).collect()
    want = {(f"d{d}", i + (50 if n - i > 50 else 0), i + min(200, n - i)) for d, n in sizes.items() for i in range(0, n, 300)}
    assert len(rows) == len(want) and {(r["chromosome"], r["region_start"], r["region_end"]) for r in rows} == want
    assert selection.sample_regions(plans.layer_regions(seqs), None).count() == len(want)


def test_resampling_queries_run_the_published_counts(spark, monkeypatch):
    """Defaults against brute force on a small fixture, and what the registered queries ask for."""
    rnd = random.Random(4)
    rows = [(f"s{i}", ("pELS", "dELS")[i % 2], round(rnd.random() + 0.15 * (i % 2 == 0), 3)) for i in range(24)]
    p, grain = resampling.PRIME, resampling.thresholds("poisson", 0)[1].tolist()
    part = lambda text: int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    diffs = []
    for k in range(1, 10001):
        a, b, sums = 1 + part(f"11|{k}|a") % (p - 1), part(f"11|{k}|b") % p, {"pELS": [0, 0], "dELS": [0, 0]}
        for key, g, v in rows:
            x = (part(key) % p * a + b) % p
            w = sum((x * x % p * resampling.STEP + x) % p >= t for t in grain)
            sums[g][0] += w * v
            sums[g][1] += w
        if sums["pELS"][1] and sums["dELS"][1]:
            diffs.append(sums["pELS"][0] / sums["pELS"][1] - sums["dELS"][0] / sums["dELS"][1])
    got = stats.mean_diff_bootstrap(spark.createDataFrame(rows, "state_label string, g string, v double"), "g", "v", "pELS", "dELS").first()
    assert got["iterations"] == len(diffs) and tuple(got)[1:] == pytest.approx(tuple(np.quantile(diffs, [0.025, 0.975])))
    asked = []
    for name in ("replicate_metrics", "weighted_means", "subset_sums"):
        place = list(inspect.signature(getattr(resampling, name)).parameters).index("replicates")
        monkeypatch.setattr(stats, name, lambda *args, f=getattr(stats, name), place=place, **kw: (asked.append(args[place]), f(*args, **kw))[1])
    for name, least in FULL.items():
        asked.clear()
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert set(asked) == {least}, name
        if name == "significance_summary":
            p_values = [r["permutation_p_value"] for r in out.collect()]
            assert all(abs(v * 5001 - round(v * 5001)) < 0.01 for v in p_values)


FULL = {"significance_summary": 5000, "paired_bootstrap": 5000, "paired_bootstrap_auroc": 5000, "paired_permutation": 5000, "bootstrap_ci": 1000,
        "mean_difference_bootstrap": 10000, "mean_difference_permutation": 10000, "state_blocked_effect": 10000, "validation_suite": 10000}


def test_bounded_scores_equal_full_sums():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 5, 4000)
    for m in (1, 2, 3, 4, 5, 6, 9, 14):
        for cutoff in (-5.0, 0.5, 0.55 * m, 99.0):
            table = np.hstack([np.round(rng.normal(0, 2, (m, 4)), 3), np.zeros((m, 1))])
            fits = rng.random(len(codes) - m + 1) < 0.9
            full = np.zeros(len(fits))
            for j in range(m):
                full += table[j][codes[j:j + len(fits)]]
            full = np.round(full, 6)
            want = np.flatnonzero(fits & (full >= cutoff))
            size = min(m, motifs.HEAD)
            at, score = motifs._hits(codes, motifs._heads(codes, size), fits, table, size, cutoff, 6)
            assert at.tolist() == want.tolist() and score.tolist() == full[want].tolist()


def test_stored_library_is_read_in_bounded_pieces(spark, monkeypatch):
    rows = [(f"m{i:03d}", [float(i)] * (4 * (1 + i % 7)), 0.5) for i in range(300)]
    path = motifs.qualified(spark, motifs.store_library(spark.createDataFrame(rows, "tf_id string, matrix array<double>, cutoff double").repartition(3)))
    monkeypatch.setattr(motifs, "MAX_CELLS", 100)
    pieces = list(motifs._stored_motifs(path))
    assert max(sum(m.size for _, m, _ in p) for p in pieces) <= 100 and len(pieces) > 30
    assert sorted((t, m.ravel().tolist(), c) for p in pieces for t, m, c in p) == rows


def test_scan_takes_a_stored_library_and_an_empty_one(spark):
    seqs = spark.createDataFrame([("s", "GGACCGTTGAGG")], "seq_id string, sequence string")
    pos = spark.createDataFrame([("a", i, *row) for i, row in enumerate([[9., 1., 1., 1.], [1., 9., 1., 1.], [1., 9., 1., 1.]])], "motif_id string, position int, A double, C double, G double, T double")
    lib = motifs.pwm_library(pos)
    stored = motifs.store_library(lib)
    assert motifs.scan_motifs(seqs, stored).collect() == motifs.scan_motifs(seqs, lib).collect() != []
    assert motifs.scan_motifs(seqs, lib.where("false")).count() == 0
