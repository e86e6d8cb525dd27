"""Queries on large keys, large cells, ties and large batches."""

import os
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from compare import TABLES, check, duck
from pairgrammar.functions import sequence
from pairgrammar.operators import resampling
from pairgrammar.plans import panels
from pairgrammar.queries import plans, sources
from pairgrammar.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def tables(folder, **changed):
    """The smallest tables, some made anew by SQL over ``{old}``."""
    con = duckdb.connect()
    for t in TABLES:
        old = f"{SMALL}/{t}.parquet"
        if t in changed:
            con.execute(f"COPY ({changed[t].format(old=repr(old))}) TO '{folder}/{t}.parquet'")
        else:
            os.symlink(old, f"{folder}/{t}.parquet")
    return str(folder)


def agree(spark, sf, name):
    ok, note = check(spark, duck(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


@pytest.mark.parametrize("name", ["coalesce_nonblank", "index_maps"])
def test_ids_of_six_digits(spark, tmp_path, name):
    agree(spark, tables(tmp_path, part="SELECT * REPLACE ((p_partkey + 99990)::BIGINT AS p_partkey) FROM {old}"), name)


def test_catalogue_of_many_genes_and_equal_motifs(spark, tmp_path):
    lines = "SELECT * REPLACE ((l_suppkey + i)::BIGINT AS l_suppkey) FROM {old}, (SELECT unnest(range(3)) AS i)"
    parts = "SELECT * REPLACE ((p_partkey + i * 1000)::BIGINT AS p_partkey) FROM {old}, (SELECT unnest(range(600)) AS i)"
    agree(spark, tables(tmp_path, part=parts, lineitem=lines), "tf_master_catalogue")


@pytest.mark.parametrize("name", ["checksum_inventory", "selective_risk"])
def test_scores_on_a_tie_of_rounding(spark, name):
    agree(spark, "/root/testdata/sf0.1", name)


def test_bootstrap_of_large_cells(spark, tmp_path):
    rows = "SELECT * REPLACE ((doc_id + i * 100000)::BIGINT AS doc_id{0}) FROM {{old}}, (SELECT unnest(range(2000)) AS i)"
    agree(spark, tables(tmp_path, documents=rows.format(", '' AS text"), labels=rows.format("")), "bootstrap_ci")


def test_tracks_of_a_batch_take_little_more_than_their_numbers():
    texts = ["ACGTN" * 19 + "A", "", None, "AC", "G"] * 2000
    sequence.track_lists(pa.array(texts[:5]), 2)
    tracemalloc.start()
    found = sequence.track_lists(pa.array(texts), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * found.nbytes
    first = found[:5].to_pylist()
    assert found[-5:].to_pylist() == first and first[1] == first[2] == [[]] * 4
    assert [len(t) for t in first[0]] == [96] * 4 and [len(t) for t in first[3]] == [2] * 4
    assert np.allclose(first[0], sequence._tracks(sequence._CODE[np.frombuffer(texts[0].encode(), np.uint8)][None], 2)[0])


@pytest.mark.parametrize("name", ["direction_consistency", "target_consistency", "biosample_consistency"])
def test_registry_rows_are_dealt_by_numbers_and_never_by_biosample(spark, name):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("hashpartitioning(l_orderkey" in line for line in dealt)
    assert not any("registry_id" in line for line in dealt)
    if name == "direction_consistency":  # the others never ask for the supported labels
        assert "BroadcastHashJoin [canonical_biosample" in plan


@pytest.mark.parametrize("kind", ["poisson", "swap"])
def test_replicate_sums_are_those_of_plain_weights_in_small_matrices(monkeypatch, kind):
    a, b = resampling.constants(11, 300)
    rng = np.random.default_rng(5)
    n = 3000
    score, label = np.sort(rng.integers(0, 900, n))[::-1] / 900.0, (rng.random(n) < 0.4) * 1.0
    key, count, first = rng.integers(0, resampling.PRIME, n), rng.integers(1, 6, n), rng.random(n) < 0.5
    x = (key[:, None].astype(object) * a + b) % resampling.PRIME
    assert (resampling.numbers(key, a, b) == (x * x * resampling.STEP + x) % resampling.PRIME).all()
    drawn = resampling.draws(kind, key, count, a, b)
    want = np.zeros((2, 4, 300))
    for side, mine in enumerate((first, ~first)):
        w = np.where(mine[:, None], count[:, None] - drawn, drawn) if kind == "swap" else drawn * mine[:, None]
        tp = fp = np.zeros(300)
        for s in np.unique(score)[::-1]:
            pos, neg = (w[(score == s) & (label == sign)].sum(axis=0) for sign in (1.0, 0.0))
            tp, fp = tp + pos, fp + neg
            want[side] += [pos, neg, np.where(tp + fp > 0, pos * tp / np.maximum(tp + fp, 1), 0), pos * (fp - neg / 2)]
    parts = []
    plain = resampling.draws
    monkeypatch.setattr(resampling, "draws", lambda kind, key, *rest: parts.append(len(key)) or plain(kind, key, *rest))
    sums, last = resampling._sums(score, label, key, count, first, kind, a, b, None)
    assert np.allclose(sums, want, rtol=1e-12) and max(parts) <= 256
    ahead, same = resampling._sums(score, label, key, count, first, kind, a, b, None, ahead_only=True)
    assert (ahead[:, :2] == sums[:, :2]).all() and (same == last).all() and not ahead[:, 2:].any()


@pytest.mark.parametrize("start", ["stream_candidates", "stream_hydrate"])
def test_a_batch_looks_its_keys_up_once(spark, tmp_path, start):
    plans = []

    def work(rows):
        plans.append(rows._jdf.queryExecution().analyzed().toString())
        assert rows.sparkSession._jsparkSession.equals(spark._jsparkSession)
        both = rows.join(rows.select("seq_id"), "seq_id")  # a use of the batch beside another
        if start == "stream_candidates":
            return both.selectExpr("seq_id", "true AS has_candidate", "'' AS pair_mode", "0D AS pair_reference_supported")
        return both.selectExpr("seq_id", "'c' AS chromosome", "0L AS window_start", "'A' AS sequence", "'complete' AS hydration_status")

    spark.createDataFrame([("a",), ("b",), ("a",)], "seq_id string").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq_id string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    getattr(jobs, start)(stream, f"{tmp_path}/store", f"{tmp_path}/cp", work).awaitTermination()
    assert plans and not any("Deduplicate" in p for p in plans)
    assert sorted(r.seq_id for r in spark.read.parquet(f"{tmp_path}/store").collect()) == ["a", "b"]


def test_ranks_store_no_sequences(spark, monkeypatch):
    seen, plain = [], panels.competition_ranks
    monkeypatch.setattr(panels, "competition_ranks", lambda frame: seen.append(frame.columns) or plain(frame))
    agree(spark, SMALL, "competition_ranks")
    assert seen == [["competition_group", "activity_score", "crs"]]


def test_layers_and_tiles_read_the_texts_once(spark):
    regions, _, chunks, _, _, lengths = plans._layer(spark, SMALL)
    tiles, _ = sources._tiles(spark, SMALL)
    assert not any("regexp_replace" in df._jdf.queryExecution().analyzed().toString() for df in (regions, chunks, lengths, tiles))
