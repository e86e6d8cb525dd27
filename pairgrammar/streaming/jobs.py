"""Incremental jobs. Each store is a folder of Parquet parts, one per batch, read back with keep-last.

A batch writes its own ``batch_id`` part with overwrite, so a batch that is run again after a
failure replaces its own output and nothing is counted twice. What a batch reads does not grow with the batches
before it: seen keys are keyed state on the executors' disks, tops are the last part alone, counts are added up when read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairgrammar.functions.keys import format_region, hash_rank
from pairgrammar.operators.intervals import count_marked, merge_marks, overlap_marks
from pairgrammar.operators.ordered import dedupe
from pairgrammar.session import scratch_path
from pairgrammar import schema


def read_store(spark: SparkSession, store: str, columns: str, key: str = "seq_id") -> DataFrame:
    """Latest row per key of a store (empty when nothing was written yet)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], columns)
    rows = spark.read.schema(f"{columns}, batch_id long").parquet(store)
    return dedupe(rows, [key], ["batch_id"], keep="last").drop("batch_id")


def _write_part(df: DataFrame, store: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch function over all that is there, with state on disk; the session's own choice of state store wins.

    A query keeps the settings it was started with, so the session's are put back at once.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, "")
    if not before or before.endswith("HDFSBackedStateStoreProvider"):
        conf.set(PROVIDER, ROCKSDB)
    try:
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before:
            conf.set(PROVIDER, before)
        else:
            conf.unset(PROVIDER)


def _with_stored(spark: SparkSession, df: DataFrame, work: Callable[[DataFrame], None]) -> None:
    """Give ``work`` a batch's rows from a scratch copy, which goes when the work is done.

    Each use of the batch itself would look its keys up in the state, and store the state, again. The copy belongs
    to the caller's session, which may adapt its plans; the stream's own session does not, as its plans keep state.
    """
    path = scratch_path(spark, "batch")
    df.write.parquet(path)
    work(spark.read.schema(df.schema).parquet(path))
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


CANDIDATE_STATUS = "seq_id string, has_candidate boolean, pair_mode string, pair_reference_supported double"


def stream_candidates(stream: DataFrame, store: str, checkpoint: str, candidates: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """M1: status of unseen ids only. ``candidates`` turns a batch of (seq_id, sequence) into status rows.

    Which ids were seen is the stream's own state, looked up by key; the store is never read. A checkpoint goes with one store.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        _with_stored(stream.sparkSession, df, lambda rows: _write_part(
            candidates(rows).select("seq_id", "has_candidate", "pair_mode", "pair_reference_supported"), store, batch_id))
    return _start(stream.dropDuplicates(["seq_id"]), batch, checkpoint)


HYDRATED = "seq_id string, chromosome string, window_start long, sequence string, hydration_status string"


def stream_hydrate(stream: DataFrame, store: str, checkpoint: str, hydrate: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """M2: windows hydrated as they arrive, ids of earlier batches skipped as in M1."""
    def batch(df: DataFrame, batch_id: int) -> None:
        _with_stored(stream.sparkSession, df, lambda rows: _write_part(
            hydrate(rows).select("seq_id", "chromosome", "window_start", "sequence", "hydration_status"), store, batch_id))
    return _start(stream.dropDuplicates(["seq_id"]), batch, checkpoint)


def _seen_before(spark: SparkSession, store: str, columns: str, batch_id: int, key: str) -> DataFrame:
    """Keys of earlier runs only, so that a repeated run does its work again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], columns).select(key)
    return spark.read.schema(f"{columns}, batch_id long").parquet(store).filter(F.col("batch_id") < batch_id).select(key).distinct()


def run_pending(rows: DataFrame, store: str, columns: str, work: Callable[[DataFrame], DataFrame], budget: int | None = None, key: str = "seq_id") -> int:
    """M1, M2: one run over the rows whose key the store lacks, at most ``budget`` of them in key order.

    The rest stays pending for the next run. Gives the number of the part that was written.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [str(f.getPath().getName()) for f in files.listStatus(path)] if files.exists(path) else []
    run = 1 + max([int(p.partition("=")[2]) for p in parts if p.startswith("batch_id=")], default=-1)
    pending = rows.dropDuplicates([key]).join(_seen_before(spark, store, columns, run, key), key, "left_anti")
    if budget is not None:
        pending = pending.orderBy(key).limit(budget)
    _write_part(work(pending), store, run)
    return run


LATEST_KEYS = ["phase", "scenario", "split_name", "seed"]


def stream_latest(ledger: DataFrame) -> DataFrame:
    """M3: latest ledger record per slice. State grows with the number of slices only."""
    rec = F.struct(*[c for c in ledger.columns if c not in LATEST_KEYS])
    return ledger.groupBy(*LATEST_KEYS).agg(F.max_by(rec, F.struct("started_at", "run_id")).alias("r")).select(*LATEST_KEYS, "r.*")


MARKS = "chromosome string, at long, order int, started long, ended long"


def stream_overlaps(fragments: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """M4: how many fragments start and end at each place, a part per batch; no hit is formed and no state is kept."""
    return _start(fragments, lambda df, batch_id: _write_part(overlap_marks(df), store, batch_id), checkpoint)


def read_overlaps(spark: SparkSession, store: str, regions: DataFrame, key: str = "region_id") -> DataFrame:
    """M4: overlap count of every hit region so far, from the sum of all parts."""
    marks = merge_marks(spark.read.schema(f"{MARKS}, batch_id long").parquet(store).drop("batch_id"))
    return count_marked(regions, marks, [key]).filter("fragment_count > 0")


TOP = "priority int, rank long, state_label string, element_type string"


def _parts(spark: SparkSession, store: str) -> tuple[object, dict[int, object]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(path)] if files.exists(path) else []
    return files, {int(str(p.getName()).partition("=")[2]): p for p in found if str(p.getName()).startswith("batch_id=")}


def stream_top_regions(stream: DataFrame, k: int, store: str, checkpoint: str) -> StreamingQuery:
    """M5: running best ``k`` regions by element priority and hash.

    A batch joins its own best ``k`` with those of the batch before it and writes the best of both. Only the last two
    parts stay, so that a batch that is run again finds its predecessor: at most 2 ``k`` rows, however many batches.
    """
    priority = F.lit(schema.OTHER_PRIORITY)
    for name, value in schema.ELEMENT_PRIORITY.items():
        priority = F.when(F.col("element_type") == name, value).otherwise(priority)
    rank = hash_rank("screen_id", "encode_id", "chromosome", "region_start", "region_end")
    label = format_region("chromosome", "region_start", "region_end")
    ranked = stream.filter("region_end > region_start").select(priority.cast("int").alias("priority"), rank.alias("rank"), label.alias("state_label"), "element_type")

    def batch(df: DataFrame, batch_id: int) -> None:
        files, parts = _parts(df.sparkSession, store)
        earlier = [p for p in parts if p < batch_id]
        own = df
        if earlier:
            own = own.unionByName(df.sparkSession.read.schema(TOP).parquet(f"{store}/batch_id={max(earlier)}"))
        best = own.groupBy("state_label").agg(F.min(F.struct("priority", "rank", "element_type")).alias("r")).select("r.priority", "r.rank", "state_label", "r.element_type")
        _write_part(best.orderBy("priority", "rank", "state_label").limit(k), store, batch_id)
        for old in earlier:
            if old < max(earlier):
                files.delete(parts[old], True)

    return _start(ranked, batch, checkpoint)


def read_top_regions(spark: SparkSession, store: str) -> DataFrame:
    """M5: the best regions so far."""
    _, parts = _parts(spark, store)
    return spark.read.schema(TOP).parquet(f"{store}/batch_id={max(parts)}") if parts else spark.createDataFrame([], TOP)
