"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pairgrammar", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``), also set as checkpoint folder.

    Only a local master may fall back to a fresh folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named is None and current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if current is None:
        sc.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, max_leaves: int = 4) -> DataFrame:
    """Checkpoint a plan that already reads its sources more than ``max_leaves`` times.

    Operators that use their input several times would otherwise multiply the plan when they are
    stacked. The checkpoint lies in the shared folder, so it survives a lost executor.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().size()
    if leaves <= max_leaves:
        return df
    shared_dir(df.sparkSession)
    return df.checkpoint()


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of everything a plan reads, by Spark's own statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def shuffles(df: DataFrame) -> bool:
    """Whether a plan aggregates, joins, sorts, deals or windows its rows."""
    return re.search(r"^[\s:+-]*(Aggregate|Join|Sort|Window|Repartition\w*|Distinct)\b", df._jdf.queryExecution().optimizedPlan().toString(), re.M) is not None


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint rows that are costly to make and used more than once; stored rows pass through."""
    root = df._jdf.queryExecution().analyzed().getClass().getSimpleName()
    if root in ("LogicalRDD", "LogicalRelation"):
        return df
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Many rows written to the shared folder by column, for readers that want few of the columns or nothing but a count."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPLIT_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Spread rows ahead of heavy per-row work when the input is too small to be read in as many splits as there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if leaf_bytes(df) < cores * SPLIT_BYTES else df


SHARE_BYTES = 2 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to tasks that get what is made of about ``SHARE_BYTES`` of the files read, however large these are.

    For rows that a little input makes many of: Spark's own tasks hold a fixed size of packed rows, which may be any number of them.
    """
    size, cores = leaf_bytes(df), df.sparkSession.sparkContext.defaultParallelism
    if size >= 1 << 46:  # Spark does not know the size
        return df.repartition(*keys)
    return df.repartition(max(cores, -(-size // SHARE_BYTES)), *keys)
