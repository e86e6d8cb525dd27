"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrammar.session import scratch_path


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) of every node on an edge (a, b).

    Every round takes the smallest label among a node and its neighbours and then the label's own
    label, writes the labels to the shared folder and ends when none has changed; there is no limit
    on rounds. Null ends and loops say nothing.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    one = edges.select("a", "b").where("a <> b").distinct()
    both = stored(one.union(one.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        seen = (
            both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            .join(labels, "node").select("node", "label", F.least("near", "label").alias("next")))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = stored(seen.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels
