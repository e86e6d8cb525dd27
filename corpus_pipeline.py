"""From raw documents to packed training bins, one stage after the other.

Every stage takes whole tables with nulls, repeated rows and extra columns: rows that repeat are judged each by itself but
for the near duplicates, where one of them stays; a null text has no language and goes in the first stage; a null id or
source is kept as it is. An empty table passes all stages that need nothing learnt from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrammar.llm import decontaminate, jaccard, langid, packing, quality
from pairgrammar.session import scratch_path

ORACLE_SQL = None  # fitted models, alignment and packing have no SQL form; tests/llm checks against brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without a letter go, and so do long ones that no language fits."""
    judged = langid.identify(docs, langid.learn(docs), docs.columns)
    fits = (F.col("lang_pred") != langid.UNKNOWN) & ((F.col("span") >= langid.LEAST_SPAN) | (F.length("row.text") < langid.LEAST_CHARS))
    return judged.where(fits).select("row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field calls good."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.rate(docs, model, docs.columns).where("predicted = 1").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id: five-word shingles, similarity 0.8 by links.

    Where ids are null or repeated, rows are numbered and linked by their number; of a group the row with the smallest id
    stays (null ids last, then by number), so a repeated row loses its copies and one id with two texts keeps both if they differ.
    Null and empty texts are linked with nothing and stay; an empty table stays empty.
    """
    if not docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count():
        copies = jaccard.link(docs, words=5, percent=80).where("component_id < doc_id").select("doc_id")
        return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    path = scratch_path(spark, "numbered")
    docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text").withColumn("number", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    groups = jaccard.link(numbered, key="number", words=5, percent=80).join(numbered.select("number", "doc_id"), "number")
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "number")).alias("best")).select(F.col("best.number").alias("number"))
    return numbered.join(kept, "number", "left_semi").select("row.*")


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.uncontaminated(docs, decontaminate.passes(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words go in the training bins; equal texts and full sources keep apart."""
    sized = docs.select("doc_id", "source", packing.word_count(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("cluster"))
    return packing.pack(sized)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("decontamination", untested), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every earlier stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
