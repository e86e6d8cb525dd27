"""Table files, prediction store, ledger and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgrammar import schema
from pairgrammar.sources.blocks import file_digests, file_listing


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def _format(path: str) -> tuple[str, dict]:
    name = path.rstrip("/").lower().removesuffix(".gz")
    if name.endswith(".parquet"):
        return "parquet", {}
    return "csv", {"sep": "\t" if name.endswith((".tsv", ".txt")) else ",", "header": "true", "escape": '"'}


def read_table(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A1: first existing path, format by suffix. Text tables need a schema to avoid an extra inference pass."""
    for path in paths:
        if _exists(spark, path):
            fmt, options = _format(path)
            reader = spark.read.options(**options)
            if schema is not None:
                reader = reader.schema(schema)
            elif fmt == "csv":
                reader = reader.option("inferSchema", "true")
            return reader.format(fmt).load(path)
    raise FileNotFoundError(", ".join(paths))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """A2: format by suffix."""
    fmt, options = _format(path)
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def clean_columns(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Strip byte-order mark and blanks from names, then rename the ones present."""
    out = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return out.withColumnsRenamed({k: v for k, v in (rename or {}).items() if k in out.columns})


PREDICTION_KEYS = ["phase", "scenario", "split_name", "seed"]


def write_predictions(df: DataFrame, root: str, mode: str = "append") -> None:
    """Store partitioned by phase, scenario, split and seed."""
    df.write.mode(mode).partitionBy(*PREDICTION_KEYS).parquet(root)


def read_predictions(spark: SparkSession, root: str, **keys) -> DataFrame:
    """Pruned read; a key may be one value or a list."""
    df = spark.read.parquet(root)
    for name, value in keys.items():
        df = df.filter(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df


def available_slices(spark: SparkSession, root: str) -> DataFrame:
    """Stored slices with their file count, from a listing; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(root)
    return files.select(*PREDICTION_KEYS, "path").groupBy(*PREDICTION_KEYS).agg(F.count("*").alias("run_count"))


def append_ledger(df: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    df.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A9."""
    return spark.read.schema(schema.LEDGER).json(path)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing with empty files; the file content is never read."""
    return file_listing(spark, root).select(
        "relative_path", F.regexp_extract("relative_path", r"(\.[^./]+)$", 1).alias("suffix"), "bytes",
        (F.lower(F.element_at(F.split("relative_path", "/"), -1)) == "landing.html").alias("is_landing_page"))


def line_inventory(spark: SparkSession, paths) -> DataFrame:
    """Lines per file, told apart by path."""
    return spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name")).agg(F.count("*").alias("lines"))


def pair_file_inventory(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Size of the left and right file of each curated pair (null when absent)."""
    sizes = files.select(F.element_at(F.split("relative_path", "/"), -1).alias("_f"), "bytes").groupBy("_f").agg(F.max("bytes").alias("bytes"))
    out = pairs
    for side in ("left", "right"):
        out = out.join(sizes.select(F.col("_f").alias(f"{side}_seq_file"), F.col("bytes").alias(f"{side}_bytes")), f"{side}_seq_file", "left")
    return out


def checksum_inventory(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """sha256 and size per file, checked against a manifest (relative_path, sha256) when given; files are read in blocks."""
    found = file_digests(spark, root)
    if manifest is None:
        return found
    want = manifest.select("relative_path", F.col("sha256").alias("expected"))
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("sha256") == F.col("expected"), "ok").otherwise("changed")
    return found.join(want, "relative_path", "full").withColumn("status", status)


def metadata_datasets(spark: SparkSession, path) -> DataFrame:
    """One row per dataset document: file count, joined reference ids, status."""
    docs = spark.read.schema(_METADATA).option("multiLine", "true").json(path)
    ids = F.array_join(F.flatten(F.transform(F.coalesce("references", F.array().cast(_METADATA["references"].dataType)), lambda r: F.coalesce(r["identifiers"], F.array().cast("array<string>")))), "; ")
    return docs.select("accession", F.greatest(F.size("files"), F.lit(0)).alias("file_reference_count"), ids.alias("reference_identifiers"), F.coalesce("status", F.lit("")).alias("status"))


def metadata_files(spark: SparkSession, path, formats: list[str] | None = None, portal: str = "", where: Column | None = None) -> DataFrame:
    """A17 + N5: released files that have a link, optionally of given formats and passing a predicate."""
    files = spark.read.schema(_METADATA).option("multiLine", "true").json(path).select(F.col("accession").alias("dataset"), F.explode("files").alias("f")).select("dataset", "f.*")
    out = files.filter((F.col("status") == "released") & (F.coalesce("href", F.lit("")) != ""))
    if formats:
        out = out.filter(F.col("file_format").isin(formats))
    if where is not None:
        out = out.filter(where)
    return out.withColumn("download_url", F.concat(F.lit(portal), "href"))


_METADATA = T.StructType([
    T.StructField("accession", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("references", T.ArrayType(T.StructType([T.StructField("identifiers", T.ArrayType(T.StringType()))]))),
    T.StructField("files", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in (
        "accession", "status", "file_format", "output_type", "submitted_file_name", "assembly", "href")]))),
])
