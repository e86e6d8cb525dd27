"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE_BYTES = 1 << 20


def lowered(col: Column) -> Column:
    """A-Z in lower case, every other character as it is; null is the empty text."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z in lower case, cut at blank and tab to carriage return."""
    return text.lower().split() if text else []


def remainder_is_one(key: str, divisor: int) -> Column:
    """Whether crc32 of the key as text leaves 1; a null key does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % divisor == 1, F.lit(False))


def text_part(text: Column, seed: Column, size: int) -> Column:
    """``size`` characters of a text from a start drawn by ``seed``; a shorter text whole."""
    return F.substring(text, (F.pmod(seed, F.greatest(F.length(text) - size, F.lit(0)) + 1) + 1).cast("int"), F.lit(size))


def bounded_sample(rows: DataFrame, key: str, label: str, buckets: int) -> DataFrame:
    """One row key per (label, hash bucket), the one with the smallest hash: at most ``buckets`` per label.

    Only partial minima are shuffled, however many rows a label has.
    """
    hashed = F.xxhash64(F.lit("sample"), F.col(key))
    return (
        rows.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"), F.pmod(hashed, F.lit(buckets)).alias("bucket"))
        .agg(F.min(F.struct(hashed.alias("h"), F.col(key).alias("key"))).alias("pick"))
        .select("label", F.col("pick.h").alias("h"), F.col("pick.key").alias("key")))


def slices(batch: pa.RecordBatch, column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Runs of rows whose texts hold about ``limit`` bytes together; a longer text is a run of its own."""
    column, start, total = column.cast(pa.binary()), 0, 0
    for i, size in enumerate(pc.binary_length(column).to_pylist()):
        size = size or 0
        if i > start and total + size > limit:
            yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += size
    if start < len(column):
        yield batch.slice(start), column.slice(start).to_pylist()


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let at most ``BATCH_ROWS`` rows with whole texts cross to Python at once: what both sides hold goes with it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_texts(docs: DataFrame, text: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]]) -> DataFrame:
    """Add columns computed from whole texts, in Arrow batches, without a shuffle.

    ``make`` runs once per task and gives the function from texts (UTF-8, or None) to one array per
    field. The result holds the kept columns in the struct ``row``, so no name can clash with a field.
    """
    small_batches(docs.sparkSession)
    inside = text in keep
    given = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] + ([] if inside else [F.col(f"`{text}`").cast("string").alias("text")])
    frame = docs.select(*given)
    schema = T.StructType([frame.schema["row"], *fields])
    names = ["row", *[f.name for f in fields]]
    place = keep.index(text) if inside else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            column = batch.column(0).field(place) if inside else batch.column(1)
            work = work or make()
            for part, values in slices(batch, column):
                yield pa.RecordBatch.from_arrays([part.column(0), *work(values)], names)
            pa.default_memory_pool().release_unused()

    return frame.mapInArrow(run, schema)
