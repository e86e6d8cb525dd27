"""Keys, labels, hashes and text decoding (column in, column out)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar import schema


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pair_key(left, right) -> Column:
    """B1: unordered pair key ``min::max``."""
    return F.concat_ws("::", F.least(_c(left), _c(right)), F.greatest(_c(left), _c(right)))


def split_pair(label) -> tuple[Column, Column]:
    """B2: first and last non-empty token of a pair label."""
    tokens = F.filter(F.split(_c(label), "::"), lambda t: t != "")
    return F.get(tokens, F.lit(0)), F.get(tokens, F.size(tokens) - 1)


def hash_bucket(key, buckets: int) -> Column:
    """First 8 hex digits of sha256, modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(_c(key), 256), 1, 8), 16, 10).cast("long") % F.lit(buckets)


def hash_rank(*parts) -> Column:
    """First 15 hex digits of sha1 over ``::``-joined parts."""
    key = F.concat_ws("::", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha1(key), 1, 15), 16, 10).cast("long")


def prefix_group(seq) -> Column:
    """Locus group from the first 32 bases."""
    return F.concat(F.lit("kmer::"), F.substring(F.sha2(F.substring(_c(seq), 1, 32), 256), 1, 12))


def draw(n, *parts) -> Column:
    """Deterministic draw in ``0..n-1``: 15 hex digits of sha256 over ``|``-joined parts."""
    key = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    value = F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")
    return F.pmod(value, n if isinstance(n, Column) else F.lit(n))


def slug(value, default: str = "default") -> Column:
    """Stable slug of a name; ``text_slugs`` is for whole texts."""
    text = F.lower(F.btrim(F.regexp_replace(_c(value), "[^A-Za-z0-9._-]+", "-"), F.lit("-")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)


# lowers A-Z and makes every byte that a slug has no place for a blank, those of non-ASCII characters included
_SLUG = bytes(ord(chr(b).lower()) if b < 128 and (chr(b).isalnum() or chr(b) in "._-") else 32 for b in range(256))


def text_slugs(rows: DataFrame, value: str, default: str = "default") -> DataFrame:
    """Column ``slug`` of whole texts, a table look-up for each byte instead of regular expressions."""
    empty = default.encode()

    def run(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            slugs = [b"-".join(t.translate(_SLUG).split()).strip(b"-") or empty if t else empty for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(slugs, pa.binary()).cast(pa.string())], ["slug"])

    return rows.select(F.col(value).cast("string")).mapInArrow(run, "slug string")


def format_region(chrom, start, end) -> Column:
    """``chr:start-end``."""
    return F.concat(_c(chrom), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"))


def parse_region(label) -> tuple[Column, Column, Column]:
    """Chromosome, start, end of a coordinate label."""
    pattern = r"^([^:]*):(\d+)-(\d+)$"
    return (
        F.regexp_extract(_c(label), pattern, 1),
        F.regexp_extract(_c(label), pattern, 2).try_cast("long"),
        F.regexp_extract(_c(label), pattern, 3).try_cast("long"),
    )


def or_null(value: Column) -> Column:
    """Empty text to null (``regexp_extract`` gives '' when nothing matches)."""
    return F.when(value != "", value)


def leading_code(value) -> Column:
    """Leading integer code of ``code-scope`` cells."""
    return F.regexp_extract(_c(value), r"^\s*(-?\d+)", 1).try_cast("int")


def platform_reference(value) -> tuple[Column, Column]:
    """Platform and reference around the first underscore; without one the whole text is the platform."""
    text = F.trim(_c(value))
    platform = or_null(F.regexp_extract(text, r"^([^_]+)_.", 1))
    return F.coalesce(platform, text), F.regexp_extract(text, r"^[^_]+_(.+)$", 1)


def trailing_number(value) -> Column:
    """Trailing tag number."""
    return F.regexp_extract(_c(value), r"(\d+)$", 1).try_cast("int")


def parse_effect(value) -> tuple[Column, Column]:
    """Numeric effect and p-value from the last two ``_`` tokens."""
    tokens = F.split(_c(value), "_")
    ok = F.size(tokens) >= 3
    effect = F.when(ok, F.get(tokens, F.size(tokens) - 2)).try_cast("double")
    p_value = F.when(ok, F.get(tokens, F.size(tokens) - 1)).try_cast("double")
    return effect, p_value


def direction(effect) -> Column:
    """Activating below zero, repressive above, blank otherwise."""
    e = _c(effect)
    return F.when(e < 0, "activating").when(e > 0, "repressive").otherwise("")


def canonical_biosample(value, rules: list[str], default: str = "other") -> Column:
    """Case-insensitive contains, the last matching rule wins."""
    out = F.lit(default)
    for rule in rules:
        out = F.when(F.lower(_c(value)).contains(rule.lower()), F.lit(rule)).otherwise(out)
    return out


def is_control(name) -> Column:
    """``no_BC`` or an ``ENSG`` element."""
    return (_c(name) == "no_BC") | _c(name).startswith("ENSG")


def strip_reverse(name) -> Column:
    """Drop the reverse-orientation suffix."""
    return F.replace(_c(name), F.lit("_Reversed:"), F.lit(""))


def is_reverse(name) -> Column:
    return _c(name).endswith("_Reversed:")


def to_numeric(value) -> Column:
    """Unparseable or NaN becomes null."""
    number = _c(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def coalesce_nonblank(*cols) -> Column:
    """First value that is neither null nor blank, else ''."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols], F.lit(""))


def edit_label(position, ref, alt) -> Column:
    """``ref+position+alt``."""
    return F.concat(_c(ref), _c(position).cast("string"), _c(alt))


def prediction_projections(df: DataFrame) -> DataFrame:
    """State token, score deltas and sign/label group of a prediction table."""
    delta = F.col("full_score") - F.col("availability_only_score")
    return df.select(
        "*",
        F.element_at(F.split("state_label", "::"), -1).alias("state_token"),
        delta.alias("delta_availability"),
        (F.col("full_score") - F.col("additive_null_score")).alias("delta_additive"),
        F.concat(
            F.when(delta >= 0, "gain").otherwise("loss"),
            F.lit("_"),
            F.when(F.col("label") > 0.5, "positive").otherwise("negative"),
        ).alias("gain_group"),
    )


def _file_name(*parts) -> Column:
    return F.concat(*[F.coalesce(_c(p), F.lit("")) if isinstance(p, str) else p for p in parts], F.lit("_sig.seq"))


def parse_curated_pairs(df: DataFrame) -> DataFrame:
    """Pair sheet to TF names and round-specific file names (right one blank without a prefix)."""
    left, right = F.split("hgnc_pair", "_")[0], F.get(F.split("hgnc_pair", "_"), F.lit(1))
    has_right = F.coalesce("tf2_seq_prefix", F.lit("")) != ""
    return df.select(
        "*",
        F.col("hgnc_pair").contains("_").alias("is_pair"),
        left.alias("left_tf"),
        F.coalesce(right, left).alias("right_tf"),
        _file_name("tf1_seq_prefix", "tf1_plate", "tf1_round").alias("left_seq_file"),
        F.when(has_right, _file_name("tf2_seq_prefix", "tf2_plate", "tf2_round")).otherwise("").alias("right_seq_file"),
    )


def parse_batch_pairs(df: DataFrame) -> DataFrame:
    """Batch sheet (HGNC, Barcode, Batch) to TF names and the pair file; single names drop out."""
    parts = F.split("HGNC", "_")
    return df.filter(F.col("HGNC").contains("_")).select(
        F.col("HGNC").alias("hgnc_pair"), parts[0].alias("left_tf"), parts[1].alias("right_tf"),
        F.col("Barcode").alias("pair_seq_prefix"), F.col("Batch").alias("pair_plate"),
        _file_name("Barcode", "Batch", F.lit("3u")).alias("pair_seq_file"),
    )


def parse_run_names(df: DataFrame, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Five-token run names to pair, round, plate and file; the second frame holds the malformed ones."""
    stem = F.regexp_replace(F.trim(F.col(name)), r"\.fastq\.gz$", "")
    t = df.withColumn("_t", F.split(stem, "_"))
    ok = (F.size("_t") == 5) & F.coalesce(F.get("_t", F.lit(2)).rlike("^[0-9]+$"), F.lit(False))
    at = [F.get("_t", F.lit(i)) for i in range(5)]
    rnd = at[2].cast("int")
    good = t.filter(ok).select(
        *df.columns, F.concat_ws("_", at[0], at[1]).alias("pair_name"), at[0].alias("left_tf"), at[1].alias("right_tf"), pair_key(at[0], at[1]).alias("pair_key"),
        rnd.alias("round_index"), F.concat(rnd.cast("string"), F.lit("u")).alias("round_label"), at[3].alias("plate"), at[4].alias("seq_prefix"),
        F.concat(at[4], at[3], rnd.cast("string"), F.lit("u_sig.seq")).alias("sig_file_name"))
    return good, t.filter(~ok).drop("_t")


def download_url(value) -> Column:
    """Any scheme to https, blank stays blank."""
    v = F.trim(F.coalesce(_c(value), F.lit("")))
    return F.when(v == "", "").when(v.rlike("^https?://"), v).otherwise(F.concat(F.lit("https://"), F.regexp_replace(v, "^ftp://", "")))


def run_file_name(submitted, fastq, title) -> Column:
    """Base name of the submitted or FASTQ file, else the name in the experiment title."""
    path = coalesce_nonblank(submitted, fastq)
    base = F.element_at(F.split(path, "/"), -1)
    named = F.regexp_extract(_c(title), r"Raw reads:\s*([A-Za-z0-9._-]+)$", 1)
    return F.when(base != "", base).when(named != "", F.concat(named, F.lit(".fastq.gz"))).otherwise("")


def derive_labels(df: DataFrame) -> DataFrame:
    """Fill label, phase, split group and defaults when their columns are absent."""
    have = set(df.columns)
    out = df
    if "label" not in have:
        found = [c for c in ("usage_label", "occupancy_label", "functional_label") if c in have]
        if not found:
            raise ValueError("no label, usage_label, occupancy_label or functional_label column")
        out = out.withColumn("label", F.col(found[0]).cast("double"))
    if "phase" not in have:
        positive = F.coalesce(F.col("functional_label").cast("double"), F.lit(0.0)) > 0 if "functional_label" in have else F.lit(False)
        out = out.withColumn("phase", F.when(positive, "phase5").otherwise("phase4"))
    if "split_group" not in have:
        out = out.withColumn("split_group", F.col("tf_pair_label" if "tf_pair_label" in have else "seq_id"))
    defaults = {"composite_label": F.lit(0.0), "source_dataset": F.lit("state_layer"), "element_type": F.lit("state_usage")}
    return out.withColumns({n: c for n, c in defaults.items() if n not in have})


def pack_vector(df: DataFrame, prefix: str, width: int, name: str) -> DataFrame:
    """``prefix_i`` columns to one array, missing ones as 0."""
    have = set(df.columns)
    items = [
        F.coalesce(F.col(f"{prefix}_{i}").cast("double"), F.lit(0.0)) if f"{prefix}_{i}" in have else F.lit(0.0)
        for i in range(width)
    ]
    return df.withColumn(name, F.array(*items)).drop(*[f"{prefix}_{i}" for i in range(width)])


def unpack_vector(df: DataFrame, name: str, prefix: str, width: int) -> DataFrame:
    """Array to ``prefix_i`` columns."""
    return df.select("*", *[F.coalesce(F.get(F.col(name), F.lit(i)), F.lit(0.0)).alias(f"{prefix}_{i}") for i in range(width)]).drop(name)


def _imputed() -> Column:
    return F.lower(F.coalesce("construction_mode", F.lit(""))).contains("imputed")


def exclude_imputed(df: DataFrame) -> DataFrame:
    """Keep rows whose construction is not imputed."""
    return df.filter(~_imputed())


def imputed_counts(df: DataFrame) -> DataFrame:
    """Rows kept and excluded per phase."""
    return df.groupBy("phase").agg(F.count_if(_imputed()).alias("excluded"), F.count_if(~_imputed()).alias("kept"))


def keep_observed(df: DataFrame) -> DataFrame:
    """Observed constructions only."""
    return df.filter(F.col("construction_mode").startswith("observed"))


def calibration_set(df: DataFrame) -> DataFrame:
    """Non-composite monomer or usage rows that name one TF or are negative."""
    out = df
    if "element_type" in df.columns:
        out = out.filter(F.lower("element_type").rlike("monomer|state_usage"))
    if "composite_label" in df.columns:
        out = out.filter(F.coalesce("composite_label", F.lit(0.0)) <= 0)
    if "tf_pair_label" in df.columns:
        tokens = F.array_distinct(F.filter(F.split("tf_pair_label", "::"), lambda t: t != ""))
        out = out.filter((F.size(tokens) <= 1) | (F.col("label") <= 0))
    return out


def map_symbols(df: DataFrame, lookup: DataFrame, source: str, target: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Upper-case symbol lookup with aliases; unmapped rows drop out."""
    symbol = F.upper(F.col(source))
    symbol = reduce(lambda c, kv: F.when(symbol == kv[0], kv[1]).otherwise(c), (aliases or {}).items(), symbol)
    dim = lookup.select(F.upper("gene_symbol").alias("_key"), F.col("gene_symbol").alias(target)).groupBy("_key").agg(F.max(target).alias(target))
    return df.withColumn("_key", symbol).join(dim, "_key").drop("_key")


def derive_orientation(left_strand, right_strand) -> Column:
    return F.concat(_c(left_strand), _c(right_strand))


def orientation_index(orientation) -> Column:
    return F.array_position(F.array(*[F.lit(o) for o in schema.ORIENTATIONS]), _c(orientation)) - 1
