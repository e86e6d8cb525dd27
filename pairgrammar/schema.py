"""Fixed values, record schemas and the required-column contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------
ORIENTATIONS = ["++", "+-", "-+", "--"]
BASES = ["A", "C", "G", "T", "N"]
HELICAL_PERIOD = 10.5
WINDOW = 96
ANCHOR_WINDOW = 24
FLANK = 4
OFFSETS = [-2, -1, 0, 1, 2]
GAP_MIN = -4
GAP_MAX = 20
SEEDS = [11, 17, 23, 29, 47]
STANDARD_CHROMS = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY"]
ELEMENT_PRIORITY = {"pELS": 0, "dELS": 1, "CA-TF": 2, "TF": 3, "CA-CTCF": 4, "CA": 5}
OTHER_PRIORITY = 9
PAIR_TRANSFER_SPLITS = ["unseen_pair", "unseen_family", "unseen_subfamily"]
STATE_TRANSFER_SPLITS = ["unseen_state"]
ROLL = {
    "AA": -0.6, "AC": -0.2, "AG": 0.1, "AT": 0.4, "CA": -0.1, "CC": -0.3, "CG": 0.8, "CT": 0.2,
    "GA": 0.2, "GC": 0.7, "GG": -0.2, "GT": -0.1, "TA": 0.5, "TC": 0.0, "TG": -0.1, "TT": -0.5,
}
# -------------------------------------------------------------------------

ANCHORS = T.StructType([
    T.StructField("seq_id", T.StringType()),
    T.StructField("tf_id", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("strand", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

REGIONS = T.StructType([
    T.StructField("chromosome", T.StringType()),
    T.StructField("region_start", T.LongType()),
    T.StructField("region_end", T.LongType()),
    T.StructField("screen_id", T.StringType()),
    T.StructField("encode_id", T.StringType()),
    T.StructField("element_type", T.StringType()),
])

MPRA_BED = T.StructType([
    T.StructField("chromosome", T.StringType()),
    T.StructField("region_start", T.StringType()),
    T.StructField("region_end", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("bed_score", T.StringType()),
    T.StructField("strand", T.StringType()),
    T.StructField("activity_score", T.StringType()),
    T.StructField("activity_aux_1", T.StringType()),
    T.StructField("activity_aux_2", T.StringType()),
    T.StructField("activity_aux_3", T.StringType()),
    T.StructField("activity_aux_4", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("split_name", T.StringType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail at plan time when a required column is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
