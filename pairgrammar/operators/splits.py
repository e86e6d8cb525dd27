"""Leakage-safe train/valid/test assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar import schema
from pairgrammar.functions.keys import _c, hash_bucket, pair_key, prefix_group, slug, split_pair
from pairgrammar.operators.ordered import top_per_group

SPLITS = ["train", "valid", "test"]


def assign_split(key, train: float = 0.7, valid: float = 0.15) -> Column:
    """Split from the hash bucket of a key."""
    bucket = hash_bucket(key, 1000)
    return F.when(bucket < round(train * 1000), "train").when(bucket < round((train + valid) * 1000), "valid").otherwise("test")


def group_text(group) -> Column:
    """Group value as text; a missing one is the text ``nan``."""
    return F.coalesce(_c(group).cast("string"), F.lit("nan"))


def group_split(df: DataFrame, group, name: str) -> DataFrame:
    """A whole group lands in one split. A column expression, so nothing is shuffled."""
    return df.withColumn("split_name", F.lit(name)).withColumn("group_value", group_text(group)).withColumn("split", assign_split("group_value"))


def family_blocks(pairs: DataFrame, tf_master: DataFrame) -> DataFrame:
    """Family block (with the paralog block unless blank) and subfamily block per pair."""
    dim = tf_master.select("gene_symbol", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("family", "subfamily", "paralog_group")])
    dim = dim.groupBy("gene_symbol").agg(*[F.max(c).alias(c) for c in ("family", "subfamily", "paralog_group")])
    out = pairs
    for side in ("left", "right"):
        out = out.join(dim.select(F.col("gene_symbol").alias(f"{side}_tf"), *[F.col(c).alias(f"_{side}_{c}") for c in ("family", "subfamily", "paralog_group")]), f"{side}_tf", "left")

    def block(c: str) -> Column:
        return pair_key(F.coalesce(f"_left_{c}", F.lit("")), F.coalesce(f"_right_{c}", F.lit("")))

    paralog = block("paralog_group")
    family = F.when(paralog == "::", block("family")).otherwise(F.concat(block("family"), F.lit("::paralog::"), paralog))
    out = out.withColumn("family_block", family).withColumn("subfamily_block", block("subfamily"))
    return out.drop(*[f"_{s}_{c}" for s in ("left", "right") for c in ("family", "subfamily", "paralog_group")])


def sequence_group(df: DataFrame) -> Column:
    """Locus key: chromosome, else the prefix hash, else the id."""
    if "chromosome" in df.columns:
        return F.col("chromosome")
    return prefix_group("sequence") if "sequence" in df.columns else F.col("seq_id")


def all_splits(windows: DataFrame, tf_master: DataFrame) -> DataFrame:
    """The six split families in one long table. Windows are read once; each becomes one row per family of its phase."""
    left, right = split_pair("tf_pair_label")
    phase = F.col("phase")
    slim = windows.select("seq_id", "phase", "state_label", sequence_group(windows).alias("locus"), left.alias("left_tf"), right.alias("right_tf"))
    blocks = family_blocks(slim, tf_master)

    def family(name: str, value, of_pairs: bool = False, of_states: bool = False) -> Column:
        entry = F.struct(F.lit(name).alias("split_name"), group_text(value).alias("group_value"))
        if of_pairs:
            return F.when(phase.isin("phase2", "phase4", "phase5"), entry)
        return F.when(phase.isin("phase3", "phase4", "phase5"), entry) if of_states else entry

    families = F.array(
        family("seen", "seq_id", of_pairs=True),
        family("unseen_pair", pair_key("left_tf", "right_tf"), of_pairs=True),
        family("unseen_family", "family_block", of_pairs=True),
        family("unseen_subfamily", "subfamily_block", of_pairs=True),
        family("unseen_state", "state_label", of_states=True),
        family("sequence_locus", "locus"),
    )
    long = blocks.select("seq_id", F.explode(F.array_compact(families)).alias("x")).select("seq_id", "x.split_name", "x.group_value")
    return long.withColumn("split", assign_split("group_value"))


def phase_split_name(split_name, phase) -> Column:
    """Transfer splits apply to the phases they make sense for."""
    name, ph = slug(split_name), _c(phase)
    pair_ok, state_ok = ph.isin("phase2", "phase4", "phase5"), ph.isin("phase3", "phase4", "phase5")
    return (
        F.when(name.isin(schema.PAIR_TRANSFER_SPLITS), F.when(pair_ok, name).otherwise("default"))
        .when(name.isin(schema.STATE_TRANSFER_SPLITS), F.when(state_ok, name).otherwise("default"))
        .otherwise(name)
    )


def split_group_key(df: DataFrame, scenario: str) -> Column:
    """Group key by scenario and phase."""
    if scenario in ("synthetic", "ablation"):
        return F.col("seq_id")
    order = [c for c in ("split_group", "tf_pair_label", "seq_id") if c in df.columns]
    default = F.col(order[0])
    if "state_label" not in df.columns:
        return default
    return F.when((F.col("phase") == "phase4") & F.col("state_label").isNotNull(), F.col("state_label")).otherwise(default)


def holdout_split(df: DataFrame, col: str, value: str, group: str = "split_group") -> DataFrame:
    """Held-out value is the test set, the rest is 85/15."""
    rest = assign_split(group, 0.85, 0.15)
    split = F.when(F.col(col) == value, "test").when(rest == "test", "train").otherwise(rest)
    return df.withColumn("split_name", F.lit(f"cross_biosample_test_{value.lower()}")).withColumn("split", split).withColumn("group_value", F.col(group))


def _counts(df: DataFrame) -> Column:
    return df.agg(F.struct(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])).scalar()


def competition_split(df: DataFrame, group: str) -> DataFrame:
    """Whole groups per split; an empty valid or test set takes the last train group(s).

    Groups are ordered by (hash, name), so the outcome does not depend on row order.
    """
    groups = df.select(F.col(group).alias("_g")).distinct().withColumn("split", assign_split("_g")).withColumn("_h", hash_bucket("_g", 2**31))
    last = top_per_group(groups, ["split"], ["-_h", "-_g"], 2, name="_back", keep_rank=True).withColumn("_c", _counts(groups))
    train, valid, test = F.col("_c.train"), F.col("_c.valid"), F.col("_c.test")
    is_train, is_valid, is_test, back = F.col("split") == "train", F.col("split") == "valid", F.col("split") == "test", F.col("_back")
    to = (
        F.when(is_train & (valid == 0) & (back == 1), "valid")
        .when(is_train & (test == 0) & (valid == 0) & (train > 2) & (back == 2), "test")
        .when(is_train & (test == 0) & (valid > 0) & (train > 1) & (back == 1), "test")
        .when(is_valid & (train == 0) & (valid > 1) & (back == 1), "train")
        .when(is_test & (train == 0) & (valid == 0) & (back == 1), "valid")
    )
    moves = last.withColumn("_to", to).filter("_to is not null").select(F.col("_g").alias(group), "_to")
    base = df.withColumn("split", assign_split(group))
    # at most two groups move, hence the hint
    return base.join(F.broadcast(moves), group, "left").withColumn("split", F.coalesce("_to", "split")).drop("_to")


def label_key(group, label) -> Column:
    """``group::label::value`` with the label printed as a float."""
    text = _c(label).cast("double").cast("string")
    return F.when(_c(label).isNull(), _c(group)).otherwise(F.concat(_c(group), F.lit("::label::"), text))


def _apply_moves(df: DataFrame, moves: list[tuple[str, str]], key: str) -> DataFrame:
    if not moves:
        return df
    final = dict(moves)  # a row that moves twice ends in its last split
    table = df.sparkSession.createDataFrame(list(final.items()), f"{key} string, _to string")
    return df.join(F.broadcast(table), key, "left").withColumn("split", F.coalesce("_to", "split")).drop("_to")


def _balance_table(df: DataFrame, order: list[str], key: str, depth: int = 8):
    """Counts per split and label, and the first rows of each cell: at most 6 cells of ``depth`` rows."""
    cells = {(r["split"], r["label"]): r["n"] for r in df.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    rows = top_per_group(df.select(key, "split", "label", *[o for o in order if o != key]), ["split", "label"], order, depth, name="_rn", keep_rank=True).collect()
    first: dict = {}
    for r in sorted(rows, key=lambda r: r["_rn"]):
        first.setdefault((r["split"], r["label"]), []).append(r[key])
    return cells, first


def _fill_moves(df: DataFrame, key: str) -> list[tuple]:
    """Last rows of train (or, for an empty train, of another split) that fill an empty split: at most four."""
    size = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}
    held: dict = {name: [] for name in SPLITS}
    for r in sorted(top_per_group(df.select(key, "split"), ["split"], [f"-{key}"], 4, name="_rn", keep_rank=True).collect(), key=lambda r: -r["_rn"]):
        held[r["split"]].append(r[key])
    moves = []

    def move(source: str, target: str) -> None:
        row = held[source].pop()
        held[target].append(row)
        size[source] -= 1
        size[target] = size.get(target, 0) + 1
        moves.append((row, target))

    if not size.get("valid") and size.get("train", 0) > 2:
        move("train", "valid")
    if not size.get("test") and size.get("train", 0) > 3:
        move("train", "test")
    if not size.get("train") and sum(size.values()):
        move("valid" if size.get("valid") else "test", "train")
    if not size.get("valid") and size.get("train", 0) > 1:
        move("train", "valid")
    return moves


def label_split(df: DataFrame, group: str, label: str = "label", key: str = "seq_id") -> DataFrame:
    """Row split by (group, label); empty splits are filled, then both labels are put in every split where possible.

    Empty splits take the rows with the largest keys. Labels are 0/1, so the balance table that reaches the driver has at most six cells.
    """
    base = df.withColumn("split", assign_split(label_key(group, label)))
    base = _apply_moves(base, _fill_moves(base, key), key)
    slim = base.select(key, "split", F.col(label).cast("double").alias("label"))
    cells, first = _balance_table(slim, [key], key)
    labels = sorted({l for _, l in cells if l is not None})
    if len(labels) < 2:
        return base
    moves = []
    for target in ("valid", "train", "test"):
        for lab in labels:
            if cells.get((target, lab), 0) > 0:
                continue
            for source in ("train", "test", "valid"):
                size = sum(n for (s, _), n in cells.items() if s == source)
                if source == target or size <= 1 or cells.get((source, lab), 0) <= 1:
                    continue
                moves.append((first[(source, lab)].pop(0), target))
                cells[(source, lab)] -= 1
                cells[(target, lab)] = 1
                break
    return _apply_moves(base, moves, key)


def rebalance(manifest: DataFrame, labels: DataFrame, preserve_test: bool = True, key: str = "seq_id") -> DataFrame:
    """Give every movable split at least one row per label, moving the first row of another split."""
    known = labels.groupBy(key).agg(F.max(F.col("label").cast("double")).alias("label"))
    joined = manifest.join(known, key, "left")
    cells, first = _balance_table(joined.filter("label is not null"), [key], key)
    sizes = {r["split"]: r["n"] for r in manifest.groupBy("split").agg(F.count("*").alias("n")).collect()}
    names = SPLITS[:2] if preserve_test else SPLITS
    moves = []
    for target in names:
        for lab in (0.0, 1.0):
            if cells.get((target, lab), 0) > 0:
                continue
            for source in names:
                if source == target or not first.get((source, lab)) or sizes.get(source, 0) <= 1:
                    continue
                row = first[(source, lab)].pop(0)
                moves.append((row, target))
                cells[(source, lab)] -= 1
                sizes[source] -= 1
                cells[(target, lab)] = 1
                sizes[target] = sizes.get(target, 0) + 1
                first.setdefault((target, lab), []).insert(0, row)
                break
    return _apply_moves(manifest, moves, key)


def split_collisions(df: DataFrame, key: str = "seq_id") -> DataFrame:
    """Keys that sit in more than one split."""
    return df.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def assert_disjoint(df: DataFrame, key: str = "seq_id") -> None:
    """Error when a key leaks across splits."""
    bad = split_collisions(df, key).count()
    if bad:
        raise ValueError(f"{bad} values of {key} sit in more than one split")


def override_split(df: DataFrame, overrides: DataFrame, key: str, default: Column) -> DataFrame:
    """Manual overrides on top of a default."""
    chosen = overrides.groupBy(key).agg(F.max("split").alias("_manual"))
    return df.join(chosen, key, "left").withColumn("split", F.coalesce("_manual", default)).drop("_manual")
