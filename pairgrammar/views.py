"""Surrogate views: the domain tables derived from the driver tables, in Spark and in SQL.

Each function gives the Spark form; ``SQL`` holds the same view for the oracle. Views read the
whole table they come from and whole texts (a text becomes consecutive 96-base tiles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrammar import schema
from pairgrammar.functions.keys import hash_bucket
from pairgrammar.functions.sequence import pad_or_crop
from pairgrammar.session import materialize, spread

# fixed values of the surrogate: motif genes, their language, document parity, seed and width
GENES = [
    ("G_de0", "de", 0, "TCA", 7), ("G_de1", "de", 1, "GCA", 8), ("G_en0", "en", 0, "CAT", 6), ("G_en1", "en", 1, "GAT", 7),
    ("G_es0", "es", 0, "CTA", 8), ("G_es1", "es", 1, "AGC", 9), ("G_fr0", "fr", 0, "TAG", 6), ("G_fr1", "fr", 1, "ACC", 7),
]
NAMES = [g[0] for g in GENES]
ELEMENTS = ["pELS", "dELS", "CA-TF", "TF", "CA-CTCF", "CA", "other"]
EPOCH = 1704067200


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def u01(key: Column) -> Column:
    return hash_bucket(key, 1_000_000) / 1e6


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sequences(spark, sf) -> DataFrame:
    """Whole base string per document (upper and lower case kept in ``raw_bases``)."""
    raw = F.regexp_replace("text", "[^ACGTacgt]+", "")  # a run at a time
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("seq_id"), "doc_id", raw.alias("raw_bases"), F.upper(raw).alias("bases"),
        F.col("lang").alias("chromosome"), F.col("source").alias("state_label"))


def windows(spark, sf) -> DataFrame:
    """Consecutive 96-base tiles of every document with pair label, phase, label and construction."""
    tiles = sequences(spark, sf).filter(F.length("bases") > 0).select(
        "seq_id", "doc_id", "bases", "chromosome", "state_label",
        F.explode(F.sequence(F.lit(0), F.floor((F.length("bases") - 1) / schema.WINDOW).cast("int"))).alias("tile"))
    sid = F.concat("seq_id", F.lit("_w"), F.col("tile").cast("string"))
    seq = pad_or_crop(F.substring("bases", F.col("tile") * schema.WINDOW + 1, F.lit(schema.WINDOW)), schema.WINDOW)
    base = tiles.select(sid.alias("seq_id"), "doc_id", "tile", seq.alias("sequence"), "chromosome", "state_label")
    left, right = _pick(NAMES, hash_bucket(F.concat("seq_id", F.lit("l")), 8)), _pick(NAMES, hash_bucket(F.concat("seq_id", F.lit("r")), 8))
    return base.select(
        "*", left.alias("left_tf"), right.alias("right_tf"), F.concat_ws("::", left, right).alias("tf_pair_label"),
        F.concat(F.lit("phase"), (1 + hash_bucket(F.concat("seq_id", F.lit("p")), 5)).cast("string")).alias("phase"),
        F.when(hash_bucket(F.concat("seq_id", F.lit("y")), 1000) < 400, 1.0).otherwise(0.0).alias("label"),
        _pick(["observed_pair", "imputed_pair", "observed_monomer"], hash_bucket(F.concat("seq_id", F.lit("c")), 3)).alias("construction_mode"))


def anchored(spark, sf) -> DataFrame:
    """Windows with two declared anchors of width 8 and 6 placed by hash."""
    ls = hash_bucket(F.concat("seq_id", F.lit("ls")), 40)
    rs = ls + 2 + hash_bucket(F.concat("seq_id", F.lit("rs")), 30)
    ori = _pick(schema.ORIENTATIONS, hash_bucket(F.concat("seq_id", F.lit("o")), 4))
    le, re = ls + 8, rs + 6
    return windows(spark, sf).select(
        "*", ls.alias("left_start"), le.alias("left_end"), rs.alias("right_start"), re.alias("right_end"), ori.alias("orientation"),
        ((rs + re) / 2.0 - (ls + le) / 2.0).alias("center_distance"), (rs - le).cast("double").alias("edge_gap"),
        F.greatest(F.lit(0), F.least(le, re) - F.greatest(ls, rs)).cast("double").alias("overlap_len"),
        F.round(hash_bucket(F.concat("seq_id", F.lit("s")), 2000) / 100.0, 2).alias("coarse_additive_score"))


def motif_positions(spark, sf) -> DataFrame:
    """Base counts behind every seed occurrence in every tile of a motif's language that has room for the motif.

    Some rows a motif, made from all texts: they are stored, as a scan alone reads them several times.
    """
    genes = [F.struct(F.lit(g).alias("gene"), F.lit(l).alias("lang"), F.lit(p).alias("par"), F.lit(s).alias("seed"), F.lit(w).alias("len")) for g, l, p, s, w in GENES]
    tiles = windows(spark, sf).select("sequence", "chromosome", "doc_id", F.explode(F.array(*genes)).alias("g"))
    tiles = tiles.filter((F.col("chromosome") == F.col("g.lang")) & (F.col("doc_id") % 2 == F.col("g.par")))
    places = F.expr(f"filter(sequence(1, {schema.WINDOW} - g.len + 1), i -> substring(sequence, i, length(g.seed)) = g.seed)")
    tiles = tiles.filter("instr(sequence, g.seed) > 0").withColumn("at", F.explode(places))
    cells = tiles.select(F.col("g.gene").alias("motif_id"), F.explode(F.sequence(F.lit(0), F.col("g.len") - 1)).alias("position"), "sequence", "at")
    base = F.substring("sequence", F.col("at") + F.col("position"), F.lit(1))
    return materialize(cells.groupBy("motif_id", "position").agg(*[F.count_if(base == b).cast("double").alias(b) for b in "ACGT"]))


def tf_genes(spark, sf, positions: DataFrame | None = None) -> DataFrame:
    """Gene symbols of the motif table (``positions``, for callers that have it) with a sequential id and a family."""
    genes = (motif_positions(spark, sf) if positions is None else positions).select(F.col("motif_id").alias("gene_symbol")).distinct()
    code = F.lit(0)
    for i, g in enumerate(NAMES):
        code = F.when(F.col("gene_symbol") == g, i).otherwise(code)
    return genes.select("gene_symbol", F.format_string("TF_%05d", code).alias("tf_id"), F.substring("gene_symbol", 3, 2).alias("family"))


def edges(spark, sf) -> DataFrame:
    """Reference edges between motif genes seen in the events."""
    u = F.col("user_id")
    return table(spark, sf, "events").select(_pick(NAMES, u % 8).alias("left_tf"), _pick(NAMES, (u * 3 + 1) % 8).alias("right_tf")).distinct()


def wide_edges(spark, sf, repeated: bool = False) -> DataFrame:
    """A larger graph: users and event buckets, joined with part-supplier links kept apart; with an edge for every row if ``repeated``."""
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("left_tf"), F.concat(F.lit("u"), (F.col("event_id") % 41).cast("string")).alias("right_tf"))
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("left_tf"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("right_tf"))
    return ev.unionByName(li) if repeated else ev.unionByName(li).distinct()


def tf_master(spark, sf) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.format_string("TF_%05d", "p_partkey").alias("tf_id"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene_symbol"),
        F.when(size % 11 == 0, "").otherwise(F.col("p_brand")).alias("family"), F.col("p_type").alias("subfamily"),
        F.when(size % 5 == 0, "").otherwise(F.concat(F.lit("pg"), (size % 7).cast("string"))).alias("paralog_group"))


def gene_pairs(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"),
                 F.lit("_"), F.col("l_suppkey").cast("string")).alias("seq_id"),
        F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("left_tf"), F.concat(F.lit("g"), F.col("l_suppkey").cast("string")).alias("right_tf"),
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"))


def fragments(spark, sf) -> DataFrame:
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("chromosome"), start.alias("start"), (start + F.ceil("value").cast("long")).alias("end"), (F.col("user_id") % 4).alias("file_id"), "event_id")


def regions(spark, sf) -> DataFrame:
    """Hourly cells that hold an event, 90 minutes long, so neighbours overlap."""
    cells = fragments(spark, sf).select("chromosome", (F.floor(F.col("start") / 3600) * 3600).cast("long").alias("region_start")).distinct()
    rid = F.concat_ws(":", "chromosome", F.col("region_start").cast("string"))
    return cells.select(
        rid.alias("region_id"), "chromosome", "region_start", (F.col("region_start") + 5400).alias("region_end"),
        F.concat(F.lit("S"), rid).alias("screen_id"), F.concat(F.lit("E"), rid).alias("encode_id"), _pick(ELEMENTS, hash_bucket(rid, 7)).alias("element_type"))


def predictions(spark, sf) -> DataFrame:
    """Labelled documents with three scores, strata inputs and residuals (all from hashes of the id)."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    k = F.col("doc_id").cast("string")

    def noisy(tag: str, signal: float) -> Column:
        return F.round(F.col("quality") * signal + u01(F.concat(F.lit(f"{tag}|"), k)) * (1 - signal), 3)

    left, right = _pick(NAMES, hash_bucket(F.concat(k, F.lit("l")), 8)), _pick(NAMES, hash_bucket(F.concat(k, F.lit("r")), 8))
    return docs.join(lab, "doc_id").select(
        F.concat(F.lit("doc"), k).alias("seq_id"), "doc_id", F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("composite_label"),
        noisy("full", 0.3).alias("full_score"), noisy("avail", 0.1).alias("availability_only_score"), noisy("add", 0.15).alias("additive_null_score"),
        noisy("bridge", 0.2).alias("bridge_score"), noisy("shuf", 0.05).alias("bridge_score_interface_shuffle"), noisy("core", 0.12).alias("bridge_score_core_rerandomized"),
        F.round(u01(F.concat(F.lit("geo|"), k)) - 0.5, 3).alias("geometry_residual"), F.round(u01(F.concat(F.lit("bri|"), k)) - 0.5, 3).alias("bridge_residual"),
        F.col("source").alias("state_label"), F.col("lang").alias("chromosome"), F.col("n_chars").cast("double").alias("availability_signal"),
        left.alias("left_tf"), right.alias("right_tf"), F.concat_ws("::", left, right).alias("tf_pair_label"),
        _pick(schema.ORIENTATIONS, hash_bucket(F.concat(k, F.lit("o")), 4)).alias("orientation"), (hash_bucket(F.concat(k, F.lit("gap")), 25) - 4).cast("double").alias("edge_gap"),
        _pick(["phase4", "phase5"], hash_bucket(F.concat(k, F.lit("ph")), 2)).alias("phase"),
        _pick(["default", "unseen_pair", "unseen_state"], hash_bucket(F.concat(k, F.lit("sp")), 3)).alias("split_name"),
        _pick(ELEMENTS, hash_bucket(F.concat(F.lit("el"), "source"), 7)).alias("element_type"))


def seed_scores(spark, sf) -> DataFrame:
    """One row per example and seed; the last seed did not score the composite examples."""
    base = predictions(spark, sf).select("seq_id", "label", "composite_label", "phase", "split_name", "full_score", "availability_only_score", "additive_null_score",
                                         F.explode(F.array(*[F.lit(s) for s in schema.SEEDS])).alias("seed"))
    k = F.concat_ws("|", "seq_id", F.col("seed").cast("string"))
    shifted = [F.round(F.col(c) * 0.8 + u01(F.concat(k, F.lit(c))) * 0.2, 4).alias(c) for c in ("full_score", "availability_only_score", "additive_null_score")]
    return base.filter((F.col("composite_label") == 0) | (F.col("seed") != schema.SEEDS[-1])).select("seq_id", "label", "phase", "split_name", "seed", *shifted)


def line_scores(spark, sf) -> DataFrame:
    """Every line item as a scored example; a score has two decimals of a hash plus a label signal."""
    k = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    label = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    return spread(lines).select(
        k.alias("seq_id"), label.alias("label"), F.round(label * 0.2 + u01(k) * 0.8, 4).alias("score"), F.col("l_linestatus").alias("stratum"), F.col("l_shipdate").alias("shipped"))


def states(spark, sf) -> DataFrame:
    """State vectors: first 16 values as availability, next 32 as context."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")).alias("state_label"), F.col("label"),
        F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")).alias("availability"),
        F.transform(F.slice("embedding", 17, 32), lambda x: x.cast("double")).alias("state"))


def replicates(spark, sf) -> DataFrame:
    part = F.col("l_partkey")
    group = F.concat(F.when(part % 97 == 0, "ENSG").otherwise("EL"), part.cast("string"))
    return table(spark, sf, "lineitem").select(
        F.concat(group, F.when(F.col("l_returnflag") == "R", "_Reversed:").otherwise("")).alias("name"),
        F.col("l_linenumber").cast("long").alias("replicate"), F.log2("l_extendedprice").alias("log2"), (F.col("l_extendedprice") / 1013).alias("ratio"),
        F.col("l_quantity").cast("long").alias("n_obs_bc"), F.concat(F.lit("chr"), (part % 22 + 1).cast("string")).alias("chromosome"),
        (part * 1000).alias("region_start"), (part * 1000 + 200).alias("region_end"), F.col("l_discount").alias("activity_score"))


def competition(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat(F.lit("lib"), (F.col("o_custkey") % 3).cast("string")).alias("library_name"), F.col("o_orderstatus").alias("actual_state"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("competition_group"), F.col("o_totalprice").alias("activity_score"), F.col("o_orderkey").alias("crs"),
        F.when(hash_bucket(F.concat(F.lit("ev"), F.col("o_orderkey").cast("string")), 10) < 2, 1.0).otherwise(0.0).alias("evidence"), F.col("o_orderpriority").alias("priority"))


# ------------------------------------------------------------------ oracle SQL
def _b(key: str, n: int) -> str:
    """SQL bucket of a hash key."""
    return f"(CAST('0x'||substr(sha256({key}),1,8) AS BIGINT) % {n})"


def _u(key: str) -> str:
    return f"({_b(key, 1000000)} / 1e6)"


def _list(values: list[str], index: str) -> str:
    return f"([{','.join(repr(v) for v in values)}])[CAST({index} AS INT)+1]"


def sql_rank(*parts: str) -> str:
    key = " || '::' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x'||substr(sha1({key}),1,15) AS BIGINT)"


def sql_pad(s: str, n: int = 96) -> str:
    return (f"(CASE WHEN length({s}) >= {n} THEN substr({s}, CAST((length({s})-{n})//2 AS INT)+1, {n}) "
            f"ELSE repeat('N', CAST(({n}-length({s}))//2 AS INT)) || {s} || repeat('N', CAST({n}-length({s})-(({n}-length({s}))//2) AS INT)) END)")


def sql_round(x: str, digits: int, sep: str = ", ") -> str:
    return f"round({x}{sep}{digits})"


def sql_half_up(x: str, digits: int, sep: str = ", ") -> str:
    """Spark's rounding of a double: half up in the decimal digits it prints as, not in its binary value."""
    return f"CAST(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,{digits})) AS DOUBLE)"


def _noisy(tag: str, s: float, rounding=sql_round) -> str:
    return rounding(f"quality*{s} + {_u(repr(tag + '|') + ' || CAST(d.doc_id AS VARCHAR)')}*{1 - s}", 3)


_K = "CAST(d.doc_id AS VARCHAR)"
_GENE_VALUES = ",".join(f"('{g}','{l}',{p},'{s}',{w})" for g, l, p, s, w in GENES)
_LK = "l_orderkey||'|'||l_linenumber||'|'||l_partkey||'|'||l_suppkey"

def _sql_predictions(rounding) -> str:
    return f"""SELECT 'doc'||d.doc_id AS seq_id, d.doc_id, CAST(quality AS DOUBLE) AS label, CAST(toxic AS DOUBLE) AS composite_label,
      {_noisy('full', 0.3, rounding)} AS full_score, {_noisy('avail', 0.1, rounding)} AS availability_only_score, {_noisy('add', 0.15, rounding)} AS additive_null_score,
      {_noisy('bridge', 0.2, rounding)} AS bridge_score, {_noisy('shuf', 0.05, rounding)} AS bridge_score_interface_shuffle, {_noisy('core', 0.12, rounding)} AS bridge_score_core_rerandomized,
      {rounding(_u("'geo|'||" + _K) + "-0.5", 3, ",")} AS geometry_residual, {rounding(_u("'bri|'||" + _K) + "-0.5", 3, ",")} AS bridge_residual,
      source AS state_label, lang AS chromosome, CAST(n_chars AS DOUBLE) AS availability_signal,
      {_list(NAMES, _b(_K + "||'l'", 8))} AS left_tf, {_list(NAMES, _b(_K + "||'r'", 8))} AS right_tf, {_list(NAMES, _b(_K + "||'l'", 8))}||'::'||{_list(NAMES, _b(_K + "||'r'", 8))} AS tf_pair_label,
      {_list(schema.ORIENTATIONS, _b(_K + "||'o'", 4))} AS orientation, CAST({_b(_K + "||'gap'", 25)}-4 AS DOUBLE) AS edge_gap,
      {_list(["phase4", "phase5"], _b(_K + "||'ph'", 2))} AS phase, {_list(["default", "unseen_pair", "unseen_state"], _b(_K + "||'sp'", 3))} AS split_name,
      {_list(ELEMENTS, _b("'el'||source", 7))} AS element_type
      FROM documents d JOIN labels l ON d.doc_id=l.doc_id"""


def _sql_seed_scores(source: str, rounding) -> str:
    scores = ", ".join(rounding(f"{c}*0.8 + {_u('seq_id||' + repr('|') + '||seed||' + repr(c))}*0.2", 4) + f" AS {c}" for c in ("full_score", "availability_only_score", "additive_null_score"))
    return f"SELECT seq_id, label, phase, split_name, seed, {scores} FROM (SELECT *, unnest([{','.join(map(str, schema.SEEDS))}]) AS seed FROM {source}) WHERE composite_label=0 OR seed<>{schema.SEEDS[-1]}"


SQL: dict[str, tuple[list[str], str]] = {
    "sequences": ([], "SELECT 'doc'||doc_id AS seq_id, doc_id, regexp_replace(text,'[^ACGTacgt]','','g') AS raw_bases, upper(regexp_replace(text,'[^ACGTacgt]','','g')) AS bases, lang AS chromosome, source AS state_label FROM documents"),
    "windows": (["sequences"], f"""
      SELECT *, left_tf||'::'||right_tf AS tf_pair_label FROM (SELECT *, {_list(NAMES, _b("seq_id||'l'", 8))} AS left_tf, {_list(NAMES, _b("seq_id||'r'", 8))} AS right_tf,
        'phase'||CAST(1+{_b("seq_id||'p'", 5)} AS VARCHAR) AS phase, CASE WHEN {_b("seq_id||'y'", 1000)} < 400 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
        {_list(["observed_pair", "imputed_pair", "observed_monomer"], _b("seq_id||'c'", 3))} AS construction_mode
      FROM (SELECT seq_id||'_w'||tile AS seq_id, doc_id, tile, {sql_pad("substr(bases, CAST(tile*96+1 AS INT), 96)")} AS sequence, chromosome, state_label
            FROM (SELECT *, unnest(range(0, (length(bases)-1)//96+1)) AS tile FROM sequences WHERE length(bases)>0)))"""),
    "anchored": (["windows"], f"""
      SELECT *, (right_start+right_end)/2.0 - (left_start+left_end)/2.0 AS center_distance, CAST(right_start-left_end AS DOUBLE) AS edge_gap,
        CAST(greatest(0, least(left_end,right_end)-greatest(left_start,right_start)) AS DOUBLE) AS overlap_len FROM (
      SELECT *, left_start+8 AS left_end, right_start+6 AS right_end FROM (SELECT *, left_start+2+{_b("seq_id||'rs'", 30)} AS right_start FROM (
      SELECT *, {_b("seq_id||'ls'", 40)} AS left_start, {_list(schema.ORIENTATIONS, _b("seq_id||'o'", 4))} AS orientation, round({_b("seq_id||'s'", 2000)}/100.0,2) AS coarse_additive_score FROM windows)))"""),
    "motif_positions": (["windows"], f"""
      SELECT motif_id, position, {", ".join(f"CAST(sum(CASE WHEN base='{b}' THEN 1 ELSE 0 END) AS DOUBLE) AS {b}" for b in "ACGT")} FROM (
        SELECT gene AS motif_id, position, substr(sequence, CAST(ati+position AS INT), 1) AS base FROM (
          SELECT *, unnest(range(0, len)) AS position FROM (SELECT sequence, gene, len, seed, unnest(range(1, 98-len)) AS ati FROM windows w JOIN (VALUES {_GENE_VALUES}) g(gene,lang,par,seed,len) ON w.chromosome=g.lang AND w.doc_id%2=g.par)
          WHERE substr(sequence, CAST(ati AS INT), CAST(length(seed) AS INT))=seed)) GROUP BY 1,2"""),
    "pwm": (["motif_positions"], "SELECT motif_id, position, " + ", ".join(f"log2(({b}+1e-3)/(A+C+G+T+4e-3)/0.25) AS {b}" for b in "ACGT") + " FROM motif_positions"),
    "motif_stats": (["pwm"], "SELECT motif_id, count(*) AS motif_len, sum(greatest(A,C,G,T)) AS consensus_score, greatest(1.5, 0.55*sum(greatest(A,C,G,T))) AS cutoff FROM pwm GROUP BY 1"),
    "hits": (["windows", "pwm", "motif_stats"], """
      SELECT seq_id, tf_id, start, start+motif_len AS "end", strand, score, hit_rank-1 AS hit_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY seq_id, tf_id ORDER BY score DESC, start, strand) AS hit_rank FROM (
          SELECT seq_id, motif_id AS tf_id, start, strand, motif_len, round(sum(v),6) AS score, any_value(cutoff) AS cutoff FROM (
            SELECT w.seq_id, s.motif_id, p.start, o.strand, s.motif_len, s.cutoff,
              CASE substr(w.sequence, CAST(p.start + CASE WHEN o.strand='+' THEN m.position ELSE s.motif_len-1-m.position END + 1 AS INT), 1)
                WHEN 'A' THEN CASE WHEN o.strand='+' THEN m.A ELSE m.T END WHEN 'C' THEN CASE WHEN o.strand='+' THEN m.C ELSE m.G END
                WHEN 'G' THEN CASE WHEN o.strand='+' THEN m.G ELSE m.C END WHEN 'T' THEN CASE WHEN o.strand='+' THEN m.T ELSE m.A END ELSE 0 END AS v
            FROM windows w JOIN motif_stats s ON true JOIN (SELECT unnest(range(0,96)) AS start) p ON p.start+s.motif_len<=96
              JOIN (VALUES ('+'),('-')) o(strand) ON true JOIN pwm m ON m.motif_id=s.motif_id)
          GROUP BY 1,2,3,4,5) WHERE score>=cutoff)"""),
    "tf_genes": (["motif_positions"], f"SELECT gene_symbol, 'TF_'||lpad(CAST(list_position([{','.join(repr(g) for g in NAMES)}], gene_symbol)-1 AS VARCHAR),5,'0') AS tf_id, substr(gene_symbol,3,2) AS family FROM (SELECT DISTINCT motif_id AS gene_symbol FROM motif_positions)"),
    "edges": ([], f"SELECT DISTINCT {_list(NAMES, 'user_id%8')} AS left_tf, {_list(NAMES, '(user_id*3+1)%8')} AS right_tf FROM events"),
    "wide_edges": ([], "SELECT DISTINCT 'u'||(user_id%40) AS left_tf, 'u'||(event_id%41) AS right_tf FROM events UNION SELECT DISTINCT 'p'||l_partkey, 's'||l_suppkey FROM lineitem"),
    "tf_master": ([], "SELECT 'TF_'||lpad(CAST(p_partkey AS VARCHAR),5,'0') AS tf_id, 'g'||p_partkey AS gene_symbol, CASE WHEN p_size%11=0 THEN '' ELSE p_brand END AS family, p_type AS subfamily, CASE WHEN p_size%5=0 THEN '' ELSE 'pg'||(p_size%7) END AS paralog_group FROM part"),
    "long_id_tf_master": ([], "SELECT printf('TF_%05d', p_partkey) AS tf_id, 'g'||p_partkey AS gene_symbol, CASE WHEN p_size%11=0 THEN '' ELSE p_brand END AS family, p_type AS subfamily, CASE WHEN p_size%5=0 THEN '' ELSE 'pg'||(p_size%7) END AS paralog_group FROM part"),
    "gene_pairs": ([], "SELECT 'r'||l_orderkey||'_'||l_linenumber||'_'||l_partkey||'_'||l_suppkey AS seq_id, 'g'||l_partkey AS left_tf, 'g'||l_suppkey AS right_tf, l_returnflag AS flag, l_quantity AS quantity FROM lineitem"),
    "fragments": ([], f"SELECT event_type AS chromosome, epoch_us(ts)//1000000-{EPOCH} AS start, epoch_us(ts)//1000000-{EPOCH}+CAST(ceil(value) AS BIGINT) AS \"end\", user_id%4 AS file_id, event_id FROM events"),
    "regions": (["fragments"], f"""SELECT rid AS region_id, chromosome, region_start, region_start+5400 AS region_end, 'S'||rid AS screen_id, 'E'||rid AS encode_id, {_list(ELEMENTS, _b("rid", 7))} AS element_type
      FROM (SELECT DISTINCT chromosome, start//3600*3600 AS region_start, chromosome||':'||(start//3600*3600) AS rid FROM fragments)"""),
    "predictions": ([], _sql_predictions(sql_round)),
    "half_up_predictions": ([], _sql_predictions(sql_half_up)),
    "seed_scores": (["predictions"], _sql_seed_scores("predictions", sql_round)),
    "half_up_seed_scores": (["half_up_predictions"], _sql_seed_scores("half_up_predictions", sql_half_up)),
    "line_scores": ([], f"SELECT {_LK} AS seq_id, CASE WHEN l_returnflag='R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, round(CASE WHEN l_returnflag='R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END*0.2::DOUBLE + {_u(_LK)}*0.8::DOUBLE,4) AS score, l_linestatus AS stratum, l_shipdate AS shipped FROM lineitem"),
    "states": ([], "SELECT vec_id, 'src'||(vec_id%20) AS state_label, label, embedding[1:16]::DOUBLE[] AS availability, embedding[17:48]::DOUBLE[] AS state FROM embeddings"),
    "replicates": ([], """SELECT (CASE WHEN l_partkey%97=0 THEN 'ENSG' ELSE 'EL' END)||l_partkey||(CASE WHEN l_returnflag='R' THEN '_Reversed:' ELSE '' END) AS name, (CASE WHEN l_partkey%97=0 THEN 'ENSG' ELSE 'EL' END)||l_partkey AS element_group, l_returnflag='R' AS is_reverse,
      CAST(l_linenumber AS BIGINT) AS replicate, log2(l_extendedprice) AS log2, l_extendedprice/1013 AS ratio, CAST(l_quantity AS BIGINT) AS n_obs_bc, 'chr'||(l_partkey%22+1) AS chromosome, l_partkey*1000 AS region_start, l_partkey*1000+200 AS region_end, l_discount AS activity_score FROM lineitem"""),
    "competition": ([], f"SELECT 'lib'||(o_custkey%3) AS library_name, o_orderstatus AS actual_state, 'c'||o_custkey AS competition_group, o_totalprice AS activity_score, o_orderkey AS crs, CASE WHEN {_b(repr('ev') + '||o_orderkey', 10)} < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS evidence, o_orderpriority AS priority FROM orders"),
}


def oracle(body: str, *views: str) -> str:
    """SQL text with the needed views as a WITH list."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in SQL[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    if not order:
        return body
    lead = ", ".join(f"{n} AS MATERIALIZED ({SQL[n][1]})" for n in order)
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {lead}, {text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {lead}, {text[5:]}"
    return f"WITH {lead} {text}"
