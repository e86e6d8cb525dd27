"""Split queries (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgrammar import views
from pairgrammar.functions.keys import hash_bucket, pair_key
from pairgrammar.operators import joins as J
from pairgrammar.operators import splits as P
from pairgrammar.queries.registry import query
from pairgrammar.views import _b


def sql_split(key: str, train: int = 700, upto: int = 850) -> str:
    return f"(CASE WHEN {_b(key, 1000)}<{train} THEN 'train' WHEN {_b(key, 1000)}<{upto} THEN 'valid' ELSE 'test' END)"


@query("assign_split", f"SELECT 'c'||o_custkey AS k, {sql_split(chr(39) + 'c' + chr(39) + '||o_custkey')} AS split, count(*) AS n FROM orders GROUP BY 1,2")
def assign_split(spark, sf):
    return views.competition(spark, sf).groupBy(F.col("competition_group").alias("k"), P.assign_split("competition_group").alias("split")).agg(F.count("*").alias("n"))


@query("group_split", f"SELECT seq_id, 'unseen_state' AS split_name, g AS group_value, {sql_split('g')} AS split FROM (SELECT seq_id, coalesce(state_label,'nan') AS g FROM windows)", ("windows",))
def group_split(spark, sf):
    return P.group_split(views.windows(spark, sf), "state_label", "unseen_state").select("seq_id", "split_name", "group_value", "split")


_BLOCK = "least(coalesce(l.{c},''),coalesce(r.{c},''))||'::'||greatest(coalesce(l.{c},''),coalesce(r.{c},''))"
_BLOCKS = f"""(SELECT p.*, {_BLOCK.format(c='family')} || CASE WHEN {_BLOCK.format(c='paralog_group')}='::' THEN '' ELSE '::paralog::'||{_BLOCK.format(c='paralog_group')} END AS family_block, {_BLOCK.format(c='subfamily')} AS subfamily_block
  FROM {{t}} p LEFT JOIN tf_master l ON p.left_tf=l.gene_symbol LEFT JOIN tf_master r ON p.right_tf=r.gene_symbol)"""


@query("family_blocks", f"SELECT seq_id, family_block, subfamily_block, count(*) AS n FROM {_BLOCKS.format(t='gene_pairs')} GROUP BY ALL", ("gene_pairs", "tf_master"))
def family_blocks(spark, sf):
    return P.family_blocks(views.gene_pairs(spark, sf), views.tf_master(spark, sf)).groupBy("seq_id", "family_block", "subfamily_block").agg(F.count("*").alias("n"))


def _windows_parts(spark, sf):
    """Windows whose pair label names part genes, so that family blocks exist."""
    n = F.lit(200)
    left = F.concat(F.lit("g"), hash_bucket(F.concat("seq_id", F.lit("L")), 200).cast("string"))
    right = F.concat(F.lit("g"), hash_bucket(F.concat("seq_id", F.lit("R")), 200).cast("string"))
    del n
    return views.windows(spark, sf).select("seq_id", "sequence", "chromosome", "state_label", "phase", "label", left.alias("left_tf"), right.alias("right_tf"), F.concat_ws("::", left, right).alias("tf_pair_label"))


_WP = f"(SELECT seq_id, chromosome, state_label, phase, 'g'||{_b('seq_id||' + repr('L'), 200)} AS left_tf, 'g'||{_b('seq_id||' + repr('R'), 200)} AS right_tf FROM windows)"


@query("six_way_splits", f"""
  WITH wp AS MATERIALIZED {_WP}, pr AS (SELECT * FROM wp WHERE phase IN ('phase2','phase4','phase5')), bl AS {_BLOCKS.format(t='pr')},
  long AS (SELECT seq_id, 'seen' AS split_name, seq_id AS group_value FROM pr UNION ALL SELECT seq_id, 'unseen_pair', least(left_tf,right_tf)||'::'||greatest(left_tf,right_tf) FROM pr
    UNION ALL SELECT seq_id, 'unseen_family', family_block FROM bl UNION ALL SELECT seq_id, 'unseen_subfamily', subfamily_block FROM bl
    UNION ALL SELECT seq_id, 'unseen_state', state_label FROM wp WHERE phase IN ('phase3','phase4','phase5') UNION ALL SELECT seq_id, 'sequence_locus', chromosome FROM wp)
  SELECT seq_id, split_name, group_value, {sql_split('group_value')} AS split FROM long""", ("windows", "tf_master"))
def six_way_splits(spark, sf):
    return P.all_splits(_windows_parts(spark, sf).drop("left_tf", "right_tf"), views.tf_master(spark, sf))


@query("split_group_counts", f"""
  WITH wp AS MATERIALIZED {_WP}, pr AS (SELECT * FROM wp WHERE phase IN ('phase2','phase4','phase5')), bl AS {_BLOCKS.format(t='pr')},
  long AS (SELECT 'seen' AS split_name, seq_id AS g FROM pr UNION ALL SELECT 'unseen_pair', least(left_tf,right_tf)||'::'||greatest(left_tf,right_tf) FROM pr UNION ALL SELECT 'unseen_family', family_block FROM bl
    UNION ALL SELECT 'unseen_subfamily', subfamily_block FROM bl UNION ALL SELECT 'unseen_state', state_label FROM wp WHERE phase IN ('phase3','phase4','phase5') UNION ALL SELECT 'sequence_locus', chromosome FROM wp)
  SELECT split_name, count(*) AS "rows", count(DISTINCT g) AS groups FROM long GROUP BY 1""", ("windows", "tf_master"))
def split_group_counts(spark, sf):
    return six_way_splits(spark, sf).groupBy("split_name").agg(F.count("*").alias("rows"), F.count_distinct("group_value").alias("groups"))


@query("split_routing", """SELECT phase, requested, CASE WHEN requested IN ('unseen_pair','unseen_family') AND phase NOT IN ('phase2','phase4','phase5') THEN 'default' WHEN requested='unseen_state' AND phase NOT IN ('phase3','phase4','phase5') THEN 'default' ELSE requested END AS effective,
  CASE WHEN phase='phase4' THEN state_label ELSE tf_pair_label END AS group_key, count(*) AS n FROM windows, (SELECT unnest(['unseen_pair','unseen_family','unseen_state','sequence_locus']) AS requested) GROUP BY ALL""", ("windows",))
def split_routing(spark, sf):
    w = J.grid(views.windows(spark, sf), requested=["unseen_pair", "unseen_family", "unseen_state", "sequence_locus"])
    return w.groupBy("phase", "requested", P.phase_split_name("requested", "phase").alias("effective"), P.split_group_key(w, "real").alias("group_key")).agg(F.count("*").alias("n"))


@query("holdout_split", f"SELECT seq_id, 'cross_biosample_test_fr' AS split_name, state_label AS group_value, CASE WHEN chromosome='fr' THEN 'test' WHEN {_b('state_label', 1000)}<850 THEN 'train' ELSE 'valid' END AS split FROM windows", ("windows",))
def holdout_split(spark, sf):
    return P.holdout_split(views.windows(spark, sf), "chromosome", "fr", "state_label").select("seq_id", "split_name", "group_value", "split")


@query("competition_split", f"""
  WITH g AS (SELECT DISTINCT actual_state||library_name AS grp FROM competition), s AS (SELECT grp, {sql_split('grp')} AS split, {_b('grp', 2**31)} AS h FROM g),
  c AS (SELECT count(*) FILTER (split='train') AS t, count(*) FILTER (split='valid') AS v, count(*) FILTER (split='test') AS e FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h DESC, grp DESC) AS back FROM s),
  m AS (SELECT grp, CASE WHEN split='train' AND v=0 AND back=1 THEN 'valid' WHEN split='train' AND e=0 AND v=0 AND t>2 AND back=2 THEN 'test' WHEN split='train' AND e=0 AND v>0 AND t>1 AND back=1 THEN 'test'
    WHEN split='valid' AND t=0 AND v>1 AND back=1 THEN 'train' WHEN split='test' AND t=0 AND v=0 AND back=1 THEN 'valid' ELSE split END AS split FROM r, c)
  SELECT actual_state||library_name AS grp, split, count(*) AS n FROM competition JOIN m ON m.grp=actual_state||library_name GROUP BY 1,2""", ("competition",))
def competition_split(spark, sf):
    df = views.competition(spark, sf).select(F.concat("actual_state", "library_name").alias("grp"))
    return P.competition_split(df, "grp").groupBy("grp", "split").agg(F.count("*").alias("n"))


@query("label_split", f"SELECT seq_id, {sql_split('key')} AS split FROM (SELECT seq_id, state_label||'::label::'||CASE WHEN label>0.5 THEN '1.0' ELSE '0.0' END AS key FROM predictions)", ("predictions",))
def label_split(spark, sf):
    return P.label_split(views.predictions(spark, sf), "state_label").select("seq_id", "split")


@query("rebalanced_split", """
  WITH m AS (SELECT seq_id, label, CASE WHEN chromosome='en' OR label>0.5 THEN 'train' ELSE 'test' END AS split FROM predictions),
  pick AS (SELECT (SELECT min(seq_id) FROM m WHERE split='train' AND label=0) AS z, (SELECT min(seq_id) FROM m WHERE split='train' AND label=1) AS o)
  SELECT seq_id, CASE WHEN seq_id IN (z,o) THEN 'valid' ELSE split END AS split FROM m, pick""", ("predictions",))
def rebalanced_split(spark, sf):
    p = views.predictions(spark, sf)
    manifest = p.select("seq_id", F.when((F.col("chromosome") == "en") | (F.col("label") > 0.5), "train").otherwise("test").alias("split"))
    return P.rebalance(manifest, p.select("seq_id", "label"), preserve_test=True).select("seq_id", "split")


@query("split_disjointness", f"SELECT doc_id, count(DISTINCT split) AS n_splits FROM (SELECT doc_id, {sql_split('seq_id')} AS split FROM windows) GROUP BY 1 HAVING count(DISTINCT split)>1", ("windows",))
def split_disjointness(spark, sf):
    w = views.windows(spark, sf).select("doc_id", P.assign_split("seq_id").alias("split"))
    return P.split_collisions(w, "doc_id")


@query("split_override", f"SELECT p.seq_id, coalesce(o.split, {sql_split('p.state_label')}) AS split FROM predictions p LEFT JOIN (SELECT DISTINCT state_label, 'valid' AS split FROM predictions WHERE element_type='pELS') o ON o.state_label=p.state_label", ("predictions",))
def split_override(spark, sf):
    p = views.predictions(spark, sf)
    manual = p.filter("element_type = 'pELS'").select("state_label", F.lit("valid").alias("split")).distinct()
    return P.override_split(p, manual, "state_label", P.assign_split("state_label")).select("seq_id", "split")


@query("manifest_lookup", f"""SELECT w.seq_id, coalesce(a.split, b.split, {sql_split('w.state_label')}) AS split FROM windows w
  LEFT JOIN (SELECT seq_id||'_w0' AS seq_id, {sql_split('seq_id')} AS split FROM predictions) a ON a.seq_id=w.seq_id
  LEFT JOIN (SELECT g AS g, {sql_split('m')} AS split FROM (SELECT state_label AS g, min(seq_id||'_w0') AS sid FROM predictions WHERE element_type<>'CA' GROUP BY 1) x JOIN (SELECT seq_id AS m FROM predictions) y ON y.m||'_w0'=x.sid) b ON b.g=w.state_label""", ("windows", "predictions"))
def manifest_lookup(spark, sf):
    p = views.predictions(spark, sf)
    manifest = p.select(F.concat("seq_id", F.lit("_w0")).alias("seq_id"), F.when(F.col("element_type") != "CA", F.col("state_label")).alias("group_value"), P.assign_split("seq_id").alias("split"))
    return J.apply_manifest(views.windows(spark, sf), manifest, F.col("state_label"), P.assign_split("state_label")).select("seq_id", "split")


@query("split_pair_transfer", f"SELECT pair, split, count(*) AS n FROM (SELECT least(left_tf,right_tf)||'::'||greatest(left_tf,right_tf) AS pair, {sql_split('least(left_tf,right_tf)||' + repr('::') + '||greatest(left_tf,right_tf)')} AS split FROM gene_pairs) GROUP BY 1,2", ("gene_pairs",))
def split_pair_transfer(spark, sf):
    p = P.group_split(views.gene_pairs(spark, sf), pair_key("left_tf", "right_tf"), "unseen_pair")
    return p.groupBy(F.col("group_value").alias("pair"), "split").agg(F.count("*").alias("n"))
