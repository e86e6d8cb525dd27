"""Join, interval, set and reshape queries (C, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgrammar import views
from pairgrammar.functions.keys import pair_key
from pairgrammar.operators import intervals as N
from pairgrammar.operators import joins as J
from pairgrammar.operators import selection as W
from pairgrammar.queries.registry import query, rounded


@query("attach_state", "SELECT w.seq_id, s.vec_id, round(s.availability[1],6) AS a0 FROM windows w JOIN (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY state_label ORDER BY vec_id)=1) s USING (state_label)", ("windows", "states"))
def attach_state(spark, sf):
    j = J.attach_state(views.windows(spark, sf), views.states(spark, sf), ["vec_id"])
    return rounded(j.select("seq_id", "vec_id", F.get("availability", F.lit(0)).alias("a0")))


@query("enrich_chain", "SELECT c_custkey, c_name, n_name AS n_name_nat, n_regionkey AS n_regionkey_nat, k AS supplier_count_sup FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) ON s_nationkey=c_nationkey")
def enrich_chain(spark, sf):
    base = views.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "k")
    nat = views.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "k").select("k", "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    sup = views.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("supplier_count"))
    return J.enrich(base, "k", nat=nat, sup=sup).select("c_custkey", "c_name", "n_name_nat", "n_regionkey_nat", "supplier_count_sup")


@query("lookup_map", "SELECT seq_id, left_tf, family FROM gene_pairs LEFT JOIN tf_master ON left_tf=gene_symbol", ("gene_pairs", "tf_master"))
def lookup_map(spark, sf):
    dim = views.tf_master(spark, sf).select(F.col("gene_symbol").alias("left_tf"), "family")
    return J.lookup(views.gene_pairs(spark, sf), dim, "left_tf").select("seq_id", "left_tf", "family")


@query("keep_known", "SELECT seq_id FROM windows WHERE doc_id IN (SELECT doc_id FROM predictions)", ("windows", "predictions"))
def keep_known(spark, sf):
    return J.keep_known(views.windows(spark, sf), views.predictions(spark, sf), ["doc_id"]).select("seq_id")


@query("drop_known", "SELECT seq_id FROM windows WHERE doc_id NOT IN (SELECT doc_id FROM predictions)", ("windows", "predictions"))
def drop_known(spark, sf):
    return J.drop_known(views.windows(spark, sf), views.predictions(spark, sf), ["doc_id"]).select("seq_id")


@query("align_seeds", "SELECT seq_id, label, round(avg(full_score),6) AS full_score, round(avg(availability_only_score),6) AS availability_only_score FROM seed_scores GROUP BY 1,2 HAVING count(DISTINCT seed)=5", ("seed_scores",))
def align_seeds(spark, sf):
    return rounded(J.align_seeds(views.seed_scores(spark, sf), [11, 17, 23, 29, 47], ["seq_id", "label"], ["full_score", "availability_only_score"]))


@query("checked_join", "SELECT seq_id, label, doc_id FROM predictions", ("predictions",))
def checked_join(spark, sf):
    p = views.predictions(spark, sf)
    return J.checked_join(p.select("seq_id", "label"), p.select("seq_id", "doc_id"), ["seq_id"], "one_to_one")


_RANGE = "fragments f JOIN regions r ON r.chromosome=f.chromosome AND r.region_start<f.\"end\" AND r.region_end>f.start AND f.\"end\">f.start"


@query("overlap_counts", f"SELECT r.region_id, coalesce(n,0) AS fragment_count FROM regions r LEFT JOIN (SELECT region_id, count(*) AS n FROM {_RANGE} GROUP BY 1) x USING (region_id)", ("fragments", "regions"))
def overlap_counts(spark, sf):
    return N.count_overlaps(views.regions(spark, sf), views.fragments(spark, sf), ["region_id"]).select("region_id", "fragment_count")


@query("overlap_counts_salted", f"SELECT r.region_id, coalesce(n,0) AS fragment_count FROM regions r LEFT JOIN (SELECT region_id, count(*) AS n FROM {_RANGE} GROUP BY 1) x USING (region_id)", ("fragments", "regions"))
def overlap_counts_salted(spark, sf):
    """The join of hits, with salted bins."""
    regions = views.regions(spark, sf)
    hits = N.overlap_pairs(regions, views.fragments(spark, sf).select("chromosome", "start", "end"), 3_000, salts=4).groupBy("region_id").agg(F.count("*").alias("fragment_count"))
    return regions.select("region_id").join(hits, "region_id", "left").fillna(0, ["fragment_count"])


@query("support_counts", f"SELECT region_id, sum(n)::BIGINT AS total_fragment_count, count(*) AS supporting_files FROM (SELECT region_id, file_id, count(*) AS n FROM {_RANGE} GROUP BY 1,2) GROUP BY 1", ("fragments", "regions"))
def support_counts(spark, sf):
    per = N.count_overlaps(views.regions(spark, sf), views.fragments(spark, sf), ["region_id"], extra=["file_id"])
    return N.support_counts(per, ["region_id"])


_MERGED = """SELECT {k}, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(nw) OVER (PARTITION BY {k} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
  SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY {k} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY {k} ORDER BY start, "end")=1 THEN 1 ELSE 0 END AS nw FROM {t} WHERE "end">start)) GROUP BY {k}, g"""


@query("merge_intervals", _MERGED.format(k="chromosome", t="fragments"), ("fragments",))
def merge_intervals(spark, sf):
    return W.merge_intervals(views.fragments(spark, sf), ["chromosome"]).select("chromosome", "start", "end")


def peak_rows(spark, sf):
    """Regions with two genes each, and peaks per gene from the fragments."""
    r = views.regions(spark, sf).select(F.col("region_id").alias("seq_id"), "chromosome", "region_start", "region_end",
                                       F.concat(F.lit("f"), (F.length("region_id") % 3).cast("string")).alias("left_tf"), F.concat(F.lit("f"), (F.length("element_type") % 6).cast("string")).alias("right_tf"))
    f = views.fragments(spark, sf).select(F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("gene"), "chromosome", "start", "end")
    return r, W.merge_intervals(f, ["gene", "chromosome"])


PEAKS_SQL = f"""rr AS MATERIALIZED (SELECT region_id AS seq_id, chromosome, region_start, region_end, 'f'||(length(region_id)%3) AS left_tf, 'f'||(length(element_type)%6) AS right_tf FROM regions),
  pk AS MATERIALIZED ({_MERGED.format(k='gene, chromosome', t="(SELECT 'f'||file_id AS gene, chromosome, start, \"end\" FROM fragments)")}),
  fl AS MATERIALIZED (SELECT *, (CASE WHEN lc THEN 1 ELSE 0 END)+(CASE WHEN rc THEN 1 ELSE 0 END) AS num_covered_tfs FROM (SELECT rr.*, left_tf IN (SELECT gene FROM pk) AS lc, right_tf IN (SELECT gene FROM pk) AS rc,
    EXISTS (SELECT 1 FROM pk WHERE pk.gene=rr.left_tf AND pk.chromosome=rr.chromosome AND pk.start<rr.region_end AND pk."end">rr.region_start) AS lo,
    EXISTS (SELECT 1 FROM pk WHERE pk.gene=rr.right_tf AND pk.chromosome=rr.chromosome AND pk.start<rr.region_end AND pk."end">rr.region_start) AS ro FROM rr))"""


@query("overlap_flags", f"WITH {PEAKS_SQL} SELECT seq_id, lc AS left_tf_covered, rc AS right_tf_covered, lo AS left_tf_overlap, ro AS right_tf_overlap, num_covered_tfs::BIGINT AS num_covered_tfs, lo OR ro AS any_tf_overlap, lo AND ro AS both_tfs_overlap FROM fl", ("fragments", "regions"))
def overlap_flags(spark, sf):
    r, peaks = peak_rows(spark, sf)
    return rounded(N.overlap_flags(r, peaks, 20_000).select("seq_id", "left_tf_covered", "right_tf_covered", "left_tf_overlap", "right_tf_overlap", "num_covered_tfs", "any_tf_overlap", "both_tfs_overlap"))


_LOST = "(doc_id % 4 = 1 AND c = 0 OR doc_id % 4 = 2 AND c = 1 OR doc_id % 4 = 3 AND c = (length(bases) - 1) // 200)"


@query("hydrate_windows", f"""
  WITH s AS (SELECT seq_id, doc_id, bases, length(bases) AS n FROM sequences), w AS (SELECT *, o * 150 AS w, least(o * 150 + 96, n) AS e FROM (SELECT *, unnest(range(0, n // 150 + 1)) AS o FROM s)),
  lost AS (SELECT seq_id, c * 200 AS a, c * 200 + 200 AS b FROM (SELECT *, unnest(range(0, (n + 199) // 200)) AS c FROM s) WHERE {_LOST})
  SELECT seq_id || '_' || o AS seq_id, CASE WHEN ok THEN rpad(substr(bases, CAST(w + 1 AS INT), 96), 96, 'N') END AS sequence, CASE WHEN ok THEN 'complete' ELSE 'incomplete' END AS hydration_status
  FROM (SELECT w.*, w.w < n AND NOT EXISTS (SELECT 1 FROM lost l WHERE l.seq_id = w.seq_id AND l.a < w.e AND l.b > w.w) AS ok FROM w)""", ("sequences",))
def hydrate_windows(spark, sf):
    """Windows over all sequences; some have lost their first, second or last chunk."""
    s = views.sequences(spark, sf)
    n = F.floor(F.length("bases") / 150).cast("int")
    regions = s.select("seq_id", F.explode(F.sequence(F.lit(0), n)).alias("o")).select(
        F.concat("seq_id", F.lit("_"), F.col("o").cast("string")).alias("seq_id"), F.col("seq_id").alias("chromosome"), (F.col("o") * 150).cast("long").alias("window_start"))
    last = F.floor((F.length("bases") - 1) / 200).cast("int")
    chunks = s.filter(F.length("bases") > 0).select(F.col("seq_id").alias("chromosome"), "doc_id", "bases", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("c"))
    lost = "doc_id % 4 = 1 AND c = 0 OR doc_id % 4 = 2 AND c = 1 OR doc_id % 4 = 3 AND c = last"
    chunks = chunks.filter(f"NOT ({lost})").select(
        "chromosome", F.col("c").cast("long").alias("chunk_id"), (F.col("c") * 200).cast("long").alias("start"), F.substring("bases", F.col("c") * 200 + 1, F.lit(200)).alias("bases"))
    lengths = s.select(F.col("seq_id").alias("chromosome"), F.length("bases").alias("chromosome_length"))
    return N.hydrate_windows(regions, chunks, 96, 200, lengths=lengths).select("seq_id", "sequence", "hydration_status")


@query("attach_metadata", "SELECT p.seq_id, p.label, p.full_score, d.n_chars FROM predictions p LEFT JOIN documents d ON 'doc'||d.doc_id=p.seq_id", ("predictions",))
def attach_metadata(spark, sf):
    meta = views.table(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("seq_id"), "n_chars", F.lit(-1.0).alias("label"))
    return J.attach_metadata(views.predictions(spark, sf).select("seq_id", "label", "full_score"), meta).select("seq_id", "label", "full_score", "n_chars")


def _pair_sources(spark, sf):
    g = views.gene_pairs(spark, sf).select(F.concat("left_tf", F.lit("_"), "right_tf").alias("pair_name"), "left_tf", "right_tf", "flag").distinct()
    return [g.filter(F.col("flag") == f) for f in ("A", "N", "R")]


_G = "(SELECT DISTINCT left_tf||'_'||right_tf AS pair_name, left_tf, right_tf, flag FROM gene_pairs WHERE flag='{0}')"
_UK = "least(left_tf,right_tf)||'::'||greatest(left_tf,right_tf)"


@query("priority_union", f"""WITH a AS {_G.format('A')}, b AS {_G.format('N')}, c AS {_G.format('R')} SELECT pair_name, flag FROM a UNION ALL SELECT pair_name, flag FROM b WHERE pair_name NOT IN (SELECT pair_name FROM a)
  UNION ALL SELECT pair_name, flag FROM c WHERE pair_name NOT IN (SELECT pair_name FROM a) AND {_UK} NOT IN (SELECT {_UK} FROM a)""", ("gene_pairs",))
def priority_union(spark, sf):
    return J.priority_union(*_pair_sources(spark, sf)).select("pair_name", "flag")


@query("missing_slices", "SELECT state_label, split_name, 'missing_predictions' AS reason FROM (SELECT DISTINCT state_label FROM predictions), (SELECT unnest(['default','unseen_pair','unseen_state','sequence_locus']) AS split_name) EXCEPT SELECT DISTINCT state_label, split_name, 'missing_predictions' FROM predictions", ("predictions",))
def missing_slices(spark, sf):
    p = views.predictions(spark, sf)
    wanted = J.grid(p.select("state_label").distinct(), split_name=["default", "unseen_pair", "unseen_state", "sequence_locus"])
    return J.missing_slices(wanted, p, ["state_label", "split_name"], "missing_predictions").select("state_label", "split_name", "reason")


@query("reference_support", f"SELECT seq_id, {_UK} IN (SELECT {_UK} FROM edges) AS reference_supported FROM windows", ("windows", "edges"))
def reference_support(spark, sf):
    return J.reference_support(views.windows(spark, sf), views.edges(spark, sf)).select("seq_id", "reference_supported")


@query("union_missing_columns", "SELECT seq_id, part, label, NULL::DOUBLE AS quantity FROM predictions, (SELECT 'p' AS part) UNION ALL SELECT seq_id, 'g', NULL, quantity FROM gene_pairs", ("predictions", "gene_pairs"))
def union_missing_columns(spark, sf):
    return J.tagged_union("part", p=views.predictions(spark, sf).select("seq_id", "label"), g=views.gene_pairs(spark, sf).select("seq_id", "quantity"))


@query("distinct_on", "SELECT DISTINCT left_tf, right_tf, flag FROM gene_pairs", ("gene_pairs",))
def distinct_on(spark, sf):
    return views.gene_pairs(spark, sf).select("left_tf", "right_tf", "flag").dropDuplicates(["left_tf", "right_tf", "flag"])


@query("key_union", "SELECT left_tf AS gene FROM gene_pairs UNION SELECT right_tf FROM gene_pairs", ("gene_pairs",))
def key_union(spark, sf):
    return J.key_union(views.gene_pairs(spark, sf), "left_tf", "right_tf", "gene")


@query("missing_keys", "SELECT DISTINCT gene_symbol AS right_tf FROM tf_master EXCEPT SELECT right_tf FROM gene_pairs", ("tf_master", "gene_pairs"))
def missing_keys(spark, sf):
    return J.missing_keys(views.tf_master(spark, sf).select(F.col("gene_symbol").alias("right_tf")), views.gene_pairs(spark, sf), ["right_tf"])


@query("common_keys", "SELECT left_tf AS k FROM gene_pairs INTERSECT SELECT right_tf FROM gene_pairs", ("gene_pairs",))
def common_keys(spark, sf):
    g = views.gene_pairs(spark, sf)
    return J.common_keys(g.select(F.col("left_tf").alias("k")), g.select(F.col("right_tf").alias("k")), ["k"])


@query("melt_scores", "SELECT seq_id, unnest(['full_score','bridge_score','geometry_residual']) AS component, unnest([full_score,bridge_score,geometry_residual]) AS value FROM predictions", ("predictions",))
def melt_scores(spark, sf):
    return J.melt(views.predictions(spark, sf), ["seq_id"], ["full_score", "bridge_score", "geometry_residual"], "component")


@query("flatten_metrics", """SELECT event_id, 'phase4' AS phase, event_type AS feature_group, m AS estimator, event_type||'/'||m AS method, CASE m WHEN 'logit' THEN round(value/1000,6) ELSE round(value/500,6) END AS auprc, CASE m WHEN 'logit' THEN user_id::DOUBLE END AS auroc FROM events, (SELECT unnest(['logit','forest']) AS m)""")
def flatten_metrics(spark, sf):
    v = F.round(F.col("value") / 1000, 6).cast("string")
    v2 = F.round(F.col("value") / 500, 6).cast("string")
    doc = F.concat(F.lit('{"phase4":{"'), "event_type", F.lit('":{"logit":{"auprc":'), v, F.lit(',"auroc":'), F.col("user_id").cast("string"), F.lit('},"forest":{"auprc":'), v2,
                   F.lit('},"empty":{"auroc":1}}},"phase5":{}}'))
    ev = views.table(spark, sf, "events").select("event_id", doc.alias("doc"))
    return rounded(J.flatten_metrics(ev, "doc", "phase4").select("event_id", "phase", "feature_group", "estimator", "method", "auprc", "auroc"))


@query("pair_order_insensitive", f"SELECT {_UK} AS pair, count(*) AS n, count(DISTINCT left_tf) AS orders FROM gene_pairs GROUP BY 1 HAVING count(*)>1", ("gene_pairs",))
def pair_order_insensitive(spark, sf):
    return views.gene_pairs(spark, sf).groupBy(pair_key("left_tf", "right_tf").alias("pair")).agg(F.count("*").alias("n"), F.count_distinct("left_tf").alias("orders")).filter("n > 1")
