"""Aggregate and window queries (D, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgrammar import schema, views
from pairgrammar.operators import ordered as O
from pairgrammar.operators import selection as W
from pairgrammar.operators import summaries as D
from pairgrammar.queries.registry import query, rounded
from pairgrammar.views import sql_rank

P = ("predictions",)


@query("value_counts", "SELECT phase, label, construction_mode, count(*) AS n FROM windows GROUP BY ALL", ("windows",))
def value_counts(spark, sf):
    return D.value_counts(views.windows(spark, sf), "phase", "label", "construction_mode")


@query("region_summary", """SELECT element_group, min(chromosome) AS chromosome, min(region_start) AS region_start, max(region_end) AS region_end, count(*) AS bed_rows, count(*) FILTER (is_reverse) AS bed_reverse_rows, count(*) FILTER (NOT is_reverse) AS bed_forward_rows,
  round(avg(activity_score),6) AS mean_bed_activity, round(stddev_samp(activity_score),6) AS std_bed_activity, max(region_end)-min(region_start) AS element_width FROM replicates GROUP BY 1""", ("replicates",))
def region_summary(spark, sf):
    return rounded(D.aggregate_regions(views.replicates(spark, sf)))


@query("replicate_summary", """SELECT element_group, count(*) AS tsv_rows, count(DISTINCT replicate) AS replicate_count, min(replicate) AS replicate_min, max(replicate) AS replicate_max, round(avg(log2),6) AS mean_log2_activity, round(stddev_samp(log2),6) AS std_log2_activity,
  round(avg(ratio),6) AS mean_ratio, round(stddev_samp(ratio),6) AS std_ratio, min(n_obs_bc) AS min_obs_bc, round(avg(n_obs_bc),6) AS mean_obs_bc, count(*) FILTER (is_reverse) AS reverse_rows, count(*) FILTER (NOT is_reverse) AS forward_rows,
  round(avg(log2) FILTER (NOT is_reverse),6) AS forward_mean_log2, round(avg(log2) FILTER (is_reverse),6) AS reverse_mean_log2, round(abs(avg(log2) FILTER (NOT is_reverse)-avg(log2) FILTER (is_reverse)),6) AS orientation_gap_log2 FROM replicates GROUP BY 1""", ("replicates",))
def replicate_summary(spark, sf):
    return rounded(D.aggregate_replicates(views.replicates(spark, sf)))


@query("pivot_means", """SELECT tf_pair_label, round(avg(full_score) FILTER (orientation='++'),6) AS pp, round(avg(full_score) FILTER (orientation='--'),6) AS mm FROM predictions WHERE tf_pair_label IN (SELECT tf_pair_label FROM predictions GROUP BY 1 ORDER BY count(*) DESC, tf_pair_label LIMIT 12) GROUP BY 1""", P)
def pivot_means(spark, sf):
    p = views.predictions(spark, sf)
    top = D.top_categories(p, "tf_pair_label", 12)
    wide = D.pivot_means(p.join(top, "tf_pair_label", "left_semi"), "tf_pair_label", "orientation", "full_score", ["++", "--"])
    return rounded(wide.select("tf_pair_label", F.col("`++`").alias("pp"), F.col("`--`").alias("mm")))


@query("best_per_group", "SELECT competition_group, crs, activity_score FROM competition QUALIFY row_number() OVER (PARTITION BY competition_group ORDER BY activity_score DESC, crs)=1", ("competition",))
def best_per_group(spark, sf):
    return W.best_per_group(views.competition(spark, sf), ["competition_group"], ["-activity_score", "crs"]).select("competition_group", "crs", "activity_score")


@query("distinct_counts", "SELECT phase, count(DISTINCT state_label) AS state_label_distinct, count(DISTINCT tf_pair_label) AS tf_pair_label_distinct, count(DISTINCT nullif(left_tf,'')) AS left_tf_distinct FROM windows GROUP BY 1", ("windows",))
def distinct_counts(spark, sf):
    return D.distinct_counts(views.windows(spark, sf), ["state_label", "tf_pair_label", "left_tf"], ["phase"])


@query("distinct_list", "SELECT left_tf, array_to_string(list_sort(list(DISTINCT state_label)),',') AS states FROM predictions GROUP BY 1", P)
def distinct_list(spark, sf):
    return D.distinct_list(views.predictions(spark, sf), "left_tf", "state_label", "states")


@query("distinct_chunks", """SELECT l_returnflag AS flag, chunk, array_to_string(list_sort(list(v)),',') AS orders FROM (SELECT *, (row_number() OVER (PARTITION BY l_returnflag ORDER BY v)-1)//1000 AS chunk
  FROM (SELECT DISTINCT l_returnflag, CAST(l_orderkey AS VARCHAR) AS v FROM lineitem)) GROUP BY 1,2""")
def distinct_chunks(spark, sf):
    li = views.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return D.distinct_chunks(li, "flag", "l_orderkey", name="orders")


@query("quantiles", "SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice,0.1),6) AS q10, round(quantile_cont(l_extendedprice,0.5),6) AS med, round(quantile_cont(l_extendedprice,0.9),6) AS q90 FROM lineitem GROUP BY 1")
def quantiles(spark, sf):
    li = views.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return rounded(D.quantiles(li, "l_extendedprice", {"q10": 0.1, "med": 0.5, "q90": 0.9}, ["flag"]))


@query("minmax_scaling", "SELECT seq_id, round((availability_signal-min(availability_signal) OVER ())/(max(availability_signal) OVER ()-min(availability_signal) OVER ()),6) AS availability_signal FROM predictions", P)
def minmax_scaling(spark, sf):
    return rounded(D.minmax(views.predictions(spark, sf).select("seq_id", "availability_signal"), ["availability_signal"]))


_ST = "(SELECT o_custkey AS k, count(*) AS files, sum(o_orderkey%50)::DOUBLE AS total FROM orders GROUP BY 1)"


@query("support_score", f"SELECT k, round(least(greatest(0.7*(total-min(total) OVER ())/(max(total) OVER ()-min(total) OVER ())+0.3*(files-min(files) OVER ())/(max(files) OVER ()-min(files) OVER ()),0),1),6) AS state_support_score FROM {_ST}")
def support_score(spark, sf):
    s = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("state_supporting_files"), F.sum(F.col("o_orderkey") % 50).cast("double").alias("state_total_fragment_count"))
    return rounded(D.support_score(s).select("k", "state_support_score"))


@query("score_landscape", "SELECT edge_gap AS gap, orientation, round(avg(full_score),6) AS score FROM predictions GROUP BY 1,2", P)
def score_landscape(spark, sf):
    return rounded(D.landscape(views.predictions(spark, sf)))


@query("seed_summary", """WITH r AS (SELECT split_name, seed, avg(full_score) AS auprc, avg(availability_only_score) AS auroc FROM seed_scores GROUP BY 1,2)
  SELECT split_name, count(DISTINCT seed) AS n_seeds, string_agg(CAST(seed AS VARCHAR),',' ORDER BY seed) AS seeds, arg_max(seed, (auprc,-seed))::BIGINT AS best_seed_by_auprc, """ + ", ".join(
    f"round(avg({m}),6) AS {m}_mean, round(coalesce(stddev_samp({m}),0),6) AS {m}_std, round(min({m}),6) AS {m}_min, round(max({m}),6) AS {m}_max" for m in ("auprc", "auroc")) + " FROM r GROUP BY 1", ("seed_scores",))
def seed_summary(spark, sf):
    r = views.seed_scores(spark, sf).groupBy("split_name", "seed").agg(F.avg("full_score").alias("auprc"), F.avg("availability_only_score").alias("auroc"))
    return rounded(D.seed_summary(r, ["auprc", "auroc"]))


@query("sem_summary", "SELECT phase, label, count(full_score) AS n, round(avg(full_score),6) AS mean, round(coalesce(1.96*stddev_samp(full_score)/sqrt(count(full_score)),0),6) AS half_width FROM predictions GROUP BY 1,2", P)
def sem_summary(spark, sf):
    return rounded(D.sem_summary(views.predictions(spark, sf), ["phase", "label"], "full_score"))


@query("binary_summary", "SELECT element_type, count(*) AS n, count(*) FILTER (label>0.5) AS positive_n, count(*) FILTER (label<=0.5) AS negative_n, round(avg(CASE WHEN label>0.5 THEN 1.0 ELSE 0.0 END),6) AS positive_rate FROM predictions GROUP BY 1", P)
def binary_summary(spark, sf):
    return rounded(D.binary_summary(views.predictions(spark, sf), "label", ["element_type"]))


@query("qualify_states", "SELECT *, n_rows>=2 AND positives>0 AND positives<n_rows AND max_evidence>min_evidence AS qualified FROM (SELECT state_label, count(*) AS n_rows, count(*) FILTER (label>0.5) AS positives, min(full_score) AS min_evidence, max(full_score) AS max_evidence FROM predictions GROUP BY 1)", P)
def qualify_states(spark, sf):
    return D.qualify_states(views.predictions(spark, sf), evidence="full_score")


@query("seed_ensemble", "SELECT seq_id, round(avg(full_score),6) AS score_mean, round(coalesce(stddev_samp(full_score),0),6) AS score_std FROM seed_scores GROUP BY 1", ("seed_scores",))
def seed_ensemble(spark, sf):
    return rounded(D.ensemble(views.seed_scores(spark, sf), ["seq_id"], "full_score", 1))


@query("summary_with_total", "SELECT coalesce(left_tf,'ALL') AS left_tf, count(*) AS n, round(avg(full_score),6) AS mean_score FROM predictions GROUP BY ROLLUP(left_tf)", P)
def summary_with_total(spark, sf):
    return rounded(D.summary_with_total(views.predictions(spark, sf), "left_tf", n=F.count("*"), mean_score=F.avg("full_score")))


GAP_SQL = "SELECT round(avg(g),6) AS matched_availability_gain_mean, round(stddev_pop(g),6) AS matched_availability_gain_std FROM (SELECT availability_stratum, avg(full_score)-avg(availability_only_score) AS g FROM (SELECT *, greatest(((r-1)*5+n-2)//(n-1)-1,0) AS availability_stratum FROM (SELECT *, row_number() OVER (ORDER BY availability_signal, seq_id) AS r, count(*) OVER () AS n FROM predictions)) GROUP BY 1)"


@query("availability_gap", GAP_SQL, P)
def availability_gap(spark, sf):
    return rounded(D.availability_gap(W.strata(views.predictions(spark, sf), "availability_signal")))


LEAKAGE_SQL = "SELECT round(avg(bridge_score-bridge_score_interface_shuffle),6) AS bridge_leakage_index, round(avg(abs(bridge_score-bridge_score_core_rerandomized)),6) AS exclusive_core_sensitivity FROM predictions"


@query("leakage_audit", LEAKAGE_SQL, P)
def leakage_audit(spark, sf):
    return rounded(D.leakage_audit(views.predictions(spark, sf)))


@query("harmonic_fit", """WITH c AS (SELECT orientation, edge_gap AS x, avg(full_score) AS y0 FROM predictions GROUP BY 1,2), z AS (SELECT orientation, sin(x*2*pi()/10.5) AS s, cos(x*2*pi()/10.5) AS c, y0-avg(y0) OVER (PARTITION BY orientation) AS y FROM c),
  m AS (SELECT orientation, count(*) AS points, sum(s*s) AS ss, sum(c*c) AS cc, sum(s*c) AS sc, sum(s*y) AS sy, sum(c*y) AS cy, sum(y*y) AS yy FROM z GROUP BY 1), k AS (SELECT *, (sy*cc-cy*sc)/(ss*cc-sc*sc) AS a, (cy*ss-sy*sc)/(ss*cc-sc*sc) AS b FROM m)
  SELECT orientation, points, round(a,6) AS sin_coef, round(b,6) AS cos_coef, round(sqrt(a*a+b*b),6) AS amplitude, round((a*sy+b*cy)/yy,6) AS r_squared FROM k""", P)
def harmonic_fit(spark, sf):
    return rounded(D.harmonic_fit(D.landscape(views.predictions(spark, sf)), ["orientation"], "gap", "score"))


def near_bins(predictions):
    """Predicted gap bins ``pred``: nearly all mass on a bin beside the gap, by score."""
    hit = F.pmod(F.col("edge_gap").cast("long") + 4 + F.round(F.col("full_score") * 3).cast("long"), F.lit(25))
    bins = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.when(i == F.col("hit"), 0.904).otherwise(0.004))
    return predictions.withColumn("hit", hit).withColumn("pred", bins)


SPACING_SQL = """WITH b AS (SELECT unnest(range(0,25)) AS bin), p0 AS (SELECT edge_gap+4 AS t, (CAST(edge_gap AS BIGINT)+4+CAST(round(full_score*3) AS BIGINT))%25 AS p FROM predictions), n AS (SELECT count(*) AS n FROM predictions),
  r AS (SELECT bin, (SELECT count(*) FROM p0 WHERE t=bin)/n::DOUBLE AS t, ((SELECT count(*) FROM p0 WHERE p=bin)*0.9+n*0.1/25)/n::DOUBLE AS p FROM b, n), s AS (SELECT bin, t/sum(t) OVER () AS t, p/sum(p) OVER () AS p FROM r), c AS (SELECT *, sum(t) OVER (ORDER BY bin)-sum(p) OVER (ORDER BY bin) AS d FROM s),
  o AS (SELECT sum(t*ln((t+1e-8)/(p+1e-8))) AS kl, sum(abs(d)) AS emd FROM c) SELECT round(kl,5) AS spacing_kl, round(emd,5) AS spacing_emd, round(1/(1+emd+kl),5) AS helical_recovery FROM o"""


@query("spacing_metrics", SPACING_SQL, P)
def spacing_metrics(spark, sf):
    m = D.spacing_metrics(near_bins(views.predictions(spark, sf)), "edge_gap", "pred")
    return m.select(*[F.round(c, 5).alias(c) for c in m.columns])


@query("mutual_information", """WITH l AS (SELECT vec_id, label, unnest(['a0','a1','a2']) AS feature, unnest([availability[1],availability[2],availability[3]]) AS value FROM states), b AS (SELECT feature, label, (row_number() OVER (PARTITION BY feature ORDER BY value, vec_id)-1)*5//(SELECT count(*) FROM states) AS bin FROM l),
  j AS (SELECT feature, bin, label, count(*) AS nxy FROM b GROUP BY ALL), n AS (SELECT count(*) AS n FROM states) SELECT feature, round(sum(nxy/n::DOUBLE*ln(nxy*n::DOUBLE/(nx*ny))),6) AS mutual_information FROM (SELECT *, sum(nxy) OVER (PARTITION BY feature, bin) AS nx, sum(nxy) OVER (PARTITION BY feature, label) AS ny FROM j), n GROUP BY 1""", ("states",))
def mutual_information(spark, sf):
    s = views.states(spark, sf).select("vec_id", "label", *[F.get("availability", F.lit(i)).alias(f"a{i}") for i in range(3)])
    return rounded(D.mutual_information(s, ["a0", "a1", "a2"], "label", 5, "vec_id"))


@query("activity_margin", "SELECT library_name, actual_state, competition_group, count(*) AS group_size, max(activity_score) AS top_activity, min(activity_score) AS bottom_activity, round(max(activity_score)-min(activity_score),6) AS activity_margin FROM competition GROUP BY 1,2,3", ("competition",))
def activity_margin(spark, sf):
    return rounded(D.activity_margin(views.competition(spark, sf), ["library_name", "actual_state", "competition_group"], "activity_score"))


@query("softmin", "SELECT state_label, round(-0.5*(ln(sum(exp(-full_score/0.5-m)))+max(m)),6) AS softmin FROM (SELECT *, max(-full_score/0.5) OVER (PARTITION BY state_label) AS m FROM predictions) GROUP BY 1", P)
def softmin(spark, sf):
    return rounded(D.softmin(views.predictions(spark, sf), ["state_label"], "full_score", 0.5))


@query("dataset_rollup", "SELECT l_returnflag AS dataset, l_linestatus AS assay, count(*) AS \"rows\", count(DISTINCT gene) AS gene_count FROM (SELECT *, CASE WHEN l_partkey%10=0 THEN NULL ELSE 'g'||l_partkey END AS gene FROM lineitem) GROUP BY 1,2")
def dataset_rollup(spark, sf):
    li = views.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("assay"),
                                                   F.when(F.col("l_partkey") % 10 == 0, "").otherwise(F.concat(F.lit("g"), F.col("l_partkey").cast("string"))).alias("gene"))
    return D.dataset_rollup(li, ["dataset", "assay"], ["gene"])


# ---- F
@query("group_rank", "SELECT crs, row_number() OVER (PARTITION BY competition_group ORDER BY activity_score DESC, crs) AS activity_rank FROM competition", ("competition",))
def group_rank(spark, sf):
    return O.ranked(views.competition(spark, sf).select("crs", "competition_group", "activity_score"), ["competition_group"], ["-activity_score", "crs"], "activity_rank").select("crs", "activity_rank")


@query("first_rank_hot_group", "SELECT seq_id, row_number() OVER (PARTITION BY stratum ORDER BY score DESC, seq_id) AS rank_desc FROM line_scores", ("line_scores",))
def first_rank_hot_group(spark, sf):
    """Two strata hold all rows; small ranges force the split of a hot group."""
    return O.ranked(views.line_scores(spark, sf), ["stratum"], ["-score", "seq_id"], "rank_desc", ranges=16).select("seq_id", "rank_desc")


@query("group_size_margin", "SELECT crs, count(*) OVER w AS group_size, round(max(activity_score) OVER w-min(activity_score) OVER w,6) AS group_margin FROM competition WINDOW w AS (PARTITION BY competition_group)", ("competition",))
def group_size_margin(spark, sf):
    v = F.col("activity_score")
    return rounded(W.group_stats(views.competition(spark, sf), ["competition_group"], group_size=F.count("*"), group_margin=F.max(v) - F.min(v)).select("crs", "group_size", "group_margin"))


@query("hash_ranked_head", f"SELECT seq_id FROM windows QUALIFY row_number() OVER (PARTITION BY phase, state_label ORDER BY {sql_rank('seq_id')}, seq_id)<=5", ("windows",))
def hash_ranked_head(spark, sf):
    return W.ranked_head(views.windows(spark, sf), ["phase", "state_label"], 5).select("seq_id")


_WIN = """(SELECT state_label, seq_id, score, sup, count(*) OVER w AS n, max(score) OVER w AS top, min(score) OVER w AS low, sum(sup) OVER w AS s FROM {t} WINDOW w AS (PARTITION BY state_label))"""


@query("label_winners", f"""WITH c AS (SELECT actual_state||competition_group AS state_label, CAST(crs AS VARCHAR) AS seq_id, evidence AS sup, CASE WHEN evidence>0 THEN 1+(crs%3) ELSE 0 END::DOUBLE AS score FROM competition), x AS {_WIN.format(t='c')},
  y AS (SELECT *, sum(CASE WHEN score=top THEN 1 ELSE 0 END) OVER (PARTITION BY state_label) AS ntop FROM x)
  SELECT seq_id, row_number() OVER (PARTITION BY state_label ORDER BY score DESC, seq_id) AS evidence_rank, CASE WHEN score=top THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS usage_label FROM y WHERE n>=2 AND ntop=1 AND top>low AND s>0 AND s<n""", ("competition",))
def label_winners(spark, sf):
    c = views.competition(spark, sf).select(F.concat("actual_state", "competition_group").alias("state_label"), F.col("crs").cast("string").alias("seq_id"), F.col("evidence").alias("evidence_supported"),
                                            F.when(F.col("evidence") > 0, 1.0 + F.col("crs") % 3).otherwise(0.0).alias("evidence_score"))
    return W.label_winners(c).select("seq_id", "evidence_rank", "usage_label")


def _ext_sql(p: str) -> str:
    return f"""WITH s AS (SELECT *, count(*) OVER w AS n, max(activity_score) OVER w AS hi, min(activity_score) OVER w AS lo, row_number() OVER (PARTITION BY competition_group ORDER BY activity_score DESC, crs) AS d, row_number() OVER (PARTITION BY competition_group ORDER BY activity_score, crs DESC) AS a FROM competition WINDOW w AS (PARTITION BY competition_group))
  SELECT crs, CASE WHEN d<={p} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS derived_label FROM s WHERE n>=2 AND hi>lo AND (d<={p} OR a<={p})"""


@query("extrema_single", _ext_sql("1"), ("competition",))
def extrema_single(spark, sf):
    return W.extrema(views.competition(spark, sf), ["competition_group"], "activity_score", "crs").select("crs", "derived_label")


@query("extrema_adaptive", _ext_sql("(CASE WHEN n>=4 THEN 2 ELSE 1 END)"), ("competition",))
def extrema_adaptive(spark, sf):
    return W.extrema(views.competition(spark, sf), ["competition_group"], "activity_score", "crs", adaptive=True).select("crs", "derived_label")


@query("running_totals", "SELECT seq_id, round(sum(score) OVER w,4) AS running_sum, count(*) OVER w AS seen FROM line_scores WINDOW w AS (PARTITION BY stratum ORDER BY score, seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", ("line_scores",))
def running_totals(spark, sf):
    r = O.running(views.line_scores(spark, sf).select("seq_id", "stratum", "score"), ["stratum"], ["score", "seq_id"], {"s": ("sum", F.col("score")), "seen": ("sum", F.lit(1).cast("long"))})
    return r.select("seq_id", F.round("s", 4).alias("running_sum"), "seen")


@query("reverse_running_min", "SELECT crs, min(activity_score) OVER (PARTITION BY actual_state ORDER BY crs DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM competition", ("competition",))
def reverse_running_min(spark, sf):
    return O.running(views.competition(spark, sf).select("crs", "actual_state", "activity_score"), ["actual_state"], ["-crs"], {"low": ("min", F.col("activity_score"))}, ranges=16).select("crs", "low")


@query("round_robin", "SELECT seq_id FROM (SELECT *, row_number() OVER (PARTITION BY chromosome, label ORDER BY full_score, seq_id) AS rn FROM predictions) ORDER BY rn, chromosome, label LIMIT 60", P)
def round_robin(spark, sf):
    return W.round_robin(views.predictions(spark, sf), ["chromosome", "label"], ["full_score", "seq_id"], 60).select("seq_id")


@query("dedupe_keep_last", "SELECT competition_group, crs FROM competition QUALIFY row_number() OVER (PARTITION BY competition_group ORDER BY crs DESC)=1", ("competition",))
def dedupe_keep_last(spark, sf):
    return O.dedupe(views.competition(spark, sf), ["competition_group"], ["crs"], keep="last").select("competition_group", "crs")


# ---- G
@query("top_rows", "SELECT crs, activity_score FROM competition ORDER BY priority, activity_score DESC, crs LIMIT 50", ("competition",))
def top_rows(spark, sf):
    return W.top_rows(views.competition(spark, sf), ["priority", "-activity_score", "crs"], 50).select("crs", "activity_score")


_PRI = "CASE element_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in schema.ELEMENT_PRIORITY.items()) + " ELSE 9 END"


@query("sample_regions", f"SELECT chromosome||':'||region_start||'-'||region_end AS state_label, element_type, region_end-region_start AS width FROM regions ORDER BY {_PRI}, {sql_rank('screen_id', 'encode_id', 'chromosome', 'region_start', 'region_end')} LIMIT 200", ("regions",))
def sample_regions(spark, sf):
    return W.sample_regions(views.regions(spark, sf), 200).select("state_label", "element_type", "width")


@query("diverse_pick", "SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rn FROM part) ORDER BY rn>1, p_retailprice, p_partkey LIMIT 60")
def diverse_pick(spark, sf):
    return W.diverse_pick(views.table(spark, sf, "part"), "p_brand", ["p_retailprice", "p_partkey"], 60).select("p_partkey")


@query("pick_case", "SELECT seq_id, round(abs(geometry_residual)-abs(bridge_residual),6) AS case_score FROM predictions ORDER BY left_tf='G_en0' AND right_tf='G_fr1' DESC, round(abs(geometry_residual)-abs(bridge_residual),9) DESC, seq_id LIMIT 1", P)
def pick_case(spark, sf):
    p = views.predictions(spark, sf)
    pool = (F.col("left_tf") == "G_en0") & (F.col("right_tf") == "G_fr1")
    return rounded(W.pick_case(p, F.round(F.abs("geometry_residual") - F.abs("bridge_residual"), 9), pool).select("seq_id", "case_score"))


@query("extreme_states", "(SELECT state_label, round(avg(full_score),6) AS mean_value, 'high' AS extreme FROM predictions GROUP BY 1 ORDER BY avg(full_score) DESC, state_label LIMIT 1) UNION ALL (SELECT state_label, round(avg(full_score),6), 'low' FROM predictions GROUP BY 1 ORDER BY avg(full_score), state_label DESC LIMIT 1)", P)
def extreme_states(spark, sf):
    return rounded(W.extreme_states(views.predictions(spark, sf), "state_label", "full_score"))


@query("dynamic_pair", "WITH c AS (SELECT orientation AS pair, edge_gap, count(*) AS n, avg(full_score) AS m FROM predictions GROUP BY 1,2) SELECT pair, sum(n)::BIGINT AS \"rows\", round(max(m)-min(m),6) AS span, round(coalesce(stddev_samp(m),0),6) AS spread, round(max(m)-min(m)+coalesce(stddev_samp(m),0),6) AS dynamics FROM c GROUP BY 1 HAVING sum(n)>=20 ORDER BY max(m)-min(m)+coalesce(stddev_samp(m),0) DESC, pair LIMIT 1", P)
def dynamic_pair(spark, sf):
    p = views.predictions(spark, sf).withColumnRenamed("orientation", "pair")
    return rounded(W.dynamic_pair(p, "pair", "edge_gap", "full_score", 20))


@query("widest_margin", "SELECT pair, positions, round(margin,6) AS margin FROM (SELECT orientation AS pair, count(DISTINCT edge_gap) AS positions, avg(full_score) FILTER (label>0.5)-avg(full_score) FILTER (label<=0.5) AS margin FROM predictions GROUP BY 1) WHERE positions>=4 AND margin IS NOT NULL ORDER BY margin DESC, pair LIMIT 1", P)
def widest_margin(spark, sf):
    return rounded(W.widest_margin(views.predictions(spark, sf).withColumnRenamed("orientation", "pair"), "pair", "edge_gap", "label", "full_score"))


@query("best_prefix", "SELECT file_id, pairs::BIGINT AS pairs, monomers::BIGINT AS monomers FROM (SELECT file_id, sum(p) OVER w AS pairs, sum(m) OVER w AS monomers FROM (SELECT l_linenumber::BIGINT AS file_id, count(*) FILTER (l_linenumber<5)::BIGINT AS p, count(*) FILTER (l_returnflag='A' AND l_linenumber<4)::BIGINT AS m FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) ORDER BY pairs DESC, monomers DESC, file_id LIMIT 1")
def best_prefix(spark, sf):
    n = F.col("l_linenumber")
    per = views.table(spark, sf, "lineitem").groupBy(n.cast("long").alias("file_id")).agg(F.count_if(n < 5).alias("pairs"), F.count_if((F.col("l_returnflag") == "A") & (n < 4)).alias("monomers"))
    return W.best_prefix(per, "file_id", ["pairs", "monomers"])


@query("diverse_tfs", "SELECT tf_id FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY tf_id) AS rn, dense_rank() OVER (ORDER BY family) AS fr FROM tf_master WHERE family<>'') WHERE rn<=2 AND fr<=6", ("tf_master",))
def diverse_tfs(spark, sf):
    return W.diverse_tfs(views.tf_master(spark, sf)).select("tf_id")
