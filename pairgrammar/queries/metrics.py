"""Metric and statistics queries (E, parts of D and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgrammar import views
from pairgrammar.operators import metrics as M
from pairgrammar.operators import resampling as R
from pairgrammar.operators import selection as W
from pairgrammar.operators import splits as P
from pairgrammar.operators import stats as X
from pairgrammar.operators import summaries as D
from pairgrammar.queries.registry import query, rounded
from pairgrammar.queries.splits import sql_split

PREDS = ("predictions",)


def sql_rank_metrics(source: str, label: str, score: str, by: str = "", weight: str = "1") -> str:
    """Table expression with n, positives, auprc and auroc per group."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {keys} CAST(p+n0 AS BIGINT) AS n, CAST(p AS BIGINT) AS positives, CASE WHEN p>0 AND n0>0 THEN ap/p END AS auprc, CASE WHEN p>0 AND n0>0 THEN 1-above/(p*n0) END AS auroc FROM (
      SELECT {keys} sum(pos) AS p, sum(neg) AS n0, coalesce(sum(pos*tp/nullif(tp+fp,0)),0) AS ap, sum(pos*(fp-neg/2)) AS above FROM (
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (SELECT {keys} {score} AS s, CAST(sum(CASE WHEN {label}>0.5 THEN {weight} ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN {label}>0.5 THEN 0 ELSE {weight} END) AS DOUBLE) AS neg
          FROM {source} WHERE {label} IS NOT NULL AND {score} IS NOT NULL GROUP BY {keys} {score})
        WINDOW w AS ({part} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) {group}))"""


@query("split_ranking_metrics", f"""SELECT split, n, positives, round(positives/n,6) AS prevalence, round(auprc,6) AS auprc, round(auroc,6) AS auroc FROM {sql_rank_metrics('(SELECT *, ' + sql_split('seq_id') + ' AS split FROM predictions)', 'label', 'full_score', 'split')}""", PREDS)
def split_ranking_metrics(spark, sf):
    p = views.predictions(spark, sf).withColumn("split", P.assign_split("seq_id"))
    m = M.ranking_metrics(p, "label", "full_score", ["split"])
    return rounded(m.select("split", "n", "positives", (F.col("positives") / F.col("n")).alias("prevalence"), "auprc", "auroc"))


@query("auroc_auprc_lines", f"SELECT stratum, n, positives, round(auprc,6) AS auprc, round(auroc,6) AS auroc FROM {sql_rank_metrics('line_scores', 'label', 'score', 'stratum')}", ("line_scores",))
def auroc_auprc_lines(spark, sf):
    return rounded(M.ranking_metrics(views.line_scores(spark, sf), "label", "score", ["stratum"]))


@query("auroc_auprc_all", f"SELECT n, positives, round(auprc,6) AS auprc, round(auroc,6) AS auroc FROM {sql_rank_metrics('line_scores', 'label', 'score')}", ("line_scores",))
def auroc_auprc_all(spark, sf):
    return rounded(M.ranking_metrics(views.line_scores(spark, sf), "label", "score"))


_BINARY = """round(avg((full_score-label)**2),6) AS brier, round(avg(-(label*ln(p)+(1-label)*ln(1-p))),6) AS nll, round((avg(CASE WHEN label>0.5 THEN h END)+avg(CASE WHEN label<=0.5 THEN 1-h END))/2,6) AS balanced_accuracy
  FROM (SELECT *, least(greatest(full_score,1e-6::DOUBLE),1-1e-6::DOUBLE) AS p, CASE WHEN full_score>=0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h FROM predictions)"""
BINARY_SQL = f"SELECT {_BINARY}"
_ECE = """round(sum(CASE WHEN b IS NOT NULL THEN abs(c-a)*n ELSE 0 END)/sum(n),6) AS ece"""
_ECE_BIN = "CASE WHEN full_score BETWEEN 0 AND 1 THEN least(floor(full_score*10),9) END AS b, count(*) AS n, avg(full_score) AS c, avg(label) AS a"
CALIBRATION_SQL = f"SELECT {_ECE} FROM (SELECT {_ECE_BIN} FROM predictions GROUP BY 1)"


@query("binary_metrics", f"SELECT phase, {_BINARY} GROUP BY 1", PREDS)
def binary_metrics(spark, sf):
    return rounded(M.binary_metrics(views.predictions(spark, sf), "label", "full_score", ["phase"]))


@query("calibration_error", f"SELECT phase, {_ECE} FROM (SELECT phase, {_ECE_BIN} FROM predictions GROUP BY 1,2) GROUP BY 1", PREDS)
def calibration_error(spark, sf):
    return rounded(M.calibration_error(views.predictions(spark, sf), "label", "full_score", ["phase"]))


@query("top_k_recall", "SELECT round((SELECT sum(label) FROM (SELECT label FROM line_scores ORDER BY score DESC, seq_id LIMIT 500))/(SELECT sum(label) FROM line_scores),6) AS recall", ("line_scores",))
def top_k_recall(spark, sf):
    return rounded(M.top_k_recall(views.line_scores(spark, sf), "label", "score", 500))


_MOST_LEVELS = 6  # the oracles know cells of up to 63 rows; the tables have far smaller ones


def sql_draws(seed: int, key: str, rows: str, cell: str, replicates: int) -> str:
    """Cells of a table (rows alike in ``cell``) with a uniform number z for each replicate and power of two in their count, by the operators' hash."""
    return f"""(SELECT *, (y*{R.STEP}+x)%{R.PRIME} AS z FROM (SELECT *, x*x%{R.PRIME} AS y FROM (SELECT t.*, c.replicate, (h*c.ra+c.rb)%{R.PRIME} AS x FROM (
      SELECT {cell}, level, (h+level*{R.LEVEL_STEP})%{R.PRIME} AS h FROM (SELECT {cell}, count(*) AS n, min(('0x'||substr(sha256({key}),1,8))::BIGINT%{R.PRIME}) AS h FROM {rows} GROUP BY {cell}), (SELECT unnest(range(0,{_MOST_LEVELS})) AS level) WHERE (n>>level)&1=1) t, {sql_constants(seed, replicates)} c)))"""


def sql_constants(seed: int, replicates: int) -> str:
    return f"(SELECT replicate, 1+('0x'||substr(sha256('{seed}|'||replicate||'|a'),1,8))::BIGINT%{R.PRIME - 1} AS ra, ('0x'||substr(sha256('{seed}|'||replicate||'|b'),1,8))::BIGINT%{R.PRIME} AS rb FROM (SELECT unnest(range(1,{replicates + 1})) AS replicate))"


def sql_drawn(kind: str) -> str:
    """What a cell's power of two draws: thresholds that z has reached."""
    each = [R.thresholds(kind, level) for level in range(_MOST_LEVELS)]
    return "CASE level " + " ".join(f"WHEN {level} THEN {low}+" + "+".join(f"(z>={t})::INT" for t in table) for level, (low, table) in enumerate(each)) + " END"


def sql_poisson_steps(drawn: str) -> str:
    """CTEs up to ``steps``: for each level that is drawn, what z draws from t on, as ``resampling.thresholds`` has it; levels have no upper end."""
    return f"""used AS MATERIALIZED (SELECT DISTINCT level, 1<<level AS n FROM {drawn}),
  odds AS (SELECT level, k, sum(CASE WHEN k=low THEN 0 ELSE ln(n/k::DOUBLE) END) OVER (PARTITION BY level ORDER BY k) AS log
    FROM (SELECT *, unnest(range(low, high+1)) AS k FROM (SELECT level, n::DOUBLE AS n, greatest(0, trunc(n-12*sqrt(n)-20))::BIGINT AS low, trunc(n+12*sqrt(n)+20)::BIGINT AS high FROM used WHERE level>0))),
  weight AS (SELECT level, k, exp(log-max(log) OVER (PARTITION BY level)) AS v FROM odds),
  steps AS MATERIALIZED (SELECT level, t, max(w) AS w FROM (
    SELECT level, k+1 AS w, trunc({R.PRIME}*(sum(v) OVER (PARTITION BY level ORDER BY k)/sum(v) OVER (PARTITION BY level)))::BIGINT AS t FROM weight
    UNION ALL SELECT level, min(k), -1 FROM odds GROUP BY 1
    UNION ALL SELECT 0, k+1, trunc({R.PRIME}*exp(-1)*(SELECT sum(1/factorial(i::INT)) FROM (SELECT unnest(range(0,k+1)) AS i)))::BIGINT FROM (SELECT unnest(range(0,10)) AS k)
    UNION ALL SELECT 0, 0, -1) GROUP BY 1,2)"""


_CELL = "label, full_score, availability_only_score"
_BOOT = f"bt AS MATERIALIZED (SELECT replicate, {sql_drawn('poisson')} AS w, {_CELL} FROM {sql_draws(11, 'seq_id', 'predictions', _CELL, 5000)})"


def _sql_boot(metric: str) -> str:
    return f"""
  WITH {_BOOT},
  m AS {sql_rank_metrics('bt', 'label', 'full_score', 'replicate', 'w')}, a AS {sql_rank_metrics('bt', 'label', 'availability_only_score', 'replicate', 'w')},
  om AS {sql_rank_metrics('predictions', 'label', 'full_score')}, oa AS {sql_rank_metrics('predictions', 'label', 'availability_only_score')},
  d AS (SELECT coalesce(m.{metric}-a.{metric}, om.{metric}-oa.{metric}) AS d FROM m JOIN a USING (replicate), om, oa)
  SELECT '{metric}' AS metric_name, round(max(om.{metric}),6) AS model_metric, round(max(oa.{metric}),6) AS baseline_metric, round(max(om.{metric}-oa.{metric}),6) AS observed_diff,
    round(quantile_cont(d,0.025),6) AS ci_low, round(quantile_cont(d,0.975),6) AS ci_high, round((count(*) FILTER (d<=0)+1)/(count(*)+1),6) AS bootstrap_p_value FROM d, om, oa"""


@query("paired_bootstrap", _sql_boot("auprc"), PREDS)
def paired_bootstrap(spark, sf):
    return rounded(X.paired_bootstrap(views.predictions(spark, sf), "full_score", "availability_only_score", "auprc"))


@query("paired_bootstrap_auroc", _sql_boot("auroc"), PREDS)
def paired_bootstrap_auroc(spark, sf):
    return rounded(X.paired_bootstrap(views.predictions(spark, sf), "full_score", "availability_only_score", "auroc"))


@query("paired_permutation", f"""
  WITH s AS MATERIALIZED (SELECT replicate, {_CELL}, 1<<level AS n, {sql_drawn('swap')} AS k FROM {sql_draws(11, 'seq_id', 'predictions', _CELL, 5000)}),
  r AS MATERIALIZED (SELECT replicate, label, unnest([full_score, availability_only_score]) AS a, unnest([availability_only_score, full_score]) AS b, unnest([n-k, k]) AS w FROM s),
  m AS {sql_rank_metrics('r', 'label', 'a', 'replicate', 'w')}, n AS {sql_rank_metrics('r', 'label', 'b', 'replicate', 'w')}, om AS {sql_rank_metrics('predictions', 'label', 'full_score')}, oa AS {sql_rank_metrics('predictions', 'label', 'availability_only_score')},
  d AS (SELECT m.auprc-n.auprc AS d, om.auprc-oa.auprc AS o FROM m JOIN n USING (replicate), om, oa)
  SELECT 'auprc' AS metric_name, round(max(o),6) AS observed_diff, round((count(*) FILTER (d>=o-1e-12)+1)/(count(*)+1),6) AS permutation_p_value FROM d""", PREDS)
def paired_permutation(spark, sf):
    return rounded(X.paired_permutation(views.predictions(spark, sf), "full_score", "availability_only_score", "auprc"))


@query("bootstrap_ci", f"""WITH cell AS MATERIALIZED (SELECT label, full_score, count(*) AS n, min(('0x'||substr(sha256(seq_id),1,8))::BIGINT%{R.PRIME}) AS h FROM half_up_predictions GROUP BY 1,2),
  part AS (SELECT label, full_score, h, n, unnest(range(0,{R.TOP_LEVEL}+(n>>{R.TOP_LEVEL}))) AS step FROM cell),
  drawn AS MATERIALIZED (SELECT label, full_score, replicate, level, (y*{R.STEP}+x)%{R.PRIME} AS z FROM (SELECT *, x*x%{R.PRIME} AS y FROM (SELECT label, full_score, replicate, least(step,{R.TOP_LEVEL}) AS level, ((h+step*{R.LEVEL_STEP})%{R.PRIME}*ra+rb)%{R.PRIME} AS x
    FROM part, {sql_constants(11, 1000)} WHERE step>={R.TOP_LEVEL} OR (n>>step)&1=1))),
  {sql_poisson_steps("drawn")},
  bt AS MATERIALIZED (SELECT replicate, label, full_score, w FROM drawn d ASOF JOIN steps s ON d.level=s.level AND d.z>=s.t), m AS {sql_rank_metrics('bt', 'label', 'full_score', 'replicate', 'w')}
  SELECT count(*) AS used, round(quantile_cont(auprc,0.025),6) AS ci_low, round(quantile_cont(auprc,0.975),6) AS ci_high FROM m WHERE auprc IS NOT NULL""", ("half_up_predictions",))
def bootstrap_ci(spark, sf):
    return rounded(X.bootstrap_ci(views.predictions(spark, sf), "full_score", "auprc"))


@query("bh_fdr", """WITH p AS (SELECT l_partkey, (sum(l_linenumber)*7+count(*)) % 997 / 997.0::DOUBLE AS p FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, l_partkey) AS k, count(*) OVER () AS n FROM p)
  SELECT l_partkey, round(p,6) AS p, round(least(greatest(min(p*n/k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),0),1),6) AS bh_fdr FROM r""")
def bh_fdr(spark, sf):
    p = views.table(spark, sf, "lineitem").groupBy("l_partkey").agg((F.pmod(F.sum("l_linenumber") * 7 + F.count("*"), F.lit(997)) / 997.0).alias("p"))
    return rounded(X.bh_fdr(p, "p", ["l_partkey"]))


def _sig(spark, sf):
    """Comparison rows per (split, phase, baseline): observed differences with hash-made p-values."""
    p = views.predictions(spark, sf)
    long = M.long_scores(p, {"model": "full_score", "availability_only": "availability_only_score", "additive_null": "additive_null_score", "bridge": "bridge_score"}, ["split_name", "phase", "label"])
    m = M.ranking_metrics(long, "label", "score", ["split_name", "phase", "method"])
    wide = m.groupBy("split_name", "phase").pivot("method", ["model", "availability_only", "additive_null", "bridge"]).agg(F.first("auprc"))
    rows = wide.unpivot(["split_name", "phase", "model"], ["availability_only", "additive_null", "bridge"], "comparison_method", "baseline_metric")
    diff = F.col("model") - F.col("baseline_metric")
    return rows.select("split_name", "phase", F.lit("auprc").alias("metric_name"), "comparison_method", F.col("model").alias("model_metric"), "baseline_metric", diff.alias("observed_diff"),
                       (diff - 0.02).alias("ci_low"), (diff + 0.02).alias("ci_high"), F.greatest(F.lit(0.001), 0.06 - diff).alias("permutation_p_value"))


_LONG = "(SELECT split_name, phase, label, unnest(['model','availability_only','additive_null','bridge']) AS method, unnest([full_score,availability_only_score,additive_null_score,bridge_score]) AS score FROM predictions)"
_SIG = f"""m0 AS {sql_rank_metrics(_LONG, 'label', 'score', 'split_name, phase, method')},
  sig AS (SELECT b.split_name, b.phase, 'auprc' AS metric_name, b.method AS comparison_method, a.auprc AS model_metric, b.auprc AS baseline_metric, a.auprc-b.auprc AS observed_diff, a.auprc-b.auprc-0.02 AS ci_low, a.auprc-b.auprc+0.02 AS ci_high, greatest(0.001::DOUBLE,0.06::DOUBLE-(a.auprc-b.auprc)) AS permutation_p_value
    FROM m0 a JOIN m0 b ON a.split_name=b.split_name AND a.phase=b.phase AND a.method='model' AND b.method<>'model'),
  rk AS (SELECT *, row_number() OVER (ORDER BY permutation_p_value, split_name, phase, comparison_method) AS k, count(*) OVER () AS n FROM sig),
  fdr AS (SELECT *, least(1,min(permutation_p_value*n/k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bh_fdr FROM rk)"""


@query("significance_flags", f"WITH {_SIG} SELECT split_name, phase, comparison_method, round(observed_diff,6) AS observed_diff, round(bh_fdr,6) AS bh_fdr, ci_low>0 AND permutation_p_value<0.05 AS significant_win, ci_low>0 AND bh_fdr<0.05 AS significant_win_fdr FROM fdr", PREDS)
def significance_flags(spark, sf):
    s = X.significant_win(X.bh_fdr(_sig(spark, sf), "permutation_p_value", ["split_name", "phase", "comparison_method"]))
    return rounded(s.select("split_name", "phase", "comparison_method", "observed_diff", "bh_fdr", "significant_win", "significant_win_fdr"))


@query("claim_table", f"""WITH {_SIG} SELECT split_name, phase, metric_name, comparison_method AS best_baseline, round(model_metric,6) AS model_metric, round(baseline_metric,6) AS baseline_metric, round(observed_diff,6) AS lead FROM (
  SELECT *, row_number() OVER (PARTITION BY split_name, phase, metric_name ORDER BY comparison_method IN ('bridge') DESC, baseline_metric DESC, comparison_method) AS rn FROM sig) WHERE rn=1""", PREDS)
def claim_table(spark, sf):
    return rounded(X.claim_table(_sig(spark, sf), ["bridge"]).select("split_name", "phase", "metric_name", "best_baseline", "model_metric", "baseline_metric", "lead"))


_TAB = "(SELECT element_type AS el, count(*) FILTER (full_score>0.5 AND label>0.5) AS a, count(*) FILTER (full_score>0.5 AND NOT label>0.5) AS b, count(*) FILTER (NOT full_score>0.5 AND label>0.5) AS c, count(*) FILTER (NOT full_score>0.5 AND NOT label>0.5) AS d FROM predictions GROUP BY 1)"
_LF = "lgamma({0}+1)"
SQL_HYPERGEOMETRIC = "exp(lgamma(a+b+1)-lgamma(k+1)-lgamma(a+b-k+1)+lgamma(c+d+1)-lgamma(a+c-k+1)-lgamma(c+d-a-c+k+1)-lgamma(a+b+c+d+1)+lgamma(a+c+1)+lgamma(b+d+1))"


@query("contingency", f"SELECT * FROM {_TAB}", PREDS)
def contingency(spark, sf):
    p = views.predictions(spark, sf).withColumnRenamed("element_type", "el")
    return D.contingency(p, F.col("full_score") > 0.5, F.col("label") > 0.5, ["el"])


@query("fisher_exact", f"""SELECT el, a, b, c, d, round(sum({SQL_HYPERGEOMETRIC}) FILTER (k>=a),6) AS p_value, round(CASE WHEN b*c=0 THEN -1 ELSE a*d/(b*c) END,6) AS odds_ratio FROM (SELECT *, unnest(range(greatest(0,a-d), least(a+b,a+c)+1)) AS k FROM {_TAB}) GROUP BY ALL""", PREDS)
def fisher_exact(spark, sf):
    t = X.fisher_greater(contingency(spark, sf), ["el"])
    return rounded(t.withColumn("odds_ratio", F.when(F.col("b") * F.col("c") == 0, -1.0).otherwise(F.col("odds_ratio"))))


@query("mann_whitney_u", """WITH v AS (SELECT chromosome AS g, full_score, label>0.5 AS pos FROM predictions), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY full_score) + (count(*) OVER (PARTITION BY g, full_score)-1)/2.0 AS mid FROM v)
  SELECT g AS chromosome, count(*) FILTER (pos) AS n_positive, count(*) FILTER (NOT pos) AS n_negative, round(CAST(sum(CASE WHEN pos THEN mid ELSE 0 END) - count(*) FILTER (pos)*(count(*) FILTER (pos)+1)/2.0 AS DOUBLE),6) AS u FROM r GROUP BY 1""", PREDS)
def mann_whitney_u(spark, sf):
    p = views.predictions(spark, sf).withColumn("side", F.when(F.col("label") > 0.5, "pos").otherwise("neg"))
    return rounded(X.mann_whitney(p, "side", "full_score", "pos", "neg", ["chromosome"]).drop("p_value", "p_value_method"))


def sql_normal_tail(z: str) -> str:
    """P(Z >= z) by Simpson's rule on 2000 steps from 0 to z."""
    f = "exp(-0.5*pow({z}*i/2000.0,2))".format(z=z)
    return f"(0.5 - ({z})/6000.0*list_sum(list_transform(range(0,2001), lambda i: (CASE WHEN i IN (0,2000) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*{f}))/sqrt(2*pi()))"


def sql_mann_whitney(source: str, by: str, side: str, value: str) -> str:
    """Group sizes, U and its tail where both sides have more than eight rows or there are ties."""
    part = f"PARTITION BY {by}, " if by else "PARTITION BY "
    keys = f"{by}, " if by else ""
    return f"""(SELECT *, {sql_normal_tail('zz')} AS p_value FROM (SELECT *, (u-a*b/2.0-0.5)/sqrt(a*b/12.0*((a+b+1)-ties/((a+b)*(a+b-1.0)))) AS zz FROM (
      SELECT {keys} count(*) FILTER ({side}) AS a, count(*) FILTER (NOT {side}) AS b, CAST(sum(CASE WHEN {side} THEN mid ELSE 0 END)-count(*) FILTER ({side})*(count(*) FILTER ({side})+1)/2.0 AS DOUBLE) AS u, CAST(sum(CAST(c AS DOUBLE)*c-1) AS DOUBLE) AS ties
      FROM (SELECT *, rank() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {value}) + (count(*) OVER ({part}{value})-1)/2.0 AS mid, count(*) OVER ({part}{value}) AS c FROM {source}) {f'GROUP BY {by}' if by else ''})))"""


@query("mann_whitney_p_value", f"SELECT chromosome, a AS n_positive, b AS n_negative, round(u,6) AS u, round(p_value,6) AS p_value, CASE WHEN least(a,b)=0 THEN NULL WHEN least(a,b)<=8 AND ties=0 THEN 'exact' ELSE 'normal' END AS p_value_method FROM {sql_mann_whitney('(SELECT chromosome, full_score, label>0.5 AS pos FROM predictions)', 'chromosome', 'pos', 'full_score')}", PREDS)
def mann_whitney_p_value(spark, sf):
    p = views.predictions(spark, sf).withColumn("side", F.when(F.col("label") > 0.5, "pos").otherwise("neg"))
    return rounded(X.mann_whitney(p, "side", "full_score", "pos", "neg", ["chromosome"]))


_ST = "st AS MATERIALIZED (SELECT state_label, min(chromosome) AS chromosome, min(CASE WHEN element_type IN ('pELS','dELS','CA-TF') THEN 'pELS' ELSE 'dELS' END) AS g, avg(full_score) AS v FROM predictions GROUP BY 1)"


def _states(spark, sf):
    p = views.predictions(spark, sf).withColumn("element_type", F.when(F.col("element_type").isin("pELS", "dELS", "CA-TF"), "pELS").otherwise("dELS"))
    return p.groupBy("state_label").agg(F.min("chromosome").alias("chromosome"), F.min("element_type").alias("g"), F.avg("full_score").alias("v"))


_MB = f"mb AS (SELECT replicate, sum(w*v) FILTER (g='pELS')/nullif(sum(w) FILTER (g='pELS'),0) - sum(w*v) FILTER (g='dELS')/nullif(sum(w) FILTER (g='dELS'),0) AS d FROM (SELECT *, {sql_drawn('poisson')} AS w FROM {sql_draws(11, 'state_label', 'st', 'g, v', 10000)}) GROUP BY 1)"
# cells of equal v, of at most R.LIGHT rows each: every row has a number, the smallest are taken
_MP = f"""o AS (SELECT avg(v) FILTER (g='pELS')-avg(v) FILTER (g='dELS') AS o, count(*) FILTER (g='pELS') AS p FROM st),
  it AS (SELECT v, (min(h) OVER (PARTITION BY v)+(row_number() OVER (PARTITION BY v ORDER BY h)-1)*{R.ITEM_STEP})%{R.PRIME} AS h FROM (SELECT v, ('0x'||substr(sha256(state_label),1,8))::BIGINT%{R.PRIME} AS h FROM st)),
  iz AS (SELECT *, (x*x%{R.PRIME}*{R.STEP}+x)%{R.PRIME} AS z FROM (SELECT it.*, replicate, (h*ra+rb)%{R.PRIME} AS x FROM it, {sql_constants(11, 10000)} c)),
  mr AS (SELECT replicate, v, row_number() OVER (PARTITION BY replicate ORDER BY z, h) AS k FROM iz), mp AS (SELECT replicate, avg(v) FILTER (k<=p)-avg(v) FILTER (k>p) AS d, any_value(o) AS o FROM mr, o GROUP BY 1)"""


@query("mean_difference_bootstrap", f"WITH {_ST}, {_MB} SELECT count(d) AS iterations, round(quantile_cont(d,0.025),6) AS bootstrap_ci_low, round(quantile_cont(d,0.975),6) AS bootstrap_ci_high FROM mb", PREDS)
def mean_difference_bootstrap(spark, sf):
    return rounded(X.mean_diff_bootstrap(_states(spark, sf), "g", "v", "pELS", "dELS"))


@query("mean_difference_permutation", f"WITH {_ST}, {_MP} SELECT round(max(o),6) AS observed_diff, round((count(*) FILTER (d>=o-1e-12)+1)/(count(*)+1),6) AS permutation_p_value FROM mp", PREDS)
def mean_difference_permutation(spark, sf):
    return rounded(X.mean_diff_permutation(_states(spark, sf), "g", "v", "pELS", "dELS"))


_JK = """jk AS (SELECT c.chromosome AS left_out, count(*) FILTER (g='pELS') AS positive_n, count(*) FILTER (g='dELS') AS negative_n, avg(v) FILTER (g='pELS') AS positive_mean, avg(v) FILTER (g='dELS') AS negative_mean FROM (SELECT DISTINCT chromosome FROM st) c JOIN st ON st.chromosome<>c.chromosome GROUP BY 1)"""


@query("jackknife", f"WITH {_ST}, {_JK} SELECT left_out, positive_n, negative_n, round(positive_mean,6) AS positive_mean, round(negative_mean,6) AS negative_mean, round(positive_mean-negative_mean,6) AS effect FROM jk WHERE positive_n>0 AND negative_n>0", PREDS)
def jackknife(spark, sf):
    return rounded(X.jackknife(_states(spark, sf), "chromosome", "g", "v", "pELS", "dELS"))


@query("jackknife_summary", f"WITH {_ST}, {_JK} SELECT round(min(positive_mean-negative_mean),6) AS jackknife_min_effect, round(avg(CASE WHEN positive_mean-negative_mean>0 THEN 1.0 ELSE 0.0 END),6) AS jackknife_positive_fraction FROM jk WHERE positive_n>0 AND negative_n>0", PREDS)
def jackknife_summary(spark, sf):
    return rounded(X.jackknife_summary(X.jackknife(_states(spark, sf), "chromosome", "g", "v", "pELS", "dELS")))


def sql_state_blocked(states: str) -> str:
    """The one-row report over ``st`` (state_label, chromosome, g, v), behind WITH RECURSIVE."""
    return f"""{states}, {_JK}, {_MB}, {_MP}, mw AS {sql_mann_whitney("(SELECT v, g='pELS' AS pos FROM st)", '', 'pos', 'v')}, am AS (SELECT avg(v) FILTER (g='pELS') AS pm, avg(v) FILTER (g='dELS') AS qm FROM st)
  , sub(k, last, s) AS (SELECT 0, -1, 0 UNION ALL SELECT k+1, j, s+j FROM sub, mw, (SELECT unnest(range(0,20)) AS j) WHERE j>last AND j<mw.a+mw.b AND k<least(mw.a,mw.b) AND least(mw.a,mw.b)<=8)
  SELECT round(pm,6) AS positive_mean, round(qm,6) AS negative_mean, mw.a AS positive_states, mw.b AS negative_states, round(pm-qm,6) AS effect, round(pm/qm,6) AS effect_ratio,
    (SELECT round(quantile_cont(d,0.025),6) FROM mb) AS bootstrap_ci_low, (SELECT round(quantile_cont(d,0.975),6) FROM mb) AS bootstrap_ci_high, (SELECT round((count(*) FILTER (d>=o-1e-12)+1)/(count(*)+1),6) FROM mp) AS permutation_p_value,
    round(CASE WHEN mw.ties=0 AND least(mw.a,mw.b)<=8 THEN (SELECT count(*) FILTER (s-k*(k-1)/2>=mw.u)/count(*) FROM sub WHERE k=least(mw.a,mw.b)) ELSE mw.p_value END,6) AS mann_whitney_p_value, (SELECT round(min(positive_mean-negative_mean),6) FROM jk WHERE positive_n>0 AND negative_n>0) AS jackknife_min_effect,
    (SELECT round(avg(CASE WHEN positive_mean-negative_mean>0 THEN 1.0 ELSE 0.0 END),6) FROM jk WHERE positive_n>0 AND negative_n>0) AS jackknife_positive_fraction FROM am, mw"""


@query("state_blocked_effect", f"WITH RECURSIVE {sql_state_blocked(_ST)}", PREDS)
def state_blocked_effect(spark, sf):
    p = views.predictions(spark, sf).withColumn("element_type", F.when(F.col("element_type").isin("pELS", "dELS", "CA-TF"), "pELS").otherwise("dELS"))
    return rounded(X.state_blocked_effect(p, "pELS", "dELS", "full_score"))


@query("control_report", f"""
  WITH a AS (SELECT label, full_score, geometry_residual, row_number() OVER (ORDER BY sha256('7a|'||seq_id)) AS k FROM predictions), b AS (SELECT full_score AS sh, row_number() OVER (ORDER BY sha256('7b|'||seq_id)) AS k FROM predictions),
  x AS (SELECT label, unnest(['score','residual','shuffled']) AS method, unnest([full_score, geometry_residual, sh]) AS score FROM a JOIN b USING (k))
  SELECT method, round(auprc,6) AS auprc, round(auroc,6) AS auroc FROM {sql_rank_metrics('x', 'label', 'score', 'method')}""", PREDS)
def control_report(spark, sf):
    return rounded(M.control_report(views.predictions(spark, sf), F.col("geometry_residual"), 7))


@query("selective_risk", """SELECT seq_id, k AS kept, round(k/n,6) AS coverage, round(c/k,6) AS accuracy FROM (SELECT *, row_number() OVER w AS k, sum(ok) OVER w AS c, count(*) OVER () AS n FROM (
    SELECT seq_id, round(stddev_pop(full_score),9) AS sd, CASE WHEN (round(avg(full_score),9)>=0.5)=(max(label)>0.5) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM half_up_seed_scores GROUP BY 1) WINDOW w AS (ORDER BY sd, seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", ("half_up_seed_scores",))
def selective_risk(spark, sf):
    e = D.ensemble(views.seed_scores(spark, sf), ["seq_id", "label"], "full_score", 0)
    ok = ((F.round("score_mean", 9) >= 0.5) == (F.col("label") > 0.5)).cast("double")
    return rounded(M.selective_risk(e.select("seq_id", F.round("score_std", 9).alias("score_std"), ok.alias("correct"))))


@query("metric_by_stratum", f"SELECT element_type, n, positives, round(auprc,6) AS auprc, round(auroc,6) AS auroc FROM {sql_rank_metrics('predictions', 'label', 'full_score', 'element_type')} WHERE auprc IS NOT NULL", PREDS)
def metric_by_stratum(spark, sf):
    return rounded(M.metric_by(views.predictions(spark, sf), ["element_type"], "label", "full_score"))


@query("gains", f"""WITH m0 AS {sql_rank_metrics(_LONG, 'label', 'score', 'split_name, method')} SELECT a.split_name, round(a.auprc-b.auprc,6) AS gain_vs_availability_only, round((a.auprc-b.auprc)/greatest(abs(b.auprc),1e-6),6) AS relative_gain_vs_availability_only,
  round(a.auprc-c.auprc,6) AS gain_vs_additive_null, round((a.auprc-c.auprc)/greatest(abs(c.auprc),1e-6),6) AS relative_gain_vs_additive_null FROM m0 a JOIN m0 b ON a.split_name=b.split_name AND a.method='model' AND b.method='availability_only' JOIN m0 c ON c.split_name=a.split_name AND c.method='additive_null'""", PREDS)
def gains(spark, sf):
    long = M.long_scores(views.predictions(spark, sf), {"model": "full_score", "availability_only": "availability_only_score", "additive_null": "additive_null_score"}, ["split_name", "label"])
    m = M.ranking_metrics(long, "label", "score", ["split_name", "method"])
    return rounded(M.gains(m, ["split_name"], "auprc", "model", ["availability_only", "additive_null"]))


@query("ranking_nll", """SELECT count(*) AS groups, round(avg(ln(zs)-yz/p),6) AS ranking_nll FROM (SELECT state_label, count(*) AS n, sum(label) AS p, sum(exp(z)) AS zs, sum(label*z) AS yz FROM (SELECT state_label, label, ln(p/(1-p)) AS z FROM (SELECT *, least(greatest(full_score,1e-6::DOUBLE),1-1e-6::DOUBLE) AS p FROM predictions)) GROUP BY 1) WHERE n>=2 AND p>0 AND p<n""", PREDS)
def ranking_nll(spark, sf):
    return rounded(M.ranking_nll(views.predictions(spark, sf), "state_label", "label", "full_score"))


@query("monotonicity", "SELECT round(avg(greatest(s-nx,0)),6) AS violation FROM (SELECT full_score AS s, lead(full_score) OVER (ORDER BY availability_signal, seq_id) AS nx FROM predictions) WHERE nx IS NOT NULL", PREDS)
def monotonicity(spark, sf):
    return rounded(M.monotonicity(views.predictions(spark, sf), "full_score", "availability_signal"))


@query("landscape_smoothness", "SELECT orientation, round(coalesce(avg(d*d),0),6) AS roughness FROM (SELECT orientation, s-lag(s) OVER (PARTITION BY orientation ORDER BY edge_gap) AS d FROM (SELECT orientation, edge_gap, avg(full_score) AS s FROM predictions GROUP BY 1,2)) GROUP BY 1", PREDS)
def landscape_smoothness(spark, sf):
    return rounded(M.smoothness(D.landscape(views.predictions(spark, sf)), ["orientation"], "gap", "score"))


@query("golden_metric_check", f"""WITH o AS {sql_rank_metrics('predictions', 'label', 'full_score', 'phase')}, e AS (SELECT phase, avg(full_score) AS expected FROM predictions WHERE label>0.5 GROUP BY 1)
  SELECT phase, round(o.auprc,6) AS observed, round(e.expected,6) AS expected, coalesce(abs(o.auprc-e.expected)<=0.3,false) AS passes FROM o FULL JOIN e USING (phase)""", PREDS)
def golden_metric_check(spark, sf):
    p = views.predictions(spark, sf)
    obs = M.ranking_metrics(p, "label", "full_score", ["phase"]).select("phase", "auprc")
    exp = p.filter("label > 0.5").groupBy("phase").agg(F.avg("full_score").alias("auprc"))
    return rounded(M.check_metrics(obs, exp, ["phase"], "auprc", 0.3))


@query("hardest_examples", "SELECT seq_id, label, full_score, round(abs(label-full_score),6) AS error FROM predictions ORDER BY abs(label-full_score) DESC, seq_id LIMIT 8", PREDS)
def hardest_examples(spark, sf):
    return rounded(M.hardest(views.predictions(spark, sf)).select("seq_id", "label", "full_score", "error"))


@query("strata", "SELECT seq_id, CASE WHEN n>1 THEN greatest(((r-1)*least(5,n)+n-2)//(n-1)-1,0) ELSE 0 END AS availability_stratum FROM (SELECT seq_id, row_number() OVER (ORDER BY availability_signal, seq_id) AS r, count(*) OVER () AS n FROM predictions)", PREDS)
def strata(spark, sf):
    return W.strata(views.predictions(spark, sf), "availability_signal").select("seq_id", "availability_stratum")
