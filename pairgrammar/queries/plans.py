"""Domain-plan queries (L, N, parts of I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgrammar import schema, views
from pairgrammar.functions.keys import hash_bucket, parse_curated_pairs
from pairgrammar.operators import splits as P
from pairgrammar.operators.ordered import dedupe
from pairgrammar.operators.summaries import audit_layer
from pairgrammar.plans import catalogue as C
from pairgrammar.plans import panels as A
from pairgrammar.plans import reports as R
from pairgrammar.plans import scoring as N
from pairgrammar.plans import states as S
from pairgrammar.queries.expressions import _curated
from pairgrammar.queries.metrics import BINARY_SQL, CALIBRATION_SQL, SQL_HYPERGEOMETRIC, sql_drawn, sql_draws, sql_rank_metrics, sql_state_blocked
from pairgrammar.queries.motifs import _CAND
from pairgrammar.queries.registry import query, rounded
from pairgrammar.queries.relations import PEAKS_SQL, peak_rows
from pairgrammar.queries.splits import sql_split
from pairgrammar.queries.summaries import GAP_SQL, LEAKAGE_SQL, SPACING_SQL, near_bins
from pairgrammar.session import materialize

# ---- L1
_HOCO = "(SELECT * FROM (SELECT 'G'||l_partkey AS g, 'H'||l_orderkey AS m, l_returnflag AS q, l_linenumber AS len, CASE WHEN l_linestatus='F' THEN '' ELSE 'fam'||(l_suppkey%7) END AS fam FROM lineitem WHERE l_returnflag<>'R') QUALIFY row_number() OVER (PARTITION BY g ORDER BY q, len DESC, m, fam)=1)"
_JASP = "(SELECT * FROM (SELECT 'G'||l_partkey AS g, 'J'||l_orderkey AS m, l_linenumber AS len FROM lineitem WHERE l_returnflag='R') QUALIFY row_number() OVER (PARTITION BY g ORDER BY len DESC, m)=1)"


@query("tf_master_catalogue", f"""SELECT printf('TF_%05d', row_number() OVER (ORDER BY gene_symbol)) AS tf_id, * FROM (SELECT 'G'||p_partkey AS gene_symbol, coalesce(nullif(h.fam,''),nullif(p_brand,''),'') AS family,
  coalesce(nullif(p_type,''),'') AS subfamily, coalesce(nullif(p_brand,''),'G'||p_partkey) AS paralog_group, coalesce(h.m,j.m,'') AS motif_id, CASE WHEN h.m IS NOT NULL THEN 'H11' WHEN j.m IS NOT NULL THEN 'J26' ELSE '' END AS motif_source
  FROM part LEFT JOIN {_HOCO} h ON h.g='G'||p_partkey LEFT JOIN {_JASP} j ON j.g='G'||p_partkey WHERE p_size%9<>0)""")
def tf_master_catalogue(spark, sf):
    part, li = views.table(spark, sf, "part"), views.table(spark, sf, "lineitem")
    gene = F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene_symbol")
    human = part.select(F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene_symbol"), F.lit("").alias("ensembl_id"), F.when(F.col("p_size") % 9 == 0, "No").otherwise("Yes").alias("is_tf"),
                        F.col("p_brand").alias("dbd_family"), F.col("p_type").alias("binding_mode"))
    fam = F.when(F.col("l_linestatus") == "F", "").otherwise(F.concat(F.lit("fam"), (F.col("l_suppkey") % 7).cast("string")))
    h = li.filter("l_returnflag <> 'R'").select(gene, F.concat(F.lit("H"), F.col("l_orderkey").cast("string")).alias("motif_id"), F.lit("H11").alias("motif_source"), F.col("l_returnflag").alias("quality"),
                                               F.col("l_linenumber").alias("model_length"), fam.alias("tf_family"), F.lit("").alias("tf_subfamily"), F.lit("").alias("uniprot_id"))
    j = li.filter("l_returnflag = 'R'").select(gene, F.concat(F.lit("J"), F.col("l_orderkey").cast("string")).alias("motif_id"), F.lit("J26").alias("motif_source"), F.col("l_linenumber").alias("model_length"))
    return C.build_tf_master(human, h, j).select("tf_id", "gene_symbol", "family", "subfamily", "paralog_group", "motif_id", "motif_source")


# ---- L2
def _assay(spark, sf):
    curated = parse_curated_pairs(_curated(spark, sf).drop("id")).distinct()
    names = curated.select(F.explode(F.array("left_seq_file", "right_seq_file", F.concat("tf2_seq_prefix", F.lit("0u_sig.seq")))).alias("file_name")).filter("file_name <> '' AND file_name <> '0u_sig.seq'").distinct()
    w = views.windows(spark, sf).select("sequence", "doc_id", "tile")
    names = names.withColumn("d", hash_bucket("file_name", 200))
    lines = names.join(w.withColumn("d", F.col("doc_id") % 200), "d").select(F.col("file_name").alias("sequence_file"), F.concat_ws("_", "doc_id", "tile").alias("seq_index"), "sequence")
    return curated, names.select("file_name"), lines


@query("assay_inventory", """WITH c AS (SELECT DISTINCT CASE WHEN p_size%3=0 THEN p_brand ELSE p_brand||'_'||p_type END AS pair_name, p_size%3<>0 AS is_pair, CASE WHEN p_size%4=0 THEN '' ELSE 'pre'||p_size END AS p1, CASE WHEN p_size%6=0 THEN '' ELSE 'q'||p_size END AS p2 FROM part),
  f AS (SELECT p1||'P13u_sig.seq' AS f FROM c UNION SELECT p2||'P24u_sig.seq' FROM c WHERE p2<>'' UNION SELECT p2||'0u_sig.seq' FROM c WHERE p2<>''),
  x AS (SELECT *, CASE WHEN p1<>'' THEN p1||'0u_sig.seq' IN (SELECT f FROM f) ELSE false END AS lb, p2<>'' AS rb, 1+(p2<>'')::INT AS np FROM c)
  SELECT pair_name, is_pair, np::BIGINT AS num_pair_files, NOT is_pair AND (lb OR rb) AS monomer_usable, is_pair AND (lb OR rb) AS pair_usable,
    CASE WHEN is_pair AND lb AND rb THEN 'paired_plus_both_baselines' WHEN is_pair AND lb THEN 'paired_plus_left_baseline' WHEN is_pair AND rb THEN 'paired_plus_right_baseline' WHEN NOT is_pair AND (lb OR rb) THEN 'monomer_treated_plus_baseline' ELSE '' END AS support_type FROM x""")
def assay_inventory(spark, sf):
    curated, files, _ = _assay(spark, sf)
    return rounded(C.curated_inventory(curated, files).select("pair_name", "is_pair", "num_pair_files", "monomer_usable", "pair_usable", "support_type"))


@query("assay_sequences", f"""WITH c AS (SELECT DISTINCT p_brand AS l, CASE WHEN p_size%3=0 THEN p_brand ELSE p_type END AS r, p_size%3<>0 AS is_pair, CASE WHEN p_size%4=0 THEN '' ELSE 'pre'||p_size END||'P13u_sig.seq' AS treated, 'q'||p_size AS p2 FROM part WHERE p_size%6<>0),
  u AS (SELECT 'phase1' AS phase, l||'::'||l AS tf_pair_label, 1.0::DOUBLE AS label, treated AS f FROM c WHERE NOT is_pair UNION ALL SELECT 'phase1', l||'::'||l, 0.0::DOUBLE, p2||'0u_sig.seq' FROM c WHERE NOT is_pair
    UNION ALL SELECT 'phase2', l||'::'||r, 1.0::DOUBLE, unnest([treated, p2||'P24u_sig.seq']) FROM c WHERE is_pair UNION ALL SELECT 'phase2', l||'::'||r, 0.0::DOUBLE, p2||'0u_sig.seq' FROM c WHERE is_pair),
  w AS (SELECT doc_id%200 AS d, count(*) AS n FROM windows GROUP BY 1)
  SELECT phase, label, tf_pair_label, CAST(sum(n) AS BIGINT) AS n FROM u JOIN w ON w.d={views._b("f", 200)} GROUP BY 1,2,3""", ("windows",))
def assay_sequences(spark, sf):
    out = C.harmonize_assay(*_assay(spark, sf))
    return out["sequences"].groupBy("phase", "label", "tf_pair_label").agg(F.count("*").alias("n"))


@query("assay_acceptance", """WITH c AS (SELECT DISTINCT CASE WHEN p_size%3=0 THEN p_brand ELSE p_brand||'_'||p_type END AS pair_name, p_brand AS l, CASE WHEN p_size%3=0 THEN p_brand ELSE p_type END AS r, p_size%3<>0 AS is_pair, p_size%6<>0 AS rb, CASE WHEN p_size%4=0 THEN '' ELSE 'pre'||p_size END AS p1, p_size%6=0 AS z, CASE WHEN p_size%6=0 THEN '' ELSE 'q'||p_size END AS p2 FROM part)
  SELECT count(*) AS inventory_rows, count(*) FILTER (is_pair AND rb) AS usable_pair_rows, count(*) FILTER (NOT is_pair AND rb) AS usable_monomer_rows, count(DISTINCT CASE WHEN is_pair AND rb THEN l||'|'||r END) AS reference_edges,
   count(*) FILTER (is_pair AND rb)>=1 AS ready FROM c""")
def assay_acceptance(spark, sf):
    acc = C.harmonize_assay(*_assay(spark, sf))["acceptance"]
    return acc.withColumn("ready", C.readiness(acc).filter("gate = 'assay'").select("ready").scalar())


# ---- L3
_RUNS = "(SELECT 'R'||p_partkey AS run_accession, p_brand AS l, p_type AS r, p_size AS b FROM part WHERE p_size%10<>0)"


@query("pair_targets", f"""WITH e AS (SELECT DISTINCT p_type AS left_tf, p_brand AS right_tf FROM part), b AS (SELECT *, count(*) OVER (PARTITION BY l, r) AS n, row_number() OVER (PARTITION BY l, r ORDER BY b DESC, run_accession) AS k FROM {_RUNS})
  SELECT left_tf, right_tf, coalesce(n,0) AS ena_run_count, run_accession FROM e LEFT JOIN (SELECT * FROM b WHERE k=1) b ON b.l=e.right_tf AND b.r=e.left_tf""")
def pair_targets(spark, sf):
    part = views.table(spark, sf, "part")
    rnd = F.when(F.col("p_size") % 10 == 0, "x").otherwise("3")
    stem = F.concat_ws("_", "p_brand", "p_type", rnd, F.lit("PL1"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")))
    reports = part.select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("run_accession"), F.concat(F.lit("ftp/x/"), stem, F.lit(".fastq.gz")).alias("submitted_ftp"), F.lit("").alias("fastq_ftp"),
                          F.lit("").alias("experiment_title"), F.col("p_size").cast("long").alias("submitted_bytes"), F.lit(0).cast("long").alias("fastq_bytes"))
    edges = part.select(F.col("p_type").alias("left_tf"), F.col("p_brand").alias("right_tf")).distinct()
    return C.build_inventories(reports, edges)["targets"].select("left_tf", "right_tf", "ena_run_count", "run_accession")


# ---- L4
def _usage(spark, sf):
    c = views.competition(spark, sf)
    return c.select(F.concat_ws("-", "actual_state", "competition_group").alias("state_label"), F.col("crs").cast("string").alias("seq_id"), F.lit("phase4").alias("phase"),
                    F.when(F.col("crs") % 5 == 0, "imputed_pair").otherwise("observed_pair").alias("construction_mode"), F.col("evidence").alias("pair_reference_supported"), F.lit(0.5).alias("label"))


@query("usage_labels", """WITH c AS (SELECT actual_state||'-'||competition_group AS s, crs, evidence AS e FROM competition), o AS (SELECT * FROM c WHERE crs%5<>0), q AS (SELECT s, max(e) AS top FROM o GROUP BY 1 HAVING count(*)>=2 AND count(*) FILTER (e>0)=1)
  SELECT CAST(crs AS VARCHAR) AS seq_id, CASE WHEN crs%5=0 THEN 0.0::DOUBLE WHEN e=top THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM c JOIN q USING (s)""", ("competition",))
def usage_labels(spark, sf):
    return S.assign_usage_labels(_usage(spark, sf)).select("seq_id", "label")


# ---- L5, L6, L12, I11, I13
def layer_regions(seqs):
    """A region in every 300 bases of a document, bases 50 to 200 of them; in the shorter rest what there is of these, or all of a rest of at most 50."""
    chrom = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    steps = seqs.filter(F.length("bases") > 0).select(chrom.alias("chromosome"), F.length("bases").alias("size"), F.explode(F.sequence(F.lit(0), F.floor((F.length("bases") - 1) / 300).cast("int"))).alias("i"))
    rest = F.col("size") - F.col("i") * 300
    return steps.select(
        "chromosome", (F.col("i") * 300 + F.when(rest > 50, 50).otherwise(0)).cast("long").alias("region_start"), (F.col("i") * 300 + F.least(F.lit(200), rest)).cast("long").alias("region_end"),
        F.concat_ws("_", F.lit("S"), "chromosome", F.col("i").cast("string")).alias("screen_id"), F.concat_ws("_", F.lit("E"), "chromosome", F.col("i").cast("string")).alias("encode_id"),
        F.element_at(F.array(*[F.lit(e) for e in views.ELEMENTS]), (F.col("i") % 7 + 1).cast("int")).alias("element_type"))


def _layer(spark, sf, motifs=True):
    """Regions on document 'chromosomes', over all their bases; fragments from the line items on all of them, over their whole length; lengths.

    ``motifs``: whether the motif counts, made from all texts, are wanted.
    """
    seqs = materialize(views.sequences(spark, sf).filter(F.length("bases") > 0).select("doc_id", "bases"))  # texts are read once
    chrom = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    sizes = seqs.select(chrom.alias("chromosome"), F.length("bases").cast("long").alias("size"))
    docs = views.table(spark, sf, "documents").agg(F.count("*")).scalar()
    li = views.table(spark, sf, "lineitem").select(
        F.concat(F.lit("d"), (F.col("l_orderkey") % docs).cast("string")).alias("chromosome"), (F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104729).alias("x"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_linenumber") % 4).cast("long").alias("file_id"))
    fragments = li.join(sizes, "chromosome").select("chromosome", (F.col("x") % F.col("size")).alias("start"), (F.col("x") % F.col("size") + F.col("q")).alias("end"), "file_id")
    chunks = seqs.select(chrom.alias("chromosome"), "bases", F.explode(F.sequence(F.lit(0), F.floor((F.length("bases") - 1) / 500).cast("int"))).alias("c")).select(
        "chromosome", F.col("c").cast("long").alias("chunk_id"), (F.col("c") * 500).cast("long").alias("start"), F.substring("bases", F.col("c") * 500 + 1, F.lit(500)).alias("bases"))
    return layer_regions(seqs), fragments, chunks, views.motif_positions(spark, sf) if motifs else None, views.edges(spark, sf), sizes.withColumnRenamed("size", "chromosome_length")


def state_layer(spark, sf):
    *parts, lengths = _layer(spark, sf)
    return S.build_state_layer(*parts, chunk_size=500, max_regions=None, max_states=400, multiplier=2, lengths=lengths)


_RANKED = """lr AS (SELECT 'd'||doc_id AS c, bases, i*300+CASE WHEN n-i*300>50 THEN 50 ELSE 0 END AS rs, i*300+least(200,n-i*300) AS re FROM (SELECT doc_id, bases, length(bases) AS n, unnest(range(0,(length(bases)-1)//300+1)) AS i FROM sequences WHERE length(bases)>0)),
  lf AS (SELECT c, x%n AS s, x%n+q AS e, file FROM (SELECT 'd'||(l_orderkey%(SELECT count(*) FROM documents)) AS c, l_partkey*7919+l_linenumber*104729 AS x, CAST(l_quantity AS BIGINT) AS q, l_linenumber%4 AS file FROM lineitem) JOIN (SELECT 'd'||doc_id AS c, length(bases) AS n FROM sequences WHERE length(bases)>0) USING (c)),
  lp AS (SELECT lr.c, rs, re, file, count(*) AS k FROM lr JOIN lf ON lr.c=lf.c AND rs<e AND re>s AND e>s GROUP BY ALL),
  rk AS (SELECT c||':'||rs||'-'||re AS state_label, c, rs, re, sum(k)::BIGINT AS total, count(*) AS files FROM lp GROUP BY ALL ORDER BY total DESC, files DESC, c, rs LIMIT 800)"""


@query("ranked_states", f"WITH {_RANKED} SELECT state_label, total AS total_fragment_count, files AS supporting_files FROM rk", ("sequences",))
def ranked_states(spark, sf):
    regions, fragments, *_ = _layer(spark, sf, motifs=False)
    return S.rank_states(regions, fragments, None, 800).select("state_label", "total_fragment_count", "supporting_files")


# hydrated states, their hits, the 400 states with most candidates, and what is made of them: a widest hit each, two pairs each, winners
_LAYER = f"""{_RANKED}, lw AS (SELECT state_label AS seq_id, rpad(substr(bases,CAST(w+1 AS INT),96),96,'N') AS sequence, rk.* FROM (SELECT *, greatest((rs+re)//2-48,0) AS w FROM rk) rk JOIN lr USING (c,rs,re)),
  lh AS ({views.SQL["hits"][1].replace("FROM windows w", "FROM lw w")}), hits2 AS (SELECT * FROM lh WHERE hit_rank<2 AND tf_id IN (SELECT left_tf FROM edges UNION SELECT right_tf FROM edges)),
  g AS (SELECT seq_id, tf_id, count(*) AS k FROM hits2 GROUP BY 1,2), sup AS (SELECT DISTINCT least(left_tf,right_tf) AS a, greatest(left_tf,right_tf) AS b FROM edges),
  hc AS (SELECT x.seq_id, x.n AS mono, coalesce(p.n,0) AS pairs FROM (SELECT seq_id, count(*) AS n FROM g GROUP BY 1) x LEFT JOIN (SELECT l.seq_id, sum(CASE WHEN s.a IS NULL THEN least(l.k*r.k,1) ELSE l.k*r.k END) AS n FROM g l JOIN g r ON l.seq_id=r.seq_id AND l.tf_id<r.tf_id LEFT JOIN sup s ON s.a=l.tf_id AND s.b=r.tf_id GROUP BY 1) p USING (seq_id)),
  st AS (SELECT lw.*, mono IS NOT NULL AS found, total>=quantile_cont(total,0.5) OVER () AS high FROM (SELECT * FROM lw LEFT JOIN hc USING (seq_id) ORDER BY coalesce(pairs,0) DESC, coalesce(mono,0) DESC, total DESC, files DESC, c, rs LIMIT 400) lw),
  {_CAND.replace("FROM hits WHERE hit_rank<2", "FROM hits2 JOIN (SELECT seq_id FROM st) USING (seq_id)")},
  pr AS (SELECT seq_id, sup, count(*) OVER w AS n, count(*) FILTER (sup) OVER w AS ns FROM sel WHERE pair_rank<2 AND pair_mode<>'homotypic_fallback' WINDOW w AS (PARTITION BY seq_id)),
  ly AS (SELECT 'phase3' AS phase, CASE WHEN found THEN 'observed_monomer' ELSE 'imputed_monomer' END AS construction_mode, seq_id AS state_label, high AS pos FROM st UNION ALL SELECT 'phase4', 'observed_pair', seq_id, sup FROM pr WHERE n=2 AND ns=1)"""


@query("state_layer_audit", f"""WITH {_LAYER}, s AS (SELECT state_label, count(*) AS n FROM ly GROUP BY 1) SELECT (SELECT count(*) FROM ly) AS num_sequences, (SELECT count(*) FROM ly) AS unique_seq_ids, 0::BIGINT AS duplicate_seq_ids, 96::BIGINT AS sequence_length_min, 96::BIGINT AS sequence_length_max,
  0::BIGINT AS anchors_out_of_bounds, 0.0::DOUBLE AS overlap_max_abs_diff, 0.0::DOUBLE AS gap_max_abs_diff, 0.0::DOUBLE AS center_distance_max_abs_diff, (SELECT count(*) FROM st) AS num_states, 0::BIGINT AS missing_state_labels, count(*) AS represented_states, min(n) AS rows_per_state_min, max(n) AS rows_per_state_max FROM s""", ("sequences", "pwm", "motif_stats", "edges"))
def state_layer_audit(spark, sf):
    return rounded(state_layer(spark, sf)["audit"])


@query("state_layer_candidates", f"WITH {_LAYER} SELECT phase, construction_mode, count(*) AS n, count(*) FILTER (pos) AS positives FROM ly GROUP BY 1,2", ("sequences", "pwm", "motif_stats", "edges"))
def state_layer_candidates(spark, sf):
    return state_layer(spark, sf)["candidates"].groupBy("phase", "construction_mode").agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0.5).alias("positives"))


@query("candidate_layer_audit", """SELECT count(*) AS num_sequences, count(*) AS unique_seq_ids, 0::BIGINT AS duplicate_seq_ids, 96::BIGINT AS sequence_length_min, 96::BIGINT AS sequence_length_max, count(*) FILTER (right_end>96 OR left_end>96) AS anchors_out_of_bounds, 0.0::DOUBLE AS overlap_max_abs_diff, 0.0::DOUBLE AS gap_max_abs_diff,
  0.0::DOUBLE AS center_distance_max_abs_diff, (SELECT count(DISTINCT state_label) FROM states) AS num_states, count(*) FILTER (state_label NOT IN (SELECT state_label FROM states)) AS missing_state_labels, count(DISTINCT state_label) AS represented_states,
  (SELECT min(n) FROM (SELECT count(*) AS n FROM anchored GROUP BY state_label)) AS rows_per_state_min, (SELECT max(n) FROM (SELECT count(*) AS n FROM anchored GROUP BY state_label)) AS rows_per_state_max FROM anchored""", ("anchored", "states"))
def candidate_layer_audit(spark, sf):
    a = views.anchored(spark, sf).withColumnsRenamed({f"{s}_{e}": f"{s}_anchor_{e}" for s in ("left", "right") for e in ("start", "end")})
    return rounded(audit_layer(a, views.states(spark, sf)))


@query("state_data", """WITH w AS (SELECT * FROM windows JOIN (SELECT DISTINCT state_label FROM states) USING (state_label) WHERE construction_mode LIKE 'observed%'),
  q AS (SELECT doc_id FROM w WHERE phase='phase4' AND construction_mode='observed_pair' GROUP BY 1 HAVING count(*)>=2 AND count(*) FILTER (label>0.5) BETWEEN 1 AND count(*)-1)
  SELECT phase, count(*) AS "rows" FROM w WHERE phase<>'phase4' OR doc_id IN (SELECT doc_id FROM q) GROUP BY 1""", ("windows", "states"))
def state_data(spark, sf):
    w = views.windows(spark, sf).withColumn("evidence_supported", F.col("label"))
    # a document is the competing state here; the vector state is looked up by source
    vec = views.states(spark, sf).select("state_label").distinct()
    kept = w.join(vec, "state_label", "left_semi").withColumn("state_label", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return S.prepare_state_data(kept, kept.select("state_label").distinct())["phase_counts"]


@query("functional_candidates", f"""WITH {_CAND}, pk AS (SELECT seq_id, pair_mode FROM sel WHERE pair_rank=0), st AS (SELECT seq_id, pair_mode IS NOT NULL AS has_candidate, coalesce(pair_mode,'') AS pair_mode FROM windows LEFT JOIN pk USING (seq_id))
  SELECT has_candidate, st.pair_mode, count(*) AS n, coalesce(any_value(r."rows"),0) AS "rows" FROM st LEFT JOIN (SELECT pair_mode, count(*) AS "rows" FROM pk GROUP BY 1) r USING (pair_mode) GROUP BY 1,2""", ("windows", "hits", "edges"))
def functional_candidates(spark, sf):
    rows, status = S.functional_candidates(views.windows(spark, sf).select("seq_id", "sequence", "label", "chromosome"), views.motif_positions(spark, sf), views.edges(spark, sf))
    n = rows.groupBy("pair_mode").agg(F.count("*").alias("rows"))
    return status.groupBy("has_candidate", "pair_mode").agg(F.count("*").alias("n")).join(n, "pair_mode", "left").fillna(0, ["rows"])


@query("expanded_candidates", f"""WITH {_CAND.replace('hit_rank<2', 'hit_rank<3')}, ex AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (sup) OVER w AS ns FROM sel WHERE pair_rank<3 AND pair_mode<>'homotypic_fallback' WINDOW w AS (PARTITION BY seq_id))
  SELECT left_tf||'::'||right_tf AS tf_pair_label, count(*) AS n, CAST(count(*) FILTER (sup) AS DOUBLE) AS positives FROM ex WHERE n>=2 AND ns=1 GROUP BY 1""", ("hits", "edges"))
def expanded_candidates(spark, sf):
    w = views.windows(spark, sf).select("seq_id", "sequence", F.col("seq_id").alias("state_label"), "phase", "chromosome", F.lit(1.0).alias("state_total_fragment_count"), F.lit(1.0).alias("state_supporting_files"))
    return S.expanded_candidates(w, views.motif_positions(spark, sf), views.edges(spark, sf), 3).groupBy("tf_pair_label").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@query("panel_candidates", "SELECT w.seq_id, round(s.availability[1],6) AS a0 FROM windows w JOIN (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY state_label ORDER BY vec_id)=1) s USING (state_label) WHERE phase='phase4' AND construction_mode='observed_pair'", ("windows", "states"))
def panel_candidates(spark, sf):
    feats = dedupe(views.states(spark, sf), ["state_label"], ["vec_id"]).select("state_label", "availability")
    return rounded(S.panel_candidates(views.windows(spark, sf), feats).select("seq_id", F.get("availability", F.lit(0)).alias("a0")))


# ---- L7
_PANEL = """m AS (SELECT element_group, count(*) AS tsv_rows, count(DISTINCT replicate) AS reps, min(n_obs_bc) AS bc, avg(log2) AS mean_log2_activity, stddev_samp(log2) AS sd, abs(avg(log2) FILTER (NOT is_reverse)-avg(log2) FILTER (is_reverse)) AS gap FROM replicates GROUP BY 1),
  q AS (SELECT *, NOT starts_with(element_group,'ENSG') AND reps>=3 AND bc>=1 AND coalesce(sd,0)<=1.5 AND coalesce(gap,0)<=1 AS ok, row_number() OVER (ORDER BY mean_log2_activity DESC, element_group) AS rank_desc FROM m),
  c AS (SELECT quantile_cont(mean_log2_activity,0.1) AS lo, quantile_cont(mean_log2_activity,0.9) AS hi FROM q WHERE ok),
  pn AS (SELECT element_group, ok AS passes_quality, rank_desc, mean_log2_activity, tsv_rows, reps, bc, sd, gap, lo, hi, CASE WHEN ok AND mean_log2_activity<=lo THEN 0.0::DOUBLE WHEN ok AND mean_log2_activity>=hi THEN 1.0::DOUBLE END AS label FROM q, c)"""


def _panel(spark, sf):
    r = views.replicates(spark, sf)
    return A.mpra_panel(r, r, "K562", min_obs_bc=1, max_std=1.5)


@query("mpra_panel", f"""WITH {_PANEL} SELECT 'external_mpra::k562::'||element_group AS seq_id, element_group, element_group AS split_group, 'K562' AS biosample_label, 'K562' AS state_label, passes_quality, label, tsv_rows, reps AS replicate_count, bc::BIGINT AS min_obs_bc,
  round(mean_log2_activity,6) AS mean_log2_activity, round(sd,6) AS std_log2_activity, round(gap,6) AS orientation_gap_log2, round(lo,6) AS quantile_low, round(hi,6) AS quantile_high FROM pn""", ("replicates",))
def mpra_panel(spark, sf):
    return rounded(_panel(spark, sf).select(
        "seq_id", "element_group", "split_group", "biosample_label", "state_label", "passes_quality", "label", "tsv_rows", "replicate_count", F.col("min_obs_bc").cast("long").alias("min_obs_bc"),
        "mean_log2_activity", "std_log2_activity", "orientation_gap_log2", "quantile_low", "quantile_high"))


@query("mpra_splits", f"WITH {_PANEL} SELECT 'external_mpra::k562::'||element_group AS seq_id, s AS split_name, CASE s WHEN 'default' THEN {sql_split('element_group')} ELSE 'test' END AS split FROM pn, (SELECT unnest(['default','cross_biosample_test_k562']) AS s) WHERE label IS NOT NULL", ("replicates",))
def mpra_splits(spark, sf):
    return A.panel_splits(_panel(spark, sf), ["K562"]).select("seq_id", "split_name", "split")


# ---- L8
def _comp(spark, sf):
    c = views.competition(spark, sf)
    name = lambda k: F.element_at(F.array(F.lit("ga"), F.lit("gb"), F.lit("trp53")), (k % 3 + 1).cast("int"))
    raw = c.select("library_name", F.concat("actual_state", "competition_group").alias("actual_state"), "crs", "activity_score", name(F.col("crs")).alias("tf1_name"), name(F.col("crs") % 6 / 2).alias("tf2_name"),
                   F.concat(F.lit("acgtACGTnnXX"), F.repeat(F.lit("ACGT"), (F.col("crs") % 40).cast("int"))).alias("seq"))
    lookup = spark.createDataFrame([("GA",), ("GB",), ("TP53",)], "gene_symbol string")
    return A.competition_frame(raw, lookup)


_CNAME = "(['GA','GB','TP53'])[CAST({0} AS INT)+1]"
_US = "actual_state||competition_group"
_UK = "least(l,r)||'::'||greatest(l,r)"
_CF = f"cf AS (SELECT *, library_name||'::'||actual_state||competition_group||'::'||least(l,r)||'::'||greatest(l,r) AS cg FROM (SELECT *, {_CNAME.format('crs%3')} AS l, {_CNAME.format('floor((crs%6/2)%3)')} AS r FROM competition))"


@query("competition_panel", f"""WITH {_CF}, s AS (SELECT *, count(*) OVER w AS n, max(activity_score) OVER w AS hi, min(activity_score) OVER w AS lo, row_number() OVER (PARTITION BY cg ORDER BY activity_score DESC, crs) AS d, row_number() OVER (PARTITION BY cg ORDER BY activity_score, crs DESC) AS a FROM cf WINDOW w AS (PARTITION BY cg))
  SELECT crs, p AS phase, CASE WHEN d<=k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM (SELECT *, CASE WHEN p='phase5' AND n>=4 THEN 2 ELSE 1 END AS k FROM s, (SELECT unnest(['phase4','phase5']) AS p)) WHERE n>=2 AND hi>lo AND (d<=k OR a<=k)""", ("competition",))
def competition_panel(spark, sf):
    return A.competition_panel(_comp(spark, sf)).select("crs", "phase", "label")


@query("competition_ranks", f"WITH {_CF} SELECT crs, count(*) OVER (PARTITION BY cg) AS group_size, row_number() OVER (PARTITION BY cg ORDER BY activity_score DESC, crs) AS activity_rank_desc, row_number() OVER (PARTITION BY cg ORDER BY activity_score, crs) AS activity_rank_asc FROM cf", ("competition",))
def competition_ranks(spark, sf):
    slim = _comp(spark, sf).select("competition_group", "activity_score", "crs")  # the ranks store their rows as they come
    return A.competition_ranks(slim).select("crs", "group_size", "activity_rank_desc", "activity_rank_asc")


@query("competition_group_summary", f"WITH {_CF} SELECT library_name, actual_state||competition_group AS actual_state, least(l,r)||'::'||greatest(l,r) AS pair_transfer_group, count(*) AS group_size, round(max(activity_score)-min(activity_score),6) AS activity_margin FROM cf GROUP BY 1,2,3", ("competition",))
def competition_group_summary(spark, sf):
    return rounded(A.group_summary(_comp(spark, sf)).select("library_name", "actual_state", "pair_transfer_group", "group_size", "activity_margin"))


@query("competition_manifests", f"WITH {_CF} SELECT 'unseen_pair' AS split_name, least(l,r)||'::'||greatest(l,r) AS group_value, {sql_split(_UK)} AS split, count(*) AS n FROM cf GROUP BY ALL UNION ALL SELECT 'unseen_state', {_US}, {sql_split(_US)}, count(*) FROM cf GROUP BY ALL", ("competition",))
def competition_manifests(spark, sf):
    m = A.competition_manifests(_comp(spark, sf).withColumn("seq_id", F.col("crs").cast("string")))
    return m.groupBy("split_name", "group_value", "split").agg(F.count("*").alias("n"))


# ---- L9
def _endo(spark, sf):
    li = views.table(spark, sf, "lineitem")
    bio = F.element_at(F.array(F.lit("K562"), F.lit("HepG2"), F.lit("other")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # made distinct as numbers: shorter than the texts of a row
    reg = li.select(*parts).distinct().select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in parts]).alias("registry_id"), bio.alias("canonical_biosample"), F.concat(F.lit("t"), (F.col("l_suppkey") % 50).cast("string")).alias("target_gene"),
        F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("enhancer_id"), F.concat(F.lit("g_x_"), (F.col("l_partkey") % 9 - 4).cast("string"), F.lit("_0.01")).alias("perturbation_descriptor"))
    sid = F.concat(F.lit("endogenous_confirmatory::"), "registry_id")
    enh = F.substring("enhancer_id", 2, 20).cast("long")
    status = reg.select(sid.alias("seq_id"), (enh % 4 != 0).alias("has_candidate"), F.when(enh % 4 != 0, "heterotypic_reference").otherwise("").alias("pair_mode"))
    scores = reg.filter(enh % 8 > 1).select(sid.alias("seq_id"), F.explode(F.array(F.lit(11), F.lit(17))).alias("seed"), (enh % 100 / 100.0).alias("full_score"))
    return R.endogenous_evaluation(reg, status, scores, spark.createDataFrame([("K562",), ("HepG2",)], "state_label string"))


_EN = """rg AS (SELECT DISTINCT l_orderkey||'|'||l_linenumber||'|'||l_partkey||'|'||l_suppkey AS registry_id, (['K562','HepG2','other'])[CAST(l_linenumber%3 AS INT)+1] AS b, 't'||(l_suppkey%50) AS t, l_partkey AS e, l_partkey%9-4 AS eff FROM lineitem),
  rw AS (SELECT *, e%8>1 AS sc, e%4<>0 AS cand, CASE WHEN eff<0 THEN 'activating' ELSE 'repressive' END AS od, CASE WHEN (e%100)/100.0>=0.5 THEN 'activating' ELSE 'repressive' END AS pd FROM rg WHERE eff<>0)"""


@query("direction_consistency", f"WITH {_EN} SELECT registry_id, od AS observed_direction, CASE WHEN sc THEN pd ELSE '' END AS predicted_direction, CASE WHEN sc THEN CASE WHEN pd=od THEN 'yes' ELSE 'no' END ELSE '' END AS direction_consistent, CASE WHEN b='other' THEN 'unsupported_state_label' WHEN NOT cand THEN 'no_candidate_pair' WHEN NOT sc THEN 'missing_prediction' ELSE 'scored' END AS coverage_note FROM rw")
def direction_consistency(spark, sf):
    return _endo(spark, sf)["rows"].select("registry_id", "observed_direction", "predicted_direction", F.when(F.col("direction_consistent"), "yes").when(F.col("scored"), "no").otherwise("").alias("direction_consistent"), "coverage_note")


@query("target_consistency", f"WITH {_EN} SELECT b AS canonical_biosample, t AS target_gene, count(*) AS n_rows, count(DISTINCT e) AS n_unique_enhancers, round(avg(eff),6) AS mean_effect_size, round(avg((e%100)/100.0::DOUBLE),6) AS mean_full_score, round(avg(CASE WHEN pd=od THEN 1.0 ELSE 0.0 END),6) AS row_direction_consistency_rate FROM rw WHERE sc GROUP BY 1,2")
def target_consistency(spark, sf):
    return rounded(_endo(spark, sf)["targets"].select("canonical_biosample", "target_gene", "n_rows", "n_unique_enhancers", "mean_effect_size", "mean_full_score", "row_direction_consistency_rate"))


@query("biosample_consistency", f"""WITH {_EN}, a AS (SELECT coalesce(b,'ALL') AS k, count(*) AS registry_rows, count(DISTINCT t) AS unique_targets, count(*) FILTER (eff<>0) AS direction_evaluable_rows FROM rg GROUP BY ROLLUP(b)),
  c AS (SELECT coalesce(b,'ALL') AS k, count(*) FILTER (cand) AS candidate_rows, count(*) FILTER (sc) AS scored_rows, round(avg(CASE WHEN sc THEN (pd=od)::INT::DOUBLE END),6) AS direction_consistency_rate FROM rw GROUP BY ROLLUP(b)) SELECT k AS canonical_biosample, * EXCLUDE (k) FROM a LEFT JOIN c USING (k)""")
def biosample_consistency(spark, sf):
    return rounded(_endo(spark, sf)["biosamples"].select("canonical_biosample", "registry_rows", "unique_targets", "direction_evaluable_rows", "candidate_rows", "scored_rows", "direction_consistency_rate"))


# ---- L10, L11, L20
def _scored(spark, sf):
    """Predictions whose state is a region label, so coordinates can be parsed."""
    r, peaks = peak_rows(spark, sf)
    lab = F.when(F.length("seq_id") % 2 == 0, 1.0).otherwise(0.0)
    score = views.u01(F.concat(F.lit("v"), "seq_id")) * 0.8 + lab * 0.2
    scored = r.select("seq_id", F.concat("chromosome", F.lit(":"), F.col("region_start").cast("string"), F.lit("-"), F.col("region_end").cast("string")).alias("state_label"), "chromosome", "left_tf", "right_tf", lab.alias("label"), F.round(score, 4).alias("score"))
    registry = scored.select("state_label", F.element_at(F.array(*[F.lit(e) for e in views.ELEMENTS]), (F.length("state_label") % 3 + 1).cast("int")).alias("element_type")).distinct()
    return scored, registry, peaks


@query("ccre_winners", "WITH p AS (SELECT *, max(full_score) OVER (PARTITION BY state_label)-min(full_score) OVER (PARTITION BY state_label) AS mg FROM predictions), w AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY state_label ORDER BY full_score DESC, seq_id)=1) SELECT seq_id, state_label, round(mg,6) AS state_margin, full_score>=(SELECT quantile_cont(full_score,0.75) FROM w) AS high_confidence_winner FROM w", ("predictions",))
def ccre_winners(spark, sf):
    p = views.predictions(spark, sf)
    out = R.ccre_report(p, p.select("state_label", "element_type").distinct(), "full_score")["winners"]
    return rounded(out.select("seq_id", "state_label", "state_margin", "high_confidence_winner"))


@query("ccre_classes", "WITH p AS (SELECT *, max(full_score) OVER (PARTITION BY state_label)-min(full_score) OVER (PARTITION BY state_label) AS mg FROM predictions), w AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY state_label ORDER BY full_score DESC, seq_id)=1) SELECT element_type, count(*) AS n_states, round(avg(full_score),6) AS mean_score, round(quantile_cont(full_score,0.5),6) AS median_score, round(avg(mg),6) AS mean_state_margin, round(avg(CASE WHEN label>0.5 THEN 1.0 ELSE 0.0 END),6) AS correct_rate FROM w GROUP BY 1", ("predictions",))
def ccre_classes(spark, sf):
    p = views.predictions(spark, sf)
    return rounded(R.ccre_report(p, p.select("state_label", "element_type").distinct(), "full_score")["classes"])


@query("ccre_contrast", f"""WITH w AS (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY state_label ORDER BY full_score DESC, seq_id)=1), h AS (SELECT full_score>=(SELECT quantile_cont(full_score,0.75) FROM w) AS hc, element_type IN ('pELS','dELS') AS hit FROM w),
  t AS (SELECT 'enhancer_like' AS contrast_class, count(*) FILTER (hc AND hit) AS a, count(*) FILTER (hc AND NOT hit) AS b, count(*) FILTER (NOT hc AND hit) AS c, count(*) FILTER (NOT hc AND NOT hit) AS d FROM h)
  SELECT contrast_class, a, b, c, d, round(sum({SQL_HYPERGEOMETRIC}) FILTER (k>=a),6) AS p_value, round(CASE WHEN b*c=0 THEN CASE WHEN a*d=0 THEN 'NaN'::DOUBLE ELSE 'Infinity'::DOUBLE END ELSE a*d/(b*c) END,6) AS odds_ratio FROM (SELECT *, unnest(range(greatest(0,a-d), least(a+b,a+c)+1)) AS k FROM t) GROUP BY ALL""", ("predictions",))
def ccre_contrast(spark, sf):
    p = views.predictions(spark, sf)
    return rounded(R.ccre_report(p, p.select("state_label", "element_type").distinct(), "full_score")["contrast"])


@query("peak_overlap_report", f"""WITH {PEAKS_SQL}, tl AS (SELECT length(seq_id)%2=0 AS pos, 'any_tf_overlap' AS metric, lo OR ro AS hit FROM fl WHERE num_covered_tfs>=1 UNION ALL SELECT length(seq_id)%2=0, 'both_tf_overlap', lo AND ro FROM fl WHERE num_covered_tfs>=2),
  t AS (SELECT metric, count(*) AS n_rows, avg(CASE WHEN pos THEN hit::INT END) AS pr, avg(CASE WHEN NOT pos THEN hit::INT END) AS nr, count(*) FILTER (pos AND hit) AS a, count(*) FILTER (pos AND NOT hit) AS b, count(*) FILTER (NOT pos AND hit) AS c, count(*) FILTER (NOT pos AND NOT hit) AS d FROM tl GROUP BY 1)
  SELECT metric, n_rows, round(pr,6) AS positive_overlap_rate, round(nr,6) AS negative_overlap_rate, round(CASE WHEN b*c=0 THEN CASE WHEN a*d=0 THEN 'NaN'::DOUBLE ELSE 'Infinity'::DOUBLE END ELSE a*d/(b*c) END,6) AS odds_ratio, round(sum({SQL_HYPERGEOMETRIC}) FILTER (k>=a),6) AS p_value
  FROM (SELECT *, unnest(range(greatest(0,a-d), least(a+b,a+c)+1)) AS k FROM t) GROUP BY ALL""", ("fragments", "regions"))
def peak_overlap_report(spark, sf):
    scored, _, peaks = _scored(spark, sf)
    return rounded(R.peak_overlap_report(scored, peaks, 20_000))


_SUITE = f"""st AS MATERIALIZED (SELECT state_label, min(chromosome) AS chromosome, min(g) AS g, avg(v) AS v FROM (SELECT *, ({views.ELEMENTS})[length(state_label)%3+1] AS g FROM (
  SELECT chromosome, chromosome||':'||region_start||'-'||region_end AS state_label, round(('0x'||substr(sha256('v'||region_id),1,8))::BIGINT%1000000/1e6::DOUBLE*0.8::DOUBLE+CASE WHEN length(region_id)%2=0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END,4) AS v FROM regions)) WHERE g IN ('pELS','dELS') GROUP BY 1)"""


@query("validation_suite", f"WITH RECURSIVE {sql_state_blocked(_SUITE)}", ("regions",))
def validation_suite(spark, sf):
    scored, registry, peaks = _scored(spark, sf)
    return rounded(R.validation_suite(scored, registry, peaks)["state_blocked"])


# ---- L13, L14, L15, L19
_MS = """ms AS (SELECT split_name, phase, seq_id, label, round(avg(full_score),9) AS f, round(avg(availability_only_score),9) AS a, round(avg(additive_null_score),9) AS n FROM seed_scores GROUP BY 1,2,3,4 HAVING count(DISTINCT seed)=5)"""


@query("significance_metrics", f"WITH {_MS}, lg AS (SELECT split_name, phase, label, unnest(['model','availability_only','additive_null']) AS method, unnest([f,a,n]) AS score FROM ms) SELECT split_name, phase, method, n, round(auprc,6) AS auprc, round(auroc,6) AS auroc FROM {sql_rank_metrics('lg', 'label', 'score', 'split_name, phase, method')}", ("seed_scores",))
def significance_metrics(spark, sf):
    m = R.significance_metrics(R.method_scores(views.seed_scores(spark, sf), schema.SEEDS))
    return rounded(m.select("split_name", "phase", "method", "n", "auprc", "auroc"))


_SLICE = "split_name, phase, comparison_method"
_BOTH = "unnest(['auprc','auroc']) AS metric_name, unnest([{0}.auprc,{0}.auroc]) AS {1}"


def _sql_two(name: str, source: str, m: str, b: str, by: str, weight: str = "1") -> str:
    """Model and baseline metric of every group, one row a metric."""
    return (f"{name}_m AS {sql_rank_metrics(source, 'label', m, by, weight)}, {name}_b AS {sql_rank_metrics(source, 'label', b, by, weight)}, "
            f"{name} AS (SELECT {by}, {_BOTH.format('x', 'mv')}, unnest([y.auprc,y.auroc]) AS bv FROM {name}_m x JOIN {name}_b y USING ({by}))")


@query("significance_summary", f"""WITH {_MS}, pr AS (SELECT split_name, phase, seq_id, label, f AS m, unnest(['availability_only','additive_null']) AS comparison_method, unnest([a,n]) AS b FROM ms),
  bt AS MATERIALIZED (SELECT *, {sql_drawn('poisson')} AS w FROM {sql_draws(11, 'seq_id', 'pr', _SLICE + ', label, m, b', 5000)}),
  sw AS MATERIALIZED (SELECT {_SLICE}, replicate, label, unnest([m,b]) AS sm, unnest([b,m]) AS sb, unnest([n-k,k]) AS w FROM (SELECT *, 1<<level AS n, {sql_drawn('swap')} AS k FROM {sql_draws(11, 'seq_id', 'pr', _SLICE + ', label, m, b', 5000)})),
  {_sql_two('ob', 'pr', 'm', 'b', _SLICE)}, {_sql_two('bo', 'bt', 'm', 'b', _SLICE + ', replicate', 'w')}, {_sql_two('pe', 'sw', 'sm', 'sb', _SLICE + ', replicate', 'w')},
  o AS (SELECT {_SLICE}, metric_name, mv AS model_metric, bv AS baseline_metric, mv-bv AS observed_diff FROM ob),
  bs AS (SELECT {_SLICE}, metric_name, quantile_cont(d,0.025) AS ci_low, quantile_cont(d,0.975) AS ci_high, (count(*) FILTER (d<=0)+1)/(count(*)+1) AS bootstrap_p_value FROM (SELECT {_SLICE}, metric_name, coalesce(mv-bv,observed_diff) AS d FROM bo JOIN o USING ({_SLICE}, metric_name)) GROUP BY ALL),
  ps AS (SELECT {_SLICE}, metric_name, (count(*) FILTER (mv-bv>=observed_diff-1e-12)+1)/(count(*)+1) AS permutation_p_value FROM pe JOIN o USING ({_SLICE}, metric_name) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (ORDER BY permutation_p_value, split_name, phase, metric_name, comparison_method) AS k, count(*) OVER () AS n FROM o JOIN bs USING ({_SLICE}, metric_name) JOIN ps USING ({_SLICE}, metric_name)),
  f AS (SELECT *, least(1,min(permutation_p_value*n/k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bh_fdr FROM r)
  SELECT {_SLICE}, metric_name, round(model_metric,6) AS model_metric, round(baseline_metric,6) AS baseline_metric, round(observed_diff,6) AS observed_diff, round(ci_low,6) AS ci_low, round(ci_high,6) AS ci_high, round(bootstrap_p_value,6) AS bootstrap_p_value,
    round(permutation_p_value,6) AS permutation_p_value, round(bh_fdr,6) AS bh_fdr, ci_low>0 AND permutation_p_value<0.05 AS significant_win, ci_low>0 AND bh_fdr<0.05 AS significant_win_fdr FROM f""", ("seed_scores",))
def significance_summary(spark, sf):
    return rounded(R.significance_tests(R.method_scores(views.seed_scores(spark, sf), schema.SEEDS)))


@query("significance_with_baselines", f"WITH {_MS}, b AS (SELECT split_name, seq_id, round(label*0.3::DOUBLE+length(seq_id)/10.0::DOUBLE,4) AS s FROM ms WHERE length(seq_id)<>5), k AS (SELECT ms.* FROM ms WHERE (split_name, seq_id) IN (SELECT (split_name, seq_id) FROM b)), lg AS (SELECT split_name, phase, label, 'model' AS method, f AS score FROM k UNION ALL SELECT split_name, phase, label, 'availability_only', a FROM k UNION ALL SELECT split_name, phase, label, 'additive_null', n FROM k UNION ALL SELECT k.split_name, phase, label, 'GET', s FROM k JOIN b USING (split_name, seq_id)) SELECT split_name, phase, method, count(*) AS n, round(sum(score),5) AS total FROM lg GROUP BY 1,2,3", ("seed_scores",))
def significance_with_baselines(spark, sf):
    s = views.seed_scores(spark, sf)
    full = s.groupBy("split_name", "phase", "seq_id", "label").agg(F.count_distinct("seed").alias("k")).filter("k = 5")
    base = full.filter(F.length("seq_id") != 5).select("split_name", "seq_id", F.lit("GET").alias("method"), F.round(F.col("label") * 0.3 + F.length("seq_id") / 10.0, 4).alias("score"))
    m = R.method_scores(s, schema.SEEDS, base)
    return m.groupBy("split_name", "phase", "method").agg(F.count("*").alias("n"), F.round(F.sum("score"), 5).alias("total"))


def _ledger(spark, sf):
    ev = views.table(spark, sf, "events")
    return ev.select(F.concat(F.lit("run"), F.format_string("%08d", "event_id")).alias("run_id"), F.col("event_type").alias("phase"), F.lit("real").alias("scenario"), F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("split_name"),
                     (F.col("event_id") % 3).cast("int").alias("seed"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.create_map(F.lit("auprc"), F.col("value"), F.lit("ece"), F.col("user_id").cast("double")).alias("metrics"))


@query("main_metrics", """WITH l AS (SELECT event_type AS phase, 's'||(user_id%5) AS split_name, (event_id%3)::BIGINT AS seed, value AS auprc, user_id::DOUBLE AS ece FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id%5, event_id%3 ORDER BY strftime(ts,'%Y-%m-%d %H:%M:%S') DESC, event_id DESC)=1)
  SELECT phase AS method, phase, split_name, seed, auprc, ece FROM l UNION ALL SELECT p_brand, 'baseline', 'default', -1, avg(p_retailprice), 0 FROM part GROUP BY 1""")
def main_metrics(spark, sf):
    base = views.table(spark, sf, "part").groupBy(F.col("p_brand").alias("method")).agg(F.avg("p_retailprice").alias("auprc")).withColumn("split_name", F.lit("default"))
    m = R.main_metrics(_ledger(spark, sf), base, "real").select("method", "phase", "split_name", F.coalesce(F.col("seed").cast("long"), F.lit(-1)).alias("seed"), "auprc", "ece")
    return m


def _inventory(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("checkpoint", "predictions", "train_bundle", "valid_bundle")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    a = views.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "phase4").otherwise("phase5").alias("phase"), F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("split_name"), (F.col("l_linenumber") % 2).cast("long").alias("seed"),
        kind.alias("kind"), F.col("l_suppkey").alias("modified"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"))
    return R.artifact_inventory(a.select("phase", "split_name", "seed").distinct(), a)


_INVENTORY = """a AS (SELECT CASE WHEN l_linestatus='F' THEN 'phase4' ELSE 'phase5' END AS phase, 's'||l_orderkey AS split_name, (l_linenumber%2)::BIGINT AS seed, (['checkpoint','predictions','train_bundle','valid_bundle'])[CAST(l_partkey%4 AS INT)+1] AS kind, l_suppkey AS modified, 'p'||l_partkey AS path FROM lineitem),
  g AS (SELECT DISTINCT phase, split_name, seed FROM a), ck AS (SELECT phase, split_name, seed, arg_max(path,(modified,path)) AS checkpoint FROM a WHERE kind='checkpoint' GROUP BY 1,2,3), pr AS (SELECT DISTINCT phase, split_name, seed FROM a WHERE kind='predictions'), bu AS (SELECT phase, split_name FROM a WHERE kind LIKE '%bundle' GROUP BY 1,2 HAVING count(DISTINCT kind)=2),
  iv AS (SELECT g.phase, g.split_name, g.seed, CASE WHEN ck.checkpoint IS NOT NULL AND pr.seed IS NOT NULL THEN 'complete' WHEN ck.checkpoint IS NOT NULL THEN 'needs_prediction_regeneration' WHEN bu.phase IS NULL THEN 'blocked_missing_bundles' WHEN g.phase='phase5' AND w.seed IS NULL THEN 'blocked_missing_phase4_warm_start' ELSE 'ready_to_train' END AS status, coalesce(ck.checkpoint,'') AS checkpoint, pr.seed IS NOT NULL AS scored
  FROM g LEFT JOIN ck USING (phase, split_name, seed) LEFT JOIN pr ON pr.phase=g.phase AND pr.split_name=g.split_name AND pr.seed=g.seed LEFT JOIN bu ON bu.phase=g.phase AND bu.split_name=g.split_name LEFT JOIN (SELECT split_name, seed FROM ck WHERE phase='phase4') w ON w.split_name=g.split_name AND w.seed=g.seed)"""


@query("artifact_inventory", f"WITH {_INVENTORY} SELECT phase, split_name, seed, status, checkpoint FROM iv")
def artifact_inventory(spark, sf):
    return _inventory(spark, sf).select("phase", "split_name", "seed", "status", "checkpoint")


@query("inventory_rollups", f"""WITH {_INVENTORY}, e AS (SELECT unnest([['requested',''], ['status',status], CASE WHEN status='complete' THEN ['complete',''] END, CASE WHEN status='ready_to_train' THEN ['ready_to_train',''] END, CASE WHEN status LIKE 'blocked%' THEN ['blocked',''] END,
  CASE WHEN checkpoint='' THEN ['missing_checkpoint',''] END, CASE WHEN NOT scored THEN ['missing_prediction',''] END, CASE WHEN status='ready_to_train' THEN ['ready_to_train_by_phase',phase] END, CASE WHEN status LIKE 'blocked%' THEN ['blocked_by_phase',phase] END]) AS p FROM iv)
  SELECT p[1] AS measure, p[2] AS value, count(*) AS n FROM e WHERE p IS NOT NULL GROUP BY 1,2""")
def inventory_rollups(spark, sf):
    return R.inventory_rollups(_inventory(spark, sf))


@query("missing_predictions", f"SELECT split_name, phase, 99::INT AS seed, 'missing_predictions' AS reason FROM (SELECT DISTINCT split_name, phase FROM seed_scores) UNION ALL SELECT split_name, phase, s, 'missing_predictions' FROM (SELECT DISTINCT split_name, phase FROM seed_scores), (SELECT unnest([{','.join(map(str, schema.SEEDS))}])::INT AS s) WHERE (split_name, phase, s) NOT IN (SELECT (split_name, phase, seed) FROM seed_scores)", ("seed_scores",))
def missing_predictions(spark, sf):
    return R.missing_predictions(views.seed_scores(spark, sf), [*schema.SEEDS, 99])


@query("evaluate_predictions", f"""WITH m AS {sql_rank_metrics('predictions', 'label', 'full_score')}, a AS {sql_rank_metrics('predictions', 'label', 'availability_only_score')}, n AS {sql_rank_metrics('predictions', 'label', 'additive_null_score')}
  SELECT round(m.auprc,6) AS model_auprc, round(m.auroc,6) AS model_auroc, round(a.auprc,6) AS availability_only_auprc, round(a.auroc,6) AS availability_only_auroc, round(n.auprc,6) AS additive_null_auprc, round(n.auroc,6) AS additive_null_auroc,
  round((m.auprc-a.auprc)/a.auprc,6) AS relative_gain_vs_availability, round((m.auprc-n.auprc)/n.auprc,6) AS relative_gain_vs_additive, b.*, e.*, g.*, l.*, s.*
  FROM m, a, n, ({BINARY_SQL}) b, ({CALIBRATION_SQL}) e, ({GAP_SQL}) g, ({LEAKAGE_SQL}) l, ({SPACING_SQL}) s""", ("predictions",))
def evaluate_predictions(spark, sf):
    out = R.evaluate_predictions(near_bins(views.predictions(spark, sf)), "pred")
    spacing = ["spacing_kl", "spacing_emd", "helical_recovery"]
    return rounded(out.withColumns({c: F.round(c, 5) for c in spacing}))


# ---- L17, L18
@query("reporter_panel", """WITH s AS (SELECT state_label, list_sum(availability) AS a, list_sum(state) AS c FROM (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY state_label ORDER BY vec_id)=1)), h AS (SELECT state_label FROM s ORDER BY a DESC, c DESC, state_label LIMIT 1), l AS (SELECT state_label FROM s ORDER BY a, c, state_label LIMIT 1)
  SELECT 'reporter::p'||p_partkey||'::'||m AS seq_id, CASE m WHEN 'high' THEN (SELECT state_label FROM h) ELSE (SELECT state_label FROM l) END AS state_label, CASE WHEN m='high' AND p_size%2=0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, CASE WHEN p_partkey=3 AND m='low' THEN 'valid' ELSE 'train' END AS split FROM part, (SELECT unnest(['high','low']) AS m)""", ("states",))
def reporter_panel(spark, sf):
    con = views.table(spark, sf, "part").select(F.concat(F.lit("P#"), F.col("p_partkey").cast("string")).alias("sequence_name"), F.lit("ACGT").alias("sequence"), F.concat_ws("::", "p_brand", "p_type").alias("tf_pair_label"), (F.col("p_size") % 2 == 0).alias("positive_in_high_state"))
    st = dedupe(views.states(spark, sf), ["state_label"], ["vec_id"])
    return A.reporter_panel(con, st, ["P#3::low"]).select("seq_id", "state_label", "label", "split")


@query("source_registry", "SELECT p_brand AS phase, p_type AS source_type, count(*) AS n, count(*) FILTER (p_size%2=0) AS required_n FROM part GROUP BY 1,2")
def source_registry(spark, sf):
    m = views.table(spark, sf, "part").select(F.col("p_brand").alias("phase"), F.col("p_type").alias("source_type"), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false").alias("required"))
    return C.source_registry(m)


# ---- N
@query("user_scoring", "SELECT seq_id, round((length(sequence)-length(replace(sequence,'A','')))/96.0,6) AS score FROM windows", ("windows",))
def user_scoring(spark, sf):
    def fn(pdf):
        return pdf.assign(score=pdf["sequence"].str.count("A") / 96.0)[["seq_id", "score"]]
    return rounded(N.score_table(views.windows(spark, sf).select("seq_id", "sequence"), fn, "seq_id string, score double"))


@query("usage_score", """WITH e AS (SELECT seq_id, full_score*2-1 AS l, bridge_score*2-1 AS r, geometry_residual AS d, exp(-greatest(0,edge_gap-4)) AS c FROM predictions), z AS (SELECT *, ln(1+exp(-l)+exp(-r)) AS m FROM e), g AS (SELECT *, ln(exp(m)+c*exp(-(l+r+d)))-m AS g, c*tanh(-d) AS dr, ln(exp(m)+c*exp(-(l+r)))-m AS g0 FROM z)
  SELECT seq_id, round(m,6) AS log_z_mono, round(g,6) AS cooperative_gain, round(1/(1+exp(-(ln(2.0::DOUBLE)*(m+g+dr)))),6) AS full_score, round(1/(1+exp(-(ln(2.0::DOUBLE)*(m+g0)))),6) AS availability_only_score, round(1/(1+exp(l+r)),6) AS additive_null_score FROM g""", ("predictions",))
def usage_score(spark, sf):
    p = views.predictions(spark, sf)
    e = p.select("seq_id", (F.col("full_score") * 2 - 1).alias("left_energy"), (F.col("bridge_score") * 2 - 1).alias("right_energy"), F.col("geometry_residual").alias("state_residual"), F.exp(-F.greatest(F.lit(0.0), F.col("edge_gap") - 4)).alias("compatibility"))
    return rounded(N.usage_score(e).select("seq_id", "log_z_mono", "cooperative_gain", "full_score", "availability_only_score", "additive_null_score"))


@query("robustness_report")
def robustness_report(spark, sf):
    s = views.states(spark, sf).select(F.col("vec_id").cast("string").alias("seq_id"), F.when(F.col("label") < 5, 1.0).otherwise(0.0).alias("label"), "availability", "state")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    score = lambda df: df.withColumn("score", 1 / (1 + F.exp(-(total("availability") + F.get("state", F.lit(0))))))
    return rounded(N.robustness_report(s, score))


@query("anchor_roll", "SELECT vec_id, round(availability[16],6) AS first, round(availability[15],6) AS last FROM states", ("states",))
def anchor_roll(spark, sf):
    s = views.states(spark, sf).select("vec_id", F.col("availability").alias("left_anchor_offsets"), F.col("availability").alias("right_anchor_offsets"))
    r = N.perturb(s, "anchor_shift", key="vec_id")
    return rounded(r.select("vec_id", F.get("left_anchor_offsets", F.lit(0)).alias("first"), F.element_at("left_anchor_offsets", -1).alias("last")))


@query("linear_classifier")
def linear_classifier(spark, sf):
    p = views.predictions(spark, sf).withColumn("split", P.assign_split("seq_id"))
    return rounded(N.fit_classifier(p, ["full_score", "availability_only_score", "additive_null_score", "geometry_residual"]))


@query("ridge_component")
def ridge_component(spark, sf):
    p = views.predictions(spark, sf).withColumn("split", P.assign_split("seq_id"))
    return rounded(N.fit_component(p, ["full_score", "availability_only_score", "bridge_score"], "geometry_residual", reg=0.1))
