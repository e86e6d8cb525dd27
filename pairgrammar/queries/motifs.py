"""Motif, sequence-job and graph queries (D14, D15, C10-C13, G3-G5, I, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgrammar import views
from pairgrammar.functions.geometry import geometry_vector
from pairgrammar.functions.sequence import interface_bounds
from pairgrammar.operators import examples as E
from pairgrammar.operators import graph as R
from pairgrammar.operators import motifs as M
from pairgrammar.queries.registry import query, rounded

H = ("hits",)


def library(spark, sf, cutoff=None):
    return M.pwm_library(views.motif_positions(spark, sf), cutoff=cutoff)


@query("motif_consensus", "SELECT motif_id, string_agg(CASE greatest(A,C,G,T) WHEN A THEN 'A' WHEN C THEN 'C' WHEN G THEN 'G' ELSE 'T' END,'' ORDER BY position) AS consensus FROM motif_positions GROUP BY 1", ("motif_positions",))
def motif_consensus(spark, sf):
    return M.consensus(views.motif_positions(spark, sf))


@query("motif_log_odds", "SELECT motif_id, position, round(A,6) AS \"A\", round(C,6) AS \"C\", round(G,6) AS \"G\", round(T,6) AS \"T\" FROM pwm", ("pwm",))
def motif_log_odds(spark, sf):
    return rounded(M.build_pwm(views.motif_positions(spark, sf)))


@query("motif_cutoffs", "SELECT motif_id, motif_len, round(consensus_score,6) AS consensus_score, round(cutoff,6) AS cutoff FROM motif_stats", ("motif_stats",))
def motif_cutoffs(spark, sf):
    return rounded(M.motif_stats(M.build_pwm(views.motif_positions(spark, sf))))


@query("scan_motifs", 'SELECT seq_id, tf_id, start, "end", strand, score, hit_rank FROM hits WHERE hit_rank<24', H)
def scan_motifs(spark, sf):
    return M.scan_motifs(views.windows(spark, sf), library(spark, sf)).select(
        "seq_id", "tf_id", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "hit_rank")], "strand", "score")


_PAIRS2 = "least(left_tf,right_tf)||'::'||greatest(left_tf,right_tf)"


@query("hit_counts", f"""WITH g AS (SELECT seq_id, tf_id, count(*) AS k FROM hits WHERE hit_rank<2 GROUP BY 1,2), sup AS (SELECT DISTINCT least(left_tf,right_tf) AS a, greatest(left_tf,right_tf) AS b FROM edges)
  SELECT x.seq_id, x.n AS observed_monomer_candidate_count, coalesce(p.n,0) AS observed_pair_candidate_count FROM (SELECT seq_id, count(*) AS n FROM g GROUP BY 1) x LEFT JOIN (
    SELECT l.seq_id, sum(CASE WHEN s.a IS NULL THEN least(l.k*r.k,1) ELSE l.k*r.k END)::BIGINT AS n FROM g l JOIN g r ON l.seq_id=r.seq_id AND l.tf_id<r.tf_id LEFT JOIN sup s ON s.a=l.tf_id AND s.b=r.tf_id GROUP BY 1) p USING (seq_id)""", ("hits", "edges"))
def hit_counts(spark, sf):
    return M.hit_counts(M.scan_motifs(views.windows(spark, sf), library(spark, sf), top_k=2), views.edges(spark, sf))


_CAND = """cand AS (SELECT l.seq_id, l.tf_id AS left_tf, r.tf_id AS right_tf, l.start AS left_start, r.start AS right_start, l.strand||r.strand AS orientation, s.a IS NOT NULL AS sup, l."end"-l.start+r."end"-r.start AS width_sum, abs(r.start-l."end"-6) AS gap_penalty,
    greatest(0, least(l."end",r."end")-greatest(l.start,r.start)) AS overlap_len, l.hit_rank+r.hit_rank AS rank_sum, l.hit_rank AS left_rank, CASE WHEN l.tf_id=r.tf_id THEN 'homotypic_fallback' WHEN s.a IS NOT NULL THEN 'heterotypic_reference' ELSE 'heterotypic_fallback' END AS pair_mode
  FROM (SELECT * FROM hits WHERE hit_rank<2) l JOIN (SELECT * FROM hits WHERE hit_rank<2) r ON l.seq_id=r.seq_id AND (l.tf_id<r.tf_id OR (l.tf_id=r.tf_id AND l.hit_rank<r.hit_rank)) LEFT JOIN (SELECT DISTINCT least(left_tf,right_tf) AS a, greatest(left_tf,right_tf) AS b FROM edges WHERE left_tf<>right_tf) s ON s.a=l.tf_id AND s.b=r.tf_id),
  fit AS (SELECT * FROM cand c WHERE pair_mode<>'homotypic_fallback' OR NOT EXISTS (SELECT 1 FROM cand o WHERE o.seq_id=c.seq_id AND o.pair_mode<>'homotypic_fallback')),
  sel AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY sup DESC, width_sum DESC, gap_penalty, overlap_len, rank_sum, left_tf, right_tf, left_rank)-1 AS pair_rank FROM fit)"""


@query("select_pairs", f"WITH {_CAND} SELECT seq_id, left_tf, right_tf, left_start, right_start, orientation, pair_mode, pair_rank FROM sel WHERE pair_rank<3", ("hits", "edges"))
def select_pairs(spark, sf):
    hits = M.scan_motifs(views.windows(spark, sf), library(spark, sf), top_k=2)
    return rounded(M.select_pairs(hits, views.edges(spark, sf), 3).select("seq_id", "left_tf", "right_tf", "left_start", "right_start", "orientation", "pair_mode", "pair_rank"))


_ANCH = "an AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, tf_id, start, strand) AS r FROM hits WHERE hit_rank<6)"


@query("generate_pairs", f"""WITH {_ANCH}, p AS (SELECT l.seq_id, l.tf_id AS left_tf, r.tf_id AS right_tf, l.start AS left_start, r.start AS right_start, l.strand||r.strand AS orientation, CAST(r.start-l."end" AS DOUBLE) AS edge_gap, round(l.score+r.score,6) AS coarse_additive_score,
    row_number() OVER (PARTITION BY l.seq_id ORDER BY round(l.score+r.score,6) DESC, l.r, r.r)-1 AS k FROM an l JOIN an r ON l.seq_id=r.seq_id AND l.r<r.r) SELECT seq_id||'::pair::'||k AS pair_id, left_tf, right_tf, left_start, right_start, orientation, edge_gap, coarse_additive_score FROM p WHERE k<16""", H)
def generate_pairs(spark, sf):
    hits = M.scan_motifs(views.windows(spark, sf), library(spark, sf), top_k=6)
    return rounded(M.generate_pairs(hits, 16).select("pair_id", "left_tf", "right_tf", "left_start", "right_start", "orientation", "edge_gap", "coarse_additive_score"))


_TARGET = """tp AS (SELECT w.seq_id, l.tf_id AS left_tf, r.tf_id AS right_tf, l.start AS left_start, r.start AS right_start, l.strand||r.strand AS orientation, round(l.score+r.score,6) AS coarse_additive_score,
    row_number() OVER (PARTITION BY w.seq_id ORDER BY round(l.score+r.score,6) DESC, l.hit_rank, r.hit_rank)-1 AS k FROM windows w JOIN hits l ON l.seq_id=w.seq_id AND l.tf_id=w.left_tf AND l.hit_rank<2 JOIN hits r ON r.seq_id=w.seq_id AND r.tf_id=w.right_tf AND r.hit_rank<2
    WHERE w.left_tf<>w.right_tf OR (l.hit_rank=0 AND r.hit_rank=0))"""


@query("targeted_pairs", f"WITH {_TARGET} SELECT seq_id||'::target::'||k AS pair_id, left_tf, right_tf, left_start, right_start, orientation, coarse_additive_score FROM tp", ("windows", "hits"))
def targeted_pairs(spark, sf):
    w = views.windows(spark, sf)
    hits = M.scan_motifs(w, library(spark, sf), top_k=2)
    return rounded(M.targeted_pairs(hits, w.select("seq_id", "left_tf", "right_tf")).select("pair_id", "left_tf", "right_tf", "left_start", "right_start", "orientation", "coarse_additive_score"))


_BUILD = f"""al AS (SELECT h.* FROM hits h JOIN windows w ON w.seq_id=h.seq_id AND h.tf_id IN (w.left_tf, w.right_tf) WHERE hit_rank<24), {_TARGET.replace('hits l', 'al l').replace('hits r', 'al r')},
  fb AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, tf_id, start, strand) AS r FROM al WHERE seq_id NOT IN (SELECT seq_id FROM tp)),
  fp AS (SELECT l.seq_id, l.tf_id AS left_tf, r.tf_id AS right_tf, l.start AS left_start, r.start AS right_start, l.strand||r.strand AS orientation, row_number() OVER (PARTITION BY l.seq_id ORDER BY round(l.score+r.score,6) DESC, l.r, r.r)-1 AS k FROM fb l JOIN fb r ON l.seq_id=r.seq_id AND l.r<r.r),
  bp AS (SELECT seq_id, left_tf, right_tf, left_start, right_start, orientation FROM tp UNION SELECT seq_id, left_tf, right_tf, left_start, right_start, orientation FROM fp WHERE k<64)"""


@query("build_candidates", f"WITH {_BUILD} SELECT b.seq_id, l.tf_id AS left_tf, r.tf_id AS right_tf, left_start, right_start, orientation FROM bp b JOIN tf_genes l ON l.gene_symbol=b.left_tf JOIN tf_genes r ON r.gene_symbol=b.right_tf", ("windows", "hits", "tf_genes"))
def build_candidates(spark, sf):
    found = views.motif_positions(spark, sf)
    genes = views.tf_genes(spark, sf, found)
    pos = found.join(genes.select(F.col("gene_symbol").alias("motif_id"), "tf_id"), "motif_id").drop("motif_id").withColumnRenamed("tf_id", "motif_id")
    anchors, pairs = M.build_candidates(views.windows(spark, sf), genes, M.pwm_library(pos))
    return rounded(pairs.select("seq_id", "left_tf", "right_tf", "left_start", "right_start", "orientation"))


@query("declared_candidates", "SELECT seq_id, seq_id||'::direct' AS pair_id, coalesce(l.tf_id,'') AS left_tf, coalesce(r.tf_id,'') AS right_tf, left_start, right_end, edge_gap FROM anchored a LEFT JOIN tf_genes l ON l.gene_symbol=a.left_tf LEFT JOIN tf_genes r ON r.gene_symbol=a.right_tf", ("anchored", "tf_genes"))
def declared_candidates(spark, sf):
    w = views.anchored(spark, sf).withColumnsRenamed({f"{s}_{e}": f"{s}_anchor_{e}" for s in ("left", "right") for e in ("start", "end")})
    found = views.motif_positions(spark, sf)
    _, pairs = M.build_candidates(w, views.tf_genes(spark, sf, found), M.pwm_library(found))
    return rounded(pairs.select("seq_id", "pair_id", "left_tf", "right_tf", "left_start", "right_end", "edge_gap"))


@query("resolve_pair", """WITH st AS (SELECT seq_id, CASE WHEN tile%2=0 THEN right_tf ELSE left_tf END AS a, CASE WHEN tile%2=0 THEN left_tf ELSE right_tf END AS b, left_start+1 AS ls FROM anchored WHERE label>0.5)
  SELECT w.seq_id, coalesce(s.ls, w.left_start) AS pair_left_start, w.right_start AS pair_right_start, w.edge_gap AS pair_edge_gap FROM anchored w LEFT JOIN st s USING (seq_id)""", ("anchored",))
def resolve_pair(spark, sf):
    a = views.anchored(spark, sf)
    even = F.col("tile") % 2 == 0
    stored = a.filter("label > 0.5").select(
        "seq_id", F.when(even, F.col("right_tf")).otherwise(F.col("left_tf")).alias("_l"), F.when(even, F.col("left_tf")).otherwise(F.col("right_tf")).alias("_r"),
        (F.col("left_start") + 1).alias("left_start"), "left_end", "right_start", "right_end", "orientation", "center_distance", "edge_gap", "overlap_len", "coarse_additive_score",
        F.concat("seq_id", F.lit("::p")).alias("pair_id")).withColumnsRenamed({"_l": "left_tf", "_r": "right_tf"})
    w = a.withColumnsRenamed({f"{s}_{e}": f"{s}_anchor_{e}" for s in ("left", "right") for e in ("start", "end")}).withColumnsRenamed({"left_tf": "left_tf_id", "right_tf": "right_tf_id"})
    return rounded(M.resolve_pair(w, stored).select("seq_id", "pair_left_start", "pair_right_start", "pair_edge_gap"))


_DI = "(SELECT seq_id, substr(sequence, CAST(p AS INT), 2) AS pair, count(*) AS n FROM windows, (SELECT unnest(range(1,96)) AS p) GROUP BY 1,2)"


@query("dinucleotide_counts", f"SELECT seq_id, pair, n FROM {_DI}", ("windows",))
def dinucleotide_counts(spark, sf):
    return E.dinucleotide_counts(views.windows(spark, sf))


@query("dinucleotide_shuffle", f"SELECT seq_id, pair, n FROM {_DI}", ("windows",))
def dinucleotide_shuffle(spark, sf):
    """Counts after the shuffle equal the counts before it."""
    return E.dinucleotide_counts(E.shuffle_dinucleotide(views.windows(spark, sf).select("seq_id", "sequence"), 11), "shuffled")


@query("interface_shuffle", """SELECT seq_id, substr(sequence,1,CAST(a AS INT)) AS head, substr(sequence,CAST(least(b,96)+1 AS INT)) AS tail, array_to_string(list_sort(string_split(substr(sequence,CAST(a+1 AS INT),CAST(least(b,96)-a AS INT)),'')),'') AS letters FROM (
  SELECT *, greatest(CASE WHEN hi>lo THEN lo ELSE least(left_end,right_start) END-4,0) AS a, CASE WHEN hi>lo THEN hi ELSE greatest(left_end,right_start) END+4 AS b FROM (SELECT *, greatest(left_start,right_start) AS lo, least(left_end,right_end) AS hi FROM anchored))""", ("anchored",))
def interface_shuffle(spark, sf):
    a = views.anchored(spark, sf).select("seq_id", "sequence", "left_start", "left_end", "right_start", "right_end")
    s = E.shuffle_interface(a, 11)
    lo, hi = interface_bounds("left_start", "left_end", "right_start", "right_end")
    t = F.col("sequence_interface_shuffle")
    lo, hi = lo.cast("int"), F.least(hi, F.lit(96)).cast("int")
    letters = F.array_join(F.array_sort(F.filter(F.split(F.substring(t, lo + 1, hi - lo), ""), lambda c: c != "")), "")
    return s.select("seq_id", F.substring(t, F.lit(1), lo).alias("head"), F.substring(t, hi + 1, F.lit(96)).alias("tail"), letters.alias("letters"))


_D15 = "(('0x'||substr(sha256({0}),1,15))::BIGINT)"


@query("rerandomize_cores", f"""SELECT seq_id, string_agg(CASE WHEN (p>=left_start AND p<least(left_end,greatest(left_start,right_start))) OR (p>=greatest(right_start,least(left_end,right_end)) AND p<right_end) THEN substr('ACGT', CAST({_D15.format("'11|'||seq_id||'|'||p")}%4+1 AS INT),1) ELSE substr(sequence,CAST(p+1 AS INT),1) END, '' ORDER BY p) AS randomized
  FROM anchored, (SELECT unnest(range(0,96)) AS p) GROUP BY 1""", ("anchored",))
def rerandomize_cores(spark, sf):
    a = views.anchored(spark, sf).select("seq_id", "sequence", "left_start", "left_end", "right_start", "right_end")
    return E.rerandomize_cores(a, 11, "randomized").select("seq_id", "randomized")


_EDIT = "(SELECT *, substr(sequence,CAST(position+1 AS INT),1) AS ref_base FROM (SELECT *, unnest(range(least(left_end,right_start),greatest(left_end,right_start))) AS position FROM anchored))"


@query("single_edits", f"SELECT seq_id, position, ref_base, alt_base, substr(sequence,1,CAST(position AS INT))||alt_base||substr(sequence,CAST(position+2 AS INT)) AS edited_sequence FROM {_EDIT}, (SELECT unnest(['A','C','G','T']) AS alt_base) WHERE alt_base<>ref_base", ("anchored",))
def single_edits(spark, sf):
    return E.single_edits(views.anchored(spark, sf)).select("seq_id", "position", "ref_base", "alt_base", "edited_sequence")


_GC = "(length(replace(replace({0},'A',''),'T',''))-(length({0})-length(replace({0},'N',''))))"


@query("rank_edits", f"""WITH s AS (SELECT seq_id, position, alt_base, st, {_GC.format('e')}*(CASE st WHEN 'high' THEN 2 ELSE 1 END)::DOUBLE/96 AS sc, {_GC.format('sequence')}*(CASE st WHEN 'high' THEN 2 ELSE 1 END)::DOUBLE/96 AS b0 FROM (
    SELECT seq_id, sequence, position, alt_base, substr(sequence,1,CAST(position AS INT))||alt_base||substr(sequence,CAST(position+2 AS INT)) AS e FROM {_EDIT}, (SELECT unnest(['A','C','G','T']) AS alt_base) WHERE alt_base<>ref_base), (SELECT unnest(['high','low']) AS st)),
  m AS (SELECT seq_id, position, alt_base, max(sc) FILTER (st='high')-max(sc) FILTER (st='low') AS high_low_margin, max(b0) FILTER (st='high')-max(b0) FILTER (st='low') AS b FROM s GROUP BY 1,2,3)
  SELECT seq_id, position, alt_base, round(high_low_margin,6) AS high_low_margin, round(b-high_low_margin,6)+0.0::DOUBLE AS margin_drop FROM m""", ("anchored",))
def rank_edits(spark, sf):
    def gc(c):
        return (F.length(F.col(c)) - F.length(F.translate(c, "GC", ""))) / 96.0
    states = F.explode(F.array(F.struct(F.lit("high").alias("m"), F.lit(2.0).alias("f")), F.struct(F.lit("low").alias("m"), F.lit(1.0).alias("f")))).alias("st")
    a = views.anchored(spark, sf).select("seq_id", "sequence", "left_end", "right_start")
    scored = E.single_edits(a).select("seq_id", "position", "alt_base", "edited_sequence", states).select("seq_id", "position", "alt_base", F.col("st.m").alias("state_mode"), (gc("edited_sequence") * F.col("st.f")).alias("full_score"))
    base = a.select("seq_id", "sequence", states).select("seq_id", F.col("st.m").alias("state_mode"), (gc("sequence") * F.col("st.f")).alias("full_score"))
    return rounded(E.rank_edits(scored, base, ["seq_id"]))


@query("gap_grid", """SELECT seq_id, gap, left_end+gap AS new_right_start, substr(sequence,CAST(left_start+1 AS INT),8) AS left_seen, substr(sequence,CAST(right_start+1 AS INT),6) AS right_seen FROM anchored, (SELECT unnest([1,5,9,11,15,19,23]) AS gap) WHERE left_end+gap+6<=95""", ("anchored",))
def gap_grid(spark, sf):
    g = E.gap_grid(views.anchored(spark, sf), [-3, 1, 5, 9, 11, 15, 19, 23], 11)
    cut = lambda at, n: F.substring("edited_sequence", (F.col(at) + 1).cast("int"), F.lit(n))
    return g.select("seq_id", F.col("gap").cast("long").alias("gap"), "new_right_start", cut("left_start", 8).alias("left_seen"), cut("new_right_start", 6).alias("right_seen"))


@query("index_maps", "SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY value)-1 AS \"index\" FROM (SELECT DISTINCT 'tf_id' AS field, tf_id AS value FROM long_id_tf_master UNION SELECT 'family', family FROM long_id_tf_master UNION SELECT 'paralog_group', paralog_group FROM long_id_tf_master)", ("long_id_tf_master",))
def index_maps(spark, sf):
    return E.index_maps(views.tf_master(spark, sf), ["tf_id", "family", "paralog_group"])


@query("example_targets", """SELECT seq_id, CAST(least(greatest(edge_gap,-4),20)+4 AS BIGINT) AS gap_bin, CASE orientation WHEN '++' THEN 0 WHEN '+-' THEN 1 WHEN '-+' THEN 2 ELSE 3 END::BIGINT AS orientation_bin, round(exp(-greatest(0,overlap_len-4)),6) AS compatibility, 96::BIGINT AS window_mass FROM anchored""", ("anchored",))
def example_targets(spark, sf):
    e = E.build_examples(views.anchored(spark, sf).drop("tile"))
    total = F.aggregate(F.flatten("window_one_hot"), F.lit(0.0), lambda a, x: a + x).cast("long")
    return rounded(e.select("seq_id", (F.array_position("spacing_target", 1.0) - 1).alias("gap_bin"), (F.array_position("orientation_target", 1.0) - 1).alias("orientation_bin"), "compatibility", total.alias("window_mass")))


@query("example_tensors")
def example_tensors(spark, sf):
    e = E.build_examples(views.anchored(spark, sf).drop("tile"))
    mass = lambda c: F.round(F.aggregate(F.flatten(c), F.lit(0.0), lambda a, x: a + x), 3)
    return e.select("seq_id", F.size("interface_tensor").alias("channels"), mass("interface_tensor").alias("plain"), mass("interface_tensor_shuffle").alias("shuffled"), mass("interface_tensor_core_rerandomized").alias("core"),
                    F.size("left_anchor_offsets").alias("offsets"))


_G19 = ["center_distance", "edge_gap", "overlap_len", "1.0"] + [f"{f}(center_distance*2*pi()*{k}/10.5)" for k in (1, 2) for f in ("sin", "cos")] + [f"greatest(1-abs(center_distance-({-4 + i * 24 / 7}))/3.0,0)" for i in range(8)] + ["0.0", "0.0", "0.0"]


@query("baseline_features", f"SELECT seq_id, round(center_distance,6) AS geom_0, round(list_avg(g),6) AS geom_mean, round(list_stddev_samp(g),6) AS geom_std FROM (SELECT *, [{', '.join(f'CAST({g} AS DOUBLE)' for g in _G19)}] AS g FROM anchored)", ("anchored",))
def baseline_features(spark, sf):
    a = views.anchored(spark, sf).select("seq_id", F.array(*geometry_vector("center_distance", "edge_gap", "overlap_len", "orientation")).alias("geometry_features"))
    return rounded(E.baseline_features(a))


_SF = "(SELECT state_label, min(chromosome) AS chromosome, min(CASE WHEN state_label LIKE '%1%' THEN 'pELS' ELSE 'TF' END) AS element_type, round(avg(length(bases)),4) AS width, count(*)::DOUBLE AS files, sum(length(bases))::DOUBLE AS total FROM sequences GROUP BY 1)"


@query("state_features", f"SELECT state_label, round((total-min(total) OVER ())/(max(total) OVER ()-min(total) OVER ()),6) AS availability_0, round(coalesce((files-min(files) OVER ())/nullif(max(files) OVER ()-min(files) OVER (),0),0),6) AS availability_1, round((width-min(width) OVER ())/(max(width) OVER ()-min(width) OVER ()),6) AS state_0, 0.5::DOUBLE AS state_1, 0.0::DOUBLE AS state_2, CASE WHEN element_type='pELS' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS state_3, CASE WHEN element_type='TF' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS state_8 FROM {_SF}", ("sequences",))
def state_features(spark, sf):
    s = views.sequences(spark, sf).groupBy("state_label").agg(
        F.min("chromosome").alias("chromosome"), F.min(F.when(F.col("state_label").contains("1"), "pELS").otherwise("TF")).alias("element_type"), F.lit(0.5).alias("gc_content"),
        F.round(F.avg(F.length("bases")), 4).alias("width"), F.count("*").alias("supporting_files"), F.sum(F.length("bases")).alias("total_fragment_count"))
    return rounded(E.state_features(s).select("state_label", "availability_0", "availability_1", "state_0", "state_1", "state_2", "state_3", "state_8"))


@query("one_hot_states", "SELECT state_label, k-1 AS state_index, CASE WHEN k<=16 THEN k-1 ELSE -1 END AS hot FROM (SELECT state_label, row_number() OVER (ORDER BY state_label) AS k FROM (SELECT DISTINCT state_label FROM windows))", ("windows",))
def one_hot_states(spark, sf):
    return E.one_hot_states(views.windows(spark, sf)).select("state_label", "state_index", (F.array_position("availability", 1.0) - 1).alias("hot"))


# ---- graph
def _tree(spark, sf, odd: bool):
    c = views.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("c"), "c_nationkey", "c_acctbal")
    n = views.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    cn = c.select(F.col("c").alias("left_tf"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("right_tf"))
    nr = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("left_tf"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("right_tf"))
    out = cn.unionByName(nr)
    if odd:
        tri = c.filter("c_acctbal < 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).filter("n_regionkey <> 1 AND n_regionkey <> 3")
        out = out.unionByName(tri.select(F.col("c").alias("left_tf"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("right_tf")))
    return out


_NODES = "(SELECT 'c'||c_custkey AS node, n_regionkey AS r FROM customer JOIN nation ON c_nationkey=n_nationkey UNION SELECT 'n'||n_nationkey, n_regionkey FROM nation UNION SELECT 'r'||n_regionkey, n_regionkey FROM nation)"


@query("connected_components", f"SELECT node, min(node) OVER (PARTITION BY r) AS component FROM {_NODES}")
def connected_components(spark, sf):
    return R.connected_components(_tree(spark, sf, False))


@query("odd_cycle_components", f"SELECT min(node) AS component, count(*) AS nodes, r NOT IN (1,3) AND r IN (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_acctbal<0) AS non_bipartite FROM {_NODES} GROUP BY r")
def odd_cycle_components(spark, sf):
    return R.identifiability_components(_tree(spark, sf, True))


@query("identifiability_audit", f"SELECT count(*) AS num_components, count(*) FILTER (nb) AS num_non_bipartite_components, bool_and(nb) AS joint_finetune_allowed FROM (SELECT r NOT IN (1,3) AND r IN (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_acctbal<0) AS nb FROM {_NODES} GROUP BY r)")
def identifiability_audit(spark, sf):
    return R.identifiability_audit(_tree(spark, sf, True))


@query("large_graph_components", """WITH RECURSIVE ed AS MATERIALIZED (SELECT '0|'||left_tf AS a, '1|'||right_tf AS b FROM wide_edges UNION SELECT '1|'||left_tf, '0|'||right_tf FROM wide_edges UNION SELECT '1|'||right_tf, '0|'||left_tf FROM wide_edges UNION SELECT '0|'||right_tf, '1|'||left_tf FROM wide_edges),
  cc(id, label) USING KEY (id) AS (SELECT a, min(least(a,b)) FROM ed GROUP BY a UNION SELECT ed.a, min(cc.label) FROM cc JOIN ed ON ed.b=cc.id JOIN recurring.cc AS u ON u.id=ed.a WHERE cc.label<u.label GROUP BY ed.a)
  SELECT component, count(*) AS nodes, bool_or(odd) AS non_bipartite FROM (SELECT substr(id,3) AS node, min(substr(label,3)) AS component, min(label)=max(label) AS odd FROM cc GROUP BY 1) GROUP BY 1""", ("wide_edges",))
def large_graph_components(spark, sf):
    return R.identifiability_components(views.wide_edges(spark, sf, repeated=True))  # components need no distinct edges


@query("reference_graph", "SELECT DISTINCT left_tf, right_tf FROM gene_pairs WHERE flag='A' AND left_tf IN (SELECT gene_symbol FROM tf_master WHERE family<>'') AND right_tf IN (SELECT gene_symbol FROM tf_master WHERE family<>'')", ("gene_pairs", "tf_master"))
def reference_graph(spark, sf):
    inv = views.gene_pairs(spark, sf).withColumn("pair_usable", F.col("flag") == "A")
    return R.reference_graph(inv, views.tf_master(spark, sf).filter("family <> ''"))

