"""Scalar-expression queries (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgrammar import schema, views
from pairgrammar.functions import geometry as G
from pairgrammar.functions import keys as K
from pairgrammar.functions import sequence as S
from pairgrammar.operators.joins import grid
from pairgrammar.queries.registry import query, r6, rounded


@query("pair_key", """SELECT least(left_tf,right_tf)||'::'||greatest(left_tf,right_tf) AS pair, count(*) AS n FROM gene_pairs GROUP BY 1""", ("gene_pairs",))
def pair_key(spark, sf):
    return views.gene_pairs(spark, sf).groupBy(K.pair_key("left_tf", "right_tf").alias("pair")).agg(F.count("*").alias("n"))


@query("split_pair_label", """SELECT l AS left_tf, r AS right_tf, count(*) AS n FROM (SELECT list_filter(string_split(p_name||'::'||p_brand||'::','::'), lambda x: x<>'') AS t, t[1] AS l, t[len(t)] AS r FROM part) GROUP BY 1,2""")
def split_pair_label(spark, sf):
    left, right = K.split_pair(F.concat("p_name", F.lit("::"), "p_brand", F.lit("::")))
    return views.table(spark, sf, "part").groupBy(left.alias("left_tf"), right.alias("right_tf")).agg(F.count("*").alias("n"))


def _curated(spark, sf):
    size = F.col("p_size")
    return views.table(spark, sf, "part").select(
        F.when(size % 3 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("_"), "p_type")).alias("hgnc_pair"),
        F.when(size % 4 == 0, "").otherwise(F.concat(F.lit("pre"), size.cast("string"))).alias("tf1_seq_prefix"), F.lit("P1").alias("tf1_plate"), F.lit("3u").alias("tf1_round"),
        F.when(size % 6 == 0, "").otherwise(F.concat(F.lit("q"), size.cast("string"))).alias("tf2_seq_prefix"), F.lit("P2").alias("tf2_plate"), F.lit("4u").alias("tf2_round"), F.col("p_partkey").alias("id"))


@query("curated_pair_sheet", """
  SELECT id, hgnc_pair, contains(hgnc_pair,'_') AS is_pair, string_split(hgnc_pair,'_')[1] AS left_tf, coalesce(string_split(hgnc_pair,'_')[2], string_split(hgnc_pair,'_')[1]) AS right_tf,
    pre||'P13u_sig.seq' AS left_seq_file, CASE WHEN p_size%6=0 THEN '' ELSE 'q'||p_size||'P24u_sig.seq' END AS right_seq_file
  FROM (SELECT p_partkey AS id, p_size, CASE WHEN p_size%3=0 THEN p_brand ELSE p_brand||'_'||p_type END AS hgnc_pair, CASE WHEN p_size%4=0 THEN '' ELSE 'pre'||p_size END AS pre FROM part)""")
def curated_pair_sheet(spark, sf):
    return K.parse_curated_pairs(_curated(spark, sf)).select("id", "hgnc_pair", "is_pair", "left_tf", "right_tf", "left_seq_file", "right_seq_file")


@query("batch_pair_sheet", """SELECT p_brand||'_'||p_type AS hgnc_pair, p_brand AS left_tf, p_type AS right_tf, 'BC'||p_partkey AS pair_seq_prefix, 'B'||(p_size%7) AS pair_plate, 'BC'||p_partkey||'B'||(p_size%7)||'3u_sig.seq' AS pair_seq_file FROM part""")
def batch_pair_sheet(spark, sf):
    raw = views.table(spark, sf, "part").select(
        F.concat("p_brand", F.lit("_"), "p_type").alias("HGNC"), F.concat(F.lit("BC"), F.col("p_partkey").cast("string")).alias("Barcode"),
        F.concat(F.lit("B"), (F.col("p_size") % 7).cast("string")).alias("Batch"))
    return K.parse_batch_pairs(raw)


@query("regex_extraction", """SELECT p_partkey, CAST(nullif(regexp_extract(p_size||'-'||p_type,'^\\s*(-?\\d+)',1),'') AS BIGINT) AS code, CASE WHEN p_size%4=0 THEN p_type ELSE p_type END AS platform, CASE WHEN p_size%4=0 THEN '' ELSE p_brand||'_x' END AS reference, CAST(nullif(regexp_extract(p_brand,'(\\d+)$',1),'') AS BIGINT) AS tag FROM part""")
def regex_extraction(spark, sf):
    platform, ref = K.platform_reference(F.when(F.col("p_size") % 4 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit("_"), "p_brand", F.lit("_x"))))
    return views.table(spark, sf, "part").select(
        "p_partkey", K.leading_code(F.concat(F.col("p_size").cast("string"), F.lit("-"), "p_type")).cast("long").alias("code"), platform.alias("platform"), ref.alias("reference"),
        K.trailing_number("p_brand").cast("long").alias("tag"))


@query("effect_payload", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, effect, p_value, CASE WHEN effect<0 THEN 'activating' WHEN effect>0 THEN 'repressive' ELSE '' END AS direction FROM (
    SELECT *, TRY_CAST(CASE WHEN len(t)>=3 THEN t[len(t)-1] END AS DOUBLE) AS effect, TRY_CAST(CASE WHEN len(t)>=3 THEN t[len(t)] END AS DOUBLE) AS p_value FROM (
      SELECT *, string_split(CASE WHEN l_linenumber=7 THEN 'bad' ELSE 'guide_x_'||(l_partkey%9-4)||'_0.'||l_suppkey END,'_') AS t FROM lineitem))""")
def effect_payload(spark, sf):
    text = F.when(F.col("l_linenumber") == 7, "bad").otherwise(F.concat(
        F.lit("guide_x_"), (F.col("l_partkey") % 9 - 4).cast("string"), F.lit("_0."), F.col("l_suppkey").cast("string")))
    effect, p = K.parse_effect("t")
    li = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("t"))
    return li.select("l_orderkey", F.col("l_linenumber"), "l_partkey", "l_suppkey", effect.alias("effect"), p.alias("p_value"), K.direction(effect).alias("direction"))


@query("canonical_biosample", """SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%bolt%' THEN 'BOLT' WHEN lower(p_name) LIKE '%red%' THEN 'Red' WHEN lower(p_name) LIKE '%ring%' THEN 'RING' ELSE 'other' END AS canonical,
  (CASE WHEN lower(p_name) LIKE '%bolt%' THEN 'BOLT' WHEN lower(p_name) LIKE '%red%' THEN 'Red' WHEN lower(p_name) LIKE '%ring%' THEN 'RING' ELSE 'other' END)||'::'||p_brand||'::'||p_type AS registry_id FROM part""")
def canonical_biosample(spark, sf):
    c = K.canonical_biosample("p_name", ["RING", "Red", "BOLT"])
    return views.table(spark, sf, "part").select("p_partkey", c.alias("canonical"), F.concat_ws("::", c, "p_brand", "p_type").alias("registry_id"))


@query("control_flags", """SELECT element_group, starts_with(name,'ENSG') OR name='no_BC' AS is_control, count(*) AS n FROM replicates GROUP BY 1,2""", ("replicates",))
def control_flags(spark, sf):
    return views.replicates(spark, sf).groupBy(K.strip_reverse("name").alias("element_group"), K.is_control("name").alias("is_control")).agg(F.count("*").alias("n"))


@query("stable_slug", """SELECT s AS slug, count(*) AS n FROM (SELECT CASE WHEN t='' THEN 'default' ELSE t END AS s FROM (SELECT lower(regexp_replace(regexp_replace(substr(text,1,length(text)),'[^A-Za-z0-9._-]+','-','g'),'^-+|-+$','','g')) AS t FROM documents)) GROUP BY 1""")
def stable_slug(spark, sf):
    return K.text_slugs(views.table(spark, sf, "documents"), "text").groupBy("slug").agg(F.count("*").alias("n"))


@query("region_labels", """SELECT region_id, chromosome||':'||region_start||'-'||region_end AS label, chromosome AS chrom, region_start AS p_start, region_end AS p_end FROM regions""", ("regions",))
def region_labels(spark, sf):
    lab = views.regions(spark, sf).select("region_id", K.format_region("chromosome", "region_start", "region_end").alias("label"))
    c, s, e = K.parse_region("label")
    return lab.select("region_id", "label", c.alias("chrom"), s.alias("p_start"), e.alias("p_end"))


@query("centered_windows", """SELECT region_id, greatest((region_start+region_end)//2-48,0) AS w_start, greatest((region_start+region_end)//2-48,0)+96 AS w_end FROM regions""", ("regions",))
def centered_windows(spark, sf):
    a, b = S.centered_window("region_start", "region_end", 96)
    return views.regions(spark, sf).select("region_id", a.alias("w_start"), b.alias("w_end"))


@query("pad_or_crop", f"""SELECT seq_id, {views.sql_pad('bases')} AS win, {views.sql_pad('bases', 4001)} AS odd_win FROM sequences""", ("sequences",))
def pad_or_crop(spark, sf):
    return views.sequences(spark, sf).select("seq_id", S.pad_or_crop("bases", 96).alias("win"), S.pad_or_crop("bases", 4001).alias("odd_win"))


@query("clean_sequence", f"""
  SELECT seq_id, {views.sql_pad("upper(substr(s, CAST(st+1 AS INT), 96))")} AS cleaned FROM (
    SELECT seq_id, s, CASE WHEN st0+96 > n THEN greatest(0, n-96) ELSE st0 END AS st FROM (
      SELECT seq_id, s, n, CASE WHEN f>0 THEN greatest(0, (f-1+n-rf+1)//2-48) ELSE greatest(0,(n-96)//2) END AS st0 FROM (
        SELECT seq_id, s, length(s) AS n, coalesce(nullif(length(regexp_extract(s,'^[^ACGTN]*[ACGTN]')),0),0) AS f, coalesce(nullif(length(regexp_extract(reverse(s),'^[^ACGTN]*[ACGTN]')),0),0) AS rf FROM (
          SELECT seq_id, regexp_replace(trim(raw_bases),'[^ACGTNacgtn]','N','g') AS s FROM sequences))))""", ("sequences",))
def clean_sequence(spark, sf):
    return views.sequences(spark, sf).select("seq_id", S.clean_sequence("raw_bases", 96).alias("cleaned"))


@query("reverse_complement", "SELECT seq_id, reverse(translate(bases,'ACGTN','TGCAN')) AS rc FROM sequences", ("sequences",))
def reverse_complement(spark, sf):
    return views.sequences(spark, sf).select("seq_id", S.reverse_complement("bases").alias("rc"))


@query("gc_content", "SELECT seq_id, round((length(bases)-length(replace(replace(bases,'G',''),'C','')))/greatest(length(bases),1),6) AS gc FROM sequences", ("sequences",))
def gc_content(spark, sf):
    return views.sequences(spark, sf).select("seq_id", r6(S.gc_content("bases"), "gc"))


@query("offset_windows", """
  SELECT seq_id, off AS "offset", substr(repeat('N',24)||sequence||repeat('N',24), CAST((left_start+left_end)//2+off-12+24+1 AS INT), 24) AS offset_window FROM (SELECT *, unnest([-2,-1,0,1,2]) AS off FROM anchored)""", ("anchored",))
def offset_windows(spark, sf):
    return S.offset_windows(views.anchored(spark, sf), "left_start", "left_end").select("seq_id", F.col("offset").cast("long").alias("offset"), "offset_window")


@query("embed_motif", """SELECT seq_id, substr(sequence,1,CAST(left_start AS INT))||'ACGTACGT'||substr(sequence,CAST(left_start+9 AS INT)) AS embedded FROM anchored""", ("anchored",))
def embed_motif(spark, sf):
    return views.anchored(spark, sf).select("seq_id", S.embed("sequence", F.lit("ACGTACGT"), "left_start").alias("embedded"))


@query("one_hot", """SELECT seq_id, c AS channel, sum(CASE WHEN substr(sequence, CAST(p AS INT),1)=substr('ACGTN',CAST(c+1 AS INT),1) THEN p ELSE 0 END)::BIGINT AS mass FROM windows, (SELECT unnest(range(0,5)) AS c), (SELECT unnest(range(1,97)) AS p) GROUP BY 1,2""", ("windows",))
def one_hot(spark, sf):
    hot = views.windows(spark, sf).select("seq_id", F.posexplode(S.one_hot("sequence")).alias("channel", "track"))
    weighted = F.aggregate(F.transform("track", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return hot.select("seq_id", F.col("channel").cast("long").alias("channel"), weighted.cast("long").alias("mass"))


_ROLL = "CASE pair " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in schema.ROLL.items()) + " ELSE 0 END"


@query("shape_tracks", f"""
  WITH chars AS (SELECT seq_id, sequence, length(sequence) AS n, unnest(range(0,length(sequence))) AS p FROM windows),
  raw AS (SELECT seq_id, p, (length(loc)-length(replace(replace(loc,'A',''),'T','')))/greatest(length(replace(loc,'N','')),1)::DOUBLE AS mgw,
      (length(loc)-length(replace(replace(loc,'C',''),'G','')))/greatest(length(replace(loc,'N','')),1)::DOUBLE AS helt, CAST({_ROLL} AS DOUBLE) AS roll,
      CASE WHEN regexp_matches(pair,'^[CT][AG]$') THEN 1.0::DOUBLE WHEN regexp_matches(pair,'^[AG][CT]$') THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS prot
    FROM (SELECT seq_id, p, substr(sequence, CAST(greatest(0,p-2)+1 AS INT), CAST(least(n,p+3)-greatest(0,p-2) AS INT)) AS loc, substr(sequence, CAST(CASE WHEN p<n-1 THEN p+1 ELSE p END AS INT), 2) AS pair FROM chars))
  SELECT seq_id, p AS position, round((mgw-avg(mgw) OVER w)/greatest(stddev_pop(mgw) OVER w,1e-6),4) AS mgw, round((roll-avg(roll) OVER w)/greatest(stddev_pop(roll) OVER w,1e-6),4) AS roll,
    round((prot-avg(prot) OVER w)/greatest(stddev_pop(prot) OVER w,1e-6),4) AS prot, round((helt-avg(helt) OVER w)/greatest(stddev_pop(helt) OVER w,1e-6),4) AS helt FROM raw WINDOW w AS (PARTITION BY seq_id)""", ("windows",))
def shape_tracks(spark, sf):
    t = views.windows(spark, sf).select("seq_id", S.shape_tracks("sequence").alias("t"))
    t = t.select("seq_id", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(95)).alias("p"), F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"), F.col("t")[3].alias("d"))).alias("z"))
    return t.select("seq_id", F.col("z.p").cast("long").alias("position"), *[(F.round(F.col(f"z.{k}"), 4) + F.lit(0.0)).alias(n) for k, n in zip("abcd", ("mgw", "roll", "prot", "helt"))])


_PI = "pi()"
_GEOM = (["center_distance", "edge_gap", "overlap_len"] + [f"CASE WHEN orientation='{o}' THEN 1.0 ELSE 0.0 END" for o in schema.ORIENTATIONS]
         + [f"{f}(center_distance*2*{_PI}*{k}/10.5)" for k in (1, 2) for f in ("sin", "cos")] + [f"greatest(1-abs(center_distance-({-4 + i * 24 / 7}))/3.0,0)" for i in range(8)])


@query("helical_basis", "SELECT seq_id, " + ", ".join(f"round({_GEOM[7 + i]},6) AS h{i}" for i in range(4)) + " FROM anchored", ("anchored",))
def helical_basis(spark, sf):
    return rounded(views.anchored(spark, sf).select("seq_id", *[c.alias(f"h{i}") for i, c in enumerate(G.helical_basis("center_distance"))]))


@query("spline_basis", "SELECT seq_id, " + ", ".join(f"round(CAST({_GEOM[11 + i]} AS DOUBLE),6) AS s{i}" for i in range(8)) + " FROM anchored", ("anchored",))
def spline_basis(spark, sf):
    return rounded(views.anchored(spark, sf).select("seq_id", *[c.alias(f"s{i}") for i, c in enumerate(G.spline_basis("center_distance"))]))


@query("geometry_features", "SELECT seq_id, seq_id||'::p' AS pair_id, " + ", ".join(f"round(CAST({g} AS DOUBLE),6) AS geom_{i}" for i, g in enumerate(_GEOM)) + " FROM anchored", ("anchored",))
def geometry_features(spark, sf):
    return rounded(G.geometry_features(views.anchored(spark, sf).withColumn("pair_id", F.concat("seq_id", F.lit("::p")))))


@query("gap_one_hot", "SELECT idx AS bin, count(*) AS n, count(*) AS mass FROM (SELECT least(greatest(CAST(round_even(gap,0) AS BIGINT),-4),20)+4 AS idx FROM (SELECT edge_gap + l_quantity*0.5 - 12 AS gap FROM (SELECT CAST(l_linenumber AS DOUBLE) AS edge_gap, l_quantity FROM lineitem))) GROUP BY 1")
def gap_one_hot(spark, sf):
    gap = F.col("l_linenumber") + F.col("l_quantity") * 0.5 - 12
    rows = views.table(spark, sf, "lineitem").select(G.gap_index(gap).cast("long").alias("bin"), G.gap_one_hot(gap).alias("hot"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.get("hot", F.col("bin").cast("int"))).cast("long").alias("mass"))


@query("pair_geometry", "SELECT seq_id, orientation, center_distance, edge_gap, overlap_len, coarse_additive_score, round(exp(-greatest(0,overlap_len-4)),6) AS compatibility FROM anchored", ("anchored",))
def pair_geometry(spark, sf):
    a = views.anchored(spark, sf).withColumns({"ls": F.substring("orientation", 1, 1), "rs": F.substring("orientation", 2, 1), "z": F.lit(0.0)})
    g = G.pair_geometry({"start": "left_start", "end": "left_end", "strand": "ls", "score": "coarse_additive_score"}, {"start": "right_start", "end": "right_end", "strand": "rs", "score": "z"})
    out = a.select("seq_id", *[c.alias(n) for n, c in g.items()])
    return rounded(out.withColumn("compatibility", G.compatibility("overlap_len")))


@query("interface_bounds", """SELECT seq_id, greatest(CASE WHEN hi>lo THEN lo ELSE least(left_end,right_start) END-4,0) AS i_start, CASE WHEN hi>lo THEN hi ELSE greatest(left_end,right_start) END+4 AS i_end FROM (SELECT *, greatest(left_start,right_start) AS lo, least(left_end,right_end) AS hi FROM anchored)""", ("anchored",))
def interface_bounds(spark, sf):
    a, b = S.interface_bounds("left_start", "left_end", "right_start", "right_end")
    return views.anchored(spark, sf).select("seq_id", a.alias("i_start"), b.alias("i_end"))


@query("region_masks", """
  SELECT seq_id, m AS mask, count(*) FILTER (p>=a AND p<b) AS ones, coalesce(sum(p) FILTER (p>=a AND p<b),0)::BIGINT AS centre FROM (
    SELECT seq_id, m, CASE m WHEN 0 THEN greatest(left_start,right_start) WHEN 1 THEN least(left_end,right_end) WHEN 2 THEN greatest(left_end-4,left_start) ELSE right_start END AS a,
      CASE m WHEN 0 THEN least(left_end,right_end) WHEN 1 THEN greatest(left_start,right_start) WHEN 2 THEN left_end ELSE least(right_start+4,right_end) END AS b FROM anchored, (SELECT unnest(range(0,4)) AS m)),
    (SELECT unnest(range(0,96)) AS p) GROUP BY 1,2""", ("anchored",))
def region_masks(spark, sf):
    m = views.anchored(spark, sf).select("seq_id", F.posexplode(S.region_masks("left_start", "left_end", "right_start", "right_end")).alias("mask", "t"))
    total = F.aggregate("t", F.lit(0.0), lambda a, x: a + x).cast("long")
    centre = F.aggregate(F.transform("t", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x).cast("long")
    return m.select("seq_id", F.col("mask").cast("long").alias("mask"), total.alias("ones"), centre.alias("centre"))


@query("interface_tensor", """
  SELECT seq_id, c AS channel, coalesce(sum(p) FILTER (substr(sequence,CAST(p+1 AS INT),1)=substr('ACGTN',CAST(c+1 AS INT),1) AND NOT ((p>=left_start AND p<e1) OR (p>=s2 AND p<right_end))),0)::BIGINT AS mass FROM (
    SELECT *, CASE WHEN right_start>=left_end THEN left_end ELSE greatest(left_start,right_start) END AS e1, CASE WHEN right_start>=left_end THEN right_start ELSE least(left_end,right_end) END AS s2 FROM anchored),
    (SELECT unnest(range(0,5)) AS c), (SELECT unnest(range(0,96)) AS p) GROUP BY 1,2""", ("anchored",))
def interface_tensor(spark, sf):
    t = views.anchored(spark, sf).select("seq_id", F.slice(S.interface_tensor("sequence", "left_start", "left_end", "right_start", "right_end"), 1, 5).alias("t"))
    t = t.select("seq_id", F.posexplode("t").alias("channel", "track"))
    mass = F.aggregate(F.transform("track", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return t.select("seq_id", F.col("channel").cast("long").alias("channel"), mass.cast("long").alias("mass"))


@query("coalesce_nonblank", "SELECT tf_id, coalesce(nullif(family,''),nullif(paralog_group,''),nullif(subfamily,''),'') AS family FROM long_id_tf_master", ("long_id_tf_master",))
def coalesce_nonblank(spark, sf):
    return views.tf_master(spark, sf).select("tf_id", K.coalesce_nonblank("family", "paralog_group", "subfamily").alias("family"))


@query("derive_labels", """SELECT seq_id, CASE WHEN full_score>0.5 THEN label END AS label, CASE WHEN composite_label>0 THEN 'phase5' ELSE 'phase4' END AS phase, tf_pair_label AS split_group, 0.0::DOUBLE AS composite_label, 'state_layer' AS source_dataset FROM predictions""", ("predictions",))
def derive_labels(spark, sf):
    base = views.predictions(spark, sf).select("seq_id", "tf_pair_label", F.when(F.col("full_score") > 0.5, F.col("label")).alias("usage_label"), F.col("composite_label").alias("functional_label"))
    return K.derive_labels(base).select("seq_id", "label", "phase", "split_group", "composite_label", "source_dataset")


@query("vector_columns", "SELECT vec_id, " + ", ".join(f"round(coalesce(CASE WHEN {i}<>3 AND {i}<4 THEN availability[{i + 1}] END,0),6) AS a_{i}" for i in range(6)) + " FROM states", ("states",))
def vector_columns(spark, sf):
    wide = K.unpack_vector(views.states(spark, sf).select("vec_id", "availability"), "availability", "availability", 16)
    packed = K.pack_vector(wide.select("vec_id", "availability_0", "availability_1", "availability_2"), "availability", 6, "v")
    return rounded(K.unpack_vector(packed, "v", "a", 6))


@query("imputed_filter", "SELECT phase, count(*) FILTER (construction_mode LIKE 'imputed%') AS excluded, count(*) FILTER (construction_mode NOT LIKE 'imputed%') AS kept, count(*) FILTER (left_tf=right_tf OR label<=0) AS calibration FROM windows GROUP BY 1", ("windows",))
def imputed_filter(spark, sf):
    w = views.windows(spark, sf)
    cal = K.calibration_set(w).groupBy("phase").agg(F.count("*").alias("calibration"))
    return K.imputed_counts(w).join(cal, "phase", "left")


@query("numeric_coercion", """SELECT sum(coalesce(v,0))::DOUBLE AS total, count(v) AS parsed, count(*) AS n FROM (SELECT TRY_CAST(CASE WHEN event_type='click' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS v FROM events)""")
def numeric_coercion(spark, sf):
    text = F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("user_id").cast("string"))
    return views.table(spark, sf, "events").select(K.to_numeric(text).alias("v")).agg(F.sum(F.coalesce("v", F.lit(0.0))).alias("total"), F.count("v").alias("parsed"), F.count("*").alias("n"))


@query("hash_keys", f"""SELECT seq_id, {views._b('seq_id', 1000)} AS bucket, {views.sql_rank('seq_id', 'chromosome')} AS rank, 'kmer::'||substr(sha256(substr(sequence,1,32)),1,12) AS prefix FROM windows""", ("windows",))
def hash_keys(spark, sf):
    return views.windows(spark, sf).select("seq_id", K.hash_bucket("seq_id", 1000).alias("bucket"), K.hash_rank("seq_id", "chromosome").alias("rank"), K.prefix_group("sequence").alias("prefix"))


@query("symbol_mapping", "SELECT event_id, gene_symbol AS left_tf FROM (SELECT event_id, CASE WHEN upper('G'||(user_id*3))='G30' THEN 'G31' ELSE upper('G'||(user_id*3)) END AS k FROM events) e JOIN tf_master t ON upper(t.gene_symbol)=e.k", ("tf_master",))
def symbol_mapping(spark, sf):
    ev = views.table(spark, sf, "events").select("event_id", F.concat(F.lit("G"), (F.col("user_id") * 3).cast("string")).alias("sym"))
    return K.map_symbols(ev, views.tf_master(spark, sf), "sym", "left_tf", {"G30": "G31"}).select("event_id", "left_tf")


@query("prediction_labels", """SELECT seq_id, state_label AS state_token, round(full_score-availability_only_score,6) AS delta_availability, round(full_score-additive_null_score,6) AS delta_additive,
  (CASE WHEN full_score-availability_only_score>=0 THEN 'gain' ELSE 'loss' END)||'_'||(CASE WHEN label>0.5 THEN 'positive' ELSE 'negative' END) AS gain_group FROM predictions""", ("predictions",))
def prediction_labels(spark, sf):
    return rounded(K.prediction_projections(views.predictions(spark, sf)).select("seq_id", "state_token", "delta_availability", "delta_additive", "gain_group"))


@query("literal_grid", "SELECT gap, split_name, count(*) AS n FROM predictions_small, (SELECT unnest([-4,0,6,12,20]) AS gap), (SELECT unnest(['default','unseen_pair']) AS split_name) GROUP BY 1,2".replace("predictions_small", "(SELECT seq_id FROM predictions)"), ("predictions",))
def literal_grid(spark, sf):
    return grid(views.predictions(spark, sf).select("seq_id"), gap=[-4, 0, 6, 12, 20], split_name=["default", "unseen_pair"]).groupBy(F.col("gap").cast("long").alias("gap"), "split_name").agg(F.count("*").alias("n"))


@query("run_names", """SELECT p_partkey, p_brand||'_'||p_type AS pair_name, least(p_brand,p_type)||'::'||greatest(p_brand,p_type) AS pair_key, (p_size%5)::BIGINT AS round_index, (p_size%5)||'u' AS round_label, 'PL1' AS plate, 'S'||p_partkey AS seq_prefix, 'S'||p_partkey||'PL1'||(p_size%5)||'u_sig.seq' AS sig_file_name FROM part WHERE p_size%10<>0""")
def run_names(spark, sf):
    return _run_names(spark, sf)[0].select("p_partkey", "pair_name", "pair_key", F.col("round_index").cast("long").alias("round_index"), "round_label", "plate", "seq_prefix", "sig_file_name")


def _run_names(spark, sf):
    """Run names of every part; sizes divisible by ten get a malformed round."""
    rnd = F.when(F.col("p_size") % 10 == 0, "x").otherwise((F.col("p_size") % 5).cast("string"))
    name = F.concat_ws("_", "p_brand", "p_type", rnd, F.lit("PL1"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")))
    return K.parse_run_names(views.table(spark, sf, "part").select("p_partkey", F.concat(name, F.lit(".fastq.gz")).alias("file_name")))


@query("malformed_run_names", "SELECT p_partkey FROM part WHERE p_size%10=0")
def malformed_run_names(spark, sf):
    return _run_names(spark, sf)[1].select("p_partkey")


@query("download_urls", """SELECT page_id, CASE WHEN page_id%3=0 THEN '' WHEN page_id%3=1 THEN 'https://'||regexp_replace(url,'^https?://','') ELSE url END AS u, CASE WHEN page_id%2=0 THEN 'run'||page_id||'.fastq.gz' ELSE 'x'||page_id||'.bam' END AS f FROM pages""")
def download_urls(spark, sf):
    bare = F.regexp_replace("url", "^https?://", "")
    raw = F.when(F.col("page_id") % 3 == 0, " ").when(F.col("page_id") % 3 == 1, F.concat(F.lit("ftp://"), bare)).otherwise(F.col("url"))
    sub = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("ftp/a/x"), F.col("page_id").cast("string"), F.lit(".bam")))
    title = F.concat(F.lit("Raw reads: run"), F.col("page_id").cast("string"))
    p = views.table(spark, sf, "pages").select("page_id", "url", raw.alias("raw"), sub.alias("sub"), title.alias("title"))
    return p.select("page_id", K.download_url("raw").alias("u"), K.run_file_name("sub", F.lit(""), "title").alias("f"))
