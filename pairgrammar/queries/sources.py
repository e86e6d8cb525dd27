"""Source, sink and streaming queries (A, M): tables are written as files and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pairgrammar import schema, views
from pairgrammar.operators import intervals as N
from pairgrammar.operators.motifs import store_library
from pairgrammar.operators.selection import sample_regions
from pairgrammar.plans import states as S
from pairgrammar.queries.motifs import _CAND
from pairgrammar.queries.plans import _ledger
from pairgrammar.queries.registry import query, rounded
from pairgrammar.session import materialize, scratch_path
from pairgrammar.sources import blocks
from pairgrammar.sources import genomics as B
from pairgrammar.sources import tables as T
from pairgrammar.streaming import jobs as J


def _text(spark, df, name: str) -> str:
    path = scratch_path(spark, name)
    df.write.text(path)
    return path


def _tabs(*cols):
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]).alias("value")


@query("table_roundtrip", "SELECT phase, count(*) AS n, sum(label) AS positives FROM windows GROUP BY 1", ("windows",))
def table_roundtrip(spark, sf):
    w = views.windows(spark, sf).select("seq_id", "phase", "label")
    tsv, pq = scratch_path(spark, "t") + ".tsv", scratch_path(spark, "t") + ".parquet"
    T.write_table(w.filter("phase = 'phase1'"), tsv)
    T.write_table(w.filter("phase <> 'phase1'"), pq)
    both = T.read_table(spark, "/nowhere.tsv", tsv, schema=w.schema).unionByName(T.read_table(spark, pq))
    return both.groupBy("phase").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


_CH = "'chr'||(list_position(['click','error','purchase','signup','view'],chromosome))"


def _std(df):
    """Event types as chromosome names chr1..chr5 in alphabetical order (chr0 for any other)."""
    order = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    return df.withColumn("chromosome", F.concat(F.lit("chr"), F.array_position(order, F.col("chromosome")).cast("string")))


def _bed_path(spark, sf):
    r = _std(views.regions(spark, sf))
    lines = r.select(_tabs("chromosome", "region_start", "region_end", "screen_id", "encode_id", "element_type"))
    junk = r.select(_tabs("chromosome", "region_end", "region_start", F.lit("bad"), F.lit("bad"), F.lit("CA"))).unionByName(r.select(F.concat(F.lit("#"), "region_id").alias("value")))
    return _text(spark, lines.unionByName(junk).unionByName(lines), "bed")


@query("read_bed", f"SELECT {_CH}||':'||region_start||'-'||region_end AS state_label, element_type, screen_id FROM regions WHERE list_position(['click','error','purchase','signup','view'],chromosome)>0", ("regions",))
def read_bed(spark, sf):
    return B.read_bed(spark, _bed_path(spark, sf)).select("state_label", "element_type", "screen_id")


@query("read_fragments", 'SELECT chromosome, count(*) AS n, sum("end"-start)::BIGINT AS bases FROM fragments WHERE "end">start GROUP BY 1', ("fragments",))
def read_fragments(spark, sf):
    f = views.fragments(spark, sf)
    path = scratch_path(spark, "frag")
    f.select(_tabs("chromosome", "start", "end", "file_id")).unionByName(f.limit(5).select(F.lit("broken line").alias("value"))).write.option("compression", "gzip").text(path)
    return B.read_fragments(spark, path).groupBy("chromosome").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


@query("fragment_blocks", 'SELECT chromosome, count(*) AS n, sum("end"-start)::BIGINT AS bases FROM fragments WHERE "end">start GROUP BY 1', ("fragments",))
def fragment_blocks(spark, sf):
    """Block-compressed files, one an Arrow batch and named by its place."""
    def packed(batches):
        from pyspark import TaskContext
        for i, pdf in enumerate(batches):
            text = "\n".join(pdf["value"]) + "\n"
            yield pd.DataFrame({"name": [f"{TaskContext.get().partitionId()}-{i}.tsv.gz"], "content": [blocks.compressed_blocks(text.encode())]})

    f = views.fragments(spark, sf).select(_tabs("chromosome", "start", "end", "file_id"))
    path = scratch_path(spark, "blocks")
    blocks.write_files(f.mapInPandas(packed, "name string, content binary"), path)
    return B.read_fragments(spark, path, blocks=True).groupBy("chromosome").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


@query("fragment_budget", "SELECT file_id, least(count(*),2000) AS n FROM fragments WHERE \"end\">start AND chromosome IN (SELECT chromosome FROM regions WHERE chromosome<>'view') GROUP BY 1", ("fragments", "regions"))
def fragment_budget(spark, sf):
    """A file a sample; the files of different folders may share their names."""
    path = scratch_path(spark, "frag")
    views.fragments(spark, sf).select("file_id", _tabs("chromosome", "start", "end")).repartition("file_id").write.partitionBy("file_id").text(path)
    rows = B.read_fragments(spark, path, max_lines=2000, regions=views.regions(spark, sf).filter("chromosome <> 'view'"))
    return rows.groupBy(F.regexp_extract("file_path", r"file_id=(\d+)", 1).cast("long").alias("file_id")).agg(F.count("*").alias("n"))


@query("read_mpra_bed", "SELECT element_group, CASE WHEN is_reverse THEN 'reverse_construct' ELSE 'forward_construct' END AS orientation_mode, count(*) AS n, round(sum(activity_score),6) AS activity, 200::BIGINT AS element_width FROM replicates GROUP BY 1,2", ("replicates",))
def read_mpra_bed(spark, sf):
    r = views.replicates(spark, sf)
    path = _text(spark, r.select(_tabs("chromosome", "region_start", "region_end", "name", F.lit("0"), F.lit("+"), "activity_score", *[F.lit("NA")] * 4)), "mpra")
    m = B.read_mpra_bed(spark, path, "ds", "K562")
    return rounded(m.groupBy("element_group", "orientation_mode").agg(F.count("*").alias("n"), F.sum("activity_score").alias("activity"), F.max("element_width").alias("element_width")))


@query("read_perturbation_bed", "SELECT 'e'||l_partkey AS enhancer_id, 'K562 cell' AS biosample_label, 'g'||l_suppkey AS target_gene, CASE WHEN l_linenumber%2=0 THEN 'CRISPRi' ELSE 'CRISPRi' END AS perturbation_platform, CASE WHEN l_linenumber%2=0 THEN 'PMID_'||l_linenumber ELSE '' END AS reference_token, count(*) AS n FROM lineitem GROUP BY ALL")
def read_perturbation_bed(spark, sf):
    li = views.table(spark, sf, "lineitem")
    locus = F.concat(F.lit("e"), F.col("l_partkey").cast("string"), F.lit("_K562_cell_g"), F.col("l_suppkey").cast("string"))
    ev = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("CRISPRi_PMID_"), F.col("l_linenumber").cast("string"))).otherwise("CRISPRi")
    lines = li.select(_tabs(F.lit("chr1"), F.col("l_partkey").cast("string"), (F.col("l_partkey") + 10).cast("string"), locus, F.lit("g_0.1_0.01"), ev))
    p = B.read_perturbation_bed(spark, _text(spark, lines.unionByName(spark.range(1).select(F.lit("track name=x").alias("value"))), "pert"))
    return p.groupBy("enhancer_id", "biosample_label", "target_gene", "perturbation_platform", "reference_token").agg(F.count("*").alias("n"))


@query("read_sequence_lines", "SELECT chromosome, row_number() OVER (PARTITION BY chromosome ORDER BY doc_id, tile)-1 AS seq_index, sequence FROM windows", ("windows",))
def read_sequence_lines(spark, sf):
    """A file a chromosome; the files of different folders may share their names."""
    w = views.windows(spark, sf).select("chromosome", "doc_id", "tile", "sequence").repartition("chromosome").sortWithinPartitions("chromosome", "doc_id", "tile")
    path = scratch_path(spark, "seq")
    w.select("chromosome", F.concat(F.lit(" "), F.lower("sequence"), F.when(F.col("tile") == 0, "\n").otherwise("")).alias("value")).write.partitionBy("chromosome").text(path)
    return B.read_sequence_lines(spark, path).select(F.regexp_extract("sequence_path", "chromosome=([^/]+)", 1).alias("chromosome"), "seq_index", "sequence")


def _motif_text(spark, sf, pcm: bool):
    rows = views.motif_positions(spark, sf).groupBy("motif_id").agg(F.array_sort(F.collect_list(F.struct("position", *"ACGT"))).alias("p"))
    if pcm:
        body = F.array_join(F.transform("p", lambda p: F.concat_ws("\t", *[p[b].cast("string") for b in "ACGT"])), "\n")
        return rows.select(F.concat(F.lit(">"), "motif_id", F.lit("\n"), body).alias("value"))
    line = lambda b: F.concat(F.lit(f"{b}  [ "), F.array_join(F.transform("p", lambda p: p[b].cast("string")), " "), F.lit(" ]"))
    return rows.select(F.concat(F.lit(">"), "motif_id", F.lit("\t"), F.lower("motif_id"), F.lit("\n"), F.array_join(F.array(*[line(b) for b in "ACGT"]), "\n")).alias("value"))


@query("read_motifs_base_rows", 'SELECT motif_id, position, A AS "A", C AS "C", G AS "G", T AS "T" FROM motif_positions', ("motif_positions",))
def read_motifs_base_rows(spark, sf):
    _, pos = B.read_motifs(spark, _text(spark, _motif_text(spark, sf, False), "jaspar"), "jaspar", "J")
    return rounded(pos.drop("motif_source"))


@query("read_motifs_position_rows", "SELECT motif_id, count(*) AS model_length, 'pcm' AS matrix_format FROM motif_positions GROUP BY 1", ("motif_positions",))
def read_motifs_position_rows(spark, sf):
    prof, _ = B.read_motifs(spark, _text(spark, _motif_text(spark, sf, True), "pcm"), "pcm", "H")
    return prof.select("motif_id", "model_length", "matrix_format")


@query("read_motif_archives", 'SELECT motif_id, position, A AS "A", C AS "C", G AS "G", T AS "T" FROM motif_positions', ("motif_positions",))
def read_motif_archives(spark, sf):
    """Zip archives of one member a motif, made by the tasks that hold the motifs, each a file named by its digest."""
    def archives(batches):
        import hashlib
        import io
        import zipfile
        for pdf in batches:
            blob = io.BytesIO()
            with zipfile.ZipFile(blob, "w") as z:
                for i, text in enumerate(pdf["value"]):
                    z.writestr(f"m{i}.jaspar", text)
                z.writestr("readme.txt", "none")
            name = hashlib.sha256("".join(pdf["value"]).encode()).hexdigest()
            yield pd.DataFrame({"name": [f"{name}.zip"], "content": [blob.getvalue()]})

    path = scratch_path(spark, "zip")
    blocks.write_files(_motif_text(spark, sf, False).mapInPandas(archives, "name string, content binary"), path)
    return rounded(B.read_motif_archives(spark, path, "J")[1].drop("motif_source"))


@query("ledger_roundtrip", "SELECT event_type AS phase, count(*) AS n, round(sum(value),4) AS auprc FROM events GROUP BY 1")
def ledger_roundtrip(spark, sf):
    path = scratch_path(spark, "ledger")
    led = _ledger(spark, sf)
    T.append_ledger(led.filter("seed = 0"), path)
    T.append_ledger(led.filter("seed <> 0"), path)
    return T.read_ledger(spark, path).groupBy("phase").agg(F.count("*").alias("n"), F.round(F.sum(F.try_element_at("metrics", F.lit("auprc"))), 4).alias("auprc"))


@query("html_json_manifest", "SELECT 'u'||page_id AS uuid, 'f'||page_id||'.bed.gz' AS name, 'organ'||(page_id%7) AS organ, page_id AS size, 'v'||page_id AS version, 'lab' AS file_source, 'peaks;'||page_id AS content_description, 'drs://x/'||page_id AS drs_uri, '' AS azul_mirror_uri FROM pages")
def html_json_manifest(spark, sf):
    pid = F.col("page_id").cast("string")
    node = F.concat(F.lit('{"name":"f'), pid, F.lit('.bed.gz","format":"bed.gz","uuid":"u'), pid, F.lit('","azul_url":"http://x/'), pid, F.lit('","version":"v'), pid, F.lit('","fileSource":"lab","contentDescription":["peaks",'), pid, F.lit('],"drs_uri":"drs://x/'), pid, F.lit('","size":'), pid, F.lit("}"))
    doc = F.concat(F.lit('{"props":{"organ":{"organ'), (F.col("page_id") % 7).cast("string"), F.lit('":{"files":['), node, F.lit(","), node, F.lit("]}}}}"))
    pages = views.table(spark, sf, "pages").select(F.concat("html", F.lit('<script id="__NEXT_DATA__" type="application/json">'), doc, F.lit("</script>")).alias("html"))
    return B.html_json_manifest(pages, r'__NEXT_DATA__" type="application/json">(.*?)</script>').select("uuid", "name", "organ", "size", "version", "file_source", "content_description", "drs_uri", "azul_mirror_uri")


def _prediction_root(spark, sf):
    root = scratch_path(spark, "preds")
    T.write_predictions(views.seed_scores(spark, sf).withColumn("scenario", F.lit("real")), root)
    return root


@query("prediction_store", "SELECT phase, split_name, seed::BIGINT AS seed, count(*) AS n, round(sum(full_score),4) AS total FROM seed_scores WHERE phase='phase4' AND seed IN (11,17) GROUP BY ALL", ("seed_scores",))
def prediction_store(spark, sf):
    p = T.read_predictions(spark, _prediction_root(spark, sf), phase="phase4", seed=[11, 17])
    return p.groupBy("phase", "split_name", F.col("seed").cast("long").alias("seed")).agg(F.count("*").alias("n"), F.round(F.sum("full_score"), 4).alias("total"))


@query("available_slices", "SELECT DISTINCT phase, split_name, seed::BIGINT AS seed FROM seed_scores", ("seed_scores",))
def available_slices(spark, sf):
    return T.available_slices(spark, _prediction_root(spark, sf)).filter("run_count > 0").select("phase", "split_name", F.col("seed").cast("long").alias("seed"))


def _one_file_a_slice(spark, sf):
    """Score texts, one file for each slice."""
    rows = views.seed_scores(spark, sf).select("split_name", "seed", F.concat_ws("\t", "seq_id", F.format_string("%.4f", "full_score")).alias("value"))
    path = scratch_path(spark, "slices")
    rows.repartition("split_name", "seed").sortWithinPartitions("split_name", "seed", "value").write.partitionBy("split_name", "seed").text(path)
    return path


_SLICES = "SELECT split_name, seed, string_agg(v, chr(10) ORDER BY v)||chr(10) AS body FROM (SELECT split_name, seed, seq_id||chr(9)||printf('%.4f',full_score) AS v FROM seed_scores) GROUP BY 1,2"
_HALF_UP_SLICES = _SLICES.replace("FROM seed_scores", "FROM half_up_seed_scores")


@query("file_inventory", f"SELECT 'split_name='||split_name||'/seed='||seed AS folder, '.txt' AS suffix, strlen(body) AS bytes, false AS is_landing_page FROM ({_SLICES})", ("seed_scores",))
def file_inventory(spark, sf):
    inv = T.file_inventory(spark, _one_file_a_slice(spark, sf)).filter("suffix = '.txt'")
    return inv.select(F.substring_index("relative_path", "/", 2).alias("folder"), "suffix", "bytes", "is_landing_page")


_PAIR_FILES = "SELECT DISTINCT 's'||l_suppkey||'.fa' AS left_seq_file, 's'||l_partkey||'.fa' AS right_seq_file FROM lineitem"


@query("pair_file_inventory", f"WITH f AS (SELECT 's'||s_suppkey||'.fa' AS file, strlen(s_name)::BIGINT AS bytes FROM supplier) SELECT left_seq_file, right_seq_file, coalesce(a.bytes,-1) AS left_bytes, coalesce(b.bytes,-1) AS right_bytes FROM ({_PAIR_FILES}) LEFT JOIN f a ON left_seq_file=a.file LEFT JOIN f b ON right_seq_file=b.file")
def pair_file_inventory(spark, sf):
    """A file a supplier, of as many bytes as its name; sheets of pairs from line items."""
    path = scratch_path(spark, "pairs")
    file = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"), F.lit(".fa"))
    blocks.write_files(views.table(spark, sf, "supplier").select(file("s_suppkey").alias("name"), F.encode("s_name", "utf-8").alias("content")), path)
    pairs = views.table(spark, sf, "lineitem").select(file("l_suppkey").alias("left_seq_file"), file("l_partkey").alias("right_seq_file")).distinct()
    out = T.pair_file_inventory(pairs, T.file_inventory(spark, path))
    return out.select("left_seq_file", "right_seq_file", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("left_bytes", "right_bytes")])


@query("line_inventory", "SELECT sum(1)::BIGINT AS lines FROM windows", ("windows",))
def line_inventory(spark, sf):
    return T.line_inventory(spark, _text(spark, views.windows(spark, sf).select(F.col("sequence").alias("value")), "lines")).agg(F.sum("lines").alias("lines"))


@query("checksum_inventory", f"SELECT 'split_name='||split_name||'/seed='||seed AS folder, strlen(body) AS bytes, sha256(body) AS sha256, CASE WHEN seed=11 THEN 'changed' ELSE 'ok' END AS status FROM ({_HALF_UP_SLICES})", ("half_up_seed_scores",))
def checksum_inventory(spark, sf):
    root = _one_file_a_slice(spark, sf)
    found = T.checksum_inventory(spark, root)
    stale = found.withColumn("sha256", F.when(F.col("relative_path").contains("seed=11/"), "stale").otherwise(F.col("sha256")))
    checked = T.checksum_inventory(spark, root, stale).filter("relative_path like '%.txt'")
    return checked.select(F.substring_index("relative_path", "/", 2).alias("folder"), "bytes", "sha256", "status")


@query("interaction_matrix", """WITH c AS (SELECT 's'||(l_suppkey%25) AS p, 's'||(l_partkey%10) AS b, max(l_linenumber)||'-scope' AS t, max(l_linenumber) AS code FROM lineitem GROUP BY 1,2)
  SELECT least(p,b) AS left_tf, greatest(p,b) AS right_tf, max(code)::BIGINT AS interaction_code, 'scope' AS interaction_scope FROM c GROUP BY 1,2""")
def interaction_matrix(spark, sf):
    li = views.table(spark, sf, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 25).cast("string")).alias("p"), (F.col("l_partkey") % 10).alias("b"), "l_linenumber")
    wide = li.groupBy("p").pivot("b", list(range(10))).agg(F.concat(F.max("l_linenumber").cast("string"), F.lit("-scope")))
    body = wide.select((F.substring("p", 2, 9).cast("long") + 1).alias("row"), F.array("p", *[F.col(f"`{i}`") for i in range(10)]).alias("cells"))
    head = spark.range(1).select(F.lit(0).cast("long").alias("row"), F.array(F.lit("Prey\\Bait"), *[F.lit(f"s{i}") for i in range(10)]).alias("cells"))
    tail = spark.range(1).select(F.lit(1000).cast("long").alias("row"), F.array(F.lit("section B"), *[F.lit("9-late")] * 10).alias("cells"))
    return rounded(B.read_interaction_matrix(head.unionByName(body).unionByName(tail)).select("left_tf", "right_tf", "interaction_code", "interaction_scope"))


@query("clean_columns", "SELECT p_partkey AS motif_id, p_name AS gene FROM part")
def clean_columns(spark, sf):
    raw = views.table(spark, sf, "part").select(F.col("p_partkey").alias("﻿Model "), F.col("p_name").alias(" gene"))
    return T.clean_columns(raw, {"Model": "motif_id", "absent": "x"}).select("motif_id", "gene")


def _metadata_path(spark, sf):
    """JSON documents of at most 512 files, each of documents of one source whose ids are near."""
    f = F.struct(F.concat(F.lit("F"), F.col("doc_id").cast("string")).alias("accession"), F.when(F.col("doc_id") % 5 == 0, "archived").otherwise("released").alias("status"),
                 F.when(F.col("lang") == "en", "bed").otherwise("tsv").alias("file_format"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("/f/"), F.col("doc_id").cast("string"))).alias("href"))
    docs = views.table(spark, sf, "documents").groupBy("source", F.expr("doc_id div 512").alias("part")).agg(F.collect_list(f).alias("files"))
    ref = F.array(F.struct(F.array(F.concat(F.lit("PMID:"), "source"), F.lit("doi:x")).alias("identifiers")))
    path = scratch_path(spark, "meta")
    docs.select(F.concat_ws("-", "source", "part").alias("part"), F.concat_ws("-", "source", "part").alias("accession"), F.lit("released").alias("status"), ref.alias("references"), "files").repartition("part").write.partitionBy("part").json(path)
    return path


@query("metadata_datasets", "SELECT source||'-'||doc_id//512 AS accession, count(*) AS file_reference_count, 'PMID:'||source||'; doi:x' AS reference_identifiers, 'released' AS status FROM documents GROUP BY source, doc_id//512")
def metadata_datasets(spark, sf):
    return rounded(T.metadata_datasets(spark, _metadata_path(spark, sf)))


@query("metadata_files", "SELECT source||'-'||doc_id//512 AS dataset, 'F'||doc_id AS accession, 'http://p/f/'||doc_id AS download_url FROM documents WHERE doc_id%5<>0 AND doc_id%7<>0 AND lang='en'")
def metadata_files(spark, sf):
    return T.metadata_files(spark, _metadata_path(spark, sf), ["bed"], "http://p", F.col("accession") != "F0").select("dataset", "accession", "download_url")


# ---- streaming
def _stream(spark, df, name: str, parts: int = 4):
    path = scratch_path(spark, name)
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _memory(spark, df, mode: str):
    """Run a streaming aggregate to its end; the sink is one file set replaced per batch."""
    out = scratch_path(spark, "out")
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True)
         .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}")).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@query("stream_candidates", f"WITH {_CAND} SELECT w.seq_id, s.seq_id IS NOT NULL AS has_candidate, coalesce(s.pair_mode,'') AS pair_mode, CASE WHEN s.sup THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pair_reference_supported FROM windows w LEFT JOIN (SELECT * FROM sel WHERE pair_rank=0) s USING (seq_id)", ("windows", "hits", "edges"))
def stream_candidates(spark, sf):
    edges = views.edges(spark, sf)
    library = store_library(S.edge_library(views.motif_positions(spark, sf), edges))
    store = scratch_path(spark, "store")
    stream = _stream(spark, views.windows(spark, sf).select("seq_id", "sequence"), "win")
    J.stream_candidates(stream, store, scratch_path(spark, "cp"), lambda df: S.functional_candidates(df, None, edges, library=library)[1]).awaitTermination()
    return J.read_store(spark, store, J.CANDIDATE_STATUS)


_TILES = "SELECT seq_id||'_'||o AS seq_id, rpad(substr(bases,CAST(o*96+1 AS INT),96),96,'N') AS sequence, 'complete' AS hydration_status{extra} FROM (SELECT seq_id, bases, unnest(range(0,(length(bases)+95)//96)) AS o FROM sequences)"


def _tiles(spark, sf):
    """Windows over all bases of every sequence, with the chunk table and the lengths."""
    s = materialize(views.sequences(spark, sf).filter(F.length("bases") > 0).select("seq_id", "bases"))  # texts are read once, not for every batch
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("bases") - 1) / 96).cast("int"))).alias("o")
    regions = s.select("seq_id", at).select(F.concat("seq_id", F.lit("_"), F.col("o").cast("string")).alias("seq_id"), F.col("seq_id").alias("chromosome"), (F.col("o") * 96).cast("long").alias("window_start"))
    cut = s.select(F.col("seq_id").alias("chromosome"), "bases", F.explode(F.sequence(F.lit(0), F.floor((F.length("bases") - 1) / 1000).cast("int"))).alias("c"))
    chunks = cut.select("chromosome", F.col("c").cast("long").alias("chunk_id"), (F.col("c") * 1000).cast("long").alias("start"), F.substring("bases", F.col("c") * 1000 + 1, F.lit(1000)).alias("bases"))
    lengths = s.select(F.col("seq_id").alias("chromosome"), F.length("bases").alias("chromosome_length"))
    return regions, lambda df: N.hydrate_windows(df, chunks, 96, 1000, lengths=lengths)


@query("stream_hydrate", _TILES.format(extra=""), ("sequences",))
def stream_hydrate(spark, sf):
    """Every id arrives twice and is hydrated once."""
    regions, hydrate = _tiles(spark, sf)
    store = scratch_path(spark, "hyd")
    J.stream_hydrate(_stream(spark, regions.unionByName(regions), "reg"), store, scratch_path(spark, "cp"), hydrate).awaitTermination()
    return spark.read.schema(f"{J.HYDRATED}, batch_id long").parquet(store).select("seq_id", "sequence", "hydration_status")


@query("pending_hydrate", f"SELECT seq_id, sequence, hydration_status, CASE WHEN row_number() OVER (ORDER BY seq_id)<=1000 THEN 0 ELSE 1 END AS run FROM ({_TILES.format(extra='')})", ("sequences",))
def pending_hydrate(spark, sf):
    """Two runs: the first has a budget, the second only touches what it left pending."""
    regions, hydrate = _tiles(spark, sf)
    store = scratch_path(spark, "hyd")
    for budget in (1000, None):
        J.run_pending(regions, store, J.HYDRATED, lambda df: hydrate(df).select("seq_id", "chromosome", "window_start", "sequence", "hydration_status"), budget)
    return spark.read.schema(f"{J.HYDRATED}, batch_id long").parquet(store).select("seq_id", "sequence", "hydration_status", F.col("batch_id").alias("run"))


@query("stream_latest", "SELECT event_type AS phase, 's'||(user_id%5) AS split_name, event_id%3 AS seed, 'run'||lpad(CAST(event_id AS VARCHAR),8,'0') AS run_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id%5, event_id%3 ORDER BY strftime(ts,'%Y-%m-%d %H:%M:%S') DESC, event_id DESC)=1")
def stream_latest(spark, sf):
    out = _memory(spark, J.stream_latest(_stream(spark, _ledger(spark, sf), "led")), "update")
    last = out.groupBy("phase", "split_name", "seed").agg(F.max_by("run_id", "batch_id").alias("run_id"))
    return rounded(last)


@query("stream_overlaps", 'SELECT region_id, count(*) AS fragment_count FROM fragments f JOIN regions r ON r.chromosome=f.chromosome AND r.region_start<f."end" AND r.region_end>f.start AND f."end">f.start GROUP BY 1', ("fragments", "regions"))
def stream_overlaps(spark, sf):
    frag = _stream(spark, views.fragments(spark, sf).select("chromosome", "start", "end"), "frag")
    store = scratch_path(spark, "marks")
    J.stream_overlaps(frag, store, scratch_path(spark, "cp")).awaitTermination()
    return J.read_overlaps(spark, store, views.regions(spark, sf))


@query("stream_top_regions", f"SELECT chromosome||':'||region_start||'-'||region_end AS state_label, element_type FROM regions ORDER BY CASE element_type {' '.join(f'WHEN {k!r} THEN {v}' for k, v in schema.ELEMENT_PRIORITY.items())} ELSE 9 END, {views.sql_rank('screen_id', 'encode_id', 'chromosome', 'region_start', 'region_end')} LIMIT 100", ("regions",))
def stream_top_regions(spark, sf):
    store = scratch_path(spark, "top")
    J.stream_top_regions(_stream(spark, views.regions(spark, sf), "regs"), 100, store, scratch_path(spark, "cp")).awaitTermination()
    return J.read_top_regions(spark, store).select("state_label", "element_type")


@query("batch_top_regions", f"SELECT chromosome||':'||region_start||'-'||region_end AS state_label FROM regions ORDER BY CASE element_type {' '.join(f'WHEN {k!r} THEN {v}' for k, v in schema.ELEMENT_PRIORITY.items())} ELSE 9 END, {views.sql_rank('screen_id', 'encode_id', 'chromosome', 'region_start', 'region_end')} LIMIT 100", ("regions",))
def batch_top_regions(spark, sf):
    return sample_regions(views.regions(spark, sf), 100).select("state_label")
