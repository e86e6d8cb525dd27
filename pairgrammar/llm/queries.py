"""Registered queries of this subpackage, one ``opN_<name>`` for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrammar.llm import decontaminate, extract, jaccard, langid, packing, perspectives, quality, recompress, spelling, suffixtree, topk, whiten, wordpiece
from pairgrammar.llm.common import remainder_is_one

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_suffix_tree")
def _suffix_tree(spark: SparkSession, sf: str) -> DataFrame:
    return suffixtree.score(table(spark, sf, "documents"))


@query("op2_best_fit_packing")
def _packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    sized = docs.select("doc_id", "source", packing.word_count(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("cluster"))
    return packing.pack(sized)


@query("op3_perspectives", """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT DISTINCT conv_id, speaker AS assistant FROM t WHERE speaker <> 'system'),
p AS (
  SELECT conv_id, assistant, turn, speaker, text, speaker = assistant AS trained,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = assistant THEN 'assistant' ELSE 'user name=' || speaker END || chr(10)
    || replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) AS piece
  FROM t JOIN v USING (conv_id)
), o AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "end" FROM p
)
SELECT conv_id, assistant, turn, speaker, "end" - length(piece) AS start, "end", trained, md5(piece) AS piece_md5 FROM o""")
def _perspectives(spark: SparkSession, sf: str) -> DataFrame:
    pieces = perspectives.rotate(table(spark, sf, "conversations"))
    return pieces.select("conv_id", "assistant", "turn", "speaker", "start", "end", "trained", F.md5("piece").alias("piece_md5"))


@query("op4_threshold_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def _top_k(spark: SparkSession, sf: str) -> DataFrame:
    items = topk.scaled(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return topk.top_k(items, items.where("id % 100 = 0"), k=10)


@query("op5_quality_field")
def _quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf, "labels"))
    kept = docs.withColumn("held_out", remainder_is_one("doc_id", 3))
    return quality.rate(kept, model, ["doc_id", "held_out"]).select("row.doc_id", "row.held_out", "score", "predicted")


@query("op6_main_text")
def _main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(table(spark, sf, "pages"), ["page_id", "url"]).select("row.page_id", "row.url", "text", "n_chars")


@query("op7_language_id")
def _language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    kept = docs.withColumn("held_out", remainder_is_one("doc_id", 3))
    return langid.identify(kept, model, ["doc_id", "held_out"]).select("row.doc_id", "row.held_out", "lang_pred", "score")


@query("op8_piece_counts")
def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return wordpiece.count_pieces(docs, ["doc_id"]).select("row.doc_id", "n_words", "n_tokens", "n_unknown")


@query("op9_jaccard_join", """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a) k USING (doc_id)""")
def _jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.link(table(spark, sf, "documents"), words=3, percent=90)


@query("op10_decontamination")
def _decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), decontaminate.passes(table(spark, sf, "benchmark")))


@query("op11_whitening")
def _whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten.whiten(table(spark, sf, "embeddings"), "vec_id", "embedding", components=16)


@query("op12_spelling_variants")
def _spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf, "documents"))


@query("op13_substring_dedup", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT *, CASE WHEN count(*) OVER s = 13 THEN string_agg(word, ' ') OVER s END AS k FROM x WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
g AS (SELECT doc_id, i, word, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS gone FROM k),
c AS (SELECT doc_id, i, word, max(CAST(gone AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM g)
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def _repeats(spark: SparkSession, sf: str) -> DataFrame:
    return recompress.remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
