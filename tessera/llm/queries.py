"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, crf, mixing, multiset, rabitq, repair, secrets, simhash, toxicity, warc
from tessera.llm.common import table


def tokenizer_path() -> str:
    """The public vocabulary file that the contracts of the BPE and token-id queries name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split(n: int) -> Column:
    """The remainder that holds documents out of training; a null id has that of the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = split(3)
    model = toxicity.fit(docs.select("doc_id", "text").where(remainder != 1), labels.where(remainder != 1), "doc_id", "text", "toxic")
    scored = toxicity.scores(docs, model, "doc_id", "text")
    return scored.select("doc_id", (remainder == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("details")


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.with_edits(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    # in training order by the first pass; rows that aren't taken come last
    first = F.coalesce(F.try_element_at("passes", F.lit(1)).position, F.lit(2.0))
    return mixed.orderBy(first, "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = split(4)
    model = crf.fit(docs.where((remainder != 2) & F.col("lang").isNotNull()), "doc_id", "text", "lang")
    found = crf.languages(docs, model, "doc_id", "text")
    return found.select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_toxicity, op3_secret_scan, op4_warc_dictionary, op5_bpe, op6_simhash_near_dedup, op7_multiset_fingerprint, op8_mixing, op9_language_id, op10_token_ids, pipeline)}

ORACLES = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(id, seen) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.w FROM reach r JOIN links l ON l.u = r.seen)
SELECT e.vec_id, COALESCE(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT u, COUNT(*) AS n FROM links GROUP BY u) n ON n.u = e.vec_id
JOIN (SELECT id, MIN(seen) AS component_id FROM reach GROUP BY id) c ON c.id = e.vec_id""",
    "op4_warc_dictionary": """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS html, CAST(octet_length(encode(COALESCE(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
r AS (SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 THEN MAX(page_id) OVER (PARTITION BY html) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to FROM r""",
    "op8_mixing": """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(COALESCE(CAST(doc_id AS VARCHAR), 'none ' || COALESCE(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  CAST(3 * source_size AS DOUBLE) AS cap, CAST(SUM(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / SUM(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE LEAST(cap, final * weight) END AS target FROM f),
p AS (SELECT source, source_size, target, CAST(FLOOR(target) AS BIGINT) AS whole,
  CASE WHEN source_size > 0 THEN LEAST(3, CAST(FLOOR(target) AS BIGINT) // source_size) ELSE 0 END AS passes FROM t),
o AS (SELECT doc_id, source, size, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT o.doc_id, o.size, p.source_size, p.target,
  CAST(p.passes * o.size + GREATEST(0, LEAST(o.size, p.whole - p.passes * p.source_size - o.before)) AS BIGINT) AS taken
FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source""",
}
