"""A corpus pipeline of five stages; each works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, crf, mixing, secrets, simhash
from tessera.llm.common import new_folder, remove, scratch, table
from tessera.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose words don't tell a language (crf.accepted): no letter, or 20 words and more that are on
    average no likelier in one language each than OWN_SHARE says. If no document names its language, only those without a letter go."""
    named = docs.where(F.col("lang").isNotNull())
    model = crf.fit(named, "doc_id", "text", "lang")
    # verdicts are made in one pass over the rows: no join, repeated rows and null ids keep their place
    return crf.accepted(docs, model, "text")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: sets of five-word shingles of likeness 0.8 or more, linked by SimHash
    fingerprints through the ring and checked exactly; what 4 bits don't tell is found by rare shingles."""
    return simhash.keep_one(docs, words=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten in the texts; no document goes."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight has it, in training order."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether decoding them gives back the vocabulary's strings in order."""
    return bpe.with_tokens(docs, tokenizer_path()).select("doc_id", "lang", "source", "n_chars", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("bpe_encode", encode)]

#: Language identification, SimHash and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again as the next one's.

    What a stage's operator wrote between, and the rows of the stage before, are deleted once the stage is written.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(at := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(at)
        if before is not None:
            remove(spark, before)
        before = at
    return docs
