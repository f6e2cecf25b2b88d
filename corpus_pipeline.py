"""From raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as
Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import bpe, minhash, mixing, quality_rules, secret_scan
from hrefwarden.llm import words as W


def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, the base rules' among them."""
    W.workspace(spark)
    return quality_rules.kept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least doc_id."""
    return minhash.kept(docs, W.workspace(spark))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask and ``n_chars`` counted anew."""
    ledger = secret_scan.Ledger(spark, f"{W.workspace(spark)}/ledger")
    secret_scan.scan(docs, ledger)
    rows = secret_scan.redacted(docs, ledger)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; those most likely clean at least once."""
    return mixing.mixed(docs, W.table(spark, sf_dir, "labels"), W.workspace(spark))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every row; a null text has no tokens."""
    import public_tokenizers

    W.workspace(spark)
    rows = bpe.encoded(docs.withColumn("text", W.whole(F.col("text"))), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", pass_quality_rules),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_domains),
    ("BPE encoding and decoding", encode_tokens),
]

#: SQL cannot express MinHash, mixing and BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = W.table(spark, sf_dir, "documents")
    folder = W.workspace(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.stage(stage(spark, docs, sf_dir), folder, f"stage_{k}")
    return docs
