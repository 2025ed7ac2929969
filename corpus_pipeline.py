"""Corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents go, secrets are
masked, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them to `documents`, each written as
Parquet in the shared folder and read again. All but the last return the columns of documents. The near-duplicate
stage takes five-word shingles and a similarity of 0.8.

Defined results of every stage: a null or empty text is not toxic by itself, has no near copies, no benchmark passage,
no secret and no tokens, so it stays; rows with a null doc_id are judged like others and stay, but for near copies: one
goes if a row with an equal set of shingles is kept; rows that repeat id and text are one near-duplicate group, else each
is judged for itself; an empty table gives an empty one; very long texts are judged and encoded whole; columns besides
doc_id, text and n_chars, of whatever name, pass unchanged, but for n_tokens, ids_sha256 and decoded_sha256, which the
last stage sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillhouse.llm import bpe_codec, decontam, ngram_join, secrets, toxicity
from rillhouse.runtime import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity score reaches the threshold; models come from these documents and `labels`."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component of near copies."""
    return ngram_join.representatives(docs, 5, 8, 10)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth of the words or more lies in benchmark passages."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mask; n_chars follows."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token count and digests of the ids and of the decoded text."""
    return bpe_codec.with_ids(docs, keep=tuple(docs.columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("bpe_encoding", encode),
]
#: Learned scores, exact merges and components have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
