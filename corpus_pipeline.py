"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its decisions take
effect: rejected, repeated and contaminated documents go, personal data is replaced in the texts. All but the
last return the columns of documents; the last returns token ids and digests of every document that is left.
Nulls, empty and long texts, repeated rows, empty tables and clashing columns are handled as the operators'
docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wavecairn.llm import bpe, common, decontaminate, nearup, pii, quality

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise-ranking score is under the threshold go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), common.documents(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 on five-word shingles stays."""
    return nearup.survivors(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item in tiles go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans found by rules or selected by the boosted trees are replaced by their kind; n_chars follows."""
    return pii.redacted(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, with digests of ids and of the text decoded from them."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_pairs", byte_pairs),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
