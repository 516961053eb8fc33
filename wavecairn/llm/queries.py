"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import audio, bpe, common, decontaminate, katz, licenses, lines, nearup, pii, quality, suffixes

#: The tokenizer is a parameter of the operator; this is the one that the contract names.
TOKENIZER = "byte_bpe_50k.json"


def op1_quality(spark, sf_dir):
    return quality.classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_bpe(spark, sf_dir):
    return bpe.digests(common.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op3_licenses(spark, sf_dir):
    return licenses.scan(common.documents(spark, sf_dir))


def op4_tiling(spark, sf_dir):
    return decontaminate.scan(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_katz(spark, sf_dir):
    return katz.score(common.documents(spark, sf_dir))


def op6_mpeg_audio(spark, sf_dir):
    return audio.media(common.documents(spark, sf_dir), keep_media=False)


def op7_lines(spark, sf_dir):
    out = lines.dedup(common.documents(spark, sf_dir))
    removed = F.concat_ws(",", F.transform("removed", lambda x: F.concat_ws(":", x["s"], x["e"])))
    kept = F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256)
    return out.select("doc_id", "n_units", "n_removed", "n_repeated", "n_passages", removed.alias("removed"), kept.alias("kept_sha256"))


def op8_minhash(spark, sf_dir):
    return nearup.dedup(common.documents(spark, sf_dir))


def op9_pii(spark, sf_dir):
    return pii.scan(common.documents(spark, sf_dir), keep_text=False)


def op10_suffixes(spark, sf_dir):
    return suffixes.dedup(common.documents(spark, sf_dir)).drop("removed")


QUERIES = {f.__name__: f for f in (op1_quality, op2_bpe, op3_licenses, op4_tiling, op5_katz, op6_mpeg_audio, op7_lines, op8_minhash, op9_pii, op10_suffixes)}
ORACLES: dict[str, str] = {"op7_lines": lines.SQL}
