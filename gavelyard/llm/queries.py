"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, codes, merkle, minhash, oracles, packing, pieces, ranker, rules, simhash, spelling, substring, toxicity, whitening
from .storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.adaptive_rules(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_fingerprints(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranker.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.drop_repeated_units(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), gone.cast("long").alias("removed_chars"), "removed", "text")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    codes.write_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return codes.read_ids(spark, path)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_minhash, op2_toxicity, op3_quality_rules, op4_fingerprints, op5_packing, op6_quality_classifier, op7_substring_dedup, op8_pieces, op9_token_ids, op10_chat, op11_whitening, op12_simhash, op13_spelling, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": oracles.OP1, "op3_quality_rules": oracles.OP3, "op10_chat": oracles.OP10, "op12_simhash": oracles.OP12, "op13_spelling": oracles.OP13}
