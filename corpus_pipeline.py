"""The corpus pipeline: documents in, packed token sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gavelyard.llm import minhash, packing, ranker, substring, toxicity
from gavelyard.llm.queries import table, vocabulary
from gavelyard.llm.storage import keep, numbered


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is 0.7 or more go.

    Null and empty texts are scored like any other (without a clause they stay); rows that repeat are judged alike, null
    ids too; very long texts are read whole; columns of any name stay as they are; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold that the ranking learned go.

    The ranker learns from the labelled documents that are left. Null and empty texts have zero features and are scored
    like any other; rows that repeat are judged alike, null ids too; very long texts are read whole; columns of any name
    stay as they are; an empty table stays empty.
    """
    model = ranker.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_scored(docs, ranker.scorer(model), lambda s: s >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the row with the smallest doc_id stays.

    Null and empty texts are nobody's duplicates and stay; rows are told apart by number where doc_ids repeat, so of
    repeated rows one stays and different texts under one id are judged each; null ids rank last; very long texts are
    compared whole; columns of any name stay as they are; an empty table stays empty.
    """
    rows, name = numbered(docs)
    groups = minhash.near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"))
    stay = keep(groups.where("kept").select(F.col("doc_id").alias(name)), "kept-rows")
    return rows.join(stay, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines, sentences and runs of them that an earlier document has are cut out; n_chars follows.

    A null text stays null (its n_chars too), an empty one empty; every row stays, repeated ones with what is left of
    them; null ids rank last; very long texts are cut like others; columns of any name stay as they are, but one named
    `removed` is no column of documents and goes; an empty table stays empty.
    """
    cut = substring.drop_repeated_units(docs)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return (cut.withColumn("n_chars", F.length("text").cast(kind)) if kind else cut).drop("removed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids.

    A null or empty text is one piece with the end id alone; rows that repeat are packed each, null ids too; only texts
    of more than 2048 ids are cut; columns besides doc_id and text are not read; an empty table gives no rows.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_units),
    ("best_fit_packing", pack),
]

# Learned models and a tokenizer can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
