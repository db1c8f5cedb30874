"""Stages of the corpus pipeline: each calls one operator and keeps the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, mixing, nbest, passages
from . import quality as classifier
from ._scratch import table

REPEATS = 1.5  # of the source that mixing repeats most


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a probability below 0.5 go."""
    network = classifier.fitted(docs, table(spark, sf_dir, "labels"))
    return classifier.scored(docs, network).where("_score >= 0.5").drop("_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring passages go from every text; documents left without a word go too. Other texts stay as they are."""
    rows = passages.without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_words")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_words").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.where("n_removed = 0 or n_removed < n_words").withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; small sources more often, up to REPEATS times."""
    return mixing.mixed(docs, repeats=REPEATS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and its n best segmentations with their scores."""
    return nbest.encoded(docs, keep=["doc_id", "lang", "source", "n_chars"])
