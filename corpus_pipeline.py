"""Corpus preparation from ``documents``: five stages, each a corpus operator.

Every stage takes and (but for the last) returns the columns of ``documents``;
``run`` writes each stage's result as Parquet and reads it as the next one's
input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import written
from textloom.llm.jaccard_join import jaccard_dedup
from textloom.llm.language_id import UND, language_id, learn, trained_rows
from textloom.llm.mixing import mix_sources
from textloom.llm.sentence_pieces import encode
from textloom.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


SPACES = r"[\x20\x09-\x0D]+"

#: A document whose best language has a smaller score than this is rejected.
LEAST_SCORE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the predicted language; those without one, or of too small a score, go."""
    found = language_id(docs, learn(docs, trained_rows(F.col("doc_id"))))
    sure = (F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE)
    return found.where(sure).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_dedup(docs).where("kept").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose passages that repeat; texts that lose nothing stay as they are, emptied ones go."""
    found = substring_dedup(docs)
    changed = F.col("n_removed") > 0
    found = found.where(~changed | (F.col("n_words") > F.col("n_removed")))
    found = found.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; a part taken is its first words, joined by one space."""
    found = mix_sources(docs).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    found = found.withColumn("time", F.explode(F.sequence(F.lit(1), times)))
    left = (F.col("taken") - (F.col("time") - 1) * F.col("size")).cast("int")
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, left), " "))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, checked by decoding them."""
    return encode(docs).select("doc_id", "lang", "source", "ids", "n_tokens", "round_trip")


STAGES = [
    ("language", identify),
    ("near_copies", drop_near_copies),
    ("passages", drop_repeated_passages),
    ("mix", mix),
    ("pieces", tokenize),
]

#: Trained networks and piece models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
