"""The registered corpus queries: one per operator, and the pipeline.

Each reads its whole table, runs its operator with production parameters and
derives digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_search import ann_search
from .embedding_dedup import embedding_dedup
from .hard_negatives import hard_negatives
from .jaccard_join import jaccard_classes
from .language_id import language_id, learn, trained_rows
from .license_scan import license_scan
from .mixing import mix_sources
from .periodic_runs import periodic_runs, strongest
from .quality_classifier import learn as learn_quality
from .quality_classifier import quality
from .quality_classifier import trained_rows as quality_rows
from .sentence_pieces import encode
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_tokens", "round_trip", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = learn(docs, trained_rows(F.col("doc_id")))
    found = language_id(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as a tree, as the table has no paths: a folder a hundred ids, those that speak of a
    license as licence files of the folder, the others in a folder a source below."""
    doc = F.col("doc_id").cast("string")
    folder = F.concat_ws("/", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"))
    speaks = F.coalesce(F.col("text").rlike("(?i)licen[cs]e"), F.lit(False))
    plain = F.concat_ws("/", folder, F.coalesce("source", F.lit("none")), F.concat(doc, F.lit(".txt")))
    path = F.when(speaks, F.concat(folder, F.lit("/LICENSE."), doc)).otherwise(plain)
    files = _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan(files).drop("text")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _made_periodic(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; of a tenth of the documents, by id, the text goes over into repeats of some of its words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(F.col("n") > 0, g % F.greatest("n", F.lit(1))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    left = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_made_periodic(_table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = learn_quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), train=quality_rows(F.col("doc_id")))
    found = quality(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_sentence_pieces": op3_sentence_pieces,
        "op4_ann_search": op4_ann_search,
        "op5_mix_sources": op5_mix_sources,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_language_id": op7_language_id,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_license_scan": op9_license_scan,
        "op10_url_filter": op10_url_filter,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_quality": op13_quality,
    }
