"""Retrieval scored against known answers, for one ranking or a grid of chunkings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import retrieval as R


def retrieval_scores(ranked: DataFrame, relevant: DataFrame, asks: DataFrame, query: str, found: str, config: str | None = None, configs: Sequence = ()) -> DataFrame:
    """A row a question (and ``config``): ``n_retrieved, n_relevant, n_found, hit, precision, recall, first_rank``.

    ``ranked`` has ``query, found, rank`` (and ``config``); of what is found twice the best rank counts.
    ``relevant`` has ``query, found``.  Every row of ``asks`` is scored under every one of ``configs``;
    without anything retrieved the precision is 0, without a relevant thing the recall is null.
    """
    by = [query] if config is None else [config, query]
    once = ranked.groupBy(*by, found).agg(F.min("rank").alias("rank"))
    known = relevant.select(query, found).distinct()
    judged = once.join(known.withColumn("is_relevant", F.lit(True)), [query, found], "left")
    right = F.col("is_relevant").isNotNull()
    counted = judged.groupBy(*by).agg(F.count("*").alias("n_retrieved"), F.count_if(right).alias("n_found"), F.min(F.when(right, F.col("rank"))).alias("first_rank"))
    rows = asks.select(query).distinct().join(known.groupBy(query).agg(F.count("*").alias("n_relevant")), query, "left")
    if config is not None:
        rows = rows.withColumn(config, F.explode(F.array(*map(F.lit, configs))))
    rows = rows.join(counted, by, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        *by, n("n_retrieved").alias("n_retrieved"), n("n_relevant").alias("n_relevant"), n("n_found").alias("n_found"), (n("n_found") > 0).alias("hit"),
        F.coalesce(F.col("n_found") / F.col("n_retrieved"), F.lit(0.0)).alias("precision"), (n("n_found") / F.col("n_relevant")).alias("recall"), "first_rank",
    )


def score_summary(scores: DataFrame, config: str) -> DataFrame:
    """A row a config: ``questions, hits, precision, recall, reciprocal_rank``; recall over questions that have an answer."""
    mean = lambda c: F.round(F.avg(c), 6)
    reciprocal = F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))
    return scores.groupBy(config).agg(F.count("*").alias("questions"), F.count_if("hit").alias("hits"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean(reciprocal).alias("reciprocal_rank"))


def grid_ranking(docs: DataFrame, asks: DataFrame, query: str, sizes: Sequence[int], k: int = 5, chunk: Callable[[DataFrame, int], DataFrame] = R.fixed_chunk) -> DataFrame:
    """``config_id, query, chunk_id, document_id, rank``: the same questions ranked over each chunking.

    Every size has statistics of its own (a term's documents are its chunks); the rankings are
    branches of one plan.
    """
    rows = None
    for size in sizes:
        hits = R.bm25_topk(chunk(docs, size), "chunk_id", asks, query, k).withColumn("config_id", F.lit(size))
        rows = hits if rows is None else rows.unionByName(hits)
    document = F.regexp_extract("chunk_id", r"^(?s)(.*)__chunk_\d+$", 1)
    return rows.select("config_id", query, "chunk_id", document.alias("document_id"), "rank")
