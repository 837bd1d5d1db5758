"""A written inverted index with block maxima, and a top-k that reads only blocks that can matter.

``build_index`` writes, under a folder a version:

* ``postings``, by bucket of the term: a row a term and block of documents, with the documents'
  keys, counts and lengths, and ``best``, the greatest share of a score that the term has in the block;
* ``terms``: document frequencies and inverse ones;
* ``stats``: documents and their mean length.  It is written last; a version without it isn't there.

``index_topk`` adds the weights times ``best`` of a query's terms by block: no document of the block
scores more.  A task takes its blocks one by one and scores each for the queries whose ``k``-th score
so far the bound reaches.  Where the queries' weights are too many for that, the few most promising blocks are scored first; where a query's ``k``-th best score of
them is above a block's bound, the block's postings are neither shuffled nor scored.  The rest is
scored whole, so the rows are those of scoring everything.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import tokenize
from textloom.operators.retrieval import _TERM, B, EPSILON, K1, MOST_WEIGHTS, _Best, _ranked

BLOCK, BUCKETS, FIRST = 64, 16, 4  # documents of a block at most; buckets of terms; blocks of a query scored first
_LOT = 16  # blocks that are packed at once


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/stats")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def current(spark: SparkSession, path: str) -> dict | None:
    """The last version's row of ``stats``: ``version, number, documents, postings, mean_length, key_type``; none before the first."""
    found = _versions(spark, path)
    row = None if found is None else found.orderBy(F.desc("number")).first()
    return row.asDict() if row else None


def build_index(chunks: DataFrame, key: str, path: str, text: str = "text", block: int = BLOCK, buckets: int = BUCKETS) -> dict:
    """Write a new version of the index at ``path``; returns ``documents`` and ``stored_before``.

    Keys tell documents apart and are not null.  Null texts count as empty documents.  Without a
    document that holds a term it is an error and nothing is written.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, total = rows.select(F.size(tokenize(F.col("text"))).alias("n")).agg(F.count("*"), F.sum("n")).first()
    if not total:
        raise ValueError("nothing to index")
    before, mean, version = current(spark, path), total / n, uuid.uuid4().hex
    kind = rows.schema["key"].dataType.simpleString()
    low = rows.select("key", F.lower("text").alias("text"), F.spark_partition_id().alias("part"))
    posted = low.mapInArrow(_posted(block, mean), f"term string, block long, docs array<struct<key:{kind},share:double>>, best double, n int")
    posted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).write.partitionBy("bucket").parquet(f"{path}/postings/version={version}")
    written = spark.read.parquet(f"{path}/postings/version={version}")
    df = written.groupBy("bucket", "term").agg(F.sum("n").alias("df")).withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    df.write.partitionBy("bucket").parquet(f"{path}/terms/version={version}")
    floor, postings = spark.read.parquet(f"{path}/terms/version={version}").agg(F.avg("raw") * EPSILON, F.sum("df")).first()
    number = before["number"] + 1 if before else 1
    stats = spark.createDataFrame([(version, number, n, postings, float(mean), float(floor), buckets)], "version string, number int, documents long, postings long, mean_length double, least_idf double, buckets int")
    stats.coalesce(1).write.mode("append").parquet(f"{path}/stats")
    return {"documents": n, "stored_before": before["documents"] if before else 0}


def _posted(block: int, mean: float):
    """Postings of a task's documents, ``block`` after another a block, so none is shuffled; a term's rows come once a block."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block * _LOT):
                part = batch.slice(lo, block * _LOT)
                words = [_TERM.findall(t) for t in part["text"].to_pylist()]
                counts = [Counter(w) for w in words]
                terms = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
                doc = np.repeat(np.arange(len(words)), [len(c) for c in counts])
                term = np.array([terms[t] for c in counts for t in c], np.int64)
                tf = np.array([n for c in counts for n in c.values()], float)
                size = np.array([len(w) for w in words], float)
                share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)[doc])
                order = np.lexsort((doc, term, doc // block))
                doc, term, share = doc[order], term[order], share[order]
                at = doc // block
                begin = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (at[1:] != at[:-1])]) if len(doc) else np.zeros(0, np.int64)
                docs = pa.StructArray.from_arrays([part["key"].take(pa.array(doc)), pa.array(share)], ["key", "share"])
                held = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(doc)].astype(np.int32)), docs)
                number = (int(part["part"][0].as_py()) << 32) + place + at[begin]
                best = np.maximum.reduceat(share, begin) if len(begin) else share
                names = pa.array(list(terms), pa.string()).take(pa.array(term[begin]))
                n = pa.array(np.diff(np.r_[begin, len(doc)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([names, pa.array(number.astype(np.int64)), held, pa.array(best), n], ["term", "block", "docs", "best", "n"])
                place += -(-len(words) // block)

    return posted


def _bounds(spark: SparkSession, path: str, at: dict, queries: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """``query, bucket, term, weight`` and ``query, block, bound``."""
    terms = spark.read.parquet(f"{path}/terms/version={at['version']}")
    words = queries.select(F.col(query).alias("query"), F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    words = words.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(at["buckets"])).cast("int"))
    idf = F.when(F.col("raw") < 0, at["least_idf"]).otherwise(F.col("raw"))
    weights = words.join(terms, ["bucket", "term"]).select("query", "bucket", "term", (F.col("qtf") * idf).alias("weight"))
    best = spark.read.parquet(f"{path}/postings/version={at['version']}").select("bucket", "term", "block", "best")
    bound = F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * F.col("best")).alias("bound")
    return weights, weights.join(best, ["bucket", "term"]).groupBy("query", "block").agg(bound).where("bound > 0")


def index_topk(spark: SparkSession, path: str, queries: DataFrame, query: str, key: str, k: int = 10, first: int = FIRST, most: int = MOST_WEIGHTS) -> DataFrame:
    """``query, key, score, rank`` as ``bm25_topk`` gives, from the last version at ``path``.

    Up to ``most`` weights of query terms go to the tasks: only postings of asked terms are moved, once,
    to their block, whatever the number of queries, and a task sends ``k`` rows a query.  More
    weights meet the postings by joins.
    """
    at = current(spark, path)
    if at is None:
        raise ValueError(f"no index at {path}")
    weights, bounds = _bounds(spark, path, at, queries, query)
    few = weights.limit(most + 1).toPandas()
    if len(few) <= most:
        scored = _by_block(spark, path, at, few, weights.schema["query"].dataType.simpleString(), k)
        return _ranked(scored, "query", "key", k).select(F.col("query").alias(query), F.col("key").alias(key), "score", "rank")
    promising, rest = _parts(spark, path, at, weights, bounds, k, first)
    scored = _scored(spark, path, at, weights, promising).unionByName(_scored(spark, path, at, weights, rest)).where("score > 0")
    return _ranked(scored, "query", "key", k).select(F.col("query").alias(query), F.col("key").alias(key), "score", "rank")


def _by_block(spark: SparkSession, path: str, at: dict, weights: pd.DataFrame, kind: str, k: int) -> DataFrame:
    """``query, key, score``: the ``k`` best of each task; a block is scored for the queries whose bound reaches their ``k``-th score."""
    postings = spark.read.parquet(f"{path}/postings/version={at['version']}")
    asks, row = np.unique(weights["query"].to_numpy(), return_inverse=True)
    terms, column = np.unique(weights["term"].to_numpy(dtype=object), return_inverse=True)
    order = np.argsort(column, kind="stable")
    cuts = np.searchsorted(column[order], np.arange(len(terms) + 1))
    place = spark.sparkContext.broadcast((asks, {t: i for i, t in enumerate(terms)}, cuts, row[order], weights["weight"].to_numpy(dtype=float)[order]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asks, known, cuts, row, weight = place.value
        best, held = _Best(asks, k, 0.0), []

        def settle():
            block = pd.concat(held)
            held.clear()
            at = block["term"].map(known).to_numpy()
            n = cuts[at + 1] - cuts[at]
            to = np.repeat(cuts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())  # places in the weights, term by term
            bound = np.bincount(row[to], np.maximum(weight[to], 0) * np.repeat(block["best"].to_numpy(), n), len(asks))
            alive = np.flatnonzero((bound > 0) & (bound >= best.least - 1e-6))
            if not len(alive):
                return
            new = np.full(len(asks), -1)
            new[alive] = np.arange(len(alive))
            code, keys = pd.factorize(np.concatenate(block["keys"].to_list()))
            of = np.repeat(np.arange(len(block)), block["keys"].map(len).to_numpy())
            share, m = np.concatenate(block["shares"].to_list()), n[of]
            to = np.repeat(cuts[at][of] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            mine = new[row[to]]
            on = mine >= 0
            cell = (np.repeat(code, m) * len(alive) + mine)[on]
            part = np.bincount(cell, (np.repeat(share, m) * weight[to])[on], len(keys) * len(alive))
            scores = np.full((len(keys), len(asks)), -np.inf)
            scores[:, alive] = part.reshape(len(keys), -1)
            best.add(scores, keys)

        for pdf in batches:
            cut = np.flatnonzero(np.diff(pdf["block"].to_numpy())) + 1
            for lo, hi in zip([0, *cut], [*cut, len(pdf)]):
                if held and held[0]["block"].iat[0] != pdf["block"].iat[lo]:
                    settle()
                held.append(pdf.iloc[lo:hi])
        if held:
            settle()
        yield best.rows()

    asked = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
    rows = postings.join(asked, "term", "left_semi").select("block", "term", "best", F.col("docs.key").alias("keys"), F.col("docs.share").alias("shares"))
    found = rows.repartition("block").sortWithinPartitions("block")
    keys = postings.schema["docs"].dataType.elementType["key"].dataType.simpleString()
    return found.mapInPandas(score, f"query {kind}, key {keys}, score double")


def _scored(spark: SparkSession, path: str, at: dict, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """``query, key, score`` of all documents of the asked blocks (``query, block``)."""
    postings = spark.read.parquet(f"{path}/postings/version={at['version']}").select("bucket", "term", "block", "docs")
    met = weights.join(blocks.select("query", "block"), "query").join(postings, ["bucket", "term", "block"])
    rows = met.select("query", "weight", F.explode("docs").alias("doc"))
    return rows.groupBy("query", F.col("doc.key").alias("key")).agg(F.sum(F.col("weight") * F.col("doc.share")).alias("score"))


def _parts(spark: SparkSession, path: str, at: dict, weights: DataFrame, bounds: DataFrame, k: int, first: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of every query that are scored first, and those of the others that may hold one of its ``k`` best."""
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    placed = bounds.withColumn("place", F.row_number().over(order))
    promising = placed.where(F.col("place") <= first)
    seen = _ranked(_scored(spark, path, at, weights, promising).where("score > 0"), "query", "key", k)
    least = seen.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    others = placed.where(F.col("place") > first).join(least, "query", "left")
    # Scores that agree to nine digits are ties, so a block is skipped only where it is clearly below.
    return promising, others.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))


def block_counts(spark: SparkSession, path: str, queries: DataFrame, query: str, k: int = 10, first: int = FIRST) -> DataFrame:
    """``query, blocks, scored``: how many blocks hold a term of the query, and how many are scored."""
    at = current(spark, path)
    weights, bounds = _bounds(spark, path, at, queries, query)
    promising, rest = _parts(spark, path, at, weights, bounds, k, first)
    scored = promising.select("query").unionByName(rest.select("query")).groupBy("query").agg(F.count("*").alias("scored"))
    return bounds.groupBy("query").agg(F.count("*").alias("blocks")).join(scored, "query").withColumnRenamed("query", query)
