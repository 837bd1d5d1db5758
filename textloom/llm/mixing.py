"""Mixing sources to target weights, with DataFrame functions only.

Targets: sources in code point order (null last) weigh ``weights``, repeating,
and share ``share`` times all sizes; a target stops at ``most`` times its
source's size and the excess is shared again by weight until none is above.

Order within a source is Efraimidis-Spirakis: an exponential key ``-ln(u) / q``
with ``u`` a hash of the id and ``q`` the document's quality weight, smallest
first.  Whole epochs come first: with target ``T`` and source size ``S`` every
document is taken ``floor(T / S)`` times; then documents are taken in key order
until their prefix sum reaches the rest, the last one in part.

No sort of a source: keys fall into buckets whose sums locate the bucket in
which the prefix sum reaches the rest, and only that bucket's rows are ordered.
What comes back to all rows is one row a source; it is broadcast only if there
are at most ``BROADCAST_SOURCES`` of them.

Defined cases: null text has size 0 and takes 0; null source is a source of its
own; at the cut, rows equal in id (or without one) and in quality weight share in
proportion to their sizes, rounded down, what their key gets; an empty table
gives an empty table; other columns pass through and the operator's replace their
like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unwrapped, wrapped, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUCKETS = 1 << 16
BROADCAST_SOURCES = 10_000


def quality_weight(text: Column) -> Column:
    """Share of letters in the text, at least 0.05; 1 for an empty one."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.when(F.length(text) > 0, F.greatest(letters / F.length(text), F.lit(0.05))).otherwise(F.lit(1.0))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """``docs`` and ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted)."""
    row = F.col("row")
    body = row.getField(text)
    name = F.concat(F.coalesce(row.getField(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}"))
    u = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))
    rows = wrapped(docs).select(
        "row",
        row.getField(source).cast("string").alias("source"),
        row.getField(doc_id).alias("id"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.log(u) / quality_weight(body)).alias("key"),
    ).withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int"))

    # One slim row a document, written once: texts are read here and for the result only.
    slim = written(rows.select("source", "id", "size", "key", "bucket"), "sizes")
    sums = written(slim.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")), "buckets")
    targets = _targets(sums, weights, share, most)
    # The bucket of each source in which the prefix sum reaches what is left after whole epochs.
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    reached = (
        sums.withColumn("upto", F.sum("in_bucket").over(by_bucket))
        .join(targets, F.expr("source <=> of_source"))
        .where("upto >= rest and upto - in_bucket < rest")
        .select("of_source", F.col("bucket").alias("edge"), (F.col("upto") - F.col("in_bucket")).alias("before"))
    )
    plan = targets.join(reached.withColumnRenamed("of_source", "r_source"), F.expr("of_source <=> r_source"), "left")
    plan = written(plan.drop("r_source"), "plan")
    small = plan.count() <= BROADCAST_SOURCES
    plan = F.broadcast(plan) if small else plan

    # Only that bucket is ordered; documents equal in key and id stand as one there.
    edge = slim.join(plan, F.expr("source <=> of_source and bucket = edge")).groupBy("of_source", "before", "rest", "key", "id").agg(F.sum("size").alias("sizes"))
    in_edge = Window.partitionBy("of_source").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("sizes").over(in_edge)).where("upto >= rest and upto - sizes < rest")
    part = (F.col("rest") - F.col("upto") + F.col("sizes")).alias("part")
    cut = written(edge.select(F.col("of_source").alias("c_source"), F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), "sizes", part), "cut")
    plan = plan.join(cut, F.expr("of_source <=> c_source"), "left").drop("c_source")

    found = rows.join(F.broadcast(plan) if small else plan, F.expr("source <=> of_source"), "left")
    tied = F.col("key") == F.col("cut_key")
    last = tied & F.col("id").eqNullSafe(F.col("cut_id"))
    smaller = F.coalesce(F.col("id") < F.col("cut_id"), F.col("id").isNull() & F.col("cut_id").isNotNull())
    before = (F.col("key") < F.col("cut_key")) | (tied & smaller)
    share_of_part = F.expr("part * size div sizes")
    more = F.when(F.col("cut_key").isNull(), 0).when(last, share_of_part).when(before, F.col("size")).otherwise(0)
    taken = (F.col("epochs") * F.col("size") + more).cast("long")
    return unwrapped(found, {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken})


def _targets(sums: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row a source; the windows without keys run over sources, not documents."""
    totals = sums.groupBy(F.col("source").alias("of_source")).agg(F.sum("in_bucket").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("of_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("all", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("of_source").asc_nulls_last())
    level = (F.col("all") - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("full", F.col("cap") <= level * F.col("weight"))
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(Window.partitionBy()), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(Window.partitionBy())
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("weight") / open_weight))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    return s.select("of_source", "source_size", "target", "epochs", "rest")
