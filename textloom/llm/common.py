"""Shared plumbing of the corpus operators: written tables and row identity."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and runs in one process (local tests) a temporary one is set.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most so many rows reach a Python worker at once: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it at most so many rows reach a Python worker at once: rows may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage in a way that survives lost executors.  The files go with
    the session, or earlier by ``discard``.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _files(df.sparkSession, path)
    files.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        files, at = _files(df.sparkSession, folder)
        files.delete(at, True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def wrapped(docs: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unwrapped(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """``row``'s fields and the added columns, which win over fields of their name."""
    low = {c.lower() for c in added}
    kept = [F.col("row").getField(f.name).alias(f.name) for f in df.schema["row"].dataType.fields if f.name.lower() not in low]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])


def row_ids(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, bool]:
    """``doc_id`` where it is a key; else a hash of id and text, and true.  Over ``wrapped`` rows."""
    ids = docs.select(F.col(doc_id).alias("id"))
    shared = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").limit(1).count()
    doc, body = F.col("row").getField(doc_id), F.col("row").getField(text)
    return (F.xxhash64(doc, body), True) if shared else (doc.cast("long"), False)


def coded(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int, int]:
    """``row, text, code``; the bits that a place in the longest text needs; the bytes of all texts.

    Codes are longs that ascend with ``doc_id``, null first, and leave room for the bits
    of a place.  Where ids repeat or spread too far, the distinct rows are numbered, by
    id and then by two 64-bit hashes of the text: only rows equal in both share a code.
    """
    rows = wrapped(docs)
    rows = rows.select("row", F.col("row").getField(text).alias("text"), F.col("row").getField(doc_id).cast("long").alias("id"))
    low, high, longest, volume = rows.agg(F.min("id"), F.max("id"), F.max(F.octet_length("text")), F.sum(F.octet_length("text"))).first()
    shift, volume = int(longest or 1).bit_length(), int(volume or 0)
    shared = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not shared and ((high or 0) - (low or 0) + 2) << shift < 1 << 62:
        return rows.select("row", "text", F.coalesce(F.col("id") - F.lit((low or 0) - 1), F.lit(0).cast("long")).alias("code")), shift, volume
    tags = {"tag1": F.xxhash64("text"), "tag2": F.xxhash64(F.lit("again"), F.col("text"))}
    tagged = rows.withColumns(tags)
    keys = written(tagged.select("id", *tags).distinct().orderBy(F.col("id").asc_nulls_first(), *tags).withColumn("at", F.monotonically_increasing_id()), "codes")
    part = F.shiftright("at", 33)
    begins, total = [], 0
    for p, n in sorted(keys.groupBy(part.alias("part")).count().collect()):  # one row a partition
        begins.append((p, total))
        total += n
    begins = docs.sparkSession.createDataFrame(begins, "part long, begin long")
    keys = keys.withColumn("part", part).join(F.broadcast(begins), "part").select(F.col("id").alias("key"), *[F.col(t).alias(f"key_{t}") for t in tags], (F.col("begin") + F.col("at") - F.shiftleft("part", 33)).alias("code"))
    same = [F.col("id").eqNullSafe(F.col("key")), *[F.col(t) == F.col(f"key_{t}") for t in tags]]
    return tagged.join(keys, same).select("row", "text", "code"), shift, volume
