"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.chunking import recursive_chunk
from textloom.operators.metering import LIMIT, WINDOW_SECONDS, accept

#: The setting that jobs with keyed state need, and its value.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_usage_month(events: DataFrame, late: str = "40 days") -> DataFrame:
    """``month, n, spend`` so far, by UTC month; a month is closed ``late`` after its last event."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    month = F.date_trunc("month", "ts").alias("month")
    return timed.groupBy(month).agg(F.count("*").alias("n"), F.sum("value").alias("spend"))


class _Limiter(StatefulProcessor):
    """Waiting events of a key, and its accepted times in the window; a timer stands at the earliest waiting event."""

    def __init__(self, kind: str, limit: int, micros: int):
        self.kind, self.limit, self.micros = kind, limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"t bigint, tie {self.kind}")
        self.held = handle.getValueState("held", "times array<bigint>")
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, t: int) -> None:
        """A timer for when all events up to ``t`` (microseconds) have come."""
        at = t // 1000 + 1
        if self.timer.exists():
            (old,) = self.timer.get()
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.appendList(list(zip(pdf["t"].tolist(), pdf["tie"].tolist())))
            self._wake(int(pdf["t"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        every = sorted(self.waiting.get())
        due = [x for x in every if x[0] // 1000 < passed]
        held = deque(self.held.get()[0] if self.held.exists() else [])
        accepted = accept([t for t, _ in due], held, self.limit, self.micros)
        self.held.update((list(held),))
        self.timer.clear()
        if len(due) < len(every):
            self.waiting.put(every[len(due) :])
            self._wake(every[len(due)][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame({"tie": [x for _, x in due], "key": [key[0]] * len(due), "accepted": accepted}, dtype=object)


def stream_rate_limit(events: DataFrame, key: str, ts: str, tie: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """``tie, key, accepted`` as the batch operator gives, whatever the order of arrival within ``late``.

    Events wait in state until the watermark has passed them and then go in order, across
    micro-batches; those that come later than ``late`` are dropped.  A key's state is its events of
    the last ``late`` and at most ``limit`` accepted times.  Needs the RocksDB state store (see
    ``ROCKSDB``).
    """
    kind = events.schema[tie].dataType.simpleString()
    rows = events.select(F.col(tie).alias("tie"), F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.withColumn("t", F.unix_micros("ts"))
    done = rows.groupBy("key").transformWithStateInPandas(_Limiter(kind, limit, seconds * 1_000_000), f"tie {kind}, key string, accepted boolean", "Append", "EventTime")
    return done.select(F.col("tie").alias(tie), F.col("key").alias(key), "accepted")


def stream_ingest(docs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Chunks of arriving documents into the folder ``table``, the last version of each in a batch.

    A batch writes its own folder, over what a failed attempt left there, so a retry changes
    nothing and no earlier chunk is rewritten; :func:`read_chunks` gives the current ones.
    Column ``version`` orders the versions of a document within a batch.
    """

    def ingest(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("doc_id").agg(F.max_by("text", "version").alias("text"))
        ids = latest.select(F.regexp_replace(F.col("doc_id").cast("string"), "/", "_").alias("document_id"))
        # A document without chunks still replaces what it had.
        rows = ids.join(recursive_chunk(latest), "document_id", "left")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return docs.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chunks(spark: SparkSession, table: str) -> DataFrame:
    """Every document's chunks of the last batch that held it."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["document_id", "batch"]).where("chunk_id is not null").drop("batch")


class _Fold(StatefulProcessor):
    """Per key the last value of each scalar field, and the items of each list field."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scalars = handle.getMapState("scalars", "field string", "seq bigint, value string")
        self.items = handle.getListState("items", "field string, seq bigint, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scalars, lists, items = set(), set(), []
        for pdf in rows:
            for field, seq, value, appends in zip(pdf["field"], pdf["seq"].tolist(), pdf["value"], pdf["appends"]):
                if appends:
                    items.append((field, seq, value))
                    lists.add(field)
                    continue
                at = (field,)
                if not self.scalars.containsKey(at) or tuple(self.scalars.getValue(at)) <= (seq, value):
                    self.scalars.updateValue(at, (seq, value))
                scalars.add(field)
        out = [(key[0], f, self.scalars.getValue((f,))[1], None) for f in sorted(scalars)]
        if items:
            self.items.appendList(items)
            every = sorted(tuple(x) for x in self.items.get() if x[0] in lists)
            out += [(key[0], f, None, [v for g, _, v in every if g == f]) for f in sorted(lists)]
        yield pd.DataFrame(out, columns=["key", "field", "value", "items"], dtype=object)


_STATE = "key string, field string, value string, items array<string>"


def _updates(updates: DataFrame) -> DataFrame:
    return updates.select(F.col("key").cast("string").alias("key"), "field", F.col("seq").cast("long").alias("seq"), "value", F.coalesce("appends", F.lit(False)).alias("appends")).where("value is not null and field is not null")


def stream_state_fold(updates: DataFrame) -> DataFrame:
    """``key, field, value, items``: the new state of the fields that a micro-batch touched.

    ``updates`` has ``key, seq, field, value, appends``.  A field that appends collects its values in
    order of ``seq`` (equal ones in order of value), another is overwritten by the value of greatest
    ``seq`` (then value), whatever the order of arrival; empty strings count, nulls are no update.
    The last row a key and field is the batch twin's.  Needs the RocksDB state store (see ``ROCKSDB``).
    """
    return _updates(updates).groupBy("key").transformWithStateInPandas(_Fold(), _STATE, "Update", "None")


def state_fold(updates: DataFrame) -> DataFrame:
    """Batch twin of :func:`stream_state_fold`: the last state of every key and field."""
    rows = _updates(updates)
    at = F.struct("seq", "value")
    scalars = rows.where("not appends").groupBy("key", "field").agg(F.max(at)["value"].alias("value"))
    lists = rows.where("appends").groupBy("key", "field").agg(F.transform(F.sort_array(F.collect_list(at)), lambda x: x["value"]).alias("items"))
    return scalars.withColumn("items", F.lit(None).cast("array<string>")).unionByName(lists.withColumn("value", F.lit(None).cast("string")))
