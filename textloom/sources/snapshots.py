"""Chunks of documents in versions: writes are prepared aside and become visible by one small file.

A store is a folder.  ``data/<id>`` holds what one write brought: ``chunks``, and ``heads``, a row
a document with the hash of its body and its number of chunks.  ``log/<number>`` names such a
folder; a log file is created only where none is, so two writers never share a number, and
until it is there nobody reads the folder.  A document is what the last log entry that
holds its head says.  Files are never rewritten: a write leaves other documents' files alone,
and what a failed or lost write left behind is read by nobody.  ``compact`` brings the current
state into one folder; readers start at the last such entry.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.chunking import OVERLAP, SIZE, recursive_chunk
from textloom.sources import folders
from textloom.sources.files import parse_front_matter

HEADS = "document_id string, hash string, n_chunks long"
CHUNKS = "document_id string, chunk_index int, chunk_id string, text string"
#: Fields of a document that its chunks carry.
FIELDS = ("title", "source", "source_url")


def _document_id(column: Column) -> Column:
    return F.regexp_replace(column.cast("string"), "/", "_")


class ChunkStore:
    """Versioned chunks under ``path``."""

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = ()):
        self.spark, self.path, self.fields = spark, path.rstrip("/"), fields
        self._chunks = ", ".join([CHUNKS, *[f"{f} string" for f in fields]])

    def version(self) -> int:
        """The number of the last log entry, 0 before the first."""
        found = folders.names(self.spark, f"{self.path}/log")
        return int(found[-1]) if found else 0

    def _entries(self, version: int | None = None) -> list[tuple[int, str]]:
        """Log entries that count for a version: number and folder, from the last full one on."""
        out = []
        for name in folders.names(self.spark, f"{self.path}/log"):
            if version is None or int(name) <= version:
                entry = json.loads(folders.content(self.spark, f"{self.path}/log/{name}"))
                out = [(int(name), entry["folder"])] if entry["full"] else [*out, (int(name), entry["folder"])]
        return out

    def _read(self, kind: str, schema: str, entries: list[tuple[int, str]]) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/data/{folder}/{kind}").withColumn("version", F.lit(n)) for n, folder in entries]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, version int")

    def heads(self, version: int | None = None) -> DataFrame:
        """``document_id, hash, n_chunks, version`` of all documents, the last of each."""
        rows = self._read("heads", HEADS, self._entries(version))
        last = rows.groupBy("document_id").agg(F.max_by(F.struct("hash", "n_chunks", "version"), "version").alias("last"))
        return last.select("document_id", "last.*").where("hash is not null")

    def chunks(self, version: int | None = None) -> DataFrame:
        """The chunks of all documents, those of each document's last version alone."""
        entries = self._entries(version)
        return self._read("chunks", self._chunks, entries).join(self.heads(version).select("document_id", "version"), ["document_id", "version"], "left_semi").drop("version")

    def _commit(self, chunks: DataFrame, heads: DataFrame, full: bool = False) -> int:
        folder = uuid.uuid4().hex
        chunks.write.parquet(f"{self.path}/data/{folder}/chunks")
        heads.write.parquet(f"{self.path}/data/{folder}/heads")
        return self._log(folder, full)

    def _log(self, folder: str, full: bool) -> int:
        while True:
            number = self.version() + 1
            if folders.create(self.spark, f"{self.path}/log/{number:08d}", json.dumps({"folder": folder, "full": full})):
                return number

    def replace(self, docs: DataFrame, chunker=recursive_chunk) -> int:
        """Put documents (``doc_id, text`` and the fields) in place of their former versions; returns the version.

        ``chunker`` gives ``document_id, chunk_index, chunk_id, text``.  Documents whose body and fields are as
        stored are left out, so a rerun changes nothing and makes no version.  Of rows that share
        an id the greatest text counts; null ids are no documents.  A text without chunks leaves none.
        """
        body = F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), *self.fields)).alias("row")
        given = docs.where("doc_id is not null").groupBy(_document_id(F.col("doc_id")).alias("document_id")).agg(body)
        given = given.select("document_id", "row.*").withColumn("hash", F.sha2(F.to_json(F.struct("text", *self.fields), {"ignoreNullFields": "false"}), 256))
        fresh = given.join(self.heads().select("document_id", "hash"), ["document_id", "hash"], "left_anti")
        # The new texts are written once: chunks, heads and their number are made of the same rows.
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        fresh.write.parquet(f"{at}/texts")
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{at}/texts")
        if fresh.isEmpty():
            return self.version()
        cut = chunker(fresh.select(F.col("document_id").alias("doc_id"), "text")).select("document_id", "chunk_index", "chunk_id", "text")
        if self.fields:
            cut = cut.join(fresh.select("document_id", *self.fields), "document_id")
        cut.write.parquet(f"{at}/chunks")
        counts = self.spark.read.schema(self._chunks).parquet(f"{at}/chunks").groupBy("document_id").agg(F.count("*").alias("n_chunks"))
        heads = fresh.select("document_id", "hash").join(counts, "document_id", "left").select("document_id", "hash", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))
        heads.write.parquet(f"{at}/heads")
        return self._log(folder, False)

    def delete(self, ids: DataFrame) -> int:
        """Take documents (``doc_id``) away; ids that aren't there make no version."""
        gone = self.heads().join(ids.select(_document_id(F.col("doc_id")).alias("document_id")).distinct(), "document_id", "left_semi")
        if gone.isEmpty():
            return self.version()
        heads = gone.select("document_id", F.lit(None).cast("string").alias("hash"), F.lit(0).cast("long").alias("n_chunks"))
        return self._commit(self.spark.createDataFrame([], self._chunks), heads)

    def compact(self) -> int:
        """One folder with the current state."""
        return self._commit(self.chunks(), self.heads().drop("version"), True)


def ingest_single_document(store: ChunkStore, document_id: str | None, text: str | None, source: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> int:
    """Check, chunk and replace one document; returns its number of chunks.

    Id and text are trimmed and the text loses invisible characters; either being empty is an
    error, as is a text that gives no chunk.  Front matter gives title and url; the source is
    ``ui/<id>`` unless given.  ``store`` has the fields of ``FIELDS``.
    """
    spark = store.spark
    name = (document_id or "").strip()
    if not name:
        raise ValueError("document_id must not be empty")
    whole = F.regexp_replace(T.strip_invisible(F.lit(text or "")), r"^\s+|\s+$", "")
    fields, body = parse_front_matter(F.col("whole"))
    row = spark.range(1).select(whole.alias("whole")).select(F.lit(name).alias("doc_id"), fields.alias("fields"), body.alias("text"), "whole")
    field = lambda n: F.nullif(F.col("fields")[n], F.lit(""))
    title = T.resolve_title(field("title"), F.col("text"), F.lit(name))
    row = row.select("doc_id", "text", "whole", title.alias("title"), F.lit(source or f"ui/{name}").alias("source"), F.coalesce(field("source_url"), F.lit("")).alias("source_url"))
    found = row.select("whole", "text").first()
    if not found["whole"]:
        raise ValueError("text must not be empty")
    chunker = lambda docs: recursive_chunk(docs, size, overlap)
    n = chunker(row.select("doc_id", "text")).count()
    if not n:
        raise ValueError("no chunks made from the text")
    store.replace(row.select("doc_id", "text", *FIELDS), chunker)
    return n
