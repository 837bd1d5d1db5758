"""Chunking by a cascade of separators, one pass over each document."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators in order of preference, size and overlap in characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SIZE, OVERLAP = 800, 100
#: Characters of texts whose chunks a task holds at once.
LOT = 1 << 20


def _parts(text: str, separator: str) -> list[str]:
    """Parts that join to the text; each but the first starts with the separator."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *(separator + r for r in rest)] if p]


def _packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Parts joined up to ``size``; a chunk starts with at most ``overlap`` characters of the one before."""
    held, length = deque(), 0
    for part in parts:
        if held and length + len(part) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.popleft())
        held.append(part)
        length += len(part)
    if held:
        yield "".join(held)


def cut(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Chunks of at most ``size`` characters, blank ones left out."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    run: list[str] = []
    for part in _parts(text, separators[at]):
        if len(part) <= size:
            run.append(part)
            continue
        yield from filter(None, map(str.strip, _packed(run, size, overlap)))
        run = []
        yield from cut(part, size, overlap, separators[at + 1 :] or ("",))
    yield from filter(None, map(str.strip, _packed(run, size, overlap)))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most so many rows reach a Python worker at once: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def lots(batches: Iterator[pd.DataFrame], text: str = "text", most: int = LOT) -> Iterator[pd.DataFrame]:
    """The rows of the batches in order, in lots of at most ``most`` characters of text or of one row."""
    for batch in batches:
        begin, held = 0, 0
        for i, n in enumerate(batch[text].map(len)):
            if i > begin and held + n > most:
                yield batch.iloc[begin:i]
                begin, held = i, 0
            held += n
        yield batch.iloc[begin:]


def recursive_chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``document_id, chunk_index, chunk_id, text``.

    An overlap of ``size`` or more counts as ``size - 1``; null and blank texts have no chunks.
    """
    overlap = min(overlap, size - 1)
    small_batches(docs.sparkSession)

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in lots(batches):
            rows = [(d, i, c) for d, t in zip(batch["document_id"], batch["text"]) for i, c in enumerate(cut(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "text"])

    document = F.regexp_replace(F.col("doc_id").cast("string"), "/", "_").alias("document_id")
    found = docs.where("trim(text) <> ''").select(document, "text").mapInPandas(chunked, "document_id string, chunk_index int, text string")
    return found.select("document_id", "chunk_index", F.concat("document_id", F.lit("__chunk_"), "chunk_index").alias("chunk_id"), "text")


def chunk_size_sweep(docs: DataFrame, sizes: tuple[int, ...] = (100, 500)) -> DataFrame:
    """Chunks of several sizes in one table, told apart by ``config_id``."""
    found = None
    for size in sizes:
        chunks = recursive_chunk(docs, size, 0).withColumn("config_id", F.lit(size))
        found = chunks if found is None else found.unionByName(chunks)
    return found
