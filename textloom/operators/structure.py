"""Structure-aware chunking: rows and sections stay whole where a text has them.

Units (sections or paragraphs, cut at row marks) are packed greedily; each step depends on the one
before, so a document is folded in its own row, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.chunking import OVERLAP, SIZE, cut, lots, small_batches

# What opens a section, a row, a numbered row; and a section's label.
SECTION = re.compile(r"Grade \d+ Learning progression|Supporting [^\n|]{8,120}(?:K-\d+|K-8)", re.I)
ROW = re.compile(r"(?:^|[\n.]\s*)(Topic \d+:|Unit \d+:|Mission \d+, Topic [A-Z]|Mission \d+:)", re.I | re.M)
SIGNAL = re.compile(r"Grade \d+ Learning progression|Topic \d+:|Unit \d+:|Mission \d+:", re.I)
NUMBERED, TOPIC = re.compile(r"(?=Topic \d+:|Unit \d+:)", re.I), re.compile(r"Topic (\d+):", re.I)
ANY_ROW = re.compile(r"Topic \d+:|Unit \d+:|Mission \d+:", re.I)
GRADE = re.compile(r"Grade (\d+) Learning progression", re.I)
TOPIC_ROW = re.compile(r"(Grade \d+ Learning progression \| )?(Topic \d+:|Unit \d+:)", re.I)
HEADING = re.compile(r"(?m)^(?=#{1,6}\s+\S)")
_EDGE = " .\n"


def source_type(page_number: Column, source: Column) -> Column:
    """``pdf`` where there is a page number, ``markdown`` by the file's ending, else ``text``."""
    return F.when(page_number.isNotNull(), "pdf").when(F.lower(source).endswith(".md"), "markdown").otherwise("text")


def _paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]


def split_rows(text: str) -> list[str]:
    """A text cut where sections and rows begin."""
    starts = sorted({m.start() for m in SECTION.finditer(text)} | {m.start(1) for m in ROW.finditer(text)})
    edges = [0, *starts, len(text)]
    pieces = [text[a:b].strip(_EDGE) for a, b in zip(edges, edges[1:-1])] + [text[edges[-2] :].strip()]
    return [p for p in pieces if p]


def _topics(unit: str) -> list[str]:
    """A unit of several numbered rows as one each; what stands before the first is dropped."""
    starts = [m.start() for m in NUMBERED.finditer(unit)]
    if len(starts) < 2:
        return [unit]
    return [p for p in (unit[a:b].strip(_EDGE) for a, b in zip(starts, [*starts[1:], len(unit)])) if p]


def _with_intros(units: list[str]) -> Iterator[str]:
    """A section's heading joins the unit after it."""
    rest = iter(units)
    for unit in rest:
        if SECTION.search(unit) and not ROW.search(unit) and (following := next(rest, None)) is not None:
            unit = f"{unit.strip()} {following.strip()}".strip()
        yield unit


def labelled(units: list[str], series: str, product: str) -> list[str]:
    """Row units with their section's label in front, and that of series, grade and topic, where they lack them."""
    grade, out = None, []
    for unit in units:
        if m := GRADE.search(unit):
            grade = m[1]
        if grade and ANY_ROW.search(unit):
            section = f"Grade {grade} Learning progression"
            if section.lower() not in unit.lower():
                unit = f"{section} | {unit}"
            if (m := TOPIC.search(unit)) and (label := f"{series} Grade {grade} Topic {m[1]}".strip()).lower() not in unit.lower():
                mission = re.search(rf"{re.escape(product)} Mission (\d+)", unit, re.I) if product else None
                unit = f"{label}{f' {product} Mission {mission[1]}' if mission else ''} | {unit}"
        out.append(unit)
    return out


def units_of(text: str, kind: str, series: str = "", product: str = "") -> list[str]:
    """Ordered units of a text of a source type."""
    base = []
    for part in HEADING.split(text) if kind == "markdown" else [text]:
        base += [part.strip()] if kind == "markdown" and part.startswith("#") else _paragraphs(part)
    cut_up = [u for b in base if b for u in (split_rows(b) if SIGNAL.search(b) and ROW.search(b) else [b])]
    return [u for u in labelled([t for u in _with_intros(cut_up) for t in _topics(u)], series, product) if u.strip()]


def pack_units(units: list[str], size: int, overlap: int) -> list[str]:
    """Units joined by spaces up to ``size``; a chunk may begin with the last units of the one before.

    No more than ``overlap`` characters are repeated, and none if that would make the chunk too long.
    A unit over ``size`` is split on its own; no chunk has two rows that begin a topic.
    """
    chunks, held = [], []

    def close() -> None:
        if held:
            chunks.append(" ".join(held))
            held.clear()

    for unit in filter(None, (u.strip() for u in units)):
        if len(unit) > size:
            close()
            chunks.extend(cut(unit, size, overlap))
        elif held and TOPIC_ROW.match(unit) and any(TOPIC_ROW.match(h) for h in held):
            close()
            held.append(unit)
        elif held and len(" ".join(held)) + 1 + len(unit) > size:
            seed = next((held[i:] for i in range(len(held)) if len(" ".join(held[i:])) <= overlap), [])
            close()
            held.extend(seed if len(" ".join([*seed, unit])) <= size else [])
            held.append(unit)
        else:
            held.append(unit)
    close()
    return chunks


def structured(text: str, kind: str, size: int, overlap: int, series: str = "", product: str = "") -> list[str]:
    """Chunks of one text: packed units where it has structure, else the whole or the plain splitter."""
    text = text.strip()
    units = units_of(text, kind, series, product)
    if not (SIGNAL.search(text) or (len(units) > 1 and any(ROW.search(u) for u in units))):
        return [text] if 0 < len(text) <= size else list(cut(text, size, overlap))
    return labelled(pack_units(units, size, overlap) or list(cut(text, size, overlap)), series, product)


def structure_chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, series: str = "", product: str = "") -> DataFrame:
    """``document_id, chunk_index, chunk_id, text`` of ``doc_id, text, source`` and, if there, ``page_number``.

    Rows that share a ``doc_id`` (pages, files) are numbered together, by source and page.  Null and
    blank texts have no chunks; an overlap of ``size`` or more counts as ``size - 1``.
    """
    overlap = min(overlap, size - 1)
    small_batches(docs.sparkSession)
    page = F.col("page_number").cast("int") if "page_number" in docs.columns else F.lit(None).cast("int")
    document = F.regexp_replace(F.col("doc_id").cast("string"), "/", "_")
    rows = docs.where("trim(text) <> ''").select(document.alias("document_id"), F.col("source").cast("string").alias("source"), page.alias("page"), source_type(page, F.col("source")).alias("kind"), "text")

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in lots(batches):
            parts = [structured(t, k, size, overlap, series, product) for t, k in zip(pdf["text"], pdf["kind"])]
            yield pd.DataFrame({"document_id": pdf["document_id"], "source": pdf["source"], "page": pdf["page"], "parts": parts})

    return numbered(rows.mapInPandas(chunked, "document_id string, source string, page int, parts array<string>"))


def numbered(rows: DataFrame) -> DataFrame:
    """Chunks of rows ``document_id, source, page, parts``, numbered through each document."""
    # Only documents of several rows need an order among these: each row learns how many chunks precede it.
    sized = rows.withColumn("n", F.size("parts")).withColumn("before", F.coalesce(F.expr(
        "sum(n) over (partition by document_id order by source, page, parts rows between unbounded preceding and 1 preceding)"), F.lit(0)))
    chunks = sized.select("document_id", "before", F.posexplode("parts").alias("at", "text"))
    index = (F.col("before") + F.col("at")).cast("int")
    return chunks.select("document_id", index.alias("chunk_index"), F.concat("document_id", F.lit("__chunk_"), index.cast("string")).alias("chunk_id"), "text")
