"""Blocks of a text: array functions over the blocks of each row, and windows over exploded lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.sequences import overlap

#: Blocks are parted by blank lines.
BLANK = r"\n\s*\n"
# Labels of tabs, headings and lines around articles, and the blocks that end or pair them.
TAB_LABELS = ("build fluency", "learn concepts", "solve math problems", "write your work", "get real-time support", "show mastery", "teachers", "families", "systems")
ARTICLE_HEADINGS = ("at a glance", "share this article", "related articles")
ARTICLE_LINES = ("+", "notes", "written by", "join the conversation", "share this article")
RELEASE_HEADINGS = ("related articles", "notes")
LAST_HEADING = "related articles"
CONTENTS, CONTENTS_WORDS = "table of contents", 12


def blocks_of(text: Column, separator: str = BLANK) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x))


def plain(block: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(block, r"\s+", " ")))


def heading(block: Column) -> Column:
    """Text of a heading block's first line without its marks, else the line itself, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_extract(block, r"^([^\n]*)", 1), r"^#+\s*", "")))


def n_words(block: Column) -> Column:
    return F.size(F.filter(F.split(block, r"\s+"), lambda w: w != ""))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: an expression within a function of blocks is worked out for each block."""
    return F.get(F.transform(F.array(value), body), 0)


def dedupe_consecutive_blocks(blocks: Column, labels: tuple[str, ...] = TAB_LABELS) -> tuple[Column, Column]:
    """Blocks that differ from the one kept before, and how many were removed.

    Blank blocks and labels of tabs are left out and don't part equal blocks; blank ones aren't counted.
    """
    filled = F.transform(F.filter(blocks, lambda b: F.trim(b) != ""), lambda b: F.struct(b.alias("block"), plain(b).alias("plain")))

    def both(filled):
        bare = F.filter(filled, lambda b: ~b["plain"].isin(*labels))
        kept = bound(bare, lambda all_: F.filter(all_, lambda b, i: (i == 0) | (b["plain"] != F.get(all_, i - 1)["plain"])))
        return bound(kept, lambda k: F.struct(F.transform(k, lambda b: b["block"]).alias("kept"), (F.size(filled) - F.size(k)).alias("removed")))

    found = bound(filled, both)
    return found["kept"], found["removed"]


def truncate_after_marker(blocks: Column, headings: tuple[str, ...], lines: tuple[str, ...] = (), least_words: int = 0, last: str = LAST_HEADING) -> Column:
    """Blocks before the heading ``last``, without headings and lines of these names and without short blocks.

    A block under a top heading (one ``#``) stays whatever its length; empty headings go.
    """
    marked = lambda b: b.startswith("##")
    top = lambda b: b.rlike(r"^#\s")
    ends = F.array_position(F.transform(blocks, lambda b: marked(b) & (heading(b) == last)), F.lit(True))
    before = F.when(ends > 0, F.slice(blocks, F.lit(1), (ends - 1).cast("int"))).otherwise(blocks)
    named = lambda b: marked(b) & (heading(b).isin(*headings) | (heading(b) == ""))
    return F.filter(before, lambda b: (b != "") & (top(b) | (~named(b) & ~plain(b).isin(*lines, "") & (n_words(b) >= least_words))))


def article_body(blocks: Column, path: Column) -> Column:
    """The rule of the path: research pages, press releases, or all blocks."""
    research = truncate_after_marker(blocks, ARTICLE_HEADINGS, ARTICLE_LINES, 80)
    release = truncate_after_marker(blocks, RELEASE_HEADINGS, RELEASE_HEADINGS)
    return F.when(path.startswith("/research/"), research).when(path.startswith("/press-releases/"), release).otherwise(blocks)


def strip_heading_pairs(blocks: Column, name: str, body: str) -> Column:
    """Without each heading of this name whose next block holds the body, that block, and blocks that are the body."""
    def left(blocks):
        def pair(i):
            return (heading(F.get(blocks, i)) == name) & F.coalesce(plain(F.get(blocks, i + 1)).contains(body), F.lit(False))

        return F.filter(blocks, lambda b, i: ~pair(i) & ~((i > 0) & pair(i - 1)) & (plain(b) != body))

    return bound(blocks, left)


def strip_marked_blocks(blocks: Column, marks: tuple[tuple[str, ...], ...] = ()) -> Column:
    """Without tables of contents (alone, or a short block that starts so) and blocks that hold all of a tuple of marks."""
    def contents(p):
        return (p == CONTENTS) | (p.startswith(CONTENTS) & (n_words(p) <= CONTENTS_WORDS))

    def marked(b):
        out = b.rlike(T.spaced(CONTENTS)) & bound(plain(b), contents)
        for all_of in marks:
            every = F.lit(True)
            for m in all_of:
                every = every & plain(b).contains(m)
            out = out | every
        return out

    return F.filter(blocks, lambda b: ~marked(b))


def heading_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, unit``: a unit for each markdown heading with what follows it, and for each paragraph before the first."""
    parts = F.split(F.col(text), r"(?m)(?=^#{1,6}\s+\S)")
    marked = lambda p: p.rlike(r"^#{1,6}\s+\S")
    units = F.flatten(F.transform(parts, lambda p: F.when(marked(p), F.array(p)).otherwise(F.split(p, r"\n\n+"))))
    trimmed = F.filter(F.transform(units, lambda u: F.regexp_replace(u, r"^\s+|\s+$", "")), lambda u: u != "")
    return docs.select(key, F.posexplode(trimmed).alias("pos", "unit"))


def header_chunk(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, title, section, unit``: one chunk a markdown section, with the headings above it.

    ``title`` is the last first-level heading so far, ``section`` the last second-level one under it.
    """
    units = heading_sections(docs, key, text)
    found = lambda level: F.nullif(F.trim(F.regexp_extract("unit", rf"^#{{{level}}}\s+([^\n]+)", 1)), F.lit(""))
    so_far = Window.partitionBy(key).orderBy("pos")
    rows = units.withColumns({"h1": found(1), "h2": found(2)}).withColumn("part", F.count("h1").over(so_far))
    within = Window.partitionBy(key, "part").orderBy("pos")
    return rows.select(key, "pos", F.last("h1", True).over(so_far).alias("title"), F.last("h2", True).over(within).alias("section"), "unit")


def carry_section_label(units: DataFrame, key: str, pos: str, unit: str, label: str, row: str) -> DataFrame:
    """``units`` with ``labelled``: rows (by the pattern ``row``) get the last label (pattern's first match) before or in them.

    It is put in front only where the unit doesn't hold it, whatever the case.
    """
    own = F.nullif(F.regexp_extract(unit, label, 0), F.lit(""))
    carried = F.last(own, True).over(Window.partitionBy(key).orderBy(pos))
    rows = units.withColumn("carried", carried)
    wants = F.col("carried").isNotNull() & F.col(unit).rlike(row) & ~F.lower(unit).contains(F.lower("carried"))
    return rows.withColumn("labelled", F.when(wants, F.concat("carried", F.lit(" | "), F.col(unit))).otherwise(F.col(unit))).drop("carried")


#: A code line, lines without meaning, and a mapping line.
CODE, NOISE, MAPPING = r"(?i)^(?:K|\d+)\.[A-Z0-9]+(?:\.[A-Z0-9]+)*$", r"(?i)^(?:©|\d{1,3}$|.*\bSTANDARDS\b.*$|http)", r"(?i)^Mission\s+\d+"


def parse_standard_entries(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, code, description, mappings`` from ordered lines: a code line opens an entry.

    Lines before the first code and noise are ignored; lines describe until the first mapping; of a
    repeated code the last entry counts.  Lines of one text are numbered and meet in one group of it.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    by_line = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("code", F.when(F.col("line").rlike(CODE), F.upper(F.regexp_replace("line", r"\s+", "")))).withColumn("island", F.count("code").over(by_line))
    in_entry = Window.partitionBy(key, "island").orderBy("pos")
    mapping = F.col("line").rlike(MAPPING)
    lines = lines.where("island > 0").withColumn("mapped", F.sum(mapping.cast("int")).over(in_entry))
    use = F.col("code").isNull() & (F.col("line") != "") & ~F.col("line").rlike(NOISE)
    ordered = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("pos", "line")))), lambda x: x["line"])
    entries = lines.groupBy(key, "island").agg(
        F.max("code").alias("code"), F.array_join(ordered(use & ~mapping & (F.col("mapped") == 0)), " ").alias("description"), ordered(use & mapping).alias("mappings")
    )
    last = Window.partitionBy(key, "code").orderBy(F.desc("island"))
    return entries.withColumn("back", F.row_number().over(last)).where("back = 1").select(key, "code", "description", "mappings")


def standard_lookup(asked: DataFrame, entries: DataFrame, limit: int = 8) -> DataFrame:
    """``asked`` (``state, code``) with ``requested, found, description, mappings, similar, error``.

    ``entries`` has ``state, code, description, mappings``.  Codes are compared upper case and without
    space, states in lower case.  A code that isn't there gets up to ``limit`` codes of the state with the
    same first two parts, in order; an unknown state gets an error and no suggestions.
    """
    state = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    prefix = lambda c: F.array_join(F.slice(F.split(c, r"\."), 1, 2), ".")
    rows = asked.withColumn("ask_id", F.monotonically_increasing_id()).withColumns({"s": state(F.col("state")), "requested": F.upper(F.regexp_replace("code", r"\s+", ""))})
    known = entries.select(state(F.col("state")).alias("s"), F.col("code").alias("requested"), "description", "mappings").withColumn("p", prefix(F.col("requested")))
    states = known.select("s").distinct().withColumn("is_state", F.lit(True))
    keys = rows.select("s", prefix(F.col("requested")).alias("p")).distinct()
    # Only the first codes of a prefix can be suggested: one more than the limit, as the asked one goes.
    near = known.join(keys, ["s", "p"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("s", "p").orderBy("requested"))).where(F.col("n") <= limit + 1)
    near = near.groupBy("s", "p").agg(F.sort_array(F.collect_list("requested")).alias("codes"))
    both = rows.withColumn("p", prefix(F.col("requested"))).join(known.drop("p").withColumn("found", F.lit(True)), ["s", "requested"], "left").join(states, "s", "left").join(near, ["s", "p"], "left")
    found, none = F.coalesce("found", F.lit(False)), F.array().cast("array<string>")
    similar = F.slice(F.array_remove(F.coalesce("codes", none), F.col("requested")), 1, limit)
    return both.select(
        "state", "code", "requested", found.alias("found"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("mappings", none).alias("mappings"),
        F.when(found, none).otherwise(similar).alias("similar"), F.when(F.col("is_state").isNull(), F.concat(F.lit("unknown state: "), F.col("state"))).alias("error"),
    )


def overlap_text(chunks: DataFrame, key: str = "document_id", pos: str = "chunk_index", text: str = "text") -> DataFrame:
    """``key, pos, overlap``: the longest end of a chunk that begins the next one, in time linear in both; the last chunk has none."""
    following = F.coalesce(F.lead(text).over(Window.partitionBy(key).orderBy(pos)), F.lit(""))
    rows = chunks.select(key, pos, F.coalesce(text, F.lit("")).alias("own"), following.alias("following"))

    @F.pandas_udf("string")
    def shared(own: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([b[: overlap(a, b)] for a, b in zip(own, after)], dtype=object)

    return rows.select(key, pos, shared("own", "following").alias("overlap"))
