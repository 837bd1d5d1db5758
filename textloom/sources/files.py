"""Readers and writers of corpus files; every path may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import strip_invisible

_DOCUMENT = "document_id string, title string, source_url string, text string"


def parse_front_matter(text: Column) -> tuple[Column, Column]:
    """Fields and body: a leading ``---`` block as a map (last key wins), and what follows it.

    Values lose the quotes around them, the body its blank ends.  Lines without a colon are left out; an unclosed block gives an empty map and the whole text.
    """
    block = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n?---[ \t]*(?:\r?\n|$)(.*)$"
    closed = text.rlike(block)
    unquoted = lambda v: F.regexp_replace(F.trim(v), r"""^["']+|["']+$""", "")
    lines = F.filter(F.split(F.regexp_extract(text, block, 1), r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring(x, F.lit(1), F.instr(x, ":") - 1)).alias("k"), unquoted(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    fields = F.when(closed, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))
    return fields, F.when(closed, F.regexp_replace(F.regexp_extract(text, block, 2), r"^\s+|\s+$", "")).otherwise(text)


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``document_id, title, source_url, text`` of all ``.md`` and ``.txt`` files under a folder.

    Markdown takes id, title and url from its front matter, else the id from the file name.
    Blank bodies are left out; a missing folder has no documents.
    """
    try:
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,MD,txt,TXT}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _DOCUMENT)
    files = files.select(F.col("_metadata.file_name").alias("name"), strip_invisible(F.col("value")).alias("value"))
    fields, body = parse_front_matter(F.col("value"))
    markdown = F.lower("name").endswith(".md")
    rows = files.select("name", F.when(markdown, fields).alias("fields"), F.when(markdown, body).otherwise(F.col("value")).alias("text"))
    field = lambda name: F.nullif(F.col("fields")[name], F.lit(""))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    found = rows.select(F.coalesce(field("document_id"), stem).alias("document_id"), F.coalesce(field("title"), stem).alias("title"), F.coalesce(field("source_url"), F.lit("")).alias("source_url"), "text")
    return found.where(F.trim("text") != "")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that each hold one JSON array (a question list)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped and a missing path has no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parse_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``url, lastmod`` of sitemaps; where a url repeats, its last entry stays (files in order of their paths).

    A file without ``<url>`` entries gives its bare ``<loc>`` ones, with no date.  A sitemap file is
    small (the protocol allows 50 MB), so each is read whole and its entries are numbered.
    """
    inner = lambda tag: rf"(?s)<(?:\w+:)?{tag}\s*>(.*?)</(?:\w+:)?{tag}\s*>"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"(?s)<!--.*?-->", "").alias("xml"))
    entries = F.regexp_extract_all("xml", F.lit(inner("url")), F.lit(1))
    bare = F.transform(F.regexp_extract_all("xml", F.lit(inner("loc")), F.lit(1)), lambda x: F.concat(F.lit("<loc>"), x, F.lit("</loc>")))
    rows = files.select("file", F.posexplode(F.when(F.size(entries) > 0, entries).otherwise(bare)).alias("at", "entry"))

    def plain(tag):
        out = F.regexp_extract("entry", inner(tag), 1)
        for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
            out = F.replace(out, F.lit(f"&{name};"), F.lit(mark))
        return F.nullif(F.regexp_replace(out, r"^\s+|\s+$", ""), F.lit(""))

    rows = rows.select("file", "at", plain("loc").alias("url"), plain("lastmod").alias("lastmod")).where("url is not null")
    return rows.groupBy("url").agg(F.max_by("lastmod", F.struct("file", "at")).alias("lastmod"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields kept."""
    df.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in each part and quotes doubled."""
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``filename, url`` of a manifest's ``pdfs``; entries without either are left out, of a repeated name the last counts.

    A missing or broken manifest has no rows.
    """
    schema = "filename string, url string"
    try:
        rows = spark.read.schema("pdfs array<struct<filename:string,url:string>>").option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    entries = rows.select(F.posexplode("pdfs").alias("pos", "p")).select("pos", "p.filename", "p.url")
    entries = entries.where("trim(filename) <> '' and trim(url) <> ''")
    return entries.groupBy("filename").agg(F.max_by("url", "pos").alias("url"))


def write_eval_json(results: DataFrame, path: str) -> None:
    """Check results, one JSON object a line."""
    write_jsonl(results, path)


def read_eval_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Check results as written, null where there are none."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
