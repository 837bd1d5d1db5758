"""HTML pages to cleaned blocks: a small parser per page in Arrow batches, block rules as columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.sequences import difference
from textloom.operators import blocks as B

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "svg", "iframe", "video", "picture", "noscript", "template", "button"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "aside", "figure", "form"}
_LEVEL = {f"h{i}": i for i in range(1, 7)}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)


@dataclass(frozen=True)
class Layout:
    """What is content on a site: ``roots`` in order of preference, tags and classes to leave out, tab classes."""

    roots: tuple[str, ...] = ("main", "article", "body")
    left_out: tuple[str, ...] = ("nav", "footer", "aside")
    hidden: tuple[str, ...] = ("hide", "hidden")
    calls: tuple[str, ...] = ("ad", "cta", "button-row", "link-block")
    tab_label: str = "tab-link"
    tab_pane: str = "tab-pane"


PAGES, ARTICLES = Layout(), Layout(roots=("article",))


@cache
def _kinds(layout: Layout):
    """What a tag with such classes is: left out, the label of a tab, its pane."""

    @lru_cache(1024)
    def kind(tag: str, classes: str) -> tuple[bool, bool, bool]:
        names = classes.lower().split()
        hidden = any(c in layout.hidden or any(c.startswith(h + "-") or c.endswith("-" + h) for h in layout.hidden) for c in names)
        return tag in _SILENT or tag in layout.left_out or hidden or any(c in layout.calls for c in names), layout.tab_label in names, layout.tab_pane in names

    return kind


class _Reader(HTMLParser):
    """Blocks of the text within each root tag: ``[level of heading or 0, texts]``; broken nesting closes where it can.

    All roots are read in one pass: a part of a text has a bit for each root that it is in.
    """

    def __init__(self, layout: Layout):
        super().__init__(convert_charrefs=True)
        self.kind, self.bit, self.stack, self.opened, self.parts = _kinds(layout), {r: 1 << i for i, r in enumerate(layout.roots)}, [], {}, []
        self.found, self.skip, self.inside, self.level, self.item = {r: [] for r in self.bit}, 0, 0, 0, False
        self.labels, self.panes, self.in_label, self.title, self.in_title = [], 0, False, [], False

    def updatepos(self, i, j):  # places aren't asked for
        return j

    def _close_block(self) -> None:
        parts, self.parts = self.parts, []
        if not parts or not self.inside or self.skip:
            return
        shared = all(bits & self.inside == self.inside for bits, _ in parts)
        text = " ".join("".join([t for _, t in parts]).split()) if shared else ""
        for root, bit in self.bit.items():
            if not bit & self.inside:
                continue
            own = text if shared else " ".join("".join([t for bits, t in parts if bits & bit]).split())
            if not own:
                continue
            found = self.found[root]
            if self.level and found and found[-1][0] == self.level:  # headings that only decoration parted
                found[-1][1].append(own)
            else:
                found.append((self.level, [("* " if self.item and not self.level else "") + own]))

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if block := tag in _BLOCK:
            self._close_block()
        if tag == "br":
            self.parts.append((-1, " "))
        if tag in _VOID:
            return
        attrs = dict(attrs)
        drops, label, pane = self.kind(tag, attrs.get("class") or "")
        drops = drops or bool(_HIDDEN_STYLE.search(attrs.get("style") or ""))
        self.stack.append((tag, drops, label))
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.skip += drops
        self.inside |= self.bit.get(tag, 0)
        self.in_label = self.in_label or label
        if label:
            self.labels.append("")
        if pane and self.panes < len(self.labels):
            for found in self.found.values():
                found.append((2, [f"Tab: {self.labels[self.panes].strip().upper()}"]))
            self.panes += 1
        self.level, self.item = _LEVEL.get(tag, 0 if block else self.level), tag == "li" or (self.item and not block)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in _BLOCK:
            self._close_block()
            self.level, self.item = 0, False
        if self.opened.get(tag):
            while True:
                t, drops, label = self.stack.pop()
                self.opened[t] -= 1
                self.skip -= drops
                if not self.opened[t]:
                    self.inside &= ~self.bit.get(t, 0)
                self.in_label = self.in_label and not label
                if t == tag:
                    break

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif self.in_label:
            self.labels[-1] += data
        elif self.inside and not self.skip:
            self.parts.append((self.inside, data))

    def blocks(self) -> list[str]:
        """Of the first root that has any."""
        self._close_block()
        found = next((f for f in self.found.values() if f), [])
        return [("#" * level + " " if level else "") + " ".join(texts) for level, texts in found]


def read_page(html: str | None, layout: Layout) -> tuple[list[str], int]:
    """Blocks of the first root that has text, and how many tabs were labelled; a page is parsed once, for all roots."""
    if not html:
        return [], 0
    reader = _Reader(layout)
    reader.feed(html)
    reader.close()
    found = reader.blocks()
    return found, reader.panes if found else 0


def page_blocks(pages: DataFrame, key: str, html: str, layout: Layout = PAGES, carried: dict[str, Column] | None = None) -> DataFrame:
    """``key, blocks, tabs`` and the carried columns of every row; null html and pages without a root have no blocks.

    Rows are neither joined nor told apart by their key: repeated and null keys keep a row each.
    """
    carried = carried or {}
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), *[c.alias(f"with_{n}") for n, c in carried.items()])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [read_page(h, layout) for h in pdf["html"]]
            yield pdf.drop(columns="html").assign(blocks=[b for b, _ in found], tabs=[n for _, n in found])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "html"]
    found = rows.mapInPandas(read, ", ".join([*kinds, "blocks array<string>", "tabs int"]))
    return found.select(F.col("key").alias(key), *[F.col(f"with_{n}").alias(n) for n in carried], "blocks", "tabs")


def body_length_validation(path: Column, text: Column, least: int = 20, least_research: int = 5, keywords: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Status ``ok``, ``static_failed`` (too short) or ``incomplete`` (keywords missing), and the reason."""
    text = F.coalesce(text, F.lit(""))
    # Only counts of short texts are told, so the split ends where the longest of them would.
    n = F.size(F.filter(F.split(text, r"\s+", max(least, least_research) + 2), lambda w: w != ""))
    short = n < F.when(path.startswith("/research/"), least_research).otherwise(least)
    missing = F.filter(F.array(*map(F.lit, keywords)).cast("array<string>"), lambda w: ~F.lower(text).contains(F.lower(w)))
    status = F.when(short, "static_failed").when(F.size(missing) > 0, "incomplete").otherwise("ok")
    reason = F.when(short, F.concat(F.lit("body too short ("), n, F.lit(" words)")))
    return status, reason.when(F.size(missing) > 0, F.concat(F.lit("missing expected keywords: "), F.array_join(missing, ", ")))


def excluded_path(path: Column, exact: tuple[str, ...] = ("/sitemap",), prefixes: tuple[str, ...] = ("/webinar-recordings/",), part: str = "espanol") -> Column:
    """Exact paths and prefixes as they are, and a part of the path whatever its case."""
    out = path.isin(*exact) | F.lower(path).contains(part)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", layout: Layout = PAGES) -> DataFrame:
    """``key, url, path, title, status, reason, removed, tabs, body``: cleaned markdown of every page that isn't excluded.

    In this order: exclude, content root with labels, heading merge and hidden parts, markdown clean-up,
    consecutive copies, boilerplate of the path, contents, language, length.  Pages in another language
    get ``other_language``; null html gives ``static_failed``.
    """
    path = T.url_path(F.col(url))
    wanted = pages.where(~F.coalesce(excluded_path(path), F.lit(False)))
    title = F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)
    rows = page_blocks(wanted, key, html, layout, {url: F.col(url), "path": path, "title": title})
    rows = rows.withColumn("blocks", F.filter(F.transform("blocks", lambda b: T.clean_markdown(b)), lambda b: b != ""))
    kept, removed = B.dedupe_consecutive_blocks(F.col("blocks"))
    rows = rows.withColumns({"kept": kept, "removed": removed})
    rows = rows.withColumn("body", F.array_join(B.strip_marked_blocks(B.article_body(F.col("kept"), F.col("path"))), "\n\n"))
    rows = rows.withColumn("other", F.coalesce(T.language_share(F.col("body")) >= 0.95, F.lit(False)))
    status, reason = body_length_validation(F.col("path"), F.col("body"))
    other = F.col("other")
    named = F.coalesce(F.nullif(T.clean_title(F.col("title")), F.lit("")), T.url_doc_id(F.col(url)))
    return rows.select(key, url, "path", named.alias("title"), F.when(other, "other_language").otherwise(status).alias("status"), F.when(~other, reason).alias("reason"), "removed", "tabs", "body")


def extract_articles(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, slug, title, status, body`` of help pages: the article is the root, its first heading the title."""
    rows = page_blocks(pages, key, html, ARTICLES, {"slug": T.article_slug(F.col(url)), "path": T.url_path(F.col(url))})
    rows = rows.withColumn("blocks", F.filter(F.transform("blocks", lambda b: T.clean_markdown(b)), lambda b: b != ""))
    top = F.filter("blocks", lambda b: b.rlike(r"^#\s"))
    title = F.when(F.size(top) > 0, F.regexp_replace(F.get(top, 0), r"^#\s+", "")).otherwise(T.humanize_id(F.col("slug")))
    body = F.array_join(F.filter("blocks", lambda b: ~b.rlike(r"^#\s")), "\n\n")
    rows = rows.withColumns({"title": title, "body": body})
    return rows.select(key, "slug", "title", body_length_validation(F.col("path"), F.col("body"))[0].alias("status"), "body")


#: Attributes that link, and what a link to a document or a shared file looks like in text.
ATTRIBUTES = ("href", "src", "data-src", "data-href", "data-url", "data-file")
_PDF, _SHARED = r"(?i)https?://[^\s\"'<>]+\.pdf(?:\?[^\s\"'<>]*)?", r"(?i)https?://drive\.google\.com/(?:file/d/[A-Za-z0-9_-]+|open\?[^\s\"'<>]+)"


def discover_links(pages: DataFrame, key: str, url: str, html: str, site: str, endings: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """``key, link``: distinct links of a page to documents of the site (and its sub-domains) or to shared files.

    Attribute links are resolved against the page's url; those in running text are taken as they are.
    """
    attribute = rf"(?i)\b(?:{'|'.join(ATTRIBUTES)})\s*=\s*[\"']([^\"']+)[\"']"

    @F.pandas_udf("array<string>")
    def resolved(base: pd.Series, links: pd.Series) -> pd.Series:
        def one(b, link):
            try:
                return urljoin(b or "", link.strip())
            except ValueError:
                return ""
        return pd.Series([[one(b, x) for x in links_] if links_ is not None else [] for b, links_ in zip(base, links)])

    page = F.coalesce(F.col(html), F.lit(""))
    found = F.concat(resolved(F.col(url), F.regexp_extract_all(page, F.lit(attribute), F.lit(1))), F.regexp_extract_all(page, F.lit(_PDF), F.lit(0)), F.regexp_extract_all(page, F.lit(_SHARED), F.lit(0)))
    rows = pages.select(key, F.explode(F.array_distinct(found)).alias("raw")).where(F.col("raw").rlike("^(?i)https?://"))
    host, path = F.lower(F.regexp_extract("raw", "://([^/?#]*)", 1)), F.lower(F.regexp_extract("raw", "://[^/?#]*([^?#]*)", 1))
    ends = F.lit(False)
    for e in endings:
        ends = ends | path.endswith(e)
    mine = ((host == site) | host.endswith("." + site)) & ends
    return rows.where(mine | T.drive_file_id(F.col("raw")).isNotNull()).select(key, T.normalize_pdf_url(F.col("raw")).alias("link")).distinct()


def text_similarity(left: Column, right: Column) -> dict[str, Column]:
    """``ratio, word_delta, identical, excerpt`` of two texts, compared with their space collapsed.

    ``ratio``: twice the words that both share in order, at most, by the words of both; ``excerpt``: the
    first difference with five words around it, 140 characters at most.  Equal texts are not compared
    by words; a pair is, whole, in linear space.  Both texts go to one function, once, so that
    what they are made from is worked out once.
    """

    @F.pandas_udf("ratio double, word_delta int, identical boolean, excerpt string")
    def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append((None, None, None, None))
                continue
            if x == y:
                out.append((1.0, 0, True, None))
                continue
            p, q = x.split(" "), y.split(" ")
            shared, first = difference(p, q)
            delta = sum(map(bool, p)) - sum(map(bool, q))
            out.append((round(2 * shared / (len(p) + len(q)), 6), delta, False, " ".join(p[max(0, first[0] - 5) : first[1] + 5])[:140] if first else None))
        return pd.DataFrame(out, columns=["ratio", "word_delta", "identical", "excerpt"]).astype({"ratio": "float64", "word_delta": "Int32", "identical": "boolean"})

    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, T.MARKS, ""), r"\s+", " "))
    found = compared(plain(left), plain(right))
    return {n: found[n] for n in ("ratio", "word_delta", "identical", "excerpt")}


def text_issues(local: Column, live: Column, patterns: tuple[str, ...] = ()) -> Column:
    """``kind:detail`` of glued words, escaped numbers, invisible characters and the first sentence that is missing."""
    local, live = F.coalesce(local, F.lit("")), F.coalesce(live, F.lit(""))
    spaced = lambda w: F.regexp_replace(w, r"(?<=[a-z])(?=[A-Z])", " ")
    words = F.regexp_extract_all(local, F.lit(r"[a-z]{2,}[A-Z][a-zA-Z]+"), F.lit(0))
    glued = F.filter(words, lambda w: ~live.contains(w) & live.contains(spaced(w)))
    known = F.filter(F.array(*map(F.lit, patterns)).cast("array<string>"), lambda p: local.contains(p) & ~live.contains(p))
    number = r"(?m)^\d+\\\."
    sentences = F.filter(F.transform(F.split(live, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: (F.length(s) >= 40) & ~local.contains(s) & ~local.contains(s.substr(1, 50)) & ~local.contains(F.regexp_replace(s, r"[#*\[\]]", "").substr(1, 35)))
    tagged = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind + ":"), x))
    one = lambda cond, kind: F.when(cond, F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    return F.concat(
        tagged("glued", F.concat(known, glued)), one(local.rlike(number) & ~live.rlike(number), "escaped_number"), one(local.rlike(T.INVISIBLE), "invisible_char"),
        F.when(local != live, tagged("missing", F.transform(F.slice(sentences, 1, 1), lambda s: s.substr(1, 80)))).otherwise(F.array().cast("array<string>")),
    )
