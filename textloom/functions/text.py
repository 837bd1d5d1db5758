"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVISIBLE = "[​-‍﻿⁠]"
#: Zero-width characters, direction marks and the emoji selector.
MARKS = r"[\u200B-\u200F\u202A-\u202E\u2060\u2066-\u2069\uFEFF\uFE0F]"


# Host of shared files, separators of titles, roles, and lines that only call to action.
DRIVE = "drive.google.com"
TITLE_MARKS = (" | ", " - ", " — ")
ROLES = ("student", "teacher", "parent", "admin")
ROLE_WORDS = r"(?i)\b(teachers?|administrators?|admins?|parents?|students?|school\s+districts?|school\s+admins?|group\s+admins?)\b"
CALL_LINES = ("text link", "create a free account", "contact us", "sign up", "log in", "get started", "donate", "read our privacy policy")
# Words that tell English prose, and words that tell nothing; both are parameters.
ENGLISH_WORDS = tuple(
    "a about after all also an and any are as at be because been before but by can could did do does for from get had has have he her "
    "him his how i if in into is it its just know like make me more my new no not now of on one only or other our out over people said "
    "she so some than that the their them then there these they this to two up us use was we well what when which who will with would "
    "you your".split()
)
WORD = "[a-z\u00e1\u00e9\u00ed\u00f3\u00fa\u00fc\u00f1']+"
NEUTRAL_WORDS = ("com", "facebook", "http", "https", "linkedin", "math", "org", "pdf", "twitter", "www", "youtube")
# Types of questions and their patterns, most specific first.
QUESTION_RULES = (
    ("list_features", r"names?\s+only|feature\s+names|list\s+of\s+\w+|succinct\s+list|bullet\s+list\s+of|without\s+descriptions?"),
    ("comparison", r"\bcompare\b|\bdifference\s+between\b|\bvs\.?\b|\bversus\b|which\s+\w+\s+accounts?\s+|individual\s+vs|school\s+vs|which\s+accounts?\s+are\s+free|\bfree\s+accounts?\b"),
    ("affirmation", r"\bbased\s+on\b|\bgrounded\s+in\b|\blearning\s+science\b|\bresearch[\-\s]based\b|\bevidence[\-\s]based\b|\bis\s+\w+\s+(designed|built|grounded|based)\b"),
    ("troubleshooting", r"troubleshoot|won'?t\s+(load|work|open|print)|can'?t\s+(log|sign|access)|not\s+working|doesn'?t\s+work|\berror\b|\bfix\b|\bissue\b|blank\s+(page|report)|not\s+printing"),
    ("parent_family", r"\bparent\b|\bfamily\b|\bchild'?s?\b|\bhomeschool|\bat\s+home\b|my\s+child"),
    ("integration", r"\bclever\b|\bclasslink\b|\boneroster\b|\broster(?:ing|er)?\b|\bsync\b|\bsso\b|\bmerge\s+accounts?\b|\bspreadsheet\s+roster"),
    ("permissions", r"\bpermission\b|\bco-?teacher\b|\badmin\s+role\b|\baccess\s+level\b|what\s+can\s+(a\s+)?(admin|teacher|co-?teacher)"),
    ("requirements", r"\brequirement\b|\bcompatible\b|\bbrowser\b|\bdevice\b|\bbandwidth\b|\bandroid\b|\bipad\b|\btechnology\b|\bsystem\s+requirements?"),
    ("policy", r"\bprivacy\b|\bpolicy\b|\bcookie\b|\bferpa\b|\bgdpr\b|\bsub-?processor"),
    ("navigation", r"\bwhere\s+(do|can|should)\s+i\b|\bwhere\s+to\s+find\b|\bhow\s+do\s+i\s+find\b|\blocate\b.*\breport\b"),
    ("checklist_orientation", r"\bchecklist\b|\borient(?:ation)?\b|\bgetting\s+started\b|\bfirst\s+steps?\b|\boverview\s+of\s+implement"),
    ("research", r"\bstudy\b|\bresearch\b|\befficacy\b|\bimpact\s+study\b|\bfindings?\b|\bstatistically\b|\bLEAP\b|\bSTAAR\b|\bassessment\b.*\b(state|Louisiana|Texas)\b|what\s+did\s+the\s+\w+\s+study\b"),
    ("report", r"\breport\b|\bliveview\b|\bsnapshot\b|\bpace\s+report\b|\bprogress\s+report\b|\btower\s+alert\b|\bsprint\s+alert\b|what\s+does\s+the\s+\w+\s+report\s+show"),
    ("how_to", r"^how\s+(?:do\s+i|to|can\s+i)\b|\bsteps?\s+to\b|^how\s+should\s+i\b|\bwalk\s+me\s+through\b"),
    ("yes_no", r"^(?:is|are|can|do|does|will|should|am)\s+\w"),
    ("definition", r"^what\s+(?:is|are|does)\b|^explain\s+what\b|^define\b"),
)


def spaced(*phrases: str) -> str:
    """Pattern that every text fits that begins with one of the phrases once its space is collapsed and its case lowered.

    It fails at the first letter of most other texts, so they needn't be collapsed to know.  Every text
    fits where a phrase isn't ASCII, as lower case can be longer there.
    """
    if not all(p.isascii() for p in phrases):
        return ""
    return r"(?iu)^\s*(?:" + "|".join(r"\s+".join(map(re.escape, p.split(" "))) for p in phrases) + ")"


def strip_invisible(text: Column) -> Column:
    """Without zero-width characters."""
    return F.regexp_replace(text, INVISIBLE, "")


def soft_normalize(text: Column) -> Column:
    """Horizontal space collapsed in each line, blank lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize_block(text: Column) -> Column:
    """For comparison: invisible characters and direction marks out, quotes straight, space collapsed, lower case."""
    plain = F.translate(F.regexp_replace(text, MARKS, ""), "‘’“”", "''\"\"")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def tokenize(text: Column) -> Column:
    """Lower-case ASCII letters and digits, in runs."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def strip_citations(text: Column) -> Column:
    """Display form: link and bracket citations, bold marks and blank lines gone."""
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"\[\d+\]", ""), r"\*\*", "")
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), "\n")


def has_markdown_link(text: Column) -> Column:
    return text.rlike(r"\[[^\]]+\]\([^)]+\)")


def redact_secrets(text: Column) -> Column:
    """Key-like tokens masked, then e-mail addresses."""
    text = F.regexp_replace(text, r"\b(sk-|pcsk_)[A-Za-z0-9_-]{8,}", "[redacted]")
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]")


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_doc_id(url: Column) -> Column:
    """Path as a slug; ``index`` for the root."""
    slug = F.regexp_replace(F.regexp_replace(url_path(url), r"^/+|/+$|\.html$", ""), r"[^A-Za-z0-9]+", "-")
    return F.when(slug == "", "index").otherwise(slug)


def url_section(url: Column) -> Column:
    """First segment of the path; ``home`` for the root."""
    first = F.regexp_extract(url_path(url), "^/+([^/]+)", 1)
    return F.when(first == "", "home").otherwise(first)


def article_slug(url: Column) -> Column:
    """Last segment of a help article's path, lower case, without its leading number."""
    last = F.regexp_extract(F.regexp_replace(url_path(url), "/+$", ""), "([^/]*)$", 1)
    return F.when(last == "", "index").otherwise(F.lower(F.regexp_replace(last, r"^\d+-", "")))


def drive_file_id(url: Column) -> Column:
    """Id of a shared file on the public drive host: from the path, else the ``id`` parameter; null elsewhere."""
    host = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    by_path, by_query = F.regexp_extract(url, "/file/d/([A-Za-z0-9_-]+)", 1), F.regexp_extract(url, "[?&]id=([A-Za-z0-9_-]+)", 1)
    return F.when(host == DRIVE, F.nullif(F.when(by_path != "", by_path).otherwise(by_query), F.lit("")))


def normalize_pdf_url(url: Column) -> Column:
    """https, lower-case host, no query and no fragment, ``/`` for an empty path; shared files by their id."""
    url = F.trim(url)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    plain = F.concat(F.lit("https://"), F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.when(path == "", "/").otherwise(path))
    return F.coalesce(F.concat(F.lit(f"https://{DRIVE}/file/d/"), drive_file_id(url), F.lit("/view")), plain)


def pdf_basename(url: Column) -> Column:
    """Percent-decoded last segment of the path; a shared file is named by its id."""
    path = F.when(url.contains("://"), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)).otherwise(url)
    last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    return F.coalesce(F.concat(drive_file_id(url), F.lit(".pdf")), decoded)


def clean_title(title: Column) -> Column:
    """Space collapsed; cut at the first kind of separator that occurs."""
    title = F.trim(F.regexp_replace(title, r"\s+", " "))
    cut = title
    for mark in reversed(TITLE_MARKS):
        cut = F.when(title.contains(mark), F.trim(F.substring_index(title, mark, 1))).otherwise(cut)
    return cut


def humanize_id(name: Column) -> Column:
    """Words of a file name: glued connectors, ranges, separators and capitals taken apart."""
    name = F.regexp_replace(name, r"(?<=[A-Za-z0-9])(and|for|from|of|through|to|with|within)(?=[A-Z])", " $1 ")
    name = F.translate(F.regexp_replace(name, r"(\d+)_(\d+)", "$1-$2"), "_-", "  ")
    name = F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[A-Z](?![0-9]))", " ")
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def pdf_title(name: Column, override: Column) -> Column:
    """The override, else the words of a file name (of bracketed parts too), marked as a PDF; empty stays empty."""
    spaced = F.regexp_replace(name, r"\[\s*", " [")
    title = F.coalesce(override, humanize_id(spaced))
    return F.when(title == "", "").otherwise(F.concat(title, F.lit(" (PDF)")))


def resolve_title(title: Column, body: Column, name: Column) -> Column:
    """Front matter's title, else the first top heading with text, else the words of the id."""
    heading = F.regexp_extract(body, r"(?m)^#[ \t]+(\S[^\n]*)$", 1)
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(title), filled(heading), humanize_id(name), F.lit(""))


def display_title(title: Column, name: Column) -> Column:
    """A chunk's title, unless it is blank or just the id; then the words of the id."""
    own = F.trim(F.coalesce(title, F.lit("")))
    return F.when((own != "") & (own != F.coalesce(name, F.lit(""))), own).otherwise(F.coalesce(humanize_id(name), own))


def strip_duplicate_sources(answer: Column) -> Column:
    """Without a closing ``Source:`` line where a bulleted list of sources stands."""
    text = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", ""))
    listed = text.rlike(r"(?i)(?:\*\*Sources:\*\*|Sources:)\s*\n(?:[-*]\s+|\d+\.\s+)\[[^\]]+\]\([^)]+\)")
    cut = F.regexp_replace(F.regexp_replace(text, r"(?i)\n---\s*\n+Source:\s*[^\n]+\s*$", ""), r"(?i)\n+Source:\s*[^\n]+\s*$", "")
    return F.when(listed, F.regexp_replace(cut, r"\s+$", "")).otherwise(text)


def classify_question(question: Column, override: str | None = None, enabled: bool = True) -> Column:
    """The first rule of ``QUESTION_RULES`` that fits, else ``general``; an override of a known type wins."""
    known = {name for name, _ in QUESTION_RULES}
    if override and override.strip().lower() in known:
        return F.lit(override.strip().lower())
    kind = F.lit("general")
    if enabled:
        text = F.trim(F.coalesce(question, F.lit("")))
        for name, pattern in reversed(QUESTION_RULES):
            kind = F.when(text.rlike("(?i)" + pattern), name).otherwise(kind)
    return kind


def classify_answer(answer: Column, used_web: Column, refusal: str, banner: str) -> Column:
    """``refuse`` if the answer starts with the refusal, else ``web`` by use or banner, else ``answer``."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    web = F.coalesce(used_web, F.lit(False)) | text.startswith(banner)
    return F.when(text.startswith(refusal), "refuse").when(web, "web").otherwise("answer")


def scope_query(question: Column, phrase: Column) -> Column:
    """Without words for roles, and with the one role phrase at the end; unchanged if there is no phrase."""
    text = F.trim(F.coalesce(question, F.lit("")))
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(text, ROLE_WORDS, " "), r"\s+", " "))
    cleaned = F.when(cleaned == "", text).otherwise(cleaned)
    has = F.lower(cleaned).contains(F.lower(phrase))
    return F.when(F.coalesce(phrase, F.lit("")) == "", text).when(has, cleaned).otherwise(F.trim(F.concat(cleaned, F.lit(" "), phrase)))


def role_phrase(role: Column) -> Column:
    """Phrase of a known role, else null."""
    role = F.lower(F.trim(role))
    return F.when(role.isin(*ROLES), F.concat(F.lit("for "), F.when(role == "admin", "administrator").otherwise(role)))


def parse_json_tolerant(value: Column) -> Column:
    """A JSON list as strings; anything else, trimmed, as the only item; blank and null as none."""
    text = F.trim(value)
    items = F.filter(F.transform(F.from_json(text, "array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", none).when(text.startswith("["), F.coalesce(items, F.array(text))).otherwise(F.array(text))


def keyword_in_chunk_flag(question: Column, text: Column) -> Column:
    """Whether a word of the question occurs anywhere in the text, whatever the case."""
    words = F.filter(F.split(F.lower(F.coalesce(question, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.exists(words, lambda w: F.lower(F.coalesce(text, F.lit(""))).contains(w))


def clean_markdown(text: Column, calls: tuple[str, ...] = CALL_LINES) -> Column:
    """Emphasis, links, empty headings and lines that only call to action gone; blank lines collapsed."""
    inline = text.contains("**") | text.contains("_") | text.contains("[")
    cleaned = text
    for pattern, put in ((r"\*\*(.+?)\*\*", "$1"), (r"__(.+?)__", "$1"), (r"(?<!\w)_(.+?)_(?!\w)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"\[\s*\]", "")):
        cleaned = F.regexp_replace(cleaned, pattern, put)
    plain = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    called = lambda x: x.rlike(spaced(*calls)) & plain(x).isin(*calls) if calls else F.lit(False)
    stays = lambda x: ~F.trim(x).rlike(r"^#+$") & ~called(x)

    def lines(text):
        joined = F.array_join(F.transform(F.filter(F.split(text, "\n"), stays), lambda x: F.rtrim(x)), "\n")
        several = F.rtrim(F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"\n+$", ""))
        return F.when(text.contains("\n"), several).otherwise(F.when(stays(text), F.rtrim(text)).when(text.isNotNull(), ""))

    return _bound(F.when(inline, cleaned).otherwise(text), lines)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def normalize_list_indent(text: Column) -> Column:
    """Every run of list lines moved left by its smallest indent; linear in the lines."""
    item = lambda x: x.rlike(r"^\s*([*\-+]|\d+\.)\s")

    def moved(lines):
        # Other lines end runs: a run lies between two of them, or an end of the text.
        marked = F.transform(lines, lambda x, i: F.when(~item(x), i))
        return _bound(F.concat(F.array(F.lit(-1)), F.array_compact(marked), F.array(F.size(lines))), lambda ends: F.flatten(F.transform(ends, lambda end, place: run(lines, ends, end, place))))

    def run(lines, ends, end, place):
        start = F.get(ends, place - 1)
        rows = F.slice(lines, start + 2, end - start - 1)
        low = F.array_min(F.transform(rows, lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1))))
        left = _bound(low, lambda n: F.transform(rows, lambda x: x.substr(n + 1, F.length(x))))
        return F.when(place == 0, F.array().cast("array<string>")).otherwise(F.concat(left, F.slice(lines, end + 1, 1)))

    return F.array_join(_bound(F.split(text, "\n"), moved), "\n")


def response_errors(text: Column, least: int = 10, most: int = 5000) -> Column:
    """All errors of an answer by its length; a null answer is too short."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(F.when(n < least, "too short"), F.when(n > most, "too long")))


def language_share(text: Column, words: tuple[str, ...] = ENGLISH_WORDS, neutral: tuple[str, ...] = NEUTRAL_WORDS) -> Column:
    """Share of words that are no English function words; null under 20 words or if all are neutral."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def share(found):
        counted = F.size(found) - F.size(F.filter(found, lambda w: w.isin(*neutral)))
        english = F.size(F.filter(found, lambda w: w.isin(*[x for x in words if x not in neutral])))
        return F.when(F.size(found) >= 20, _bound(counted, lambda n: F.when(n > 0, 1 - english / n)))

    return _bound(found, share)


def indicator_words(docs: DataFrame, language: str, most: int = 300, times: int = 10, lang: str = "lang", text: str = "text", neutral: tuple[str, ...] = NEUTRAL_WORDS) -> DataFrame:
    """``word, n_own, n_other``: the ``most`` words in the most documents of a language whose share of them is ``times`` that of the other ones.

    Documents without language or text say nothing; ties go by word.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select((F.col(lang) == language).alias("own"), words.alias("words"))
    own, other = rows.agg(F.count_if("own"), F.count_if(~F.col("own"))).first()
    found = rows.select("own", F.explode("words").alias("word")).where(~F.col("word").isin(*neutral))
    found = found.groupBy("word").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_other"))
    telling = (F.col("n_own") > 0) & (F.col("n_own") * other >= F.col("n_other") * own * times)
    return found.where(telling).orderBy(F.desc("n_own"), "word").limit(most)


def format_quantity(value: Column, unit: Column, limit: Column | None = None) -> Column:
    """Fewer digits for larger amounts, dollars always with cents, thousands with commas; ``x of y`` with a limit."""
    def one(x):
        digits = F.when(F.abs(x) >= 100, F.format_number(x, 0)).when(F.abs(x) >= 10, F.format_number(x, 1)).otherwise(F.format_number(x, 2))
        return F.when(F.upper(unit) == "USD", F.concat(F.lit("$"), F.format_number(x, 2))).otherwise(F.concat(digits, F.lit(" "), unit))

    return one(value) if limit is None else F.coalesce(F.concat(one(value), F.lit(" of "), one(limit)), one(value))
