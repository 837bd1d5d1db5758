"""Evaluation, session, link, cost and trace queries, and their SQL, written from the operators' semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import blocks as B
from textloom.operators import evaluation as V
from textloom.operators import metering as M
from textloom.operators import sessions as O
from textloom.operators import traces as A
from textloom.plans import corpus as C
from textloom.sources.files import parse_front_matter

SIZES = (100, 500)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- evaluation


def grid_scores(spark, sf_dir):
    """Every question over chunks of each size: which documents that hold it are among those of the five best chunks."""
    asks = _table(spark, sf_dir, "benchmark")
    ranked = V.grid_ranking(_table(spark, sf_dir, "documents"), asks, "item_id", SIZES)
    relevant = C._golden(spark, sf_dir).select("item_id", F.explode("expected").alias("document_id"))
    return V.retrieval_scores(ranked, relevant, asks, "item_id", "document_id", "config_id", SIZES)


def retrieval_scores(spark, sf_dir):
    rows = grid_scores(spark, sf_dir)
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def evaluation_grid(spark, sf_dir):
    return V.score_summary(grid_scores(spark, sf_dir), "config_id")


def rank_precision_recall(spark, sf_dir):
    """The ten nearest of every fiftieth vector; relevant are other vectors of its label."""
    vectors = _table(spark, sf_dir, "embeddings")
    asks = vectors.where("vec_id % 50 = 0")
    found = C.R.dense_topk(vectors, asks, 10).join(asks.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    found = found.groupBy("query_id", "own").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("own")).alias("right"))
    # Labels are counted, so no query meets all rows of its label.
    sizes = vectors.where("label is not null").groupBy(F.col("label").alias("own")).agg((F.count("*") - 1).alias("relevant"))
    rows = found.join(sizes, "own", "left")
    return rows.select("query_id", F.round(F.col("right") / F.col("n"), 4).alias("precision"), F.round(F.try_divide(F.col("right"), F.col("relevant")), 6).alias("recall"))


# ---- sessions: an install owns every fiftieth conversation; requests come from installs that own about half of what they ask for


def _sessions(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations").where("conv_id is not null")
    install = lambda n: F.concat(F.lit("install-"), (F.col("session") % n).cast("string")).alias("install")
    sessions = talks.groupBy(F.col("conv_id").alias("session")).agg(F.max("turn").alias("updated")).select("session", "updated", install(50))
    return sessions, talks.select(F.col("conv_id").alias("session"), F.col("turn").alias("message"), "role", F.md5("text").alias("digest")), sessions.select("session", install(25))


def select_session_list(spark, sf_dir):
    return O.select_session_list(_sessions(spark, sf_dir)[0])


def session_messages(spark, sf_dir):
    sessions, messages, requests = _sessions(spark, sf_dir)
    return O.session_messages(requests, sessions, messages).select("install", "session", "message", "place", "role", "digest")


def delete_session(spark, sf_dir):
    """Every request with ``removed``, whether its session is still there, and how many of its messages are."""
    sessions, messages, requests = _sessions(spark, sf_dir)
    answered, kept, left = O.delete_session(requests.where("session % 3 = 0"), sessions, messages)
    counts = left.groupBy("session").agg(F.count("*").alias("messages"))
    rows = answered.join(kept.select("session", F.lit(True).alias("kept")), "session", "left").join(counts, "session", "left")
    return rows.select("install", "session", "removed", F.coalesce("kept", F.lit(False)).alias("kept"), F.coalesce("messages", F.lit(0)).alias("messages"))


def _persisted(spark, sf_dir):
    """Messages before turn 4 of conversations not divisible by 3 are stored, every fifth of them without title; later questions and their answers are turns.

    Those of conversations divisible by 11 have no install.
    """
    talks = _table(spark, sf_dir, "conversations").where("conv_id is not null")
    old = talks.where("turn < 4 and conv_id % 3 <> 0").withColumnRenamed("conv_id", "session")
    title = F.when(F.col("session") % 5 != 0, F.concat(F.lit("Talk "), F.col("session").cast("string"))).otherwise("")
    sessions = old.groupBy("session").agg(F.max("turn").alias("updated")).select(
        "session", F.lit("first").alias("install"), title.alias("title"), F.lit(7).cast("long").alias("token_count"), F.lit("ended").alias("status"), F.lit("limit").alias("ended_reason"), "updated",
    )
    messages = old.select("session", (F.col("turn") + 1).cast("long").alias("message"), "role", F.col("text").alias("content"), F.lit(None).cast("long").alias("total_tokens"))
    answer = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    install = F.when(F.col("conv_id") % 11 != 0, F.concat(F.lit("install-"), (F.col("conv_id") % 50).cast("string")))
    turns = talks.withColumn("answer", answer).where("role = 'user' and turn >= 4 - 4 * cast(conv_id % 3 = 0 as int)").select(
        F.col("conv_id").alias("session"), install.alias("install"), F.col("turn").alias("at"), F.col("text").alias("question"), "answer", F.length("answer").cast("long").alias("total_tokens"),
    )
    return O.persist_turns(sessions, messages, turns)


def persist_turns_sessions(spark, sf_dir):
    return _persisted(spark, sf_dir)[0]


def persist_turns_messages(spark, sf_dir):
    return _persisted(spark, sf_dir)[1].withColumn("content", F.md5("content"))


# ---- links, failures, costs


def links_per_page(spark, sf_dir):
    """Different links of every page; pages without links, or that failed, have 0."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return _table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.size(links), F.lit(0)).cast("long").alias("n_links"))


def failure_ids(spark, sf_dir):
    """Every failed document with its failure, how many share it, and the failure's place."""
    rows = _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low quality").alias("failure")).where("failure is not null")
    return M.failure_ids(rows, "failure", "doc_id")


def token_cost(spark, sf_dir):
    """Events as calls of a model (their type); types without a price cost what the default model does."""
    events = _table(spark, sf_dir, "events")
    calls = events.select("event_id", F.col("event_type").alias("model"), F.floor(F.col("value") * 10).alias("prompt_tokens"), F.floor("value").alias("completion_tokens"))
    prices = spark.createDataFrame([("purchase", 0.01, 0.03), ("click", 0.002, 0.002), ("view", 0.001, 0.004)], "model string, prompt_price double, completion_price double")
    return M.token_cost(calls, prices, "view").select("event_id", "model", "usd")


# ---- markdown, titles and traces over rows made of the given tables


def header_chunk(spark, sf_dir):
    """Documents under a title of their own; every fifth filled line is a heading of second level, of first level at multiples of fifteen."""
    filled = lambda x: F.trim(x) != ""
    mark = lambda x, i: F.when(filled(x) & (i % 15 == 0), F.concat(F.lit("# "), x)).when(filled(x) & (i % 5 == 0), F.concat(F.lit("## "), x)).otherwise(x)
    lines = F.transform(F.split(F.regexp_replace("text", "[#\\r\\f\\x0B\\u0085\\u2028\\u2029]", " "), "\n"), mark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("text"))
    return B.header_chunk(docs, "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("title").alias("title"), F.md5("section").alias("section"), F.length("unit").cast("long").alias("characters"))


def carry_section_label(spark, sf_dir):
    """Messages of a conversation as rows of a section: the last word like ``Than`` so far labels those that hold ``an``."""
    talks = _table(spark, sf_dir, "conversations")
    found = B.carry_section_label(talks, "conv_id", "turn", "text", "Than[a-z]*", "an")
    return found.select("conv_id", "turn", F.md5("labelled").alias("digest"), F.length("labelled").cast("long").alias("characters"))


def front_matter_fields(spark, sf_dir):
    """Pages rendered with front matter, and read again."""
    pages = _table(spark, sf_dir, "pages").where("html is not null")
    fields = {"doc_id": T.url_doc_id(F.col("url")), "source_url": F.col("url"), "title": F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))}
    made = pages.select("page_id", C.front_matter(fields, C._stripped(F.col("html"))).alias("made"))
    found, body = parse_front_matter(F.col("made"))
    return made.select("page_id", found["doc_id"].alias("slug"), found["source_url"].alias("source_url"), found["title"].alias("title"), F.md5(body).alias("body"))


def pdf_title(spark, sf_dir):
    """Last parts of page addresses as file names; those of home pages have an override."""
    name = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    override = F.when(T.url_section(F.col("url")) == "home", F.lit("Home"))
    return _table(spark, sf_dir, "pages").select("page_id", T.pdf_title(name, override).alias("title"))


def step_classify(spark, sf_dir):
    """Messages as raw events: every third user turn calls a tool, other user turns speak, answers are its responses."""
    talks, user = _table(spark, sf_dir, "conversations"), F.col("role") == "user"
    calls = user & (F.col("turn") % 3 == 0)
    raw = talks.select("conv_id", "turn", F.when(calls, "search_doc").alias("call_name"), F.when(calls & (F.col("turn") > 0), F.lit("{}")).alias("call_args"), F.when(F.col("role") == "assistant", "search_doc").alias("response_name"), F.col("text").alias("response"), "text")
    return A.step_classify(raw).select("conv_id", "turn", "phase", "tool", "args", F.md5("result").alias("result"), F.md5("content").alias("content"))


def trace_summary(spark, sf_dir):
    """Every document as a trace: a search that observes its id and source, and a web search where it has no language."""
    docs = _table(spark, sf_dir, "documents").where("doc_id is not null")
    step = lambda phase, tool, result=None: F.struct(F.lit(phase).alias("phase"), F.lit(tool).alias("tool"), (F.lit(None).cast("string") if result is None else result).alias("result"))
    ids = F.array(F.col("doc_id").cast("string"), F.coalesce("source", F.lit(" ")), F.col("doc_id").cast("string"))
    seen = F.to_json(F.struct((F.coalesce("n_chars", F.lit(0)) % 7).cast("int").alias("chunk_count"), ids.alias("document_ids")))
    none = F.array().cast("array<struct<phase:string,tool:string,result:string>>")
    steps = F.concat(F.array(step("Act", "search_doc"), step("Observe", "search_doc", seen), step("Observe", "search_doc", F.lit("broken {"))), F.when(F.col("lang").isNull(), F.array(step("Act", "web_search"), step("Observe", "web_search", seen))).otherwise(none))
    got = A.trace_summary(steps)
    return docs.select("doc_id", F.array_join(got["tool_calls"], ",").alias("tool_calls"), F.array_join(got["retrieved_document_ids"], ",").alias("ids"), got["used_web_fallback"].alias("used_web"), got["corpus_chunks"].cast("long").alias("n_chunks"))


def qa_report_rows(spark, sf_dir):
    """Answers with two checks: that they are long, and that they come early."""
    talks = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = talks.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("role").alias("question"), F.lit("").alias("reference"), F.col("text").alias("answer"),
        F.array(F.col("conv_id").cast("string"), F.lit(" "), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("document_ids"), (F.length("text") > 200).alias("is_long"), (F.col("turn") < 4).alias("is_early"),
    )
    return A.qa_report_rows(rows, ("is_long", "is_early")).select("id", F.md5("shown").alias("shown"), "ids", "failed")


def _plain_lines():
    return F.split(F.regexp_replace("text", "[#\\r\\f\\x0B\\u0085\\u2028\\u2029]", " "), "\n")


def parse_standard_entries(spark, sf_dir):
    """Documents as lists of standards: of seven lines the third is a code, the sixth a mapping, the seventh noise."""
    mark = lambda x, i: (
        F.when(i % 7 == 2, F.concat(F.lit(" k.ab."), (i % 5).cast("string"))).when(i % 7 == 5, F.concat(F.lit("Mission "), i.cast("string"), F.lit(": "), x))
        .when(i % 7 == 6, F.concat(F.lit("\u00a9 "), x)).otherwise(x)
    )
    docs = _table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.array_join(F.transform(_plain_lines(), mark), "\n").alias("text"))
    return B.parse_standard_entries(docs, "doc_id").select("doc_id", "code", F.md5("description").alias("description"), F.md5(F.array_join("mappings", "|")).alias("mappings"), F.size("mappings").cast("long").alias("n_mappings"))


def normalize_list_indent(spark, sf_dir):
    """Documents whose lines, but for every fourth, are list lines of different indents."""
    mark = lambda x, i: F.when(i % 4 == 3, x).otherwise(F.concat(F.repeat(F.lit(" "), i % 5), F.when(i % 2 == 0, "- ").otherwise("1. "), x))
    made = F.array_join(F.transform(_plain_lines(), mark), "\n")
    rows = _table(spark, sf_dir, "documents").select("doc_id", made.alias("made")).select("doc_id", "made", T.normalize_list_indent(F.col("made")).alias("moved"))
    return rows.select("doc_id", F.md5("moved").alias("moved"), (F.length("made") - F.length("moved")).cast("long").alias("spaces"))


def indicator_words(spark, sf_dir):
    """The telling words of the English documents."""
    return T.indicator_words(_table(spark, sf_dir, "documents"), "en")


def language_filter_learned(spark, sf_dir):
    """Documents of other languages, by the words that the labelled documents teach (at most 300, so a bounded list)."""
    words = tuple(r["word"] for r in indicator_words(spark, sf_dir).collect())
    share = T.language_share(F.col("text"), words) if words else F.lit(None).cast("double")
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(share >= 0.95, F.lit(False)).alias("other_language"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        retrieval_scores, evaluation_grid, rank_precision_recall, select_session_list, session_messages, delete_session, links_per_page, failure_ids, token_cost,
        header_chunk, carry_section_label, front_matter_fields, pdf_title, step_classify, trace_summary, qa_report_rows,
        persist_turns_sessions, persist_turns_messages, parse_standard_entries, normalize_list_indent, indicator_words, language_filter_learned,
    )
}


# ---- the same in SQL

_CUT = """c AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id || '__chunk_' || i AS chunk_id, substr(text, i * {n} + 1, {n}) AS text
FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / {n}.0) AS BIGINT))) AS i FROM documents WHERE text <> ''))"""
_RANKED = " UNION ALL ".join(
    f"SELECT {n} AS config_id, item_id, CAST(split_part(chunk_id, '__', 1) AS BIGINT) AS doc_id, rank FROM (WITH {_CUT.replace('{n}', str(n))}, {C._kw(5, 'c', 'chunk_id')} SELECT * FROM kw)" for n in SIZES
)
_SCORES = f"""r AS ({_RANKED}), o AS (SELECT config_id, item_id, doc_id, min(rank) AS rank FROM r GROUP BY ALL), x AS (SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
a AS (SELECT item_id, n AS config_id, (SELECT count(*) FROM x WHERE x.item_id = b.item_id) AS n_relevant FROM (SELECT DISTINCT item_id FROM benchmark) b, (SELECT unnest({list(SIZES)}) AS n)),
s AS (SELECT a.config_id, a.item_id, count(o.doc_id) AS n_retrieved, n_relevant, count(x.doc_id) AS n_found, count(x.doc_id) > 0 AS hit, coalesce(count(x.doc_id) / nullif(count(o.doc_id), 0)::DOUBLE, 0.0) AS "precision",
count(x.doc_id) / nullif(n_relevant, 0)::DOUBLE AS recall, min(CASE WHEN x.doc_id IS NOT NULL THEN rank END) AS first_rank
FROM a LEFT JOIN o ON o.item_id = a.item_id AND o.config_id = a.config_id LEFT JOIN x ON x.item_id = o.item_id AND x.doc_id = o.doc_id GROUP BY a.config_id, a.item_id, n_relevant)"""
_SESSIONS = "s AS (SELECT conv_id AS session, max(turn) AS updated, 'install-' || (conv_id % 50) AS install FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)"
_MINE = "'install-' || (conv_id % 25) = 'install-' || (conv_id % 50)"
_LINES = r"regexp_replace(text, '[#\r\f\v\x{0085}\x{2028}\x{2029}]', ' ', 'g')"

_OLD = "o AS (SELECT * FROM conversations WHERE turn < 4 AND conv_id % 3 <> 0)"
_NEW = """n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
WHERE role = 'user' AND conv_id % 11 <> 0 AND (turn >= 4 OR conv_id % 3 = 0))"""
_MADE = f"l AS (SELECT doc_id, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM (SELECT doc_id, string_split({_LINES}, chr(10)) AS xs FROM documents WHERE text IS NOT NULL))"
_INDICATORS = f"""d AS (SELECT doc_id, lang, {C._FOUND} AS ws FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT w AS word, count(DISTINCT doc_id) FILTER (lang = 'en') AS n_own, count(DISTINCT doc_id) FILTER (lang <> 'en') AS n_other FROM (SELECT doc_id, lang, unnest(ws) AS w FROM d) WHERE w NOT IN {C._IN(T.NEUTRAL_WORDS)} GROUP BY w),
ind AS (SELECT * FROM iw WHERE n_own > 0 AND n_own * (SELECT count(*) FROM d WHERE lang <> 'en') >= n_other * 10 * (SELECT count(*) FROM d WHERE lang = 'en') ORDER BY n_own DESC, word LIMIT 300)"""

SQL: dict[str, str] = {
    "retrieval_scores": f'WITH {_SCORES} SELECT config_id, item_id, n_retrieved, n_relevant, n_found, hit, round("precision", 6) AS "precision", round(recall, 6) AS recall, first_rank FROM s',
    "evaluation_grid": f"""WITH {_SCORES} SELECT config_id, count(*) AS questions, count(*) FILTER (hit) AS hits, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS reciprocal_rank FROM s GROUP BY config_id""",
    "rank_precision_recall": f"""WITH p AS (SELECT q.vec_id AS query_id, q.label AS own, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({C._cosine('e.embedding', 'q.embedding')}, 9) DESC, e.vec_id) AS rank
FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) SELECT query_id, round(avg(CASE WHEN label = own THEN 1.0::DOUBLE ELSE 0 END), 4) AS "precision",
round(count(*) FILTER (label = own) / nullif((SELECT count(*) - 1 FROM embeddings z WHERE z.label = p.own), 0)::DOUBLE, 6) AS recall FROM p WHERE rank <= 10 GROUP BY query_id, own""",
    "select_session_list": f"WITH {_SESSIONS}, p AS (SELECT install, session, updated, CAST(row_number() OVER (PARTITION BY install ORDER BY updated DESC, session) AS INT) AS place FROM s) SELECT * FROM p WHERE place <= 100",
    "session_messages": f"SELECT 'install-' || (conv_id % 50) AS install, conv_id AS session, turn AS message, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place, role, md5(text) AS digest FROM conversations WHERE {_MINE}",
    "delete_session": f"""SELECT 'install-' || (conv_id % 25) AS install, conv_id AS session, bool_and({_MINE}) AS removed, NOT bool_and({_MINE}) AS kept, count(*) FILTER (NOT ({_MINE})) AS messages FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id""",
    "links_per_page": """SELECT page_id, coalesce(len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), 0) AS n_links FROM pages""",
    "failure_ids": """WITH f AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low quality' END AS failure FROM labels WHERE toxic = 1 OR quality = 0), c AS (SELECT failure, count(*) AS n FROM f GROUP BY failure),
p AS (SELECT failure, n, CAST(row_number() OVER (ORDER BY n DESC, failure) AS INT) AS place FROM c) SELECT f.doc_id, f.failure, n, place FROM f JOIN p USING (failure)""",
    "token_cost": """SELECT event_id, event_type AS model, round((floor(value * 10) * CASE event_type WHEN 'purchase' THEN 0.01::DOUBLE WHEN 'click' THEN 0.002::DOUBLE ELSE 0.001::DOUBLE END
+ floor(value) * CASE event_type WHEN 'purchase' THEN 0.03::DOUBLE WHEN 'click' THEN 0.002::DOUBLE ELSE 0.004::DOUBLE END) / 1000, 6) AS usd FROM events""",
    "header_chunk": f"""WITH l AS (SELECT doc_id, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM (SELECT doc_id, string_split({_LINES}, chr(10)) AS xs FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, i + 1 AS i, CASE WHEN trim(x, ' ') <> '' AND i % 15 = 0 THEN '# ' || x WHEN trim(x, ' ') <> '' AND i % 5 = 0 THEN '## ' || x ELSE x END AS x, trim(x, ' ') <> '' AND i % 5 = 0 AS h FROM l
UNION ALL SELECT doc_id, 0, '# Document ' || doc_id, true FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m),
u AS (SELECT doc_id, island - 1 AS pos, regexp_replace(string_agg(x, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS unit, arg_min(x, i) AS head FROM g GROUP BY doc_id, island),
t AS (SELECT *, last_value(CASE WHEN starts_with(head, '# ') THEN trim(substr(head, 3), ' ') END IGNORE NULLS) OVER w AS title, sum(CAST(starts_with(head, '# ') AS INT)) OVER w AS part FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(pos AS BIGINT) AS pos, md5(title) AS title, md5(last_value(CASE WHEN starts_with(head, '## ') THEN trim(substr(head, 4), ' ') END IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY pos)) AS section, length(unit) AS characters FROM t""",
    "carry_section_label": """WITH k AS (SELECT conv_id, turn, text, last_value(nullif(regexp_extract(text, 'Than[a-z]*'), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations),
o AS (SELECT conv_id, turn, CASE WHEN label IS NOT NULL AND contains(text, 'an') AND NOT contains(lower(text), lower(label)) THEN label || ' | ' || text ELSE text END AS t FROM k) SELECT conv_id, turn, md5(t) AS digest, length(t) AS characters FROM o""",
    "front_matter_fields": f"""WITH q AS (SELECT page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS title, {C._STRIP('html')} AS body FROM pages WHERE html IS NOT NULL)
SELECT page_id, {C.SQL_SLUG} AS slug, url AS source_url, nullif(regexp_replace(title, '^["'']+|["'']+$', '', 'g'), '') AS title, md5(body) AS body FROM q""",
    "step_classify": """SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'Act' WHEN role = 'assistant' THEN 'Observe' ELSE 'Think' END AS phase,
CASE WHEN role = 'assistant' OR (role = 'user' AND turn % 3 = 0) THEN 'search_doc' END AS tool, CASE WHEN role = 'user' AND turn % 3 = 0 THEN '{}' END AS args,
CASE WHEN role = 'assistant' THEN md5(substr(coalesce(text, ''), 1, 800)) END AS result, CASE WHEN role <> 'assistant' AND NOT (role = 'user' AND turn % 3 = 0) THEN md5(trim(text, ' ')) END AS content
FROM conversations WHERE role = 'assistant' OR (role = 'user' AND turn % 3 = 0) OR trim(text, ' ') <> ''""",
    "trace_summary": """SELECT doc_id, CASE WHEN lang IS NULL THEN 'search_doc,web_search' ELSE 'search_doc' END AS tool_calls, CAST(doc_id AS VARCHAR) || CASE WHEN trim(coalesce(source, ''), ' ') NOT IN ('', CAST(doc_id AS VARCHAR)) THEN ',' || trim(source, ' ') ELSE '' END AS ids,
lang IS NULL AS used_web, coalesce(n_chars, 0) % 7 AS n_chunks FROM documents WHERE doc_id IS NOT NULL""",
    "qa_report_rows": r"""SELECT conv_id || ':' || turn AS id, md5(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[\d+\]', '', 'g'), '\*\*', '', 'g'), chr(10)), lambda x: trim(x) <> ''), chr(10))) AS shown,
conv_id || CASE WHEN turn <> conv_id THEN ', ' || turn ELSE '' END AS ids, concat_ws(', ', CASE WHEN coalesce(length(text) <= 200, true) THEN 'is_long' END, CASE WHEN turn >= 4 THEN 'is_early' END) AS failed FROM conversations WHERE role = 'assistant'""",
    "persist_turns_sessions": f"""WITH {_OLD}, {_NEW}, os AS (SELECT conv_id AS session, max(turn) AS updated FROM o GROUP BY conv_id),
ns AS (SELECT conv_id AS session, min(CASE WHEN place = 1 THEN substr(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), 1, 100) END) AS title, arg_max(coalesce(length(answer), 0), place) AS tokens, max(turn) AS updated FROM n GROUP BY conv_id)
SELECT session, CASE WHEN os.updated IS NOT NULL THEN 'first' ELSE 'install-' || (session % 50) END AS install,
CASE WHEN os.updated IS NOT NULL AND session % 5 <> 0 THEN 'Talk ' || session WHEN ns.updated IS NULL THEN '' WHEN ns.title = '' THEN 'New chat' ELSE ns.title END AS title,
CAST(coalesce(ns.tokens, 7) AS BIGINT) AS token_count, CASE WHEN ns.updated IS NULL THEN 'ended' ELSE 'active' END AS status, CASE WHEN os.updated IS NOT NULL THEN 'limit' END AS ended_reason,
coalesce(ns.updated, os.updated) AS updated FROM os FULL JOIN ns USING (session)""",
    "persist_turns_messages": f"""WITH {_OLD}, {_NEW}, h AS (SELECT conv_id, max(turn) + 1 AS last FROM o GROUP BY conv_id)
SELECT conv_id AS session, CAST(turn + 1 AS BIGINT) AS message, role, md5(text) AS content, CAST(NULL AS BIGINT) AS total_tokens FROM o
UNION ALL SELECT n.conv_id, CAST(coalesce(last, 0) + 2 * place - 1 AS BIGINT), 'user', md5(coalesce(text, '')), NULL FROM n LEFT JOIN h ON h.conv_id = n.conv_id
UNION ALL SELECT n.conv_id, CAST(coalesce(last, 0) + 2 * place AS BIGINT), 'assistant', md5(coalesce(answer, '')), CAST(length(answer) AS BIGINT) FROM n LEFT JOIN h ON h.conv_id = n.conv_id""",
    "parse_standard_entries": f"""WITH {_MADE}, m AS (SELECT doc_id, i, trim(CASE WHEN i % 7 = 2 THEN 'k.ab.' || (i % 5) WHEN i % 7 = 5 THEN 'Mission ' || i || ': ' || x WHEN i % 7 = 6 THEN '\u00a9 ' || x ELSE x END, ' ') AS x FROM l WHERE doc_id IS NOT NULL),
k AS (SELECT *, regexp_matches(x, '(?i){B.CODE}') AS is_code, regexp_matches(x, '(?i){B.MAPPING}') AS is_map FROM m),
e AS (SELECT *, sum(is_code::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM k), f AS (SELECT *, sum(is_map::INT) OVER (PARTITION BY doc_id, island ORDER BY i) AS mapped FROM e WHERE island > 0),
g AS (SELECT doc_id, island, upper(max(x) FILTER (is_code)) AS code, string_agg(x, ' ' ORDER BY i) FILTER (u AND NOT is_map AND mapped = 0) AS descr, string_agg(x, '|' ORDER BY i) FILTER (u AND is_map) AS maps, count(*) FILTER (u AND is_map) AS n
FROM (SELECT *, NOT is_code AND x <> '' AND NOT regexp_matches(x, '{B.NOISE}') AS u FROM f) GROUP BY doc_id, island)
SELECT doc_id, code, md5(coalesce(descr, '')) AS description, md5(coalesce(maps, '')) AS mappings, n AS n_mappings FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, code ORDER BY island DESC) = 1""",
    "normalize_list_indent": f"""WITH {_MADE}, m AS (SELECT doc_id, i, CASE WHEN i % 4 = 3 THEN x ELSE repeat(' ', i % 5) || CASE WHEN i % 2 = 0 THEN '- ' ELSE '1. ' END || x END AS x FROM l),
k AS (SELECT *, regexp_matches(x, '^\\s*([*\\-+]|\\d+\\.)\\s') AS item FROM m), e AS (SELECT *, sum(CAST(NOT item AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM k),
g AS (SELECT *, CASE WHEN item THEN min(length(regexp_extract(x, '^(\\s*)', 1))) FILTER (item) OVER (PARTITION BY doc_id, island) ELSE 0 END AS low FROM e)
SELECT doc_id, md5(string_agg(substr(x, low + 1), chr(10) ORDER BY i)) AS moved, CAST(sum(low) AS BIGINT) AS spaces FROM g GROUP BY doc_id UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL""",
    "indicator_words": f"WITH {_INDICATORS} SELECT word, n_own, n_other FROM ind",
    "language_filter_learned": f"""WITH {_INDICATORS}, a AS (SELECT doc_id, unnest({C._FOUND}) AS w FROM documents),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (w NOT IN {C._IN(T.NEUTRAL_WORDS)}) AS counted, count(ind.word) AS english FROM a LEFT JOIN ind ON ind.word = a.w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n >= 20 AND counted > 0 AND 1 - english::DOUBLE / counted >= 0.95, false) AS other_language FROM documents d LEFT JOIN c USING (doc_id)""",
}
