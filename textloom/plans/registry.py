"""All registered queries of the library and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chunking as C
from textloom.operators import metering as M
from textloom.operators import retrieval as R
from textloom.plans import corpus, reports
from textloom.plans.relational import PLANS, SPELLING


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plan(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return lambda spark, sf_dir: spark.sql(sql, **{n: _table(spark, sf_dir, n) for n in names})


def _elsewhere(sql: str) -> str:
    for here, there in SPELLING.items():
        sql = sql.replace(here, there)
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def _docs(f):
    return lambda spark, sf_dir: f(_table(spark, sf_dir, "documents"))


def _asks(vectors: DataFrame) -> DataFrame:
    """The query set: every fiftieth vector."""
    return vectors.where("vec_id % 50 = 0")


def _dense(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return R.dense_topk(vectors, _asks(vectors), k=20)


def _keyword(spark, sf_dir, k=10):
    return R.bm25_topk(_table(spark, sf_dir, "documents"), "doc_id", _table(spark, sf_dir, "benchmark"), "item_id", k)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "strip_invisible": _docs(lambda d: d.select("doc_id", T.strip_invisible(F.col("text")).alias("text"))),
    "soft_normalize": _docs(lambda d: d.select("doc_id", T.soft_normalize(F.col("text")).alias("text"))),
    "normalize_block": _docs(lambda d: d.select("doc_id", F.md5(T.normalize_block(F.col("text"))).alias("digest"))),
    "content_hash": _docs(lambda d: d.select("doc_id", F.sha2("text", 256).alias("sha256"))),
    "tokenize": _docs(lambda d: d.select("doc_id", F.size(T.tokenize(F.col("text"))).cast("long").alias("n_tokens"))),
    "redact_secrets": _docs(lambda d: d.select("doc_id", T.redact_secrets(F.col("text")).alias("text"))),
    "strip_citations": lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", T.strip_citations(F.col("text")).alias("text")),
    "has_markdown_link": lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", T.has_markdown_link(F.col("text")).alias("cited")),
    "url_path_section_site": lambda s, d: _table(s, d, "pages").select("page_id", T.url_path(F.col("url")).alias("path"), T.url_section(F.col("url")).alias("section"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("site")),
    "url_doc_id": lambda s, d: _table(s, d, "pages").select("page_id", T.url_doc_id(F.col("url")).alias("slug")),
    "normalize_pdf_url": lambda s, d: _table(s, d, "pages").select("page_id", T.normalize_pdf_url(F.col("url")).alias("url")),
    "fixed_chunk": _docs(R.fixed_chunk),
    "recursive_chunk": _docs(C.recursive_chunk),
    "chunk_size_sweep": _docs(C.chunk_size_sweep),
    "rate_limit": lambda s, d: M.rate_limit(_table(s, d, "events"), "user_id", "ts", "event_id"),
    "assign_chunk_ids": _docs(lambda d: R.fixed_chunk(d, 200).select("document_id", "chunk_index", "chunk_id")),
    "chunk_length_stats": _docs(lambda d: R.fixed_chunk(d).agg(F.round(F.avg(F.length("text")), 4).alias("mean_length"), F.min(F.length("text")).alias("least"), F.max(F.length("text")).alias("most"), F.count("*").alias("n"))),
    "bm25_corpus_stats": _docs(lambda d: R.bm25_corpus_stats(d, "doc_id")),
    "bm25_topk": lambda s, d: _keyword(s, d).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank"),
    "dense_topk": lambda s, d: _dense(s, d).where("rank <= 10").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank"),
    "diverse_filter": lambda s, d: R.diverse_filter(_dense(s, d), "query_id", "label").select("query_id", "vec_id", "label", "rank"),
    "relevance_gap_filter": lambda s, d: R.relevance_gap_filter(_dense(s, d), "query_id", 0.1, 2).select("query_id", "vec_id", "rank"),
    "neighbor_join": _docs(lambda d: R.neighbor_join(R.fixed_chunk(d), R.fixed_chunk(d))),
    "merge_neighbors": _docs(lambda d: R.merge_neighbors(R.fixed_chunk(d), R.fixed_chunk(d))),
    "format_quantity": lambda s, d: _table(s, d, "events").select("event_id", T.format_quantity(F.col("value"), F.when(F.col("event_type") == "purchase", "USD").otherwise("GB")).alias("shown")),
    "retrieval_hit": lambda s, d: _dense(s, d).where("rank <= 10").join(_table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").groupBy("query_id").agg(F.coalesce(F.bool_or(F.col("label") == F.col("own")), F.lit(False)).alias("hit")),
}

_CHUNKS = """c AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i AS INT) AS chunk_index, doc_id || '__chunk_' || i AS chunk_id, substr(text, i * {n} + 1, {n}) AS text
FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / {n}.0) AS BIGINT))) AS i FROM documents WHERE text <> ''))"""
_C500, _C200 = _CHUNKS.replace("{n}", "500"), _CHUNKS.replace("{n}", "200")
_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"
_DENSE = f"""p AS (SELECT q.vec_id AS query_id, q.label AS own, e.vec_id, e.label, {_COS} AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
t AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INT) AS rank FROM p) WHERE rank <= 20)"""
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"

_SQL: dict[str, str] = {
    "strip_invisible": "SELECT doc_id, regexp_replace(text, '[​-‍﻿⁠]', '', 'g') AS text FROM documents",
    "soft_normalize": "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS text FROM documents",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "tokenize": f"SELECT doc_id, len({_TOKENS}) AS n_tokens FROM documents",
    "redact_secrets": r"SELECT doc_id, regexp_replace(regexp_replace(text, '\b(sk-|pcsk_)[A-Za-z0-9_-]{8,}', '[redacted]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted]', 'g') AS text FROM documents",
    "strip_citations": r"SELECT conv_id, turn, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[\d+\]', '', 'g'), '\*\*', '', 'g'), chr(10)), lambda x: trim(x) <> ''), chr(10)) AS text FROM conversations",
    "has_markdown_link": r"SELECT conv_id, turn, regexp_matches(text, '\[[^\]]+\]\([^)]+\)') AS cited FROM conversations",
    "url_path_section_site": "SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]+)', 1), ''), 'home') AS section, regexp_extract(url, '://([^/?#]*)', 1) AS site FROM pages",
    "url_doc_id": r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/'), '^/+|/+$|\.html$', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), ''), 'index') AS slug FROM pages",
    "normalize_pdf_url": "SELECT page_id, 'https://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') AS url FROM pages",
    "fixed_chunk": f"WITH {_C500} SELECT * FROM c",
    "assign_chunk_ids": f"WITH {_C200} SELECT document_id, chunk_index, chunk_id FROM c",
    "chunk_length_stats": f"WITH {_C500} SELECT round(avg(length(text)), 4) AS mean_length, CAST(min(length(text)) AS INT) AS least, CAST(max(length(text)) AS INT) AS most, count(*) AS n FROM c",
    "bm25_corpus_stats": f"""WITH d AS (SELECT doc_id, {_TOKENS.replace('text', "coalesce(text, '')")} AS ws FROM documents), g AS (SELECT count(*) AS n_docs, round(avg(len(ws)), 6) AS mean_length FROM d)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, any_value(n_docs) AS n_docs, any_value(mean_length) AS mean_length FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY ALL), g GROUP BY term""",
    "bm25_topk": f"""WITH d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents), x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM x GROUP BY ALL), g AS (SELECT count(*) AS n_docs, avg(len(ws)) AS mean FROM d),
df AS (SELECT term, ln(n_docs - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf, g GROUP BY term, n_docs),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(qtf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * n / mean)))) AS score FROM q JOIN i USING (term) JOIN tf USING (term), g GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10",
    "diverse_filter": f"""WITH {_DENSE}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM t),
o AS (SELECT query_id, vec_id, label, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank FROM g WHERE n <= 2) SELECT * FROM o WHERE rank <= 5""",
    "relevance_gap_filter": f"WITH {_DENSE} SELECT query_id, vec_id, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM t) WHERE score >= best - 0.1::DOUBLE OR rank <= 2",
    "neighbor_join": f"""WITH {_C500} SELECT a.document_id, b.chunk_index AS neighbor_index, a.chunk_index, b.text AS neighbor_text FROM c a JOIN c b ON a.document_id = b.document_id AND abs(a.chunk_index - b.chunk_index) = 1
WHERE trim(b.text) <> ''""",
    "format_quantity": """SELECT event_id, CASE WHEN event_type = 'purchase' THEN '$' || printf('%.2f', value) WHEN abs(value) >= 100 THEN format('{:,}', CAST(round_even(value, 0) AS BIGINT)) || ' GB'
WHEN abs(value) >= 10 THEN printf('%.1f', value) || ' GB' ELSE printf('%.2f', value) || ' GB' END AS shown FROM events""",
    "retrieval_hit": f"WITH {_DENSE} SELECT query_id, coalesce(bool_or(label = own), false) AS hit FROM t WHERE rank <= 10 GROUP BY query_id",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword retrieval of every benchmark text over all documents."""
    return _QUERIES["bm25_topk"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _plan(sql) for name, sql in PLANS.items()} | _QUERIES | corpus.QUERIES | reports.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: _elsewhere(sql) for name, sql in PLANS.items()} | _SQL | corpus.SQL | reports.SQL
