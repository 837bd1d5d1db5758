"""Corpus, retrieval, text and page queries, and their SQL, written from the operators' semantics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import blocks as B
from textloom.operators import index as X
from textloom.operators import metering as M
from textloom.operators import pages as P
from textloom.operators import retrieval as R
from textloom.operators import structure as S
from textloom.operators import traces as A
from textloom.sources import folders
from textloom.sources.snapshots import ChunkStore
from textloom.streaming import jobs as J


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_table(spark, sf_dir, name))


# ---- retrieval: benchmark texts ask; their vectors are those of like number


def _dense(spark, sf_dir, k=10):
    vectors = _table(spark, sf_dir, "embeddings")
    asks = vectors.join(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    found = R.dense_topk(vectors, asks, k)
    return found.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "label", "score", "rank")


def _keyword(spark, sf_dir, k=10):
    return R.bm25_topk(_table(spark, sf_dir, "documents"), "doc_id", _table(spark, sf_dir, "benchmark"), "item_id", k)


def _scores(df):
    return df.withColumn("score", F.round("score", 6))


def _chunks(spark, sf_dir):
    return R.fixed_chunk(_table(spark, sf_dir, "documents"))


def _chunk_hits(spark, sf_dir, k=3):
    """The ``k`` best chunks of every question, with their place in their document."""
    chunks = _chunks(spark, sf_dir)
    hits = R.bm25_topk(chunks, "chunk_id", _table(spark, sf_dir, "benchmark"), "item_id", k)
    place = F.regexp_extract("chunk_id", r"^(.*)__chunk_(\d+)$", 2).cast("int")
    return hits.select("item_id", "chunk_id", F.regexp_extract("chunk_id", r"^(.*)__chunk_(\d+)$", 1).alias("document_id"), place.alias("chunk_index"), "score", "rank")


def _blocks(spark, sf_dir):
    blocks = R.merge_hits(_chunk_hits(spark, sf_dir), _chunks(spark, sf_dir), 1, ("item_id", "rank"))
    return blocks.withColumn("chunk_id", F.concat("document_id", F.lit("__chunk_"), "chunk_index"))


def _titled(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("source", F.lit("")).alias("title"))


#: The scopes that questions get by turns: include, exclude.  Null excludes mean the default.
SCOPES = ((("src1", " src2 ", ""), None), ((), ()), (None, ("src3", " ")), (None, None))
DEFAULT_EXCLUDE = ("src0", "src5")


def _scope(spark, sf_dir, query):
    kind = lambda names: F.lit(None).cast("array<string>") if names is None else F.array(*map(F.lit, names)).cast("array<string>")
    table, turn = _table(spark, sf_dir, "benchmark"), F.col("item_id") % len(SCOPES)
    pick = lambda i: F.coalesce(*[F.when(turn == n, kind(s[i])) for n, s in enumerate(SCOPES)])
    return R.Scope(table.select(F.col("item_id").alias(query), pick(0).alias("include"), pick(1).alias("exclude")), "source", DEFAULT_EXCLUDE)


def _sourced(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")


def _chunks_with(docs, *others):
    """Chunks with ``others``, columns of ``docs``, as a join by ``document_id`` gives them.

    A chunk takes them along, so no text is shuffled; only where ids repeat, or aren't those of the
    chunks, the join is made.
    """
    named = docs.select(F.col("doc_id").cast("string").alias("document_id"), *others).where("document_id is not null")
    if named.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1 or contains(document_id, '/')").limit(1).count():
        return R.fixed_chunk(docs).join(named, "document_id")
    return R.fixed_chunk(docs.where("doc_id is not null"), others=others)


def _scoped_keyword(spark, sf_dir, k=10):
    """Chunks of every question, within its scope."""
    chunks = _chunks_with(_table(spark, sf_dir, "documents"), "source")
    return R.bm25_topk(chunks, "chunk_id", _table(spark, sf_dir, "benchmark"), "item_id", k, scope=_scope(spark, sf_dir, "item_id"))


def _scoped_dense(spark, sf_dir, k=10, most=R.MOST_WEIGHTS):
    """Documents of every question by their vectors, within its scope."""
    vectors = _table(spark, sf_dir, "embeddings").join(_sourced(spark, sf_dir), "vec_id")
    asks = _table(spark, sf_dir, "embeddings").join(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return R.dense_topk(vectors, asks, k, _scope(spark, sf_dir, "query_id"), most).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank")


def retrieve_context(spark, sf_dir, lite=False):
    """The funnel without a reranker: scopes before the cuts, both rankings (a document's vector is its first chunk's), fusion, two chunks a document, the gap, neighbours, numbered blocks."""
    docs = _table(spark, sf_dir, "documents")
    chunks = _chunks_with(docs.withColumns({"title": F.col("source"), "source_url": F.lit("")}), "title", "source_url")
    dense = _scoped_dense(spark, sf_dir).select("item_id", F.concat(F.col("doc_id").cast("string"), F.lit("__chunk_0")).alias("chunk_id"), "score", "rank")
    found = R.retrieve_context(chunks, dense, _scoped_keyword(spark, sf_dir), "item_id", 2, 5, 0.0123, 1, lite)
    return found.select("item_id", F.md5("context").alias("digest"), F.length("context").alias("characters"))


def _golden(spark, sf_dir, most=R.MOST_WEIGHTS):
    """A question's expected documents are those that hold its text (of ten words or more).

    Questions of at most ``most`` characters in all go to the tasks, which look up the eight words
    after a question's first one at every place where they may start, and compare the whole text
    there; more questions are joined by these words.
    """
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("expected_id"), F.col("text").alias("body"))
    asks = _table(spark, sf_dir, "benchmark")
    if (asks.agg(F.sum(F.length("text"))).first()[0] or 0) <= most:
        true = _held_questions(docs, asks.where("text is not null").toPandas())
        true = true.distinct().groupBy("item_id").agg(F.sort_array(F.collect_list(F.col("expected_id").cast("string"))).alias("expected"))
        return asks.select("item_id").join(true, "item_id", "left")
    # Candidates share eight words in a row with the question's inside, so no document meets all questions.
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def grams(c):
        out = words(c)
        for k in range(1, 8):
            out = F.zip_with(out, F.slice(words(c), k + 1, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    key = asks.select("item_id", F.col("text").alias("question"), F.array_join(F.slice(words(F.col("text")), 2, 8), " ").alias("gram"))
    held = docs.select("expected_id", F.explode(grams(F.col("body"))).alias("gram")).join(key, "gram").select("item_id", "question", "expected_id").distinct()
    true = held.join(docs, "expected_id").where(F.col("body").contains(F.col("question")))
    true = true.groupBy("item_id").agg(F.sort_array(F.collect_list(F.col("expected_id").cast("string"))).alias("expected"))
    return asks.select("item_id").join(true, "item_id", "left")


def _held_questions(docs, asks):
    """``item_id, expected_id`` of the questions (``item_id, text``) that a document (``expected_id, body``) holds."""
    known, starts = {}, set()
    for item, text in zip(asks["item_id"], asks["text"]):
        gram = text.encode().split()[1:9]  # splits at the same ASCII blanks as \s
        if gram:
            known.setdefault(tuple(gram), []).append((item, text))
            starts.add(gram[0])
    place = docs.sparkSession.sparkContext.broadcast((known, starts))

    def found(batches):
        known, starts = place.value
        lengths = sorted({len(g) for g in known})
        for pdf in batches:
            out = []
            for key, body in zip(pdf["expected_id"], pdf["body"]):
                words = body.encode().split()
                grams = {tuple(words[i : i + n]) for i, w in enumerate(words) if w in starts for n in lengths}
                out += [(item, key) for g in grams & known.keys() for item, text in known[g] if text in body]
            yield pd.DataFrame(out, columns=["item_id", "expected_id"])

    kinds = docs.schema["expected_id"].dataType.simpleString()
    return docs.where("body is not null").mapInPandas(found, f"item_id long, expected_id {kinds}")


def golden_eval(spark, sf_dir):
    found = R.golden_eval(_keyword(spark, sf_dir, 5), _golden(spark, sf_dir), "item_id", "doc_id")
    return found.select("item_id", "hit", F.array_join("retrieved", ",").alias("retrieved"))


def eval_averages(spark, sf_dir):
    """Hit rate and the mean number of documents found over all questions; no questions give a rate of 0."""
    rows = golden_eval(spark, sf_dir)
    rate = F.coalesce(F.round(F.avg(F.col("hit").cast("double")), 4), F.lit(0.0))
    return rows.agg(F.count("*").alias("questions"), rate.alias("hit_rate"), F.round(F.avg(F.size(F.split("retrieved", ",")).cast("double")), 4).alias("mean_found"))


def query_chunk_cross(spark, sf_dir):
    """Every query against every vector, in tiles of blocks whatever their number; the five best stay."""
    vectors = _table(spark, sf_dir, "embeddings")
    asks = vectors.join(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return _scores(R.dense_topk(vectors, asks, 5, most=0).select("query_id", "vec_id", "score", "rank"))


def cosine_similarity(spark, sf_dir):
    """Cosine of every vector and the one of the next id."""
    vectors = _table(spark, sf_dir, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("q"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


def lookup_chunks(spark, sf_dir):
    """Documents of the labelled ids, from those in English first, else from all."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    return R.lookup_chunks(_table(spark, sf_dir, "labels"), docs.where("lang = 'en'").withColumn("found_in", F.lit("first")), docs.withColumn("found_in", F.lit("second")), "doc_id")


def hydrate_hits(spark, sf_dir):
    hits = _keyword(spark, sf_dir, 5).select("item_id", "doc_id", "rank", F.lit("own text").alias("text"), F.lit("own title").alias("title"))
    stored = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("text")).alias("text"), F.col("source").alias("title"))
    return R.hydrate_hits(hits, stored, "doc_id")


_LINES = lambda c: B.blocks_of(F.col(c), "\n")


def _joined(blocks):
    return F.md5(F.array_join(blocks, "\n"))


def link_sources(spark, sf_dir):
    """Every link of a page's anchors with the sorted set of pages that hold it."""
    links = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    rows = links.distinct().groupBy("link").agg(F.sort_array(F.collect_list("page_id")).alias("pages"))
    return rows.select("link", F.size("pages").cast("long").alias("n_pages"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def seeded_sample_with_required(pages: DataFrame, required, n: int, seed: int, excluded=None) -> DataFrame:
    """``pages`` (``page_id, url``) to ``n``: all required ones, then others in the order of a seeded hash; excluded ones never."""
    if excluded is not None:
        pages = pages.where(~F.coalesce(excluded, F.lit(False)))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("page_id").cast("string")))
    rows = pages.select("page_id", "url", F.coalesce(required, F.lit(False)).alias("required")).withColumn("order", order)
    return rows.orderBy(F.desc("required"), "order", "page_id").limit(n).union(rows.where("required")).distinct().drop("order")


def corpus_vs_live(local: DataFrame, live: DataFrame, least_ratio: float = 0.995, most_words: int = 5) -> DataFrame:
    """``page_id, status, word_delta`` of stored pages (``page_id, url, body``) beside fresh ones (``url, body``)."""
    both = local.join(live.select(F.col("url").alias("live_url"), F.col("body").alias("live_body"), F.lit(True).alias("seen")).dropDuplicates(["live_url"]), F.col("url") == F.col("live_url"), "left")
    words = lambda c: F.size(F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), " "), lambda w: w != ""))
    delta = words(F.col("body")) - words(F.col("live_body"))
    status = F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "no_source_url").when(F.col("seen").isNull(), "fetch_failed").when(words(F.col("live_body")) == 0, "no_live_body")
    status = status.when(F.abs(delta) <= most_words, "ok").otherwise("mismatch")
    compared = status.isin("ok", "mismatch")
    return both.select("page_id", status.alias("status"), F.when(compared, delta).alias("word_delta"))


def _stripped(html):
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def corpus_vs_live_join(spark, sf_dir):
    """Stored pages beside the articles of addresses without a query string."""
    pages = _table(spark, sf_dir, "pages")
    local = pages.select("page_id", "url", _stripped(F.col("html")).alias("body"))
    article = _stripped(F.regexp_extract("html", r"<article>([^~]*)</article>", 1))
    return corpus_vs_live(local, pages.where(~F.col("url").contains("?")).select("url", article.alias("body")))


def mismatch_sort(spark, sf_dir):
    """Mismatches, the largest difference first."""
    rows = corpus_vs_live_join(spark, sf_dir).where("status = 'mismatch'")
    return rows.orderBy(F.desc(F.abs("word_delta")), "page_id")


def sync_summary(spark, sf_dir):
    """Links of all pages against stored addresses: kept, to load, without an address; and stored pages that no link names."""
    pages = _table(spark, sf_dir, "pages")
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")).distinct()
    stored = pages.select(T.url_path(F.col("url")).alias("link"), "page_id").groupBy("link").agg(F.count("*").alias("n"))
    both = links.withColumn("linked", F.lit(True)).join(stored, "link", "full")
    count = lambda c: F.count_if(c)
    return both.agg(
        count(F.col("linked") & F.col("n").isNotNull()).alias("skipped_existing"), count(F.col("linked") & F.col("n").isNull() & (F.col("link") != "")).alias("downloaded"),
        count(F.col("linked") & (F.col("link") == "")).alias("failed"), F.coalesce(F.sum(F.when(F.col("linked").isNull(), F.col("n"))), F.lit(0)).alias("removed"),
    )


def first_keyword_match(spark, sf_dir):
    """The first nation (by key) whose first three letters occur in a message, else ``none``."""
    nations = _table(spark, sf_dir, "nation").select(F.substring("n_name", 1, 3).alias("keyword"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("priority"))
    return R.first_keyword_match(_table(spark, sf_dir, "conversations"), nations, ("conv_id", "turn"))


def first_keyword_match_parts(spark, sf_dir):
    """The same against the colours, metals and so on that part names are made of, a dimension of many rows."""
    parts = _table(spark, sf_dir, "part")
    names = parts.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("keyword"), "p_partkey").groupBy("keyword").agg(F.min("p_partkey").alias("priority"))
    return R.first_keyword_match(_table(spark, sf_dir, "documents"), names.withColumn("name", F.col("keyword")), ("doc_id",))


def overlap_text(spark, sf_dir):
    """Chunks of 60 characters that step by 45, so that neighbours overlap, whole."""
    docs = _table(spark, sf_dir, "documents").where("text <> ''")
    at = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 45).cast("int"))
    chunks = docs.select(F.col("doc_id").cast("string").alias("document_id"), "text", F.explode(at).alias("chunk_index"))
    return B.overlap_text(chunks.select("document_id", "chunk_index", F.expr("substring(text, chunk_index * 45 + 1, 60)").alias("text")))


def state_fold(spark, sf_dir):
    """Messages as updates of their conversation: roles are overwritten by their last text's opening, turns append."""
    talks = _table(spark, sf_dir, "conversations").where("text is not null")
    value = F.md5("text")
    scalar = talks.select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.col("role").alias("field"), value.alias("value"), F.lit(False).alias("appends"))
    listed = talks.select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.lit("turns").alias("field"), value.alias("value"), F.lit(True).alias("appends"))
    found = J.state_fold(scalar.unionByName(listed))
    return found.select("key", "field", F.coalesce("value", F.array_join("items", ",")).alias("state"))


def exclude_articles(spark, sf_dir):
    """Without drafts (no language), listed ids (toxic ones) and titles (first lines) that end in ``(Spanish)``."""
    docs = _table(spark, sf_dir, "documents")
    listed = _table(spark, sf_dir, "labels").where("toxic = 1")
    spanish = F.coalesce(F.regexp_extract("text", r"^([^\n]*)", 1).rlike(r"(?i)\(Spanish\)\s*$"), F.lit(False))
    return docs.where(F.col("lang").isNotNull() & ~spanish).join(listed, "doc_id", "left_anti").select("doc_id", "lang")


def standard_lookup(spark, sf_dir):
    """Parts as standards: a brand is a state, a size and type give the code; codes are asked with the next letter too."""
    part = _table(spark, sf_dir, "part")
    code = lambda n: F.concat(F.col("p_size").cast("string"), F.lit("."), F.upper(F.substring("p_type", 1, 2)), F.lit("."), n.cast("string"))
    rows = part.select("p_partkey", F.col("p_brand").alias("state"), code(F.length("p_name")).alias("code"), code(F.length("p_name") + 1).alias("next"))
    entries = rows.groupBy("state", "code").agg(F.min("p_partkey").cast("string").alias("description")).withColumn("mappings", F.array("description"))
    found = B.standard_lookup(rows.select("state", F.col("next").alias("code")).distinct(), entries)
    return found.select("state", "requested", "found", "description", F.array_join("similar", ",").alias("similar"))


def answer_schema_check(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    payload = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("answer"), (F.col("turn") / 4).alias("confidence"), (F.col("role") == "user").alias("needs_human")))
    ok, wrong = A.answer_schema_check(payload)
    return talks.select("conv_id", "turn", ok.alias("valid"), F.array_join(wrong, "; ").alias("errors"))


def memory_validation(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    band = F.concat(F.lit("Grade "), F.col("turn").cast("string"))
    role = F.when(F.col("role") == "user", "Teacher ").otherwise(F.col("role"))
    rows = talks.select("conv_id", "turn", role.alias("role"), F.array(F.lit("Kindergarten"), band).alias("grade_bands"), (F.length("text") > 100).alias("confirmed"))
    return A.memory_validation(rows).select("conv_id", "turn", "accepted", F.coalesce("reason", F.lit("")).alias("reason"))


def render_markdown_docs(spark, sf_dir):
    """Front matter of the fields that aren't empty, in order, and the body."""
    pages = _table(spark, sf_dir, "pages")
    fields = {"doc_id": T.url_doc_id(F.col("url")), "source_url": F.col("url"), "title": F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), "description": F.lit("")}
    return pages.select("page_id", F.md5(front_matter(fields, _stripped(F.col("html")))).alias("digest"))


def front_matter(fields, body):
    """A ``---`` block of ``key: value`` lines, null and empty values left out, then the body."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.coalesce(body, F.lit("")))


def trace_checks(spark, sf_dir):
    """Every assistant message as a trace whose tool call is known; the banner is a common opening."""
    talks = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = talks.select(
        F.concat_ws(":", "conv_id", "turn").alias("trace_id"), F.col("text").alias("answer"), F.array(F.lit("search_doc")).alias("tool_calls"), F.lit(False).alias("is_refusal"),
        F.col("text").startswith("The").alias("used_web"), F.col("turn").cast("int").alias("n_chunks"), F.lit("answer").alias("expected"), F.when(F.length("text") > 300, "web").otherwise(" Answer").alias("actual"),
    )
    return M.trace_checks(rows, "The", 500)


def _indexed(spark, sf_dir):
    """A written index of all documents, in the session's shared folder."""
    path = folders.scratch(spark, "index")
    X.build_index(_table(spark, sf_dir, "documents"), "doc_id", path)
    return path


def build_chunk_index(spark, sf_dir):
    """Chunks of every document, written as an index twice: what it holds by bucket of terms, and the stored count before and after."""
    path, chunks = folders.scratch(spark, "index"), _chunks(spark, sf_dir)
    first, again = X.build_index(chunks, "chunk_id", path), X.build_index(chunks, "chunk_id", path)
    postings = spark.read.parquet(f"{path}/postings/version={X.current(spark, path)['version']}")
    rows = postings.groupBy(F.substring("term", 1, 1).alias("letter")).agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("postings"), F.round(F.max("best"), 6).alias("best"))
    return rows.withColumns({"stored_before": F.lit(first["stored_before"]).cast("long"), "stored_again": F.lit(again["stored_before"]).cast("long"), "chunks": F.lit(again["documents"]).cast("long")})


def index_topk(spark, sf_dir):
    return _scores(X.index_topk(spark, _indexed(spark, sf_dir), _table(spark, sf_dir, "benchmark"), "item_id", "doc_id"))


def replace_document_chunks(spark, sf_dir):
    """A store of chunks: all documents, then shorter versions of the labelled low-quality ones, the same again, and toxic ones taken away."""
    store = ChunkStore(spark, folders.scratch(spark, "chunks"))
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    shorter = docs.join(labels.where("quality = 0"), "doc_id", "left_semi").withColumn("text", F.substring("text", 1, 300))
    versions = [store.replace(docs, R.fixed_chunk), store.replace(shorter, R.fixed_chunk), store.replace(shorter, R.fixed_chunk), store.delete(labels.where("toxic = 1").select("doc_id"))]
    rows = store.chunks().groupBy("document_id").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last_index"), F.sum(F.length("text")).alias("characters"))
    return rows.withColumn("versions", F.lit(",".join(map(str, versions))))


def text_similarity(spark, sf_dir):
    """Stored documents beside their text without secrets and marks: equal ones are found by hash."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"), T.redact_secrets(F.col("text")).alias("b"))
    found = P.text_similarity(F.col("a"), F.col("b"))
    return docs.select("doc_id", *[found[n].alias(n) for n in ("ratio", "word_delta", "identical", "excerpt")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rrf_fuse": lambda s, d: R.rrf_fuse(_dense(s, d), _keyword(s, d), "item_id", "doc_id").withColumn("score", F.round("score", 9)),
    "hybrid_retrieve": lambda s, d: R.hybrid_retrieve(_dense(s, d), _keyword(s, d), _table(s, d, "documents"), "item_id", "doc_id", "source").select("item_id", "doc_id", "source", "rank"),
    "diverse_dense_retrieve": lambda s, d: R.diverse_filter(_dense(s, d, 20), "item_id", "label", 1, 5).select("item_id", "doc_id", "label", "rank"),
    "debug_rankings": lambda s, d: R.debug_rankings(_dense(s, d), _keyword(s, d), "item_id", "doc_id", 5).withColumn("score", F.round("score", 6)),
    "retrieve_context": retrieve_context,
    "retrieve_context_lite": lambda s, d: retrieve_context(s, d, True),
    "scoped_keyword": lambda s, d: _scores(_scoped_keyword(s, d, 5)),
    "scoped_dense": lambda s, d: _scores(_scoped_dense(s, d, 5)),
    "golden_eval": golden_eval,
    "eval_averages": eval_averages,
    "query_chunk_cross": query_chunk_cross,
    "cosine_similarity": cosine_similarity,
    "lookup_chunks": lookup_chunks,
    "hydrate_hits": hydrate_hits,
    "expand_neighbors": lambda s, d: R.expand_neighbors(_chunk_hits(s, d), _chunks(s, d), 1, "item_id"),
    "context_cap": lambda s, d: R.context_cap(_blocks(s, d), 2, "item_id").select("item_id", "rank", "first_index", F.md5("block").alias("digest")),
    "context_chunk_ids": lambda s, d: R.context_chunk_ids(_blocks(s, d), "item_id").select("item_id", F.array_join("chunk_ids", ",").alias("chunk_ids")),
    "format_context": lambda s, d: R.format_context(
        _blocks(s, d).join(_titled(s, d), "document_id").select("item_id", "rank", "title", F.lit("").alias("source_url"), "document_id", "chunk_id", "chunk_ids", F.col("block").alias("text")), "item_id"
    ).select("item_id", F.md5("context").alias("digest")),
    "dedupe_consecutive_blocks": _over("documents", lambda t: t.select("doc_id", *[c.alias(n) for c, n in zip(B.dedupe_consecutive_blocks(_LINES("text")), ("kept", "removed"))]).select("doc_id", _joined(F.col("kept")).alias("digest"), "removed")),
    "truncate_after_marker": _over("documents", lambda t: t.select("doc_id", _joined(B.truncate_after_marker(_LINES("text"), B.ARTICLE_HEADINGS, B.ARTICLE_LINES, 5)).alias("digest"))),
    "strip_marked_blocks": _over("documents", lambda t: t.select("doc_id", _joined(B.strip_marked_blocks(_LINES("text"), (("all rights", "reserved"),))).alias("digest"))),
    "strip_heading_pairs": _over("documents", lambda t: t.select("doc_id", _joined(B.strip_heading_pairs(_LINES("text"), "all rights reserved.", "the")).alias("digest"))),
    "heading_sections": _over("documents", lambda t: B.heading_sections(t.where("text is not null"), "doc_id").select("doc_id", "pos", F.md5("unit").alias("digest"))),
    "overlap_text": overlap_text,
    "state_fold": state_fold,
    "first_keyword_match_parts": first_keyword_match_parts,
    "structure_chunk": _over("documents", lambda t: S.structure_chunk(t)),
    "clean_title": _over("pages", lambda t: t.select("page_id", T.clean_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))),
    "pdf_basename": _over("pages", lambda t: t.select("page_id", T.pdf_basename(F.col("url")).alias("name"))),
    "article_slug": _over("pages", lambda t: t.select("page_id", T.article_slug(F.col("url")).alias("slug"))),
    "humanize_id": _over("part", lambda t: t.select("p_partkey", T.humanize_id(F.concat(F.initcap("p_name"), F.lit("_"), F.col("p_brand"))).alias("name"))),
    "resolve_title": _over("documents", lambda t: t.select("doc_id", T.resolve_title(F.when(F.col("lang") == "en", F.col("source")), F.col("text"), F.concat(F.lit("doc_"), F.col("doc_id"))).alias("title"))),
    "clean_markdown": _over("conversations", lambda t: t.select("conv_id", "turn", T.clean_markdown(F.col("text")).alias("text"))),
    "classify_question": _over("conversations", lambda t: t.select("conv_id", "turn", T.classify_question(F.col("text")).alias("kind"))),
    "classify_answer": _over("conversations", lambda t: t.select("conv_id", "turn", T.classify_answer(F.col("text"), F.col("role") == "system", "The", "That").alias("outcome"))),
    "scope_query": _over("conversations", lambda t: t.select("conv_id", "turn", T.scope_query(F.col("text"), T.role_phrase(F.when(F.col("role") == "user", "admin").otherwise(F.col("role")))).alias("query"))),
    "parse_json_tolerant": _over("events", lambda t: t.select("event_id", F.array_join(T.parse_json_tolerant(F.when(F.col("event_type") == "error", F.concat(F.lit('["'), F.col("event_type"), F.lit('", " x "]'))).otherwise(F.col("props"))), "|").alias("items"))),
    "keyword_in_chunk_flag": _over("conversations", lambda t: t.select("conv_id", "turn", T.keyword_in_chunk_flag(F.col("role"), F.col("text")).alias("found"))),
    "language_filter": _over("documents", lambda t: t.select("doc_id", F.coalesce(T.language_share(F.col("text")) >= 0.95, F.lit(False)).alias("other_language"))),
    "body_length_validation": _over("pages", lambda t: t.select("page_id", *[c.alias(n) for c, n in zip(P.body_length_validation(T.url_path(F.col("url")), _stripped(F.col("html")), 120, 5, ("the",)), ("status", "reason"))])),
    "strip_duplicate_sources": _over("conversations", lambda t: t.select("conv_id", "turn", T.strip_duplicate_sources(F.concat(F.col("text"), F.lit("\nSource: here"))).alias("text"))),
    "text_issues": _over("documents", lambda t: t.select("doc_id", F.array_join(P.text_issues(F.col("text"), T.soft_normalize(F.col("text"))), "|").alias("issues"))),
    "text_similarity": text_similarity,
    "extract_pages": _over("pages", lambda t: P.extract_pages(t)),
    "extract_articles": _over("pages", lambda t: P.extract_articles(t)),
    "discover_links": _over("pages", lambda t: P.discover_links(t, "page_id", "url", "html", "example.com", endings=("",))),
    "link_sources": link_sources,
    "sync_summary": sync_summary,
    "corpus_vs_live_join": corpus_vs_live_join,
    "mismatch_sort": mismatch_sort,
    "seeded_sample_with_required": _over("pages", lambda t: seeded_sample_with_required(t, F.col("url").contains("?page=2&ref=x") & F.col("url").contains("www."), 100, 7, P.excluded_path(T.url_path(F.col("url")), (), ("/es/",)))),
    "first_keyword_match": first_keyword_match,
    "exclude_articles": exclude_articles,
    "standard_lookup": standard_lookup,
    "answer_schema_check": answer_schema_check,
    "memory_validation": memory_validation,
    "render_markdown_docs": render_markdown_docs,
    "trace_checks": trace_checks,
    "request_rate": _over("events", lambda t: A.request_rate(t, "user_id", "ts", "event_id", 86400)),
    "build_chunk_index": build_chunk_index,
    "index_topk": index_topk,
    "replace_document_chunks": replace_document_chunks,
}

# ---- the same in DuckDB's SQL

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _cosine(a, b):
    dot = lambda x, y: _DOT.format(a=x, b=y)
    return f"{dot(a, b)} / sqrt({dot(a, a)}) / sqrt({dot(b, b)})"


_ASK = "SELECT vec_id, label, embedding FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)"


def _dn(k, name="dn", where=""):
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank
FROM (SELECT q.vec_id AS item_id, e.vec_id AS doc_id, e.label, {_cosine('e.embedding', 'q.embedding')} AS score FROM embeddings e JOIN ({_ASK}) q ON e.vec_id <> q.vec_id {where})) WHERE rank <= {k})"""


def _kw(k, source="documents", key="doc_id", name="kw", where=""):
    return f"""kd AS (SELECT {key} AS key, {_TOKENS} AS ws FROM {source}), kx AS (SELECT key, len(ws) AS n, unnest(ws) AS term FROM kd),
ktf AS (SELECT key, n, term, count(*) AS tf FROM kx GROUP BY ALL), kg AS (SELECT count(*) AS n_docs, avg(len(ws)) AS mean FROM kd),
kdf AS (SELECT term, ln(n_docs - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM ktf, kg GROUP BY term, n_docs),
ki AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM kdf) ELSE raw END AS idf FROM kdf),
kq AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
ks AS (SELECT item_id, key, sum(qtf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * n / mean)))) AS score FROM kq JOIN ki USING (term) JOIN ktf USING (term), kg GROUP BY ALL),
{name} AS (SELECT item_id, key AS {key}, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, key) AS INT) AS rank FROM ks WHERE score > 0 {where}) WHERE rank <= {k})"""


def _rrf(dense="dn", keyword="kw"):
    return f"""fu AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, a NULLS LAST, b NULLS LAST, doc_id) AS INT) AS rank
FROM (SELECT coalesce(d.item_id, k.item_id) AS item_id, coalesce(d.doc_id, k.doc_id) AS doc_id, d.rank AS a, k.rank AS b, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS score
FROM {dense} d FULL JOIN {keyword} k ON d.item_id = k.item_id AND d.doc_id = k.doc_id))"""


def _diverse(source, group, per, k, name="dv"):
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY item_id, {group} ORDER BY rank) AS in_group FROM {source}),
{name} AS (SELECT * EXCLUDE (rank, place, in_group), CAST(place AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM {name}0 WHERE in_group <= {per}) WHERE place <= {k})"""


_CHUNKS = """c AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i AS INT) AS chunk_index, doc_id || '__chunk_' || i AS chunk_id, substr(text, i * 500 + 1, 500) AS text
FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents WHERE text <> ''))"""
_HITS = f"""{_CHUNKS}, {_kw(3, 'c', 'chunk_id')}, h AS (SELECT kw.item_id, kw.rank, c.document_id, c.chunk_index, c.chunk_id FROM kw JOIN c USING (chunk_id))"""
_BLOCKS = f"""{_HITS}, m AS (SELECT h.item_id, h.rank, h.document_id, h.chunk_id AS own_id, n.chunk_index, n.chunk_id, trim(n.text, ' ') AS t FROM h JOIN c n ON n.document_id = h.document_id AND abs(n.chunk_index - h.chunk_index) <= 1
WHERE trim(n.text, ' ') <> '' OR n.chunk_index = h.chunk_index),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, rank, t ORDER BY chunk_index) AS copy FROM m),
b AS (SELECT item_id, rank, document_id, own_id, min(chunk_index) AS first_index, string_agg(chunk_id, ',' ORDER BY chunk_index) AS ids, string_agg(chunk_id, ', ' ORDER BY chunk_index) AS spaced,
coalesce(string_agg(t, chr(10) || chr(10) ORDER BY chunk_index) FILTER (copy = 1 AND t <> ''), '') AS block FROM o GROUP BY ALL)"""
_B = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' '))"
_PLAIN = lambda x: f"lower(trim(regexp_replace({x}, '[\\t\\n\\v\\f\\r ]+', ' ', 'g'), ' '))"
_HEAD = lambda x: f"lower(trim(regexp_replace({x}, '^#+[\\t\\n\\v\\f\\r ]*', ''), ' '))"
_WORDS = lambda x: f"len(list_filter(regexp_split_to_array({x}, '[\\t\\n\\v\\f\\r ]+'), lambda w: w <> ''))"
_IN = lambda items: "(" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + ")"
_STRIP = lambda x: f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[\\t\\n\\v\\f\\r ]+', ' ', 'g'), ' ')"
_DIGEST = lambda x: f"md5(array_to_string({x}, chr(10)))"
_PATH = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"
SQL_SLUG = f"coalesce(nullif(regexp_replace(regexp_replace({_PATH}, '^/+|/+$|\\.html$', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), ''), 'index')"
_LIVE = f"""l AS (SELECT page_id, url, {_STRIP('html')} AS body FROM pages),
v AS (SELECT DISTINCT url, {_STRIP("regexp_extract(html, '<article>([^~]*)</article>', 1)")} AS body FROM pages WHERE url NOT LIKE '%?%'),
w AS (SELECT l.page_id, l.url, v.url AS seen, {_WORDS('l.body')} AS a, {_WORDS("coalesce(v.body, '')")} AS b FROM l LEFT JOIN v ON v.url = l.url),
z AS (SELECT page_id, CASE WHEN coalesce(trim(url), '') = '' THEN 'no_source_url' WHEN seen IS NULL THEN 'fetch_failed' WHEN b = 0 THEN 'no_live_body' WHEN abs(a - b) <= 5 THEN 'ok' ELSE 'mismatch' END AS status, CAST(a - b AS INT) AS delta FROM w),
y AS (SELECT page_id, status, CASE WHEN status IN ('ok', 'mismatch') THEN delta END AS word_delta FROM z)"""
_GOLD = f"""{_kw(5)}, x AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
g AS (SELECT item_id, coalesce(bool_or(kw.doc_id IN (SELECT doc_id FROM x WHERE x.item_id = b.item_id)), false) AS hit, coalesce(string_agg(CAST(kw.doc_id AS VARCHAR), ',' ORDER BY rank), '') AS retrieved
FROM benchmark b LEFT JOIN kw USING (item_id) GROUP BY item_id)"""
_MARK = f"(starts_with(x, '##') AND {_HEAD('x')} = 'related articles')"
_CODE = "CAST(p_size AS VARCHAR) || '.' || upper(substr(p_type, 1, 2)) || '.' || "
_FOUND = r"regexp_extract_all(lower(coalesce(text, '')), '[a-záéíóúüñ'']+')"
_QUESTION = "CASE " + " ".join("WHEN regexp_matches(trim(coalesce(text, ''), ' '), '(?i)" + p.replace("'", "''") + f"') THEN '{n}'" for n, p in T.QUESTION_RULES) + " ELSE 'general' END"

_NAMES = lambda names: "[" + ", ".join(f"'{n.strip()}'" for n in names if n.strip()) + "]"
_SCOPES = "al AS (SELECT item_id, doc_id FROM benchmark, (SELECT doc_id, coalesce(source, '') AS s FROM documents) WHERE CASE item_id % 4 " + " ".join(
    f"WHEN {n} THEN " + (f"list_contains({_NAMES(i)}, s)" if i else f"NOT list_contains({_NAMES(DEFAULT_EXCLUDE if e is None else e)}::VARCHAR[], s)") for n, (i, e) in enumerate(SCOPES)
) + " END)"
_KEYWORD_SCOPE = "AND (item_id, split_part(key, '__', 1)) IN (SELECT (item_id, CAST(doc_id AS VARCHAR)) FROM al)"
_DENSE_SCOPE = "AND (q.vec_id, e.vec_id) IN (SELECT (item_id, doc_id) FROM al)"


def _context(kept, radius):
    dense = _dn(10, "dd", _DENSE_SCOPE) + ", dn AS (SELECT item_id, doc_id || '__chunk_0' AS doc_id, rank FROM dd)"
    keyword = _kw(10, "c", "chunk_id", "kk", _KEYWORD_SCOPE) + ", kw AS (SELECT item_id, chunk_id AS doc_id, rank FROM kk)"
    return f"""WITH {_CHUNKS}, {_SCOPES}, {dense}, {keyword}, {_rrf()}, s AS (SELECT fu.*, split_part(doc_id, '__', 1) AS document FROM fu JOIN c ON c.chunk_id = fu.doc_id), {_diverse('s', 'document', 2, 5)},
w AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM dv) WHERE {kept}),
h AS (SELECT item_id, rank, c.* FROM w JOIN c ON c.chunk_id = w.doc_id),
m AS (SELECT h.item_id, h.rank, h.document_id, n.chunk_index, n.chunk_id, trim(n.text, ' ') AS t FROM h JOIN c n ON n.document_id = h.document_id AND abs(n.chunk_index - h.chunk_index) <= {radius}
WHERE trim(n.text, ' ') <> '' OR n.chunk_index = h.chunk_index),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, rank, t ORDER BY chunk_index) AS copy FROM m),
b AS (SELECT item_id, rank, document_id, string_agg(chunk_id, ', ' ORDER BY chunk_index) AS ids, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY chunk_index) FILTER (copy = 1 AND t <> ''), '') AS block FROM o GROUP BY ALL),
f AS (SELECT b.*, d.source, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM b JOIN documents d ON CAST(d.doc_id AS VARCHAR) = b.document_id),
g AS (SELECT item_id, string_agg('[' || n || '] title: ' || coalesce(source, '') || ' | document_id: ' || document_id || ' | chunk_id: ' || ids || chr(10) || block, chr(10) || chr(10) ORDER BY n) AS context FROM f GROUP BY item_id)
SELECT item_id, md5(context) AS digest, CAST(length(context) AS INT) AS characters FROM g"""


SQL: dict[str, str] = {
    "rrf_fuse": f"WITH {_dn(10)}, {_kw(10)}, {_rrf()} SELECT item_id, doc_id, round(score, 9) AS score, rank FROM fu",
    "hybrid_retrieve": f"WITH {_dn(10)}, {_kw(10)}, {_rrf()}, s AS (SELECT fu.*, d.source FROM fu JOIN documents d USING (doc_id)), {_diverse('s', 'source', 2, 5)} SELECT item_id, doc_id, source, rank FROM dv",
    "diverse_dense_retrieve": f"WITH {_dn(20)}, {_diverse('dn', 'label', 1, 5)} SELECT item_id, doc_id, label, rank FROM dv",
    "debug_rankings": f"""WITH {_dn(10)}, {_kw(10)}, {_rrf()}, u AS (SELECT item_id, 'dense' AS list, rank, doc_id, score FROM dn UNION ALL SELECT item_id, 'keyword', rank, doc_id, score FROM kw UNION ALL SELECT item_id, 'fused', rank, doc_id, score FROM fu)
SELECT item_id, list, rank, doc_id, round(score, 6) AS score FROM u WHERE rank <= 5""",
    "scoped_keyword": f"WITH {_CHUNKS}, {_SCOPES}, {_kw(5, 'c', 'chunk_id', where=_KEYWORD_SCOPE)} SELECT item_id, chunk_id, round(score, 6) AS score, rank FROM kw",
    "scoped_dense": f"WITH {_SCOPES}, {_dn(5, where=_DENSE_SCOPE)} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM dn",
    "retrieve_context": _context("best - score <= 0.0123 OR rank = 1", 1),
    "retrieve_context_lite": _context("true", 0),
    "golden_eval": f"WITH {_GOLD} SELECT * FROM g",
    "eval_averages": f"WITH {_GOLD} SELECT count(*) AS questions, coalesce(round(avg(CAST(hit AS INT)), 4), 0.0) AS hit_rate, round(avg(len(string_split(retrieved, ','))), 4) AS mean_found FROM g",
    "query_chunk_cross": f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INT) AS rank FROM
(SELECT q.vec_id AS query_id, e.vec_id, {_cosine('e.embedding', 'q.embedding')} AS score FROM ({_ASK}) q JOIN embeddings e ON e.vec_id <> q.vec_id)) WHERE rank <= 5""",
    "cosine_similarity": f"SELECT a.vec_id, round({_cosine('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "lookup_chunks": "SELECT doc_id, lang, CAST(length(text) AS INT) AS n, CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS found_in FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "hydrate_hits": f"""WITH {_kw(5)} SELECT item_id, kw.doc_id, rank, CASE WHEN lang = 'en' AND trim(text, ' ') <> '' THEN text ELSE 'own text' END AS text,
CASE WHEN lang = 'en' AND trim(text, ' ') <> '' THEN coalesce(nullif(trim(source, ' '), ''), 'own title') ELSE 'own title' END AS title FROM kw JOIN documents d ON d.doc_id = kw.doc_id""",
    "expand_neighbors": f"""WITH {_HITS}, e AS (SELECT item_id, rank, document_id, chunk_index, 0 AS step FROM h UNION ALL SELECT h.item_id, h.rank, h.document_id, n.chunk_index, 2 * abs(n.chunk_index - h.chunk_index) + CAST(n.chunk_index > h.chunk_index AS INT)
FROM h JOIN c n ON n.document_id = h.document_id AND abs(n.chunk_index - h.chunk_index) = 1 WHERE trim(n.text, ' ') <> ''),
f AS (SELECT item_id, document_id, chunk_index, min(rank * 100 + step) AS o FROM e GROUP BY ALL) SELECT item_id, document_id, chunk_index, CAST(row_number() OVER (PARTITION BY item_id ORDER BY o, document_id, chunk_index) AS INT) AS place FROM f""",
    "context_cap": f"WITH {_BLOCKS} SELECT item_id, rank, first_index, md5(block) AS digest FROM b WHERE rank <= 2",
    "context_chunk_ids": f"WITH {_BLOCKS} SELECT item_id, string_agg(ids, ',' ORDER BY rank) AS chunk_ids FROM b GROUP BY item_id",
    "format_context": f"""WITH {_BLOCKS} SELECT item_id, md5(string_agg('[' || rank || '] title: ' || coalesce(source, '') || ' | document_id: ' || document_id || ' | chunk_id: ' || spaced || chr(10) || block, chr(10) || chr(10) ORDER BY rank)) AS digest
FROM b JOIN documents d ON CAST(d.doc_id AS VARCHAR) = b.document_id GROUP BY item_id""",
    "dedupe_consecutive_blocks": f"""WITH f AS (SELECT doc_id, list_filter({_B}, lambda x: x <> '') AS filled FROM documents), g AS (SELECT doc_id, filled, list_filter(filled, lambda x: {_PLAIN('x')} NOT IN {_IN(B.TAB_LABELS)}) AS bare FROM f),
k AS (SELECT doc_id, filled, list_filter(bare, lambda x, i: i = 1 OR {_PLAIN('x')} <> {_PLAIN('bare[i - 1]')}) AS kept FROM g) SELECT doc_id, {_DIGEST('kept')} AS digest, CAST(len(filled) - len(kept) AS INT) AS removed FROM k""",
    "truncate_after_marker": f"""WITH f AS (SELECT doc_id, {_B} AS bs FROM documents), p AS (SELECT doc_id, bs, list_position(list_transform(bs, lambda x: {_MARK}), true) AS o FROM f),
q AS (SELECT doc_id, CASE WHEN o > 0 THEN bs[1:o - 1] ELSE bs END AS bs FROM p) SELECT doc_id, {_DIGEST(f"list_filter(bs, lambda x: x <> '' AND (regexp_matches(x, '^#[ ]') OR (NOT (starts_with(x, '##') AND ({_HEAD('x')} IN {_IN(B.ARTICLE_HEADINGS)} OR {_HEAD('x')} = '')) AND {_PLAIN('x')} NOT IN {_IN([*B.ARTICLE_LINES, ''])} AND {_WORDS('x')} >= 5)))")} AS digest FROM q""",
    "strip_marked_blocks": f"""SELECT doc_id, {_DIGEST(f"list_filter({_B}, lambda x: NOT ({_PLAIN('x')} = 'table of contents' OR (starts_with({_PLAIN('x')}, 'table of contents') AND {_WORDS(_PLAIN('x'))} <= 12) OR (contains({_PLAIN('x')}, 'all rights') AND contains({_PLAIN('x')}, 'reserved'))))")} AS digest FROM documents""",
    "strip_heading_pairs": f"""WITH f AS (SELECT doc_id, {_B} AS bs FROM documents), p AS (SELECT doc_id, bs, list_transform(bs, lambda x, i: {_HEAD('x')} = 'all rights reserved.' AND coalesce(contains({_PLAIN('bs[i + 1]')}, 'the'), false)) AS pair FROM f)
SELECT doc_id, {_DIGEST(f"list_filter(bs, lambda x, i: NOT pair[i] AND NOT (i > 1 AND pair[i - 1]) AND {_PLAIN('x')} <> 'the')")} AS digest FROM p""",
    "clean_title": f"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\\t\\n\\v\\f\\r ]+', ' ', 'g'), ' ') AS t FROM pages)
SELECT page_id, CASE WHEN contains(t, ' | ') THEN trim(split_part(t, ' | ', 1), ' ') WHEN contains(t, ' - ') THEN trim(split_part(t, ' - ', 1), ' ') WHEN contains(t, ' — ') THEN trim(split_part(t, ' — ', 1), ' ') ELSE t END AS title FROM t""",
    "pdf_basename": "SELECT page_id, url_decode(regexp_extract(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1)) AS name FROM pages",
    "article_slug": f"SELECT page_id, coalesce(nullif(lower(regexp_replace(regexp_extract(regexp_replace({_PATH}, '/+$', ''), '([^/]*)$', 1), '^\\d+-', '')), ''), 'index') AS slug FROM pages",
    "classify_question": f"SELECT conv_id, turn, {_QUESTION} AS kind FROM conversations",
    "classify_answer": "SELECT conv_id, turn, CASE WHEN starts_with(trim(coalesce(text, ''), ' '), 'The') THEN 'refuse' WHEN coalesce(role = 'system', false) OR starts_with(trim(coalesce(text, ''), ' '), 'That') THEN 'web' ELSE 'answer' END AS outcome FROM conversations",
    "scope_query": f"""WITH t AS (SELECT conv_id, turn, role, trim(coalesce(text, ''), ' ') AS t FROM conversations), c AS (SELECT *, trim(regexp_replace(regexp_replace(t, '{T.ROLE_WORDS}', ' ', 'g'), '[\\t\\n\\v\\f\\r ]+', ' ', 'g'), ' ') AS c FROM t)
SELECT conv_id, turn, CASE WHEN role <> 'user' THEN t WHEN contains(lower(CASE WHEN c = '' THEN t ELSE c END), 'for administrator') THEN (CASE WHEN c = '' THEN t ELSE c END) ELSE trim((CASE WHEN c = '' THEN t ELSE c END) || ' for administrator', ' ') END AS query FROM c""",
    "parse_json_tolerant": "SELECT event_id, CASE WHEN event_type = 'error' THEN event_type || '|x' ELSE coalesce(trim(props, ' '), '') END AS items FROM events",
    "keyword_in_chunk_flag": "SELECT conv_id, turn, contains(lower(coalesce(text, '')), lower(role)) AS found FROM conversations",
    "language_filter": f"""WITH f AS (SELECT doc_id, {_FOUND} AS ws FROM documents), c AS (SELECT doc_id, ws, list_filter(ws, lambda w: w NOT IN {_IN(T.NEUTRAL_WORDS)}) AS counted FROM f)
SELECT doc_id, coalesce(len(ws) >= 20 AND len(counted) > 0 AND 1 - len(list_filter(counted, lambda w: w IN {_IN(T.ENGLISH_WORDS)}))::DOUBLE / len(counted) >= 0.95, false) AS other_language FROM c""",
    "body_length_validation": f"""WITH t AS (SELECT page_id, {_PATH} AS path, {_STRIP('html')} AS body FROM pages), n AS (SELECT *, {_WORDS('body')} AS n FROM t)
SELECT page_id, CASE WHEN n < (CASE WHEN starts_with(path, '/research/') THEN 5 ELSE 120 END) THEN 'static_failed' WHEN NOT contains(lower(body), 'the') THEN 'incomplete' ELSE 'ok' END AS status,
CASE WHEN n < (CASE WHEN starts_with(path, '/research/') THEN 5 ELSE 120 END) THEN 'body too short (' || n || ' words)' WHEN NOT contains(lower(body), 'the') THEN 'missing expected keywords: the' END AS reason FROM n""",
    "link_sources": """WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) SELECT link, count(*) AS n_pages, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS pages FROM l GROUP BY link""",
    "sync_summary": f"""WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages), s AS (SELECT {_PATH} AS link, count(*) AS n FROM pages GROUP BY 1)
SELECT count(*) FILTER (l.link IS NOT NULL AND s.link IS NOT NULL) AS skipped_existing, count(*) FILTER (l.link <> '' AND s.link IS NULL) AS downloaded, count(*) FILTER (l.link = '') AS failed, CAST(coalesce(sum(s.n) FILTER (l.link IS NULL), 0) AS BIGINT) AS removed FROM l FULL JOIN s ON s.link = l.link""",
    "corpus_vs_live_join": f"WITH {_LIVE} SELECT * FROM y",
    "mismatch_sort": f"WITH {_LIVE} SELECT * FROM y WHERE status = 'mismatch' ORDER BY abs(word_delta) DESC, page_id",
    "seeded_sample_with_required": f"""WITH p AS (SELECT page_id, url, contains(url, '?page=2&ref=x') AND contains(url, 'www.') AS required, md5('7:' || page_id) AS o FROM pages WHERE NOT starts_with({_PATH}, '/es/') AND NOT contains(lower({_PATH}), 'espanol'))
SELECT DISTINCT page_id, url, required FROM (SELECT * FROM (SELECT * FROM p ORDER BY required DESC, o, page_id LIMIT 100) UNION ALL SELECT * FROM p WHERE required)""",
    "first_keyword_match": """SELECT c.conv_id, c.turn, coalesce((SELECT min_by(n_name, n_nationkey) FROM nation n WHERE contains(lower(coalesce(c.text, '')), lower(substr(n_name, 1, 3)))), 'none') AS match FROM conversations c""",
    "first_keyword_match_parts": """WITH w AS (SELECT lower(word) AS word, min_by(word, (k, word)) AS name, min(k) AS k FROM (SELECT word, min(p_partkey) AS k FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word) GROUP BY lower(word))
SELECT d.doc_id, coalesce((SELECT min_by(name, (k, name)) FROM w WHERE contains(lower(coalesce(d.text, '')), w.word)), 'none') AS match FROM documents d""",
    "overlap_text": """WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i AS INT) AS chunk_index, substr(text, i * 45 + 1, 60) AS text FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 45 + 1)) AS i FROM documents WHERE text <> '')),
p AS (SELECT *, coalesce(lead(text) OVER (PARTITION BY document_id ORDER BY chunk_index), '') AS nxt FROM c)
SELECT document_id, chunk_index, left(nxt, coalesce(list_max(list_filter(range(1, least(length(text), length(nxt)) + 1), lambda i: right(text, i) = left(nxt, i))), 0)) AS overlap FROM p""",
    "state_fold": """SELECT conv_id AS key, role AS field, max_by(md5(text), (turn, md5(text))) AS state FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id, role
UNION ALL SELECT conv_id, 'turns', string_agg(md5(text), ',' ORDER BY turn, md5(text)) FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""",
    "exclude_articles": r"SELECT doc_id, lang FROM documents d WHERE lang IS NOT NULL AND NOT coalesce(regexp_matches(regexp_extract(text, '^([^\n]*)', 1), '(?i)\(Spanish\)\s*$'), false) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)",
    "standard_lookup": f"""WITH e AS (SELECT p_brand AS state, {_CODE} length(p_name) AS code, CAST(min(p_partkey) AS VARCHAR) AS description FROM part GROUP BY ALL), a AS (SELECT DISTINCT p_brand AS state, {_CODE} (length(p_name) + 1) AS code FROM part),
s AS (SELECT a.state, a.code, e.code AS other, row_number() OVER (PARTITION BY a.state, a.code ORDER BY e.code) AS n FROM a JOIN e ON e.state = a.state AND e.code <> a.code AND split_part(e.code, '.', 1) = split_part(a.code, '.', 1) AND split_part(e.code, '.', 2) = split_part(a.code, '.', 2)),
l AS (SELECT state, code, string_agg(other, ',' ORDER BY other) AS similar FROM s WHERE n <= 8 GROUP BY ALL)
SELECT a.state, a.code AS requested, e.code IS NOT NULL AS found, coalesce(e.description, '') AS description, CASE WHEN e.code IS NULL THEN coalesce(l.similar, '') ELSE '' END AS similar FROM a LEFT JOIN e ON e.state = a.state AND e.code = a.code LEFT JOIN l ON l.state = a.state AND l.code = a.code""",
    "answer_schema_check": """SELECT conv_id, turn, length(coalesce(text, '')) >= 1 AND turn <= 4 AND role IS NOT NULL AS valid,
array_to_string(list_filter([CASE WHEN length(coalesce(text, '')) < 1 THEN 'answer must not be empty' END, CASE WHEN turn > 4 THEN 'confidence must be from 0 to 1' END, CASE WHEN role IS NULL THEN 'needs_human must be true or false' END], lambda x: x IS NOT NULL), '; ') AS errors FROM conversations""",
    "memory_validation": """WITH r AS (SELECT conv_id, turn, CASE WHEN NOT coalesce(length(text) > 100, false) THEN 'not confirmed' WHEN coalesce(role, '') <> 'user' THEN 'unknown role' WHEN turn NOT BETWEEN 1 AND 8 THEN 'unknown grade band' ELSE '' END AS reason FROM conversations)
SELECT conv_id, turn, reason = '' AS accepted, reason FROM r""",
    "render_markdown_docs": f"""SELECT page_id, md5('---' || chr(10) || 'doc_id: ' || coalesce(nullif(regexp_replace(regexp_replace({_PATH}, '^/+|/+$|\\.html$', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), ''), 'index') || chr(10) || 'source_url: ' || url
|| coalesce(chr(10) || 'title: ' || nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' '), ''), '') || chr(10) || '---' || chr(10) || chr(10) || {_STRIP('html')}) AS digest FROM pages""",
    "trace_checks": r"""WITH t AS (SELECT conv_id || ':' || turn AS trace_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS answer, coalesce(starts_with(text, 'The'), false) AS web, turn AS n, coalesce(length(text) > 300, false) AS long FROM conversations WHERE role = 'assistant'),
c AS (SELECT trace_id, true AS used_tool, (NOT web AND NOT long AND n <= 0) OR regexp_matches(answer, '\[[^\]]+\]\([^)]+\)') AS citation_present, web = starts_with(answer, 'The') AS fallback_banner, NOT long AS outcome_appropriate, length(answer) <= 500 AS length_budget FROM t)
SELECT *, used_tool AND citation_present AND fallback_banner AND outcome_appropriate AND length_budget AS passed FROM c""",
    "request_rate": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS requests FROM events",
    "build_chunk_index": f"""WITH {_CHUNKS}, d AS (SELECT chunk_id, {_TOKENS} AS ws FROM c), g AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d), x AS (SELECT chunk_id, len(ws) AS n, unnest(ws) AS term FROM d),
t AS (SELECT chunk_id, term, n, count(*) AS tf FROM x GROUP BY ALL)
SELECT left(term, 1) AS letter, count(DISTINCT term) AS terms, count(*) AS postings, round(max(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * t.n / mean))), 6) AS best,
CAST(0 AS BIGINT) AS stored_before, any_value(g.n) AS stored_again, any_value(g.n) AS chunks FROM t, g GROUP BY left(term, 1)""",
    "index_topk": f"WITH {_kw(10)} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM kw",
    "replace_document_chunks": """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN left(text, 300) ELSE text END AS text FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), c AS (SELECT document_id, CAST(ceil(length(text) / 500.0) AS BIGINT) AS chunks, length(text) AS characters FROM t WHERE text <> '')
SELECT document_id, chunks, CAST(chunks - 1 AS INT) AS last_index, characters, '1,2,2,3' AS versions FROM c""",
}
