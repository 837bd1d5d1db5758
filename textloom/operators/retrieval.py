"""Chunking, keyword and vector retrieval, fusion and context, for many queries at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import tokenize
from textloom.operators.tiles import tiled

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Numbers that a broadcast of queries is made of, at most; rows and columns of a block of scores; sides of a tile of cosines.
MOST_WEIGHTS, _ROWS, _COLUMNS, _SIDE = 1 << 21, 256, 4096, 1024
_VOCABULARY, _TERM = 1 << 18, re.compile("[a-z0-9]+")  # terms that a task counts at once, about; a term of a lower-case text


def fixed_chunk(docs: DataFrame, size: int = 500, others: tuple[str, ...] = ()) -> DataFrame:
    """``document_id, chunk_index, chunk_id, text``: every ``size`` characters; ``others`` names more columns of ``docs`` that a chunk takes along."""
    n = F.ceil(F.length("text") / size).cast("int")
    rows = docs.where("text <> ''").select("doc_id", "text", *others, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    document = F.regexp_replace(F.col("doc_id").cast("string"), "/", "_")
    return rows.select(document.alias("document_id"), "chunk_index", F.concat(document, F.lit("__chunk_"), F.col("chunk_index")).alias("chunk_id"), F.expr(f"substring(text, chunk_index * {size} + 1, {size})").alias("text"), *others)


def bm25_corpus_stats(chunks: DataFrame, key: str) -> DataFrame:
    """``term, df, tf, n_docs, mean_length`` over the whole corpus: documents and occurrences of a term, number of documents and their mean length.

    Documents are told apart by ``key``; null texts count as empty documents.
    """
    terms = chunks.select(key, tokenize(F.coalesce("text", F.lit(""))).alias("terms"))
    whole = terms.agg(F.count("*").alias("n"), F.round(F.avg(F.size("terms")), 6).alias("mean"))
    counted = terms.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    counted = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return counted.select("term", "df", "tf", whole.select("n").scalar().alias("n_docs"), whole.select("mean").scalar().alias("mean_length"))


def term_counts(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, term, tf, length`` of every document; counts are combined before the shuffle."""
    terms = chunks.select(key, tokenize(F.col(text)).alias("terms")).withColumn("length", F.size("terms"))
    return terms.select(key, "length", F.explode("terms").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def _asked(chunks: DataFrame, queries: DataFrame, query: str) -> tuple[DataFrame, Column]:
    """``query, term, weight`` (repeats times idf) of the queries' terms, and the corpus' mean length.

    One pass counts documents by term; the row of the empty term holds their number and length.
    A negative idf becomes a share of the mean idf over all terms.
    """
    held = chunks.select(tokenize(F.coalesce("text", F.lit(""))).alias("terms"))  # null texts count as empty documents
    held = held.select(F.size("terms").alias("length"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("terms"))).alias("term"))
    counted = held.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("length"))).alias("all_length"))
    whole = counted.where("term = ''")
    n, mean = whole.select("df").scalar(), whole.select(F.col("all_length") / F.col("df")).scalar()
    stats = counted.where("term <> ''").withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = stats.select(F.avg("raw") * EPSILON).scalar()
    words = _words(queries, query)
    idf = F.when(F.col("raw") < 0, floor).otherwise(F.col("raw"))
    return words.join(stats, "term").select(query, "term", (F.col("qtf") * idf).alias("weight")), mean


@dataclass(frozen=True)
class Scope:
    """Which groups each query may find: ``table`` has a row a query with arrays ``include`` and ``exclude``.

    A filled ``include`` wins; else ``exclude``, where an empty array excludes nothing; a null one,
    and a query without a row, means ``default``.  Names are trimmed and blanks dropped; an
    ``include`` of blanks alone limits nothing.  ``group`` is the column of the searched rows.
    """

    table: DataFrame
    group: str
    default: tuple[str, ...] = ()


_LIMITS = ("only", "never")


def resolved_scope(queries: DataFrame, query: str, scope: Scope | None) -> DataFrame:
    """``queries`` with ``only`` and ``never``: arrays, or null where they limit nothing."""
    none = F.lit(None).cast("array<string>")
    if scope is None:
        return queries.withColumns({"only": none, "never": none})
    names = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    filled = lambda c: F.when(F.size(c) > 0, c)
    rows = scope.table.select(F.col(query).alias("scope_of"), F.col("include").cast("array<string>").alias("include"), F.col("exclude").cast("array<string>").alias("exclude"))
    rows = queries.join(rows.dropDuplicates(["scope_of"]), F.col(query) == F.col("scope_of"), "left")
    wins = F.coalesce(F.size("include") > 0, F.lit(False))
    never = F.coalesce(F.col("exclude"), F.array(*map(F.lit, scope.default)).cast("array<string>"))
    rows = rows.withColumns({"only": F.when(wins, filled(names(F.col("include")))), "never": F.when(~wins, filled(names(never)))})
    return rows.drop("scope_of", "include", "exclude")


def _allowed(groups, only: list, never: list) -> np.ndarray:
    """Rows x queries: may the query find the row?  A row without a group is in no list."""
    code, names = pd.factorize(np.asarray(groups, dtype=object))
    out, seen = np.ones((len(code), len(only)), bool), {}
    for j, (inside, outside) in enumerate(zip(only, never)):
        if inside is None and outside is None:
            continue
        at = (None if inside is None else tuple(inside), None if outside is None else tuple(outside))
        if at not in seen:
            known = np.isin(names, np.array(at[0] if at[1] is None else at[1], dtype=object)) if len(names) else np.zeros(0, bool)
            known = np.append(known, False)[code]  # a null group has code -1
            seen[at] = known if at[1] is None else ~known
        out[:, j] = seen[at]
    return out


def _in_scope(group: str) -> Column:
    """The same over columns ``only`` and ``never``."""
    held = lambda c: F.coalesce(F.array_contains(c, F.col(group)), F.lit(False))
    return (F.col("only").isNull() | held("only")) & (F.col("never").isNull() | ~held("never"))


def bm25_topk(chunks: DataFrame, key: str, queries: DataFrame, query: str, k: int = 10, most: int = MOST_WEIGHTS, scope: Scope | None = None) -> DataFrame:
    """``query, key, score, rank``: Okapi scores above zero; repeated query terms count again.

    Up to ``most`` weights of query terms and names of scopes go to the tasks, by term: documents
    are scored sparsely, ``_ROWS`` of them and ``_COLUMNS`` queries at a time, and a task sends its ``k``
    best a query in scope, so no posting is shuffled.  More of them are joined with the documents' terms by
    shuffles.  Both give the same rows.  Statistics are of all documents, whatever the scopes.
    """
    limits = resolved_scope(queries.select(query).distinct(), query, scope)
    if scope is not None:
        names = limits.agg(F.sum(F.coalesce(F.greatest(F.size("only"), F.size("never")), F.lit(0)))).first()[0] or 0
        limits = limits.where("only is not null or never is not null")
    words = _words(queries, query)
    weights = words.limit(most + 1).toPandas() if scope is None or names <= most else None
    if weights is None or len(weights) > most:
        asked, mean = _asked(chunks, queries, query)
        length = F.col("tf") + K1 * (1 - B + B * F.col("length") / mean)
        scored = asked.join(term_counts(chunks, key), "term").groupBy(query, key).agg(F.sum(F.col("weight") * F.col("tf") * (K1 + 1) / length).alias("score")).where("score > 0")
        if scope is not None:
            scored = scored.join(chunks.select(key, F.col(scope.group).alias("its_group")), key).join(limits, query, "left").where(_in_scope("its_group")).select(query, key, "score")
        return _ranked(scored, query, key, k)
    idf, average = _idf(chunks, words)
    weights["weight"] = weights["qtf"] * weights["term"].map(idf)
    weights = weights[weights["weight"].notna()]
    asks, row = np.unique(weights[query].to_numpy(), return_inverse=True)
    terms, column = np.unique(weights["term"].to_numpy(dtype=object), return_inverse=True)
    order = np.lexsort((column, row // _COLUMNS))
    held = _Weights({t: i for i, t in enumerate(terms)}, asks, row[order], column[order], weights["weight"].to_numpy(dtype=float)[order])
    if scope is not None:
        own = limits.toPandas().set_index(query)
        held.only, held.never = ([own[c].get(a) for a in asks] for c in _LIMITS)
    place = chunks.sparkSession.sparkContext.broadcast(held)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if len(asks):
            yield from place.value.best((pdf.iloc[lo : lo + _ROWS] for pdf in batches for lo in range(0, len(pdf), _ROWS)), average, k)

    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((query, queries), (key, chunks))}
    group = F.lit(None).cast("string") if scope is None else F.col(scope.group).cast("string")
    rows = chunks.select(F.col(key).alias("key"), group.alias("group"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    found = rows.mapInPandas(score, f"query {kinds[query]}, key {kinds[key]}, score double")
    return _ranked(found.select(F.col("query").alias(query), F.col("key").alias(key), "score"), query, key, k)


def _words(queries: DataFrame, query: str) -> DataFrame:
    """``query, term, qtf``."""
    return queries.select(query, F.explode(tokenize(F.col("text"))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))


def _idf(chunks: DataFrame, words: DataFrame) -> tuple[dict[str, float], float]:
    """The asked terms' idf, as ``_asked`` gives it, and the mean length of a document (1 if none has a term).

    Tasks count their documents by term, and the counts of ``_VOCABULARY`` terms at a time are
    added up.  Of terms that nobody asks for only the histogram of their counts is fetched: the
    number of different counts is below the square root of twice the postings.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, length = Counter(), 0, 0
        for pdf in batches:
            for text in pdf["text"]:
                terms = _TERM.findall(text)
                n, length = n + 1, length + len(terms)
                df.update(set(terms))
                if len(df) > _VOCABULARY:
                    yield pd.DataFrame({"term": list(df), "df": list(df.values()), "length": 0})
                    df.clear()
        yield pd.DataFrame({"term": [*df, ""], "df": [*df.values(), n], "length": [0] * len(df) + [length]})

    rows = chunks.select(F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInPandas(counted, "term string, df long, length long")
    counts = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
    asked = F.broadcast(words.select("term").distinct().withColumn("asked", F.lit(True)))
    named = F.when(F.col("asked") | (F.col("term") == ""), F.col("term")).alias("term")
    found = counts.join(asked, "term", "left").groupBy(named, "df").agg(F.count("*").alias("terms"), F.sum("length").alias("length")).toPandas()
    whole = found["term"] == ""
    n, length = int(found.loc[whole, "df"].sum()), int(found.loc[whole, "length"].sum())
    found = found[~whole]
    raw = np.log(n - found["df"] + 0.5) - np.log(found["df"] + 0.5)
    floor = EPSILON * float((raw * found["terms"]).sum() / found["terms"].sum()) if len(found) else 0.0
    mine = found["term"].notna()
    return dict(zip(found.loc[mine, "term"], raw[mine].where(raw[mine] >= 0, floor))), length / n if length else 1.0


class _Weights:
    """Sparse weights of query terms, in lots of ``_COLUMNS`` queries, by term within a lot."""

    def __init__(self, known: dict, asks: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.known, self.asks, self.only, self.never = known, asks, None, None
        self.row, self.term, self.weight = row, term, weight
        self.cuts = np.searchsorted(row // _COLUMNS, np.arange(-(-len(asks) // _COLUMNS) + 1))

    def best(self, parts: Iterable[pd.DataFrame], average: float, k: int) -> Iterator[pd.DataFrame]:
        """The ``k`` best of all parts (``key, group, text``: lower case) for every query."""
        held = [_Best(self.asks[lo : lo + _COLUMNS], k, 0.0) for lo in range(0, len(self.asks), _COLUMNS)]
        for part in parts:
            words = [_TERM.findall(t) for t in part["text"]]
            counts = [Counter(filter(self.known.__contains__, w)) for w in words]
            doc = np.repeat(np.arange(len(part)), [len(c) for c in counts])
            term = np.array([self.known[t] for c in counts for t in c], np.int64)
            tf = np.array([n for c in counts for n in c.values()], float)
            size = np.array([len(w) for w in words], float)
            tf = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average)[doc])
            for lot, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:])):
                n = len(held[lot].asks)
                begin, end = (lo + np.searchsorted(self.term[lo:hi], term, side) for side in ("left", "right"))
                count = end - begin
                at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
                cell = np.repeat(doc, count) * n + self.row[at] - lot * _COLUMNS
                scores = np.bincount(cell, np.repeat(tf, count) * self.weight[at], len(part) * n).reshape(len(part), -1)
                if self.only is not None:
                    mine = slice(lot * _COLUMNS, (lot + 1) * _COLUMNS)
                    scores[~_allowed(part["group"], self.only[mine], self.never[mine])] = 0.0
                held[lot].add(scores, part["key"].to_numpy())
        for b in held:
            yield b.rows()


def _ranked(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine(x: Column, y: Column) -> Column:
    """Cosine in double precision; null where a norm is zero."""
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scope: Column | Scope | None = None, most: int = MOST_WEIGHTS) -> DataFrame:
    """``query_id, vec_id, label, score, rank``: exact cosine; the scope filters before the cut.

    ``scope`` is a condition for all queries, or a :class:`Scope` (its table by ``query_id``).  Queries
    (``vec_id, embedding``) of at most ``most`` numbers go to the tasks, which compare them with
    their vectors tile by tile and send ``k`` rows a query; more of them meet the vectors in tiles
    of blocks that send ``k`` a query each.  A query isn't its own answer; vectors that are
    null, of norm zero or of another length than the query's take no part.
    """
    each = scope if isinstance(scope, Scope) else None
    base = vectors if scope is None or each else vectors.where(scope)
    asks = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec")).where("vec is not null")
    asks = resolved_scope(asks, "query_id", each).select(F.col("query_id").alias("id"), "vec", *_LIMITS)
    group = F.col(each.group).cast("string") if each else F.lit(None).cast("string")
    rows = base.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), group.alias("group")).where("vec is not null")
    size = F.size("vec") + F.coalesce(F.greatest(F.size("only"), F.size("never"), F.lit(0)), F.lit(0))
    counted = asks.agg(F.count("*").alias("n"), F.sum(size).alias("numbers")).first()
    schema = "query long, key long, score double"
    if (counted["numbers"] or 0) > most:
        found = tiled(asks, rows, lambda q, v: pd.concat([_NOTHING, *_nearest(_by_length(q, _LIMITS), [v], k)]), schema, counted["n"], rows.count())
    else:
        held = vectors.sparkSession.sparkContext.broadcast(_by_length(asks.toPandas(), _LIMITS))

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from _nearest(held.value, batches, k)

        found = rows.mapInPandas(nearest, schema)
    ranked = _ranked(found.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), "score"), "query_id", "vec_id", k)
    # The labels meet the few rows that are left.
    return ranked.join(base.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", "score", "rank")


_NOTHING = pd.DataFrame({"query": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "score": np.zeros(0)})


def _nearest(asked: dict, batches: Iterable[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The best of all rows for queries by length; scores are held for a tile of ``_SIDE`` rows and queries at a time."""
    best = {n: [_Best(mine[lo : lo + _SIDE], k, -1.5) for lo in range(0, len(mine), _SIDE)] for n, (mine, _, _) in asked.items()}
    for pdf in batches:
        for n, (ids, x, (groups,)) in _by_length(pdf, ("group",)).items():
            if n not in asked:
                continue
            _, q, (only, never) = asked[n]
            for row in range(0, len(ids), _SIDE):
                rows = slice(row, row + _SIDE)
                for column, held in enumerate(best[n]):
                    mine = slice(column * _SIDE, (column + 1) * _SIDE)
                    s = x[rows] @ q[mine].T
                    s[(ids[rows, None] == held.asks[None, :]) | ~_allowed(groups[rows], only[mine], never[mine])] = -2
                    held.add(s, ids[rows])
    for held in (b for of in best.values() for b in of):
        yield held.rows()


class _Best:
    """The ``k`` best rows of each of some queries: scores to nine digits and above ``above``, ties to the smaller key."""

    def __init__(self, asks: np.ndarray, k: int, above: float):
        self.asks, self.k, self.above, self.least = asks, k, above, np.full(len(asks), -np.inf)
        self.held, self.waiting = [], 0

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """Rows x queries."""
        least = self.least
        if len(keys) > self.k and not np.isfinite(least).all():
            least = np.maximum(least, np.partition(scores, len(keys) - self.k, axis=0)[len(keys) - self.k] - 1e-9)
        row, column = np.nonzero((scores >= least) & (scores > self.above))
        if len(row):
            self.held.append((column, keys[row], scores[row, column]))
            self.waiting += len(row)
            if self.waiting > 2 * self.k * len(self.asks):
                self._merge()

    def _merge(self) -> None:
        column, key, score = (np.concatenate(c) for c in zip(*self.held))
        # Nulls come first, as in Spark's order.
        by = np.where(pd.isna(key), -np.inf if key.dtype.kind == "f" else "", key) if key.dtype.kind in "Of" else key
        order = np.lexsort((by, -np.rint(score * 1e9), column))
        column, key, score = column[order], key[order], score[order]
        kept = np.arange(len(column)) - np.searchsorted(column, column) < self.k
        column, key, score = column[kept], key[kept], score[kept]
        self.held, self.waiting = [(column, key, score)], 0
        n = np.bincount(column, minlength=len(self.asks))
        self.least = np.where(n == self.k, score[np.maximum(np.cumsum(n) - 1, 0)] - 1e-9, -np.inf)

    def rows(self) -> pd.DataFrame:
        if not self.held:  # an empty list would be a column of floats, which Arrow can't make strings of
            return pd.DataFrame({"query": self.asks[:0], "key": np.zeros(0, object), "score": np.zeros(0)})
        self._merge()
        column, key, score = self.held[0]
        return pd.DataFrame({"query": self.asks[column], "key": key, "score": score})


def _by_length(pdf: pd.DataFrame, others: tuple[str, ...]) -> dict[int, tuple[np.ndarray, np.ndarray, list]]:
    """Ids, unit vectors and other columns by vector length; vectors of norm zero, or without a norm, are left out."""
    out = {}
    for n, part in pdf.groupby(pdf["vec"].map(len)):
        x = np.stack([np.asarray(v, dtype=float) for v in part["vec"]])
        norm = np.sqrt((x * x).sum(1))
        good = (norm > 0) & np.isfinite(norm)
        if good.any():
            out[n] = part["id"].to_numpy()[good], x[good] / norm[good, None], [[v for v, g in zip(part[c], good) if g] for c in others]
    return out


def rrf_fuse(dense: DataFrame, keyword: DataFrame, query: str, key: str, rrf_k: int = RRF_K) -> DataFrame:
    """``query, key, score, rank`` by reciprocal ranks; ties keep the dense order first."""
    none = F.lit(None).cast("int")
    both = dense.select(query, key, F.col("rank").alias("dense_rank"), none.alias("keyword_rank"))
    both = both.unionByName(keyword.select(query, key, none.alias("dense_rank"), F.col("rank").alias("keyword_rank")))
    one = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = both.groupBy(query, key).agg(F.min("dense_rank").alias("dense_rank"), F.min("keyword_rank").alias("keyword_rank"))
    fused = fused.withColumn("score", one("dense_rank") + one("keyword_rank"))
    order = Window.partitionBy(query).orderBy(F.desc(F.round("score", 12)), F.col("dense_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(), key)
    return fused.select(query, key, "score", F.row_number().over(order).alias("rank"))


def diverse_filter(ranked: DataFrame, query: str, group: str, per_group: int = 2, k: int = 5) -> DataFrame:
    """At most ``per_group`` of a group in rank order, then the first ``k``."""
    inner = Window.partitionBy(query, group).orderBy("rank")
    outer = Window.partitionBy(query).orderBy("rank")
    few = ranked.withColumn("in_group", F.row_number().over(inner)).where(F.col("in_group") <= per_group).drop("in_group")
    return few.withColumn("place", F.row_number().over(outer)).where(F.col("place") <= k).drop("rank").withColumnRenamed("place", "rank")


def relevance_gap_filter(ranked: DataFrame, query: str, gap: float = 1.0, least: int = 1) -> DataFrame:
    """Rows within ``gap`` of the query's best score, at least ``least``."""
    best = F.max("score").over(Window.partitionBy(query))
    return ranked.withColumn("best", best).where((F.col("score") >= F.col("best") - gap) | (F.col("rank") <= least)).drop("best")


def hydrate_hits(hits: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Hits with stored text and title; where none is stored, or only blanks, the hit's own fields stay.

    Hits are few (after a top-k), so the stored side meets them by its key.  ``hits`` may hold
    ``text, title``; ``chunks`` has ``key, text, title``.
    """
    own = {c: F.col(f"h.{c}") if c in hits.columns else F.lit(None).cast("string") for c in ("text", "title")}
    stored = F.coalesce(F.trim("c.text") != "", F.lit(False))
    both = hits.alias("h").join(chunks.select(key, "text", "title").alias("c"), F.col(f"h.{key}") == F.col(f"c.{key}"), "left")
    kept = [F.col(f"h.{c}") for c in hits.columns if c not in own]
    title = F.coalesce(F.expr("nullif(trim(c.title), '')"), own["title"])
    return both.select(*kept, F.when(stored, F.col("c.text")).otherwise(own["text"]).alias("text"), F.when(stored, title).otherwise(own["title"]).alias("title"))


def lookup_chunks(asked: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the asked keys (each once), from ``first``, else from ``second``; unknown keys are absent."""
    both = first.withColumn("source_no", F.lit(0)).unionByName(second.withColumn("source_no", F.lit(1)))
    found = both.join(asked.select(key).distinct(), key, "left_semi")
    order = Window.partitionBy(key).orderBy("source_no")
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "source_no")


def neighbor_join(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """``document_id, chunk_index, neighbor_index, neighbor_text``; an equi-join on document and index.

    A radius of 0 or less gives no neighbours; ``distance`` orders them, lower index first if equal.
    """
    around = [i for i in range(-radius, radius + 1) if i] if radius > 0 else []
    near = hits.select("document_id", "chunk_index", F.explode(F.array(*map(F.lit, around)).cast("array<int>")).alias("step"))
    near = near.select("document_id", "chunk_index", (F.col("chunk_index") + F.col("step")).alias("neighbor_index")).where("neighbor_index >= 0")
    other = chunks.select("document_id", F.col("chunk_index").alias("neighbor_index"), F.col("text").alias("neighbor_text")).where("trim(neighbor_text) <> ''")
    return near.join(other, ["document_id", "neighbor_index"])


def merge_hits(hits: DataFrame, chunks: DataFrame, radius: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """One block a hit: itself and its neighbours in index order, equal texts once.

    Returns ``document_id, chunk_index, first_index`` (the block's smallest), ``chunk_ids`` (in index
    order, repeats included), ``block``; ``by`` names more columns of a hit (its query, its rank).
    Chunks of a document are numbered once, so one hit's parts are bounded by the radius.
    """
    around = F.sequence(F.col("chunk_index") - max(radius, 0), F.col("chunk_index") + max(radius, 0))
    near = hits.select(*by, "document_id", "chunk_index", F.explode(around).alias("at"))
    chunk_id = F.col("chunk_id") if "chunk_id" in chunks.columns else F.concat("document_id", F.lit("__chunk_"), F.col("chunk_index").cast("string"))
    stored = chunks.select("document_id", F.col("chunk_index").alias("at"), chunk_id.alias("chunk_id"), F.trim("text").alias("t"))
    parts = near.join(stored, ["document_id", "at"]).where("t <> '' or at = chunk_index")
    rows = parts.groupBy(*by, "document_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct("at", "chunk_id", "t"))).alias("parts"))
    texts = F.array_distinct(F.filter("parts.t", lambda t: t != ""))
    first, block = F.array_min("parts.at").cast("int"), F.array_join(texts, "\n\n")
    return rows.select(*by, "document_id", "chunk_index", first.alias("first_index"), F.col("parts.chunk_id").alias("chunk_ids"), block.alias("block"))


def merge_neighbors(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """``document_id, chunk_index, block, n_parts`` of every hit's merged block."""
    return merge_hits(hits, chunks, radius).select("document_id", "chunk_index", "block", F.size("chunk_ids").alias("n_parts"))


def expand_neighbors(hits: DataFrame, chunks: DataFrame, radius: int = 1, query: str = "query_id") -> DataFrame:
    """``query, document_id, chunk_index, place``: every hit, then its neighbours, each chunk once.

    Neighbours come by distance, the lower index first; a chunk keeps its first place.
    """
    near = neighbor_join(hits, chunks, radius).select("document_id", "chunk_index", "neighbor_index").distinct()
    near = hits.select(query, "rank", "document_id", "chunk_index").join(near, ["document_id", "chunk_index"])
    step = F.abs(F.col("neighbor_index") - F.col("chunk_index")) * 2 + (F.col("neighbor_index") > F.col("chunk_index")).cast("int")
    every = near.select(query, "rank", "document_id", F.col("neighbor_index").alias("chunk_index"), step.alias("step"))
    every = every.unionByName(hits.select(query, "rank", "document_id", "chunk_index", F.lit(0).alias("step")))
    first = every.groupBy(query, "document_id", "chunk_index").agg(F.min(F.struct("rank", "step")).alias("at"))
    order = Window.partitionBy(query).orderBy("at", "document_id", "chunk_index")
    return first.select(query, "document_id", "chunk_index", F.row_number().over(order).alias("place"))


def context_cap(blocks: DataFrame, n: int, query: str = "query_id", place: str = "rank") -> DataFrame:
    """The first ``n`` blocks of a query; all of them for ``n`` of 0 or less."""
    if n <= 0:
        return blocks
    order = Window.partitionBy(query).orderBy(place)
    return blocks.withColumn("kept_place", F.row_number().over(order)).where(F.col("kept_place") <= n).drop("kept_place")


def context_chunk_ids(blocks: DataFrame, query: str = "query_id", place: str = "rank") -> DataFrame:
    """``query, chunk_ids``: the merged ids of a query's blocks, or their own id, in order, repeats kept."""
    own = F.when(F.size("chunk_ids") > 0, F.col("chunk_ids")).otherwise(F.array("chunk_id"))
    rows = blocks.groupBy(query).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("place"), own.alias("ids")))).alias("parts"))
    return rows.select(query, F.flatten("parts.ids").alias("chunk_ids"))


def format_context(blocks: DataFrame, query: str = "query_id", place: str = "rank") -> DataFrame:
    """``query, context``: numbered blocks, each headed by title, url, document and chunk ids.

    Columns read: ``title, source_url, document_id, chunk_id, chunk_ids, text``.
    """
    number = F.row_number().over(Window.partitionBy(query).orderBy(place))
    ids = F.when(F.size("chunk_ids") > 0, F.array_join("chunk_ids", ", ")).otherwise(F.col("chunk_id"))
    url = F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit(" | url: "), F.col("source_url"))).otherwise("")
    head = F.concat(F.lit("["), F.col("n"), F.lit("] title: "), F.coalesce("title", F.lit("")), url, F.lit(" | document_id: "), F.col("document_id"), F.lit(" | chunk_id: "), ids)
    rows = blocks.withColumn("n", number).select(query, "n", F.concat(head, F.lit("\n"), F.col("text")).alias("part"))
    return rows.groupBy(query).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n").alias("context"))


def source_label(url: Column, title: Column, source: Column, document: Column) -> Column:
    """The first of url, title, source and document id that isn't blank, else ``unknown``."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (url, title, source, document)], F.lit("unknown"))


def hybrid_retrieve(dense: DataFrame, keyword: DataFrame, groups: DataFrame, query: str, key: str, group: str, per_group: int = 2, k: int = 5) -> DataFrame:
    """Both rankings fused by reciprocal ranks, then at most ``per_group`` of a group and ``k`` in all."""
    fused = rrf_fuse(dense, keyword, query, key)
    return diverse_filter(fused.join(groups.select(key, group), key), query, group, per_group, k)


def debug_rankings(dense: DataFrame, keyword: DataFrame, query: str, key: str, k: int = 10) -> DataFrame:
    """``query, list, rank, key, score`` of the dense, the keyword and the fused ranking, first ``k`` of each."""
    lists = {"dense": dense, "keyword": keyword, "fused": rrf_fuse(dense, keyword, query, key)}
    out = None
    for name, rows in lists.items():
        rows = rows.where(F.col("rank") <= k).select(query, F.lit(name).alias("list"), "rank", key, "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def golden_eval(hits: DataFrame, expected: DataFrame, query: str, key: str) -> DataFrame:
    """``query, hit, retrieved`` (ids in rank order, each once) for every question of ``expected`` (``query, expected``: ids).

    Ids are compared trimmed and in lower case; questions without hits or expected ids have no hit.
    """
    got = hits.groupBy(query).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", key))), lambda x: x[key].cast("string")).alias("ids"))
    plain = lambda c: F.transform(c, lambda x: F.lower(F.trim(x.cast("string"))))
    rows = expected.join(got, query, "left")
    hit = F.coalesce(F.arrays_overlap(plain(F.col("ids")), plain(F.col("expected"))), F.lit(False))
    return rows.select(query, hit.alias("hit"), F.array_distinct(F.coalesce("ids", F.array().cast("array<string>"))).alias("retrieved"))


def _first_held(words: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """The name of the first of ``words`` (word and name, in order) that a text holds."""
    grams, lengths = {}, sorted({len(w[:3]) for w, _ in words})
    for place, (word, _) in enumerate(words):
        grams.setdefault(word[:3], []).append(place)

    @F.pandas_udf("string")
    def matched(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            held = {text[i : i + n] for n in lengths for i in range(len(text) - n + 1)} & grams.keys()
            first = next((p for p in sorted(p for g in held for p in grams[g]) if words[p][0] in text), None)
            out.append(None if first is None else words[first][1])
        return pd.Series(out, dtype=object)

    return matched


def first_keyword_match(texts: DataFrame, keywords: DataFrame, key: tuple[str, ...], text: str = "text", default: str = "none", most: int = MOST_WEIGHTS) -> DataFrame:
    """``key`` and ``match``: the name of the keyword of smallest ``priority`` that the text holds, else ``default``.

    ``keywords`` has ``keyword, name, priority``, a dimension of any size; both sides are compared in
    lower case, blank and null keywords match nothing, equal priorities go by name.  Keywords of at most
    ``most`` letters in all go to the tasks, so no text is moved; with more of them a text meets
    only the keywords whose first letters (three, or all of a shorter one) it holds: an equi-join
    on grams; what meets is then compared whole.  Equal rows are compared once.
    """
    known = keywords.select(F.lower(F.trim("keyword")).alias("word"), "name", "priority").where("word <> ''").withColumn("gram", F.substring("word", 1, 3))
    if (known.agg(F.sum(F.length("word"))).first()[0] or 0) <= most:
        matched = _first_held([(r["word"], r["name"]) for r in known.select("word", "name").orderBy("priority", "name").collect()])
        return texts.select(*key, F.coalesce(matched(F.lower(F.coalesce(F.col(text), F.lit("")))), F.lit(default)).alias("match"))
    lengths = sorted(r[0] for r in known.select(F.length("gram")).distinct().collect())  # three rows at most
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = texts.select(*key, low.alias("low")).withColumns({"h1": F.xxhash64(*key, "low"), "h2": F.xxhash64(F.lit("again"), *key, "low")})
    lettered = rows.select("h1", "h2", F.split("low", "").alias("letters"))

    def grams(n):
        out = F.col("letters")
        for k in range(1, n):
            out = F.zip_with(out, F.slice("letters", k + 1, 1 << 30), lambda a, b: F.concat(a, b))
        return out

    every = F.array_distinct(F.concat(F.array().cast("array<string>"), *map(grams, lengths)))
    met = lettered.select("h1", "h2", F.explode(every).alias("gram")).join(known, "gram")
    met = met.select("h1", "h2", "word", "name", "priority").distinct()
    held = met.join(rows.select("h1", "h2", "low").distinct(), ["h1", "h2"]).where(F.col("low").contains(F.col("word")))
    first = held.groupBy("h1", "h2").agg(F.min(F.struct("priority", "name"))["name"].alias("match"))
    return rows.join(first, ["h1", "h2"], "left").select(*key, F.coalesce("match", F.lit(default)).alias("match"))


def retrieve_context(chunks: DataFrame, dense: DataFrame, keyword: DataFrame, query: str, per_document: int = 2, k: int = 5, gap: float | None = None, radius: int = 1, lite: bool = False) -> DataFrame:
    """``query, context``: both rankings fused, ``per_document`` chunks of a document, ``k`` in all; then what is near the best, with its neighbours.

    ``chunks`` has ``document_id, chunk_index, chunk_id, text, title, source_url``; ``dense`` and ``keyword``
    rank ``chunk_id``, with each query's scope applied before their cut.  ``lite`` leaves out the gap
    and the neighbours.  Chunks keep their whole text.
    """
    fused = rrf_fuse(dense, keyword, query, "chunk_id").join(chunks.select("chunk_id", "document_id", "chunk_index"), "chunk_id")
    hits = diverse_filter(fused, query, "document_id", per_document, k)
    if gap is not None and not lite:
        hits = relevance_gap_filter(hits, query, gap, 1)
    blocks = merge_hits(hits, chunks, 0 if lite else radius, (query, "rank"))
    heads = chunks.select("document_id", "chunk_index", "chunk_id", "title", "source_url")
    return format_context(blocks.join(heads, ["document_id", "chunk_index"]).withColumnRenamed("block", "text"), query)
