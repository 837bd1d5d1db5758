"""Periodic runs of words: seeds of guaranteed overlap, extended along diagonals.

A word is a maximal run of characters other than space and U+0009 to U+000D.  A
*run* is a stretch of consecutive words of one document whose smallest period is
``q`` (words ``q`` apart are identical), of at least ``max(least, times * q)``
words, that no neighbouring word extends.

1. *Seeds.* On the diagonal of lag ``q`` a run agrees with itself over at least
   ``max(least, times * q) - q`` words.  Lags are cut into classes; ``k``, a class's
   gram length, is the least overlap that any lag of it guarantees, and no lag of
   it exceeds ``k`` (for 24 and 3: lags 1-16 with 16-grams, 17-34 with 34-grams,
   35-70 with 70-grams and so on).  So every run holds a gram of its class at two
   places ``q`` apart.
2. *Pairs.* Only neighbouring occurrences of a gram are paired, at most one pair a
   word and class, however often a gram repeats.  No run is lost: were there an
   occurrence at ``d < q`` between the two, the stretch of ``k + d >= q + d`` words
   would have the periods ``d`` and ``q`` and so (Fine and Wilf) their greatest common
   divisor, which would be the run's too.  For the same reason ``q`` is the smallest
   period of any long enough stretch that a pair leads to.
3. *Extension.* A table holds, for each lag, how far its last stretch reaches; pairs
   before that are not extended again.  Extension compares words, not hashes.

Documents in which no gram of the first class repeats (nearly all) end after one
sort.  Every text is judged whole, in the task that reads it; nothing is shuffled.

Words are compared exactly; grams by 64-bit hashes that extension verifies (only a
false occurrence between two true ones could hide a pair: one chance in 2**64 for
two grams).

Defined cases: a null or empty text has no words and no runs, its collapsed text is
empty; repeated rows are judged each for itself; of a very long text the task
holds the words and one sort at a time (about 100 bytes a word); an empty table
gives an empty table; other columns pass through, and the operator's columns
replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, unwrapped, wrapped
from .windows import U64, Fingerprints, mix

LEAST, TIMES = 24, 3
_CHUNK = 1 << 19  # bytes of text handled at once; a longer text stands alone
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("collapsed", T.StringType())])

Run = tuple[int, int, int]  # start, length, period


def lag_classes(n: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Smallest and greatest lag, and gram length, of the classes that a document of ``n`` words can have runs in."""
    lo = 1
    while max(least, times * lo) <= n:
        k = min(max(least - q, (times - 1) * q) for q in range(lo, max(lo, least) + 1))
        yield lo, k, k
        lo = k + 1


def _stretch(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch around ``at`` whose words agree ``lag`` apart, as begin and end."""
    lo, hi, step = at, at, 64
    while hi + lag < len(ids):
        a, b = ids[hi : hi + step], ids[hi + lag : hi + lag + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            hi += int(differ[0])
            break
        hi, step = hi + len(b), step * 2
    step = 64
    while lo > 0:
        size = min(step, lo)
        differ = np.flatnonzero(ids[lo - size : lo] != ids[lo - size + lag : lo + lag])
        if len(differ):
            lo += int(differ[-1]) + 1 - size
            break
        lo, step = lo - size, step * 2
    return lo, hi + lag


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of one document, given as word ids, by start and then period."""
    names, found = Fingerprints(mix(ids.astype(U64)), 0), []
    for lo, hi, k in lag_classes(len(ids), least, times):
        grams = names.all(k)
        order = np.argsort(grams, kind="stable")
        lag = np.diff(order)
        on = np.flatnonzero((grams[order[1:]] == grams[order[:-1]]) & (lag >= lo) & (lag <= hi))
        seed, lag = order[on], lag[on]
        turn = np.lexsort((seed, lag))
        seed, lag = seed[turn], lag[turn]
        head = np.ones(len(seed), bool)  # pairs that only go on with the pair before lie on its diagonal
        head[1:] = (lag[1:] != lag[:-1]) | (seed[1:] != seed[:-1] + 1)
        reached: dict[int, int] = {}
        for at, q in zip(seed[head].tolist(), lag[head].tolist()):
            if at < reached.get(q, 0):
                continue
            begin, end = _stretch(ids, at, q)
            if end - q < at + k:  # a hash's mistake
                continue
            reached[q] = end - q
            if end - begin >= max(least, times * q):
                found.append((begin, end - begin, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Mask of the words that lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def _suspects(ids: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which documents of the batch hold a ``k``-gram twice (by hash; some may not)."""
    if len(ids) < k:
        return np.zeros(len(sizes), bool)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(doc[: len(ids) - k + 1] == doc[k - 1 :])
    grams = Fingerprints(mix(ids.astype(U64)), 0).all(k)[whole] ^ mix(doc[whole].astype(U64), 3)
    order = np.sort(grams)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    out = np.zeros(len(sizes), bool)
    if len(twice):
        out[doc[whole[np.isin(grams, twice)]]] = True
    return out


def _chunks(texts) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if held and size + len(raw) > _CHUNK:
            yield held
            held, size = [], 0
        held.append(raw.split())
        size += len(raw)
    if held:
        yield held


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` and ``n_words``, ``runs`` (``start, length, period`` by start, then period) and ``collapsed``
    (the words that no run holds after its first period, joined by one space)."""
    if times < 3 or least < 2:
        raise ValueError("runs of less than three periods have no classes of lags")
    small_batches(docs.sparkSession)
    shortest = next(lag_classes(least, least, times))[2]

    @F.pandas_udf(_FOUND)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for pieces in _chunks(texts):
                sizes = np.array([len(p) for p in pieces], np.int64)
                flat = np.empty(int(sizes.sum()), object)
                flat[:] = [w for p in pieces for w in p]
                ids, end = pd.factorize(flat)[0], np.cumsum(sizes)
                for i, suspect in enumerate(_suspects(ids, sizes, shortest)):
                    words = pieces[i]
                    runs = runs_of(ids[end[i] - sizes[i] : end[i]], least, times) if suspect else []
                    kept = [words[j] for j in np.flatnonzero(~dropped(len(words), runs))] if runs else words
                    out.append((len(words), [x for r in runs for x in r], b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=_FOUND.fieldNames())

    judge = judge.asNondeterministic()  # so a filter on the result doesn't make it twice
    found = wrapped(docs).withColumn("found", judge(F.col("row").getField(text)))
    found = found.withColumn("found", F.struct("found.n_words", _structs(F.col("found.runs")).alias("runs"), "found.collapsed"))
    return unwrapped(found, {n: F.col("found").getField(n) for n in _FOUND.fieldNames()})


def _structs(flat: Column) -> Column:
    """Triples laid end to end as an array of structs."""
    of = lambda i: F.struct(*[F.get(flat, i * 3 + j).alias(n) for j, n in enumerate(("start", "length", "period"))])
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(flat)), F.lit(1), (F.size(flat) / 3).cast("int")), of)


def strongest(runs: Column) -> Column:
    """The run of greatest length a period, null if there is none; of equal ones the first."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
