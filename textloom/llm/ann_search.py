"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Every vector length is a space of its own.  Fit (on at most ``SAMPLE`` vectors or
``SAMPLE_BYTES`` a space, by id hash): coarse centroids by k-means, and codebooks of
the residuals' sub-vectors.  Cells grow with the square root of the corpus: beyond
what the sample can train, every coarse centroid is split by shared second-level
centroids of the residuals.  ``probes`` is the least number of cells that reaches
``RECALL`` on some of the sample.

Index: every vector gets its nearest cell and a code.  Cells are numbered so that
neighbours follow each other, and small ones share a bin of about ``BLOCK`` rows;
bins of more rows are cut at random into blocks of that size, and so are a bin's
queries, so no task holds a cell.  Search: in each of its cells a task adds up a
query's distance tables over the codes and reranks the best ``rerank`` by exact
cosine on the original vectors.  A code's score is off by at most the length of what
the code leaves of the vector, which the index holds; the other rows that could by
this bound be among the ``k`` best are checked exactly too, so a probed cell loses no
near vector however alike its codes are.  Over all cells of its block a task sends
about ``k`` a query.

Equal vectors beyond the ``k + 1`` of smallest id can't be among the answers
(ties go to the smaller id), so they stay out of the search.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without an id; vectors of different length are
no candidates for each other.  Rows are told apart by a number of their own, so rows
that share a ``vec_id`` all ask (each has its own ranks) and are all candidates, also
for each other, and an id may come several times in one list; fewer candidates than
``k`` give all of them; an empty table gives an empty table.  Other columns, whatever
their names, are not read.  Within ``MOST_CELLS`` centroids an index that is broadcast
takes 8 x width bytes for each: 201 MB at 768 doubles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import doubles, stacked, unit

SAMPLE, SAMPLE_BYTES, RECALL, RERANK, BLOCK = 20_000, 64 << 20, 0.998, 96, 4096
SUBSPACES, CODES, MOST_CELLS = 16, 64, 1 << 15
_FLOATS = 1 << 23  # of a table of distances held at once


def _nearest(x: np.ndarray, c: np.ndarray, m: int = 1) -> np.ndarray:
    """The ``m`` nearest rows of ``c`` for each row of ``x``, nearest first."""
    step = max(1, _FLOATS // len(c))
    if len(x) > step:
        return np.concatenate([_nearest(x[lo : lo + step], c, m) for lo in range(0, len(x), step)])
    d = (c * c).sum(1) - 2 * x @ c.T
    if m == 1:
        return d.argmin(1)[:, None]
    top = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    return np.take_along_axis(top, np.take_along_axis(d, top, 1).argsort(1), 1)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)[:, 0]
        n = np.bincount(at, minlength=len(c))
        total = np.stack([np.bincount(at, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids, at most ``MOST_CELLS``, and residual codebooks."""

    def __init__(self, x: np.ndarray, cells: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        first = min(cells, max(1, int(np.sqrt(len(x)))))
        self.coarse = _kmeans(x, first, rng)
        if cells > first:
            rest = x - self.coarse[_nearest(x, self.coarse)[:, 0]]
            second = _kmeans(rest, -(-cells // first), rng)
            self.coarse = (self.coarse[:, None] + second[None]).reshape(-1, x.shape[1])
        near = np.random.default_rng(seed + 1)
        regions = _nearest(self.coarse, _kmeans(self.coarse, max(1, int(np.sqrt(len(self.coarse)))), near))[:, 0]
        self.coarse = self.coarse[np.argsort(regions, kind="stable")]
        rest = x - self.coarse[_nearest(x, self.coarse)[:, 0]]
        m = min(SUBSPACES, x.shape[1])
        self.cuts = np.array_split(np.arange(x.shape[1]), m)
        self.books = [_kmeans(rest[:, c], CODES, rng) for c in self.cuts]
        self.probes = self._tuned(x, rng)

    def _tuned(self, x: np.ndarray, rng, k: int = 5) -> int:
        if len(x) < 2:
            return len(self.coarse)
        q = rng.choice(len(x), min(len(x), 200), replace=False)
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -2
        true = np.argsort(-s, 1)[:, :k]
        home = _nearest(x, self.coarse)[:, 0][true]
        order = _nearest(x[q], self.coarse, len(self.coarse))
        place = np.argsort(order, 1)
        need = np.sort(np.take_along_axis(place, home, 1).ravel())
        return int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and the lengths of what cell and code leave of the vectors."""
        cell = _nearest(x, self.coarse)[:, 0]
        rest = x - self.coarse[cell]
        codes = np.stack([_nearest(rest[:, c], b)[:, 0] for c, b in zip(self.cuts, self.books)], 1).astype(np.uint8)
        for j, (c, b) in enumerate(zip(self.cuts, self.books)):
            rest[:, c] -= b[codes[:, j]]
        return cell, codes, np.sqrt((rest * rest).sum(1))

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products, from tables of each query with each codeword."""
        out = np.repeat((q @ self.coarse[cell])[:, None], len(codes), 1)
        for j, (c, b) in enumerate(zip(self.cuts, self.books)):
            out += (q[:, c] @ b.T)[:, codes[:, j]]
        return out


def _indexes(base: DataFrame) -> dict[int, Index]:
    """An index for each vector length, fitted on its sample."""
    counts = {r["size"]: r["n"] for r in base.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).collect()}
    within = F.lit(False)
    for size, n in counts.items():
        most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * size)) // max(1, len(counts) // 4))
        share = min(1 << 40, -(-(most << 40) // n))
        within = within | ((F.size("vec") == size) & (F.pmod("hash", F.lit(1 << 40)) < share))
    sample = base.where(within).select("id", "vec", "hash").toPandas().sort_values(["id", "hash"])
    groups = sample.groupby(sample["vec"].map(len))["vec"]
    return {size: Index(unit(stacked(part)), int(np.clip(np.sqrt(counts[size]), 1, MOST_CELLS))) for size, part in groups}


def ann_search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, rerank: int = RERANK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows where ``queries`` holds, their nearest others."""
    rows = doubles(vectors, vec_id, vector, F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = written(rows.withColumns({"row": F.monotonically_increasing_id(), "hash": F.xxhash64("id", "vec")}), "vectors")
    first = rows.withColumn("copy", F.row_number().over(Window.partitionBy("vec").orderBy("id", "row"))).where(F.col("copy") <= k + 1)
    base = written(first.select("row", "id", "hash", "vec"), "base")
    indexes = _indexes(base)
    if not indexes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)

    def coded(batches):
        for pdf in batches:
            for size, part in pdf.groupby(pdf["vec"].map(len)):
                cell, codes, off = shared.value[size].encode(unit(stacked(part["vec"])))
                own = {c: part[c].to_numpy() for c in ("row", "id", "hash", "vec")}
                yield pd.DataFrame({"size": size, "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes], "off": off, **own})

    table = written(base.mapInPandas(coded, "size int, cell int, codes binary, off double, row long, id long, hash long, vec array<double>"), "index")
    counts = {}  # one number a cell, of at most MOST_CELLS cells a space
    for r in table.groupBy("size", "cell").count().collect():
        counts.setdefault(r["size"], np.zeros(len(indexes[r["size"]].coarse), np.int64))[r["cell"]] = r["count"]
    bins = {size: (np.cumsum(n) - n) // BLOCK for size, n in counts.items()}
    placed = vectors.sparkSession.sparkContext.broadcast(bins)

    def asked(batches):
        for pdf in batches:
            for size, part in pdf.groupby(pdf["vec"].map(len)):
                index = shared.value[size]
                cells = _nearest(unit(stacked(part["vec"])), index.coarse, index.probes)
                own = {c: part[c].to_numpy() for c in ("row", "id", "vec")}
                yield pd.DataFrame({"size": size, **own, "cells": list(cells.astype(np.int32)), "bins": [np.unique(b) for b in placed.value[size][cells]]})

    ask = written(rows.where("asks").select("row", "id", "vec").mapInPandas(asked, "size int, row long, id long, vec array<double>, cells array<int>, bins array<long>"), "queries")
    ask = ask.select("size", "row", "id", "vec", "cells", F.explode("bins").alias("bin"))
    cells = [(size, cell, int(b)) for size, of in bins.items() for cell, b in enumerate(of)]
    cells = vectors.sparkSession.createDataFrame(cells, "size int, cell int, bin long")
    table = table.join(F.broadcast(cells), ["size", "cell"])
    # One row a bin, of which there are no more than cells: how many blocks its vectors and its queries make.
    place = ["size", "bin"]
    n_rows = table.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
    n_asks = ask.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).alias("asks"))
    shape = written(n_rows.join(n_asks, place), "bins")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    table = table.join(F.broadcast(shape), place).withColumn("cut", F.pmod("hash", F.col("cuts"))).withColumn("lot", every("asks"))
    shape = shape.select(*place, F.col("cuts").alias("q_cuts"), F.col("asks").alias("q_asks"))
    ask = ask.join(F.broadcast(shape), place).withColumn("lot", F.pmod(F.xxhash64("row"), F.col("q_asks"))).withColumn("cut", every("q_cuts"))

    def search(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return _searched(shared.value[int(key[0])], q, x, k, rerank) if len(q) and len(x) else pd.DataFrame({c: [] for c in ("row", "query_id", "vec_id", "score")})

    group = [*place, "lot", "cut"]
    found = ask.groupBy(*group).cogroup(table.groupBy(*group)).applyInPandas(search, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(index: Index, q: pd.DataFrame, x: pd.DataFrame, k: int, rerank: int) -> pd.DataFrame:
    """The best rows of a block for each of its queries by exact cosine: ``rerank`` a cell by codes, and all that may be among the ``k`` best."""
    x = x.sort_values("cell", kind="stable")
    ids, at, qat = x["id"].to_numpy(), x["row"].to_numpy(), q["row"].to_numpy()
    qv, xv = unit(stacked(q["vec"])), unit(stacked(x["vec"]))
    codes = np.stack([np.frombuffer(c, np.uint8) for c in x["codes"]])
    off, best_yet = x["off"].to_numpy() + 1e-9, np.full(len(q), -np.inf)
    probed, step = np.stack(q["cells"].to_numpy()), max(1, _FLOATS // (8 * rerank * xv.shape[1]))
    cells, begin = np.unique(x["cell"].to_numpy(), return_index=True)
    out = []
    for cell, lo, hi in zip(cells, begin, [*begin[1:], len(x)]):
        mine = np.flatnonzero((probed == cell).any(1))
        kk = min(rerank, hi - lo)
        for some in (mine[i : i + step] for i in range(0, len(mine), step)):
            near = index.scores(qv[some], int(cell), codes[lo:hi])
            near[qat[some, None] == at[None, lo:hi]] = -np.inf
            top = lo + np.argpartition(-near, kk - 1, axis=1)[:, :kk]
            # Sums row by row: equal vectors get equal scores wherever they stand.
            score = (xv[top] * qv[some][:, None]).sum(2)
            score[at[top] == qat[some, None]] = -np.inf
            best = np.lexsort((ids[top], -score), axis=1)[:, : k + 8]
            out.append((np.repeat(some, best.shape[1]), np.take_along_axis(top, best, 1).ravel(), np.take_along_axis(score, best, 1).ravel()))
            if kk >= k:
                best_yet[some] = np.maximum(best_yet[some], np.take_along_axis(score, best[:, k - 1 : k], 1)[:, 0])
            if kk == hi - lo:
                continue
            least = best_yet[some, None] - 1e-9
            may = near + off[None, lo:hi] >= least
            np.put_along_axis(may, top - lo, False, 1)
            asks, hits = np.nonzero(may.any(1))[0], np.nonzero(may.any(0))[0]
            if not len(asks):
                continue
            exact = qv[some[asks]] @ xv[lo + hits].T
            a, h = np.nonzero(may[np.ix_(asks, hits)] & (exact >= least[asks]))
            a, h = some[asks[a]], lo + hits[h]
            out.append((a, h, (xv[h] * qv[a]).sum(1)))
    if not out:
        return pd.DataFrame({c: [] for c in ("row", "query_id", "vec_id", "score")})
    ask, hit, score = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((ids[hit], -score, ask))
    order = order[np.isfinite(score[order])]
    ask, hit, score = ask[order], hit[order], score[order]
    first = np.flatnonzero(np.r_[True, ask[1:] != ask[:-1]]) if len(ask) else np.zeros(0, int)
    kept = np.arange(len(ask)) - np.repeat(first, np.diff([*first, len(ask)])) < k + 8
    ask, hit = ask[kept], hit[kept]
    return pd.DataFrame({"row": qat[ask], "query_id": q["id"].to_numpy()[ask], "vec_id": ids[hit], "score": score[kept]})
