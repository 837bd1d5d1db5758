"""N-gram Jaccard join of documents: MinHash banding, verified on full n-gram sets.

N-grams are of ``n`` words (between the ASCII white space characters, unchanged);
a text of fewer words is one n-gram.

1. One pass makes each text's n-gram set (64-bit hashes), its signature and a
   128-bit name of the set.  Equal sets form a class; one member stands for it.
2. Bands and rows are chosen for the target recall at the threshold.  Classes
   that share a band hash are tied to the smallest of them, so a bucket of m
   gives m - 1 rows; candidates are the components of these ties.
3. Candidates are verified exactly, block by block: a task holds the full n-gram
   sets of two blocks (``BLOCK`` classes or ``VOLUME`` n-grams) and sends only
   link counts and a spanning forest of the links that it found.  A component
   is compared as a whole, or bucket by bucket, whichever moves fewer n-grams:
   groups of near copies cost less as a whole, long chains of chance candidates
   by buckets.  By buckets, a pair counts in the first band that it shares.  Only
   texts whose id passes a Bloom filter of the candidates are shuffled to them.

Returned per document: ``class_id``, ``n_links`` (other documents of Jaccard at
least the threshold, copies included), ``component_id`` (smallest id reachable
by links) and ``kept`` (the one row that stands for its component, also where rows
of one id and text repeat).

Defined cases: null texts and texts without words link with nothing; documents
that share an id, or have none, are told apart by their text.  Every row keeps
its own id.  A class or component is named by the smallest id in it that only one
text has, and by a hash if it has no such id; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketches
from .common import row_ids, small_batches, unwrapped, wrapped, written
from .components import components
from .repeats import Windows
from .windows import U64, mix

N, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999, 150
BLOCK, VOLUME = 512, 1 << 20
FILTER_BITS = 27  # at most, of a filter's slots: 32 MB


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """``(bands, rows)``: the most rows a band for which the bands reach the recall at the threshold."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def _sets(texts, n: int):
    """``(place, n-gram hashes)`` for each text with words."""
    windows = Windows("words", n, 1)
    for first, pieces, b in windows.chunks(texts):
        grams = b.first.all(n) if b.begin[-1] >= n else np.zeros(0, U64)
        for i, words in enumerate(pieces):
            if words:
                at, size = b.begin[i], len(words)
                yield first + i, np.unique(grams[at : at + size - n + 1] if size >= n else b.first.at(np.array([at]), size))


def _signature(grams: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = (grams >> U64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):
        np.minimum(low, (x[lo : lo + 512, None] * a + c).min(0), out=low)
    return low


def _signed(rows: DataFrame, n: int, bands: int, per_band: int) -> DataFrame:
    """Written, for every row: ``u`` (a number of its own), ``id, doc, has_doc``.

    Where it has words also ``k1, k2`` (the set's name), ``size`` (of the set) and ``bands``.
    """
    rng = np.random.default_rng(11)
    a = (rng.integers(1, 2**31, bands * per_band) * 2 + 1).astype(np.uint32)
    c = rng.integers(0, 2**32, bands * per_band).astype(np.uint32)

    def sign(batches):
        for pdf in batches:
            out = [(False, 0, 0, 0, [])] * len(pdf)
            for i, grams in _sets(pdf["text"], n):
                low = _signature(grams, a, c).reshape(bands, per_band).astype(U64)
                name = np.arange(bands, dtype=U64)
                for r in range(per_band):
                    name = mix(name ^ low[:, r])
                k1, k2 = (np.sum(mix(grams, seed)).view(np.int64) for seed in (1, 2))
                out[i] = (True, k1, k2, len(grams), name.view(np.int64))
            signs = pd.DataFrame(out, columns=["words", "k1", "k2", "size", "bands"], index=pdf.index)
            yield pd.concat([pdf[["id", "doc", "has_doc"]], signs], axis=1)

    found = rows.mapInPandas(sign, "id long, doc long, has_doc boolean, words boolean, k1 long, k2 long, size long, bands array<long>")
    return written(found.withColumn("u", F.monotonically_increasing_id()), "signatures")


def _linked(pdf: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Link matrix of the sets, and their ids."""
    sets = [np.frombuffer(s, np.int64) for s in pdf["grams"]]
    size = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    on = times[column] > 1
    row, column = row[on], np.unique(column[on], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        here = slice(*np.searchsorted(column, [lo, lo + width]))
        m = np.zeros((len(sets), width), np.float32)
        m[row[here], column[here] - lo] = 1
        both += m @ m.T
    link = both / (size[:, None] + size[None, :] - both) >= threshold
    np.fill_diagonal(link, False)
    return link, pdf["id"].to_numpy()


def _blocks(n: str, volume: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(volume) / VOLUME)).cast("long")


def _cells(grouped: DataFrame, classes: DataFrame) -> DataFrame:
    """Written: ``id, times, component, band, hash, blocks``: what is compared with what.

    ``band`` is -1 where a component is one cell; elsewhere cells are its buckets,
    and ``bands`` tells which pairs an earlier bucket holds.
    """
    members = written(grouped.join(classes.select(F.col("class_id").alias("id"), "times", "size", "bands"), "id"), "members")
    whole = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("volume")).withColumn("blocks", _blocks("n", "volume"))
    large = whole.where("blocks > 1").select("component", F.col("volume").alias("all"), F.col("blocks").alias("cuts"))
    spread = members.join(large, "component").select("component", "id", "times", "size", "bands", F.posexplode("bands").alias("band", "hash"))
    buckets = spread.groupBy("component", "band", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("volume")).where("n > 1")
    buckets = written(buckets.withColumn("blocks", _blocks("n", "volume")).select("component", "band", "hash", "volume", "blocks"), "buckets")
    moved = buckets.groupBy("component").agg(F.sum(F.col("volume") * F.col("blocks")).alias("moved"))
    split = large.join(moved, "component").where(F.col("moved") < F.col("all") * F.col("cuts")).select("component")
    one = members.join(whole.join(split, "component", "left_anti").select("component", "blocks"), "component")
    one = one.select("id", "times", "component", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("hash"), "blocks", F.array().cast("array<long>").alias("bands"))
    some = spread.join(split, "component", "left_semi").join(buckets.drop("volume"), ["component", "band", "hash"])
    return written(one.unionByName(some.select("id", "times", "component", "band", "hash", "blocks", "bands")), "cells")


def _earlier(bands: np.ndarray, band: int) -> np.ndarray:
    """Which pairs share a band before ``band``."""
    out = np.zeros((len(bands), len(bands)), bool)
    for b in range(band):
        out |= bands[:, b, None] == bands[None, :, b]
    return out


def _perhaps(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` is among ``ids``, and at most a few others (more where ids exceed 2**(``FILTER_BITS`` - 3))."""
    bits = sketches.fitting_bits(4 * ids.distinct().count(), 16, FILTER_BITS)
    plane = sketches.build(ids, lambda batches: (b["id"].to_numpy().view(U64) for b in batches), bits, "once")
    shared = sketches.broadcast(rows.sparkSession, plane)

    @F.pandas_udf("boolean")
    def held(some: pd.Series) -> pd.Series:
        return pd.Series(sketches.test(shared.value, some.to_numpy().view(U64), bits))

    return rows.where(held("id"))


def _labelled(docs: DataFrame, doc_id: str, text: str, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, Column, bool]:
    """For every row ``id`` (see ``row_ids``), ``doc, has_doc`` and the result's columns; the column that gives ``id``; and whether ``id`` may repeat."""
    small_batches(docs.sparkSession)
    key, shared = row_ids(docs, doc_id, text)
    doc = F.col("row").getField(doc_id).cast("long")
    rows = wrapped(docs).select(key.alias("id"), F.coalesce(doc, F.lit(0)).alias("doc"), doc.isNotNull().alias("has_doc"), F.col("row").getField(text).alias("text"))
    bands, per_band = banding(threshold, recall)
    signed = _signed(rows, n, bands, per_band)
    classes = written(signed.where("words").groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.count("*").alias("times"), F.first("size").alias("size"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("class_id", F.posexplode("bands").alias("band", "hash"))
    centers = buckets.groupBy("band", "hash").agg(F.min("class_id").alias("center"), F.count("*").alias("n")).where("n > 1").select("band", "hash", "center")
    ties = buckets.join(centers, ["band", "hash"]).where("class_id != center").select(F.col("center").alias("a"), F.col("class_id").alias("b"))
    grouped = components(ties)
    cells = _cells(grouped, classes)

    def grams(batches):
        for pdf in batches:
            out = [(i, g.tobytes()) for i, g in _sets(pdf["text"], n)]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[[i for i, _ in out]], "grams": [g for _, g in out]})

    full = _perhaps(rows.select("id", "text"), cells.select("id")).join(cells.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).mapInPandas(grams, "id long, grams binary")
    mine = cells.join(full, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = mine.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        link, ids = _linked(pdf, threshold)
        block, i, j = pdf["block"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        if i != j:  # pairs within one block are counted where i = j
            link &= block[:, None] != block[None, :]
        if (band := int(pdf["band"].iloc[0])) > 0:
            link &= ~_earlier(np.stack(list(pdf["bands"])), band)
        root = np.arange(len(ids))  # smallest place reachable
        while True:
            near = np.where(link, root[None, :], len(ids)).min(1)
            new = np.minimum(root, near)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"id": ids, "n": link @ pdf["times"].to_numpy(), "root": ids[root]})

    found = written(pairs.groupBy("component", "band", "hash", "i", "j").applyInPandas(verify, "id long, n long, root long").where("n > 0"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    state = classes.select("k1", "k2", F.col("class_id").alias("id"), "times").join(counts, "id", "left").join(joined, "id", "left")
    state = state.select("k1", "k2", F.col("id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    worded = signed.where("words").join(state, ["k1", "k2"])
    bare = signed.where("not words").withColumns({"class_id": F.col("id"), "n_links": F.lit(0).cast("long"), "component_id": F.col("id")})
    columns = ["u", "id", "doc", "has_doc", "words", "class_id", "n_links", "component_id"]
    every = worded.select(*columns).unionByName(bare.select(*columns))
    if not shared:
        return every.withColumn("kept", F.col("id") == F.col("component_id")), key, shared
    # Names: ids of one text before hashes.  Rows may repeat: the first by ``u`` of those that a component is named by is kept.
    every = written(every, "rows")
    clear = every.where("has_doc").groupBy("doc").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low = high").select("doc", F.lit(True).alias("has_doc"), F.lit(False).alias("hashed"))
    every = every.join(clear, ["doc", "has_doc"], "left").withColumn("hashed", F.coalesce("hashed", F.lit(True)))
    every = written(every.withColumn("name", F.when(F.col("hashed"), F.col("id")).otherwise(F.col("doc"))), "rows")
    for group in ("class_id", "component_id"):
        names = every.groupBy(group).agg(F.min(F.struct("hashed", "name", "u")).alias(f"first_{group}"))
        every = every.join(names, group)
    kept = ~F.col("words") | (F.col("u") == F.col("first_component_id.u"))
    named = {c: F.col(f"first_{c}.name") for c in ("class_id", "component_id")}
    return every.select("id", "doc", "has_doc", "words", "n_links", *[n.alias(c) for c, n in named.items()], kept.alias("kept")), key, shared


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``id`` (the row's ``doc_id``), ``class_id, n_links, component_id, kept`` for every row of ``docs``."""
    return _labelled(docs, doc_id, text, **options)[0].select(F.when(F.col("has_doc"), F.col("doc")).alias("id"), "class_id", "n_links", "component_id", "kept")


def jaccard_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` and ``class_id, n_links, component_id, kept``."""
    added = ["class_id", "n_links", "component_id"]
    found, key, shared = _labelled(docs, doc_id, text, **options)
    rows = wrapped(docs).withColumn("id", key)
    if not shared:
        return unwrapped(rows.join(found.select("id", *added, "kept"), "id", "left"), {c: F.col(c) for c in (*added, "kept")})
    # One state an id; where rows repeat the kept one, these are numbered once and the first of them stays.
    states = found.groupBy("id").agg(*[F.min(c).alias(c) for c in added], F.max("kept").alias("kept"), (F.first("words") & F.max("kept") & (F.count("*") > 1)).alias("several"))
    out = written(rows.join(states, "id", "left").withColumn("u", F.monotonically_increasing_id()), "rows")
    first = out.where("several").groupBy("id").agg(F.min("u").alias("u")).select("u", F.lit(True).alias("first"))
    several = out.where("several").join(first, "u", "left").withColumn("kept", F.coalesce("first", F.lit(False))).drop("first")
    return unwrapped(out.where("not several").unionByName(several), {c: F.col(c) for c in (*added, "kept")})
