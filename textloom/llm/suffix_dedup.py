"""Exact dedup of byte strings: suffixes sorted a bucket at a time over a difference cover.

Every byte covered by a ``length``-byte string that also starts earlier (smaller
``doc_id``, or the same document at an earlier start) is removed.  A text is its
UTF-8 bytes; strings are judged on the input and never cross documents.

1. *Cover.* ``COVERS`` holds residues modulo ``v`` in which every difference
   occurs.  So any two places have an offset below ``v`` at which both meet the
   cover; two equal strings meet there in equal samples (``length - v + 1`` bytes).
2. *Ranks.* The samples are sorted by name, some buckets a pass; the rank of a
   sample is the first place that holds its name.  A sample that no other place
   shares has none.
3. *Long ties.* Samples of a document that rank at one distance before it, and
   overlap, make a stretch that is the earlier text's too; all strings in it start
   there.  They are settled by the ranks alone, however many copies there are.  As
   ``v`` is at most half of ``length``, the offsets at which two copies meet the cover
   (at least one in ``v``) make such a stretch whatever their distance is.
4. *Buckets.* Of the other suffixes only those tie with anything that have a ranked
   sample at an offset below ``v``.  They are sorted by the 128-bit names of their
   first ``length`` bytes, some buckets a pass; of equal ones the first place stays.

A pass takes as many buckets as make a shuffle of about the input's size, and its
shuffle files go when it ends.  A task holds one bucket of about ``bucket``
suffixes: a name costs a bucket one row a block of texts, whatever repeats in it.

The order of the suffixes is that of their names, not of their bytes: equality is
all that is asked.

Defined cases: null text counts as empty; documents shorter than ``length``
lose nothing; equal rows that share a ``doc_id`` are one document (each keeps
what it would keep alone); an empty table gives an empty table; other columns
pass through, and the operator's columns replace columns of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import coded, discard, small_batches, unwrapped, written
from .windows import U64, Fingerprints, mix

LENGTH = 100
BLOCK, BUCKET = 1 << 19, 1 << 19  # bytes of text handled at once; suffixes in a bucket
#: Perfect difference sets, by modulus.
COVERS = {
    1: [0],
    3: [0, 1],
    7: [0, 1, 3],
    13: [0, 1, 3, 9],
    21: [0, 1, 4, 14, 16],
    31: [0, 1, 3, 8, 12, 18],
    57: [0, 1, 3, 13, 32, 36, 43, 52],
}

_BYTES = mix(np.arange(256, dtype=U64), 11)
_SECOND = mix(_BYTES, 7)
_BLOCK = "codes binary, sizes binary, body binary"
_RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def _spans(mask: np.ndarray) -> bytes:
    """Runs of a mask, as begins and ends."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edges.astype(np.int64).tobytes()


def _filled(spans: bytes, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int8)
    edges = np.frombuffer(spans, np.int64)
    edge[edges[::2]], edge[edges[1::2]] = 1, -1
    return np.cumsum(edge[:n], dtype=np.int8) > 0


def _classes(names: np.ndarray, places: np.ndarray, second: np.ndarray | None = None):
    """Of the distinct names, sorted: themselves, each member's class, the smallest places, and which have several members."""
    order = np.argsort(names)
    cut = np.append(True, names[order[1:]] != names[order[:-1]])[: len(names)]
    if second is not None:
        if (~cut[1:] & (second[order[1:]] != second[order[:-1]])).any():
            order = np.lexsort((second, names))
        cut[1:] = (names[order[1:]] != names[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    at = np.flatnonzero(cut)
    group = np.empty(len(names), np.int64)
    group[order] = np.cumsum(cut) - 1
    low = np.minimum.reduceat(places[order], at) if len(at) else places[:0]
    return order[at], group, low, np.diff(np.append(at, len(names))) > 1


class Cover:
    """The cover for a string length, and how places are numbered: ``code << shift | start``."""

    def __init__(self, length: int, shift: int):
        self.length, self.shift = length, shift
        self.v = max(v for v in COVERS if v == 1 or v <= 0.5 * length)
        self.sample = length - self.v + 1


class Texts:
    """A block of whole texts laid end to end, in the order of their codes; none is shorter than a string."""

    def __init__(self, row, cover: Cover):
        self.cover, self.sizes = cover, np.frombuffer(row.sizes, np.int64)
        self.codes, self.begin = np.frombuffer(row.codes, np.int64), np.concatenate([[0], np.cumsum(self.sizes)])
        self.raw = np.frombuffer(zlib.decompress(row.body), np.uint8)
        self.names = Fingerprints(_BYTES[self.raw], 0)
        self.base = (self.codes << cover.shift) - self.begin[:-1]  # a place less its number in the block

    def places(self, at: np.ndarray) -> np.ndarray:
        """Places of ascending numbers in the block."""
        return at + np.repeat(self.base, np.diff(np.searchsorted(at, self.begin)))

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the cover samples in the block, and their names."""
        v, whole = self.cover.v, self.sizes - self.cover.sample + 1
        cycles = -(-whole // v)
        first = np.cumsum(cycles) - cycles
        at = np.repeat(self.begin[:-1] - v * first, cycles) + v * np.arange(cycles.sum())
        at, end = at[:, None] + np.asarray(COVERS[v]), np.repeat(self.begin[:-1] + whole, cycles)
        at = at[at < end[:, None]]
        return at, self.names.at(at, self.cover.sample)

    def ties(self, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the string starts that the samples' ranks (-1: none) settle, and of those that may tie beside them."""
        n, cover = len(self.raw), self.cover
        place = self.places(at)
        back = first - place
        good = np.flatnonzero((first >= 0) & (back < 0))
        good = good[np.argsort(back[good], kind="stable")]
        where, back, doc = at[good], back[good], place[good] >> cover.shift
        on = np.zeros(len(good), bool)  # goes on with the stretch of the sample before
        on[1:] = (back[1:] == back[:-1]) & (doc[1:] == doc[:-1]) & (where[1:] - where[:-1] <= cover.sample)
        begin, end = np.flatnonzero(~on), np.flatnonzero(~np.append(on[1:], False)[: len(on)])
        lo, hi = where[begin], where[end] + (cover.sample - cover.length + 1)
        whole = (hi > lo) & (end > begin)
        settled = _between(lo[whole], hi[whole], n)
        ranked, start = at[first >= 0], place[first >= 0] & ((1 << cover.shift) - 1)
        near = _between(ranked - np.minimum(start, cover.v - 1), ranked + 1, n)
        near &= _between(self.begin[:-1], self.begin[1:] - cover.length + 1, n)
        return settled, near & ~settled

    def strings(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the wanted starts: numbers in the block and 64-bit names."""
        at = np.flatnonzero(wanted)
        return at, self.names.at(at, self.cover.length)

    def seconds(self, at: np.ndarray) -> np.ndarray:
        """The other 64 bits of the names."""
        return Fingerprints(_SECOND[self.raw], 1).at(at, self.cover.length)


def _between(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Mask of the places in any of the ranges."""
    edge = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by name; they ascend with it."""
    return ((names >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _shares(names: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that occur among sorted names, and where."""
    found, at = np.unique(_bucket(names, buckets), return_index=True)
    for b, lo, hi in zip(found.tolist(), at, np.append(at[1:], len(names))):
        yield b, slice(lo, hi)


@contextmanager
def _short_lived_shuffles(spark: SparkSession):
    """Shuffle files go when the query that made them ends, so passes don't add up on disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _packed(batches: Iterator[pd.DataFrame], size_of_block: int) -> Iterator[pd.DataFrame]:
    """Texts in blocks of about so many bytes; a longer text stands alone."""

    def block(held):
        held.sort(key=lambda h: h[0])
        sizes = np.array([len(raw) for _, raw in held], np.int64)
        return pd.DataFrame({"codes": [np.array([c for c, _ in held], np.int64).tobytes()], "sizes": [sizes.tobytes()], "body": [zlib.compress(b"".join(raw for _, raw in held), 1)]})

    held, size = [], 0
    for pdf in batches:
        for code, text in zip(pdf["code"].tolist(), pdf["text"]):
            raw = text.encode("utf-8", "surrogatepass")
            if held and size + len(raw) > size_of_block:
                yield block(held)
                held, size = [], 0
            held.append((code, raw))
            size += len(raw)
    if held:
        yield block(held)


def _ranks(blocks: DataFrame, cover: Cover, buckets: int, passes: int) -> list[DataFrame]:
    """``block, bucket, idx, first``: which samples of a block's bucket have a rank, and which."""

    def one_pass(lo: int, hi: int) -> DataFrame:
        def named(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    texts = Texts(row, cover)
                    at, names = texts.samples()
                    b = _bucket(names, buckets)
                    on = (b >= lo) & (b < hi)
                    at, names = at[on], names[on]
                    member, _, low, several = _classes(names, texts.places(at))
                    names = names[member]
                    out = [(row.block, b, names[s].tobytes(), low[s].tobytes(), several[s].tobytes()) for b, s in _shares(names, buckets)]
                    yield pd.DataFrame(out, columns=["block", "bucket", "names", "places", "several"])

        def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
            names, places, twice = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("names", U64), ("places", np.int64), ("several", bool)))
            _, group, low, several = _classes(names, places)
            several |= np.bincount(group, weights=twice) > 0
            out, lo = [], 0
            for block, bucket, part in zip(pdf["block"], pdf["bucket"], pdf["names"]):
                mine = group[lo : lo + len(part) // 8]
                lo += len(mine)
                on = np.flatnonzero(several[mine])
                if len(on):
                    out.append((block, bucket, on.astype(np.int32).tobytes(), low[mine[on]].tobytes()))
            return pd.DataFrame(out, columns=["block", "bucket", "idx", "first"])

        found = blocks.mapInPandas(named, "block long, bucket long, names binary, places binary, several binary")
        return written(found.groupBy("bucket").applyInPandas(ranked, "block long, bucket long, idx binary, first binary"), "ranks")

    return _by_passes(one_pass, buckets, passes)


def _by_passes(one_pass, buckets: int, passes: int) -> list[DataFrame]:
    edges = [buckets * i // passes for i in range(passes + 1)]
    return [one_pass(lo, hi) for lo, hi in zip(edges, edges[1:])]


def _met(blocks: DataFrame, parts: list[DataFrame], *columns: str) -> DataFrame:
    """Blocks and ``parts``, what the passes found for each."""
    found = reduce(DataFrame.unionByName, parts)
    return blocks.join(found.groupBy("block").agg(F.collect_list(F.struct("bucket", *columns)).alias("parts")), "block", "left")


def _tied(blocks: DataFrame, ranks: list[DataFrame], cover: Cover, buckets: int) -> DataFrame:
    """Written: blocks in which a sample has a rank, runs of ``settled`` and ``wanted`` starts, how many are ``n`` wanted."""

    def tie(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                texts = Texts(row, cover)
                at, names = texts.samples()
                member, group, *_ = _classes(names, at)
                begin = {b: s.start for b, s in _shares(names[member], buckets)}
                first = np.full(len(member), -1, np.int64)
                for part in row.parts:
                    first[begin[part["bucket"]] + np.frombuffer(part["idx"], np.int32)] = np.frombuffer(part["first"], np.int64)
                settled, wanted = texts.ties(first[group], at)
                yield pd.DataFrame([(row.block, row.codes, row.sizes, row.body, _spans(settled), _spans(wanted), int(wanted.sum()))], columns=["block", "codes", "sizes", "body", "settled", "wanted", "n"])

    met = _met(blocks, ranks, "idx", "first").where("parts is not null")
    return written(met.mapInPandas(tie, f"block long, {_BLOCK}, settled binary, wanted binary, n long"), "tied")


def _firsts(tied: DataFrame, cover: Cover, buckets: int, passes: int) -> list[DataFrame]:
    """``block, bucket, bits``: which distinct wanted strings of a block's bucket start nowhere earlier."""

    def one_pass(lo: int, hi: int) -> DataFrame:
        def named(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    texts = Texts(row, cover)
                    at, k1 = texts.strings(_filled(row.wanted, len(texts.raw)))
                    b = _bucket(k1, buckets)
                    on = (b >= lo) & (b < hi)
                    at, k1 = at[on], k1[on]
                    k2 = texts.seconds(at)
                    member, _, low, _ = _classes(k1, texts.places(at), k2)
                    k1, k2 = k1[member], k2[member]
                    out = [(row.block, b, k1[s].tobytes(), k2[s].tobytes(), low[s].tobytes()) for b, s in _shares(k1, buckets)]
                    yield pd.DataFrame(out, columns=["block", "bucket", "k1", "k2", "places"])

        def sort(pdf: pd.DataFrame) -> pd.DataFrame:
            k1, k2, places = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("k1", U64), ("k2", U64), ("places", np.int64)))
            _, group, low, _ = _classes(k1, places, k2)
            cuts = np.cumsum([len(k) // 8 for k in pdf["k1"]])[:-1]
            bits = [np.packbits(b).tobytes() for b in np.split(places == low[group], cuts)]
            return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "bits": bits})

        found = tied.where("n > 0").mapInPandas(named, "block long, bucket long, k1 binary, k2 binary, places binary")
        return written(found.groupBy("bucket").applyInPandas(sort, "block long, bucket long, bits binary"), "firsts")

    return _by_passes(one_pass, buckets, passes)


def _removed(tied: DataFrame, firsts: list[DataFrame], cover: Cover, buckets: int) -> DataFrame:
    """Written: ``code, spans`` of the documents that lose bytes."""

    def judge(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                texts = Texts(row, cover)
                n = len(texts.raw)
                gone = _filled(row.settled, n)
                if row.n:
                    at, k1 = texts.strings(_filled(row.wanted, n))
                    place = texts.places(at)
                    member, group, low, _ = _classes(k1, place, texts.seconds(at))
                    stays = np.zeros(len(member), bool)
                    shares = dict(_shares(k1[member], buckets))
                    for part in row.parts:
                        s = shares[part["bucket"]]
                        stays[s] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=s.stop - s.start)
                    gone[at] = ~(stays[group] & (place == low[group]))
                starts = np.concatenate([np.zeros(cover.length, np.int64), np.cumsum(gone)])
                covered = starts[cover.length :] > starts[:-cover.length]
                for i in np.flatnonzero(np.add.reduceat(covered, texts.begin[:-1], dtype=np.int64)):
                    out.append((int(texts.codes[i]), _spans(covered[texts.begin[i] : texts.begin[i + 1]])))
            yield pd.DataFrame(out, columns=["code", "spans"])

    return written(_met(tied, firsts, "bits").mapInPandas(judge, "code long, spans binary"), "spans")


def _finish(text: str | None, spans: bytes | None) -> tuple[int, int, int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if spans is None:
        return len(raw), 0, 0, raw
    kept = np.frombuffer(raw, np.uint8)[~_filled(spans, len(raw))].tobytes()
    return len(raw), len(raw) - len(kept), len(spans) // 16, kept


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """``docs`` and ``n_bytes``, ``n_removed``, ``n_spans`` (removed runs), ``kept`` (bytes left)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, shift, volume = coded(docs, doc_id, text)
    cover = Cover(length, shift)
    with _short_lived_shuffles(spark):
        long = rows.where(F.octet_length("text") >= length).select("code", "text")
        blocks = written(long.mapInPandas(lambda batches: _packed(batches, block), _BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")
        samples = volume * len(COVERS[cover.v]) // cover.v
        buckets, passes = _sized(samples, 17, volume, bucket)
        ranks = _ranks(blocks, cover, buckets, passes)
        tied = _tied(blocks, ranks, cover, buckets)
        for done in (blocks, *ranks):
            discard(done)
        buckets, passes = _sized(tied.agg(F.sum("n")).first()[0] or 0, 24, volume, bucket)
        firsts = _firsts(tied, cover, buckets, passes)
        spans = _removed(tied, firsts, cover, buckets)
        for done in (tied, *firsts):
            discard(done)

    @F.pandas_udf(_RESULT)
    def finish(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            yield pd.DataFrame([_finish(t, s) for t, s in zip(texts, found)], columns=_RESULT.fieldNames())

    finish = finish.asNondeterministic()  # so a filter on the result doesn't make it twice
    joined = rows.join(spans.groupBy("code").agg(F.first("spans").alias("spans")), "code", "left")
    return unwrapped(joined.select("row", finish("text", "spans").alias("found")), {n: F.col("found").getField(n) for n in _RESULT.fieldNames()})


def _sized(suffixes: int, width: int, volume: int, bucket: int) -> tuple[int, int]:
    """How many buckets, and passes over them, so that a pass ships about ``volume`` bytes."""
    buckets = suffixes // bucket + 1
    return buckets, min(buckets, suffixes * width // max(volume, 1) + 1)
