"""Which fixed-length windows of a corpus occur more than once, exactly.

Steps, for windows of words or of bytes:

1. Every task sketches the anchors of its ranges (see ``windows``); the merged
   count-min sketch never estimates a window below its count, so windows that
   it puts at one are settled.
2. Ranges estimated repeated are grouped by anchor and, within it, a 64-bit name
   of their content (map-side combined: a class of copies costs one row a task).  In a bucket of
   ranges with one anchor and one content, all is known.
3. In buckets with several contents, one or two members of each content are
   cut into single windows, which are grouped by their 128-bit names.  Members
   are found again by a Bloom filter; what its false members add is told apart
   at the end, where the true members' ranges are at hand.
4. What comes out are *exceptions*: windows estimated repeated that must stay.
   They meet the texts in one join, and each task recomputes the estimates.

No step needs the rows of a group in one task, and none drops a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketches
from .common import coded, small_batches, written
from .windows import U64, Batch, covered, mix, spread

_BYTES = mix(np.arange(256, dtype=U64), 11)
_CHUNK = 1 << 19  # bytes of text handled at once; longer documents stand alone


class Windows:
    """Windows of ``length`` tokens (``words`` or ``bytes``), anchored by grams."""

    def __init__(self, tokens: str, length: int, gram: int):
        self.tokens, self.length, self.gram = tokens, length, gram

    def split(self, raw: bytes) -> list[bytes] | bytes:
        """Words between the ASCII white space characters, or the bytes themselves."""
        return raw.split() if self.tokens == "words" else raw

    def batch(self, pieces: list) -> Batch:
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        if self.tokens == "words":
            flat = np.empty(int(sizes.sum()), dtype=object)
            flat[:] = [w for p in pieces for w in p]
            hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, U64)
        else:
            hashes = _BYTES[np.frombuffer(b"".join(pieces), np.uint8)]
        return Batch(hashes, sizes, self.length, self.gram)

    def chunks(self, texts) -> Iterator[tuple[int, list, Batch]]:
        """Place of the first text, the texts' tokens, and their windows."""
        first, pieces, size = 0, [], 0
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            if pieces and size + len(raw) > _CHUNK:
                yield first, pieces, self.batch(pieces)
                first, pieces, size = i, [], 0
            pieces.append(self.split(raw))
            size += len(raw)
        if pieces:
            yield first, pieces, self.batch(pieces)


#: Marks, above its length, what a span is: a member's range, or a single window that stays if a member's range holds it.
_MEMBER, _SINGLE = 1 << 30, 1 << 29


def _stays(spans: np.ndarray, size: int) -> np.ndarray:
    """Window starts that stay; single windows of ranges that only seemed members don't count."""
    start, n = spans >> 32, spans & (_SINGLE - 1)
    member, single = spans & _MEMBER > 0, spans & _SINGLE > 0
    mine = np.zeros(size, dtype=bool)
    mine[spread(start[member], n[member])] = True
    one = start[single]
    return np.concatenate([spread(start[~member & ~single], n[~member & ~single]), one[mine[one]]])


def _member(anchor, name, mark, start) -> np.ndarray:
    """One hash for one range of one row."""
    return mix(anchor.view(U64)) ^ mix(name.view(U64), 1) ^ mix(mark.view(U64), 2) ^ mix(start.astype(np.int64).view(U64), 3)


class Repeats:
    """Finds, over a whole corpus, the windows that occur again.

    ``keep_first``: exceptions are the first occurrence of every window
    (smallest ``doc_id``, then start); else only windows that occur once.
    ``most_bits`` bounds the broadcast sketch: ``2**most_bits`` slots in each of
    two rows, 1 bit a slot.  Beyond it more windows are estimated repeated and
    grouped exactly; the result does not change.

    A row's ``code`` orders rows by ``doc_id`` (see ``coded``); a ``place`` is
    ``code << shift | start``.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str, windows: Windows, keep_first: bool, most_bits: int = 27):
        self.windows, self.keep_first, self.most_bits, self.spark = windows, keep_first, most_bits, docs.sparkSession
        small_batches(self.spark)
        rows, self.shift, volume = coded(docs, doc_id, text)
        self.rows, self.text = rows.select("row", "code"), F.col("row").getField(text)
        self.slim = rows.select("code", F.xxhash64("code").alias("mark"), "text").where(F.octet_length("text") >= windows.length)
        per_token = 1 if windows.tokens == "bytes" else 6
        self.bits = sketches.fitting_bits(volume / per_token * 2 / (windows.length - windows.gram + 2), 16, most_bits)

        def anchors(batches):
            for pdf in batches:
                for _, _, b in windows.chunks(pdf["text"]):
                    yield b.anchor

        self.twice = sketches.broadcast(self.spark, sketches.build(self.slim.select("text"), anchors, self.bits, "twice"))

    def _place(self):
        return F.shiftleft("code", self.shift) + F.col("start")

    def _code(self):
        return F.shiftright("place", self.shift)

    def _start(self):
        return F.col("place").bitwiseAND(F.lit((1 << self.shift) - 1)).cast("int")

    def exceptions(self) -> DataFrame:
        """``code`` (the row) and ``spans``: ``start << 32 | n`` of windows that stay."""
        windows, twice, bits = self.windows, self.twice, self.bits

        def ranges(batches):
            for pdf in batches:
                for first, _, b in windows.chunks(pdf["text"]):
                    on = sketches.test(twice.value, b.anchor, bits)
                    start, count, doc = b.start[on], b.count[on], b.doc[on]
                    name = b.first.at(start, count + (windows.length - 1)).view(np.int64)
                    yield pd.DataFrame({"anchor": b.anchor[on].view(np.int64), "name": name, "code": pdf["code"].to_numpy()[doc + first], "start": (start - b.begin[doc]).astype(np.int32), "n": count.astype(np.int32)})

        found = self.slim.mapInPandas(ranges, f"anchor long, name long, code long, start int, n int").withColumn("place", self._place())
        high = [] if self.keep_first else [F.max("place").alias("high")]
        classes = written(found.groupBy("anchor", "name").agg(F.min("place").alias("low"), *high, F.count("*").alias("times"), F.max("n").alias("n")), "classes")
        several = written(classes.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1").select("anchor"), "several")
        plain = classes if self.keep_first else classes.where("times = 1")
        spans = plain.join(several, "anchor", "left_anti").select(F.col("low").alias("place"), "n")
        members = written(classes.join(several, "anchor").select("anchor", "name", "n", F.explode(F.array("low") if self.keep_first else F.array_distinct(F.array("low", "high"))).alias("place")), "members")
        if n := members.count():
            spans = spans.unionByName(members.select("place", (F.col("n") + _MEMBER).alias("n"))).unionByName(self._single(members, n))
        span = F.shiftleft(self._start().cast("long"), 32) + F.col("n")
        return spans.select(self._code().alias("code"), span.alias("span")).groupBy("code").agg(F.collect_list("span").alias("spans"))

    def _single(self, members: DataFrame, n: int) -> DataFrame:
        """Exceptions among the single windows of the members' ranges."""
        windows, twice, bits = self.windows, self.twice, self.bits
        member_bits = sketches.fitting_bits(n * 4, 16, self.most_bits)

        def hashes(batches):
            for pdf in batches:
                yield _member(*(pdf[c].to_numpy() for c in ("anchor", "name", "mark", "start")))

        known = sketches.broadcast(self.spark, sketches.build(members.select("anchor", "name", F.xxhash64(self._code()).alias("mark"), self._start().alias("start")), hashes, member_bits, "once"))

        def singles(batches):
            for pdf in batches:
                codes, marks = pdf["code"].to_numpy(), pdf["mark"].to_numpy()
                for first, _, b in windows.chunks(pdf["text"]):
                    on = np.flatnonzero(sketches.test(twice.value, b.anchor, bits))
                    name = b.first.at(b.start[on], b.count[on] + (windows.length - 1)).view(np.int64)
                    doc = b.doc[on]
                    on = on[sketches.test(known.value, _member(b.anchor[on].view(np.int64), name, marks[doc + first], b.start[on] - b.begin[doc]), member_bits)]
                    if not len(on):
                        continue
                    a = spread(b.start[on], b.count[on])
                    doc = np.repeat(b.doc[on], b.count[on])
                    k1, k2 = b.names(a, windows.length)
                    yield pd.DataFrame({"k1": k1, "k2": k2, "code": codes[doc + first], "start": (a - b.begin[doc]).astype(np.int32)})

        found = self.slim.mapInPandas(singles, f"k1 long, k2 long, code long, start int").withColumn("place", self._place())
        times = [] if self.keep_first else [F.count("*").alias("times")]
        found = found.groupBy("k1", "k2").agg(F.min("place").alias("place"), *times)
        if not self.keep_first:
            found = found.where("times = 1")
        return found.select("place", F.lit(1 + _SINGLE).cast("int").alias("n"))

    def applied(self, result: T.StructType, finish) -> DataFrame:
        """``row`` and ``found``: ``finish(tokens, removed mask)`` for every row."""
        windows, twice, bits = self.windows, self.twice, self.bits

        @F.pandas_udf(result)
        def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, spans in batches:
                out, spans = [], spans.tolist()
                for first, pieces, b in windows.chunks(texts):
                    on = sketches.test(twice.value, b.anchor, bits)
                    again = np.zeros(int(b.begin[-1]), dtype=bool)
                    again[spread(b.start[on], b.count[on])] = True
                    for i in range(len(pieces)):
                        if (s := spans[first + i]) is not None and len(s):
                            again[_stays(np.asarray(s, dtype=np.int64), int(b.lengths[i])) + b.begin[i]] = False
                    gone = covered(len(again), np.flatnonzero(again), windows.length)
                    out += [finish(p, gone[b.begin[i] : b.begin[i + 1]]) for i, p in enumerate(pieces)]
                yield pd.DataFrame(out, columns=result.fieldNames())

        judge = judge.asNondeterministic()  # so a filter on the result doesn't make it twice
        joined = self.rows.join(self.exceptions(), "code", "left")
        return joined.select("row", judge(self.text, "spans").alias("found"))
