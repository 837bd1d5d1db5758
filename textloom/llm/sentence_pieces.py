"""SentencePiece encoding and decoding over a relational lattice.

The commonest words of the corpus (at most ``DICTIONARY``, a fixed bound) are
encoded relationally: their substrings of bounded length are exploded and joined
with the piece table, edges are grouped by word, and a Spark higher-order
aggregate folds them.  A unigram model is folded by Viterbi.  A BPE model's ids
are not the best path of any sum of scores, so there the fold merges, step by
step, the neighbours whose joint piece scores best, leftmost first; that gives
the library's ids.

Shuffling every occurrence of every word to its code would move several times
the input.  So documents stay where they are: each task looks words up in the
broadcast dictionary, and works out the rest by the same rule in Python: words
that a task hasn't met are merged together, a step of all of them at once.

Spaces become U+2581, one is put in front, nothing else is normalised; a
character without a piece becomes its UTF-8 bytes' pieces (or ``unk``).

Defined cases: null text has null ids, empty text none; U+2581 in a text comes
back as a space, as in the library; repeated rows are coded alike; an empty table
gives an empty table; other columns pass through, and the operator's columns
replace columns of the same name.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unwrapped, wrapped, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
DICTIONARY, LONGEST_WORD, CACHE, BINS = 40_000, 48, 200_000, 16
LOT, TOGETHER = 1 << 22, 1 << 14  # characters whose words are looked up, and words merged, at once


class Pieces:
    """A piece table: ``score`` and ``id`` by piece, ids of bytes, pieces by id."""

    def __init__(self, pieces: list[str], scores: list[float], unk: int, special: set[int], bpe: bool):
        self.pieces, self.unk, self.special, self.bpe = pieces, unk, special, bpe
        byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if re.fullmatch("<0x[0-9A-F]{2}>", p)}
        self.byte_ids = [byte.get(b, unk) for b in range(256)]
        self.byte_of = {i: b for b, i in byte.items()}
        self.raw_of = [self._raw(i) for i in range(len(pieces))]
        plain = [i for i in range(len(pieces)) if i not in special and i not in self.byte_of]
        self.table = {pieces[i]: (scores[i], i) for i in plain}
        self.scores = {p: score for p, (score, _) in self.table.items()}
        self.longest = max(map(len, self.table), default=1)
        self.worst = min((scores[i] for i in plain), default=0.0) - 10.0
        if any(SPACE in p.lstrip(SPACE) for p in self.table):
            raise ValueError("pieces that cross words aren't supported")
        # Characters that no piece holds stand alone, and so end words.
        self.alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.table))

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        kind = re.search(rb"\x18([\x01-\x04])\x20", model.serialized_model_proto()[-2000:])
        return cls([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], model.unk_id(), special, bool(kind) and kind[1] == b"\x02")

    @property
    def words(self) -> str:
        """Java and Python pattern of the stretches that are encoded on their own."""
        alone = "".join({"\n": r"\n", "\t": r"\t", "\r": r"\r"}[c] for c in self.alone)
        return f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")

    def raw(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]

    def encode(self, word: str) -> list[int]:
        if self.bpe and len(word) <= LONGEST_WORD:
            out, get = [], self.table.get
            for piece in self._joined(word):
                out += [got[1]] if (got := get(piece)) else self.raw(piece)
            return out
        cuts = self._merged(word) if self.bpe else self._viterbi(word)
        out = []
        for s, t in zip(cuts, cuts[1:]):
            got = self.table.get(word[s:t])
            out += [got[1]] if got else self.raw(word[s:t])
        return out

    def _viterbi(self, word: str) -> list[int]:
        best, back = [0.0], [-1]
        for t in range(1, len(word) + 1):
            score, start = best[t - 1] + self.worst, t - 1
            for s in range(max(0, t - self.longest), t):
                if (got := self.table.get(word[s:t])) and (best[s] + got[0], -s) > (score, -start if self.table.get(word[start:t]) else -t):
                    score, start = best[s] + got[0], s
            best.append(score)
            back.append(start)
        cuts = [len(word)]
        while cuts[-1] > 0:
            cuts.append(back[cuts[-1]])
        return cuts[::-1]

    def _joined(self, word: str) -> list[str]:
        """The pieces of a short word: the best pair joined, leftmost first, until none is left."""
        get, none = self.scores.get, -math.inf
        parts = list(word)
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def _merged(self, word: str) -> list[int]:
        """Boundaries of the same pieces, by a heap: for words of any length."""
        n, get = len(word), self.table.get
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts there
        heap = [(-got[0], i, i + 1, i + 2) for i in range(n - 1) if (got := get(word[i : i + 2]))]
        heapq.heapify(heap)
        while heap:
            _, s, m, t = heapq.heappop(heap)
            if end[s] != m or m >= n or end[m] != t:
                continue
            end[s], end[m] = t, 0
            if t < n:
                left[t] = s
                if got := get(word[s : end[t]]):
                    heapq.heappush(heap, (-got[0], s, t, end[t]))
            if (p := left[s]) >= 0 and (got := get(word[p:t])):
                heapq.heappush(heap, (-got[0], p, s, t))
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(end[cuts[-1]])
        return cuts

    def encode_all(self, words: list[str]) -> list[bytes]:
        """The ids of each word as bytes of int32."""
        out: list[bytes | None] = [None] * len(words)
        if self.bpe:
            size = np.fromiter(map(len, words), np.int64, len(words))
            short = np.argsort(size, kind="stable")  # words of like lengths go together
            short = short[np.searchsorted(size[short], 1) : np.searchsorted(size[short], LONGEST_WORD, "right")].tolist()
            for lo in range(0, len(short), TOGETHER):
                here = short[lo : lo + TOGETHER]
                for i, ids in zip(here, self.joints.merged([words[i] for i in here])):
                    out[i] = ids
        return [array("i", self.encode(w)).tobytes() if ids is None else ids for w, ids in zip(words, out)]

    @cached_property
    def joints(self) -> Joints:
        return Joints(self)

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw_of.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text

    def _raw(self, i: int) -> bytes:
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        return b" \xe2\x81\x87 " if i == self.unk else b"" if i in self.special else self.pieces[i].encode()


def splitter(pieces: Pieces):
    """A function from a text to its words, in which a plain space stands for U+2581."""
    find = re.compile(pieces.words.replace(SPACE, " ")).findall
    return lambda text: find(" " + text.replace(SPACE, " ")) if text else []


class Joints:
    """The rule of a BPE model for many short words at once.

    Symbols are the pieces, then characters that only occur within pieces; 0 stands
    for what no piece holds.  Ranks are those of scores, best first, and shared
    where scores are; the leftmost of the least rank is merged.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, pieces: Pieces):
        symbol = {p: i for i, p in enumerate(pieces.table, 1)}
        for c in sorted({c for p in pieces.table for c in p} - symbol.keys()):
            symbol[c] = len(symbol) + 1
        self.ids = np.full(len(symbol) + 1, -1, np.int32)
        self.ids[1 : len(pieces.table) + 1] = [i for _, i in pieces.table.values()]
        ranks = {s: i for i, s in enumerate(sorted(set(pieces.scores.values()), reverse=True))}
        self.char = np.zeros(0x110000, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.width = len(symbol) + 1
        joint = [(symbol[p[:k]] * self.width + symbol[p[k:]], ranks[pieces.scores[p]], symbol[p]) for p in pieces.table for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.bits = (4 * len(joint)).bit_length()
        self.keys, self.ranks, self.symbols = (np.full(1 << self.bits, x, t) for x, t in ((-1, np.int64), (self.NONE, np.int32), (0, np.int32)))
        key, rank, piece = np.array(joint, np.int64).reshape(-1, 3).T
        slot = self._slot(key)
        while len(key):  # the first that asks for a free slot gets it, the others ask for the next one
            free = np.flatnonzero(self.keys[slot] == -1)
            got = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[got]], self.ranks[slot[got]], self.symbols[slot[got]] = key[got], rank[got], piece[got]
            left = np.ones(len(key), bool)
            left[got] = False
            key, rank, piece, slot = key[left], rank[left], piece[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the joint pieces of neighbours stand in the table: at a free slot if there is none."""
        key = a.astype(np.int64) * self.width + b
        slot = self._slot(key)
        met = self.keys[slot]
        far = np.flatnonzero((met != key) & (met != -1))
        while len(far):
            slot[far] = (slot[far] + 1) & ((1 << self.bits) - 1)
            met = self.keys[slot[far]]
            far = far[(met != key[far]) & (met != -1)]
        return slot

    def merged(self, words: list[str]) -> list[bytes | None]:
        """Ids of words as bytes; none where a part is no piece."""
        out: list[bytes | None] = [None] * len(words)
        size = np.array([len(w) for w in words])
        n, wide = len(words), int(size.max())
        parts = self.char[np.array(words, f"U{wide}").view(np.uint32).reshape(n, wide)]
        parts[np.arange(wide) >= size[:, None]] = 0
        rows = np.arange(n)
        joint = self.ranks[self._place(parts[:, :-1].ravel(), parts[:, 1:].ravel())].reshape(n, wide - 1)
        while len(rows):
            at = joint.argmin(1) if joint.shape[1] else np.zeros(len(rows), np.int64)
            best = joint[np.arange(len(rows)), at] if joint.shape[1] else np.full(len(rows), self.NONE)
            more = best < self.NONE
            self._put(out, rows[~more], parts[~more], size[~more])
            rows, parts, joint, size, at = rows[more], parts[more], joint[more], size[more] - 1, at[more]
            if not len(rows):
                break
            here, width = np.arange(len(rows)), parts.shape[1] - 1
            parts[here, at] = self.symbols[self._place(parts[here, at], parts[here, at + 1])]
            parts = parts[np.arange(width + 1) != at[:, None] + 1].reshape(len(rows), width)
            joint = joint[np.arange(width) != at[:, None]].reshape(len(rows), width - 1)
            for side, ok in ((at - 1, at > 0), (at, at < width - 1)):
                i, j = here[ok], side[ok]
                joint[i, j] = self.ranks[self._place(parts[i, j], parts[i, j + 1])]
        return out

    def _put(self, out: list, rows: np.ndarray, parts: np.ndarray, size: np.ndarray) -> None:
        ids = self.ids[parts]
        used = np.arange(parts.shape[1]) < size[:, None]
        whole = ((ids >= 0) | ~used).all(1)
        flat, end = ids[used].tobytes(), np.cumsum(size) * 4
        for row, lo, hi, ok in zip(rows.tolist(), (end - size * 4).tolist(), end.tolist(), whole.tolist()):
            if ok:
                out[row] = flat[lo:hi]


class Codes:
    """Ids of words as bytes of int32: the dictionary's, and lately met others.

    It is broadcast, so the tasks that a Python worker runs share what it has met.
    """

    def __init__(self, pieces: Pieces, known: dict[str, list[int]]):
        self.known = {w.replace(SPACE, " "): np.array(ids, np.int32).tobytes() for w, ids in known.items()}
        self.pieces, self.met = pieces, {}

    def of(self, texts: list[list[str]]) -> dict[str, bytes]:
        """The ids of all words of the texts, and maybe of others."""
        if not self.met or len(self.met) > len(self.known) + 2 * CACHE:
            self.met = dict(self.known)
        new = list(set().union(*texts).difference(self.met))
        codes = self.pieces.encode_all([w.replace(" ", SPACE) for w in new])
        self.met.update((w, c) for w, c in zip(new, codes) if len(w) <= LONGEST_WORD)
        long = {w: c for w, c in zip(new, codes) if len(w) > LONGEST_WORD}
        return {**self.met, **long} if long else self.met


def lots(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lots of at most ``LOT`` characters or of one text."""
    lot, held = [], 0
    for t in texts:
        if lot and held + len(t or "") > LOT:
            yield lot
            lot, held = [], 0
        lot.append(t)
        held += len(t or "")
    if lot:
        yield lot


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``word, edges``: all pieces in each word, as ``start, end, score, id``."""
    spark = words.sparkSession
    table = spark.createDataFrame([(p, float(s), i) for p, (s, i) in pieces.table.items()], "piece string, score double, id int")
    spans = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    spans = spans.select("word", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + pieces.longest, F.length("word")))).alias("end"))
    edges = spans.withColumn("piece", F.expr("substring(word, start + 1, end - start)")).join(F.broadcast(table), "piece")
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("start", "end", "score", "id"))).alias("edges"))
    none = F.array().cast("array<struct<start:int,end:int,score:double,id:int>>")
    return words.join(grouped, "word", "left").select("word", F.coalesce("edges", none).alias("edges"))


def _fold_merges(edges: Column, length: Column) -> Column:
    """Boundaries after merging the best joint piece of two neighbours, again and again."""

    def step(cuts, _):
        def joins(e):
            at = F.array_position(cuts, e["start"]).cast("int")
            return (at > 0) & (F.get(cuts, at + 1) == e["end"])

        best = F.array_max(F.transform(F.filter(edges, joins), lambda e: F.struct(e["score"].alias("score"), (-e["start"]).alias("left"), e["end"].alias("end"))))
        return F.when(best.isNull(), cuts).otherwise(F.filter(cuts, lambda x: (x <= -best["left"]) | (x >= best["end"])))

    return F.aggregate(F.sequence(F.lit(1), length), F.sequence(F.lit(0), length), step)


def _fold_viterbi(edges: Column, length: Column, worst: float) -> Column:
    """Boundaries of the path of largest total score, longest last piece on ties."""

    def step(best, t):
        lone = F.struct((F.element_at(best, -1)["score"] + F.lit(worst)).alias("score"), (-(t - 1)).alias("left"))
        paths = F.transform(F.filter(edges, lambda e: e["end"] == t), lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("left")))
        return F.concat(best, F.array(F.coalesce(F.array_max(paths), lone)))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("left")))
    best = F.aggregate(F.sequence(F.lit(1), length), start, step)
    back = lambda cuts, _: F.when(F.element_at(cuts, 1) == 0, cuts).otherwise(F.concat(F.array(-F.get(best, F.element_at(cuts, 1))["left"]), cuts))
    return F.aggregate(F.sequence(F.lit(1), length), F.array(length), back)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``word, ids`` of distinct words, by the lattice."""
    length = F.length("word")
    cuts = _fold_merges(F.col("edges"), length) if pieces.bpe else _fold_viterbi(F.col("edges"), length, pieces.worst)
    rows = lattice(words, pieces).withColumn("cuts", cuts)
    bytes_ = F.array(*[F.lit(i) for i in pieces.byte_ids])

    def code(start, place):
        end = F.get(F.col("cuts"), place + 1)
        hit = F.filter("edges", lambda e: (e["start"] == start) & (e["end"] == end))
        hexed = F.hex(F.encode(F.substring(F.col("word"), start + 1, end - start), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2)), lambda i: F.get(bytes_, F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("int")))
        return F.when(F.size(hit) > 0, F.transform(hit, lambda e: e["id"])).otherwise(raw)

    return rows.select("word", F.flatten(F.transform(F.slice("cuts", 1, F.size("cuts") - 1), code)).alias("ids"))


def common_words(docs: DataFrame, text: Column, pieces: Pieces, most: int = DICTIONARY) -> DataFrame:
    """The commonest words, at most ``most``: whole bins of like counts, from the commonest down."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = splitter(shared.value)
        for batch in batches:
            found = Counter()
            for t in batch["text"]:
                found.update(split(t))
            kept = [(w, n) for w, n in found.items() if len(w) <= LONGEST_WORD]
            yield pd.DataFrame({"word": [w for w, _ in kept], "n": [n for _, n in kept]})

    counted = docs.select(text.alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted.withColumn("bin", F.floor(F.log2("n") * BINS).cast("int")), "counts")
    # One row a bin (a sixteenth of a power of two, so under a thousand), taken from the commonest down.
    least, held = None, 0
    for r in sorted(counted.groupBy("bin").agg(F.count("*").alias("words")).collect(), reverse=True):
        held += r["words"]
        if held > most:
            break
        least = r["bin"]
    kept = counted.where(F.col("bin") >= least) if least is not None else counted.limit(0)
    return kept.select(F.translate("word", " ", SPACE).alias("word"))


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, most: int = DICTIONARY) -> DataFrame:
    """``docs`` and ``ids`` (array of int), ``n_tokens``, ``decoded`` equal to the text or not (``round_trip``)."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = Pieces.load(model)
    rows = wrapped(docs)
    body = F.col("row").getField(text)
    words = written(common_words(rows, body, pieces, most), "words")
    known = {r["word"]: r["ids"] for r in encode_words(words.repartition(spark.sparkContext.defaultParallelism * 4), pieces).collect()}
    shared = spark.sparkContext.broadcast(Codes(pieces, known))

    @F.pandas_udf("ids array<int>, n_tokens int, round_trip boolean")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes = shared.value
        pieces, split = codes.pieces, splitter(codes.pieces)
        for texts in batches:
            out = []
            for lot in lots(texts.tolist()):
                words = [split(t) for t in lot]
                code = codes.of(words).__getitem__
                for t, found in zip(lot, words):
                    if t is None:
                        out.append((None, 0, None))
                        continue
                    ids = np.frombuffer(b"".join(map(code, found)), np.int32)
                    out.append((ids, len(ids), pieces.decode(ids.tolist()) == t))
            yield pd.DataFrame(out, columns=["ids", "n_tokens", "round_trip"])

    found = rows.withColumn("found", coded(body))
    return unwrapped(found, {c: F.col("found").getField(c) for c in ("ids", "n_tokens", "round_trip")})


def decode(docs: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` and ``decoded``: the text of an id array; null ids give null."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if r is None else shared.value.decode(r) for r in rows], dtype=object)

    rows = wrapped(docs).withColumn("found", text(F.col("row").getField(ids)))
    return unwrapped(rows, {"decoded": F.col("found")})
