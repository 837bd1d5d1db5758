"""Quality classifier from trusted positives and unlabelled text (non-negative PU risk).

Only texts that a label of 1 vouches for are used as such; label 0 is never read as
negative.  Everything else is unlabelled: a mixture of good and bad texts.

1. *Sample.* At most ``positives`` documents with label 1 and ``unlabelled`` documents
   of any kind, those of smallest hash; their ids (a bounded number) select the
   texts, tasks turn these into features, and only features reach the driver.
2. *Prior.* A network learns to tell positives from unlabelled texts on four fifths of
   both.  On the rest, the share of unlabelled texts above a score cannot be below the
   prior times the share of positives above it; the prior is their quotient where it
   is smallest beyond sampling error.
3. *Risk.* With prior ``p`` the network minimises ``p * E+[loss(+)] + max(0, Eu[loss(-)] -
   p * E+[loss(-)])`` with logistic loss; where a batch's second term is negative, that
   term alone is stepped back.  So scores are probabilities of label 1.
4. Every whole text is scored in the task that reads it; the weights (tens of KB) travel
   in the task's closure.

Features: frequencies of pairs of byte classes (letter cases, digits, white space, marks
one by one, parts of multi-byte characters), and shares of repeated words, of words
equal to the one before, of repeated lines, lengths of words.

Defined cases: a null text counts as empty and is scored like any other; without
trusted positives or without texts every score is 0.5; a document with labels 0 and 1 is
not trusted; null labels and null ids are not learned from; of documents that share an
id one (the smallest text) is learned from; repeated rows get the same score; very long
texts are counted a slice at a time; an empty table gives an empty table; other
columns pass through, and the operator's columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unwrapped, wrapped

POSITIVES, UNLABELLED = 3000, 6000
HIDDEN, EPOCHS, BATCH, RATE = 16, 60, 256, 0.003
_SLICE = 1 << 20  # bytes counted at once


def _byte_classes() -> np.ndarray:
    """The class of each byte: marks have classes of their own."""
    out = np.zeros(256, np.int64)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 1, 2, 3
    out[ord(" ")], out[9], out[10:14] = 4, 5, 6
    for i, mark in enumerate(".,;:!?'\"-()[]{}<>/\\|*#%&$@_=+"):
        out[ord(mark)] = 7 + i
    out[128:160], out[160:192], out[192:] = 37, 38, 39
    return out


_CLASS = _byte_classes()
_KINDS = 40
_EXTRA = 6
WIDTH = _KINDS * _KINDS + _EXTRA


def _pairs(raws: list[bytes]) -> np.ndarray:
    """Counts of class pairs, a row a text."""
    n, sizes = len(raws), np.array([len(r) for r in raws])
    kinds = _CLASS[np.frombuffer(b"".join(raws), np.uint8)]
    doc = np.repeat(np.arange(n), sizes)
    out = np.zeros(n * _KINDS * _KINDS)
    for lo in range(0, max(0, len(kinds) - 1), _SLICE):
        a, b = slice(lo, min(lo + _SLICE, len(kinds) - 1)), slice(lo + 1, min(lo + _SLICE, len(kinds) - 1) + 1)
        on = doc[a] == doc[b]
        out += np.bincount((doc[a][on] * _KINDS + kinds[a][on]) * _KINDS + kinds[b][on], minlength=len(out))
    return out.reshape(n, -1)


def features(raws: list[bytes]) -> np.ndarray:
    """One row a text: square roots of pair frequencies, and shares of repetition."""
    out = np.zeros((len(raws), WIDTH), np.float32)
    counts = _pairs(raws)
    out[:, :-_EXTRA] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    for row, raw in zip(out, raws):
        words, lines = raw.split(), raw.split(b"\n")
        n = len(words)
        if n:
            row[-_EXTRA:] = len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), np.log1p(n), len(raw) / n / 16, len(max(words, key=len)) / 64
    return out


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), 1 / (x.std(0) + 0.02)
        self.p = {"w": rng.normal(0, 0.05, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1)}

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip((x - self.mean) * self.scale, -6, 6)
        return x, np.maximum(x @ self.p["w"] + self.p["b"], 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x)[1] @ self.p["v"] + self.p["c"][0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, slope, epochs: int = EPOCHS, seed: int = 7) -> None:
        """Adam; ``slope(zp, zu)`` is the risk's derivative by the logits of both batches."""
        rng, p = np.random.default_rng(seed), self.p
        m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for epoch in range(epochs):
            lots = max(1, len(unlabelled) // (2 * BATCH))
            order = rng.permutation(len(positive))
            for i, u in enumerate(np.array_split(rng.permutation(len(unlabelled)), lots)):
                q = np.take(order, np.arange(i * BATCH, (i + 1) * BATCH), mode="wrap")
                x, h = self._hidden(np.concatenate([positive[q], unlabelled[u]]))
                z = h @ p["v"] + p["c"][0]
                d = np.concatenate(slope(z[: len(q)], z[len(q) :]))
                dh = np.outer(d, p["v"]) * (h > 0)
                g = {"w": x.T @ dh + 1e-4 * p["w"], "b": dh.sum(0), "v": h.T @ d, "c": d.sum(keepdims=True)}
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - RATE * 0.96**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _apart(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the logistic loss of positives against unlabelled, both classes of equal weight."""
    return -_sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu)


def non_negative_risk(prior: float):
    """Slope of the non-negative unbiased risk."""

    def slope(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        dp, du = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        if negative < 0:
            return -dp, -du
        return dp - prior * _sigmoid(-zp) / len(zp), du

    return slope


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled texts, from scores of texts not learned from."""
    edges = np.unique(positive)
    above = lambda s: 1 - np.searchsorted(np.sort(s), edges) / len(s)
    p, u = above(positive), above(unlabelled)
    error = np.sqrt(np.log(40) / 2)  # of shares, at one in ten
    bound = (u + error / np.sqrt(len(unlabelled)) + error / np.sqrt(len(positive))) / p
    best = int(bound.argmin())
    return float(min(0.99, max(0.01, u[best] / p[best])))


class Model:
    """The trained network and the prior it was trained with."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        fifth = lambda x: (x[np.arange(len(x)) % 5 > 0], x[np.arange(len(x)) % 5 == 0])
        (p, p_out), (u, u_out) = fifth(positive), fifth(unlabelled)
        apart = Network(np.concatenate([p, u]) if len(p) and len(u) else unlabelled)
        if len(p) and len(u):
            apart.fit(p, u, _apart, EPOCHS // 4)
        self.prior = estimated_prior(apart.logits(p_out), apart.logits(u_out))
        self.network = Network(unlabelled)
        self.network.fit(positive, unlabelled, non_negative_risk(self.prior))


def trained_rows(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def _least(ids: DataFrame, most: int) -> DataFrame:
    """``id`` of the ``most`` distinct ids of smallest hash; others than those far below are cut off before the shuffle."""
    ids = ids.where("id is not null").withColumn("at", F.xxhash64("id"))
    n = ids.agg(F.approx_count_distinct("id", 0.02)).first()[0]
    if n > 1.5 * most:
        ids = ids.where(F.col("at") <= int(2**64 * 1.3 * most / n) - 2**63)
    return ids.groupBy("id", "at").agg(F.lit(1)).orderBy("at", "id").limit(most).select("id")


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train: Column | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """The model; ``labels`` has ``doc_id`` and ``label``, ``train`` marks the rows of both tables that may be learned from."""
    if train is not None:
        docs, labels = docs.where(train), labels.where(train)
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    marks = labels.groupBy(F.col(doc_id).alias("id"))
    trusted = marks.agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = 1 and high = 1").select("id")

    def drawn(ids: DataFrame, most: int) -> np.ndarray:
        few = docs.join(F.broadcast(_least(ids, most)), "id").groupBy("id").agg(F.min("text").alias("text"))

        def vectors(batches):
            for pdf in batches:
                for i in range(0, len(pdf), 64):
                    part = pdf.iloc[i : i + 64]
                    x = features([_raw(t) for t in part["text"]]).astype(np.float16)
                    yield pd.DataFrame({"id": part["id"].astype(str).to_numpy(), "x": [r.tobytes() for r in x]})

        got = few.mapInPandas(vectors, "id string, x binary").toPandas().sort_values(["id", "x"])
        return np.array([np.frombuffer(b, np.float16) for b in got["x"]], np.float32).reshape(-1, WIDTH)

    small_batches(docs.sparkSession)
    x_p, x_u = drawn(trusted, positives), drawn(docs.select("id"), unlabelled)
    return Model(x_p, x_u) if len(x_p) >= 5 and len(x_u) >= 5 else None


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def quality(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` and ``score`` (probability of label 1) and ``predicted`` (1 from 0.5 on)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            scores, held, size = [], [], 0
            for i, body in enumerate(texts):
                held.append(_raw(body))
                size += len(held[-1])
                if size >= _SLICE // 2 or i + 1 == len(texts):
                    scores.append(np.full(len(held), 0.5) if model is None else model.network.probabilities(features(held)))
                    held, size = [], 0
            yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))

    judge = judge.asNondeterministic()  # so a filter on the score doesn't make it twice
    rows = wrapped(docs).withColumn("found", judge(F.col("row").getField(text)))
    return unwrapped(rows, {"score": F.col("found"), "predicted": F.when(F.col("found") >= 0.5, 1).otherwise(0)})
