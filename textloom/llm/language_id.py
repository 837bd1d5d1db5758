"""Language ID by a byte convolutional network in numpy.

Bytes are embedded; filters of several widths, max pooling over the window and
softmax give a window's probabilities.  A text is cut whole into windows of
``LENGTH`` bytes (the last one padded); its probabilities are the windows' mean,
weighted by their bytes.

Training reads text and language of at most ``per_lang`` distinct rows a language
(the rows of smallest hash that ``train`` marks), ``WINDOWS`` windows of each.
The weights (a few KB) travel in the tasks' closure.

Defined cases: null text and text without a letter get ``und`` and score 0; a
table without usable labels gives ``und`` throughout; equal probabilities go to
the language first in code point order; an empty table gives an empty table;
other columns pass through, and the operator's replace their like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unwrapped, wrapped

LENGTH, WINDOWS, PER_LANG = 128, 4, 600
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 6
UND = "und"


def trained_rows(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def _cut(raw: bytes) -> np.ndarray:
    n = -(-len(raw) // LENGTH)
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, LENGTH)


class ByteCNN:
    """The network: ``embed`` (256 x EMBED), one matrix for all filters, softmax layer.

    Narrow filters are rows of zeros in the widest filter's matrix, kept so by a mask.
    """

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.langs = langs
        self.mask = np.concatenate([np.repeat((np.arange(wide) < w)[:, None].repeat(EMBED, 0), FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "conv": rng.normal(0, 0.3, (wide * EMBED, n)) * self.mask,
            "bias": np.zeros(n),
            "out": rng.normal(0, 0.1, (n, len(langs))),
            "prior": np.zeros(len(langs)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """``windows x positions x (width * EMBED)``: the bytes under the widest filter."""
        e = self.p["embed"][x]
        m = LENGTH - max(WIDTHS) + 1
        return np.concatenate([e[:, j : j + m] for j in range(max(WIDTHS))], 2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        c = self._columns(x)
        pooled = (c.reshape(-1, c.shape[2]) @ self.p["conv"]).reshape(c.shape[0], c.shape[1], -1).max(1)
        z = np.maximum(pooled + self.p["bias"], 0) @ self.p["out"] + self.p["prior"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on cross entropy."""
        rng, p = np.random.default_rng(seed), self.p
        m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                b, c = x[at], self._columns(x[at])
                raw = c @ p["conv"]
                top = raw.argmax(1)
                pre = np.take_along_axis(raw, top[:, None], 1)[:, 0] + p["bias"]
                h = np.maximum(pre, 0)
                z = h @ p["out"] + p["prior"]
                z = np.exp(z - z.max(1, keepdims=True))
                d = z / z.sum(1, keepdims=True)
                d[np.arange(len(at)), y[at]] -= 1
                d /= len(at)
                dh = (d @ p["out"].T) * (pre > 0)
                under = np.take_along_axis(c[:, :, None, :], top[:, None, :, None], 1)[:, 0]  # batch x filters x columns
                g = {"out": h.T @ d, "prior": d.sum(0), "bias": dh.sum(0), "conv": np.einsum("bfk,bf->kf", under, dh) * self.mask, "embed": np.zeros_like(p["embed"])}
                back = np.einsum("bf,kf->bfk", dh, p["conv"]).reshape(len(at), top.shape[1], max(WIDTHS), EMBED)
                for j in range(max(WIDTHS)):
                    np.add.at(g["embed"], np.take_along_axis(b, top + j, 1), back[:, :, j])
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = (p[k] - rate * 0.7**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def learn(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> ByteCNN | None:
    """The network trained on a bounded sample; None where nothing is labelled.

    A row belongs to the sample if its hash falls under its language's threshold,
    which is set for ``per_lang`` distinct rows; repeated rows count once.
    """
    row = wrapped(docs.where(train & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")))
    body = F.col("row").getField(text)
    row = row.select(F.col("row").getField(lang).alias("lang"), F.xxhash64(F.col("row").getField(doc_id), body).alias("at"), body.alias("text"))
    # One row a language; counts of distinct rows are estimated in the map tasks.
    counted = row.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n")).collect()
    if not counted:
        return None
    within = F.lit(False)
    for r in counted:
        most = min(2**63 - 1, int(2**64 * min(1.0, 1.2 * per_lang / r["n"])) - 2**63)
        within = within | ((F.col("lang") == r["lang"]) & (F.col("at") <= most))
    few = row.where(within).groupBy("lang", "at").agg(F.min("text").alias("text"))

    def windows(batches):
        for pdf in batches:
            for lang_, at, body in zip(pdf["lang"], pdf["at"], pdf["text"]):
                w = _cut(body.encode("utf-8", "replace"))
                w = w[:-1] if len(w) > 1 else w
                pick = np.random.default_rng(at & 0xFFFFFFFF).choice(len(w), min(len(w), WINDOWS), replace=False)
                yield pd.DataFrame({"lang": lang_, "at": at, "bytes": [w[i].tobytes() for i in np.sort(pick)]})

    got = few.mapInPandas(windows, "lang string, at long, bytes binary").toPandas().sort_values(["lang", "at", "bytes"])
    got = got[got.groupby("lang")["at"].rank("dense") <= per_lang]
    langs = sorted(got["lang"].unique())
    model = ByteCNN(langs)
    model.fit(np.stack([np.frombuffer(b, np.uint8) for b in got["bytes"]]), got["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy())
    return model


def language_id(docs: DataFrame, model: ByteCNN | None, text: str = "text") -> DataFrame:
    """``docs`` and ``lang_pred``, ``score``: every whole text judged."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lettered in batches:
            names, scores = [UND] * len(texts), np.zeros(len(texts))
            todo, size = [], 0

            def settle():
                parts = [_cut(t) for _, t in todo]
                lot, at = np.concatenate(parts), 0
                prob = np.concatenate([model.probabilities(lot[i : i + 256]) for i in range(0, len(lot), 256)])
                for (row, raw), part in zip(todo, parts):
                    weight = np.full(len(part), LENGTH, np.float64)
                    weight[-1] = len(raw) - LENGTH * (len(part) - 1)
                    mean = weight @ prob[at : at + len(part)].astype(np.float64) / weight.sum()
                    names[row], scores[row] = model.langs[int(mean.argmax())], min(1.0, float(mean.max()))
                    at += len(part)

            for i, (body, ok) in enumerate(zip(texts, lettered)):
                if ok and model:
                    todo.append((i, body.encode("utf-8", "replace")))
                    size += len(todo[-1][1])
                    if size > 1 << 20:
                        settle()
                        todo, size = [], 0
            if todo:
                settle()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    body = F.col("row").getField(text)
    judge = judge.asNondeterministic()  # so a filter on the prediction doesn't make it twice
    rows = wrapped(docs).withColumn("found", judge(body, F.coalesce(body.rlike(r"\p{L}"), F.lit(False))))
    return unwrapped(rows, {"lang_pred": F.col("found.lang_pred"), "score": F.col("found.score")})
