"""Every stage of the pipeline beside plain Python, on rows of every awkward kind."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from textloom.llm.language_id import language_id, learn, trained_rows
from textloom.llm.sentence_pieces import MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(P.STAGES)
WORDS = {"en": "the of and to in is that was for it with as his on be", "de": "der die und das ist nicht ein zu den mit sich auf"}


def corpus():
    rng = random.Random(3)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "x", "ly"]) for _ in range(n))
    docs = [(i, prose(lang, rng.randint(30, 90)), lang, f"s{i % 3}") for i in range(120) for lang in [rng.choice(["en", "de"])]]
    passage = prose("en", 60)
    docs += [(200 + i, prose("en", 40) + " " + passage + " " + prose("en", 40), "en", "s0") for i in range(3)]
    docs += [(300 + i, docs[5][1] + (" tail" if i % 2 else ""), docs[5][2], None) for i in range(4)]
    docs += [(400, None, "en", "s1"), (401, "", "en", "s1"), (402, "12 34 !", None, "s1"), (403, prose("de", 6000), None, "big"), (404, passage, "en", "s2")]
    docs += [docs[7], docs[7], (None, docs[9][1], "en", "s0"), (None, prose("en", 50), None, None)]
    return [(d, t, l, s, len(t or "")) for d, t, l, s in docs]


@pytest.fixture(scope="module")
def frames(spark):
    """Each stage's input and output, as ``run`` chains them."""
    docs, out = spark.createDataFrame(corpus(), SCHEMA).repartition(5), {}
    for name, stage in P.STAGES:
        found = P.written(stage(spark, docs, ""), name)
        out[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in found.collect()], found.columns)
        docs = found
    return out


def ordered(rows):
    return sorted(rows, key=str)


def test_language_takes_the_prediction(spark, frames):
    before, after, columns = frames["language"]
    assert columns == P.COLUMNS
    df = spark.createDataFrame(before, SCHEMA)
    said = {r.text: (r.lang_pred, r.score) for r in language_id(df, learn(df, trained_rows(F.col("doc_id")))).collect()}
    assert ordered(after) == ordered((d, t, said[t][0], s, n) for d, t, _, s, n in before if said[t][0] != "und" and said[t][1] >= P.LEAST_SCORE)
    assert {t for _, t, *_ in before} - {t for _, t, *_ in after} >= {None, "", "12 34 !"}
    assert [l for d, _, l, *_ in after if d == 403] == ["de"]  # it had none


def test_a_changed_prediction_changes_the_result(spark, monkeypatch):
    class Unsure:
        langs = ["xx", "yy"]

        def probabilities(self, x):
            import numpy as np

            return np.tile([[0.45, 0.45]], (len(x), 1))

    monkeypatch.setattr(P, "learn", lambda *a, **k: Unsure())
    assert P.identify(spark, spark.createDataFrame(corpus(), SCHEMA), "").count() == 0
    Unsure.probabilities = lambda self, x: __import__("numpy").tile([[0.1, 0.9]], (len(x), 1))
    assert {r.lang for r in P.identify(spark, spark.createDataFrame(corpus(), SCHEMA), "").collect()} == {"yy"}


def grams(text, n=5):
    w = text.split()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_one_of_each_group_of_near_copies_stays(frames):
    before, after, _ = frames["near_copies"]
    texts = sorted({t for _, t, *_ in before})
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    assert len(after) == len({group[t] for _, t, *_ in before}) and {group[t] for _, t, *_ in after} == set(group.values())
    assert all(r in before for r in after)
    first = {}
    for d, t, *_ in before:
        if d is not None:
            first[group[t]] = min(first.get(group[t], d), d)
    assert all(d == first[group[t]] for d, t, *_ in after if d is not None)


def test_repeated_passages_go(frames):
    before, after, columns = frames["passages"]
    seen, window = {}, 35
    for d, t, *_ in before:
        w = t.split()
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    want = []
    for d, t, l, s, n in before:
        w, gone = t.split(), set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = t if not gone else " ".join(x for i, x in enumerate(w) if i not in gone)
        if kept or not gone:
            want.append((d, kept, l, s, len(kept)))
    assert ordered(after) == ordered(want) and columns == P.COLUMNS
    assert 404 not in {d for d, *_ in after} and {200, 201, 202} <= {d for d, *_ in after}


def test_mix_takes_what_it_counts(frames):
    before, after, _ = frames["mix"]
    size = lambda t: len(t.split())
    sources = sorted({s for *_, s, _ in before}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, _, x, _ in before if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(sources)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2.0 * total[s] for s in full)
        open_ -= full
    for s in sources:
        assert abs(sum(size(t) for _, t, _, x, _ in after if x == s) - target[s]) <= 2
    key = lambda d, t: -math.log((int(hashlib.md5(f"{'' if d is None else d}:42".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / max(0.05, sum(c.isalpha() for c in t) / len(t))
    for s in sources:
        rows = sorted((r for r in before if r[3] == s), key=lambda r: (key(r[0], r[1]), r[0] or 0))
        whole, rest = int(target[s] // total[s]), math.floor(target[s] - target[s] // total[s] * total[s] + 0.5)
        want = []
        for d, t, l, _, n in rows:
            want += [(d, t, l, s, n)] * whole
            part = min(size(t), rest)
            rest -= part
            if part:
                cut = t if part == size(t) else " ".join(t.split()[:part])
                want.append((d, cut, l, s, len(cut)))
        assert ordered(r for r in after if r[3] == s) == ordered(want)


def test_pieces_equal_the_library(frames):
    import sentencepiece

    before, after, columns = frames["pieces"]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"]
    assert ordered(tuple(r) for r in after) == ordered((d, l, s, model.encode(t), len(model.encode(t)), True) for d, t, l, s, _ in before)


def test_stages_on_nothing_and_on_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0, name
    wide = spark.createDataFrame([(1, "the of and " * 20, "en", "s", 1, "x", 2, 3)], SCHEMA + ", row string, kept int, score int")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, wide, "").columns == P.COLUMNS, name


def test_run_chains_the_stages(spark, tmp_path, frames):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in P.run(spark, str(tmp_path)).collect()]
    assert ordered(got) == ordered(frames["pieces"][1])
