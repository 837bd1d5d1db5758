import random

from textloom.llm import jaccard_join
from textloom.llm.jaccard_join import banding, jaccard_classes, jaccard_dedup

SCHEMA = "doc_id long, text string, kept string"


def grams(text, n=5):
    w = (text or "").encode().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, threshold=0.8):
    sets = {d: grams(t) for d, t, _ in docs}
    links = {d: {e for e in sets if e != d and sets[d] and sets[e] and len(sets[d] & sets[e]) / len(sets[d] | sets[e]) >= threshold} for d in sets}
    low = {d: d for d in sets}
    for _ in sets:
        low = {d: min([low[d], *(low[e] for e in links[d])]) for d in sets}
    return {d: (len(links[d]), low[d], low[d] == d) for d in sets}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 200))), "x") for i in range(60)]
    base = [word() for _ in range(150)]
    for i in range(60, 460):  # one large group of near copies
        w = list(base)
        w[rng.randrange(150)] = word()
        docs.append((i, " ".join(w), None))
    docs += [(500, None, None), (501, "  ", None), (502, "a b", None), (503, "a\tb", None), (504, docs[3][1], None)]
    return docs


def test_matches_brute_force(spark):
    docs = corpus()
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in jaccard_classes(spark.createDataFrame(docs, SCHEMA).repartition(6)).collect()}
    want = brute(docs)
    assert got == want


def test_shared_ids_and_columns(spark):
    docs = [(1, "a b c d e f", "x"), (1, "z y x w v u", "x"), (None, "a b c d e f", None)]
    found = jaccard_dedup(spark.createDataFrame(docs, SCHEMA))
    assert found.columns == ["doc_id", "text", "class_id", "n_links", "component_id", "kept"]
    assert sorted(r.n_links for r in found.collect()) == [0, 1, 1]


def test_empty(spark):
    assert jaccard_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_banding_reaches_recall():
    bands, rows = banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 150


def test_one_of_repeated_rows_stays(spark):
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join([f"w{i}" for i in range(59)] + ["other"])
    docs = [(None, text, "x")] * 20 + [(7, text, "y")] * 3 + [(8, near, "z"), (9, "quite another text", "z"), (9, "quite another text", "other"), (10, None, "x")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    for found in (jaccard_classes(df), jaccard_dedup(df)):
        rows = found.collect()
        assert len(rows) == len(docs)
        by = {}
        for r in rows:
            by.setdefault(r.component_id, []).append(r.kept)
        assert sorted((len(k), sum(k)) for k in by.values()) == [(1, 1), (2, 1), (24, 1)]
        assert sorted(r.n_links for r in rows) == [0, 1, 1] + [23] * 24


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text, "en", "s", 1)] * 3 + [(None, text + " end", "en", "s", 1)] * 5 + [(2, " ".join(f"v{i}" for i in range(50)), "en", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        df = stage(spark, df, "")
    got = sorted(r.text for r in df.collect())
    assert len(got) == 2 and got[0].startswith("v0") and got[1] in (text, text + " end")


def test_rows_keep_their_ids(spark):
    docs = corpus() + [(None, "no id at all here", None), (None, "no id at all here", None), (3, "shares its id", None), (600, "m n o p q", None), (600, "m n o p q", None)]
    rows = jaccard_classes(spark.createDataFrame(docs, SCHEMA).repartition(6)).collect()
    assert sorted((r.id is None, r.id or 0) for r in rows) == sorted((d is None, d or 0) for d, _, _ in docs)
    want = brute(corpus())
    for r in rows:
        if r.id in want and r.id not in (3, 504):
            assert (r.n_links, r.component_id, r.kept) == want[r.id] and r.class_id in want
    assert {(r.n_links, r.component_id) for r in rows if r.id == 504} == {(1, 504)}  # 3 names two texts
    assert sorted((r.n_links, r.class_id, r.component_id, r.kept) for r in rows if r.id == 600) == [(1, 600, 600, False), (1, 600, 600, True)]
    assert sorted(r.kept for r in rows if r.id is None) == [False, True] and len({r.component_id for r in rows if r.id is None} - {None}) == 1
    assert len({r.component_id for r in rows if r.id == 3}) == 2


def test_few_texts_but_the_candidates_are_shuffled(spark, monkeypatch):
    """Texts without a near copy stay where they are, and no candidate is lost."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    docs = [(i, " ".join(word() for _ in range(60)), None) for i in range(2000)]
    docs += [(2000 + i, docs[i][1] + " end", None) for i in range(20)]
    sent, perhaps = [], jaccard_join._perhaps

    def counted(rows, ids):
        out = perhaps(rows, ids)
        sent.append({r.id for r in out.collect()})
        return out

    monkeypatch.setattr(jaccard_join, "_perhaps", counted)
    got = {r.id: r for r in jaccard_classes(spark.createDataFrame(docs, SCHEMA)).collect()}
    pairs = {*range(20), *range(2000, 2020)}
    assert {i for i, r in got.items() if r.n_links == 1} == pairs
    assert pairs <= sent[0] and len(sent[0]) < 100
