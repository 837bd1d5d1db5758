import math

import numpy as np
from pyspark.sql import functions as F

from textloom.llm.ann_search import ann_search
from textloom.llm.embedding_dedup import embedding_dedup
from textloom.llm.language_id import language_id, learn, trained_rows
from textloom.llm.mixing import mix_sources
from textloom.llm.url_filter import url_filter


def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist(), int(i % 3)) for i in range(150)]
    rows += [(150 + i, (np.array(rows[6][1]) + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(60)]
    rows += [(300, rows[0][1], 0), (301, [2 * x for x in rows[0][1]], 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [math.nan] * 16, 1), (305, rows[0][1], None), (306, [math.inf] + [1.0] * 15, 1)]
    return rows


def test_embedding_dedup_matches_brute_force(spark):
    rows = vectors()
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, l in rows if v and l is not None and np.isfinite(v).all() and np.any(v)}
    label = {i: l for i, _, l in rows}
    links = {i: {j for j in ok if i in ok and j != i and label[i] == label[j] and ok[i] @ ok[j] >= 0.93} for i, _, _ in rows}
    low = {i: i for i in links}
    for _ in links:
        low = {i: min([low[i], *(low[j] for j in links[i])]) for i in links}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (len(links[i]), low[i], low[i] == i) for i in links}


def test_audit_in_lots_and_with_negative_ids(spark, monkeypatch):
    """Ids -1 and -2 are ids like others, and lots give the counts of one lot."""
    from textloom.llm import embedding_dedup as E

    unit = [(i - 4, [1.0, i / 100, 0.0], "a") for i in range(6)] + [(50, [0.0, 0.0, 1.0], "a"), (51, [0.0, 0.1, 1.0], "b")]
    classes = spark.createDataFrame([(*r, None) for r in unit], "id long, vec array<double>, label string, whole long")
    links = spark.createDataFrame([(-1, -2), (-4, 1)], "a long, b long")
    for size in (64 << 20, 48):
        monkeypatch.setattr(E, "AUDIT_BYTES", size)
        recall, short = E._audit(links, classes, 0.93)
        assert (recall, short) == (2 / 30, ["a"])
        held = classes.withColumn("whole", F.when(F.col("id") <= 1, F.lit(-1)).cast("long"))
        assert E._audit(links, held, 0.93) == (1.0, [])


def test_ann_recall_and_ties(spark):
    rows = vectors()
    found = ann_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 10 == 0)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and np.isfinite(v).all() and np.any(v)}
    hit = total = 0
    for q in (i for i in ok if i % 10 == 0):
        want = sorted((-round(float(ok[q] @ ok[j]), 9), j) for j in ok if j != q)[:5]
        hit += len({j for _, j in want} & {j for _, j, _ in got[q]})
        total += 5
    assert hit / total >= 0.9 and [r for r, _, _ in sorted(got[0])] == [1, 2, 3, 4, 5]
    assert [j for _, j, _ in sorted(got[0])][:3] == [300, 301, 305]


def test_ann_near_copies_whose_codes_are_alike(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x[:667] = rng.normal(size=64) + 1e-4 * rng.normal(size=(667, 64))
    x = rng.permutation(x)
    found = ann_search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2000, 50):
        s = x @ x[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / (5 * 40) >= 0.97


def test_ann_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(40)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(4)] + [(200, [1.0])]
    rows += [(0, [9.0] * 8), rows[1], rows[1], (None, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann_search(df, F.col("vec_id") % 50 == 0).collect())
    cosine = lambda v, w: float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
    want = []
    for a, (i, v) in enumerate(rows):
        if i is not None and i % 50 == 0:
            others = [(-cosine(v, w), j) for b, (j, w) in enumerate(rows) if b != a and j is not None and len(w) == len(v)]
            want += [(i, n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(sorted(others)[:5])]
    assert got == sorted(want) and {q for q, *_ in got} == {0, 100}


def test_ann_cells_grow_with_the_corpus():
    from textloom.llm.ann_search import Index

    x = np.random.default_rng(2).normal(size=(900, 16))
    index = Index(x, 240)
    assert len(index.coarse) == 240 and index.encode(x)[0].max() > 30 and 1 <= index.probes <= 240


def test_embedding_dedup_any_label_and_repeated_rows(spark):
    v, w = [1.0, 0.0, 2.0], [1.0, 0.01, 2.0]
    rows = [(1, v, "a"), (1, v, "a"), (2, w, "a"), (3, v, "b"), (1, [0.0, 1.0, 0.0], "b"), (None, v, "a"), (4, [1.0, 2.0], "a"), (5, None, None)]
    for kind in ("string", "double"):
        data = [(i, x, l if kind == "string" or l is None else {"a": 1.2, "b": 1.7}[l]) for i, x, l in rows]
        got = embedding_dedup(spark.createDataFrame(data, f"vec_id long, embedding array<double>, label {kind}")).collect()
        assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
        assert all(r.audited_recall == 1.0 for r in got)


def test_mixing_ties_at_the_cut(spark):
    docs = [(None, "w w w", "a")] * 40 + [(7, "v v", "b")] * 3 + [(i, "x " * (i % 4), "c") for i in range(20)]
    found = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    by = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 40 for taken, target in by.values())


def test_network_matches_loops():
    from textloom.llm.language_id import EMBED, FILTERS, LENGTH, WIDTHS, ByteCNN

    net = ByteCNN(["aa", "bb", "cc"])
    x = np.random.default_rng(1).integers(0, 256, (3, LENGTH)).astype(np.uint8)
    p, want = net.p, []
    for row in x:
        pooled = []
        for f in range(FILTERS * len(WIDTHS)):
            width = WIDTHS[f // FILTERS]
            best = -1e9
            for at in range(LENGTH - max(WIDTHS) + 1):
                best = max(best, sum(float(p["embed"][row[at + j], e]) * float(p["conv"][j * EMBED + e, f]) for j in range(width) for e in range(EMBED)))
            pooled.append(max(0.0, best + float(p["bias"][f])))
        z = np.array([sum(h * float(p["out"][f, c]) for f, h in enumerate(pooled)) + float(p["prior"][c]) for c in range(3)])
        want.append(np.exp(z) / np.exp(z).sum())
    assert np.abs(net.probabilities(x) - np.array(want)).max() < 1e-4


def test_network_step_lowers_the_loss():
    from textloom.llm.language_id import LENGTH, ByteCNN

    rng = np.random.default_rng(3)
    y = np.arange(80) % 2
    x = np.where(y[:, None] == 1, rng.integers(97, 110, (80, LENGTH)), rng.integers(105, 122, (80, LENGTH))).astype(np.uint8)
    net = ByteCNN(["aa", "bb"])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(80), y]).mean()
    first = loss()
    net.fit(x, y, epochs=1, batch=80, rate=1e-3)
    assert loss() < first
    net.fit(x, y, epochs=8, batch=8)
    assert loss() < 0.2


def test_language_id_of_nothing_and_clashes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, score int")
    assert learn(empty, trained_rows(F.col("doc_id"))) is None and language_id(empty, None).count() == 0
    docs = [(1, "the cat", "aa", 3), (1, "the cat", "aa", 3), (3, "der hund", "bb", 4)]
    df = spark.createDataFrame(docs, empty.schema)
    found = language_id(df, learn(df, F.lit(True)))
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and found.count() == 3


def test_url_filter_of_nothing_and_clashes(spark):
    empty = spark.createDataFrame([], "page_id long, url string, verdict int")
    assert url_filter(empty).count() == 0
    rows = [(1, "http://h/poker-free", 5), (1, "http://h/poker-free", 5), (2, "http://h/poker", 6), (3, "http://h/" + "a/" * 50000 + "casino", 7)]
    found = url_filter(spark.createDataFrame(rows, empty.schema))
    assert found.columns[:2] == ["page_id", "url"] and sorted(r.verdict for r in found.collect()) == ["allow", "block", "block", "block"]


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert ann_search(empty, F.col("vec_id") % 50 == 0).count() == 0 and embedding_dedup(empty).count() == 0


def test_mixing_reaches_targets(spark):
    docs = [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 5 else None, "x") for i in range(300)] + [(400, None, "s1", "x"), (401, "", "tiny", "x")]
    found = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string, target string"))
    assert found.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    by = {}
    for r in found.collect():
        assert 0 <= r.taken <= 2 * r.size
        t = by.setdefault(r.source, [0, 0, r.target])
        t[0] += r.taken
        t[1] += r.size
    assert all(abs(taken - target) <= 1 for taken, _, target in by.values())
    assert abs(sum(t[2] for t in by.values()) - 1.5 * sum(t[1] for t in by.values())) < 1e-6
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_language_id(spark):
    words = {"aa": "the of and", "bb": "der die das"}
    docs = [(i, words["aa" if i % 2 else "bb"] * (1 + i % 50), "aa" if i % 2 else "bb") for i in range(200)] + [(500, None, "aa"), (501, "12 !", "aa"), (502, "the and of " * 9000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(df, learn(df, trained_rows(F.col("doc_id")))).collect()}
    assert got[500] == ("und", 0.0) == got[501] and got[502][0] == "aa"
    assert sum(got[i][0] == l for i, _, l in docs[:200]) >= 195
    assert language_id(df, None).where("lang_pred != 'und'").count() == 0


def test_url_filter(spark):
    urls = [None, "no scheme", "HTTP://Net/x", "http://a.net", "http://a.net/", "https://www.example.net/en/1?q", "http://de.example.com/de/a#b", "http://x.org/fr/", "http://xnet/", "http://h/free-poker", "http://h/freepoker", "http://h/a_xxx.html", "http://h/sexxxy"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").coalesce(1)).collect()]
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("net", "/x", "net/", "block") and got[3] == ("a.net", "", None, "allow") and got[4][2:] == ("net/", "block")
    assert got[5][2:] == ("example.net/en/", "allow") and got[6][1:] == ("/de/a", "example.com/de/", "block") and got[7][2:] == ("org/fr/", "allow")
    assert [g[3] for g in got[8:]] == ["allow", "block", "allow", "block", "allow"]


def _lonely_pairs(labels, each, seed=8):
    """Pairs of cosine about 0.94 without other near neighbours."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(labels * each, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.94 * x + math.sqrt(1 - 0.94**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    return [(2 * i + j, v[i].tolist(), i % labels) for i in range(len(x)) for j, v in enumerate((x, y))]


def test_embedding_dedup_first_trees_go_by_label(spark):
    from textloom.llm.embedding_dedup import _graph

    rows = _lonely_pairs(20, 60)  # 120 vectors a label: one bucket
    df = spark.createDataFrame(rows, "id long, vec array<double>, label long")
    assert _graph(df, range(1), 0.6, 32).where("a % 2 = 0 and b = a + 1").count() == len(rows) // 2


def test_embedding_dedup_compares_short_labels_exactly(spark):
    rows = _lonely_pairs(2, 700)
    found = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), trees=1, most_trees=1)
    assert found.where("n_links = 1 and component_id = vec_id - vec_id % 2").count() == len(rows)


def test_embedding_dedup_local_join(spark):
    """Members meet at their centre once, whatever the cut of batches; those that met before or don't ask stay out."""
    from textloom.llm.common import batches_of
    from textloom.llm.embedding_dedup import _local

    rng = np.random.default_rng(5)
    rows = [(c, c * 10 + i, bool(i % 3), i % 2 == 0, rng.normal(size=4 + c % 2).tolist()) for c in range(23) for i in range(1 + c % 7)]
    unit = {i: np.array(v) / np.linalg.norm(v) for _, i, _, _, v in rows}
    want = set()
    for centre in range(23):
        members = [r for r in rows if r[0] == centre]
        for _, a, asks, met, _ in members:
            near = sorted((-float(unit[a] @ unit[b]), b) for _, b, _, was, _ in members if b != a and not (met and was))[:2]
            want |= {(a, b) for s, b in near if asks and -s >= 0.1}
    with batches_of(spark, 5):
        got = _local(spark.createDataFrame(rows, "centre long, id long, asks boolean, met boolean, vec array<double>"), 0.1, 2).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.sim - unit[r.a] @ unit[r.b]) < 1e-12 for r in got)
