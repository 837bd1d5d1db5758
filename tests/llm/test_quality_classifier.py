import numpy as np
from pyspark.sql import functions as F

from textloom.llm.quality_classifier import _KINDS, Network, _byte_classes, _pairs, estimated_prior, features, learn, non_negative_risk, quality, trained_rows
from textloom.llm.queries import op13_quality


def made(rng, good):
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(rng.integers(20, 90))]
    if good:
        return " ".join(words).capitalize() + "."
    return " ".join(w.upper() + "!!" for w in words) if rng.random() < 0.5 else " | ".join(words) + " |"


def corpus(seed=2, n=700):
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.7
    docs = [(i, made(rng, g)) for i, g in enumerate(good)]
    labels = [(i, int(good[i])) for i in range(n) if rng.random() < 0.5]
    return docs, labels, dict(enumerate(good))


def test_pairs_match_loops():
    kinds, raws = _byte_classes(), ["aB é!".encode(), b"", b"x", b"12\n\n##"]
    want = np.zeros((4, _KINDS, _KINDS))
    for i, raw in enumerate(raws):
        for a, b in zip(raw, raw[1:]):
            want[i, kinds[a], kinds[b]] += 1
    assert (_pairs(raws).reshape(want.shape) == want).all()
    assert np.allclose(features(raws)[0], features([raws[0]])[0])


def test_risk_slope_matches_differences():
    rng = np.random.default_rng(1)
    for prior, shift in ((0.3, 0.0), (0.9, -3.0)):  # the second has a negative term below zero
        zp, zu = rng.normal(size=5) - shift, rng.normal(size=7) + shift

        def parts(zp, zu):
            return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

        below = parts(zp, zu)[1] < 0
        assert below == (shift < 0)
        risk = (lambda a, b: -parts(a, b)[1]) if below else (lambda a, b: sum(parts(a, b)))
        dp, du = non_negative_risk(prior)(zp, zu)
        step = 1e-6
        for z, d in ((zp, dp), (zu, du)):
            for i in range(len(z)):
                z[i] += step
                up = risk(zp, zu)
                z[i] -= 2 * step
                down = risk(zp, zu)
                z[i] += step
                assert abs((up - down) / (2 * step) - d[i]) < 1e-5


def test_network_gradient_lowers_the_risk():
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, (400, 5)), np.concatenate([rng.normal(1, 1, (300, 5)), rng.normal(-1, 1, (500, 5))])
    net = Network(u)
    net.fit(p, u, non_negative_risk(0.375), epochs=30)
    assert (net.probabilities(rng.normal(1, 1, (500, 5))) >= 0.5).mean() > 0.9
    assert (net.probabilities(rng.normal(-1, 1, (500, 5))) < 0.5).mean() > 0.9


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.5, 0.86):
        p = rng.normal(3, 1, 2000)
        u = np.where(rng.random(4000) < prior, rng.normal(3, 1, 4000), rng.normal(-1, 1, 4000))
        assert abs(estimated_prior(p, u) - prior) < 0.06


def test_held_out_accuracy_and_label_zero_is_not_read(spark):
    docs, labels, good = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    scored = []
    for rows in (labels, [r for r in labels if r[1]]):
        model = learn(frame, spark.createDataFrame(rows, "doc_id long, quality int"), train=trained_rows(F.col("doc_id")))
        assert abs(model.prior - 0.7) < 0.12
        scored.append({r.doc_id: (r.score, r.predicted) for r in quality(frame, model).collect()})
    assert scored[0] == scored[1]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in scored[0].values())
    assert np.mean([scored[0][i][1] == g for i, g in good.items()]) > 0.95


def test_odd_rows(spark):
    docs, labels, _ = corpus(5, 200)
    docs += [(None, None), (300, ""), (301, None), (302, "Good words " * 40_000), (0, docs[0][1]), (0, "other")]
    frame = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, Score string, row int")
    marks = spark.createDataFrame([*labels, (None, 1), (300, None), (3, 0), (3, 1)], "doc_id long, quality int")
    found = quality(frame, learn(frame, marks)).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.row == 1 for r in found)
    assert len({r.score for r in found if r.text is None or r.text == ""}) == 1
    assert {r.score for r in quality(frame, learn(frame, marks.limit(0))).collect()} == {0.5}
    assert quality(frame.limit(0), None).count() == 0


def test_query_holds_out_by_id(spark, tmp_path):
    docs, labels, good = corpus(7, 400)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = op13_quality(spark, str(tmp_path)).collect()
    assert 80 < sum(r.held_out for r in found) < 190
    assert np.mean([r.predicted == good[r.doc_id] for r in found if r.held_out]) > 0.93
