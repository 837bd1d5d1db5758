import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import hard_negatives as H
from textloom.llm.hard_negatives import Best, first_columns, hard_negatives, strassen

SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (70, 64, 131), (129, 65, 200), (3, 300, 5), (33, 17, 34)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(2**40), 2**40, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    for leaf in (2, 8, 32):
        assert (strassen(a, b, leaf) == a @ b).all()


def test_first_columns_and_merged_lists():
    rng = np.random.default_rng(5)
    score = rng.integers(-4, 4, (50, 60))
    for k in (1, 5, 70):
        found, column = first_columns(score, k)
        want = [sorted(range(60), key=lambda c: (-row[c], c))[:k] for row in score]
        assert column.tolist() == want and (found == np.take_along_axis(score, column, 1)).all()
    ids = np.broadcast_to(rng.integers(0, 30, 60), score.shape)
    row = np.broadcast_to(np.arange(60), score.shape)
    one, two = Best(50, 7), Best(50, 7)
    one.merge(score, ids, row)
    for part in (slice(40, 60), slice(0, 3), slice(3, 40)):
        two.merge(score[:, part], ids[:, part], row[:, part])
    assert (one.row == two.row).all() and (one.score == two.score).all()


def brute(rows, is_anchor, k=5, n=3, low=50, high=95, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v, l) in enumerate(ok):
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m == l) for b, (j, w, m) in enumerate(ok) if b != at and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2])[:k]:
            hard = sorted((t, c) for t, c, same in scored if not same and low * -s <= 100 * -t <= high * -s)[:n]
            out += [(i, j, rank + 1, c, -s, -t) for rank, (t, c) in enumerate(hard)]
    return sorted(out)


def made(seed=4, n=260, width=6):
    rng = np.random.default_rng(seed)
    return [(i, np.round(rng.normal(size=width) + 0.6, 1).tolist(), int(rng.choice([0, 0, 0, 1, 2, 9]))) for i in range(n)]


def test_matches_brute_force(spark):
    rows = made() + [(300, None, 0), (301, [math.nan] * 6, 0), (302, [math.inf] + [0.0] * 5, 1), (303, [None] + [0.0] * 5, 1), (304, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(310, [0.0] * 6, 1), (320, [-1.0] * 6, 1), (330, [1.0, 2.0], 0), (331, [1.0, 1.5], 0), (332, [1.0, 1.0], 4), (333, [1.0, 1.2], 4), (340, [], 0), (341, [], 0), (342, [], 3), (350, [5.0], 0)]
    got = sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()))
    want = brute(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 100


def test_small_blocks_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 300)
    monkeypatch.setattr(H, "_COLUMNS", 7)
    monkeypatch.setattr(H, "_HELD", 20)
    rows = made(9, 150) + [(400 + i, [1.0] * 6, 0) for i in range(40)] + [(500 + i, [0.5] * 6, 1) for i in range(40)] + [(7, [2.0] * 6, 0)] * 3 + [(10, [1.5] * 6, 0)]
    got = sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0)


def test_other_labels_parameters_names_and_huge_rows(spark):
    rows = [(r[0], r[1], "abc"[r[2] % 3]) for r in made(3, 120)]
    df = spark.createDataFrame(rows + [(900, [1e300] * 6, "a"), (901, [2.0**27] * 6, "b")], "k long, v array<double>, row string").withColumn("id", F.lit("clash"))
    got = sorted(map(tuple, hard_negatives(df, F.col("k") < 9, vec_id="k", vector="v", label="row", positives=2, negatives=4, window=(20, 80), scale=10).collect()))
    assert got == brute(rows, lambda i: i < 9, 2, 4, 20, 80, 10) and got


def test_no_anchors_no_rows(spark):
    df = spark.createDataFrame(made(1, 30), SCHEMA)
    for few, which in ((df, F.col("vec_id") < 0), (df.limit(0), F.lit(True)), (df.where("label = 0"), F.lit(True))):
        found = hard_negatives(few, which)
        assert found.count() == 0 and found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "4"
