import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.sequences import common_lengths, difference, overlap
from textloom.operators import pages as P
from textloom.operators import retrieval as R


def table(a, b):
    out = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + 1, j + 1] = out[i, j] + 1 if x == y else max(out[i, j + 1], out[i + 1, j])
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz"])
def test_difference_matches_the_table(letters):
    rng = random.Random(len(letters))
    for _ in range(300):
        a = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        b = [rng.choice(letters) for _ in range(rng.randint(0, 40))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        full = table(a, b)
        assert common_lengths(a, b).tolist() == full[-1].tolist()
        shared, first = difference(a, b)
        assert shared == full[-1, -1] and (first is None) == (a == b)
        if first:
            lo, hi = first
            assert a[:lo] == b[:lo] and lo <= hi <= len(a)
            # some longest common subsequence goes on with the word after the difference
            best = max((table(a[hi + 1 :], b[j + 1 :])[-1, -1] + 1 for j in range(lo, len(b)) if hi < len(a) and a[hi] == b[j]), default=0)
            assert lo + best == shared


def test_long_pairs_end_in_time():
    rng = random.Random(4)
    a = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(20_000)]
    b = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(20_000)]
    began = time.time()
    shared, first = difference(a, b)
    assert 0 < shared < 20_000 and first[0] == 0 and time.time() - began < 20
    assert difference(["w"] * 30_000, ["w"] * 29_999 + ["x"]) == (29_999, (29_999, 30_000))


def test_overlap_matches_brute_force():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert overlap(a, b) == max((n for n in range(min(len(a), len(b)) + 1) if a.endswith(b[:n])), default=0)
    assert overlap("x" + "a" * 100_000, "a" * 100_000 + "b") == 100_000


def test_pages_keep_every_row(spark):
    html = "<html><title>T</title><body><main><h1>Head</h1><p>some words here</p></main></body></html>"
    rows = [(1, "https://a.b/x", html), (1, "https://a.b/y", html), (1, "https://a.b/x", html), (None, "https://a.b/z", html), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for found in (P.extract_pages(pages).collect(), P.extract_articles(pages).collect()):
        assert sorted(str(r.page_id) for r in found) == ["1", "1", "1", "2", "None"]
    assert sorted(str(r.url) for r in P.extract_pages(pages).collect()) == ["None", "https://a.b/x", "https://a.b/x", "https://a.b/y", "https://a.b/z"]


def test_keywords_of_any_number(spark):
    words = [(f"key{i}", f"K{i}", i) for i in range(3000)] + [("é", "short", 5000), ("ab", "two", 4000), (" ", "blank", 0), (None, "null", 0), ("KEY7", "again", 7), ("ey1", "inner", 2)]
    texts = [(1, "has KEY2999 and key30"), (2, "é"), (3, "ab"), (4, None), (5, "nothing"), (6, "key7"), (6, "key7"), (7, ""), (8, "ey" * 20_000)]
    found = R.first_keyword_match(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(words, "keyword string, name string, priority int"), ("id",))
    got = sorted(tuple(r) for r in found.collect())
    low = lambda s: (s or "").lower()
    want = [(i, min(((p, n) for k, n, p in words if k and k.strip() and low(k) in low(t)), default=(0, "none"))[1]) for i, t in texts]
    assert got == sorted(want)
    assert R.first_keyword_match(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "keyword string, name string, priority int"), ("id",)).where("match <> 'none'").count() == 0


def test_tiles_give_what_one_lot_gives(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).round(1).tolist(), 0) for i in range(90)] + [(200, [1.0, 2.0], 0), (201, [2.0, 1.0], 0), (202, None, 0), (203, [0.0] * 5, 0)] + [(300 + i, [1.0] * 5, 1) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asks = vectors.where("vec_id % 10 = 0")
    import textloom.operators.tiles as tiles

    kept, tiles.BLOCK = tiles.BLOCK, 16
    try:
        few, many = (sorted(map(tuple, R.dense_topk(vectors, asks, 4, most=m).collect())) for m in (1 << 21, 0))
    finally:
        tiles.BLOCK = kept
    assert [r[:3] + r[4:] for r in few] == [r[:3] + r[4:] for r in many] and len(few) > 40
