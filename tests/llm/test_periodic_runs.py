import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.periodic_runs import dropped, lag_classes, periodic_runs, runs_of, strongest
from textloom.llm.queries import op11_periodic_runs


def brute_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, times * q) and not any(all(w[x] == w[x + d] for x in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_words(rng, kind):
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 150))]
    if kind == 1:
        units = [[rng.choice("abc") for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 4))]
        return [x for u in units for x in u * rng.randint(1, 5) + u[: rng.randint(0, len(u))]]
    if kind == 2:  # every gram of such a unit occurs in it more than once
        loops = ["c"], ["d"] + ["c"] * rng.randint(3, 16)
        u = [x for _ in range(rng.randint(2, 5)) for x in rng.choice(loops)]
        return u * rng.randint(2, 5) + u[: rng.randint(0, len(u))]
    u = [rng.choice("ab")] * rng.randint(1, 20) + [rng.choice("abc") for _ in range(rng.randint(0, 20))]
    return (u + u[:5]) * rng.randint(1, 4)


@pytest.mark.parametrize("kind", range(4))
def test_runs_match_brute_force(kind):
    rng, found = random.Random(kind), 0
    for _ in range(300):
        w = made_words(rng, kind)
        ids = np.array([ord(x) for x in w], np.int64)
        for least, times in ((24, 3), (8, 3), (10, 4)):
            want = brute_runs(w, least, times)
            assert runs_of(ids, least, times) == want, w
            found += len(want)
    assert found > 50


def test_lag_classes_guarantee_their_grams():
    assert list(lag_classes(300, 24, 3)) == [(1, 16, 16), (17, 34, 34), (35, 70, 70), (71, 142, 142)]
    for least, times in ((24, 3), (2, 3), (100, 5)):
        last = 0
        for lo, hi, k in lag_classes(5000, least, times):
            assert lo == last + 1 and hi == k and all(max(least, times * q) - q >= k for q in range(lo, hi + 1))
            last = hi
        assert last * times >= 5000 - times or (last + 1) * times > 5000


def test_long_documents_take_one_pair_a_run():
    assert runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert runs_of(np.tile(np.arange(1000), 300)) == [(0, 300_000, 1000)]


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    gone = dropped(len(w), runs)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for x, g in zip(w, gone) if not g)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["aé", "b", "c\x0bd", "longer"]) for _ in range(rng.randint(0, 400)))) for i in range(120)]
    rows += [(200 + i, "\n".join(made_words(rng, i % 4))) for i in range(80)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "x " * 500), (None, "y " * 40), (303, "x " * 500), (304, "aa bb " * 3000)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = sorted(map(tuple, op11_periodic_runs(spark, path).collect()), key=str)
    assert got == sorted((brute_row(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 40


def test_clashing_names_empty_table_and_order(spark):
    schema = "runs string, text string, Collapsed int, row int, found string"
    docs = spark.createDataFrame([("x", "u v " * 30 + "w " * 24, 1, 2, "f")], schema)
    got = periodic_runs(docs).collect()
    assert got[0]["row"] == 2 and got[0]["found"] == "f" and got[0]["n_words"] == 84
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 60, 2), (60, 24, 1)] and got[0]["collapsed"] == "u v w"
    best = periodic_runs(docs).select(strongest(F.col("runs")).alias("b")).first()["b"]
    assert tuple(best) == (0, 60, 2)
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, times=2)
