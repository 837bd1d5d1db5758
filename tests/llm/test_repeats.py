import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.substring_dedup import substring_dedup
from textloom.llm.suffix_dedup import COVERS, suffix_dedup

SCHEMA = "doc_id long, text string, n_removed string"


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(3)]
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 50)))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), rng.choice(shared))
        docs.append((i, "\n".join(parts), "x"))
    base = docs[3][1].split(" ")
    for i in range(n, n + 8):  # near copies, an edit each
        w = list(base)
        w[rng.randrange(len(w))] = f"e{i}"
        docs.append((i, " ".join(w), None))
    docs += [(100, None, None), (101, "", ""), (102, "a " * 300, None), (103, "aa" * 400, None), (104, docs[3][1], None), (None, docs[5][1], None)]
    return docs


def brute_bytes(docs, length):
    rows = sorted(((-1 if d is None else d, (t or "").encode()) for d, t, _ in docs))
    seen, out = set(), {}
    for d, raw in rows:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def brute_words(docs, window):
    count, words = {}, [(d, (t or "").encode().split()) for d, t, _ in docs]
    for _, w in words:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for d, w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((-1 if d is None else d, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("seed,length", [(1, 30), (2, 100)])
def test_bytes_match_brute_force(spark, seed, length):
    docs = corpus(seed)
    got = {(-1 if r.doc_id is None else r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(spark.createDataFrame(docs, SCHEMA).repartition(5), length=length).collect()}
    assert got == brute_bytes(docs, length)


@pytest.mark.parametrize("repeat", [False, True])
def test_words_match_brute_force(spark, repeat):
    docs = corpus(3)
    if repeat:  # the same row again, and another text under a used id
        docs += [docs[7], (8, docs[0][1], None)]
    found = substring_dedup(spark.createDataFrame(docs, SCHEMA).repartition(5), window=12)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect())
    assert got == brute_words(docs, 12)
    assert found.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text"]


def test_tiny_sketch_changes_nothing(spark):
    docs = corpus(4)
    df = spark.createDataFrame(docs, SCHEMA)
    import textloom.llm.sketches as sketches

    real = sketches.fitting_bits
    try:
        sketches.fitting_bits = lambda *a: 10  # nearly every window is estimated repeated
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=12).collect())
        assert got == brute_words(docs, 12)
    finally:
        sketches.fitting_bits = real


def test_every_difference_meets_in_the_cover():
    for v, on in COVERS.items():
        assert {(a - b) % v for a in on for b in on} == set(range(v))


@pytest.mark.parametrize("length,block,bucket", [(40, 1000, 300), (100, 1, 50), (3, 1 << 19, 100), (1, 500, 1 << 19)])
def test_bytes_in_many_blocks_and_buckets(spark, length, block, bucket):
    docs = corpus(6)
    text = docs[3][1] + docs[9][1]
    docs += [(200 + i, text[i % 7 :] + "z" * (i % 3), None) for i in range(12)]  # copies in step with the cover or not
    found = suffix_dedup(spark.createDataFrame(docs, SCHEMA).repartition(3), length=length, block=block, bucket=bucket)
    assert {(-1 if r.doc_id is None else r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()} == brute_bytes(docs, length)


def test_bytes_of_repeated_rows_and_ids(spark):
    docs = [(1, "q w e r t y " * 20, "a"), (1, "q w e r t y " * 20, "b"), (1, "other " * 30, "c"), (2, "q w e r t y " * 20, None), (None, None, None)]
    found = suffix_dedup(spark.createDataFrame(docs, SCHEMA), length=30)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in found.collect())
    assert got == [(0, 0, 0), (1, 180, 174), (1, 240, 228), (1, 240, 228), (2, 240, 240)]
    assert found.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept"]


def agreeing(spark, bits=31):
    """Two different texts, the second longer, whose 64-bit hashes agree in so many low bits."""
    text = F.concat(F.lit("row "), F.col("id").cast("string"), F.repeat(F.lit(" of one id"), 12 + F.col("id") % 2 * 20))
    low = F.xxhash64("text").bitwiseAND(F.lit((1 << bits) - 1))
    rows = spark.range(250_000).select("id", text.alias("text")).withColumn("low", low)
    one = rows.where("id % 2 = 0").select("low", F.col("text").alias("a"))
    pair = one.join(rows.where("id % 2 = 1").select("low", F.col("text").alias("b")), "low").orderBy("low").first()
    return pair.a, pair.b


@pytest.mark.parametrize("shared", [None, 7])
def test_rows_of_one_id_whose_hashes_agree(spark, shared):
    a, b = agreeing(spark)
    docs = [(shared, a, None), (shared, b, None), (9, b, None)]
    df = spark.createDataFrame(docs, SCHEMA)
    words = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=12).collect()]
    assert sorted(words) == brute_words(docs, 12)
    got = {(r.doc_id, r.text): bytes(r.kept) for r in suffix_dedup(df, length=100).collect()}
    orders = [brute_bytes([(i, d[1], None) for i, d in enumerate(o)], 100) for o in (docs, [docs[1], docs[0], docs[2]])]
    assert [got[shared, a], got[shared, b], got[9, b]] in ([orders[0][i][3] for i in (0, 1, 2)], [orders[1][i][3] for i in (1, 0, 2)])


def test_many_texts_of_one_id(spark):
    rng = random.Random(5)
    docs = [(None, " ".join(rng.choice("abcdefgh") for _ in range(60)), None) for _ in range(200)]
    docs += [(None, d[1] + " tail", None) for d in docs[:40]]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = sorted((-1, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=12).collect())
    assert got == brute_words(docs, 12)
    found = suffix_dedup(df, length=40).collect()
    assert len(found) == 240 and sum(r.n_removed for r in found) >= 40 * 119


def test_wide_ids(spark):
    docs = [(-(2**62), "x y " * 40, None), (2**62, "x y " * 40, None), (5, "q" * 130, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute_bytes(docs, 100)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0


def test_digest_is_of_kept_words(spark):
    row = substring_dedup(spark.createDataFrame([(1, " a\tb  c ", None)], SCHEMA)).first()
    assert row.kept_text == "a b c" and hashlib.sha256(b"a b c").hexdigest()
