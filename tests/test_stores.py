import tempfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import index as X
from textloom.operators import retrieval as R
from textloom.sources import files, folders
from textloom.sources.snapshots import FIELDS, ChunkStore, ingest_single_document


@pytest.fixture
def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def test_snapshots(spark, folder):
    store = ChunkStore(spark, f"{folder}/s")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id string, text string")
    cut = lambda d: R.fixed_chunk(d, 4)
    texts = lambda v=None: sorted((r.document_id, r.chunk_index, r.text) for r in store.chunks(v).collect())
    assert store.version() == 0 and texts() == []
    assert store.replace(docs([("a", "one two three"), ("b/c", "kept"), ("e", ""), (None, "x"), ("d", "q"), ("d", "p")]), cut) == 1
    before = texts()
    assert [t for t in before if t[0] == "a"] == [("a", 0, "one "), ("a", 1, "two "), ("a", 2, "thre"), ("a", 3, "e")]
    data = set(folders.names(spark, f"{folder}/s/data"))
    assert store.replace(docs([("a", "new")]), cut) == 2  # a shorter version leaves no tail
    assert [t for t in texts() if t[0] == "a"] == [("a", 0, "new")] and [t for t in texts() if t[0] != "a"] == [t for t in before if t[0] != "a"]
    assert data < set(folders.names(spark, f"{folder}/s/data"))  # other documents' files are as they were
    assert store.replace(docs([("a", "new"), ("b/c", "kept")]), cut) == 2 and texts(1) == before
    assert store.delete(docs([("nobody", "")])) == 2 and store.delete(docs([("b/c", "")])) == 3
    now = texts()
    assert {t[0] for t in now} == {"a", "d"}
    assert store.compact() == 4 and texts() == now and len(store._entries()) == 1
    spark.createDataFrame([("a", 9, "a__chunk_9", "stray")], "document_id string, chunk_index int, chunk_id string, text string").write.parquet(f"{folder}/s/data/lost/chunks")
    assert texts() == now  # what no log entry names isn't read
    assert not folders.create(spark, f"{folder}/s/log/00000004", "{}") and store.replace(docs([("e", "back")]), cut) == 5


def test_ingest_single_document(spark, folder):
    store = ChunkStore(spark, folder, FIELDS)
    assert ingest_single_document(store, " one ", "---\ntitle: \"A: b\"\nsource_url: 'u'\n---\n\nSome body.\n\n") == 1
    row = store.chunks().first()
    assert (row.document_id, row.text, row.title, row.source, row.source_url) == ("one", "Some body.", "A: b", "ui/one", "u")
    assert ingest_single_document(store, "two", "word " * 300, "mine", 100, 20) > 5
    assert ingest_single_document(store, "two", "short", "mine") == 1 and store.chunks().where("document_id = 'two'").count() == 1
    last = store.version()
    ingest_single_document(store, "two", "short", "mine")
    assert store.version() == last
    for name, text in ((" ", "x"), (None, "x"), ("x", " ​\n"), ("x", None), ("x", "---\na: b\n---\n")):
        with pytest.raises(ValueError):
            ingest_single_document(store, name, text)


def test_index_gives_the_rows_of_scoring_everything(spark, folder):
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[(i * j) % 60] for j in range(1, 2 + i % 25)) + (" rare" if i % 97 == 0 else "")) for i in range(600)] + [(900, None), (901, "")]
    asks = [(1, "w1 w2 w2 rare"), (2, "w7"), (3, "unknown"), (4, None), (5, "w0 w30 rare rare w59")]
    chunks, queries = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asks, "q long, text string")
    assert X.current(spark, folder) is None
    assert X.build_index(chunks, "id", folder, block=16) == {"documents": 602, "stored_before": 0}
    rounded = lambda df: sorted((r.q, r.id, round(r.score, 9), r["rank"]) for r in df.collect())
    for k, first in ((3, 1), (10, 4), (1000, 2)):
        assert rounded(X.index_topk(spark, folder, queries, "q", "id", k, first)) == rounded(R.bm25_topk(chunks, "id", queries, "q", k))
        assert rounded(X.index_topk(spark, folder, queries, "q", "id", k, first, most=0)) == rounded(X.index_topk(spark, folder, queries, "q", "id", k))
    plan = X.index_topk(spark, folder, queries, "q", "id", 3)._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and plan.count("MapInPandas") >= 1
    counts = {r.q: (r.blocks, r.scored) for r in X.block_counts(spark, folder, queries, "q", 3, 1).collect()}
    assert all(0 < s <= b for b, s in counts.values()) and any(s < b for b, s in counts.values())
    assert X.build_index(chunks.limit(5), "id", folder)["stored_before"] == 602
    with pytest.raises(ValueError):
        X.build_index(chunks.where("id >= 900"), "id", folder)
    assert X.current(spark, folder)["documents"] == 5


def scopes(spark):
    rows = [(1, ["a", " b "], ["a"]), (2, [], []), (3, None, [" c", ""]), (4, None, None), (5, [" "], ["a"]), (6, ["zz"], None)]
    return spark.createDataFrame(rows, "q long, include array<string>, exclude array<string>")


WANT = {1: {"a", "b"}, 2: {"a", "b", "c", "d", None}, 3: {"a", "b", "d", None}, 4: {"a", "b", "c", None}, 5: {"a", "b", "c", "d", None}, 6: set(), 7: {"a", "b", "c", None}}


def test_scopes_limit_before_the_cut(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 3) + f"t{i}", "abcd"[i % 5] if i % 5 < 4 else None) for i in range(200)], "id long, text string, g string")
    queries = spark.createDataFrame([(i, "word") for i in WANT], "q long, text string")
    scope = R.Scope(scopes(spark), "g", ("d",))
    group = {r.id: r.g for r in docs.collect()}
    full = {r.id: r for r in R.bm25_topk(docs, "id", queries.limit(1), "q", 500).collect()}
    for most in (1 << 21, 0):
        found = R.bm25_topk(docs, "id", queries, "q", 5, most, scope).collect()
        for q, groups in WANT.items():
            mine = sorted((r["rank"], r.id) for r in found if r.q == q)
            assert [i for _, i in mine] == sorted((i for i in full if group[i] in groups), key=lambda i: full[i]["rank"])[:5]


def test_dense_scopes(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 50.0, 1.0], 0, "abcd"[i % 5] if i % 5 < 4 else None) for i in range(120)], "vec_id long, embedding array<double>, label int, g string")
    asks = vectors.where("vec_id between 1 and 7")
    scope = R.Scope(scopes(spark).withColumnRenamed("q", "query_id"), "g", ("d",))
    group = {r.vec_id: r.g for r in vectors.collect()}
    whole = {}
    for r in R.dense_topk(vectors, asks, 500).collect():
        whole.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for most in (1 << 21, 0):
        found = R.dense_topk(vectors, asks, 5, scope, most).collect()
        for q, groups in WANT.items():
            assert sorted((r["rank"], r.vec_id) for r in found if r.query_id == q) == [(n + 1, v) for n, (_, v) in enumerate(x for x in sorted(whole[q]) if group[x[1]] in groups)][:5]


def test_sitemaps_keep_the_last_entry(spark, folder):
    local = folder.removeprefix("file://")
    with open(f"{local}/a.xml", "w") as f:
        f.write("<urlset><url><loc>u1</loc><lastmod>2025</lastmod></url><url>\n<loc> u1 </loc><lastmod>2024</lastmod></url><!-- <url><loc>no</loc></url> --><url><loc>u?a=1&amp;b=2</loc></url><url><loc/></url></urlset>")
    with open(f"{local}/b.xml", "w") as f:
        f.write("<sitemapindex><sitemap><loc>u3</loc></sitemap><sitemap><loc>u1</loc></sitemap></sitemapindex>")
    read = lambda p: {tuple(r) for r in files.parse_sitemap(spark, p).collect()}
    assert read(f"{local}/a.xml") == {("u1", "2024"), ("u?a=1&b=2", None)} and read(f"{local}/b.xml") == {("u3", None), ("u1", None)}
    assert read(f"{local}/*.xml") == {("u1", None), ("u?a=1&b=2", None), ("u3", None)}


def test_front_matter_loses_quotes_and_blank_ends(spark):
    text = "---\ntitle: \"Foo: x\"\nid: 'it''s'\n---\n\n body\n\n"
    fields, body = files.parse_front_matter(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(fields.alias("f"), body.alias("b")).first()
    assert row.f == {"title": "Foo: x", "id": "it''s"} and row.b == "body"
