import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators.chunking import chunk_size_sweep, cut, lots, recursive_chunk
from textloom.operators.metering import rate_limit, trace_checks
from textloom.operators.structure import structure_chunk
from textloom.sources import files
from textloom.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def brute_limit(rows, limit, seconds):
    out, kept = {}, {}
    for tie, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        recent = [x for x in kept.get(key, []) if t - x <= seconds]
        out[tie] = len(recent) < limit
        kept[key] = recent + [t] * out[tie]
    return out


def requests(seed=3, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice("aaab"), rng.randrange(0, 900)) for i in range(n)]


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))


def test_cut_keeps_every_word_and_the_size():
    text = "\n\n".join("one two three. " * n for n in (1, 5, 40)) + "x" * 500
    chunks = list(cut(text, 80, 20))
    assert max(map(len, chunks)) <= 80
    assert "".join("".join(c.split()) for c in cut(text, 80, 0)) == "".join(text.split())
    assert list(cut("a b", 80, 20)) == ["a b"] and list(cut("  \n\n ", 80, 20)) == []


def test_recursive_chunk(spark):
    docs = spark.createDataFrame([("a/b", "word " * 400), ("e", ""), ("n", None)], "doc_id string, text string")
    rows = recursive_chunk(docs, 100, 500).collect()
    assert {r.document_id for r in rows} == {"a_b"} and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert rows[0].chunk_id == "a_b__chunk_0"
    assert {r.config_id for r in chunk_size_sweep(docs).collect()} == {100, 500}


def test_rate_limit(spark):
    rows = requests()
    got = {r.id: r.accepted for r in rate_limit(events(spark, rows), "k", "ts", "id", 5, 60).collect()}
    assert got == brute_limit(rows, 5, 60) and not all(got.values())


def test_trace_checks(spark):
    schema = "trace_id int, answer string, tool_calls array<string>, is_refusal boolean, used_web boolean, n_chunks int, expected string, actual string"
    rows = [
        (1, "see [a](b)", ["search_doc"], False, False, 3, "answer", " Answer"),
        (2, "no link", ["search_doc"], False, False, 3, "answer", "answer"),
        (3, "No.", [], True, False, 0, "refuse", "refuse"),
        (4, "Web: [a](b)", ["web_search"], False, True, 0, "answer", "web"),
        (5, None, None, None, None, None, None, None),
    ]
    found = {r.trace_id: r for r in trace_checks(spark.createDataFrame(rows, schema), "Web:").collect()}
    assert [found[i].passed for i in range(1, 6)] == [True, False, True, False, False]
    assert not found[2].citation_present and not found[4].outcome_appropriate and not found[5].used_tool


def test_files(spark, folder):
    with open(f"{folder}/a.md", "w") as f:
        f.write("---\ntitle: T: x\nno colon\ndocument_id: one\ntitle: U\n---\nBody\n")
    with open(f"{folder}/b.md", "w") as f:
        f.write("---\nopen\nBody")
    with open(f"{folder}/c.TXT", "w") as f:
        f.write("plain")
    with open(f"{folder}/d.txt", "w") as f:
        f.write("  ")
    got = {tuple(r) for r in files.scan_corpus(spark, folder).collect()}
    assert got == {("one", "U", "", "Body"), ("b", "b", "", "---\nopen\nBody"), ("c", "c", "", "plain")}
    assert files.scan_corpus(spark, f"{folder}/none").count() == 0
    rows = spark.createDataFrame([(1, "é\n", None)], "a int, b string, c string")
    files.write_jsonl(rows, f"{folder}/out")
    assert files.read_jsonl(spark, f"{folder}/out", "a int, b string, c string").collect() == rows.collect()
    assert files.read_jsonl(spark, f"{folder}/none", "a int").count() == 0
    with open(f"{folder}/q.json", "w") as f:
        f.write('[{"id": 1},\n {"id": 2}]')
    assert files.read_json_array(spark, f"{folder}/q.json", "id int").count() == 2
    with open(f"{folder}/s.xml", "w") as f:
        f.write("<urlset><url><loc>u1</loc><lastmod>2024</lastmod></url><url><loc>u1</loc></url><url><loc>u2</loc></url></urlset>")
    assert {tuple(r) for r in files.parse_sitemap(spark, f"{folder}/s.xml").collect()} == {("u1", None), ("u2", None)}  # the last entry of a url counts


def test_rate_limit_cuts_keys_at_gaps(spark):
    from textloom.operators.metering import client_key, islands

    rows = [(i, "hot", (i // 30) * 1000 + i % 30) for i in range(900)] + [(2000 + i, None, 5 * i) for i in range(50)] + [(3000, "edge", 0), (3001, "edge", 60), (3002, "edge", 121)]
    df = events(spark, rows)
    got = {r.id: r.accepted for r in rate_limit(df.unionByName(events(spark, [(9999, "hot", None)])), "k", "ts", "id", 5, 60).collect()}
    assert not got.pop(9999) and got == brute_limit(rows, 5, 60)
    cut = islands(df.select("id", "k", F.unix_micros("ts").alias("t")), "k", "t", 60_000_000)
    numbers = {r.k: r.n for r in cut.groupBy("k").agg(F.countDistinct("island").alias("n")).collect()}
    assert numbers == {"hot": 30, None: 1, "edge": 2}
    spread = cut.where("k = 'hot'").repartition(8, "k", "island").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread >= 6  # a hot key with gaps uses many tasks
    asks = spark.createDataFrame([(" i1 ", "9.9.9.9", "h"), ("", " 1.2.3.4 , 5.6.7.8", "h"), (None, " ", "h"), (None, None, " ")], "i string, f string, h string")
    assert [r[0] for r in asks.select(client_key(F.col("i"), F.col("f"), F.col("h"))).collect()] == ["i1", "ip:1.2.3.4", "ip:h", "ip:unknown"]


@pytest.fixture
def rocksdb(spark):
    key, value = jobs.ROCKSDB
    spark.conf.set(key, value)
    yield
    spark.conf.unset(key)


def test_stream_rate_limit_orders_across_batches(spark, folder, rocksdb):
    """Shuffled arrival over many micro-batches gives the batch result; a late event is dropped."""
    rng = random.Random(3)
    rows = sorted(requests(3, 300), key=lambda r: r[2] + rng.randrange(0, 300))
    schema = "id long, k string, s long, ts timestamp"
    parts = [rows[i : i + 60] for i in range(0, 300, 60)] + [[(1000, k, 100_000) for k in "ab"], [(1001, "a", 5), (1002, "b", 200_000)], [(1003, "b", 300_000)]]
    for i, part in enumerate(parts):
        events(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        limited = jobs.stream_rate_limit(source, "k", "ts", "id", 5, 60, late="10 minutes")
        # every micro-batch is a run of its own: state survives the restart
        limited.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{folder}/out").collect()
    want = brute_limit(rows, 5, 60)
    assert len(got) == len({(r.id, r.k) for r in got}) and 1001 not in {r.id for r in got}
    assert {r.id: r.accepted for r in got if r.id < 1000} == want


def test_stream_state_fold_equals_batch(spark, folder, rocksdb):
    rng = random.Random(9)
    schema = "key string, seq long, field string, value string, appends boolean"
    rows = [(rng.choice("xyz"), i, rng.choice(["name", "level"]), rng.choice(["", "a", "b", None]), False) for i in range(60)]
    rows += [(rng.choice("xyz"), i, "notes", f"n{i}" if i % 9 else "", True) for i in range(60)] + [("x", 5, "notes", "tie", True), ("x", 5, "notes", "tie", True), ("y", 99, "name", "p", None), ("y", 99, "name", "q", False)]
    rng.shuffle(rows)
    states = {}
    for i in range(0, len(rows), 30):
        spark.createDataFrame(rows[i : i + 30], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.stream_state_fold(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        keep = lambda df, n: states.update({(r.key, r.field): (r.value, r["items"]) for r in df.collect()})
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    batch = {(r.key, r.field): (r.value, r["items"]) for r in jobs.state_fold(spark.createDataFrame(rows, schema)).collect()}
    assert states == batch and batch["y", "name"][0] == "q" and "" in batch["x", "notes"][1] + batch["y", "notes"][1] + batch["z", "notes"][1]


def test_stream_usage_month(spark, folder):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{SF}/events.parque*")
    seen = []
    jobs.stream_usage_month(stream).writeStream.outputMode("update").foreachBatch(lambda d, n: seen.extend(d.collect())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    want = batch.groupBy(F.date_trunc("month", F.col("ts").cast("timestamp")).alias("month")).agg(F.count("*").alias("n"))
    assert {r.month: r.n for r in seen} == {r.month: r.n for r in want.collect()}


def test_stream_ingest(spark, folder):
    schema = "doc_id string, text string, version int"
    for rows in ([("a", "old", 1), ("b", "kept", 1)], [("a", "new", 2), ("a", "newer", 3), ("c", "", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        jobs.stream_ingest(stream, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert {(r.document_id, r.text) for r in jobs.read_chunks(spark, f"{folder}/out").collect()} == {("a", "newer"), ("b", "kept")}


def test_chunks_of_few_texts_are_held_at_once(spark):
    """Before, a task held the chunks of up to 10,000 texts."""
    frame = pd.DataFrame({"text": ["ab", "c" * 10, "", "d" * 3, "e" * 3, "f"]})
    assert [list(x["text"]) for x in lots(iter([frame, frame[:0]]), most=6)] == [["ab"], ["c" * 10], ["", "d" * 3, "e" * 3], ["f"], []]
    docs = spark.createDataFrame([(i, "word " * 40, "a.md") for i in range(30)], "doc_id long, text string, source string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for chunks in (chunk_size_sweep, structure_chunk):
        was = spark.conf.get(key)
        spark.conf.set(key, 10000)
        try:
            assert chunks(docs).count() >= 30
            assert int(spark.conf.get(key)) <= 1000
        finally:
            spark.conf.set(key, was)
