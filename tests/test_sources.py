import tempfile

from textloom.sources import files


def test_manifest_and_results(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/manifest.json", "w") as f:
        f.write('{"pdfs": [{"filename": "a.pdf", "url": "u1"},\n {"filename": "a.pdf", "url": "u2"}, {"filename": "b.pdf"}, {"url": "u3"}]}')
    with open(f"{folder}/bad.json", "w") as f:
        f.write("{broken")
    assert [tuple(r) for r in files.read_manifest(spark, f"{folder}/manifest.json").collect()] == [("a.pdf", "u2")]
    assert files.read_manifest(spark, f"{folder}/bad.json").count() == 0 and files.read_manifest(spark, f"{folder}/none.json").count() == 0
    rows = spark.createDataFrame([("x", True, None)], "id string, passed boolean, reason string")
    files.write_eval_json(rows, f"{folder}/out")
    assert files.read_eval_json(spark, f"{folder}/out", "id string, passed boolean, reason string").collect() == rows.collect()
    assert files.read_eval_json(spark, f"{folder}/none", "id string") is None
