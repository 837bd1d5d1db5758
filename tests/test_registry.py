import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows_of
from textloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    ref = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in ref.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, ref.fetchall())


def test_normalize_block(spark):
    from pyspark.sql import functions as F

    from textloom.functions.text import normalize_block

    row = spark.createDataFrame([("​  It’s  “NEW” ",)], "t string").select(normalize_block(F.col("t")).alias("t")).first()
    assert row.t == "it's \"new\""


def test_merge_neighbors(spark):
    from textloom.operators.retrieval import merge_neighbors

    chunks = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 2, "b "), ("e", 0, "x")], "document_id string, chunk_index int, text string")
    hits = chunks.where("document_id = 'd' and chunk_index = 1")
    assert [tuple(r) for r in merge_neighbors(hits, chunks).collect()] == [("d", 1, "a\n\nb", 3)]


def test_every_chunk_gets_its_block(spark):
    blocks = registry.queries()["merge_neighbors"](spark, SF)
    chunks = registry.queries()["fixed_chunk"](spark, SF)
    counts = (blocks.count(), chunks.count())
    print(counts, chunks.where("chunk_index % 3 = 0").count())
    assert counts[0] == counts[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
