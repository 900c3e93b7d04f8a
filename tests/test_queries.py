import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from clipfold.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    frame = entry.queries()[name](spark, FOLDER)
    sql = con.sql(ORACLE_SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(sql.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    theirs = sorted(tuple(plain(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_hopping_window_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from clipfold.streaming.windows import first_seen, hopping

    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER)
    cents = lambda df: df.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    q = hopping(cents(stream), "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("hops").option("checkpointLocation", str(tmp_path / "a")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("hops").collect())) == sorted(map(tuple, hopping(cents(events), "ts", ["event_type"]).collect()))
    q = first_seen(stream, "ts", "user_id").select("user_id").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "b")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == events.select("user_id").distinct().count()


#: First lines that tables of any size can have, and their neighbours.
ODD = (None, "", "\nnext", "  ", "a]]>b", "a]]", "<!DOCTYPE html><p>x", "<!-- c --> t", "<b></b>", "x\x01y", "\x0c", "\x85 t \x85", "\ufeff", "&nbsp;", "<![CDATA[n]]>", "&lt;b&gt;x", "é" * 600, "\U000f00001f;")


def test_feed_items_of_odd_titles_match_sql(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = pa.array([ODD[i % len(ODD)] for i in range(5 * len(ODD))], pa.string())
    ids = pa.array(range(len(texts)), pa.int64())
    pq.write_table(pa.table({"doc_id": ids, "text": texts}), tmp_path / "documents.parquet")
    found = entry.queries()["feed_items"](spark, str(tmp_path))
    columns = ("source_id", "item_index", "title", "excerpt", "issue", "original_url")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['feed_items']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())


def test_ingestion_run_of_odd_titles_matches_sql(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 12 * len(ODD)
    table = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array([ODD[i * 5 % len(ODD)] for i in range(n)], pa.string()), "source": [f"src{i % 5}" for i in range(n)]})
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"text": ["a title", None]}), tmp_path / "benchmark.parquet")
    found = entry.queries()["ingestion_run"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    columns = ("total", "failed", "collected", "deduplicated", "inserted", "status")
    assert con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['ingestion_run']})").fetchall() == [tuple(r) for r in found.select(*columns).collect()]
