"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from lintlake.operators.history import to_history
from lintlake.plans.scan import scan_all
from lintlake.sources import history_store
from lintlake.streaming import streams
from workloads import history_queries

SCHEMA = "path string, text string, project_hash string, ts timestamp"


def write_files(spark, place):
    texts = ["use rand;\n", "use serde;\n", "use time;\nuse rand;\n"]
    rows = [(f"/w/f{i}.rs", t, f"p{i % 2}", f"2024-01-0{i + 1} 00:00:00") for i, t in enumerate(texts)]
    rows.append(("/w/c.py", "class A:\n    A = 'a'\n    B = 'b'\n    C = 'c'\n", "p0", "2024-01-05 00:00:00"))
    df = spark.createDataFrame(rows, "path string, text string, project_hash string, ts string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(place)
    return spark.read.schema(SCHEMA).parquet(place)


def test_scan_to_history(spark, tmp_path):
    batch = write_files(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        streams.scan_to_history(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    stored = history_store.read_history(spark, str(tmp_path / "log"))
    want = to_history(scan_all(batch, keep=("project_hash", "ts")), F.col("ts"))
    assert stored.count() == want.count() > 0
    assert stored.exceptAll(want.select(stored.columns)).count() == 0


def test_stream_scan_is_stateless(spark, tmp_path):
    write_files(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    found = streams.stream_scan(stream, "project_hash")
    assert found.isStreaming
    writer = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    kinds = {r.violation_type for r in got.collect()}
    assert {"banned_crate_usage", "enum_opportunity", "missing_docstring"} <= kinds


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/parts")
    (part,) = (tmp_path / "parts").glob("*.parquet")
    (tmp_path / "file").mkdir()
    part.rename(tmp_path / "file" / "documents.parquet")
    for form in ("folder", "file"):
        found = history_queries._drain(history_queries._document_stream(spark, f"{tmp_path}/{form}"), f"{tmp_path}/{form}-work")
        assert sorted(r.doc_id for r in found.collect()) == list(range(20)), form
