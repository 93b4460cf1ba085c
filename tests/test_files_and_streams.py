"""Files are read as they were written; streams agree with batches."""

import json

from pyspark.sql import functions as F

from corvane.operators.sessions import islands
from corvane.sources import files
from corvane.streaming import sessions as G


def test_lines_and_maps(spark, tmp_path):
    assert files.read_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    path = tmp_path / "c.jsonl"
    path.write_text('{"chunk_id": "a", "page_start": 1}\n\n  \n{"chunk_id": "b", "text": "t"}\n')
    rows = {r.chunk_id: r for r in files.read_lines(spark, str(path)).collect()}
    assert set(rows) == {"a", "b"} and rows["b"].text == "t" and rows["a"].table_note is None
    (tmp_path / "t.json").write_text(json.dumps({"p": [{"page": 1, "caption": "Table 1", "markdown": "|", "n_rows": 1, "n_cols": 2}], "q": []}))
    got = files.read_by_paper(spark, str(tmp_path / "t.json")).collect()
    assert [(r.paper, r.page, r.n_cols) for r in got] == [("p", 1, 2)]


def test_tables_and_predictions(spark, tmp_path):
    a = spark.createDataFrame([("x", 0.123456)], "config string, mrr double")
    b = spark.createDataFrame([("y", 3)], "config string, n int")
    files.write_table([a, b], str(tmp_path / "t"))
    got = {r.config: r for r in files.read_table(spark, str(tmp_path / "t")).collect()}
    assert got["x"].mrr == 0.1235 and got["x"].n is None and got["y"].n == 3
    rows = spark.createDataFrame([("m", "id", 1), ("m", "ood", 2)], "method string, part string, v int")
    files.write_predictions(rows, str(tmp_path / "p"))
    files.write_predictions(rows.where("part = 'id'").withColumn("v", F.lit(9)), str(tmp_path / "p"))
    assert {(r.part, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("id", 9), ("ood", 2)}
    assert files.report(a, ["config", "mrr"], ("mrr",)) == "| config | mrr |\n|---|---|\n| x | 12.3% |"


def test_stream_of_sessions_agrees_with_the_batch(spark, tmp_path):
    events = spark.createDataFrame([(u, f"2024-01-01 {h:02}:{m:02}:00") for u, h, m in [(1, 0, 0), (1, 0, 59), (1, 1, 59), (1, 3, 0), (2, 5, 0), (9, 23, 0)]], "user long, ts string").withColumn("ts", F.to_timestamp("ts"))
    batch = {(r.user, r.started, r.n) for r in islands(events, "user", "ts").collect()}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = G.sessions(stream, "user", "ts", late="0 seconds").writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    closed = {(r.user, r.started, r.n) for r in spark.table("closed").collect()}
    assert closed and closed <= batch and len(batch - closed) <= 1  # the last one is still open


def test_unseen_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    G.unseen(stream, ["k"]).writeStream.format("memory").queryName("unseen").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.table("unseen").collect()) == ["a", "b"]
