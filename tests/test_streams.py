"""Streams with state: turns in order."""

import random
import time

from pyspark.sql import functions as F

from corvane.streaming.turns import in_order

SCHEMA = "conv string, turn int, text string"


def drain(spark, folder, **kw):
    stream = in_order(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "conv", "turn", "text", **kw)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def test_turns_after_a_restart_repeated_and_missing_ones(spark, tmp_path):
    folder, own = str(tmp_path), random.Random(6)
    turns = [(c, t, f"{c}{t}") for c, n in (("a", 12), ("b", 1), ("c", 7), ("d", 9)) for t in range(n)]
    turns = [r for r in turns if r != ("c", 3, "c3")]  # one that never comes
    arrived = turns + own.sample(turns, 8) + [("a", None, "no number"), ("b", -1, "before the first"), ("e", 2, "alone")]
    own.shuffle(arrived)
    cut = len(arrived) // 3
    for start in (0, cut):
        for at in range(start, start + cut, 4):
            spark.createDataFrame(arrived[at : min(at + 4, start + cut)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        drain(spark, folder)  # the second time goes on from the checkpoint
    spark.createDataFrame(arrived[2 * cut :], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    got = drain(spark, folder)
    want = [r for r in turns if r[0] != "c" or r[1] < 3]
    assert sorted((r.conv, r.turn, r.text) for r in got) == sorted(want)
    assert all(r.n == r.turn + 1 and not r.after_gap for r in got)
    assert all(r.history == [f"{r.conv}{t}" for t in range(max(0, r.turn - 3), r.turn)] for r in got)


def test_a_session_goes_on_without_a_turn_it_has_waited_for(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([("a", 0, "x"), ("a", 2, "z"), ("a", 3, "w"), ("a", 9, "v"), ("b", 0, "u")], SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    stream = in_order(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), "conv", "turn", "text", patience_ms=500, history=1)
    running = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            got = sorted((r.conv, r.turn, r.n, r.after_gap, tuple(r.history)) for r in spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()) if (tmp_path / "out").exists() else []
            if len(got) == 5:
                break
    finally:
        running.stop()
    assert got == [("a", 0, 1, False, ()), ("a", 2, 2, True, ("x",)), ("a", 3, 3, False, ("z",)), ("a", 9, 4, True, ("w",)), ("b", 0, 1, False, ())]
