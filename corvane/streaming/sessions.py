"""Streams: idle sessions, rows seen before, a lexical index that grows with its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import search_tokens
from corvane.operators.segments import add_and_retract
from corvane.sources.manifest import opened


def sessions(events: DataFrame, key: str, ts: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """key, started, ended, n of the sessions of a stream, each once its gap is past the watermark."""
    watched = events.withWatermark(ts, late)
    found = watched.groupBy(key, F.session_window(ts, gap).alias("_w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))
    return found.select(key, "started", "ended", "n")


def unseen(rows: DataFrame, keys: list[str], ts: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows of a stream whose keys have not come before; with ``ts``, keys are forgotten behind the watermark."""
    if ts is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def index_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends postings (chunk_id, length, term, tf) of arriving chunks (chunk_id, text) to the table at ``path``.

    A batch that is run again writes its own folder again, so postings come once.
    """
    tokens = search_tokens(F.col("text"))
    postings = chunks.select("chunk_id", F.size(tokens).alias("length"), tokens.alias("_t"))

    def append(batch: DataFrame, number: int) -> None:
        rows = batch.select("chunk_id", "length", F.explode("_t").alias("term")).groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return postings.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_sessions(events: DataFrame, root: str, checkpoint: str, name: str = "sessions") -> StreamingQuery:
    """Keeps the segmented index at ``root`` (operators/segments.py) up with a stream of (scope, at, action, chunk_id, text) and vector, if there.

    ``upload`` adds a chunk to its scope, ``end`` retracts what the scope has uploaded before ``at``. A batch is one version of
    the index; its number goes with the version, so a batch that runs again after a failure changes nothing.
    """
    spark = events.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        base = opened(spark, root)
        if base.facts.get(f"batch {name}", -1) >= number:
            return
        ended = batch.where(F.col("action") == "end").groupBy("scope").agg(F.max("at").alias("_ended"))
        came = batch.where(F.col("action") == "upload").join(ended, "scope", "left").where(F.col("_ended").isNull() | (F.col("at") > F.col("_ended")))
        chunks = came.select("scope", "chunk_id", search_tokens(F.col("text")).alias("tokens"), *(["vector"] if "vector" in batch.columns else []))
        add_and_retract(base, chunks, ended.select("scope"), **{f"batch {name}": number})

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
