"""Sessions: idle gaps, eviction, histories, runs of failures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import written


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without time zone (without: UTC, the session's)."""
    return F.unix_micros(ts.cast("timestamp"))


def islands(events: DataFrame, key: str, ts: str, gap_seconds: int = 3600) -> DataFrame:
    """key, session, started, ended, n: rows of a key that follow one another within the gap."""
    order = Window.partitionBy(key).orderBy(ts)
    idle = micros(F.col(ts)) - micros(F.lag(ts).over(order))
    marked = events.withColumn("_new", F.coalesce((idle > gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("_new").over(order).cast("long"))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))


def evicted(sessions: DataFrame, key: str, last_used: str, now: Column, ttl_seconds: int = 3600, most: int = 50) -> DataFrame:
    """key, reason: sessions to drop before another is opened: the idle ones, then the longest unused."""
    idle = micros(now) - micros(F.col(last_used)) > ttl_seconds * 1_000_000
    marked = sessions.select(key, last_used, idle.alias("_idle"))
    # only the most - 1 last used of the others stay: a limit keeps this from being one task's sort
    kept = marked.where(~F.col("_idle")).orderBy(F.desc(last_used), F.desc(key)).limit(most - 1).select(key)
    gone = marked.join(F.broadcast(kept), key, "left_anti")  # at most `most` rows
    return gone.select(key, F.when(F.col("_idle"), "idle").otherwise("over capacity").alias("reason"))


def history(turns: DataFrame, session: str, turn: str, text: str, most: int = 3) -> DataFrame:
    """``turns`` with the texts of the ``most`` turns before each."""
    frame = Window.partitionBy(session).orderBy(turn).rowsBetween(-most, -1)
    return turns.withColumn("history", F.collect_list(text).over(frame))


def until_failures(rows: DataFrame, key: str, order: str, failed: Column, most: int = 3) -> DataFrame:
    """The rows of a key before its ``most``-th failure in a row (that one included, none after)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_f", failed.cast("int")).withColumn("_ok", F.sum(1 - F.col("_f")).over(w))
    run = F.sum("_f").over(Window.partitionBy(key, "_ok").orderBy(order))
    stop = F.min(F.when(F.col("_run") >= most, F.col(order))).over(Window.partitionBy(key))
    return marked.withColumn("_run", run).withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_f", "_ok", "_run", "_stop")


def _newest(uses: DataFrame, most: int) -> DataFrame:
    """Of (block, key, last), the ``most`` keys of a block that were used last."""
    nth = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("last"), "key"))
    return uses.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def _carried(uses: DataFrame, blocks: int, most: int) -> DataFrame:
    """block, key, last: for each block, the ``most`` keys that were used last in all blocks before it.

    Which keys were used last is a sum of a kind: that of two stretches follows from theirs. So stretches are doubled, each round
    putting that of a block together with the one before it, and a round handles ``most`` rows a block at most.
    """
    state, reach = written(_newest(uses, most), "lru-last"), 1
    while reach < blocks:
        before = state.select((F.col("block") + reach).alias("block"), "key", "last").where(F.col("block") < blocks)
        both = state.unionByName(before).groupBy("block", "key").agg(F.max("last").alias("last"))
        state, reach = written(_newest(both, most), "lru-last"), 2 * reach
    return state.select((F.col("block") + 1).alias("block"), "key", "last").where(F.col("block") < blocks)


def _replayed(uses: pd.DataFrame, before: pd.DataFrame, ttl: int, most: int) -> pd.DataFrame:
    """The pieces of sessions in one block, and the sessions that are over when another needs their place."""
    block = int(uses["block"].iloc[0]) if len(uses) else -1
    store = {k: (last["t"], last["tie"], None) for k, last in sorted(zip(before["key"], before["last"], strict=True), key=lambda x: (x[1]["t"], x[1]["tie"]))}
    pieces: list[list] = []  # block, piece, key, fresh, started, ended, tie, n, evicted
    for key, t, tie in sorted(zip(uses["key"], uses["t"], uses["tie"], strict=True), key=lambda x: (x[1], x[2])):
        held = store.pop(key, None)
        alive = held is not None and t - held[0] <= ttl
        at = held[2] if alive else None
        if not alive:
            # the longest unused are the first ones: those idle too long, then those beyond the capacity
            for old in [*store]:
                last, last_tie, _ = store[old]
                if t - last <= ttl and len(store) < most:
                    break
                del store[old]
                if t - last <= ttl:
                    pieces.append([block, len(pieces), old, False, last, last, last_tie, 0, True])
        if at is None:
            at = len(pieces)
            pieces.append([block, at, key, not alive, t, t, tie, 0, False])
        own = pieces[at]
        own[5], own[6], own[7] = t, tie, own[7] + 1
        store[key] = (t, tie, at)
    return pd.DataFrame(pieces, columns=["block", "piece", "key", "fresh", "started", "ended", "tie", "n", "evicted"])


def lru_sessions(events: DataFrame, key: str, ts: str, tie: str, ttl_seconds: int = 3600, most: int = 50, block_rows: int = 50_000) -> DataFrame:
    """key, session (from 1), started, ended, n, reason of all sessions, when no more than ``most`` are open at a time.

    A use of a key goes on with its session, unless that has been idle for more than the limit or was closed for another: a new
    session closes the idle ones and then, while ``most`` are open, the one that is longest unused. reason: ``over capacity``, ``idle``, or
    ``open`` when the events end. ``tie`` (a whole number) orders uses of one time.

    All keys share the places, so this is one sequence. It is cut by time into blocks of about ``block_rows`` events; what is open at a
    block's start are the keys that were used last, ``most`` at most, which are found for all blocks by doubling; then blocks are
    replayed by themselves. Rows without key or time are left out.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), micros(F.col(ts)).alias("t"), F.col(tie).cast("long").alias("tie"))
    blocks = max(1, -(-rows.count() // block_rows))
    # range partitions of a written table: a row's block stays what it is, whatever is run again
    cut = written(rows.repartitionByRange(blocks, "t", "tie").withColumn("block", F.spark_partition_id().cast("long")), "lru-uses")
    last = cut.groupBy("block", "key").agg(F.max(F.struct("t", "tie")).alias("last"))
    before = _carried(last, blocks, most)
    kind = cut.schema["key"].dataType.simpleString()
    ttl = ttl_seconds * 1_000_000
    schema = f"block bigint, piece int, key {kind}, fresh boolean, started bigint, ended bigint, tie bigint, n bigint, evicted boolean"
    pieces = written(cut.groupBy("block").cogroup(before.groupBy("block")).applyInPandas(lambda uses, kept: _replayed(uses, kept, ttl, most), schema), "lru-pieces")
    # pieces, not events: a key has at most one for each block besides its sessions
    numbered = pieces.where("not evicted").withColumn("session", F.sum(F.col("fresh").cast("long")).over(Window.partitionBy("key").orderBy("block", "piece")))
    whole = numbered.groupBy("key", "session").agg(F.min("started").alias("started"), F.max(F.struct("ended", "tie")).alias("_last"), F.sum("n").alias("n"))
    closed = pieces.where("evicted").select("key", F.struct("ended", "tie").alias("_last"), F.lit(True).alias("_full")).distinct()
    end = cut.agg(F.max("t").alias("_end"))  # one row
    met = whole.join(closed, ["key", "_last"], "left").crossJoin(F.broadcast(end))
    reason = F.when(F.col("_full"), "over capacity").when(F.col("_end") - F.col("_last.ended") > ttl, "idle").otherwise("open")
    return met.select(F.col("key").alias(key), "session", F.timestamp_micros("started").alias("started"), F.timestamp_micros("_last.ended").alias("ended"), "n", reason.alias("reason"))
