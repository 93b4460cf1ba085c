"""Sessions, histories and streams: their queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.operators import sessions as S
from corvane.session import Fixture, scratch, table
from corvane.streaming import sessions as G
from corvane.streaming.turns import in_order


@query(
    "session_islands",
    "WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 3600000000, true) AS fresh FROM events), s AS (SELECT user_id, ts, CAST(sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM g) SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session",
)
def session_islands(spark, sf_dir):
    return S.islands(table(spark, sf_dir, "events"), "user_id", "ts")


@query(
    "lru_evict",
    "WITH s AS (SELECT user_id, max(ts) AS used FROM events GROUP BY user_id), n AS (SELECT max(used) AS now FROM s), m AS (SELECT user_id, used, epoch_us(now) - epoch_us(used) > 36000000000 AS idle FROM s, n), r AS (SELECT *, row_number() OVER (PARTITION BY idle ORDER BY used DESC, user_id DESC) AS n FROM m) SELECT user_id, CASE WHEN idle THEN 'idle' ELSE 'over capacity' END AS reason FROM r WHERE idle OR n > 9",
)
def lru_evict(spark, sf_dir):
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("used"))
    now = used.agg(F.max("used")).first()[0]
    return S.evicted(used, "user_id", "used", F.lit(now), 36000, 10)


def _sql_lru(ttl: int, most: int) -> str:
    """By another road than the operator: how many other users came between a use and the next one of the same user."""
    return f"""WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events),
u AS MATERIALIZED (SELECT *, lead(pos) OVER w AS after, lead(t) OVER w AS after_t, row_number() OVER w AS nth FROM a WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
c AS (SELECT x.pos, count(DISTINCT o.user_id) AS others FROM u x JOIN u o ON o.pos > x.pos AND o.pos < coalesce(x.after, 1000000000) AND o.t <= x.t + {ttl * 1_000_000} GROUP BY x.pos),
f AS (SELECT u.*, coalesce(others, 0) >= {most} AS closed FROM u LEFT JOIN c USING (pos)),
n AS (SELECT *, coalesce(lag(closed) OVER w OR t - lag(t) OVER w > {ttl * 1_000_000}, true) AS fresh FROM f WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
s AS (SELECT *, CAST(sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS session FROM n)
SELECT user_id, session, make_timestamp(min(t)) AS started, make_timestamp(max(t)) AS ended, count(*) AS n,
  CASE WHEN arg_max(closed, pos) THEN 'over capacity' WHEN (SELECT max(t) FROM a) - max(t) > {ttl * 1_000_000} THEN 'idle' ELSE 'open' END AS reason FROM s GROUP BY user_id, session"""


@query("lru_sessions", _sql_lru(3600, 50))
def lru_sessions(spark, sf_dir):
    """Sessions of all users when fifty may be open and an hour idle."""
    return S.lru_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("lru_sessions_crowded", _sql_lru(86400, 10))
def lru_sessions_crowded(spark, sf_dir):
    """The same with ten places and a day, so that most sessions are closed for others."""
    return S.lru_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86400, 10, block_rows=2_000)


@query("history_window", "SELECT conv_id, turn, coalesce(string_agg(CAST(length(text) AS VARCHAR), ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS lengths FROM conversations")
def history_window(spark, sf_dir):
    turns = S.history(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return turns.select("conv_id", "turn", F.array_join(F.transform("history", lambda t: F.length(t).cast("string")), ",").alias("lengths"))


@query(
    "stop_after_three",
    "WITH m AS (SELECT user_id, event_id, event_type = 'error' AS f, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM events), r AS (SELECT *, sum(f::INT) OVER (PARTITION BY user_id, ok ORDER BY event_id) AS run FROM m), s AS (SELECT *, min(CASE WHEN run >= 3 THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM r) SELECT user_id, event_id FROM s WHERE stop IS NULL OR event_id <= stop",
)
def stop_after_three(spark, sf_dir):
    return S.until_failures(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id")


TURNS = Fixture("turn int, question string, answer string, variants array<string>", [(1, "a?", "It is [S1].", ["a?", "b?"]), (2, "c?", "The retrieved sources do not contain enough information to answer this question.", None)], per="documents", ids="turn", texts="question answer", pick=True)


@query("turn_view", f"SELECT turn, question, contains(lower(answer), 'the retrieved sources do not contain enough information') AS refused, coalesce(array_to_string(variants[2:], '|'), '') AS rephrasings FROM {TURNS.sql}")
def turn_view(spark, sf_dir):
    rest = F.slice("variants", 2, F.greatest(F.size("variants") - 1, F.lit(0)))
    return TURNS.frame(spark, sf_dir).select("turn", "question", F.contains(F.lower("answer"), F.lit("the retrieved sources do not contain enough information")).alias("refused"), F.coalesce(F.array_join(rest, "|"), F.lit("")).alias("rephrasings"))


SESSIONS = Fixture("id string, uploads int, with_corpus boolean", [("a", 0, True), ("b", 2, True), ("c", 1, False), ("d", 0, False)], per="pages", ids="id")


@query("session_view", f"SELECT id, CASE WHEN uploads = 0 THEN 'corpus' WHEN with_corpus THEN 'uploads+corpus' ELSE 'uploads' END AS scope, CASE WHEN uploads > 0 AND NOT with_corpus THEN 0 ELSE 2 END AS per_paper FROM {SESSIONS.sql}")
def session_view(spark, sf_dir):
    """What a session searches; over uploads alone the cap on a paper is off."""
    scope = F.when(F.col("uploads") == 0, "corpus").when(F.col("with_corpus"), "uploads+corpus").otherwise("uploads")
    return SESSIONS.frame(spark, sf_dir).select("id", scope.alias("scope"), F.when(scope == "uploads", 0).otherwise(2).alias("per_paper"))


def _stream(spark, sf_dir: str, name: str):
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _drained(spark, stream, name: str):
    """What a stream puts out until it has read all there is."""
    path = scratch(spark, name)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_sessions")
def stream_sessions(spark, sf_dir):
    """The sessions that a stream of events has closed."""
    return _drained(spark, G.sessions(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts"), "stream-sessions")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return _drained(spark, G.unseen(_stream(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"]), "stream-dedup")


@query("stream_index", "SELECT count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS tokens FROM (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(regexp_replace(lower(text), '\\b([a-z]+)-(\\d+)\\b', '\\1\\2', 'g'), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)")
def stream_index(spark, sf_dir):
    """Postings of a stream of chunks."""
    path = scratch(spark, "stream-index")
    chunks = _stream(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    G.index_chunks(chunks, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("tokens"))


@query(
    "stream_turns",
    """WITH t AS (SELECT *, row_number() OVER w AS n, coalesce(string_agg(CAST(length(text) AS VARCHAR), ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS lengths FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, n, role, lengths FROM t WHERE turn = n - 1""",
)
def stream_turns(spark, sf_dir):
    """Turns in order, each with those before it, from a stream in which they arrive shuffled: four batches, dealt out by hash."""
    turns, path = table(spark, sf_dir, "conversations"), scratch(spark, "turns")
    files = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    turns.repartition(files, F.xxhash64("conv_id", "turn")).write.parquet(f"{path}/in")
    arriving = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{path}/in")
    rows = _drained(spark, in_order(arriving, "conv_id", "turn", "text"), "turns-in-order")
    return rows.select("conv_id", "turn", "n", "role", F.array_join(F.transform("history", lambda t: F.length(t).cast("string")), ",").alias("lengths"))
