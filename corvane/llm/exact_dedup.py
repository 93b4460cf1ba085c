"""Exact deduplication by a stateful stream.

The documents are read as a file stream. A streaming aggregation without watermark keeps, per digest
of the normalised text, the smallest (doc_id, content locator) and the number of rows; the state lives
in RocksDB on the executors' disks, its changes in the shared folder, and nothing expires. When the stream
has caught up, the state is read back as a table and joined to the rows. Digests hit more than once
have their full normalised texts compared; should two texts share a digest, its rows are regrouped
by the text itself.

Only DataFrame operations run on the rows. A hot group is combined before the shuffle, in the stream as in
the comparison of texts: each task sends a text once, however many copies it has read. If a count finds the
digests that were hit again few, a broadcast keeps all other texts out of that shuffle. The join back is a
plain equi-join of short rows, whose skewed partitions Spark splits.

Defined cases: null text equals empty text; a null doc_id sorts before all others; rows that repeat a
doc_id are separate rows, told apart by their locator (file, row in the file), the smaller of which
stays; an empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import remove, scratch, written

SPACES = r"[\x20\x09-\x0D]+"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.streaming.internal.stateStore.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Input bytes for each state partition, and the fewest and most partitions. Each is a RocksDB instance
#: that takes some MB of disk whatever it holds, and their number can't change later in a stream's life.
PARTITION_BYTES, LEAST_PARTITIONS, MOST_PARTITIONS = 16 << 20, 8, 8192


#: Digests hit again that are broadcast at most (some 100 bytes each); beyond it, all distinct texts are shuffled.
BROADCAST_DIGESTS = 100_000


def state_partitions(rows: DataFrame) -> int:
    held = int(rows._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return min(MOST_PARTITIONS, max(LEAST_PARTITIONS, -(-held // PARTITION_BYTES)))


def normalised(text: str = "text") -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def sha256(norm: Column) -> Column:
    return F.sha2(F.encode(norm, "UTF-8"), 256)


def _keyed(rows: DataFrame, digest: Callable[[Column], Column], text: bool) -> DataFrame:
    """doc_id, locator and digest of each row, with the normalised text if asked for."""
    norm = normalised()
    kept = [F.col("doc_id"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"), digest(norm).alias("digest")]
    return rows.select(*kept, *([norm.alias("norm")] if text else []))


def _schema(spark: SparkSession, path: str) -> StructType:
    """The columns that are read; no other column of the table can take the name of the files' metadata."""
    held = spark.read.parquet(path).schema
    return StructType([held["doc_id"], held["text"]])


def stream_state(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, state_path: str | None = None, max_bytes_per_batch: str | None = None) -> DataFrame:
    """Run the stream over the Parquet files at ``path`` until it has caught up; returns its state.

    digest, keep (struct of doc_id, locator), group_size. With a ``state_path`` of one's own, a later
    call goes on from the files that the former has seen; a lost driver restarts from it.
    """
    state_path = state_path or scratch(spark, "dedup-state")
    files = spark.read.schema(_schema(spark, path)).parquet(path)
    reader = spark.readStream.schema(files.schema)
    if max_bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_batch)
    # as a pattern, the path may be one file as well as a folder of files
    keyed = _keyed(reader.parquet(f"{path[:-1]}[{path[-1]}]"), digest, text=False)
    grouped = keyed.groupBy("digest").agg(F.min(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    settings = {PROVIDER: ROCKSDB, PARTITIONS: str(state_partitions(files))}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = grouped.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    held = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/state")
    if not held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held):  # no file, no batch
        return empty_state(spark, keyed)
    state = spark.read.format("statestore").load(state_path)
    value = state.schema["value"].dataType.names
    return state.select(F.col("key").getField(state.schema["key"].dataType.names[0]).alias("digest"), F.col("value").getField(value[0]).alias("keep"), F.col("value").getField(value[1]).alias("group_size"))


def empty_state(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    locator = keyed.schema["locator"].dataType.simpleString()
    return spark.createDataFrame([], f"digest string, keep struct<doc_id:{keyed.schema['doc_id'].dataType.simpleString()},locator:{locator}>, group_size bigint")


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, state_path: str | None = None, max_bytes_per_batch: str | None = None, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256, locator."""
    held = state_path or scratch(spark, "dedup-state")
    state = written(stream_state(spark, path, digest, held, max_bytes_per_batch), "dedup-groups")
    if state_path is None:
        remove(spark, held)
    rows = spark.read.schema(_schema(spark, path)).parquet(path)
    own = digest is sha256
    light = _keyed(rows, digest, text=False)
    if not own:
        light = _keyed(rows, digest, text=True).withColumn("text_sha256", sha256(F.col("norm"))).drop("norm")
    sha = F.col("digest") if own else F.col("text_sha256")

    # full bytes of every digest that was hit again; combined before the shuffle
    again = state.where("group_size > 1").select("digest")
    texts = _keyed(rows, digest, text=True).select("digest", "norm")
    if again.limit(broadcast_digests + 1).count() <= broadcast_digests:
        texts = texts.join(F.broadcast(again), "digest", "left_semi")
    texts = texts.distinct()
    clash = written(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1").select("digest"), "dedup-clash")
    out = light.join(state, "digest")
    if clash.isEmpty():
        return _verdict(out, sha)
    apart = _keyed(rows, digest, text=True).withColumn("text_sha256", sha256(F.col("norm"))).join(clash, "digest", "left_semi")
    apart_groups = apart.groupBy("digest", "norm").agg(F.min(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    regrouped = apart.join(apart_groups, ["digest", "norm"])
    return _verdict(out.join(clash, "digest", "left_anti"), sha).unionByName(_verdict(regrouped, F.col("text_sha256")))


def _verdict(rows: DataFrame, sha: Column) -> DataFrame:
    return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("locator") == F.col("keep.locator")).alias("kept"), sha.alias("text_sha256"), "locator")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all ``documents``."""
    return exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet").drop("locator")


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
