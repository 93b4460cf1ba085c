"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch at most: bounds what a Python worker holds at a time, however long the texts are.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    spark.conf.set(*BATCH)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where driver and executors are one process (``local`` masters, as in tests) a temporary folder
    stands in for it; on a cluster without the setting this raises an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if context.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


_OWN: set[str] = set()


def _home(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver ends."""
    home = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}"
    if home not in _OWN:
        _OWN.add(home)
        atexit.register(_leave, spark, home)
    return home


def _leave(spark: SparkSession, home: str) -> None:
    try:
        remove(spark, home)
    except Exception:  # the session is gone already; the folder bears the application's name
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for a table or a stream's state in the shared folder."""
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    spark.conf.set(*BATCH)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage, survives lost executors."""
    return _write(df, scratch(df.sparkSession, name))


class Scratch:
    """Tables that are needed until the block ends, and then deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.clear()

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As the function of this name."""
        self.paths.append(scratch(self.spark, name))
        return _write(df, self.paths[-1])

    def drop(self, at: int) -> None:
        """Delete the table that was written at this place."""
        remove(self.spark, self.paths.pop(at))

    def clear(self) -> None:
        while self.paths:
            self.drop(-1)


def salted_join(rows: DataFrame, values: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """``rows`` with the columns of ``values``, which has each key (nulls too) of ``rows`` once and, as ``n``, how many rows have it.

    Keys of more than a quarter of a mean shuffle partition are split: their values stand there once for each share, and their rows
    are dealt out over the shares. Such keys, fewer than four times the shuffle partitions, are broadcast.
    """
    share, hot = hot_keys(values, on, n)
    rest = [c for c in values.columns if c not in (*on, n)]
    copies = F.greatest(F.ceil(F.col(n) / share).cast("int"), F.lit(1))
    placed = values.select(*[F.col(c).alias(f"_on_{c}") for c in on], *rest, F.explode(F.sequence(F.lit(0), copies - 1)).alias("_on_salt"))
    dealt = salted(rows, hot, on)
    same = F.col("_salt") == F.col("_on_salt")
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return dealt.join(placed, same).select(*rows.columns, *rest)


def hot_keys(counts: DataFrame, on: list[str], n: str = "n") -> tuple[int, DataFrame]:
    """The rows of a share, and (_hot_..., _copies) of the keys with more rows than that: fewer than four times the shuffle partitions."""
    spark = counts.sparkSession
    total = counts.agg(F.sum(n)).first()[0] or 0
    share = max(1, -(-int(total) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    hot = counts.where(F.col(n) > share).select(*[F.col(c).alias(f"_hot_{c}") for c in on], F.ceil(F.col(n) / share).cast("int").alias("_copies"))
    return share, hot


def salted(rows: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` and _salt: 0, or for rows of a hot key a number below its _copies, dealt out by the rows' places."""
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_hot_{c}"))
    place = F.monotonically_increasing_id()
    return rows.join(F.broadcast(hot), same, "left").select(*rows.columns, F.pmod(place, F.coalesce(F.col("_copies"), F.lit(1))).cast("int").alias("_salt"))
