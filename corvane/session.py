"""Session settings and the tables that queries read."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: What the engine expects of a session; all else is the cluster's.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "corvane", **settings: str) -> SparkSession:
    """A session with SETTINGS; further settings by their names with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
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


def written(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage, survives lost executors.

    ``most`` rows a file at most (0: any number): a reader takes up to 4096 of a file at once, which large rows have no room for.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: dict[str, tuple[list[str], object]] = {}


def stored(spark: SparkSession, source: str | list[str], what: str, make: Callable[[], T], tables: Callable[[T], list[DataFrame]]) -> T:
    """What ``make`` has made of the files at ``source``, once for an application while these stay as they are.

    Known by the files' names, lengths and times, which a scan without contents tells; made again if its own files are gone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    said = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    key = f"{spark.sparkContext.applicationId} {what} {source} {tuple(said)}"
    if key in _STORED and all(_there(spark, p) for p in _STORED[key][0]):
        return _STORED[key][1]  # type: ignore[return-value]
    made = make()
    _STORED[key] = ([f.rpartition("/")[0] for t in tables(made) for f in t.inputFiles()[:1]], made)
    return made


def _there(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return {"inf": "CAST('Infinity' AS DOUBLE)", "-inf": "CAST('-Infinity' AS DOUBLE)"}.get(str(value), repr(value))
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


class Fixture:
    """Rows laid over a given table: for Spark a DataFrame of these, for SQL a subquery.

    A written row is a case, and each row of the table ``per`` makes its own copy of it: ``ids`` bear the table row's key (texts in front,
    or behind with ``behind``; whole numbers are moved by 1000 a key), ``texts`` have the row's text behind them (arrays: as a
    further element), ``moved`` numbers are shifted by the key's remainder by 7. With ``pick`` a row of the table makes one case
    only, the cases taking turns. Without ``per`` it is the written rows alone.
    """

    def __init__(self, schema: str, rows: Iterable[tuple], per: str | None = None, ids: str = "", texts: str = "", moved: str = "", pick: bool = False, behind: bool = False, sep: str = " "):
        self.schema, self.rows, self.per = schema, list(rows), per
        self.ids, self.texts, self.moved, self.pick, self.behind, self.sep = ids.split(), texts.split(), moved.split(), pick, behind, sep
        self.columns = [tuple(x.strip().split(" ", 1)) for x in schema.split(", ")]

    #: Key and text of the tables that cases are laid over.
    TABLES = {"documents": ("doc_id", "text"), "pages": ("page_id", "url"), "benchmark": ("item_id", "text"), "events": ("event_id", "event_type")}

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        written = spark.createDataFrame(self.rows, self.schema)
        if self.per is None:
            return written
        key, text = self.TABLES[self.per]
        cases = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(name) if not isinstance(v, (list, tuple)) else F.array(*map(F.lit, v)).cast(kind).alias(name) for (name, kind), v in zip(self.columns, row, strict=True)]) for row in self.rows])
        over = table(spark, sf_dir, self.per).select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t"))
        laid = over.select("_k", "_t", F.inline(F.array(F.element_at(cases, (F.pmod("_k", F.lit(len(self.rows))) + 1).cast("int"))) if self.pick else cases))
        return laid.select(*[self._own(name, kind).alias(name) for name, kind in self.columns])

    def _own(self, name: str, kind: str) -> Column:
        c, k = F.col(name), F.col("_k")
        if name in self.ids and kind == "string":
            parts = [c, F.lit("~"), k.cast("string")] if self.behind else [k.cast("string"), F.lit("~"), c]
            return F.concat(*parts)
        if name in self.ids:
            return (c + 1000 * k).cast(kind)
        if name in self.texts:
            return F.array_append(c, F.col("_t")) if kind.startswith("array") else F.concat(c, F.lit(self.sep), F.col("_t"))
        return (c + k % 7).cast(kind) if name in self.moved else c

    @property
    def sql(self) -> str:
        kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
        cast = lambda k: kinds[k[6:-1]] + "[]" if k.startswith("array<") else kinds[k]
        columns = ", ".join(f"CAST({name} AS {cast(kind)}) AS {name}" for name, kind in self.columns)
        rows = ", ".join("(" + ", ".join(map(_literal, (*row, i))) + ")" for i, row in enumerate(self.rows))
        written = f"(SELECT {columns}, _i FROM (VALUES {rows}) AS v({', '.join(name for name, _ in self.columns)}, _i))"
        if self.per is None:
            return f"(SELECT {', '.join(name for name, _ in self.columns)} FROM {written})"
        key, text = self.TABLES[self.per]
        own = ", ".join(f"{self._sql(name, kind, cast(kind))} AS {name}" for name, kind in self.columns)
        turn = f" AND _i = _k % {len(self.rows)}" if self.pick else ""
        return f"(SELECT {own} FROM {written} AS f JOIN (SELECT {key} AS _k, {text} AS _t FROM {self.per}) AS o ON true{turn})"

    def _sql(self, name: str, kind: str, cast: str) -> str:
        c = f"f.{name}"
        if name in self.ids and kind == "string":
            return f"CASE WHEN {c} IS NOT NULL THEN concat({f"{c}, '~', _k" if self.behind else f"_k, '~', {c}"}) END"
        if name in self.ids:
            return f"CAST({c} + 1000 * _k AS {cast})"
        if name in self.texts:
            return f"CASE WHEN _t IS NOT NULL THEN list_append({c}, _t) END" if kind.startswith("array") else f"({c} || {_literal(self.sep)} || _t)"
        return f"CAST({c} + _k % 7 AS {cast})" if name in self.moved else c
