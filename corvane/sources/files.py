"""Readers and writers of the engine's file formats, with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import manifest

CHUNK = "chunk_id string, arxiv_id string, title string, year string, page_start int, page_end int, is_reference boolean, n_tokens int, chunk_index int, text string, table_note string, table_markdown string, table_grid_source string, figure_note string, figure_images string"
QUERY = "qid string, category string, question string, source string, relevant array<struct<chunk_id:string,text_hash:string>>, evidence array<string>"
TABLE = "array<struct<page:int,caption:string,markdown:string,n_rows:int,n_cols:int>>"
FIGURE = "array<struct<page:int,figure_no:string,caption:string,image:string,width:int,height:int,description:string,described_by:string>>"


def read_lines(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    """JSON lines; blank lines are passed over, a missing file is an empty table."""
    try:
        text = spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    return text.where(F.trim("value") != "").select(F.from_json("value", schema).alias("_r")).select("_r.*")


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines; the job's commit makes the output appear at once."""
    rows.write.mode("overwrite").json(path)


def read_by_paper(spark: SparkSession, path: str, kind: str = TABLE) -> DataFrame:
    """A JSON object of lists by paper, as rows (paper, the list's fields); a missing file is an empty table."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        text = spark.createDataFrame([], "value string")
    return text.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("paper", "_l")).select("paper", F.inline("_l"))


def write_table(frames: list[DataFrame], path: str, digits: int = 4) -> None:
    """CSV with a header: the union of all columns, numbers rounded."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    kinds = dict(rows.dtypes)
    rows.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else c for c in rows.columns]).write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; each column has one type, inferred from all its values."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


#: fixed values: how whole numbers and others are written (with underscores between digits, signs, and the names of those that are none)
WHOLE = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
NUMBER = r"^\s*[+-]?(([0-9]+(_[0-9]+)*)?\.[0-9]+(_[0-9]+)*|[0-9]+(_[0-9]+)*\.?)([eE][+-]?[0-9]+(_[0-9]+)*)?\s*$"
NO_NUMBER = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"


def own_type(text: Column) -> Column:
    """A text as a VARIANT of its own type: a boolean (True, False), a whole number, another number, or the text itself.

    Whole numbers of more than 38 digits are kept as text.
    """
    plain = F.regexp_replace(F.trim(text), "_", "")
    digits = F.length(F.regexp_replace(plain, "[^0-9]", ""))
    special = F.when(F.lower(plain).contains("nan"), F.lit(float("nan"))).when(F.startswith(plain, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(text.isin("True", "False"), (text == "True").cast("variant"))
        .when(text.rlike(WHOLE) & (digits <= 18), plain.try_cast("long").cast("variant"))
        .when(text.rlike(WHOLE) & (digits <= 38), plain.try_cast("decimal(38,0)").cast("variant"))
        .when(text.rlike(WHOLE), text.cast("variant"))
        .when(text.rlike(NUMBER), plain.try_cast("double").cast("variant"))
        .when(text.rlike(NO_NUMBER), special.cast("variant"))
        .otherwise(text.cast("variant"))
    )


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; each value has its own type, so all columns are VARIANT."""
    rows = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    return rows.select(*[own_type(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def read_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """One run's rows of a results table partitioned by ``run``: only its folder is read."""
    return spark.read.parquet(path).where(F.col("run") == run)


def write_predictions(rows: DataFrame, path: str) -> None:
    """Predictions by method and set; sets written before are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "part").parquet(path)


def write_index(spark: SparkSession, root: str, chunks: DataFrame, vectors: DataFrame, postings: DataFrame, model: str, dimensions: int) -> manifest.Version:
    """The tables of an index and what they were made with, published at once (see manifest.py): readers see all of it or the version before.

    Facts: model, dim, chunks, and how many chunks have a table note, a rebuilt table, a figure note.
    """
    noted = [c for c in ("table_note", "table_markdown", "figure_note") if c in chunks.columns]
    counts = chunks.agg(F.count(F.lit(1)).alias("chunks"), *[F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(c) for c in noted]).first().asDict()
    return manifest.publish(manifest.opened(spark, root), replace={"chunks": chunks, "vectors": vectors, "postings": postings}, facts={"model": model, "dim": dimensions, **counts})


def read_index(spark: SparkSession, root: str, version: int | None = None) -> manifest.Version:
    """The newest version of an index, or one of this number: tables chunks, vectors, postings, and facts."""
    found = manifest.opened(spark, root, version)
    if not found.number:
        raise FileNotFoundError(f"no index at {root}")
    return found


def report(rows: DataFrame, columns: list[str], percent: tuple[str, ...] = ()) -> str:
    """A Markdown table of a small result; ``-`` for what is missing."""
    kinds = dict(rows.dtypes)

    def shown(c: str):
        if c in percent:
            text = F.concat(F.format_number(F.col(c) * 100, 1), F.lit("%"))
        elif kinds[c] in ("double", "float"):
            text = F.format_number(c, 4)
        else:
            text = F.col(c).cast("string")
        return F.coalesce(F.when(~F.isnan(F.col(c)), text) if kinds[c] in ("double", "float") else text, F.lit("-")).alias(c)

    lines = [" | ".join(r) for r in rows.select(*[shown(c) for c in columns]).collect()]
    return "\n".join([f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *[f"| {line} |" for line in lines]])
