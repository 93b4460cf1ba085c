"""The corpus pipeline: each stage reads, as a Parquet table, all that the one before has kept.

Language ID drops documents in none of the languages that it has learnt; line dedup removes boilerplate lines of each source;
near-dedup keeps one document of each group; the secret scan redacts what it finds; packing lays out what
is left as sequences of tokens. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, table, written
from corvane.llm.language_id import UNDETERMINED, held_out, identify, learn
from corvane.llm.line_dedup import line_dedup
from corvane.llm.near_dedup import near_groups
from corvane.llm.packing import pack_documents
from corvane.llm.secret_scan import redact


#: Least cosine of a document with the language that is nearest to it: vectors of 512 random signs that have nothing
#: to do with each other stay below it in 98.8 of 100 cases. Texts of fewer characters say too little to be judged by it.
MIN_SCORE, JUDGED_FROM = 0.1, 20


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as long as the text is now (null where the text is null)."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` as a struct ``row`` beside the columns a stage works on, so that no name can clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), *needed)


def _restored(done: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``row``, with the text that the stage has made."""
    return done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are like no language learnt (or have no letter); all others stay as they are."""
    langs, prototypes = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = identify(_carried(docs, "text"), langs, prototypes)
    like = (F.col("score") >= MIN_SCORE) | (F.length("text") < JUDGED_FROM)
    return _restored(found.where((F.col("lang_pred") != UNDETERMINED) & like), docs.columns)


def line_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the lines that recur over a source; documents stay, if need be with an empty text."""
    return _counted(_restored(line_dedup(_carried(docs, "source", "text")), docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group; documents with an empty text stay."""
    gone = written(near_groups(docs).where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts the secrets; all documents stay."""
    return _counted(_restored(redact(_carried(docs, "doc_id", "text")), docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row per piece of a document."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_boilerplate),
    ("near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: Sketches, learnt profiles and packing are beyond SQL: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is a Parquet table in the shared folder.

    A stage's table goes when the next one has been written.
    """
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as own:
        for name, stage in STAGES[:-1]:
            docs = own.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            while len(own.paths) > 1:
                own.drop(0)
        name, stage = STAGES[-1]
        return written(stage(spark, docs, sf_dir), f"pipeline-{name}")
