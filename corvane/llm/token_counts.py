"""Token counts behind a digest cache.

A text is known by the SHA-256 of its content (null counts as empty; nothing else is normalised, as
any change could change the count), a tokenizer version by the SHA-256 of its file. Contents whose
pair of digests is in the cache are not encoded. Of the others one copy each is encoded, and the new
counts are appended to the cache, a Parquet table in partitions by tokenizer version, of which a run reads
its own.

Copies are combined before the shuffle, so a hot content costs one row a task. Appending is atomic
(Spark's commit); should two writers, or a job that ran twice, have left a pair more than once, it counts
as one on reading.

Defined cases: null and empty text have 0 tokens; special strings inside texts count as the library's
default has it; texts of any length count whole; repeated rows give repeated rows; an empty table gives an
empty result; further columns are passed on, but for ones named n_bytes, n_tokens or over_limit, which give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written
from .tokens import Memo, byte_chunks, vocabulary

CACHE = "content_sha string, n_tokens bigint, tokenizer_sha string"
VOCABULARY = "byte_bpe_50k.json"


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def counter(path: str):
    """For mapInArrow: (content_sha, text) to (content_sha, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            model = Memo(path, "counts", len)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column("text").to_pylist()
                if path.endswith(".model"):
                    counts = [len(ids) for ids in model.encode(texts, num_threads=1)]
                else:
                    chunks = [byte_chunks(t) for t in texts]
                    held = model.learn(set().union(*chunks))
                    counts = [sum(map(held.__getitem__, own)) for own in chunks]
                yield pa.RecordBatch.from_arrays([part.column("_sha"), pa.array(counts, pa.int64())], names=["content_sha", "n_tokens"])

    return count


def token_counts(docs: DataFrame, vocabulary_path: str, cache_path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""
    spark = docs.sparkSession
    version = file_digest(vocabulary_path)
    content = F.coalesce(F.col(text), F.lit(""))
    sha = F.sha2(content.cast("binary"), 256)
    try:
        cached = spark.read.schema(CACHE).parquet(cache_path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        cached = spark.createDataFrame([], CACHE)
    def known(cache: DataFrame) -> DataFrame:
        own = cache.where(F.col("tokenizer_sha") == version)  # prunes the other versions' partitions
        return own.groupBy(F.col("content_sha").alias("_sha")).agg(F.max("n_tokens").alias("_tokens"))

    contents = docs.select(sha.alias("_sha"), content.alias("text")).groupBy("_sha").agg(F.first("text").alias("text"))
    misses = contents.join(known(cached), "_sha", "left_anti")
    counted = misses.mapInArrow(counter(vocabulary_path), "content_sha string, n_tokens bigint")
    counted.withColumn("tokenizer_sha", F.lit(version)).write.mode("append").partitionBy("tokenizer_sha").parquet(cache_path)

    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    # the columns go along as one, whatever their names
    keyed = docs.select(F.struct(*rest, F.octet_length(content).cast("long").alias("n_bytes")).alias("_row"), sha.alias("_sha"))
    # as a table of its own, so that the join's skewed partitions (copies of a hot content) can be split
    counted = written(known(spark.read.schema(CACHE).parquet(cache_path)), "token-counts")
    counts = keyed.join(counted, "_sha")
    return counts.select(*[F.col("_row").getField(c).alias(c) for c in (*rest, "n_bytes")], F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``; the cache starts empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary(VOCABULARY), scratch(spark, "token-cache"))
