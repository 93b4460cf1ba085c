"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Whole documents only; one longer than a sequence is cut into full pieces and a rest. Which piece goes
where depends on the pieces' lengths alone, so the plan is made on their histogram, which has at most
``capacity`` entries however many documents there are: a bin is filled greedily, largest fitting length
first; then its smallest document gives way to the two unpacked ones that fit the expanded gap most
tightly, if they fill more of it. A pattern of lengths found so is used as often as the histogram allows.
The pieces are numbered within their length (in buckets by a number of the row, so that no length and no
repeated row meets in one task) and each number is looked up in the plan.

Defined cases: null and empty texts are the one token that ends a document; which of the pieces of one length
goes where is left open; rows that repeat a doc_id are packed as documents of their own; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import WordMemo, vocabulary, word_chunks

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: Pieces of one length are numbered in at least so many buckets, of about so many pieces.
BUCKETS, BUCKET_ROWS = 512, 1_000_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cutter(path: str, capacity: int, end_id: int):
    """For mapInArrow: (doc_id, text) to the pieces of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(path)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                chunks = [word_chunks(t) if t else [] for t in part.column("text").to_pylist()]
                held = memo.learn(set().union(*chunks))
                for doc_id, own in zip(part.column("doc_id").to_pylist(), chunks, strict=True):
                    ids = b"".join([*map(held.__getitem__, own), end])
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        of = ids[start : start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(of) // 4, zlib.crc32(of)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pattern(left: np.ndarray, capacity: int) -> dict[int, int]:
    """The next bin as {length: how many}; ``left[n]`` counts the unpacked documents of length n."""
    used: dict[int, int] = {}
    gap = capacity
    for n in np.flatnonzero(left[: capacity + 1])[::-1]:
        if k := min(int(left[n]), gap // int(n)):
            used[int(n)] = k
            gap -= k * int(n)
        if not gap:
            return used
    least = min(used)
    room = gap + least
    free = left.copy()
    for n, k in used.items():
        free[n] -= k
    small = np.flatnonzero(free[: room + 1])
    small = small[small > 0]
    best = (least, 0, 0)
    for a in small[::-1]:
        fits = small[small <= min(room - a, a)]
        for b in fits[::-1][:2]:
            if b != a or free[a] > 1:
                best = max(best, (int(a + b), int(a), int(b)))
                break
        if best[0] == room:
            break
    if best[0] > least:
        used[least] -= 1
        for n in best[1:]:
            used[n] = used.get(n, 0) + 1
    return {n: k for n, k in used.items() if k}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of the plan: (length, first number, end number, documents a bin, first sequence, offset).

    The documents of ``length`` numbered from first to end go, so many to each, into consecutive
    sequences, the first of each at ``offset``.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in histogram.items():
        left[n] = k
    done = np.zeros(capacity + 1, dtype=np.int64)
    runs, sequence = [], 0
    while left.any():
        used = pattern(left, capacity)
        times = min(int(left[n]) // k for n, k in used.items())
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            runs.append((n, int(done[n]), int(done[n]) + k * times, k, sequence, offset))
            done[n] += k * times
            left[n] -= k * times
            offset += n * k
        sequence += times
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` (length, ``_row``: a number of the row's own, and others; a stable table) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    buckets = max(buckets, sum(histogram.values()) // BUCKET_ROWS)
    runs = spark.createDataFrame(plan(histogram, capacity), "length bigint, run_from bigint, run_to bigint, per_bin bigint, run_sequence bigint, run_offset bigint")

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sums = dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("bucket", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("_row")) - 1
    numbered = dealt.withColumn("own", own).join(before, ["bucket", "length"]).withColumn("number", F.col("before") + F.col("own"))
    at = F.col("number") - F.col("run_from")
    return (
        numbered.join(F.broadcast(runs), "length")  # bounded: the plan has a few runs for each of `capacity` lengths
        .where((F.col("number") >= F.col("run_from")) & (F.col("number") < F.col("run_to")))
        .withColumn("sequence_id", F.col("run_sequence") + F.floor(at / F.col("per_bin")))
        .withColumn("offset", F.col("run_offset") + F.pmod(at, F.col("per_bin")) * F.col("length"))
        .select(*[c for c in pieces.columns if c != "_row"], "sequence_id", "offset")
    )


def cut_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32; no text goes further."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cutter(vocabulary_path, capacity, end_id), PIECES)


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack: one row per piece."""
    cut = cut_documents(docs, vocabulary_path or vocabulary(VOCABULARY), capacity, end_id)
    return pack(written(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
