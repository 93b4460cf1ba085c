"""Rankings: dense and lexical search, fusion, reranking, demotion, diversity.

A ranking is a table (keys..., chunk_id, score, rank); keys are the query and whatever else is swept over.
Ranks go by the score rounded to nine places, so that sums added in another order rank alike, then by what
the operator names, then by chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from corvane.session import written

RRF_K = 60


def best_first(*ties: Column | str) -> list[Column]:
    return [F.desc(F.round("score", 9)), *[F.asc(t) if isinstance(t, str) else t for t in ties]]


def ranked(scores: DataFrame, by: list[str], most: int | None = None, ties: tuple = ("chunk_id",)) -> DataFrame:
    """``scores`` with rank (from 1) within ``by``; the ``most`` first of them."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best_first(*ties))))
    return out.where(F.col("rank") <= most) if most else out


#: Vectors of a block.
VECTOR_BLOCK = 1024


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, vector) put together to blocks: their ids, and their vectors end to end."""
    for batch in batches:
        for start in range(0, batch.num_rows, VECTOR_BLOCK):
            part = batch.slice(start, VECTOR_BLOCK)
            ids, flat = part.column(0), part.column(1).flatten()
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([whole(ids), whole(flat)], names=["ids", "flat"])


def _local(most: int):
    """For mapInArrow: pairs of a block of queries and a block of vectors to the ``most`` best of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qids, chunks = (batch.column(c)[row].values for c in ("qids", "ids"))
                asked, held = (batch.column(c)[row].values.to_numpy().reshape(n, -1) for c, n in (("asked", len(qids)), ("flat", len(chunks))))
                near = np.round(asked @ held.T, 12)
                order = np.argsort(chunks.to_numpy(zero_copy_only=False), kind="stable")
                first = order[np.argsort(-np.round(near[:, order], 9), axis=1, kind="stable")[:, :most]]
                scores = np.take_along_axis(near, first, axis=1).reshape(-1)
                own = np.repeat(np.arange(len(qids)), first.shape[1])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(own)), chunks.take(pa.array(first.reshape(-1))), pa.array(scores)], names=["qid", "chunk_id", "score"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, most: int, block: int = 4096) -> DataFrame:
    """qid, chunk_id, score, rank: the ``most`` largest inner products of (qid, vector) over (chunk_id, vector)."""
    return ranked(dense_pairs(vectors, queries, most, block), ["qid"], most)


def dense_pairs(vectors: DataFrame, queries: DataFrame, most: int, block: int = 4096) -> DataFrame:
    """qid, chunk_id, score of what may be among the ``most`` first of a query, as dense() ranks them.

    Queries are put together to blocks of about ``block``, vectors to blocks of VECTOR_BLOCK as they are read; each pair of blocks
    keeps its own ``most`` for each query, and only these meet. Blocks of queries are broadcast if there are few.
    """
    held = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-held.count() // block))
    dealt = held.groupBy(F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("_block")).agg(F.collect_list("qid").alias("qids"), F.flatten(F.collect_list("vector")).alias("asked")).drop("_block")
    asked = F.broadcast(dealt) if blocks <= 8 else written(dealt, "query-blocks")
    kinds = (queries.schema["qid"].dataType, vectors.schema["chunk_id"].dataType)
    packed = StructType([StructField("ids", ArrayType(kinds[1])), StructField("flat", ArrayType(DoubleType()))])
    there = vectors.where(F.col("vector").isNotNull()).select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_blocks, packed)
    found = StructType([StructField("qid", kinds[0]), StructField("chunk_id", kinds[1]), StructField("score", DoubleType())])
    # every block of queries meets every block of vectors: a stated set of queries against all rows
    return there.crossJoin(asked).mapInArrow(_local(most), found)


def rrf(rankings: list[DataFrame], by: list[str], k: int = RRF_K) -> DataFrame:
    """by, chunk_id, score, seen: the sum of 1 / (k + rank) over the rankings; seen is where a chunk first came up."""
    marked = [r.select(*by, "chunk_id", "rank", F.lit(i).alias("_list")) for i, r in enumerate(rankings)]
    union = marked[0]
    for m in marked[1:]:
        union = union.unionByName(m)
    return rrf_lists(union, by, "_list", k)


def rrf_lists(union: DataFrame, by: list[str], number: str, k: int = RRF_K) -> DataFrame:
    """As rrf(), of one table whose column ``number`` tells the rankings apart."""
    return union.groupBy(*by, "chunk_id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min(F.struct(number, "rank")).alias("seen"))


def placed(lists: list[DataFrame], names: list[str], fused: str, by: list[str], k: int = RRF_K) -> DataFrame:
    """by, chunk_id, the rank in each of ``lists`` (by, chunk_id, score; null where it is not in one) and in their fusion by rrf(), of every chunk.

    All pairs are shuffled once: ranks, their fusion and its ranks are worked out where the pairs of one ``by`` lie, in sorted runs.
    """
    union = lists[0].select(*by, "chunk_id", "score", F.lit(0).alias("_list"))
    for i, rows in enumerate(lists[1:], 1):
        union = union.unionByName(rows.select(*by, "chunk_id", "score", F.lit(i).alias("_list")))
    each = ranked(union.repartition(*[F.col(c) for c in by]), [*by, "_list"])
    own = [F.max(F.when(F.col("_list") == i, F.col("rank"))).alias(n) for i, n in enumerate(names)]
    met = each.groupBy(*by, "chunk_id").agg(*own, F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))
    first = F.coalesce(*[F.lit(i << 40) + F.col(n) for i, n in enumerate(names)])  # the first list that has the chunk, then its rank there
    return ranked(met.withColumn("_first", first), by, ties=("_first", "chunk_id")).withColumnRenamed("rank", fused).drop("score", "_first")


def min_max(scores: DataFrame, by: list[str], least_spread: float = 1e-9) -> DataFrame:
    """Scores scaled to 0-1 within ``by``; 1 for all where they do not differ."""
    w = Window.partitionBy(*by)
    low, spread = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return scores.withColumn("score", F.when(spread < least_spread, 1.0).otherwise((F.col("score") - low) / spread))


def weighted(a: DataFrame, b: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """by, chunk_id, score, seen: alpha x scaled scores of a and 1 - alpha x those of b; absent counts 0."""
    left = min_max(a, by).select(*by, "chunk_id", F.col("score").alias("_a"), F.col("rank").alias("_ra"))
    right = min_max(b, by).select(*by, "chunk_id", F.col("score").alias("_b"), F.col("rank").alias("_rb"))
    score = alpha * F.coalesce("_a", F.lit(0.0)) + (1 - alpha) * F.coalesce("_b", F.lit(0.0))
    first = F.when(F.col("_ra").isNotNull(), F.struct(F.lit(0).alias("_list"), F.col("_ra").alias("rank"))).otherwise(F.struct(F.lit(1).alias("_list"), F.col("_rb").alias("rank")))
    return left.join(right, [*by, "chunk_id"], "full").select(*by, "chunk_id", score.alias("score"), first.alias("seen"))


def shared_tokens(a: Column, b: Column) -> Column:
    """How many distinct tokens two arrays share: the built-in stand-in for a reranking model."""
    return F.size(F.array_intersect(a, b)).cast("double")


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def demote(rows: DataFrame, by: list[str], penalty: float | Column, tagged: str = "is_reference") -> DataFrame:
    """Tagged rows moved towards the least score of their query: low + (score - low) x penalty (a column: one value a query)."""
    if not isinstance(penalty, Column) and penalty >= 1:
        return rows
    low = F.min("score").over(Window.partitionBy(*by))
    moves = F.col(tagged) & (_column(penalty) < 1)
    moved = rows.withColumn("score", F.when(moves, low + (F.col("score") - low) * penalty).otherwise(F.col("score")))
    return ranked(moved.withColumnRenamed("rank", "_before"), by, ties=("_before",)).drop("_before")


def diversity_cap(rows: DataFrame, by: list[str], k: int | Column, most: int | Column = 2, share: float | Column = 0.25, hard: bool | Column = False, group: str = "paper") -> DataFrame:
    """The k first rows with at most ``most`` of a group and a score of ``share`` of the best at least.

    Where these do not fill k, the strongest of the others do, those below the floor before those beyond the cap;
    a hard cap takes only the former, as far as their group has room. ``rows`` has rank, group and score. Without a
    cap (0) the k first rows are taken. The parameters may be columns, with one value a query.
    """
    if not isinstance(most, Column) and most <= 0:
        return rows.where(F.col("rank") <= k)
    limit, floor = _column(most), _column(share)
    query, own = Window.partitionBy(*by), Window.partitionBy(*by, group)
    top = F.max("score").over(query)
    above = F.col("score") >= F.when((floor > 0) & (top > 0), top * floor).otherwise(F.lit(float("-inf")))
    marked = rows.withColumn("_above", above)
    marked = marked.withColumn("_nth", F.sum(F.col("_above").cast("int")).over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.when((limit <= 0) | (F.col("_above") & (F.col("_nth") <= limit)), 0).when(~F.col("_above") & (F.col("_nth") < limit), 1).otherwise(2)
    marked = marked.withColumn("_kind", kind)
    if isinstance(hard, Column) or hard:
        free = ~_column(hard) | (limit <= 0)
        marked = marked.where(free | (F.col("_kind") < 2)).withColumn("_room", F.row_number().over(own.orderBy("_kind", "rank"))).where(free | (F.col("_room") <= limit)).drop("_room")
    # those admitted come first; then the others by score
    order = [F.when(F.col("_kind") == 0, 0).otherwise(1), F.when(F.col("_kind") == 0, F.col("rank")).otherwise(0), F.desc(F.round("score", 9)), "_kind", "rank"]
    taken = marked.withColumn("_n", F.row_number().over(query.orderBy(*order))).where(F.col("_n") <= k)
    final = F.row_number().over(query.orderBy(F.desc(F.round("score", 9)), "_n"))
    return taken.withColumn("_final", final).drop("rank", "_above", "_nth", "_kind", "_n").withColumnRenamed("_final", "rank")


def mmr(rows: DataFrame, by: list[str], k: int | Column, weight: float | Column = 0.7, vector: str = "vector") -> DataFrame:
    """k rows a query, each the best by weight x relevance - (1 - weight) x likeness to those picked before.

    Sequential within a query's candidates, of which there are few; ``rows`` has rank, score and vector. k and the weight
    may be columns, with one value a query.
    """
    rows = rows.withColumns({"_weight": _column(weight).cast("double"), "_k": _column(k).cast("int")})
    kept = [f for f in rows.schema if f.name not in ("rank", vector, "_weight", "_k")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", rank int"

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        weight, most = group["_weight"].iloc[0], group["_k"].iloc[0]
        scores = group["score"].to_numpy(dtype=np.float64)
        spread = scores.max() - scores.min()
        relevance = (scores - scores.min()) / spread if spread > 1e-12 else np.ones(len(scores))
        x = np.array(group[vector].tolist(), dtype=np.float64)
        likeness = np.zeros(len(scores))
        open_, order = np.ones(len(scores), dtype=bool), []
        while open_.any() and len(order) < most:
            gain = np.where(open_, np.round(weight * relevance - (1 - weight) * likeness, 9), -np.inf)
            best = int(gain.argmax())
            near = x @ x[best]
            likeness = np.maximum(likeness, near) if order else near
            order.append(best)
            open_[best] = False
        return group.iloc[order].drop(columns=["rank", vector, "_weight", "_k"]).assign(rank=range(1, len(order) + 1))

    return rows.groupBy(*by).applyInPandas(pick, schema)
