"""Metrics of rankings against relevance labels, null for queries without relevant chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5, 10)


def judged(rankings: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """``rankings`` (by, chunk_id, rank) with gain: the label's (``gain`` or 1), 0 without one."""
    gains = labels.select(*[k for k in by if k in labels.columns], "chunk_id", (F.col("gain") if "gain" in labels.columns else F.lit(1.0)).cast("double").alias("gain"))
    on = [k for k in by if k in labels.columns] + ["chunk_id"]
    return rankings.join(gains, on, "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))


def per_query(rankings: DataFrame, labels: DataFrame, queries: DataFrame, by: list[str], ks: tuple[int, ...] = K_VALUES, cutoff: str | None = None) -> DataFrame:
    """by, n_relevant, mrr, and recall_k, precision_k, success_k, ndcg_k for each k.

    ``queries`` lists every (by) to be judged; one without results scores 0, one without labels null. ``cutoff`` names the column of
    ``rankings`` that tells for which k a search was made: the metrics at k are then of the search for k, mrr of that for the largest.
    """
    on = [k for k in by if k in labels.columns]
    gains = labels.select(*on, "chunk_id", (F.col("gain") if "gain" in labels.columns else F.lit(1.0)).cast("double").alias("gain"))
    ideal = gains.groupBy(*on).agg(F.count_if(F.col("gain") > 0).alias("n_relevant"), F.sort_array(F.collect_list("gain"), asc=False).alias("_ideal"))
    hit = F.col("gain") > 0
    dcg = F.col("gain") / F.log2(F.col("rank") + 1)
    searched = lambda k: F.lit(True) if cutoff is None else F.col(cutoff) == k
    marks = [F.min(F.when(hit & searched(max(ks)), F.col("rank"))).alias("_first")]
    for k in ks:
        near = (F.col("rank") <= k) & searched(k)
        marks += [F.count_if(near & hit).alias(f"_hits_{k}"), F.sum(F.when(near, dcg)).alias(f"_dcg_{k}")]
    found = judged(rankings, labels, by).groupBy(*by).agg(*marks)
    rows = queries.select(*by).distinct().join(ideal, on, "left").join(found, by, "left")
    known = F.col("n_relevant") > 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    out = [F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), F.when(known, F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr")]
    for k in ks:
        best = F.aggregate(F.transform(F.slice("_ideal", 1, k), lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x)
        out += [
            F.when(known, zero(f"_hits_{k}") / F.col("n_relevant")).alias(f"recall_{k}"),
            F.when(known, zero(f"_hits_{k}") / k).alias(f"precision_{k}"),
            F.when(known, (zero(f"_hits_{k}") > 0).cast("double")).alias(f"success_{k}"),
            F.when(known, zero(f"_dcg_{k}") / best).alias(f"ndcg_{k}"),
        ]
    return rows.select(*by, *out)


def means(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by, n and the mean of each metric over the rows where it is not null."""
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in names])


def abstention(rows: DataFrame, by: list[str], answered: str = "answered", answerable: str = "answerable") -> DataFrame:
    """by, accuracy, false_answer, false_abstain of the decision to answer."""
    a, ok = F.col(answered), F.col(answerable)
    share = lambda what, where: F.avg(F.when(where, what.cast("double")))
    return rows.groupBy(*by).agg(F.avg((a == ok).cast("double")).alias("accuracy"), share(a, ~ok).alias("false_answer"), share(~a, ok).alias("false_abstain"))
