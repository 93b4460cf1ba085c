"""Rank statistics of scores: AUROC, average precision, thresholds, risk and coverage, paired intervals.

All are built on prefix sums over distinct scores. These are worked out in buckets between quantiles of the scores,
so that no task has to see a whole key, however many rows it has. Results are null where a class is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.index import broadcast_if_small

#: Buckets of a key; each STRIDE-th cut is looked at first.
BUCKETS, STRIDE = 256, 16


def prefix_sums(rows: DataFrame, by: list[str], order: str, values: list[str], ties: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``{value}_to``, the sum of each value up to and with the row, in the order of a finite number.

    The buckets are parted at approximate quantiles of the order, so that each has about as many rows, however the numbers lie.
    """
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = rows.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx(order, shares, 16 * buckets))).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda _, i: i % STRIDE == 0))
    placed = rows.join(cuts, by) if by else rows.crossJoin(F.broadcast(cuts))  # one row
    # how many cuts lie below: first among every STRIDE-th, then among those that follow it
    below = lambda some: F.size(F.filter(some, lambda c: c < F.col(order)))
    placed = placed.withColumn("_run", F.greatest(below(F.col("_coarse")) - 1, F.lit(0)))
    placed = placed.withColumn("_bucket", F.col("_run") * STRIDE + below(F.slice("_cuts", F.col("_run") * STRIDE + 1, F.lit(STRIDE)))).drop("_cuts", "_coarse", "_run")
    sums = placed.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows a key
    before = sums.select(*by, "_bucket", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}_before") for v in values])
    own = Window.partitionBy(*by, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(before, [*by, "_bucket"])
    return out.withColumns({f"{v}_to": F.col(f"_{v}_before") + F.sum(v).over(own) for v in values}).drop("_bucket", *[f"_{v}_before" for v in values])


def class_counts(rows: DataFrame, by: list[str], score: Column, positive: Column) -> DataFrame:
    """by, score, pos, neg: how many of either class have each score."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.select(*by, score.cast("double").alias("score"), positive.alias("_p")).groupBy(*by, "score").agg(one(F.col("_p")).alias("pos"), one(~F.col("_p")).alias("neg"))


def auroc(rows: DataFrame, by: list[str], score: Column, positive: Column) -> DataFrame:
    """by, auroc: how often a positive scores above a negative, ties counting half."""
    sums = prefix_sums(class_counts(rows, by, score, positive), by, "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_to") - F.col("neg") / 2.0))
    return sums.groupBy(*by).agg((wins / F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("pos") * F.sum("neg"))).alias("auroc"))


def average_precision(rows: DataFrame, by: list[str], score: Column, positive: Column, name: str = "ap") -> DataFrame:
    """by, name: precision at each distinct score, weighted by the recall gained there."""
    sums = prefix_sums(class_counts(rows, by, -score, positive), by, "score", ["pos", "neg"])
    gained = F.sum(F.col("pos") * F.col("pos_to") / (F.col("pos_to") + F.col("neg_to")))
    return sums.groupBy(*by).agg((gained / F.when(F.sum("pos") > 0, F.sum("pos"))).alias(name))


def quantile_higher(rows: DataFrame, by: list[str], score: str, q: float, name: str) -> DataFrame:
    """by, name: the least score that at least ceil(q (n - 1)) + 1 rows do not exceed."""
    counts = rows.select(*by, F.col(score).cast("double").alias("score")).groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    sums = prefix_sums(counts, by, "score", ["n"])
    met = sums.join(total, by) if by else sums.crossJoin(F.broadcast(total))  # one row
    return met.where(F.col("n_to") >= F.ceil(q * (F.col("_total") - 1)) + 1).groupBy(*by).agg(F.min("score").alias(name))


def fpr_at_tpr(rows: DataFrame, by: list[str], score: str, is_ood: Column, tpr: float = 0.95, name: str = "fpr95") -> DataFrame:
    """by, name: the share of outside rows taken for inside ones where ``tpr`` of the inside ones are."""
    limit = quantile_higher(rows.where(~is_ood), by, score, tpr, "_limit")
    outside = rows.where(is_ood).select(*by, F.col(score).alias("_s"))
    met = outside.join(limit, by) if by else outside.crossJoin(F.broadcast(limit))  # one row
    return met.groupBy(*by).agg(F.avg((F.col("_s") <= F.col("_limit")).cast("double")).alias(name))


def ood_metrics(rows: DataFrame, by: list[str], score: str, is_ood: Column) -> DataFrame:
    """by, auroc, aupr_in, aupr_out, fpr95."""
    s = F.col(score)
    parts = [auroc(rows, by, s, is_ood), average_precision(rows, by, -s, ~is_ood, "aupr_in"), average_precision(rows, by, s, is_ood, "aupr_out"), fpr_at_tpr(rows, by, score, is_ood)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by, "left") if by else out.crossJoin(F.broadcast(part))  # one row
    return out


def best_threshold(rows: DataFrame, by: list[str], score: Column, answerable: Column) -> DataFrame:
    """by, threshold, accuracy, false_answer, false_abstain of the score from which answering is right most often.

    Candidates are all scores and +infinity; the lowest of equals is taken.
    """
    counts = class_counts(rows, by, score, answerable)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    sums = prefix_sums(counts, by, "score", ["pos", "neg"])
    tried = sums.select(*by, F.col("score").alias("threshold"), (F.col("pos_to") - F.col("pos")).alias("_missed"), (F.col("neg_to") - F.col("neg")).alias("_declined"))
    never = totals.select(*by, F.lit(float("inf")).alias("threshold"), F.col("_pos").alias("_missed"), F.col("_neg").alias("_declined"))
    met = tried.unionByName(never)
    met = met.join(totals, by) if by else met.crossJoin(F.broadcast(totals))  # one row
    right = (F.col("_pos") - F.col("_missed") + F.col("_declined")) / (F.col("_pos") + F.col("_neg"))
    judged = met.select(*by, "threshold", right.alias("accuracy"), ((F.col("_neg") - F.col("_declined")) / F.when(F.col("_neg") > 0, F.col("_neg"))).alias("false_answer"), (F.col("_missed") / F.when(F.col("_pos") > 0, F.col("_pos"))).alias("false_abstain"))
    best = F.max_by(F.struct("threshold", "accuracy", "false_answer", "false_abstain"), F.struct(F.round("accuracy", 12), -F.col("threshold")))
    return judged.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def roc_curve(rows: DataFrame, score: Column, positive: Column, points: int = 200) -> DataFrame:
    """point, threshold, fpr, tpr at evenly spaced quantiles of all scores, from the highest down."""
    all_ = rows.select(score.cast("double").alias("score"), positive.alias("_p"))
    shares = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    cuts = all_.agg(F.percentile("score", shares).alias("_c")).select(F.posexplode(F.reverse("_c")).alias("point", "threshold"))
    # a broadcast of `points` thresholds: each row adds to those it reaches
    met = all_.join(F.broadcast(cuts), F.col("score") >= F.col("threshold"))
    hits = met.groupBy("point", "threshold").agg(F.count_if("_p").alias("_tp"), F.count_if(~F.col("_p")).alias("_fp"))
    totals = all_.agg(F.count_if("_p").alias("_pos"), F.count_if(~F.col("_p")).alias("_neg"))
    return hits.crossJoin(F.broadcast(totals)).select("point", "threshold", (F.col("_fp") / F.when(F.col("_neg") > 0, F.col("_neg"))).alias("fpr"), (F.col("_tp") / F.when(F.col("_pos") > 0, F.col("_pos"))).alias("tpr"))  # one row


def risk_coverage(rows: DataFrame, by: list[str], uncertainty: str, correct: Column, key: str) -> DataFrame:
    """by, key, n, coverage, risk when rows are answered most certain first; ties go by ``key``."""
    marked = rows.select(*by, key, F.col(uncertainty).cast("double").alias("_u"), F.lit(1).alias("one"), (~correct).cast("int").alias("wrong"))
    sums = prefix_sums(marked, by, "_u", ["one", "wrong"], (key,))
    totals = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    met = sums.join(totals, by) if by else sums.crossJoin(F.broadcast(totals))  # one row
    return met.select(*by, key, F.col("one_to").alias("n"), (F.col("one_to") / F.col("_total")).alias("coverage"), (F.col("wrong_to") / F.col("one_to")).alias("risk"), F.col("_total").alias("total"))


def selective(curve: DataFrame, by: list[str], coverages: tuple[float, ...] = (0.8, 0.9)) -> DataFrame:
    """by, aurc and the accuracy at each coverage, of a risk_coverage() table."""
    at = lambda c: F.greatest(F.lit(1), F.least(F.col("total"), F.ceil(F.col("total") * c)))
    return curve.groupBy(*by).agg(F.avg("risk").alias("aurc"), *[F.max(F.when(F.col("n") == at(c), 1 - F.col("risk"))).alias(f"acc_at_{round(100 * c)}") for c in coverages])


def bootstrap(pairs: DataFrame, by: list[str], delta: str, key: str, resamples: int = 2000, least: int = 8, seed: int = 0, block: int = 4096) -> DataFrame:
    """by, n, delta, ci_low, ci_high, significant: a 95 % interval of the mean difference by resampled means.

    The draws of a resample are hashes of its number, the draw's and the seed, so any engine finds the same. Pairs are
    numbered in the order of ``key`` (a number); a task draws ``block`` of a resample's draws, and only sums of draws meet.
    """
    ones = pairs.select(*by, key, F.col(delta).cast("double").alias("_x"), F.lit(1).alias("one"))
    placed = prefix_sums(ones, by, key, ["one"], ("_x",)).select(*by, F.col("one_to").alias("_at"), "_x")
    plain = ones.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("delta"))
    boots = plain.where("n > 0").select(*by, "n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_boot"))
    blocks = boots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))).alias("_block"))
    # few and small rows that stand for many draws: a given number of partitions, else they are put together into one
    dealt = blocks.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_boot", "_block")
    draws = dealt.select(*by, "n", "_boot", F.explode(F.sequence(F.col("_block") * block + 1, F.least((F.col("_block") + 1) * block, F.col("n")))).alias("_draw"))
    drawn = draws.select(*by, "n", "_boot", (draw_index(F.col("_boot"), F.col("_draw"), F.col("n"), seed) + 1).cast("long").alias("_at"))
    means = drawn.join(broadcast_if_small(placed, 1_000_000), [*by, "_at"]).groupBy(*by, "_boot").agg((F.sum("_x") / F.first("n")).alias("_mean"))
    sorted_ = means.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_mean")))  # `resamples` rows a key
    low, high = int(0.025 * resamples) + 1, int(0.975 * resamples)
    ends = sorted_.groupBy(*by).agg(F.max(F.when(F.col("_rank") == low, F.col("_mean"))).alias("_low"), F.max(F.when(F.col("_rank") == high, F.col("_mean"))).alias("_high"))
    met = plain.join(ends, by) if by else plain.crossJoin(F.broadcast(ends))  # one row
    wide = F.col("n") >= least
    return met.select(*by, "n", "delta", F.when(wide, F.col("_low")).alias("ci_low"), F.when(wide, F.col("_high")).alias("ci_high"), F.when(wide, (F.round("_low", 12) > 0) | (F.round("_high", 12) < 0)).alias("significant"))


def draw_index(boot: Column, draw: Column, n: Column, seed: int) -> Column:
    """The index from 0 that a draw of a resample takes."""
    text = F.concat_ws(":", F.lit(str(seed)), boot.cast("string"), draw.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")
