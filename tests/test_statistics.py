"""Statistics of scores against definitions written out in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import uncertainty as U
from corvane.operators import statistics as S


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(np.round(rng.normal() + (i % 3 == 0), 1)), bool(i % 3 == 0)) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id long, score double, positive boolean").cache()


def pairs_auroc(pos, neg):
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auroc_and_ap(scored):
    rows, df = scored
    pos, neg = [s for _, s, p in rows if p], [s for _, s, p in rows if not p]
    assert np.isclose(S.auroc(df, [], F.col("score"), F.col("positive")).first()[0], pairs_auroc(pos, neg))
    best = sorted({s for _, s, _ in rows}, reverse=True)
    recall = [sum(p >= t for p in pos) / len(pos) for t in best]
    precision = [sum(p >= t for p in pos) / sum(s >= t for _, s, _ in rows) for t in best]
    ap = sum((r - b) * q for r, b, q in zip(recall, [0, *recall], precision))
    assert np.isclose(S.average_precision(df, [], F.col("score"), F.col("positive")).first()[0], ap)


@pytest.mark.parametrize("rows,want", [([(1.0, True), (0.0, False)], 1.0), ([(0.0, True), (1.0, False)], 0.0), ([(1.0, True), (1.0, False)], 0.5), ([(1.0, True)], None)])
def test_auroc_extremes(spark, rows, want):
    df = spark.createDataFrame(rows, "score double, positive boolean")
    assert S.auroc(df, [], F.col("score"), F.col("positive")).first()[0] == want


def test_quantile_higher(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "score double")
    assert S.quantile_higher(df, [], "score", 0.95, "q").first()[0] == np.quantile(np.arange(100.0), 0.95, method="higher")


def test_threshold(scored):
    rows, df = scored
    got = S.best_threshold(df, [], F.col("score"), F.col("positive")).first()
    tried = [*sorted({s for _, s, _ in rows}), float("inf")]
    accuracy = [np.mean([(s >= t) == p for _, s, p in rows]) for t in tried]
    assert got.threshold == tried[int(np.argmax(accuracy))] and np.isclose(got.accuracy, max(accuracy))


def test_risk_coverage(scored):
    rows, df = scored
    curve = S.risk_coverage(df, [], "score", F.col("positive"), "id").orderBy("n").collect()
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    wrong = np.cumsum([not p for _, _, p in order]) / np.arange(1, len(order) + 1)
    assert np.allclose([r.risk for r in curve], wrong)


def test_few_pairs_have_no_interval(spark):
    df = spark.createDataFrame([(i, 0.1 * i) for i in range(5)], "qid int, delta double")
    got = S.bootstrap(df, [], "delta", "qid", resamples=40).first()
    assert got.ci_low is None and got.significant is None and np.isclose(got.delta, 0.2)


def test_scores_at_their_ends(spark):
    one = spark.range(1)
    hot, even = F.array(*[F.lit(x) for x in (1.0, 0.0)]), F.array(*[F.lit(0.25)] * 4)
    got = one.select(
        U.msp(hot).alias("a"), U.entropy(even).alias("b"), U.mutual_information(F.array(hot, F.reverse(hot))).alias("c"), U.mutual_information(F.array(hot, hot)).alias("d"),
        U.vacuity(F.array(*[F.lit(1.0)] * 3)).alias("e"), U.brier(hot, F.lit(0)).alias("f"), U.nll(hot, F.lit(1)).alias("g"),
    ).first()
    assert np.allclose(list(got), [0, np.log(4), np.log(2), 0, 1, 0, -np.log(1e-12)], atol=1e-9)


def test_digamma():
    x = np.array([0.5, 1.0, 3.0, 12.0])
    assert np.allclose(U.digamma(x), [-1.9635100260214235, -0.5772156649015329, 0.9227843350984671, 2.4426616799758123])
