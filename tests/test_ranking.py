"""Ranking, fusion and selection against small models in Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import ranking as R
from corvane.operators import retrieval_metrics as M


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def greedy_cap(rows, k, most, share, hard):
    """One query's (chunk, paper, score), best first, taken one at a time."""
    if most <= 0:
        return [c for c, _, _ in rows][:k]
    top = rows[0][2]
    floor = top * share if share > 0 and top > 0 else float("-inf")
    taken, held, low, full = [], {}, [], []
    for n, (chunk, paper, score) in enumerate(rows):
        if held.get(paper, 0) >= most:
            full.append((-score, 1, n, chunk, paper))
        elif score < floor:
            low.append((-score, 0, n, chunk, paper))
        else:
            taken.append((-score, len(taken), chunk))
            held[paper] = held.get(paper, 0) + 1
    taken = taken[:k]
    spare = low if hard else low + full
    for score, _, n, chunk, paper in sorted(spare, key=lambda r: (r[0], r[1], r[2])):
        if len(taken) == k:
            break
        if hard and held.get(paper, 0) >= most:
            continue
        held[paper] = held.get(paper, 0) + 1
        taken.append((score, 1000 + len(taken), chunk))
    return [c for _, _, c in sorted(taken, key=lambda t: (t[0], t[1]))]


def test_diversity_cap_follows_the_greedy_model(spark):
    rng = random.Random(3)
    cases, rows = {}, []
    for q in range(150):
        n = rng.randint(1, 12)
        scores = sorted((rng.choice([rng.uniform(-1, 1), rng.randint(0, 4) / 4]) for _ in range(n)), reverse=True)
        cases[q] = [(f"c{i:02}", rng.choice("abcd"), s) for i, s in enumerate(scores)]
        rows += [(q, c, p, float(s), i + 1) for i, (c, p, s) in enumerate(cases[q])]
    df = frame(spark, rows, "qid int, chunk_id string, paper string, score double, rank int").cache()
    for most, share, hard in ((2, 0.25, False), (1, 0.5, True), (1, 0.0, False), (2, 0.6, True), (0, 0.25, False)):
        got = {}
        for r in R.diversity_cap(df, ["qid"], 5, most, share, hard).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.chunk_id)
        for q, case in cases.items():
            assert got.get(q, []) == greedy_cap(case, 5, most, share, hard), (q, most, share, hard)


def test_mmr_prefers_unlike_rows(spark):
    rows = [("q", "a", 1.0, 1, [1.0, 0.0]), ("q", "b", 0.9, 2, [1.0, 0.0]), ("q", "c", 0.5, 3, [0.0, 1.0])]
    df = frame(spark, rows, "qid string, chunk_id string, score double, rank int, vector array<double>")
    pick = lambda w: [r.chunk_id for r in R.mmr(df, ["qid"], 2, w).orderBy("rank").collect()]
    assert pick(0.5) == ["a", "c"]
    assert pick(1.0) == ["a", "b"]


def test_rrf_and_weighted(spark):
    a = frame(spark, [("q", "x", 3.0, 1), ("q", "y", 1.0, 2)], "qid string, chunk_id string, score double, rank int")
    b = frame(spark, [("q", "y", 9.0, 1), ("q", "z", 9.0, 2)], "qid string, chunk_id string, score double, rank int")
    fused = {r.chunk_id: r.score for r in R.rrf([a, b], ["qid"]).collect()}
    assert np.isclose(fused["y"], 1 / 62 + 1 / 61) and np.isclose(fused["x"], 1 / 61)
    mixed = {r.chunk_id: r.score for r in R.weighted(a, b, ["qid"], 0.3).collect()}
    assert mixed == {"x": 0.3, "y": 0.7, "z": 0.7}


def test_demotion_interpolates_to_the_least(spark):
    rows = [("q", "a", 0.98, 1, True), ("q", "b", 0.40, 2, False), ("q", "c", 0.0, 3, False)]
    df = frame(spark, rows, "qid string, chunk_id string, score double, rank int, is_reference boolean")
    got = [(r.chunk_id, r.score) for r in R.demote(df, ["qid"], 0.5).orderBy("rank").collect()]
    assert got == [("a", 0.49), ("b", 0.40), ("c", 0.0)]


def test_metrics_by_hand(spark):
    ranking = frame(spark, [("q", c, i) for i, c in enumerate("abcde", 1)] + [("s", "a", 1), ("s", "b", 2)], "qid string, chunk_id string, rank int")
    labels = frame(spark, [("q", "b"), ("q", "d"), ("q", "zz"), ("s", "zz")], "qid string, chunk_id string")
    asked = frame(spark, [("q",), ("s",), ("none",), ("empty",)], "qid string")
    got = {r.qid: r for r in M.per_query(ranking, labels, asked, ["qid"], (2, 5)).collect()}
    assert np.isclose(got["q"].recall_2, 1 / 3) and np.isclose(got["q"].precision_5, 2 / 5) and got["q"].mrr == 0.5
    assert got["s"].precision_5 == 0 and got["s"].mrr == 0 and got["s"].success_5 == 0
    assert got["none"].mrr is None and got["none"].recall_5 is None
    best = 1 + 1 / np.log2(3) + 0.5
    assert np.isclose(got["q"].ndcg_5, (1 / np.log2(3) + 1 / np.log2(5)) / best)


def test_local_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "qid long, vector array<double>")
    got = {}
    for r in R.dense(vectors, queries, 4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    for q in range(7):
        assert got[q] == np.argsort(-np.round(x @ x[q], 9), kind="stable")[:4].tolist()
    assert R.dense(vectors, queries, 4, block=3).count() == 28
    assert F is not None
