"""The shared sweep against a search for each configuration, and its queries against SQL."""

import random

from pyspark.sql import functions as F

from corvane.operators import retrieval_metrics as M
from corvane.plans.search import CONFIGS, Config, Corpus, search
from corvane.plans.sweep import first_stages, sweep, sweep_apart



def test_configurations_share_first_stages():
    stages, at = first_stages(CONFIGS)
    assert len(CONFIGS) == 26 and set(at) == set(CONFIGS)
    assert len(stages) == 14  # 4 modes as 3, 4 rephrased as 3, 2 weights, 6 further depths
    assert len({at[c] for c in ("hybrid", "hybrid_rerank", "rerank_mmr0.5", "rerank_cap1", "rerank_refs_excluded")}) == 1


def small_corpus(spark):
    own = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: own.choices(words, k=n)
    vector = lambda: [round(own.gauss(0, 1), 3) for _ in range(4)]
    chunks = [(i, own.choice("pqr"), i % 4 == 0, text(own.randint(0, 15))) for i in range(60)]
    vectors = [(i, vector()) for i in range(60) if i % 9]
    queries = [(q, text(4), vector() if q else None) for q in range(5)] + [(9, [], vector())]
    variants = [(q, v, text(3), vector() if v != 1 else None) for q in range(5) for v in range(3)]
    return Corpus(
        spark.createDataFrame(chunks, "chunk_id int, paper string, is_reference boolean, tokens array<string>"),
        spark.createDataFrame(vectors, "chunk_id int, vector array<double>"),
        spark.createDataFrame(queries, "qid int, tokens array<string>, vector array<double>"),
        spark.createDataFrame(variants, "qid int, variant int, tokens array<string>, vector array<double>"),
    )


CHOSEN = {n: CONFIGS[n] for n in ("dense", "hybrid_rerank+mq3", "hybrid_weighted_a0.3", "rerank_cand8", "rerank_hardcap1", "rerank_refs", "rerank_refs_excluded", "rerank_mmr0.5")}
CHOSEN |= {"floor": Config(mode="bm25", min_score=0.02, per_paper=1, variants=2), "weighted variants": Config(mode="hybrid", fusion="weighted", alpha=0.6, variants=2, candidates=5)}


def test_every_configuration_is_ranked_as_its_own_search_ranks(spark):
    corpus = small_corpus(spark)
    got = {}
    for r in sweep(corpus, CHOSEN, 6).collect():
        got.setdefault(r.config, []).append((r.qid, r["rank"], r.chunk_id, round(r.score, 9)))
    assert set(got) == set(CHOSEN)
    for name, config in CHOSEN.items():
        want = [(r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in search(corpus, config, 6).collect()]
        assert sorted(got[name]) == sorted(want), name


def test_without_rephrasings_configurations_search_the_query_itself(spark):
    corpus = small_corpus(spark)
    corpus.variants = None
    rows = sweep(corpus, {"a": Config(mode="bm25", variants=3), "b": Config(mode="bm25")}, 4)
    assert rows.where(F.col("config") == "a").drop("config").exceptAll(rows.where(F.col("config") == "b").drop("config")).count() == 0


def test_each_cutoff_is_a_search_of_its_own(spark):
    corpus = small_corpus(spark)
    chosen = {n: CHOSEN[n] for n in ("hybrid_rerank+mq3", "rerank_hardcap1", "rerank_mmr0.5", "floor")} | {"cap1": Config(per_paper=1)}
    got = {}
    for r in sweep_apart(corpus, chosen, (1, 3, 6)).collect():
        got.setdefault((r.config, r.cutoff), []).append((r.qid, r["rank"], r.chunk_id, round(r.score, 9)))
    for name, config in chosen.items():
        for k in (1, 3, 6):
            assert sorted(got[name, k]) == sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in search(corpus, config, k).collect()), (name, k)
    assert sorted(got["cap1", 3]) != sorted(r for r in got["cap1", 6] if r[1] <= 3)


def test_metrics_at_k_are_of_the_search_for_k(spark):
    runs = [("c", 1, 1, "y", 1), ("c", 1, 2, "x", 1), ("c", 1, 2, "y", 2), ("c", 1, 3, "y", 1), ("c", 1, 3, "z", 2), ("c", 1, 3, "x", 3)]
    ranking = spark.createDataFrame(runs, "config string, qid int, cutoff int, chunk_id string, rank int")
    labels = spark.createDataFrame([(1, "x"), (1, "w")], "qid int, chunk_id string")
    row = M.per_query(ranking, labels, ranking.select("config", "qid"), ["config", "qid"], (1, 2, 3), "cutoff").first()
    assert (row.recall_1, row.recall_2, row.recall_3) == (0.0, 0.5, 0.5) and row.success_2 == 1.0
    assert abs(row.mrr - 1 / 3) < 1e-12 and abs(row.ndcg_2 - 1 / (1 + 1 / 1.584962500721156)) < 1e-9
