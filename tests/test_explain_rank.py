"""explain_rank ranks all pairs, but scores and shuffles them once."""

from pyspark.sql import functions as F

from corvane import catalog
from corvane.operators import ranking as R

SF = "/root/testdata/sf0.001"


def test_all_pairs_are_scored_and_shuffled_once(spark):
    plan = catalog.QUERIES["explain_rank"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow run(") == 2  # pairs of blocks of vectors, pairs of blocks of chunks
    # by query: the pairs, and at most the few rows asked for and the join of both
    assert plan.count("Exchange hashpartitioning(qid") + plan.count("Exchange hashpartitioning(chunk_id") <= 3


def test_places_equal_ranks_and_fusion_by_themselves(spark):
    pairs = spark.range(6000).select((F.col("id") % 7).alias("qid"), F.floor(F.col("id") / 7).alias("chunk_id"), (F.col("id") * 37 % 11).cast("double").alias("score"))
    lists = [pairs.where("chunk_id % 3 <> 0"), pairs.where("chunk_id % 5 <> 1").withColumn("score", F.col("chunk_id") % 13 * 0.5)]
    got = {(r.qid, r.chunk_id): (r.a, r.b, r.both) for r in R.placed(lists, ["a", "b"], "both", ["qid"]).collect()}
    each = [R.ranked(rows, ["qid"]) for rows in lists]
    a, b = ({(r.qid, r.chunk_id): r["rank"] for r in rows.collect()} for rows in each)
    both = R.ranked(R.rrf(each, ["qid"]), ["qid"], ties=("seen", "chunk_id")).collect()
    assert got == {(r.qid, r.chunk_id): (a.get((r.qid, r.chunk_id)), b.get((r.qid, r.chunk_id)), r["rank"]) for r in both}
