"""Models as column functions, and searches with a scorer of one's own."""

import sys
from dataclasses import replace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corvane.functions.text import search_tokens
from corvane.operators import chunking as C
from corvane.operators import models as M
from corvane.plans.search import CONFIGS, corpus, search
from corvane.session import table

SF = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counts():
    return lambda texts: [[t.count("a"), t.count("b"), 1.0] for t in texts]


def spans():
    import re

    return lambda texts: [[(len(m[0]), m.start(), m.end()) for m in re.finditer(r"\S+", t)] for t in texts]


def test_models_see_batches_and_nulls_stay(spark):
    rows = spark.createDataFrame([(1, "aab", "b"), (2, None, "a"), (3, "", "a"), (4, "bb", "bb")], "id int, text string, other string").repartition(2)
    sizes = lambda: lambda pairs: [len(a) * 10 + len(b) + 100 * (len(pairs) > 2) for a, b in pairs]
    out = rows.select("id", M.embedder(counts)(F.col("text")).alias("v"), M.reranker(sizes, batch=2)(F.col("text"), F.col("other")).alias("s"), M.tokenizer(spans)(F.col("text")).alias("t"), M.completer(lambda: lambda p: [x.upper() for x in p])(F.col("text")).alias("r"))
    got = {r.id: r for r in out.collect()}
    assert np.allclose(got[1].v, np.array([2, 1, 1]) / np.sqrt(6)) and got[2].v is None
    assert {k: r.s for k, r in got.items()} == {1: 31.0, 2: None, 3: 1.0, 4: 22.0}
    assert [tuple(t) for t in got[1].t] == [(3, 0, 3)] and got[3].t == []
    assert {k: r.r for k, r in got.items()} == {1: "AAB", 2: None, 3: "", 4: "BB"}


def test_a_model_that_loses_rows_is_told(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    with pytest.raises(Exception, match="1 values for 2 rows"):
        rows.select(M.completer(lambda: lambda p: p[:1])(F.col("text"))).collect()


def test_search_takes_a_scorer(spark):
    held = corpus(spark, SF)
    texts = table(spark, SF, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    items = table(spark, SF, "benchmark").select(F.col("item_id").alias("qid"), "text")

    def overlap():
        tokens = lambda t: {*t.lower().split()}
        return lambda pairs: [len(tokens(a) & tokens(b)) for a, b in pairs]

    own = replace(held, chunks=held.chunks.join(texts, "chunk_id"), queries=held.queries.join(items, "qid"), scorer=M.reranker(overlap), scored="text")
    rows = search(own, CONFIGS["hybrid_rerank"], 5).collect()
    words = {r.chunk_id: {*(r.text or "").lower().split()} for r in texts.collect()}
    asked = {r.qid: {*r.text.lower().split()} for r in items.collect()}
    tagged = {i for i in words if i % 7 == 0}
    assert rows and all(r.score == len(words[r.chunk_id] & asked[r.qid]) for r in rows if r.chunk_id not in tagged)


def test_semantic_breaks_by_an_embedder(spark):
    docs = spark.createDataFrame([(1, "Aa aa. Ab aa. Bb bb. Bb bb.")], "doc_id int, text string")
    sents = docs.select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("sentence", "s"))
    vectors = sents.withColumn("vector", M.embedder(lambda: lambda t: [[x.lower().count("a"), x.lower().count("b")] for x in t])(F.col("s")))
    assert [r.sentence for r in C.semantic_breaks(vectors, percentile=0.6).collect()] == [1]
    assert search_tokens is not None
