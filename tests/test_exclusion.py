"""Search with exclusions, and what a judge is asked."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators.enrich import as_documents, judge_prompt
from corvane.operators.index import bm25
from corvane.plans.search import lexical_excluding


@pytest.mark.parametrize("share", [0.0, 0.5, 0.97])
def test_excluded_chunks_never_come_up_and_others_fill(spark, share):
    own = random.Random(int(share * 100))
    chunks = [(i, own.choices([f"w{k}" for k in range(40)], k=own.randint(0, 4))) for i in own.sample(range(1000), 200)]
    queries = [(q, own.sample([f"w{k}" for k in range(44)], 2)) for q in range(12)] + [(50, []), (51, ["none"])]
    gone = {(q, c) for q, _ in queries for c, _ in sorted(chunks)[: int(len(chunks) * share)]} | {(51, c) for c, _ in chunks[:195]}
    docs = spark.createDataFrame(chunks, "chunk_id int, tokens array<string>")
    asked = spark.createDataFrame(queries, "qid int, tokens array<string>")
    excluded = spark.createDataFrame(sorted(gone), "qid int, chunk_id int")
    scores = {(r.qid, r.chunk_id): round(r.score, 9) for r in bm25(docs, asked).collect()}
    want = []
    for q, _ in queries:
        left = sorted((-scores.get((q, c), 0.0), c) for c, _ in chunks if (q, c) not in gone)
        want += [(q, n, c) for n, (_, c) in enumerate(left[:5], 1)]
    got = lexical_excluding(docs, asked, excluded, 5).collect()
    assert sorted((r.qid, r["rank"], r.chunk_id) for r in got) == sorted(want)


def test_a_judge_gets_numbered_sentences_and_quotes_that_say_something(spark):
    rows = spark.createDataFrame([("src\n", "Why?", ["One.", "Two."], ["q", " ", None]), ("src\n", "Why?", [], None)], "s string, q string, a array<string>, e array<string>")
    first, second = (r.p for r in rows.select(judge_prompt(F.col("s"), F.col("q"), F.col("a"), F.col("e")).alias("p")).collect())
    assert first == "src\n\n\nQuestion: Why?\n\nAnswer, split into sentences:\nSENTENCE 1: One.\nSENTENCE 2: Two.\n\nReference quote(s) the question was written from:\n- q"
    assert second == "src\n\n\nQuestion: Why?\n\nAnswer, split into sentences:\n\nNo reference quote is given."


def test_documents_have_the_fields_that_hits_have(spark):
    hits = spark.createDataFrame([(1, "c", "text", 2017, "other")], "qid int, chunk_id string, text string, year int, more string")
    found = as_documents(hits, "qid").first()
    assert (found.page_content, found.metadata.asDict()) == ("text", {"chunk_id": "c", "year": 2017})
