"""Lexical search by blocks of queries and chunks; passages by pairs of columns."""

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from corvane.functions.text import search_tokens, token_text
from corvane.operators.index import _runs, bm25, build_index, containing, holding

WORDS = "gradient model sparse attention tensor kernel dropout margin entropy lattice".split()


def rows(n: int) -> list[tuple]:
    """Texts of few words; each third is a copy of the one before."""
    texts = [[WORDS[(7 * i + j * j + i // (j + 1)) % (3 + i % 8)] for j in range(i % 23)] for i in range(n)]
    return [(i, f"p{i % 4}" if i % 11 else None, texts[i - 1] if i % 3 == 2 else texts[i]) for i in range(n)]


def brute(docs: list[tuple]) -> dict[int, tuple[int, float]]:
    """The best of another part, for every row that has one."""
    n, mean = len(docs), sum(len(t) for *_, t in docs) / len(docs)
    df = Counter(w for *_, t in docs for w in set(t))
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    out = {}
    for q, own, asked in docs:
        for c, part, told in docs:
            tf = Counter(told)
            score = sum(idf[w] * k * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(told) / mean)) for w, k in Counter(asked).items() if w in tf)
            if own and part and own != part and score > 0 and (q not in out or (-round(score, 9), c) < (-round(out[q][1], 9), out[q][0])):
                out[q] = (c, score)
    return out


def test_every_chunk_asks_all_of_other_parts(spark):
    docs = rows(90)
    index = build_index(spark.createDataFrame([(i, p, t) for i, p, t in docs], "chunk_id long, part string, tokens array<string>").repartition(7))
    met = bm25(index, None, most=1, apart=True)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # nothing a pair is shuffled
    found = {}
    for r in met.collect():
        if r.qid not in found or (-round(r.score, 9), r.chunk_id) < (-round(found[r.qid][1], 9), found[r.qid][0]):
            found[r.qid] = (r.chunk_id, r.score)
    want = brute(docs)
    assert {q: c for q, (c, _) in found.items()} == {q: c for q, (c, _) in want.items()}
    assert all(abs(found[q][1] - want[q][1]) < 1e-9 for q in want)


def test_copies_score_equally_to_the_last_bit(spark):
    docs = spark.createDataFrame([(i, t) for i, _, t in rows(90)], "chunk_id long, tokens array<string>").repartition(5)
    asked = spark.createDataFrame([(0, WORDS * 3)], "qid long, tokens array<string>")
    scores = {r.chunk_id: r.score for r in bm25(docs, asked).collect()}
    assert all(scores.get(i) == scores.get(i - 1) for i in range(2, 90, 3))


def test_passages_by_their_inner_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "b c d"), (3, "x a  b c\nd e f y"), (4, ""), (5, None), (6, "za b c d e fz"), (7, "a b c d e a b c d e")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "a b c d e"), (2, "b c"), (3, "c d e a b c")], "qid long, text string")
    assert {(r.qid, r.chunk_id) for r in containing(docs, asked).collect()} == {(1, 1), (1, 6), (1, 7), (2, 1), (2, 2), (2, 3), (2, 6), (2, 7), (3, 7)}


def test_files_of_blocks_are_small(spark):
    docs = spark.createDataFrame([(i, ["a", f"b{i}"]) for i in range(60)], "chunk_id long, tokens array<string>").repartition(60).cache()
    index = build_index(docs.repartition(30).coalesce(1))
    per_file = [r["count"] for r in index.blocks.groupBy("_metadata.file_path").count().collect()]
    assert max(per_file) <= 8


def test_whole_texts_of_results_are_not_shuffled(spark):
    from corvane import catalog

    catalog.load()
    rows = catalog.QUERIES["to_documents"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


ODD = ["", None, "EnD² on CIFAR-10, C100", "x-1-2 ab-12c a_b-3", "ﬁne ＡＢ１ İstanbul K9 ſ", "c10", "--", "日本語abc", "end end", "a\u0301b éa1", "é" * 3, "c10 cifar-10 endd c-100"]


def test_texts_are_split_as_the_tokens_are(spark):
    """Texts go into blocks with the tokens that search_tokens() makes of them, and no table of tokens is made."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 3)], "chunk_id long, text string").repartition(3)
    own = build_index(docs.select("chunk_id", token_text(F.col("text")).alias("tokens")))
    want = build_index(docs.select("chunk_id", search_tokens(F.col("text")).alias("tokens")))
    assert sorted(map(tuple, own.terms.collect())) == sorted(map(tuple, want.terms.collect()))

    def postings(index):
        return sorted((b.ids[r], b.lengths[r], b.terms[c], n) for b in index.blocks.collect() for r, c, n in zip(b.row, b.code, b.tf, strict=True))

    assert postings(own) == postings(want) and own.stats.collect() == want.stats.collect()
    parts = pa.array(["zz zz", "ab", "c1", None, "", "d,", "e"]).slice(1)
    assert _runs(parts).to_pylist() == [["ab"], ["c1"], [], [], ["d"], ["e"]]


def test_passages_by_the_index(spark):
    texts = [(1, "a b c d e f"), (2, "b c d"), (3, "x a  b c\nd e f y"), (4, ""), (5, None), (6, "za b c d e fz"), (7, "a b c d e a b c d e"), (8, "f e d c b a"), (9, "p é ü ö ä q"), (10, "u CIFAR-10 C100 ﬁne v w")]
    docs = spark.createDataFrame(texts, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "a b c d e"), (2, "b c"), (3, "c d e a b c"), (4, "p é ü ö ä"), (5, "CIFAR-10 C100 ﬁne v"), (6, "C100 ﬁne v")], "qid long, text string")
    index = build_index(docs.select("chunk_id", token_text(F.col("text")).alias("tokens")))
    own = {(r.qid, r.chunk_id) for r in containing(docs, asked, index).collect()}
    assert own == {(q, c) for q, p in map(tuple, asked.collect()) for c, t in texts if t is not None and p in t}
    few = holding(index, asked.where("qid in (1, 5)").select("qid", token_text(F.col("text")).alias("tokens")))
    assert {r.chunk_id for r in few.collect()} == {1, 3, 7, 8, 10}


def test_modes_are_searched_once(spark):
    """compare_modes has one lexical search, not one for each mode; the sweep goes through whole texts for the pairs it scores only."""
    from corvane import catalog
    from corvane.plans import search, sweep

    catalog.load()
    calls = []
    held = sweep.lexical
    sweep.lexical = lambda *a: calls.append(1) or held(*a)
    try:
        rows = catalog.QUERIES["compare_modes"](spark, "/root/testdata/sf0.001").collect()
    finally:
        sweep.lexical = held
    c = search.corpus(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and c._split is None
    for mode in ("dense", "hybrid_rerank"):
        assert {(r.qid, r.chunk_id, r["rank"]) for r in search.search(c, search.CONFIGS[mode], 3).collect()} == {(r.qid, r.chunk_id, r["rank"]) for r in rows if r["mode"] == mode}
    assert c._split is None
