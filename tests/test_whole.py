"""Queries over all rows and whole texts, against brute force on small tables."""

import math
import os
from collections import Counter
from hashlib import md5

import oracle
import pytest
from pyspark.sql import functions as F

from corvane import catalog
from corvane.operators import statistics as S
from corvane.plans import evaluation
from corvane.plans import text as P

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
catalog.load()


def folder(path, **tables) -> str:
    """A folder with the given tables; the others are those of SF."""
    for name in os.listdir(SF):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{SF}/{name}", f"{path}/{name}")
    for name, frame in tables.items():
        frame.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def nearest_elsewhere(docs):
    """(qid, chunk_id, score) of (doc_id, source, text), one pair at a time."""
    words = {i: t.split() for i, _, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    idf = {t: math.log((len(words) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: low if x < 0 else x for t, x in idf.items()}
    out = []
    for q, own, _ in docs:
        met = []
        for c, paper, _ in docs:
            tf = Counter(words[c])
            score = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(words[c]) / mean)) for t in words[q] if t in tf)
            if paper != own and score > 0:
                met.append((-round(score, 9), c, score))
        if met:
            out.append((q, min(met)[1], round(min(met)[2], 6)))
    return sorted(out)


def test_cross_doc_nearest_asks_with_whole_texts(spark, tmp_path):
    opening = [" ".join(f"{x}{i}" for i in range(35)) for x in ("aa", "bb", "cc", "dd", "ee")]
    late = " ".join(f"shared{i}" for i in range(12))
    docs = [(1, "p", f"{opening[0]} {late}"), (2, "q", f"{opening[1]} {late} {late}"), (3, "q", f"{opening[2]} aa1 aa2"), (25, "r", f"{opening[3]} bb3 shared1"), (26, "s", opening[4]), (50, "r", "aa5 cc1 cc2 shared2")]
    sf = folder(tmp_path, documents=spark.createDataFrame(docs, "doc_id long, source string, text string"))
    rows = catalog.QUERIES["cross_doc_nearest"](spark, sf).collect()
    got, want = sorted((r.qid, r.chunk_id, r.score) for r in rows), nearest_elsewhere(docs)
    assert [r[:2] for r in got] == [r[:2] for r in want] and dict((r[0], r[1]) for r in got)[1] == 2
    assert all(math.isclose(g[2], w[2], abs_tol=2e-6) for g, w in zip(got, want))


def interval(values, resamples=2000):
    """n, delta, ci_low, ci_high of differences in the order of their keys, one draw at a time."""
    n = len(values)
    means = sorted(sum(values[int(md5(f"0:{b}:{i}".encode()).hexdigest()[:8], 16) % n] for i in range(1, n + 1)) / n for b in range(1, resamples + 1))
    return n, sum(values) / n, means[int(0.025 * resamples)], means[int(0.975 * resamples) - 1]


def delta_rows(spark):
    return evaluation.scored(spark, SF).select("doc_id", (F.col("score") / 97 - F.col("answerable").cast("int")).alias("delta"))


def test_paired_bootstrap_takes_every_pair(spark):
    want = interval([r.delta for r in delta_rows(spark).orderBy("doc_id").collect()])
    got = catalog.QUERIES["paired_bootstrap"](spark, SF).first()
    assert got.n == want[0] == spark.read.parquet(f"{SF}/labels.parquet").count()
    assert all(math.isclose(g, w, abs_tol=2e-9) for g, w in zip(got[1:4], want[1:]))
    assert got.significant == (want[2] > 0 or want[3] < 0)


def test_bootstrap_in_blocks_and_by_keys(spark):
    rows = delta_rows(spark).withColumn("k", F.col("doc_id") % 2)
    got = {r.k: r for r in S.bootstrap(rows, ["k"], "delta", "doc_id", resamples=200, block=7).collect()}
    for k in (0, 1):
        want = interval([r.delta for r in rows.where(F.col("k") == k).orderBy("doc_id").collect()], 200)
        assert got[k].n == want[0] and all(math.isclose(g, w, abs_tol=1e-9) for g, w in zip(got[k][2:5], want[1:]))


def test_bootstrap_agrees_with_sql(spark):
    got = evaluation.rounded(S.bootstrap(delta_rows(spark), [], "delta", "doc_id"), ["delta", "ci_low", "ci_high"])
    assert oracle.differences(got, catalog.ORACLE_SQL["paired_bootstrap"], oracle.connect(SF)) == []


def test_to_documents_keeps_whole_texts(spark):
    rows = catalog.QUERIES["to_documents"](spark, SF)
    assert oracle.differences(rows, catalog.ORACLE_SQL["to_documents"], oracle.connect(SF)) == []
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows.collect()
    assert got and any(len(r.page_content) > 40 for r in got)
    assert all(r.page_content == texts[int(r.metadata.split("chunk=")[1].split(";")[0])] for r in got)


def test_attach_evidence_fills_from_every_document(spark, tmp_path):
    long = "evidence of a query that goes on " * 4
    docs = [(0, "unused"), (1, f"odd {long}"), (2, f"even {long}"), (3, "for a blank one"), (4, " \n"), (7, "seven")]
    items = [(0, f"own {long}"), (1, "a"), (2, "b"), (3, " "), (4, "c"), (5, "d"), (7, "e")]
    sf = folder(tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = {r.qid: r.evidence for r in catalog.QUERIES["attach_evidence"](spark, sf).collect()}
    assert got == {0: f"own {long}", 1: f"odd {long}", 2: f"even {long}", 3: "for a blank one", 4: None, 5: None, 7: "seven"}


TEXT_SQL = {
    "citation_density": (f"SELECT -1 - doc_id AS id, round({P._DENSITY}, 9) AS density FROM documents", 200),
    "table_like": (f"SELECT -1 - doc_id AS id, {P._table_like('w')} AS table_like FROM (SELECT doc_id, {P.WORDS('text')} AS w FROM documents)", 200),
    "table_chunks": (f"SELECT -1 - doc_id AS id FROM (SELECT doc_id, {P.WORDS('text')} AS w FROM documents) WHERE doc_id % 7 <> 0 AND {P._HAS_TABLE}", 3),
    "bm25_tokens": (f"SELECT -1 - doc_id AS id, array_to_string({P.TOKENS('text')}, ' ') AS tokens FROM documents", 200),
}


@pytest.mark.parametrize("key", sorted(TEXT_SQL))
def test_text_queries_take_every_document(spark, tmp_path, key):
    cells = " ".join(["76", "84", "9.1"] * 10)
    docs = [(i, f"Words of {i} before CIFAR-10 [1] et al. " * 40 + (cells if i in (3, 7, 150, 199) else "") + " and after. " * (i % 9)) for i in range(200)]
    sf = folder(tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string"))
    rows, con = catalog.QUERIES[key](spark, sf), oracle.connect(sf)
    sql, least = TEXT_SQL[key]
    assert rows.where("id < 0").count() >= least
    assert oracle.differences(rows.where("id < 0"), sql, con) == []
    assert oracle.differences(rows, catalog.ORACLE_SQL[key], con) == []
    con = oracle.connect(SF)
    assert oracle.differences(catalog.QUERIES[key](spark, SF).where("id < 0"), sql, con) == []
