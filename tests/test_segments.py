"""Published versions, and the index of segments against one that is built anew."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.text import search_tokens
from corvane.operators import ranking as R
from corvane.operators import segments as G
from corvane.operators.index import bm25
from corvane.sources import manifest
from corvane.sources.files import read_index, write_index
from corvane.streaming.sessions import index_sessions

ROWS = "scope string, chunk_id int, tokens array<string>, vector array<double>"


def chunks(own, scope, ids):
    words = ["the", "of", *[f"w{i}" for i in range(25)], f"only {scope}"]
    return [(scope, i, ["the", *own.choices(words, k=own.randint(0, 12))] if i % 7 else [], [own.gauss(0, 1) for _ in range(3)] if i % 5 else None) for i in ids]


def same_as_rebuilt(spark, view, rows, queries):
    """Each query over an index built from the corpus and its own scope."""
    asked = spark.createDataFrame(queries, "qid int, scope string, tokens array<string>, vector array<double>")
    lexical = sorted((r.qid, r.chunk_id, round(r.score, 9)) for r in view.lexical(asked).collect())
    dense = sorted((r.qid, r["rank"], r.chunk_id) for r in view.dense(asked, 7).collect())
    want, near = [], []
    for scope in sorted({q[1] for q in queries}):
        held = spark.createDataFrame([r for r in rows if r[0] in (G.CORPUS, scope)], ROWS)
        own = asked.where(F.col("scope") == scope)
        want += [(r.qid, r.chunk_id, round(r.score, 9)) for r in bm25(held.select("chunk_id", "tokens"), own.select("qid", "tokens")).collect()]
        near += [(r.qid, r["rank"], r.chunk_id) for r in R.dense(held.where("vector is not null").select("chunk_id", "vector"), own.where("vector is not null").select("qid", "vector"), 7).collect()]
    assert lexical == sorted(want)
    assert dense == sorted(near)


def test_an_index_of_segments_equals_one_built_anew(spark, tmp_path):
    own = random.Random(3)
    corpus, a1, a2, b = chunks(own, "", range(40)), chunks(own, "a", range(100, 104)), chunks(own, "a", range(110, 113)), chunks(own, "b", range(200, 230))
    queries = [(q, s, ["the", f"only {s}", *own.choices([f"w{i}" for i in range(25)], k=3)], [own.gauss(0, 1) for _ in range(3)] if q else None) for q, s in enumerate(["a", "b", "c", "a", "b"])]
    make = lambda rows: spark.createDataFrame(rows, ROWS)
    first = G.add(manifest.opened(spark, str(tmp_path)), make(corpus[:25]))
    whole = G.add(G.add(G.add(first, make(corpus[25:])), make(a1 + b)), make(a2))
    same_as_rebuilt(spark, G.View(whole), corpus + a1 + a2 + b, queries)
    without = G.retract(whole, spark.createDataFrame([("b",)], "scope string"))
    same_as_rebuilt(spark, G.View(without), corpus + a1 + a2, queries)
    again = G.add(without, make(b[:3]))  # the session comes back
    same_as_rebuilt(spark, G.View(again), corpus + a1 + a2 + b[:3], queries)
    small = G.compact(again)
    assert [len(small.tables[n]) for n in G.KINDS] == [1, 1, 1, 1]
    assert small.table("postings").where("scope = 'b'").select("chunk_id").distinct().count() <= 3
    same_as_rebuilt(spark, G.View(small), corpus + a1 + a2 + b[:3], queries)
    same_as_rebuilt(spark, G.View(manifest.opened(spark, str(tmp_path), whole.number)), corpus + a1 + a2 + b, queries)  # as it was then


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    root = str(tmp_path)
    table = lambda *values: spark.createDataFrame([(v,) for v in values], "x int")
    one = manifest.publish(manifest.opened(spark, root), add={"a": table(1), "b": table(1)}, facts={"made": "first"})
    reader = manifest.opened(spark, root)
    two = manifest.publish(one, replace={"a": table(2), "b": table(2, 2)}, facts={"more": 3})
    three = manifest.publish(two, add={"a": table(3)})
    values = lambda v, name: sorted(r.x for r in v.table(name).collect())
    assert (values(reader, "a"), values(reader, "b"), reader.facts) == ([1], [1], {"made": "first"})
    assert (values(three, "a"), values(three, "b"), three.facts) == ([2, 3], [2, 2], {"made": "first", "more": 3})
    with pytest.raises(manifest.Conflict):
        manifest.publish(two, add={"a": table(9)})
    with pytest.raises(KeyError):
        three.table("c")
    manifest.prune(spark, root, keep=1)
    assert manifest.versions(spark, root) == [3] and values(manifest.opened(spark, root), "a") == [2, 3]
    assert len(list((tmp_path / "data").iterdir())) == 2


def test_a_publication_that_fails_shows_nothing(spark, tmp_path):
    root = str(tmp_path)
    good = manifest.publish(manifest.opened(spark, root), add={"a": spark.range(3), "b": spark.range(3)})
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        manifest.publish(good, replace={"a": spark.range(9), "b": broken})
    now = manifest.opened(spark, root)
    assert (now.number, now.table("a").count(), now.table("b").count()) == (1, 3, 3)
    assert len(list((tmp_path / "data").iterdir())) == 1
    assert manifest.publish(now, add={"a": spark.range(2)}).table("a").count() == 5


def test_an_index_says_what_it_was_made_with(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_index(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "note", "", None), ("b", "", "| x |", "fig"), ("c", "n", None, "fig")], "chunk_id string, table_note string, table_markdown string, figure_note string")
    write_index(spark, str(tmp_path), rows, spark.range(3), spark.range(5), "tiny", 3)
    old = read_index(spark, str(tmp_path))
    write_index(spark, str(tmp_path), rows.limit(1), spark.range(1), spark.range(1), "tiny", 4)
    assert old.facts == {"model": "tiny", "dim": 3, "chunks": 3, "table_note": 2, "table_markdown": 1, "figure_note": 2}
    assert [old.table(n).count() for n in ("chunks", "vectors", "postings")] == [3, 3, 5]
    assert read_index(spark, str(tmp_path)).facts["dim"] == 4 and read_index(spark, str(tmp_path), 1).table("chunks").count() == 3


def test_a_stream_of_uploads_and_ends_leaves_what_is_open(spark, tmp_path):
    root, folder = str(tmp_path / "index"), str(tmp_path / "in")
    kind = "scope string, at int, action string, chunk_id int, text string"
    text = lambda i: f"deep ensembles word{i} and the net"
    batches = [
        [("", 0, "upload", i, text(i)) for i in range(8)] + [("a", 1, "upload", 20, text(20)), ("b", 1, "upload", 30, "the the net")],
        [("a", 5, "end", None, None), ("a", 4, "upload", 21, text(1)), ("a", 6, "upload", 22, text(2)), ("c", 7, "upload", 40, "")],
        [("b", 9, "end", None, None), ("zz", 9, "end", None, None)],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
        for _ in range(2):  # the second time finds nothing new
            index_sessions(spark.readStream.schema(kind).parquet(folder), root, str(tmp_path / "state")).awaitTermination()
        assert manifest.opened(spark, root).number == n + 1
    left = {("", i, text(i)) for i in range(8)} | {("a", 22, text(2)), ("c", 40, "")}
    rows = spark.createDataFrame(sorted(left), "scope string, chunk_id int, text string").select("scope", "chunk_id", search_tokens(F.col("text")).alias("tokens"), F.lit(None).cast("array<double>").alias("vector"))
    held = [tuple(r) for r in rows.collect()]
    view = G.View(manifest.opened(spark, root))
    asked = spark.createDataFrame([(1, "a", ["net", "word2"]), (2, "b", ["the", "ensembles"]), (3, "c", ["net"])], "qid int, scope string, tokens array<string>")
    got = sorted((r.qid, r.chunk_id, round(r.score, 9)) for r in view.lexical(asked).collect())
    want = []
    for qid, scope, tokens in asked.collect():
        own = spark.createDataFrame([r for r in held if r[0] in ("", scope)], ROWS)
        want += [(r.qid, r.chunk_id, round(r.score, 9)) for r in bm25(own.select("chunk_id", "tokens"), spark.createDataFrame([(qid, tokens)], "qid int, tokens array<string>")).collect()]
    assert got == sorted(want)


def test_postings_are_blocks_of_one_scope_and_only_the_best_leave_a_block(spark, tmp_path):
    own = random.Random(5)
    rows = chunks(own, "", range(300)) + chunks(own, "a", range(400, 460)) + chunks(own, "b", range(500, 560))
    own.shuffle(rows)
    version = G.add(manifest.opened(spark, str(tmp_path)), spark.createDataFrame(rows, ROWS).repartition(2))
    # a row a block, not one a term of a chunk
    assert version.table("postings").count() <= 6
    assert version.table("postings").where(F.size(F.array_distinct("parts")) > 1).count() == 0
    asked = spark.createDataFrame([(q, s, ["the", "w1", "w2", f"only {s}"]) for q, s in enumerate(["a", "b", "c"])], "qid int, scope string, tokens array<string>")
    first = lambda found: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in R.ranked(found, ["qid"], 3).collect())
    every, best = G.View(version).lexical(asked), G.View(version).lexical(asked, most=3)
    assert first(every) == first(best) and best.count() < every.count() / 4
