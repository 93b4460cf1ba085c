"""Exact, line and near deduplication against brute force."""

import collections
import os
import random
import re

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import exact_dedup, line_dedup, near_dedup
from corvane.llm.common import Scratch
from corvane.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, norm string, keys string, digest int"


def test_queries_agree_with_sql(spark):
    con = oracle.connect(SF)
    assert oracle.differences(exact_dedup.op10_exact_dedup(spark, SF), exact_dedup.ORACLE_SQL, con) == []
    assert oracle.differences(line_dedup.op1_line_dedup(spark, SF), line_dedup.ORACLE_SQL, con) == []


ROWS = [(1, "a  b", "x", "y", 0), (2, "a b", None, None, 1), (3, None, None, None, 2), (4, "", None, None, 3), (4, "", None, None, 3), (None, "a\tb", None, None, 4), (7, "z" * 100_000, None, None, 5), (8, "z" * 100_000, None, None, 6), (9, " ", None, None, 7)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda n: F.substring(exact_dedup.sha256(n), 1, 0), lambda n: F.length(n).cast("string")])
def test_exact_dedup_even_where_digests_collide(spark, tmp_path, digest):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    got = exact_dedup.exact_dedup(spark, path, digest).collect()
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[re.sub("[ \t-\r]+", " ", text or "")].append(doc_id)
    want = collections.Counter((d, min(ids, key=lambda x: (x is not None, x or 0)), len(ids)) for ids in groups.values() for d in ids)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_beyond_the_broadcast_and_with_clashing_names(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(i, "copy" if i % 3 else f"own {i}", "m", i) for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, _metadata string, row bigint").repartition(3).write.parquet(path)
    for bound in (0, 1000):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, path, broadcast_digests=bound).collect()}
        assert got == {i: (1, 26, i == 1) if i % 3 else (i, 1, True) for i in range(40)}


def test_exact_dedup_goes_on_and_takes_an_empty_table(spark, tmp_path):
    path, state = str(tmp_path / "d.parquet"), str(tmp_path / "state")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string").write.parquet(path)
    exact_dedup.stream_state(spark, path, state_path=state)
    spark.createDataFrame([(3, "a")], "doc_id bigint, text string").write.mode("append").parquet(path)
    sizes = sorted(r.group_size for r in exact_dedup.stream_state(spark, path, state_path=state).collect())
    assert sizes == [1, 2]
    empty = str(tmp_path / "e.parquet")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(empty)
    assert exact_dedup.exact_dedup(spark, empty).collect() == []


def test_line_dedup_on_cases(spark):
    rows = [(i, "h", f"menu\nown {i}\n\n menu ", "x", 1) for i in range(6)] + [(10, None, "menu\nx", "x", 1), (11, "one", "menu", "x", 1), (12, "h", None, "x", 1), (13, "h", "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string, _host string, n_lines int")
    for broadcast in (1000, 0):
        got = {r.doc_id: r for r in line_dedup.line_dedup(df, max_ratio=0.5, min_pages=3, broadcast_lines=broadcast, salts=3).collect()}
        assert got[0].text == "own 0\n" and got[0].n_dropped == 2 and got[0]._host == "x"
        assert got[10].text == "menu\nx" and got[11].text == "menu" and got[12].text is None and got[13].text == ""
    assert line_dedup.line_dedup(df.limit(0)).collect() == []


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute_groups(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


def test_near_groups_on_cases(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"e{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 60, 2))]
    rows += [(100 + i, " ".join(base[: 58 - 2 * i])) for i in range(12)]  # a chain whose ends are unlike
    rows += [(200, None), (201, ""), (202, " \n"), (203, "A b"), (204, "a  B"), (205, "a"), (206, "É b c d"), (207, "é b c d"), (208, "x " * 5000), (209, "x " * 5000)]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id bigint, text string, keys string, node int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df).collect()}
    assert got == brute_groups(rows)
    repeated = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "q r s t u"), (1, "q r s t u")], "doc_id bigint, text string")
    out = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_groups(repeated).collect())
    assert out == [("1", "1", True)] * 3 + [("2", "1", False), ("None", "None", True)]
    assert near_dedup.near_groups(df.limit(0)).collect() == []


def test_near_groups_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "GRID", 2)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):  # most pairs lie about the similarity
        own = base.copy()
        for k in rng.sample(range(80), rng.randint(0, 5)):
            own[k] = f"e{i}_{k}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(i, "copy of one text that many have " * 3) for i in range(50)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()}
    assert got == brute_groups(rows)


def test_blocks_give_a_forest_of_links():
    texts = ["one text that all of them have in common"] * 64
    block = lambda first: [{"comp": first + i, "text": t, "keys": [i, 7]} for i, t in enumerate(texts)]
    kind = pa.list_(pa.struct([("comp", pa.int64()), ("text", pa.string()), ("keys", pa.list_(pa.int64()))]))
    def links(band):
        batch = pa.RecordBatch.from_arrays([pa.array([band], pa.int32()), pa.array([block(0)], kind), pa.array([block(100)], kind)], names=["band", "left", "right"])
        return pa.Table.from_batches([*near_dedup.block_verifier(4, 80)(iter([batch]))]).to_pydict()

    found = links(0)
    assert len(found["a"]) == 127 and set(found["a"]) == set(range(64)) and set(found["b"]) == set(range(100, 164))
    assert len(links(1)["a"]) == 127  # but pairs that share band 0
    assert links(2)["a"] == []  # all share band 1


def test_counts_of_common_shingles_are_exact():
    x = np.arange(100_000, dtype=np.uint64)
    got = near_dedup.common_counts(x, np.array([0, 100_000]), x, np.array([0, 100_000]))
    assert got.dtype == np.int64 and got[0, 0] == 100_000


def test_near_groups_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op3_near_dedup(spark, SF).collect()}
    assert got == brute_groups(rows)


def test_scratch_tables_go(spark, tmp_path):
    with Scratch(spark) as own:
        rows = own.written(spark.range(3), "x")
        assert rows.count() == 3 and os.path.isdir(own.paths[0].removeprefix("file:"))
        path = own.paths[0].removeprefix("file:")
    assert not os.path.exists(path)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100)}
