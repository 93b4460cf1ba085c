"""Fill-in-middle, vector codes and license scan: against SQL, brute force and round trips."""

import hashlib
import random
import re
import string

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from corvane.llm import fill_in_middle, license_scan, vector_codes
from corvane.llm.common import salted_join
from corvane.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_vector_codes"])
def test_queries_agree_with_sql(spark, name):
    assert oracle.differences(QUERIES[name](spark, SF), ORACLE_SQL[name], oracle.connect(SF)) == []


def test_salted_join_keeps_every_row_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else 1 if i % 3 == 1 else i, i) for i in range(3000)], "k long, row long").repartition(5)
    values = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least"))
    got = sorted(tuple(r) for r in salted_join(rows, values, ["k"]).select("row", "least").collect())
    assert got == [(i, 0 if i % 3 == 0 else 1 if i % 3 == 1 else i) for i in range(3000)]


# fill-in-middle


def plain_cut(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    own = random.Random(3)
    long = "".join(own.choice("ab \n<>PSM.é😀") for _ in range(60_000))
    texts = [None, "", " ", "a", "\n", "é😀", "word", "a<P>b", "<S", "<P", "P>", "no <M> here", "naïve Kelvin K s ſ", "x" * 50_000, long.replace("<P>", "").replace("<S>", "").replace("<M>", "")]
    rows = [(i, t, "row", 1, "out") for i, t in enumerate(texts)] + [(None, "null id", None, None, None), (3, "a", "row", 1, "out"), (3, "a", "row", 1, "out")]
    return rows + [(100 + i, "the same copy of a text", "c", i, None) for i in range(400)] + [(1000 + i, f"{own.random()} <{own.choice('PSM')} > text", None, i, None) for i in range(200)]


@pytest.mark.parametrize("key", [None, lambda t: F.length(F.coalesce(t, F.lit(""))).cast("long"), lambda t: F.lit(7).cast("long")])
def test_cuts_equal_a_plain_version_even_where_hashes_collide(spark, key):
    rows = fim_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, _salt long, output string").repartition(5)
    made = fill_in_middle.fill_in_middle(docs, key=key and key(F.col("text"))).withColumn("back", fill_in_middle.restored())
    assert made.columns == ["doc_id", "_row", "_salt", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    want = sorted(((d, a, b, *plain_cut(d, t), t or "") for d, t, a, b, _ in rows), key=repr)
    assert got == want
    assert {r[4] for r in got} == {"plain", "psm", "spm"}


def test_cuts_of_an_empty_table(spark):
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("step", [1, 2, 3, 70, 5000])
def test_boundaries_select_every_value(step):
    values = np.cumsum(np.random.default_rng(step).integers(1, step + 1, 700))
    held = fill_in_middle.Boundaries(values)
    assert [held.select(k) for k in range(700)] == values.tolist()
    assert len(held.low) + len(held.high) <= 700 * (2 + np.log2(values[-1] / 700) + 1) / 8 + 16


# vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [[int(np.floor(x * 4096)) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, cut[i]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def assign(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [assign(p, c[p])[1] for c in cut]
            for k in range(len(books[p])):
                of = [c[p] for c, o in zip(cut, own) if o == k]
                if of:
                    books[p][k] = tuple(sum(x) // len(of) for x in zip(*of))
    out = []
    for (vec_id, _, label), c in zip(kept, cut):
        best = [assign(p, c[p]) for p in range(parts)]
        out.append((vec_id, "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), (1 << 63) - 1), label))
    return out, [[list(e) for e in b] for b in books]


VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("label", IntegerType()), StructField("code", IntegerType())])


def vector_rows(scale=1.0):
    own = np.random.default_rng(5)
    rows = [(i, (own.normal(size=16) * scale).tolist(), i % 3) for i in range(60)]
    hot = own.normal(size=16).tolist()
    rows += [(100 + i, hot, None) for i in range(40)] + [(7, rows[7][1], 1), (7, rows[7][1], 1), (2, hot, 0), (None, hot, 1)]
    rows += [(200, None, 0), (201, [None] * 16, 0), (202, [float("nan")] * 16, 0), (203, [float("inf")] + [0.0] * 15, 0), (204, [0.0] * 16, 2), (205, [0.1] * 13, 2), (206, [], None)]
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_codes_equal_a_plain_version(spark, scale):
    rows = vector_rows(scale)
    frame = spark.createDataFrame([(*r, 1) for r in rows], VECTORS).repartition(3)
    got, books = vector_codes.compress(frame)
    want, expected = plain_codes(rows)
    assert books == expected
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_codes_beyond_a_long_and_of_few_or_no_vectors(spark):
    rows = [(1, [1e15, -1e15] * 8, 0), (2, [0.0] * 16, 0), (3, [3.0, -2.0] * 8, 1)]
    got, books = vector_codes.compress(spark.createDataFrame([(*r, 0) for r in rows], VECTORS), rounds=0, entries=1)
    assert books[0] == [[4096 * 10**15, -4096 * 10**15]]
    assert {r.vec_id: r.error for r in got.collect()} == {1: 0, 2: (1 << 63) - 1, 3: (1 << 63) - 1}
    got, books = vector_codes.compress(spark.createDataFrame([(*r, 0) for r in rows], VECTORS))
    assert [len(b) for b in books] == [3] * 8 and {r.error for r in got.collect()} == {0}
    got, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert got.count() == 0 and books == [[]] * 8


# licenses


def plain_words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in text or ""))


def plain_base(own):
    found = []
    for phrase, label in license_scan.BASE:
        want = phrase.split()
        found += [(label, i) for i in range(len(own)) if own[i : i + len(want)] == want]
    return sorted(found)


def plain_found(own):
    """All rules on all texts, and every pair of detections looked at."""
    line = (" " + " ".join(own) + " ").encode()
    rules = license_scan.rules()
    every = [(line.count(b" ", 0, m.start()) - 1, line.count(b" ", 0, m.end()), k) for k, r in enumerate(rules) for m in r.pattern.finditer(line)]

    def beats(e, d):
        return e[0] <= d[0] and d[1] <= e[1] and (rules[e[2]].priority, e[0] - e[1], e[2]) < (rules[d[2]].priority, d[0] - d[1], d[2])

    return sorted((rules[d[2]].label, *d) for d in every if not any(beats(e, d) for e in every))


PIECES = "the a of under licensed released distributed see terms MIT Apache License license licence, version 2 2.0 3.0 3 GNU General Public Lesser CC BY BY-NC BY-SA 4.0 All rights reserved. BSD 3-clause new SPDX-License-Identifier: MPL mozilla gplv3 LGPL 2.1 public domain is é K ſ\n\t creative commons attribution software".split(" ")


def license_texts():
    own = random.Random(11)
    mixed = [" ".join(own.choices(PIECES, k=own.randint(1, 60))) for _ in range(150)]
    long = " ".join(own.choices(PIECES, k=20_000))
    hand = ["cc by cc by cc by", "CC-BY cc_by CC\nBY ccby Kcc by", "all rights reserved all rights reserved", "GENERAL public License", "é cc by é", "\x00cc\x7fby\x80", "cc by"]
    return [None, "", " \n", *hand, *mixed, *mixed[:3], long]


def test_licenses_equal_a_plain_version(spark):
    texts = license_texts()
    docs = spark.createDataFrame([(i, t, "mine", 4) for i, t in enumerate(texts)], "doc_id long, text string, _text string, base int").repartition(4)
    got = {r.doc_id: r for r in license_scan.license_scan(docs).withColumn("score", license_scan.score()).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        own = plain_words(text)
        assert got[i].n_words == len(own)
        assert got[i]["_text"] == "mine"
        assert sorted((s.label, s.start) for s in got[i].base) == plain_base(own)
        if len(own) < 2000:
            assert sorted((d.label, d.start, d.stop, d.rule) for d in got[i].found) == plain_found(own)
        assert (got[i].score > 0) == bool(got[i].base or got[i].found) and 0 <= got[i].score <= 1


STATED = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0 (the License)": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "All rights reserved.": "reserved",
    "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "under the terms of the GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
    "subject to the Mozilla Public License, v. 2.0": "mpl-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and": "mit",
    "He studied at MIT, saw Apache helicopters, wrote Ruby under the boost of an eclipse; see the Python.": "",
    "A driving license is a public document; the general public may license it.": "",
}


def test_stated_licenses_are_told_apart(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(i, t) for i, t in enumerate(STATED)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r.labels for r in QUERIES["op13_license_scan"](spark, path).collect()}
    assert [got[i] for i in range(len(STATED))] == list(STATED.values())


def test_licenses_of_the_table(spark):
    """Each planted line has its label, and no text without one of its words has any."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op13_license_scan"](spark, SF).collect():
        own = plain_words(texts[r.doc_id])
        base = plain_base(own)
        starts = [s for _, s in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for label, _ in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        for line, label in STATED.items():
            if label and line in texts[r.doc_id]:
                assert set(label.split(",")) <= set(r.labels.split(","))
        if not re.search("licen|rights|cc by|copyright|permission", " ".join(own)):
            assert r.labels == "" and r.score == 0


def test_licenses_of_an_empty_table(spark):
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
