"""Compatibility composition: only what it changes leaves the JVM, and the tables have nothing of the kind."""

import random
import unicodedata

from pyspark.sql import functions as F

from corvane.functions import text as T


def test_composed_equals_nfkc_on_any_characters(spark):
    own = random.Random(9)
    points = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(own.choice(points)) for _ in range(30)) for _ in range(300)] + [chr(c) + chr(d) for c in (0x65, 0x41, 0x1100, 0xAC00) for d in (0x301, 0x323, 0x1161, 0x11A8)]
    texts += [chr(c) for c in points[::37]] + [None, "", "plain", "ﬁrst Ｃ１⁰", "été"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", T.composed(F.col("t")).alias("c")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}


def test_index_tokens_and_pages_are_composed(spark):
    rows = spark.createDataFrame([("ＣＩＦＡＲ－１０ ﬁne x² ét",)], "t string")
    assert rows.select(T.search_tokens(F.col("t")).alias("w")).first().w == ["cifar10", "fine", "x2", "t"]
    assert spark.createDataFrame([("１\nﬁne day",)], "t string").select(T.clean_page(F.col("t")).alias("c")).first().c == "fine day"


def test_the_tables_have_nothing_that_composition_changes(spark):
    for name in ("documents", "benchmark", "conversations"):
        rows = spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
        assert rows.where(T.composed(F.col("text")) != F.col("text")).count() == 0


def test_settled_ranges_cost_nothing_at_plain_characters(spark):
    """The form in use before tried every range at every character: six times as long as this one on texts of letters and a few accents."""
    import time

    rows = spark.range(0, 1200, 1, 4).select(F.concat(F.lit("é"), F.repeat(F.lit("some words, and more of them "), 600)).alias("t")).localCheckpoint()

    def seconds(column):
        def once():
            start = time.perf_counter()
            rows.select(F.sum(F.length(column))).collect()
            return time.perf_counter() - start

        return min(once() for _ in range(3))

    before = F.when(F.col("t").rlike(rf"[^\x00-\x7F{T.SETTLED}]"), F.lit("")).otherwise(F.col("t"))
    assert 2 * seconds(T.composed(F.col("t"))) < seconds(before)
