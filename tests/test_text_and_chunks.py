"""Text functions and chunking on cases worked out by hand."""

import random

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunking as C
from corvane.operators import enrich as E
from corvane.operators import layout as L


def value(spark, column, **texts):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in texts.items()])
    return df.select(column.alias("v")).first()[0]


def test_nfkc_and_unicode_spaces(spark):
    assert value(spark, T.nfkc(F.col("x")), x="ﬁt EnD²") == "fit EnD2"
    assert value(spark, T.search_tokens(F.col("x")), x="EnD² on CIFAR-10, C100") == ["end2", "on", "cifar10", "cifar100"]
    assert value(spark, T.words(F.col("x")), x="a b  c") == ["a", "b", "c"]
    assert value(spark, T.clean_page(F.col("x")), x="é-\nx y") == "éx y"


def test_numbers_at_the_edges_only(spark):
    assert value(spark, T.clean_page(F.col("x")), x="1\n76\n84\nend\n2") == "76 84 end"


def test_packing_of_sentences():
    assert C.pack_plan([3, 3, 3], [0, 1, 2], 6, 0, set(), 1) == [(0, 1), (2, 2)]
    assert C.pack_plan([3, 3, 3], [0, 1, 2], 6, 3, set(), 1) == [(0, 1), (1, 2)]
    assert C.pack_plan([3, 3, 3], [0, 1, 2], 9, 3, {0}, 2) == [(0, 0), (1, 2)]
    assert C.pack_plan([9, 1], [0, 1], 5, 5, set(), 1) == [(0, 0), (1, 1)]


def test_fig_does_not_end_a_sentence(spark):
    assert value(spark, C.sentences(F.col("x")), x="See Fig. 3 here. Then go on! No") == ["See Fig. 3 here.", "Then go on!", "No"]


def test_page_lines_anchor_on_the_first_word(spark):
    rows = [(1, 0.0, 5.0, "a", 0.0, 10.0), (1, 6.0, 9.0, "b", 5.0, 15.0), (1, 10.0, 12.0, "c", 8.0, 18.0)]
    df = spark.createDataFrame(rows, "page int, x0 double, x1 double, text string, y0 double, y1 double")
    assert {r.text: r.line for r in C.page_lines(df, ["page"]).collect()} == {"a": 0, "b": 0, "c": 1}


def test_grid(spark):
    rows = [(1, 1, 0.0, 5.0, "m"), (1, 1, 10.0, 15.0, "e"), (1, 2, 1.0, 4.0, "x"), (1, 2, 11.0, 14.0, "7"), (1, 2, 20.0, 25.0, "+")]
    df = spark.createDataFrame(rows, "page int, line int, x0 double, x1 double, text string")
    assert [list(r) for r in L.to_grid(df, ["page"]).first().grid] == [["m", "e", ""], ["x", "7", "+"]]


def test_columns_widen_as_cells_join_them(spark):
    rows = [(1, 1, 0.0, 10.0, "h1"), (1, 1, 20.0, 30.0, "h2"), (1, 2, 8.0, 16.0, "a"), (1, 3, 13.0, 18.0, "b")]
    df = spark.createDataFrame(rows, "page int, line int, x0 double, x1 double, text string")
    assert [list(r) for r in L.to_grid(df, ["page"]).first().grid] == [["h1", "h2"], ["a", ""], ["b", ""]]


def plain_pack(sizes, sentence, size, overlap, breaks, least):
    out, first = [], 0
    while sizes:
        end = first
        while end < len(sizes) - 1:
            topic = sentence[end] in breaks and sentence[end + 1] != sentence[end] and sum(sizes[first : end + 1]) >= least
            if topic or sum(sizes[first : end + 2]) > size:
                break
            end += 1
        out.append((first, end))
        if end == len(sizes) - 1:
            break
        first = end + 1 if sentence[end] in breaks else min(s for s in range(first + 1, end + 2) if sum(sizes[s : end + 1]) <= overlap)
    return out


def test_packing_against_one_unit_at_a_time():
    rng = random.Random(1)
    for _ in range(3000):
        sizes, sentence, k = [], [], 0
        for _ in range(rng.randint(0, 14)):
            sizes.append(rng.randint(1, 9))
            sentence.append(k)
            k += rng.random() < 0.6
        rest = (rng.randint(3, 20), rng.randint(0, 12), {x for x in range(14) if rng.random() < 0.3}, rng.randint(0, 12))
        assert C.pack_plan(sizes, sentence, *rest) == plain_pack(sizes, sentence, *rest)


def test_grids_of_widened_hits_go_along_once(spark):
    cells = " ".join(map(str, range(40)))
    chunks = spark.createDataFrame([("a", 0, "before", 1, 1, "| x |"), ("a", 1, cells, 2, 2, "| x |\n\n| y |"), ("a", 2, "behind", 3, 3, "| z |")], "paper string, idx int, text string, page_start int, page_end int, table_markdown string")
    hits = chunks.where("idx = 1").selectExpr("'q' as qid", "1 as rank", "*")
    row = E.expand_split_tables(hits, chunks, ["qid"]).first()
    assert row.expanded_with == [0, 2] and (row.page_start, row.page_end) == (1, 3)
    assert row.text == f"before {cells} behind" and row.table_markdown == "| x |\n\n| y |\n\n| z |"
    assert E.expand_split_tables(hits.drop("table_markdown"), chunks, ["qid"], most=0).first().expanded_with == []


def test_safe_files(spark):
    ok = {"a-1.png": True, "../a.png": False, "a/b.png": False, "a.png\n": False, "a.jpg": False, "A:1.png": True}
    assert {k: value(spark, T.safe_file(F.col("x")), x=k) for k in ok} == ok
    assert value(spark, T.safe_file(F.col("x"), T.RESULT_FILE), x="A.png") is False
    assert value(spark, T.set_filename(F.col("x")), x="svhn/test") == "svhn__test"


def test_tables_of_replies(spark):
    from corvane.plans.text import TABLE_REPLIES

    replies = spark.createDataFrame(TABLE_REPLIES.rows, TABLE_REPLIES.schema).withColumn("_t", T.reply_tables(F.col("reply")))
    rows = replies.select("id", F.col("_t").isNull().alias("failed"), F.inline_outer("_t")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.failed, r.caption, r.description, r.markdown))
    assert got[1] == [(False, "Errors", "Compares all methods", "| a | b |\n|---|---|\n| x | 1 |"), (False, "Other", "", "")]
    assert got[2] == [(False, "Alone", "", "| a | b |")]
    assert got[3] == [(False, "J", "d", "| a |")]
    assert got[4] == [(False, None, None, None)] and got[5] == got[6] == [(True, None, None, None)]
