"""The pipeline against a plain version of it."""

import collections
import re

import numpy as np

import corpus_pipeline
from corvane.llm import line_dedup
from corvane.llm.language_id import UNDETERMINED, held_out, identify, learn
from corvane.llm.tokens import vocabulary
from test_dedup import brute_groups
from test_models import base_spans

SF = "/root/testdata/sf0.001"


def plain(rows):
    """(doc_id, text) left for packing, from (doc_id, text, source) with a language."""
    pages, on = collections.Counter(), collections.Counter()
    for _, text, source in rows:
        pages[source] += 1
        on.update({(source, x.strip(" ")) for x in text.split("\n") if x.strip(" ")})
    gone = {k for k, n in on.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.MAX_RATIO * pages[k[0]]}
    rows = [(d, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in gone)) for d, t, s in rows]
    groups = brute_groups(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    out = []
    for d, text in rows:
        end = 0
        parts = []
        for a, _, b in base_spans(text):
            if a >= end:
                parts += [text[end:a], "[secret]"]
            end = max(end, b)
        out.append((d, "".join(parts) + text[end:]))
    return out


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learnt = learn(docs.where(~held_out()))
    spoken = {r.doc_id for r in identify(docs, *learnt).where(f"lang_pred <> '{UNDETERMINED}' and (score >= {corpus_pipeline.MIN_SCORE} or length(text) < {corpus_pipeline.JUDGED_FROM})").collect()}
    left = plain([(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect() if r.doc_id in spoken])
    got = corpus_pipeline.run(spark, SF).toPandas()
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert got.groupby("doc_id").length.sum().to_dict() == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in left}
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("*", "1 as score", "'x' as n_lines", "2 as row", "3 as base_spans")
    empty = spark.createDataFrame([(900, None, None, None, None, 1, "x", 2, 3), (901, "", "en", "s", 0, 1, "x", 2, 3), (902, "Just words", "en", None, 10, 1, "x", 2, 3)], docs.schema)
    rows = docs.unionByName(empty)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == docs.columns, name
        rows = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.n_lines for r in rows.collect()} == {"x"} and {r.score for r in rows.collect()} == {1}
    kept = {r.doc_id for r in rows.collect()}
    assert 902 in kept and 900 not in kept and 901 not in kept
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert re


def test_language_stage_rejects_what_is_like_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = spark.createDataFrame([(9000, "Жили-были дед да баба, и была у них курочка ряба, и снесла она яичко не простое"), (9001, "zqxj vkqz xjqk wvzx qqzj kxvw jzqx vvkq"), (9002, "12 34")], "doc_id bigint, text string")
    rows = docs.unionByName(other, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, rows, SF).collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept == lettered
