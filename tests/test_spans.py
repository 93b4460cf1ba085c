"""Chunks by offsets and their pages, against plain versions."""

import itertools
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corvane.operators import spans as P
from corvane.operators.models import embedder, tokenizer
from corvane.operators.chunking import page_char_map

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models here travel to the workers


def letters_and_digits():
    """A tokenizer whose tokens are not runs without white space: letters, digits and marks apart, three letters at most."""
    return lambda texts: [[(k, *m.span()) for k, m in enumerate(re.finditer(r"[^\W\d]{1,3}|\d|[^\w\s]", t))] for t in texts]


def places(text, own):
    return [m.span() for m in re.finditer(r"\S+", text)] if own is None else [(a, b) for _, a, b in own()([text])[0]]


def plain_sentences(text):
    out, start = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z])", text):
        out.append((start, m.start()))
        start = m.end()
    return [(a, b) for a, b in [*out, (start, len(text))] if text[a:b].strip()]


def plain_chunks(text, tokens, strategy, size, overlap, breaks=(), least=64):
    if strategy == "fixed":
        ranges, at = [], 0
        while at < len(tokens):
            ranges.append((at, min(at + size, len(tokens))))
            if at + size >= len(tokens):
                break
            at += max(1, size - overlap)
    else:
        units = []
        for k, (a, b) in enumerate(plain_sentences(text)):
            own = [i for i, (s, _) in enumerate(tokens) if a <= s < b]
            units += [(k, own[w], own[min(w + size, len(own)) - 1] + 1) for w in range(0, len(own), size)]
        ranges, i = [], 0
        while i < len(units):
            total = units[i][2] - units[i][1]
            j = i
            ends = lambda u: units[u][0] in breaks and (u + 1 == len(units) or units[u + 1][0] != units[u][0])
            while not (ends(j) and total >= least) and j + 1 < len(units) and total + units[j + 1][2] - units[j + 1][1] <= size:
                j += 1
                total += units[j][2] - units[j][1]
            ranges.append((units[i][1], units[j][2]))
            if j + 1 == len(units):
                break
            back = j + 1
            if units[j][0] not in breaks:
                carried = 0
                while back - 1 > i and carried + units[back - 1][2] - units[back - 1][1] <= overlap:
                    back -= 1
                    carried += units[back][2] - units[back][1]
            i = back
    found = [(hi - lo, tokens[lo][0], tokens[hi - 1][1]) for lo, hi in ranges]
    return [(k, n, a, b, text[a:b].strip()) for k, (n, a, b) in enumerate(found)]


def documents():
    own = random.Random(8)
    pieces = ["deep", "Ensembles", "are", "good.", "In", "2016", "(see", "Fig. 3)", "7.3", "±0.4", "é😀", "\n", "\t ", "What? Yes! No", "　", "uncertainty,"]
    rows = [(i, " ".join(own.choices(pieces, k=n)), sorted(own.sample(range(40), 8))) for i, n in enumerate([0, 1, 2, 5, 30, 31, 64, 200, 1500])]
    return rows + [(20, None, None), (21, "  \n ", [0]), (22, "A. B. C.", [1]), (None, "no id here", None), (22, "A. B. C.", [1])]


@pytest.mark.parametrize("own", [None, letters_and_digits])
@pytest.mark.parametrize("strategy", ["fixed", "sentence"])
def test_chunks_equal_a_plain_version_and_are_pieces_of_the_text(spark, strategy, own):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id int, text string, b array<int>").repartition(3)
    tokens = tokenizer(own)(F.col("text")) if own else None
    for size, overlap, least in ((8, 3, 2), (64, 0, 16), (5, 9, 1)):
        got = P.chunk_spans(docs, strategy, tokens=tokens, breaks="b", size=size, overlap=overlap, least=least)
        want = [(d, *c) for d, t, b in rows for c in plain_chunks(t or "", places(t or "", own), strategy, size, overlap, set(b or []), least)]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        texts = {d: t for d, t, _ in rows}
        assert all(r.text in texts[r.doc_id] for r in got.collect())


def test_unknown_strategies_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    with pytest.raises(ValueError):
        P.chunk_spans(docs, "pages")
    with pytest.raises(ValueError):
        P.chunk_pages(docs.withColumn("page_no", F.lit(1)), "semantic")


def test_positions_on_pages_of_long_and_short_documents(spark):
    own = random.Random(4)
    sizes = {1: [own.randint(0, 9000) for _ in range(40)], 2: [0, 3, 0], 3: [1] * 9000, 4: []}
    pages = spark.createDataFrame([(d, i + 1, "x" * n) for d, s in sizes.items() for i, n in enumerate(s)] + [(5, 7, "y")], "doc_id int, page_no int, text string")
    spans = page_char_map(pages)
    asked = [(d, p) for d in (1, 2, 3, 4, 5, 9) for p in [0, 1, 2, 4095, 4096, 8191, *own.choices(range(200_000), k=50)]]
    got = P.on_pages(spark.createDataFrame(asked, "doc_id int, pos long"), spans).collect()

    def plain(doc, pos):
        if doc == 5:
            return 7
        at, last = 0, 1
        for i, n in enumerate(sizes.get(doc, [])):
            if n:
                last = i + 1
                if at <= pos < at + n + 1:
                    return last
                at += n + 1
        return last

    assert sorted((r.doc_id, r.pos, r.page_no) for r in got) == sorted((d, p, plain(d, p)) for d, p in asked)


def hashed():
    def embed(texts):
        out = np.zeros((len(texts), 16))
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                row[zlib.crc32(w.encode()) % 16] += 1
        return out

    return embed


@pytest.mark.parametrize("own", [None, letters_and_digits])
def test_semantic_chunks_with_pages_equal_a_plain_version(spark, own):
    draw = random.Random(2)
    topics = [["loss", "weight", "train", "net"], ["river", "boat", "water", "fish"], ["court", "law", "judge"]]
    pages = []
    for doc in range(6):
        for page in range(draw.randint(1, 4)):
            sents = [" ".join(draw.choices(draw.choice(topics), k=draw.randint(3, 12))).capitalize() + "." for _ in range(draw.randint(0, 6))]
            pages.append((doc, page + 1, " ".join(sents)))
    frame = spark.createDataFrame(pages, "doc_id int, page_no int, text string").repartition(3)
    got = P.chunk_pages(frame, "semantic", tokenizer=tokenizer(own) if own else None, embed=embedder(hashed), size=40, overlap=8, least=6)
    want = []
    for doc, group in itertools.groupby(sorted(pages), key=lambda r: r[0]):
        filled = [(n, t) for _, n, t in group if t]
        text = "".join(t + " " for _, t in filled)
        sents = [text[a:b] for a, b in plain_sentences(text)]
        breaks = set()
        if len(sents) >= 3:
            x = hashed()([" ".join(sents[max(0, i - 1) : i + 2]) for i in range(len(sents))])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            apart = 1 - (x[:-1] * x[1:]).sum(axis=1)
            breaks = {i for i, d in enumerate(apart) if d > np.percentile(apart, 90) + 1e-12}
        ends = list(itertools.accumulate(len(t) + 1 for _, t in filled))
        page = lambda pos: next(n for (n, _), e in zip(filled, ends) if pos < e)
        want += [(doc, k, page(a), page(b - 1), n, a, b, piece) for k, n, a, b, piece in plain_chunks(text, places(text, own), "sentence", 40, 8, breaks, 6)]
    rows = [(r.doc_id, r.chunk_index, r.page_start, r.page_end, r.n_tokens, r.char_start, r.char_end, r.text) for r in got.collect()]
    assert sorted(rows) == sorted(want)


def test_an_empty_table_has_no_chunks(spark):
    pages = spark.createDataFrame([], "doc_id int, page_no int, text string")
    assert P.chunk_pages(pages).count() == 0
