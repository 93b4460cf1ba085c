"""Packing, token counts and pieces against the libraries themselves."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import packing, pieces, token_counts
from corvane.llm.tokens import LONGEST, Memo, WordMemo, byte_chunks, vocabulary, word_chunks

TEXTS = [None, "", " ", "a", "The end. The End, so<|endoftext|>it is", "é́x Σσ ΑΣ\n\n\tb  c 漢字 12'34 don't", "word " * 5000, "x" * 60_000, "same", "same"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_tokens int")


def model(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def test_chunks_have_the_ids_of_the_text():
    rng = random.Random(1)
    word, byte = model("word_bpe_49k.json"), model("byte_bpe_50k.json")
    parts = [" ", " ", "\n", "a", "b", "É", "\t", "\u00a0", "'s", "12", "!", "<|endoftext|>", "\u0301", "Σ", "漢", "\x1c", "ß", ".", ","]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    memo = WordMemo(vocabulary("word_bpe_49k.json"))
    for text in texts:
        own = word_chunks(text)
        held = memo.learn(set(own))
        assert b"".join(held[c] for c in own) == np.asarray(word.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    memo = Memo(vocabulary("byte_bpe_50k.json"), "test", len)
    for text in texts:
        own = byte_chunks(text)
        held = memo.learn(set(own))
        assert sum(held[c] for c in own) == len(byte.encode(text, add_special_tokens=False).ids)


def test_packing(spark, docs):
    got = packing.pack_documents(docs).toPandas()
    tok = model("word_bpe_49k.json")
    want = {}
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            own = np.asarray(ids[start : start + 2048], "<u4")
            want[i, k] = (start, len(own), zlib.crc32(own.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    check_layout(got)
    assert packing.pack_documents(docs.limit(0)).collect() == []


def check_layout(rows, capacity=2048):
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() <= capacity
    assert not rows.duplicated(["sequence_id", "offset"]).any()


def test_plan_is_whole_and_close_to_the_bound():
    rng = random.Random(2)
    for capacity in (10, 64, 2048):
        lengths = [rng.randint(1, capacity) for _ in range(3000)]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.plan(histogram, capacity)
        assert all(sum(b - a for n_, a, b, *_ in runs if n_ == n) == k for n, k in histogram.items())
        bins = max(s + (b - a) // k for _, a, b, k, s, _ in runs)
        assert bins <= -(-sum(lengths) // capacity) * 1.02 + 2


def test_two_documents_replace_the_smallest():
    left = np.zeros(11, dtype=np.int64)
    left[[6, 3, 2]] = [1, 1, 2]  # greedy: 6 + 3, gap 1; 2 + 2 fill the gap of 3's place
    assert packing.pattern(left, 10) == {6: 1, 2: 2}


def test_repeated_rows_are_packed_each(spark):
    rows = spark.createDataFrame([(5, "a b c")] * 7, "doc_id bigint, text string")
    got = packing.pack_documents(rows, capacity=8).toPandas()
    assert len(got) == 7
    check_layout(got, 8)


def test_counts_and_cache(spark, docs, tmp_path):
    tok, cache = model("byte_bpe_50k.json"), str(tmp_path / "cache")
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    for _ in range(2):
        got = {r.doc_id: r for r in token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), cache).collect()}
        assert {k: r.n_tokens for k, r in got.items()} == want
        assert all(r.over_limit == (r.n_tokens > 512) and r.n_bytes == len((TEXTS[k] or "").encode()) for k, r in got.items())
    held = spark.read.parquet(cache)
    assert held.count() == held.select("content_sha").distinct().count() == len({t or "" for t in TEXTS})
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model"), cache).collect()}
    assert got == {i: len(other.encode(t or "")) for i, t in enumerate(TEXTS)}
    assert token_counts.token_counts(docs.limit(0), vocabulary("byte_bpe_50k.json"), str(tmp_path / "new")).collect() == []


def test_a_pair_that_is_cached_twice_counts_once(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    first = token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), cache).collect()
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer_sha").parquet(cache)
    assert sorted(token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), cache).collect()) == sorted(first)


def test_columns_go_along(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id bigint, text string, content_sha string, _sha string")
    got = token_counts.token_counts(rows, vocabulary("byte_bpe_50k.json"), str(tmp_path / "cache")).first().asDict()
    assert got == {"doc_id": 1, "content_sha": "x", "_sha": "y", "n_bytes": 3, "n_tokens": 2, "over_limit": False}


def test_memos_are_bounded():
    rng = random.Random(3)
    byte, word = Memo(vocabulary("byte_bpe_50k.json"), "bound", len), WordMemo(vocabulary("word_bpe_49k.json"))
    models = model("byte_bpe_50k.json"), model("word_bpe_49k.json")
    texts = ["".join(rng.choice("ab\t  c") for _ in range(100_000)), "z" * 100_000, "x\ty " * 25_000]
    for text in texts:
        own = byte_chunks(text)
        held = byte.learn(set(own))
        assert sum(held[c] for c in own) == len(models[0].encode(text, add_special_tokens=False).ids)
        own = word_chunks(text)
        held = word.learn(set(own))
        assert b"".join(held[c] for c in own) == np.asarray(models[1].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for memo in (byte, word):
        memo.learn({"end"})
        assert max(map(len, memo.held)) <= LONGEST


def test_pieces_equal_the_library_and_decode(spark):
    import sentencepiece

    texts = [None, "", "  a  b ", "a\tb\n\n c\n", "\U0001f600漢字é▁x", " ", "aaaa" * 12, "\n", "The ferry left at noon; 42 people.", "x y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary(pieces.VOCABULARY))
    out = pieces.decode(pieces.encode(docs, vocabulary(pieces.VOCABULARY)), vocabulary(pieces.VOCABULARY)).collect()
    assert {r.doc_id: list(r.ids) for r in out} == {i: lib.encode(t or "") for i, t in enumerate(texts)}
    assert all(r.round_trip for r in out)
    assert {r.doc_id: r.decoded for r in out} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert pieces.encode(docs.limit(0), vocabulary(pieces.VOCABULARY)).collect() == []


def test_long_words_equal_the_library(spark):
    import sentencepiece

    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)) for n in (64, 65, 96, 97, 500, 60_000)]
    texts += ["a" * 1000, "=" * 333, "abc" * 300, "Ünïcödé漢字" * 40, "-" * 65 + " short " + "the" * 50, "".join(rng.choice("ab") for _ in range(700)), "xyzzy" * 200]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in enumerate(texts)] + [(0, texts[0], "w", 1)], "doc_id bigint, text string, word string, block int")
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary(pieces.VOCABULARY))
    out = pieces.encode(docs, vocabulary(pieces.VOCABULARY)).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert list(r.ids) == lib.encode(texts[r.doc_id]) and r.round_trip, r.doc_id


def test_pieces_of_the_table_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary(pieces.VOCABULARY))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: lib.encode(r.text or "") for r in docs.collect()}
    got = {r.doc_id: list(r.ids) for r in pieces.op5_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_viterbi_finds_the_best_sum(spark):
    listed = [("▁", 1, -3.0), ("a", 2, -2.0), ("b", 3, -2.5), ("ab", 4, -3.1), ("▁a", 5, -4.0), ("ba", 6, -3.0), ("aba", 7, -5.5), ("bab", 8, -4.9)]
    score = {p: s for p, _, s in listed}

    def best(word):
        sums = [0.0]
        for end in range(1, len(word) + 1):
            sums.append(max(sums[a] + score.get(word[a:end], -100.0 if end - a == 1 else float("-inf")) for a in range(end)))
        return sums[-1]

    words = ["▁" + "".join(x) for n in range(1, 6) for x in itertools.product("abc", repeat=n)]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    rows = pieces.lattice(frame, spark.createDataFrame(listed, pieces.PIECES), 3).withColumn("cuts", pieces.viterbi_fold(3)).collect()
    assert len(rows) == len(words)
    for r in rows:
        assert np.isclose(sum(score.get(r.word[a:b], -100.0) for a, b in zip(r.cuts, r.cuts[1:])), best(r.word))
    assert F is not None


def test_sentencepiece_returns_ids_that_decode_spells(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "Some words, ünï 漢字 twice twice"), (2, ""), (3, None), (4, f"a{pieces.SPACE}b  c\n")], "doc_id long, text string")
    sf, decode = str(tmp_path), pieces.decode
    docs.coalesce(1).write.parquet(f"{sf}/documents.parquet")
    rows = pieces.op5_sentencepiece(spark, sf)
    got = {r.doc_id: r for r in rows.collect()}
    assert all(len(r.ids) == r.n_tokens and r.round_trip for r in got.values()) and got[1].n_tokens > 5
    assert {r.doc_id: r.decoded for r in decode(rows, vocabulary(pieces.VOCABULARY)).collect()} == {1: "Some words, ünï 漢字 twice twice", 2: "", 3: "", 4: "a b  c\n"}
    monkeypatch.setattr(pieces, "decode", lambda *a: decode(*a).withColumn("decoded", F.lit("x")))
    assert not any(r.round_trip for r in pieces.op5_sentencepiece(spark, sf).collect())


def test_two_documents_replace_a_lone_one():
    left = np.zeros(2049, dtype=np.int64)
    left[[1100, 1010, 1000]] = 1
    assert packing.pattern(left, 2048) == {1010: 1, 1000: 1}
    left[[1010, 1000]] = 0
    assert packing.pattern(left, 2048) == {1100: 1}


def test_packing_of_the_table(spark):
    """Every token of every whole text is in one place, without gaps, in as few sequences as can be."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = packing.op2_best_fit_packing(spark, sf).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(range(0, len(ids), 2048)) and all(r.length == min(2048, len(ids) - r.start) for r in own)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_token_counts_of_the_table_equal_the_library(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op7_token_counts(spark, sf).collect()}
    want = {d: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in texts.items()}
    assert got == {d: (b, n, n > 512) for d, (b, n) in want.items()}


def test_blocks_are_of_neighbours_and_bounded(spark):
    """Texts in order of their ids fall into runs, so a reader has words of few blocks; one id's many texts are dealt out."""
    docs = spark.range(4000, numPartitions=8).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), F.lit(20)).alias("text"))
    placed = pieces.blocks(docs, 20_000).withColumn("reader", F.spark_partition_id())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    cells = placed.groupBy("range", "share").agg(F.sum(F.octet_length("text")).alias("n"), F.count_distinct("reader").alias("readers")).collect()
    assert size / 20_000 <= len(cells) <= 2 * size / 20_000 + 2
    assert max(c.readers for c in cells) <= 2 and max(c.n for c in cells) < 40_000
    same = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(-(1 << 63))).when(F.col("doc_id") % 3 == 0, F.lit((1 << 63) - 1)))
    cells = pieces.blocks(same, 20_000).groupBy("range", "share").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert sum(c.n for c in cells) == size and max(c.n for c in cells) < 40_000
    assert pieces.blocks(docs.limit(0)).collect() == []
