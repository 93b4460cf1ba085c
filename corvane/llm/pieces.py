"""SentencePiece encoding and decoding as a relational lattice.

The pieces of a model are a table. Texts fall into words (a run of the space mark and what follows it; no
piece reaches beyond). Of each distinct word, all substrings up to the longest piece are exploded and
equi-joined to the piece table, the matching edges are grouped by word, and the lattice of a word is folded
with Spark's higher-order ``aggregate``: for unigram models by Viterbi over the scores; for BPE models,
where the best sum of scores is not the model's segmentation, by the model's own order of merges, read
off the same edges. Characters without a piece become their bytes' pieces.

Texts are put together again in blocks of bounded size: each block meets the dictionary of its own words. A block has texts of
neighbouring doc_ids, which mostly lie together in the files, so that a reader has words of few blocks to tell apart.

Defined cases: null and empty texts have no pieces and decode to an empty text; the model's normalisation is
the identity with a leading space (models with other rules are refused); very long texts and words are
encoded whole; repeated rows give repeated rows, and rows that repeat a doc_id are texts of their own; an empty table
gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import vocabulary

SPACE = "▁"
VOCABULARY = "piece_bpe_32k.model"
#: Characters of a window of a long word, and from one window to the next: two windows share half of their text.
WINDOW, STEP = 64, 32
#: Bytes of text in a block that is put together at once.
BLOCK_BYTES = 32 << 20
PIECES = "piece string, id int, score double"


def load_pieces(path: str) -> tuple[list[tuple[str, int, float]], dict[int, int]]:
    """The ordinary pieces of a model file (piece, id, score), and the id of each byte's piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "  Ａ  b\t"
    if model.decode(model.encode(probe)) != probe or model.encode(probe, out_type=str)[0][:1] != SPACE:
        raise ValueError("only models without normalisation and with a leading space are supported")
    pieces, of_byte = [], {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            of_byte[int(model.id_to_piece(i)[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), i, model.get_score(i)))
    return pieces, of_byte


def word_pattern(pieces: list[tuple[str, int, float]]) -> str:
    """Where words part: before a run of space marks, and around line ends if no piece has one."""
    if any(SPACE in p.lstrip(SPACE) for p, *_ in pieces):
        raise ValueError("pieces that go on over a space are not supported")
    cut = f"(?<=[^{SPACE}])(?={SPACE})"
    return cut if any("\n" in p for p, *_ in pieces) else cut + r"|(?<=\n)(?=[^\n])|(?<=[^\n])(?=\n)"


def split_words(text: Column, pattern: str) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(F.concat(F.lit(SPACE), F.translate(whole, " ", SPACE)), pattern, -1))


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """word, n (its length) and its edges: a map of start * (longest + 1) + length to (id, score)."""
    n = F.length("word")
    starts = words.select("word", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("start"))
    cut = starts.select("word", "n", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("start") + 1))).alias("length"))
    named = cut.select("word", "n", "start", "length", F.col("word").substr(F.col("start"), F.col("length")).alias("piece"))
    # each word's first character stays though it has no piece, so that no word is lost
    edges = named.join(F.broadcast(pieces), "piece", "left").where("id is not null or (start = 1 and length = 1)")  # bounded: the vocabulary
    at = ((F.col("start") - 1) * (longest + 1) + F.col("length")).alias("at")
    found = F.collect_list(F.when(F.col("id").isNotNull(), F.struct(at, F.struct("id", "score"))))
    return edges.groupBy("word").agg(F.first("n").alias("n"), F.map_from_entries(found).alias("edges"))


def merge_fold(longest: int) -> Column:
    """Ends of the segments of a BPE word: the best-scoring merge of neighbours is done, leftmost first, until none is left."""
    n, edges = F.col("n"), F.col("edges")
    score = lambda a, b: F.when(b - a <= longest, F.element_at(edges, a * (longest + 1) + (b - a))["score"])

    def merge(cuts: Column, _: Column) -> Column:
        choices = F.transform(F.sequence(F.lit(1), F.size(cuts) - 2), lambda i: F.struct(score(F.element_at(cuts, i), F.element_at(cuts, i + 2)).alias("score"), (-i).alias("i")))
        best = F.array_max(F.filter(choices, lambda c: c["score"].isNotNull()))
        return F.when(F.size(cuts) < 3, cuts).otherwise(_let(best, lambda b: F.when(b.isNull(), cuts).otherwise(F.filter(cuts, lambda _, j: j != -b["i"]))))

    return F.aggregate(F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>")), F.sequence(F.lit(0), n), merge)


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def viterbi_fold(longest: int, unknown: float = -100.0) -> Column:
    """Ends of the segments with the best sum of scores; a lone character without a piece scores ``unknown``.

    Folds over the word's positions; the state holds, per position, the best sum and the segment's start.
    """
    edges = F.col("edges")
    state = "array<struct<sum:double,from:int>>"

    def step(best: Column, end: Column) -> Column:
        def arrive(start: Column) -> Column:
            edge = F.element_at(edges, start * (longest + 1) + (end - start))["score"]
            own = F.coalesce(edge, F.when(end - start == 1, F.lit(unknown)))
            return F.struct((F.element_at(best, start + 1)["sum"] + own).alias("sum"), start.cast("int").alias("from"))

        choices = F.filter(F.transform(F.sequence(F.greatest(F.lit(0), end - longest), end - 1), arrive), lambda c: c["sum"].isNotNull())
        return F.concat(best, F.array(F.array_max(choices))).cast(state)

    walked = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("from"))).cast(state), step)
    # back from the end: a start once taken is the next end
    return F.aggregate(
        F.reverse(F.sequence(F.lit(1), F.col("n"))),
        F.array(F.col("n")),
        lambda ends, at: F.when(F.element_at(ends, 1) == at, F.concat(F.array(F.element_at(walked, at + 1)["from"]), ends)).otherwise(ends),
    )


def segment_words(words: DataFrame, pieces: DataFrame, of_byte: dict[int, int], longest: int, fold: str = "merge") -> DataFrame:
    """word, segments (start, stop, ids) of every row of ``words``; the fold is ``merge`` (BPE) or ``viterbi`` (unigram)."""
    cuts = merge_fold(longest) if fold == "merge" else viterbi_fold(longest)
    folded = lattice(words, pieces, longest).withColumn("cuts", cuts)
    hexed = F.array(*[F.lit(of_byte.get(b, 0)) for b in range(256)])

    def segment(i: Column) -> Column:
        start, end = F.element_at("cuts", i), F.element_at("cuts", i + 1)
        edge = F.element_at("edges", start * (longest + 1) + (end - start))
        own = F.substring(F.col("word"), start + 1, end - start)
        byte = lambda k: F.conv(F.substring(F.hex(own.cast("binary")), 2 * k + 1, F.lit(2)), 16, 10).cast("int")
        spelt = F.transform(F.sequence(F.lit(0), F.octet_length(own) - 1), lambda k: F.element_at(hexed, byte(k) + 1))
        ids = F.when(edge.isNotNull(), F.array(edge["id"])).otherwise(spelt)
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("stop"), ids.alias("ids"))

    return folded.select("word", F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), segment).alias("segments"))


def _ids(segments: Column) -> Column:
    return F.flatten(F.transform(segments, lambda s: s["ids"]))


def _windowed(long: DataFrame) -> DataFrame:
    """key, k, last, word: the windows of long words (key, word), each STEP behind the one before."""
    last = F.ceil((F.length("word") - WINDOW) / STEP).cast("int")
    dealt = long.select("key", "word", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return dealt.select("key", "k", "last", F.col("word").substr(F.col("k") * STEP + 1, F.lit(WINDOW)).alias("word"))


def _stitched(windows: DataFrame) -> DataFrame:
    """key, whole, ids of long words, from their windows (key, k, last, segments).

    A sequence of pieces is what the merges of its text give if each two neighbours of it are what the merges of their own
    text give. In a window all neighbours are. So two windows may be joined in a piece that both of them have; where
    they overlap, the first such piece is taken. ``whole`` tells whether there was one in each overlap.
    """
    shift = lambda s: F.struct((s["start"] + F.col("k") * STEP).alias("start"), (s["stop"] + F.col("k") * STEP).alias("stop"), s["ids"].alias("ids"))
    spans = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    placed = windows.select("key", "k", "last", F.transform("segments", shift).alias("own"))
    after = placed.select("key", (F.col("k") - 1).alias("k"), F.col("own").alias("after"))
    met = placed.join(after, ["key", "k"], "left")
    common = F.array_min(F.array_intersect(spans(F.col("own")), spans(F.col("after"))))["stop"]
    ends = met.select("key", "k", "own", F.when(F.col("k") == F.col("last"), F.lit(2147483647)).otherwise(common).alias("stop"))
    rows = F.array_sort(F.collect_list(F.struct("k", "stop", "own")))
    gathered = ends.groupBy("key").agg(rows.alias("rows"), F.every(F.col("stop").isNotNull()).alias("whole"))
    froms = F.concat(F.array(F.lit(0)), F.transform("rows", lambda r: r["stop"]))
    kept = F.zip_with("rows", froms, lambda r, begin: F.filter(r["own"], lambda s: (s["start"] >= begin) & (s["stop"] <= r["stop"])))
    own = F.flatten(F.filter(kept, lambda x: x.isNotNull()))
    return gathered.select("key", "whole", _ids(own).alias("ids"))


def encode_words(words: DataFrame, pieces: DataFrame, of_byte: dict[int, int], longest: int, fold: str = "merge") -> DataFrame:
    """word, ids of every row of ``words`` (distinct words).

    With merges, words beyond WINDOW characters go through the lattice in overlapping windows, which are stitched
    again, so that the work grows with their length; a word whose windows have nothing in common somewhere goes whole.
    """
    if fold != "merge":
        return segment_words(words, pieces, of_byte, longest, fold).select("word", _ids(F.col("segments")).alias("ids"))
    is_long = F.length("word") > WINDOW
    long = words.where(is_long).select(F.sha2(F.col("word").cast("binary"), 256).alias("key"), "word")
    windows = _windowed(long)
    parts = words.where(~is_long).unionByName(windows.select("word").distinct()).distinct()
    segments = written(segment_words(parts, pieces, of_byte, longest), "segments")
    short = words.where(~is_long).join(segments, "word").select("word", _ids(F.col("segments")).alias("ids"))
    stitched = written(_stitched(windows.join(segments, "word")), "stitched")
    done = stitched.where("whole").join(long, "key").select("word", "ids")
    rest = segment_words(long.join(stitched.where("not whole"), "key", "left_semi").select("word"), pieces, of_byte, longest)
    return short.unionByName(done).unionByName(rest.select("word", _ids(F.col("segments")).alias("ids")))


def encoder(pattern: str):
    """For cogroup: a block's texts and its words' ids to the encoded texts."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        lists = words.column("ids").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
        flat, ends = np.asarray(lists.flatten(), dtype="<u4").tobytes(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]) * 4
        held = {w: flat[a:b] for w, a, b in zip(words.column("word").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
        cut = re.compile(pattern)
        rows: dict[str, list] = {"doc_id": texts.column("doc_id").to_pylist(), "n_words": [], "n_tokens": [], "ids": [], "ids_crc32": [], "text": texts.column("text").to_pylist()}
        for text in rows["text"]:
            own = cut.split((SPACE + text).replace(" ", SPACE)) if text else []
            whole = b"".join(map(held.__getitem__, own))
            ids = np.frombuffer(whole, dtype="<u4")
            rows["n_words"].append(len(own))
            rows["n_tokens"].append(len(ids))
            rows["ids"].append(ids)
            rows["ids_crc32"].append(zlib.crc32(whole))
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_crc32": pa.int64(), "text": pa.string()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return run


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of the ids, by the piece table (bounded: the vocabulary)."""
    pieces, of_byte = load_pieces(vocabulary_path)
    names = {i: p.encode().hex() for p, i, _ in pieces} | {i: f"{b:02x}" for b, i in of_byte.items()}
    held = F.split(F.lit(",".join(names.get(i, "") for i in range(max(names) + 1))), ",")
    spelt = F.array_join(F.transform(ids, lambda i: F.element_at(held, i + 1)), "")
    whole = F.translate(F.decode(F.unhex(spelt), "UTF-8"), SPACE, " ")
    return encoded.withColumn("decoded", F.coalesce(F.substring(whole, 2, 2147483647), F.lit("")))


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, and range and share, which name a block of about ``block_bytes``: texts of a range of doc_ids, which is dealt out by hash if it has more."""
    size, low, high = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).first()
    n = -(-(size or 0) * 5 // (4 * block_bytes))  # ranges differ in size: most of them are to be below a block's
    span = min(max(1, -(-((high or 0) - (low or 0) + 1) // max(n, 1))), (1 << 63) - 1)
    ranged = docs.select("doc_id", "text", F.coalesce(F.expr(f"doc_id div {span}"), F.lit(0)).alias("range"))
    sizes = ranged.groupBy("range").agg(F.sum(F.octet_length("text")).alias("_size"))
    shares = sizes.select("range", F.greatest(F.ceil(F.coalesce("_size", F.lit(0)) / block_bytes), F.lit(1)).alias("_shares"))
    # the broadcast: a row for each range, which are about as many as blocks
    return ranged.join(F.broadcast(shares), "range").select("doc_id", "text", "range", F.pmod(F.xxhash64("doc_id", "text"), F.col("_shares")).cast("int").alias("share"))


def encode(docs: DataFrame, vocabulary_path: str, fold: str = "merge", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_tokens, ids, ids_crc32, round_trip (the ids spell the text again) of (doc_id, text)."""
    spark = docs.sparkSession
    listed, of_byte = load_pieces(vocabulary_path)
    longest, pattern = max(len(p) for p, *_ in listed), word_pattern(listed)
    pieces = spark.createDataFrame(listed, PIECES)

    block = ["range", "share"]
    dealt = blocks(docs, block_bytes)
    used = dealt.select(*block, F.explode(split_words(F.col("text"), pattern)).alias("word")).distinct()
    used = written(used, "words")
    encoded = encode_words(used.select("word").distinct(), pieces, of_byte, longest, fold)
    dictionary = used.join(encoded, "word")
    out = "doc_id bigint, n_words bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint, text string"
    encoded = dealt.groupBy(*block).cogroup(dictionary.groupBy(*block)).applyInArrow(encoder(pattern), out)
    spelt = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    return decode(encoded, vocabulary_path).select("doc_id", "n_words", "n_tokens", "ids", "ids_crc32", spelt.alias("round_trip"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every whole text of ``documents``, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, vocabulary(VOCABULARY))
