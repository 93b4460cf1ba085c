"""Chunks as spans of their document's text: what stands between two tokens' offsets, with the pages it stands on.

A tokenizer gives each token's start and end in characters (see operators/models.py); without one, tokens are runs without
white space. A document is read by one task at a time, and its chunks are slices of its text, so text is never put
together from tokens. Pages are found by an interval join: spans of pages and ends of chunks meet in blocks of characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from corvane.functions.text import is_reference
from corvane.operators.chunking import SENTENCE_END, pack_plan, page_char_map, semantic_breaks

STRATEGIES = ("fixed", "sentence")
CHUNK = "chunk_index int, n_tokens bigint, char_start bigint, char_end bigint, text string"
SPANS = "array<struct<start:bigint,end:bigint>>"
#: Characters of a block in which positions meet pages.
BLOCK = 4096


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence that is not blank."""
    ends = [(m.start(), m.end()) for m in re.finditer(SENTENCE_END, text)]
    starts = [0, *[b for _, b in ends]]
    return [(a, b) for a, b in zip(starts, [*[a for a, _ in ends], len(text)], strict=True) if text[a:b].strip()]


def _offsets(texts: list[str | None], tokens: pa.ListArray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The starts and ends of each text's tokens."""
    if tokens is None:
        for text in texts:
            found = np.array([m.span() for m in re.finditer(r"\S+", text or "")], dtype=np.int64).reshape(-1, 2)
            yield found[:, 0], found[:, 1]
        return
    at = tokens.offsets.to_numpy()
    starts, ends = (tokens.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
    for i in range(len(tokens)):
        own = slice(at[i], at[i + 1]) if tokens[i].is_valid else slice(0, 0)
        yield starts[own], ends[own]


def _fixed(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges of windows; the last is the one that reaches the end."""
    step = max(1, size - overlap)
    return [(lo, min(lo + size, n)) for lo in range(0, n, step) if lo == 0 or lo - step + size < n]


def _packed(text: str, starts: np.ndarray, size: int, overlap: int, breaks: set[int], least: int) -> list[tuple[int, int]]:
    """Token ranges of chunks of whole sentences."""
    units = []
    for k, (a, b) in enumerate(sentence_spans(text)):
        lo, hi = (int(x) for x in np.searchsorted(starts, (a, b)))
        units += [(k, w, min(w + size, hi)) for w in range(lo, hi, size)]
    plan = pack_plan([hi - lo for _, lo, hi in units], [k for k, _, _ in units], size, overlap, breaks, least)
    return [(units[a][1], units[b][2]) for a, b in plan]


def _slicer(doc: str, strategy: str, size: int, overlap: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: documents to their chunks."""
    names = [doc, "chunk_index", "n_tokens", "char_start", "char_end", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            tokens = batch.column("_tokens") if "_tokens" in batch.schema.names else None
            breaks = batch.column("_breaks").to_pylist()
            own: list[int] = []
            found: list[tuple] = []
            for i, (text, (starts, ends)) in enumerate(zip(texts, _offsets(texts, tokens), strict=True)):
                if strategy == "fixed":
                    ranges = _fixed(len(starts), size, overlap)
                else:
                    ranges = _packed(text or "", starts, size, overlap, set(breaks[i] or []), least)
                k = 0
                for lo, hi in ranges:
                    a, b = int(starts[lo]), int(ends[hi - 1])
                    whole = text[a:b].strip()
                    if whole or strategy != "fixed":
                        own.append(i)
                        found.append((k, hi - lo, a, b, whole))
                        k += 1
                if len(found) >= 4096 or (i == len(texts) - 1 and found):
                    columns = list(zip(*found, strict=True))
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column("_doc").take(pa.array(own)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)
                    own, found = [], []

    return run


def chunk_spans(docs: DataFrame, strategy: str = "fixed", doc: str = "doc_id", text: str = "text", tokens: Column | None = None, breaks: str | None = None, size: int = 512, overlap: int = 50, least: int = 64) -> DataFrame:
    """doc, chunk_index, n_tokens, char_start, char_end, text of each chunk; the text is that between the offsets, without outer white space.

    ``fixed``: windows of ``size`` tokens. ``sentence``: whole sentences while they fit; with ``breaks``, a column of sentence numbers,
    a chunk of ``least`` tokens ends behind such a sentence. ``tokens``: a tokenizer's (id, start, end), e.g. tokenizer(load)(F.col("text")).
    A null or blank text has no chunk.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    given = [] if tokens is None else [F.transform(tokens, lambda t: F.struct(t["start"].cast("long").alias("start"), t["end"].cast("long").alias("end"))).cast(SPANS).alias("_tokens")]
    cut = F.col(breaks).cast("array<int>") if breaks else F.lit(None).cast("array<int>")
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), cut.alias("_breaks"), *given)
    schema = StructType([docs.schema[doc], *StructType.fromDDL(CHUNK)])
    return rows.mapInArrow(_slicer(doc, strategy, size, overlap, least), schema)


def running_text(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """doc, text: the pages that are not empty, each with a space behind it."""
    filled = pages.where(F.length(text) > 0).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("_n"), F.col(text).alias("_t")))).alias("_p"))
    return filled.select(doc, F.concat(F.array_join(F.transform("_p", lambda p: p["_t"]), " "), F.lit(" ")).alias("text"))


def on_pages(rows: DataFrame, spans: DataFrame, doc: str = "doc_id", pos: str = "pos", page: str = "page_no") -> DataFrame:
    """``rows`` with the page that each position stands on: behind the end the last page, without pages page 1.

    An interval join by equality: a span stands in each block of BLOCK characters that it reaches into, a position in one, so
    a long document's positions are spread over its blocks, and in a block they meet at most BLOCK / 2 spans.
    """
    block = lambda c: F.floor(c / BLOCK)
    blocks = spans.select(F.col(doc).alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col(page).alias("_p"), F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1))).alias("_b"))
    at = F.col(pos)
    met = rows.join(blocks, (F.col(doc) == F.col("_d")) & (block(at) == F.col("_b")) & (at >= F.col("_s")) & (at < F.col("_e")), "left")
    last = spans.groupBy(F.col(doc).alias("_l")).agg(F.max_by(page, "start").alias("_last"))  # a row a document
    return met.join(last, F.col(doc) == F.col("_l"), "left").select(*rows.columns, F.coalesce("_p", "_last", F.lit(1)).cast(spans.schema[page].dataType).alias(page))


def with_pages(chunks: DataFrame, spans: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """``chunks`` with page_start and page_end: the pages of their first and last character."""
    first, last = F.col("char_start"), F.greatest(F.col("char_start"), F.col("char_end") - 1)
    ends = chunks.select(doc, "chunk_index", F.explode(F.array(first, last)).alias("pos"))
    found = on_pages(ends, spans, doc, "pos", page).groupBy(doc, "chunk_index").agg(F.min_by(page, "pos").alias("page_start"), F.max_by(page, "pos").alias("page_end"))
    return chunks.join(found, [doc, "chunk_index"])


def topic_breaks(docs: DataFrame, embed: Callable[[Column], Column], doc: str = "doc_id", text: str = "text", percentile: float = 0.9, around: int = 1) -> DataFrame:
    """doc, breaks: the sentences behind which the topic shifts, for documents that have such.

    Each sentence goes to ``embed`` (text to unit vector) together with ``around`` sentences on either side; a shift is a distance to the
    next vector beyond the document's percentile. Texts of fewer than three sentences have none.
    """
    spans = F.pandas_udf(lambda texts: texts.map(lambda t: [t[a:b] for a, b in sentence_spans(t or "")]), "array<string>")
    each = docs.select(doc, F.posexplode(spans(text)).alias("sentence", "_s"))
    near = Window.partitionBy(doc).orderBy("sentence").rowsBetween(-around, around)
    windows = each.select(doc, "sentence", F.array_join(F.collect_list("_s").over(near), " ").alias("_w"))
    shifts = semantic_breaks(windows.select(doc, "sentence", embed(F.col("_w")).alias("vector")), doc, percentile=percentile)
    return shifts.groupBy(doc).agg(F.array_sort(F.collect_list(F.col("sentence").cast(IntegerType()))).alias("breaks"))


def chunk_pages(pages: DataFrame, strategy: str = "fixed", doc: str = "doc_id", page: str = "page_no", text: str = "text", tokenizer: Callable[[Column], Column] | None = None, embed: Callable[[Column], Column] | None = None, size: int = 512, overlap: int = 50, least: int = 64) -> DataFrame:
    """doc, chunk_index, page_start, page_end, is_reference, n_tokens, char_start, char_end, text of the documents whose pages these are.

    Strategies: those of chunk_spans(), and ``semantic``: sentences that begin anew at topic_breaks().
    """
    docs = running_text(pages, doc, page, text)
    breaks = None
    if strategy == "semantic":
        if embed is None:
            raise ValueError("the semantic strategy needs an embedder")
        docs, strategy, breaks = docs.join(topic_breaks(docs, embed, doc), doc, "left"), "sentence", "breaks"
    tokens = tokenizer(F.col("text")) if tokenizer else None
    chunks = chunk_spans(docs, strategy, doc, "text", tokens, breaks, size, overlap, least)
    paged = with_pages(chunks, page_char_map(pages, doc, page, text), doc, page)
    return paged.select(doc, "chunk_index", "page_start", "page_end", is_reference(F.col("text")).alias("is_reference"), "n_tokens", "char_start", "char_end", "text")
