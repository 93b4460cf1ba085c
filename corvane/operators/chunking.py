"""From pages to chunks: page maps, token windows, sentences, semantic breaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import words

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"


def page_char_map(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Half-open character span of each page in its document's running text; empty pages have none.

    A document's pages are read in order by one window; a document is the unit of work.
    """
    size = F.length(text) + 1
    order = Window.partitionBy(doc).orderBy(page)
    filled = pages.where(F.length(text) > 0)
    return filled.select(doc, page, (F.sum(size).over(order) - size).cast("long").alias("start"), F.sum(size).over(order).cast("long").alias("end"))


def page_for_char(positions: DataFrame, spans: DataFrame, doc: str = "doc_id", page: str = "page_no", pos: str = "pos") -> DataFrame:
    """``positions`` with the page each stands on: behind the end the last page, without spans page 1.

    A document's spans meet as one array, so no range join is needed.
    """
    held = spans.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col(page).alias("page")))).alias("_spans"))
    at = F.get(F.filter("_spans", lambda s: (s["start"] <= F.col(pos)) & (F.col(pos) < s["end"])), F.lit(0))["page"]
    return positions.join(held, doc, "left").withColumn(page, F.coalesce(at, F.element_at("_spans", -1)["page"], F.lit(1))).drop("_spans")


def sentences(text: Column) -> Column:
    """Sentences, without blank ones."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(r"(?U)\S"))


def token_units(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 512) -> DataFrame:
    """doc, sentence, unit, n_tokens: sentences; one longer than ``size`` is several units."""
    split = docs.select(doc, F.posexplode(sentences(F.col(text))).alias("sentence", "_s"))
    n = F.size(words(F.col("_s")))
    parts = split.withColumn("_n", n).where("_n > 0").select(doc, "sentence", "_n", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(size))).alias("unit", "_at"))
    return parts.select(doc, "sentence", "unit", F.least(F.lit(size), F.col("_n") - F.col("_at")).cast("long").alias("n_tokens"))


def pack_plan(sizes: list[int], sentence: list[int], size: int, overlap: int, breaks: set[int], least: int) -> list[tuple[int, int]]:
    """(first, last) unit of each chunk.

    A chunk takes whole units while they fit; it ends early behind a sentence in ``breaks`` once it has ``least``
    tokens. The next begins there, or else with trailing units of at most ``overlap`` tokens; it always gets on.

    Where a chunk ends, and where the next begins, follows from its first unit alone: both are looked up in the running
    sums of the sizes, for all units at once, and the chunks are the walk from the first unit on.
    """
    n = len(sizes)
    if not n:
        return []
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at, owner = np.arange(n), np.asarray(sentence)
    topic = np.isin(owner, list(breaks))
    # the last unit that fits; the first unit at the end of a topic with enough tokens before it
    fits = np.maximum(at, np.searchsorted(sums, sums[:-1] + size, side="right") - 2)
    ends = np.append(np.flatnonzero(topic & np.append(owner[1:] != owner[:-1], True)), n - 1)
    enough = np.maximum(at, np.searchsorted(sums, sums[:-1] + least, side="left") - 1)
    last = np.minimum(np.minimum(fits, ends[np.minimum(np.searchsorted(ends, enough), len(ends) - 1)]), n - 1)
    trailing = np.searchsorted(sums, sums[last + 1] - overlap, side="left")
    following = np.where(topic[last], last + 1, np.clip(trailing, at + 1, last + 1))
    plan = [(0, int(last[0]))]
    while plan[-1][1] < n - 1:
        first = int(following[plan[-1][0]])
        plan.append((first, int(last[first])))
    return plan


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_breaks(sents: DataFrame, doc: str = "doc_id", at: str = "sentence", vector: str = "vector", percentile: float = 0.9) -> DataFrame:
    """(doc, sentence) behind which the distance to the next vector is beyond the document's percentile."""
    order = Window.partitionBy(doc).orderBy(at)
    gaps = sents.withColumn("_next", F.lead(vector).over(order)).where(F.col("_next").isNotNull()).select(doc, at, (1 - dot(F.col(vector), F.col("_next"))).alias("distance"))
    limit = gaps.groupBy(doc).agg(F.percentile("distance", F.lit(percentile)).alias("_limit"), F.count(F.lit(1)).alias("_n"))
    return gaps.join(limit, doc).where((F.col("distance") > F.col("_limit")) & (F.col("_n") >= 2)).select(doc, at, "distance")


def page_lines(found: DataFrame, keys: list[str], tolerance: float = 0.6) -> DataFrame:
    """keys, line, and the words' columns: words whose centres are near that of a line's first word share it.

    What a word belongs to depends on the line begun before it, so a page is read in order in Python.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", line int"

    def lines(page: pd.DataFrame) -> pd.DataFrame:
        centre = (page["y0"] + page["y1"]) / 2
        page = page.assign(_c=centre).sort_values(["_c", "x0"], kind="stable")
        reach = tolerance * (page["y1"] - page["y0"]).median()
        numbers, anchor, n = [], None, -1
        for c in page["_c"]:
            if anchor is None or abs(c - anchor) > reach:
                anchor, n = c, n + 1
            numbers.append(n)
        return page.drop(columns="_c").assign(line=numbers)

    return found.groupBy(*keys).applyInPandas(lines, schema)
