"""Joins that enrich chunks and keep tables in step: notes, tables, figures, labels, to-do lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.text import grid_values, present, text_hash


def attach_notes(chunks: DataFrame, notes: DataFrame, prompt: str) -> DataFrame:
    """``chunks`` (chunk_id, text) with the notes (chunk_id, text_hash, prompt_version, note, grid, grid_ok) that are current.

    state: described, stale, or null where there is no note.
    """
    own = notes.select("chunk_id", F.col("text_hash").alias("_hash"), F.col("prompt_version").alias("_prompt"), "note", "grid", "grid_ok")
    current = (F.col("_hash") == text_hash(F.col("text"))) & (F.col("_prompt") == prompt)
    joined = chunks.join(own, "chunk_id", "left")
    state = F.when(F.col("_hash").isNull(), None).when(current, "described").otherwise("stale")
    return joined.select(*chunks.columns, state.alias("state"), F.when(current, present(F.col("note"))).alias("table_note"), F.when(current & F.col("grid_ok"), present(F.col("grid"))).alias("table_markdown"))


def attach_tables(chunks: DataFrame, tables: DataFrame, least: float = 0.4) -> DataFrame:
    """(paper, table_no, chunk_id) of each table on the chunks of its page that hold its caption or enough of its values.

    ``chunks``: chunk_id, paper, page_start, page_end, text; ``tables``: paper, table_no, page, caption, markdown. An
    equi-join on paper and page: a chunk is exploded to the few pages it covers.
    """
    paged = chunks.select("chunk_id", "paper", "text", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    keyed = tables.withColumn("_key", F.array_join(F.slice(F.split("caption", r"\s+"), 1, 2), " ")).withColumn("_values", grid_values(F.col("markdown")))
    met = keyed.join(paged, ["paper", "page"])
    text = F.col("text")
    held = F.size(F.filter("_values", lambda v: F.contains(text, v))) / F.when(F.size("_values") > 0, F.size("_values"))
    return met.where(F.contains(text, F.col("_key")) | (F.coalesce(held, F.lit(0.0)) >= least)).select("paper", "table_no", "chunk_id")


def attach_figures(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """(chunk_id, figure_note, figure_images) of the chunks whose text names figures of their paper.

    The figure numbers a text names are read off it, so chunks meet figures by an equi-join.
    """
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)\b(?:Figure|Fig\.?)\s*(\d+)\b"), F.lit(1)))
    mentions = chunks.select("chunk_id", "paper", F.explode(named).alias("figure_no"))
    note = F.concat(F.lit("Figure "), "figure_no", F.lit(": "), "caption", F.coalesce(F.concat(F.lit(" "), present(F.col("description"))), F.lit("")))
    met = figures.withColumn("_note", note).join(mentions, ["paper", "figure_no"])
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c])
    return met.groupBy("chunk_id").agg(F.array_join(F.array_distinct(ordered("_note")), "\n").alias("figure_note"), F.array_join(F.array_distinct(ordered("image")), ",").alias("figure_images"))


def label_problems(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_id, problem) of the labels (qid, chunk_id, text_hash) whose chunk is gone or has changed."""
    now = chunks.select("chunk_id", text_hash(F.col("text")).alias("_now"))
    problem = F.when(F.col("_now").isNull(), "no longer exists").when(F.col("_now") != F.col("text_hash"), "text changed")
    return labels.join(now, "chunk_id", "left").withColumn("problem", problem).where("problem is not null").select("qid", "chunk_id", "problem")


def fill_from(rows: DataFrame, other: DataFrame, keys: list[str], columns: list[str], usable=present, prefer_other: bool = False) -> DataFrame:
    """``rows`` whose ``columns`` are filled from ``other`` where they are empty, or wherever ``other`` has something."""
    own = other.select(*keys, *[usable(F.col(c)).alias(f"_{c}") for c in columns])
    pick = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if prefer_other else F.coalesce(usable(F.col(c)), F.col(f"_{c}"))
    joined = rows.join(own, keys, "left")
    return joined.select(*[pick(c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def upsert(held: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` and those rows of ``fresh`` whose keys it has not."""
    return held.unionByName(fresh.join(held.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def todo(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.join(done.select(*keys), keys, "left_anti")


def neighbours(chunks: DataFrame, paper: str, at: str, value: str) -> DataFrame:
    """``chunks`` with the value of the chunk before and after each in its paper."""
    order = Window.partitionBy(paper).orderBy(at)
    return chunks.withColumn("before", F.lag(value).over(order)).withColumn("after", F.lead(value).over(order))


def answered_by_all(rows: DataFrame, unit: str, group: str) -> DataFrame:
    """Units that every group has (relational division)."""
    groups = rows.select(group).distinct().agg(F.count(F.lit(1)).alias("_groups"))
    per = rows.select(unit, group).distinct().groupBy(unit).agg(F.count(F.lit(1)).alias("_n"))
    return per.crossJoin(F.broadcast(groups)).where("_n = _groups").select(unit)  # one row




def closest_model(listed: DataFrame, wanted: str, family: str = "flash", variant: str = "lite") -> DataFrame:
    """The listed model (name) nearest to one that is gone: of its variant, else its family, else any.

    Previews and experiments come last, higher version numbers first, then the name.
    """
    name = F.col("name")
    kin = F.when(~name.contains(family), 2).when(name.contains(variant) == F.lit(variant in wanted), 0).otherwise(1)
    trial = name.contains("preview") | name.contains("exp")
    versions = F.transform(F.regexp_extract_all(name, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: -x.cast("double"))
    versions = F.when(F.size(versions) > 0, versions).otherwise(F.array(F.lit(-0.0)))
    return listed.select("name").orderBy(kin, trial, versions, "name").limit(1)


#: fixed values: what a document's metadata may hold, in this order
DOCUMENT_FIELDS = ("chunk_id", "arxiv_id", "title", "year", "page_start", "page_end", "score", "is_reference", "table_markdown", "table_grid_source", "figure_note", "figure_images")


def as_documents(hits: DataFrame, *keys: str | Column) -> DataFrame:
    """keys, page_content and metadata (a struct of those of DOCUMENT_FIELDS that ``hits`` has) of each hit."""
    there = [c for c in DOCUMENT_FIELDS if c in hits.columns]
    return hits.select(*keys, F.col("text").alias("page_content"), F.struct(*there).alias("metadata"))


# fixed values: the lines of the prompt
def judge_prompt(sources: Column, question: Column, sentences: Column, evidence: Column) -> Column:
    """What a judge is asked: the numbered sources, the question, the answer's sentences, and the quotes that are not blank."""
    numbered = F.transform(sentences, lambda s, i: F.concat(F.lit("SENTENCE "), (i + 1).cast("string"), F.lit(": "), s))
    quotes = F.filter(F.coalesce(evidence, F.array().cast("array<string>")), lambda e: F.coalesce(e.rlike(r"(?U)\S"), F.lit(False)))
    told = F.when(F.size(quotes) > 0, F.concat(F.array(F.lit("\nReference quote(s) the question was written from:")), F.transform(quotes, lambda q: F.concat(F.lit("- "), q)))).otherwise(F.array(F.lit("\nNo reference quote is given.")))
    lines = F.concat(F.array(sources, F.concat(F.lit("\nQuestion: "), question, F.lit("\n")), F.lit("Answer, split into sentences:")), numbered, told)
    return F.array_join(lines, "\n")


def expand_split_tables(hits: DataFrame, chunks: DataFrame, by: list[str], most: int = 2, window: int = 30) -> DataFrame:
    """``hits`` with text and pages widened where a hit begins or ends within a table, and expanded_with.

    A hit whose first (last) ``window`` tokens look like a table's takes the chunk before (behind) it along, unless that
    is a hit itself; a chunk that two hits ask for goes to the first of them, and only the first ``most`` hits of a
    query that get one are widened. ``hits``: by, rank, paper, idx, text, page_start, page_end; ``chunks`` likewise
    without by and rank. Grids (``table_markdown``), if both have them, go along, each once.
    """
    tokens = T.words(F.col("text"))
    long = F.size(tokens) >= window
    sides = F.filter(F.array(F.when(T.table_like(F.slice(tokens, 1, window)), -1), F.when(T.table_like(F.slice(tokens, -window, window)), 1)), lambda s: s.isNotNull())
    asked = hits.where(long).select(*by, "rank", "paper", F.explode(sides).alias("side"), "idx").withColumn("_idx", F.col("idx") + F.col("side")).drop("idx")
    new = asked.join(hits.select(*by, "paper", F.col("idx").alias("_idx")), [*by, "paper", "_idx"], "left_anti")
    grids = "table_markdown" in hits.columns and "table_markdown" in chunks.columns
    part = F.struct(F.col("idx").alias("idx"), "text", "page_start", "page_end", *(["table_markdown"] if grids else [])).alias("_part")
    found = new.join(chunks.select("paper", F.col("idx").alias("_idx"), part), ["paper", "_idx"])
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "paper", "_idx").orderBy("rank", "side"))).where("_n = 1")
    taken = first.withColumn("_n", F.dense_rank().over(Window.partitionBy(*by).orderBy("rank"))).where(F.col("_n") <= most)
    beside = taken.groupBy(*by, "rank").agg(F.first(F.when(F.col("side") < 0, F.col("_part")), ignorenulls=True).alias("_before"), F.first(F.when(F.col("side") > 0, F.col("_part")), ignorenulls=True).alias("_after"))
    met = hits.join(beside, [*by, "rank"], "left")
    before, after = F.col("_before.text"), F.col("_after.text")
    led = F.when(before.isNull(), F.col("text")).otherwise(T.overlap_merged(before, F.col("text")))
    whole = F.when(after.isNull(), F.col("_led")).otherwise(T.overlap_merged(F.col("_led"), after))
    out = met.withColumn("_led", led).withColumns(
        {
            "text": whole,
            "page_start": F.least("page_start", "_before.page_start"),
            "page_end": F.greatest("page_end", "_after.page_end"),
            "expanded_with": F.array_compact(F.array("_before.idx", "_after.idx")),
        }
    )
    if grids:
        each = F.split(F.concat_ws("\n\n", "_before.table_markdown", "table_markdown", "_after.table_markdown"), "\n\n")
        out = out.withColumn("table_markdown", F.array_join(F.array_distinct(F.filter(each, lambda g: F.trim(g) != "")), "\n\n"))
    return out.drop("_before", "_after", "_led")
