"""Line deduplication by site-relative frequency.

For each host, the number of its pages that contain a line is divided by the number of its pages;
lines beyond a boilerplate ratio go from all pages of the host. Lines are compared without outer
spaces and known by a 128-bit digest.

A line counts once a page, and counts are combined before the shuffle, so a hot host or line costs a
row a task. The lines to drop are few whatever the number of pages (at most the mean number of lines
a page divided by the ratio, for each host): they are gathered to one row a host and joined to the
pages, by broadcast if their counted size is small, else with the pages of a host salted over
``salts`` tasks.

Defined cases: a null text stays null, a null host is a host of its own; blank lines are never dropped;
hosts with fewer than ``min_pages`` pages that share a line keep it; repeated rows are pages of their own;
an empty table gives an empty result; further columns are passed on, but for ones named n_lines or n_dropped,
which give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

MAX_RATIO = 0.1
MIN_PAGES = 5
#: Lines to drop that are broadcast at most (about 100 bytes each).
BROADCAST_LINES = 50_000
SALTS = 64

NONE = "\x00none"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_host, _line (digest) of every line on more than ``max_ratio`` of a host's pages, and on ``min_pages`` at least."""
    keyed = pages.select(F.coalesce(F.col(host).cast("string"), F.lit(NONE)).alias("_host"), F.col(text).alias("_text"))
    totals = keyed.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    filled = F.filter(F.transform(_lines(F.col("_text")), F.trim), lambda line: line != "")
    lines = keyed.select("_host", F.explode(F.array_distinct(filled)).alias("_own")).select("_host", _digest(F.col("_own")).alias("_line"))
    counts = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_on")).where(F.col("_on") >= min_pages)
    return counts.join(totals, "_host").where(F.col("_on") > max_ratio * F.col("_pages")).select("_host", "_line")


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, salts: int = SALTS) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text``, and n_lines, n_dropped."""
    drop = written(boilerplate(pages, host, text, max_ratio, min_pages), "boilerplate")
    by_host = drop.groupBy("_host").agg(F.collect_set("_line").alias("_drop"))
    # a page's columns go along as one, whatever their names
    keyed = pages.select(F.struct(*pages.columns).alias("_row"), F.col(text).alias("_text"), F.coalesce(F.col(host).cast("string"), F.lit(NONE)).alias("_host"))
    if drop.count() <= broadcast_lines:
        joined = keyed.join(F.broadcast(by_host), "_host", "left")
    else:
        salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
        spread = by_host.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = salted.join(spread, ["_host", "_salt"], "left")
    lines = _lines(F.col("_text"))
    kept = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col("_drop"), _digest(line)))
    out = joined.withColumn("_kept", F.when(F.col("_drop").isNull(), lines).otherwise(kept))
    cleaned = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    return out.select(
        *[cleaned.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in pages.columns if c not in ("n_lines", "n_dropped")],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the lines that recur over their source."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE_SQL = f"""
WITH pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
lines AS (SELECT DISTINCT doc_id, source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
gone AS (SELECT l.source, l.line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
         WHERE l.line <> '' GROUP BY l.source, l.line, p.pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO} * p.pages),
own AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
kept AS (SELECT o.doc_id, string_agg(o.line, chr(10) ORDER BY o.i) AS text, count(*) AS n FROM own o
         LEFT JOIN gone g ON g.source IS NOT DISTINCT FROM o.source AND g.line = trim(o.line) WHERE g.line IS NULL GROUP BY o.doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
       coalesce(len(string_split(d.text, chr(10))), 0) - CASE WHEN d.text IS NULL THEN 0 ELSE coalesce(k.n, 0) END AS n_dropped
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
