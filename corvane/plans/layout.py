"""Words, captions, tables and figures of a page: their queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import text as T
from corvane.operators import chunking as C
from corvane.operators import layout as L
from corvane.plans.text import QUOTE, STRIP
from corvane.session import Fixture

BOXES = Fixture("page int, figure int, x0 double, y0 double, x1 double, y1 double", [(1, 1, 10.0, 20.0, 30.0, 40.0), (1, 1, 5.0, 25.0, 20.0, 60.0), (1, 2, 0.0, 0.0, 1.0, 1.0)], per="pages", ids="page", moved="x0 x1")


@query("union_rect", f"SELECT page, figure, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {BOXES.sql} GROUP BY page, figure")
def union_rect(spark, sf_dir):
    return BOXES.frame(spark, sf_dir).groupBy("page", "figure").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])


LINE_WORDS = Fixture(
    "page int, line int, x0 double, x1 double, text string, y0 double, y1 double",
    [
        (1, 1, 10.0, 30.0, "Method", 0.0, 10.0), (1, 1, 50.0, 60.0, "C10", 1.0, 11.0), (1, 1, 62.0, 70.0, "err", 0.0, 10.0), (1, 2, 10.0, 20.0, "ours", 20.0, 30.0), (1, 2, 50.0, 58.0, "7.3", 21.0, 31.0), (1, 3, 10.0, 90.0, "prose", 40.0, 50.0),
        (2, 1, 0.0, 10.0, "wide", 0.0, 10.0), (2, 1, 14.0, 20.0, "type", 0.0, 10.0), (2, 1, 27.0, 40.0, "here", 0.0, 10.0), (2, 2, 0.0, 10.0, "two", 20.0, 30.0), (2, 2, 14.0, 20.0, "words", 20.0, 30.0), (2, 2, 31.0, 40.0, "cell", 20.0, 30.0), (3, 1, 0.0, 5.0, "x", 0.0, 9.0), (3, 1, 30.0, 35.0, "y", 0.0, 9.0),
    ],
    per="pages", ids="page", moved="x0 x1",
)
_THRESHOLDS = f"g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY page, line ORDER BY x0, x1) AS gap FROM {LINE_WORDS.sql}), t AS (SELECT page, greatest(6.0, 2.5 * coalesce(quantile_cont(gap, 0.5) FILTER (WHERE gap > 0 AND gap <= 8), 3.0)) AS threshold FROM g GROUP BY page)"


@query("cell_threshold", f"WITH {_THRESHOLDS} SELECT page, threshold FROM t")
def cell_threshold(spark, sf_dir):
    return L.cell_thresholds(LINE_WORDS.frame(spark, sf_dir), ["page"])


_CELLED = f"""{_THRESHOLDS}, c AS (SELECT g.*, CAST(sum(CASE WHEN gap >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY g.page, line ORDER BY x0, x1) AS BIGINT) AS cell FROM g JOIN t ON t.page = g.page)"""


@query("split_cells", f"WITH {_CELLED} SELECT page, line, cell, min(x0) AS x0, max(x1) AS x1, string_agg(text, ' ' ORDER BY x0) AS text FROM c GROUP BY page, line, cell")
def split_cells(spark, sf_dir):
    return L.split_cells(LINE_WORDS.frame(spark, sf_dir).select("page", "line", "x0", "x1", "text"), ["page"])


@query("page_lines", f"SELECT page, x0, x1, text, y0, y1, CAST(dense_rank() OVER (PARTITION BY page ORDER BY line) - 1 AS INTEGER) AS line FROM {LINE_WORDS.sql}")
def page_lines(spark, sf_dir):
    """Words grouped to lines by their height alone; the fixture names the lines they belong to."""
    return C.page_lines(LINE_WORDS.frame(spark, sf_dir).drop("line"), ["page"])


@query("to_grid", "SELECT CAST(v.page + 1000 * page_id AS INTEGER) AS page, markdown FROM pages, (VALUES (1, '| Method | C10 err |' || chr(10) || '| --- | --- |' || chr(10) || '| ours | 7.3 |'), (2, '| wide type here |  |' || chr(10) || '| --- | --- |' || chr(10) || '| two words | cell |')) AS v(page, markdown)")
def to_grid(spark, sf_dir):
    """The cells of two pages' lines laid out in columns (SQL: the grids that the rule gives by hand)."""
    cells = L.split_cells(LINE_WORDS.frame(spark, sf_dir).where("page % 1000 < 3 and line < 3").select("page", "line", "x0", "x1", "text"), ["page"])
    return L.to_grid(cells, ["page"]).select("page", T.grid_markdown(F.col("grid")).alias("markdown"))


PAGE_LINES = Fixture(
    "page int, line int, y0 double, y1 double, text string",
    [(1, 0, 0.0, 10.0, "Figure 1: Error of  all"), (1, 1, 12.0, 22.0, "methods on C10."), (1, 2, 24.0, 34.0, "More of it."), (1, 3, 36.0, 46.0, "Not of it."), (1, 4, 50.0, 60.0, "Fig. 2a. Short"), (1, 5, 62.0, 72.0, "FIGURE 3 : next"), (1, 6, 100.0, 110.0, "far below"), (2, 0, 0.0, 10.0, "see Figure 4: no caption"), (2, 1, 20.0, 30.0, " Figure 5. The last"), (2, 2, 32.0, 42.0, "   ")],
    per="pages", ids="page", texts="text",
)
_FIGURE = QUOTE(L.FIGURE_CAPTION)


@query(
    "figure_captions",
    f"""WITH l AS (SELECT *, lead(text, 1) OVER w AS t1, lead(y0, 1) OVER w AS a1, lead(text, 2) OVER w AS t2, lead(y0, 2) OVER w AS a2 FROM {PAGE_LINES.sql} WINDOW w AS (PARTITION BY page ORDER BY line)),
c AS (SELECT *, coalesce(trim(t1) <> '', false) AND NOT coalesce(regexp_matches(t1, {_FIGURE}), false) AND a1 - y1 <= 1.6 * greatest(6, y1 - y0) AS o1, coalesce(trim(t2) <> '', false) AND NOT coalesce(regexp_matches(t2, {_FIGURE}), false) AND a2 - y1 <= 1.6 * greatest(6, y1 - y0) AS o2 FROM l WHERE regexp_matches(text, {_FIGURE}))
SELECT page, line, y0, y1, regexp_extract(text, {_FIGURE}, 1) AS figure_no, {STRIP("regexp_replace(concat(text, CASE WHEN o1 THEN concat(' ', t1) ELSE '' END, CASE WHEN o1 AND o2 THEN concat(' ', t2) ELSE '' END), '\\s+', ' ', 'g')")} AS caption FROM c""",
)
def figure_captions(spark, sf_dir):
    return L.figure_captions(PAGE_LINES.frame(spark, sf_dir), ["page"])


CAPTION_CELLS = Fixture("page int, line int, x0 double, x1 double, text string", [(1, 0, 0.0, 9.0, "Table 1: Errors  in %"), (1, 0, 20.0, 30.0, "Figure 2: x"), (1, 1, 0.0, 9.0, "see Table 2: x"), (1, 2, 0.0, 5.0, " TABLE IV. More"), (1, 3, 0.0, 5.0, "Table 3 shows")], per="pages", ids="page", texts="text", moved="x0 x1")


@query("table_captions", f"SELECT page, line, x0, x1, text, {STRIP("regexp_replace(text, '\\s+', ' ', 'g')")} AS caption FROM {CAPTION_CELLS.sql} WHERE regexp_matches(text, {QUOTE(L.TABLE_CAPTION)})")
def table_captions(spark, sf_dir):
    return L.table_captions(CAPTION_CELLS.frame(spark, sf_dir))


FIGURE_AT = Fixture("page int, figure_no string, y0 double, y1 double, width double, height double", [(1, "1", 300.0, 310.0, 600.0, 800.0), (1, "2", 700.0, 710.0, 600.0, 800.0), (2, "3", 20.0, 30.0, 600.0, 800.0), (3, "4", 500.0, 510.0, 600.0, 800.0)], per="pages", ids="page", moved="y0 y1")
GRAPHICS = Fixture("page int, bx0 double, by0 double, bx1 double, by1 double", [(1, 50.0, 100.0, 200.0, 290.0), (1, 220.0, 120.0, 400.0, 301.0), (1, 10.0, 320.0, 90.0, 340.0), (1, 100.0, 500.0, 300.0, 690.0), (2, 30.0, 40.0, 700.0, 300.0), (2, 40.0, 0.0, 60.0, 10.0), (3, 0.0, 10.0, 300.0, 60.0), (3, 0.0, 520.0, 30.0, 700.0), (1, 0.0, 0.0, 600.0, 300.0), (1, 0.0, 0.0, 600.0, 798.0), (2, 0.0, 40.0, 600.0, 795.0), (2, 9.0, 50.0, 9.0, 60.0)], per="pages", ids="page", moved="by0 by1")


@query(
    "figure_area",
    f"""WITH m AS (SELECT f.*, b.*, unnest([0, 1]) AS side FROM {FIGURE_AT.sql} f JOIN {GRAPHICS.sql} b ON b.page = f.page WHERE bx1 > bx0 AND by1 > by0 AND (bx1 - bx0) * (by1 - by0) <= 0.9 * width * height),
s AS (SELECT figure_no, side, greatest(min(bx0), 0) AS x0, greatest(min(by0), 0) AS y0, least(max(bx1), any_value(width)) AS x1, least(max(by1), any_value(height)) AS y1 FROM m WHERE CASE side WHEN 0 THEN by1 <= y0 + 2 AND by1 > y0 - 420 ELSE by0 >= y1 - 2 AND by0 < y1 + 420 END GROUP BY figure_no, side)
SELECT figure_no, x0 - 4 AS x0, y0 - 4 AS y0, x1 + 4 AS x1, y1 + 4 AS y1 FROM s WHERE x1 - x0 >= 40 AND y1 - y0 >= 40 QUALIFY row_number() OVER (PARTITION BY figure_no ORDER BY side) = 1""",
)
def figure_area(spark, sf_dir):
    return L.figure_areas(FIGURE_AT.frame(spark, sf_dir), GRAPHICS.frame(spark, sf_dir), ["page"], ["figure_no"])


CELL_LINES = Fixture(
    "page int, line int, y0 double, y1 double, x0 double, x1 double, text string",
    [
        (1, 0, 0.0, 10.0, 0.0, 500.0, "a line of prose"),
        (1, 1, 30.0, 40.0, 10.0, 60.0, "Method"), (1, 1, 30.0, 40.0, 100.0, 140.0, "C10"), (1, 1, 30.0, 40.0, 320.0, 360.0, "SVHN"),
        (1, 2, 45.0, 55.0, 10.0, 60.0, "ours"), (1, 2, 45.0, 55.0, 100.0, 140.0, "7.3"), (1, 2, 45.0, 55.0, 320.0, 360.0, "9.1"), (1, 2, 45.0, 55.0, 700.0, 710.0, "a figure's own"),
        (1, 3, 60.0, 70.0, 10.0, 60.0, "theirs"), (1, 3, 60.0, 70.0, 100.0, 140.0, "8.4"),
        (1, 4, 110.0, 120.0, 10.0, 160.0, "Table 1: Errors"),
        (1, 5, 300.0, 310.0, 10.0, 60.0, "too"), (1, 5, 300.0, 310.0, 100.0, 140.0, "far"),
    ],
    per="pages", ids="page", moved="x0 x1",
)


@query("grow_blocks", "SELECT CAST(1 + 1000 * page_id AS INTEGER) AS page, side, n, cells FROM pages, (VALUES (-1, 0, 'Method,C10,SVHN'), (-1, 1, 'ours,7.3,9.1'), (-1, 2, 'theirs,8.4')) AS v(side, n, cells)")
def grow_blocks(spark, sf_dir):
    """The rows beside a caption (SQL: those that the rule gives by hand): the second pass reaches a column that the caption does not."""
    cells = CELL_LINES.frame(spark, sf_dir)
    lines = cells.groupBy("page", "line").agg(F.first("y0").alias("y0"), F.first("y1").alias("y1"), F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("cells"))
    captions = L.table_captions(cells).select("page", "line", "x0", "x1", "y0", "y1", "caption")
    rows = L.grow_blocks(captions, lines, ["page"]).select("page", "side", F.posexplode("rows").alias("n", "cells"))
    return rows.select("page", "side", "n", F.array_join(F.transform("cells", lambda c: c["text"]), ",").alias("cells"))
