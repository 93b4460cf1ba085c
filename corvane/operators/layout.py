"""From words on a page to tables and figures: cells, captions, blocks beside a caption, columns, areas.

Pages are small; what goes by keys is a page (or a caption) and runs in one array or window each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: patterns of captions, and lengths in points
TABLE_CAPTION = r"^\s*(?:TABLE|Table)\s+(\d+|[IVX]+)\s*[:.]\s"
FIGURE_CAPTION = r"(?i)^\s*(?:Figure|Fig\.)\s+(\d+[a-z]?)\s*[:.]\s"
LEAST_GAP, WORD_SPACE, WIDEST_SPACE = 6.0, 3.0, 8.0
#: fixed value: the share of a page from which on a box is its background
PAGE_SIZED = 0.9
BAND_JUMP, FIGURE_HEIGHT, LEAST_FIGURE, AIR = 160.0, 420.0, 40.0, 4.0
LEAST_HEIGHT, CAPTION_GAP, ROW_GAP, CONTINUED_GAP = 6.0, 5.0, 3.0, 1.6


def cell_thresholds(found: DataFrame, page: list[str], line: str = "line", spaces: float = 2.5) -> DataFrame:
    """page, threshold: the gap that parts cells, from the median word space of a page.

    Only gaps up to WIDEST_SPACE count as word spaces, so that column gaps do not raise it.
    """
    gap = F.col("x0") - F.lag("x1").over(Window.partitionBy(*page, line).orderBy("x0", "x1"))
    small = found.select(*page, gap.alias("_gap")).groupBy(*page).agg(F.percentile(F.when((F.col("_gap") > 0) & (F.col("_gap") <= WIDEST_SPACE), F.col("_gap")), F.lit(0.5)).alias("_space"))
    return small.select(*page, F.greatest(F.lit(LEAST_GAP), spaces * F.coalesce("_space", F.lit(WORD_SPACE))).alias("threshold"))


def split_cells(found: DataFrame, page: list[str], line: str = "line") -> DataFrame:
    """page, line, cell, x0, x1, text: a line's words (x0, x1, text) parted wherever the gap reaches the page's threshold."""
    order = Window.partitionBy(*page, line).orderBy("x0", "x1")
    gap = F.col("x0") - F.lag("x1").over(order)
    marked = found.join(cell_thresholds(found, page, line), page).withColumn("_new", F.coalesce((gap >= F.col("threshold")).cast("int"), F.lit(0)))
    celled = marked.withColumn("cell", F.sum("_new").over(order).cast("long"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " ")
    return celled.groupBy(*page, line, "cell").agg(F.min("x0").alias("x0"), F.max_by("x1", "x0").alias("x1"), words.alias("text"))


def table_captions(cells: DataFrame) -> DataFrame:
    """The cells that begin a table's caption, with its text in one spacing (200 characters at most)."""
    return cells.where(F.col("text").rlike(TABLE_CAPTION)).withColumn("caption", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 200))


def figure_captions(lines: DataFrame, page: list[str], line: str = "line") -> DataFrame:
    """page, line, y0, y1, figure_no, caption: lines that begin a figure's caption, each with up to two that go on.

    ``lines`` has y0, y1, text. A line goes on while it is not blank, begins no caption, and is not far below the first.
    """
    order = Window.partitionBy(*page).orderBy(line)
    begins = F.col("text").rlike(FIGURE_CAPTION)
    reach = CONTINUED_GAP * F.greatest(F.lit(LEAST_HEIGHT), F.col("y1") - F.col("y0"))
    text, goes_on = F.col("text"), F.lit(True)
    for n in (1, 2):
        after, top = F.lead("text", n).over(order), F.lead("y0", n).over(order)
        goes_on = goes_on & F.coalesce(F.trim(after) != "", F.lit(False)) & ~F.coalesce(after.rlike(FIGURE_CAPTION), F.lit(False)) & (top - F.col("y1") <= reach)
        text = F.when(goes_on, F.concat(text, F.lit(" "), after)).otherwise(text)
    told = lines.select(*page, line, "y0", "y1", begins.alias("_begins"), F.regexp_extract("text", FIGURE_CAPTION, 1).alias("figure_no"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("caption"))
    return told.where("_begins").drop("_begins")


def figure_areas(captions: DataFrame, boxes: DataFrame, page: list[str], keys: list[str]) -> DataFrame:
    """keys, x0, y0, x1, y1: the area of each caption's figure.

    The least rectangle around the boxes (bx0, by0, bx1, by1) of the page that end above the caption and not too
    far up, else of those that begin below it; empty boxes and those of more than PAGE_SIZED of the page do not count; areas of less than LEAST_FIGURE either way are none. ``captions`` has
    y0, y1 and the page's width and height, at which areas end.
    """
    area = (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))
    # boxes as large as the page are its background
    met = captions.join(boxes.where("bx1 > bx0 and by1 > by0"), page).where(area <= PAGE_SIZED * F.col("width") * F.col("height"))
    above = (F.col("by1") <= F.col("y0") + 2) & (F.col("by1") > F.col("y0") - FIGURE_HEIGHT)
    below = (F.col("by0") >= F.col("y1") - 2) & (F.col("by0") < F.col("y1") + FIGURE_HEIGHT)
    sided = met.withColumn("_side", F.explode(F.filter(F.array(F.when(above, 0), F.when(below, 1)), lambda s: s.isNotNull())))
    around = sided.groupBy(*keys, "_side").agg(
        F.greatest(F.min("bx0"), F.lit(0.0)).alias("x0"), F.greatest(F.min("by0"), F.lit(0.0)).alias("y0"),
        F.least(F.max("bx1"), F.first("width")).alias("x1"), F.least(F.max("by1"), F.first("height")).alias("y1"),
    )
    large = around.where((F.col("x1") - F.col("x0") >= LEAST_FIGURE) & (F.col("y1") - F.col("y0") >= LEAST_FIGURE))
    best = large.groupBy(*keys).agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "_side").alias("r"))
    return best.select(*keys, (F.col("r.x0") - AIR).alias("x0"), (F.col("r.y0") - AIR).alias("y0"), (F.col("r.x1") + AIR).alias("x1"), (F.col("r.y1") + AIR).alias("y1"))


def _grown(lines: Column, top: Column, low: Column, high: Column) -> Column:
    """The rows that a fold over ``lines`` (y0, y1, cells), away from a caption at height ``top``, takes."""
    row = "array<array<struct<x0:double,x1:double,text:string>>>"
    zero = F.struct(low.alias("low"), high.alias("high"), top.alias("at"), F.lit(True).alias("open"), F.array().cast(row).alias("rows"))

    def step(acc: Column, line: Column) -> Column:
        near = F.filter(line["cells"], lambda c: (c["x1"] >= acc["low"] - BAND_JUMP) & (c["x0"] <= acc["high"] + BAND_JUMP))
        middle = (line["y0"] + line["y1"]) / 2
        limit = F.when(F.size(acc["rows"]) == 0, F.lit(CAPTION_GAP)).otherwise(F.lit(ROW_GAP)) * F.greatest(F.lit(LEAST_HEIGHT), line["y1"] - line["y0"])
        taken = acc["open"] & (F.size(near) >= 2) & (F.abs(middle - acc["at"]) <= limit)
        return F.struct(
            F.when(taken, F.least(acc["low"], F.array_min(F.transform(near, lambda c: c["x0"])))).otherwise(acc["low"]).alias("low"),
            F.when(taken, F.greatest(acc["high"], F.array_max(F.transform(near, lambda c: c["x1"])))).otherwise(acc["high"]).alias("high"),
            middle.alias("at"),
            taken.alias("open"),
            F.when(taken, F.concat(acc["rows"], F.array(near))).otherwise(acc["rows"]).alias("rows"),
        )

    return F.aggregate(lines, zero, step)


def grow_blocks(captions: DataFrame, lines: DataFrame, page: list[str], line: str = "line") -> DataFrame:
    """captions' columns, side (-1 above, 1 below), rows: the table rows next to each caption, from the top down.

    Rows are taken away from the caption while they have two cells at least within the table's band and are not set
    off too far. The band begins as the caption's span and widens with each row; a second pass starts from what
    the first has found. ``captions``: page, line, x0, x1, y0, y1; ``lines``: page, line, y0, y1, cells (x0, x1, text).
    """
    held = lines.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col(line).alias("line"), "y0", "y1", "cells"))).alias("_lines"))
    met = captions.join(held, page).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    away = F.when(F.col("side") > 0, F.filter("_lines", lambda x: x["line"] > F.col(line))).otherwise(F.reverse(F.filter("_lines", lambda x: x["line"] < F.col(line))))
    top = (F.col("y0") + F.col("y1")) / 2
    met = met.withColumn("_away", away).withColumn("_first", _grown(F.col("_away"), top, F.col("x0"), F.col("x1")))
    grown = met.withColumn("_rows", _grown(F.col("_away"), top, F.col("_first.low"), F.col("_first.high"))["rows"])
    rows = F.when(F.col("side") > 0, F.col("_rows")).otherwise(F.reverse("_rows"))
    return grown.withColumn("rows", rows).drop("_lines", "_away", "_first", "_rows").where(F.size("rows") > 0)


def grid(rows: Column) -> Column:
    """Rows of cells (x0, x1, text) laid out in columns, as texts.

    The first of the rows with most cells gives the columns. In reading order, a cell widens the column that it
    overlaps most (the last of equals) and stands there; one that overlaps none begins a column.
    """
    width = F.array_max(F.transform(rows, F.size))
    template = F.get(F.filter(rows, lambda r: F.size(r) == width), F.lit(0))
    spans = F.transform(template, lambda c: F.struct(c["x0"].cast("double").alias("x0"), c["x1"].cast("double").alias("x1")))
    cells = F.flatten(F.transform(rows, lambda r, i: F.transform(r, lambda c: F.struct(i.alias("row"), c["x0"].cast("double").alias("x0"), c["x1"].cast("double").alias("x1"), c["text"].alias("text")))))
    placed = "array<struct<row:int,column:int,text:string>>"

    def step(acc: Column, c: Column) -> Column:
        shared = F.transform(acc["columns"], lambda s, j: F.struct((F.least(s["x1"], c["x1"]) - F.greatest(s["x0"], c["x0"])).alias("width"), j.alias("j")))
        best = F.array_max(shared)
        known = best["width"] > 0
        at = F.when(known, best["j"]).otherwise(F.size(acc["columns"]))
        widened = F.transform(acc["columns"], lambda s, j: F.when(j == best["j"], F.struct(F.least(s["x0"], c["x0"]).alias("x0"), F.greatest(s["x1"], c["x1"]).alias("x1"))).otherwise(s))
        own = F.concat(acc["columns"], F.array(F.struct(c["x0"].alias("x0"), c["x1"].alias("x1"))))
        here = F.struct(c["row"].alias("row"), at.alias("column"), c["text"].alias("text"))
        return F.struct(F.when(known, widened).otherwise(own).alias("columns"), F.concat(acc["placed"], F.array(here)).alias("placed"))

    def laid(done: Column) -> Column:
        order = F.array_sort(F.transform(done["columns"], lambda s, j: F.struct(s["x0"].alias("x0"), j.alias("j"))))
        texts = lambda i, j: F.filter(done["placed"], lambda p: (p["row"] == i) & (p["column"] == j))
        return F.transform(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.transform(order, lambda o: F.array_join(F.transform(texts(i, o["j"]), lambda p: p["text"]), " ")))

    folded = F.aggregate(cells, F.struct(spans.alias("columns"), F.array().cast(placed).alias("placed")), step)
    return F.element_at(F.transform(F.array(folded), laid), 1)


def to_grid(found: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """keys, grid: the cells (line, x0, x1, text) of a table's lines laid out in columns, see ``grid``."""
    lines = found.groupBy(*keys, line).agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("_cells"))
    tables = lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(line, "_cells"))), lambda r: r["_cells"]).alias("_rows"))
    return tables.select(*keys, grid(F.col("_rows")).alias("grid"))
