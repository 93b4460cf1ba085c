"""Answer evaluation: sentences, judge replies, rephrasings, per-answer and per-configuration scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import cited_sources, strip

# fixed values in this module: the marks of bullets, rules and headings, and the lines of a judge's reply
MOST_SENTENCES = 15


def answer_sentences(answer: Column, most: int = MOST_SENTENCES) -> Column:
    """The checkable sentences of an answer: no bullets, rules, headings or fragments."""
    lines = F.transform(F.split(answer, "\n"), lambda x: strip(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s+", "")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[|:\-\s]+$") & ~x.startswith("#"))
    split = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z(\[*])")))
    bare = F.transform(split, lambda x: strip(F.regexp_replace(strip(x), r"^\*+|\*+$", "")))
    return F.slice(F.filter(bare, lambda x: F.regexp_count(x, F.lit("[A-Za-z]{2,}")) >= 2), 1, most)


def reply_lines(replies: DataFrame, keys: list[str], text: str) -> DataFrame:
    lines = replies.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "_x"))
    return lines.withColumn("_x", strip(F.regexp_replace(strip(F.col("_x")), r"^\*+|\*+$", "")))


def judge_support(replies: DataFrame, keys: list[str], text: str = "reply") -> DataFrame:
    """keys, sentence, support (numbers) of every sentence the judge speaks of; its last word counts."""
    lines = reply_lines(replies, keys, text)
    pattern = r"(?i)^SENTENCE\s+(\d+)\s*:\s*(.*)$"
    found = lines.where(F.col("_x").rlike(pattern)).select(*keys, "line", F.regexp_extract("_x", pattern, 1).cast("long").alias("sentence"), F.regexp_extract("_x", pattern, 2).alias("_said"))
    last = found.groupBy(*keys, "sentence").agg(F.max_by("_said", "line").alias("_said"))
    numbers = F.transform(F.regexp_extract_all("_said", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    return last.select(*keys, "sentence", F.array_sort(F.array_distinct(numbers)).alias("support"))


def judge_marks(replies: DataFrame, keys: list[str], text: str = "reply") -> DataFrame:
    """keys, relevance (1-5), correct (1, 0.5, 0) of each reply; null where it says nothing of it."""
    lines = reply_lines(replies, keys, text)
    relevance, correct = r"(?i)^RELEVANCE\s*:\s*(\d)", r"(?i)^CORRECT\s*:\s*(yes|partly|partial|no|n/?a)"
    word = F.lower(F.regexp_extract("_x", correct, 1))
    value = F.when(word == "yes", 1.0).when(word.isin("partly", "partial"), 0.5).when(word == "no", 0.0)
    mark = F.greatest(F.lit(1), F.least(F.lit(5), F.regexp_extract("_x", relevance, 1).cast("int")))
    return lines.groupBy(*keys).agg(
        F.max_by(F.when(F.col("_x").rlike(relevance), mark), F.when(F.col("_x").rlike(relevance), F.col("line"))).alias("relevance"),
        F.max_by(F.when(F.col("_x").rlike(correct), value), F.when(F.col("_x").rlike(correct), F.col("line"))).alias("correct"),
    )


def rephrasings(replies: DataFrame, key: str, raw: str, original: str, most: int) -> DataFrame:
    """key, n, text: at most ``most`` distinct rephrasings of a model's reply, without bullets and quotes."""
    lines = replies.select(key, original, F.posexplode(F.split(raw, "\n")).alias("line", "_x"))
    bare = strip(F.regexp_replace(strip(F.regexp_replace("_x", r"^\s*(?:[-*•]|\d+[.)]|\(\d+\))\s*", "")), "^[\"']+|[\"']+$", ""))
    usable = lines.withColumn("text", bare).where((F.col("text") != "") & ~F.col("text").endswith(":") & (F.lower("text") != F.lower(strip(F.col(original)))))
    once = usable.groupBy(key, F.lower("text").alias("_l")).agg(F.min("line").alias("line"), F.min_by("text", "line").alias("text"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return once.withColumn("n", n).where(F.col("n") <= most).select(key, F.col("n").cast("long").alias("n"), "text")


def answer_metrics(sentences: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Per answer: n_sentences, faithfulness, citation_coverage, citation_accuracy, invalid_citations.

    ``sentences``: keys, text, support (array; null counts as unsupported); ``sources``: keys, n_sources.
    """
    cited = sentences.withColumn("_c", cited_sources(F.col("text"))).withColumn("_s", F.coalesce("support", F.array().cast("array<bigint>"))).join(sources, keys)
    has = F.size("_c") > 0
    wrong = F.size(F.filter("_c", lambda c: (c < 1) | (c > F.col("n_sources"))))
    return cited.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.avg((F.size("_s") > 0).cast("double")).alias("faithfulness"),
        F.avg(has.cast("double")).alias("citation_coverage"),
        F.avg(F.when(has, F.arrays_overlap("_c", "_s").cast("double"))).alias("citation_accuracy"),
        F.sum(wrong).cast("long").alias("invalid_citations"),
    )


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Scores by configuration; answerable, answered and unanswerable questions are pooled apart.

    ``rows``: by, answerable, refused and the metrics of an answer.
    """
    ans, ref = F.col("answerable"), F.col("refused")
    mean = lambda c, where: F.avg(F.when(where, F.col(c)))
    share = lambda where: F.avg(F.when(where, ref.cast("double")))
    return rows.groupBy(*by).agg(
        F.count_if(ans).alias("n_answerable"), F.count_if(~ans).alias("n_unanswerable"),
        *[mean(c, ans & ~ref).alias(c) for c in ("faithfulness", "citation_accuracy", "citation_coverage", "relevance", "correct")],
        share(ans).alias("false_refusal_rate"), share(~ans).alias("abstention_rate"), mean("faithfulness", ~ans & ~ref).alias("unanswerable_faithfulness"),
    )
