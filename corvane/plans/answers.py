"""Answer evaluation: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.operators import answers as A
from corvane.operators.enrich import answered_by_all
from corvane.plans.evaluation import rounded
from corvane.plans.text import STRIP
from corvane.session import Fixture, table

TEXTS = Fixture(
    "id long, answer string",
    [
        (1, "# Head\n- Errors fall by half [S1]. They rise later [S2][S9].\n|---|---|\n* **Bold claim here.** (See it there.) Ok."),
        (2, "1. One item only\n\n2) Another item. And More here!"),
        (3, "a b c"),
        (4, ""),
    ],
    per="documents", ids="id", texts="answer", pick=True, sep="\n",
)
_BULLET = "'^\\s*(?:[-*•]|\\d+[.)])\\s+'"
_SPLIT = "string_split(regexp_replace(x, '([.!?])\\s+([A-Z(\\[*])', '\\1' || chr(9246) || '\\2', 'g'), chr(9246))"
_SENTS = f"""list_filter(list_transform(flatten(list_transform(list_filter(list_transform(string_split(answer, chr(10)), lambda x: {STRIP(f"regexp_replace(x, {_BULLET}, '')")}), lambda x: x <> '' AND NOT regexp_matches(x, '^[|:\\-\\s]+$') AND NOT starts_with(x, '#')), lambda x: {_SPLIT})), lambda x: {STRIP("regexp_replace(" + STRIP('x') + ", '^\\*+|\\*+$', '', 'g')")}), lambda x: len(regexp_extract_all(x, '[A-Za-z]{{2,}}')) >= 2)[1:15]"""


@query("answer_sentences", f"WITH s AS (SELECT id, {_SENTS.replace('{{2,}}', '{2,}')} AS s FROM {TEXTS.sql}) SELECT id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS n, unnest(s) AS text FROM s")
def answer_sentences(spark, sf_dir):
    return TEXTS.frame(spark, sf_dir).select("id", F.posexplode(A.answer_sentences(F.col("answer"))).alias("n", "text"))


REPLIES = Fixture(
    "id long, reply string, n_sentences long",
    [(1, "SENTENCE 1: 1, 2\n**Sentence 2: none**\nRELEVANCE: 4\nCORRECT: partly", 3), (2, "noise\nSENTENCE 1: 2\nSENTENCE 1: 3\nrelevance: 9\nCorrect: n/a", 1), (3, "", 2), (4, "SENTENCE 2: 5 and 5\nCORRECT: No", 2)],
    per="documents", ids="id", texts="reply", pick=True, sep="\n",
)
_LINES = f"l AS (SELECT id, n_sentences, i, {STRIP('regexp_replace(' + STRIP('x') + ', ' + repr('^\\*+|\\*+$').replace('\\\\', '\\') + ', ' + repr('') + ', ' + repr('g') + ')')} AS x FROM (SELECT id, n_sentences, unnest(string_split(reply, chr(10))) AS x, generate_subscripts(string_split(reply, chr(10)), 1) AS i FROM {REPLIES.sql}))"
_MARKS = "m AS (SELECT id, arg_max(least(5, greatest(1, CAST(nullif(regexp_extract(x, '(?i)^RELEVANCE\\s*:\\s*(\\d)', 1), '') AS INTEGER))), i) FILTER (WHERE regexp_matches(x, '(?i)^RELEVANCE\\s*:\\s*(\\d)')) AS relevance, arg_max(CASE lower(regexp_extract(x, '(?i)^CORRECT\\s*:\\s*(yes|partly|partial|no|n/?a)', 1)) WHEN 'yes' THEN 1.0::DOUBLE WHEN 'partly' THEN 0.5 WHEN 'partial' THEN 0.5 WHEN 'no' THEN 0.0 END, i) FILTER (WHERE regexp_matches(x, '(?i)^CORRECT\\s*:\\s*(yes|partly|partial|no|n/?a)')) AS correct FROM l GROUP BY id)"
_SUPPORT = "u AS (SELECT id, sentence, arg_max(said, i) AS said FROM (SELECT id, i, CAST(nullif(regexp_extract(x, '(?i)^SENTENCE\\s+(\\d+)\\s*:\\s*(.*)$', 1), '') AS BIGINT) AS sentence, regexp_extract(x, '(?i)^SENTENCE\\s+(\\d+)\\s*:\\s*(.*)$', 2) AS said FROM l WHERE regexp_matches(x, '(?i)^SENTENCE\\s+(\\d+)\\s*:\\s*(.*)$')) GROUP BY ALL)"
_NUMBERS = "array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(said, '\\d+'), lambda x: CAST(x AS BIGINT)))), ',')"


@query("parse_judgement", f"WITH {_LINES}, {_MARKS}, {_SUPPORT}, n AS (SELECT id, unnest(range(1, n_sentences + 1)) AS sentence FROM {REPLIES.sql}) SELECT n.id, n.sentence, coalesce({_NUMBERS}, '') AS support, relevance, correct FROM n LEFT JOIN u USING (id, sentence) LEFT JOIN m ON m.id = n.id")
def parse_judgement(spark, sf_dir):
    """Every sentence with what the judge found for it; one that it passes over is unsupported."""
    replies = REPLIES.frame(spark, sf_dir)
    wanted = replies.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_sentences"))).alias("sentence"))
    joined = wanted.join(A.judge_support(replies, ["id"]), ["id", "sentence"], "left").join(A.judge_marks(replies, ["id"]), "id", "left")
    return joined.select("id", "sentence", F.coalesce(F.array_join(F.col("support").cast("array<string>"), ","), F.lit("")).alias("support"), "relevance", "correct")


VARIANTS = Fixture("qid string, raw string, original string", [("q1", "Rephrasings:\n1. What is ECE?\n- \"what is ece?\"\n(3) How calibrated is it\n\nWhat?", "What?"), ("q2", "", "x"), ("q3", "* a one\n* b two\n* c three\n* d four", "zz")], per="documents", ids="qid", texts="raw", pick=True, sep="\n")


@query(
    "parse_variants",
    f"""WITH l AS (SELECT qid, original, i, {STRIP("regexp_replace(" + STRIP("regexp_replace(x, '^\\s*(?:[-*•]|\\d+[.)]|\\(\\d+\\))\\s*', '')") + ", '^[\"'']+|[\"'']+$', '', 'g')")} AS text FROM (SELECT qid, original, unnest(string_split(raw, chr(10))) AS x, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM {VARIANTS.sql})),
o AS (SELECT qid, min(i) AS i, arg_min(text, i) AS text FROM l WHERE text <> '' AND NOT ends_with(text, ':') AND lower(text) <> lower({STRIP('original')}) GROUP BY qid, lower(text))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY i) AS n, text FROM o QUALIFY n <= 3""",
)
def parse_variants(spark, sf_dir):
    return A.rephrasings(VARIANTS.frame(spark, sf_dir), "qid", "raw", "original", 3)


SENTENCES = Fixture(
    "config string, qid string, text string, support array<long>",
    [("a", "q1", "One [S1].", [1]), ("a", "q1", "Two [S2][S9].", [1]), ("a", "q1", "Three.", []), ("a", "q2", "Four [S1].", None), ("b", "q1", "Five.", [2]), ("b", "q3", "Six [S0].", [1])],
    per="pages", ids="qid", texts="text",
)
SOURCES = Fixture("config string, qid string, n_sources long", [("a", "q1", 3), ("a", "q2", 1), ("b", "q1", 2), ("b", "q3", 2)], per="pages", ids="qid")
_AM = f"am AS (SELECT config, qid, count(*) AS n_sentences, avg((len(s) > 0)::INT) AS faithfulness, avg((len(c) > 0)::INT) AS citation_coverage, avg(list_has_any(c, s)::INT) FILTER (WHERE len(c) > 0) AS citation_accuracy, CAST(sum(len(list_filter(c, lambda x: x < 1 OR x > n_sources))) AS BIGINT) AS invalid_citations FROM (SELECT config, qid, n_sources, coalesce(support, []) AS s, list_distinct(list_transform(regexp_extract_all(text, '\\[S(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT))) AS c FROM {SENTENCES.sql} JOIN {SOURCES.sql} USING (config, qid)) GROUP BY config, qid)"
_AMS = ["faithfulness", "citation_coverage", "citation_accuracy"]


@query("answer_metrics", f"WITH {_AM} SELECT config, qid, n_sentences, invalid_citations, {', '.join(f'round({n}, 9) AS {n}' for n in _AMS)} FROM am")
def answer_metrics(spark, sf_dir):
    return rounded(A.answer_metrics(SENTENCES.frame(spark, sf_dir), SOURCES.frame(spark, sf_dir), ["config", "qid"]), _AMS)


_RECORDS = "r AS (SELECT 'c' || (event_id % 3) AS config, user_id AS qid, user_id % 4 <> 0 AS answerable, event_type = 'error' AS refused, CASE WHEN event_id % 5 > 0 THEN (event_id % 11) / 10 END AS faithfulness, CASE WHEN event_id % 7 > 0 THEN (event_id % 6) / 5 END AS citation_accuracy, (event_id % 9) / 8 AS citation_coverage, (event_id % 5) / 4 AS relevance, CASE WHEN event_id % 2 = 0 THEN (event_id % 3) / 2 END AS correct FROM events)"


def records(spark, sf_dir):
    """Events stand in for judged answers."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), (e % 3).cast("string")).alias("config"), F.col("user_id").alias("qid"), (F.col("user_id") % 4 != 0).alias("answerable"), (F.col("event_type") == "error").alias("refused"),
        F.when(e % 5 > 0, (e % 11) / 10).alias("faithfulness"), F.when(e % 7 > 0, (e % 6) / 5).alias("citation_accuracy"), ((e % 9) / 8).alias("citation_coverage"), ((e % 5) / 4).alias("relevance"), F.when(e % 2 == 0, (e % 3) / 2).alias("correct"),
    )


_GEN = ["faithfulness", "citation_accuracy", "citation_coverage", "relevance", "correct", "false_refusal_rate", "abstention_rate", "unanswerable_faithfulness"]
_GEN_SQL = "count(*) FILTER (WHERE answerable) AS n_answerable, count(*) FILTER (WHERE NOT answerable) AS n_unanswerable, " + ", ".join(f"round(avg({n}) FILTER (WHERE answerable AND NOT refused), 9) AS {n}" for n in _GEN[:5]) + ", round(avg(refused::INT) FILTER (WHERE answerable), 9) AS false_refusal_rate, round(avg(refused::INT) FILTER (WHERE NOT answerable), 9) AS abstention_rate, round(avg(faithfulness) FILTER (WHERE NOT answerable AND NOT refused), 9) AS unanswerable_faithfulness"


@query("gen_aggregate", f"WITH {_RECORDS} SELECT config, {_GEN_SQL} FROM r GROUP BY config")
def gen_aggregate(spark, sf_dir):
    return rounded(A.summary(records(spark, sf_dir), ["config"]), _GEN)


@query("gen_summary", f"WITH {_RECORDS}, ok AS (SELECT qid FROM r WHERE event_common GROUP BY qid HAVING count(DISTINCT config) = 3) SELECT config, {_GEN_SQL} FROM r WHERE qid IN (SELECT qid FROM ok) GROUP BY config".replace("WHERE event_common ", ""))
def gen_summary(spark, sf_dir):
    """Over the questions that every configuration has answered."""
    rows = records(spark, sf_dir)
    return rounded(A.summary(rows.join(answered_by_all(rows, "qid", "config"), "qid", "left_semi"), ["config"]), _GEN)
