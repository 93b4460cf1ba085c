"""Enrichment and bookkeeping joins: their queries and SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import text as T
from corvane.operators import enrich as E
from corvane.operators import overlay as O
from corvane.operators import ranking as R
from corvane.operators.elsewhere import nearest_elsewhere
from corvane.operators.index import build_index
from corvane.plans.retrieval import DOCS, STATS, sql_bm25
from corvane.plans.search import corpus
from corvane.plans.text import STRIP
from corvane.session import Fixture, table

CHUNKS = Fixture(
    "chunk_id string, paper string, page_start int, page_end int, text string",
    [("a__0", "a", 1, 2, "Table 1: errors are 7.3 and 8.1 here; see Figure 1 and Fig. 2"), ("a__1", "a", 2, 3, "values 7.3 8.1 9.9 of the methods"), ("b__0", "b", 1, 1, "Table 1: other; figure 1"), ("b__1", "b", 2, 2, "nothing")],
    per="pages", ids="chunk_id paper", texts="text",
)
NOTES = Fixture(
    "chunk_id string, of string, prompt_version string, note string, grid string, grid_ok boolean",
    [("a__0", CHUNKS.rows[0][4], "p1", "errors", "| a |", True), ("a__1", "old", "p1", "x", "y", True), ("b__0", CHUNKS.rows[2][4], "p0", "z", None, False), ("b__1", "nothing", "p1", "", "| b |", False)],
    per="pages", ids="chunk_id", texts="of",
)
SQL_HASH = "left(sha1(text), 12)"
#: A fixture with text_hash, the hash of its column ``of``.
HASHED = lambda fixture: f"(SELECT *, left(sha1(of), 12) AS text_hash FROM {fixture.sql})"


def hashed(fixture, spark, sf_dir):
    return fixture.frame(spark, sf_dir).withColumn("text_hash", T.text_hash(F.col("of"))).drop("of")


@query(
    "attach_notes",
    f"""WITH j AS (SELECT c.*, n.text_hash AS h, n.prompt_version AS p, note, grid, grid_ok, coalesce(n.text_hash = {SQL_HASH} AND n.prompt_version = 'p1', false) AS cur FROM {CHUNKS.sql} c LEFT JOIN {HASHED(NOTES)} n USING (chunk_id))
SELECT chunk_id, paper, page_start, page_end, text, CASE WHEN h IS NULL THEN NULL WHEN cur THEN 'described' ELSE 'stale' END AS state, CASE WHEN cur THEN nullif(note, '') END AS table_note, CASE WHEN cur AND grid_ok THEN nullif(grid, '') END AS table_markdown FROM j""",
)
def attach_notes(spark, sf_dir):
    return E.attach_notes(CHUNKS.frame(spark, sf_dir), hashed(NOTES, spark, sf_dir), "p1")


@query("note_is_current", f"SELECT chunk_id, n.text_hash = {SQL_HASH} AND prompt_version = 'p1' AS is_current FROM {HASHED(NOTES)} n JOIN {CHUNKS.sql} c USING (chunk_id)")
def note_is_current(spark, sf_dir):
    joined = hashed(NOTES, spark, sf_dir).join(CHUNKS.frame(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    return joined.select("chunk_id", ((F.col("text_hash") == T.text_hash(F.col("text"))) & (F.col("prompt_version") == "p1")).alias("is_current"))


TABLES = Fixture("paper string, table_no int, page int, caption string, markdown string", [("a", 1, 2, "Table 1: errors of all", "| m | e |\n|---|---|\n| x | 7.3 |\n| y | 8.1 |"), ("a", 2, 3, "Table 2: more", "| m | e |\n|---|---|\n| x | 1.0 |"), ("b", 1, 1, "Table 1: other", "| m |\n|---|\n| z |")], per="pages", ids="paper", texts="caption")


@query(
    "attach_tables",
    f"""WITH t AS (SELECT *, array_to_string(regexp_split_to_array(caption, '\\s+')[1:2], ' ') AS key, list_filter(list_transform(flatten(list_transform(string_split(markdown, chr(10))[3:], lambda x: string_split(regexp_replace(x, '^\\|+|\\|+$', '', 'g'), '|'))), lambda c: {STRIP('c')}), lambda c: regexp_matches(c, '^[±+\\-]?\\d')) AS vals FROM {TABLES.sql})
SELECT t.paper, table_no, chunk_id FROM t JOIN {CHUNKS.sql} c ON c.paper = t.paper AND t.page BETWEEN page_start AND page_end WHERE contains(text, key) OR coalesce(len(list_filter(vals, lambda v: contains(text, v))) / nullif(len(vals), 0), 0) >= 0.4""",
)
def attach_tables(spark, sf_dir):
    return E.attach_tables(CHUNKS.frame(spark, sf_dir), TABLES.frame(spark, sf_dir))


FIGURES = Fixture("n int, paper string, figure_no string, page int, caption string, description string, described_by string, image string", [(1, "a", "1", 1, "A plot", None, None, "a1.png"), (2, "a", "2", 2, "A curve", "It rises", "m", "a2.png"), (3, "b", "1", 1, "B plot", "", None, "b1.png"), (4, "b", "10", 1, "Far", "", None, "b10.png")], per="pages", ids="paper page", texts="caption")


@query(
    "attach_figures",
    f"""WITH f AS (SELECT *, concat('Figure ', figure_no, ': ', caption, CASE WHEN description <> '' THEN concat(' ', description) ELSE '' END) AS note FROM {FIGURES.sql})
SELECT chunk_id, string_agg(note, chr(10) ORDER BY n) AS figure_note, string_agg(image, ',' ORDER BY n) AS figure_images FROM f JOIN {CHUNKS.sql} c ON c.paper = f.paper AND regexp_matches(text, concat('(?i)\\b(?:Figure|Fig\\.?)\\s*', figure_no, '\\b')) GROUP BY chunk_id""",
)
def attach_figures(spark, sf_dir):
    return E.attach_figures(CHUNKS.frame(spark, sf_dir), FIGURES.frame(spark, sf_dir))


LABELS = Fixture("qid string, chunk_id string, of string", [("q1", "a__0", CHUNKS.rows[0][4]), ("q1", "a__1", "old"), ("q2", "gone", "0"), ("q3", "b__1", "nothing")], per="pages", ids="qid chunk_id", texts="of")


@query("validate_labels", f"SELECT qid, l.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'no longer exists' ELSE 'text changed' END AS problem FROM {HASHED(LABELS)} l LEFT JOIN {CHUNKS.sql} c ON c.chunk_id = l.chunk_id WHERE c.chunk_id IS NULL OR {SQL_HASH} <> l.text_hash")
def validate_labels(spark, sf_dir):
    return E.label_problems(hashed(LABELS, spark, sf_dir), CHUNKS.frame(spark, sf_dir))


@query("attach_evidence", "SELECT item_id AS qid, coalesce(CASE WHEN item_id % 3 = 0 AND regexp_matches(b.text, '\\S') THEN b.text END, CASE WHEN regexp_matches(d.text, '\\S') THEN d.text END) AS evidence FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id")
def attach_evidence(spark, sf_dir):
    """Evidence of the candidates fills what a query lacks (each third query has its own)."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 3 == 0, F.col("text")).alias("evidence"))
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("evidence"))
    return E.fill_from(queries, found, ["qid"], ["evidence"], lambda c: F.when(c.rlike(r"\S"), c))


RENDERED = Fixture("page int, figure_no string, image string, description string, described_by string", [(1, "1", "new1.png", None, None), (2, "2", "new2.png", None, None), (9, "9", "new9.png", "own", "x")], per="pages", ids="page")


@query("keep_descriptions", f"SELECT r.page, r.figure_no, r.image, coalesce(nullif(f.description, ''), r.description) AS description, coalesce(nullif(f.described_by, ''), r.described_by) AS described_by FROM {RENDERED.sql} r LEFT JOIN {FIGURES.sql} f ON f.page = r.page AND f.figure_no = r.figure_no AND f.paper LIKE '%~a'")
def keep_descriptions(spark, sf_dir):
    return E.fill_from(RENDERED.frame(spark, sf_dir), FIGURES.frame(spark, sf_dir).where("paper like '%~a'"), ["page", "figure_no"], ["description", "described_by"], prefer_other=True)


@query("todo_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def todo_antijoin(spark, sf_dir):
    return E.todo(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("cache_todo_antijoin", "SELECT c.config, item_id AS qid, concat_ws('|', c.config, item_id, 'gen', 'judge', 'v1') AS key FROM benchmark CROSS JOIN (VALUES ('dense'), ('bm25')) AS c(config) WHERE NOT (c.config = 'dense' AND item_id % 2 = 0)")
def cache_todo_antijoin(spark, sf_dir):
    """(config, query) pairs not yet in the cache, by their key (each second query of dense is done)."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    jobs = items.select(F.explode(F.array(F.lit("dense"), F.lit("bm25"))).alias("config"), "qid")
    key = F.concat_ws("|", "config", F.col("qid").cast("string"), F.lit("gen"), F.lit("judge"), F.lit("v1")).alias("key")
    done = items.where("qid % 2 = 0").select(F.lit("dense").alias("config"), "qid").select(key)
    return E.todo(jobs.select("config", "qid", key), done, ["key"]).select("config", "qid", "key")


@query("upsert_latest", "SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'new', source FROM documents WHERE doc_id % 3 = 0")
def upsert_latest(spark, sf_dir):
    """Held rows stay; fresh ones come in where their key is new (fresh: all, held: two of three)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return E.upsert(docs.where("doc_id % 3 <> 0"), docs.withColumn("lang", F.lit("new")), ["doc_id"])


@query(
    "cross_doc_nearest",
    f"WITH {DOCS}, items AS (SELECT chunk_id AS qid, paper AS own, w FROM docs), {STATS}, {sql_bm25()}, other AS (SELECT b.qid, b.chunk_id, b.score FROM bm25 b JOIN docs d USING (chunk_id) JOIN items i ON i.qid = b.qid WHERE d.paper <> i.own) SELECT qid, chunk_id, round(score, 6) AS score FROM other QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) = 1",
)
def cross_doc_nearest(spark, sf_dir):
    """The lexically nearest chunk of another paper, of every chunk by all its tokens."""
    chunks = corpus(spark, sf_dir).chunks
    met = nearest_elsewhere(build_index(chunks.select("chunk_id", T.token_text(F.col("text")).alias("tokens"), F.col("paper").alias("part"))))
    return R.ranked(met, ["qid"], 1).select("qid", "chunk_id", F.round("score", 6).alias("score"))


@query("neighbours", "SELECT doc_id, source, lag(doc_id) OVER w AS before, lead(doc_id) OVER w AS after FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def neighbours(spark, sf_dir):
    return E.neighbours(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", "doc_id")


@query("common_questions", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_questions(spark, sf_dir):
    """Units with a row in every group (users as questions, event types as configurations)."""
    return E.answered_by_all(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("except_ids", "SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings")
def except_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("limit_n", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 7")
def limit_n(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").orderBy("item_id").limit(7)


@query("ordered_distinct", "SELECT source, min(doc_id) AS first, row_number() OVER (ORDER BY min(doc_id)) AS n FROM documents GROUP BY source")
def ordered_distinct(spark, sf_dir):
    """Distinct values in the order in which they first come up."""
    first = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("first")).cast("long"))  # a row a distinct value


SETTINGS = Fixture("key string, fallback string, file string, given string", [("epochs", "30", None, None), ("lr", "0.1", "0.05", None), ("seed", "0", "1", "7"), ("out", None, None, "x")], per="pages", ids="key", texts="fallback")


@query("config_overlay", f"SELECT key, coalesce(given, file, fallback) AS value FROM {SETTINGS.sql}")
def config_overlay(spark, sf_dir):
    return SETTINGS.frame(spark, sf_dir).select("key", F.coalesce("given", "file", "fallback").alias("value"))


_LAYERS = """SELECT doc_id, json_object('source', source, 'stats', json_object('chars', n_chars, 'lang', lang), 'run', json_object('opt', json_object('lr', 1, 'by', 'sgd'), 'seed', 0)) AS low,
CASE doc_id % 4 WHEN 0 THEN json_object('stats', json_object('lang', 'other'), 'run', json_object('opt', json_object('lr', doc_id))) WHEN 1 THEN json_object('run', json_object('opt', 'none')) WHEN 2 THEN json_object('stats', json('{}'), 'source', json('{}')) ELSE json('{}') END AS mid,
CASE WHEN doc_id % 3 = 0 THEN json_object('run', json_object('opt', json_object('by', 'adam', 'beta', json_object('one', 9))), 'stats', doc_id) ELSE json_object('run', json_object('seed', doc_id % 5)) END AS high FROM documents"""


@query(
    "config_overlay_nested",
    f"""WITH l AS ({_LAYERS}), m AS (SELECT doc_id, json_merge_patch(json_merge_patch(low, mid), high) AS j FROM l)
SELECT doc_id, {', '.join(f"json_extract_string(j, '$.{p}') AS {c}" for c, p in (('lang', 'stats.lang'), ('chars', 'stats.chars'), ('lr', 'run.opt.lr'), ('by_', 'run.opt.by'), ('beta', 'run.opt.beta.one'), ('seed', 'run.seed')))}, replace(json_extract_string(j, '$.source'), ' ', '') AS source, CASE WHEN json_type(j, '$.stats') = 'UBIGINT' THEN json_extract_string(j, '$.stats') END AS stats, CASE WHEN json_type(j, '$.run.opt') = 'VARCHAR' THEN json_extract_string(j, '$.run.opt') END AS opt FROM m""",
)
def config_overlay_nested(spark, sf_dir):
    """Three layers of nested settings for each document, merged whatever their depth."""
    d, body = F.col("doc_id"), lambda **c: F.to_json(F.struct(*[v.alias(n) for n, v in c.items()]), {"ignoreNullFields": "false"})
    nest = lambda **c: F.struct(*[v.alias(n) for n, v in c.items()])
    low = body(source=F.col("source"), stats=nest(chars=F.col("n_chars"), lang=F.col("lang")), run=nest(opt=nest(lr=F.lit(1), by=F.lit("sgd")), seed=F.lit(0)))
    mid = F.when(d % 4 == 0, body(stats=nest(lang=F.lit("other")), run=nest(opt=nest(lr=d)))).when(d % 4 == 1, body(run=nest(opt=F.lit("none")))).when(d % 4 == 2, F.lit('{"stats": {}, "source": {}}')).otherwise(F.lit("{}"))
    high = F.when(d % 3 == 0, body(run=nest(opt=nest(by=F.lit("adam"), beta=nest(one=F.lit(9)))), stats=d)).otherwise(body(run=nest(seed=d % 5)))
    layers = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(low, mid, high)).alias("layer", "body"))
    merged = O.overlay(layers, "doc_id")
    at = lambda path: F.get_json_object("body", f"$.{path}")
    names = {"lang": "stats.lang", "chars": "stats.chars", "lr": "run.opt.lr", "by_": "run.opt.by", "beta": "run.opt.beta.one", "seed": "run.seed", "source": "source"}
    whole = F.when(~F.startswith(at("stats"), F.lit("{")), at("stats")).alias("stats"), F.when(~F.startswith(at("run.opt"), F.lit("{")), at("run.opt")).alias("opt")
    return merged.select("doc_id", *[at(p).alias(c) for c, p in names.items()], *whole)


CANDIDATES = Fixture("qid string, category string, status string, edited boolean, chunk_id string, of string", [("q1", "semantic", "kept", False, "a__0", CHUNKS.rows[0][4]), ("q2", "semantic", "dropped", False, "a__1", "0"), ("q3", "exact_term", "kept", True, "b__1", "nothing"), ("q4", "unanswerable", "pending", False, None, None), ("q5", "unanswerable", "kept", False, None, None)], per="pages", ids="qid chunk_id", texts="of")


@query("export_kept", f"SELECT qid, category, k.chunk_id, coalesce(k.chunk_id IS NULL OR k.text_hash = {SQL_HASH}, false) AS valid FROM {HASHED(CANDIDATES)} k LEFT JOIN {CHUNKS.sql} c ON c.chunk_id = k.chunk_id WHERE status = 'kept'")
def export_kept(spark, sf_dir):
    kept = hashed(CANDIDATES, spark, sf_dir).where("status = 'kept'")
    now = CHUNKS.frame(spark, sf_dir).select("chunk_id", T.text_hash(F.col("text")).alias("_now"))
    return kept.join(now, "chunk_id", "left").select("qid", "category", "chunk_id", F.coalesce(F.col("chunk_id").isNull() | (F.col("text_hash") == F.col("_now")), F.lit(False)).alias("valid"))


@query("review_stats", f"SELECT category, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'kept') AS kept, count(*) FILTER (WHERE status = 'dropped') AS dropped FROM {CANDIDATES.sql} GROUP BY category")
def review_stats(spark, sf_dir):
    return CANDIDATES.frame(spark, sf_dir).groupBy("category").pivot("status", ["pending", "kept", "dropped"]).count().na.fill(0)


@query("candidate_counts", f"SELECT category, count(*) AS n, count(*) FILTER (WHERE chunk_id IS NULL) AS unanswerable FROM {CANDIDATES.sql} GROUP BY category")
def candidate_counts(spark, sf_dir):
    return CANDIDATES.frame(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("chunk_id").isNull()).alias("unanswerable"))


TABLE_NOTES = Fixture("chunk_id string, ok boolean, description string, reason string", [("a", True, "d", ""), ("a", False, "e", "x"), ("b", False, "d", "model gave no grid"), ("c", False, "", "reply did not follow the format"), ("d", False, "", "other")], per="pages", ids="chunk_id", texts="reason")


@query("notes_summary", f"SELECT outcome, count(*) AS n FROM (SELECT chunk_id, CASE WHEN bool_or(ok) THEN 'with_grid' WHEN bool_or(description <> '') THEN 'description_only' WHEN bool_or(starts_with(reason, 'reply did not follow')) THEN 'unparseable' ELSE 'no_table_found' END AS outcome FROM {TABLE_NOTES.sql} GROUP BY chunk_id) GROUP BY outcome")
def notes_summary(spark, sf_dir):
    per = TABLE_NOTES.frame(spark, sf_dir).groupBy("chunk_id").agg(F.when(F.bool_or("ok"), "with_grid").when(F.bool_or(F.col("description") != ""), "description_only").when(F.bool_or(F.col("reason").startswith("reply did not follow")), "unparseable").otherwise("no_table_found").alias("outcome"))
    return per.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("papers", "SELECT source AS paper, count(*) AS chunks, arg_min(left(text, 30), doc_id) AS title FROM documents GROUP BY source")
def papers(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("paper")).agg(F.count(F.lit(1)).alias("chunks"), F.min_by(F.substring("text", 1, 30), "doc_id").alias("title"))


@query("status", "SELECT count(*) AS chunks, count(DISTINCT source) AS papers, count(*) FILTER (WHERE doc_id % 7 = 0) AS reference_chunks FROM documents")
def status(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("papers"), F.count_if(F.col("doc_id") % 7 == 0).alias("reference_chunks"))


