"""Text predicates and transformations: their queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import text as T
from corvane.operators.enrich import closest_model
from corvane.session import Fixture, table

STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
QUOTE = lambda x: "'" + x.replace("'", "''") + "'"

#: What NFKC makes of the characters in the cases; the tables have no others that it changes (tests/test_composed.py).
COMPOSED = lambda x: f"replace(replace(replace(translate({x}, '\uff23\uff29\uff26\uff21\uff32\uff0d\uff11\uff10\uff12', 'CIFAR-102'), chr(64257), 'fi'), chr(178), '2'), chr(160), ' ')"

PAGES = Fixture(
    "doc_id string, page_no int, raw string",
    [
        ("a", 1, "12\n Deep  ensembles\nare neural-\nnetwork models.\n34"),
        ("a", 2, "Preprint.\nTable 3\n76\n84\nThe end\n7"),
        ("a", 3, "  \n\n"),
        ("a", 4, "arXiv:1612.01474v3 [stat.ML]\nUnder review as a paper\nOne  two\tthree"),
        ("b", 1, "Fig. 3 shows it. The next one. And more? Yes!"),
        ("b", 2, "\uff11\uff12\nThe \ufb01rst \uff23\uff29\uff26\uff21\uff32 x\u00b2\u00a0of it"),
    ],
    per="documents", ids="doc_id", texts="raw", pick=True, sep="\n",
)
CITED = Fixture(
    "id long, text string",
    [
        (1, "C. M., Bishop. Pattern recognition. Springer, 2006. [1] [Bishop 2006] et al. pp. 100-109, 33(8):831"),
        (2, "In Proceedings of the Conference on vision, 12-19, 2015. Jane Roe, John Doe, and Max Moe. ICML. Nature"),
        (3, "A plain sentence about models that cites nobody at all and goes on for a while"),
        (4, ""),
        (5, "A result of 2019, and Smith J. Brown. is cited [12] twice [13] in this prose of some length which says other things too"),
    ],
)
CELLS = Fixture(
    "id long, text string, ref boolean",
    [
        (1, "8.0 ±0.4 76 84 NA N/A - 7.3 ± 0.2", False),
        (2, "Method C10 error is 7.3 in this table of results, and nothing else is said here", False),
        (3, "we show in the table below all our results for the two data sets that we use here and there 76 84 92 83 76 84 92 83 75 76 84 92 83 76 84 92 83 75 1 2 3 4 5", False),
        (4, "76 84 92 83 76 84 92 83 75 76 84 92 83 76 84 92 83 75 1 2 3 4 5", True),
        (5, "", False),
    ],
)


#: (id, text) of a fixture and of all documents, as with_documents() has them.
ALL = lambda fixture: f"(SELECT id, text FROM {fixture.sql} UNION ALL SELECT -1 - doc_id, text FROM documents)"


def with_documents(fixture, spark, sf_dir):
    """id and text of the fixture and of all documents, whose ids are negative."""
    docs = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), "text")
    return fixture.frame(spark, sf_dir).select("id", "text").unionByName(docs)


@query(
    "clean_page_text",
    f"""
WITH l AS (SELECT doc_id, page_no, list_filter(list_transform(string_split(raw, chr(10)), lambda x: {STRIP("x")}), lambda x: x <> '') AS lines FROM (SELECT doc_id, page_no, {COMPOSED("raw")} AS raw FROM {PAGES.sql})),
k AS (SELECT doc_id, page_no, list_filter(lines, lambda x, i: NOT ((i = 1 OR i = len(lines)) AND regexp_matches(x, '^\\d{{1,4}}$'))
   AND NOT regexp_matches(x, '(?i)^arXiv:\\d+\\.\\d+') AND NOT regexp_matches(x, '(?i)^Preprint\\.?\\s*$') AND NOT regexp_matches(x, '(?i)^Under review')) AS kept FROM l)
SELECT doc_id, page_no, {STRIP("regexp_replace(regexp_replace(coalesce(array_to_string(kept, chr(10)), ''), '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '\\s+', ' ', 'g')")} AS text FROM k""",
)
def clean_page_text(spark, sf_dir):
    return PAGES.frame(spark, sf_dir).select("doc_id", "page_no", T.clean_page(F.col("raw")).alias("text"))


_DENSITY = "(" + " + ".join(f"len(regexp_extract_all(text, {QUOTE(p)})) * {w}" for p, w in T.CITATION_MARKERS) + f") / greatest(1, len({WORDS('text')}))"


@query("citation_density", f"SELECT id, round({_DENSITY}, 9) AS density FROM {ALL(CITED)}")
def citation_density(spark, sf_dir):
    return with_documents(CITED, spark, sf_dir).select("id", F.round(T.citation_density(F.col("text")), 9).alias("density"))


@query("is_reference", f"SELECT doc_id, {_DENSITY} >= 0.25 AS is_reference FROM documents UNION ALL SELECT -id, {_DENSITY} >= 0.25 FROM {CITED.sql}")
def is_reference(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(CITED.frame(spark, sf_dir).select((-F.col("id")).alias("doc_id"), "text"))
    return rows.select("doc_id", T.is_reference(F.col("text")).alias("is_reference"))


def _table_like(tokens: str) -> str:
    return f"coalesce(len(list_filter({tokens}, lambda t: regexp_matches(t, {QUOTE(T.TABLE_TOKEN)}))) / nullif(len({tokens}), 0) >= 0.5, false)"


_HAS_TABLE = f"CASE WHEN len(w) < 20 THEN {_table_like('w')} ELSE len(list_filter(range(0, greatest(len(w) - 20, 0) + 1, 5), lambda i: {_table_like('w[i + 1:i + 20]')})) > 0 END"


@query("table_like", f"WITH t AS (SELECT id, {WORDS('text')} AS w FROM {ALL(CELLS)}) SELECT id, {_table_like('w')} AS table_like FROM t")
def table_like(spark, sf_dir):
    return with_documents(CELLS, spark, sf_dir).select("id", T.table_like(T.words(F.col("text"))).alias("table_like"))


@query("has_table", f"WITH t AS (SELECT id, {WORDS('text')} AS w FROM {CELLS.sql} UNION ALL SELECT -1 - doc_id, {WORDS('text')} FROM documents) SELECT id, {_HAS_TABLE} AS has_table FROM t")
def has_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), "text")
    return CELLS.frame(spark, sf_dir).select("id", "text").unionByName(docs).select("id", T.has_table(F.col("text")).alias("has_table"))


@query("table_chunks", f"WITH t AS (SELECT id, ref, {WORDS('text')} AS w FROM (SELECT * FROM {CELLS.sql} UNION ALL SELECT -1 - doc_id, text, doc_id % 7 = 0 FROM documents)) SELECT id FROM t WHERE NOT ref AND {_HAS_TABLE}")
def table_chunks(spark, sf_dir):
    """The chunks with a table that are no references (documents: each seventh is one, as in corpus())."""
    docs = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), "text", (F.col("doc_id") % 7 == 0).alias("ref"))
    return CELLS.frame(spark, sf_dir).unionByName(docs).where(~F.col("ref") & T.has_table(F.col("text"))).select("id")


@query("is_prose", f"WITH t AS (SELECT doc_id, {WORDS('text')} AS w FROM documents) SELECT doc_id, len(w) >= 80 AND coalesce(len(list_filter(w, lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z\\-]{{2,}}$'))) / nullif(len(w), 0), 0) > 0.55 AS is_prose FROM t")
def is_prose(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_prose(F.col("text")).alias("is_prose"))


QUESTIONS = Fixture("id long, text string", [(1, "What error does This Paper report on C10?"), (2, "How are ensembles trained for uncertainty?"), (3, "Why so?"), (4, "Which of the above methods is best here?"), (5, "Does temperature scaling change the accuracy of a model")], per="documents", ids="id", texts="text", pick=True)
_LEANS = " OR ".join(f"contains(lower(text), {QUOTE(p)})" for p in T.LEANING_PHRASES)


@query("looks_standalone", f"SELECT id, len({WORDS('text')}) >= 5 AND NOT ({_LEANS}) AS standalone FROM {QUESTIONS.sql}")
def looks_standalone(spark, sf_dir):
    return QUESTIONS.frame(spark, sf_dir).select("id", T.looks_standalone(F.col("text")).alias("standalone"))


NAMES = Fixture("id long, text string", [(5, "\ufb01ne \uff23\uff29\uff26\uff21\uff32\uff0d\uff11\uff10 x\u00b2"), (1, "CIFAR-10 and C10, C100; EnDD vs. ResNet-18 at FPR-95"), (2, "no-name 12-13 a-1b"), (3, ""), (4, "VGG-16-bn")])
TOKENS = lambda x: f"list_transform(regexp_extract_all(regexp_replace(lower({x}), '\\b([a-z]+)-(\\d+)\\b', '\\1\\2', 'g'), '[a-z0-9]+'), lambda t: CASE t WHEN 'c10' THEN 'cifar10' WHEN 'c100' THEN 'cifar100' WHEN 'endd' THEN 'end2' ELSE t END)"


@query("bm25_tokens", f"SELECT id, array_to_string({TOKENS(COMPOSED('text'))}, ' ') AS tokens FROM {ALL(NAMES)}")
def bm25_tokens(spark, sf_dir):
    return with_documents(NAMES, spark, sf_dir).select("id", F.array_join(T.search_tokens(F.col("text")), " ").alias("tokens"))


@query("plain_tokens", "SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM benchmark")
def plain_tokens(spark, sf_dir):
    tokens = T.plain_tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("long").alias("n"))


CHUNKS = Fixture(
    "chunk_id string, arxiv_id string, title string, year string, page_start int, page_end int, text string, table_note string, figure_note string, table_markdown string, table_grid_source string, figure_images string",
    [
        ("1612.01474__0000", "1612.01474", "Deep Ensembles", "2017", 1, 2, "Ensembles are  simple.", "", None, "", None, "figures/a.png,figures/b.png"),
        ("1612.01474__0001", "1612.01474", "Deep Ensembles", "2017", 3, 3, "Results are in Table 1.", "A table of errors", "Figure 1: A plot", "| a | b |", "geometry", ""),
        ("upload:x__0000", "upload:x", "", "", 1, 1, "An uploaded\ntext", None, "", None, "", None),
    ],
    per="documents", ids="chunk_id", texts="text", pick=True,
)


@query("index_text", f"SELECT chunk_id, concat_ws(chr(10), nullif(title, ''), nullif(table_note, ''), nullif(figure_note, ''), text) AS indexed, concat_ws(chr(10), nullif(table_note, ''), nullif(figure_note, ''), text) AS plain FROM {CHUNKS.sql}")
def index_text(spark, sf_dir):
    part = [F.col(c) for c in ("title", "table_note", "figure_note", "text")]
    return CHUNKS.frame(spark, sf_dir).select("chunk_id", T.index_text(*part).alias("indexed"), T.index_text(*part, contextual=False).alias("plain"))


_OPTIONAL = ("table_note", "figure_note", "table_markdown", "table_grid_source", "figure_images")


@query("meta_row", f"SELECT chunk_id, arxiv_id, title, year, page_start, page_end, text, {', '.join(f'''nullif({c}, '') AS {c}''' for c in _OPTIONAL)} FROM {CHUNKS.sql}")
def meta_row(spark, sf_dir):
    return CHUNKS.frame(spark, sf_dir).withColumns({c: T.present(F.col(c)) for c in _OPTIONAL})


_LABEL = "CASE WHEN page_start = page_end THEN concat('p.', page_start) ELSE concat('pp.', page_start, '-', page_end) END"


@query("source_tag", f"SELECT chunk_id, concat('S', row_number() OVER (PARTITION BY arxiv_id, string_split(chunk_id, '~')[1]::BIGINT % 50 ORDER BY chunk_id), ': ', arxiv_id, CASE WHEN year <> '' THEN concat(' (', year, ')') ELSE '' END, CASE WHEN title <> '' THEN concat(' \"', title, '\"') ELSE '' END, ', ', {_LABEL}) AS tag FROM {CHUNKS.sql}")
def source_tag(spark, sf_dir):
    n = F.expr("row_number() over (partition by arxiv_id, cast(split_part(chunk_id, '~', 1) as bigint) % 50 order by chunk_id)")
    return CHUNKS.frame(spark, sf_dir).withColumn("n", n).select("chunk_id", T.source_tag(*[F.col(c) for c in ("n", "arxiv_id", "year", "title", "page_start", "page_end")]).alias("tag"))


@query(
    "source_view",
    f"""SELECT chunk_id, {_LABEL} AS pages, left(array_to_string({WORDS('text')}, ' '), 1200) AS text,
    CASE WHEN regexp_matches(arxiv_id, '^\\d{{4}}\\.\\d{{4,5}}$') THEN concat('https://arxiv.org/abs/', arxiv_id) END AS url, nullif(table_markdown, '') AS table_markdown,
    nullif(table_grid_source, '') AS table_source,
    coalesce(array_to_string(list_transform(list_filter(string_split(figure_images, ','), lambda x: x <> ''), lambda x: regexp_replace(x, '^.*/', '')), ','), '') AS figures FROM {CHUNKS.sql}""",
)
def source_view(spark, sf_dir):
    images = F.filter(F.split("figure_images", ","), lambda x: x != "")
    return CHUNKS.frame(spark, sf_dir).select(
        "chunk_id",
        T.pages_label(F.col("page_start"), F.col("page_end")).alias("pages"),
        F.substring(T.one_spaced(F.col("text")), 1, 1200).alias("text"),
        F.when(F.col("arxiv_id").rlike(T.PAPER_ID), F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id")).alias("url"),
        T.present(F.col("table_markdown")).alias("table_markdown"),
        T.present(F.col("table_grid_source")).alias("table_source"),
        F.coalesce(F.array_join(F.transform(images, lambda x: F.regexp_replace(x, "^.*/", "")), ","), F.lit("")).alias("figures"),
    )


ANSWERS = Fixture(
    "id long, text string",
    [(1, "Errors fall 【S1†L5-L7】 and rise 【 S12 】."), (2, "It is so [S2][S1], and so [S2]. Then [S10]."), (3, "The retrieved sources do not contain enough information to answer this question."), (4, "Sorry: the RETRIEVED sources do not contain enough information to answer this question, I fear"), (5, "")],
    per="documents", ids="id", texts="text", pick=True,
)


@query(
    "citations",
    f"""WITH n AS (SELECT id, regexp_replace(text, '【\\s*(S\\d+)[^】]*】', '[\\1]', 'g') AS text FROM {ANSWERS.sql})
SELECT id, text, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\[S(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)))), ',') AS cited,
regexp_replace(text, '\\s*\\[S\\d+\\]', '', 'g') AS bare FROM n""",
)
def citations(spark, sf_dir):
    normal = ANSWERS.frame(spark, sf_dir).select("id", T.normalize_citations(F.col("text")).alias("text"))
    return normal.select("id", "text", F.array_join(T.cited_sources(F.col("text")).cast("array<string>"), ",").alias("cited"), T.strip_citations(F.col("text")).alias("bare"))


@query("is_refusal", f"SELECT id, contains(lower(text), {QUOTE(T.REFUSAL.rstrip('.').lower())}) AS refused FROM {ANSWERS.sql}")
def is_refusal(spark, sf_dir):
    return ANSWERS.frame(spark, sf_dir).select("id", T.is_refusal(F.col("text")).alias("refused"))


SAYINGS = Fixture("id long, text string", [(1, "Hi there!"), (2, "thanks a lot"), (3, "Who are you?"), (4, "hello, how do ensembles work?"), (5, "OK."), (6, "  good morning  "), (7, "what's this"), (8, "nice result")])


@query(
    "small_talk",
    f"""WITH s AS (SELECT id, {STRIP('text')} AS t FROM {SAYINGS.sql} UNION ALL SELECT -1 - (conv_id * 1000 + turn), {STRIP('text')} FROM conversations WHERE role = 'user')
SELECT id, CASE WHEN regexp_matches(t, {QUOTE(T.ABOUT)}) THEN 'about' WHEN regexp_matches(t, {QUOTE(T.SMALL_TALK)}) THEN CASE WHEN regexp_matches(t, {QUOTE(T.THANKS)}) THEN 'thanks' ELSE 'greeting' END END AS reply FROM s""",
)
def small_talk(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((-1 - (F.col("conv_id") * 1000 + F.col("turn"))).alias("id"), "text")
    return SAYINGS.frame(spark, sf_dir).unionByName(turns).select("id", T.small_talk(F.col("text")).alias("reply"))


ROWS = Fixture("id long, cells array<string>", [(1, ["8.0 ±0.4", "76", "", "C10"]), (2, ["", " "]), (3, ["a", "b"]), (4, ["-1", "+2", "±3"])], per="documents", ids="id", texts="cells", pick=True)


@query(
    "numeric_share",
    f"""WITH b AS (SELECT id, list_filter(list_transform(cells, lambda c: {STRIP('c')}), lambda c: c <> '') AS b, cells FROM {ROWS.sql})
SELECT id, coalesce(len(list_filter(b, lambda c: regexp_matches(c, '^[±+\\-]?\\d'))) / nullif(len(b), 0), 0.0) AS share,
len(list_filter(cells, lambda c: regexp_matches(c, '\\d') AND NOT regexp_matches(regexp_replace(c, '\\bN/?A\\b', '', 'g'), '[A-Za-z]'))) AS value_cells FROM b""",
)
def numeric_share(spark, sf_dir):
    return ROWS.frame(spark, sf_dir).select("id", T.numeric_share(F.col("cells")).alias("share"), F.size(F.filter("cells", T.is_value_cell)).cast("long").alias("value_cells"))


@query("keyword_search", f"SELECT id FROM {NAMES.sql} WHERE regexp_matches(text, '(?i)CIFAR[\\s\\-]?10') UNION ALL SELECT doc_id + 100 FROM documents WHERE regexp_matches(text, '(?i)the[\\s\\-]?1')")
def keyword_search(spark, sf_dir):
    named = NAMES.frame(spark, sf_dir).where(F.col("text").rlike(T.keyword_pattern("cifar10"))).select("id")
    return named.unionByName(table(spark, sf_dir, "documents").where(F.col("text").rlike(T.keyword_pattern("the1"))).select((F.col("doc_id") + 100).alias("id")))


@query(
    "keyword_snippet",
    """WITH h AS (SELECT doc_id, text, strpos(lower(text), 'the') AS pos FROM documents WHERE contains(lower(text), 'the'))
SELECT doc_id, substring(text, greatest(1, pos - 450), pos + 453 - greatest(1, pos - 450)) AS snippet FROM h""",
)
def keyword_snippet(spark, sf_dir):
    """450 characters to either side of the first mention."""
    hits = table(spark, sf_dir, "documents").withColumn("at", F.locate("the", F.lower("text"))).where("at > 0")
    start = F.greatest(F.lit(1), F.col("at") - 450)
    return hits.select("doc_id", F.col("text").substr(start, F.col("at") + 453 - start).alias("snippet"))


TITLES = Fixture("stem string, meta string, first_page string", [("a", "A title of note", "x"), ("b", "Untitled", "12 34\narXiv:1\nThe first usable line"), ("c", None, "short\n"), ("d", "ab", None)])
_JUNK = " OR ".join(f"contains(lower(m), {QUOTE(j)})" for j in T.JUNK_TITLES)


@query(
    "doc_title",
    f"""WITH t AS (SELECT stem, {STRIP("coalesce(meta, '')")} AS m, list_filter(list_transform(string_split(coalesce(first_page, ''), chr(10)), lambda x: {STRIP('x')}), lambda x: length(x) > 8 AND NOT regexp_matches(x, '^[\\d\\W]+$') AND NOT contains(lower(x), 'arxiv')) AS u FROM {TITLES.sql}
 UNION ALL SELECT CAST(page_id AS VARCHAR), {STRIP("coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '')")}, [] FROM pages)
SELECT stem, CASE WHEN length(m) > 3 AND NOT ({_JUNK}) THEN left(m, 150) ELSE coalesce(left(u[1], 150), stem) END AS title FROM t""",
)
def doc_title(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("stem"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("meta"), F.lit(None).cast("string").alias("first_page"))
    rows = TITLES.frame(spark, sf_dir).unionByName(pages)
    return rows.select("stem", T.chosen_title(F.col("meta"), F.col("first_page"), F.col("stem")).alias("title"))


REWRITES = Fixture("id long, raw string, question string", [(1, "Standalone question: \"What is ECE?\"\nmore", "and that?"), (2, "\n\n", "why?"), (3, "why ?!", "Why?"), (4, "x" * 300, "short"), (5, "Rewritten: How is it trained", "how")], per="documents", ids="id", texts="raw", pick=True)


@query(
    "clean_rewrite",
    f"""WITH r AS (SELECT id, question, list_filter(list_transform(string_split(raw, chr(10)), lambda x: {STRIP("regexp_replace(" + STRIP("regexp_replace(" + STRIP('x') + ", '(?i)^(standalone question|question|rewritten)\\s*:\\s*', '')") + ", '^[\"'']+|[\"'']+$', '', 'g')")}), lambda x: x <> '')[1] AS f FROM {REWRITES.sql})
SELECT id, CASE WHEN f IS NULL OR length(f) > greatest(200, length(question) * 4) OR trim(regexp_replace(lower(f), '[\\s?.!]+', ' ', 'g')) = trim(regexp_replace(lower(question), '[\\s?.!]+', ' ', 'g')) THEN question ELSE f END AS rewritten FROM r""",
)
def clean_rewrite(spark, sf_dir):
    return REWRITES.frame(spark, sf_dir).select("id", T.clean_rewrite(F.col("raw"), F.col("question")).alias("rewritten"))


@query("src_id_normalize", f"WITH p AS (SELECT page_id, {STRIP('string_split(url, chr(35))[1]')} AS u FROM pages), i AS (SELECT page_id, regexp_replace(regexp_replace(u, '^.*/(?:abs|pdf)/', ''), '(\\.pdf)?$|v\\d+(\\.pdf)?$', '') AS id FROM p) SELECT id, min(page_id) AS first_page FROM i GROUP BY id")
def src_id_normalize(spark, sf_dir):
    ids = table(spark, sf_dir, "pages").select("page_id", T.paper_id(F.col("url")).alias("id"))
    return ids.groupBy("id").agg(F.min("page_id").alias("first_page"))


IDS = Fixture("id string", [("1612.01474v3",), ("cs/0112017",), ("2001.00001",)], per="pages", ids="id", pick=True)


@query("id_to_filename", f"SELECT id, replace(regexp_replace(id, 'v\\d+$', ''), '/', '_') AS file, replace(id, '/', '__') AS set_file FROM {IDS.sql}")
def id_to_filename(spark, sf_dir):
    return IDS.frame(spark, sf_dir).select("id", T.paper_file(F.col("id")).alias("file"), F.replace(F.col("id"), F.lit("/"), F.lit("__")).alias("set_file"))


@query(
    "history_text",
    f"""WITH b AS (SELECT conv_id, turn, {STRIP("regexp_replace(text, '\\s*\\[S\\d+\\]', '', 'g')")} AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN length(t) > 700 THEN concat(regexp_replace(left(t, 700), '(?s) [^ ]*$', ''), ' ...') ELSE t END AS text FROM b""",
)
def history_text(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return answers.select("conv_id", "turn", T.history_text(F.col("text")).alias("text"))


OVERLAPS = Fixture("id long, a string, b string", [(1, "one two three four five six seven", "four five six seven eight nine"), (2, "nothing shared here at all", "and nothing over there either"), (3, "short", "short"), (4, "the same text of some length", "the same text of some length")], per="benchmark", ids="id", texts="b")


@query(
    "merge_overlap",
    f"""WITH n AS (SELECT id, a, b, list_max(list_filter(range(20, greatest(20, least(length(a), length(b))) + 1), lambda k: k <= least(length(a), length(b)) AND right(a, k) = left(b, k))) AS n FROM {OVERLAPS.sql})
SELECT id, CASE WHEN n IS NULL THEN concat(a, ' ', b) ELSE concat(a, substring(b, n + 1)) END AS merged FROM n""",
)
def merge_overlap(spark, sf_dir):
    return OVERLAPS.frame(spark, sf_dir).select("id", T.overlap_merged(F.col("a"), F.col("b")).alias("merged"))


@query("extract_json", "SELECT event_id, regexp_extract(concat('Reply: ', props, ' end'), '(?s)(\\{.*\\})', 1) AS body FROM events")
def extract_json(spark, sf_dir):
    said = F.concat(F.lit("Reply: "), F.col("props"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", T.json_object(said).alias("body"))


ERRORS = Fixture("id long, message string", [(1, "429 RESOURCE_EXHAUSTED quota"), (2, "404 model not found"), (3, "503 UNAVAILABLE"), (4, "httpx.ReadTimeout: timed out"), (5, "bad key"), (6, "quota of 500 reached: 429")], per="documents", ids="id", texts="message", pick=True)


@query(
    "error_class",
    f"SELECT id, CASE WHEN contains(message, '429') OR contains(message, 'RESOURCE_EXHAUSTED') THEN 'rate_limit' WHEN contains(message, '404') OR contains(message, 'NOT_FOUND') THEN 'unknown_model' WHEN regexp_matches(message, '^\\s*50[0234]\\b|\\b(UNAVAILABLE|INTERNAL)\\b') THEN 'server_error' WHEN regexp_matches(message, 'ConnectError|ConnectTimeout|ReadTimeout|ReadError|WriteError|RemoteProtocolError|SSLError|TimeoutError|ConnectionError|ConnectionResetError') THEN 'network_error' ELSE 'other' END AS class FROM {ERRORS.sql}",
)
def error_class(spark, sf_dir):
    return ERRORS.frame(spark, sf_dir).select("id", T.error_class(F.col("message")).alias("class"))


GRIDS = Fixture(
    "id long, markdown string, source string",
    [
        (1, "| M | C10 |\n|---|:---:|\n| a | 7.3 |\n| b | 8 |", "M C10 a 7.3 b 8"),
        (2, "| M | C10 |\n|---|---|\n| a | 9.9 |", "M C10 a 7.3"),
        (3, "| M |\n|---|\n| a |", "a"),
        (4, "| M | N |\n|---|---|\n| a |", "a"),
        (5, "| M | N |\n|---|---|\n| 5 | 5 |", "only one 5"),
        (6, "plain text", "x"),
        (7, "| M | N |\n|---|---|\n| a | b |", "a b"),
    ],
    per="documents", ids="id", texts="source", pick=True,
)
_ROWS = f"list_filter(list_transform(list_filter(string_split({STRIP('markdown')}, chr(10)), lambda x: contains(x, '|')), lambda x: list_transform(string_split(regexp_replace({STRIP('x')}, '^\\||\\|$', '', 'g'), '|'), lambda c: {STRIP('c')})), lambda r: NOT (len(list_filter(r, lambda c: c <> '')) > 0 AND len(list_filter(r, lambda c: c <> '' AND NOT regexp_matches(c, '^:?-{{2,}}:?$'))) = 0))"


@query("parse_markdown", f"SELECT id, array_to_string(list_transform({_ROWS.replace('{{2,}}', '{2,}')}, lambda r: array_to_string(r, ';')), '/') AS rows, len({_ROWS.replace('{{2,}}', '{2,}')}) AS n FROM {GRIDS.sql}")
def parse_markdown(spark, sf_dir):
    rows = T.markdown_rows(F.col("markdown"))
    return GRIDS.frame(spark, sf_dir).select("id", F.array_join(F.transform(rows, lambda r: F.array_join(r, ";")), "/").alias("rows"), F.size(rows).cast("long").alias("n"))


@query(
    "check_markdown",
    f"""WITH r AS (SELECT id, source, {_ROWS.replace('{{2,}}', '{2,}')} AS rows FROM {GRIDS.sql}),
v AS (SELECT id, source, rows, regexp_extract_all(array_to_string(list_filter(flatten(rows[2:]), lambda c: regexp_matches(c, '\\d') AND NOT regexp_matches(regexp_replace(c, '\\bN/?A\\b', '', 'g'), '[A-Za-z]')), ' '), '\\d+(?:\\.\\d+)?') AS nums, regexp_extract_all(source, '\\d+(?:\\.\\d+)?') AS held FROM r),
e AS (SELECT id, num, count(*) AS n, min(i) AS first FROM (SELECT id, unnest(nums) AS num, generate_subscripts(nums, 1) AS i FROM v) GROUP BY ALL),
h AS (SELECT id, num, count(*) AS n FROM (SELECT id, unnest(held) AS num FROM v) GROUP BY ALL),
bad AS (SELECT e.id, string_agg(e.num, ', ' ORDER BY e.first) AS nums FROM e LEFT JOIN h ON h.id = e.id AND h.num = e.num WHERE e.n > coalesce(h.n, 0) GROUP BY e.id)
SELECT v.id, CASE WHEN len(rows) < 2 THEN 'fewer than one header and one data row' WHEN len(rows[1]) < 2 THEN 'only one column'
 WHEN len(list_filter(rows[2:], lambda r: len(r) <> len(rows[1]))) > 0 THEN concat(len(list_filter(rows[2:], lambda r: len(r) <> len(rows[1]))), ' row(s) with a different number of cells than the header')
 WHEN len(v.nums) = 0 THEN 'no numbers in the table body' WHEN bad.nums IS NOT NULL THEN concat('numbers not in the source text: ', bad.nums) ELSE '' END AS reason
FROM v LEFT JOIN bad ON bad.id = v.id""",
)
def check_markdown(spark, sf_dir):
    return GRIDS.frame(spark, sf_dir).select("id", T.check_markdown(F.col("markdown"), F.col("source")).alias("reason"))


@query(
    "grid_values",
    f"SELECT id, array_to_string(list_filter(list_transform(flatten(list_transform(string_split(markdown, chr(10))[3:], lambda x: string_split(regexp_replace(x, '^\\|+|\\|+$', '', 'g'), '|'))), lambda c: {STRIP('c')}), lambda c: regexp_matches(c, '^[±+\\-]?\\d')), ',') AS found FROM {GRIDS.sql}",
)
def grid_values(spark, sf_dir):
    return GRIDS.frame(spark, sf_dir).select("id", F.array_join(T.grid_values(F.col("markdown")), ",").alias("found"))


@query("grid_to_markdown")
def grid_to_markdown(spark, sf_dir):
    grid = T.markdown_rows(F.col("markdown"))
    rows = GRIDS.frame(spark, sf_dir).where("markdown like '|%'")
    return rows.select("id", T.grid_markdown(T.merged_header(grid)).alias("markdown"), T.grid_reason(grid).alias("reason"))


TABLE_REPLIES = Fixture(
    "id long, reply string",
    [
        (1, "TABLE\nCAPTION: Errors\nDESCRIPTION: Compares\nall methods\nGRID:\n| a | b |\n|---|---|\n| x | 1 |\nEND\n**TABLE 2**\nCAPTION: Other\nGRID: none\nEND"),
        (2, "```\nCAPTION: Alone\n| a | b |\n```"),
        (3, '{"tables": [{"caption": "J", "description": "d", "markdown": "| a |"}]}'),
        (4, "NO TABLES"),
        (5, "I cannot do that."),
        (6, None),
    ],
    per="documents", ids="id", texts="reply", pick=True, sep="\n",
)


@query("parse_tables")
def parse_tables(spark, sf_dir):
    """Tables of model replies; a reply that follows no format has one row without a table."""
    rows = TABLE_REPLIES.frame(spark, sf_dir).withColumn("_t", T.reply_tables(F.col("reply")))
    return rows.select("id", F.col("_t").isNull().alias("failed"), F.inline_outer("_t"))


MODELS = Fixture("name string", [("gem-2.0-flash",), ("gem-2.5-flash",), ("gem-3.0-flash-preview",), ("gem-2.5-flash-lite",), ("gem-9-pro",)], per="pages", ids="name", pick=True, behind=True)


@query("pick_model", f"SELECT name FROM {MODELS.sql} WHERE contains(name, 'flash') AND NOT contains(name, 'lite') ORDER BY contains(name, 'preview') OR contains(name, 'exp'), list_transform(regexp_extract_all(name, '\\d+(?:\\.\\d+)?'), lambda x: -CAST(x AS DOUBLE)), name LIMIT 1")
def pick_model(spark, sf_dir):
    return closest_model(MODELS.frame(spark, sf_dir), "gem-1.5-flash")
