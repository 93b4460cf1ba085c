"""Pages, chunks, sentences and layout: their queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import text as T
from corvane.operators import chunking as C
from corvane.operators import enrich as E
from corvane.operators import overlay as O
from corvane.operators import spans as P
from corvane.operators.models import embedder
from corvane.plans.text import _DENSITY, QUOTE, WORDS
from corvane.session import Fixture, table

PAGES = "(SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_no, text FROM conversations)"
SPANS = f"(SELECT doc_id, page_no, CAST(sum(length(text) + 1) OVER w - length(text) - 1 AS BIGINT) AS start, CAST(sum(length(text) + 1) OVER w AS BIGINT) AS \"end\" FROM {PAGES} WHERE length(text) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY page_no))"


def pages(spark, sf_dir):
    """Turns stand in for pages, conversations for documents."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), "text")


@query("page_char_map", f"SELECT * FROM {SPANS}")
def page_char_map(spark, sf_dir):
    return C.page_char_map(pages(spark, sf_dir))


@query(
    "page_for_char",
    f"""WITH p AS (SELECT event_id, user_id AS doc_id, CAST(event_id * 37 % 9000 AS BIGINT) AS pos FROM events), s AS {SPANS},
l AS (SELECT doc_id, max(page_no) AS last FROM s GROUP BY doc_id)
SELECT event_id, p.doc_id, pos, coalesce(s.page_no, l.last, 1) AS page_no FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.start <= pos AND pos < s."end" LEFT JOIN l ON l.doc_id = p.doc_id""",
)
def page_for_char(spark, sf_dir):
    spans = C.page_char_map(pages(spark, sf_dir))
    positions = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") * 37 % 9000).cast("long").alias("pos"))
    return C.page_for_char(positions, spans)


def sql_windows(texts: str, size: int, overlap: int) -> str:
    """CTEs that end in ``chunks`` (doc_id, chunk_index, n_tokens, char_start, char_end, text) from ``texts`` (doc_id, text)."""
    step = size - overlap
    return f"""f AS ({texts}), p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\s*\\S+')) AS piece, generate_subscripts(regexp_extract_all(text, '\\s*\\S+'), 1) - 1 AS i FROM f),
t AS (SELECT doc_id, i, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e, length(regexp_replace(piece, '^\\s+', '')) AS n FROM p),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
w AS (SELECT doc_id, n, unnest(list_filter(range(0, n, {step}), lambda s: s = 0 OR s - {step} + {size} < n)) AS lo FROM n),
chunks AS (SELECT w.doc_id, CAST(lo // {step} AS INTEGER) AS chunk_index, least({size}, w.n - lo) AS n_tokens, a.e - a.n AS char_start, b.e AS char_end, substring(f.text, a.e - a.n + 1, b.e - a.e + a.n) AS text
  FROM w JOIN t a ON a.doc_id = w.doc_id AND a.i = lo JOIN t b ON b.doc_id = w.doc_id AND b.i = least(lo + {size}, w.n) - 1 JOIN f ON f.doc_id = w.doc_id)"""


@query("chunk_fixed", f"WITH {sql_windows('SELECT doc_id, text FROM documents', 512, 50)} SELECT * FROM chunks")
def chunk_fixed(spark, sf_dir):
    """Windows of white-space tokens, as exact pieces of the text."""
    return P.chunk_spans(table(spark, sf_dir, "documents"))


RUNNING = f"SELECT doc_id, string_agg(text || ' ', '' ORDER BY page_no) AS text FROM {PAGES} WHERE length(text) > 0 GROUP BY doc_id"
_PAGED = f"""WITH {sql_windows(RUNNING, 64, 8)}, s AS {SPANS},
paged AS (SELECT c.*, a.page_no AS page_start, z.page_no AS page_end FROM chunks c JOIN s a ON a.doc_id = c.doc_id AND a.start <= char_start AND char_start < a."end" JOIN s z ON z.doc_id = c.doc_id AND z.start <= char_end - 1 AND char_end - 1 < z."end")"""


@query("chunk_pages", f"{_PAGED} SELECT doc_id, chunk_index, page_start, page_end, {_DENSITY} >= 0.25 AS is_reference, n_tokens, char_start, char_end, text FROM paged")
def chunk_pages(spark, sf_dir):
    """Windows over the running text of a document's pages, with the pages they stand on."""
    return P.chunk_pages(pages(spark, sf_dir), size=64, overlap=8)


def _hashed():
    """The built-in stand-in for an embedding model: words hashed to 64 places."""
    import zlib

    def embed(texts: list[str]) -> list[list[int]]:
        out = [[0] * 64 for _ in texts]
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                row[zlib.crc32(word.encode()) % 64] += 1
        return out

    return embed


@query("chunk_pages_semantic")
def chunk_pages_semantic(spark, sf_dir):
    """Whole sentences of the running text; a chunk ends where the topic shifts."""
    return P.chunk_pages(pages(spark, sf_dir), "semantic", embed=embedder(_hashed), size=96, overlap=16, least=24)


_SENTENCES = "list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(9246) || '\\2', 'g'), chr(9246)), lambda s: regexp_matches(s, '\\S'))"


@query("sentence_split", f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence, unnest(s) AS text FROM s")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("sentence", "text"))


@query(
    "token_units",
    f"""WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), u AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence, unnest(s) AS x FROM s),
n AS (SELECT doc_id, sentence, len({WORDS('x')}) AS n FROM u)
SELECT doc_id, sentence, CAST(pos // 24 AS INTEGER) AS unit, least(24, n - pos) AS n_tokens FROM (SELECT doc_id, sentence, n, unnest(range(0, n, 24)) AS pos FROM n WHERE n > 0)""",
)
def token_units(spark, sf_dir):
    return C.token_units(table(spark, sf_dir, "documents"), size=24)


@query("chunk_sentence")
def chunk_sentence(spark, sf_dir):
    """Chunks of whole sentences, as exact pieces of the text."""
    return P.chunk_spans(table(spark, sf_dir, "documents"), "sentence", size=256, overlap=32)


@query(
    "semantic_breaks",
    """WITH v AS (SELECT label AS doc_id, vec_id AS sentence, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
d AS (SELECT doc_id, sentence, 1 - list_dot_product(CAST(embedding AS DOUBLE[]), CAST(nxt AS DOUBLE[])) AS distance FROM v WHERE nxt IS NOT NULL),
l AS (SELECT doc_id, quantile_cont(distance, 0.9) AS lim, count(*) AS n FROM d GROUP BY doc_id)
SELECT d.doc_id, sentence, round(distance, 6) AS distance FROM d JOIN l ON l.doc_id = d.doc_id WHERE distance > lim AND n >= 2""",
)
def semantic_breaks(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("sentence"), F.col("embedding").alias("vector"))
    return C.semantic_breaks(rows).withColumn("distance", F.round("distance", 6))


HITS = Fixture(
    "qid string, n int, arxiv_id string, title string, year string, page_start int, page_end int, text string, grid string, figure_note string",
    [("q1", 1, "a", "T a", "2017", 1, 1, "one  two", "| g |", None), ("q1", 2, "b", "", "", 2, 3, "three", "| g |", "Figure 1: x"), ("q1", 3, "c", "T c", "2020", 4, 4, "four\nfive", "", None), ("q2", 1, "a", "T a", "2017", 1, 1, "one", None, None)],
    per="pages", ids="qid", texts="text",
)


@query(
    "build_prompt",
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY qid, grid ORDER BY n) AS seen, concat('S', n, ': ', arxiv_id, CASE WHEN year <> '' THEN concat(' (', year, ')') ELSE '' END, CASE WHEN title <> '' THEN concat(' "', title, '"') ELSE '' END, ', ', CASE WHEN page_start = page_end THEN concat('p.', page_start) ELSE concat('pp.', page_start, '-', page_end) END) AS tag FROM {HITS.sql}),
p AS (SELECT qid, n, concat('[', tag, ']', chr(10), array_to_string({WORDS('text')}, ' '), chr(10), CASE WHEN grid <> '' AND seen = 1 THEN concat(chr(10), 'Table from this source, rebuilt as a grid:', chr(10), grid, chr(10)) ELSE '' END, CASE WHEN figure_note <> '' THEN concat(chr(10), 'Figures on these pages: ', figure_note, chr(10)) ELSE '' END) AS part FROM h)
SELECT qid, concat('Sources:', chr(10), chr(10), string_agg(part, chr(10) ORDER BY n), chr(10), chr(10), 'Question: ', qid) AS prompt FROM p GROUP BY qid""",
)
def build_prompt(spark, sf_dir):
    """Numbered sources; a grid that two sources carry is shown with the first."""
    tag = T.source_tag(*[F.col(c) for c in ("n", "arxiv_id", "year", "title", "page_start", "page_end")])
    seen = F.expr("row_number() over (partition by qid, grid order by n)")
    grid = F.when((F.col("grid") != "") & (F.col("_seen") == 1), F.concat(F.lit("\nTable from this source, rebuilt as a grid:\n"), "grid", F.lit("\n"))).otherwise("")
    figure = F.when(F.col("figure_note") != "", F.concat(F.lit("\nFigures on these pages: "), "figure_note", F.lit("\n"))).otherwise("")
    part = F.concat(F.lit("["), tag, F.lit("]\n"), T.one_spaced(F.col("text")), F.lit("\n"), grid, figure)
    parts = HITS.frame(spark, sf_dir).withColumn("_seen", seen).select("qid", "n", part.alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n")
    return parts.groupBy("qid").agg(joined.alias("_j")).select("qid", F.concat(F.lit("Sources:\n\n"), "_j", F.lit("\n\nQuestion: "), "qid").alias("prompt"))


_JUDGED = "CASE WHEN conv_id % 3 = 0 THEN [] WHEN conv_id % 3 = 1 THEN ['', ' '] ELSE [said[1], NULL, ' '] END"


@query(
    "judge_prompt",
    f"""WITH t AS (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS said, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS asked FROM conversations GROUP BY conv_id),
q AS (SELECT conv_id, said, asked[1] AS question, list_filter({_JUDGED}, lambda e: e IS NOT NULL AND regexp_matches(e, '\\S')) AS quotes FROM t WHERE len(said) > 0 AND len(asked) > 0)
SELECT conv_id, concat('Sources:', chr(10), chr(10), conv_id, chr(10), chr(10), chr(10), 'Question: ', question, chr(10), chr(10), 'Answer, split into sentences:', chr(10), array_to_string(list_transform(said, lambda s, i: concat('SENTENCE ', i, ': ', s)), chr(10)), chr(10), CASE WHEN len(quotes) > 0 THEN concat(chr(10), 'Reference quote(s) the question was written from:', chr(10), array_to_string(list_transform(quotes, lambda e: concat('- ', e)), chr(10))) ELSE concat(chr(10), 'No reference quote is given.') END) AS prompt FROM q""",
)
def judge_prompt(spark, sf_dir):
    """What a judge is asked of each conversation: its first question, the replies as sentences, and quotes for some."""
    turns = table(spark, sf_dir, "conversations")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    told = turns.groupBy("conv_id").agg(of("assistant").alias("said"), of("user").alias("asked")).where((F.size("said") > 0) & (F.size("asked") > 0))
    quotes = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("conv_id") % 3 == 1, F.array(F.lit(""), F.lit(" "))).otherwise(F.array(F.get("said", F.lit(0)), F.lit(None).cast("string"), F.lit(" ")))
    sources = F.concat(F.lit("Sources:\n\n"), F.col("conv_id").cast("string"), F.lit("\n"))
    return told.select("conv_id", E.judge_prompt(sources, F.get("asked", F.lit(0)), F.col("said"), quotes).alias("prompt"))


SPLIT_CHUNKS = Fixture(
    "paper string, idx int, text string, page_start int, page_end int",
    [
        ("a", 0, "In the table below we give all results of the methods on both data sets " + " ".join(str(i) for i in range(40)), 1, 1),
        ("a", 1, " ".join(str(i) for i in range(25, 70)) + " and so the table ends and the text goes on for thirty words or more " + "word " * 30 + " ".join(str(i) for i in range(30)), 2, 2),
        ("a", 2, " ".join(str(i) for i in range(30)) + " closes the second table", 3, 3),
        ("a", 3, "then " * 40, 3, 4),
        ("b", 0, "prose " * 40, 1, 1),
        ("b", 1, " ".join(str(i) for i in range(100, 140)), 2, 2),
        ("b", 2, "more prose " * 30, 2, 3),
        ("c", 0, " ".join(str(i) for i in range(200, 240)), 5, 5),
        ("c", 1, "1 2 3", 6, 6),
    ],
    per="benchmark", ids="paper",
)
SPLIT_HITS = Fixture("qid string, paper string, idx int, rank int", [("q1", "a", 0, 1), ("q1", "a", 2, 2), ("q1", "b", 0, 3), ("q1", "b", 1, 4), ("q2", "b", 1, 1), ("q2", "a", 1, 2), ("q2", "c", 0, 3), ("q2", "c", 1, 4), ("q3", "a", 3, 1), ("q3", "c", 0, 2)], per="benchmark", ids="qid paper")
_CELLS = lambda w: f"len(list_filter({w}, lambda t: regexp_matches(t, {QUOTE(T.TABLE_TOKEN)}))) / 30 >= 0.5"
_JOINED = lambda a, b: f"CASE WHEN {b} IS NULL OR {a} IS NULL THEN coalesce({a}, {b}) ELSE coalesce({a} || substring({b}, 1 + list_max(list_filter(range(20, least(length({a}), length({b})) + 1), lambda k: right({a}, k) = left({b}, k)))), concat({a}, ' ', {b})) END"


@query(
    "expand_split_tables",
    f"""WITH h AS (SELECT h.*, c.text, c.page_start, c.page_end, {WORDS('text')} AS w FROM {SPLIT_HITS.sql} h JOIN {SPLIT_CHUNKS.sql} c USING (paper, idx)),
e AS (SELECT qid, paper, idx, rank, unnest([-1, 1]) AS side, w FROM h WHERE len(w) >= 30),
f AS (SELECT e.* FROM e JOIN {SPLIT_CHUNKS.sql} c ON c.paper = e.paper AND c.idx = e.idx + side WHERE CASE WHEN side < 0 THEN {_CELLS('w[:30]')} ELSE {_CELLS('w[-30:]')} END AND NOT EXISTS (SELECT 1 FROM h o WHERE o.qid = e.qid AND o.paper = e.paper AND o.idx = e.idx + side)),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY qid, paper, idx + side ORDER BY rank) = 1),
t AS (SELECT * FROM o QUALIFY dense_rank() OVER (PARTITION BY qid ORDER BY rank) <= 2),
m AS (SELECT h.*, p.text AS pt, p.page_start AS ps, n.text AS nt, n.page_end AS ne, CASE WHEN p.idx IS NOT NULL THEN p.idx END AS pi, n.idx AS ni FROM h LEFT JOIN (t JOIN {SPLIT_CHUNKS.sql} c ON c.paper = t.paper AND c.idx = t.idx - 1 AND t.side = -1) AS p(qid, tp, ti, rank, side, w, paper, idx, text, page_start, page_end) ON p.qid = h.qid AND p.rank = h.rank
LEFT JOIN (t JOIN {SPLIT_CHUNKS.sql} c ON c.paper = t.paper AND c.idx = t.idx + 1 AND t.side = 1) AS n(qid, tp, ti, rank, side, w, paper, idx, text, page_start, page_end) ON n.qid = h.qid AND n.rank = h.rank),
j AS (SELECT *, {_JOINED('pt', 'text')} AS led FROM m)
SELECT qid, rank, paper, idx, least(page_start, coalesce(ps, page_start)) AS page_start, greatest(page_end, coalesce(ne, page_end)) AS page_end, {_JOINED('led', 'nt')} AS text, nullif(concat_ws(',', CASE WHEN pi IS NOT NULL THEN concat(paper, '__', lpad(CAST(pi AS VARCHAR), 4, '0')) END, CASE WHEN ni IS NOT NULL THEN concat(paper, '__', lpad(CAST(ni AS VARCHAR), 4, '0')) END), '') AS expanded_with FROM j""",
)
def expand_split_tables(spark, sf_dir):
    """Hits that begin or end within a table take the chunk before or behind along."""
    chunks = SPLIT_CHUNKS.frame(spark, sf_dir)
    hits = SPLIT_HITS.frame(spark, sf_dir).join(chunks, ["paper", "idx"])
    out = E.expand_split_tables(hits, chunks, ["qid"])
    return out.select("qid", "rank", "paper", "idx", "page_start", "page_end", "text", T.present(F.array_join(F.transform("expanded_with", lambda i: T.chunk_name(F.col("paper"), i)), ",")).alias("expanded_with"))


@query("upload_chunk_ids", f"{_PAGED} SELECT concat('upload:', doc_id, '.pdf__', lpad(CAST(chunk_index AS VARCHAR), 4, '0')) AS chunk_id, concat('upload:', doc_id, '.pdf') AS arxiv_id, '' AS year, chunk_index, page_start, page_end FROM paged")
def upload_chunk_ids(spark, sf_dir):
    """Chunks of uploads, in the corpus' form (conversations stand in for uploaded files)."""
    name = F.concat(F.lit("upload:"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    chunks = P.chunk_pages(pages(spark, sf_dir).withColumn("doc_id", name), size=64, overlap=8)
    return chunks.select(T.chunk_name(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), F.col("doc_id").alias("arxiv_id"), F.lit("").alias("year"), "chunk_index", "page_start", "page_end")


UPLOADS = Fixture("seq int, name string, found boolean, mb double, pages int", [(1, "a.pdf", True, 1.0, 5), (2, "a.pdf", True, 1.0, 5), (3, "b.txt", True, 1.0, 1), (4, "c.pdf", True, 31.0, 5), (5, "d.pdf", True, 2.0, 81), (6, "e.pdf", False, None, None), (7, "f.pdf", True, 3.0, None), (8, "a.pdf", True, 2.0, 3)], per="pages", ids="seq name")


@query(
    "upload_check_reason",
    f"SELECT seq, CASE WHEN NOT found THEN 'file not found' WHEN NOT regexp_matches(lower(name), '\\.pdf$') THEN 'not a .pdf file' WHEN mb > 30 THEN 'too large' WHEN pages IS NULL THEN 'could not open' WHEN pages > 80 THEN 'too many pages' END AS reason FROM {UPLOADS.sql}",
)
def upload_check_reason(spark, sf_dir):
    reason = F.when(~F.col("found"), "file not found").when(~F.lower("name").endswith(".pdf"), "not a .pdf file").when(F.col("mb") > 30, "too large").when(F.col("pages").isNull(), "could not open").when(F.col("pages") > 80, "too many pages")
    return UPLOADS.frame(spark, sf_dir).select("seq", reason.alias("reason"))


_NAMED = "concat('p', doc_id % 3, CASE doc_id % 5 WHEN 1 THEN '-2' WHEN 2 THEN '-2-2' WHEN 3 THEN '-3' ELSE '' END, '.pdf')"


@query(
    "upload_doc_ids",
    f"""WITH RECURSIVE u AS (SELECT doc_id, doc_id // 12 AS session, {_NAMED} AS name, row_number() OVER (PARTITION BY doc_id // 12 ORDER BY doc_id) AS i FROM documents),
r(session, i, doc_id, seen) AS (SELECT DISTINCT session, 0::BIGINT, NULL::BIGINT, []::VARCHAR[] FROM u
UNION ALL SELECT u.session, u.i, u.doc_id, list_append(seen, list_filter(list_prepend(name, list_transform(range(2, 20), lambda n: concat(name[:-5], '-', n, '.pdf'))), lambda c: NOT list_contains(seen, c))[1]) FROM r JOIN u ON u.session = r.session AND u.i = r.i + 1)
SELECT session, doc_id AS seq, concat('upload:', seen[-1]) AS doc_id FROM r WHERE doc_id IS NOT NULL""",
)
def upload_doc_ids(spark, sf_dir):
    """Twelve uploads a session, whose names may be those that others get (documents stand in for them)."""
    d = F.col("doc_id")
    suffix = F.when(d % 5 == 1, "-2").when(d % 5 == 2, "-2-2").when(d % 5 == 3, "-3").otherwise("")
    uploads = table(spark, sf_dir, "documents").select(F.floor(d / 12).alias("session"), d.alias("seq"), F.concat(F.lit("p"), (d % 3).cast("string"), suffix, F.lit(".pdf")).alias("name"))
    return O.unique_names(uploads, "session", "seq", "name").select("session", "seq", F.concat(F.lit("upload:"), "unique").alias("doc_id"))


JOBS = Fixture("run string, spec string", [("r", "softmax:0,softmax:1,softmax:2,dropout:0,edl:0",)], per="pages", ids="run")


@query("job_spec_share", f"WITH j AS (SELECT run, unnest(string_split(spec, ',')) AS job, generate_subscripts(string_split(spec, ','), 1) - 1 AS n FROM {JOBS.sql}) SELECT run, n % 2 AS worker, string_split(job, ':')[1] AS method, CAST(string_split(job, ':')[2] AS INTEGER) AS seed FROM j")
def job_spec_share(spark, sf_dir):
    jobs = JOBS.frame(spark, sf_dir).select("run", F.posexplode(F.split("spec", ",")).alias("n", "job"))
    part = F.split("job", ":")
    return jobs.select("run", F.pmod("n", F.lit(2)).cast("long").alias("worker"), part[0].alias("method"), part[1].cast("int").alias("seed"))


METHODS = Fixture("method string, kind string, members int", [("ensemble", "softmax", 5), ("dropout", "dropout", 1), ("edl", "edl", 1)], per="pages", ids="method")


@query("ensemble_members", f"SELECT method, concat(kind, '_', unnest(range(0, members)), '.pt') AS checkpoint FROM {METHODS.sql}")
def ensemble_members(spark, sf_dir):
    members = METHODS.frame(spark, sf_dir).select("method", "kind", F.explode(F.sequence(F.lit(0), F.col("members") - 1)).alias("m"))
    return members.select("method", F.concat("kind", F.lit("_"), F.col("m").cast("string"), F.lit(".pt")).alias("checkpoint"))


@query(
    "split_messages",
    "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn % 4 = 0) AS system_text, count(*) FILTER (WHERE turn % 4 <> 0) AS n_turns, string_agg(CASE role WHEN 'assistant' THEN 'model' ELSE role END, ',' ORDER BY turn) FILTER (WHERE turn % 4 <> 0) AS roles FROM conversations GROUP BY conv_id",
)
def split_messages(spark, sf_dir):
    """System texts apart from the turns, whose roles are renamed (each fourth turn stands in for a system text)."""
    turns = table(spark, sf_dir, "conversations")
    system = F.col("turn") % 4 == 0
    ordered = lambda where, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("turn", value.alias("v"))))), lambda x: x["v"]), "\n" if value is text else ",")
    text = F.col("text")
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    out = turns.groupBy("conv_id").agg(ordered(system, text).alias("system_text"), F.count_if(~system).alias("n_turns"), ordered(~system, role).alias("roles"))
    return out.withColumns({c: T.present(F.col(c)) for c in ("system_text", "roles")})
