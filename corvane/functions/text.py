"""Column functions on texts: cleaning, tokens, predicates, labels.

White space and word characters are Unicode's, as ``(?U)`` has it. All functions are JVM-side but for nfkc().
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: patterns and weights of citation markers
CITATION_MARKERS = (
    (r"\b(?:19|20)\d{2}\b", 2),
    (r"\[\d+\]", 3),
    (r"\[[A-Z][a-z]+[^\]]{0,40}\d{4}\]", 3),
    (r"\bet\s+al\.", 3),
    (r"\b[A-Z]\.\s*[A-Z]?\.?\s*[;,]", 2),
    (r"(?i)\b(?:In Proceedings|In Advances|Conference on|Journal of|arXiv preprint|Transactions on|NeurIPS|ICML|ICLR|CVPR|Nature|PMLR)\b", 3),
    (r"\d+\(\d+\):\d+", 3),
    ("\\bpp?\\.\\s*\\d+[-\u2013]\\d+", 3),
    ("\\d+[-\u2013]\\d+\\s*,\\s*(?:19|20)\\d{2}", 3),
    (r"[A-Z][a-z]+\s+[A-Z][a-z]+,\s+[A-Z][a-z]+\s+[A-Z][a-z]+,\s+and\s+[A-Z]", 4),
    (r",\s+and\s+[A-Z][a-z]+\s+[A-Z]\.?\s*[A-Z]?[a-z]*\.", 3),
)
REFERENCE_DENSITY = 0.25
# fixed values: what counts as a table's token, names of one thing, phrases, replies and titles that the rules name
TABLE_TOKEN = "^(?:[±+\\-]?\\d+(?:\\.\\d+)?%?|±|NA|N/A|-|–)$"
TOKEN_ALIASES = {"c10": "cifar10", "c100": "cifar100", "endd": "end2"}
LEANING_PHRASES = ("this paper", "the passage", "passage a", "passage b", "the authors", "the proposed", "this work", "this study", "the above")
REFUSAL = "The retrieved sources do not contain enough information to answer this question."
SMALL_TALK = r"(?i)^(hi+|hello|hey+|hiya|yo|good (morning|afternoon|evening)|thanks?|thank you|thx|ty|ok(ay)?|cool|great|nice|got it)( there| so much| a lot)?[\s!.,:)]*$"
THANKS = r"(?i)^(thank|thx|ty|ok|cool|great|nice|got)"
ABOUT = r"(?i)^(how are you|how'?s it going|how are things|who are you|what are you|what can you do|what do you do|what is this|what's this|help)[\s?!.,]*$"
JUNK_LINES = (r"(?i)^arXiv:\d+\.\d+", r"(?i)^Preprint\.?\s*$", r"(?i)^Under review")
JUNK_TITLES = ("untitled", "microsoft word", ".dvi", ".tex", "arxiv")
PAPER_ID = r"^\d{4}\.\d{4,5}$"
NUMBER = r"\d+(?:\.\d+)?"


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, which Spark has no function for."""
    import unicodedata

    for part in texts:
        yield part.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None and not t.isascii() else t)


#: Characters beyond ASCII that compatibility composition leaves as they are, whatever stands before them: accented Latin letters, Greek and
#: Cyrillic ones, dashes and quotes, kana, ideographs, Hangul syllables. A few ranges, as each costs time at each character.
SETTLED = r"\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{391}-\x{3C9}\x{400}-\x{481}\x{2012}-\x{2016}\x{2018}-\x{2022}\x{20AC}\x{3041}-\x{3096}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}"


def composed(text: Column) -> Column:
    """NFKC of a text. Only texts with a character that it may change leave the JVM."""
    beyond = F.octet_length(text) != F.length(text)
    # the many ranges are looked at behind characters beyond ASCII only: each costs time
    return F.coalesce(nfkc(F.when(beyond & text.rlike(rf"[^\x00-\x7F](?<![{SETTLED}])"), text)), text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def one_spaced(text: Column) -> Column:
    return F.array_join(words(text), " ")


def clean_page(text: Column) -> Column:
    """Lines joined to running text, without page numbers at either end, stamps and line-end hyphens."""
    junk = lambda x: x.rlike(JUNK_LINES[0]) | x.rlike(JUNK_LINES[1]) | x.rlike(JUNK_LINES[2])
    edge = lambda i, n: (i == 0) | (i == n - 1)
    filled = lambda pieces: F.filter(F.transform(pieces, strip), lambda x: x != "")
    content = lambda lines: F.filter(lines, lambda x, i: ~(edge(i, F.size(lines)) & x.rlike(r"^\d{1,4}$")) & ~junk(x))
    kept = let(F.split(composed(text), "\n"), lambda pieces: let(filled(pieces), content))
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"(?U)(\w)-\n(\w)", "$1$2")
    return strip(F.regexp_replace(joined, r"(?U)\s+", " "))


def citation_density(text: Column) -> Column:
    """Weighted citation markers a word."""
    marks = sum((F.regexp_count(text, F.lit(p)) * w for p, w in CITATION_MARKERS), F.lit(0))
    return marks / F.greatest(F.lit(1), F.size(words(text)))


def is_reference(text: Column, threshold: float = REFERENCE_DENSITY) -> Column:
    return citation_density(text) >= threshold


def share(items: Column, holds) -> Column:
    """Share of an array's items for which ``holds``; null for an empty array."""
    return F.size(F.filter(items, holds)) / F.when(F.size(items) > 0, F.size(items))


def table_like(tokens: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(share(tokens, lambda t: t.rlike(TABLE_TOKEN)) >= threshold, F.lit(False))


def let(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def has_table(text: Column, window: int = 20, stride: int = 5) -> Column:
    """Some window of tokens is mostly table cells; a shorter text is taken whole."""

    def judge(cells: Column) -> Column:
        n = F.size(cells)
        full = lambda part: F.size(F.filter(part, lambda c: c)) * 2 >= F.size(part)
        windows = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(stride))
        return F.when(n < window, (n > 0) & full(cells)).otherwise(F.exists(windows, lambda i: full(F.slice(cells, i + 1, F.lit(window)))))

    return let(F.transform(words(text), lambda t: t.rlike(TABLE_TOKEN)), judge)


def is_prose(text: Column) -> Column:
    tokens = words(text)
    return (F.size(tokens) >= 80) & (F.coalesce(share(tokens, lambda t: t.rlike(r"^[A-Za-z][A-Za-z\-]{2,}$")), F.lit(0.0)) > 0.55)


def looks_standalone(question: Column) -> Column:
    leans = F.lit(False)
    for phrase in LEANING_PHRASES:
        leans = leans | F.lower(question).contains(phrase)
    return (F.size(words(question)) >= 5) & ~leans


def plain_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_text(text: Column) -> Column:
    """A text whose runs of a-z and 0-9 are, with aliases resolved, its search_tokens(): composed by compatibility, in small letters, name-number joined."""
    lowered = F.lower(composed(text))
    return F.when(F.contains(lowered, F.lit("-")), F.regexp_replace(lowered, r"\b([a-z]+)-(\d+)\b", "$1$2")).otherwise(lowered)


def search_tokens(text: Column) -> Column:
    """Tokens of the lexical index: composed by compatibility, name-number joined, aliases resolved."""
    aliases = F.create_map(*[F.lit(x) for pair in TOKEN_ALIASES.items() for x in pair])
    return F.transform(F.regexp_extract_all(token_text(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.coalesce(F.try_element_at(aliases, t), t))


def present(value: Column) -> Column:
    """Null for an empty string."""
    return F.when(value != "", value)


def index_text(title: Column, table_note: Column, figure_note: Column, text: Column, contextual: bool = True) -> Column:
    return F.concat_ws("\n", *([present(title)] if contextual else []), present(table_note), present(figure_note), text)


def pages_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("p."), first.cast("string"))).otherwise(F.concat(F.lit("pp."), first.cast("string"), F.lit("-"), last.cast("string")))


def source_tag(n: Column, paper: Column, year: Column, title: Column, first: Column, last: Column) -> Column:
    """S{n}: paper (year) "title", pages; absent parts are left out."""
    dated = F.coalesce(F.concat(F.lit(" ("), present(year), F.lit(")")), F.lit(""))
    titled = F.coalesce(F.concat(F.lit(' "'), present(title), F.lit('"')), F.lit(""))
    return F.concat(F.lit("S"), n.cast("string"), F.lit(": "), paper, dated, titled, F.lit(", "), pages_label(first, last))


def normalize_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"【\s*(S\d+)[^】]*】", "[$1]")


def cited_sources(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))))


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\[S\d+\]", "")


def is_refusal(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit(REFUSAL.rstrip(".").lower()))


def small_talk(text: Column) -> Column:
    """about, thanks, greeting or null."""
    said = strip(text)
    return F.when(said.rlike(ABOUT), "about").when(said.rlike(SMALL_TALK), F.when(said.rlike(THANKS), "thanks").otherwise("greeting"))


def is_value_cell(cell: Column) -> Column:
    return cell.rlike(r"\d") & ~F.regexp_replace(cell, r"\bN/?A\b", "").rlike("[A-Za-z]")


def keyword_pattern(keyword: str) -> str:
    """Case-insensitive; letters and digits may be set apart by a space or hyphen."""
    import re

    return "(?i)" + r"[\s\-]?".join(re.findall(r"[A-Za-z]+|\d+", keyword))


def normal_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s?.!]+", " "))


def clean_rewrite(raw: Column, fallback: Column, max_ratio: float = 4.0) -> Column:
    """First usable line of a rewritten question, or the question itself."""
    bare = lambda x: strip(F.regexp_replace(strip(F.regexp_replace(strip(x), r"(?i)^(standalone question|question|rewritten)\s*:\s*", "")), "^[\"']+|[\"']+$", ""))
    first = F.get(F.filter(F.transform(F.split(raw, "\n"), bare), lambda x: x != ""), F.lit(0))
    answered = (F.length(first) > F.greatest(F.lit(200), F.length(fallback) * max_ratio)) | (normal_question(first) == normal_question(fallback))
    return F.when(first.isNull() | answered, fallback).otherwise(first)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def paper_id(raw: Column) -> Column:
    """An id without comment, address and version."""
    bare = strip(F.element_at(F.split(raw, "#"), 1))
    return F.regexp_replace(F.regexp_replace(bare, r"^.*/(?:abs|pdf)/", ""), r"(\.pdf)?$|v\d+(\.pdf)?$", "")


def paper_file(paper: Column) -> Column:
    return F.replace(F.regexp_replace(paper, r"v\d+$", ""), F.lit("/"), F.lit("_"))


def chosen_title(meta: Column, first_page: Column, stem: Column) -> Column:
    """The metadata's title unless it is junk, else the first usable line, else the file's name."""
    held = strip(F.coalesce(meta, F.lit("")))
    junk = F.lit(False)
    for j in JUNK_TITLES:
        junk = junk | F.lower(held).contains(j)
    usable = F.filter(F.transform(F.split(F.coalesce(first_page, F.lit("")), "\n"), strip), lambda x: (F.length(x) > 8) & ~x.rlike(r"^[\d\W]+$") & ~F.lower(x).contains("arxiv"))
    return F.when((F.length(held) > 3) & ~junk, F.substring(held, 1, 150)).otherwise(F.coalesce(F.substring(F.get(usable, F.lit(0)), 1, 150), stem))


def history_text(answer: Column, most: int = 700) -> Column:
    """An earlier answer, cut at a word where it is too long."""
    bare = strip(strip_citations(answer))
    cut = F.regexp_replace(F.substring(bare, 1, most), r"(?s) [^ ]*$", "")
    return F.when(F.length(bare) > most, F.concat(cut, F.lit(" ..."))).otherwise(bare)


def chunk_name(doc: Column, index: Column) -> Column:
    """The id of a document's chunk: its number in four digits at least."""
    return F.format_string("%s__%04d", doc, index)


#: fixed values: names of files that may be asked for
FIGURE_FILE, RESULT_FILE = r"^[A-Za-z0-9._:-]+\.png$", r"^[a-z0-9_]+\.png$"


def safe_file(name: Column, allowed: str = FIGURE_FILE) -> Column:
    """Whether a name is one of the allowed form, so that it leads to no other folder."""
    return F.coalesce(name.rlike(allowed) & ~name.rlike(r"[\r\n]"), F.lit(False))


def set_filename(name: Column) -> Column:
    """The file name of a data set's name."""
    return F.replace(name, F.lit("/"), F.lit("__"))


def overlap_merged(first: Column, second: Column, least: int = 20) -> Column:
    """Two texts joined over the longest end of the one that begins the other, or by a space."""
    most = F.least(F.length(first), F.length(second))
    fits = F.filter(F.sequence(F.lit(least), F.greatest(most, F.lit(least))), lambda n: (n <= most) & (F.right(first, n) == F.left(second, n)))
    n = F.array_max(fits)
    return F.when(n.isNull(), F.concat(first, F.lit(" "), second)).otherwise(F.concat(first, F.substring(second, n + 1, F.length(second))))


def json_object(text: Column) -> Column:
    """What lies between the first { and the last }, if that is JSON."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(present(inner)).isNotNull(), inner)


# fixed values: the names of errors and what tells them
def error_class(message: Column) -> Column:
    return (
        F.when(message.contains("429") | message.contains("RESOURCE_EXHAUSTED"), "rate_limit")
        .when(message.contains("404") | message.contains("NOT_FOUND"), "unknown_model")
        .when(message.rlike(r"^\s*50[0234]\b|\b(UNAVAILABLE|INTERNAL)\b"), "server_error")
        .when(message.rlike("(ConnectError|ConnectTimeout|ReadTimeout|ReadError|WriteError|RemoteProtocolError|SSLError|TimeoutError|ConnectionError|ConnectionResetError)"), "network_error")
        .otherwise("other")
    )


def markdown_rows(markdown: Column) -> Column:
    """The cells of a Markdown table, a row each, without the rule below the header."""
    lines = F.filter(F.split(strip(markdown), "\n"), lambda x: x.contains("|"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^\||\|$", ""), r"\|"), strip))
    rule = lambda row: F.forall(F.filter(row, lambda c: c != ""), lambda c: c.rlike(r"^:?-{2,}:?$")) & F.exists(row, lambda c: c != "")
    return F.filter(cells, lambda row: ~rule(row))


def number_counts(texts: Column) -> Column:
    """Each number of a text once, with how often it stands there."""
    found = F.regexp_extract_all(texts, F.lit(NUMBER), F.lit(0))
    return F.transform(F.array_distinct(found), lambda n: F.struct(n.alias("number"), F.size(F.filter(found, lambda x: x == n)).alias("n")))


# fixed values in the next functions: the reasons and the names of errors that they give
def check_markdown(markdown: Column, source: Column) -> Column:
    """Why a rebuilt table cannot be shown; an empty string if it can."""
    rows = markdown_rows(markdown)
    width = F.size(F.get(rows, F.lit(0)))
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    ragged = F.size(F.filter(body, lambda r: F.size(r) != width))
    values = F.array_join(F.filter(F.flatten(body), is_value_cell), " ")
    counts = number_counts(values)
    held = F.regexp_extract_all(source, F.lit(NUMBER), F.lit(0))
    invented = F.filter(counts, lambda c: c["n"] > F.size(F.filter(held, lambda x: x == c["number"])))
    return (
        F.when(F.size(rows) < 2, "fewer than one header and one data row")
        .when(width < 2, "only one column")
        .when(ragged > 0, F.concat(ragged.cast("string"), F.lit(" row(s) with a different number of cells than the header")))
        .when(F.size(counts) == 0, "no numbers in the table body")
        .when(F.size(invented) > 0, F.concat(F.lit("numbers not in the source text: "), F.array_join(F.slice(F.transform(invented, lambda c: c["number"]), 1, 5), ", ")))
        .otherwise("")
    )


def grid_values(markdown: Column) -> Column:
    """The numeric cells below the two head lines of a table."""
    lines = F.split(markdown, "\n")
    body = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    cells = F.flatten(F.transform(body, lambda x: F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|")))
    return F.filter(F.transform(cells, strip), lambda c: c.rlike(r"^[±+\-]?\d"))


def numeric_share(cells: Column) -> Column:
    body = F.filter(F.transform(cells, strip), lambda c: c != "")
    return F.coalesce(share(body, lambda c: c.rlike(r"^[±+\-]?\d")), F.lit(0.0))


def grid_markdown(grid: Column) -> Column:
    """A grid (array of rows) as a Markdown table."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    rule = F.transform(F.get(grid, F.lit(0)), lambda _: F.lit("---"))
    return F.array_join(F.concat(F.array(line(F.get(grid, F.lit(0)))), F.array(line(rule)), F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), line)), "\n")


def merged_header(grid: Column) -> Column:
    """A grid whose second row, if it has no numbers, is folded into the first."""
    first, second = F.get(grid, F.lit(0)), F.get(grid, F.lit(1))
    header = F.zip_with(first, second, lambda a, b: strip(F.concat_ws(" ", present(a), present(b))))
    folds = (F.size(grid) >= 3) & (numeric_share(F.coalesce(second, F.array().cast("array<string>"))) == 0)
    return F.when(folds, F.concat(F.array(header), F.slice(grid, 3, F.greatest(F.size(grid) - 2, F.lit(0))))).otherwise(grid)


def grid_reason(grid: Column, least_rows: int = 3, least_columns: int = 2, least_numeric: float = 0.3) -> Column:
    """Why a grid is no table of results; an empty string if it is one."""
    width = F.size(F.get(grid, F.lit(0)))
    body = F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0)))
    numeric = numeric_share(F.flatten(body))
    hollow = F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda j: ~F.exists(body, lambda r: strip(F.get(r, j)) != ""))
    return (
        F.when(F.size(grid) < least_rows, F.concat(F.size(grid).cast("string"), F.lit(f" row(s), needs {least_rows}")))
        .when(width < least_columns, F.concat(width.cast("string"), F.lit(f" column(s), needs {least_columns}")))
        .when(numeric < least_numeric, F.concat(F.lit("only "), F.round(numeric * 100).cast("int").cast("string"), F.lit(f"% of cells look like values, needs {least_numeric:.0%}")))
        .when(F.size(hollow) > 0, F.concat(F.lit("column "), (F.get(hollow, F.lit(0)) + 1).cast("string"), F.lit(" is empty in every row")))
        .otherwise("")
    )


TABLES_JSON = "struct<tables:array<struct<caption:string,description:string,markdown:string>>>"


def reply_tables(reply: Column) -> Column:
    """The tables of a model's reply, structs of caption, description and markdown; null if it follows no format.

    Blocks are parted at their marker lines (emphasised or numbered as may be); fields without a marker are one
    block; JSON is taken as well; a reply that says there are no tables has none.
    """
    bare = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?m)^\s*```.*$", "")
    parts = F.split(bare, r"(?im)^[\W_]*(?:TABLE(?:\s*\d+)?|END)[\W_]*$")
    field = lambda part, name, more: one_spaced(F.regexp_extract(part, rf"(?ims)^[\W_]*{name}[\W_]*:[ *_]*(.*?){more}", 1))
    ends = r"(?=^[\W_]*(?:CAPTION|DESCRIPTION|GRID)[\W_]*:|^\s*\||\z)"

    def block(part: Column) -> Column:
        grid = F.array_join(F.transform(F.regexp_extract_all(part, F.lit(r"(?m)^\s*(\|.*)$"), F.lit(1)), strip), "\n")
        return F.struct(field(part, "CAPTION", r"$").alias("caption"), field(part, "DESCRIPTION", ends).alias("description"), grid.alias("markdown"))

    filled = F.filter(F.transform(parts, block), lambda b: (b["caption"] != "") | (b["description"] != "") | (b["markdown"] != ""))
    from_json = F.from_json(json_object(bare), TABLES_JSON)["tables"]
    none = F.array().cast("array<struct<caption:string,description:string,markdown:string>>")
    return F.when(from_json.isNotNull(), from_json).when(F.size(filled) > 0, filled).when(F.upper(bare).contains("NO TABLES"), none)
