"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The patterns find assigned secrets, access keys and long hexadecimal strings; their spans always stay. Of the
other long strings without white space, those go with them that a first-order Markov model of random
strings explains better than one of ordinary identifiers, by ``MARGIN`` nats a character. Both models are
trained on labelled samples: random strings drawn from digests in several alphabets, and ordinary
identifiers: words of at most ``SAMPLE_DOCS`` documents, and names joined from a word list.

All of it is DataFrame functions. Only the counts of the models' character pairs, 68 x 68 a model, reach
the driver.

Defined cases: null and empty texts have no spans and the digest of an empty string; overlapping spans of
different kinds all stay, ordered by start and then kind; of added strings, those that overlap a span of the
patterns are dropped; texts with very many matches take time in proportion to them (but for the search of
characters' places in ``redact``); repeated rows give repeated rows; an empty table gives an empty result (the word list
still trains the model); further columns are passed on, but for ones named base_spans or all_spans, which give way.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# fixed values: the patterns, the group whose length counts, and its least length
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 12, ASSIGN.replace("=-]+)", "=-]{12,})")),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18, "AKIA[A-Z0-9]{14,}"),  # AKIA[A-Z0-9]+ of 18 characters or more
    ("hex", "[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),  # [0-9a-f]+ of 16 characters or more: runs are matched whole
)
ADDED = "random"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=^"
MARGIN = 0.6
#: Bounds of the labelled sample: random strings, documents whose words are ordinary, names from the list.
SAMPLE_STRINGS, SAMPLE_DOCS, SAMPLE_NAMES = 4_000, 400, 4_000
WORDS = "get set add list value name user item count index file path read write open close start stop node tree map key data table row column query plan merge sort hash page line text word token block buffer stream event state time date size length width height color image model view control service client server request response handler manager factory builder config option default error message test case result output input source target parent child first last next previous max min sum total average update delete insert create remove find search filter group order limit offset join left right inner outer main help version build deploy release branch commit change issue review license copyright".split()

SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"
SAID = "array<struct<start:bigint,kind:int,stop:bigint,said:string>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once: lambdas work out anew what stands outside of them."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column], run: int = 128) -> Column:
    """For each of the longs, ``join`` of all before it, from ``zero``.

    Appending to an array copies it, so this goes by runs of elements: first over the runs, then within each.
    """
    none = F.array().cast("array<bigint>")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def before(own: Column, start: Column) -> Column:
        return F.aggregate(own, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def cut(whole: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(whole) / run).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(whole, i * run + 1, run))

    def over(runs: Column) -> Column:
        totals = F.transform(runs, lambda own: F.aggregate(own, zero, lambda a, x: join(a, x)))
        return F.flatten(F.zip_with(runs, before(totals, zero), before))

    return _let(values, lambda whole: _let(cut(whole), over))


def _spans(text: Column, kind: int, pattern: str, group: int, least: int, said: bool = False) -> Column:
    """Spans of all matches whose group is long enough, from what lies between the matches; with ``said``, their strings too."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(F.arrays_zip(found.alias("m"), judged.alias("g")), gaps, lambda m, gap: F.struct(F.length(gap).cast("long").alias("gap"), F.length(m["m"]).cast("long").alias("size"), F.length(m["g"]).alias("judged"), m["m"].alias("said")))

    def placed(rows: Column) -> Column:
        starts = running(F.transform(rows, lambda r: F.coalesce(r["gap"] + r["size"], F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)

        def span(r: Column, at: Column) -> Column:
            start = at + r["gap"]
            told = [start.alias("start"), F.lit(kind).alias("kind"), (start + r["size"]).alias("stop")]
            return F.struct(*told, *([r["said"].alias("said")] if said else [r["judged"].alias("judged")]))

        spans = F.zip_with(rows, starts, span)
        if said:
            return F.filter(spans, lambda s: F.length(s["said"]) >= least)
        long = F.filter(spans, lambda s: s["judged"] >= least)  # what follows the last match has no length
        return F.transform(long, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))

    return _let(rows, placed)


def apart(base: Column, others: Column) -> Column:
    """Those of ``others`` (start, kind, stop, said) that overlap no span of ``base``."""
    far = F.lit(1 << 60)
    zero = F.lit(0).cast("long")
    as_base = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.lit(None).cast("string").alias("said")))

    def judged(spans: Column) -> Column:
        stops = running(F.transform(spans, lambda s: F.when(s["said"].isNull(), s["stop"]).otherwise(zero)), zero, F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["said"].isNull(), s["start"]).otherwise(far))), far, F.least))
        around = F.zip_with(spans, F.arrays_zip(stops.alias("a"), starts.alias("b")), lambda s, r: F.struct(s.alias("s"), (s["said"].isNotNull() & (r["a"] <= s["start"]) & (s["stop"] <= r["b"])).alias("free")))
        return F.transform(F.filter(around, lambda x: x["free"]), lambda x: x["s"])

    return _let(F.array_sort(F.concat(as_base, others)), judged)


def spans_of(text: Column, kind: int, pattern: str, group: int, least: int, hint: str) -> Column:
    """As _spans; texts in which ``hint`` (needed for any match to count) isn't found are passed over."""
    return F.when(text.rlike(hint), _spans(text, kind, pattern, group, least)).otherwise(F.array().cast(SPAN))


def _pair_counts(strings: DataFrame) -> dict[str, int]:
    """How often each pair of characters stands in the strings, ^ before the first."""
    led = F.concat(F.lit("^"), F.col("string"))
    pairs = strings.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("string")), lambda i: F.substring(led, i, F.lit(2)))).alias("pair"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 68 x 68


def labelled_sample(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Random strings and ordinary identifiers, each a column ``string``."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("corvane"), F.col("id").cast("string")).cast("binary"), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    shapes = F.array(F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)), F.substring(base64, 1, 40), F.regexp_replace(F.substring(base64, 1, 60), "[+/=]", ""), F.translate(F.substring(base64, 1, 44), "+/", "-_"))
    rand = spark.range(SAMPLE_STRINGS).select(F.element_at(shapes, (F.col("id") % 5 + 1).cast("int")).alias("string"))

    chosen = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    texts = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")  # at most SAMPLE_DOCS ids
    own = texts.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z][A-Za-z_-]*"), F.lit(0))).alias("string"))
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    joined = F.array(F.concat_ws("_", pick(1), pick(2), pick(3)), F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3))), F.concat_ws("-", pick(1), pick(2), pick(3)), F.concat_ws("/", pick(1), pick(2), pick(3)), F.upper(F.concat_ws("_", pick(1), pick(2))))
    names = spark.range(SAMPLE_NAMES).select(F.element_at(joined, (F.col("id") % 5 + 1).cast("int")).alias("string"))
    return rand, own.unionByName(names)


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of all pairs of ALPHABET, row by row."""
    models = []
    for strings in labelled_sample(docs):
        counts = _pair_counts(strings)
        logs = []
        for a in ALPHABET:
            row = [counts.get(a + b, 0) + 0.5 for b in ALPHABET[:-1]]
            logs += [math.log(x / sum(row)) for x in row] + [0.0]
        models.append(logs)
    return [r - i for r, i in zip(*models, strict=True)]


def ratio(string: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio a character of a string over ALPHABET."""
    held = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    chars = F.regexp_extract_all(F.concat(F.lit("^"), string), F.lit("(?s)."), F.lit(0))
    places = F.transform(chars, lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    n = F.length(string)
    # the places are worked out once: bound as the only element of an array
    terms = F.flatten(F.transform(F.array(places), lambda p: F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: F.element_at(held, (a - 1) * len(ALPHABET) + b))))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / n


def scan(docs: DataFrame, model: list[float] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans`` (start, kind, stop; code points, end exclusive)."""
    model = model or train(docs)
    whole = F.coalesce(F.col(text), F.lit(""))
    base = [spans_of(whole, k, pattern, group, least, hint) for k, (_, pattern, group, least, hint) in enumerate(BASE)]
    with_base = docs.withColumn("base_spans", F.array_sort(F.concat(*base)))
    found = F.when(whole.rlike(CANDIDATE), _spans(whole, len(BASE), CANDIDATE, 0, 20, said=True)).otherwise(F.array().cast(SAID))
    random = F.filter(found, lambda c: ratio(c["said"], model) > MARGIN)
    held = "_random"
    while held in docs.columns:
        held += "_"
    kept = F.transform(F.when(F.size(held) > 0, apart(F.col("base_spans"), F.col(held))).otherwise(F.array().cast(SAID)), lambda s: s.dropFields("said"))
    return with_base.withColumn(held, random).withColumn("all_spans", F.array_sort(F.concat("base_spans", kept))).drop(held)


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(b[0]) for b in BASE], F.lit(ADDED))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the scan replaced by ``mark``; overlapping spans are replaced as one."""
    scanned = scan(docs, text=text)
    whole = F.col(text)
    spans = F.col("all_spans")
    tops = running(F.transform(spans, lambda s: s["stop"]), F.lit(0).cast("long"), F.greatest)

    def piece(s: Column, top: Column) -> Column:
        before = F.substring(whole, (top + 1).cast("int"), (s["start"] - top).cast("int"))
        return F.when(s["start"] < top, F.lit("")).otherwise(F.concat(before, F.lit(mark)))

    rest = F.substring(whole, (F.array_max(F.transform(spans, lambda s: s["stop"])) + 1).cast("int"), F.lit(2147483647))
    clean = F.concat(F.array_join(F.zip_with(spans, tops, piece), ""), rest)
    return scanned.withColumn(text, F.when(F.size("all_spans") > 0, clean).otherwise(whole)).drop("base_spans", "all_spans")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all ``documents``."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{b[0]}") for k, b in enumerate(BASE)], F.sha2(_joined("base_spans").cast("binary"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"))
