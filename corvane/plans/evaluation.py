"""Retrieval metrics, sweeps, intervals and abstention: their queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.operators import retrieval_metrics as M
from corvane.operators import statistics as S
from corvane.operators.index import containing
from corvane.plans.retrieval import SWEEP, sql_search, sql_swept
from corvane.plans.search import CONFIGS, corpus, search
from corvane.plans.sweep import sweep_apart
from corvane.session import Fixture, stored, table, written

LABELS = "labels_ AS (SELECT item_id AS qid, doc_id AS chunk_id, 1.0::DOUBLE AS gain FROM benchmark b JOIN documents d ON contains(d.text, b.text)), queries_ AS (SELECT item_id AS qid, CASE item_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'exact_term' ELSE 'multi_paper' END AS category FROM benchmark)"
KS = (1, 3, 5, 10)
NAMES = ["mrr", *[f"{m}_{k}" for k in KS for m in ("recall", "precision", "success", "ndcg")]]


def labels(spark, sf_dir):
    """The documents that hold a benchmark passage are relevant to it; kept for all queries over the same files."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    make = lambda: written(containing(docs, passages, corpus(spark, sf_dir).index), "labels")
    return stored(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("documents", "benchmark")], "labels", make, lambda rows: [rows])


def questions(spark, sf_dir):
    category = F.when(F.col("item_id") % 3 == 0, "semantic").when(F.col("item_id") % 3 == 1, "exact_term").otherwise("multi_paper")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), category.alias("category"))


def sql_metrics(rankings: str = "final", by: str = "qid", apart: bool = False) -> str:
    """CTE ``metrics`` from ``rankings`` (by, chunk_id, rank), ``labels_`` and ``judged_`` (by, to be judged); ``apart``: by their cutoff."""
    searched = lambda k: f" AND cutoff = {k}" if apart else ""
    ks = ", ".join(
        f"CASE WHEN n_relevant > 0 THEN coalesce(hits_{k}, 0) / n_relevant END AS recall_{k}, CASE WHEN n_relevant > 0 THEN coalesce(hits_{k}, 0) / {k} END AS precision_{k}, CASE WHEN n_relevant > 0 THEN (coalesce(hits_{k}, 0) > 0)::INT::DOUBLE END AS success_{k}, CASE WHEN n_relevant > 0 THEN coalesce(dcg_{k}, 0) / list_sum(list_transform(ideal[1:{k}], lambda g, i: g / log2(i + 1))) END AS ndcg_{k}"
        for k in KS
    )
    marks = ", ".join(f"count(*) FILTER (WHERE rank <= {k} AND gain > 0{searched(k)}) AS hits_{k}, sum(gain / log2(rank + 1)) FILTER (WHERE rank <= {k}{searched(k)}) AS dcg_{k}" for k in KS)
    return f"""rel AS (SELECT qid, count(*) FILTER (WHERE gain > 0) AS n_relevant, list(gain ORDER BY gain DESC) AS ideal FROM labels_ GROUP BY qid),
found AS (SELECT {by}, min(rank) FILTER (WHERE gain > 0{searched(max(KS))}) AS first, {marks} FROM {rankings} LEFT JOIN labels_ USING (qid, chunk_id) GROUP BY {by}),
metrics AS (SELECT {by}, coalesce(n_relevant, 0) AS n_relevant, CASE WHEN n_relevant > 0 THEN coalesce(1 / first, 0) END AS mrr, {ks} FROM judged_ LEFT JOIN rel USING (qid) LEFT JOIN found USING ({by}))"""


def metrics(spark, sf_dir, config="bm25"):
    c = corpus(spark, sf_dir)
    return M.per_query(search(c, CONFIGS[config]), labels(spark, sf_dir), questions(spark, sf_dir), ["qid"])


def sql_one(config: str = "bm25") -> str:
    return f"{sql_search(CONFIGS[config])}, {LABELS}, judged_ AS (SELECT qid FROM queries_), {sql_metrics()}"


def _metric(key: str, names: list[str]):
    cut = ", ".join(f"round({n}, 9) AS {n}" for n in names)

    @query(key, f"{sql_one()} SELECT qid, {cut} FROM metrics")
    def run(spark, sf_dir):
        return metrics(spark, sf_dir).select("qid", *[F.round(n, 9).alias(n) for n in names])

    return run


recall_at_k = _metric("recall_at_k", [f"recall_{k}" for k in KS])
precision_at_k = _metric("precision_at_k", [f"precision_{k}" for k in KS])
mrr = _metric("mrr", ["mrr"])
ndcg_at_k = _metric("ndcg_at_k", [f"ndcg_{k}" for k in KS])
success_at_k = _metric("success_at_k", [f"success_{k}" for k in KS])


@query("evaluate_query", f"{sql_one('hybrid_rerank')} SELECT qid, n_relevant, {', '.join(f'round({n}, 9) AS {n}' for n in NAMES)} FROM metrics")
def evaluate_query(spark, sf_dir):
    return metrics(spark, sf_dir, "hybrid_rerank").select("qid", "n_relevant", *[F.round(n, 9).alias(n) for n in NAMES])


GRADED = Fixture("qid string, chunk_id string, rank int, gain double", [("q1", "a", 1, 3.0), ("q1", "b", 2, 0.0), ("q1", "c", 3, 2.0), ("q1", "d", None, 1.0), ("q2", "a", 1, 0.0), ("q2", "e", None, 1.0)], per="pages", ids="qid")


@query(
    "ndcg_graded",
    f"WITH g AS (SELECT * FROM {GRADED.sql}), i AS (SELECT qid, sum(gain / log2(n + 1)) AS best FROM (SELECT qid, gain, row_number() OVER (PARTITION BY qid ORDER BY gain DESC) AS n FROM g) WHERE n <= 3 GROUP BY qid) SELECT g.qid, round(coalesce(sum(gain / log2(rank + 1)) FILTER (WHERE rank <= 3), 0) / any_value(best), 9) AS ndcg_3 FROM g JOIN i ON i.qid = g.qid GROUP BY g.qid",
)
def ndcg_graded(spark, sf_dir):
    rows = GRADED.frame(spark, sf_dir)
    out = M.per_query(rows.where("rank is not null").select("qid", "chunk_id", "rank"), rows.select("qid", "chunk_id", "gain"), rows.select("qid"), ["qid"], (3,))
    return out.select("qid", F.round("ndcg_3", 9).alias("ndcg_3"))


_ALL = " UNION ALL ".join(f"SELECT '{name}' AS config, * FROM ({sql_swept(c)} SELECT * FROM final)" for name, c in CONFIGS.items())
_CONFIGS = ", ".join(f"('{c}')" for c in CONFIGS)
_JUDGED = f"{LABELS}, judged_ AS (SELECT config, qid FROM queries_ CROSS JOIN (VALUES {_CONFIGS}) AS v(config))"
SWEPT = f"{SWEEP}, runs AS MATERIALIZED ({_ALL}), {_JUDGED}, {sql_metrics('runs', 'config, qid')}"
_EACH = " UNION ALL ".join(f"SELECT '{name}' AS config, {k} AS cutoff, * FROM ({sql_swept(c, k)} SELECT * FROM final)" for name, c in CONFIGS.items() for k in KS)
#: As SWEPT, with a search for each k.
SWEPT_APART = f"{SWEEP}, runs AS MATERIALIZED ({_EACH}), {_JUDGED}, {sql_metrics('runs', 'config, qid', True)}"


def _swept(spark, sf_dir, what, make):
    return stored(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("documents", "embeddings", "benchmark")], what, make, lambda rows: [rows])


def searches(spark, sf_dir):
    """config, cutoff, qid, chunk_id, score, rank of a search for each k under every configuration; kept for all queries over the same files."""
    return _swept(spark, sf_dir, "sweep-runs", lambda: written(sweep_apart(corpus(spark, sf_dir), CONFIGS, KS), "sweep-runs"))


def sweep(spark, sf_dir, apart=False):
    """config, qid, category, top_score and the metrics of every query under every configuration; kept for all queries over the same files.

    With ``apart`` the metrics at k are those of a search for k; without, of the k first of a search for the largest k.
    """

    def make():
        runs = searches(spark, sf_dir)
        deepest = runs.where(F.col("cutoff") == max(KS))
        asked = questions(spark, sf_dir).withColumn("config", F.explode(F.array(*[F.lit(n) for n in CONFIGS])))
        top = deepest.where("rank = 1").select("config", "qid", F.col("score").alias("top_score"))
        by = ["config", "qid"]
        told = M.per_query(runs, labels(spark, sf_dir), asked, by, KS, "cutoff") if apart else M.per_query(deepest, labels(spark, sf_dir), asked, by)
        return written(told.join(asked, by).join(top, by, "left"), "sweep-metrics")

    return _swept(spark, sf_dir, "sweep-apart" if apart else "sweep", make)


def rounded(rows, names, digits=9):
    return rows.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in rows.columns])


_MEANS = ", ".join(f"round(avg({n}), 9) AS {n}" for n in NAMES)


@query("eval_sweep", f"{SWEPT_APART} SELECT config, qid, n_relevant, round(mrr, 9) AS mrr, round(recall_5, 9) AS recall_5, round(ndcg_5, 9) AS ndcg_5 FROM metrics")
def eval_sweep(spark, sf_dir):
    """Every query under every configuration, each k a search of its own."""
    return rounded(sweep(spark, sf_dir, apart=True).select("config", "qid", "n_relevant", "mrr", "recall_5", "ndcg_5"), ["mrr", "recall_5", "ndcg_5"])


@query("eval_summary", f"{SWEPT} SELECT config, count(*) AS n, {_MEANS} FROM metrics WHERE n_relevant > 0 GROUP BY config")
def eval_summary(spark, sf_dir):
    return rounded(M.means(sweep(spark, sf_dir).where("n_relevant > 0"), ["config"], NAMES), NAMES)


@query("summary_by_category", f"{SWEPT} SELECT config, category, count(*) AS n, {_MEANS} FROM metrics JOIN queries_ USING (qid) WHERE n_relevant > 0 GROUP BY GROUPING SETS ((config), (config, category))")
def summary_by_category(spark, sf_dir):
    """Means by configuration, and by configuration and category (null: all)."""
    rows = sweep(spark, sf_dir).where("n_relevant > 0")
    sets = rows.groupingSets([["config"], ["config", "category"]], "config", "category")
    return sets.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), 9).alias(n) for n in NAMES])


@query("recall_pivot", f"{SWEPT}, r AS (SELECT config, category, recall_5 FROM metrics JOIN queries_ USING (qid)) SELECT config, {', '.join(f'''round(avg(recall_5) FILTER (WHERE category = '{c}'), 9) AS {c}''' for c in ('exact_term', 'multi_paper', 'semantic'))} FROM r GROUP BY config")
def recall_pivot(spark, sf_dir):
    return rounded(sweep(spark, sf_dir).groupBy("config").pivot("category", ["exact_term", "multi_paper", "semantic"]).agg(F.avg("recall_5")), ["exact_term", "multi_paper", "semantic"])


@query("summary_melt", f"{SWEPT}, m AS (SELECT config, avg(recall_5) AS recall_5, avg(ndcg_5) AS ndcg_5, avg(mrr) AS mrr FROM metrics GROUP BY config) SELECT config, metric, round(value, 9) AS value FROM m UNPIVOT (value FOR metric IN (recall_5, ndcg_5, mrr))")
def summary_melt(spark, sf_dir):
    means = M.means(sweep(spark, sf_dir), ["config"], ["recall_5", "ndcg_5", "mrr"]).drop("n")
    return rounded(means.unpivot("config", ["recall_5", "ndcg_5", "mrr"], "metric", "value"), ["value"])


@query("relative_vs_baseline", f"{SWEPT}, m AS (SELECT config, avg(recall_5) AS r FROM metrics GROUP BY config) SELECT config, round(100 * (r / nullif((SELECT r FROM m WHERE config = 'dense'), 0) - 1), 6) AS change FROM m WHERE config <> 'dense'")
def relative_vs_baseline(spark, sf_dir):
    means = M.means(sweep(spark, sf_dir), ["config"], ["recall_5"])
    base = means.where("config = 'dense'").select(F.col("recall_5").alias("_base"))
    return means.where("config <> 'dense'").crossJoin(F.broadcast(base)).select("config", F.round(100 * (F.col("recall_5") / F.nullif(F.col("_base"), F.lit(0.0)) - 1), 6).alias("change"))  # one row


@query("paired_delta", f"{SWEPT} SELECT c.config, c.qid, round(c.recall_5 - b.recall_5, 9) AS recall_5, round(c.mrr - b.mrr, 9) AS mrr FROM metrics c JOIN metrics b ON b.qid = c.qid AND b.config = 'dense' WHERE c.config <> 'dense' AND c.n_relevant > 0")
def paired_delta(spark, sf_dir):
    return rounded(deltas(spark, sf_dir), ["recall_5", "mrr"])


def deltas(spark, sf_dir):
    rows = sweep(spark, sf_dir).where("n_relevant > 0").select("config", "qid", "recall_5", "mrr")
    base = rows.where("config = 'dense'").select("qid", F.col("recall_5").alias("_r"), F.col("mrr").alias("_m"))
    return rows.where("config <> 'dense'").join(base, "qid").select("config", "qid", (F.col("recall_5") - F.col("_r")).alias("recall_5"), (F.col("mrr") - F.col("_m")).alias("mrr"))


SCORED = "s AS (SELECT doc_id, CAST(n_chars % 97 AS DOUBLE) AS score, n_chars % 97 + quality * 40 > 60 AS answerable FROM labels JOIN documents USING (doc_id))"


def scored(spark, sf_dir):
    """Synthetic scores of labelled documents, with ties."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", (F.col("n_chars") % 97).cast("double").alias("score"), (F.col("n_chars") % 97 + F.col("quality") * 40 > 60).alias("answerable"))


@query("abstention_metrics", f"WITH {SCORED} SELECT round(avg(((score >= 50) = answerable)::INT), 9) AS accuracy, round(avg((score >= 50)::INT) FILTER (WHERE NOT answerable), 9) AS false_answer, round(avg((score < 50)::INT) FILTER (WHERE answerable), 9) AS false_abstain FROM s")
def abstention_metrics(spark, sf_dir):
    return rounded(M.abstention(scored(spark, sf_dir).withColumn("answered", F.col("score") >= 50), []), ["accuracy", "false_answer", "false_abstain"])


def sql_auroc(source: str, score: str, positive: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"SELECT {g}sum(CASE WHEN p THEN r END) FILTER (WHERE p) AS x, (sum(r) FILTER (WHERE p) - count(*) FILTER (WHERE p) * (count(*) FILTER (WHERE p) + 1) / 2) / nullif(count(*) FILTER (WHERE p) * count(*) FILTER (WHERE NOT p), 0) AS auroc FROM (SELECT {g}{positive} AS p, rank() OVER (PARTITION BY {by or 1} ORDER BY {score}) + (count(*) OVER (PARTITION BY {g}{score}) - 1) / 2 AS r FROM {source}) {f'GROUP BY {by}' if by else ''}"


@query("auroc", f"WITH {SCORED} SELECT round(auroc, 9) AS auroc FROM ({sql_auroc('s', 'score', 'answerable')})")
def auroc(spark, sf_dir):
    return rounded(S.auroc(scored(spark, sf_dir), [], F.col("score"), F.col("answerable")), ["auroc"])


@query(
    "best_threshold",
    f"""WITH {SCORED}, t AS (SELECT DISTINCT score AS threshold FROM s UNION ALL SELECT CAST('Infinity' AS DOUBLE)),
j AS (SELECT threshold, avg(((score >= threshold) = answerable)::INT) AS accuracy, avg((score >= threshold)::INT) FILTER (WHERE NOT answerable) AS false_answer, avg((score < threshold)::INT) FILTER (WHERE answerable) AS false_abstain FROM t CROSS JOIN s GROUP BY threshold)
SELECT threshold, round(accuracy, 9) AS accuracy, round(false_answer, 9) AS false_answer, round(false_abstain, 9) AS false_abstain FROM j ORDER BY round(accuracy, 12) DESC, threshold LIMIT 1""",
)
def best_threshold(spark, sf_dir):
    return rounded(S.best_threshold(scored(spark, sf_dir), [], F.col("score"), F.col("answerable")), ["accuracy", "false_answer", "false_abstain"])


@query(
    "paired_bootstrap",
    f"""WITH {SCORED}, d AS (SELECT list(x ORDER BY doc_id) AS d FROM (SELECT doc_id, score / 97 - CAST(answerable AS INT) AS x FROM s)),
b AS (SELECT boot, d, list_transform(range(1, len(d) + 1), lambda i: d[1 + CAST(('0x' || left(md5('0:' || boot || ':' || i), 8)) AS BIGINT) % len(d)]) AS draws FROM d, range(1, 2001) AS r(boot)),
m AS (SELECT list_sum(draws) / len(d) AS mean FROM b), o AS (SELECT mean, row_number() OVER (ORDER BY mean) AS n FROM m),
e AS (SELECT max(mean) FILTER (WHERE n = 51) AS low, max(mean) FILTER (WHERE n = 1950) AS high FROM o)
SELECT len(d) AS n, round(list_sum(d) / len(d), 9) AS delta, round(low, 9) AS ci_low, round(high, 9) AS ci_high, low > 0 OR high < 0 AS significant FROM d, e""",
)
def paired_bootstrap(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("delta", F.col("score") / 97 - F.col("answerable").cast("int"))
    return rounded(S.bootstrap(rows, [], "delta", "doc_id"), ["delta", "ci_low", "ci_high"])


_DELTAS = "SELECT c.config, unnest(['recall_5', 'mrr']) AS metric, unnest([c.recall_5 - b.recall_5, c.mrr - b.mrr]) AS x, c.qid FROM metrics c JOIN metrics b ON b.qid = c.qid AND b.config = 'dense' WHERE c.config <> 'dense' AND c.n_relevant > 0"


@query(
    "significance",
    f"""{SWEPT}, d AS (SELECT config, metric, list(x ORDER BY qid) AS d FROM ({_DELTAS}) GROUP BY config, metric),
i AS MATERIALIZED (SELECT n, boot, list_transform(range(1, n + 1), lambda k: 1 + CAST(('0x' || left(md5('0:' || boot || ':' || k), 8)) AS BIGINT) % n) AS drawn FROM (SELECT DISTINCT len(d) AS n FROM d), range(1, 2001) AS r(boot)),
m AS (SELECT config, metric, list_sum(list_transform(drawn, lambda k: d[k])) / n AS mean FROM d JOIN i ON n = len(d)),
o AS (SELECT *, row_number() OVER (PARTITION BY config, metric ORDER BY mean) AS n FROM m),
e AS (SELECT config, metric, max(mean) FILTER (WHERE n = 51) AS low, max(mean) FILTER (WHERE n = 1950) AS high FROM o GROUP BY ALL)
SELECT config, metric, len(d) AS n, round(list_sum(d) / len(d), 9) AS delta, CASE WHEN len(d) >= 8 THEN round(low, 9) END AS ci_low, CASE WHEN len(d) >= 8 THEN round(high, 9) END AS ci_high, CASE WHEN len(d) >= 8 THEN round(low, 12) > 0 OR round(high, 12) < 0 END AS significant FROM d JOIN e USING (config, metric)""",
)
def significance(spark, sf_dir):
    """Intervals of every configuration against the baseline, for recall and reciprocal rank."""
    long = deltas(spark, sf_dir).unpivot(["config", "qid"], ["recall_5", "mrr"], "metric", "delta")
    return rounded(S.bootstrap(long, ["config", "metric"], "delta", "qid"), ["delta", "ci_low", "ci_high"])


@query(
    "abstention_by_config",
    f"""{SWEPT}, s AS (SELECT config, round(coalesce(t.score, 0), 9) AS score, n_relevant > 0 AS answerable FROM metrics LEFT JOIN (SELECT config, qid, score FROM runs WHERE rank = 1) t USING (config, qid)),
t AS (SELECT DISTINCT config, score AS threshold FROM s UNION ALL SELECT DISTINCT config, CAST('Infinity' AS DOUBLE) FROM s),
j AS (SELECT config, threshold, avg(((score >= threshold) = answerable)::INT) AS accuracy, avg((score >= threshold)::INT) FILTER (WHERE NOT answerable) AS false_answer, avg((score < threshold)::INT) FILTER (WHERE answerable) AS false_abstain FROM t JOIN s USING (config) GROUP BY config, threshold),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY config ORDER BY round(accuracy, 12) DESC, threshold) = 1), a AS ({sql_auroc('s', 'score', 'answerable', 'config')})
SELECT config, round(auroc, 9) AS auroc, threshold, round(accuracy, 9) AS accuracy, round(false_answer, 9) AS false_answer, round(false_abstain, 9) AS false_abstain FROM b JOIN a USING (config)""",
)
def abstention_by_config(spark, sf_dir):
    """How well the first result's score tells answerable queries, by configuration."""
    rows = sweep(spark, sf_dir).select("config", F.round(F.coalesce("top_score", F.lit(0.0)), 9).alias("score"), (F.col("n_relevant") > 0).alias("answerable"))
    best = S.best_threshold(rows, ["config"], F.col("score"), F.col("answerable"))
    told = S.auroc(rows, ["config"], F.col("score"), F.col("answerable"))
    return rounded(told.join(best, "config"), ["auroc", "accuracy", "false_answer", "false_abstain"])
