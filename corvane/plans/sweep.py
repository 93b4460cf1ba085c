"""Many configurations over one corpus: what they share is worked out once.

All queries and rephrasings go through one dense and one lexical search, as deep as the deepest configuration asks. The
distinct first stages (mode, fusion, rephrasings, depth) are cut from these two lists, a chunk and a query are scored for
reranking once, and only the rest, on some tens of candidates a query, runs for each configuration; its parameters are
columns there, so the plan does not grow with the configurations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import ranking as R
from corvane.operators.index import broadcast_if_small
from corvane.plans.search import Config, Corpus, dense, lexical
from corvane.session import written

STAGE = ["stage", "qid"]


def depth(config: Config) -> int:
    return config.candidates * (1 if config.include_refs else 3)


def first_stages(configs: dict[str, Config]) -> tuple[list[tuple], dict[str, int]]:
    """The distinct (lists, fusion, alpha, variants, depth) and, by configuration, which one it has."""
    keys = {}
    for name, c in configs.items():
        lists = "both" if c.mode.startswith("hybrid") else c.mode
        fusion = c.fusion if lists == "both" else "none"
        keys[name] = (lists, fusion, c.alpha if fusion == "weighted" else 0.0, c.variants, depth(c))
    distinct = sorted(set(keys.values()))
    return distinct, {name: distinct.index(key) for name, key in keys.items()}


def searched(corpus: Corpus, most: int, variants: int) -> DataFrame:
    """qid, variant (-1: the query itself), list (0: dense, 1: lexical), chunk_id, score, rank."""
    kind = corpus.queries.schema["qid"].dataType
    asked = corpus.queries.select("qid", F.lit(-1).alias("variant"), "tokens", "vector")
    if variants:
        asked = asked.unionByName(corpus.variants.where(F.col("variant") < variants).select("qid", F.col("variant").cast("int"), "tokens", "vector"))
    named = asked.select(F.concat_ws("#", F.col("qid").cast("string"), F.col("variant").cast("string")).alias("qid"), "tokens", "vector")
    both = [found.withColumn("list", F.lit(i)) for i, found in enumerate((dense(corpus, named, most), lexical(corpus, named, most)))]
    lists = both[0].unionByName(both[1])
    name = F.substring_index("qid", "#", 1).cast(kind)
    return lists.select(name.alias("qid"), F.substring_index("qid", "#", -1).cast("int").alias("variant"), "list", "chunk_id", "score", "rank")


def fused(lists: DataFrame, stages: list[tuple]) -> DataFrame:
    """stage, qid, chunk_id, score, rank of every first stage."""
    each = F.array(*[F.struct(F.lit(i).alias("stage"), *[F.lit(v).alias(c) for c, v in zip(("lists", "fusion", "alpha", "variants", "depth"), s, strict=True)]) for i, s in enumerate(stages)])
    rows = lists.select("*", F.inline(each)).where(F.col("rank") <= F.col("depth"))
    rows = rows.where((F.col("lists") == "both") | ((F.col("lists") == "dense") & (F.col("list") == 0)) | ((F.col("lists") == "bm25") & (F.col("list") == 1)))
    rows = rows.where(F.when(F.col("variants") > 0, (F.col("variant") >= 0) & (F.col("variant") < F.col("variants"))).otherwise(F.col("variant") == -1))
    own = [*STAGE, "variant"]
    scaled = R.min_max(rows.withColumn("_score", F.col("score")), [*own, "list"]).withColumnRenamed("score", "_x")
    of = lambda i: F.coalesce(F.max(F.when(F.col("list") == i, F.col("_x"))), F.lit(0.0))
    sums = scaled.groupBy(*own, "fusion", "alpha", "chunk_id").agg(
        F.sum(1 / (F.lit(float(R.RRF_K)) + F.col("rank"))).alias("_rrf"), of(0).alias("_a"), of(1).alias("_b"), F.max("_score").alias("_own"), F.min(F.struct("list", "rank")).alias("seen")
    )
    mixed = F.col("alpha") * F.col("_a") + (1 - F.col("alpha")) * F.col("_b")
    score = F.when(F.col("fusion") == "none", F.col("_own")).when(F.col("fusion") == "rrf", F.col("_rrf")).otherwise(mixed)
    ranked = R.ranked(sums.select(*own, "chunk_id", score.alias("score"), "seen"), own, ties=("seen", "chunk_id")).drop("seen")
    several = R.rrf_lists(ranked.where("variant >= 0"), STAGE, "variant")
    several = R.ranked(several, STAGE, ties=("seen", "chunk_id"))
    return ranked.where("variant < 0").drop("variant").unionByName(several.drop("seen"))


def _parameters(corpus: Corpus, configs: dict[str, Config], stage: dict[str, int]) -> DataFrame:
    """A row a configuration."""
    schema = "config string, stage int, candidates int, reranked boolean, penalty double, per_paper int, share double, hard boolean, mmr double, least double"
    rows = [(name, stage[name], c.candidates, c.mode == "hybrid_rerank", 1.0 if c.include_refs else float(c.ref_penalty), c.per_paper, float(c.floor_share), c.hard_cap, c.mmr_weight, c.min_score) for name, c in configs.items()]
    return corpus.queries.sparkSession.createDataFrame(rows, schema)


def _judged(corpus: Corpus, stages: DataFrame) -> DataFrame:
    """qid, chunk_id, paper, is_reference, told of every pair that some first stage has: scored once for all."""
    pairs = broadcast_if_small(written(stages.select("qid", "chunk_id").distinct(), "sweep-pairs"))  # so no tokens are shuffled
    told = pairs.join(corpus.told(pairs), "chunk_id")
    asked = corpus.queries.select("qid", F.col(corpus.scored).alias("_asked"))
    return told.join(asked, "qid").select("qid", "chunk_id", "paper", "is_reference", corpus.scorer(F.col("_told"), F.col("_asked")).alias("told"))


def sweep(corpus: Corpus, configs: dict[str, Config], k: int = 10) -> DataFrame:
    """config, qid, chunk_id, score, rank: the k results of every query under every configuration, as search() gives them."""
    return sweep_apart(corpus, configs, (k,)).drop("cutoff")


def sweep_apart(corpus: Corpus, configs: dict[str, Config], ks: tuple[int, ...]) -> DataFrame:
    """config, cutoff, qid, chunk_id, score, rank: as sweep(), with a search for each of ``ks`` as cutoff.

    The 5 first of a search for 10 are not those of a search for 5: what fills up to k beyond the cap is ranked among the others.
    Candidates and their scores are the same whatever k, so searches part only where results are selected.
    """
    if corpus.variants is None:
        configs = {name: Config(**{**c.__dict__, "variants": 0}) for name, c in configs.items()}
    stages, stage = first_stages(configs)
    lists = written(searched(corpus, max(s[4] for s in stages), max(s[3] for s in stages)), "sweep-lists")
    rows = written(fused(lists, stages), "sweep-stages")
    known = rows.join(F.broadcast(_parameters(corpus, configs, stage)), "stage").join(written(_judged(corpus, rows), "sweep-judged"), ["qid", "chunk_id"])  # the broadcast: a row a configuration
    known = known.where((F.col("penalty") > 0) | ~F.col("is_reference"))
    by = ["config", "qid"]
    pool = R.ranked(known.withColumnRenamed("rank", "_stage"), by, ties=("_stage",)).where(F.col("rank") <= F.col("candidates"))
    told = pool.withColumn("score", F.when(F.col("reranked"), F.col("told")).otherwise(F.col("score")))
    ordered = R.ranked(told.withColumnRenamed("rank", "_pool"), by, ties=("_pool",))
    demoted = R.demote(ordered, by, F.when((F.col("penalty") > 0) & (F.col("penalty") < 1), F.col("penalty")).otherwise(1.0))
    demoted = demoted.where(F.col("least").isNull() | (F.col("score") >= F.col("least")))
    demoted = demoted.withColumn("cutoff", F.explode(F.array(*map(F.lit, ks))))
    by, k = ["config", "cutoff", "qid"], F.col("cutoff")
    out = [*by, "chunk_id", "score", "rank"]
    capped = R.diversity_cap(demoted.where("mmr is null"), by, k, F.col("per_paper"), F.col("share"), F.col("hard")).select(*out)
    if not any(c.mmr_weight is not None for c in configs.values()):
        return capped
    varied = demoted.where("mmr is not null").select(*out, "mmr").join(corpus.vectors, "chunk_id")
    return capped.unionByName(R.mmr(varied, by, k, F.col("mmr")).select(*out))

