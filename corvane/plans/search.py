"""Search plans over a corpus: first stage, fusion, reranking, selection, for all queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import search_tokens, token_text
from corvane.operators import ranking as R
from corvane.operators.index import Index, bm25, broadcast_if_small, build_index
from corvane.session import stored, table, written


@dataclass(frozen=True)
class Config:
    """What a search does; the fields' defaults are the engine's."""

    mode: str = "hybrid_rerank"
    candidates: int = 20
    fusion: str = "rrf"
    alpha: float = 0.5
    per_paper: int = 2
    floor_share: float = 0.25
    include_refs: bool = False
    ref_penalty: float = 0.75
    hard_cap: bool = False
    mmr_weight: float | None = None
    min_score: float | None = None
    variants: int = 0


_RERANK = Config()
#: Named configurations of the evaluation sweep.
CONFIGS = {m: Config(mode=m) for m in ("dense", "bm25", "hybrid", "hybrid_rerank")}
CONFIGS |= {f"{m}+mq3": Config(mode=m, variants=3) for m in ("hybrid_rerank", "dense", "bm25", "hybrid")}
CONFIGS |= {f"hybrid_weighted_a{a}": Config(mode="hybrid", fusion="weighted", alpha=a) for a in (0.3, 0.7)}
CONFIGS |= {"rerank_nocap": replace(_RERANK, per_paper=0), "rerank_cap1": replace(_RERANK, per_paper=1), "rerank_nofloor": replace(_RERANK, floor_share=0.0)}
CONFIGS |= {f"rerank_cand{n}": replace(_RERANK, candidates=n) for n in (8, 10, 12, 15, 40)}
CONFIGS |= {"rerank_hardcap2": replace(_RERANK, hard_cap=True), "rerank_hardcap1": replace(_RERANK, hard_cap=True, per_paper=1)}
CONFIGS |= {"rerank_refs": replace(_RERANK, include_refs=True), "rerank_refs_excluded": replace(_RERANK, ref_penalty=0.0)}
CONFIGS |= {f"rerank_refs_demote{p}": replace(_RERANK, ref_penalty=p) for p in (0.25, 0.5)}
CONFIGS |= {f"rerank_mmr{w}": replace(_RERANK, mmr_weight=w) for w in (0.7, 0.5)}


@dataclass
class Corpus:
    """chunks: chunk_id, paper, is_reference, tokens, and text if search_tokens() makes the tokens of it. vectors: chunk_id, vector. queries: qid, tokens, vector.

    variants: qid, variant, tokens, vector, if queries have rephrasings. ``scorer`` reranks: of a chunk's and a query's
    column named ``scored`` it makes a score; chunks and queries have that column.
    """

    chunks: DataFrame
    vectors: DataFrame
    queries: DataFrame
    variants: DataFrame | None = None
    scorer: Callable[[Column, Column], Column] = R.shared_tokens
    scored: str = "tokens"
    source: str | None = None  # the files that the chunks are made from: what is made of these is kept for other searches
    _index: Index | None = field(default=None, init=False, repr=False)
    _split: DataFrame | None = field(default=None, init=False, repr=False)

    @property
    def split(self) -> DataFrame:
        """chunk_id, tokens, paper, is_reference of the chunks, as a table: texts are split into tokens once."""
        if self._split is None:
            self._split = self._kept("chunk-tokens", lambda: written(self.chunks.select("chunk_id", "tokens", "paper", "is_reference"), "chunk-tokens"), lambda t: [t])
        return self._split

    @property
    def index(self) -> Index:
        """The lexical index of the chunks, built when it is first asked for."""
        if self._index is None:
            self._index = self._kept("index", lambda: build_index(self.chunks.select("chunk_id", token_text(F.col("text")).alias("tokens")) if "text" in self.chunks.columns else self.split.select("chunk_id", "tokens")), lambda i: [i.blocks, i.terms, i.stats])
        return self._index

    def told(self, pairs: DataFrame) -> DataFrame:
        """chunk_id, paper, is_reference, _told (what is scored) of the chunks that ``pairs`` (chunk_id) name: tokens are made of these only."""
        named = broadcast_if_small(pairs.select("chunk_id").distinct())
        made = self.scored == "tokens" and "text" in self.chunks.columns  # a join is not pushed below what Python works out
        own = self.chunks.select("chunk_id", "paper", "is_reference", "text" if made else self.scored).join(named, "chunk_id", "left_semi")
        return own.select("chunk_id", "paper", "is_reference", (search_tokens(F.col("text")) if made else F.col(self.scored)).alias("_told"))

    def _kept(self, what: str, make: Callable, tables: Callable[..., list[DataFrame]]):
        if self.source is None:
            return make()
        return stored(self.chunks.sparkSession, self.source, what, make, tables)


def lexical(corpus: Corpus, queries: DataFrame, most: int | None) -> DataFrame:
    return R.ranked(bm25(corpus.index, queries.select("qid", "tokens"), most=most), ["qid"], most)


def lexical_excluding(chunks: DataFrame, queries: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """qid, chunk_id, score, rank: the k best of (chunk_id, tokens) for each of (qid, tokens) without its (qid, chunk_id) excluded.

    Chunks that share no term score 0 and fill up to k, the least ids first. For that only queries with fewer than k hits are looked
    at, and only so many of the least ids as are excluded or hit for one query at most, and k more: no other can come up.
    """
    hits = written(R.ranked(bm25(chunks, queries).join(excluded, ["qid", "chunk_id"], "left_anti"), ["qid"], k), "hits")
    few = written(queries.select("qid").join(hits.groupBy("qid").agg(F.count(F.lit(1)).alias("_n")), "qid", "left").where(F.coalesce("_n", F.lit(0)) < k).select("qid"), "few-hits")
    most = excluded.join(few, "qid", "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    least = chunks.select("chunk_id").orderBy("chunk_id").limit(most + 2 * k)
    known = excluded.select("qid", "chunk_id").unionByName(hits.select("qid", "chunk_id"))
    # queries that need them beside the least ids: a bounded number of rows a query
    fill = few.crossJoin(least).join(known, ["qid", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return R.ranked(hits.drop("rank").unionByName(fill), ["qid"], k)


def dense(corpus: Corpus, queries: DataFrame, most: int) -> DataFrame:
    return R.dense(corpus.vectors, queries.where(F.col("vector").isNotNull()), most)


def first_stage(corpus: Corpus, queries: DataFrame, config: Config, fetch: int) -> DataFrame:
    """qid, chunk_id, score, rank of the stage that ``config`` names."""
    if config.mode == "dense":
        return dense(corpus, queries, fetch)
    if config.mode == "bm25":
        return lexical(corpus, queries, fetch)
    near, sparse = dense(corpus, queries, fetch), lexical(corpus, queries, fetch)
    fused = R.rrf([near, sparse], ["qid"]) if config.fusion == "rrf" else R.weighted(near, sparse, ["qid"], config.alpha)
    return R.ranked(fused, ["qid"], ties=("seen", "chunk_id")).drop("seen")


def search(corpus: Corpus, config: Config, k: int = 10) -> DataFrame:
    """qid, chunk_id, score, rank: the k results of every query."""
    fetch = config.candidates * (1 if config.include_refs else 3)
    if config.variants and corpus.variants is not None:
        several = corpus.variants.where(F.col("variant") < config.variants)
        named = several.select(F.concat_ws("#", F.col("qid").cast("string"), F.col("variant").cast("string")).alias("qid"), "tokens", "vector")
        lists = first_stage(corpus, named, config, fetch)
        kind = dict(corpus.queries.dtypes)["qid"]
        lists = lists.select(F.substring_index("qid", "#", 1).cast(kind).alias("qid"), F.substring_index("qid", "#", -1).cast("int").alias("variant"), "chunk_id", "rank")
        stage = R.ranked(R.rrf_lists(lists, ["qid"], "variant"), ["qid"], ties=("seen", "chunk_id")).drop("seen")
    else:
        stage = first_stage(corpus, corpus.queries, config, fetch)
    penalty = 1.0 if config.include_refs else config.ref_penalty
    reranked = config.mode == "hybrid_rerank"
    if reranked:  # few rows a query meet the chunks where these lie, so no tokens are shuffled
        stage = broadcast_if_small(written(stage, "stage"))
    known = stage.join(corpus.told(stage) if reranked else corpus.chunks.select("chunk_id", "paper", "is_reference"), "chunk_id")
    if penalty <= 0:
        known = known.where(~F.col("is_reference"))
    pool = R.ranked(known.withColumnRenamed("rank", "_stage"), ["qid"], config.candidates, ties=("_stage",)).drop("_stage")
    if reranked:
        asked = corpus.queries.select("qid", F.col(corpus.scored).alias("_asked"))
        scored = pool.join(asked, "qid").withColumn("first_stage_score", F.col("score")).withColumn("score", corpus.scorer(F.col("_told"), F.col("_asked")))
        pool = R.ranked(scored.withColumnRenamed("rank", "_pool"), ["qid"], ties=("_pool",)).drop("_pool", "_told", "_asked")
    if penalty > 0:
        pool = R.demote(pool, ["qid"], penalty)
    return select(corpus, pool, config, k)


def select(corpus: Corpus, pool: DataFrame, config: Config, k: int) -> DataFrame:
    if config.min_score is not None:
        pool = pool.where(F.col("score") >= config.min_score)
    if config.mmr_weight is not None:
        return R.mmr(pool.join(corpus.vectors, "chunk_id"), ["qid"], k, config.mmr_weight).select("qid", "chunk_id", "score", "rank")
    return R.diversity_cap(pool, ["qid"], k, config.per_paper, config.floor_share, config.hard_cap).select("qid", "chunk_id", "score", "rank")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The driver tables as a corpus: documents are chunks, sources papers, benchmark items queries.

    A vector belongs to the document or query of its number; each seventh document is tagged as a reference list.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper"), (F.col("doc_id") % 7 == 0).alias("is_reference"), search_tokens(F.col("text")).alias("tokens"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), search_tokens(F.col("text")).alias("tokens"))
    queries = items.join(vectors.select(F.col("chunk_id").alias("qid"), "vector"), "qid", "left")
    # rephrasings: the query, its first half, its second half
    half = F.ceil(F.size("tokens") / 2).cast("int")
    parts = F.array(F.col("tokens"), F.slice("tokens", 1, half), F.slice("tokens", half + 1, F.greatest(F.size("tokens") - half, F.lit(0))))
    variants = items.select("qid", F.posexplode(parts).alias("variant", "tokens")).join(vectors.select((F.col("chunk_id") - 100).alias("_v"), "vector"), F.col("_v") == F.col("qid") + F.col("variant"), "left").drop("_v")
    return Corpus(docs, vectors, queries, variants, source=f"{sf_dir.rstrip('/')}/documents.parquet")
