"""Approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is cut into balanced partitions, and a small classifier (softmax
regression) learns to name the partitions of a vector's neighbours. Where the partitions are still large,
each is cut again in the same way on a bounded sample of its own rows. Every row is indexed under its most
probable partition; a query looks into its most probable ones, as many as reach the target recall on the
sample, and ranks what it finds there by the exact cosine.

A partition's rows lie in blocks of bounded size, as its queries do. A group of queries is sent once to
every GRID blocks of rows and meets them one after another, so one very common vector fills more blocks,
not a larger task. Only the samples, the partitions' sizes and the classifiers' weights are on the driver.

Defined cases: vectors that are null, zero, or that hold null or non-finite components take no part, nor do
rows without vec_id; vectors of another length than most of the sample are compared, without partitions,
with those of their length; rows that repeat a vec_id are rows of their own (as queries, with ranks of their
own); ties go to the smaller vec_id; a query finds as many rows as there are if they are fewer than
asked for; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, written

#: Rows of the sample; of the sample of each partition that is cut again; rows for each partition; fewest and
#: most partitions of one cut; rows of a sample for each partition.
SAMPLE, SUB_SAMPLE, PARTITION_ROWS, LEAST_PARTITIONS, MOST_PARTITIONS, LABEL_ROWS = 5_000, 2_000, 1_000, 8, 96, 40
#: Partitions of so many times PARTITION_ROWS rows on average are cut again.
CUT_AGAIN = 4
NEIGHBOURS, RECALL, SEED = 10, 0.95, 7
#: Rows of a block, queries of a group, blocks that a group of queries is sent to at once, rows that routing gives out at once.
BLOCK, QUERY_BLOCK, GRID, ROUTED = 4_096, 1_024, 16, 65_536


def usable(vector: str = "embedding") -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of unit vectors x to each of ``of`` (the nearest, itself, left out)."""
    out = []
    for start in range(0, len(of), 1024):
        near = of[start : start + 1024] @ x.T
        some = np.argpartition(-near, k, axis=1)[:, : k + 1]
        order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
        out.append(np.take_along_axis(some, order, axis=1)[:, 1:])
    return np.concatenate(out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 30) -> np.ndarray:
    """A part for each node: halves along the main direction, then moves of nodes to where most neighbours are.

    No part gets more than its even share and ``slack`` of it.
    """
    label = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        own, first, n = todo.pop()
        label[own] = first
        if n > 1:
            centred = x[own] - x[own].mean(axis=0)
            main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = own[np.argsort(centred @ main, kind="stable")]
            cut = len(own) * (n // 2) // n
            todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    most = int(np.ceil(len(x) / parts * (1 + slack)))
    links = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.reshape(-1)], 1), np.stack([graph.reshape(-1), np.repeat(np.arange(len(x)), graph.shape[1])], 1)])
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), dtype=np.int32)
        np.add.at(votes, (links[:, 0], label[links[:, 1]]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: len(x) // 4]:
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < len(x) // 500:
            break
    return label


def softmax(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    logits = x @ weights[:-1] + weights[-1]
    logits -= logits.max(axis=1, keepdims=True)
    return np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)


def train_classifier(x: np.ndarray, targets: np.ndarray, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Softmax regression on target distributions by Adam on the whole sample."""
    weights = np.zeros((x.shape[1] + 1, targets.shape[1]))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    led = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for t in range(1, steps + 1):
        slope = led.T @ (softmax(x, weights) - targets) / len(x)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return weights


def learn_partitions(x: np.ndarray, parts: int, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each row of unit vectors x, and the weights of a classifier trained on the rows ``use``."""
    graph = neighbours(x, x, min(NEIGHBOURS, len(x) - 1))
    label = balanced_partition(x, graph, parts)
    share = 1 / (graph.shape[1] + 2)
    targets = np.zeros((len(x), parts))
    np.add.at(targets, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.reshape(-1)]), share)
    targets[np.arange(len(x)), label] += 2 * share
    return graph, train_classifier(x, targets) if use is None else train_classifier(x[use], targets[use])


class Router:
    """The classifiers, and how many partitions a query looks into.

    Partitions are numbered from 0; those of the first cut's partition p begin at ``first[p]``.
    """

    def __init__(self, sample: np.ndarray, rows: int, partition_rows: int = PARTITION_ROWS):
        most = min(MOST_PARTITIONS, len(sample) // LABEL_ROWS)
        self.length = sample.shape[1] if len(sample) else 0
        self.x = _unit(sample) if len(sample) else sample
        parts = max(1, min(most, max(LEAST_PARTITIONS, rows // partition_rows)))
        self.subs: list[np.ndarray | None] = [None] * parts
        self.weights = learn_partitions(self.x, parts)[1] if parts > 1 else np.zeros((self.length + 1, 1))
        self._number()

    def _number(self) -> None:
        self.first = np.cumsum([0, *(1 if w is None else w.shape[1] for w in self.subs)])
        self.parts = self.probes = int(self.first[-1])

    def cut_again(self, subs: dict[int, np.ndarray]) -> None:
        self.subs = [subs.get(p) for p in range(len(self.subs))]
        self._number()

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each partition, for each unit vector."""
        top = softmax(x, self.weights)
        return np.concatenate([top[:, [p]] if w is None else top[:, [p]] * softmax(x, w) for p, w in enumerate(self.subs)], axis=1)

    def routes(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each unit vector, most probable first."""
        return np.argsort(-self.probabilities(x), axis=1, kind="stable")

    def choose_probes(self, target: float) -> None:
        """As many as hold the share ``target`` of the 5 nearest rows, for rows that the first classifier has not seen."""
        if self.parts == 1:
            return
        seen = np.random.default_rng(SEED).random(len(self.x)) < 0.8
        weights = self.weights
        graph, self.weights = learn_partitions(self.x, len(self.subs), seen)
        probable = self.probabilities(self.x)
        self.weights = weights
        place = probable.argmax(axis=1)
        held = np.argsort(-probable[~seen], axis=1, kind="stable")
        rank = np.empty_like(held)
        np.put_along_axis(rank, held, np.arange(self.parts)[None, :].repeat(len(held), 0), axis=1)
        needed = np.sort(np.take_along_axis(rank, place[graph[~seen][:, :5]], axis=1).reshape(-1))
        self.probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), length)


def _sub_fit(parts: int):
    """For applyInArrow: a sample of one partition's vectors to the weights of its own cut."""

    def run(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        column = own.column("embedding").combine_chunks()
        x = _unit(_matrix(column, len(column[0])))
        n = min(parts, len(x) // LABEL_ROWS)
        weights = learn_partitions(x, n)[1] if n > 1 else np.zeros((0, 0))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "parts": pa.array([weights.shape[1]], pa.int32()), "weights": pa.array([weights.reshape(-1).tolist()], pa.list_(pa.float64()))})

    return run


def fit(vectors: DataFrame, sample_rows: int = SAMPLE, target: float = RECALL, partition_rows: int = PARTITION_ROWS) -> Router:
    """A router for ``vectors`` (vec_id, embedding; usable rows), from the rows with the least hashed ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toPandas().embedding.tolist()  # bounded
    lengths = np.array([len(r) for r in rows])
    usual = np.bincount(lengths).argmax() if len(rows) else 0
    usual_rows = [r for r in rows if len(r) == usual]
    sample = np.array(usual_rows, dtype=np.float64) if usual_rows else np.zeros((0, 0))
    total = vectors.count()
    router = Router(sample, total, partition_rows)
    again = total // router.parts // partition_rows
    if router.parts > 1 and again >= CUT_AGAIN:
        # of each partition some SUB_SAMPLE rows, by the hash of their ids: the vectors of a partition are alike in number
        share = min(1.0, SUB_SAMPLE * router.parts / total)
        chosen = vectors.where((F.size("embedding") == router.length) & (F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))).select("vec_id", "embedding")
        placed = chosen.mapInArrow(_assign(router), _indexed(chosen))
        placed = placed.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id"))).where(F.col("n") <= 2 * SUB_SAMPLE)
        fitted = placed.select("part", "embedding").groupBy("part").applyInArrow(_sub_fit(min(MOST_PARTITIONS, again)), "part int, parts int, weights array<double>").collect()  # a row a partition
        router.cut_again({r["part"]: np.array(r["weights"]).reshape(-1, r["parts"]) for r in fitted if r["parts"] > 1})
    router.choose_probes(target)
    return router


def _indexed(vectors: DataFrame) -> str:
    """The schema of ``vectors`` with their partition."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema if f.name in ("row", "vec_id", "embedding")) + ", part int"


def _assign(router: Router):
    """For mapInArrow: rows with an embedding of the usual length to the same and their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.zeros(batch.num_rows, dtype=np.int64)
            if router.parts > 1 and batch.num_rows:
                part = router.probabilities(_unit(_matrix(batch.column("embedding"), router.length))).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    return run


def _route(router: Router, sizes: np.ndarray, k: int):
    """For mapInArrow: queries (row, vec_id, embedding) to a row a partition, so that at least k rows besides its own are met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(1024, ROUTED // router.parts))  # a query may have as many rows as there are partitions
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                order = router.routes(_unit(_matrix(batch.column("embedding"), router.length)))
                enough = np.cumsum(sizes[order], axis=1) >= k + 1
                probes = np.maximum(router.probes, np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, router.parts))
                at = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                parts = np.concatenate([o[:n] for o, n in zip(order, probes, strict=True)])
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(parts, pa.int32())], names=[*batch.schema.names, "part"])

    return run


def _rank(k: int):
    """For mapInArrow: a group of queries and a block of rows to the k nearest of these for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                q, v = (batch.column(c).slice(at, 1).flatten() for c in ("queries", "rows"))
                (qrow, qid), (vrow, vid) = ([np.asarray(x.field(c)) for c in ("row", "vec_id")] for x in (q, v))
                length = len(q.field("embedding")[0])
                qx, vx = (_matrix(x.field("embedding"), length) for x in (q, v))
                qn, vn = (np.sqrt((x * x).sum(axis=1)) for x in (qx, vx))
                near = (qx @ vx.T) / (qn[:, None] * vn[None, :])
                near[qrow[:, None] == vrow[None, :]] = -np.inf
                asked, found, scores = [], [], []
                for i, row in enumerate(near):
                    least = np.partition(row, -k)[-k] if len(row) > k else -2.0
                    some = np.flatnonzero(row >= max(least - 1e-9, -2.0))
                    exact = (qx[i] * vx[some]).sum(axis=1) / (qn[i] * vn[some])  # the same sum wherever a vector stands
                    best = np.lexsort((vid[some], -exact))[:k]
                    asked += [i] * len(best)
                    found += vid[some][best].tolist()
                    scores += exact[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(qrow[asked], pa.int64()), pa.array(qid[asked], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], names=["row", "query_id", "vec_id", "score"])

    return run


def nearest(embeddings: DataFrame, queries: Column, k: int = 5, router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row for which ``queries`` holds."""
    vectors = embeddings.where(F.col("vec_id").isNotNull() & usable()).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    with Scratch(embeddings.sparkSession) as own:
        vectors = own.written(vectors, "vectors")
        router = router or fit(vectors)
        usual = F.size("embedding") == router.length
        indexed = vectors.where(usual).mapInArrow(_assign(router), _indexed(vectors))
        odd = (-F.size("embedding")).alias("part")  # vectors of another length are a partition by themselves
        indexed = own.written(indexed.unionByName(vectors.where(~usual).select("*", odd)), "index")
        counts = indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        sizes = np.zeros(router.parts, dtype=np.int64)
        for r in counts.where("part >= 0").collect():  # a row a partition
            sizes[r["part"]] = r["n"]

        asked = indexed.where(queries)
        routed = asked.where("part >= 0").select("row", "vec_id", "embedding").mapInArrow(_route(router, sizes, k), _indexed(vectors))
        routed = own.written(routed.unionByName(asked.where("part < 0")), "routed")
        blocks = F.ceil(F.col("n") / BLOCK)
        rows = indexed.join(counts, "part").withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int"))
        rows = rows.groupBy("part", "block").agg(F.collect_list(F.struct("row", "vec_id", "embedding")).alias("rows")).withColumn("cell", F.floor(F.col("block") / GRID).cast("int"))
        groups = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("groups"))
        dealt = routed.join(groups, "part").withColumn("group", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int"))
        dealt = dealt.groupBy("part", "group").agg(F.collect_list(F.struct("row", "vec_id", "embedding")).alias("queries"))
        dealt = dealt.join(counts, "part").select("part", "queries", F.explode(F.sequence(F.lit(0), F.ceil(blocks / GRID).cast("int") - 1)).alias("cell"))
        met = dealt.join(rows, ["part", "cell"]).select("queries", "rows").mapInArrow(_rank(k), "row bigint, query_id bigint, vec_id bigint, score double")
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")  # k rows a query and block
        best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return written(best, "nearest")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest ``embeddings`` of every row whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
