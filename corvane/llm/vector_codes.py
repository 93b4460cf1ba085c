"""Vector code compression: integer parts of vectors, coded by codebooks that are fitted to weighted distinct parts.

Components become integers, vectors are cut into equal consecutive parts, and for each position equal parts are counted: the
distinct parts with their weights are all that the rounds of Lloyd's algorithm go over. Each round sends the codebooks to the tasks
(``entries`` x components numbers) and brings back as many sums and counts, whatever the number of vectors. Then codes and
squared distances are joined back to the vectors, where a part that very many vectors have is split.

All is exact: integers throughout, sums as decimals. Distances are worked out in 64 bits where the largest component allows it and in
whole numbers of any size otherwise.

Defined cases: null vectors and those with null or non-finite components are left out; shorter ones (an empty one too) are filled up with zeros
to the longest, and all to a multiple of the number of parts; integers beyond a long are taken as the nearest long, and so are errors;
with fewer vectors than entries each vector gives an entry; null ids come after all others, and of vectors with one id the one that is
smaller by components comes first; equally near entries: the lower index; entries without parts stay; repeated rows are coded each; an
empty table gives an empty result; of further columns only the label is passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LONGEST = (1 << 63) - 1
#: Numbers that are compared at a time in a task.
AT_ONCE = 1 << 21

Codebooks = list[list[list[int]]]  # by part, entry, position within the part


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _padded(vector: Column, width: int) -> Column:
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector))
    return F.concat(vector, zeros)


def _cut(vector: Column, parts: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(vector, i * width + 1, width))


def nearest(own: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index and squared distance of the entry that is nearest to each row."""
    codes, errors = [], []
    step = max(1, AT_ONCE // max(1, book.size))
    for start in range(0, len(own), step):
        apart = own[start : start + step, None, :] - book[None]
        squared = (apart * apart).sum(axis=2)
        codes.append(squared.argmin(axis=1))
        errors.append(squared.min(axis=1))
    return np.concatenate(codes), np.concatenate(errors)


def _by_position(batches: Iterator[pa.RecordBatch], books: Codebooks, large: bool) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each batch and position: the batch, the position, its rows, their parts, and the position's codebook."""
    kind = object if large else np.int64
    for batch in batches:
        at = batch.column("pos").to_numpy()
        flat = batch.column("part").flatten().to_numpy()
        parts = flat.reshape(len(at), -1).astype(kind)
        for pos in np.unique(at).tolist():
            rows = np.flatnonzero(at == pos)
            yield batch, pos, rows, parts[rows], np.array(books[pos], dtype=kind).reshape(len(books[pos]), -1)


def _summing(books: Codebooks, large: bool):
    """For mapInArrow: weighted parts to the sums and counts of the entries they are nearest to."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pos, rows, parts, book in _by_position(batches, books, large):
            codes, _ = nearest(parts, book)
            weights = batch.column("n").to_numpy()[rows].astype(object)
            used = np.unique(codes)
            totals = [(parts[codes == k].astype(object) * weights[codes == k, None]).sum(axis=0).tolist() for k in used]
            counts = [Decimal(int(weights[codes == k].sum())) for k in used]
            values = [[n, *map(Decimal, own)] for n, own in zip(counts, totals, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([pos] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(values, pa.list_(pa.decimal128(38, 0)))], names=["pos", "entry", "value"])

    return sums


def _coding(books: Codebooks, large: bool):
    """For mapInArrow: parts to their code and squared distance."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pos, rows, parts, book in _by_position(batches, books, large):
            code, error = nearest(parts, book)
            own = batch.take(pa.array(rows))
            capped = [min(LONGEST, int(e)) for e in error]
            yield pa.RecordBatch.from_arrays([own.column("pos"), own.column("part"), own.column("n"), pa.array(code, pa.int32()), pa.array(capped, pa.int64())], names=["pos", "part", "n", "code", "error"])

    return codes


def fit(weighted: DataFrame, books: Codebooks, large: bool, rounds: int = ROUNDS) -> Codebooks:
    """``books`` after rounds of assignment and update over the weighted distinct parts (pos, part, n)."""
    for _ in range(rounds):
        sums = weighted.mapInArrow(_summing(books, large), "pos int, entry int, value array<decimal(38,0)>")
        each = sums.select("pos", "entry", F.posexplode("value").alias("i", "x")).groupBy("pos", "entry", "i").agg(F.sum("x").alias("x"))
        found: dict[tuple[int, int], dict[int, int]] = {}
        for r in each.collect():  # a number for each component of the codebooks, and a count an entry
            found.setdefault((r.pos, r.entry), {})[r.i] = int(r.x)
        books = [[[found[pos, k][i + 1] // found[pos, k][0] for i in range(len(old))] if (pos, k) in found else old for k, old in enumerate(book)] for pos, book in enumerate(books)]
    return books


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``vec_id``, code, error and ``label`` of every kept vector, and the codebooks."""
    kept = vectors.where(_finite(F.col(vector))).select(F.col(vec_id).alias("_id"), F.col(label).alias("_label"), integers(F.col(vector)).alias("_vector"))
    # a number for each row, kept by the table
    kept = written(kept.withColumn("_row", F.monotonically_increasing_id()), "vector-integers")
    longest, largest = kept.agg(F.max(F.size("_vector")), F.max(F.array_max(F.transform("_vector", lambda x: F.abs(x.cast("decimal(20,0)")))))).first()
    width = max(1, -(-(longest or 0) // parts))
    large = width * (2 * int(largest or 0)) ** 2 > LONGEST
    cut = _cut(_padded(F.col("_vector"), width * parts), parts, width)
    first = kept.select("_id", cut.alias("parts")).orderBy(F.col("_id").asc_nulls_last(), "parts").limit(entries).collect()
    books = [[list(row.parts[pos]) for row in first] for pos in range(parts)]
    each = kept.select("_row", F.posexplode(cut).alias("pos", "part"))
    weighted = written(each.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")), "distinct-parts")
    books = fit(weighted, books, large, rounds) if first else books
    coded = written(weighted.mapInArrow(_coding(books, large), "pos int, part array<bigint>, n bigint, code int, error bigint"), "coded-parts")
    joined = salted_join(each, coded, ["pos", "part"]).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("codes"), F.sum(F.col("error").cast("decimal(38,0)")).alias("error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c["code"]), 2, "0"))), "")
    error = F.least(F.col("error"), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    out = joined.select("_row", code.alias("code"), error.alias("error")).join(kept.select("_row", "_id", "_label"), "_row")
    return out.select(F.col("_id").alias(vec_id), "code", "error", F.col("_label").alias(label)), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector of ``embeddings``, and each label's error."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = written(coded, "vector-codes")
    capped = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    labels = written(coded.groupBy("label").agg(capped.alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    rows = salted_join(coded, labels, ["label"])
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out one after the other; vec_id is unique there, as in the tables given."""
    floor = "CAST((s - ((s % c) + c) % c) // c AS BIGINT)"
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "w AS MATERIALIZED (SELECT len(embedding) // 8 AS w FROM k LIMIT 1)",
        "x AS MATERIALIZED (SELECT vec_id, (i - 1) // w AS pos, (i - 1) % w AS i, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, embedding, w, unnest(range(1, len(embedding) + 1)) AS i FROM k, w))",
        "b0 AS MATERIALIZED (SELECT pos, entry, i, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k) USING (vec_id) WHERE entry < 16)",
    ]
    for r in range(7):
        apart = f"SELECT vec_id, pos, entry, sum((x - c) * (x - c)) AS d FROM x JOIN b{r} USING (pos, i) GROUP BY ALL"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, pos, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM ({apart}) GROUP BY vec_id, pos)")
        if r < 6:
            sums = f"SELECT pos, entry, i, sum(x) AS s, count(*) AS c FROM x JOIN a{r} USING (vec_id, pos) GROUP BY ALL"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT o.pos, o.entry, o.i, CASE WHEN n.c IS NULL THEN o.c ELSE n.mean END AS c FROM b{r} o LEFT JOIN (SELECT pos, entry, i, c, {floor} AS mean FROM ({sums})) n USING (pos, entry, i))")
    steps.append("v AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id)")
    steps.append("s AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos, entry, i)) AS codebooks_sha256 FROM b6)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN k USING (vec_id), s"


ORACLE_SQL = _sql()
