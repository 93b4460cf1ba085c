"""Near-duplicates by fast similarity sketches, banding and exact verification.

1. Each text's set of word shingles gets a fast similarity sketch (rounds of hashed bin placement until every
   bin is filled), whose bands are hashed to keys. Texts with equal sets are one class; its smallest
   doc_id stands for it from here on.
2. Classes that share a key are candidates. In a round of hubs, each bucket's most central class outside the
   components found so far (the one that shares its keys with the most others) is held against all the bucket
   that is not in its component, and components are formed anew.
3. What no hub has settled is compared exactly and in blocks: in each bucket, the members outside its
   commonest component with one another and with those inside it. Two blocks of bounded size meet in a
   task, which gives out a spanning forest of the links found, less than one link a member. A hot
   bucket's pairs of blocks are dealt out by cells, so that no task has to take a whole key.
4. Links join components to components; each document gets the smallest doc_id of its component.

Links are confirmed on the full sets. No pairs of a group are listed, but where many members of a bucket
lie just below the similarity, so that no hub settles them, step 3 compares them with all the bucket: its work
(not its output) grows with the number of such members times the bucket's.

With 160 bins in 32 bands of 5, two sets of similarity 0.8 share no band with a probability of 3e-6
(less above it). Nothing else can lose a link.

Defined cases: null and empty texts, and texts without words, have an empty set and stay alone; equal sets
are copies; rows that share a doc_id count as one document; a row without doc_id is linked with nothing
and is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, written
from .components import components
from .shingles import U64, band_keys, mix, shingle_sets, sketches
from .tokens import per_process

WORDS, PERCENT = 4, 80
BINS, BAND_ROWS = 160, 5
#: Rounds of hubs; members of a block, and about how many shingles; blocks along a side of a cell; salts of a hub.
ROUNDS, BLOCK, BLOCK_SHINGLES, GRID, SALTS = 2, 256, 250_000, 16, 32

SKETCHED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>"


def pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes of text each."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        gone = lengths[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(lengths, gone + size)))
        yield batch.slice(start, stop - start)
        start = stop


def sketcher(words: int, bins: int, band_rows: int):
    """For mapInArrow: (doc_id, text) to SKETCHED; rows of empty sets have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_process("near_dedup")
        for whole in batches:
            for batch in pieces(whole, "text"):
                prints, bounds = shingle_sets(batch.column("text").fill_null(""), words)
                sizes = np.diff(bounds)
                keys = band_keys(sketches(prints, bounds, bins), band_rows)
                sums = np.zeros((2, len(prints) + 1), dtype=U64)
                for k in range(2):
                    np.cumsum(mix(prints + U64(k + 1)), out=sums[k, 1:])
                digests = [mix(s[bounds[1:]] - s[bounds[:-1]] + sizes.astype(U64)).view(np.int64) for s in sums]
                held = np.where(sizes > 0, keys.shape[1], 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(keys[sizes > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *map(pa.array, digests), lists], names=["doc_id", "n_shingles", "d1", "d2", "keys"])

    return run


def common_counts(x: np.ndarray, bx: np.ndarray, y: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all sets of y."""
    out = np.zeros((len(bx) - 1, len(by) - 1), dtype=np.int64)
    shared = np.intersect1d(x, y)
    rows = [np.repeat(np.arange(len(b) - 1), np.diff(b)) for b in (bx, by)]
    for start in range(0, len(shared), 20_000):
        part = shared[start : start + 20_000]
        sides = []
        for prints, own, n in ((x, rows[0], out.shape[0]), (y, rows[1], out.shape[1])):
            place = np.minimum(np.searchsorted(part, prints), len(part) - 1)
            use = part[place] == prints
            side = np.zeros((n, len(part)), dtype=np.float32)
            side[own[use], place[use]] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)  # each part is exact, being below 2^24
    return out


def forest(left: list[int], right: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between two lists of components, as many as join what they join, and no more."""
    parent = {c: c for c in (*left, *right)}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    kept = []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(linked)), strict=True):
        p, q = root(left[i]), root(right[j])
        if p != q:
            parent[p] = q
            kept.append((left[i], right[j]))
    return kept


def block_verifier(words: int, percent: int):
    """For mapInArrow: band and two blocks (lists of comp, text, keys) to links (a, b) between their components.

    All members are held against each other on their full sets, but for pairs that share the key of an earlier
    band than ``band``, which meet in that key's bucket; of the links found, a spanning forest is given
    out, less than one link for each member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                comps, texts, keys = [], [], []
                for side in ("left", "right"):
                    block = whole.column(side).slice(at, 1).flatten()
                    comps.append(block.field("comp").to_numpy(zero_copy_only=False))
                    texts.append(block.field("text"))
                    keys.append(np.asarray(block.field("keys").flatten()).reshape(len(block), -1))
                apart = comps[0][:, None] != comps[1][None, :]
                for band in range(whole.column("band")[at].as_py()):
                    apart &= keys[0][:, None, band] != keys[1][None, :, band]
                found: list[tuple[int, int]] = []
                if apart.any():
                    use = [np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))]
                    sets = [shingle_sets(t.take(pa.array(u)).fill_null(""), words) for t, u in zip(texts, use, strict=True)]
                    common = common_counts(*sets[0], *sets[1])
                    sizes = [np.diff(b) for _, b in sets]
                    linked = apart[np.ix_(*use)] & (common > 0) & (100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common))
                    found = forest(comps[0][use[0]].tolist(), comps[1][use[1]].tolist(), linked)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _blocks(n: Column, size: Column) -> Column:
    """Blocks for n members that have so many shingles together."""
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")


def star_links(own: Scratch, members: DataFrame, hubs: DataFrame, texts: DataFrame, check) -> DataFrame:
    """Links (a, b) between the components of hubs and of members held against them.

    ``members``: key, node, size, comp; ``hubs``: key, hub, hub_comp. A hub meets its members in blocks.
    """
    pairs = members.join(hubs, "key").where("comp <> hub_comp").select("hub", "hub_comp", "node", "comp", "size").distinct()
    pairs = own.written(pairs, "star-pairs")
    many = pairs.groupBy("hub").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("blocks"))
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hub may have very many members
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int"))
    dealt = salted.join(many, ["hub", "salt"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = dealt.join(texts, "node").groupBy("hub", "hub_comp", "block").agg(F.collect_list(F.struct("comp", "text", "keys")).alias("right"))
    left = texts.select(F.col("node").alias("hub"), "text", "keys")
    two = blocks.join(left, "hub").select(F.lit(0).alias("band"), F.array(F.struct(F.col("hub_comp").alias("comp"), "text", "keys")).alias("left"), "right")
    return own.written(two.mapInArrow(check, "a bigint, b bigint"), "star-links")


def rest_links(own: Scratch, members: DataFrame, texts: DataFrame, check) -> DataFrame:
    """Links (a, b) between the components of ``members`` (key, node, size, comp) that share a bucket.

    In each bucket, the members outside its commonest component meet one another and those inside it, in
    blocks. A bucket's blocks form a square, cut into cells of GRID x GRID blocks with a key each.
    """
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = F.max_by(F.struct("comp", "n", "size"), F.struct("n", "comp")).alias("most")
    buckets = sizes.groupBy("key").agg(most, F.sum("n").alias("n"), F.sum("size").alias("all")).where("n > most.n")
    buckets = buckets.select("key", F.col("most.comp").alias("main"), _blocks(F.col("most.n"), F.col("most.size")).alias("inside"), _blocks(F.col("n") - F.col("most.n"), F.col("all") - F.col("most.size")).alias("outside"))
    of = members.join(buckets, "key").withColumn("in_main", F.col("comp") == F.col("main"))
    of = of.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("inside")).otherwise(F.col("outside"))).cast("int"))
    of = of.join(texts, "node").withColumn("band", F.array_position("keys", F.col("key")).cast("int") - 1).where("band >= 0")
    held = of.groupBy("key", "band", "in_main", "block", "inside", "outside").agg(F.collect_list(F.struct("comp", "text", "keys")).alias("members"))
    held = own.written(held, "blocks")
    cells = lambda n: F.sequence(F.lit(0), F.ceil(F.col(n) / GRID).cast("int") - 1)
    cell = F.floor(F.col("block") / GRID).cast("int")
    left = held.where("not in_main").select("key", "band", F.col("block").alias("i"), cell.alias("row"), F.explode(F.array_distinct(F.concat(cells("inside"), cells("outside")))).alias("column"), F.col("members").alias("left"))
    right = held.select("key", "in_main", F.col("block").alias("j"), F.explode(cells("outside")).alias("row"), cell.alias("column"), F.col("members").alias("right"))
    two = left.join(right, ["key", "row", "column"]).where("in_main or i <= j").select("band", "left", "right")
    return own.written(two.mapInArrow(check, "a bigint, b bigint"), "rest-links")


def joined(classes: DataFrame, same: DataFrame, words: int, percent: int, docs: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) of every class; ``same``: links (a, b) beside those found."""
    check = block_verifier(words, percent)
    with Scratch(docs.sparkSession) as own:
        keyed = classes.select("node", F.col("n_shingles").alias("size"), F.explode("keys").alias("key"))
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = own.written(keyed.join(sizes, "key"), "members")
        # a class that shares keys with many others lies amid them: it makes a good hub
        centre = members.groupBy("node").agg(F.sum("n").alias("score"))
        members = own.written(members.join(centre, "node").select("key", "node", "size", "score"), "scored")
        held = classes.select("node", "keys").join(centre.select("node"), "node")
        texts = own.written(docs.select(F.col("doc_id").alias("node"), "text").join(held, "node"), "candidates")

        comps = centre.select("node", F.col("node").alias("comp"))
        # tested: hubs so far, which have met all of their bucket that is not in their component
        tested, outside = None, members.withColumn("comp", F.col("node"))
        for at in range(ROUNDS):
            hubs = outside.groupBy("key").agg(F.max_by(F.struct("node", "comp"), F.struct("score", -F.col("node"))).alias("h"))
            hubs = own.written(hubs.select("key", F.col("h.node").alias("hub"), F.col("h.comp").alias("hub_comp")), "hubs")
            comps = own.written(_again(comps, components(star_links(own, members.join(comps, "node"), hubs, texts, check), own)), "comps")
            met = hubs.select("key", "hub")
            tested = met if tested is None else tested.unionByName(met)
            # the members whose component holds no hub of their bucket
            placed = tested.join(comps, F.col("hub") == F.col("node")).select("key", "comp").distinct()
            outside = members.join(comps, "node").join(placed, ["key", "comp"], "left_anti")
        left = members.join(tested.select("key", F.col("hub").alias("node")), ["key", "node"], "left_anti").join(comps, "node").select("key", "node", "size", "comp")
        comp = lambda k: comps.select(F.col("node").alias(k), F.col("comp").alias(f"{k}_comp"))
        same = same.join(comp("a"), "a", "left").join(comp("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
        grouped = components(rest_links(own, own.written(left, "left"), texts, check).unionByName(same), own)
        comps = classes.select("node").distinct().join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
        return written(_again(comps, grouped), "joined")


def _again(comps: DataFrame, grouped: DataFrame) -> DataFrame:
    """``comps`` after links between them have grouped some."""
    return comps.join(grouped.select(F.col("node").alias("comp"), "component"), "comp", "left").select("node", F.coalesce("component", "comp").alias("comp"))


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sketched = written(docs.mapInArrow(sketcher(words, BINS, BAND_ROWS), SKETCHED), "sketches")
    real = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = written(real.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("least")).select("d1", "d2", F.col("least.doc_id").alias("node"), "least.n_shingles", "least.keys"), "classes")
    # rows that share a doc_id are one document: their classes are linked
    again = real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    repeated = real.join(again, "doc_id").join(classes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node").distinct()
    same = repeated.join(repeated.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
    comps = joined(classes, same, words, percent, docs)
    labels = classes.select("d1", "d2", "node").join(comps, "node").select("d1", "d2", F.col("comp").alias("component"))
    placed = sketched.select("doc_id", "n_shingles", "d1", "d2").join(labels, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``."""
    return near_groups(table(spark, sf_dir, "documents"))
