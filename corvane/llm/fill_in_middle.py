"""Fill-in-middle: each text cut at two seeded token boundaries, its parts put in another order.

Copies of a text share one entry of a distinct-text index: the text's token boundaries as an Elias-Fano list, from which
any boundary is selected without going through the text again. Texts travel once: rows meet by a 64-bit hash of
their text and lie together in their partition, where the index takes up each new text, tells equal texts by
their whole content (colliding hashes only share a place), and gives each of the rows its own cut. An index written as a
table and joined back would move all texts a second time.

The rows of a text that has more than its share are dealt out over several partitions, each of which lists its boundaries once;
hashes and counts of such texts are all that is broadcast, fewer than four times the shuffle partitions.

Defined cases: null text is empty and so plain with no tokens; a text that contains a marker is plain; a null doc_id is
seeded as an empty string; a text is held whole, with its list, while its rows are cut, so memory is bounded by the
longest text and not by the number of copies; equal texts under different doc_ids get different cuts, repeated rows the same; an
empty table gives an empty result; further columns are passed on, but for ones with the names of those added, which give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import hot_keys, salted, table

# fixed values: the markers of prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
#: Of 100 texts, those turned at all, and of 100 turned ones those with the suffix first.
TURNED, SUFFIX_FIRST = 90, 20
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class Boundaries:
    """A rising list of numbers as Elias-Fano: low bits packed one after the other, high bits in unary.

    ``ranks`` holds the place of every 64th one of the unary part, so that a selection looks at the bits between two of them.
    """

    EVERY = 64

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.low_bits = max(0, int(values[-1] // self.n).bit_length() - 1) if self.n else 0
        places = (values >> self.low_bits) + np.arange(self.n)
        unary = np.zeros(int(places[-1]) + 1 if self.n else 0, dtype=np.uint8)
        unary[places] = 1
        self.high = np.packbits(unary)
        self.ranks = places[:: self.EVERY]
        low = (values[:, None] >> np.arange(self.low_bits)) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes()

    def select(self, k: int) -> int:
        """The value at place ``k``, from 0."""
        block = k // self.EVERY
        start = int(self.ranks[block])
        stop = int(self.ranks[block + 1]) if block + 1 < len(self.ranks) else 8 * len(self.high)
        first = start // 8
        ones = np.flatnonzero(np.unpackbits(self.high[first : (stop + 7) // 8])[start - 8 * first :])
        high = start + int(ones[k % self.EVERY]) - k
        at = k * self.low_bits
        chunk = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8], "little")
        return high << self.low_bits | (chunk >> at % 8) & ((1 << self.low_bits) - 1)


def boundaries(text: str) -> Boundaries:
    """Where the tokens ``[A-Za-z]+|[^A-Za-z]`` of ``text`` end, in code points."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)
    inside = letter[:-1] & letter[1:]
    return Boundaries(np.append(np.flatnonzero(~inside) + 1, len(points)) if len(points) else np.empty(0, dtype=np.int64))


def cut(text: str, ends: Boundaries, seeds: list[int]) -> tuple[str, int | None, int | None, str]:
    """form, characters of prefix and middle, output."""
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or seeds[2] % 100 >= TURNED:
        return "plain", None, None, text
    at = [ends.select(k - 1) if k else 0 for k in sorted(h % (ends.n + 1) for h in seeds[:2])]
    prefix, middle, suffix = text[: at[0]], text[at[0] : at[1]], text[at[1] :]
    if seeds[3] % 100 < SUFFIX_FIRST:
        return "spm", len(prefix), len(middle), SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", len(prefix), len(middle), PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, index = None, {}  # the hash met now, and boundaries by text of this hash: more than one text only where hashes collide
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_key", "_text", "_seeds")]
        done = []
        for key, text, seeds in zip(*columns, strict=True):
            if key != at:
                at, index = key, {}
            if text not in index:
                index[text] = boundaries(text)
            done.append((index[text].n, *cut(text, index[text], seeds)))
        n, form, before, within, output = zip(*done, strict=True) if done else [()] * 5
        arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(output, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), *arrays], names=["_row", *ADDED])


def seeds(doc_id: str = "doc_id", seed: int = 1) -> Column:
    """Four numbers below 2^32 from the digest of the seed and the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1, key: Column | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, and n (tokens), form, prefix_chars, middle_chars, output."""
    rest = [c for c in docs.columns if c not in (text, *ADDED)]
    content = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64(content) if key is None else key
    _, hot = hot_keys(docs.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("n")), ["_key"])
    keyed = docs.select(F.struct(*rest).alias("_row"), content.alias("_text"), seeds(doc_id, seed).alias("_seeds"), key.alias("_key"))
    together = salted(keyed, hot, ["_key"]).repartition("_key", "_salt").sortWithinPartitions("_key")
    added = StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    made = together.select("_key", "_text", "_seeds", "_row").mapInArrow(_cuts, StructType([keyed.schema["_row"], *added]))
    return made.select(*[F.col("_row").getField(c).alias(c) for c in rest], *ADDED)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of."""
    first, second, last = (F.get(F.split(output, MARKER, -1), i) for i in (1, 2, 3))
    psm, spm = F.concat(first, last, second), F.concat(second, last, first)
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cut and digests of every whole text of ``documents``."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS digest FROM documents
), h AS (
  SELECT *, len(units) AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2, ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
