"""Nested settings laid over one another, and names made unique.

A tree of settings is rows of (path, value): which leaves stay when layers are laid over one another is then a join on paths and their beginnings,
for all trees at once, and a tree is built again from what is left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

EMPTY = "{}"
LEAVES = ArrayType(StructType([StructField("path", ArrayType(StringType())), StructField("value", StringType())]))


def _walk(tree: object, at: tuple[str, ...]) -> Iterator[tuple[list[str], str]]:
    if isinstance(tree, dict) and tree:
        for key, value in tree.items():
            yield from _walk(value, (*at, key))
    elif at:
        yield list(at), json.dumps(tree, sort_keys=True)


@F.pandas_udf(LEAVES)
def leaves(bodies: pd.Series) -> pd.Series:
    """A JSON object's leaves: path and value, as JSON; an empty object is a leaf, what is in a list is not."""
    return bodies.map(lambda body: [*_walk(json.loads(body), ())] if body is not None else [])


@F.pandas_udf(StringType())
def tree(held: pd.Series) -> pd.Series:
    """The JSON object with these leaves."""

    def build(rows: list) -> str:
        out: dict = {}
        for row in rows:
            at = out
            for key in row["path"][:-1]:
                at = at.setdefault(key, {})
            at[row["path"][-1]] = json.loads(row["value"])
        return json.dumps(out, sort_keys=True)

    return held.map(build)


def overlay(layers: DataFrame, by: str = "id", layer: str = "layer", body: str = "body") -> DataFrame:
    """by, body: the JSON objects of each ``by`` merged, higher layers over lower ones.

    Objects are merged key by key, whatever their depth; anything else replaces what was there. An empty object leaves
    an object as it is and replaces anything else. A layer that is null counts for nothing.
    """
    each = layers.select(F.col(by).alias("_id"), F.col(layer).alias("_layer"), F.explode(leaves(body)).alias("_l")).select("_id", "_layer", "_l.path", "_l.value")
    begins = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))
    # a leaf (below) beside each leaf (above) that stands at a beginning of its path, or at the path itself
    below = each.select(F.col("_id").alias("_b_id"), F.col("_layer").alias("_b_layer"), F.col("path").alias("_b_path"), F.explode(begins).alias("_begin"))
    pairs = below.join(each, (F.col("_b_id") == F.col("_id")) & (F.col("_begin") == F.col("path")) & (F.col("_b_layer") != F.col("_layer")))
    same, later = F.col("_b_path") == F.col("path"), F.col("_layer") > F.col("_b_layer")
    below_goes = pairs.where(later & (same | (F.col("value") != EMPTY))).select(F.col("_id"), F.col("_b_path").alias("path"), F.col("_b_layer").alias("_layer"))
    above_goes = pairs.where(~later).select("_id", "path", "_layer")
    left = each.join(below_goes.unionByName(above_goes).distinct(), ["_id", "path", "_layer"], "left_anti")
    # an empty object has nothing to say where leaves below it are left
    under = left.where(F.size("path") > 1).select("_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("path")).distinct().withColumn("_under", F.lit(True))
    kept = left.join(under, ["_id", "path"], "left").where((F.col("value") != EMPTY) | F.col("_under").isNull())
    built = kept.groupBy("_id").agg(tree(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("_body"))
    ids = layers.select(F.col(by).alias("_id")).distinct()
    return ids.join(built, "_id", "left").select(F.col("_id").alias(by), F.coalesce("_body", F.lit(EMPTY)).alias(body))


def unique_names(uploads: DataFrame, session: str, seq: str, name: str) -> DataFrame:
    """``uploads`` with ``unique``: the name, or the first of stem-2.ext, stem-3.ext, ... that nothing before it in the session has.

    A suffixed name may be that of another upload, so what a file is called hangs on all before it that share its stem but for such
    suffixes; each such family of a session is one group, in the order of ``seq``.
    """
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    family = F.concat(F.regexp_replace(stem, r"(-\d+)+$", ""), F.lit("/"), F.regexp_extract(name, r"\.[^.]*$", 0))
    rows = uploads.withColumn("_family", family)
    schema = StructType([*uploads.schema, StructField("unique", StringType())])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        following: dict[str, int] = {}  # all lower numbers of a name are taken
        out = []
        for own in (group := group.sort_values(seq, kind="stable"))[name]:
            path, found = PurePosixPath(own), own
            if found in seen:
                n = following.get(own, 2)
                while (found := f"{path.stem}-{n}{path.suffix}") in seen:
                    n += 1
                following[own] = n + 1
            seen.add(found)
            out.append(found)
        return group.drop(columns="_family").assign(unique=out)

    return rows.groupBy(session, "_family").applyInPandas(settle, schema)

