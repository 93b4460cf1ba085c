"""Several tables published at once: a version is a list of their files, and readers hold on to the version they opened.

A publication writes its tables to folders of their own and then puts down one file, versions/<number>.json, which names all tables of
the new version. Before that file is there nobody sees anything of them, so a publication that fails shows nothing;
what earlier versions name stays until prune(). Numbers are claimed by creating a file that must not exist yet, so of two
publications on top of one version one is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corvane.session import remove


class Conflict(Exception):
    """Another publication came first."""


@dataclass(frozen=True)
class Part:
    """A table's files of one publication."""

    path: str
    schema: str
    version: int


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def _children(spark: SparkSession, path: str) -> list[str]:
    files, held = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(held)) if files.exists(held) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions there are, oldest first."""
    return [int(n[:-5]) for n in _children(spark, f"{root}/versions") if n.endswith(".json")]


@dataclass(frozen=True)
class Version:
    """What one version names; nothing that is published later changes it. ``facts`` are small values that belong to it."""

    spark: SparkSession
    root: str
    number: int
    tables: dict[str, tuple[Part, ...]]
    facts: dict[str, Any]

    def parts(self, name: str) -> list[tuple[int, DataFrame]]:
        """(version that wrote it, rows) of each part of a table."""
        return [(p.version, self.spark.read.schema(p.schema).parquet(p.path)) for p in self.tables.get(name, ())]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"version {self.number} has no table {name!r}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows for _, rows in self.parts(name)])


def opened(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The version of this number, or the newest; an empty one (0) if there is none."""
    root = root.rstrip("/")
    if number is None:
        number = max(versions(spark, root), default=0)
    if number == 0:
        return Version(spark, root, 0, {}, {})
    text = spark.read.text(f"{root}/versions/{number:08d}.json", wholetext=True).first()[0]
    said = json.loads(text)
    return Version(spark, root, number, {name: tuple(Part(**p) for p in parts) for name, parts in said["tables"].items()}, said["facts"])


def publish(base: Version, add: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, facts: dict[str, Any] | None = None, most: dict[str, int] | None = None) -> Version:
    """A new version on top of ``base``: parts added to tables, tables replaced, facts set; ``most`` rows a file of a table at most.

    Raises Conflict if another version has been published on top of ``base``.
    """
    spark, root, number = base.spark, base.root, base.number + 1
    taken = f"{number:08d}"
    files, claim = _files(spark, f"{root}/claims/{taken}")
    if files.exists(_files(spark, f"{root}/versions/{taken}.json")[1]):
        raise Conflict(f"version {number} is there already")
    home = f"{root}/data/{uuid.uuid4().hex}"
    tables = {name: list(parts) for name, parts in base.tables.items()}
    try:
        for name, rows in {**(add or {}), **(replace or {})}.items():
            rows.write.option("maxRecordsPerFile", (most or {}).get(name, 0)).parquet(f"{home}/{name}")
            part = Part(f"{home}/{name}", rows._jdf.schema().toDDL(), number)
            tables[name] = [part] if name in (replace or {}) else [*tables.get(name, []), part]
        if not files.createNewFile(claim):
            raise Conflict(f"version {number} is being published by another")
    except Exception:
        remove(spark, home)
        raise
    said = {"tables": {n: [p.__dict__ for p in parts] for n, parts in tables.items()}, "facts": {**base.facts, **(facts or {})}}
    _put(spark, f"{root}/versions/{taken}.json", json.dumps(said))
    return opened(spark, root, number)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    files, part = _files(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(part, False)
    out.write(text.encode())
    out.close()
    if not files.rename(part, _files(spark, path)[1]):
        raise OSError(f"could not put {path} in place")


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions, and the files that no version names any more."""
    root = root.rstrip("/")
    there = versions(spark, root)
    for number in there[:-keep]:
        remove(spark, f"{root}/versions/{number:08d}.json")
    named = {p.path.rsplit("/", 2)[1] for n in there[-keep:] for parts in opened(spark, root, n).tables.values() for p in parts}
    for home in _children(spark, f"{root}/data"):
        if home not in named:
            remove(spark, f"{root}/data/{home}")
