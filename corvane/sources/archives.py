"""Archives of predictions: one npz file a member, <method>__<set>.npz, as rows of a data source.

    read_archives(spark, path, methods=["edl"])

A member is a partition, read in blocks of rows, so a task holds a block of each of its arrays. method and set (``/`` in a set's name is ``__`` in
the file's) are told by the name, so members that are not asked for stay unopened. The schema comes from the headers of the first
member of each method. Paths are those that pyarrow's file systems know (local, hdfs, s3).
"""

from __future__ import annotations

import io
import json
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

#: Rows of a block.
BLOCK = 4096
NAMED = [StructField("method", StringType()), StructField("part", StringType()), StructField("row", LongType())]


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def file_name(method: str, part: str) -> str:
    return f"{method}__{part.replace('/', '__')}.npz"


@dataclass(frozen=True)
class Member(InputPartition):
    method: str
    part: str
    path: str


def members(path: str) -> list[Member]:
    """The members of a folder, by name."""
    files, folder = _located(path)
    found = []
    for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        name = info.base_name
        if info.is_file and name.endswith(".npz"):
            method, _, part = name[:-4].partition("__")
            found.append(Member(method, part.replace("__", "/"), f"{path.rstrip('/')}/{name}"))
    return sorted(found, key=lambda m: (m.method, m.part))


def chosen(path: str, wanted: dict[str, list[str]]) -> list[Member]:
    return [m for m in members(path) if all(getattr(m, c) in values for c, values in wanted.items())]


def _header(entry: IO[bytes]) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(entry)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(entry)
    if fortran and len(shape) > 1:
        raise ValueError("arrays in column order are not read")
    return shape, kind


def _fields(path: str) -> list[StructField]:
    """A column for each array of a member: whole numbers or doubles, or arrays of them."""
    files, at = _located(path)
    out = []
    with files.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        for name in sorted(z.namelist()):
            with z.open(name) as entry:
                shape, kind = _header(entry)
            value = LongType() if kind.kind in "iub" else DoubleType()
            for _ in shape[1:]:
                value = ArrayType(value)
            out.append(StructField(name.removesuffix(".npy"), value))
    return out


def _nested(block: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of any number of dimensions as an Arrow array."""
    if block.ndim == 1:
        return pa.array(block).cast(kind)
    size = int(block.shape[1])
    inner = _nested(block.reshape(-1, *block.shape[2:]), kind.value_type)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * size), inner).cast(kind)


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, wanted: dict[str, list[str]]):
        self.path, self.schema, self.wanted = path, schema, wanted

    def partitions(self) -> list[Member]:
        return chosen(self.path, self.wanted)

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        files, at = _located(partition.path)
        with files.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            entries = {n.removesuffix(".npy"): z.open(n) for n in z.namelist()}
            heads = {n: _header(e) for n, e in entries.items()}
            lengths = {shape[0] for shape, _ in heads.values()}
            if len(lengths) != 1:
                raise ValueError(f"arrays of {partition.path} differ in length")
            for start in range(0, lengths.pop(), BLOCK):
                columns: dict[str, pa.Array] = {}
                n = 0
                for name, (shape, kind) in heads.items():
                    n = min(BLOCK, shape[0] - start)
                    width = int(np.prod(shape[1:], dtype=np.int64))
                    raw = entries[name].read(n * width * kind.itemsize)
                    if name in kinds.names:
                        columns[name] = _nested(np.frombuffer(raw, dtype=kind).reshape(n, *shape[1:]), kinds.field(name).type)
                columns |= {"method": pa.array([partition.method] * n), "part": pa.array([partition.part] * n), "row": pa.array(np.arange(start, start + n))}
                yield pa.RecordBatch.from_arrays([columns[k.name].cast(k.type) if k.name in columns else pa.nulls(n, k.type) for k in kinds], schema=kinds)


class PredictionArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prediction_archives"

    def wanted(self) -> dict[str, list[str]]:
        return {c: json.loads(self.options[c]) for c in ("method", "part") if c in self.options}

    def schema(self) -> StructType:
        """method, part, row, and the arrays of all methods; a method that lacks one has nulls there."""
        first: dict[str, Member] = {}
        for m in chosen(self.options["path"], self.wanted()):
            first.setdefault(m.method, m)
        fields: dict[str, StructField] = {}
        for m in first.values():
            for f in _fields(m.path):
                fields.setdefault(f.name, f)
        return StructType([*NAMED, *fields.values()])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, self.wanted())


def read_archives(spark: SparkSession, path: str, methods: list[str] | None = None, parts: list[str] | None = None) -> DataFrame:
    """The rows of all members, or of these methods and sets; other members are not opened.

    Which members are read is said here and not by pushed filters: Spark 4.1 keeps what has been pushed to a source in Python with
    the frame it was pushed from, so a second query on that frame would miss rows.
    """
    spark.dataSource.register(PredictionArchives)
    wanted = {"method": methods, "part": parts}
    return spark.read.format("prediction_archives").options(**{c: json.dumps(v) for c, v in wanted.items() if v is not None}).load(path)


def write_archives(rows: DataFrame, path: str, order: str = "row", force: bool = False) -> list[str]:
    """One member for each (method, part) of ``rows``, its other columns as arrays in the order of ``order``; the names of those written.

    Members that are there already stay as they are, unless ``force``. A member is written by one task, which spools its arrays
    to its own disk and holds a batch of rows; it appears whole or not at all.
    """
    arrays = [c for c in rows.columns if c not in ("method", "part", order)]
    _located(path)[0].create_dir(_located(path)[1], recursive=True)
    there = [] if force else [(m.method, m.part) for m in members(path)]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spools = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            if at is None:
                return
            name = file_name(*at)
            files, target = _located(f"{path.rstrip('/')}/{name}")
            with files.open_output_stream(f"{target}.part") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
                for column, (spool, shape, kind) in spools.items():
                    head = io.BytesIO()
                    np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": tuple(shape)})
                    spool.seek(0)
                    with z.open(f"{column}.npy", "w", force_zip64=True) as entry:
                        entry.write(head.getvalue())
                        while block := spool.read(1 << 20):
                            entry.write(block)
                    spool.close()
            files.move(f"{target}.part", target)
            yield pa.RecordBatch.from_pydict({"name": [name]})

        for batch in batches:
            keys = list(zip(batch.column("method").to_pylist(), batch.column("part").to_pylist(), strict=True))
            starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[a] != at:
                    yield from close()
                    at, spools = keys[a], {}
                for column in arrays:
                    block = np.array(batch.column(column).slice(a, b - a).to_pylist())
                    block = block.astype(np.int64 if block.dtype.kind in "iub" else np.float32)
                    if column not in spools:
                        spools[column] = (tempfile.TemporaryFile(), [0, *block.shape[1:]], block.dtype)
                    spools[column][0].write(np.ascontiguousarray(block).tobytes())
                    spools[column][1][0] += len(block)
        yield from close()

    todo = rows.where(~rows["method"].isNull() & ~rows["part"].isNull())
    if there:
        todo = todo.join(rows.sparkSession.createDataFrame(there, "method string, part string"), ["method", "part"], "left_anti")
    dealt = todo.repartition("method", "part").sortWithinPartitions("method", "part", order)
    return sorted(r.name for r in dealt.mapInArrow(write, "name string").collect())
