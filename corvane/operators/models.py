"""Models of one's own as column functions, on Arrow batches: embedders, rerankers, tokenizers, language models.

Each takes a ``load`` that gives the model: it is called once in every Python worker that needs it, so models
need not travel with the plan. Texts go to the model in batches; null texts stay null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

Load = Callable[[], Callable]
TOKENS = ArrayType(StructType([StructField("id", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def _mapped(load: Load, kind: DataType, batch: int, finish: Callable = lambda value: value) -> Callable[..., Column]:
    """A column function over one or more columns: rows without nulls go to the model, ``batch`` at a time."""

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in parts:
            columns = columns if isinstance(columns, tuple) else (columns,)
            there = np.flatnonzero(np.logical_and.reduce([c.notna().to_numpy() for c in columns]))
            out: list = [None] * len(columns[0])
            for start in range(0, len(there), batch):
                at = there[start : start + batch]
                rows = [*zip(*(c.iloc[at] for c in columns), strict=True)]
                values = model([r[0] for r in rows] if len(columns) == 1 else rows)
                if len(values) != len(at):
                    raise ValueError(f"the model gave {len(values)} values for {len(at)} rows")
                for i, value in zip(at, values, strict=True):
                    out[i] = finish(value)
            yield pd.Series(out, dtype=object)

    def one(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(parts)

    def two(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from run(parts)

    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)


def _unit(vector: object) -> list[float]:
    x = np.asarray(vector, dtype=np.float64)
    norm = np.linalg.norm(x)
    return (x / norm if norm else x).tolist()


def embedder(load: Load, batch: int = 64) -> Callable[[Column], Column]:
    """text -> unit vector, by a model of list[str] to vectors."""
    return _mapped(load, ArrayType(DoubleType()), batch, _unit)


def reranker(load: Load, batch: int = 64) -> Callable[[Column, Column], Column]:
    """(query, text) -> score, by a model of list[(query, text)] to numbers."""
    return _mapped(load, DoubleType(), batch, float)


def tokenizer(load: Load, batch: int = 256) -> Callable[[Column], Column]:
    """text -> array of (id, start, end), by a model of list[str] to lists of those."""
    return _mapped(load, TOKENS, batch, lambda tokens: [(int(i), int(a), int(b)) for i, a, b in tokens])


def completer(load: Load, batch: int = 8) -> Callable[[Column], Column]:
    """prompt -> reply, by a model of list[str] to list[str]: completions, chats and judges alike."""
    return _mapped(load, StringType(), batch)
