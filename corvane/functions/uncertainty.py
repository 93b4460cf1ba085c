"""Column functions on class probabilities: scores of uncertainty, calibration terms, evidential losses."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvane.functions.text import let

LEAST = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / total(powers))


def msp(probs: Column) -> Column:
    """One less the largest probability."""
    return 1 - F.array_max(probs)


def entropy(probs: Column) -> Column:
    return -total(F.transform(probs, lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(LEAST)) * F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(LEAST)))))


def mean_probs(samples: Column) -> Column:
    """The mean of an array of probability vectors."""
    n = F.size(samples)
    return F.transform(F.get(samples, F.lit(0)), lambda _, i: total(F.transform(samples, lambda s: F.get(s, i))) / n)


def mutual_information(samples: Column) -> Column:
    """Entropy of the mean less the mean entropy."""
    return entropy(mean_probs(samples)) - total(F.transform(samples, entropy)) / F.size(samples)


def dirichlet_alpha(logits: Column) -> Column:
    """softplus + 1."""
    return F.transform(logits, lambda x: F.log1p(F.exp(x)) + 1)


def dirichlet_mean(alpha: Column) -> Column:
    return F.transform(alpha, lambda a: a / total(alpha))


def vacuity(alpha: Column) -> Column:
    return F.size(alpha) / total(alpha)


def argmax(probs: Column) -> Column:
    """Index from 0 of the first largest."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def brier(probs: Column, label: Column) -> Column:
    return total(F.transform(probs, lambda p, i: F.pow(p - (i == label).cast("double"), F.lit(2.0))))


def nll(probs: Column, label: Column) -> Column:
    return -F.ln(F.greatest(F.least(F.get(probs, label), F.lit(1.0)), F.lit(LEAST)))


def confidence_bin(probs: Column, bins: int = 15) -> Column:
    """Bin of the largest probability; bins are closed to the right, the first to both sides."""
    conf = F.array_max(probs)
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: conf > e))


def edl_fit(evidence: Column, label: Column, kind: str) -> Column:
    """The data term of the evidential loss: ``mse`` or ``log``."""
    alpha = F.transform(evidence, lambda e: e + 1)
    s = total(alpha)
    y = lambda i: (i == label).cast("double")
    if kind == "mse":
        return total(F.transform(alpha, lambda a, i: F.pow(y(i) - a / s, F.lit(2.0)) + a / s * (1 - a / s) / (s + 1)))
    if kind == "log":
        return total(F.transform(alpha, lambda a, i: y(i) * (F.ln(s) - F.ln(a))))
    raise ValueError(f"unknown kind {kind!r}")


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, dtype=np.float64), np.zeros(np.shape(x))
    for _ in range(6):
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def lgamma(x: np.ndarray) -> np.ndarray:
    from math import lgamma as one

    return np.vectorize(one, otypes=[float])(x)


def edl_loss_udf(anneal: int = 10):
    """Series of (evidence, label, epoch) to the loss with the digamma data term and the annealed KL term."""

    @F.pandas_udf(DoubleType())
    def loss(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for evidence, label, epoch in parts:
            alpha = np.array(evidence.tolist(), dtype=np.float64).reshape(len(evidence), -1) + 1
            y = np.eye(alpha.shape[1])[label.to_numpy()] if len(label) else alpha
            s = alpha.sum(axis=1, keepdims=True)
            fit = (y * (digamma(s) - digamma(alpha))).sum(axis=1)
            rest = y + (1 - y) * alpha
            t = rest.sum(axis=1, keepdims=True)
            kl = lgamma(t)[:, 0] - lgamma(np.full(len(t), float(alpha.shape[1]))) - lgamma(rest).sum(axis=1) + ((rest - 1) * (digamma(rest) - digamma(t))).sum(axis=1)
            yield pd.Series(fit + np.minimum(1.0, epoch.to_numpy() / max(1, anneal)) * kl)

    return loss


def clamped(values: Column) -> Column:
    return F.transform(values, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def contrast(values: Column, p: Column) -> Column:
    return clamped(let(total(values) / F.size(values), lambda mean: F.transform(values, lambda x: (x - mean) * p + mean)))


def brightness(values: Column, p: Column) -> Column:
    return clamped(F.transform(values, lambda x: x + p))


def normal_draws(row: Column, n: int, seed: int = 0) -> Column:
    """``n`` standard normal numbers of a row, each from the digest of seed, row and its place: no partitioning changes them."""

    def draw(i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), i.cast("string")).cast("binary"))
        whole = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double")
        return F.sqrt(-2 * F.log((whole(1) + 1) / float(2**32 + 1))) * F.cos(2 * math.pi * whole(9) / float(2**32))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw)


def noise(values: Column, draws: Column, deviation: Column) -> Column:
    """Noise of this deviation on top."""
    return clamped(F.zip_with(values, draws, lambda x, z: x + z * deviation))


def blur_weights(n: int, sigma: float) -> np.ndarray:
    """What each of ``n`` pixels in a line takes of the others: a Gaussian of three deviations on either side, mirrored at the ends."""
    reach = round(3 * sigma)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    out = np.zeros((n, n))
    turn = max(1, 2 * (n - 1))
    for i in range(n):
        for k, weight in enumerate(taps):
            at = (i + k - reach) % turn
            out[i, min(at, turn - at)] += weight
    return out


def box_weights(n: int, factor: float) -> np.ndarray:
    """The same for blocks: a line averaged down to ``factor`` of its length by overlapping boxes, and blown up again."""
    small = max(1, int(n * factor))
    out = np.zeros((n, n))
    for i in range(n):
        box = i * small // n
        first, last = box * n // small, -(-(box + 1) * n // small)
        out[i, first:last] = 1 / (last - first)
    return out


def resampled(weights: Callable[[int, float], np.ndarray], parameter: float, shape: tuple[int, int, int]) -> Callable[[Column], Column]:
    """A column function: pixels (channels, height, width, in one array) mixed along both axes, each channel by itself.

    Arrays of another length give null.
    """
    channels, height, width = shape
    mixed = np.kron(np.eye(channels), np.kron(weights(height, parameter), weights(width, parameter)))

    def run(parts: pa.Array) -> pa.Array:
        there = pc.fill_null(pc.equal(pc.list_value_length(parts), len(mixed)), False)
        rows = parts.filter(there).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, len(mixed)) @ mixed.T
        ends = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))]) * len(mixed)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.clip(rows, 0.0, 1.0, out=rows).reshape(-1)), mask=pc.invert(there))

    return F.arrow_udf(run, "array<double>")


def corrupted(rows: DataFrame, row: str, values: str, shape: tuple[int, int, int], levels: dict[str, tuple[float, ...]], seed: int = 0) -> DataFrame:
    """``rows`` under each kind and severity (from 1): kind, severity and the changed ``values``, all in 0 to 1.

    Kinds: gaussian_noise (deviation), gaussian_blur (sigma), contrast (factor), brightness (what is added), pixelate (factor).
    Arrays of another length than the shape's give null.
    """
    channels, height, width = shape
    e, size = F.col("_e"), channels * height * width
    channel = lambda i: F.slice(e, i * height * width + 1, height * width)
    each = F.sequence(F.lit(0), F.lit(channels - 1))
    drawn = rows.withColumns({"_e": F.when(F.size(values) == size, F.col(values)), "_draws": normal_draws(F.col(row), size, seed)})
    make = {
        "gaussian_noise": lambda p: noise(e, F.col("_draws"), F.lit(p)),
        "gaussian_blur": lambda p: resampled(blur_weights, p, shape)(e),
        "contrast": lambda p: F.flatten(F.transform(each, lambda i: contrast(channel(i), F.lit(p)))),
        "brightness": lambda p: brightness(e, F.lit(p)),
        "pixelate": lambda p: resampled(box_weights, p, shape)(e),
    }
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("severity"), make[kind](p).alias(values)) for kind, own in levels.items() for i, p in enumerate(own, 1)])
    return drawn.select(*[c for c in rows.columns if c != values], F.inline(kinds))
