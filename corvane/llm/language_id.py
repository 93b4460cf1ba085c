"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A trigram is bound from the vectors of its letters,
permuted once for each place from the end; a text is the bundle (sum) of its trigrams; a language's
prototype is the bundle of all its training texts. A text gets the language whose prototype has the
largest cosine with it.

The trigrams of all training texts are counted in one pass over the corpus, so that what reaches the
driver is one count for each language and trigram (at most 64^3 a language), and no text.

Defined cases: null text or text without a letter is ``und`` with score 0; with nothing to learn from
every text is ``und``; ties go to the first language in alphabetical order; a null doc_id is neither
held out nor learnt from; texts of any length are read whole, very long ones one at a time; repeated rows give
repeated rows; an empty table gives an empty result; further columns are passed on, but for ones named lang_pred or
score, which give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import per_process

CLASSES = 64
DIMENSIONS = 512
SEED = 20_260
#: Texts that are worked on together, and the most characters of them together (longer texts are alone).
TOGETHER, CHARACTERS = 64, 200_000

UNDETERMINED = "und"


def letter_classes() -> np.ndarray:
    """Class of each code point: 0 for none, 1-26 for a-z, 27-63 for other letters; case is ignored."""
    kept = per_process("language_id")
    if "letter_classes" not in kept:
        classes = np.zeros(0x110000, dtype=np.uint8)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = ord(char.lower()[0])
                classes[point] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        kept["letter_classes"] = classes
    return kept["letter_classes"]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' numbers and trigram codes, one of each a trigram; runs of other characters are one gap."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    own = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    letters = letter_classes()[points]
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0) | (own[1:] != own[:-1])
    letters, own = letters[keep].astype(np.int32), own[keep]
    whole = own[2:] == own[:-2]
    return own[2:][whole], ((letters[:-2] * CLASSES + letters[1:-1]) * CLASSES + letters[2:])[whole]


class Space:
    """The vectors of trigrams; of the first HELD that are met they are kept (64 MB), others are bound when needed."""

    HELD, AT_ONCE = 32_768, 8_192

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.float32), (CLASSES, dimensions))
        self.places = [np.roll(letters, shift, axis=1) for shift in (2, 1, 0)]
        self.row = np.full(CLASSES**3, -1, dtype=np.int32)
        self.vectors = np.empty((self.HELD, dimensions), dtype=np.float32)
        self.used = 0

    @staticmethod
    def held() -> Space:
        kept = per_process("language_id")
        if "trigram_space" not in kept:
            kept["trigram_space"] = Space()
        return kept["trigram_space"]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        return self.places[0][codes // CLASSES**2] * self.places[1][codes // CLASSES % CLASSES] * self.places[2][codes % CLASSES]

    def bundle(self, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The sums of the codes' vectors, each row of ``counts`` times."""
        new = codes[self.row[codes] < 0][: self.HELD - self.used]
        for start in range(0, len(new), self.AT_ONCE):
            part = new[start : start + self.AT_ONCE]
            self.row[part] = self.used + np.arange(len(part))
            self.vectors[self.used : self.used + len(part)] = self.bind(part)
            self.used += len(part)
        out = np.zeros((len(counts), self.vectors.shape[1]), dtype=counts.dtype)
        for start in range(0, len(codes), self.AT_ONCE):
            part = codes[start : start + self.AT_ONCE]
            rows = self.row[part]
            out += counts[:, start : start + self.AT_ONCE] @ (self.vectors[rows] if (rows >= 0).all() else self.bind(part))
        return out


def bundles(texts: list[str], space: Space) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and whether it has a letter."""
    own, codes = trigrams(texts)
    present = np.zeros(CLASSES**3, dtype=bool)
    present[codes] = True
    distinct = np.flatnonzero(present)
    place = np.zeros(CLASSES**3, dtype=np.int64)
    place[distinct] = np.arange(len(distinct))
    counts = np.bincount(own * max(1, len(distinct)) + place[codes], minlength=len(texts) * max(1, len(distinct)))
    lettered = np.bincount(own[(codes // CLASSES % CLASSES) > 0], minlength=len(texts)) > 0
    return space.bundle(counts.reshape(len(texts), -1).astype(np.float32)[:, : len(distinct)], distinct), lettered


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= TOGETHER or size + len(t or "") > CHARACTERS):
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in sums.items():
            codes = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int32()), pa.array(counts[codes], pa.int64())], names=["lang", "code", "n"])
        sums.clear()

    for batch in batches:
        langs, texts = (batch.column(c).to_pylist() for c in ("lang", "text"))
        for a, b in slices(texts):
            own, codes = trigrams([t or "" for t in texts[a:b]])
            of = np.array(langs[a:b], dtype=object)
            for lang in dict.fromkeys(langs[a:b]):
                counts = np.bincount(codes[(of == lang)[own]], minlength=CLASSES**3)
                sums[lang] = sums[lang] + counts if lang in sums else counts
            if len(sums) > 64:
                yield from flush()
    yield from flush()


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their prototypes (unit vectors) of all rows of (lang, text)."""
    counted = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(_count, "lang string, code int, n bigint")
    rows = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()  # at most 64^3 rows a language
    rows = rows.sort_values(["lang", "code"])
    rows = rows[(rows.code // CLASSES % CLASSES) > 0]
    space, langs, vectors = Space(), [], []
    for lang, own in rows.groupby("lang", sort=True):
        codes = own.code.to_numpy()
        vector = space.bundle(own.n.to_numpy(np.float64)[None, :], codes)[0]
        if (norm := np.linalg.norm(vector)) > 0:
            langs.append(str(lang))
            vectors.append(vector / norm)
    return langs, np.array(vectors, dtype=np.float32).reshape(len(langs), DIMENSIONS)


def predictor(langs: list[str], prototypes: np.ndarray, columns: list[str]):
    """For mapInArrow: ``columns`` and text to ``columns``, lang_pred, score."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space.held()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found: list[str] = []
            scores: list[float] = []
            for a, b in slices(texts):
                vectors, lettered = bundles([t or "" for t in texts[a:b]], space)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = vectors @ prototypes.T / np.where(norms > 0, norms, 1)[:, None] if langs else np.zeros((b - a, 1))
                for best, row, ok in zip(cosines.argmax(axis=1).tolist(), cosines, lettered & (len(langs) > 0), strict=True):
                    found.append(langs[best] if ok else UNDETERMINED)
                    scores.append(min(1.0, max(0.0, float(row[best]))) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """All columns of ``docs`` (text among them), and lang_pred and score."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return docs.select(*columns).mapInArrow(predictor(langs, prototypes, columns), schema + ", lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    langs, prototypes = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    rows = identify(docs.select("doc_id", "text"), langs, prototypes)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
