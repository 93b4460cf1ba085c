"""Token ids and counts by public vocabularies, with a bounded memo of white-space separated chunks.

A ``tokenizers`` model never merges across a cut before a space or newline that follows a character
which is no white space: the pre-tokenizers of the supported vocabularies start a new piece there.
So the ids of a text are the ids of its chunks, one after another, and each worker encodes a chunk once.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Callable, Iterable

import numpy as np

#: Chunks that a worker remembers before it starts anew, and the longest of them in characters; longer ones
#: are encoded each time. An entry is of 450 bytes at most (150 as a rule), so a memo is below 180 MB.
MEMO_CHUNKS, LONGEST = 400_000, 48
#: White space besides single spaces and line ends inside a text.
_UNSAFE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]|  | \n|\n ")
#: A single space between characters that are no white space.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def per_process(owner: str) -> dict:
    """What this process keeps from one task of ``owner`` to the next (this code itself comes anew with each task).

    A worker serves one owner at a time: what another has left is dropped.
    """
    module = sys.modules.setdefault("_corvane_kept", types.ModuleType("_corvane_kept"))
    if getattr(module, "owner", None) != owner:
        module.owner, module.kept = owner, {}
    return module.kept


def tokenizer(path: str):
    """The ``tokenizers`` model of a file, once per process and without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = per_process(f"tokens {path}")
    if path not in kept:
        from tokenizers import Tokenizer

        kept[path] = Tokenizer.from_file(path)
    return kept[path]


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Kept(dict):
    """What is known of chunks: short ones are kept, up to MEMO_CHUNKS; long ones until the next call of ``renew``."""

    def __init__(self):
        super().__init__()
        self.passing: list[str] = []

    def renew(self) -> None:
        for chunk in self.passing:
            self.pop(chunk, None)
        self.passing = []
        if len(self) > MEMO_CHUNKS:
            self.clear()

    def __setitem__(self, chunk: str, value: object) -> None:
        super().__setitem__(chunk, value)
        if len(chunk) > LONGEST:
            self.passing.append(chunk)


class Memo:
    """``make(ids)`` of each chunk; kept under ``name``."""

    def __init__(self, path: str, name: str, make: Callable):
        self.model, self.make = tokenizer(path), make
        self.held = per_process(f"tokens {path}").setdefault(f"{path}/{name}", Kept())

    def learn(self, chunks: set) -> dict:
        """The memo, with all ``chunks`` in it."""
        self.held.renew()
        new = [*chunks.difference(self.held)]
        for start in range(0, len(new), 4096):
            part = new[start : start + 4096]
            for chunk, encoded in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.held[chunk] = self.make(encoded.ids)
        return self.held


class WordMemo:
    """The ids of each chunk as bytes, for vocabularies whose words end in a mark of their own.

    Most chunks are one word of Latin letters and perhaps a punctuation mark, each a piece of its own to
    the pre-tokenizer. Such words are encoded many to a call and told apart by the marks in their ids.
    """

    SIMPLE = staticmethod(re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch)

    def __init__(self, path: str, end: str = "</w>"):
        self.model = tokenizer(path)
        kept = per_process(f"tokens {path}")
        self.held, self.words = kept.setdefault(f"{path}/chunks", Kept()), kept.setdefault(f"{path}/words", Kept())
        if f"{path}/ends" not in kept:
            ends = np.zeros(self.model.get_vocab_size(), dtype=bool)
            ends[[i for token, i in self.model.get_vocab().items() if token.endswith(end)]] = True
            kept[f"{path}/ends"] = ends
        self.ends = kept[f"{path}/ends"]
        self.marks = dict(zip(".,!?;:", self._encode([*".,!?;:"]), strict=True))

    def _encode(self, texts: list[str]) -> Iterable[bytes]:
        for at in range(0, len(texts), 4096):
            for encoded in self.model.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False):
                yield np.asarray(encoded.ids, "<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.asarray(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(part):  # not one mark a word: one by one
                self.words.update(zip(part, self._encode(part), strict=True))
                continue
            whole = ids.tobytes()
            self.words.update((w, whole[a:b]) for w, a, b in zip(part, [0, *stops], stops, strict=False))

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The memo, with all ``chunks`` in it."""
        held, words = self.held, self.words
        held.renew()
        words.renew()
        new = chunks.difference(held)
        simple, rest = [], []
        for c in new:
            word = c[:-1] if c[-1:] in self.marks else c
            (simple if len(c) <= LONGEST and self.SIMPLE(word) else rest).append(c)
        bare = [(c[:-1] if c[-1:] in self.marks else c).lower() for c in simple]
        self._learn_words([*set(bare).difference(words)])
        held.update((c, words[w] + self.marks.get(c[-1:], b"")) for c, w in zip(simple, bare, strict=True))
        for c, ids in zip(rest, self._encode(rest), strict=True):
            held[c] = ids
        return held


def word_chunks(text: str) -> list[str]:
    """Chunks of a text for vocabularies that drop white space."""
    return text.replace("\n", " ").split(" ")


def byte_chunks(text: str) -> list[str]:
    """Chunks of a text for byte-level vocabularies, where a space belongs to the word behind it."""
    if _UNSAFE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]
