"""Sizes of texts in tokens of a public tokenizer, and one-pass text features, in Arrow batches.

The rank-file tokenizers split a text before merging, and no part reaches over the place between a
visible character and the white space behind it. So a text falls into runs of leading white space
and one visible word, whose token counts add up exactly; each distinct run is encoded once per task
and remembered (``Counter.limit`` runs, then the memory starts anew). Vocabulary files stay where
they are; their folder is a parameter.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cache

import numpy as np

FOLDER = "/opt/tokenizers"
DEFAULT = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern published with the rank files; it splits a text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECE = re.compile(r"\s*\S+|\s+")


@cache
def encoding(name: str = DEFAULT, folder: str = FOLDER):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Token counts of runs, with a few pseudo-random directions of each run's word for document vectors."""

    def __init__(self, name: str = DEFAULT, folder: str = FOLDER, dims: int = 0, limit: int = 500_000):
        self.encode = encoding(name, folder).encode_ordinary
        self.dims, self.limit = dims, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens: list[int] = []
        self.words: list[str] = []

    def _make(self, piece: str) -> int:
        at = self.number[piece] = len(self.tokens)
        self.tokens.append(len(self.encode(piece)))
        self.words.append(piece)
        return at

    def read(self, text: str) -> list[int]:
        known, make = self.number, self._make
        return [known[p] if p in known else make(p) for p in _PIECE.findall(text)]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        return self._flat(texts)[0]

    def count_and_runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text and the number of its white-space separated runs."""
        tokens, _, owner = self._flat(texts)
        return tokens, np.bincount(owner, minlength=len(texts))

    def _flat(self, texts):
        if len(self.tokens) > self.limit:
            self.clear()
        lists = [self.read(t) for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        tokens = np.bincount(owner, np.array(self.tokens, np.float64)[ids] if len(ids) else None, len(texts))
        return tokens.astype(np.int64), ids, owner

    def count_and_place(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and its hashed bag of words projected to `dims` directions (unit variance, any length)."""
        tokens, ids, owner = self._flat(texts)
        place = np.zeros((len(texts), self.dims))
        if len(ids):
            if len(getattr(self, "_directions", ())) != len(self.words):
                self._directions = np.array([_direction(w.strip().lower(), self.dims) for w in self.words])
            counts = np.bincount(owner, minlength=len(texts))
            for d in range(self.dims):
                place[:, d] = np.bincount(owner, self._directions[ids, d], len(texts)) / np.sqrt(np.maximum(counts, 1))
        return tokens, place


@cache
def _salt(d: int) -> int:
    return 0x9E3779B97F4A7C15 * (d + 1) & 0xFFFFFFFFFFFFFFFF


def _direction(word: str, dims: int) -> list[float]:
    import xxhash

    h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
    out = []
    for d in range(dims):
        x = (h ^ _salt(d)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        out.append(1.0 if x >> 63 else -1.0)
    return out
