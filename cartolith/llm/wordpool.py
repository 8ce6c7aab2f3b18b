"""Ids of words that come again and again: each distinct word is encoded once while it stays in the pool."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa

from cartolith.llm.arrowtext import ragged


WORD = 110


class WordPool:
    """A bounded memo of word -> ids. Overflow keeps the words of the last batch, or none if these are too many, too; results never depend on it."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 36 << 20) -> None:
        """``encode``: distinct words to (ids of all words in a row, number of ids of each). ``limit``: bytes, at ``WORD`` and more for each word."""
        self.encode, self.limit, self.size = encode, limit, 0
        self.index: dict[str, int] = {}
        self.words: list[str] = []
        self.starts, self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _add(self, words: list[str]) -> dict[str, int]:
        """Their places, which are in the index too."""
        ids, lengths = self.encode(words)
        self.size += WORD * len(words) + sum(map(len, words)) + 4 * len(ids)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        places = dict(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.index.update(places)
        self.words += words
        self.starts, self.lengths, self.ids = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        return places

    def _trim(self, used: np.ndarray) -> None:
        keep = np.unique(used)
        if WORD * len(keep) + sum(len(self.words[i]) for i in keep) > self.limit:
            keep = keep[:0]
        self.words = [self.words[i] for i in keep]
        self.index = dict(zip(self.words, range(len(keep))))
        self.ids = self.ids[ragged(self.starts[keep], self.lengths[keep])]
        self.lengths = self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.size = WORD * len(keep) + sum(map(len, self.words)) + 4 * len(self.ids)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if missing.size:
            new = list(compress(words, (at < 0).tolist()))
            at[missing] = np.fromiter(map(self._add(list(dict.fromkeys(new))).__getitem__, new), np.int64, missing.size)
        lengths = self.lengths[at]
        ids = self.ids[ragged(self.starts[at], lengths)]
        if self.size > self.limit:
            self._trim(at)
        return ids, lengths


def distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(each word once, in the order of first places; which of them each word is). Words are compared in full."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths


def per_document(lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Offsets of documents in ids: ``lengths`` of each word, ``words`` of each document."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ends[np.concatenate([[0], np.cumsum(words)])]
