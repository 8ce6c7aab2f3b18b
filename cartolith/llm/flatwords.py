"""Words of many texts as flat arrays of 64-bit hashes, and hashes of runs of words, without a Python object per word.

Words are hashed eight bytes at a time, every step a bijection of the state, so words of up to eight bytes and equal length
never collide; words of more than ``LONG`` bytes get a BLAKE2 digest. Runs are hashed by combining halves. Nothing is a
polynomial in a fixed step, whose collisions could be built from repetition. Two hashes with different starts make 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
SEEDS = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)
LONG = 96
BLOCK_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """A hash of each of the spans for each seed."""
    sizes = ends - starts
    out = [mix(sizes.astype(np.uint64) * ODD + U(seed)) for seed in seeds]
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(body) + 1,), "<u8", padded, strides=(1,))
    live, done = np.flatnonzero(sizes <= LONG), 0
    while live.size:
        rest = sizes[live] - done
        block = blocks[starts[live] + done] & BLOCK_MASK[np.minimum(rest, 8)]
        for h in out:
            h[live] = mix(h[live] * ODD + block)
        done += 8
        live = live[rest > 8]
    for i in np.flatnonzero(sizes > LONG).tolist():
        digest = np.frombuffer(hashlib.blake2b(body[starts[i] : ends[i]], digest_size=16).digest(), "<u8")
        for h, seed in zip(out, seeds):
            h[i] = digest[SEEDS.index(seed)]
    return out


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * ODD + b)


def run_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i+k] for each i, from hashes of 1, 2, 4, ... values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, size = None, 0, values, 1
    while True:
        if k & size:
            piece = power[done : done + n]
            out = mix(piece + U(k)) if out is None else combined(out, piece)
            done += size
        if 2 * size > k:
            return out
        power = combined(power[:-size], power[size:])
        size *= 2


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: start and end bytes, hashes, and the first word of each text."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, lower: bool, seeds: int = 1) -> None:
        """``seeds``: how many hashes of each word; with 0 the words are only cut."""
        if lower:
            body = LOWER[body]
        self.solid = ~SPACE[body]
        begins, stops = self.solid.copy(), self.solid.copy()
        begins[1:] &= ~self.solid[:-1]
        stops[:-1] &= ~self.solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(body))]
        begins[inner] = self.solid[inner]
        stops[inner - 1] = self.solid[inner - 1]
        self.body = body
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        del begins, stops
        self.each = word_hashes(body, self.starts, self.ends, SEEDS[:seeds])
        self.first = np.searchsorted(self.starts, offsets)  # of each text, with the end

    @property
    def hashes(self) -> np.ndarray:
        return self.each[0]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def places(self, k: int) -> np.ndarray:
        """First word of every run of k words within one text, in order."""
        n = np.maximum(self.counts - k + 1, 0)
        ends = np.cumsum(n)
        return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(self.first[:-1] - (ends - n), n)

    def runs(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word of every run of k words within one text, its hash), in order."""
        at = self.places(k)
        return at, run_hashes(self.each[seed], k)[at] if at.size else np.empty(0, np.uint64)

    def whole(self, some: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hash of all words of each of some texts."""
        counts, out = self.counts[some], np.zeros(len(some), np.uint64)
        for n in np.unique(counts[counts > 0]).tolist():
            own = np.flatnonzero(counts == n)
            out[own] = run_hashes(self.each[seed], n)[self.first[:-1][some[own]]]
        return out

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all words, each with one blank after it; where each word starts in them, with the end)."""
        sizes = self.ends - self.starts + 1
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(int(at[-1]), 0x20, np.uint8)
        letters = np.ones(len(out), bool)
        letters[at[1:] - 1] = False
        out[letters] = self.body[self.solid]
        return out, at


def shingle_sets(words: Words, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each seed of ``words``, the hashes of the distinct k-word shingles of all texts; offsets). They are sorted by the
    first hash within each text. Fewer words: the whole sequence as one."""
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    owner = np.concatenate([np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0)), short])
    every = [np.concatenate([words.runs(k, s)[1], words.whole(short, s)]) for s in range(len(words.each))]
    order = np.argsort(every[0])
    home = owner[order]
    order = order[np.argsort(home.astype(np.uint16) if len(counts) < 1 << 16 else home, kind="stable")]
    owner, every = owner[order], [x[order] for x in every]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (every[0][1:] != every[0][:-1])
    return [x[new] for x in every], np.searchsorted(owner[new], np.arange(len(counts) + 1))
