"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with every run of other characters than letters and digits as one blank. A passage is any
``segment`` characters of an item, wherever they start in it, or the whole of a shorter item. A region with at most k edits to a
passage of m characters shares at least m + 1 - q(k + 1) character q-grams with it, all on at most k + 1 neighbouring diagonals,
so they lie within one of the overlapping bands of 2(k + 1) diagonals. Items are indexed whole, each q-gram once; bands in which
so many places of shared q-grams lie within a passage's length are verified by an alignment within the band: first the passages that start
at every half of ``segment``, then, only where none of these is found, all others that the q-grams allow. k is a tenth of m,
but none below 16 characters, at most one below 24 and two below 32, as far as the lemma goes.

Items of fewer than ``FREE_CHARS`` compared characters match only between word boundaries: beside a blank, an end of the text, or
a letter of a script that doesn't part words.

Benchmark items are indexed in blocks of about ``block_chars`` characters, each of which is broadcast and scanned over
the documents in a pass of its own. Where there are several, a pass is written and its index taken back before the next begins, so
memory is bounded whatever the number of items. Documents are never shuffled.

Defined cases: null or empty text matches nothing; items with fewer than ``MIN_CHARS`` compared characters, a q-gram,
match nothing; repeated rows are matched each on its own, repeated items too; null ids stay null; texts of any length are scanned
whole; ties: the least edits, then the first region's end. An empty benchmark matches nothing, an empty table gives an empty table. Extra
columns pass through ``clean`` untouched and are ignored by ``matches``.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cartolith.llm import store
from cartolith.llm.arrowtext import column, slices
from cartolith.llm.workers import tidy

Q = 8
MIN_CHARS = Q
FREE_CHARS = 32
#: Thai and Lao, Burmese, Khmer, radicals to unified ideographs with kana, Hangul excepted; compatibility ideographs, narrow kana, further planes.
UNPARTED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x31A0, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
TABLE_BITS = 22
PRIME = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point: its lower case if it is a letter or digit (itself where that has several), else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(len(out)):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def points(text: str | None) -> np.ndarray:
    """Code points as they are compared: lower case, one blank for each inner run of others."""
    if not text:
        return np.empty(0, np.uint32)
    out = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    solid = out != 0
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    out = out[keep]
    out[out == 0] = 0x20
    return out[:-1] if len(out) and out[-1] == 0x20 else out


def compared(text: str | None) -> str:
    return points(text).tobytes().decode("utf-32-le", "surrogatepass")


def gram_codes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit code of the q-gram that starts at each position."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out *= PRIME
        out += chars[j : j + n]
    out ^= out >> np.uint64(29)
    return out * PRIME


@dataclass
class Index:
    item_ids: list
    chars: np.ndarray  # items, one after the other
    owner: np.ndarray  # the place in the list of each indexed item
    begins: np.ndarray
    lengths: np.ndarray
    windows: np.ndarray  # the characters of a passage, and how many of them may be edited
    edits: np.ndarray
    step: int
    codes: np.ndarray  # sorted q-gram codes, and for each the indexed item and position
    segment: np.ndarray
    place: np.ndarray
    table: np.ndarray

    def _passages(self, of: np.ndarray) -> np.ndarray:
        return np.repeat(of, self.lengths - self.windows + 1)

    @property
    def items(self) -> np.ndarray:
        """Of every passage: its item, start, size and budget."""
        return self._passages(self.owner)

    @property
    def starts(self) -> np.ndarray:
        counts = self.lengths - self.windows + 1
        return np.arange(int(counts.sum())) - self._passages(np.cumsum(counts) - counts) + self._passages(self.begins)

    @property
    def sizes(self) -> np.ndarray:
        return self._passages(self.windows)

    @property
    def budgets(self) -> np.ndarray:
        return self._passages(self.edits)


def index_items(rows: list[tuple], segment: int = 96, rate: float = 0.1) -> Index:
    chars, owner = [], []
    for n, (_, text) in enumerate(rows):
        whole = points(text)
        if len(whole) >= MIN_CHARS:
            chars.append(whole)
            owner.append(n)
    length = np.array([len(c) for c in chars], np.int64)
    windows = np.minimum(length, segment)
    edits = np.minimum((windows * rate).astype(np.int64), np.maximum(windows // Q - 1, 0))
    counts = np.maximum(length - Q + 1, 0)
    every = np.concatenate([*map(gram_codes, chars), np.empty(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    table = np.zeros(1 << TABLE_BITS, bool)
    table[every >> np.uint64(64 - TABLE_BITS)] = True
    place = np.concatenate([*(np.arange(n) for n in counts), np.empty(0, np.int64)])
    return Index([r[0] for r in rows], np.concatenate([*chars, np.empty(0, np.uint32)]), np.array(owner, np.int64), np.cumsum(length) - length, length, windows, edits, segment // 2, every[order], np.repeat(np.arange(len(length)), counts)[order], place[order], table)


@dataclass
class Bands:
    """Runs of shared q-grams, in one band and within a passage's length, that reach the lemma's bound; sorted by band and place."""

    item: np.ndarray
    first: np.ndarray  # diagonal: place in text less place in item
    low: np.ndarray  # the passages that hold the run start from here
    high: np.ndarray  # to here
    at: np.ndarray  # a place in the text

    def take(self, some: np.ndarray) -> Bands:
        return Bands(self.item[some], self.first[some], self.low[some], self.high[some], self.at[some])


def bands(text: np.ndarray, index: Index) -> Bands:
    codes = gram_codes(text)
    at = np.flatnonzero(index.table[codes >> np.uint64(64 - TABLE_BITS)])
    codes = codes[at]
    low, high = np.searchsorted(index.codes, codes, "left"), np.searchsorted(index.codes, codes, "right")
    n = high - low
    hit = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    item, place, at = index.segment[hit], index.place[hit], np.repeat(at, n)
    need = index.windows + 1 - Q * (index.edits + 1)
    before = int(index.lengths.max()) + 2  # diagonals may be negative by less than an item
    span = len(text) + 2 * before
    row = np.floor_divide(at - place, index.edits[item] + 1) + before
    keys, where, counts = np.unique(item * span + row, return_inverse=True, return_counts=True)
    none = np.empty(0, np.int64)
    if not keys.size:
        return Bands(none, none, none, none, none)
    together = keys[1:] == keys[:-1] + 1
    with_next = counts + np.append(np.where(together, counts[1:], 0), 0) >= need[keys // span]
    with_last = np.append(False, with_next[:-1] & together) | (counts >= need[keys // span])
    # a band is told by the first of its two rows
    own, last = np.flatnonzero(with_next[where]), np.flatnonzero(with_last[where])
    hit = np.concatenate([own, last])
    if not hit.size:
        return Bands(none, none, none, none, none)
    key = np.concatenate([keys[where[own]], keys[where[last]] - 1])
    order = np.lexsort((place[hit], key))
    hit, key = hit[order], key[order]
    new = np.append(True, (key[1:] != key[:-1]) | (place[hit[1:]] != place[hit[:-1]]))  # a place in the item counts once
    hit, key = hit[new], key[new]
    item, place, at = item[hit], place[hit], at[hit]
    end = np.arange(len(hit)) + need[item] - 1
    fits = end < len(hit)
    end = np.minimum(end, len(hit) - 1)
    fits &= (key[end] == key) & (place[end] - place <= index.windows[item] - Q)
    i, e = np.flatnonzero(fits), end[fits]
    item = item[i]
    first = (key[i] % span - before) * (index.edits[item] + 1)
    window = index.windows[item]
    return Bands(item, first, np.maximum(place[e] + Q - window, 0), np.minimum(place[i], index.lengths[item] - window), at[i])


def boundaries(text: np.ndarray) -> np.ndarray:
    """Of each place and the end of the text: whether a word may end or start there."""
    free = (text == 0) | (text == 0x20)
    for low, high in UNPARTED:
        free |= (text >= low) & (text <= high)
    out = np.ones(len(text) + 1, bool)
    out[1:-1] = free[1:] | free[:-1]
    return out


def aligned(text: np.ndarray, index: Index, item: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each passage and any region within its band, and where the region ends. One row of the alignment at a time, all bands together."""
    budgets, size, first = index.edits[item], index.windows[item], first + start
    width = int(2 * (budgets.max() + 1))
    across = np.arange(width)
    inside = across[None, :] < 2 * (budgets + 1)[:, None]
    cost = np.where(inside, 0, 1 << 20).astype(np.int64)
    short = np.flatnonzero(size < FREE_CHARS)
    if short.size:
        fits = boundaries(text)
        j = first[short, None] + across[None, :]
        cost[short] = np.where(inside[short] & (j >= 0) & (j <= len(text)) & fits[np.clip(j, 0, len(text))], 0, 1 << 20)
        cost[short] = np.minimum.accumulate(cost[short] - across, axis=1) + across
    final = np.full(len(item), 1 << 20)
    ends = np.zeros(len(item), np.int64)
    for i in range(int(size.max())):
        j = first[:, None] + across[None, :] + i
        there = (j >= 0) & (j < len(text))
        own = index.chars[np.minimum(index.begins[item] + start + i, len(index.chars) - 1)]
        match = there & (text[np.clip(j, 0, len(text) - 1)] == own[:, None])
        step = np.where(there, cost + ~match, 1 << 20)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        step = np.where(inside, step, 1 << 20)
        cost = np.minimum.accumulate(step - across, axis=1) + across
        cost = np.where(inside, cost, 1 << 20)
        over = np.flatnonzero(size == i + 1)
        if over.size:
            ended = cost[over]
            if short.size:
                j = first[over, None] + across[None, :] + i + 1
                ended = np.where((size[over] >= FREE_CHARS)[:, None] | ((j >= 0) & (j <= len(text)) & fits[np.clip(j, 0, len(text))]), ended, 1 << 20)
            best = ended.argmin(1)
            final[over] = ended[np.arange(len(over)), best]
            ends[over] = first[over] + best + i + 1
    return final, ends


class Finder:
    def __init__(self, index: Index) -> None:
        self.index = index

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, passages found, least edits, end of the first region in compared characters). Passages are counted at every half of a segment, but as one where only others are found."""
        index = self.index
        if not len(index.owner):
            return []
        gap = np.zeros(2 * int(index.windows.max()), np.uint32)
        whole = [points(t) for t in texts]
        starts = np.cumsum([0] + [len(w) + len(gap) for w in whole])
        text = np.concatenate([x for w in whole for x in (w, gap)]) if whole else gap
        if len(text) < Q:
            return []
        runs = bands(text, index)
        out: dict[tuple[int, int], list] = {}

        def verify(item: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
            for at in range(0, len(item), 4096):
                own, begin, dia = item[at : at + 4096], start[at : at + 4096], first[at : at + 4096]
                edits, ends = aligned(text, index, own, begin, dia)
                for k in np.flatnonzero(edits <= index.edits[own]):
                    doc = int(np.searchsorted(starts, max(int(ends[k]) - 1, 0), "right")) - 1
                    out.setdefault((doc, int(index.owner[own[k]])), []).append((int(begin[k]), int(edits[k]), int(ends[k] - starts[doc])))

        last = index.lengths[runs.item] - index.windows[runs.item]
        tried = [(runs, np.where(runs.high == last, last, -1))]
        begin = -(-runs.low // index.step) * index.step
        while (begin <= runs.high).any():
            tried.append((runs, np.where(begin <= runs.high, begin, -1)))
            begin = begin + index.step
        some = np.concatenate([np.stack([r.item, r.first, x], 1)[x >= 0] for r, x in tried])
        some = np.unique(some, axis=0)
        verify(some[:, 0], some[:, 2], some[:, 1])
        rows = [(d, i, len({s for s, _, _ in found}), min(e for _, e, _ in found), min(x for _, _, x in found)) for (d, i), found in out.items()]

        doc = np.searchsorted(starts, runs.at, "right") - 1
        have = set(out)
        out.clear()
        left = np.array([(d, i) not in have for d, i in zip(doc.tolist(), index.owner[runs.item].tolist())], bool)
        left &= last > 0  # the only passage of other items has been tried
        rest = runs.take(left)
        for a in range(0, len(rest.item), 4096):
            part = rest.take(np.arange(a, min(a + 4096, len(rest.item))))
            n = part.high - part.low + 1
            begin = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(part.low, n)
            some = np.unique(np.stack([np.repeat(part.item, n), np.repeat(part.first, n), begin], 1), axis=0)
            verify(some[:, 0], some[:, 2], some[:, 1])
        rows += [(d, i, 1, min(e for _, e, _ in found), min(x for _, _, x in found)) for (d, i), found in out.items() if (d, i) not in have]
        return sorted(rows)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> list[DataFrame]:
    """The items (k, t), in blocks of about ``block_chars`` characters. An item longer than that is a block by itself."""
    items = benchmark.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t") + 64)).first()[0] or 0
    count = max(1, math.ceil(total / block_chars))
    return [items.where(F.pmod(F.xxhash64("k", "t"), F.lit(count)) == n) for n in range(count)]


def _sent(block: DataFrame) -> Broadcast:
    """The index of a block's items on the executors."""
    return block.sparkSession.sparkContext.broadcast(index_items([(r.k, r.t) for r in block.collect()]))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, segments, edits, region_end: a row for each document and item of which it holds a passage."""
    spark = docs.sparkSession
    kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    item_kind = to_arrow_schema(StructType([benchmark.schema[item_col]])).field(0).type
    schema = f"k {kinds[0]}, item {kinds[1]}, segments long, edits long, region_end long"
    own = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))

    def scan(sent: Broadcast) -> DataFrame:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value)
            for b in slices(batches, "t", 1 << 20):
                found = finder.find(column(b, "t").to_pylist())
                if found:
                    doc, item, *rest = zip(*found)
                    ids = pa.array([finder.index.item_ids[i] for i in item], item_kind)
                    yield pa.RecordBatch.from_arrays([column(b, "k").take(pa.array(doc)), ids, *(pa.array(x, pa.int64()) for x in rest)], ["k", "item", "segments", "edits", "region_end"])

        return own.mapInArrow(run, schema)

    parts = blocks(benchmark, item_col, item_text, block_chars)
    if len(parts) == 1:
        return scan(_sent(parts[0])).withColumnsRenamed({"k": id_col, "item": item_col})
    found = []
    for block in parts:  # one index at a time
        sent = _sent(block)
        found.append(store.save(spark, scan(sent), "matches")[0])
        store.release(sent)
    return reduce(DataFrame.unionAll, found).withColumnsRenamed({"k": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns."""

    def kept(docs: DataFrame, sent: Broadcast) -> DataFrame:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value)
            for b in slices(batches, text_col, 1 << 20):
                bad = {d for d, *_ in finder.find(column(b, text_col).to_pylist())}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    parts = blocks(benchmark, item_col, item_text, block_chars)
    before = None
    for block in parts[:-1]:  # one index at a time
        sent = _sent(block)
        docs, path = store.save(docs.sparkSession, kept(docs, sent), "clean")
        store.release(sent)
        if before:
            store.drop(docs.sparkSession, before)
        before = path
    return kept(docs, _sent(parts[-1]))
