"""Substring dedup: repeated runs of at least ``window`` words, from prefix-partitioned suffix trees.

The trees are sparse: suffixes start at anchors, the least hashed runs of half a window's words within every window. Every
window has an anchor, and equal windows have equal anchors at equal places, whatever the hash. Suffixes are partitioned by the
prefix that they start with: first by the anchor, half a window long; where more than ``most_group`` of them share it, by
a prefix of the whole window.

First pass: anchors with their first and last documents, summed before the shuffle; anchors of one document only are left out
by a bounded filter. Second pass: of each anchor that is left, the words of the windows that it answers for, from the first
window's start to the last one's end. They meet in groups of equal anchors. Of a group, the suffixes from the anchor on are
sorted, and so are the words before it, backwards; common prefixes of neighbours, in words, give the trees' internal nodes
at every depth. Two windows whose anchor has w words before it are equal if they lie under one node of depth window - w of the first tree
and one of depth w of the second. Words are compared, hashes only bring them together. Windows under equal nodes
that are also in a smaller document are maximal runs of removals.

At the longer prefix, all suffixes of a group are one window, so a first document for each is all there is to find: it is summed
before the shuffle, by the window's words, after windows whose hash is in one document only have been left out. These windows are
sent to the executors where they fit in ``most_sent`` bytes, else joined.

Defined cases: null or empty text has no words. Rows with a null id lose nothing and count for nothing. Rows with the same
id are one document, with the same removals by position only if their text is the same. Ties can't arise: the smallest
document of equal windows is unique. An empty table gives an empty table. Texts of any length are taken whole, one at a time where
they are long. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm import keyfilter, store
from cartolith.llm.arrowtext import binary_column, column, flat, ragged, slices
from cartolith.llm.flatwords import Words, mix, run_hashes
from cartolith.llm.workers import tidy

SLICE = 1 << 20
HELD_ROWS, HELD_BYTES = 20_000, 8 << 20
CONTEXT = "h long, k long, th long, place long, before int, n int, words binary, often boolean"
SPANS = "k long, th long, start int, stop int"


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of every window, the first word of its anchor, the anchor's hash), in order."""
    half = window // 2
    starts = words.places(window)
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    grams = run_hashes(words.hashes, half)
    best = _sliding_argmin(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), window - half + 1)[starts]
    return starts, best, grams[best]


def _sliding_argmin(values: np.ndarray, span: int) -> np.ndarray:
    """Index of the least of values[i:i+span], the first of equals, by doubling."""
    at = np.arange(len(values))
    size = 1
    while size < span:
        step = min(size, span - size)
        other = at[np.minimum(np.arange(len(values)) + step, len(values) - 1)]
        at = np.where(values[other] < values[at], other, at)
        size += step
    return at


def _suffixes(b: pa.RecordBatch, window: int) -> tuple:
    """(words, first window of each suffix, how many it answers for, its anchor's first word, the anchor's hash, its text)."""
    words = Words(*flat(column(b, "t")), lower=False)
    starts, where, gram = anchors(words, window)
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(where)))
    doc = np.searchsorted(words.first, where[heads], "right") - 1
    return words, starts[heads], sizes, where[heads], gram[heads], doc


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """h, n: anchors found in more than one document, and how often they occur."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE):
            _, _, _, _, gram, doc = _suffixes(b, window)
            ids = column(b, "k").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), ids], ["h", "k"])

    found = docs.mapInArrow(run, "h long, k long")
    return found.groupBy("h").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("h", "n")


def suffix_rows(docs: DataFrame, window: int, passing: keyfilter.KeyFilter, often: keyfilter.KeyFilter) -> tuple[DataFrame, object]:
    """(rows, what to release). h: an anchor; place: the first window that it answers for; n: how many; before: words of that window before
    the anchor; words: all words of these windows, a blank after each; often: whether the anchor may be too frequent for one group."""
    sent = docs.sparkSession.sparkContext.broadcast((passing, often))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, many = sent.value
        for b in slices(batches, "t", SLICE):
            words, first, n, anchor, gram, doc = _suffixes(b, window)
            keep = np.flatnonzero(some.maybe(gram))
            if not keep.size:
                continue
            first, n, anchor, gram, doc = (x[keep] for x in (first, n, anchor, gram, doc))
            body, at = words.joined()
            raw = body.tobytes()
            spans = [raw[s:e] for s, e in zip(at[first].tolist(), at[first + n + window - 1].tolist())]
            ids = [column(b, x).take(pa.array(doc)) for x in ("k", "th")]
            cols = [pa.array(gram.view(np.int64)), *ids, pa.array(first - words.first[doc]), pa.array((anchor - first).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(spans, pa.binary()), pa.array(many.maybe(gram))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "k", "th", "place", "before", "n", "words", "often"])

    return docs.mapInArrow(run, CONTEXT), sent


def _word_ids(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word among the distinct words, from 1 on; the first word of each row, with the end)."""
    body, offsets = flat(bodies)
    ends = np.flatnonzero(body == 0x20)
    at = np.concatenate([[0], ends + 1])
    each = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])
    ids = each.dictionary_encode().indices.to_numpy().astype(np.int32) + 1
    return ids, np.searchsorted(at, offsets)


def _tree(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, words that each has in common with the row before it in that order): the suffix tree of the rows."""
    if not paths.shape[1]:
        return np.arange(len(paths)), np.zeros(len(paths), np.int64)
    raw = np.ascontiguousarray(paths.astype(">u4"))
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * paths.shape[1]), len(paths), [None, pa.py_buffer(raw)])
    order = pc.array_sort_indices(fixed).to_numpy()
    sorted_paths = paths[order]
    differ = sorted_paths[1:] != sorted_paths[:-1]
    common = np.where(differ.any(1), differ.argmax(1), paths.shape[1])
    return order, np.concatenate([[0], common])


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Of each row, the internal node at ``depth`` that it lies under."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def later_windows(ids: np.ndarray, first: np.ndarray, before: np.ndarray, n: np.ndarray, k: np.ndarray, window: int) -> np.ndarray:
    """rows x places: whether the window there also starts in a smaller document, of all that are given."""
    half = window // 2
    rest = window - half
    anchor, end = first[:-1] + before, first[1:]
    right = anchor[:, None] + np.arange(window)
    right = np.where(right < end[:, None], ids[np.minimum(right, len(ids) - 1)], 0)
    left = anchor[:, None] - 1 - np.arange(rest)
    left = np.where(left >= first[:-1, None], ids[np.maximum(left, 0)], 0)
    onward, backward = _tree(right), _tree(left)
    out = np.zeros((len(k), rest + 1), bool)
    for w in range(rest + 1):  # words before the anchor
        own = np.flatnonzero((w <= before) & (before - w < n))
        if own.size < 2:
            continue
        key = _nodes(*onward, window - w)[own] * (len(k) + 1) + _nodes(*backward, w)[own]
        order = np.argsort(key, kind="stable")
        key, docs = key[order], k[own[order]]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(np.minimum.reduceat(docs, heads), np.diff(np.append(heads, len(docs))))
        row = own[order]
        out[row, before[row] - w] = docs > least
    return out


def _spans(marked: np.ndarray, k: pa.Array, th: pa.Array, place: np.ndarray, window: int) -> pa.RecordBatch:
    """Runs of marked windows of each row, as words from start to stop."""
    step = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([k.take(at), th.take(at), pa.array((place[row] + begin).astype(np.int32)), pa.array((place[row] + stop + window - 1).astype(np.int32))], ["k", "th", "start", "stop"])


def grouped_repeats(suffixes: DataFrame, window: int) -> DataFrame:
    """k, th, start, stop: words of windows that a smaller document also has. Groups come whole and sorted by anchor; some are held together while they fit."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        k, place, before, n = (t[x].to_numpy() for x in ("k", "place", "before", "n"))
        ids, first = _word_ids(t["words"].chunk(0))
        marked = later_windows(ids, first, before.astype(np.int64), n.astype(np.int64), k, window)
        return _spans(marked, t["k"].chunk(0), t["th"].chunk(0), place, window)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, size, last = 0, 0, None
        for whole in batches:
            for b in slices(iter([whole]), "words", HELD_BYTES // 4):
                h = column(b, "h").to_numpy()
                if rows + len(h) > HELD_ROWS or size + b.nbytes > HELD_BYTES:
                    cut = np.flatnonzero(np.concatenate([[last != h[0]], h[1:] != h[:-1]]))
                    if cut.size:
                        at = int(cut[-1])
                        held += [b.slice(0, at)] if at else []
                        if held:
                            yield flush(held)
                        held, rows, size, b = [], 0, 0, b.slice(at)
                held.append(b)
                rows, size, last = rows + b.num_rows, size + b.nbytes, h[-1]
        if held:
            yield flush(held)

    return suffixes.select("h", "k", "th", "place", "before", "n", "words").sortWithinPartitions("h").mapInArrow(run, SPANS)


class _Windows:
    """The windows of a batch of suffixes, one after the other: hash, suffix and place of each, and its words on demand."""

    def __init__(self, b: pa.RecordBatch, window: int) -> None:
        body, offsets = flat(column(b, "words"))
        words = Words(body, offsets, lower=False)
        self.first, self.hashes = words.runs(window)
        n = column(b, "n").to_numpy()
        self.owner = np.repeat(np.arange(b.num_rows), n)
        self.inner = ragged(np.zeros(b.num_rows, np.int64), n)
        self.body, self.begin, self.end = body, words.starts[self.first], words.ends[self.first + window - 1]

    def texts(self, some: np.ndarray) -> pa.Array:
        raw = self.body.tobytes()
        return pa.array([raw[s:e] for s, e in zip(self.begin[some].tolist(), self.end[some].tolist())], pa.binary())


def _first_by_hash(suffixes: DataFrame, parts: int, window: int) -> DataFrame:
    """w: hashes of windows in several documents. A batch sends each hash once, packed by the part it goes to."""

    def extremes(w: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(w, kind="stable")
        w, low, high = w[order], low[order], high[order]
        heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.empty(0, np.int64)
        return w[heads], *((f.reduceat(x, heads) if len(heads) else x) for f, x in ((np.minimum, low), (np.maximum, high)))

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words", 2 * SLICE):
            found = _Windows(b, window)
            k = column(b, "k").to_numpy()[found.owner]
            w, low, high = extremes(found.hashes, k, k)
            part = (w % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            some = np.flatnonzero(np.diff(ends))
            packed = [binary_column(x[order].view(np.uint8), np.append(ends[some], ends[-1]) * 8) for x in (w, low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *packed], ["part", "w", "low", "high"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
        for b in batches:
            more = (np.frombuffer(flat(column(b, n))[0].tobytes(), t) for n, t in (("w", "<u8"), ("low", "<i8"), ("high", "<i8")))
            kept = list(extremes(*(np.concatenate(x) for x in zip(kept, more))))
        w, low, high = kept
        yield pa.RecordBatch.from_arrays([pa.array(w[low < high].view(np.int64))], ["w"])

    return suffixes.mapInArrow(send, "part long, w binary, low binary, high binary").groupBy("part").applyInArrow(merge, "w long")


def _first_documents(suffixes: DataFrame, window: int, sent: object) -> DataFrame:
    """words, low: windows in several documents, by their words, and the first of these. A batch sends each window once."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words", SLICE):
            found = _Windows(b, window)
            some = np.flatnonzero(sent.value.maybe(found.hashes))
            texts = found.texts(some)
            k = column(b, "k").take(pa.array(found.owner[some]))
            t = pa.table({"w": texts, "k": k}).group_by("w").aggregate([("k", "min"), ("k", "max")])
            yield from t.select(["w", "k_min", "k_max"]).rename_columns(["w", "low", "high"]).combine_chunks().to_batches()

    each = suffixes.mapInArrow(run, "w binary, low long, high long")
    return each.groupBy("w").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("w", "low")


def frequent_repeats(suffixes: DataFrame, window: int, most_sent: int) -> tuple[DataFrame, list]:
    """(k, th, start, stop for suffixes of very frequent anchors; what to release). The windows' first documents are sent to the executors if they
    take ``most_sent`` bytes or fewer, else joined."""
    spark = suffixes.sparkSession
    hashes, _ = store.save(spark, _first_by_hash(suffixes, int(spark.conf.get("spark.sql.shuffle.partitions")), window), "hashes")
    passing = spark.sparkContext.broadcast(keyfilter.build(hashes, "w"))
    first, _ = store.save(spark, _first_documents(suffixes, window, passing), "first", "zstd")
    if (first.agg(F.sum(F.octet_length("w") + 16)).first()[0] or 0) > most_sent:
        return _joined_repeats(suffixes, first, window, passing), [passing]
    known = first.toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast(known)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        if not known.num_rows:
            return
        listed, low = known["w"].chunk(0), known["low"].to_numpy()
        for b in slices(batches, "words", 2 * SLICE):
            found = _Windows(b, window)
            some = np.flatnonzero(passing.value.maybe(found.hashes))
            at = pc.fill_null(pc.index_in(found.texts(some), listed), -1).to_numpy()
            k = column(b, "k").to_numpy()
            later = some[(at >= 0) & (low[at] < k[found.owner[some]])]
            marked = np.zeros((b.num_rows, int(column(b, "n").to_numpy().max(initial=0))), bool)
            marked[found.owner[later], found.inner[later]] = True
            yield _spans(marked, column(b, "k"), column(b, "th"), column(b, "place").to_numpy(), window)

    return suffixes.mapInArrow(run, SPANS), [passing, sent]


def _joined_repeats(suffixes: DataFrame, first: DataFrame, window: int, passing: object) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words", SLICE):
            found = _Windows(b, window)
            some = np.flatnonzero(passing.value.maybe(found.hashes))
            at = pa.array(found.owner[some])
            start = column(b, "place").to_numpy()[found.owner[some]] + found.inner[some]
            cols = [column(b, "k").take(at), column(b, "th").take(at), pa.array(start.astype(np.int32)), pa.array((start + window).astype(np.int32)), found.texts(some)]
            yield pa.RecordBatch.from_arrays(cols, ["k", "th", "start", "stop", "w"])

    each = suffixes.mapInArrow(run, f"{SPANS}, w binary")
    return each.join(first, "w").where("k > low").select("k", "th", "start", "stop")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, most_group: int = 1024, most_sent: int = 32 << 20) -> DataFrame:
    """doc, th (hash of the text), spans: words (start, stop) of windows to remove, of documents that have any."""
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    own = _own(docs, id_col, text_col).where("k is not null")
    used: list[str] = []
    with store.scope(used):  # what only the spans are made from
        known, _ = store.save(spark, repeated_anchors(own.select("k", "t"), window), "anchors")
        often = known.where(F.col("n") > most_group).select("h")
        frequent = bool(often.head(1))
        # A rare anchor that passes the filter of frequent ones wrongly is found the other way just as well.
        rows, sent = suffix_rows(own, window, keyfilter.build(known, "h"), keyfilter.build(often, "h"))
        rows, _ = store.save(spark, rows, "suffixes", "zstd")
        store.release(sent)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = grouped_repeats(rows.where("not often").repartition(n, "h"), window)
    found, _ = store.save(spark, found, "spans")
    if frequent:
        with store.scope(used):
            more, sent = frequent_repeats(rows.where("often"), window, most_sent)
        more, _ = store.save(spark, more, "spans")
        store.release(*sent)
        found = found.unionAll(more)
    store.drop(spark, *used)
    return found.groupBy(F.col("k").alias("doc"), "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def apply_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    marks = found.select(F.col("doc").alias("k"), "th", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    both = _own(docs, id_col, text_col).join(marks, ["k", "th"], "left").select("k", "t", "starts", "stops")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE):
            words = Words(*flat(column(b, "t")), lower=False, seeds=0)
            cover = np.zeros(len(words.starts) + 1, np.int64)
            for name, step in (("starts", 1), ("stops", -1)):
                lists = column(b, name)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                np.add.at(cover, lists.flatten().to_numpy() + np.repeat(words.first[:-1], sizes), step)
            keep = np.flatnonzero(np.cumsum(cover[:-1]) <= 0)
            kept = np.diff(np.searchsorted(keep, words.first))
            sizes = words.ends[keep] - words.starts[keep]
            blank = np.ones(len(keep), np.int64)
            blank[np.cumsum(kept)[kept > 0] - 1] = 0  # the last kept word of a text has no blank after it
            ends = np.cumsum(sizes + blank)
            body = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            letters = np.ones(len(body), bool)
            letters[(ends - 1)[blank == 1]] = False
            inside = np.zeros(len(words.body) + 1, np.int8)
            inside[words.starts[keep]] += 1
            inside[words.ends[keep]] -= 1
            body[letters] = words.body[np.cumsum(inside[:-1], dtype=np.int8) > 0]
            text = binary_column(body, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(kept)])]).cast(pa.string())
            n = words.counts
            yield pa.RecordBatch.from_arrays([column(b, "k"), pa.array(n), pa.array(n - kept), text], ["k", "n_words", "n_removed", "kept"])

    out = both.mapInArrow(run, "k long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("k", id_col)
