"""Language identification: words first, then shorter and shorter character n-grams.

A known word scores by its log frequency in each language. An unseen word is covered from left to right by the longest
known n-grams (``^`` and ``$`` mark its ends), of 5 letters down to 1, and scores the sum of their log frequencies.
A document's language is the one of greatest total; its score is that language's share when the mean over words counts
``EVIDENCE`` times at most.

Words are maximal runs of letters of the text in lower case. The classifier is fitted on a bounded sample of the labelled rows:
all of them up to ``sample_rows``, else about that many by a hash of id and text. Every word and n-gram of the sample is in the model, with its
counts in all languages and none left out; so the sample bounds the model, and what reaches the driver. Prediction covers every row.

Known words are found by two 64-bit hashes. N-grams are a trie of sorted arrays, exact: an n-gram's node is its first
letters' node and its last letter. All words of a batch are looked up at once.

Defined cases: null text or text without a letter is ``und`` with score 0; so is every text if no language was learned.
Equal totals go to the first language by name. Null labels aren't learned from. Repeated rows are learned from, and judged, each on its
own. Texts of any length are taken whole. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm import store
from cartolith.llm.arrowtext import column, ragged, slices
from cartolith.llm.flatwords import SEEDS, word_hashes
from cartolith.llm.workers import tidy

LONGEST = 5
EVIDENCE = 32
SLICE = 1 << 20
BEGIN, END = 0x110000, 0x110001  # the marks at a word's ends, beside all code points


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Cut:
    """The words of texts: ``text`` is all of them in lower case, ``starts`` and ``ends`` are places in it, ``first`` the first word of each text, with the end."""

    def __init__(self, texts: list[str | None]) -> None:
        low = [t.lower() if t else "" for t in texts]
        self.text = "\n".join(low)
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[self.points]
        edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)])
        self.first = np.searchsorted(self.starts, begins)

    def words(self) -> list[str]:
        return [self.text[s:e] for s, e in zip(self.starts.tolist(), self.ends.tolist())]


def hashes_of(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return word_hashes(points.view(np.uint8), starts * 4, ends * 4, SEEDS)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int) -> DataFrame:
    """t, l of the labelled rows, or of about ``sample_rows`` of them; rows equal in id and text share their fate."""
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = labelled.select(lang_col).count()
    rows = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.lit(29), id_col, text_col).alias("h"))
    if n > sample_rows:
        rows = rows.where(F.pmod("h", F.lit(1 << 40)) < F.lit(int((1 << 40) * (sample_rows / n))))
    return rows.select("t", "l")


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, item, n, summed on the executors before and after the shuffle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for b in slices(batches, "t", SLICE):
            cut = Cut(column(b, "t").to_pylist())
            words, first = cut.words(), cut.first.tolist()
            for lang, s, e in zip(column(b, "l").to_pylist(), first, first[1:]):
                found[lang].update(words[s:e])
        for lang, counted in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counted), pa.string()), pa.array(counted.keys(), pa.string()), pa.array(counted.values(), pa.int64())], ["lang", "item", "n"])

    return rows.mapInArrow(run, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _logs(counts: np.ndarray) -> np.ndarray:
    """Log frequencies of items, a column for each language, with one half added to every count."""
    return np.log((counts.astype(np.float64) + 0.5) / (np.maximum(counts.sum(0, dtype=np.float64), 1) + 0.5 * len(counts)))


def _marked(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters of words with marks at both ends, where each begins, with the end)."""
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(at[-1]), np.uint32)
    inner = np.ones(len(out), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[at[:-1]], out[at[1:] - 1] = BEGIN, END
    out[inner] = points[ragged(starts, ends - starts)]
    return out, at


class Model:
    def __init__(self, langs: list[str], words: list[str], counts: np.ndarray) -> None:
        """``counts``: words x languages."""
        self.langs = langs
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        points = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        one, two = hashes_of(points, starts, starts + sizes)
        order = np.argsort(one, kind="stable")
        self.keys, self.again, self.words = one[order], two[order], _logs(counts)[order]
        del one, two, order
        letters, at = _marked(points, starts, starts + sizes)
        del points, starts
        self.alphabet = np.unique(letters)
        self.nodes: list[np.ndarray] = []  # of each length but the first: node of the first letters * alphabet + last letter
        self.grams: list[np.ndarray] = []
        left = np.repeat(at[1:], sizes + 2) - np.arange(len(letters))  # letters to the word's end
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes + 2)
        place, here = np.arange(len(letters), dtype=np.int32), np.searchsorted(self.alphabet, letters).astype(np.int32)
        del letters, at
        node = here
        for size in range(1, LONGEST + 1):
            if size > 1:
                go = left[place] >= size
                place, node = place[go], node[go]
                known, node = np.unique(node * np.int64(len(self.alphabet)) + here[place + size - 1], return_inverse=True)
                self.nodes.append(known)
            else:
                known = self.alphabet
            own = owner[place]
            summed = np.stack([np.bincount(node, counts[:, k][own], len(known)) for k in range(len(langs))], 1) if langs else np.zeros((len(known), 0))
            self.grams.append(_logs(summed))

    def of_unseen(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of words by the longest known n-grams from left to right."""
        letters, at = _marked(points, starts, ends)
        total = np.zeros((len(starts), len(self.langs)))
        if not len(self.alphabet):
            return total
        here = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        here[self.alphabet[here] != letters] = -1
        longest = (here >= 0).astype(np.int64)
        row = np.where(here >= 0, here, 0)  # in the table of the longest
        end = np.repeat(at[1:], np.diff(at))
        live, node = np.flatnonzero(here >= 0), here[here >= 0]
        for size, known in enumerate(self.nodes, 2):
            go = live + size <= end[live]
            live, node = live[go], node[go]
            last = here[live + size - 1]
            key = node * len(self.alphabet) + last
            spot = np.minimum(np.searchsorted(known, key), len(known) - 1) if len(known) else np.zeros(len(key), np.int64)
            fits = (last >= 0) & (known[spot] == key) if len(known) else np.zeros(len(key), bool)
            live, node = live[fits], spot[fits]
            longest[live], row[live] = size, node
        active, place = np.arange(len(starts)), at[:-1].copy()
        while active.size:
            size = longest[place]
            for n in range(1, LONGEST + 1):
                some = size == n
                total[active[some]] += self.grams[n - 1][row[place[some]]]
            place = place + np.maximum(size, 1)
            more = place < at[active + 1]
            active, place = active[more], place[more]
        return total

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        cut = Cut(texts)
        n_words = np.diff(cut.first)
        if not self.langs or not len(cut.starts):
            return ["und"] * len(texts), np.zeros(len(texts))
        one, two = hashes_of(cut.points, cut.starts, cut.ends)
        _, pick, back = np.unique(one, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, one[pick]), len(self.keys) - 1)
        known = (self.keys[at] == one[pick]) & (self.again[at] == two[pick])
        each = np.empty((len(pick), len(self.langs)))
        each[known] = self.words[at[known]]
        new = pick[~known]
        each[~known] = self.of_unseen(cut.points, cut.starts[new], cut.ends[new])
        has = np.flatnonzero(n_words)
        totals = np.add.reduceat(each[back], cut.first[has], axis=0)
        n = n_words[has][:, None]
        mean = totals / n * np.minimum(n, EVIDENCE)
        share = np.exp(mean - mean.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        for i, k in zip(has.tolist(), best.tolist()):
            langs[i] = self.langs[k]
        scores[has] = share[np.arange(len(has)), best]
        return langs, scores


def model_of(rows: pa.Table) -> Model:
    """The model from counts (lang, item, n); the order of rows doesn't matter."""
    langs = sorted(pc.unique(rows["lang"]).to_pylist())
    if not langs:
        return Model([], [], np.zeros((0, 0)))
    items = rows["item"].combine_chunks().dictionary_encode()
    counts = np.zeros((len(items.dictionary), len(langs)), np.float32)
    counts[items.indices.to_numpy(), pc.index_in(rows["lang"], pa.array(langs)).to_numpy()] = rows["n"].to_numpy()
    words = items.dictionary.to_pylist()
    del items
    return Model(langs, words, counts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4096) -> Model:
    return model_of(word_counts(sample(docs, id_col, text_col, lang_col, sample_rows)).toArrow())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score. Only the text is read; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE):
            langs, scores = sent.value.score(column(b, "t").to_pylist())
            yield pa.RecordBatch.from_arrays([column(b, "k"), pa.array(langs, pa.string()), pa.array(scores)], ["k", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double")
    return out.withColumnRenamed("k", id_col)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language with a score of ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, SLICE):
            langs, scores = sent.value.score(column(b, text_col).to_pylist())
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold
