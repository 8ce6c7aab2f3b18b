"""Token-id files: canonical length-limited Huffman coding of ids.

A file set is a folder of two Parquet tables: ``codebook`` (id, bits: the code length of each id; the code itself is
canonical, so lengths are all that a reader needs) and ``blocks`` (part, block, doc ids, ids per document, payload,
checkpoints). A block holds whole consecutive documents, about ``block_ids`` ids, and is decoded without any other
block. Within it, ``checkpoints`` has the bit length of every run of ``STEP`` ids, so a reader starts at all runs at once and
decodes them in lockstep through one table.

Counts are exact and cover all documents. What reaches the driver is a count for each id of the vocabulary (a fixed
size) and one total for each output partition.

Defined cases: null text is empty text; a document always has the end id. Documents are ordered by id, equal ids by
their ids' bytes. Extra columns are ignored. An empty table gives empty tables.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.llm import store
from cartolith.llm.arrowtext import binary_column, column, flat, ragged, slices
from cartolith.llm.bpe import byte_letters
from cartolith.llm.workers import held
from cartolith.llm.wordpool import WordPool, flattened, per_document

STEP = 64
MAX_BITS = 20
BLOCK_SCHEMA = "part int, block long, doc_ids array<long>, sizes array<long>, payload binary, checkpoints binary"
BLOCK_COLUMNS = ["part", "block", "doc_ids", "sizes", "payload", "checkpoints"]
#: Printable letters and signs below U+0250, each its own composed form, whose lower case depends on nothing else.
LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
LATIN_LINES = re.compile("[\n!-~\u00a1-\u012f\u0131-\u024f]*")


def word_pattern(spec: dict) -> str | None:
    """The pattern that a tokenizers file cuts words with, if it composes letters, makes white space blanks and letters lower case, then
    cuts by a pattern that takes no white space and turns bytes into letters; else None."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [x.get("type") for x in steps] != ["NFC", "Replace", "Lowercase"] or (steps[1].get("pattern"), steps[1].get("content")) != ({"Regex": r"\s+"}, " "):
        return None
    if [x.get("type") for x in cuts] != ["Split", "ByteLevel"] or cuts[0].get("behavior") != "Removed" or not cuts[0].get("invert") or cuts[1].get("use_regex") or cuts[1].get("add_prefix_space"):
        return None
    pattern = cuts[0].get("pattern", {}).get("Regex")
    return pattern if pattern and not regex.search(pattern, " \t\n") else None


class WordEncoder:
    """A tokenizers file whose normalizer and pre-tokenizer never look across white space.

    Each word between blanks or line ends is encoded by the library, once while it stays in the pool. Latin words are
    put in lower case and cut here, by the file's own pattern, which spares the library's slow Unicode steps; the ids are from the
    library's model. All other words go through the library as they are, and so do whole texts where the file is of another kind.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words that it is asked come once, so its own memo of them only costs time
        with open(path, encoding="utf-8") as f:
            pattern = word_pattern(json.load(f))
        self.fits = pattern is not None
        if pattern is not None:
            self.wide = regex.compile(pattern + "|\n")
            self.latin = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9") + "|\n")
        self.letters = {b: c for c, b in byte_letters().items()}
        # Room for about 750,000 words and 350,000 pieces: with less room, words that come again are encoded again.
        self.pieces = WordPool(self._tokenize, 48 << 20)
        self.pool = WordPool(self._encode, 96 << 20)

    def _tokenize(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces; a line end, which only separates words, has none."""
        letters = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        return flattened([[] if p == "\n" else [t.id for t in self.model.tokenize(p)] for p in letters])

    def _latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words at once: put in lower case and cut as one text with a line for each."""
        low = "\n".join(words).lower()
        cut = (self.latin if low.isascii() else self.wide).findall(low)
        ids, sizes = self.pieces.encode_words(cut)
        line = np.cumsum(np.fromiter(map("\n".__eq__, cut), bool, len(cut)))
        return ids, np.bincount(line, sizes, len(words)).astype(np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [w.isascii() for w in words]
        groups = [[i for i, p in enumerate(plain) if p], [i for i, p in enumerate(plain) if not p], []]
        parts = []
        for n, group in enumerate(groups):
            own = [words[i] for i in group]
            joined = "\n".join(own)
            if n < 2 and own and (not LATIN_LINES.fullmatch(joined) or "<|" in joined):
                fit = [bool(LATIN.fullmatch(w)) and "<|" not in w or not w for w in own]
                groups[2] += [i for i, f in zip(group, fit) if not f]
                groups[n] = [i for i, f in zip(group, fit) if f]
                own = [words[i] for i in groups[n]]
            if own:
                parts.append(self._latin(own) if n < 2 else flattened([e.ids for e in self.lib.encode_batch_fast(own, add_special_tokens=False)]))
            else:
                parts.append((np.empty(0, np.uint32), np.empty(0, np.int64)))
        ids, lengths = (np.concatenate(x) for x in zip(*parts))
        back = np.argsort(np.concatenate([np.array(g, np.int64) for g in groups]), kind="stable")
        starts = np.cumsum(lengths) - lengths
        return ids[ragged(starts[back], lengths[back])], lengths[back]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        if not self.fits:
            ids, lengths = flattened([e.ids for e in self.lib.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)])
            return ids, np.concatenate([[0], np.cumsum(lengths)])
        for i, t in enumerate(texts):
            if t:
                w = t.replace("\n", " ").split(" ")
                words += w
                counts[i] = len(w)
        ids, lengths = self.pool.encode_words(words)
        return ids, per_document(lengths, counts)


def word_encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    return held("word encoder", WordEncoder, path)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, of ``id_width`` bytes each), the end id at the end of each."""
    width = id_width(tokenizer_path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(tokenizer_path)
        for b in slices(batches, "t"):
            ids, offsets = own.encode(column(b, "t").to_pylist())
            ids = np.insert(ids.astype(f"<u{width}"), offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            yield pa.RecordBatch.from_arrays([column(b, "k"), pa.array(np.diff(offsets)), binary_column(ids.view(np.uint8), offsets * width)], ["k", "n_tokens", "ids"])

    out = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, "k long, n_tokens long, ids binary")
    return out.withColumnRenamed("k", "doc_id")


def id_counts(encoded: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs; its size is that of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in slices(batches, "ids", 2 << 20):
            got = np.bincount(as_ids(flat(column(b, "ids"))[0], width))
            if len(got) > len(total):
                got, total = total, got
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def as_ids(body: np.ndarray, width: int) -> np.ndarray:
    return (body if body.ctypes.data % width == 0 else body.copy()).view(f"<u{width}")


def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes that hold any id."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(True), end_id + 1) <= 1 << 16 else 4


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits: Huffman's where they fit, else by package-merge."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        bits[used] = 1
        return bits
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids need codes of more than {most} bits")
    heap = [(int(counts[i]), n) for n, i in enumerate(used)]
    heapq.heapify(heap)
    above = np.zeros(2 * len(used) - 1, np.int64)
    for new in range(len(used), 2 * len(used) - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        above[[x, y]] = new
        heapq.heappush(heap, (a + b, new))
    depth = np.zeros(2 * len(used) - 1, np.int64)
    for n in range(2 * len(used) - 3, -1, -1):
        depth[n] = depth[above[n]] + 1
    if depth.max() <= most:
        bits[used] = depth[: len(used)]
        return bits
    by_weight = used[np.argsort(counts[used], kind="stable")]
    weights = counts[by_weight]
    coins = weights
    levels = [np.arange(len(by_weight))]  # of each level, which symbol an item is; -1: a pair of items of the level below
    for _ in range(most - 1):
        pairs = coins[: len(coins) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        coins = both[order]
        levels.append(np.where(order < len(weights), order, -1))
    take = 2 * (len(by_weight) - 1)
    for level in reversed(levels):
        chosen = level[:take]
        own = chosen[chosen >= 0]
        bits[by_weight[own]] += 1
        take = 2 * int((chosen < 0).sum())
    return bits


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(bits), np.int64)
    used = np.flatnonzero(bits)
    order = used[np.lexsort([used, bits[used]])]
    spans = np.int64(1) << (MAX_BITS - bits[order])
    codes[order] = (np.cumsum(spans) - spans) >> (MAX_BITS - bits[order])
    return codes


class Codec:
    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.codes = bits, canonical_codes(bits)
        used = np.flatnonzero(bits)
        order = used[np.lexsort([used, bits[used]])]
        spans = np.int64(1) << (MAX_BITS - bits[order])
        symbols = np.repeat(order, spans)
        self.table = np.zeros(1 << MAX_BITS, np.uint32)  # by the next MAX_BITS bits: id << 5 | length
        self.table[: len(symbols)] = (symbols << 5) | bits[symbols]

    def pack(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of all documents, words of each, bits of each run, runs of each). Each document begins a 64-bit word."""
        bits, codes = self.bits[ids], self.codes[ids].astype(np.uint64)
        n_runs = -(-sizes // STEP)
        heads = ragged(np.zeros(len(sizes), np.int64), n_runs) * STEP + np.repeat(np.cumsum(sizes) - sizes, n_runs)
        runs = np.add.reduceat(bits, heads)
        whole = np.add.reduceat(bits, np.cumsum(sizes) - sizes)
        n_words = -(-whole // 64)
        first = np.cumsum(n_words) - n_words
        starts = np.cumsum(bits) - bits + np.repeat(first * 64 - (np.cumsum(whole) - whole), sizes)
        word, room = starts >> 6, 64 - (starts & 63) - bits
        here = np.where(room >= 0, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
        total = np.zeros(int(n_words.sum()), np.uint64)
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total[word[at]] = np.bitwise_or.reduceat(here, at)
        split = np.flatnonzero(room < 0)
        total[word[split] + 1] |= codes[split] << (64 + room[split]).astype(np.uint64)
        return total.astype(">u8"), n_words, runs.astype("<u2"), n_runs

    def unpack(self, payload: bytes, checkpoints: bytes, sizes: np.ndarray) -> np.ndarray:
        """All ids of a block. Every run starts at its checkpoint; runs advance together, one id a step."""
        words = np.frombuffer(payload + bytes(8), ">u8").astype(np.uint64)
        lengths = np.frombuffer(checkpoints, "<u2").astype(np.int64)
        n_runs = -(-sizes // STEP)
        ends = np.cumsum(n_runs)
        whole = np.add.reduceat(lengths, ends - n_runs)
        n_words = -(-whole // 64)
        at = np.cumsum(lengths) - lengths + np.repeat((np.cumsum(n_words) - n_words) * 64 - (np.cumsum(whole) - whole), n_runs)
        size = np.full(len(lengths), STEP)
        size[ends - 1] = sizes - (n_runs - 1) * STEP
        order = np.argsort(-size, kind="stable")
        at, out = at[order], np.zeros((len(lengths), STEP), np.uint32)
        live = np.searchsorted(-size[order], -np.arange(STEP), side="left")
        for k in range(STEP):
            if not live[k]:
                break
            at = at[: live[k]]
            word, off = at >> 6, (at & 63).astype(np.uint64)
            window = words[word] << off
            window |= (words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - off)
            entry = self.table[(window >> np.uint64(64 - MAX_BITS)).astype(np.int64)]
            out[order[: live[k]], k] = entry >> 5
            at = at + (entry & 31)
        return out[np.arange(STEP) < size[:, None]]


def _codec(bits: bytes) -> Codec:
    return held("codec", lambda b: Codec(np.frombuffer(b, np.uint8).astype(np.int64)), bits)


def code(encoded: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """doc_id, n_tokens, payload, runs: every document in the global code, where it is."""
    sent = encoded.sparkSession.sparkContext.broadcast(bits.astype(np.uint8).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for b in slices(batches, "ids"):
            sizes = column(b, "n_tokens").to_numpy()
            words, n_words, runs, n_runs = codec.pack(as_ids(flat(column(b, "ids"))[0], width).astype(np.int64), sizes)
            both = [binary_column(x.view(np.uint8), np.concatenate([[0], np.cumsum(n)]) * x.itemsize) for x, n in ((words, n_words), (runs, n_runs))]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "n_tokens"), *both], ["doc_id", "n_tokens", "payload", "runs"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, payload binary, runs binary")


def write_blocks(coded: DataFrame, path: str, partitions: int, block_ids: int = 1 << 16, block_docs: int = 4096) -> None:
    """Blocks in ascending order of documents; the order runs on from partition to partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part, total = 0, None, 0
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            nonlocal block, total
            docs, sizes, payloads, runs = zip(*held)
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(payloads)], pa.binary()), pa.array([b"".join(runs)], pa.binary())]
            block, total = block + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays(row, BLOCK_COLUMNS)

        for b in slices(batches, "payload"):
            part = column(b, "part")[0].as_py()
            for row in zip(*(column(b, n).to_pylist() for n in ("doc_id", "n_tokens", "payload", "runs"))):
                held.append(row)
                total += row[1]
                if total >= block_ids or len(held) >= block_docs:
                    yield done()
        if held:
            yield done()

    ordered = (
        coded.withColumn("tie", F.xxhash64("payload"))
        .repartitionByRange(partitions, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "payload")
        .select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "payload", "runs")
    )
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write the file set. Texts are encoded once; ids are kept until the code is known."""
    spark = docs.sparkSession
    width = id_width(tokenizer_path, end_id)
    encoded, ids_path = store.save(spark, tokenize(docs, tokenizer_path, end_id, id_col, text_col), "ids", "zstd")
    bits = code_lengths(id_counts(encoded, width))
    coded, coded_path = store.save(spark, code(encoded, bits, width), "coded")
    store.drop(spark, ids_path)
    write_blocks(coded, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    store.drop(spark, coded_path)
    book = spark.createDataFrame(pa.table({"id": pa.array(np.flatnonzero(bits)), "bits": pa.array(bits[bits > 0])}))
    book.coalesce(1).write.parquet(f"{path}/codebook")


def code_book(spark: SparkSession, path: str) -> bytes:
    """The code length of each id."""
    book = spark.read.schema("id long, bits long").parquet(f"{path}/codebook").collect()
    bits = np.zeros(max((r.id for r in book), default=-1) + 1, np.uint8)
    for r in book:
        bits[r.id] = r.bits
    return bits.tobytes()


def decoded(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(block, documents' sizes, ids of all of them), block by block, each in its own right."""
    for b in slices(batches, "payload", 1 << 20):
        for row in b.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            yield row, sizes, codec.unpack(row["payload"], row["checkpoints"], sizes)


def _placed(row: dict, sizes: np.ndarray, more: pa.Array, name: str) -> pa.RecordBatch:
    n = len(sizes)
    cols = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), more]
    return pa.RecordBatch.from_arrays(cols, ["part", "block", "place", "doc_id", "n_tokens", name])


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, block, place, doc_id, n_tokens, ids (unsigned 32-bit)."""
    sent = spark.sparkContext.broadcast(code_book(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sizes, ids in decoded(batches, _codec(sent.value)):
            yield _placed(row, sizes, binary_column(ids.astype("<u4").view(np.uint8), np.concatenate([[0], np.cumsum(sizes)]) * 4), "ids")

    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, "part int, block long, place long, doc_id long, n_tokens long, ids binary")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, block, start: ids of all blocks before. One total per partition goes to the driver; within a partition a window sums."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").select("part", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before, total = [], 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        before.append((r.part, total))
        total += r.n
    parts = spark.createDataFrame(before, "part int, before long")
    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("inside", F.coalesce(F.sum("n").over(own), F.lit(0)))
    return inside.join(parts, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start"))


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers) from the files alone; ids don't leave the worker that decodes them."""
    sent = spark.sparkContext.broadcast(code_book(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sizes, ids in decoded(batches, _codec(sent.value)):
            body, ends = memoryview(ids.astype("<u4").view(np.uint8)), (np.cumsum(sizes) * 4).tolist()
            crc = [zlib.crc32(body[s:e]) for s, e in zip([0, *ends], ends)]
            yield _placed(row, sizes, pa.array(crc, pa.int64()), "ids_crc32")

    got = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, "part int, block long, place long, doc_id long, n_tokens long, ids_crc32 long")
    own = Window.partitionBy("part", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("inside", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return got.join(block_starts(spark, path), ["part", "block"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
