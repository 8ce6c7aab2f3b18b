import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartolith.llm import bpe, queries, store, token_counts, token_files

SF = "/root/testdata/sf0.001"
BYTE, WORD = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
ODD = ["", None, "  a  b\n\n c \t d", "a<|endoftext|> b", "<|startoftext|>", "don't WE'LL 'S", "日本 é e\u0301 İΣ", "   ", "\n", "\x1c a\x85b", "aaaaaaaaaaaaaa", "x" * 3000, "word " * 5000]


@pytest.fixture(scope="module")
def byte():
    return bpe.DocumentEncoder(BYTE), bpe.Decoder(BYTE), Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word():
    return token_files.WordEncoder(WORD), Tokenizer.from_file(WORD)


def lists(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_odd_texts(byte, word):
    own, back, lib = byte
    ids, offsets = own.encode(ODD)
    expected = [lib.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert lists(ids, offsets) == expected
    assert back.texts(ids, offsets).to_pylist() == [lib.decode(e, skip_special_tokens=False) for e in expected]
    own, lib = word
    assert lists(*own.encode(ODD)) == [lib.encode(t or "", add_special_tokens=False).ids for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t ab'stlmvedr12é日½²_-.<|endoftext|>ÉΣ\u0301\xa0\x1c"), max_size=60))
def test_any_text(byte, word, text):
    own, back, lib = byte
    ids, offsets = own.encode([text])
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert back.texts(ids, offsets).to_pylist() == [text]
    assert word[0].encode([text])[0].tolist() == word[1].encode(text, add_special_tokens=False).ids


def test_pair_check_and_exact_merging_agree(byte):
    own = byte[0].bpe
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(1, 14))).encode() for _ in range(400)]
    assert own.encode_pieces(words) == own.merge_exactly(words)
    assert own.merge_exactly([]) == []


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "é日ñ"])
def test_long_words(byte, letters):
    own, _, lib = byte
    rnd = random.Random(len(letters))
    word = "".join(rnd.choice(letters) for _ in range(60_000))
    expected = lib.encode(word, add_special_tokens=False).ids
    assert own.encode([word])[0].tolist() == expected
    assert own.bpe.merge_long(word.encode()) == own.bpe.merge_exactly([word.encode()])[0] == expected
    part = word[:300].encode()
    assert own.bpe._merge_one_by_one(part) == own.bpe._merge_together([part])[0] == own.bpe.merge_long(part)


def test_a_word_of_a_megabyte_takes_no_more_than_a_few_times_the_librarys_time(byte):
    import time

    own, _, lib = byte
    rnd = random.Random(5)
    word = "".join(rnd.choice("etaoinshrdlu") for _ in range(1 << 20))
    began = time.process_time()
    expected = lib.encode(word, add_special_tokens=False).ids
    between = time.process_time()
    assert own.bpe.encode_pieces([word.encode()]) == [expected]
    assert time.process_time() - between < 20 * max(between - began, 0.5)


def test_a_new_pair_that_ranks_first_goes_one_by_one(tmp_path):
    import json

    letters = {b: c for c, b in bpe.byte_letters().items()}
    vocab = {c: i for i, c in enumerate(letters.values())}
    for token in ("bc", "abc", "ab", "abcd"):
        vocab[token] = len(vocab)
    merges = [["a", "b"], ["abc", "d"], ["ab", "c"]]
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": merges}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    own, lib = bpe.ByteBpe(str(path)), Tokenizer.from_file(str(path))
    for word in ("abcd" * 50, "abcabcd", "abcdd", "dabc"):
        assert own.merge_long(word.encode()) == lib.encode(word).ids


def test_vocabularies_of_other_kinds(tmp_path, word):
    import json

    with open(WORD) as f:
        spec = json.load(f)
    assert word[0].fits and token_files.word_pattern(spec).startswith("'s|'t")
    spec["normalizer"]["normalizers"].pop()
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(spec))
    own, lib = token_files.WordEncoder(str(path)), Tokenizer.from_file(str(path))
    texts = ["Some CASED text", None, "", "don't\nX"]
    assert not own.fits and lists(*own.encode(texts)) == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError, match="cut"):
        bpe.DocumentEncoder(WORD)


def test_decode_replaces_a_column_of_its_name(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, BYTE).withColumn("decoded", F.lit(7)), BYTE).collect()
    assert {(r.doc_id, r.decoded) for r in got} == {(1, "a b"), (None, "c")}


def test_small_memory_changes_nothing(byte):
    own = bpe.DocumentEncoder(BYTE)
    own.pool.limit = 3
    texts = ["one two three four five", "six one seven two", "one"]
    for t in texts * 3:
        assert own.encode([t])[0].tolist() == byte[2].encode(t, add_special_tokens=False).ids


def test_encode_decode_frames(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = bpe.decode(bpe.encode(docs, BYTE), BYTE).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == [t or "" for t in ODD]
    short = bpe.round_trip(docs, BYTE).orderBy("doc_id").collect()
    assert [r.n_tokens for r in short] == [r.n_tokens for r in got]
    assert [r.decoded_sha256 for r in short] == [hashlib.sha256((t or "").encode()).hexdigest() for t in ODD]
    assert bpe.round_trip(docs.limit(0), BYTE).count() == 0


def test_code_lengths():
    rnd = np.random.default_rng(1)
    for counts in (rnd.integers(1, 1000, 300), rnd.zipf(1.3, 500), 2 ** np.arange(40), np.array([5]), np.array([0, 3, 0, 1])):
        bits = token_files.code_lengths(counts)
        used = counts > 0
        assert bits.max() <= token_files.MAX_BITS and (bits[~used] == 0).all()
        if used.sum() > 1:
            assert (2.0 ** -bits[used]).sum() == 1
    counts = rnd.integers(1, 60, 7)

    def best(most):  # all complete codes of seven lengths
        from itertools import combinations_with_replacement

        ordered = sorted(counts, reverse=True)
        return min(sum(c * b for c, b in zip(ordered, x)) for x in combinations_with_replacement(range(1, most + 1), 7) if sum(2.0**-b for b in x) == 1)

    assert (token_files.code_lengths(counts) * counts).sum() == best(6)
    assert (token_files.code_lengths(counts, 3) * counts).sum() == best(3)
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(20, int), 4)


def test_blocks_decode_on_their_own():
    rnd = np.random.default_rng(3)
    ids = np.minimum(rnd.zipf(1.2, 9000), 40000).astype(np.int64)
    codec = token_files.Codec(token_files.code_lengths(np.bincount(ids)))
    sizes = np.array([1, 64, 65, 128, 3, 1000, 63, *[500] * 10])
    words, n_words, runs, n_runs = codec.pack(ids[: sizes.sum()], sizes)
    assert (codec.unpack(words.tobytes(), runs.tobytes(), sizes) == ids[: sizes.sum()]).all()
    at, run = n_words[:3].sum(), n_runs[:3].sum()
    part = codec.unpack(words[at:].tobytes(), runs[run:].tobytes(), sizes[3:])
    assert (part == ids[sizes[:3].sum() : sizes.sum()]).all()


def test_files(spark):
    rows = [(3, "b a"), (1, None), (2, ""), (3, "a"), (9, "word " * 3000), (-4, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x"))
    path = store.new_path(spark, "t")
    token_files.write(docs, WORD, path)
    lib = Tokenizer.from_file(WORD)
    got = token_files.document_digests(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [-4, 1, 2, 3, 3, 9]
    at = 0
    texts = sorted(((k, lib.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in rows))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in texts)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    back = {(r.doc_id, bytes(r.ids)) for r in token_files.read(spark, path).collect()}
    assert back == {(k, np.array(i, "<u4").tobytes()) for k, i in texts}
    empty = store.new_path(spark, "t")
    token_files.write(docs.limit(0), WORD, empty)
    assert token_files.document_digests(spark, empty).count() == 0


def test_query_is_the_library(spark):
    lib, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    rows = sorted((r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_files(spark, SF).collect()}
    at = 0
    for k, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[k] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_bpe(spark, SF).collect()}
    for k, t in rows:
        ids = byte.encode(t or "", add_special_tokens=False).ids
        assert got[k] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_counts_for_every_limit(spark):
    lib = Tokenizer.from_file(BYTE)
    docs = queries.table(spark, SF, "documents")
    sizes = [len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    hist = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs, BYTE)))
    for r in hist.collect():
        assert r.n_docs == sizes.count(r.n_tokens)
        assert r.docs_ge == sum(s >= r.n_tokens for s in sizes) and r.tokens_ge == sum(s for s in sizes if s >= r.n_tokens)
        assert r.tokens_total == sum(sizes) and r.tokens_cut == sum(min(s, r.n_tokens) for s in sizes)
    limits = [0, 1, 100, 512, 10**6]
    for r in token_counts.at_limits(hist, limits).collect():
        assert (r.tokens_cut, r.docs_over) == (sum(min(s, r.context_limit) for s in sizes), sum(s > r.context_limit for s in sizes))
    ordered = sorted(sizes)
    for r in token_counts.quantiles(hist, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == ordered[max(0, int(np.ceil(r.share * len(sizes))) - 1)]
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs.limit(0), BYTE))).count() == 0
    grouped = token_counts.lengths(spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, lang string"), BYTE, group_col="lang")
    assert [(r.grp, r.n_tokens, r.n_docs) for r in token_counts.histogram(grouped).collect()] == [(None, 0, 2)]


def test_white_space_of_all_kinds_parts_chunks(byte):
    rnd = random.Random(11)
    parts = [" ", "  ", "\n", "\t", "\xa0", " ", "　 ", "  ", "\x85", "\x1c", "<|endoftext|>", " <|startoftext|> ", "<|endof", "text|>", "日本", "é", "'s", "12", "à", "word", "The"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    ids, offsets = byte[0].encode(texts)
    expected = [byte[2].encode(t, add_special_tokens=False).ids for t in texts]
    assert lists(ids, offsets) == expected
    assert byte[1].decimal_digests(ids, offsets) == [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in expected]
    assert byte[1].text_digests(ids, offsets) == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_a_worker_of_the_byte_encoder_stays_small():
    """Encoding 12 MB of ever new words adds little to a process that has loaded the tables."""
    import subprocess
    import sys

    code = f"""
import random, resource
import pyarrow as pa
from cartolith.llm import bpe
from cartolith.llm.arrowtext import slices
own = bpe.document_encoder({BYTE!r})
rnd = random.Random(1)
texts = [" ".join("".join(rnd.choices("etaoinshrdlu", k=rnd.randint(4, 12))) for _ in range(400)) for _ in range(3300)]
batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for b in slices(iter([batch]), "t", getattr(bpe, "SLICE", 2 << 20)):
    getattr(own, "encode_column", lambda x: own.encode(x.to_pylist()))(b.column(0))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=queries.__file__.rsplit("/cartolith/", 1)[0]).stdout.split()[-1])
    assert grown < 170 << 10, f"{grown >> 10} MB"


def test_proposals_take_no_step_of_the_interpreter_for_each_letter(byte):
    """Encoding new words takes fewer lines of Python than there are words, whatever their letters."""
    import sys

    own = bpe.DocumentEncoder(BYTE)
    rnd = random.Random(7)
    words = list({"".join(rnd.choice("etaoinshrdluéñ") for _ in range(rnd.randint(5, 14))) for _ in range(3000)})
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line" and frame.f_code.co_filename == bpe.__file__
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        ids, offsets = own.encode([" ".join(words)])
    finally:
        sys.settrace(before)
    assert ids.tolist() == byte[2].encode(" ".join(words), add_special_tokens=False).ids
    assert steps < 12 * len(words)


def test_lengths_are_counted_without_texts_as_strings(spark, byte):
    """``token_counts.lengths`` hands columns to the encoder, in slices that bound what it needs meanwhile."""
    assert bpe.SLICE <= 1 << 20
    got = token_counts.lengths(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), BYTE).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(byte[2].encode(t or "", add_special_tokens=False).ids) for t in ODD]
