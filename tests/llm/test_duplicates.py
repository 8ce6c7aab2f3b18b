import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import embedding_dedup, flatwords, jaccard_join, line_dedup, queries, substring_dedup
from cartolith.llm.arrowtext import flat
from cartolith.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def documents(rows, spark):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit("x"), "h": F.lit(1), "words": F.lit(0)})


def made_up(seed, n=60):
    """Copies, near copies, shared passages, and the odd cases."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(70)]
    rows, texts = [], []
    for i in range(n):
        kind = rnd.random()
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 40, 120]))]
        if kind < 0.3 and texts:
            words = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, 4)):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        elif kind < 0.6:
            at = rnd.randint(0, len(words))
            words = words[:at] + passage[rnd.randint(0, 10) :] + words[at:]
        texts.append(words)
        rows.append((i * 3, rnd.choice([" ", "\n", "  "]).join(words)))
    return rows + [(1000, ""), (1001, None), (1002, " \n "), (1003, "One"), (1004, "oNE"), (1005, "a b c d"), (1006, "A B c d"), (1007, "x " * 5000)]


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def brute_jaccard(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = Sets(sets)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= percent * len(a | b):
                up.join(i, j)
    return {i: (len(sets[i]), up.find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent", "limits"), [(4, 85, {}), (5, 80, {}), (2, 50, {}), (4, 85, {"block_docs": 3}), (2, 50, {"block_docs": 2, "block_shingles": 200})])
def test_jaccard_join(spark, k, percent, limits):
    rows = made_up(k * percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(documents(rows, spark), k, percent, **limits).collect()}
    assert got == brute_jaccard(rows, k, percent)


def test_jaccard_join_of_repeated_rows_and_none(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")]
    assert [(r.doc_id, r.component_id) for r in jaccard_join.join(documents(rows, spark), 4, 85).orderBy("doc_id").collect()] == [(1, 1), (1, 1), (2, 1)]
    assert jaccard_join.join(documents(rows, spark).limit(0), 4, 85).count() == 0
    none = jaccard_join.join(documents([(None, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (None, None)], spark), 4, 85).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in none if r.doc_id) == [(3, 3, 3), (9, 3, 3)]
    assert sorted((r.n_shingles, r.component_id) for r in none if not r.doc_id) == [(0, None), (3, None)]


def test_search_of_asked_against_others():
    rnd = np.random.default_rng(2)
    base = rnd.integers(1, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 - i], rnd.integers(1, 1 << 40, i).astype(np.uint64)])) for i in range(8)] + [np.unique(rnd.integers(1, 1 << 40, 60).astype(np.uint64))]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    edges = jaccard_join.search(np.concatenate(sets), offsets, 80)
    assert len({x for e in edges for x in e}) == 7 or len(edges) >= 6
    asked = np.array([1, 0, 0, 0, 0, 0, 0, 0, 0])
    assert all(0 in e for e in jaccard_join.search(np.concatenate(sets), offsets, 80, np.arange(9), asked))
    assert jaccard_join.search(np.concatenate(sets), offsets, 80, np.zeros(9, int)) == []


def brute_substrings(rows, window):
    words = {k: WORD.findall(t or "") for k, t in rows}
    first = {}
    for k, w in words.items():
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, k), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize(("window", "limits"), [(50, {}), (6, {}), (7, {"most_group": 2}), (7, {"most_group": 2, "most_sent": 0}), (50, {"most_group": 3, "most_sent": 1}), (2, {})])
def test_substring_dedup(spark, window, limits):
    rows = made_up(window)
    docs = documents(rows, spark)
    out = substring_dedup.apply_repeats(docs, substring_dedup.repeats(docs, window=window, **limits))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out.collect()} == brute_substrings(rows, window)


def test_substring_dedup_of_repeated_rows_and_none(spark):
    docs = documents([(1, "a b c"), (1, "a b c"), (2, "a b c x")], spark)
    out = substring_dedup.apply_repeats(docs, substring_dedup.repeats(docs, window=3)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_removed, r.kept) for r in out] == [(1, 0, "a b c"), (1, 0, "a b c"), (2, 3, "x")]
    nameless = documents([(None, "a b c"), (None, "a b c"), (2, "a b c x"), (3, "a b c")], spark)
    out = substring_dedup.apply_repeats(nameless, substring_dedup.repeats(nameless, window=3)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (0, 0), (2, 0), (3, 3)]
    none = docs.limit(0)
    assert substring_dedup.apply_repeats(none, substring_dedup.repeats(none)).count() == 0


def thue_morse(a, b, log):
    """Two texts that agree in every polynomial hash modulo a power of two whose step is odd."""
    x, y = a, b
    for _ in range(log):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("limits", [{}, {"most_group": 1}])
def test_words_built_to_collide(spark, limits):
    one, other = thue_morse("a", "b", 11)
    rows = [(1, "same " * 49 + one), (2, "same " * 49 + other), (3, one), (4, other), (5, "same " * 49 + one)]
    docs = documents(rows, spark)
    out = substring_dedup.apply_repeats(docs, substring_dedup.repeats(docs, **limits)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out} == brute_substrings(rows, 50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, 4, 85).collect()}
    assert got == brute_jaccard(rows, 4, 85)


def test_windows_are_compared_by_words(spark, monkeypatch):
    """However bad the hash is, results hold."""
    monkeypatch.setattr(flatwords, "word_hashes", lambda body, starts, ends, seeds: [(ends - starts).astype(np.uint64) % np.uint64(2) for _ in seeds])
    rnd = random.Random(3)
    lists = [[rnd.choice(["a", "bb", "ccc", "dd"]) for _ in range(40)] for _ in range(12)]
    lists += [x[5:30] + lists[0][:9] for x in lists]
    rows = list(enumerate(map(" ".join, lists)))
    import pyarrow as pa

    words = flatwords.Words(*flat(pa.array([t for _, t in rows])), lower=False)
    starts, where, _ = substring_dedup.anchors(words, 6)
    heads = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)))
    n = np.diff(np.append(heads, len(starts)))
    first, before = starts[heads], where[heads] - starts[heads]
    k = np.searchsorted(words.first, first, "right") - 1
    body, at = words.joined()
    bodies = pa.array([body[at[s] : at[s + c + 5]].tobytes() for s, c in zip(first, n)], pa.binary())
    marked = substring_dedup.later_windows(*substring_dedup._word_ids(bodies), before, n, k, 6)
    owners = {}
    for doc, w in enumerate(lists):
        for i in range(len(w) - 5):
            owners.setdefault(tuple(w[i : i + 6]), doc)
    for i in range(len(k)):
        for j in range(n[i]):
            place = first[i] + j - words.first[k[i]]
            assert marked[i, j] == (owners[tuple(lists[k[i]][place : place + 6])] < k[i])


def test_op9_query_against_brute_force(spark):
    import hashlib

    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    expected = {k: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, (n, gone, kept) in brute_substrings(rows, 50).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substring_dedup(spark, SF).collect()} == expected
    assert sum(x[1] for x in expected.values()) > 0


def test_op4_query_against_brute_force(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_jaccard_join(spark, SF).collect()} == brute_jaccard(rows, 4, 85)


def test_every_window_has_the_same_anchor_as_its_equals():
    import pyarrow as pa

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(200)) for _ in range(20)]
    words = flatwords.Words(*flat(pa.array(texts)), lower=False)
    starts, where, gram = substring_dedup.anchors(words, 4)
    assert starts.tolist() == words.places(4).tolist()
    seen = {}
    for h, s, w, g in zip(words.runs(4)[1], starts, where, gram):
        assert s <= w <= s + 2
        assert seen.setdefault(h, (w - s, g)) == (w - s, g)


def test_flat_words():
    import pyarrow as pa

    texts = ["a bb a", "", None, "A  bb a\nzz", " x ", "é a bb", "\x0bq\x0c", "no\x1cspace"]
    words = flatwords.Words(*flat(pa.array(texts)), lower=True)
    lists = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert words.counts.tolist() == [len(x) for x in lists]
    every = [w for x in lists for w in x]
    assert len(set(words.hashes.tolist())) == len(set(every))
    assert [words.body[s:e].tobytes().decode() for s, e in zip(words.starts, words.ends)] == every


def brute_lines(rows, least):
    docs = defaultdict(list)
    for k, t in rows:
        docs[k] += (t or "").split("\n")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owners = defaultdict(set)
    for k, xs in docs.items():
        for x in xs:
            owners[key(x)].add(k)
    return {k: (len(xs), "\n".join(x for x in xs if len(key(x)) < least or min(owners[key(x)]) == k)) for k, xs in docs.items()}


def test_line_dedup(spark):
    rnd = random.Random(8)
    pool = [f"line number {i} of the pool" for i in range(30)] + ["short", "", "  Line Number 3 of the POOL\t", "é" * 9, "é" * 10]
    rows = [(i * 2, "\n".join(rnd.choice(pool) for _ in range(rnd.choice([0, 1, 5, 200])))) for i in range(40)] + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "common line here")]
    docs = documents(rows, spark)
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()
    got = {r.doc_id: (len(r._kept_lines) + r._n_dropped, "\n".join(r._kept_lines)) for r in out}
    assert got == brute_lines(rows, 10)
    assert set(line_dedup.dedup(docs).columns) == set(docs.columns)
    assert line_dedup.dedup(docs.limit(0)).count() == 0
    assert line_dedup.dedup(docs).where("doc_id = 1000").first().text is None
    same = documents([(1, "one long line"), (1, "one long line"), (2, "One long line ")], spark)
    assert [r.text for r in line_dedup.dedup(same).orderBy("doc_id").collect()] == ["one long line", "one long line", ""]


def test_line_dedup_of_frequent_lines_clashing_names_and_null_ids(spark):
    rows = [(i, f"the same line of all\nown line number {i}\nthe same line of all") for i in range(300)] + [(-5, "  THE same line of all"), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for ranges in (1, 40):
        marks = line_dedup.keep_bitmaps(docs, ranges=ranges)
        got = {}
        for r in line_dedup.apply_bitmaps(docs, marks).collect():
            n, text = got.get(r.doc_id, (0, []))
            got[r.doc_id] = (n + len(r._kept_lines) + r._n_dropped, text + r._kept_lines)
        assert {k: (n, "\n".join(sorted(x))) for k, (n, x) in got.items()} == {k: (n, "\n".join(sorted(x.split("\n")))) for k, (n, x) in brute_lines(rows, 10).items()}
    assert line_dedup.frequent_keys(line_dedup.hashed_lines(docs, "doc_id", "text", 10), 20).count() == 1
    clash = docs.selectExpr("doc_id", "text", "1 AS _words", "2 AS _th", "3 AS _doc", "4 AS _kept_lines", "5 AS _N_dropped", "6 AS words")
    out = line_dedup.dedup(clash)
    assert out.columns == clash.columns and {tuple(r)[2:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6)}
    with pytest.raises(ValueError, match="already"):
        line_dedup.apply_bitmaps(clash, line_dedup.keep_bitmaps(clash))
    none = spark.createDataFrame([(None, "one long line"), (None, "one long line"), (1, "one long line")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in line_dedup.dedup(none).collect()} == {(None, "one long line"), (1, "one long line")}


def test_lines_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, "a line of some length") for i in range(50)], "doc_id long, text string")
    seen = []
    keep = line_dedup.store.save

    def noted(spark, df, name, codec="snappy"):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(spark, df, name, codec)

    line_dedup.store.save = noted
    try:
        line_dedup.keep_bitmaps(docs)
    finally:
        line_dedup.store.save = keep
    plan = dict(seen)["streamed"]
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(150)] + [(5, 5)]
    up = Sets({x for e in edges for x in e})
    for a, b in edges:
        up.join(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: up.find(i) for i in up.up if i != 5 and any(i in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, least):
    unit = {}
    for k, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[k] = (np.array(v, np.float32).astype(float), label)
    up, n = Sets([r[0] for r in rows]), defaultdict(int)
    for i, (a, la) in unit.items():
        for j, (b, lb) in unit.items():
            if i < j and la == lb and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                n[i] += 1
                n[j] += 1
                up.join(i, j)
    return {r[0]: (n[r[0]], up.find(r[0])) for r in rows}


@pytest.mark.parametrize("block", [2048, 5])
def test_embedding_dedup(spark, block):
    rnd = np.random.default_rng(6)
    rows = []
    for i in range(150):
        v = rnd.standard_normal(32)
        if i % 3 and rows:
            v = np.array(rows[rnd.integers(len(rows))][1]) + rnd.standard_normal(32) * rnd.choice([0, 0.05, 0.3])
        rows.append((i * 2, v.astype(np.float32).tolist(), int(rnd.integers(2))))
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, rows[0][1], None), (903, [float("nan")] * 32, 1), (904, [None] * 32, 1), (905, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.93, block_rows=block).collect()}
    expected = brute_vectors(rows, 0.93)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in expected.values()) > 0
    assert all(got[k][0] <= expected[k][0] for k in expected) and all(v[2] == (v[1] == k) for k, v in got.items())
    assert all(got[k][:2] == (0, k) for k in range(900, 906))


@pytest.mark.parametrize(("size", "limits"), [(64, {}), (64, {"block_rows": 40}), (64, {"whole_rows": 0, "table_bits": 11}), (64, {"whole_rows": 0}), (24, {"whole_rows": 0, "block_rows": 40})])
def test_embedding_dedup_finds_every_link_beside_a_common_direction(spark, size, limits):
    rnd = np.random.default_rng(size)
    common = 2.5 * np.sqrt(size) * np.eye(size)[0]
    rows = []
    for i in range(200):
        v = common + rnd.standard_normal(size)
        near = v + rnd.uniform(0.5, 1.1) * np.sqrt(v @ v / size) * rnd.standard_normal(size) * 0.36
        rows += [(2 * i, v.astype(np.float32).tolist(), i % 2), (2 * i + 1, near.astype(np.float32).tolist(), i % 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, 0.93, **limits).collect()}
    expected = brute_vectors(rows, 0.93)
    assert got == expected and sum(n for n, _ in expected.values()) > 100


@pytest.mark.parametrize("least", [0.8, 0.93, 0.99])
def test_tables_bring_every_link_together_once(least):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((60, 64))
    rows = np.concatenate([base, base, np.repeat(base, 5, 0) + rnd.standard_normal((300, 64)) * rnd.uniform(0, 0.5, (300, 1))])
    unit = embedding_dedup._unit(rows)
    quantiser = embedding_dedup.Quantiser.fit(unit)
    turned = quantiser.turned(unit, 8)
    reach = quantiser.reach(least, 8)
    row, spot = embedding_dedup._spots(turned, reach)
    counts = np.zeros(len(unit), int)
    for x in np.unique(spot >> 1):
        some = spot >> 1 == x
        at = row[some]
        counts[at] += embedding_dedup.Bucket(unit[at], turned[at], spot[some] % 2 == 1, int(x >> 8), least, reach).links(None, 16)[0]
    assert counts.tolist() == ((unit @ unit.T >= least).sum(1) - 1).tolist()


@pytest.mark.parametrize("limits", [{}, {"whole_rows": 0}])
def test_embedding_dedup_searches_every_length(spark, limits):
    rnd = np.random.default_rng(9)
    rows = []
    for size, n in ((16, 90), (40, 70), (3, 5)):
        for _ in range(n):
            v = rnd.standard_normal(size).astype(np.float32)
            near = (v + rnd.standard_normal(size) * 0.2).astype(np.float32)
            rows += [(len(rows), v.tolist(), 1), (len(rows) + 1, near.tolist(), 1), (len(rows) + 2, v.tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, 0.93, **limits).collect()}
    expected = {}
    for size in (16, 40, 3):
        expected |= brute_vectors([r for r in rows if len(r[1]) == size], 0.93)
    assert got == expected and all(n for n, _ in got.values())


def test_embeddings_in_double_precision_and_null_ids(spark):
    rnd = np.random.default_rng(11)
    least = 0.93
    a = np.zeros(8)
    a[0] = 1.0
    rows = []
    for i in range(40):  # cosines a hair above and below the bound, which four bytes can't tell apart
        v = rnd.standard_normal(8)
        v[0] = 0
        c = least + (1 if i % 2 else -1) * 1e-10
        rows.append((i + 1, (c * a + np.sqrt(1 - c * c) * v / np.linalg.norm(v)).tolist(), 1))
    rows = [(0, a.tolist(), 1), *rows, (None, a.tolist(), 1), (None, a.tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df, least).collect()
    unit = {r[0]: np.array(r[1]) for r in rows if r[0] is not None}
    assert {r.vec_id: r.n_links for r in got if r.vec_id is not None} == {i: sum(x != i and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= least for x, v in unit.items()) for i, u in unit.items()}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)] * 2


def test_embedding_dedup_of_none(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_tables(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: r.n_links for r in queries.op8_embedding_dedup(spark, SF).collect()}
    expected = brute_vectors(rows, 0.93)
    assert sum(got.values()) >= 0.9 * sum(v[0] for v in expected.values())
