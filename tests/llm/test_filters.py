import functools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartolith.llm import decontaminate, keyfilter, langid, queries, url_filter

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "https://example.net/enx", "x://EXAMPLE.com/de/", "http://example.com/De/", "http://b.org/fr/x?y", "http://org/fr/", "http://net", "http://net/", "http://notnet/", "http://x.net?a/en/", "no-scheme", None, "", "://", "a://b.net/en/://c", "http://example.net/en/", "http://q.net#/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"keys": F.lit(1), "rule": F.lit("no")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, queries.URL_RULES).collect()}

    def expected(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end].lower(), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.key), default=None)
        return host, path, best and best.key, best.verdict if best else "allow"

    assert got == {i: expected(u) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.judge(df, []).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)
    with pytest.raises(ValueError, match="two verdicts"):
        url_filter.judge(df, [url_filter.parse_rule("net/", v) for v in ("allow", "block")])


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = random.Random(3).sample(keys, 60)
    universe = spark.createDataFrame([(k,) for k in keys + keys[:500]], "key string")
    own = spark.createDataFrame([(k,) for k in listed], "key string")
    cascade = url_filter.build(own, universe, 60, 3000)
    got = {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert got == set(listed) and cascade.size_bytes < 60 * 8 and len(cascade.levels) > 1
    with pytest.raises(url_filter.TooLarge):
        url_filter.build(own, universe, 60, 3000, most_filter_bytes=20)


@pytest.mark.parametrize("sizes", [{}, {"most_filter_bytes": 8}, {"literals": 10}])
def test_long_lists_and_ties(spark, sizes, monkeypatch):
    if "literals" in sizes:
        monkeypatch.setattr(url_filter._verdicts, "__defaults__", (sizes["literals"],))
        sizes = {}
    rnd = random.Random(4)
    rules = [(f"h{i}.net", f"/{'p' * rnd.randint(0, 3)}", rnd.choice(["block", "allow"])) for i in range(400)]
    rules += [("net", "/abcd", "block"), ("a.net", "/ab", "allow"), ("bare.org", "", "block"), ("bare.org", "", "block")]
    urls = [f"http://{rnd.choice(['', 'www.'])}h{rnd.randint(0, 800)}.net/{'p' * rnd.randint(0, 4)}" for _ in range(300)] + ["http://a.net/abcd", "http://b.net/abcd", "x://bare.org?q", "x://y.bare.org/" + "z" * 100_000, None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("no"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, table, **sizes).collect()}
    known = {h + p: (h, p, v) for h, p, v in rules}
    for i, url in enumerate(urls):
        host, slash, rest = (url or "://").split("://", 1)[1].split("?")[0].partition("/")
        fits = [(len(k), len(h), k, v) for k, (h, p, v) in known.items() if (host == h or host.endswith("." + h)) and (slash + rest).startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow")), url
    assert got[300] == ("a.net/ab", "allow") and len(got) == len(urls)


def test_key_filter_loses_nothing(spark):
    import numpy as np

    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys], "h long")
    own = keyfilter.build(df, "h")
    assert own.maybe(keys.view(np.uint64)).all()
    assert own.maybe(np.arange(100_000, dtype=np.uint64)).mean() < 0.1
    assert keyfilter.build(df, "h", most_bits=1 << 16).maybe(keys.view(np.uint64)).all()
    assert not keyfilter.build(df.limit(0), "h").maybe(np.arange(9, dtype=np.uint64)).any()


def noisy(text, rate, rnd):
    out = []
    for c in text:
        x = rnd.random()
        out.append("" if x < rate / 3 else rnd.choice("xyz") if x < 2 * rate / 3 else c + "q" if x < rate else c)
    return "".join(out)


def edits(a, b):
    """Least edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return min(row)


def test_decontamination_against_full_alignment():
    rnd = random.Random(7)
    items = [(i, " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))) for i, n in enumerate((7, 20, 40, 8, 3))]
    index = decontaminate.index_items(items)
    finder = decontaminate.Finder(index)
    texts = [None, "", "a"]
    for rate in (0, 0.03, 0.06, 0.09, 0.12, 0.2):
        for _, t in items:
            texts.append("before this " + noisy(t.upper().replace(" ", "\n "), rate, rnd) + " and after it")
    found = {(d, i) for d, i, *_ in finder.find(texts)}
    segments = [(int(index.items[s]), "".join(map(chr, index.chars[index.starts[s] : index.starts[s] + index.sizes[s]])), int(index.budgets[s])) for s in range(len(index.sizes))]
    expected = {(d, item) for d, t in enumerate(texts) for item, text, budget in segments if edits(text, decontaminate.compared(t)) <= budget}
    assert found == expected and len(found) > 10


def test_decontamination_frames(spark):
    benchmark = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "x THE QUICK, brown fox jumps over\nthe lazy dog near the river-bank!"), (11, "clean text of some length that has nothing to do with it"), (12, None), (13, ""), (10, "the quick brown fox jumps over the lazy dog near the river bank")], "doc_id long, text string").withColumn("item", F.lit(7))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect()) == [(10, 1), (10, 1)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark, block_chars=30).collect()) == [(10, 1), (10, 1)]
    kept = decontaminate.clean(docs, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [11, 12, 13] and kept.columns == docs.columns
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == 5 and decontaminate.matches(docs.limit(0), benchmark).count() == 0


def test_short_items_are_found_between_word_boundaries():
    items = [(1, "What is the capital?"), (2, "the moon"), (3, "法国的首都是哪一座城市呢"), (4, "a b c"), (5, "capital of the far north lands"), (6, None)]
    finder = decontaminate.Finder(decontaminate.index_items(items))
    texts = ["Q: what is THE capital", "under the moonlight", "to the moon!", "人们问法国的首都是哪一座城市呢今天", "a b c", "what is the capitol", "what is the capitals", "somewhat is the capital", "", None]
    texts += ["the capital of the fair north land", "xcapital of the far north lands y", "the moon", "athe moon", "x" * 40]
    found = {(d, items[i][0]): e for d, i, _, e, _ in finder.find(texts)}
    assert found == {(0, 1): 0, (2, 2): 0, (3, 3): 0, (5, 1): 1, (6, 1): 1, (10, 5): 2, (11, 5): 1, (12, 2): 0}


def test_passages_are_found_wherever_they_start():
    rnd = random.Random(12)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(60))
    finder = decontaminate.Finder(decontaminate.index_items([(1, text)]))
    starts = [i for i in range(len(text) - 97) if text[i] != " " and text[i + 95] != " "]
    texts = ["before it " + text[i : i + 96] + " after it" for i in starts] + ["before it " + text[i : i + 70] + " after it" for i in starts]
    assert [d for d, *_ in finder.find(texts)] == list(range(len(starts)))
    assert {d for d, *_ in finder.find(["so " + text[20:120] + " on", "so " + noisy(text[31:140], 0.04, random.Random(2)) + " on"])} == {0, 1}
    assert finder.find([text[:12]]) == []


def least_edits(a, b):
    """The same as ``edits`` of code points, a row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    along = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(new - along) + along
    return row.min()


def test_leaks_of_the_tables_against_full_alignment(spark):
    items = {r.item_id: decontaminate.points(r.text) for r in queries.table(spark, SF, "benchmark").collect()}
    docs = {r.doc_id: decontaminate.points(r.text) for r in queries.table(spark, SF, "documents").collect()}
    grams = {i: set(decontaminate.gram_codes(x).tolist()) for i, x in items.items()}
    expected = set()
    for d, text in docs.items():
        own = set(decontaminate.gram_codes(text).tolist())
        for i, item in items.items():
            size = min(len(item), 96)
            budget = min(int(size * 0.1), max(size // 8 - 1, 0))
            if size < 32 or len(own & grams[i]) < size + 1 - 8 * (budget + 1):  # too few in the whole text already
                continue
            shared = np.concatenate([[0], np.cumsum([g in own for g in decontaminate.gram_codes(item).tolist()])])
            fit = np.flatnonzero(shared[size - 7 :] - shared[: len(shared) - size + 7] >= size + 1 - 8 * (budget + 1))
            if any(least_edits(item[at : at + size], text) <= budget for at in fit):
                expected.add((d, i))
    assert {(r.doc_id, r.item_id) for r in queries.op2_decontaminate(spark, SF).collect()} == expected and expected


def test_language_id_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in queries.table(spark, SF2, "documents").collect()}
    got = queries.op7_language_id(spark, SF2).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the bird", "en"), (4, None, "en"), (5, "", "de"), (6, "123 !?", None), (7, "die vögel", None), (8, "thecatt " * 4000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.train(docs)
    assert model.langs == ["de", "en"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert [got[i][0] for i in range(1, 9)] == ["en", "de", "en", "und", "und", "und", "de", "en"]
    assert got[6][1] == 0
    assert sorted(r.doc_id for r in langid.keep_identified(docs, model).collect()) == [1, 2, 3, 7, 8]
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def brute_language(train, texts):
    """(language, score) of each text, an item at a time."""
    def words(t):
        return "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()

    counts = defaultdict(Counter)
    for text, lang in train:
        counts[lang].update(words(text))
    langs = sorted(x for x in counts if counts[x])
    tables = [{x: counts[x] for x in langs}]
    for size in range(1, langid.LONGEST + 1):
        grams = {x: Counter() for x in langs}
        for x in langs:
            for w, n in counts[x].items():
                w = f"^{w}$"
                for i in range(len(w) - size + 1):
                    grams[x][w[i : i + size]] += n
        tables.append(grams)
    items = [set().union(*(t[x] for x in langs)) for t in tables]

    def log(size, item):
        return np.array([np.log((tables[size][x][item] + 0.5) / (tables[size][x].total() + 0.5 * len(items[size]))) for x in langs])

    def of(w):
        if w in items[0]:
            return log(0, w)
        total, w, at = np.zeros(len(langs)), f"^{w}$", 0
        while at < len(w):
            size = next((n for n in range(min(langid.LONGEST, len(w) - at), 0, -1) if w[at : at + n] in items[n]), 0)
            if size:
                total = total + log(size, w[at : at + size])
            at += size or 1
        return total

    of = functools.cache(of)
    out = []
    for t in texts:
        ws = words(t)
        if not ws or not langs:
            out.append(("und", 0.0))
            continue
        mean = sum(map(of, ws)) / len(ws) * min(len(ws), langid.EVIDENCE)
        share = np.exp(mean - mean.max())
        share /= share.sum()
        out.append((langs[int(share.argmax())], float(share.max())))
    return out


def test_op7_query_against_brute_force(spark):
    docs = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text", "lang").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs}
    expected = brute_language([(t, x) for i, t, x in docs if not held[i] and t is not None and x is not None], [t for _, t, _ in docs])
    got = {r.doc_id: r for r in queries.op7_language_id(spark, SF).collect()}
    for (i, _, _), (lang, score) in zip(docs, expected):
        assert (got[i].held_out, got[i].lang_pred) == (held[i], lang) and abs(got[i].score - score) < 1e-9


def test_language_id_of_odd_texts():
    train = [("the cat İstanbul ΣΟΦΟΣ naïve", "en"), ("der hund straße", "de"), ("le chat 漢字", "fr")]
    texts = ["thecat", "hunde straßen", "漢字漢 x", "ǅungla", "²³", "a_b-c9d", "σοφος", "𝒳 x", "q" * 3000, "the\ncat", None, "", " ", "ﬁne", "é é"]
    counted = Counter((lang, w) for t, lang in train for w in langid.Cut([t]).words())
    rows = pa.table({"lang": [k[0] for k in counted], "item": [k[1] for k in counted], "n": list(counted.values())})
    got = langid.model_of(rows).score(texts)
    expected = brute_language(train, texts)
    assert got[0] == [x for x, _ in expected] and np.allclose(got[1], [s for _, s in expected])
    assert langid.model_of(rows.slice(0, 0)).score(texts)[0] == ["und"] * len(texts)


def test_the_sample_is_bounded_and_the_rest_is_judged(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('word', id % 7, ' same') AS text", "if(id % 2 = 0, 'a', 'b') AS lang")
    rows = langid.sample(docs, "doc_id", "text", "lang", 500).count()
    assert 400 < rows < 600 and langid.sample(docs, "doc_id", "text", "lang", 4000).count() == 4000
    assert langid.predict(docs, langid.train(docs, sample_rows=500)).count() == 4000
