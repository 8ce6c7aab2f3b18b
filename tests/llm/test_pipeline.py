"""The pipeline against plain versions of its stages."""

import hashlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cartolith.llm import decontaminate, langid, queries
from test_duplicates import brute_jaccard, brute_lines

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    model = langid.train(docs.where(~langid.held_out(docs.doc_id)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    langs, scores = model.score([t for _, t in rows])
    rows = [r for r, lang, s in zip(rows, langs, scores) if lang != "und" and s >= 0.5]
    lines = brute_lines(rows, 10)
    rows = [(k, None if t is None else lines[k][1]) for k, t in rows]
    groups = brute_jaccard(rows, 5, 80)
    rows = [(k, t) for k, t in rows if groups[k][1] == k]
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    bad = {d for d, *_ in decontaminate.Finder(decontaminate.index_items(items)).find([t for _, t in rows])}
    lib = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    expected = {}
    for n, (k, t) in enumerate(rows):
        if n not in bad:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            expected[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected


def test_stages_keep_the_columns(spark):
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_stages_with_odd_rows_and_clashing_names(spark):
    whole = queries.table(spark, SF, "documents")
    some = whole.orderBy("doc_id").limit(40)
    text = some.first().text
    odd = [(None, text), (None, None), (900_001, None), (900_002, ""), (900_003, " \n \n"), (900_004, text), (900_004, text), (900_005, "x" * 300_000)]
    more = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) AS lang", "'s' AS source", "cast(length(text) as long) AS n_chars")
    extra = {n: F.lit(1) for n in ("k", "t", "h", "th", "doc", "_words", "_kept_lines", "component_id", "part", "score")}
    docs = some.select(*more.columns).unionAll(more).withColumns(extra)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        counts[name] = len(rows)
        if name != "bpe":
            assert out.columns == docs.columns and all(r.part == 1 and r._words == 1 for r in rows)
        kept = {r.doc_id for r in rows}
        assert (900_001 in kept) == (900_002 in kept) == (name != "language_id")
        if name == "line_dedup":
            assert {r.doc_id: r.n_chars for r in rows}[900_001] is None and {r.text for r in rows if r.doc_id is None} == {text, None}
        if name == "ngram_jaccard_join":
            assert 900_004 not in kept and sum(r.doc_id is None for r in rows) == 2
    assert counts["bpe"] == counts["line_dedup"] == 48
