"""The thin queries of this subpackage over the test tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import bpe, decontaminate, embedding_dedup, jaccard_join, langid, line_dedup, store, substring_dedup, token_counts, token_files, url_filter


def tokenizer(name: str) -> str:
    """A vocabulary file; CARTOLITH_TOKENIZERS names another folder."""
    folder = os.environ.get("CARTOLITH_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path, end_id=1)
    return token_files.document_digests(spark, path)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    n_lines = (F.size("_kept_lines") + F.col("_n_dropped")).cast("long")
    return out.select("doc_id", n_lines.alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.array_join("_kept_lines", "\n"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > owner) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR doc_id = owner), '')) AS kept_sha256
FROM keyed LEFT JOIN owners USING (key) GROUP BY doc_id
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=4, percent=85)


OP4_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM worded
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingles),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.seen = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT id AS doc_id, min(seen) AS component_id FROM reach GROUP BY id) USING (doc_id)
"""


URL_RULES = [
    url_filter.parse_rule("net/", "block"),
    url_filter.parse_rule("example.net/en/", "allow"),
    url_filter.parse_rule("example.com/de/", "block"),
    url_filter.parse_rule("org/fr/", "allow"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.lengths(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), group_col="lang")
    return token_counts.suffix_sums(token_counts.histogram(counted)).withColumnRenamed("grp", "lang")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


OP8_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.seen = links.a
), counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a), grouped AS (SELECT id AS vec_id, min(seen) AS c FROM reach GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN grouped USING (vec_id) LEFT JOIN counted USING (vec_id)
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = substring_dedup.apply_repeats(docs, substring_dedup.repeats(docs, window=50))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM worded WHERE len(w) >= 50)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM windows) WHERE first < doc_id
), words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM worded),
marked AS (
  SELECT doc_id, i, word, coalesce(max(start) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > i - 50, FALSE) AS gone
  FROM (SELECT words.doc_id, words.i, word, later.i AS start FROM words LEFT JOIN later ON later.doc_id = words.doc_id AND later.i = words.i)
)
SELECT doc_id, count(word) AS n_words, count(*) FILTER (gone AND word IS NOT NULL) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents LEFT JOIN marked USING (doc_id) GROUP BY doc_id
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_files, op2_decontaminate, op3_line_dedup, op4_jaccard_join, op5_url_filter, op6_token_counts, op7_language_id, op8_embedding_dedup, op9_substring_dedup, op10_bpe)
}
SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op5_url_filter": OP5_SQL, "op8_embedding_dedup": OP8_SQL, "op9_substring_dedup": OP9_SQL}
