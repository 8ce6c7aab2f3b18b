"""From raw documents to token ids: language id, line dedup, near-duplicate removal, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of ``documents``. A
stage deletes what the stage before it kept for itself, since that one's result is written by then.

Defined cases, of all stages: an empty table gives an empty table; columns beside doc_id, text, lang and n_chars pass through, whatever
their names, but the last stage's result has its own. Texts are taken whole, however long. Further cases are named at the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import bpe, decontaminate, jaccard_join, langid, line_dedup, store
from cartolith.llm.queries import tokenizer

_KEPT: list[str] = []


def _begin(spark: SparkSession) -> list[str]:
    store.drop(spark, *_KEPT)
    _KEPT.clear()
    return _KEPT


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the training folds; documents without a language, or with a doubtful one, go.

    Null and empty texts have no language, so they go. Repeated rows share their fate. Null labels aren't learned from; without any label all documents go. Null ids
    are in no fold: such rows are judged, but not learned from."""
    with store.scope(_begin(spark)):
        model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
        return langid.keep_identified(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen in a smaller document go; n_chars follows the text.

    Documents stay, with an empty text if all lines go; null texts stay null, with null n_chars. Rows of one id are one document. Rows with a null id keep all lines."""
    with store.scope(_begin(spark)):
        out = line_dedup.dedup(docs)
        return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one of the least id stays.

    Null and empty texts are linked with nothing and stay. Rows of one id are one document and stay or go together. Rows with a null id stay. A similarity of exactly 0.8
    links."""
    with store.scope(_begin(spark)):
        found = jaccard_join.join(docs, k=5, percent=80)
        gone = found.where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Null and empty texts, and an empty benchmark, match nothing. Each row is judged on its own, with or without an id."""
    with store.scope(_begin(spark)):
        return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests that prove the round trip: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are encoded as empty ones. Each row is encoded on its own; null ids stay null."""
    with store.scope(_begin(spark)):
        return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]
#: Neither the near-duplicate stage's edit budget nor merges can be put in SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = store.save(spark, stage(spark, docs, sf_dir), name)
        if before:
            store.drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
