"""Token counts for every context limit from one exact length histogram.

Documents are aggregated by group and encoded length; suffix sums over that histogram answer, for every limit, how
many documents reach it, how many ids they hold and how many are left when documents are cut at it. The histogram has a
row for each distinct length, whatever the number of documents.

Defined cases: null text has length 0; a null group is a group of its own; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.arrowtext import column, slices
from cartolith.llm.bpe import SLICE, document_encoder


def lengths(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """doc_id, grp, n_tokens."""
    import numpy as np

    kind = docs.schema[id_col].dataType.simpleString()
    group = (F.col(group_col) if group_col else F.lit("")).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = document_encoder(tokenizer_path)
        for b in slices(batches, "t", SLICE):
            _, offsets = own.encode_column(column(b, "t"))
            yield pa.RecordBatch.from_arrays([column(b, "k"), column(b, "grp"), pa.array(np.diff(offsets))], ["k", "grp", "n_tokens"])

    out = docs.select(F.col(id_col).alias("k"), group.alias("grp"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, grp string, n_tokens long")
    return out.withColumnRenamed("k", id_col)


def histogram(counted: DataFrame) -> DataFrame:
    """grp, n_tokens, n_docs. Partial sums before the shuffle; no group of documents meets in a task."""
    return counted.groupBy("grp", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds docs_ge and tokens_ge (documents at least that long, and their ids), tokens_total (of the group) and
    tokens_cut: the ids left when every document of the group is cut at n_tokens."""
    down = Window.partitionBy("grp").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("grp")
    held = F.col("n_docs") * F.col("n_tokens")
    out = hist.withColumns({"docs_ge": F.sum("n_docs").over(down), "tokens_ge": F.sum(held).over(down), "tokens_total": F.sum(held).over(whole)})
    return out.withColumn("tokens_cut", F.col("tokens_total") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """grp, context_limit, tokens_cut, docs_over for any limits, from the suffix sums alone."""
    over = F.col("n_tokens") > F.col("context_limit")
    asked = sums.withColumn("context_limit", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])))
    return asked.groupBy("grp", "context_limit").agg(
        (F.max("tokens_total") - F.coalesce(F.sum(F.when(over, F.col("n_docs") * (F.col("n_tokens") - F.col("context_limit")))), F.lit(0))).alias("tokens_cut"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """grp, share, n_tokens: the least length that at least that share of documents doesn't exceed."""
    whole = Window.partitionBy("grp")
    up_to = F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")
    asked = sums.withColumn("all_docs", F.max("docs_ge").over(whole)).withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    return asked.where(up_to >= F.ceil(F.col("share") * F.col("all_docs"))).groupBy("grp", "share").agg(F.min("n_tokens").alias("n_tokens"))
