"""Line dedup with DataFrame operations only.

Every line becomes a row of its key's 128-bit hash, document and position. Hashes are even, so ranges of equal width hold equally many
keys; a key of more rows than a range should have is dealt over several slices of its range by document. How many those
are, a sample of the rows tells; it only balances work. Rows are range-partitioned by range and slice, the only shuffle of
lines, sorted there by hash, document and position, and streamed once: a running window carries the first document of the current
key. A sliced key gets its first document from a table of those keys, two for each range at most. Lines in any later document are dropped.
The result is, for each document, a keep bitmap in 64-bit words of which those that keep everything are left out; no text is
moved to find it.

Defined cases: null or empty text is one empty line. Keys of fewer than ``min_chars`` code points are always kept. Rows
with the same id are one document; rows with the same id and text get the same bitmap. Rows with a null id keep all
lines and count for nothing. Lines and texts of any length are taken whole. An empty table gives an empty table. Extra columns, whatever
their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm import store

SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """h1, h2, doc, th, pos of every line whose key is long enough."""
    own = docs.where(F.col(id_col).isNotNull())
    each = own.select(F.col(id_col).alias("doc"), text_hash(F.col(text_col)).alias("th"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    each = each.select("doc", "th", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return each.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(77), "key").alias("h2"), "doc", "th", "pos")


def frequent_keys(hashed: DataFrame, most: int) -> DataFrame:
    """h1, h2, slices of keys with about ``most`` rows or more, from one row in so many that such a key has 64."""
    one_in = max(1, most // 64)
    some = hashed.where(F.pmod(F.xxhash64("doc", "pos", "h1"), F.lit(one_in)) == 0) if one_in > 1 else hashed
    counts = some.groupBy("h1", "h2").agg((F.count(F.lit(1)) * one_in).alias("n")).where(F.col("n") > most / 2)
    return counts.select("h1", "h2", F.ceil(2 * F.col("n") / most).cast("long").alias("slices"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, ranges: int | None = None) -> DataFrame:
    """doc, th (hash of the text), words: map of word number -> 64 bits, 1 for a dropped line; only documents that lose lines.
    ``ranges``: of hashes; eight for each shuffle partition unless given."""
    spark = docs.sparkSession
    hashed, hashed_path = store.save(spark, hashed_lines(docs, id_col, text_col, min_chars), "lines")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 8 * n
    most = max(1, hashed.count() // ranges)
    hot, hot_path = store.save(spark, frequent_keys(hashed, most), "frequent")
    # Two keys for each range at most, by their definition.
    dealt = hashed.join(F.broadcast(hot), ["h1", "h2"], "left")
    own = F.least(F.floor((F.col("h1") / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1)).cast("long")
    part = own * (1 << 32) + F.coalesce(F.pmod(F.xxhash64("doc"), F.col("slices")), F.lit(0))
    order = ["h1", "h2", "doc", "th", "pos"]
    ranged = dealt.withColumn("part", part).repartitionByRange(n, "part")
    stream = Window.partitionBy("part").orderBy(*order)
    so_far = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = (F.lag("h1").over(stream) != F.col("h1")) | (F.lag("h2").over(stream) != F.col("h2")) | F.lag("h1").over(stream).isNull()
    seen = ranged.withColumn("new", new).withColumn("first", F.last(F.when(F.col("new"), F.col("doc")), ignorenulls=True).over(so_far))
    seen, _ = store.save(spark, seen.where((F.col("doc") > F.col("first")) | (F.col("slices") > 1)).select("h1", "h2", "doc", "th", "pos", "first", "slices"), "streamed")
    store.drop(spark, hashed_path, hot_path)
    firsts = seen.where("slices > 1").groupBy("h1", "h2").agg(F.min("first").alias("carried"))
    owned = seen.join(F.broadcast(firsts), ["h1", "h2"], "left").withColumn("owner", F.least("first", F.coalesce("carried", "first")))
    dropped = owned.where(F.col("doc") > F.col("owner"))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = dropped.groupBy("doc", "th", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def fresh(names: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that none of the others has, in any case."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "_kept_lines", dropped_col: str = "_n_dropped") -> DataFrame:
    """All columns of ``docs`` and the kept lines (array) and the number of dropped ones, whose names must be new."""
    if {kept_col.lower(), dropped_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {kept_col} or {dropped_col} already")
    doc, th, words = fresh([*docs.columns, kept_col, dropped_col], "_doc", "_th", "_words")
    marks = bitmaps.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("words").alias(words))
    both = docs.join(marks, (F.col(id_col) == F.col(doc)) & (text_hash(F.col(text_col)) == F.col(th)), "left")
    lines = lines_of(F.col(text_col))

    def keeps(line: Column, i: Column) -> Column:
        word = F.element_at(F.col(words), F.floor(i / 64).cast("int"))
        return F.coalesce(F.getbit(word, (i % 64).cast("int")) == 0, F.lit(True))

    kept = F.when(F.col(words).isNull(), lines).otherwise(F.filter(lines, keeps))
    out = both.withColumn(kept_col, kept).withColumn(dropped_col, F.size(lines).cast("long") - F.size(kept_col))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), kept_col, dropped_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with the text replaced by its kept lines; documents without text stay as they are."""
    kept, dropped = fresh(docs.columns, "_kept_lines", "_n_dropped")
    out = apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col, kept, dropped)
    text = F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.withColumn(text_col, text).drop(kept, dropped)
