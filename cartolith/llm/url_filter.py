"""URL rules looked up through cascades of Bloom filters: exact, without a join and without Python on executors.

A URL's keys are all its host's suffixes, each followed by the starts of its path that have the length of some listed
path. The universe is every key of every URL of the corpus. Level 1 of the cascade encodes the listed keys; level 2 encodes
the keys of the universe that pass level 1 but aren't listed; level 3 the listed keys that pass level 2; and so on until nothing passes
wrongly. A key is listed if the first level that lacks it has an even number. So membership is exact for every URL of the
corpus. The verdicts of a long list are cascades, too, whose universe is the list.

The list is a table. Level 1 is sized so that about as many keys pass wrongly as are listed; the corpus is read once for
all that pass level 1, a table of about twice the list, and further levels read that. All levels together take some
log2(universe / list) bits for each listed key. They are literals in the plan of at most ``most_filter_bytes``; what reaches the
driver is their set bits, 63 in a row. A longer list, whose filters don't fit, is looked up by an equi-join of keys, with
the same result.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule. Repeated rows are judged
each on its own, whatever their ids, null ones included. Of the rules that fit, the one with most letters (host and path) wins, of those with equally many the
one with the longer host; equal rules can't be listed with different verdicts, and listing one twice changes nothing. URLs that no rule fits get
``otherwise``. Very long URLs are taken whole. An empty table gives an empty table, an empty list ``otherwise`` for all. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm import store

WORD = 7  # bits in a byte of a filter: bytes below 128 are read back as ASCII


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def parse_rule(text: str, verdict: str) -> Rule:
    """``example.net/en/``: host up to the first slash, then the start of the path."""
    host, slash, rest = text.partition("/")
    return Rule(host.lower(), slash + rest, verdict)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, path_lengths: list[int], most_labels: int) -> Column:
    """All keys of a URL; hosts of more labels than any rule keep all suffixes that a rule can equal."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(count, F.lit(most_labels))), lambda n: F.array_join(F.slice(labels, count - n + 1, n), "."))
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths])
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(starts), lambda p: F.concat(s, p))))
    return F.when(host != "", both).otherwise(F.array().cast("array<string>"))


def positions(key: Column, level: int, n_hashes: int, n_bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * 64 + k), key), F.lit(n_bits).cast("long")) for k in range(n_hashes)]


@dataclass(frozen=True)
class Level:
    number: int
    n_hashes: int
    n_bits: int
    bits: bytes

    def has(self, key: Column) -> Column:
        filled = F.lit(bytearray(self.bits))
        tests = []
        for at in positions(key, self.number, self.n_hashes, self.n_bits):
            byte = F.ascii(F.substring(filled, (F.floor(at / WORD) + 1).cast("int"), 1).cast("string"))
            tests.append(F.getbit(byte, (at % WORD).cast("int")) == 1)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Cascade:
    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """The first level that lacks the key decides; a key that all levels have is of the last level's kind."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.has(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return out

    @property
    def size_bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)


class TooLarge(ValueError):
    """The filters don't fit in the bound."""


def _filled(keys: DataFrame, number: int, n_hashes: int, n_bits: int) -> Level:
    """Set bits of all keys, or-ed on the executors, nine bytes in a row; at most n_bits / 63 rows come back."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), number, n_hashes, n_bits))).alias("at"))
    rows = at.groupBy(F.expr("at div 63").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 63 as int))")).alias("b"))
    body = bytearray((n_bits // 63 + 1) * 9)
    for r in rows.collect():
        for i in range(9):
            body[r.w * 9 + i] = r.b >> (7 * i) & 0x7F
    return Level(number, n_hashes, n_bits, bytes(body))


def build(listed: DataFrame, universe: DataFrame, n_listed: int, total: int, most_filter_bytes: int = 4 << 20, most_levels: int = 40) -> Cascade:
    """``listed`` and ``universe`` have a column ``key``, the universe's repeated or not; ``n_listed`` and ``total`` are about their numbers of distinct keys. The
    universe is read once."""
    spark = listed.sparkSession
    own = listed.select("key")
    used: list[str] = []
    levels: list[Level] = []
    inside, outside, n_inside, n_outside = own, None, n_listed, max(total, 1)
    if not n_inside:
        return Cascade([])
    for number in range(1, most_levels + 1):
        rate = min(0.5, n_inside / (2 * n_outside)) if number == 1 else 0.5
        n_hashes = max(1, round(-math.log2(rate)))
        n_bits = max(64, math.ceil(n_inside * n_hashes / math.log(2)))
        if n_bits / WORD + sum(len(x.bits) for x in levels) > most_filter_bytes:
            raise TooLarge(f"the filters of {n_inside} keys would take over {most_filter_bytes} bytes")
        levels.append(_filled(inside, number, n_hashes, n_bits))
        others = universe.select("key") if outside is None else outside
        others = others.where(levels[-1].has(F.col("key"))).distinct()
        if outside is None:
            others = others.join(own, "key", "left_anti")
        passed, path = store.save(spark, others, "passed")
        used.append(path)
        n_passed = passed.count()
        if not n_passed:
            store.drop(spark, *used)
            return Cascade(levels)
        inside, outside, n_inside, n_outside = passed, inside, n_passed, n_inside
    raise RuntimeError("the cascade did not end; hash values of two keys are equal at every level")


def _longest(keys: Column) -> Column:
    """Of an array of keys the one of most letters, of equals that of the longer host; null for none."""
    host = lambda k: F.when(F.instr(k, "/") > 0, F.instr(k, "/") - 1).otherwise(F.length(k))
    return F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), host(k).alias("h"), k.alias("key"))))


def _joined(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule and verdict of each page by an equi-join of keys: a row for each host and path meets its pages again."""
    each = parts.select("host", "path", F.explode("keys").alias("key")).distinct().join(rules, "key")
    best = each.groupBy("host", "path").agg(F.max(F.struct(F.length("key"), F.when(F.instr("key", "/") > 0, F.instr("key", "/") - 1).otherwise(F.length("key")), "key", "verdict")).alias("best"))
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), F.col("best.verdict").alias("found"))


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", **sizes: int) -> DataFrame:
    """page_id, host, path, rule, verdict. ``rules``: a list, or a table (host, path, verdict). The URL column is read three times, pages
    aren't shuffled."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    keyed, _ = store.save(spark, rules.select(F.concat("host", "path").alias("key"), "host", "path", "verdict").dropDuplicates(["key", "verdict"]), "rules")
    shape = keyed.agg(F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"), F.collect_set("verdict").alias("verdicts")).first()
    if shape.n != shape["keys"]:
        raise ValueError("a rule is listed with two verdicts")
    lengths, labels = sorted(shape.lengths, reverse=True), shape.labels or 1
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not lengths:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    parts = parts.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths, labels))
    universe = parts.select(F.explode("keys").alias("key"))
    try:
        cascade = build(keyed, universe, shape.n, universe.agg(F.approx_count_distinct("key", 0.02)).first()[0], **sizes)
        verdict = _verdicts(keyed, shape.n, sorted(shape.verdicts), **sizes)
    except TooLarge:
        found = _joined(parts, keyed.select("key", "verdict"))
    else:
        found = parts.select("page_id", "host", "path", _longest(F.filter("keys", cascade.contains))["key"].alias("rule")).withColumn("found", verdict(F.col("rule")))
    return found.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(otherwise)).alias("verdict"))


def _verdicts(keyed: DataFrame, n: int, kinds: list[str], most_literals: int = 1000, **sizes: int) -> Callable[[Column], Column]:
    """The verdict of a listed key as a column: from the keys of all kinds but the last, as literals where they are few, else in a cascade over the list."""
    tests = []
    for kind in kinds[:-1]:
        own = keyed.where(F.col("verdict") == kind).select("key")
        if n <= most_literals:
            tests.append((F.lit(kind), lambda k, keys=[r.key for r in own.collect()]: k.isin(keys)))
        else:
            tests.append((F.lit(kind), build(own, keyed, own.count(), n, **sizes).contains))

    def verdict(key: Column) -> Column:
        out = F.lit(kinds[-1])
        for kind, holds in tests:
            out = F.when(holds(key), kind).otherwise(out)
        return F.when(key.isNotNull(), out)

    return verdict
