"""Embedding near-dedup: exact links by blocks of matrix products, or by multi-index tables probed as far as a link can reach.

Every link is found; nothing depends on recall. All cosines are computed in double precision from the original vectors, as
blocks of matrix products. A task returns counts and a spanning forest, never the pairs.

A label is compared whole, all its vectors with each other, unless the tables save work. Their codes are signs of the centred,
rotated vectors, a rotation learned on a bounded sample (iterative quantisation, about ``sample_rows`` by a hash of the id); a
code is cut into substrings of ``table_bits``, one table each. Rotated vectors are no further apart than the vectors, so two
that link differ by at most 1 / tables of the greatest squared distance in one of the tables at least; where their signs differ
there, the squares of one of the two sum to half of that at most. Each vector is thus sent to its own bucket and to those that
such a sum reaches, and a pair is counted in the first table that brings it together. How many buckets that is and how many
pairs they hold is measured on the sample: vectors whose links reach most buckets (a strong common direction, a low ``least``)
are compared whole, others only in labels of at most ``whole_rows``.

Buckets and labels of more than ``block_rows`` are dealt over blocks; every pair of blocks is a task of its own, so none is
gathered and none is capped. Comparing a label whole takes time by the square of its size.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have no label, link with nothing.
Vectors of each length are searched by themselves, with a rotation of their own; lengths of fewer than ``LEAST_FIT`` rows of the
sample are compared whole. Components of four bytes and of eight are both compared in double precision as they are. Ids are integers;
rows with a null id link with nothing, are kept and have no component. Repeated rows are rows of their own; rows with the same id link as one
component. Ties: a cosine of exactly ``least`` links. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm import store
from cartolith.llm.arrowtext import column
from cartolith.llm.components import components
from cartolith.llm.workers import tidy

LEAST_FIT = 64


class Quantiser:
    """Mean and rotation: the code is the signs of (unit vector - mean) @ rotation."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray) -> None:
        self.mean, self.rotation = mean, rotation
        self.turns = max(1, -(-rotation.shape[1] // max(1, rotation.shape[0])))  # how often a difference is counted at most

    @classmethod
    def fit(cls, unit: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 7) -> Quantiser:
        mean = unit.mean(0)
        _, _, axes = np.linalg.svd(unit - mean, full_matrices=False)
        axes = axes[: min(bits, len(axes))].T
        if axes.shape[1] < min(bits, unit.shape[1]):  # fewer rows than dimensions
            axes = np.eye(unit.shape[1])[:, :bits]
        flat = (unit - mean) @ axes
        rng, turns = np.random.default_rng(seed), []
        for _ in range(-(-bits // flat.shape[1])):  # short vectors get several rotations, each from another start
            turn, _ = np.linalg.qr(rng.standard_normal((flat.shape[1], flat.shape[1])))
            for _ in range(rounds):
                signs = np.where(flat @ turn >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(signs.T @ flat)
                turn = (u @ v).T
            turns.append(axes @ turn)
        return cls(mean, np.hstack(turns)[:, :bits])

    def turned(self, unit: np.ndarray, table_bits: int) -> np.ndarray:
        """Of each vector, table and bit: the coordinate whose sign is the bit. Bits that fill up the last table are never changed."""
        flat = ((unit - self.mean) @ self.rotation).astype("<f4")
        tables = -(-flat.shape[1] // table_bits)
        return np.pad(flat, ((0, 0), (0, tables * table_bits - flat.shape[1])), constant_values=1e15).reshape(len(flat), tables, table_bits)

    def reach(self, least: float, tables: int) -> float:
        """The greatest sum of squares, of one of two vectors that link, where their signs differ in the table that they are found by."""
        return self.turns * (max(0.0, 2 - 2 * least) + 1e-5) / (2 * tables)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))


def _matrix(array: pa.Array, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), kind).reshape(-1, size).astype(np.float64)


def kind_of(vectors: DataFrame, vec_col: str) -> str:
    """How components travel: in four bytes if they come in four, else in eight."""
    return "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """k, label, v: vectors that can link. The label is that of the vector's length, too."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    named = F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    own = F.col(vec_col) if kind_of(vectors, vec_col) == "<f4" else v
    return vectors.where(fine & named).select(F.col(id_col).cast("long").alias("k"), F.xxhash64(F.col(label_col).cast("string"), F.size(v)).alias("label"), own.alias("v"))


def _subs(turned: np.ndarray) -> np.ndarray:
    """The substring of each vector in every table."""
    return (turned >= 0) @ (1 << np.arange(turned.shape[-1]))


def _costs(turned: np.ndarray) -> np.ndarray:
    """Of each vector of one table: the sum of squares for every set of changed bits. Sums are made in the order of the bits, as in ``_probes``."""
    squares = turned.astype(np.float64) ** 2
    out = np.zeros((len(turned), 1))
    for bit in range(squares.shape[1]):
        out = np.concatenate([out, out + squares[:, bit : bit + 1]], 1)
    return out


def _probes(turned: np.ndarray, changed: np.ndarray, reach: float) -> np.ndarray:
    """Whether each vector of one table reaches the bucket that differs by the bits of ``changed``."""
    total = np.zeros(len(turned))
    for bit in range(turned.shape[1]):
        total = total + np.where(changed >> bit & 1, turned[:, bit].astype(np.float64) ** 2, 0.0)
    return total <= reach


def _spots(turned: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, spot) of every bucket that a vector is sent to. Spot: (table, substring), doubled, and 1 more where it is the vector's own."""
    subs = _subs(turned)
    rows, spots = [], []
    for table in range(turned.shape[1]):
        row, changed = np.nonzero(_costs(turned[:, table]) <= reach)
        rows.append(row)
        spots.append(((table << turned.shape[2] | subs[row, table] ^ changed) << 1) + (changed == 0))
    return np.concatenate(rows), np.concatenate(spots)


def whole_up_to(turned: np.ndarray, reach: float, block_rows: int) -> int | None:
    """Labels of at most so many rows are sent fewer times as blocks than to the tables; None: the tables don't save half the pairs."""
    spots = np.concatenate([_spots(turned[at : at + 1024], reach)[1] for at in range(0, len(turned), 1024)])
    size = turned.shape[1] << turned.shape[2]
    own = np.bincount(spots[spots & 1 == 1] >> 1, minlength=size).astype(float)
    sent = np.bincount(spots[spots & 1 == 0] >> 1, minlength=size)
    if (own * own / 2 + own * sent).sum() > len(turned) ** 2 / 4:
        return None
    return int(block_rows * len(spots) / len(turned))


def bucketed(own: DataFrame, quantisers: dict[int, Quantiser], table_bits: int, least: float, whole_rows: dict[int, int], type_: str = "<f4") -> DataFrame:
    """k, label, v (binary), y (binary: the rotated vector, null in labels that are compared whole), spots (the buckets it is sent to)."""
    sent = own.sparkSession.sparkContext.broadcast(quantisers)
    width = np.dtype(type_).itemsize
    if whole_rows:
        limit = F.element_at(F.create_map(*(F.lit(x) for pair in whole_rows.items() for x in pair)), F.size("v"))
        counts = own.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
        own = own.join(counts, "label").withColumn("whole", F.coalesce(F.col("rows") <= limit, F.lit(True)))
    else:
        own = own.withColumn("whole", F.lit(True))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = [np.asarray(x, type_).tobytes() for x in column(b, "v").to_pylist()]
            y: list[bytes | None] = [None] * len(raw)
            spots: list[list[int]] = [[1]] * len(raw)
            sizes = np.where(np.array(column(b, "whole").to_pylist(), bool), 0, [len(x) // width for x in raw])
            for size in np.unique(sizes[sizes > 0]).tolist():
                dealt = np.flatnonzero(sizes == size)
                quantiser = sent.value[size]
                for at in range(0, len(dealt), 1024):
                    some = dealt[at : at + 1024]
                    turned = quantiser.turned(_unit(_matrix(pa.array([raw[i] for i in some], pa.binary()), size, type_)), table_bits)
                    row, spot = _spots(turned, quantiser.reach(least, turned.shape[1]))
                    for i, t in zip(some, turned):
                        y[i], spots[i] = t.tobytes(), []
                    for r, x in zip(some[row].tolist(), spot.tolist()):
                        spots[r].append(x)
            yield pa.RecordBatch.from_arrays([column(b, "k"), column(b, "label"), pa.array(raw, pa.binary()), pa.array(y, pa.binary()), pa.array(spots, pa.list_(pa.int32()))], ["k", "label", "v", "y", "spots"])

    return own.select("k", "label", "v", "whole").mapInArrow(run, "k long, label long, v binary, y binary, spots array<int>")


def forest_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix: a breadth-first search that reads each row once."""
    left = np.ones(len(linked), bool)
    out = []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            out += [(i, int(j)) for j in new]
            queue += new.tolist()
    return out


class Bucket:
    """The rows of a task. ``turned`` (null where a label is compared whole) and ``home`` tell which pairs are this bucket's to count."""

    def __init__(self, unit: np.ndarray, turned: np.ndarray | None, home: np.ndarray, table: int, least: float, reach: float) -> None:
        self.unit, self.turned, self.home, self.table, self.least, self.reach = unit, turned, home, table, least, reach
        self.subs = None if turned is None else _subs(turned)

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of rows a and b: the pairs that link and that no other bucket counts."""
        out = self.unit[a] @ self.unit[b].T >= self.least
        if self.turned is None:
            return out
        out &= self.home[a][:, None] | self.home[b][None, :]
        for earlier in range(self.table):
            out &= self.subs[a, earlier][:, None] != self.subs[b, earlier][None, :]
        i, j = np.nonzero(out)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            p, q = a[x], b[y]
            again = np.zeros(len(p), bool)
            for table in range(self.table):
                changed = self.subs[p, table] ^ self.subs[q, table]
                again |= _probes(self.turned[p, table], changed, self.reach) | _probes(self.turned[q, table], changed, self.reach)
            own, other = np.where(self.home[p], p, q), np.where(self.home[p], q, p)
            mine, theirs = self.subs[own, self.table], self.subs[other, self.table]
            again |= (theirs < mine) & _probes(self.turned[own, self.table], mine ^ theirs, self.reach)  # the other's bucket has it too
            out[x[again], y[again]] = False
        return out

    def links(self, side: np.ndarray | None, tile: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(links of each row, edges of spanning forests), a tile at a time; ``side`` says which rows are of the first of two blocks."""
        every = np.arange(len(self.unit))
        left, right = (every, every) if side is None else (every[side], every[~side])
        count, edges = np.zeros(len(every), np.int64), []
        for i in range(0, len(left), tile):
            for j in range(i if side is None else 0, len(right), tile):
                a, b = left[i : i + tile], right[j : j + tile]
                linked = self.linked(a, b)
                if side is None and i == j:
                    linked = np.triu(linked, 1)
                if not linked.any():
                    continue
                np.add.at(count, a, linked.sum(1))
                np.add.at(count, b, linked.sum(0))
                some, others = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                rows = np.unique(np.concatenate([a[some], b[others]]))
                both = np.zeros((len(rows), len(rows)), bool)
                both[np.ix_(np.searchsorted(rows, a[some]), np.searchsorted(rows, b[others]))] = linked[np.ix_(some, others)]
                edges += [(int(rows[x]), int(rows[y])) for x, y in forest_edges(both | both.T)]
        return count, edges


def links(own: DataFrame, least: float, block_rows: int, table_bits: int, reach: dict[int, float], type_: str = "<f4") -> DataFrame:
    """a, b, n: partial link counts (b null) and forest edges (n null), from ``bucketed`` rows."""
    each = own.select("k", "label", "v", "y", F.explode("spots").alias("spot"))
    each = each.withColumns({"home": F.col("spot") % 2 == 1, "spot": F.shiftright("spot", 1)})
    sizes = each.groupBy("label", "spot").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("any"), F.max(F.length("v")).alias("bytes")).where("size > 1 and any")
    each = each.join(sizes, ["label", "spot"])
    most = F.greatest(F.lit(block_rows), F.floor(F.lit(1 << 23) / F.col("bytes")))  # 16 MB of doubles
    deal = F.least(F.greatest(F.ceil(F.col("size") / 8), F.lit(block_rows)), most)
    each = each.withColumn("many", F.ceil(F.col("size") / deal).cast("int"))
    each = each.withColumn("mine", F.pmod(F.xxhash64("k"), F.col("many")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    each = each.select("k", "label", "v", "y", "spot", "home", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    keys = ["label", "spot", "lo", "hi"]
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.withColumn("g", F.xxhash64(*keys)).repartition(n, "g").sortWithinPartitions("g", *keys)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            group = np.stack([t[x].to_numpy() for x in keys], 1)
            heads = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)]))
            ids, sides, home = t["k"].to_numpy(), t["mine"].to_numpy(), np.array(t["home"].to_pylist(), bool)
            a, b, c = [], [], []
            for s, e in zip(heads, np.append(heads[1:], len(ids))):
                if e - s < 2:
                    continue
                _, spot, lo, hi = group[s].tolist()
                vectors = t["v"].slice(s, e - s)
                size = len(vectors[0].as_py()) // np.dtype(type_).itemsize
                unit = _unit(_matrix(vectors, size, type_))
                raw = t["y"].slice(s, e - s).to_pylist()
                turned = None if raw[0] is None else np.frombuffer(b"".join(raw), "<f4").reshape(e - s, -1, table_bits)
                count, edges = Bucket(unit, turned, home[s:e], spot >> table_bits, least, reach.get(size, 0.0)).links(sides[s:e] == lo if lo != hi else None, block_rows)
                some = np.flatnonzero(count)
                own_ids = ids[s:e]
                a += own_ids[some].tolist() + [int(own_ids[x]) for x, _ in edges]
                b += [None] * len(some) + [int(own_ids[y]) for _, y in edges]
                c += count[some].tolist() + [None] * len(edges)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["a", "b", "n"])

        last, rows = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = column(b, "g").to_numpy()
            if rows + len(g) > 4 * block_rows:
                cut = np.flatnonzero(np.concatenate([[last != g[0]], g[1:] != g[:-1]]))
                if cut.size:
                    at = int(cut[-1])
                    held += [b.slice(0, at)] if at else []
                    if held:
                        yield done()
                    b, rows = b.slice(at), 0
            held.append(b)
            rows += b.num_rows
            last = g[-1]
        if held:
            yield done()

    return dealt.mapInArrow(run, "a long, b long, n long")


def sample_of(own: DataFrame, n: int, sample_rows: int) -> list[np.ndarray]:
    """Vectors of all ``n`` rows, or of about ``sample_rows`` of them by a hash of the id."""
    if n > sample_rows:
        own = own.where(F.pmod(F.xxhash64(F.lit(31), "k"), F.lit(1 << 40)) < F.lit(int((1 << 40) * (sample_rows / n))))
    vectors = own.select(F.transform("v", lambda x: x.cast("double")).alias("v")).toArrow()["v"].combine_chunks()
    if not len(vectors):
        return []
    return np.split(vectors.flatten().to_numpy(), np.cumsum(pc.list_value_length(vectors).to_numpy())[:-1])


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", table_bits: int | None = None, sample_rows: int = 20_000, block_rows: int = 2048, whole_rows: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector. ``whole_rows``, if given, instead of what the sample says; results don't depend on
    it, nor on ``table_bits``, which follows the number of vectors unless given."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    own, type_ = usable(vectors, id_col, vec_col, label_col), kind_of(vectors, vec_col)
    n = own.count()
    if table_bits is None:
        table_bits = int(np.clip(np.ceil(np.log2(max(n, 1) / 4096)), 8, 12))
    sample = sample_of(own, n, sample_rows)
    quantisers, reach, most = {}, {}, {}
    lengths = np.array([len(x) for x in sample], np.int64)
    for size in np.unique(lengths).tolist():
        if np.count_nonzero(lengths == size) < LEAST_FIT:
            continue
        unit = _unit(np.stack([x for x in sample if len(x) == size]))
        quantisers[size] = Quantiser.fit(unit)
        turned = quantisers[size].turned(unit, table_bits)
        reach[size] = quantisers[size].reach(least, turned.shape[1])
        rows = whole_up_to(turned, reach[size], block_rows) if whole_rows is None else whole_rows
        if rows is not None:
            most[size] = rows
    coded, coded_path = store.save(spark, bucketed(own, quantisers, table_bits, least, most, type_), "codes")
    found, _ = store.save(spark, links(coded, least, block_rows, table_bits, reach, type_), "links")
    store.drop(spark, coded_path)
    counted = found.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    groups = components(found.where("b is not null"), "a", "b").withColumnRenamed("id", "vec_id")
    out = every.join(counted, "vec_id", "left").join(groups, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
