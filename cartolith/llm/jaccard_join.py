"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents link when their sets of word shingles have a Jaccard similarity of ``percent`` per cent or more. Nothing
is approximate: every link between different texts is found or implied by others, and no list is cut.

1. A table of fixed size counts, over all documents, how often shingles of each hash bin occur. It only sets the order
   in which shingles are tried (rare ones first), so its size and its collisions never change a result.
2. Of n shingles, two linked documents share S of each one's n - ceil(percent * n / 100) + S first in that order, where S
   is a fifth of n. Documents with equal sets become one class; classes with fewer shared first shingles are done with. The
   others drop all but one of the S they must share, the most frequent by exact counts first, and what is left makes
   clusters; a shingle's least document stands for it, so a shingle in k documents gives k edges, not k * k pairs.
3. In a cluster, each document is searched among those before it by size: the inverted lists of its shingles are split
   into L long ones and the rest; the short ones are merged as sorted runs and only documents found T - L times or more are probed in
   the long ones by binary search (T: the required overlap). Documents that are already connected aren't tried again.
4. Clusters of more than ``block_docs`` documents or ``block_shingles`` shingles are cut into blocks. Each is searched by
   itself; a document of each block's largest group is searched against those of the other blocks; what is still not with
   the cluster's largest group is searched against every other block that holds a document with one of the shingles of step 2. Pairs
   left out are in one group already, or can't link.

Shingles are compared by 64-bit hashes of their words, documents' whole sets by 128 bits; neither is a polynomial that repetition could
make collide.

Defined cases: null or empty text, or text without words, has an empty set and links with nothing; fewer words than a
shingle has are one shingle. Ids are integers; rows with the same id are one document, rows with a null id link with nothing and have a null component. Ties: a
similarity of exactly ``percent`` links. Texts of any length are taken whole. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm import keyfilter, store
from cartolith.llm.arrowtext import binary_column, column, flat, ragged, slices
from cartolith.llm.components import components
from cartolith.llm.flatwords import Words, mix, shingle_sets
from cartolith.llm.workers import tidy

PIECES = 64
SHARED = 5
SALT = np.uint64(0xA0761D6478BD642F)


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The overlap that any partner of a set of n needs."""
    return -(-percent * n // 100)


def first_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """S of a set of n: a fifth of it, the required overlap at most."""
    return np.minimum(-(-n // SHARED), least_overlap(n, percent))


def shared_by_partners(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its first shingles a set of n has in common with any partner's: the smallest partner's S."""
    return first_shared(least_overlap(n, percent), percent)


def frequencies(docs: DataFrame, k: int, most_log: int = 24) -> np.ndarray:
    """Documents with shingles of each bin, up to 65535; the table's size follows the corpus up to 2**most_log bins."""
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    log = int(np.clip(int(size / 48).bit_length(), 12, most_log))
    piece = (1 << log) // PIECES

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << log, np.uint16)
        for b in slices(batches, "t"):
            (hashes,), _ = shingle_sets(Words(*flat(column(b, "t")), lower=True), k)
            bins, n = np.unique((hashes >> np.uint64(64 - log)).astype(np.int64), return_counts=True)
            table[bins] = np.minimum(table[bins].astype(np.int64) + n, 65535)
        for i in range(PIECES):
            own = table[i * piece : (i + 1) * piece]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pa.compress(own.tobytes(), "zstd", asbytes=True)], pa.binary())], ["i", "n"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(piece, np.uint32)
        for b in batches:
            for x in column(b, "n").to_pylist():
                total += np.frombuffer(pa.decompress(x, 2 * piece, "zstd", asbytes=True), np.uint16)
        body = np.minimum(total, 65535).astype(np.uint16).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([body], pa.binary())], ["i", "n"])

    table = np.zeros(1 << log, np.uint16)
    for r in docs.select("t").mapInArrow(run, "i int, n binary").groupBy("i").applyInArrow(merge, "i int, n binary").collect():
        table[r.i * piece : (r.i + 1) * piece] = np.frombuffer(r.n, np.uint16)
    return table


def prefixes(docs: DataFrame, table: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc, n, s1, s2 (a 128-bit signature of the set), keys: its first shingles, need: how many of them a partner has among its own."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    log = len(table).bit_length() - 1

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            (hashes, others), offsets = shingle_sets(Words(*flat(column(b, "t")), lower=True, seeds=2), k)
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[offsets] for x in (mix(hashes ^ SALT), mix(others ^ SALT))]
            s1, s2 = ((s[1:] - s[:-1]).view(np.int64) for s in sums)
            order = np.lexsort([mix(hashes + SALT), sent.value[(hashes >> np.uint64(64 - log)).astype(np.int64)], owner])
            size = np.where(n > 0, n - least_overlap(n, percent) + first_shared(n, percent), 0)
            keys = hashes[order[ragged(offsets[:-1], size)]].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([column(b, "k"), pa.array(n), pa.array(s1), pa.array(s2), lists, pa.array(shared_by_partners(n, percent))], ["doc", "n", "s1", "s2", "keys", "need"])

    return docs.mapInArrow(run, "doc long, n long, s1 long, s2 long, keys array<long>, need long")


def sets_of(docs: DataFrame, wanted: keyfilter.KeyFilter, k: int) -> DataFrame:
    """doc, n, s1, hashes (binary, sorted) of documents that pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(pa.array(sent.value.maybe(column(b, "k").to_numpy().view(np.uint64))))
            for s in slices(iter([some]), "t"):
                (hashes,), offsets = shingle_sets(Words(*flat(column(s, "t")), lower=True), k)
                yield pa.RecordBatch.from_arrays([column(s, "k"), pa.array(np.diff(offsets)), binary_column(hashes.astype("<u8").view(np.uint8), offsets * 8)], ["doc", "n", "hashes"])

    return docs.mapInArrow(run, "doc long, n long, hashes binary")


class Groups:
    """Union-find over places in an array."""

    def __init__(self, start: np.ndarray | None, n: int) -> None:
        self.up = list(range(n))
        if start is not None:
            first: dict[int, int] = {}
            for i, c in enumerate(start.tolist()):
                self.up[i] = first.setdefault(c, i)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def merged(lists: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents in ``least`` of the sorted lists or more, in how many). The lists follow each other as sorted runs, which a stable
    sort merges as a heap would, run by run; memory is that of the lists."""
    each = np.sort(lists[ragged(starts, lengths)], kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]])) if len(each) else np.empty(0, np.int64)
    times = np.diff(np.append(heads, len(each)))
    enough = times >= least
    return each[heads[enough]], times[enough]


def search(hashes: np.ndarray, offsets: np.ndarray, percent: int, group: np.ndarray | None = None, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what isn't connected yet: a spanning forest over the links of all sets given.

    ``group``: groups known before; ``asked``: with it, only pairs of an asked and another document are tried.
    """
    n = np.diff(offsets)
    count = len(n)
    by_size = np.argsort(n, kind="stable")
    rank = np.empty(count, np.int64)
    rank[by_size] = np.arange(count)
    sizes = n[by_size]
    token, df = np.unique(hashes, return_inverse=True, return_counts=True)[1:]
    owner = rank[np.repeat(np.arange(count), n)]
    several = df[token] > 1
    token, owner = token[several], owner[several]
    order = np.lexsort([owner, token])
    token, lists = token[order], owner[order]  # lists: documents of each token by size
    begin = np.searchsorted(token, token, "left")
    place = np.arange(len(token))
    by_doc = np.argsort(lists, kind="stable")
    doc_at = np.searchsorted(lists[by_doc], np.arange(count + 1))
    groups = Groups(None if group is None else group[by_size], count)
    role = None if asked is None else asked[by_size]
    out: list[tuple[int, int]] = []
    for d in range(count):
        need = int(least_overlap(int(sizes[d]), percent))
        mine = by_doc[doc_at[d] : doc_at[d + 1]]
        if len(mine) < need or not need:
            continue
        low = int(np.searchsorted(sizes, need, "left"))
        s, e = begin[mine], place[mine]
        if low:
            s = s + np.array([np.searchsorted(lists[a:b], low) for a, b in zip(s, e)], np.int64)
        length = e - s
        full = np.flatnonzero(length)
        if len(full) < need:
            continue
        s, e, length = s[full], e[full], length[full]
        up = np.argsort(length, kind="stable")
        s, e, length = s[up], e[up], length[up]
        n_long = min(need - 1, int(need / (0.0085 * np.log2(max(int(length[-1]), 2)) + 1)))
        cut = len(s) - n_long
        close, overlap = merged(lists, s[:cut], length[:cut], max(need - n_long, 1))
        if role is not None:
            other = role[close] != role[d]
            close, overlap = close[other], overlap[other]
        top = np.argsort(-overlap, kind="stable")
        close, overlap = close[top], overlap[top]
        while close.size:
            home = groups.find(d)
            roots = np.fromiter((groups.find(int(c)) for c in close), np.int64, close.size)
            apart = roots != home
            close, overlap, roots = close[apart], overlap[apart], roots[apart]
            if not close.size:
                break
            head = np.zeros(close.size, bool)
            head[np.unique(roots, return_index=True)[1]] = True  # the likeliest of each group first
            if head.sum() < 8:
                head[:8] = True
            tried, total = close[head], overlap[head].copy()
            enough = -(-percent * (sizes[d] + sizes[tried]) // (100 + percent))
            for i in range(n_long):
                a, b = s[cut + i], e[cut + i]
                at = a + np.searchsorted(lists[a:b], tried)
                total += (at < b) & (lists[np.minimum(at, b - 1)] == tried)
                live = total + (n_long - 1 - i) >= enough
                if not live.all():
                    tried, total, enough = tried[live], total[live], enough[live]
                    if not tried.size:
                        break
            for c in tried[total >= enough].tolist():
                if groups.join(d, c):
                    out.append((int(by_size[d]), int(by_size[c])))
            close, overlap = close[~head], overlap[~head]
    return out


def _searched(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b from rows of (g, doc, hashes, comp, asked): groups of equal g are whole; several are searched at once while they fit.

    Documents of different clusters never link, so groups searched together don't disturb each other."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        docs, comp, asked = (t[x].to_numpy() for x in ("doc", "comp", "asked"))
        body, offsets = flat(t["hashes"].combine_chunks())
        hashes = np.frombuffer(body.tobytes(), "<u8")
        g = t["g"].to_numpy()
        a: list[int] = []
        b: list[int] = []
        cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if asked.max() > 0 else [0, len(g)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            base = offsets[s]
            edges = search(hashes[base // 8 : offsets[e] // 8], (offsets[s : e + 1] - base) // 8, percent, comp[s:e], None if asked[s:e].max() < 1 else asked[s:e])
            a += docs[[s + x for x, _ in edges]].tolist() if edges else []
            b += docs[[s + y for _, y in edges]].tolist() if edges else []
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for whole in batches:
            for b in slices(iter([whole]), "hashes"):
                g = column(b, "g").to_numpy()
                if size + b.nbytes > most * 8:
                    cut = np.flatnonzero(np.concatenate([[last is not None and last != g[0]], g[1:] != g[:-1]]))
                    if cut.size:
                        at = int(cut[-1])
                        held += [b.slice(0, at)] if at else []
                        if held:
                            yield done(held)
                        held, size, b = [], 0, b.slice(at)
                held.append(b)
                size += b.nbytes
                last = g[-1]
        if held:
            yield done(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def clusters_of(heads: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(id, component: documents with enough shared keys, joined by the rarest of them, a key's least document standing for it; h, doc: these keys, of which
    documents that link share one; the latter's path)."""
    spark = heads.sparkSession
    each = heads.select(F.explode("keys").alias("h"))
    shared, shared_path = store.save(spark, each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    passing = spark.sparkContext.broadcast(keyfilter.build(shared, "h"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = column(b, "keys")
            h, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(b.num_rows), sizes)
            keep = passing.value.maybe(h.view(np.uint64))
            enough = np.bincount(owner, keep, b.num_rows) >= column(b, "need").to_numpy()
            keep = np.flatnonzero(keep & enough[owner])
            at = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), column(b, "doc").take(at), column(b, "need").take(at)], ["h", "doc", "need"])

    found = heads.select("keys", "doc", "need").mapInArrow(run, "h long, doc long, need long").join(shared, "h")
    own = Window.partitionBy("doc")
    ranked = found.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "h")))
    kept, kept_path = store.save(spark, ranked.where("rank <= n - need + 1").select("h", "doc"), "kept")
    lowest = kept.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h", "low")
    edges, path = store.save(spark, kept.join(lowest, "h").where("doc <> low").select("low", "doc").distinct(), "edges")
    store.release(passing)
    found = components(edges, "low", "doc")
    store.drop(spark, shared_path, path)
    return found, kept, kept_path


def _grouped(big: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, block, doc, comp: the group that the edges put each document in."""
    comp = components(edges)
    ids = big.select("cluster", "block", "doc").join(comp.withColumnRenamed("id", "doc"), "doc", "left")
    return ids.withColumn("comp", F.coalesce("component", "doc")).drop("component")


def _largest(ids: DataFrame) -> DataFrame:
    """doc: of the largest group of each cluster's block one document."""
    own = ids.groupBy("cluster", "block", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"))
    return own.groupBy("cluster", "block").agg(F.max_by("doc", F.struct("n", "comp")).alias("doc"))


def _large_clusters(big: DataFrame, first: DataFrame, keys: DataFrame, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Links between the blocks of large clusters. big: cluster, block, doc, hashes; first: links within blocks; keys: h, doc."""
    spark = big.sparkSession
    ids, _ = store.save(spark, _grouped(big, first), "blocks")
    links = first
    leaders = _largest(ids)
    while True:  # leaders of a cluster of too many blocks are dealt over blocks themselves
        count = leaders.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        dealt = leaders.join(count, "cluster").select("cluster", F.pmod(F.xxhash64("doc", F.lit(7)), F.ceil(F.col("n") / block_docs)).alias("block"), "doc", "n")
        dealt, _ = store.save(spark, dealt, "leaders")
        across = big.select("doc", "hashes").join(dealt, "doc").select(F.xxhash64("cluster", "block").alias("g"), "doc", "hashes", F.col("doc").alias("comp"), F.lit(0).alias("asked"))
        found, _ = store.save(spark, _searched(across, percent, block_shingles), "links")
        links = links.unionAll(found)
        if (dealt.agg(F.max("n")).first()[0] or 0) <= block_docs:
            break
        leaders = _largest(_grouped(dealt, found))
    ids, _ = store.save(spark, _grouped(big, links), "blocks")
    sizes = ids.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    left = ids.join(main, "cluster").where("comp <> main").select("cluster", F.col("block").alias("own"), "doc", "comp")
    # A document left over is asked about in the other blocks that hold a document with one of its keys; the same pair may be tried twice.
    held = keys.join(ids.select("cluster", "block", "doc"), "doc").select("cluster", "block", "h").distinct()
    asked = left.join(keys, "doc").join(held, ["cluster", "h"]).where("block <> own").select("cluster", "block", "doc", "comp").distinct()
    asked, _ = store.save(spark, asked, "asked")
    counts = asked.groupBy("cluster", "block").agg(F.ceil(F.count(F.lit(1)) / 256).alias("parts"))
    asked = asked.join(counts, ["cluster", "block"]).withColumn("part", F.pmod(F.xxhash64("doc", F.lit(5)), F.col("parts")))
    questions = asked.join(big.select("doc", "hashes"), "doc").withColumn("asked", F.lit(1))
    answers = big.join(ids.select("doc", "comp"), "doc").join(counts, ["cluster", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("asked", F.lit(0))
    columns = ["cluster", "block", "part", "doc", "hashes", "comp", "asked"]
    rows = questions.select(*columns).unionAll(answers.select(*columns))
    found, _ = store.save(spark, _searched(rows.select(F.xxhash64("cluster", "block", "part").alias("g"), "doc", "hashes", "comp", "asked"), percent, block_shingles), "links")
    return links.unionAll(found)


def join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 8192, block_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links): a row for each row of ``docs``."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    heads, _ = store.save(spark, prefixes(own, frequencies(own, k), k, percent), "prefixes")
    filled = heads.where("n > 0 and doc is not null")
    classes, _ = store.save(spark, filled.groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep")), "classes")
    used: list[str] = []
    with store.scope(used):  # what only the links are made from
        reps = filled.join(classes.select("s1", "s2", "n", F.col("rep").alias("doc")), ["s1", "s2", "n", "doc"], "left_semi").dropDuplicates(["doc", "s1", "s2"])
        clusters, keys, _ = clusters_of(reps)
        clusters, _ = store.save(spark, clusters.withColumnsRenamed({"id": "doc", "component": "cluster"}), "clusters")
        sets = sets_of(own.where("k is not null"), keyfilter.build(clusters, "doc"), k).join(clusters, "doc")
        sets, _ = store.save(spark, sets, "sets")
        sizes = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
        blocks = F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("shingles") / block_shingles)).cast("int")
        large, _ = store.save(spark, sizes.select("cluster", blocks.alias("blocks")).where("blocks > 1"), "large")
        dealt = sets.join(large, "cluster", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("doc", F.lit(3)), F.col("blocks")), F.lit(0)))
        rows = dealt.select(F.xxhash64("cluster", "block").alias("g"), "doc", "hashes", F.col("doc").alias("comp"), F.lit(0).alias("asked"))
        links, links_path = store.save(spark, _searched(rows, percent, block_shingles), "links")
        if large.head(1):
            big, _ = store.save(spark, dealt.where("blocks is not null").select("cluster", "block", "doc", "hashes"), "large-sets")
            links, links_path = store.save(spark, _large_clusters(big, links, keys, percent, block_docs, block_shingles), "links")
    store.drop(spark, *(p for p in used if p != links_path))
    found = components(links).select(F.col("id").alias("rep"), "component")
    store.drop(spark, links_path)
    member = heads.select("doc", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left").join(found, "rep", "left")
    return member.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc")).alias("component_id"))
