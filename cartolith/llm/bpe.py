"""Byte-level BPE by speculation and verification.

Greedy longest-match proposes the tokens of each distinct word. The proposal is the BPE encoding exactly when each
token encodes to itself and no merge would have crossed any of its boundaries, which is tested for all adjacent pairs
of a batch at once. Only words that fail are merged step by step. Decoding gathers token bytes through a table.

Defined cases: a null text is encoded as the empty text (no ids). Repeated rows are encoded each on its own. Texts of
any length are encoded whole, single words of megabytes included, in time that grows little faster than they do. Ties: of
equal pairs the leftmost merges first. An empty table gives an empty table. Only the named columns are read, so others, whatever their
names, do no harm; a null id stays null.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.arrowtext import binary_column, column, flat, ragged, slices, string_column
from cartolith.llm.workers import held
from cartolith.llm.wordpool import WordPool, distinct, per_document

# Fixed value: the split before merging that byte-level vocabularies of this family are built with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for ASCII text.
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
NEVER = np.int64(1) << 40
#: Words of more bytes are merged by lists of pairs for each rank, of which SPAN ranks are at hand at a time.
LONG, SPAN = 128, 512
#: Positions of a long word that are looked up at once.
BLOCK = 1 << 16
#: Bytes of text that are encoded at once; what a worker needs meanwhile follows it.
SLICE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_table(spec: dict) -> tuple[list[bytes], dict[str, int]]:
    """(bytes of each ordinary id, special tokens)."""
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (max([*spec["model"]["vocab"].values(), *special.values()]) + 1)
    for token, i in spec["model"]["vocab"].items():
        if token not in special:
            out[i] = bytes(letters[c] for c in token)
    return out, special


class Lookup:
    """A hash table of distinct non-negative integers, asked for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while left.size:
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * ODD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that aren't there."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while left.size:
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            out[left] = np.where(found == keys[left], self.values[slot[left]], -1)
            left = left[(found != keys[left]) & (found >= 0)]
        return out


class Trie:
    """Tokens by their bytes, walked down from many positions at once."""

    def __init__(self, tokens: list[bytes]) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        above, token = [], [-1]
        for i, b in enumerate(tokens):
            for n in range(1, len(b) + 1):
                if b[:n] not in nodes:
                    nodes[b[:n]] = len(token)
                    above.append(nodes[b[: n - 1]] * 256 + b[n - 1])
                    token.append(-1)
            if b:
                token[nodes[b]] = i
        self.token = np.array(token, np.int64)
        self.below = Lookup(np.array(above, np.int64), np.arange(1, len(token), dtype=np.int64))

    def longest(self, body: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the longest token from each position that stops before its end, its length); every single byte is a token."""
        out, size = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        live, node, n = np.arange(len(at)), np.zeros(len(at), np.int64), 0
        place = at
        while live.size:
            node = self.below.get(node * 256 + body[place]).astype(np.int64)
            n += 1
            on = node >= 0
            live, node, place = live[on], node[on], place[on]
            token = self.token[node]
            ended = token >= 0
            out[live[ended]], size[live[ended]] = token[ended], n
            place = place + 1
            on = place < ends[live]
            live, node, place = live[on], node[on], place[on]
        return out, size


class Decoder:
    """Ids to bytes by table, all documents of a batch at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            tokens, special = token_table(json.load(f))
        for token, i in special.items():
            tokens[i] = token.encode()
        self.lengths = np.array([len(b) for b in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        named = np.array([f"{i}," for i in range(len(tokens))], bytes)
        self.digits = np.char.str_len(named)
        self.decimals = named.view(np.uint8).reshape(len(named), -1)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets)."""
        lengths = self.lengths[ids]
        return self.table[ragged(self.starts[ids], lengths)], np.concatenate([[0], np.cumsum(lengths)])[offsets]

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        raw = binary_column(*self.decode(ids, offsets))
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    def text_digests(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """SHA-256 of each text in UTF-8."""
        body, ends = flat(self.texts(ids, offsets))
        return digests(body, ends)

    def decimal_digests(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """SHA-256 of the decimal ids of each text, joined by commas."""
        lengths = self.digits[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        return digests(self.decimals.ravel()[ragged(ids.astype(np.int64) * self.decimals.shape[1], lengths)], ends, 1)


def digests(body: np.ndarray, offsets: np.ndarray, less: int = 0) -> list[str]:
    """SHA-256 of each span, without its last ``less`` bytes."""
    view, at = memoryview(np.ascontiguousarray(body)), offsets.tolist()
    return [hashlib.sha256(view[s : max(s, e - less)]).hexdigest() for s, e in zip(at, at[1:])]


class ByteBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        cut = spec.get("pre_tokenizer") or {}
        self.fits = not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        tokens, self.special = token_table(spec)
        size = len(tokens)
        single = {b: i for i, b in enumerate(tokens) if len(b) == 1}
        self.single_table = np.array([single.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single_table < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.trie = Trie(tokens)
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.made = np.zeros(len(merges), np.int64)
        first: dict[int, int] = {}
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            first.setdefault(x * size + y, r)
            self.made[r] = z
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.size = size
        keys = np.fromiter(first, np.int64, len(first))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(first.values(), np.int64, len(first))[order]
        self.ranks = Lookup(self.pair_keys, self.pair_ranks)
        self.key_of_rank = np.full(len(merges), -1, np.int64)
        self.key_of_rank[self.pair_ranks] = self.pair_keys
        self.whole = self._reachable()
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_bytes = re.compile(self.special_at.pattern.encode()) if self.special else None
        self.pieces, self.ascii_pieces = regex.compile(SPLIT), re.compile(ASCII_SPLIT)

    def _crossing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank at which the tokens x, y merge."""
        rank = self.ranks.get(x * self.size + y)
        return np.where(rank >= 0, rank, NEVER)

    def stays_apart(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the boundary between x and y, for all pairs at once.

        Merges happen in the order of ranks. Going back in time from (x, y), the younger of the two tokens at the
        boundary is undone; until then a merge of the two would have come first. Of equal merges the left one comes
        first, hence ranks count double and undoing on the right adds one.
        """
        x, y = x.astype(np.int64), y.astype(np.int64)
        fine = np.ones(len(x), bool)
        limit = np.full(len(x), 2 * NEVER) if limit is None else limit.copy()
        live = np.arange(len(x))
        first = limit[0] >= 2 * NEVER if len(x) else True
        while live.size:
            a, b = x[live], y[live]
            if first:
                crossed = 2 * self._crossing(a, b) < limit[live]
                fine[live[crossed]] = False
                live = live[~crossed]
                a, b = x[live], y[live]
            first = True
            ra, rb = self.rank[a], self.rank[b]
            undo_left = ra > rb
            limit[live] = np.where(undo_left, 2 * ra, 2 * rb + 1)
            x[live] = np.where(undo_left, self.right[a], a)
            y[live] = np.where(undo_left, b, self.left[b])
            live = live[np.maximum(ra, rb) >= 0]
        return fine

    def _reachable(self) -> np.ndarray:
        """Whether the bytes of a token encode to that token alone."""
        made = np.flatnonzero(self.rank >= 0)
        apart = np.ones(self.size, bool)
        apart[made] = self.stays_apart(self.left[made], self.right[made], 2 * self.rank[made])
        whole = np.zeros(self.size, bool)
        whole[self.single_table] = True
        for t in made[np.argsort(self.rank[made])]:
            whole[t] = apart[t] and whole[self.left[t]] and whole[self.right[t]]
        return whole

    def propose(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: (ids, the word of each), in order. Words advance together; long ones are looked up at all positions, then walked."""
        at, ends = offsets[:-1], offsets[1:]
        ids, owner, places = [], [], []
        for i in np.flatnonzero(ends - at > LONG).tolist():
            own, place = [], int(at[i])
            while place < ends[i]:
                start = place
                some = np.arange(start, min(start + BLOCK, int(ends[i])))
                token, size = (x.tolist() for x in self.trie.longest(body, some, np.full(len(some), ends[i])))
                while place < start + len(token):
                    own.append(token[place - start])
                    place += size[place - start]
            ids.append(np.array(own, np.int64))
            owner.append(np.full(len(own), i))
            places.append(np.arange(len(own)))
        live = np.flatnonzero((ends > at) & (ends - at <= LONG))
        at, ends, n = at[live], ends[live], 0
        while live.size:
            token, size = self.trie.longest(body, at, ends)
            ids.append(token)
            owner.append(live)
            places.append(np.full(len(live), n))
            at, n = at + size, n + 1
            on = at < ends
            live, at, ends = live[on], at[on], ends[on]
        if not ids:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        owner = np.concatenate(owner)
        counts = np.bincount(owner, minlength=len(offsets) - 1)
        to = (np.cumsum(counts) - counts)[owner] + np.concatenate(places)
        out = np.empty(len(owner), np.int64)
        out[to] = np.concatenate(ids)
        return out, np.repeat(np.arange(len(counts)), counts)

    def merge_long(self, word: bytes) -> list[int]:
        """All pairs of the least rank at once, from left to right; only what stands beside them is ranked anew.

        Were a new pair to rank before the one that made it, the order would matter: such words merge one pair at a time.
        """
        ids = self.single_table[np.frombuffer(word, np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        at = np.arange(n - 1)
        rank = self._crossing(ids[:-1], ids[1:])
        while True:
            wanted = rank < NEVER
            at, rank = at[wanted], rank[wanted]
            if not at.size:
                return ids[ids >= 0].tolist()
            end = int(rank.min()) + SPAN
            near = rank < end
            later = [(at[~near], rank[~near])]
            order = np.argsort(rank[near], kind="stable")
            ranks, heads = np.unique(rank[near][order], return_index=True)
            lists = dict(zip(ranks.tolist(), ([x] for x in np.split(at[near][order], heads[1:]))))
            heap = ranks.tolist()
            while heap:
                r = heapq.heappop(heap)
                x, y = divmod(int(self.key_of_rank[r]), self.size)
                at = np.unique(np.concatenate(lists.pop(r)))
                at = at[(ids[at] == x) & (after[at] < n)]
                at = at[ids[after[at]] == y]
                if x == y and at.size > 1:  # of a run of overlapping pairs, every second one
                    head = np.concatenate([[True], after[at[:-1]] != at[1:]])
                    run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                    at = at[run % 2 == 0]
                if not at.size:
                    continue
                gone = after[at]
                ids[at], ids[gone] = self.made[r], -1
                after[at] = after[gone]
                before[after[at]] = at
                beside = np.concatenate([before[at], at])
                beside = beside[beside >= 0]
                beside = beside[after[beside] < n]
                new = self._crossing(ids[beside], ids[after[beside]])
                if (new < r).any():
                    return self._merge_one_by_one(word)
                near = new < end
                later.append((beside[~near], new[~near]))
                for place, k in zip(beside[near].tolist(), new[near].tolist()):
                    if k not in lists:
                        lists[k] = []
                        heapq.heappush(heap, k)
                    lists[k].append(np.array([place]))
            at, rank = (np.concatenate(z) for z in zip(*later))

    def _merge_one_by_one(self, word: bytes) -> list[int]:
        """The pair of least rank, the leftmost of equals, by a heap."""
        ids = self.single_table[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        ranks = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(ids[i] * self.size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks.get(ids[i] * self.size + ids[j]) != r:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            before[after[i]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] < n and (r := ranks.get(ids[p] * self.size + ids[after[p]])) is not None:
                    heapq.heappush(heap, (r, p))
        return [x for x in ids if x >= 0]

    def merge_exactly(self, words: list[bytes]) -> list[list[int]]:
        """The BPE encoding of words that failed: long ones by themselves, the others together."""
        out: list[list[int] | None] = [self.merge_long(w) if len(w) > LONG else None for w in words]
        short = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(short, self._merge_together([words[i] for i in short])):
            out[i] = x
        return out

    def _merge_together(self, words: list[bytes]) -> list[list[int]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids, owner = self._merged(np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), lengths))
        return [x.tolist() for x in np.split(ids, np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])] if words else []

    def _merged(self, body: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, the word of each) from bytes and the word of each, step by step: in each round the pair of least rank, the leftmost of equals,
        merges in every word that has one."""
        ids = self.single_table[body]
        ranks = np.full(len(ids), NEVER)  # of each id and the next one of its word
        same = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[same] = self._crossing(ids[same], ids[same + 1])
        done_ids, done_owner = [], []
        while len(ids):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(ranks, heads)
            best = np.repeat(best, np.diff(np.concatenate([heads, [len(ids)]])))
            over = best == NEVER
            done_ids.append(ids[over])
            done_owner.append(owner[over])
            at = np.flatnonzero((ranks == best) & ~over)
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])] if at.size else at
            ids[at] = self.made[ranks[at]]
            ranks[at] = NEVER
            for left, right in ((at - 1, at), (at, at + 2)):
                inside = (left >= 0) & (right < len(ids))
                left, right = left[inside], right[inside]
                inside = owner[left] == owner[right]
                left, right = left[inside], right[inside]
                ranks[left] = self._crossing(ids[left], ids[right])
            over[at + 1] = True
            ids, owner, ranks = ids[~over], owner[~over], ranks[~over]
        owner = np.concatenate([*done_owner, np.empty(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([*done_ids, np.empty(0, np.int64)])[order], owner[order]

    def encode_flat(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each). Speculate on all, verify all boundaries at once, merge the failures."""
        n = len(offsets) - 1
        ids, owner = self.propose(body, offsets)
        bad = np.zeros(n, bool)
        bad[owner[~self.whole[ids]]] = True
        same = np.flatnonzero(owner[1:] == owner[:-1])
        pair, back = np.unique(ids[same] * self.size + ids[same + 1], return_inverse=True)
        apart = self.stays_apart(pair // self.size, pair % self.size)
        bad[owner[same[~apart[back]]]] = True
        again = np.flatnonzero(bad)
        if again.size:
            sizes = offsets[again + 1] - offsets[again]
            fine = ~bad[owner]
            ids, owner = [ids[fine]], [owner[fine]]
            for i in again[sizes > LONG].tolist():
                ids.append(np.array(self.merge_long(body[offsets[i] : offsets[i + 1]].tobytes()), np.int64))
                owner.append(np.full(len(ids[-1]), i))
            again, sizes = again[sizes <= LONG], sizes[sizes <= LONG]
            for x, to in zip(self._merged(body[ragged(offsets[again], sizes)], np.repeat(again, sizes)), (ids, owner)):
                to.append(x)
            ids, owner = np.concatenate(ids), np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        return ids, np.bincount(owner, minlength=n)

    def encode_pieces(self, words: list[bytes]) -> list[list[int]]:
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        ids, lengths = self.encode_flat(np.frombuffer(b"".join(words), np.uint8), offsets)
        return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] if words else []

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, number of ids of each).

        Chunks whose only space is a blank at the front are cut together as lines of one text, where the line ends are pieces of their own.
        """
        kinds = np.fromiter(map(self._kind, chunks), np.int8, len(chunks))
        pieces: list[str] = []
        counts, order, ends = [], [], []  # pieces of each chunk, which chunk that is, pieces that are line ends
        for kind, cut in ((0, self.ascii_pieces), (1, self.pieces)):
            own = np.flatnonzero(kinds == kind)
            if not own.size:
                continue
            found = cut.findall("\n".join([chunks[i] for i in own.tolist()]))
            lines = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
            ends.append(lines + len(pieces))
            counts.append(np.diff(np.concatenate([[-1], lines, [len(found)]])) - 1)
            order.append(own)
            pieces += found
        own = np.flatnonzero(kinds == 2)
        cuts = [self.pieces.findall(chunks[i]) for i in own.tolist()]
        counts.append(np.fromiter(map(len, cuts), np.int64, len(cuts)))
        order.append(own)
        pieces += chain.from_iterable(cuts)
        words, which = distinct(pa.array(pieces, pa.large_string()))
        which = np.delete(which, np.concatenate([*ends, np.empty(0, np.int64)]))
        body, offsets = flat(words)
        ids, sizes = self.encode_flat(body, offsets)
        return regrouped(ids, sizes, which, np.concatenate(counts), np.concatenate(order))

    @staticmethod
    def _kind(chunk: str) -> int:
        """0: ASCII and 1: other chunks that are words with a blank in front at most; 2: the rest."""
        if chunk[0] == " ":
            return 2 if len(chunk) == 1 or chunk[1].isspace() else 0 if chunk.isascii() else 1
        return 2 if chunk[0].isspace() else 0 if chunk.isascii() else 1


def regrouped(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray, counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all chunks, number of ids of each) from the ids and sizes of distinct pieces, the pieces of the chunks one after the
    other, how many each chunk has, and which chunk that is."""
    starts = np.cumsum(sizes) - sizes
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    first = np.cumsum(counts) - counts
    which = which[ragged(first[back], counts[back])]
    lengths = sizes[which]
    return ids[ragged(starts[which], lengths)], np.diff(per_document(lengths, counts[back]))


#: Lead bytes of white space beyond ASCII, and the bytes that may follow.
WIDE_SPACE = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE2: [b"\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [b"\x81\x9f"], 0xE3: [b"\x80\x80"]}


def space_bytes(body: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text belongs to white space."""
    out = (body == 0x20) | ((body >= 0x09) & (body <= 0x0D))
    for lead, rest in WIDE_SPACE.items():
        at = np.flatnonzero(body == lead)
        if not at.size:
            continue
        n = len(rest[0])
        at = at[at + n < len(body)]
        code = body[at + 1].astype(np.int64)
        if n == 2:
            code = code * 256 + body[at + 2]
        at = at[np.isin(code, [int.from_bytes(r) for r in rest])]
        out[(at[:, None] + np.arange(n + 1)).ravel()] = True
    return out


def chunk_starts(body: np.ndarray, offsets: np.ndarray, special: re.Pattern | None) -> np.ndarray:
    """Where the pieces of texts start that encode on their own: a run of white space and what follows it up to the next one.

    No piece goes from other letters into white space, and what a piece at the start of such a run is depends on nothing before it. Special tokens
    are pieces of their own.
    """
    space = space_bytes(body)
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[offsets[(offsets < len(body))]] = True
    if special is not None:
        raw = body.tobytes()
        if special.search(raw):
            for s, e in zip(offsets.tolist(), offsets[1:].tolist()):
                for found in special.finditer(raw, s, e):
                    cut[found.start() : found.end()] = False
                    cut[found.start()] = True
                    if found.end() < len(body):
                        cut[found.end()] = True
    return np.flatnonzero(cut)


class DocumentEncoder:
    """Encodes texts of a batch through a pool of chunks."""

    def __init__(self, path: str) -> None:
        self.bpe = ByteBpe(path)
        if not self.bpe.fits:
            raise ValueError("a vocabulary that isn't cut as byte-level ones of this family are")
        self.pool = WordPool(self._encode)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.bpe.special
        plain = [c for c in chunks if c not in special]
        ids, lengths = self.bpe.encode_chunks(plain)
        if len(plain) < len(chunks):
            named = [i for i, c in enumerate(chunks) if c in special]
            places = np.array(named) - np.arange(len(named))
            ids = np.insert(ids, np.concatenate([[0], np.cumsum(lengths)])[places], [special[chunks[i]] for i in named])
            lengths = np.insert(lengths, places, 1)
        return ids.astype(np.uint32), lengths

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        body, offsets = flat(texts)
        if not len(body):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = chunk_starts(body, offsets, self.bpe.special_bytes)
        counts = np.diff(np.searchsorted(starts, offsets))
        words, which = distinct(string_column(body, np.append(starts, len(body))))
        ids, lengths = self.pool.encode_words(words.to_pylist())
        sizes = lengths[which]
        return ids[ragged((np.cumsum(lengths) - lengths)[which], sizes)], per_document(sizes, counts)


def document_encoder(path: str) -> DocumentEncoder:
    """One for each worker process."""
    return held("bpe", lambda p: (DocumentEncoder(p), Decoder(p)), path)[0]


def decoder(path: str) -> Decoder:
    return held("bpe", lambda p: (DocumentEncoder(p), Decoder(p)), path)[1]


def ids_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    body, offsets = flat(array)
    return (body if body.ctypes.data % 4 == 0 else body.copy()).view("<u4"), offsets // 4


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: unsigned 32-bit little-endian ids). No shuffle; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = document_encoder(tokenizer_path)
        for b in slices(batches, "t", SLICE):
            ids, offsets = own.encode_column(column(b, "t"))
            body = binary_column(ids.astype("<u4").view(np.uint8), offsets * 4)
            yield pa.RecordBatch.from_arrays([column(b, "k"), pa.array(np.diff(offsets)), body], ["k", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids binary")
    return out.withColumnRenamed("k", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of the ids, in place of a column of that name. Bytes that aren't UTF-8 become U+FFFD, as in any byte-level decoder."""
    encoded = encoded.drop(text_col)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(tokenizer_path)
        for b in slices(batches, ids_col):
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in names), own.texts(*ids_of(column(b, ids_col)))], [*names, text_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, `{text_col}` string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text decoded from those
    ids, in UTF-8): ``encode`` and ``decode`` one after the other in one worker, so neither ids nor texts leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, back = document_encoder(tokenizer_path), decoder(tokenizer_path)
        for b in slices(batches, "t", SLICE):
            ids, offsets = there.encode_column(column(b, "t"))
            shas, decoded = back.decimal_digests(ids, offsets), back.text_digests(ids, offsets)
            yield pa.RecordBatch.from_arrays([column(b, "k"), pa.array(np.diff(offsets)), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", id_col)
