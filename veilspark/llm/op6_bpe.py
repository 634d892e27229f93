"""Byte-level BPE by corpus-level merge replay: encode and decode."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Texts are taken in groups of about this many characters; longer ones make a group of their own.
GROUP_CHARS = 2_000_000
#: Encoded pieces that a worker keeps between groups; beyond that it starts anew with those of the group at hand, which costs time only.
KEPT_PIECES = 300_000
#: Words are replayed by whole arrays so many at a time, and in so many ranges of ranks; those of more bytes singly.
TURN_WORDS, RANGES, LONG_BYTES = 16_000, 10, 200


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def greedy(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one word: the lowest-ranked pair first, the leftmost among equals."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((r, i) for i in range(len(parts) - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None), default=None)
        if best is None:
            return [rank[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def replay_singly(words: Iterable[bytes], rank: dict[bytes, int]) -> dict[bytes, list[int]]:
    """As :func:`replay`, one rank and place at a time: for words that have more merges than whole arrays are worth.

    ``where`` is an inverted index from a pair of neighbouring tokens, named by the token that they make, to the word
    positions where it may stand.  The heap hands out merges by rank; applying one touches only the two neighbours of each of
    its places, whose new pairs are entered into the index.  A new pair always makes a longer token; should a vocabulary rank
    that lower than the merge at hand, the word is encoded anew by the greedy rule for single words, which decides such cases.
    """
    found = list(dict.fromkeys(words))
    parts: list[bytes | None] = []
    nxt: list[int] = []
    prv: list[int] = []
    first: list[int] = []
    where: dict[int, list[int]] = defaultdict(list)
    get = rank.get
    odd: set[int] = set()
    for w in found:
        at = len(parts)
        first.append(at)
        n = len(w)
        if w in rank:  # a word that is one token needs no replay
            parts.append(w)
            nxt.append(-1)
            prv.append(-1)
            continue
        parts.extend([w[i : i + 1] for i in range(n)])
        nxt.extend(range(at + 1, at + n))
        nxt.append(-1)
        prv.append(-1)
        prv.extend(range(at, at + n - 1))
        for i in range(n - 1):
            if (r := get(w[i : i + 2])) is not None:
                where[r].append(at + i)
    heap = list(where)
    heapq.heapify(heap)
    token = {r: t for t, r in rank.items()} if heap else {}
    while heap:
        r = heapq.heappop(heap)
        made = token[r]
        size = len(made)
        places = where.pop(r)
        places.sort()  # from the left, as overlapping places are merged from the left
        for i in places:
            left = parts[i]
            if left is None or (j := nxt[i]) < 0 or len(left) + len(parts[j]) != size or left + parts[j] != made:
                continue  # merged away meanwhile
            parts[i] = made
            parts[j] = None
            k = nxt[i] = nxt[j]
            if k >= 0:
                prv[k] = i
                if (q := get(made + parts[k])) is not None:
                    if q < r:
                        odd.add(i)
                    if q not in where:
                        heapq.heappush(heap, q)
                    where[q].append(i)
            h = prv[i]
            if h >= 0 and (q := get(parts[h] + made)) is not None:
                if q < r:
                    odd.add(h)
                if q not in where:
                    heapq.heappush(heap, q)
                where[q].append(h)
    again = {bisect_right(first, i) - 1 for i in odd}
    out = {}
    for k, (w, at) in enumerate(zip(found, first, strict=True)):
        if k in again:
            out[w] = greedy(w, rank)
            continue
        ids = []
        while at >= 0:
            ids.append(rank[parts[at]])
            at = nxt[at]
        out[w] = ids
    return out


class Merges:
    """A vocabulary as arrays: what two neighbouring tokens make, by a hash table whose full slots are followed by the keys they displaced."""

    def __init__(self, rank: dict[bytes, int]):
        #: Stands for no token.
        self.none = max(rank.values(), default=-1) + 1
        self.single = np.array([rank.get(bytes([c]), self.none) for c in range(256)], np.int64)
        made = [(a * (self.none + 1) + b, r) for t, r in rank.items() for i in range(1, len(t)) if (a := rank.get(t[:i])) is not None and (b := rank.get(t[i:])) is not None]
        keys, makes = np.array(made, np.int64).reshape(-1, 2).T
        bits = max(8, 2 + len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        slots = self._slots(keys)
        order = np.argsort(slots, kind="stable")
        n = np.arange(len(keys))
        at = np.maximum.accumulate(slots[order] - n) + n
        self.keys = np.full((1 << bits) + len(keys) + 1, -1, np.int64)
        self.makes = np.full(len(self.keys), self.none, np.int64)
        self.keys[at], self.makes[at] = keys[order], makes[order]
        bounds = np.unique(np.geomspace(256, max(self.none, 512), RANGES + 1).astype(np.int64))[1:-1]
        self.ranges = len(bounds) + 1
        #: Of each rank, its range; higher ranks, whose merges are rarer, have wider ones.  No token is beyond all of them.
        self.range = np.append(np.searchsorted(bounds, np.arange(self.none), "right"), self.ranges).astype(np.uint8)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def make(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * (self.none + 1) + right
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.makes[at], self.none)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] += 1
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.makes[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


_merges: list = []


def merges(rank: dict[bytes, int]) -> Merges:
    """One for each vocabulary; the last is kept."""
    if not _merges or _merges[0] is not rank:
        _merges[:] = [rank, Merges(rank)]
    return _merges[1]


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """In order.  For these numbers sorting is several times as fast as the table of hashes in ``np.unique``."""
    x = np.sort(np.concatenate(parts))
    return x[np.append(True, x[1:] != x[:-1])]


def _replayed(words: list[bytes], m: Merges) -> tuple[list[list[int]], np.ndarray]:
    """The ids of ``words``, none of them empty, and the indices of those that need the rule for single words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    n = int(end[-1])
    word = np.repeat(np.arange(len(words)), size)
    token = m.single[np.frombuffer(b"".join(words), np.uint8)]
    nxt = np.arange(1, n + 1)
    nxt[end - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[end - size] = -1
    alive = np.ones(n, bool)
    pair = np.full(n, m.none)
    least = np.zeros(len(words), np.int64)
    odd = np.zeros(len(words), bool)
    where: list[list[np.ndarray]] = [[] for _ in range(m.ranges)]

    def enter(places: np.ndarray) -> None:
        ranges = m.range[pair[places]]
        order = np.argsort(ranges, kind="stable")
        cuts = np.searchsorted(ranges[order], np.arange(m.ranges + 1, dtype=np.uint8)).tolist()
        for k in range(m.ranges):
            if cuts[k] < cuts[k + 1]:
                where[k].append(places[order[cuts[k] : cuts[k + 1]]])

    inner = np.flatnonzero(nxt >= 0)
    pair[inner] = m.make(token[inner], token[inner + 1])
    enter(inner)
    for k in range(m.ranges):
        at = _distinct(where[k]) if where[k] else inner[:0]
        where[k] = []
        while len(at := at[m.range[pair[at]] <= k]):
            # of each word its lowest rank, at all its places
            w, r = word[at], pair[at]
            heads = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            least[w[heads]] = np.minimum.reduceat(r, heads)
            i = at[r == least[w]]
            chained = np.append(False, nxt[i[:-1]] == i[1:])
            if chained.any():  # overlapping places: from the left, every second one
                nth = np.arange(len(i))
                i = i[(nth - np.maximum.accumulate(np.where(chained, 0, nth))) % 2 == 0]
            j = nxt[i]
            after = nxt[i] = nxt[j]
            made = pair[i]
            close = np.flatnonzero(after[:-1] == i[1:])
            if len(close):  # pairs that are there only until their right tokens are merged, too
                lower = m.make(made[close], token[i[close + 1]]) < made[close]
                odd[word[i[close[lower]]]] = True
            token[i] = made
            alive[j] = False
            prv[after[after >= 0]] = i[after >= 0]
            before = prv[i]
            near = _distinct([i, before[before >= 0]])
            known = m.range[pair[near]] <= k
            pair[j] = m.none
            right = nxt[near]
            pair[near] = q = np.where(right >= 0, m.make(token[near], token[right]), m.none)
            odd[word[near[q < least[word[near]]]]] = True
            now = m.range[q] <= k
            enter(near[~now])
            if len(more := near[now & ~known]):
                at = np.sort(np.concatenate((at, more)))
    ids = token[alive].tolist()
    ends = np.cumsum(np.bincount(word[alive], minlength=len(words))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)], np.flatnonzero(odd)


def replay(words: Iterable[bytes], rank: dict[bytes, int]) -> dict[bytes, list[int]]:
    """The ids of every distinct word, by replaying the merges in rank order over all the words at once.

    ``where`` is an inverted index from a pair of neighbouring tokens, named by the range of ranks that the token they make is in,
    to the word positions where it may stand.  Ranges are taken by rank; in each, all words apply their own next merge at once, in as
    many turns as it takes, for no word depends on another.  A merge touches only the two neighbours of each of its places,
    whose new pairs are entered into the index.  A new pair always makes a longer token; should a vocabulary rank that
    lower than the merge at hand, the word is encoded anew by the greedy rule for single words, which decides such cases.
    """
    m = merges(rank)
    most = LONG_BYTES if (m.single < m.none).all() else 0
    out: dict[bytes, list[int]] = {}
    short: list[bytes] = []
    long: list[bytes] = []
    for w in dict.fromkeys(words):
        if w in rank:  # a word that is one token needs no replay
            out[w] = [rank[w]]
        elif len(w) > most:
            long.append(w)
        elif w:
            short.append(w)
        else:
            out[w] = []
    if long:
        out |= replay_singly(long, rank)
    for at in range(0, len(short), TURN_WORDS):
        some = short[at : at + TURN_WORDS]
        ids, odd = _replayed(some, m)
        out |= zip(some, ids)
        out |= ((some[k], greedy(some[k], rank)) for k in odd.tolist())
    return out


def grouped(texts: Iterable[str | None], most: int = GROUP_CHARS) -> Iterator[list[str]]:
    group: list[str] = []
    chars = 0
    for t in texts:
        group.append(t or "")
        chars += len(group[-1])
        if chars >= most:
            yield group
            group, chars = [], 0
    if group:
        yield group


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for cycles: a group's many small lists and tuples have none, and would be gone through again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Codec:
    """Encodes groups of texts; words that a worker has already replayed are kept between groups."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT_PIECES, digests: bool = False):
        self.rank = ranks(path)
        # white space as Unicode has it: the library does not count U+001C to U+001F
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.token = {r: t for t, r in self.rank.items()}
        self.digit = {r: str(r) for r in self.token}
        self.kept, self.digests = kept, digests
        self.keep([], [], [])

    def keep(self, words: list[str], ids: list, raw: list[bytes]) -> None:
        """Start anew with these pieces."""
        #: Of each piece, its place in the lists below; one not yet seen gets the next.
        self.known: defaultdict[str, int] = defaultdict(count(len(words)).__next__, zip(words, count()))
        #: The ids, or what digests need of them: their decimal form, and the bytes that they decode to.
        self.ids, self.raw = ids, raw

    def pieces(self, texts: list[str]) -> Iterator[list[int]]:
        """The pattern's matches of each text, as places in ``self.ids`` and ``self.raw``."""
        if len(self.known) != len(self.ids):  # a group before this one failed
            self.keep([], [], [])
        at = self.known.__getitem__
        out = [list(map(at, self.find(t))) for t in texts]
        new = list(islice(reversed(self.known), len(self.known) - len(self.ids)))[::-1]
        raw = [w.encode("utf-8", "replace") for w in new]
        coded = replay(raw, self.rank)
        if self.digests:
            digit = self.digit.__getitem__
            self.ids += [" ".join(map(digit, coded[w])) for w in raw]
            self.raw += [self.decode(coded[w]) for w in raw]
        else:
            self.ids += [coded[w] for w in raw]
        yield from out
        if len(self.known) > self.kept:
            # those of the texts at hand stay, which most of the frequent ones are among
            words, used = list(self.known), sorted(set().union(*out))
            self.keep([words[k] for k in used], [self.ids[k] for k in used], [self.raw[k] for k in used if self.digests])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for k in p for i in self.ids[k]] for p in self.pieces(texts)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=1)
def worker_codec(path: str, pattern: str, digests: bool = False) -> Codec:
    """One for each Python worker, which serves many tasks."""
    return Codec(path, pattern, digests=digests)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, pattern, True)
        for b in batches:
            n, a, d = [], [], []
            for group in grouped(b.column(1).to_pylist()):
                # ids, digits and bytes of a text are those of its pieces one after the other
                with uncollected():
                    for p in codec.pieces(group):
                        digits = " ".join(map(codec.ids.__getitem__, p))
                        n.append(digits.count(" ") + 1 if p else 0)
                        a.append(hashlib.sha256(digits.encode()).hexdigest())
                        d.append(hashlib.sha256(b"".join(map(codec.raw.__getitem__, p))).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, pattern)
        for b in batches:
            out = [ids for g in grouped(b.column(1).to_pylist()) for ids in codec.encode(g)]
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {r: t for t, r in ranks(path).items()}
        for b in batches:
            out = [None if ids is None else b"".join(map(token.__getitem__, ids)) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the ids of every whole text; a null or empty text has none.  No shuffle: words do not depend on each other, so each task replays the merges over the distinct words of its own texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    return lean(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_ids(path, pattern), f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, bytes)``; null ids give null, an id outside the vocabulary is an error."""
    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_texts(path), f"doc_id {kind}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode and decode in one pass.

    Null and empty texts: 0 tokens, digests of nothing.  Null ids stay null; repeated rows give repeated rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return lean(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _digests(path, pattern), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
