"""N-gram Jaccard join: prefix tiles banded by size, bitmap bounds, exact intersection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, groups, mixed
from .common import components, cut, drop, lean, release

WORDS = 5
#: Two sets link when ``DEN * intersection >= NUM * union``.
NUM, DEN = 75, 100
GROUP_BYTES = 250_000
#: Entries that a task gathers before it sends them on.
FLUSH = 250_000
#: Shingles that are put last in the common order at most: 0.5 MB, whatever the input.
COMMON = 65_536
#: Bits of a set's two bitmaps for each shingle, and at least.
BITS, FEW_BITS, LEAST_BITS = 4, 0.5, 64
#: Sets of a block of a tile at most, and shingles that these have together.
BLOCK, BLOCK_SHINGLES = 4096, 4_000_000
#: Sets of a crowd, up to which its tiles go to one task.
CROWD_ROWS = 4_000
#: Sets that a centre meets in one place at most.
MEMBERS = 256
#: Sets from which on a shingle is crowded, and centres to which the sets of such are tied before they are compared in tiles.
CROWD, CENTERS = 8, 6
#: Rows that are sent to every executor at most (24 bytes each); larger tables are joined by a shuffle.
SENT_ROWS = 500_000


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, hashes)``: text ``i`` has the set ``hashes[first[i]:first[i + 1]]``, sorted and without repeats."""
    w = Words(data, offsets)
    h = w.hashes(True)
    n, c = w.n, w.count
    short = (c > 0) & (c < WORDS)
    base = np.uint64(0x9FB21C651E98DF25)
    out = np.zeros(len(h), np.uint64)
    for i in range(WORDS):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - i] = h[i:] if i else h
        # a text of fewer words is one shingle of all of them: words of later texts count as none
        if i:
            part[: len(h) - i][w.doc[: len(h) - i] != w.doc[i:]] = 0
        out = out * base + part
    at = np.arange(len(h)) - w.first[w.doc]
    keep = np.where(short[w.doc], at == 0, at <= c[w.doc] - WORDS)
    out, doc = mixed(out)[keep], w.doc[keep]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))), out


def _signatures(first: np.ndarray, h: np.ndarray, clashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each set, equal for equal sets; the lowest bit of the first tells sets of under 256 shingles.

    Sets whose first number is among ``clashes``, those that different sets share, get another first number.
    """
    size = np.diff(first).astype(np.uint64)

    def summed(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(x), dtype=np.uint64)))
        return mixed((sums[first[1:]] - sums[first[:-1]]) + mixed(size))

    def flagged(x: np.ndarray) -> np.ndarray:
        return (x & ~np.uint64(1)) | (size < 256).astype(np.uint64)

    sig, other = flagged(summed(h)), summed(h ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return np.where(np.isin(sig, clashes), flagged(mixed(other ^ sig)), sig) if len(clashes) else sig, other


def _bitmaps(first: np.ndarray, h: np.ndarray, per_shingle: float) -> pa.Array:
    """A hashed bitmap for each set: so many bits a shingle, rounded up to a power of two."""
    size = np.diff(first)
    width = 1 << np.ceil(np.log2(np.maximum(size * per_shingle, LEAST_BITS))).astype(np.int64)
    ends = np.cumsum(width)
    set_bits = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    set_bits[np.repeat(ends - width, size) + ((mixed(h) >> np.uint64(32)).astype(np.int64) & (np.repeat(width, size) - 1))] = 1
    offsets = np.concatenate(([0], ends // 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(set_bits, bitorder="little"))])


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps, one a row, as they would be with ``width`` bytes."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _scan(clashes: np.ndarray):
    """A row for each document, and rows ``(null, count, hash, ...)`` for shingles met four times or more in one stretch of the task."""
    names = ["doc_id", "n", "sig", "other", "bits", "few_bits", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0
        kind = pa.int64()

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts >= 4], counts[counts >= 4]
            k = len(values)
            return pa.record_batch([pa.nulls(k, kind), pa.array(counts, pa.int64()), pa.array(values.view(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(np.ones(k, bool))], names)

        for b in batches:
            kind = b.column(0).type
            for a, z, data, offsets in groups(b.column(1), GROUP_BYTES):
                first, h = shingles(data, offsets)
                sig, other = _signatures(first, h, clashes)
                row = [b.column(0).slice(a, z - a), pa.array(np.diff(first)), pa.array(sig.view(np.int64)), pa.array(other.view(np.int64)), _bitmaps(first, h, BITS), _bitmaps(first, h, FEW_BITS), pa.array(np.zeros(z - a, bool))]
                yield pa.record_batch(row, names)
                held.append(h)
                n_held += len(h)
                if n_held >= 4 * FLUSH:
                    yield frequent()
                    held, n_held = [], 0
        if held:
            yield frequent()

    return run


def _prefixes(common: np.ndarray, clashes: np.ndarray, buckets: int):
    """``(bucket, entries)``: for every set the shingles of which a linked set has one, as packed (hash, signature) pairs."""
    values = np.sort(common)
    rank = np.empty(len(common), np.int64)
    rank[np.searchsorted(values, common)] = np.arange(len(common))  # 0 is the most frequent

    def packed(hs: np.ndarray, sigs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((sigs, hs))
        hs, sigs = hs[order], sigs[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (sigs[1:] != sigs[:-1])
        hs, sigs = hs[new], sigs[new]
        known = _member(values, hs)
        # a common shingle is known to be shared: its entries need not meet and are spread by the set instead
        bucket = np.where(known, mixed(sigs), mixed(hs)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        hs, sigs, known, bucket = hs[order], sigs[order], known[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
        for a, z in zip(edges, np.append(edges[1:], len(bucket))):
            blob = hs[a:z].tobytes() + sigs[a:z].tobytes() + known[a:z].tobytes()
            yield pa.record_batch([pa.array([int(bucket[a])], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, sigs, n = [], [], 0
        for b in batches:
            for _, _, data, offsets in groups(b.column(0), GROUP_BYTES):
                first, h = shingles(data, offsets)
                size = np.diff(first)
                sig = np.repeat(_signatures(first, h, clashes)[0], size)
                doc = np.repeat(np.arange(len(size)), size)
                at = np.searchsorted(values, h)
                at[at == len(values)] = 0
                is_common = (values[at] == h) if len(values) else np.zeros(len(h), bool)
                key = np.zeros(len(h), np.int64)
                key[is_common] = len(values) - rank[at[is_common]]
                order = np.lexsort((h, key, doc))  # within a set: rare ones by hash, then common ones from the least frequent
                place = np.arange(len(h)) - np.repeat(first[:-1], size)
                keep = order[place < np.repeat(size - -(-NUM * size // DEN) + 1, size)]
                hs.append(h[keep])
                sigs.append(sig[keep])
                n += len(keep)
                if n >= FLUSH:
                    yield from packed(np.concatenate(hs), np.concatenate(sigs))
                    hs, sigs, n = [], [], 0
        if n:
            yield from packed(np.concatenate(hs), np.concatenate(sigs))

    return run


def _member(values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(h), bool)
    at = np.searchsorted(values, h)
    at[at == len(values)] = 0
    return values[at] == h


def _shared(t: pa.Table) -> pa.Table:
    """Of a bucket, the entries whose shingle belongs to two sets or more."""
    hs, sigs, known = [], [], []
    for blob in t.column("entries").to_pylist():
        n = len(blob) // 17
        hs.append(np.frombuffer(blob, np.uint64, n))
        sigs.append(np.frombuffer(blob, np.uint64, n, 8 * n))
        known.append(np.frombuffer(blob, bool, n, 16 * n))
    h, s, k = np.concatenate(hs), np.concatenate(sigs), np.concatenate(known)
    order = np.lexsort((s, h))
    h, s, k = h[order], s[order], k[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    h, s, k = h[new], s[new], k[new]
    keep = k.copy()
    same = h[1:] == h[:-1]
    keep[1:] |= same
    keep[:-1] |= same
    return pa.table({"h": h[keep].view(np.int64), "sig": s[keep].view(np.int64)})


def _sets(clashes: np.ndarray):
    """``(sig, tile, center, items)`` of ``(sig, tile, center, text)``: the sorted shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offsets in groups(b.column(3), GROUP_BYTES):
                first, h = shingles(data, offsets)
                # only texts of the very set are taken: an id may have several
                own = np.flatnonzero(_signatures(first, h, clashes)[0].view(np.int64) == b.column(0).slice(a, z - a).to_numpy())
                items = [h[first[i] : first[i + 1]].tobytes() for i in own]
                yield pa.record_batch([*(b.column(k).slice(a, z - a).take(pa.array(own)) for k in range(3)), pa.array(items, pa.binary())], ["sig", "tile", "center", "items"])

    return run


def _least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least intersection with which sets of these sizes link."""
    return -(-NUM * (n + m) // (NUM + DEN))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(a, b, n_a, n_b, bits_a, bits_b)`` rows, the pairs that sizes and bit counts leave."""
    for t in batches:
        keep = []
        for i, (n, m, p, q) in enumerate(zip(*(t.column(k).to_pylist() for k in range(2, 6)), strict=True)):
            need = _least_common(n, m)
            if need > min(n, m):
                continue
            width = min(len(p), len(q))
            p, q = _folded(np.frombuffer(p, np.uint8), width), _folded(np.frombuffer(q, np.uint8), width)
            if n - int(np.bitwise_count(p & ~q).sum()) >= need and m - int(np.bitwise_count(q & ~p).sum()) >= need:
                keep.append(i)
        yield pa.record_batch([t.column(k).take(pa.array(keep, pa.int64())) for k in range(2)], ["a", "b"])


def _exact(t: pa.Table) -> pa.Table:
    """The ``(a, b)`` of a bucket's tiles, a centre and up to so many others each, whose sorted arrays have enough in common."""
    sig, tile, center = (t.column(c).to_numpy() for c in ("sig", "tile", "center"))
    items = t.column("items")
    order = np.lexsort((~center, tile))
    a, b, of, known = [], [], None, None
    for i in order:
        x = np.frombuffer(items[i].as_buffer(), np.uint64)
        if center[i]:
            of, known, s = tile[i], x, sig[i]
        elif of is not None and of == tile[i]:
            small, large = (x, known) if len(x) < len(known) else (known, x)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum())
            if DEN * both >= NUM * (len(x) + len(known) - both):
                a.append(sig[i])
                b.append(s)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _tiles_of(t: pa.Table) -> pa.Table:
    """The tiles of a bucket, one after the other; each has two blocks of rows at most."""
    cells = t.column("cells").combine_chunks()
    # a set is there once for all its tiles
    of = np.repeat(np.arange(len(t)), np.diff(cells.offsets.to_numpy()))
    tile, side = (x.to_numpy() for x in cells.flatten().flatten())
    order = np.argsort(tile, kind="stable")
    of, side = of[order], side[order]
    n, label, sig = (t.column(c).to_numpy()[of] for c in ("n", "label", "sig"))
    bitmaps = t.column("bits").to_pylist()
    bits = [bitmaps[i] for i in of]
    first = np.flatnonzero(np.diff(tile[order], prepend=tile[order][:1] - 1))
    found = []
    for a, z in zip(first, np.append(first[1:], len(n))):
        if z > a + 1:
            # the sizes of two bands, so at most two widths
            width = min(map(len, bits[a:z]))
            same = np.stack([_folded(np.frombuffer(x, np.uint8), width) for x in bits[a:z]]).view(np.uint64)
            found.append(_tile(side[a:z], n[a:z], label[a:z], sig[a:z], same))
    a, b, slack, x, y = (np.concatenate(c) for c in zip(*found)) if found else (sig[:0], sig[:0], np.empty(0), sig[:0], sig[:0])
    a, b, x, y = np.minimum(a, b), np.maximum(a, b), np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((slack, b, a))
    a, b, slack, x, y = (c[order] for c in (a, b, slack, x, y))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.table({"a": a[new], "b": b[new], "slack": slack[new], "x": x[new], "y": y[new]})


def _tile(side: np.ndarray, n: np.ndarray, label: np.ndarray, sig: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of a tile's two blocks that sizes and bit counts leave, from different components, and the share of them known to differ."""
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    out = [], [], [], [], []
    for i in left:
        m = n[right]
        ok = right[(label[right] != label[i]) & (sig[right] != sig[i]) & (_least_common(n[i], m) <= np.minimum(m, n[i]))]
        if not len(ok):
            continue
        need = _least_common(n[i], n[ok])
        only_i = np.bitwise_count(bits[i] & ~bits[ok]).sum(1).astype(np.int64)
        only_j = np.bitwise_count(bits[ok] & ~bits[i]).sum(1).astype(np.int64)
        fine = (n[i] - only_i >= need) & (n[ok] - only_j >= need)
        ok = ok[fine]
        for o, x in zip(out, (np.full(len(ok), sig[i]), sig[ok], (only_i[fine] + only_j[fine]) / (n[i] + n[ok]), np.full(len(ok), label[i]), label[ok])):
            o.append(x)
    return tuple(np.concatenate(o) for o in out) if out[0] else (sig[:0], sig[:0], np.empty(0), sig[:0], sig[:0])


def _linked(docs: DataFrame, sets: DataFrame, pairs: DataFrame, clashes: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` that link, each pair once there.

    Bitmaps go first.  Only sets of pairs that these leave travel, from one scan
    of the texts: those of ``a`` once a pair, those of ``b`` once for every so many pairs.
    """
    for bits in ("few_bits", "bits"):
        sent = F.broadcast if pairs.count() <= SENT_ROWS else lambda x: x
        of = lambda x: sets.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col(bits).alias(f"bits_{x}"))  # noqa: B023, E731
        both = of("a").join(sent(pairs), "a").join(of("b").join(sent(pairs.select("b").distinct()), "b"), "b")
        left = cut(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_bounded, "a long, b long"))
        if bits == "bits":
            drop(pairs)
        pairs = left
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    tile = lambda part: F.xxhash64("b", part)
    members = pairs.join(parts, "b").select(F.col("a").alias("sig"), tile(F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).alias("tile"), F.lit(False).alias("center"))
    centers = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("b").alias("sig"), tile(F.col("part")).alias("tile"), F.lit(True).alias("center"))
    wanted = cut(members.union(centers).join(sets.select("sig", "doc", "n"), "sig"))
    rows, items = wanted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    few = wanted.drop("n")
    texts = texts.join(F.broadcast(few) if rows <= SENT_ROWS else few, F.col("_id") == F.col("doc"))
    # rows that repeat give repeated links, which do no harm
    found = texts.select("sig", "tile", "center", "text").mapInArrow(_sets(clashes), "sig long, tile long, center boolean, items binary")
    buckets = max(16, items // FLUSH)
    out = cut(found.groupBy(F.pmod("tile", F.lit(buckets)).alias("bucket")).applyInArrow(_exact, "a long, b long").distinct())
    drop(wanted, pairs)
    return out


def _tied(rows: DataFrame, centers: int) -> DataFrame:
    """``(a, b)`` from ``(h, sig, label, size)``: each set with the centre, of another component, that most of its shingles have.

    Every shingle has so many ``centers``, each drawn from its largest component, and each gives a set one pair at most.
    """
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(centers))))
    chosen = rows.groupBy("h", "turn").agg(F.max(F.struct("size", F.xxhash64("turn", "sig").alias("r"), F.col("sig").alias("c"), F.col("label").alias("of"))).alias("m"))
    tied = rows.join(chosen.select("h", "turn", "m.c", "m.of"), ["h", "turn"]).filter("label <> of").groupBy("sig", "turn", "c").agg(F.count("*").alias("k"))
    return cut(tied.groupBy("sig", "turn").agg(F.max(F.struct("k", "c")).alias("m")).select(F.col("sig").alias("a"), F.col("m.c").alias("b")).distinct())


def _stars(label: DataFrame) -> DataFrame:
    """``(a, b)``: the components found so far as links, each node's with its smallest."""
    return label.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _scanned(text: DataFrame, id_type: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """``(seen, sets, clashes)``: a row for each document and common shingle, one for each different set, and the signatures to avoid.

    Sets are told apart by 127 bits and their size: where different ones share the first 63 (under 300 among 10^11 sets), they get
    other signatures in a second scan.
    """
    clashes = np.empty(0, np.uint64)
    for _ in range(3):
        seen = cut(text.mapInArrow(_scan(clashes), f"doc_id {id_type}, n long, sig long, other long, bits binary, few_bits binary, common boolean"))
        known = seen.filter("not common and n > 0 and doc_id is not null")
        sets = known.groupBy("sig").agg(F.min(F.struct("doc_id", "bits", "few_bits")).alias("m"), F.min("n").alias("n"), F.min("other").alias("o"), F.max("n").alias("n2"), F.max("other").alias("o2"))
        sets = cut(sets.select("sig", F.col("m.doc_id").alias("doc"), "n", "m.bits", "m.few_bits", ((F.col("n") != F.col("n2")) | (F.col("o") != F.col("o2"))).alias("clash")))
        clash = sets.filter("clash").select("sig").toArrow().column(0).to_numpy().view(np.uint64)
        if not len(clash):
            return seen, sets.drop("clash"), clashes
        clashes = np.union1d(clashes, clash)
        drop(seen, sets)
    raise RuntimeError("signatures of different sets keep clashing")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: classes of documents whose shingle sets link, directly or through others.

    Equal sets are one from the start.  All sets order their shingles alike (common ones last), so two sets that link share one of
    their first ``n - ceil(3n/4) + 1``.  Where a shingle is shared, the sets are first tied to one centre each, verified exactly,
    which settles groups of copies in linear work.  Shingles whose sets still belong to several components then form tiles, by
    bands of size and blocks of documents.  In both, bitmaps bound the overlap of a pair from above and what is left is
    intersected exactly.  No pair is dropped otherwise and none is estimated; shingles are compared by 64-bit hashes.

    Nulls and texts without words: no shingles, component of their own.  Null ids: component null.  Repeated rows link as
    equal sets do.  Empty table: no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = lean(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen, sets, clashes = _scanned(text, id_type)
    of_docs = seen.filter("not common").select("doc_id", "n", "sig")
    often = seen.filter("common").groupBy("sig").agg(F.sum("n").alias("c")).orderBy(F.col("c").desc(), "sig").limit(COMMON).collect()
    common = np.array([r["sig"] for r in often], np.int64).view(np.uint64)
    total = sets.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    buckets = max(64, int(total / FLUSH))
    packed = text.select("text").mapInArrow(_prefixes(common, clashes, buckets), "bucket long, entries binary")
    shared = cut(packed.groupBy("bucket").applyInArrow(_shared, "h long, sig long"))
    # one centre a set, from an eighth of the shingles of large sets and all those of small ones: what this misses is found below
    some = shared.filter((F.pmod("h", F.lit(8)) == 0) | (F.col("sig").bitwiseAND(1) == 1))
    best = _tied(some.select("h", "sig", F.col("sig").alias("label"), F.lit(1).cast("long").alias("size")), 1)
    edges = _linked(docs, sets, best, clashes, id_col, text_col)
    label = components(edges)
    release(docs.sparkSession)
    # crowded shingles are tried again, from several members of the largest component there
    crowd = some.join(some.groupBy("h").count().filter(F.col("count") > CROWD).select("h"), "h")
    crowd = cut(crowd.join(label, F.col("sig") == F.col("node"), "left").select("h", "sig", F.coalesce("component", "sig").alias("label")))
    sizes = crowd.groupBy("label").agg(F.countDistinct("sig").alias("size"))
    again = _tied(crowd.join(sizes, "label").select("h", "sig", "label", "size"), CENTERS)
    edges = _stars(label).union(_linked(docs, sets, again, clashes, id_col, text_col))
    label = components(edges)
    labelled = cut(shared.join(label, shared["sig"] == label["node"], "left").select("h", "sig", F.coalesce("component", "sig").alias("label")))
    drop(shared, crowd, best, again)
    release(docs.sparkSession)
    # shingles shared by the very same sets would give the same pairs: one of them stands for all
    members = labelled.groupBy("h").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("sig")).alias("m1"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("m2")
    )
    mixed_h = members.filter("x < y").groupBy("k", "m1", "m2").agg(F.min("h").alias("h")).select("h", "k")
    size = label.groupBy("component").agg(F.count("*").alias("size"))
    open_rows = labelled.join(mixed_h, "h").join(sets.select("sig", "n"), "sig").join(size, F.col("label") == F.col("component"), "left")
    open_rows = cut(open_rows.select("h", "k", "sig", "label", "n", F.coalesce("size", F.lit(1)).alias("size")))
    drop(labelled)
    # the tightest pair of every two components first: most of those that belong together are one component after that
    tiles = _tiles(open_rows.filter(F.col("k") > CROWD), sets)
    between = cut(_few(open_rows.filter(F.col("k") <= CROWD)).unionByName(tiles).groupBy("a", "b").agg(F.min("slack").alias("slack"), F.min("x").alias("x"), F.min("y").alias("y")))
    drop(tiles)
    release(docs.sparkSession)
    first = cut(between.groupBy("x", "y").agg(F.min(F.struct("slack", "a", "b")).alias("m")).select("m.a", "m.b"))
    edges = _stars(label).union(_linked(docs, sets, first, clashes, id_col, text_col))
    label = components(edges)
    now = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"n_{x}"))
    rest = between.join(first, ["a", "b"], "left_anti").join(now("a"), "a", "left").join(now("b"), "b", "left")
    rest = cut(rest.filter(F.coalesce("n_a", "a") != F.coalesce("n_b", "b")).select("a", "b"))
    drop(open_rows, between, first)
    release(docs.sparkSession)
    if not rest.isEmpty():
        edges = _stars(label).union(_linked(docs, sets, rest, clashes, id_col, text_col))
        label = components(edges)
    roots = label.join(sets, label["node"] == sets["sig"]).select("component", "sig", "doc")
    least = roots.groupBy("component").agg(F.min("doc").alias("least"))
    known = roots.join(least, "component").select(F.col("sig").alias("_sig"), "least").unionByName(
        sets.join(label, sets["sig"] == label["node"], "left_anti").select(F.col("sig").alias("_sig"), F.col("doc").alias("least"))
    )
    out = of_docs.join(known, (F.col("sig") == F.col("_sig")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def _few(open_rows: DataFrame) -> DataFrame:
    """``(a, b, slack, x, y)``: pairs whose sizes allow a link, from shingles that few sets have."""
    # dealt first: rows travel as they are, not as lists of one
    sets = open_rows.repartition("h").groupBy("h").agg(F.array_sort(F.collect_list(F.struct("sig", "label", "n"))).alias("s"))
    pairs = sets.select(F.explode("s").alias("p"), "s").select("p", F.explode("s").alias("q")).filter("p.sig < q.sig and p.label <> q.label")
    pairs = pairs.filter(f"{DEN} * least(p.n, q.n) >= {NUM} * greatest(p.n, q.n)")
    return pairs.select(F.col("p.sig").alias("a"), F.col("q.sig").alias("b"), F.lit(1.0).alias("slack"), F.expr("least(p.label, q.label)").alias("x"), F.expr("greatest(p.label, q.label)").alias("y"))


def _tiles(open_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, slack, x, y)``: the pairs between components ``x`` and ``y`` that bitmaps leave, from crowded shingles.

    A set is in one crowd for all shingles whose largest component is the same, so it travels once and not once a shingle.  In a
    crowd the sets outside of that component are compared with its members and with each other, in bands of size and blocks.
    """
    largest = open_rows.groupBy("h").agg(F.max(F.struct("size", F.xxhash64("label").alias("r"), "label")).alias("m")).select("h", F.col("m.label").alias("crowd"))
    # sizes of linked sets differ by 4/3 at most: they are in the same band or in neighbouring ones
    band = F.floor(F.log("n") / float(np.log(4 / 3)) + 1e-9).cast("int")
    rows = open_rows.join(largest, "h").select("crowd", "sig", "label", "n", band.alias("band"), (F.col("label") != F.col("crowd")).alias("out")).distinct()
    # in steps, each a table: one plan of all would be planned anew after each of its shuffles, with some of them done three times
    met = rows = cut(rows)
    # blocks of large sets have fewer of them
    block = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.lit(BLOCK_SHINGLES) / F.pow(F.lit(4 / 3), "band")))
    count = lambda c: F.ceil(F.sum(c.cast("int")) / block).cast("int")
    blocks = cut(rows.groupBy("crowd", "band").agg(count(F.col("out")).alias("o"), count(~F.col("out")).alias("c"), F.count_if("out").alias("n_out"), F.count("*").alias("n_all")))
    # the cells of a crowd that a task can hold go to one, where each set is sent once for all its cells
    small = blocks.groupBy("crowd").agg((F.sum("n_all") <= CROWD_ROWS).alias("small"))
    at = lambda by, name: blocks.select("crowd", (F.col("band") + by).alias("band"), F.col("o").alias(f"o{name}"), F.col("c").alias(f"c{name}"))
    rows = rows.join(blocks.join(small, "crowd"), ["crowd", "band"]).join(at(-1, "_up"), ["crowd", "band"], "left").join(at(1, "_down"), ["crowd", "band"], "left")
    blk = F.pmod(F.xxhash64("sig"), F.when(F.col("out"), F.col("o")).otherwise(F.col("c"))).cast("int")
    rows = rows.withColumn("blk", blk)
    none = F.array().cast("array<struct<inner:int,band:int,i:int,other:int,j:int,side:int>>")

    def every(n: str, cell) -> Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), cell)).otherwise(none)

    def cell(inner, band, i, other, j, side):
        return F.struct(F.lit(inner).alias("inner"), band.alias("band"), i.alias("i"), other.alias("other"), j.alias("j"), side.cast("int").alias("side"))

    b, k, zero, one = F.col("band"), F.col("blk"), F.lit(0), F.lit(1)
    # side 2 meets itself; 0 and 1 meet each other
    outer = F.concat(
        every("o", lambda x: cell(0, b, F.least(x, k), b, F.greatest(x, k), F.when(x == k, 2).when(k < x, 0).otherwise(1))),
        every("o_up", lambda x: cell(0, b, k, b + 1, x, zero)),
        every("o_down", lambda x: cell(0, b - 1, x, b, k, one)),
        every("c", lambda x: cell(1, b, k, b, x, zero)),
        every("c_up", lambda x: cell(1, b, k, b + 1, x, zero)),
        every("c_down", lambda x: cell(1, b, k, b - 1, x, zero)),
    )
    inner = F.concat(
        every("o", lambda x: cell(1, b, x, b, k, one)),
        every("o_up", lambda x: cell(1, b + 1, x, b, k, one)),
        every("o_down", lambda x: cell(1, b - 1, x, b, k, one)),
    )
    cells = F.when(F.col("out"), outer).otherwise(inner)
    # a set alone on both sides of a tile has nobody to meet there
    cells = F.filter(cells, lambda x: (x["side"] != 2) | (F.col("n_out") > 1))
    tile = lambda x: F.xxhash64("crowd", x["inner"], x["band"], x["i"], x["other"], x["j"])
    cells = F.transform(cells, lambda x: F.struct(tile(x).alias("tile"), x["side"].alias("side")))
    cells = every_cell = cut(rows.select("crowd", "small", "sig", "label", "n", cells.alias("cells")).filter(F.size("cells") > 0))
    drop(met, blocks)
    release(sets.sparkSession)
    # small crowds and whole tiles of others are dealt to as many buckets as the rows need, so a task holds a bounded number of rows
    buckets = max(16, (cells.agg(F.sum(F.size("cells"))).first()[0] or 0) // 10_000)
    own = F.pmod(F.xxhash64("crowd"), F.lit(buckets))
    apart = cells.filter("not small").select("sig", "label", "n", F.explode("cells").alias("cell"))
    apart = apart.select(F.pmod("cell.tile", F.lit(buckets)).alias("bucket"), "sig", "label", "n", F.array("cell").alias("cells"))
    cells = cells.filter("small").select(own.alias("bucket"), "sig", "label", "n", "cells").unionByName(apart).join(sets.select("sig", "bits"), "sig")
    out = cut(cells.groupBy("bucket").applyInArrow(_tiles_of, "a long, b long, slack double, x long, y long"))
    drop(every_cell)
    return out
