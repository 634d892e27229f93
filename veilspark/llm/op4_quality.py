"""Quality rules: base rules, and boosted trees over document statistics flattened into node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, groups, mixed, run_hashes, span_hashes

GROUP_BYTES = 1_000_000
#: The trees are fitted on at most about this many labelled documents, chosen by a hash of their ids.
FIT_ROWS = 12_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, each with the sign of its allowed influence on quality (0: free).
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", -1),
    ("digit_share", 0), ("mark_share", -1), ("same_next_share", -1), ("distinct_share", 0), ("long_word_share", 0), ("words_a_line", 0),
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _UPPER, _DIGIT, _MARK = (_table(x) for x in (SYMBOLS, bytes(range(65, 91)), bytes(range(48, 58)), b"!?~^_=+{}[]\\@"))
_START = _table(bytes(x for x in range(256) if x & 0xC0 != 0x80))


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(base counts, features)`` of a group of texts, a row each."""
    w = Words(data, offsets)
    n, words = w.n, w.count
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))

    def of(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of_byte[mask], minlength=n)

    chars = of(w.inside & _START[data])
    symbols = of(_SYMBOL[data])
    h = w.hashes(False)
    # words in windows that the text has twice or more
    runs = run_hashes(h, WINDOW)
    own = w.doc[: len(runs)] == w.doc[WINDOW - 1 :] if len(runs) else np.empty(0, bool)
    at = np.flatnonzero(own)
    keys = runs[at] + mixed(w.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(h) + WINDOW + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeat = np.bincount(w.doc[np.cumsum(cover)[: len(h)] > 0], minlength=n)
    # lines with a word, equal to an earlier one of the text
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    owner = np.searchsorted(offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    filled = np.searchsorted(w.start, starts) < np.searchsorted(w.start, ends) if len(starts) else np.empty(0, bool)
    starts, ends, owner = starts[filled], ends[filled], owner[filled]
    lines = np.bincount(owner, minlength=n)
    keys = np.unique(span_hashes(data, starts, ends, False) + mixed(owner.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    dup = lines - np.bincount(owner[keys], minlength=n)
    base = np.stack([words, chars, symbols, dup, repeat], 1).astype(np.int64)
    # for the trees
    inner = w.doc[1:] == w.doc[:-1]
    again = np.bincount(w.doc[1:][inner & (h[1:] == h[:-1])], minlength=n)
    distinct = np.bincount(w.doc[np.unique(h + mixed(w.doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]], minlength=n)
    long_words = np.bincount(w.doc[w.end - w.start > 20], minlength=n)
    m, c = np.maximum(words, 1), np.maximum(chars, 1)
    share = [symbols / c, dup / np.maximum(lines, 1), repeat / m, of(_UPPER[data]) / c, of(_DIGIT[data]) / c, of(_MARK[data]) / c, again / m]
    features = np.stack([np.log1p(words), chars / m, *share, distinct / np.sqrt(m), long_words / m, words / np.maximum(lines, 1)], 1)
    return base, features


@dataclass
class Trees:
    """Boosted trees as node arrays: children and thresholds of all nodes of all trees, leaves being their own children."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of good quality, for all rows and trees at once."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 4.0, least: int = 8) -> Trees:
    """Gradient boosting for the logistic loss on binned features.

    A feature with a sign may only split so that the side of larger values is not below (or above) the other, and the middle of
    the two values bounds all that is below either side, so every tree, and the sum, is monotone in that feature.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    f = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(feature)
        for a, v_ in ((feature, 0), (threshold, np.inf), (left, i), (right, i), (value, v)):
            a.append(v_)
        return i

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, level: int) -> int:
        v = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), lo, hi))
        me = leaf(v)
        best = None
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                c = code[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(c, k, len(e) + 1))[:-1] for k in (g[rows], h[rows], np.ones(len(rows))))
                gr, hr, nr = g[rows].sum() - gs, h[rows].sum() - hs, len(rows) - ns
                a, b = np.clip(gs / (hs + ridge), lo, hi), np.clip(gr / (hr + ridge), lo, hi)
                gain = gs * a - (hs + ridge) * a * a / 2 + gr * b - (hr + ridge) * b * b / 2
                ok = (ns >= least) & (nr >= least) & (signs[j] * (b - a) >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > (best[0] if best else g[rows].sum() * v - (h[rows].sum() + ridge) * v * v / 2 + 1e-6):
                    best = (gain[k], j, k, a[k], b[k])
        if best:
            _, j, k, a, b = best
            mid, s = (a + b) / 2, signs[j]
            side = code[rows, j] <= k
            feature[me], threshold[me] = j, edges[j][k]
            left[me] = grow(rows[side], g, h, mid if s < 0 else lo, mid if s > 0 else hi, level + 1)
            right[me] = grow(rows[~side], g, h, mid if s > 0 else lo, mid if s < 0 else hi, level + 1)
        else:
            value[me] = rate * v
        return me

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), -np.inf, np.inf, 0))
        t = Trees(np.array(roots[-1:]), *(np.array(a) for a in (feature, threshold, left, right, value)), 0.0, depth)
        at = np.full(len(y), roots[-1])
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), t.feature[at]] <= t.threshold[at], t.left[at], t.right[at])
        f += t.value[at]
    return Trees(np.array(roots, np.intp), np.array(feature, np.intp), np.array(threshold), np.array(left, np.intp), np.array(right, np.intp), np.array(value), bias, depth)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, z, data, offsets in groups(b.column(1), GROUP_BYTES):
            x = statistics(data, offsets)[1]
            yield pa.record_batch([b.column(0).slice(a, z - a), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Trees | None:
    """Trees from at most about ``rows`` labelled documents; None where no label is 0 or none is 1."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("double").alias("y"))
    n = known.count()
    if n > rows:  # a hash of the id decides, so the same documents are taken on every run
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < int(1_000_003 * rows / n))
    # not more than about ``rows`` narrow rows: small enough to send everywhere
    pairs = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    got = pairs.select("y", "text").mapInArrow(_features, "y double, x array<double>").toPandas()
    if not len(got) or got["y"].nunique() < 2:
        return None
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows came in
    return fit(x[order], y[order], tuple(s for _, s in FEATURES))


def _judge(trees: Trees | None, threshold: float):
    names = ["doc_id", *BASE, "base_failed", "kept", "quality"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offsets in groups(b.column(1), GROUP_BYTES):
                base, x = statistics(data, offsets)
                failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
                p = trees.score(x) if trees else np.ones(len(x))
                yield pa.record_batch([b.column(0).slice(a, z - a), *map(pa.array, base.T), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], names)

    return run


def judge(docs: DataFrame, trees: Trees | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality)``.

    Null or empty text: all counts 0, base_failed.  Without trees every document that passes the base rules is kept.  Null ids
    stay null, repeated rows are judged alike, other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in BASE)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _judge(trees, threshold), f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, quality double"
    )
