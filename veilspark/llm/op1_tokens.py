"""Token counts by finite-state transducers."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .op6_bpe import grouped

#: Length of the pieces whose state maps are composed; any value gives the same counts.
CHUNK = 256
#: Texts are scanned in groups of about this many characters.
GROUP_CHARS = 500_000
#: Pieces with more bytes than this are merged with a heap, as a scan for each merge would take the square of their length.
LONG_PIECE = 128
#: Accepted pieces that a worker keeps with their annotated counts; beyond it starts anew, which costs time only.
KEPT_PIECES = 700_000

# Input classes of the piece transducer.
SPACE, LETTER, DIGIT, OTHER, QUOTE, S_T_M_D, R, V, L, E = range(10)
# States: what the piece at hand can still become.
START, IN_WORD, IN_OTHER, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
# Emissions of a transition: a piece starts at this character, at the one before, or both.
HERE, BEFORE = 1, 2


def piece_transducer() -> tuple[np.ndarray, np.ndarray]:
    """``(next state, emission)`` by state and class, for the pattern ``'s|'t|'re|'ve|'m|'ll|'d|letters|digit|others``.

    Whether a quote starts a contraction shows up to two characters later, so an emission may be for the character before.
    """
    letters = (LETTER, S_T_M_D, R, V, L, E)
    to = np.zeros((7, 10), np.uint8)
    out = np.zeros((7, 10), np.uint8)

    def fresh(state: int, also: int) -> None:
        """A character that begins a piece, whatever came before."""
        for c in letters:
            to[state, c], out[state, c] = IN_WORD, HERE | also
        to[state, DIGIT], out[state, DIGIT] = START, HERE | also
        to[state, OTHER], out[state, OTHER] = IN_OTHER, HERE | also
        to[state, QUOTE], out[state, QUOTE] = QUOTED, HERE | also
        to[state, SPACE], out[state, SPACE] = START, also

    for state in (START, IN_WORD, IN_OTHER, QUOTED):
        fresh(state, 0)
    for c in letters:
        out[IN_WORD, c] = 0  # the run goes on
    for state in (IN_OTHER, QUOTED):
        for c in (OTHER, QUOTE):
            to[state, c], out[state, c] = IN_OTHER, 0
    to[QUOTED, S_T_M_D], out[QUOTED, S_T_M_D] = START, 0
    for state, c, end in ((QUOTED_R, R, E), (QUOTED_V, V, E), (QUOTED_L, L, L)):
        to[QUOTED, c], out[QUOTED, c] = state, 0
        fresh(state, BEFORE)  # no contraction: the letter begins a word after all
        for x in letters:
            out[state, x] = BEFORE
        to[state, end], out[state, end] = START, 0
    return to, out


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the library's own patterns, which may be of another version than Python's."""
    every = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
    table = np.full(0x110000, OTHER, np.uint8)
    joined = "".join(every)
    for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
        for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(joined):
            table[start:end] = cls
    for chars, cls in (("'", QUOTE), ("stmd", S_T_M_D), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in chars:
            table[ord(c)] = cls
    return table


def emissions(cls: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """What the piece transducer emits at each character, from state maps of chunks composed by a parallel prefix scan."""
    to, out = piece_transducer()
    states, width = to.shape
    flat, flat_out = to.ravel().astype(np.intp), out.ravel()
    n = len(cls)
    rows = -(-n // chunk)
    grid = np.zeros(rows * chunk, np.uint8)  # padded with spaces
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    maps = np.tile(np.arange(states, dtype=np.intp)[:, None], (1, rows))
    for column in grid:  # all entry states of all chunks at once
        maps = flat[maps * width + column]
    step = 1
    while step < rows:  # inclusive scan: maps[:, i] becomes chunk i after chunk i-1 after ... after chunk 0
        later = maps.copy()
        later[:, step:] = maps[maps[:, : rows - step], np.arange(step, rows)]
        maps, step = later, 2 * step
    state = np.zeros(rows, np.intp)
    state[1:] = maps[START, :-1]
    emitted = np.empty((chunk, rows), np.uint8)
    for j, column in enumerate(grid):
        at = state * width + column
        emitted[j] = flat_out[at]
        state = flat[at]
    return emitted.T.ravel()[:n]


class WordTransducer:
    """Accepts one piece; its final transition is annotated with the number of tokens that the merges leave.

    States are the prefixes of pieces, built when first met; only final transitions emit, so the table from accepted piece to count
    is the whole of it.  A final count is compiled from the merge list, lowest rank first and leftmost among equals.
    """

    def __init__(self, model: dict, kept: int):
        self.end = model.get("end_of_word_suffix") or ""
        self.rank = {(a, b): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.kept = kept
        self.final: dict[str, int] = {}
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in keep]
        # bytes without a printable form stand at 256 and up, in order: the byte alphabet of such vocabularies
        self.alphabet = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def compiled(self, piece: str) -> int:
        parts = [self.alphabet[b] for b in piece.encode("utf-8", "replace")]
        parts[-1] += self.end
        if len(parts) > LONG_PIECE:
            return self.merged(parts)
        get, none = self.rank.get, 1 << 30
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
        return len(parts)

    def merged(self, parts: list[str | None]) -> int:
        """The number of tokens that the merges leave of a long piece, by a heap of its neighbouring pairs."""
        rank, n = self.rank, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue  # merged otherwise meanwhile
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            n -= 1
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (r := rank.get(pair := (parts[k], parts[right[k]]))) is not None:
                    heapq.heappush(heap, (r, k, *pair))
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        final = self.final
        if new := set(pieces) - final.keys():
            if len(final) + len(new) > self.kept:
                final.clear()
                new = set(pieces)
            for p in new:
                final[p] = self.compiled(p)
        return list(map(final.__getitem__, pieces))


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """By code point, whether this Python's Unicode tables do not know it, though the library's may."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


class Counter:
    """Counts the tokens of texts as the library does for a lower-casing byte-level vocabulary with word ends."""

    def __init__(self, path: str, kept: int = KEPT_PIECES, chunk: int = CHUNK):
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        self.words = WordTransducer(t["model"], kept)
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in t["added_tokens"]) or r"(?!)")
        self.table = classes()
        self.chunk = chunk
        self.unassigned = unassigned()
        self.newer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])

    def normal(self, text: str) -> str:
        if not text.isascii():
            if self.unassigned[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
                return self.newer.normalize_str(text)
            # capital sigma has one lower case here, wherever it stands
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower()

    def count(self, texts: list[str]) -> list[int]:
        total = [0] * len(texts)
        parts, owner = [], []
        for i, t in enumerate(texts):
            if "<" in t and (found := self.special.findall(t)):
                total[i] = len(found)
                cut = self.special.split(t)
            else:
                cut = [t]
            parts += map(self.normal, cut)
            owner += [i] * len(cut)
        joined = " ".join(parts)
        if not joined:
            return total
        cls = self.table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        e = emissions(cls, self.chunk)
        begins = np.zeros(len(cls) + 1, bool)
        begins[: len(cls)] = (e & HERE) != 0
        begins[: len(cls) - 1] |= (e[1:] & BEFORE) != 0
        if len(cls) and cls[-1] in (R, V, L) and not begins[len(cls) - 1]:
            # the end of the text is like a space for a letter that waits behind a quote
            begins[len(cls) - 1] = emissions(np.append(cls, np.uint8(SPACE)), self.chunk)[-1] & BEFORE
        stops = begins.copy()
        stops[: len(cls)] |= cls == SPACE
        stops[-1] = True
        at = np.flatnonzero(stops)
        here = np.flatnonzero(begins[at[:-1]])
        starts, ends = at[here], at[here + 1]
        counts = np.array(self.words.counts([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]), np.int64)
        edges = np.cumsum([len(p) + 1 for p in parts])
        sums = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, edges)]
        for i, c in zip(owner, np.diff(sums, prepend=0).tolist()):
            total[i] += c
        return total


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every whole text, without a shuffle.

    Two transducers: one over character classes emits where pieces start; its texts are laid end to end and cut into chunks of
    equal length, each chunk's map from entry state to exit state is found for all chunks at once, and a prefix scan composes
    the maps, so a long text is no slower than many short ones.  The other accepts a piece and emits its token count.
    Null or empty text: 0 bytes and tokens.  Null ids stay null, repeated rows give repeated rows, other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n_bytes = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    counted = n_bytes.mapInArrow(_with_bytes(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@lru_cache(maxsize=1)
def worker_counter(path: str) -> Counter:
    """One for each Python worker, which serves many tasks."""
    return Counter(path)


def _with_bytes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counter = worker_counter(path)
        for b in batches:
            n = [c for g in grouped(b.column(1).to_pylist(), GROUP_CHARS) for c in counter.count(g)]
            size = pc.cast(pc.binary_length(b.column(1)), pa.int64())
            yield pa.record_batch([b.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run
