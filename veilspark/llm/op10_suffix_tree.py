"""LM scoring by a probabilistic suffix tree over bytes, kept as tables, and the exact unigram score beside it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, cut, fine, lean, release

#: Longest context in bytes.
DEPTH = 5
#: A context needs this many occurrences, and must save this many nats of code length against its suffix.
LEAST, GAIN = 20, 10.0
#: Weight of the shorter context's distribution in that of a longer one.
PRIOR = 6.0
#: Weight of the tree in a token's chance; the rest is the token's share of the training tokens.
TREE_SHARE = 0.5
GROUP_BYTES = 1_000_000
#: Texts are scored in chunks of about this many bytes of their file.
CHUNK_BYTES = 16 << 20
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: A text is this padding, then each word with a space after it, then the end.
PAD, END = b"\n" * DEPTH, b"\n"


def masks(k: int) -> tuple[int, int]:
    """Bits of a code that hold (symbol and context, context) of length ``k``; the symbol is the top byte, then the nearest byte first."""
    top = (1 << 8 * (DEPTH + 1)) - 1
    both = top ^ ((1 << 8 * (DEPTH - k)) - 1)
    return both, both & ((1 << 8 * DEPTH) - 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def sequence(words: list[bytes]) -> bytes:
    return PAD + (b" ".join(words) + b" " if words else b"") + END


def codes(texts: list[bytes]) -> np.ndarray:
    """The code of every predicted byte (all but the padding), text after text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
    use = np.ones(len(data), bool)
    for i in range(DEPTH):
        use[first + i] = False
    # whole arrays are shifted, and the padding's codes left out at the end: cheaper than picking bytes by their places
    code = data[DEPTH:].astype(np.int64)
    for i in range(1, DEPTH + 1):
        code <<= 8
        code |= data[DEPTH - i : len(data) - i]
    return code[use[DEPTH:]]


def chunk_of(id_col: str, text_col: str) -> Column:
    """A part of a table that any scan of it gives whole: of the piece of a file that a task reads, one of as many as it has chunks."""
    parts = F.greatest(F.ceil(F.input_file_block_length() / CHUNK_BYTES), F.lit(1))
    return F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64(id_col, text_col), parts))


def in_training(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 != 2, F.lit(False))


def _grouped(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for w in texts:
        group.append(w)
        size += sum(map(len, w)) + len(w)
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    c, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    at = np.flatnonzero(np.diff(c, prepend=c[:1] - 1))
    return c[at], np.add.reduceat(n, at)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(chunk, code, n)`` for every code of a chunk, ``n`` its occurrences in training texts."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting: dict[tuple[int, bool], list[bytes]] = {}
    sizes: Counter = Counter()

    def count(key: tuple[int, bool]) -> None:
        c, n = np.unique(codes(waiting.pop(key)), return_counts=True)
        sizes.pop(key)
        chunk, train = key
        own = held.setdefault(chunk, [])
        own.append((c, n if train else np.zeros_like(n)))
        if len(own) > 1 and sum(len(c) for c, _ in own) > max(1_500_000, 2 * len(own[0][0])):
            own[:] = [_merged(own)]

    for b in batches:
        for chunk, train, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            key, t = (chunk, train), sequence(words_of(text))
            waiting.setdefault(key, []).append(t)
            sizes[key] += len(t)
            if sizes[key] >= GROUP_BYTES:
                count(key)
    for key in list(waiting):
        count(key)
    for chunk in list(held):
        c, n = _merged(held.pop(chunk))
        for i in range(0, len(c), 100_000):
            part = c[i : i + 100_000]
            yield pa.record_batch([pa.array(np.full(len(part), chunk, np.int64)), pa.array(part), pa.array(n[i : i + 100_000])], ["chunk", "code", "n"])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(chunk, word, n)`` for every word of a chunk, ``n`` its occurrences in training texts."""
    known: dict[int, Counter] = {}
    for b in batches:
        for chunk, train, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            words = words_of(text)
            c = known.setdefault(chunk, Counter())
            c.update(words if train else dict.fromkeys(words, 0))
    for chunk, c in known.items():
        words, n = list(c), list(c.values())
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.record_batch([pa.array([chunk] * len(part), pa.int64()), pa.array(part, pa.binary()), pa.array(n[i : i + 50_000], pa.int64())], ["chunk", "word", "n"])


def tree(grams: DataFrame, depth: int = DEPTH, gain: float = GAIN, least: int = LEAST, prior: float = PRIOR) -> DataFrame:
    """``(code, logp)`` for every code of ``grams (code, n)``: the natural log of its symbol's chance after its longest kept suffix.

    All counts are over all training texts, and the tree, its contexts and its edges are tables, as large as the input makes them.
    A context is kept if its next-symbol distribution diverges from its suffix's by ``gain`` nats over its occurrences, or if a
    longer one that is kept ends in it.  A chance is smoothed by that of the next shorter context and, last, evenly.
    """
    level, code = {}, grams.select("code", "n")
    for k in range(depth, -1, -1):
        both, ctx = masks(k)
        sums = code.groupBy(F.col("code").bitwiseAND(both).alias("code")).agg(F.sum("n").alias("n")).withColumn("ctx", F.col("code").bitwiseAND(ctx))
        # a context has 256 symbols at most, so a window's rows are few
        level[k] = checkpointed(sums.withColumn("total", F.sum("n").over(Window.partitionBy("ctx"))))
        code = level[k]
    kept = {}
    for k in range(depth, 0, -1):
        both, ctx = masks(k - 1)
        t = level[k].filter((F.col("total") >= least) & (F.col("n") > 0)).withColumn("up", F.col("code").bitwiseAND(both))
        up = level[k - 1].select(F.col("code").alias("up"), F.try_divide("n", "total").alias("p_up"))
        saved = F.col("n") * F.log(F.col("n") / F.col("total") / F.col("p_up"))
        here = t.join(up, "up").groupBy("ctx").agg(F.sum(saved).alias("gain")).filter(F.col("gain") >= gain).select("ctx")
        if k < depth:
            here = here.union(kept[k + 1].select(F.col("ctx").bitwiseAND(masks(k)[1]).alias("ctx"))).distinct()
        kept[k] = checkpointed(here)
    even = F.lit(1 / 256)
    chance = level[0].select("code", F.when(F.col("total") > 0, (F.col("n") + prior * even) / (F.col("total") + prior)).otherwise(even).alias("p"))
    for k in range(1, depth + 1):
        up = chance.select(F.col("code").alias("up"), F.col("p").alias("p_up"))
        t = level[k].withColumn("up", F.col("code").bitwiseAND(masks(k - 1)[0])).join(kept[k].withColumn("kept", F.lit(True)), "ctx", "left").join(up, "up")
        chance = t.select("code", F.when(F.col("kept"), (F.col("n") + prior * F.col("p_up")) / (F.col("total") + prior)).otherwise(F.col("p_up")).alias("p"))
    return chance.select("code", F.log("p").alias("logp"))


def logs_of(known: tuple[np.ndarray, np.ndarray], code: np.ndarray) -> np.ndarray:
    """The log of every code, all of which are ``known``.  They are hashed, and only different ones sorted and looked up."""
    encoded = pa.array(code).dictionary_encode()
    different = encoded.dictionary.to_numpy()
    order = np.argsort(different)
    logs = np.empty(len(different))
    logs[order] = known[1][np.searchsorted(known[0], different[order])]
    return logs[encoded.indices.to_numpy()]


def score_words(known: tuple[np.ndarray, np.ndarray], counts, words: list[list[bytes]], n_train: int, n_words: int) -> list[tuple[int, int, float, float]]:
    """``(tokens, known tokens, base score, score)`` of texts given as words.

    ``known`` has the texts' codes, sorted, and their logs; ``counts`` the words' and, under None, the end's count.
    """
    logs = logs_of(known, codes([sequence(w) for w in words]))
    lengths = np.array([n for w in words for n in (*map(len, w), 0)]) + 1
    firsts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    by_token = np.add.reduceat(logs, firsts)
    c = np.array([n for w in words for n in (*(counts.get(x, 0) for x in w), counts[None])], np.float64)
    base = np.log10((c + 1) / (n_train + n_words + 1))
    if n_train:
        with np.errstate(divide="ignore"):
            by_token = np.logaddexp(by_token + np.log(TREE_SHARE), np.log(c * (1 - TREE_SHARE) / n_train))
    best = by_token / np.log(10)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    return list(zip((ends - starts).tolist(), np.add.reduceat((c > 0).astype(np.int64), starts).tolist(), np.add.reduceat(base, starts).tolist(), np.add.reduceat(best, starts).tolist(), strict=True))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every whole text.

    The tree is learned from the training texts' bytes.  Neither it nor the word counts are bounded, so nothing of them is sent
    whole: the words and codes of each chunk of the input get their counts and chances by joins, and meet the chunk's texts
    again, so a task holds one chunk's text, vocabulary and codes, however large the input and its files.  ``docs`` that are not
    read from files (after a shuffle, or made in memory) are written as a table first, as chunks are parts of files.

    ``score`` is the log10 probability of the text.  In the tree each word is its bytes and a closing space, the end is one symbol,
    and every byte is read after its longest kept suffix; a token's chance is ``TREE_SHARE`` of the tree's and the rest of its
    share of the training tokens.

    Null text: as empty, one token (the end).  Null ids are neither held out nor trained on.  Repeated rows count and score each.
    Without training texts all counts are 0 and the score is the even distribution over bytes.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    d = lean(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not docs.filter(F.input_file_name() == "").isEmpty():
        d = cut(d)
    fine(spark)
    d = d.withColumn("chunk", chunk_of("doc_id", "text")).withColumn("train", in_training("doc_id"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    n_docs = d.filter("train").count()
    grams = cut(d.select("chunk", "train", "text").mapInArrow(_grams, "chunk long, code long, n long"))
    chances = checkpointed(tree(grams, **settings))
    release(spark)
    by_word = Window.partitionBy("word")
    words = d.select("chunk", "train", "text").mapInArrow(_vocabulary, "chunk long, word binary, n long")
    words = words.withColumn("c", F.sum("n").over(by_word)).withColumn("at", F.row_number().over(by_word.orderBy("chunk"))).filter("c > 0")
    words = cut(words.select("chunk", "word", "c", (F.col("at") == 1).alias("first")))
    release(spark)
    total = words.filter("first").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train, n_words = (total["n"] or 0) + n_docs, total["v"] + (n_docs > 0)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(texts: pa.Table, facts: pa.Table) -> pa.Table:
        counts: dict[bytes | None, int] = {}
        for b in facts.select(["word", "c"]).filter(facts.column("word").is_valid()).to_batches(50_000):
            counts.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        counts[None] = n_docs
        coded = facts.select(["code", "logp"]).filter(facts.column("code").is_valid())
        code, logp = coded.column("code").to_numpy(), coded.column("logp").to_numpy()
        order = np.argsort(code)
        known = code[order], logp[order].astype(np.float64)
        del coded, code, logp, order
        parts = (words_of(t) for b in texts.select(["text"]).to_batches(1_000) for t in b.column(0).to_pylist())
        got = [x for g in _grouped(parts) for x in score_words(known, counts, g, n_train, n_words)]
        n, known_words, base, best = zip(*got) if got else ((), (), (), ())
        return pa.table(
            [texts.column("doc_id"), texts.column("held_out"), pa.array(n, pa.int64()), pa.array(known_words, pa.int64()), pa.array([n_train] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(best, pa.float64())],
            names,
        )

    texts = d.select("chunk", "doc_id", held.alias("held_out"), "text")
    # chances travel with six digits, half as many bytes
    coded = grams.select("chunk", "code").join(chances, "code").select("chunk", "code", F.col("logp").cast("float").alias("logp"))
    facts = words.select("chunk", "word", "c").unionByName(coded, allowMissingColumns=True)
    return texts.groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
