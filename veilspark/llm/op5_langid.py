"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fresh, lean

#: Most frequent n-grams of a profile and of a document that are compared.
TOP = 300
#: Profiles are fitted on about this many labelled documents a language at most, chosen by a hash of their ids.
FIT_ROWS = 2_000
#: An n-gram's code has 21 bits a symbol; these stand in the first place of shorter ones, beyond all code points.
UNI, BI = 0x1FFFFE << 42, 0x1FFFFF << 42
UNKNOWN = "und"
GROUP_CHARS = 400_000


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Code point to symbol: 0 for what is no letter, else the lower-case code point."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    table = np.zeros(0x110000, np.int32)
    for m in regex.finditer(r"\p{L}+", every):
        table[m.start() : m.end()] = [ord(c.lower()[0]) for c in m[0]]
    return table


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, counts)`` of the n-grams of 1 to 3 symbols within the words of a text, a word's edges counting as a symbol."""
    s = symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate((np.zeros(1, np.int64), s, np.zeros(2, np.int64)))  # 64 bits from here on
    if not s.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, c = s[:-2], s[1:-1], s[2:]
    two = (a << 21) | b
    return np.unique(np.concatenate((b[b > 0] | UNI, two[two > 0] | BI, ((two << 21) | c)[b > 0])), return_counts=True)


def top_grams(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes in order; ties go by code."""
    if len(codes) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:top]]


def in_training(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, code, n)`` for the texts of each batch."""
    for b in batches:
        found: dict[str, list] = defaultdict(list)
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found[lang].append(gram_counts(text))
        for lang, x in found.items():
            codes, at = np.unique(np.concatenate([c for c, _ in x]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in x]), len(codes)).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, top: int = TOP) -> dict[str, np.ndarray]:
    """The profile of each language: its most frequent codes in order, from about ``rows`` training documents a language at most."""
    known = lean(docs).filter(in_training(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, rows / n) * 1_000_003))])
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share[F.col("lang")]).filter(F.col("text").isNotNull())
    sums = chosen.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    got = sums.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= top).collect()
    profiles = {lang: [0] * sum(r["lang"] == lang for r in got) for lang in {r["lang"] for r in got}}
    for r in got:
        profiles[r["lang"]][r["at"] - 1] = r["code"]
    return {lang: np.array(p, np.int64) for lang, p in sorted(profiles.items())}


class Identifier:
    """Out-of-place distances to the profiles: ranks apart for shared n-grams, the whole profile length for others."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = list(profiles), top
        self.codes = np.unique(np.concatenate([np.full(1, -1, np.int64), *profiles.values()]))
        self.rank = np.full((len(profiles), len(self.codes)), -1, np.int32)
        for i, p in enumerate(profiles.values()):
            self.rank[i, np.searchsorted(self.codes, p)] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        best = top_grams(*gram_counts(text)) if text else ()
        if not len(best) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, best)
        at[at == len(self.codes)] = 0
        r = self.rank[:, np.where(self.codes[at] == best, at, 0)]
        d = np.where(r >= 0, np.abs(r - np.arange(len(best))), self.top).sum(1)
        i = int(np.argmin(d))
        return self.langs[i], float(max(0.0, min(1.0, 1 - d[i] / (self.top * len(best)))))


def _predict(profiles: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Identifier(profiles)
        for b in batches:
            got = [one.predict(t.as_py()) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; a null text or one without a letter is ``und`` with score 0.

    Only the text decides.  A null id is neither held out nor used for training; repeated rows are predicted alike; with no
    labelled document every text is ``und``.  Equal distances go to the first language in order.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _predict(profiles), f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def _append(profiles: dict[str, np.ndarray], text_at: int, *names: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Identifier(profiles)
        for b in batches:
            got = [one.predict(t.as_py()) for t in b.column(text_at)]
            columns = [*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.record_batch(columns, [*b.schema.names, *names])

    return run


def accepted(docs: DataFrame, profiles: dict[str, np.ndarray], least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least`` or more; all columns, no shuffle."""
    schema = docs.schema
    lang, score = fresh(docs, "_lang_pred", "_lang_score")
    out = StructType([*schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    named = docs.mapInArrow(_append(profiles, schema.names.index(text_col), lang, score), out)
    return named.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
