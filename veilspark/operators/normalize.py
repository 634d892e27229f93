"""Normalized text and the way back to positions of the original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import DASHES, SPACES
from ..functions.spans import let

_RUN = f"[{SPACES}]+"


def normalized(text: Column) -> Column:
    """Dashes of all kinds as ``-``, runs of white space as one space, lower case; no characters are trimmed or reordered."""
    one_case = F.translate(text, DASHES + "İΣ", "-" * len(DASHES) + "iσ")
    return F.lower(F.regexp_replace(one_case, _RUN, " "))


def removed_runs(text: Column) -> Column:
    """``array<struct<at, gone>>``: the normalized place from which on positions are ``gone`` code points further in ``text``.

    Null where nothing was collapsed, so positions are the same.  One pass over the text's pieces.
    """
    again = f"(?<=[{SPACES}]){_RUN}"
    kept, removed = F.split(text, again, -1), F.regexp_extract_all(text, F.lit(again), F.lit(0))
    sizes = F.zip_with(F.transform(kept, F.length), F.transform(removed, F.length), lambda k, r: F.struct(k.alias("k"), r.alias("r")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gone"), F.array().cast("array<struct<at:int,gone:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        here = F.struct((a["at"] + x["k"]).alias("at"), (a["gone"] + x["r"]).alias("gone"))
        return F.struct(here["at"].alias("at"), here["gone"].alias("gone"), F.array_append(a["out"], here).alias("out"))

    # the last piece has nothing removed after it
    runs = F.aggregate(F.filter(sizes, lambda x: x["r"].isNotNull()), start, step, lambda a: a["out"])
    return F.when(text.rlike(f"[{SPACES}]{{2}}"), runs)


def with_normalized(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``norm`` and ``kept``; a null text has nulls."""
    t = F.col(text_col)
    return df.withColumn("norm", normalized(t)).withColumn("kept", removed_runs(t))


def original_place(kept: Column, i: Column) -> Column:
    """Where normalized code point ``i`` stands in the text."""
    return i + F.coalesce(F.array_max(F.transform(F.filter(kept, lambda x: x["at"] <= i), lambda x: x["gone"])), F.lit(0))


def original_span(kept: Column, s: Column, e: Column) -> tuple[Column, Column]:
    """The original positions of a normalized span: to the end of its last character, so what was collapsed after it is left out."""
    return original_place(kept, s), original_place(kept, e - 1) + 1


def kept_positions(text: Column) -> Column:
    """Where each normalized code point stands in ``text``; null where nothing was collapsed, so positions are the same."""
    last = F.length(F.regexp_replace(text, _RUN, " ")) - 1
    return let(removed_runs(text), lambda kept: F.when(kept.isNotNull(), F.transform(F.sequence(F.lit(0), last), lambda i: original_place(kept, i))))


def normalized_place(kept: Column, i: Column) -> Column:
    """The first place of the normalized text that stands at original code point ``i`` or after it."""
    passed = F.filter(kept, lambda x: x["at"] + x["gone"] <= i)
    gone = F.coalesce(F.array_max(F.transform(passed, lambda x: x["gone"])), F.lit(0))
    following = F.array_min(F.transform(F.filter(kept, lambda x: x["at"] + x["gone"] > i), lambda x: x["at"]))
    return F.least(i - gone, F.coalesce(following, i - gone))


def byte_offset(text: Column, i: Column) -> Column:
    """UTF-8 bytes before code point ``i``."""
    return F.octet_length(F.substr(text, F.lit(1), i))


def place_of_byte(text: Column, b: Column) -> Column:
    """How many code points begin before byte ``b`` of the UTF-8 text."""
    pairs = F.regexp_extract_all(F.hex(F.substring(F.encode(text, "UTF-8"), F.lit(1), b)), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.size(F.filter(pairs, lambda x: ~x.rlike("^[89AB]")))
