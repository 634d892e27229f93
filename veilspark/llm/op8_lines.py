"""Line dedup by winnowing over line hashes.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, let

#: Lines with fewer characters are trivial ("}", "--", "1."): they go only with their neighbours, in a repeated run that has this many.
LEAST_CHARS = 5
_BLANK = " \t\r\x0b\x0c"


def _span(units: Column, i: Column, chars: int) -> Column:
    """How many lines from ``i`` on have ``chars`` characters together; null where the text ends before.  Every line has one or more."""
    reached = F.aggregate(
        F.slice(units, i + 1, F.lit(chars)),
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("c")),
        lambda a, x: F.when(a["s"] >= chars, a).otherwise(F.struct((a["s"] + x["len"]).alias("s"), (a["c"] + 1).alias("c"))),
        lambda a: F.when(a["s"] >= chars, a["c"]),
    )
    return F.when(F.get(units, i)["len"] >= chars, F.lit(1)).otherwise(reached)


def line_arrays(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, key, units)``: of the lines that are not blank, their places in the text, hashes and lengths.

    ``key`` tells texts of one id apart; rows with the same id and text are one document here.
    """
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null and text is not null")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(_BLANK)).alias("s")))
    units = F.transform(F.filter(lines, lambda r: r["s"] != ""), lambda r: F.struct(r["pos"].alias("pos"), F.xxhash64(r["s"]).alias("h"), F.length(r["s"]).alias("len")))
    return d.select("doc", F.xxhash64("text").alias("key"), units.alias("units")).dropDuplicates(["doc", "key"])


def fingerprints(arrays: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(doc, key, f, at, lines)``: every gram's hash, its first line's place and the places of all its lines.

    The grams of a line are the shortest runs with ``least_chars`` characters that start at it and that end at it; for all but
    trivial lines both are the line alone.  Each gram is the least of its own window, so none is passed over, at a text's end neither:
    every line of a run with ``least_chars`` characters lies in one of the run's own grams.  A text with fewer is one gram, which
    only such whole texts share.
    """
    units = F.col("units")

    def grams(back: Column) -> Column:
        n = F.size(units)
        ahead = F.transform(units, lambda u, i: let(_span(units, i, least_chars), lambda g: F.struct(i.alias("i"), g.alias("g"))))
        behind = F.transform(back, lambda u, i: let(_span(back, i, least_chars), lambda g: F.struct((n - i - g).alias("i"), g.alias("g"))))
        # of single lines both are the same; what else is the same does no harm
        return F.concat(F.filter(ahead, lambda x: x["g"].isNotNull()), F.filter(behind, lambda x: x["g"] > 1))

    def hashed(spans: Column) -> Column:
        def one(i: Column, g: Column, salt: str = "") -> Column:
            lines = F.slice(units, i + 1, g)
            many = F.xxhash64(F.lit(salt), F.transform(lines, lambda x: x["h"]))
            f = many if salt else F.when(g == 1, F.get(units, i)["h"]).otherwise(many)
            return F.struct(f.alias("f"), F.get(units, i)["pos"].alias("at"), F.transform(lines, lambda x: x["pos"]).alias("lines"))

        whole = F.when(F.size(units) > 0, F.array(one(F.lit(0), F.size(units), "whole")))
        return F.when(F.size(spans) > 0, F.transform(spans, lambda x: one(x["i"], x["g"]))).otherwise(whole)

    return arrays.select("doc", "key", F.inline(let(let(F.reverse(units), grams), hashed)))


def repeated_runs(arrays: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(doc, key, gone)``: the places of lines in runs that an earlier document, or earlier part of the text, has too.

    Every gram is joined to its first occurrence in (id, key, place) order, so a group of copies gives one row a member,
    not one a pair.  The first occurrence of a line is never deleted, as the same line of its gram's first occurrence is earlier still.
    """
    fps = cut(fingerprints(arrays, least_chars))
    # cut, so that the join's sides are dealt apart and a very common line's rows can go to several tasks
    first = cut(fps.groupBy("f").agg(F.min(F.struct("doc", "key", "at")).alias("a"), F.count("*").alias("n")).filter("n > 1").select("f", "a"))
    hits = fps.join(first, "f").filter(F.struct("doc", "key", "at") > F.col("a"))
    # a document has no more lines than its own here, whatever the number of its grams
    return hits.select("doc", "key", F.explode("lines").alias("pos")).groupBy("doc", "key").agg(F.collect_set("pos").alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with ``text_col`` rewritten and two columns more: ``n_lines`` and ``n_removed``.

    Lines are compared without white space at their ends; blank lines neither match nor are removed.  Null text: stays null, 0
    lines.  Null id: the row stays as it is.  Columns of these two names are replaced; all others stay, whatever their names.  Rows with the same id and text are one document and all get the same text.
    Text whose lines are all removed becomes empty.  Every later occurrence of a line, or run of whole lines, of ``least_chars``
    characters or more goes, and so do later copies of whole texts with fewer.
    """
    arrays = line_arrays(docs, id_col, text_col)
    doc, key, gone = fresh(docs, "_doc", "_key", "_gone")
    runs = repeated_runs(arrays, least_chars).select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("gone").alias(gone))
    text = F.col(text_col).cast("string")
    out = docs.drop("n_lines", "n_removed").join(runs, (F.col(id_col) == F.col(doc)) & (F.xxhash64(text) == F.col(key)), "left")
    lines = F.split(text, "\n")
    # places are set aside by hash, so a text with very many lines takes no square of them
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    rewritten = F.when(F.col(gone).isNull(), text).otherwise(left)
    columns = [rewritten.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return out.select(*columns, n_lines.alias("n_lines"), n_removed.alias("n_removed"))
