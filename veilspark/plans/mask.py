"""Whole plans: mask by rules, restore, and evaluate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chunk, models
from ..operators.detect import detect, residual
from ..operators.plan import KIND_OF_TYPE, allowed, applied, combined, detokenized, mapped, numbered, plan_of_entities, spliced, violations

PLAN_TYPE = "array<struct<s:int,e:int,token:string,original:string,kind:string,source:string>>"


def mask(docs: DataFrame, kinds: Column | None = None, min_confidence: float = 0.5, find=None) -> DataFrame:
    """``docs`` with ``masked`` and ``mappings``.  One stage without a shuffle: the plan of a text is made in its row.

    A null text has null results; there is no fallback that would pass the original through.
    """
    d = detect(docs, find).withColumn("mappings", plan_of_entities(F.col("text"), F.col("entities"), kinds, min_confidence))
    return d.withColumn("masked", spliced(F.col("text"), F.col("mappings"))).drop("entities")


def unmask(rows: DataFrame, text_col: str = "masked") -> DataFrame:
    """``rows`` with ``restored`` and ``unknown``, from ``mappings``."""
    text, unknown = detokenized(F.col(text_col), F.col("mappings"))
    return rows.withColumn("restored", text).withColumn("unknown", unknown)


def left_over(docs: DataFrame) -> DataFrame:
    """``docs`` with ``residual``: what the rules leave for models."""
    return detect(docs).withColumn("residual", residual(F.col("text"), F.col("entities"))).drop("entities")


def cascade(docs: DataFrame, detector: models.Detector, policy: DataFrame) -> DataFrame:
    """``(doc_id, masked, mappings, error)``: rules first, then a model on what they leave, both in one plan.

    ``docs``: ``(doc_id, consumer_id, text)``, ids unique; ``policy``: ``(consumer_id, kind, min_confidence)``.  The residual has the
    chunks' positions where entities are overwritten by as many spaces as code points.  Fails closed: where any chunk fails, or a
    span does not fit its text, ``masked`` and ``mappings`` are null and ``error`` says why.  Null text: error ``no_text``.
    """
    d = detect(docs.filter("text is not null"))
    blank = F.aggregate("entities", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], F.substr("text", a["at"] + 1, x["s"] - a["at"]), F.repeat(F.lit(" "), x["e"] - x["s"])).alias("out")), lambda a: F.concat(a["out"], F.substr("text", a["at"] + 1, F.length("text"))))
    d = d.withColumn("left", blank)
    chunks = chunk.chunked(d)
    gates = d.select("doc_id", "left")
    chunks = chunks.join(gates, "doc_id").withColumn("gate_text", F.substr("left", F.col("start_cp") + 1, F.col("end_cp") - F.col("start_cp"))).drop("left")
    answers = models.detect_chunks(chunks, detector)
    bad_span = F.exists("entities", lambda x: (x["start"] < 0) | (x["start"] >= x["end"]) | (x["end"] > F.length("text")))
    failed = answers.withColumn("error", F.when(F.col("error_code") != "NONE", "unavailable").when(bad_span, "span_out_of_range")).filter("error is not null")
    failed = failed.groupBy("doc_id").agg(F.min("error").alias("error"))
    texts = docs.select("doc_id", "consumer_id", "text").filter("text is not null")
    found = models.to_document(answers.filter("error_code = 'NONE'")).join(texts, "doc_id")
    ml = found.select("doc_id", "s", "e", mapped(KIND_OF_TYPE, F.col("type")).alias("kind"), F.substr("text", F.col("s") + 1, F.col("e") - F.col("s")).alias("original"), F.lit("ml").alias("source"), "confidence", "consumer_id", "text")
    rules = d.select("doc_id", "consumer_id", "text", F.explode("entities").alias("x"))
    rules = rules.select("doc_id", F.col("x.s").alias("s"), F.col("x.e").alias("e"), mapped(KIND_OF_TYPE, F.col("x.type")).alias("kind"), F.col("x.text").alias("original"), F.lit("regex").alias("source"), F.col("x.score").alias("confidence"), "consumer_id", "text")
    every = ml.unionByName(rules)
    failed = failed.union(violations(every).groupBy("doc_id").agg(F.min("violation").alias("error"))).groupBy("doc_id").agg(F.min("error").alias("error"))
    may = allowed(every, policy)
    both = combined(may.filter("source = 'ml'"), may.filter("source = 'regex'"))
    done = applied(numbered(both), texts)
    out = docs.select("doc_id", F.col("text").isNull().alias("none")).join(done, "doc_id", "left").join(failed, "doc_id", "left")
    error = F.when(F.col("none"), "no_text").otherwise(F.col("error"))
    return out.select("doc_id", F.when(error.isNull(), F.col("masked")).alias("masked"), F.when(error.isNull(), F.col("mappings")).alias("mappings"), error.alias("error"))
