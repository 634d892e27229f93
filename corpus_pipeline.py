"""From raw documents to encoded training text: five stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import op2_jaccard, op5_langid, op6_bpe, op7_mix, op8_lines
from veilspark.llm.common import cut, table

#: Texts whose n-grams are this far from every profile are no running text of a language that is known.
LEAST_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without text, or far from every learned language go."""
    return op5_langid.accepted(docs, op5_langid.learn(docs), LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; so do documents of which nothing is left, which were copies.  ``n_chars`` follows the text."""
    out = op8_lines.dedup(docs)
    out = out.filter((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\n\r\x0b\x0c")) != ""))
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays; of repeated rows, one."""
    kept = op2_jaccard.link(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    same = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).drop("_hash")
    return same.unionByName(docs.filter(F.col("doc_id").isNull()))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return op7_mix.mix_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]
#: Learned profiles and token merges are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
