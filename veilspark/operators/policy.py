"""Consumers, their policies and what a request may narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plan import ALL_KINDS

MIN_CONFIDENCE = 0.5


def policies(systems: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(consumer_id, kind, detok_allowed, min_confidence)`` from ``(id, mask_kinds, detokenization_allowed)``: no list allows all kinds, an empty one none."""
    every = F.array(*map(F.lit, sorted(ALL_KINDS)))
    s = systems.select(F.col("id").alias("consumer_id"), F.coalesce("detokenization_allowed", F.lit(True)).alias("detok_allowed"), F.coalesce("mask_kinds", every).alias("kinds"))
    return s.select("consumer_id", F.explode(F.array_distinct("kinds")).alias("kind"), "detok_allowed", F.lit(min_confidence).alias("min_confidence"))


def canonical(kinds: Column) -> Column:
    return F.array_sort(F.array_distinct(kinds))


def narrowed(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """``requests`` with ``effective_kinds`` and ``error``: a request may only take kinds away from its consumer's.

    The first kind of the list that is unknown or not allowed decides; a consumer without a policy is rejected.
    """
    by_consumer = policy.groupBy("consumer_id").agg(F.array_sort(F.collect_set("kind")).alias("_allowed"))
    r = requests.join(by_consumer, "consumer_id", "left")
    asked = F.col("mask_kinds")
    verdict = F.transform(asked, lambda k: F.when(~k.isin(*ALL_KINDS), "invalid_kind").when(~F.array_contains("_allowed", k), "policy_rejected"))
    first = F.get(F.filter(verdict, lambda v: v.isNotNull()), F.lit(0))
    error = F.when(F.col("_allowed").isNull(), "policy_rejected").otherwise(first)
    kinds = F.when(asked.isNull(), F.col("_allowed")).otherwise(canonical(asked))
    return r.withColumn("error", error).withColumn("effective_kinds", F.when(error.isNull(), kinds)).drop("_allowed")


def same_kinds(a: Column, b: Column) -> Column:
    """Equal sets, and both or neither given."""
    return canonical(a).eqNullSafe(canonical(b))


def authenticated(requests: DataFrame, systems: DataFrame) -> DataFrame:
    """``requests`` with ``consumer_id`` and ``status``: 401 without a known key, 403 for a disabled consumer.  Keys meet as SHA-256 fingerprints."""
    s = systems.select(F.sha2("api_key", 256).alias("_fp"), F.col("id").alias("consumer_id"), "enabled")
    r = requests.withColumn("_fp", F.sha2("api_key", 256)).join(s, "_fp", "left")
    status = F.when(F.col("consumer_id").isNull(), 401).when(~F.col("enabled"), 403).otherwise(200)
    return r.withColumn("status", status).withColumn("consumer_id", F.when(status == 200, F.col("consumer_id"))).drop("_fp", "enabled")


def system_errors(systems: DataFrame) -> DataFrame:
    """What is wrong with a table of systems: empty or repeated ids and keys, none enabled."""
    each = systems.select(F.explode(F.array(F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "empty_id"), F.when(F.coalesce(F.trim("api_key"), F.lit("")) == "", "empty_key"))).alias("error")).filter("error is not null")
    ids = systems.groupBy("id").count().filter("count > 1").select(F.lit("repeated_id").alias("error"))
    keys = systems.groupBy("api_key").count().filter("count > 1").select(F.lit("repeated_key").alias("error"))
    none = systems.agg(F.coalesce(F.max(F.col("enabled").cast("int")), F.lit(0)).alias("n")).filter("n = 0").select(F.lit("none_enabled").alias("error"))
    return each.union(ids).union(keys).union(none).distinct()
