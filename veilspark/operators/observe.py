"""Observability: labels, counters, histograms and the audit row of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What labels may be.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
ROUTES = ("/process", "/health", "/ready", "/metrics")
LABEL_KINDS = (
    "full_name", "first_name", "last_name", "patronymic", "address", "city", "street", "house", "apartment", "place_of_birth", "citizenship",
    "passport_issuer", "cardholder_name", "email", "phone", "inn", "card", "passport", "department_code", "date", "driver_license", "cvv", "pin", "postal_code",
)
OUTCOMES = ("masked", "retried", "detokenized", "conflict", "unavailable", "timeout", "invalid_kind", "policy_rejected", "demasking_disabled", "unknown_token")
CASCADE_ROUTES = ("ml", "rule", "safe")


def method_label(m: Column) -> Column:
    return F.when(m.isin("GET", "POST"), m).otherwise("OTHER")


def listed(value: Column, names: tuple[str, ...], other: str = "unknown") -> Column:
    return F.when(value.isin(*names), value).otherwise(other)


def status_label(code: Column) -> Column:
    """A status of 100 to 599 as text; the first write wins and none means 200."""
    c = F.coalesce(code, F.lit(200))
    return F.when(c.between(100, 599), c.cast("string")).otherwise("unknown")


def request_counters(requests: DataFrame) -> DataFrame:
    """``(method, route, status, n)``."""
    r = requests.select(method_label(F.col("method")).alias("method"), listed(F.col("route"), ROUTES).alias("route"), status_label(F.col("status")).alias("status"))
    return r.groupBy("method", "route", "status").agg(F.count("*").alias("n"))


def kind_counters(mappings: DataFrame) -> DataFrame:
    """``(kind, n)`` over exploded mappings; kinds without a label are ``unknown``."""
    return mappings.groupBy(listed(F.col("kind"), LABEL_KINDS).alias("kind")).agg(F.count("*").alias("n"))


def kinds_seen(mappings: Column) -> Column:
    """Distinct kinds in order of appearance."""
    return F.array_distinct(F.transform(mappings, lambda m: m["kind"]))


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(listed(F.col("outcome"), OUTCOMES).alias("outcome")).agg(F.count("*").alias("n"))


def audit(rows: DataFrame) -> DataFrame:
    """The completion log of ``(request_id, method, route, status, duration_ms, outcome, consumer_id, mappings, ml_invoked)``; never a payload."""
    return rows.select(
        "request_id", method_label(F.col("method")).alias("method"), listed(F.col("route"), ROUTES).alias("route"), status_label(F.col("status")).alias("status"), "duration_ms",
        F.when(F.col("outcome").isin("masked", "retried", "detokenized"), "").otherwise(F.col("outcome")).alias("error_class"), "consumer_id",
        F.coalesce(F.size("mappings"), F.lit(0)).alias("pii_count"), F.array_join(kinds_seen(F.col("mappings")), ",").alias("pii_types"), "ml_invoked",
    )


def exposition(counters: DataFrame, name: str) -> DataFrame:
    """Counter rows as lines of the text format, labels in column order; the last column is the value."""
    *labels, value = counters.columns
    parts = [F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels]
    return counters.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("line"))
