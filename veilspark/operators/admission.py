"""Admission control, replayed over recorded requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import ordered_fold


def token_bucket(requests: DataFrame, rate: float, burst: int, key: str = "user_id") -> DataFrame:
    """``(key, seq, allowed, delay)`` for ``(key, seq, ts)``: tokens come back at ``rate`` a second up to ``burst``; a denial says how long to wait."""
    return _buckets(requests.select(key, "seq", "ts", F.lit(float(rate)).alias("rate"), F.lit(float(burst)).alias("burst")), key)


def _buckets(requests: DataFrame, key: str) -> DataFrame:
    kind = requests.schema[key].dataType.simpleString()

    def step(state, row):
        have, at = state
        _, seq, t, rate, burst = row
        have = burst if at is None else min(burst, have + (t - at) * rate)
        if have >= 1:
            return (have - 1, t), (row[0], seq, True, 0.0)
        return (have, t), (row[0], seq, False, (1 - have) / rate)

    rows = requests.select(key, F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("t"), "rate", "burst")
    return ordered_fold(rows, [key], ["t", "seq"], lambda: (0.0, None), step, f"{key} {kind}, seq long, allowed boolean, delay double")


def limited(requests: DataFrame, limits: DataFrame, key: str = "user_id") -> DataFrame:
    """As :func:`token_bucket` with ``limits(key, rate, burst)``; keys without a limit are always let through."""
    known = requests.join(limits.select(key, F.col("rate").cast("double").alias("rate"), F.col("burst").cast("double").alias("burst")), key, "left")
    free = known.filter("rate is null").select(key, F.col("seq").cast("long").alias("seq"), F.lit(True).alias("allowed"), F.lit(0.0).alias("delay"))
    return free.union(_buckets(known.filter("rate is not null").select(key, "seq", "ts", "rate", "burst"), key))


def retry_after(delay: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(delay)).cast("int")


def in_flight(calls: DataFrame, key: str | None = None) -> DataFrame:
    """``(key, ts, active)`` after every start and end of ``(key, start_ts, end_ts)``: a sweep of +1 and -1, ends before starts."""
    k = F.col(key) if key else F.lit(0)
    marks = calls.select(k.alias("key"), F.explode(F.array(F.struct(F.col("start_ts").alias("ts"), F.lit(1).alias("d")), F.struct(F.col("end_ts").alias("ts"), F.lit(-1).alias("d")))).alias("m")).select("key", "m.ts", "m.d")
    net = marks.groupBy("key", "ts").agg(F.sum("d").alias("d"))
    return net.select("key", "ts", F.sum("d").over(Window.partitionBy("key").orderBy("ts")).alias("active"))


def body_fits(payload: Column, most: int = 1 << 20) -> Column:
    return F.octet_length(payload) <= most


def request_id_valid(request_id: Column) -> Column:
    return F.coalesce(request_id.rlike(r"^[A-Za-z0-9._\-]{1,64}\z"), F.lit(False))
