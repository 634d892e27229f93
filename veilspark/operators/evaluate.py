"""Evaluation: matching of spans, precision and recall, sweeps, and load reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    return ratio(both.cast("double"), ((e1 - s1) + (e2 - s2) - both).cast("double"))


def matched(expected: Column, got: Column, least: float, typed: bool) -> Column:
    """For each expected span in order, the index of the unused one that overlaps best, or -1; arrays of ``struct<type,s,e>``.

    Greedy in order of the expected spans; of equal overlaps the first.
    """

    def step(a: Column, x: Column) -> Column:
        each = F.transform(
            got,
            lambda g, i: F.struct(
                F.when(~F.array_contains(a, i) & ((g["type"] == x["type"]) if typed else F.lit(True)), iou(x["s"], x["e"], g["s"], g["e"])).otherwise(F.lit(-1.0)).alias("v"), (-i).alias("i")
            ),
        )
        best = F.array_max(F.filter(each, lambda b: b["v"] >= least))
        return F.array_append(a, F.coalesce(-best["i"], F.lit(-1)))

    return F.aggregate(expected, F.array().cast("array<int>"), step)


def span_counts(samples: DataFrame, least: float, typed: bool) -> DataFrame:
    """``(type, tp, fp, fn)`` of ``samples(expected, got)``: a row a type, and one for all under the type ``*``."""
    m = samples.withColumn("m", matched(F.col("expected"), F.col("got"), least, typed))
    exp = m.select(F.inline(F.transform("expected", lambda x, i: F.struct(x["type"].alias("type"), (F.get(F.col("m"), i) >= 0).alias("hit")))))
    got = m.select(F.inline(F.transform("got", lambda x, i: F.struct(x["type"].alias("type"), F.array_contains("m", i).alias("hit")))))
    e = exp.select("type", F.col("hit").cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (~F.col("hit")).cast("long").alias("fn"))
    g = got.select("type", F.lit(0).cast("long").alias("tp"), (~F.col("hit")).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    return e.union(g).rollup("type").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).select(F.coalesce("type", F.lit("*")).alias("type"), "tp", "fp", "fn")


def precision_recall(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def confusion(rows: DataFrame, positive: Column, predicted: Column) -> DataFrame:
    c = lambda cond, name: F.count_if(cond).alias(name)
    out = rows.agg(c(positive & predicted, "tp"), c(~positive & predicted, "fp"), c(positive & ~predicted, "fn"), c(~positive & ~predicted, "tn"))
    out = precision_recall(out)
    return out.withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def sweep(rows: DataFrame, score: str, positive: Column, thresholds: tuple[float, ...]) -> DataFrame:
    """Counts for each threshold in one pass: rows meet a list of a few thresholds, not each other."""
    t = F.array(*map(F.lit, sorted(thresholds)))
    r = rows.select(F.col(score).alias("score"), positive.alias("pos"), F.explode(t).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    out = r.groupBy("threshold").agg(F.count_if(F.col("pos") & hit).alias("tp"), F.count_if(~F.col("pos") & hit).alias("fp"), F.count_if(F.col("pos") & ~hit).alias("fn"))
    return precision_recall(out)


def percentiles(rows: DataFrame, value: str, by: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The element at ``floor((n - 1) * p)`` of each group's sorted values, for every ``p``."""
    w = Window.partitionBy(*by)
    r = rows.select(*by, value).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    picks = [F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * p), F.col(value))).alias(f"p{round(p * 100)}") for p in at]
    return r.groupBy(*by).agg(F.count("*").alias("n"), *picks)


def histogram(rows: DataFrame, value: str, by: list[str], buckets: tuple[float, ...]) -> DataFrame:
    """``(by, le, n)``: cumulative counts at each bound, as exporters give them; the last bound is infinite."""
    bounds = F.array(*map(F.lit, (*buckets, float("inf"))))
    least = F.array_min(F.filter(bounds, lambda b: F.col(value) <= b))
    each = rows.groupBy(*by, least.alias("le")).agg(F.count("*").alias("n"))
    full = each.select(*by).distinct().select(*by, F.explode(bounds).alias("le")).join(each, [*by, "le"], "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(*by).orderBy("le"))
    return full.select(*by, "le", total.alias("n"))


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other has not, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def recall_guard(counts: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``counts(type, tp, fn)`` whose recall is below ``least``; any such row fails an evaluation run."""
    return counts.filter(ratio(F.col("tp"), F.col("tp") + F.col("fn")) < least)


def load_summary(calls: DataFrame, by: list[str]) -> DataFrame:
    """``(by, n, success_rate, per_second, p50, p95, p99)`` of ``calls(by, at_s, latency, ok)``; a second's rate is over the span of the calls."""
    p = percentiles(calls, "latency", by).drop("n")
    span = F.max("at_s") - F.min("at_s")
    rates = calls.groupBy(*by).agg(F.count("*").alias("n"), ratio(F.count_if("ok").cast("double"), F.count("*").cast("double")).alias("success_rate"), ratio(F.count("*").cast("double"), span.cast("double")).alias("per_second"))
    return rates.join(p, by)


def load_mix(calls: DataFrame, seed: int = 0, retry: float = 0.15, restore: float = 0.05) -> DataFrame:
    """``calls(seq)`` with ``action``: a keyed draw of retries and restores among plain maskings, the same in every run."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(10_000)) / 10_000
    return calls.withColumn("action", F.when(draw < retry, "retry").when(draw < retry + restore, "restore").otherwise("mask"))
