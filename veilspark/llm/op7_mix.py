"""Mixing sources to target weights by entropy balancing.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is used more often than this, so no source gets more than this multiple of its size.
MOST = 3
#: Documents of one source and size are ranked in sub-groups of about this many rows.
GROUP_ROWS = 512


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, sid, source_size, target)`` from ``(source, size)`` rows.

    The targets are ``min(most * source_size, level * weight)`` with the one level at which they add up to the whole: the fixed
    point of handing the excess of capped sources to the others by weight.  Only one row a source is ordered globally.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = src.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("w", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    everything = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("w"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = F.col("level") <= F.col("cap") / F.col("w")
    found = F.min(F.when(fits, F.struct("at", "level"))).over(everything)["level"]
    return ranked.withColumn("found", F.coalesce(found, F.lit(0.0))).select(
        "source", "sid", "source_size", F.least("cap", F.col("found") * F.col("w")).alias("target")
    )


def _rate(lam: Column, x: Column, most: int) -> Column:
    return F.exp(F.least(lam * x, F.lit(1.0) * F.log(F.lit(float(most)))))


def tilt(hist: DataFrame, state: DataFrame, most: int = MOST, rounds: int = 80, tolerance: float = 1e-7) -> DataFrame:
    """Solve the dual of maximum entropy under one token constraint a source.

    ``hist`` is ``(sid, size, n)``, ``state`` ``(sid, source_size, target, mean)``.  The primal solution is
    ``rate = min(most, exp(lam * size / mean))``; the dual is convex, its gradient ``sum(n * size * rate) - target`` rises
    with ``lam``.  Every round is one distributed aggregate over the histogram: a Newton step, or a bisection where the step
    leaves the bracket that the gradients' signs have given.
    """
    state = cut(
        state.select(
            "*",
            F.lit(0.0).alias("lam"),
            F.lit(float("-inf")).alias("lo"),
            F.lit(float("inf")).alias("hi"),
            # at the cap every rate is the cap; with no target, nothing is taken
            ((F.col("target") <= 0) | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12))).alias("done"),
        )
    )
    x = F.col("size") / F.col("mean")
    inner = F.col("lam") * x < F.log(F.lit(float(most)))
    mass = F.col("n") * F.col("size") * _rate(F.col("lam"), x, most)
    for _ in range(rounds):
        sums = hist.join(state.filter(~F.col("done")).select("sid", "mean", "lam"), "sid").groupBy("sid").agg(
            F.sum(mass).alias("g"), F.sum(F.when(inner, mass * x).otherwise(0.0)).alias("dg")
        )
        both = state.join(sums, "sid", "left").withColumn("g", F.col("g") - F.col("target"))
        lo = F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("hi"))
        both = both.withColumn("lo", lo).withColumn("hi", hi)
        newton = F.when(F.col("dg") > 0, F.col("lam") - F.col("g") / F.col("dg"))
        outward = F.when(F.col("g") < 0, F.col("lam").cast("double") * 2 + 1).otherwise(F.col("lam") * 2 - 1)
        middle = F.when(F.col("lo").isin(float("-inf")) | F.col("hi").isin(float("inf")), outward).otherwise((F.col("lo") + F.col("hi")) / 2)
        # a step is taken only inside the bracket and while it at most doubles an unbounded side
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton) <= F.abs(F.col("lam")) * 8 + 8)
        still = ~F.col("done") & (F.abs(F.col("g")) > F.col("target") * tolerance)
        state = cut(
            both.select(
                "sid", "source_size", "target", "mean",
                F.when(still, F.when(inside, newton).otherwise(middle)).otherwise(F.col("lam")).alias("lam"),
                "lo", "hi", (~still).alias("done"),
            ).coalesce(1)
        )
        if state.filter(~F.col("done")).isEmpty():
            break
    return state


def copies(hist: DataFrame, state: DataFrame, most: int = MOST, passes: int = 5) -> DataFrame:
    """Whole copies for each ``(sid, size)`` group of ``n`` documents: ``(sid, size, n, m)``, ``0 <= m <= most * n``.

    Expected copies are rounded systematically in order of size, then each pass closes what is left to the target with the
    largest sizes that fit.  Windows run over the histogram, whose length is the number of different sizes, not of rows.
    """
    x = F.col("size") / F.col("mean")
    rate = (
        F.when(F.col("size") == 0, F.lit(1.0))
        .when(F.col("target") <= 0, F.lit(0.0))
        .when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), F.lit(float(most)))
        .otherwise(_rate(F.col("lam"), x, most))
    )
    up = Window.partitionBy("sid").orderBy("size")
    g = hist.join(state, "sid").withColumn("e", F.col("n") * F.round(rate, 9))
    c = F.sum("e").over(up)
    g = g.withColumn("m", F.floor(c + 0.5) - F.floor(c - F.col("e") + 0.5))
    g = g.withColumn("m", F.greatest(F.lit(0), F.least(F.col("m"), most * F.col("n"))).cast("long"))
    g = cut(g.select("sid", "size", "n", "target", "m"))
    all_of = Window.partitionBy("sid")
    for _ in range(passes):
        left = F.round(F.col("target") - F.sum(F.col("m") * F.col("size")).over(all_of)).cast("long")
        g = g.withColumn("left", left)
        room = F.when(F.col("left") > 0, most * F.col("n") - F.col("m")).otherwise(F.col("m"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("left"))
        g = g.withColumn("room", F.when(fits, room).otherwise(F.lit(0)).cast("long"))
        down = Window.partitionBy("sid").orderBy(F.col("size").desc())
        used = F.coalesce(F.sum(F.col("room") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        k = F.least(F.col("room"), F.greatest(F.lit(0), F.floor((F.abs("left") - used) / F.greatest("size", F.lit(1)))))
        g = g.withColumn("m", (F.col("m") + F.when(F.col("left") > 0, k).otherwise(-k)).cast("long")).select("sid", "size", "n", "target", "m")
    return g


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, also: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: its id, size, source_size, target and whole ``copies`` (``taken = copies * size``), and the columns ``also``.

    Nulls: a null text has size 0; null sources form one source, last in order.  Empty table: no rows.  Repeated ids
    are separate documents.  A document of size 0 gets one copy, which takes nothing.  Ties in the rounding go by id.
    """
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *also,
        )
    )
    counts = cut(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = targets(counts.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most).withColumnRenamed("source", "s2")
    known = cut(counts.join(goal, F.col("source").eqNullSafe(F.col("s2"))).select("source", "sid", "size", "n", "source_size", "target"))
    hist = known.select("sid", "size", "n")
    mean = known.filter("size > 0").groupBy("sid").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = known.select("sid", "source_size", "target").distinct().join(mean, "sid", "left").withColumn("mean", F.coalesce("mean", F.lit(1.0)))
    m = copies(hist, tilt(hist, state, most), most).select("sid", "size", "n", "m")
    plan = known.select("source", "sid", "size", "source_size", "target").join(m, ["sid", "size"])
    # which documents of a group get the odd copies: by rank within small sub-groups, so no group is one task's work
    d = base.join(plan.withColumnRenamed("source", "s2").withColumnRenamed("size", "z2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2"))).drop("s2", "z2")
    d = d.withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_ROWS)))).withColumn("odd", F.col("m") % F.col("n"))
    subs = d.filter("odd > 0").groupBy("sid", "size", "sub").agg(F.count("*").alias("k"), F.first("odd").alias("o"), F.first("n").alias("of"))
    c = F.sum("k").over(Window.partitionBy("sid", "size").orderBy("sub"))
    subs = subs.withColumn("c", c).select("sid", "size", "sub", (F.floor(F.col("c") * F.col("o") / F.col("of")) - F.floor((F.col("c") - F.col("k")) * F.col("o") / F.col("of"))).alias("more"))
    d = d.join(subs, ["sid", "size", "sub"], "left")
    at = F.row_number().over(Window.partitionBy("sid", "size", "sub").orderBy("doc_id", *also))
    n_copies = (F.floor(F.col("m") / F.col("n")) + (at <= F.coalesce("more", F.lit(0))).cast("long")).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", n_copies.alias("copies"), *also)


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it.

    Rows are told apart by id, text and source together, nulls included, so null and repeated ids are taken like any other; of rows
    that are equal in all three, each gets its own of their copies by rank.
    """
    told = [c for x in (F.col(id_col), F.col(text_col).cast("string"), F.col(source_col).cast("string")) for c in (x, x.isNull())]
    keyed = docs.withColumn("_mix_key", F.xxhash64(*told))
    plan = mix(keyed, id_col, text_col, source_col, also=("_mix_key",), **kw)
    plan = plan.groupBy("_mix_key").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_mix_copies"))
    others = F.to_json(F.struct(*[c for c in docs.columns if c != text_col]))
    rank = F.row_number().over(Window.partitionBy("_mix_key").orderBy(others))
    n = F.get("_mix_copies", F.col("_mix_rank") - 1).cast("int")
    out = keyed.withColumn("_mix_rank", rank).join(plan, "_mix_key")
    return out.withColumn("_mix_at", F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)
