"""Sessions: mask once, repeat it, or restore, by the same payload id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import ordered_fold
from .plan import detokenized
from .policy import same_kinds

TTL_S = 15 * 60
#: How outcomes appear as HTTP status; what is not listed is 500.
STATUS = {"masked": 200, "retried": 200, "detokenized": 200, "unavailable": 503, "timeout": 503, "invalid_kind": 400, "policy_rejected": 403, "demasking_disabled": 403}


def with_epochs(requests: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """``requests`` with ``epoch`` and ``opens``: which session of its payload id a request meets, and whether it makes it.

    A session lives ``ttl_s`` from its first request, whatever follows.  Which request starts the next one depends on the one before,
    so the epochs of an id are found by an ordered fold over its own times.
    """
    key = ["consumer_id", "payload_id"]
    kinds = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in key)

    def step(state, row):
        opened, n = state
        new = opened is None or row.t >= opened + ttl_s
        state = (row.t, n + 1) if new else state
        return state, (row.consumer_id, row.payload_id, row.seq, state[1], new)

    times = requests.select(*key, F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("t"))
    rows = ordered_fold(times, key, ["t", "seq"], lambda: (None, 0), step, f"{kinds}, seq long, epoch int, opens boolean")
    return requests.join(rows, [*key, "seq"])


def outcomes(requests: DataFrame, masked: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """``(consumer_id, payload_id, seq, outcome, result)`` for ``(consumer_id, payload_id, seq, ts, payload, mask_kinds, detok_allowed)``.

    ``masked``: ``(consumer_id, payload_id, seq, masked, mappings)`` of the requests that open a session.  The same payload is a retry and
    needs the same kinds; another one is restored if it holds tokens, all of them known.
    """
    r = with_epochs(requests, ttl_s)
    key = ["consumer_id", "payload_id", "epoch"]
    first = r.filter("opens").join(masked, ["consumer_id", "payload_id", "seq"], "left")
    first = first.select(*key, F.sha2("payload", 256).alias("_hash"), F.col("mask_kinds").alias("_kinds"), F.col("masked").alias("_masked"), F.col("mappings").alias("_maps"))
    r = r.join(first, key)
    same = F.sha2("payload", 256) == F.col("_hash")
    restored, unknown = detokenized(F.col("payload"), F.col("_maps"))
    shaped = F.col("payload").rlike("<[A-Z_]+_[0-9]+>")
    outcome = (
        F.when(F.col("_masked").isNull(), "unavailable")
        .when(F.col("opens"), "masked")
        .when(same & ~same_kinds(F.col("mask_kinds"), F.col("_kinds")), "conflict")
        .when(same, "retried")
        .when(~shaped, "conflict")
        .when(~F.col("detok_allowed"), "demasking_disabled")
        .when(unknown.isNotNull(), "unknown_token")
        .otherwise("detokenized")
    )
    r = r.withColumn("outcome", outcome)
    result = F.when(F.col("outcome").isin("masked", "retried"), F.col("_masked")).when(F.col("outcome") == "detokenized", restored)
    return r.select("consumer_id", "payload_id", "seq", "outcome", result.alias("result"))


def status(outcome: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, outcome), F.lit(500))


def admitted(sessions: DataFrame, capacity: int, ttl_s: int = TTL_S) -> DataFrame:
    """``sessions(payload_id, seq, at)`` with ``stored``: whether the store had room.

    The capacity is one number for the whole store, so this needs one global order: it is a replay for a single store of bounded size,
    partitioned by ``store`` where there are several.
    """

    def step(live, row):
        if len(live) >= capacity or live.get(row.payload_id, row.at + 1) <= row.at:
            live = {k: t for k, t in live.items() if t > row.at}
        ok = row.payload_id not in live and len(live) < capacity
        if ok:
            live[row.payload_id] = row.at + ttl_s
        return live, (row.store, row.payload_id, row.seq, ok)

    rows = sessions.select(F.col("store").cast("long").alias("store"), F.col("payload_id").cast("string").alias("payload_id"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"))
    return ordered_fold(rows, ["store"], ["at", "seq"], dict, step, "store long, payload_id string, seq long, stored boolean")
