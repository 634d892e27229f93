"""Streaming twins of the keyed state machines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKET_OUT = "user_id long, event_id long, allowed boolean, delay double"
SESSION_OUT = "payload_id string, seq long, opens boolean, epoch int, same_payload boolean"


def token_bucket(requests: DataFrame, rate: float, burst: int) -> DataFrame:
    """A stream of ``(user_id, event_id, ts)`` with what each user's bucket says; state is two numbers a user, gone after it is full again.

    Rows of a trigger are taken in order of time; later triggers do not look back.
    """

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        have, at = state.get if state.exists else (float(burst), None)
        for p in parts:
            out = []
            for row in p.sort_values(["ts", "event_id"]).itertuples():
                now = row.ts.timestamp()
                have = min(float(burst), have + (max(0.0, now - at) if at is not None else 0.0) * rate)
                at = now if at is None else max(at, now)
                ok = have >= 1
                out.append((key[0], row.event_id, ok, 0.0 if ok else (1 - have) / rate))
                have -= ok
            yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "delay"])
        state.update((have, at))
        state.setTimeoutDuration(int(1000 * burst / rate) + 1)

    return requests.groupBy("user_id").applyInPandasWithState(run, BUCKET_OUT, "have double, at double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(requests: DataFrame, ttl_s: int = 900) -> DataFrame:
    """A stream of ``(payload_id, seq, ts, payload)`` with the session each request meets: its number, whether it opens it, and
    whether the payload is the one that did.  State is a hash and a time a payload id, kept for ``ttl_s``.
    """
    hashed = requests.withColumn("hash", F.sha2("payload", 256))

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, since, epoch = state.get if state.exists else (None, None, 0)
        for p in parts:
            out = []
            for row in p.sort_values(["ts", "seq"]).itertuples():
                now = row.ts.timestamp()
                opens = since is None or now >= since + ttl_s
                if opens:
                    first, since, epoch = row.hash, now, epoch + 1
                out.append((key[0], row.seq, opens, epoch, row.hash == first))
            yield pd.DataFrame(out, columns=["payload_id", "seq", "opens", "epoch", "same_payload"])
        state.update((first, since, epoch))
        state.setTimeoutDuration(ttl_s * 1000)

    return hashed.select("payload_id", "seq", "ts", "hash").groupBy("payload_id").applyInPandasWithState(run, SESSION_OUT, "hash string, since double, epoch int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def masked(texts: DataFrame) -> DataFrame:
    """A stream of texts masked by rules: no state, so it is the batch plan."""
    from ..plans.mask import mask

    return mask(texts)
