"""The streaming twins over a file source, all at once."""

import datetime as dt

from veilspark.streaming import state


def test_token_bucket_and_sessions(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, t0 + dt.timedelta(seconds=i), "p", i, "same" if i % 2 else "other") for i in range(5)]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, payload_id string, seq long, payload string").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("user_id long, event_id long, ts timestamp, payload_id string, seq long, payload string").parquet(str(tmp_path / "in"))

    def ran(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = {r["event_id"]: r["allowed"] for r in ran(state.token_bucket(source().select("user_id", "event_id", "ts"), 0.5, 2), "bucket")}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True}
    seen = {r["seq"]: (r["opens"], r["epoch"], r["same_payload"]) for r in ran(state.sessions(source().select("payload_id", "seq", "ts", "payload"), 3), "met")}
    assert seen == {0: (True, 1, True), 1: (False, 1, False), 2: (False, 1, True), 3: (True, 2, True), 4: (False, 2, False)}
