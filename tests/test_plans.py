"""Plans, tokens, restoring, chunks, decoding and state machines against small models in plain Python."""

import random

from pyspark.sql import functions as F

from veilspark.operators import admission, chunk, evaluate, models, observe, plan, policy, session
from veilspark.plans.mask import cascade, mask, unmask
from veilspark.sources import readers


def test_mask_and_restore(spark):
    texts = ["почта a@b.ru и c@d.ru, снова a@b.ru <b> x", "ИНН 7707083893 <INN_1> тут", "ничего", "", "тел +7 912 345 67 89"]
    d = mask(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in unmask(d).collect()}
    assert got[0]["masked"] == "почта <EMAIL_1> и <EMAIL_2>, снова <EMAIL_1> <b> x" and got[0]["restored"] == texts[0]
    assert got[1]["masked"] == "ИНН <INN_2> <INN_1> тут" and got[1]["unknown"] == "<INN_1>" and got[1]["restored"] is None
    assert all(got[i]["restored"] == texts[i] for i in (2, 3, 4))
    only = mask(spark.createDataFrame([(1, texts[4] + " a@b.ru")], "doc_id long, text string"), kinds=F.array(F.lit("email"))).first()
    assert only["masked"] == "тел +7 912 345 67 89 <EMAIL_1>"


def test_painting_keeps_coverage(spark):
    r = random.Random(4)
    text = "".join(r.choice("abcdef") for _ in range(60))
    kinds = ["phone", "full_name", "city", "region"]
    rows = []
    for doc in range(40):
        for _ in range(r.randint(1, 7)):
            s = r.randint(0, 50)
            e = s + r.randint(1, 9)
            rows.append((doc, s, e, r.choice(kinds), text[s:e], r.choice(["ml", "regex"]), r.randint(0, 10) / 10))
    d = spark.createDataFrame(rows, "doc_id long, s int, e int, kind string, original string, source string, confidence double")
    got = {}
    for x in plan.combined(d.filter("source = 'ml'"), d.filter("source = 'regex'")).collect():
        assert x["original"] == text[x["s"] : x["e"]]
        got.setdefault(x["doc_id"], []).append((x["s"], x["e"], x["kind"]))
    weight = {"phone": 2, "full_name": 2, "city": 1, "region": 0}
    for doc in range(40):
        own = sorted({x[1:] for x in rows if x[0] == doc}, key=lambda x: (-weight[x[2]], x[4] != ("regex" if x[2] == "phone" else "ml"), -x[5], x[0] - x[1], x[0], x[1], x[2], x[4]))
        cells = {}
        for x in own:
            for i in range(x[0], x[1]):
                cells.setdefault(i, x[2])
        assert {i: k for s, e, k in got[doc] for i in range(s, e)} == cells
        assert sum(e - s for s, e, _ in got[doc]) == len(cells)


def test_numbers_and_apply(spark):
    text = "ab <CITY_1> cd ab"
    d = spark.createDataFrame([(1, 0, 2, "city", "ab", "ml", 1.0), (1, 12, 14, "city", "cd", "ml", 1.0), (1, 15, 17, "city", "ab", "ml", 1.0)], "doc_id long, s int, e int, kind string, original string, source string, confidence double")
    docs = spark.createDataFrame([(1, text), (2, "same")], "doc_id long, text string")
    out = {r["doc_id"]: r["masked"] for r in plan.applied(plan.numbered(d.join(docs, "doc_id")), docs).collect()}
    assert out == {1: "<CITY_2> <CITY_1> <CITY_3> <CITY_2>", 2: "same"}
    bad = d.join(docs, "doc_id").withColumn("original", F.lit("zz"))
    assert {r["violation"] for r in plan.violations(bad).collect()} == {"text_differs"}


def test_chunks_cover_the_text(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("абв .?!\n🎉x") * r.randint(1, 9) for _ in range(r.randint(0, 400))) for _ in range(20)] + ["", None, "x" * 1000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {}
    for x in chunk.chunked(d).orderBy("doc_id", "chunk_ix").collect():
        by.setdefault(x["doc_id"], []).append(x)
    for i, t in enumerate(texts):
        parts, at = by.get(i, []), 0
        for k, x in enumerate(parts):
            assert x["chunk_ix"] == k and x["text"] == t[x["start_cp"] : x["end_cp"]] and len(x["text"]) <= 350 and x["start_cp"] in (at, at - 50)
            at = x["end_cp"]
        assert at == len(t or "")


def test_decode_merge_and_repair(spark):
    tags = [(1, "A", i, 3 * i, 3 * i + 2, t) for i, t in enumerate([2, 2, 1, 0, 2, 2, 1, 1])]
    d = spark.createDataFrame(tags, "doc_id long, type string, tok long, start int, end int, tag int")
    assert sorted((r["start"], r["end"]) for r in models.bio_decode(d).collect()) == [(0, 5), (6, 8), (12, 17), (18, 20), (21, 23)]
    s = spark.createDataFrame([(1, "A", 0, 4), (1, "A", 3, 6), (1, "A", 6, 8), (1, "B", 1, 9), (1, "A", 0, 4)], "doc_id long, type string, start int, end int")
    assert sorted((r["type"], r["start"], r["end"]) for r in models.merge_overlaps(s).collect()) == [("A", 0, 6), ("A", 6, 8), ("B", 1, 9)]
    t = "карта 4111 1111 1111 1111, код один два три, Иванова; 12.05.2010"
    at = lambda x: (t.index(x), t.index(x) + len(x))
    got = models.repaired(t, [("CARD_NUMBER", *at("1111 1111")), ("CVV", *at("два")), ("FULL_NAME", *at("Иванов")), ("DATE_OF_BIRTH", *at("05.2010")), ("PIN", *at("2010"))])
    assert {(k, t[s:e]) for k, s, e in got} == {("CARD_NUMBER", "4111 1111 1111 1111"), ("CVV", "один два три"), ("FULL_NAME", "Иванова"), ("DATE_OF_BIRTH", "12.05.2010"), ("PIN", "2010")}


def test_model_adapter(spark):
    def detector(text, gate_text):
        if "boom" in text:
            raise ValueError
        return models.lexicon_detector({"Иван": "full_name"})(text, gate_text)

    d = spark.createDataFrame([(1, 10, "Иван тут", "Иван тут"), (2, 0, "boom", "boom"), (3, 0, "Иван", "  ")], "doc_id long, start_cp int, text string, gate_text string")
    got = models.detect_chunks(d, detector)
    assert {(r["doc_id"], r["error_code"]) for r in got.collect()} == {(1, "NONE"), (2, "MODEL_ERROR"), (3, "NONE")}
    assert [tuple(r)[:4] for r in models.to_document(got).collect()] == [(1, "FULL_NAME", 10, 14)]


def test_sessions(spark):
    key, schema = "c", "consumer_id string, payload_id string, seq long, ts timestamp, payload string, mask_kinds array<string>, detok_allowed boolean"
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    first = "пишите a@b.ru"
    rows = [("p", 1, 0, first, None), ("p", 2, 60, first, None), ("p", 3, 70, "ответ для <EMAIL_1>", None), ("p", 4, 80, "нет", None), ("p", 5, 90, "<EMAIL_9>", None), ("p", 6, 95, first, ["email"]), ("p", 7, 901, "новое c@d.ru", None), ("q", 1, 0, "x", None)]
    r = spark.createDataFrame([(key, p, s, t0 + dt.timedelta(seconds=t), x, k, True) for p, s, t, x, k in rows], schema)
    opens = mask(session.with_epochs(r).filter("opens").select("consumer_id", "payload_id", "seq", F.col("payload").alias("text")))
    got = {(x["payload_id"], x["seq"]): (x["outcome"], x["result"]) for x in session.outcomes(r, opens.select("consumer_id", "payload_id", "seq", "masked", "mappings")).collect()}
    assert got[("p", 1)] == ("masked", "пишите <EMAIL_1>") == (got[("p", 2)][0].replace("retried", "masked"), got[("p", 2)][1])
    assert got[("p", 3)] == ("detokenized", "ответ для a@b.ru")
    assert [got[("p", i)][0] for i in (4, 5, 6, 7)] == ["conflict", "unknown_token", "conflict", "masked"]


def test_token_bucket(spark):
    r = random.Random(2)
    rows = [(u, i, 1000 + sum(r.choice([0, 1, 5]) for _ in range(i % 9))) for u in range(3) for i in range(30)]
    d = spark.createDataFrame(rows, "user_id long, seq long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {(x["user_id"], x["seq"]): (x["allowed"], round(x["delay"], 9)) for x in admission.token_bucket(d, 0.5, 2).collect()}
    for u in range(3):
        have, at = 2.0, None
        for _, i, t in sorted((x for x in rows if x[0] == u), key=lambda x: (x[2], x[1])):
            have = min(2.0, have + (0 if at is None else t - at) * 0.5)
            at = t
            ok = have >= 1
            assert got[(u, i)] == (ok, 0.0 if ok else round((1 - have) / 0.5, 9))
            have -= ok
    assert d.select(admission.retry_after(F.lit(0.2)), admission.request_id_valid(F.lit("a-1.b")), admission.request_id_valid(F.lit("a b"))).first()[:] == (1, True, False)


def test_policies_and_requests(spark):
    systems = spark.createDataFrame([("a", True, "k1", None, None), ("b", True, "k2", ["phone"], False), ("c", False, "k3", [], None)], readers.SYSTEMS)
    p = policy.policies(systems)
    assert p.filter("consumer_id = 'a'").count() == len(plan.ALL_KINDS) == 27 and p.filter("consumer_id = 'c'").count() == 0
    r = spark.createDataFrame([(1, "b", ["phone"]), (2, "b", ["email"]), (3, "b", ["zzz", "email"]), (4, "x", None), (5, "a", None), (6, "a", [])], "n int, consumer_id string, mask_kinds array<string>")
    got = {x["n"]: (x["error"], None if x["effective_kinds"] is None else len(x["effective_kinds"])) for x in policy.narrowed(r, p).collect()}
    assert got == {1: (None, 1), 2: ("policy_rejected", None), 3: ("invalid_kind", None), 4: ("policy_rejected", None), 5: (None, 27), 6: (None, 0)}
    bodies = [('{"payload":"x","payload_id":"1"}', 200), ('{"payload":"x","payload_id":""}', 400), ('{"payload_id":"1"}', 400), ('{"payload":"x","payload_id":"1"} z', 400), ("[]", 400), (' {"payload":"","payload_id":"1","mask_kinds":[],"more":1} \n', 200), ("nonsense", 400)]
    out = readers.requests(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "i int, body string")).collect()
    assert [x["status"] for x in sorted(out, key=lambda x: x["i"])] == [s for _, s in bodies]
    assert [x["error"] for x in policy.system_errors(systems.unionByName(systems.filter("id = 'a'"))).orderBy("error").collect()] == ["repeated_id", "repeated_key"]


def test_evaluation(spark):
    span = "array<struct<type:string,s:int,e:int>>"
    d = spark.createDataFrame([([("A", 0, 10), ("B", 20, 30)], [("A", 1, 10), ("A", 0, 10), ("C", 40, 50)]), ([], [])], f"expected {span}, got {span}")
    by = {r["type"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.span_counts(d, 0.5, True).collect()}
    assert by == {"A": (1, 1, 0), "B": (0, 0, 1), "C": (0, 1, 0), "*": (1, 2, 1)}
    v = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "k string, v double")
    assert evaluate.percentiles(v, "v", ["k"]).first()[:] == ("a", 100, 50.0, 95.0, 99.0)
    h = {r["le"]: r["n"] for r in evaluate.histogram(v, "v", ["k"], (1.0, 50.0)).collect()}
    assert h == {1.0: 1, 50.0: 50, float("inf"): 100}
    lines = observe.exposition(spark.createDataFrame([("GET", 3)], "method string, n long"), "requests_total").collect()
    assert lines[0]["line"] == 'requests_total{method="GET"} 3'


def test_scheduler_replay(spark):
    jobs = spark.createDataFrame([(0, i, float(i), 350, 50.0, 2.0) for i in range(40)], "replica int, seq long, at_ms double, code_points int, quality_ms double, fast_ms double")
    got = [r["reason"] for r in models.replay_scheduler(jobs).orderBy("seq").collect()]
    assert got[0] == "normal" and "quality_budget" in got and got[-1] in ("hold", "quality_budget", "recovery_probe")


def test_cascade_combines_rules_and_model_and_fails_closed(spark):
    d = spark.createDataFrame([(1, "c", "пишите a@b.ru, Москва ждёт. Москва!"), (2, "c", "сбой BOOM тут a@b.ru"), (3, "c", None), (4, "none", "a@b.ru Москва"), (5, "c", "пусто")], "doc_id long, consumer_id string, text string")
    words = models.lexicon_detector({"Москва": "city"})

    def detector(text, gate):
        if "BOOM" in text:
            raise RuntimeError("no model")
        return words(text, gate)

    policy = spark.createDataFrame([("c", "city", 0.5), ("c", "email", 0.5)], "consumer_id string, kind string, min_confidence double")
    got = {r["doc_id"]: (r["masked"], r["error"]) for r in cascade(d, detector, policy).collect()}
    assert got == {1: ("пишите <EMAIL_1>, <CITY_1> ждёт. <CITY_1>!", None), 2: (None, "unavailable"), 3: (None, "no_text"), 4: ("a@b.ru Москва", None), 5: ("пусто", None)}


def test_responses_are_joined_by_id(spark):
    c = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "doc_id long, chunk_ix int")
    r = spark.createDataFrame([(1, 0, "NONE", []), (1, 1, "MODEL_ERROR", None), (2, 0, "NONE", []), (2, 0, "NONE", [])], f"doc_id long, chunk_ix int, error_code string, entities {models.ENTITIES}")
    got = {(x["doc_id"], x["chunk_ix"]): (x["failure"], x["entities"]) for x in models.joined_responses(c, r).collect()}
    assert got == {(1, 0): (None, []), (1, 1): ("unavailable", None), (2, 0): ("unavailable", None), (3, 0): ("unavailable", None)}


def test_windows_types_status_and_load(spark):
    text = "a" * 890 + ". " + "b" * 30 + "\n" + "c" * 1000
    got = [(r["s"], r["e"]) for r in models.character_windows(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("window_ix").collect()]
    assert got == [(0, 892), (892, 923), (923, 1823), (1823, len(text))]
    e = spark.createDataFrame([([("B", 3, 4, 0.5), ("A", 3, 4, 0.5), ("C", 0, 1, 0.5)],)], f"e {models.ENTITIES}")
    assert [x["type"] for x in e.select(models.enabled(F.col("e"), ("A", "B")).alias("e")).first()["e"]] == ["A", "B"]
    codes = spark.createDataFrame([(x,) for x in ("OK", "UNAVAILABLE", "RESOURCE_EXHAUSTED", "DEADLINE_EXCEEDED", "INTERNAL")], "c string")
    assert [r[0] for r in codes.select(models.wire_status(F.col("c"))).collect()] == ["ok", "unavailable", "unavailable", "timeout", "error"]
    calls = spark.createDataFrame([("a", float(i), float(i), i % 4 != 0) for i in range(101)], "k string, at_s double, latency double, ok boolean")
    s = evaluate.load_summary(calls, ["k"]).first()
    assert (s["n"], s["p50"], s["p95"], round(s["success_rate"], 6), round(s["per_second"], 6)) == (101, 50.0, 95.0, round(75 / 101, 6), 1.01)
    mix = {r["action"]: r["count"] for r in evaluate.load_mix(spark.range(20000).select(F.col("id").alias("seq"))).groupBy("action").count().collect()}
    assert abs(mix["retry"] - 3000) < 300 and abs(mix["restore"] - 1000) < 200
    low = evaluate.recall_guard(spark.createDataFrame([("x", 1, 3), ("y", 1, 1)], "type string, tp long, fn long")).collect()
    assert [r["type"] for r in low] == ["x"]


def test_limits_of_each_key_and_long_histories(spark):
    r = spark.range(40000).select((F.col("id") % 3).alias("user_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") / 100).alias("ts"))
    limits = spark.createDataFrame([(0, 1.0, 5), (1, 2.0, 1)], "user_id long, rate double, burst int")
    got = admission.limited(r, limits).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("allowed").alias("a")).orderBy("user_id").collect()
    assert got[2]["a"] == got[2]["n"] and abs(got[0]["a"] - 404) <= 1 and 780 <= got[1]["a"] <= 801


def test_places_in_both_directions(spark):
    from veilspark.operators import normalize

    texts = ["a  b\t\n c", "  x   y  ", "plain", "ж  é —   z"]
    for t in texts:
        kept = [i for i, c in enumerate(t) if not (i and c.isspace() and t[i - 1].isspace())]
        d = normalize.with_normalized(spark.createDataFrame([(t,)], "text string"))
        fwd = d.select(F.transform(F.sequence(F.lit(0), F.length("norm") - 1), lambda j: normalize.original_place(F.col("kept"), j))).first()[0]
        assert fwd == kept
        back = d.select(F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda j: normalize.normalized_place(F.col("kept"), j))).first()[0]
        assert back == [min([j for j, k in enumerate(kept) if k >= i], default=len(kept)) for i in range(len(t))]
        n = len(t.encode())
        byte = spark.range(n + 1).select(normalize.place_of_byte(F.lit(t), F.col("id").cast("int"))).collect()
        starts = [len(t[:k].encode()) for k in range(len(t))]
        assert [b[0] for b in byte] == [sum(s < i for s in starts) for i in range(n + 1)]
