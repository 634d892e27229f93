"""Around models: pluggable detectors, decoding of tags, repair of spans, response checks and the routing scheduler."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types of the model in order, other names for them, their names on the wire and what those mean to the rules.
MODEL_TYPES = (
    "FULL_NAME", "DATE_OF_BIRTH", "BIRTH_PLACE", "PASSPORT", "CITIZENSHIP", "PASSPORT_ISSUER", "DEPARTMENT_CODE", "PASSPORT_ISSUE_DATE",
    "DRIVER_LICENSE", "ADDRESS", "COUNTRY", "POSTCODE", "CITY", "STREET", "HOUSE", "APARTMENT", "EMAIL", "PHONE", "INN", "CARD_NUMBER", "CVV",
    "PIN", "CARDHOLDER_NAME", "REGION", "DISTRICT",
)
ALIASES = {
    "NAME": "FULL_NAME", "PERSON": "FULL_NAME", "FIRST_NAME": "FULL_NAME", "LAST_NAME": "FULL_NAME", "MIDDLE_NAME": "FULL_NAME",
    "PHONE_NUMBER": "PHONE", "CREDIT_CARD": "CARD_NUMBER", "BANK_CARD_NUMBER": "CARD_NUMBER", "PASSPORT_NUMBER": "PASSPORT", "CVC": "CVV",
    "BIRTH_DATE": "DATE_OF_BIRTH", "DATE": "DATE_OF_BIRTH", "POSTAL_CODE": "POSTCODE", "CARD": "CARD_NUMBER", "PLACE_OF_BIRTH": "BIRTH_PLACE",
}
TYPE_OF_WIRE = {
    "full_name": "FULL_NAME", "first_name": "FULL_NAME", "last_name": "FULL_NAME", "patronymic": "FULL_NAME", "address": "ADDRESS", "city": "CITY",
    "street": "STREET", "house": "HOUSE", "apartment": "APARTMENT", "postal_code": "POSTAL_CODE", "postcode": "POSTAL_CODE", "country": "COUNTRY",
    "region": "REGION", "district": "DISTRICT", "place_of_birth": "BIRTH_PLACE", "citizenship": "CITIZENSHIP", "passport_issuer": "PASSPORT_ISSUER",
    "cardholder_name": "CARDHOLDER_NAME", "email": "EMAIL", "phone": "PHONE", "inn": "INN", "passport": "PASSPORT", "department_code": "DEPARTMENT_CODE",
    "driver_license": "DRIVER_LICENSE", "cvv": "CVV", "pin": "PIN", "card": "CARD_NUMBER", "date": "BIRTH_DATE", "date_of_birth": "BIRTH_DATE",
    "passport_issue_date": "PASSPORT_ISSUE_DATE",
}
ERROR_CODES = ("NONE", "MODEL_ERROR", "INVALID_INPUT", "CANCELLED")
ENTITIES = "array<struct<type:string,start:int,end:int,confidence:float>>"
GATE_THRESHOLD = 1.8237e-7

Detector = Callable[[str, str], list[tuple[str, int, int, float]]]


def lexicon_detector(words: dict[str, str]) -> Detector:
    """A stand-in for a model: tags the words of a lexicon.  It is deterministic and learns nothing."""
    rx = re.compile("|".join(rf"\b{re.escape(w)}\b" for w in sorted(words, key=len, reverse=True)) or "(?!)")

    def detect(text: str, _: str) -> list[tuple[str, int, int, float]]:
        return [(words[m.group()], m.start(), m.end(), 0.9) for m in rx.finditer(text)]

    return detect


def detect_chunks(chunks: DataFrame, detector: Detector) -> DataFrame:
    """``chunks`` (with ``text`` and ``gate_text``) with ``entities`` and ``error_code``; a failure is an error of its chunk, never an empty result.

    A blank gate text asks for no model.
    """

    @F.pandas_udf(f"struct<entities:{ENTITIES},error_code:string>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gates in parts:
            found, codes = [], []
            for t, g in zip(texts, gates):
                try:
                    got = detector(t, g) if t is not None and (g or "").strip() else []
                    found.append([dict(zip(("type", "start", "end", "confidence"), x)) for x in got])
                    codes.append("NONE")
                except Exception:  # noqa: BLE001  a model may fail in any way; the row says so
                    found.append(None)
                    codes.append("MODEL_ERROR")
            yield pd.DataFrame({"entities": found, "error_code": codes})

    return chunks.withColumn("_m", run("text", "gate_text")).select(*chunks.columns, F.col("_m.entities").alias("entities"), F.col("_m.error_code").alias("error_code"))


def response_violations(results: DataFrame, model_version: str) -> DataFrame:
    """Results that break the contract, with ``violation``: ``(batch_id, chunk_id, model_version, error_code, entities, text)``."""
    e = F.coalesce("entities", F.array().cast(ENTITIES))
    repeated = F.count("*").over(Window.partitionBy("batch_id", "chunk_id")) > 1
    v = (
        F.when(F.coalesce(F.trim("batch_id"), F.lit("")) == "", "empty_batch_id")
        .when(F.coalesce(F.trim("chunk_id"), F.lit("")) == "", "empty_chunk_id")
        .when(repeated, "repeated_chunk_id")
        .when(~F.col("model_version").eqNullSafe(F.lit(model_version)), "model_version")
        .when(~F.coalesce(F.col("error_code").isin(*ERROR_CODES), F.lit(False)), "unknown_error_code")
        .when((F.col("error_code") != "NONE") & (F.size(e) > 0), "entities_with_error")
        .when(F.exists(e, lambda x: ~F.coalesce(x["type"].isin(*TYPE_OF_WIRE), F.lit(False))), "unknown_type")
        .when(F.exists(e, lambda x: F.isnan(x["confidence"]) | (x["confidence"] < 0) | (x["confidence"] > 1)), "confidence")
        .when(F.exists(e, lambda x: (x["start"] < 0) | (x["start"] >= x["end"]) | (x["end"] > F.length("text"))), "span")
    )
    return results.withColumn("violation", v).filter("violation is not null")


def request_violations(items: DataFrame, max_bytes: int = 1400, max_code_points: int = 350, max_items: int = 32) -> DataFrame:
    """Items of a batch request that a server refuses: ``(batch_id, chunk_id, text, gate_text)``."""
    by_batch = Window.partitionBy("batch_id")
    v = (
        F.when(F.coalesce("batch_id", F.lit("")) == "", "empty_batch_id")
        .when(F.coalesce("chunk_id", F.lit("")) == "", "empty_chunk_id")
        .when(F.count("*").over(Window.partitionBy("batch_id", "chunk_id")) > 1, "repeated_chunk_id")
        .when(F.count("*").over(by_batch) > max_items, "too_many_items")
        .when(F.col("gate_text").isNull(), "no_gate_text")
        .when(F.octet_length("gate_text") != F.octet_length("text"), "gate_length")
        .when(F.octet_length("text") > max_bytes, "too_many_bytes")
        .when(F.length("text") > max_code_points, "too_many_code_points")
    )
    return items.withColumn("violation", v).filter("violation is not null")


def to_document(results: DataFrame) -> DataFrame:
    """``(doc_id, type, s, e, confidence)``: chunk entities at places of the whole text, under the rules' types."""
    from .plan import mapped

    one = results.select("doc_id", "start_cp", F.explode("entities").alias("x"))
    return one.select("doc_id", mapped(TYPE_OF_WIRE, F.col("x.type")).alias("type"), (F.col("start_cp") + F.col("x.start")).alias("s"), (F.col("start_cp") + F.col("x.end")).alias("e"), F.col("x.confidence").cast("double").alias("confidence"))


def gate_max(logits: DataFrame) -> DataFrame:
    """``(doc_id, score)``: the largest sigmoid over a text's windows; logits that are not finite are an error."""
    bad = F.isnan("logit") | (F.abs("logit") == float("inf"))
    one = F.when(bad, F.raise_error(F.lit("non-finite gate output")).cast("double")).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-80.0), F.least(F.lit(80.0), F.col("logit"))))))
    return logits.groupBy("doc_id").agg(F.max(one).alias("score"))


def bio_decode(tags: DataFrame) -> DataFrame:
    """``(doc_id, type, start, end)`` from ``(doc_id, type, tok, start, end, tag)``: 1 begins, 2 goes on, 0 or an empty token ends.

    A 2 without an open span begins one.  Gaps and islands: a begin flag's running sum names the span.
    """
    w = Window.partitionBy("doc_id", "type").orderBy("tok")
    t = tags.withColumn("_in", (F.col("tag") != 0) & (F.col("end") > F.col("start")))
    begins = F.col("_in") & ((F.col("tag") == 1) | ~F.coalesce(F.lag("_in").over(w), F.lit(False)))
    t = t.withColumn("_span", F.sum(begins.cast("int")).over(w)).filter("_in")
    return t.groupBy("doc_id", "type", "_span").agg(F.min_by("start", "tok").alias("start"), F.max_by("end", "tok").alias("end")).drop("_span")


def merge_overlaps(spans: DataFrame) -> DataFrame:
    """Distinct spans of a type, those that overlap made one; touching ones stay apart."""
    w = Window.partitionBy("doc_id", "type").orderBy("start", "end")
    s = spans.select("doc_id", "type", "start", "end").distinct()
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    return s.groupBy("doc_id", "type", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


# Fixed values of the repair.
NUMERIC = frozenset({"PASSPORT", "DRIVER_LICENSE", "INN", "CARD_NUMBER", "CVV", "PIN", "PHONE", "DEPARTMENT_CODE", "POSTCODE", "HOUSE", "APARTMENT"})
DATE_TYPES = frozenset({"DATE_OF_BIRTH", "PASSPORT_ISSUE_DATE"})
WORD_TYPES = frozenset({"FULL_NAME", "CARDHOLDER_NAME", "CITY", "COUNTRY", "CITIZENSHIP", "BIRTH_PLACE", "PASSPORT_ISSUER", "REGION", "DISTRICT", "STREET"})
NUMBER_LENGTHS = {
    "PASSPORT": {10}, "DRIVER_LICENSE": {10}, "INN": {10, 12}, "CARD_NUMBER": set(range(13, 20)), "PHONE": set(range(7, 16)),
    "DEPARTMENT_CODE": {6}, "POSTCODE": {6}, "CVV": {3, 4}, "PIN": {4, 5, 6},
}
DIGIT_WORD = "(?:ноль|нуль|один|два|три|четыре|пять|шесть|семь|восемь|девять)"
_RUN = re.compile(r"(?<!\w)[+\d](?:[\d\s()./№–—-]*\d)?")
_SPOKEN = re.compile(rf"\b{DIGIT_WORD}(?:[\s,;-]+{DIGIT_WORD})*\b", re.IGNORECASE)
_DIGIT_WORDS = re.compile(DIGIT_WORD, re.IGNORECASE)
_DATE = re.compile(r"(?<!\d)\d{1,4}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{2,4}(?!\d)")
_ID_WORD = re.compile(r"(?<!\w)[A-Za-zА-Яа-яЁё0-9]{6,20}(?!\w)")

Span = tuple[str, int, int]


def _only(found: list[tuple[int, int]], s: int, e: int) -> tuple[int, int] | None:
    """The one of ``found`` that overlaps; none if there are more."""
    near = [x for x in found if x[0] < e and x[1] > s]
    return near[0] if len(near) == 1 else None


def _digits(text: str) -> int:
    return sum(map(str.isdigit, text))


def _grown(text: str, s: int, e: int, like: Callable[[str], bool]) -> tuple[int, int]:
    """Both ends moved outwards while the characters on either side are alike."""
    while 0 < s < e and like(text[s - 1]) and like(text[s]):
        s -= 1
    while s < e < len(text) and like(text[e]) and like(text[e - 1]):
        e += 1
    return s, e


def repaired(text: str, spans: list[Span]) -> list[Span]:
    """Model spans snapped to whole values: documents with letters, numbers of a fitting length, spoken digits, dates, whole words.

    No span is made that the model did not predict; equal spans become one, and of loose ones of a type those that overlap too.
    """
    ids = [m.span() for m in _ID_WORD.finditer(text) if 1 <= sum(map(str.isalpha, m.group())) <= 4 and _digits(m.group()) >= 5]
    runs = [m.span() for m in _RUN.finditer(text)]
    spoken = [m.span() for m in _SPOKEN.finditer(text)]
    dates = [m.span() for m in _DATE.finditer(text)]
    whole: list[Span] = []
    loose: list[Span] = []
    for kind, s, e in spans:
        if kind in ("PASSPORT", "DRIVER_LICENSE"):
            if x := _only(ids, s, e):
                whole.append((kind, min(s, x[0]), max(e, x[1])))
                continue
            if any(map(str.isalpha, text[s:e])):
                whole.append((kind, s, e))
                continue
        if kind in ("CVV", "PIN") and (x := _only([y for y in spoken if len(_DIGIT_WORDS.findall(text[y[0] : y[1]])) in NUMBER_LENGTHS[kind]], s, e)):
            whole.append((kind, *x))
            continue
        if kind in NUMBER_LENGTHS and (x := _only([y for y in runs if _digits(text[y[0] : y[1]]) in NUMBER_LENGTHS[kind]], s, e)):
            s, e = x
        if kind in WORD_TYPES:
            e = s + len(text[s:e].rstrip("\"'«»"))
        if kind in NUMERIC:
            while s < e and not (text[s].isdigit() or text[s] in "+•*"):
                s += 1
            e = s + len(text[s:e].rstrip(" ,;:!.?"))
            s, e = _grown(text, s, e, str.isdigit)
        if kind in DATE_TYPES and (x := _only(dates, s, e)):
            s, e = x
        if kind in WORD_TYPES:
            s, e = _grown(text, s, e, str.isalpha)
            e = s + len(text[s:e].rstrip(" ,;:!?"))
        if s < e and not (kind in ("CVV", "PIN") and not min(NUMBER_LENGTHS[kind]) <= _digits(text[s:e]) <= max(NUMBER_LENGTHS[kind])):
            loose.append((kind, s, e))
    joined: list[Span] = []
    for kind, s, e in sorted(set(loose)):
        if joined and joined[-1][0] == kind and s < joined[-1][2]:
            joined[-1] = (kind, joined[-1][1], max(e, joined[-1][2]))
        else:
            joined.append((kind, s, e))
    return sorted(set(joined) | set(whole))


def repair(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, spans array<struct<type,start,end>>)`` with ``spans`` repaired, in Arrow batches."""

    @F.pandas_udf("array<struct<type:string,start:int,end:int>>")
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, xs):
            return [dict(zip(("type", "start", "end"), x)) for x in repaired(t or "", [(x["type"], x["start"], x["end"]) for x in (xs if xs is not None else [])])]

        return pd.Series([one(t, xs) for t, xs in zip(texts, spans)])

    return docs.withColumn("spans", run("text", "spans"))


def sliding_windows(length: Column, size: int, stride: int) -> Column:
    """``array<struct<s,e>>`` of token windows that overlap by ``stride``; the last one ends with the text."""
    step = size - stride
    starts = F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - size) / step).cast("int") * step), F.lit(step)))
    return F.transform(starts, lambda s: F.struct(s.alias("s"), F.least(s + size, length).alias("e")))


def replay_scheduler(jobs: DataFrame, budget_ms: float = 60.0, hold_ms: float = 1000.0, ratio: float = 0.7, low_water: int = 1, capacity: int = 8, start_ms: tuple[float, float] = (20.0, 4.0), max_code_points: int = 350) -> DataFrame:
    """``(replica, seq, route, reason)``: what the adaptive scheduler would have done with recorded jobs.

    ``jobs``: ``(replica, seq, at_ms, code_points, quality_ms, fast_ms)``.  Each backend serves one job at a time, its estimate is an
    exponential mean (0.8 old, 0.2 new) of time a unit; degrading holds for a while and ends below a share of the budget.
    One replica is one ordered state machine.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["at_ms", "seq"])
        free, ewma = {"quality": 0.0, "fast": 0.0}, {"quality": start_ms[0], "fast": start_ms[1]}
        waiting: dict[str, list[tuple[float, float, float]]] = {"quality": [], "fast": []}
        degraded, until, out = False, 0.0, []
        for row in p.itertuples():
            now, units = row.at_ms, max(0.25, row.code_points / max_code_points)
            for r in waiting:
                for done, took, u in [x for x in waiting[r] if x[0] <= now]:
                    ewma[r] = 0.8 * ewma[r] + 0.2 * max(0.1, took / u)
                waiting[r] = [x for x in waiting[r] if x[0] > now]
            estimate = (sum(u for *_, u in waiting["quality"]) + units) * ewma["quality"]
            room, fits = len(waiting["quality"]) < capacity, estimate <= budget_ms
            if degraded and now >= until and len(waiting["quality"]) <= low_water and estimate <= budget_ms * ratio:
                degraded = False
            if not degraded and not (room and fits):
                degraded, until = True, now + hold_ms
            if not degraded:
                route, reason = "quality", "normal"
            elif now >= until and not waiting["quality"]:
                route, reason, until = "quality", "recovery_probe", now + hold_ms
            else:
                route, reason = "fast", "quality_capacity" if not room else "quality_budget" if not fits else "hold"
                if len(waiting["fast"]) >= capacity and room and fits:
                    route, reason = "quality", "fast_full_quality_spare"
            if len(waiting[route]) >= capacity:
                route, reason = "rejected", "inference_capacity_exhausted"
            else:
                took = row.quality_ms if route == "quality" else row.fast_ms
                free[route] = max(free[route], now) + took
                waiting[route].append((free[route], took, units))
            out.append((row.replica, row.seq, route, reason))
        return pd.DataFrame(out, columns=["replica", "seq", "route", "reason"])

    kind = jobs.schema["replica"].dataType.simpleString()
    return jobs.groupBy("replica").applyInPandas(run, f"replica {kind}, seq long, route string, reason string")


def enabled(entities: Column, types: tuple[str, ...]) -> Column:
    """Entities of the types that are switched on, by place and then type."""
    kept = F.filter(entities, lambda x: x["type"].isin(*types))
    return F.array_sort(kept, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], a["end"] - b["end"]).when(a["type"] < b["type"], -1).when(a["type"] > b["type"], 1).otherwise(0))


def joined_responses(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """``chunks(doc_id, chunk_ix, ...)`` with ``entities`` and ``failure`` of their ``responses(doc_id, chunk_ix, error_code, entities)``.

    A chunk whose response is missing, came more than once or has an error is ``unavailable``; it never passes as one without entities.
    """
    r = responses.groupBy("doc_id", "chunk_ix").agg(F.count("*").alias("_n"), F.first("error_code").alias("_code"), F.first("entities").alias("entities"))
    failure = F.when(F.coalesce(F.col("_n"), F.lit(0)) != 1, "unavailable").when(F.col("_code").eqNullSafe("NONE") & F.col("entities").isNotNull(), F.lit(None)).otherwise("unavailable")
    out = chunks.drop("entities", "error_code").join(r, ["doc_id", "chunk_ix"], "left").withColumn("failure", failure)
    return out.withColumn("entities", F.when(F.col("failure").isNull(), F.col("entities"))).drop("_n", "_code")


def wire_status(code: Column) -> Column:
    """How a call's status counts: exhausted or unavailable servers are ``unavailable``, a deadline is ``timeout``, the rest an error."""
    return F.when(code == "OK", "ok").when(code.isin("RESOURCE_EXHAUSTED", "UNAVAILABLE"), "unavailable").when(code == "DEADLINE_EXCEEDED", "timeout").otherwise("error")


def character_windows(docs: DataFrame, most: int = 900) -> DataFrame:
    """``(doc_id, window_ix, s, e)``: windows of at most ``most`` characters, cut after the last sentence, line or clause that ends in one.

    Null and empty texts have none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, t in zip(p["doc_id"], p["text"]):
                s = k = 0
                while s < len(t):
                    e = min(s + most, len(t))
                    if e < len(t):
                        ends = [at + len(mark) for mark in (". ", "\n", "; ") if (at := t.rfind(mark, s, e)) >= 0]
                        e = max(ends, default=e)
                    rows.append((i, k, s, e))
                    s, k = e, k + 1
            yield pd.DataFrame(rows, columns=["doc_id", "window_ix", "s", "e"])

    return docs.select("doc_id", "text").filter("text <> ''").mapInPandas(run, f"doc_id {kind}, window_ix int, s int, e int")
