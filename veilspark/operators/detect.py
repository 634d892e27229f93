"""Rules: candidates of all recognizers, their context, and the entities that are left.

Everything of a text stays in its row, and no step shuffles: texts are scanned in Arrow batches.  The column functions, in which
candidates are an array, scoring maps it and resolving folds it, serve single steps and recognizers of a caller's own.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import words as W
from ..functions.patterns import any_of
from ..functions.spans import cut_text, inner_spans, let, spans
from .normalize import byte_offset, normalized, original_span, with_normalized
from .scan import BOOST, CARD_BOOST, CARD_NEAR, MIN_SCORE, SUPPRESS, WINDOW, Scanner
from .text_rules import FOUND, recognizer, walking
from .validators import valid_card, valid_dmy, valid_inn, valid_iso

DIGIT = "[0-9]"
ENTITIES = "array<struct<type:string,s:int,e:int,text:string,score:double>>"


def _found(at: Column, kind: str, score: float, sources: tuple[str, ...], reg: int) -> Column:
    return F.transform(
        at, lambda x: F.struct(F.lit(kind).alias("type"), x["s"].alias("s"), x["e"].alias("e"), F.lit(score).alias("score"), F.array(*map(F.lit, sources)).alias("sources"), F.lit(reg).alias("reg"))
    )


def pattern_candidates(norm: Column) -> Column:
    """Candidates of the recognizers that are a pattern with a test, in the order of the registry."""
    text = lambda x: cut_text(norm, x["s"], x["e"])
    rf = ("regex", "format")

    def dates() -> Column:
        numeric, iso, named = (spans(norm, p, DIGIT) for p in (P.DATE_NUMERIC, P.DATE_ISO, P.DATE_WORDS))

        def all_of(full: Column) -> Column:
            n, i, w, y = full["n"], full["i"], full["w"], full["y"]
            every = F.concat(n, i, w)
            bare = F.filter(y, lambda a: ~F.exists(every, lambda b: (a["s"] < b["e"]) & (b["s"] < a["e"])))
            return F.concat(
                _found(F.filter(n, lambda x: valid_dmy(text(x))), "BIRTH_DATE", 0.4, rf, 11),
                _found(F.filter(i, lambda x: valid_iso(text(x))), "BIRTH_DATE", 0.4, rf, 11),
                _found(w, "BIRTH_DATE", 0.45, rf, 11),
                _found(bare, "BIRTH_DATE", 0.3, rf, 11),
            )

        return let(F.struct(numeric.alias("n"), iso.alias("i"), named.alias("w"), spans(norm, P.YEAR, DIGIT).alias("y")), all_of)

    return F.concat(
        _found(spans(norm, P.EMAIL, "@"), "EMAIL", 0.6, ("regex",), 0),
        _found(spans(norm, P.PHONE, DIGIT), "PHONE", 0.6, ("regex",), 1),
        _found(F.filter(spans(norm, P.INN, DIGIT), lambda x: valid_inn(text(x))), "INN", 0.9, ("regex", "checksum"), 2),
        _found(F.filter(spans(norm, P.CARD_NUMBER, DIGIT), lambda x: valid_card(text(x))), "CARD_NUMBER", 0.4, ("regex", "checksum"), 3),
        _found(spans(norm, P.PIN, DIGIT), "PIN", 0.3, ("regex",), 5),
        # a run of Latin words reaches the least score only with one of these words near it
        _found(F.filter(spans(norm, P.CARDHOLDER_NAME, any_of(W.CARDHOLDER_KEYWORDS)), lambda x: F.trim(text(x)).contains(" ")), "CARDHOLDER_NAME", 0.3, ("regex",), 6),
        _found(spans(norm, P.PASSPORT, DIGIT), "PASSPORT", 0.4, rf, 7),
        _found(spans(norm, P.PASSPORT_SPLIT, "серия"), "PASSPORT", 0.7, rf, 7),
        _found(spans(norm, P.DEPARTMENT_CODE, DIGIT), "DEPARTMENT_CODE", 0.4, rf, 8),
        _found(spans(norm, P.DRIVER_LICENSE, DIGIT), "DRIVER_LICENSE", 0.4, rf, 9),
        _found(
            inner_spans(norm, r"(?:выдан|выдано|орган, выдавший|кем выдан)[:\s]+", r"[а-яёa-z\s.\-]{5,80}?", r"(?:,|\s+\d|$)", "выда"), "PASSPORT_ISSUER", 0.7, ("regex", "context"), 10
        ),
        dates(),
    )


def candidates(df: DataFrame, find=None) -> DataFrame:
    """``df`` with ``norm``, ``kept`` and ``cands``: the candidates of all recognizers, by registry order and then place."""
    find = find or recognizer()
    d = with_normalized(df).withColumn("_rules", find(F.col("norm")))
    both = F.concat(pattern_candidates(F.col("norm")), F.coalesce("_rules", F.array().cast(FOUND)))
    return d.withColumn("cands", F.when(F.col("norm").isNotNull(), both)).drop("_rules")


# What raises and lowers a type's score.  ``around``: 20 characters each side with the value; a number: so many before it.
POSITIVE = {
    "EMAIL": ("around", W.EMAIL_KEYWORDS), "PHONE": ("around", W.PHONE_KEYWORDS), "INN": ("around", W.INN_KEYWORDS),
    "CARD_NUMBER": ("around", W.CARD_NUMBER_KEYWORDS), "CVV": ("around", W.CVV_KEYWORDS), "PIN": ("around", W.PIN_KEYWORDS),
    "CARDHOLDER_NAME": ("around", W.CARDHOLDER_KEYWORDS), "PASSPORT": (60, W.PASSPORT_CONTEXT_KEYWORDS),
    "DRIVER_LICENSE": (60, W.DRIVER_LICENSE_KEYWORDS), "DEPARTMENT_CODE": (60, ("код подразделения", "кп:", "кп ")),
    "BIRTH_DATE": ("around", W.BIRTH_DATE_KEYWORDS), "PASSPORT_ISSUE_DATE": ("around", W.ISSUE_DATE_KEYWORDS),
    "BIRTH_PLACE": ("around", W.BIRTH_PLACE_KEYWORDS), "CITIZENSHIP": (60, W.CITIZENSHIP_KEYWORDS),
    "PASSPORT_ISSUER": ("around", W.PASSPORT_ISSUER_KEYWORDS), "FULL_NAME": ("around", W.FULL_NAME_KEYWORDS),
    "ADDRESS": ("around", W.ADDRESS_KEYWORDS),
}
NEGATIVE = {
    "EMAIL": [[("around", W.PUBLIC_CONTACT_KEYWORDS)]], "PHONE": [[("around", W.PUBLIC_CONTACT_KEYWORDS)]],
    "INN": [[(60, W.ORDER_ARTICLE_KEYWORDS)]],
    "CARD_NUMBER": [[(60, W.ORDER_NUMBER_KEYWORDS)], [(60, W.METRO_TRANSPORT_KEYWORDS)], [(60, W.LOYALTY_CARD_KEYWORDS)]],
    "CVV": [[("around", W.AUDITORIUM_KEYWORDS), ("around", W.NON_BANK_CVV_KEYWORDS)]],
    "PIN": [[(60, W.ORDER_NUMBER_KEYWORDS), ("around", W.NON_BANK_PIN_KEYWORDS)]],
    "PASSPORT": [[(60, W.ORDER_ARTICLE_KEYWORDS)]],
    "DEPARTMENT_CODE": [[("around", ("товар", "товара", "заявке", "заявка", "заявки", "артикул"))]],
    "BIRTH_PLACE": [[(60, W.KNOWN_PERSON_CONTEXT)]], "FULL_NAME": [[("around", W.KNOWN_PERSON_CONTEXT)]],
    "ADDRESS": [[("around", W.BANK_BRANCH_KEYWORDS), ("around", W.PUBLIC_PLACE_KEYWORDS)]],
}


def around(norm: Column, s: Column, e: Column) -> Column:
    start = F.greatest(s - WINDOW, F.lit(0))
    return F.substr(norm, start + 1, e + WINDOW - start)


def before(norm: Column, s: Column, n: int) -> Column:
    start = F.greatest(s - n, F.lit(0))
    return F.substr(norm, start + 1, s - start)


def _has(norm: Column, c: Column, where, words) -> Column:
    if not words:
        return F.lit(False)
    text = around(norm, c["s"], c["e"]) if where == "around" else before(norm, c["s"], where)
    return text.rlike(any_of(words))


def scored(norm: Column, c: Column) -> Column:
    """A candidate with its type and score as the context leaves them; ``ctx`` tells that a word spoke for it."""
    issue = (c["type"] == "BIRTH_DATE") & _has(norm, c, 25, W.ISSUE_DATE_KEYWORDS)
    licence = (c["type"] == "PASSPORT") & _has(norm, c, 40, W.DRIVER_LICENSE_KEYWORDS)
    named = F.lit(False)
    for kind, (where, words) in POSITIVE.items():
        named = F.when(c["type"] == kind, _has(norm, c, where, words)).otherwise(named)
    ctx = issue | licence | named
    kind = F.when(issue, "PASSPORT_ISSUE_DATE").when(licence, "DRIVER_LICENSE").otherwise(c["type"])

    def adjusted(k: Column) -> Column:
        boost = F.when(k["ctx"], F.lit(BOOST)).otherwise(F.lit(0.0))
        for name, groups in NEGATIVE.items():
            for group in groups:
                hit = reduce(lambda a, b: a | b, [_has(norm, c, *g) for g in group])
                boost = boost + F.when((k["type"] == name) & hit, F.lit(-SUPPRESS)).otherwise(F.lit(0.0))
        pre = before(norm, c["s"], 60)
        boost = boost + F.when((k["type"] == "PASSPORT") & pre.contains("номер документа") & ~pre.contains("паспорт"), F.lit(-SUPPRESS)).otherwise(F.lit(0.0))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c["score"] + boost))
        return F.struct(k["type"].alias("type"), c["s"].alias("s"), c["e"].alias("e"), score.alias("score"), c["sources"].alias("sources"), c["reg"].alias("reg"), k["ctx"].alias("ctx"))

    return let(F.struct(kind.alias("type"), ctx.alias("ctx")), adjusted)


def near_card(cands: Column) -> Column:
    """Codes that context already speaks for gain from a card number within 60 characters."""

    def one(c: Column) -> Column:
        gap = lambda x: F.greatest(x["s"] - c["e"], c["s"] - x["e"], F.lit(0))
        near = c["type"].isin("CVV", "PIN") & c["ctx"] & F.exists(cands, lambda x: (x["type"] == "CARD_NUMBER") & (x["score"] >= MIN_SCORE) & (gap(x) <= CARD_NEAR))
        return F.struct(
            c["type"].alias("type"), c["s"].alias("s"), c["e"].alias("e"), F.when(near, F.least(F.lit(1.0), c["score"] + CARD_BOOST)).otherwise(c["score"]).alias("score"),
            F.when(near, F.array_append(c["sources"], F.lit("context"))).otherwise(c["sources"]).alias("sources"), c["reg"].alias("reg"), c["ctx"].alias("ctx"),
        )

    return F.transform(cands, one)


def evidence(sources: Column) -> Column:
    """Strength by kind of proof: checksum with context 5, checksum 4, dictionary with context 3, dictionary or context 2, else 1."""
    has = lambda x: F.array_contains(sources, x)
    return F.when(has("checksum") & has("context"), 5).when(has("checksum"), 4).when(has("dictionary") & has("context"), 3).when(has("dictionary") | has("context"), 2).otherwise(1)


def resolved(cands: Column, min_score: float = MIN_SCORE) -> Column:
    """Disjoint entities: from the left, of two that overlap the stronger stays; what is kept never overlaps, so only the last one can."""
    strong = F.filter(cands, lambda c: c["score"] >= min_score)
    keyed = F.array_sort(
        F.transform(strong, lambda c, i: F.struct(c["s"].alias("s"), (-evidence(c["sources"])).alias("ev"), (-c["score"]).alias("ns"), c["reg"].alias("reg"), i.alias("i"), c["e"].alias("e"), c["type"].alias("type"), c["score"].alias("score")))
    )
    kept = F.array().cast("array<struct<s:int,ev:int,ns:double,reg:int,i:int,e:int,type:string,score:double>>")

    def step(out: Column, c: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        clash = (F.size(out) > 0) & (c["s"] < last["e"]) & (last["s"] < c["e"])
        stronger = (c["ev"] < last["ev"]) | ((c["ev"] == last["ev"]) & (c["score"] > last["score"]))
        return F.when(~clash, F.array_append(out, c)).when(stronger, F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), c)).otherwise(out)

    return F.aggregate(keyed, kept, step)


def _scanned(rules, min_score: float):
    """The column function from text and normalized text to entities."""
    scanner = Scanner(POSITIVE, NEGATIVE, (25, W.ISSUE_DATE_KEYWORDS), (40, W.DRIVER_LICENSE_KEYWORDS), rules)

    @F.arrow_udf(ENTITIES)
    def run(texts: pa.Array, norms: pa.Array) -> pa.Array:
        ends, none, flat = [0], [], []
        for text, norm in zip(texts.to_pylist(), norms.to_pylist()):
            none.append(norm is None)
            if norm is not None:
                flat += scanner.entities(text, norm, min_score)
            ends.append(len(flat))
        kinds = (("type", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("text", pa.string()), ("score", pa.float64()))
        columns = zip(*flat) if flat else [()] * len(kinds)
        values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(none, pa.bool_()))

    return run


def detect(df: DataFrame, find=None, min_score: float = MIN_SCORE) -> DataFrame:
    """``df`` with ``entities``: ``array<struct<type, s, e, text, score>>`` at code points of ``text``, in order.

    Null text: null.  A text in which nothing is found: an empty array.  ``find``, a column function for the five walking types
    in place of the usual one, is combined with the patterns by column functions, which take many times as long.
    """
    if find is None:
        return df.withColumn("entities", _scanned(walking(), min_score)(F.col("text"), normalized(F.col("text"))))
    d = candidates(df, find)
    d = d.withColumn("cands", let(F.transform("cands", lambda c: scored(F.col("norm"), c)), near_card))

    def one(c: Column) -> Column:
        s, e = original_span(F.col("kept"), c["s"], c["e"])
        return let(F.struct(s.alias("s"), e.alias("e")), lambda x: F.struct(c["type"].alias("type"), x["s"].alias("s"), x["e"].alias("e"), cut_text(F.col("text"), x["s"], x["e"]).alias("text"), c["score"].alias("score")))

    return d.withColumn("entities", F.transform(resolved(F.col("cands"), min_score), one)).drop("norm", "kept", "cands")


def with_bytes(entities: Column, text: Column) -> Column:
    """Entities with UTF-8 byte offsets beside their code points."""
    return F.transform(entities, lambda x: F.struct(x["type"].alias("type"), x["s"].alias("s"), x["e"].alias("e"), byte_offset(text, x["s"]).alias("sb"), byte_offset(text, x["e"]).alias("eb"), x["score"].alias("score")))


def residual(text: Column, entities: Column) -> Column:
    """``text`` with each entity overwritten by as many spaces as it has bytes."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        out = F.concat(a["out"], cut_text(text, a["at"], x["s"]), F.repeat(F.lit(" "), F.octet_length(cut_text(text, x["s"], x["e"]))))
        return F.struct(x["e"].alias("at"), out.alias("out"))

    return F.aggregate(entities, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def residual_stats(text: Column, left: Column) -> tuple[Column, Column, Column]:
    """Whether anything was masked, how many bytes, and the rest trimmed."""
    return text != left, F.octet_length(F.regexp_replace(left, "[^ ]", "")) - F.octet_length(F.regexp_replace(text, "[^ ]", "")), F.trim(left)
