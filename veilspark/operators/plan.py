"""Replacement plans: merging, overlap that keeps coverage, token numbers, and putting tokens into the text.

Long form has a row for each span, ``(doc_id, s, e, kind, original, source, confidence)``; its windows are keyed by document.  The
in-row form serves rules alone, whose entities are disjoint already, and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import TOKEN
from ..functions.spans import cut_text, let, spans

# Kinds of entity types, and which kinds win.
KIND_OF_TYPE = {
    "FULL_NAME": "full_name", "BIRTH_DATE": "date", "PASSPORT_ISSUE_DATE": "date", "BIRTH_PLACE": "place_of_birth", "PASSPORT": "passport",
    "CITIZENSHIP": "citizenship", "PASSPORT_ISSUER": "passport_issuer", "DEPARTMENT_CODE": "department_code", "DRIVER_LICENSE": "driver_license",
    "ADDRESS": "address", "CITY": "city", "STREET": "street", "HOUSE": "house", "APARTMENT": "apartment", "POSTAL_CODE": "postal_code",
    "COUNTRY": "country", "REGION": "region", "DISTRICT": "district", "EMAIL": "email", "PHONE": "phone", "INN": "inn", "CARD_NUMBER": "card",
    "CVV": "cvv", "PIN": "pin", "CARDHOLDER_NAME": "cardholder_name",
}
ALL_KINDS = tuple(dict.fromkeys(KIND_OF_TYPE.values())) + ("first_name", "last_name", "patronymic")
STRUCTURED_KINDS = ("phone", "email", "inn", "card", "passport", "department_code", "date", "driver_license", "cvv", "pin", "postal_code")
FIRST_KINDS = (*STRUCTURED_KINDS, "full_name", "address")
SECOND_KINDS = ("first_name", "last_name", "patronymic", "city", "street", "house", "apartment", "place_of_birth", "citizenship", "passport_issuer", "cardholder_name")


def mapped(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def kind_priority(kind: Column) -> Column:
    return F.when(kind.isin(*FIRST_KINDS), 2).when(kind.isin(*SECOND_KINDS), 1).otherwise(0)


def primary_source(kind: Column) -> Column:
    return F.when(kind.isin(*STRUCTURED_KINDS), "regex").otherwise("ml")


def violations(rows: DataFrame) -> DataFrame:
    """Spans that do not fit their text, with the reason.  They are errors even where the policy would leave their kind out."""
    bad = (
        F.when((F.col("s") < 0) | (F.col("e") > F.length("text")) | (F.col("s") >= F.col("e")), "span_out_of_range")
        .when(cut_text(F.col("text"), F.col("s"), F.col("e")) != F.col("original"), "text_differs")
        .when(~F.col("kind").isin(*ALL_KINDS), "unknown_kind")
    )
    return rows.withColumn("violation", bad).filter("violation is not null")


def allowed(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Rows whose consumer's policy names their kind, with enough confidence.  ``policy``: ``(consumer_id, kind, min_confidence)``."""
    p = policy.select("consumer_id", "kind", "min_confidence").distinct()
    return rows.join(p, ["consumer_id", "kind"]).filter(F.col("confidence") >= F.col("min_confidence")).drop("min_confidence")


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row a (document, span, kind, original): the kind's primary source, then confidence, then source."""
    w = Window.partitionBy("doc_id", "s", "e", "kind", "original").orderBy((F.col("source") == primary_source(F.col("kind"))).desc(), F.col("confidence").desc(), "source")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def painted(rows: DataFrame) -> DataFrame:
    """Disjoint pieces that cover all that ``rows`` cover: every stretch goes to the first of its spans in order of priority.

    Boundaries cut each document into elementary stretches; each takes its best span, and neighbouring stretches of one span
    join again.  ``original`` follows the piece.
    """
    primary = (F.col("source") == primary_source(F.col("kind"))).cast("int")
    order = [kind_priority(F.col("kind")).desc(), primary.desc(), F.col("confidence").desc(), (F.col("e") - F.col("s")).desc(), F.col("s"), F.col("e"), F.col("kind"), F.col("source")]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    points = rows.select("doc_id", F.explode(F.array("s", "e")).alias("a")).distinct()
    by_doc = Window.partitionBy("doc_id").orderBy("a")
    stretches = points.withColumn("b", F.lead("a").over(by_doc)).filter("b is not null")
    covers = stretches.join(ranked, "doc_id").filter((F.col("s") <= F.col("a")) & (F.col("b") <= F.col("e")))
    best = covers.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "a").orderBy("_rank"))).filter("_r = 1")
    new = (F.lag("_rank").over(by_doc) != F.col("_rank")) | (F.lag("b").over(by_doc) != F.col("a")) | F.lag("b").over(by_doc).isNull()
    runs = best.withColumn("_run", F.sum(new.cast("int")).over(by_doc))
    out = runs.groupBy("doc_id", "_run").agg(F.min("a").alias("ps"), F.max("b").alias("pe"), *[F.first(c).alias(c) for c in rows.columns if c != "doc_id"])
    piece = F.substr("original", F.col("ps") - F.col("s") + 1, F.col("pe") - F.col("ps"))
    return out.withColumn("original", piece).withColumn("s", F.col("ps")).withColumn("e", F.col("pe")).select(*rows.columns)


def combined(ml: DataFrame, rules: DataFrame) -> DataFrame:
    """The disjoint plan of two sources' spans."""
    return painted(deduplicated(ml.unionByName(rules)))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``token``: ``<KIND_n>``, equal values of a kind alike, ``n`` by first appearance, past what the text has already."""
    first = F.min("s").over(Window.partitionBy("doc_id", "kind", "original"))
    r = rows.withColumn("_first", first)
    r = r.withColumn("_k", F.dense_rank().over(Window.partitionBy("doc_id", "kind").orderBy("_first")))
    return r.withColumn("token", _token(F.col("text"), F.col("kind"), F.col("_k"))).drop("_first", "_k")


def _name(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), F.upper(kind), F.lit("_"), n.cast("string"), F.lit(">"))


def _token(text: Column, kind: Column, k: Column) -> Column:
    """The name with the ``k``-th number that the text does not use: at most as many are used as it has token shapes."""
    used = F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    free = lambda upto: F.filter(F.sequence(F.lit(1), upto), lambda i: ~F.contains(text, _name(kind, i)))
    return F.when(used == 0, _name(kind, k)).otherwise(_name(kind, F.get(free(k + used), k - 1)))


def applied(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, masked, mappings)`` from numbered, disjoint ``rows`` and ``docs(doc_id, text)``; documents without rows stay as they are."""
    plan = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "token", "original", "kind", "source"))).alias("plan"))
    out = docs.select("doc_id", "text").join(plan, "doc_id", "left")
    none = F.array().cast("array<struct<s:int,e:int,token:string,original:string,kind:string,source:string>>")
    out = out.withColumn("plan", F.coalesce("plan", none))
    return out.select("doc_id", spliced(F.col("text"), F.col("plan")).alias("masked"), F.col("plan").alias("mappings"))


def spliced(text: Column, plan: Column) -> Column:
    """``text`` with each span of an ordered, disjoint plan replaced by its token."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], cut_text(text, a["at"], x["s"]), x["token"]).alias("out"))
    return F.aggregate(plan, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def plan_of_entities(text: Column, entities: Column, kinds: Column | None = None, min_confidence: float = 0.5) -> Column:
    """The numbered plan of a row's rule entities: ``array<struct<s, e, token, original, kind, source>>``.

    ``kinds``: an array of kinds that may be masked; null: all.
    """
    with_kind = F.transform(entities, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["text"].alias("original"), mapped(KIND_OF_TYPE, x["type"]).alias("kind"), x["score"].alias("score")))
    fits = lambda x: (x["score"] >= min_confidence) & (F.lit(True) if kinds is None else F.coalesce(F.array_contains(kinds, x["kind"]), F.lit(True)))

    def named(xs: Column) -> Column:
        values = F.array_distinct(F.transform(xs, lambda x: F.struct(x["kind"].alias("kind"), x["original"].alias("original"))))

        def each(vs: Column) -> Column:
            def one(x: Column) -> Column:
                own = F.filter(vs, lambda v: v["kind"] == x["kind"])
                k = F.array_position(F.transform(own, lambda v: v["original"]), x["original"]).cast("int")
                return F.struct(x["s"].alias("s"), x["e"].alias("e"), _token(text, x["kind"], k).alias("token"), x["original"].alias("original"), x["kind"].alias("kind"), F.lit("regex").alias("source"))

            return F.transform(xs, one)

        return let(values, each)

    return let(F.filter(with_kind, fits), named)


def mapping_conflicts(mappings: DataFrame) -> DataFrame:
    """Tokens of a document that stand for more than one (original, kind).  ``mappings``: ``(doc_id, token, original, kind)``."""
    return mappings.groupBy("doc_id", "token").agg(F.count_distinct("original", "kind").alias("n_values")).filter("n_values > 1")


def detokenized(text: Column, mappings: Column) -> tuple[Column, Column]:
    """``(restored, unknown)``: token shapes replaced by their originals; the first token without one, for which the whole is an error.

    Other text in angle brackets is left alone.
    """
    found = spans(text, TOKEN, "<")
    table = F.map_from_entries(F.array_distinct(F.transform(mappings, lambda m: F.struct(m["token"], m["original"]))))
    plan = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.try_element_at(table, cut_text(text, x["s"], x["e"])).alias("token"), cut_text(text, x["s"], x["e"]).alias("raw")))
    unknown = F.get(F.transform(F.filter(plan, lambda p: p["token"].isNull()), lambda p: p["raw"]), F.lit(0))
    return F.when(unknown.isNull(), spliced(text, plan)), unknown
