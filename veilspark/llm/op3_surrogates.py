"""Personal data replaced by keyed surrogates of the same type and format.  DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, let

# Titles with the gender they tell, and what introduces a name.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "госпожа", "Госпожа")
OTHER_TITLES = ("Dr", "Prof", "My name is", "my name is", "Ich heiße", "ich heiße", "Je m'appelle", "je m'appelle", "Me llamo", "me llamo", "Меня зовут", "меня зовут")

_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*(?<=\.[A-Za-z]{2,24})"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
KEY_ID = _B + r"(?:AKIA|ASIA)[A-Z0-9]{16}" + _E
SECRET = _B + r"(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)\s?[=:]\s?(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{5,}[^\s\"',;.:!?)\]*#$%&])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})[ .\-]?\d{2,4}[ .\-]?\d{2,4}(?:[ .\-]\d{2}(?![\d.]))*|\(\d{3}\) ?\d{3}[\-.]\d{4}|\d{3}-\d{3}-\d{4})(?!\d)"
CARD = r"(?<![\d])(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?!\d)"
IBAN = _B + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
PERSON = _B + "(?:" + "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)) + r")\.? " + _NAME + r"(?: " + _NAME + r"){0,2}" + _E
#: Types in the order in which they are tried at a place.
TYPES = {"email": EMAIL, "secret": SECRET, "key_id": KEY_ID, "ip": IP, "phone": PHONE, "iban": IBAN, "ssn": SSN, "card": CARD.replace(r"\1", r"\k<sep>").replace(r"([ \-])", r"(?<sep>[ \-])"), "person": PERSON}
ANY = "|".join(f"(?:{p})" for p in TYPES.values())
#: Every match holds a digit, an at sign or one of these words; looking for them first is far cheaper than the patterns.
WORDS_FIRST = (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES, "AKIA", "ASIA")
SECRET_WORDS = ("passw", "pwd", "secret", "token", "api", "access")
#: Words of a text, among which the parts of its names recur, and what is between them.
PIECES = r"(?s)[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+"
#: Rounds of choosing anew where a surrogate is taken; names are a syllable longer every few rounds, so their space grows.
ROUNDS, LONGER = 64, 3


def may_hold(text: Column) -> Column:
    """Whether ``text`` can have a match at all; null for null."""
    plain = reduce(lambda a, w: a | F.contains(text, F.lit(w)), WORDS_FIRST, text.rlike("[0-9@]"))
    lower = F.lower(text)
    return plain | ((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in SECRET_WORDS]))


def hit(text: Column) -> Column:
    return F.coalesce(F.when(may_hold(text), text.rlike(ANY)), F.lit(False))


def _hash(seed: Column, i: Column) -> Column:
    return F.xxhash64(seed, i)


def _pick(alphabet: str, r: Column) -> Column:
    return F.substr(F.lit(alphabet), (F.pmod(r, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def _digits(seed: Column, n: Column, first: Column) -> Column:
    """``n`` keyed digits after the kept ``first`` ones."""
    more = F.greatest(n - F.length(first), F.lit(0))
    made = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: _pick("0123456789", _hash(seed, i))), ""))
    return F.concat(first, F.coalesce(made, F.lit("")))


def luhn_digit(digits: Column) -> Column:
    """The digit that makes ``digits`` followed by it pass the Luhn check."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, F.lit(2)).otherwise(F.lit(1))
    )
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return ((10 - total % 10) % 10).cast("string")


def _alike(seed: Column, value: Column) -> Column:
    """Every letter and digit replaced by one of its kind, script and case; text of hexadecimal digits and letters stays so."""
    hexed = value.rlike("^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]+$")
    kinds = (("0", "9", "0123456789"), ("a", "z", "abcdefghijklmnopqrstuvwxyz"), ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("а", "я", "абвгдежзиклмнопрстуфхцчшэюя"), ("А", "Я", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))

    def one(i: Column) -> Column:
        c, r = F.substr(value, i, F.lit(1)), _hash(seed, i)
        alike = reduce(lambda rest, k: F.when((c >= k[0]) & (c <= k[1]), _pick(k[2], r)).otherwise(rest), reversed(kinds), c)
        return F.when(hexed, _pick("0123456789abcdef", r)).otherwise(alike)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def iban_digits(country: Column, account: Column) -> Column:
    """The two check digits with which ``country``, they and ``account`` leave 1 modulo 97."""
    chars = F.split(F.concat(account, country, F.lit("00")), "")

    def on(rest: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.when(digit, (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.lpad((98 - F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), on)).cast("string"), 2, "0")


def _name(seed: Column, gender: Column, family: Column, cyrillic: Column, syllables: Column) -> Column:
    """A pronounceable name: so many keyed syllables and an ending that fits gender and script."""
    latin = "ba be da de fa fi ga ha jo ka ke la le li ma me mi na ne no pa re ri ro sa se ta te ti va ve vi za ze".split()
    other = "ба бе ва ве га да де жа зе ка ке ла ле ли ма ме ми на не но па ре ри ро са се та те ти фа фе ша ша же".split()
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(_hash(seed, F.lit(i)), F.lit(len(xs))) + 1).cast("int"))
    ends = {
        (0, "m"): ("n", "r", "s", "t"), (0, "f"): ("na", "ra", "lia", "tte"), (0, "u"): ("n", "ri", "l", "s"),
        (1, "m"): ("н", "р", "й", "м"), (1, "f"): ("на", "ра", "ля", "ина"), (1, "u"): ("н", "ри", "ль", "с"),
    }
    family_ends = {(0, "m"): ("son", "berg", "mann", "ton"), (0, "f"): ("son", "berg", "mann", "ton"), (0, "u"): ("son", "berg", "mann", "ton"), (1, "m"): ("ков", "нев", "ский"), (1, "f"): ("кова", "нева", "ская"), (1, "u"): ("ко", "ук")}
    drawn = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(_hash(seed, i + 10), F.lit(len(xs))) + 1).cast("int"))
    stem = F.array_join(F.transform(F.sequence(F.lit(1), syllables), lambda i: F.when(cyrillic, drawn(other, i)).otherwise(drawn(latin, i))), "")

    def ending(table) -> Column:
        out = pick(table[(0, "u")], 5)
        for (script, g), xs in table.items():
            out = F.when((cyrillic == F.lit(bool(script))) & (gender == g), pick(xs, 5)).otherwise(out)
        return out

    return F.initcap(F.concat(stem, F.when(family, ending(family_ends)).otherwise(ending(ends))))


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, key, parts)``: for texts with something found, their pieces; every second one was found."""
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter(hit(F.col("text")))
    between, matches = F.split("text", ANY, -1), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    d = d.select("doc", F.xxhash64("text").alias("key"), between.alias("between"), matches.alias("matches"))
    parts = F.flatten(F.transform("between", lambda p, i: F.when(i < F.size("matches"), F.array(p, F.get("matches", i))).otherwise(F.array(p))))
    return d.select("doc", "key", parts.alias("parts"))


def entities(pieces: DataFrame) -> DataFrame:
    """``(doc, key, at, raw, type, head, value, norm, gender)`` for every part found; names give a row for each of their words."""
    rows = pieces.select("doc", "key", F.posexplode("parts").alias("at", "raw")).filter("at % 2 = 1")
    kind = reduce(lambda rest, t: F.when(F.col("raw").rlike("^(?:" + TYPES[t] + ")$"), F.lit(t)).otherwise(rest), list(TYPES)[::-1], F.lit(None).cast("string"))
    rows = rows.withColumn("type", kind)
    digits = F.regexp_replace("raw", r"\D", "")
    rows = rows.withColumn("type", F.when((F.col("type") == "card") & ~F.coalesce(F.call_function("luhn_check", F.when(F.col("type") == "card", digits)), F.lit(False)), F.lit("number")).otherwise(F.col("type")))
    title = F.regexp_extract("raw", "^(" + "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)) + r")\.? ", 1)
    head = (
        F.when(F.col("type") == "secret", F.regexp_extract("raw", r"^([A-Za-z_\-]+\s?[=:]\s?[\"']?)", 1))
        .when(F.col("type") == "person", F.regexp_extract("raw", "^((?:" + "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)) + r")\.? )", 1))
        .otherwise(F.lit(""))
    )
    rows = rows.withColumn("head", head)
    value = F.expr("substring(raw, length(head) + 1)")
    value = F.when(F.col("type") == "secret", F.regexp_replace(value, "[\"']$", "")).otherwise(value)
    gender = F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f").otherwise("u")
    rows = rows.withColumn("value", value).withColumn("gender", F.when(F.col("type") == "person", gender).otherwise("u"))
    words = F.when(F.col("type") == "person", F.split("value", " ")).otherwise(F.array("value"))
    rows = rows.select("doc", "key", "at", "raw", "type", "head", "gender", "value", F.posexplode(words).alias("w", "word"), F.size(words).alias("ws"))
    family = (F.col("type") == "person") & (F.col("w") == F.col("ws") - 1)
    norm = F.when(F.col("type").isin("phone", "card", "ssn"), F.regexp_replace("word", r"\D", "")).when(F.col("type") == "iban", F.regexp_replace("word", " ", "")).when(F.col("type").isin("email", "person"), F.lower("word")).otherwise(F.col("word"))
    kind = F.when(family, F.lit("family")).otherwise(F.col("type"))
    return rows.withColumn("norm", norm).withColumn("type", kind).filter(F.col("type").isNotNull() & (F.col("type") != "number"))


def surrogates(values: DataFrame, secret: str) -> DataFrame:
    """``(type, norm, gender, made)`` from ``(type, norm, gender)``: one surrogate a value, none for two, none that occurs itself.

    Where a candidate is taken, by a value before it in order or by a value of the texts, the next is tried.
    """
    norm = F.col("norm")
    state = values.withColumn("try", F.lit(0)).withColumn("made", F.lit(None).cast("string"))
    originals = values.select(F.col("type").alias("_t"), F.col("norm").alias("_n")).distinct()
    for _ in range(ROUNDS):
        seed = F.sha2(F.concat_ws("\x00", F.lit(secret), F.col("type"), norm, F.col("try").cast("string")), 256)
        first = F.substr(norm, F.lit(1), F.lit(1))
        domain = F.concat(F.lit("d"), F.substr(F.sha2(F.concat_ws("\x00", F.lit(secret), F.substring_index(norm, "@", -1)), 256), F.lit(1), F.lit(8)), F.lit(".example.org"))
        cyrillic = norm.rlike("[\\u0400-\\u04FF]")

        def candidate(seed: Column) -> Column:
            octet = lambda i: (F.pmod(_hash(seed, F.lit(i)), F.lit(254)) + 1).cast("string")
            return (
                F.when(F.col("type") == "email", F.concat(_alike(seed, F.substring_index(norm, "@", 1)), F.lit("@"), domain))
                .when(F.col("type") == "card", let(_digits(seed, F.length(norm) - 1, first), lambda body: F.concat(body, luhn_digit(body))))
                .when(F.col("type").isin("phone", "ssn"), _digits(seed, F.length(norm), first))
                .when(F.col("type") == "ip", F.concat_ws(".", octet(1), octet(2), octet(3), octet(4)))
                .when(F.col("type") == "key_id", F.concat(F.substr(norm, F.lit(1), F.lit(4)), _alike(seed, F.expr("substring(norm, 5)"))))
                .when(F.col("type") == "iban", let(_alike(seed, F.expr("substring(norm, 5)")), lambda account: F.concat(F.substr(norm, F.lit(1), F.lit(2)), iban_digits(F.substr(norm, F.lit(1), F.lit(2)), account), account)))
                .when(F.col("type").isin("person", "family"), _name(seed, F.col("gender"), F.col("type") == "family", cyrillic, (F.lit(3) + F.col("try") / LONGER).cast("int")))
                .otherwise(_alike(seed, norm))
            )

        # written before it is compared, so that no later step computes it again
        state = cut(state.withColumn("made", F.coalesce("made", let(seed, candidate))))
        # fixed choices come first, then earlier tries, then order; so what was fixed stays
        key = F.when(F.col("type").isin("person", "family", "email"), F.lower("made")).otherwise(F.col("made"))
        rank = F.row_number().over(Window.partitionBy("type", key).orderBy("try", "norm", "gender"))
        state = state.withColumn("rank", rank).join(originals, (F.col("type") == F.col("_t")) & (key == F.col("_n")), "left")
        bad = (F.col("rank") > 1) | F.col("_n").isNotNull()
        state = cut(state.select("type", "norm", "gender", (F.col("try") + bad.cast("int")).alias("try"), F.when(~bad, F.col("made")).alias("made")))
        if state.filter("made is null").isEmpty():
            return state.select("type", "norm", "gender", "made")
    raise RuntimeError("the space of surrogates is too small for these values")


def _fitted(raw: Column, made: Column) -> Column:
    """The characters of ``made`` in the places of the digits and capitals of ``raw``; other characters stay."""
    n = F.length(raw)
    upto = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), r"[^0-9A-Z]", ""))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substr(raw, i, F.lit(1)).rlike(r"[0-9A-Z]"), F.substr(made, upto(i), F.lit(1))).otherwise(F.substr(raw, i, F.lit(1)))), "")


def replace(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``n_entities`` added.

    Equal values (after case, spacing and punctuation that does not matter is set aside) get equal surrogates in every document,
    different ones different surrogates.  Digits keep their layout, cards and IBANs get valid check digits, hexadecimal stays so, names
    keep script and the gender that a title tells.  Names are found behind a title or an introduction only; their parts are then
    replaced alike wherever they stand as words of the same text.  ``n_entities`` counts what was found, without such recurrences.

    Null or empty text, or none found: unchanged, 0.  Null ids: unchanged too, as nothing tells such rows apart; rows with the
    same id and text are rewritten alike.  A column ``n_entities`` is replaced; all others stay, whatever their names.
    """
    pieces = found(docs.filter(F.col(id_col).isNotNull()), id_col, text_col).dropDuplicates(["doc", "key"])
    pieces = cut(pieces)
    rows = cut(entities(pieces).select("doc", "key", "at", "raw", "head", "type", "gender", "value", "w", "word", "norm"))
    # one gender a name: the one told most often by titles, as a name is one person's wherever it stands
    told = rows.groupBy("type", "norm").agg(F.sum((F.col("gender") == "m").cast("int")).alias("m"), F.sum((F.col("gender") == "f").cast("int")).alias("f"))
    values = told.select("type", "norm", F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > 0, "f").otherwise("u").alias("gender"))
    table = surrogates(cut(values), secret).select(F.col("type").alias("t2"), F.col("norm").alias("n2"), "made")
    rows = rows.join(table, (F.col("type") == F.col("t2")) & (F.col("norm") == F.col("n2")))
    fits = F.when(F.col("type").isin("phone", "card", "ssn", "iban"), _fitted(F.col("word"), F.col("made"))).otherwise(F.col("made"))
    rows = cut(rows.select("doc", "key", "at", "raw", "head", "type", "value", "w", "word", fits.alias("made")))
    one = rows.select("doc", "key", "at", "raw", "head", "value", F.struct("w", "made").alias("m"))
    one = one.groupBy("doc", "key", "at").agg(F.first("raw").alias("raw"), F.first("head").alias("head"), F.first("value").alias("value"), F.array_sort(F.collect_list("m")).alias("ms"))
    new = F.concat("head", F.array_join(F.transform("ms", lambda m: m["made"]), " "), F.expr("substring(raw, length(head) + length(value) + 1)"))
    swaps = one.groupBy("doc", "key").agg(F.map_from_entries(F.collect_list(F.struct("at", new.alias("new")))).alias("swap"))
    # a word that is a first and a family name in one text recurs as the family's
    named = rows.filter(F.col("type").isin("person", "family")).groupBy("doc", "key", "word").agg(F.min(F.struct("type", "made")).alias("m"))
    named = named.groupBy("doc", "key").agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("m.made").alias("made")))).alias("names"))

    def around(p: Column) -> Column:
        return F.when(F.col("names").isNull(), p).otherwise(F.array_join(F.transform(F.regexp_extract_all(p, F.lit(PIECES), F.lit(0)), lambda x: F.coalesce(F.col("names")[x], x)), ""))

    swapped = F.transform("parts", lambda p, i: F.when(i % 2 == 0, around(p)).otherwise(F.coalesce(F.col("swap")[i], p)))
    doc, key, text, n = fresh(docs, "_doc", "_key", "_text", "_n")
    texts = pieces.join(swaps, ["doc", "key"]).join(named, ["doc", "key"], "left")
    texts = texts.select(F.col("doc").alias(doc), F.col("key").alias(key), F.array_join(swapped, "").alias(text), F.size("swap").cast("long").alias(n))
    old = F.col(text_col).cast("string")
    found_in = hit(old) & F.col(id_col).isNotNull()
    docs = docs.drop("n_entities")
    same = docs.filter(~found_in).withColumn(text_col, old).withColumn("n_entities", F.lit(0).cast("long"))
    changed = docs.filter(found_in).join(texts, (F.col(id_col) == F.col(doc)) & (F.xxhash64(old) == F.col(key)), "left")
    changed = changed.withColumn(text_col, F.coalesce(text, old)).withColumn("n_entities", F.coalesce(n, F.lit(0).cast("long"))).drop(doc, key, text, n)
    return same.unionByName(changed)
