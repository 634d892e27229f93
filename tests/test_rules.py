"""Detection: recognizers, context, resolving, and what must stay untouched.  Sentences are our own."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions.patterns import any_of, to_java
from veilspark.operators import text_rules as R
from veilspark.operators.detect import detect, residual
from veilspark.operators.normalize import kept_positions, normalized
from veilspark.operators.validators import valid_card, valid_dmy, valid_inn, valid_iso

CASES = [
    ("Звоните по номеру +7 (912) 345-67-89 или пишите на anna@post.ru", {("PHONE", "+7 (912) 345-67-89"), ("EMAIL", "anna@post.ru")}),
    ("Паспорт 45 10 123456 выдан ОВД района Хамовники, 12.05.2010, код подразделения 770-001", {("PASSPORT", "45 10 123456"), ("PASSPORT_ISSUER", "ОВД района Хамовники"), ("DEPARTMENT_CODE", "770-001")}),
    ("ИНН 7707083893", {("INN", "7707083893")}),
    ("номер карты 4111 1111 1111 1111, CVV 123", {("CARD_NUMBER", "4111 1111 1111 1111"), ("CVV", "123")}),
    ("дата   рождения: 12.03.1985", {("BIRTH_DATE", "12.03.1985")}),
    ("дата рождения: 31.02.1985", set()),
    ("паспорт выдан 01.02.2015", {("PASSPORT_ISSUE_DATE", "01.02.2015")}),
    ("водительское удостоверение 99 12 345678", {("DRIVER_LICENSE", "99 12 345678")}),
    ("Клиент Иванов Иван Петрович", {("FULL_NAME", "Иванов Иван Петрович")}),
    ("гражданство: Россия", {("CITIZENSHIP", "Россия")}),
    ("Адрес проживания: г. Москва, ул. Ленина, д. 5; далее", {("ADDRESS", "г. Москва, ул. Ленина, д. 5")}),
    ("Заказ номер 4111111111111112 в кабинет 305", set()),
    ("Встреча в 2019 году, комната 123", set()),
    ("", set()),
]


@pytest.fixture(scope="module")
def found(spark):
    d = spark.createDataFrame(list(enumerate(t for t, _ in CASES)) + [(99, None)], "doc_id long, text string")
    return {r["doc_id"]: r for r in detect(d).withColumn("left", residual(F.col("text"), F.col("entities"))).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_entities(found, i):
    assert {(x["type"], x["text"]) for x in found[i]["entities"]} == CASES[i][1]


def test_spans_fit_the_text_and_the_residual_keeps_bytes(found):
    assert found[99]["entities"] is None
    for i, (t, _) in enumerate(CASES):
        at = 0
        for x in found[i]["entities"]:
            assert t[x["s"] : x["e"]] == x["text"] and x["s"] >= at
            at = x["e"]
        assert len(found[i]["left"].encode()) == len(t.encode())


def test_normalize(spark):
    t = "А—Б   ВΣ  İ\tx"
    r = spark.createDataFrame([(t,)], "t string").select(normalized(F.col("t")).alias("n"), kept_positions(F.col("t")).alias("k")).first()
    assert r["n"] == "а-б вσ i x"
    assert [t[k] for k in r["k"]] == list("А—Б ВΣ İ\tx")


def test_validators(spark):
    d = spark.createDataFrame([("7707083893", "4111111111111111", "29.02.2000", "2001-02-28"), ("7707083894", "4111111111111112", "29.02.1900", "2001-02-30"), ("1111111111", "0000000000000000", "1.1.85", "1899-01-01"), ("500100732259", "4111 1111-1111 1111", "1/12/2100", "2100-12-31")], "a string, b string, c string, d string")
    got = d.select(valid_inn(F.col("a")), valid_card(F.col("b")), valid_dmy(F.col("c")), valid_iso(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (False, False, False, False), (False, False, False, False), (True, True, True, True)]


def test_word_edges_are_ascii(spark):
    r = spark.createDataFrame([("серия45 10",)], "t string").select(F.regexp_extract_all("t", F.lit(to_java(r"\b\d{2}\b")), F.lit(0))).first()
    assert r[0] == ["45", "10"]
    assert any_of(("код", "код карты", "a.b")) == "a\\.b|код"


@pytest.mark.parametrize(
    ("text", "want"),
    [("cvv: 123", ["123"]), ("код безопасности 1 2 3", ["1 2 3"]), ("cvv 1234", []), ("cvv сумма 123", []), ("123 — это cvv", ["123"]), ("cvv; 123", []), ("cvv 123, сумма 5", ["123"]), ("xcvv 123", []), ("cvv. он. тут 123", [])],
)
def test_cvv(text, want):
    assert [text[s:e] for s, e in R.cvv(text)] == want


def test_walking_rules():
    known = frozenset({"россия", "южная корея", "канада", "армения"})
    assert [t[s:e] for t in ["(россия), и армении в канаде; южная корея"] for s, e in R.citizenship(t, known)] == ["(россия"[:6], "армении", "канаде", "южная корея"]
    assert [t[s:e] for t in ["родился в 1980 году в городе омск, паспорт 1"] for s, e in R.birth_place(t)] == ["городе омск"]
    first, last = frozenset({"иван"}), frozenset({"кузнец"})
    got = list(R.full_name("иван, кузнец и иван петрович кузнец смирнов", first, last, frozenset()))
    assert [round(x[2], 6) for x in got] == [0.75, 1.0]
    assert [t[s:e] for t in ["адрес: улица мира 5, телефон 1"] for s, e in R.address(t, frozenset({"улица"}))] == ["улица мира 5"]
