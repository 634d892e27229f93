"""Texts scanned in plain Python against the column functions, and work that is dealt over all cores."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators.detect import detect
from veilspark.operators.text_rules import recognizer
from veilspark.plans import queries as Q

PIECES = [
    "серия 45 10, номер 123456", "номер документа 45 10 123456", "паспорт 4510 № 123456", "выдано: ОВД Хамовники,", "кем выдан  отделом. 5", "12.05.2010", "31.02.1999", "2001-02-29", "1 мая 2003", "1985",
    "код подразделения 770-001", "ИНН 7707083893", "500100732259", "заказ", "4111 1111 1111 1111", "4111-1111-1111-1112", "cvv 123", "пин 1234", "сумма", "держатель IVAN PETROV", "Anna.X@post.example.com",
    "горячая линия", "+7 (912) 345-67-89", "тел", "Иванов Иван Петрович", "гражданство: Россия", "Южная Корея", ". армении ,", "родился в 1980 году в городе Омск, паспорт", "Адрес: г. Москва, ул. Ленина, д. 5;",
    "водительское удостоверение 99 12 345678", "İΣΑ", "🎉", "  ", "\n\n", "—", "\x01", "\x1c", "<EMAIL_3>", ".", ";", "слово", "word", "дата рождения",
]
#: Queries whose work a single small file must not put into one task.
DEALT = ["mask_documents", "resolve_entities", "detokenize_roundtrip", "pii_kind_counts", "token_mappings", "prf_by_type", "residual_text"]


def test_scan_gives_what_the_column_functions_give(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(PIECES) + r.choice([" ", "  ", "", ", ", ". ", "\n"]) for _ in range(r.randint(0, 25))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate([*texts, "", None, "  "])), "doc_id long, text string").repartition(4)
    plain, columns = ({x["doc_id"]: x["entities"] for x in detect(d, find).select("doc_id", "entities").collect()} for find in (None, recognizer()))
    assert plain == columns and sum(map(len, filter(None, plain.values()))) > 800 and plain[301] is None


@pytest.mark.parametrize("name", DEALT)
def test_one_file_is_many_tasks(spark, name, tmp_path):
    spark.createDataFrame([(i, f"почта a{i}@b.ru") for i in range(200)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(400).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = Q.dealt(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p"), (F.col("doc_id") < 1_000_000_000).alias("document")).count().collect()
    assert all(sum(r["document"] == kind for r in got) >= spark.sparkContext.defaultParallelism for kind in (True, False))
    plan = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition ") + plan.count("RepartitionByExpression") >= 2


def test_an_address_like_a_hotline_is_no_mail_left(spark, tmp_path):
    spark.createDataFrame([(1, "почта a@b.ru"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(8799, 8802).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    texts = {r["doc_id"]: r["text"] for r in Q.texts(spark, str(tmp_path)).collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["mail_left"]) for r in Q.residual_text(spark, str(tmp_path)).collect()}
    assert got == {k: (len(t.encode()), False) for k, t in texts.items() if t is not None}
