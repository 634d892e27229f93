"""Every table that operator 2 writes has a small plan: the driver plans each anew after each of its shuffles."""

import re

from veilspark.llm import op2_jaccard as J


def test_tables_have_small_plans(spark, monkeypatch):
    plans = []
    cut = J.cut
    monkeypatch.setattr(J, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    common = " ".join(f"c{i}" for i in range(30))
    texts = [f"{common} " + " ".join(f"{k}w{j}" for j in range(24 + k % 5)) for k in range(12)]
    docs = [(10 * k + i, t + f" tail{i} more") for k, t in enumerate(texts) for i in range(3)]
    got = J.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: i - i % 10 for i, _ in docs}
    assert max(len(re.findall(r"(?m)^[ :+-]*(?:Join|Aggregate) ", p)) for p in plans) <= 10, sorted(len(p) for p in plans)[-3:]
