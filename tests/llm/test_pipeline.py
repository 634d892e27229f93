from collections import Counter

import corpus_pipeline as cp
from veilspark.llm import op7_mix


def test_stages(spark, tmp_path):
    text = lambda k: " ".join(f"word{k}x{i % 37} and the other" for i in range(60))
    rows = [(i, text(i % 20), "en", f"s{i % 3}", 10) for i in range(40)] + [(90, None, "en", "s0", 0), (91, "123 456", "en", "s0", 7), (92, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = cp.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert not ids & {90, 91, 92}
        if name in ("line_dedup", "near_duplicates"):
            assert ids == set(range(20))
    last = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count() == cp.run(spark, str(tmp_path)).count()


def test_null_and_repeated_ids(spark, tmp_path):
    """Null ids, ids that two texts share, and equal rows: none is lost, and none is taken more than three times a row."""
    text = lambda k: " ".join(f"word{k}x{i % 37} and the other" for i in range(60))
    rows = [(i, text(i), "en", f"s{i % 3}", 10) for i in range(20)]
    rows += [(None, text(100 + i), "en", f"s{i % 3}", 10) for i in range(6)] + [(5, text(200), "en", "s0", 10), (6, text(201), "en", None, 10), (None, text(202), "en", None, 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES[:3]:
        docs = cp.cut(stage(spark, docs, str(tmp_path)))
        assert sorted(docs.collect(), key=str) == sorted(spark.read.parquet(str(tmp_path / "documents.parquet")).collect(), key=str), name
    again = docs.union(docs.filter("doc_id < 4 or doc_id is null"))
    for given in (docs, again):
        plan = Counter()
        for r in op7_mix.mix(given).collect():
            plan[r["doc_id"], r["source"]] += r["copies"]
        out = cp.source_mix(spark, given, str(tmp_path))
        got = Counter(tuple(r) for r in out.collect())
        rows_of = Counter(tuple(r) for r in given.collect())
        assert all(n <= 3 * rows_of[r] for r, n in got.items())
        taken = Counter()
        for r, n in got.items():
            taken[r[0], r[3]] += n
        assert taken == +plan and sum(n for (i, _), n in taken.items() if i is None) > 0
        assert cp.STAGES[-1][1](spark, out, str(tmp_path)).count() == sum(plan.values())
