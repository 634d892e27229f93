"""Line dedup writes what is read more than once, and nothing else."""

from veilspark.llm import op8_lines


def test_two_tables_are_written(spark, monkeypatch):
    written = []
    cut = op8_lines.cut
    monkeypatch.setattr(op8_lines, "cut", lambda df: written.append(df.columns) or cut(df))
    docs = spark.createDataFrame([(1, "a first line\nb second line"), (2, "b second line\nc third line"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in op8_lines.dedup(docs).collect()}
    assert got == {1: (0, "a first line\nb second line"), 2: (1, "c third line"), 3: (0, None), 4: (0, "")}
    assert written == [["doc", "key", "f", "at", "lines"], ["f", "a"]]
