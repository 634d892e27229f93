"""Cutting texts into chunks for models, and chunks into batches."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import ordered_fold

TARGET, MOST, OVERLAP = 300, 350, 50
MAX_ITEMS, MAX_CODE_POINTS = 32, 11_200


def boundaries(text: str) -> list[int]:
    """Places after a line break, or after a sentence's end before a space or line break."""
    return [i for i in range(1, len(text)) if text[i - 1] == "\n" or (text[i - 1] in ".?!" and text[i] in " \n")]


def chunk_spans(text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Chunks end at the boundary nearest to the target, the earlier of two; where there is none they are cut and overlap."""
    places, start, n = boundaries(text), 0, len(text)
    while start < n:
        if start + target >= n:
            yield start, n
            return
        top = min(start + most, n)
        near = places[bisect_left(places, max(start + 1, start + target - overlap)) : bisect_right(places, top)]
        end = min(near, key=lambda p: (abs(p - start - target), p)) if near else top
        yield start, end
        if end >= n:
            return
        start = end if near else end - overlap


def chunked(docs: DataFrame, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, chunk_ix, start_cp, end_cp, text)``; null and empty texts have no chunks.  Long texts are sent in Arrow batches and cut by one scan."""
    if not 0 < target <= most or not 0 <= overlap < most:
        raise ValueError("chunk sizes must satisfy 0 < target <= most and 0 <= overlap < most")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(p["doc_id"], p["text"]) for k, (s, e) in enumerate(chunk_spans(t, target, most, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_ix", "start_cp", "end_cp", "text"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    return d.mapInPandas(run, f"doc_id {kind}, chunk_ix int, start_cp int, end_cp int, text string")


def take_batch(items: DataFrame, max_items: int = MAX_ITEMS, max_code_points: int = MAX_CODE_POINTS) -> DataFrame:
    """``(queue, seq, size)`` rows with ``taken``: the prefix of each queue that fits a batch."""
    w = Window.partitionBy("queue").orderBy("seq")
    fits = (F.row_number().over(w) <= max_items) & (F.sum("size").over(w) <= max_code_points)
    return items.withColumn("taken", fits)


def batches(items: DataFrame, max_items: int = MAX_ITEMS, max_code_points: int = MAX_CODE_POINTS, wait_ms: float = 5.0) -> DataFrame:
    """``(queue, seq, batch)`` of ``(queue, seq, at_ms, size)``: a batch closes when full, or ``wait_ms`` after its first item.

    An ordered fold for each queue; one queue is one stream of requests, so its order is the work itself.
    """

    def step(state, row):
        batch, n, size, opened = state
        if opened is None or n + 1 > max_items or size + row.size_ > max_code_points or row.at_ms - opened > wait_ms:
            batch, n, size, opened = batch + 1, 0, 0, row.at_ms
        return (batch, n + 1, size + row.size_, opened), (row.queue, row.seq, batch)

    kind = items.schema["queue"].dataType.simpleString()
    rows = items.select("queue", F.col("seq").cast("long").alias("seq"), F.col("at_ms").cast("double").alias("at_ms"), F.col("size").cast("long").alias("size_"))
    return ordered_fold(rows, ["queue"], ["at_ms", "seq"], lambda: (-1, 0, 0, None), step, f"queue {kind}, seq long, batch int")
