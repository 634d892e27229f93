"""Tiles of crowded shingles: a set travels once for all its cells of a small crowd, and nothing is lost by that."""

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import op2_jaccard as J


def test_cells_of_one_row_meet_in_every_tile():
    r = np.random.default_rng(3)
    sets = [np.sort(r.permutation(48)[: r.integers(38, 46)]).astype(np.uint64) for _ in range(30)]
    first = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    bits = J._bitmaps(first, np.concatenate(sets), J.BITS)
    cells = [[{"tile": int(t), "side": int(r.integers(0, 3))} for t in sorted(set(r.integers(0, 6, 3)))] for _ in sets]
    n = [len(x) for x in sets]
    kind = pa.list_(pa.struct([("tile", pa.int64()), ("side", pa.int32())]))
    t = pa.table({"sig": list(range(30)), "label": [i // 2 for i in range(30)], "n": n, "cells": pa.array(cells, kind), "bits": bits})
    got = {(x["a"], x["b"]) for x in J._tiles_of(t).to_pylist()}
    met = set()
    for a in range(30):
        for b in range(a + 1, 30):
            for x in cells[a]:
                for y in cells[b]:
                    if x["tile"] == y["tile"] and a // 2 != b // 2 and (x["side"], y["side"]) not in ((0, 0), (1, 1)):
                        met.add((a, b))
    linked = {(a, b) for a, b in met if J.DEN * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= J.NUM * len(set(sets[a].tolist()) | set(sets[b].tolist()))}
    assert got <= met and linked <= got and got


@pytest.mark.parametrize("rows", [0, 4_000])
def test_tiles_of_small_and_large_crowds(spark, monkeypatch, rows):
    monkeypatch.setattr(J, "CROWD_ROWS", rows, raising=True)
    sent = []
    bounded = J._tiles
    monkeypatch.setattr(J, "_tiles", lambda *a: sent.append(bounded(*a)) or sent[-1])
    common = " ".join(f"c{i}" for i in range(30))
    texts = [f"{common} " + " ".join(f"{k}w{j}" for j in range(24 + k % 5)) for k in range(12)]
    docs = [(10 * k + i, t + f" tail{i} more") for k, t in enumerate(texts) for i in range(3)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in J.link(d).collect()}
    w = {i: t.split() for i, t in docs}
    s = {i: {tuple(x[j : j + 5]) for j in range(len(x) - 4)} for i, x in w.items()}
    root = {i: i for i in s}
    for _ in s:
        for a in s:
            for b in s:
                if a != b and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root and sent
