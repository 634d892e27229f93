"""Neighbour lists of the descent against plain counting."""

import numpy as np
import pyarrow as pa

from veilspark.llm import op9_vectors as V


def test_lists_keep_the_nearest_once():
    r = np.random.default_rng(1)
    u, v, s = r.integers(0, 30, 4000), r.integers(0, 40, 4000), r.integers(0, 50, 4000) / 50
    best = {}
    for a, b, c in zip(u.tolist(), v.tolist(), s.tolist()):
        best[a, b] = max(c, best.get((a, b), -1.0))
    got = V._listed(u, v, s, 7).to_pylist()
    assert [x["u"] for x in got] == sorted(set(u.tolist()))
    for x in got:
        want = sorted((-c, b) for (a, b), c in best.items() if a == x["u"])[:7]
        assert list(zip(x["s"], x["v"])) == [(-c, b) for c, b in want]
    assert V._listed(u[:0], v[:0], s[:0], 7).num_rows == 0


def test_local_join_takes_dimensions_apart():
    x = np.random.default_rng(2).standard_normal((9, 4))
    rows = [(1, i, -2.0, x[i].tobytes()) for i in range(5)] + [(2, 10 + i, -2.0, x[i, :3].tobytes()) for i in range(4)] + [(3, 5, -2.0, x[5].tobytes())]
    t = pa.table({"u": [r[0] for r in rows], "v": [r[1] for r in rows], "worst": [r[2] for r in rows], "x": [r[3] for r in rows]})
    got = {(a["u"], b): c for a in V._local_join(4, 0.98)(t).to_pylist() for b, c in zip(a["v"], a["s"])}
    want = {(i, j): V.pair_cosines(x[i], x[j]) for i in range(5) for j in range(5) if i != j}
    want |= {(10 + i, 10 + j): V.pair_cosines(x[i, :3], x[j, :3]) for i in range(4) for j in range(4) if i != j}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
