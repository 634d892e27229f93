"""Codes of the suffix tree: every text's bytes, looked up without sorting all of them."""

import numpy as np

from veilspark.llm import op10_suffix_tree as o


def test_codes_are_looked_up_by_hash(monkeypatch):
    words = [o.words_of(t) for t in ("The cat saw the Cat", None, "", "a", "\u044f \u0434\u043e\u043c", "ab " * 500)]
    seqs = [o.sequence(w) for w in words]
    assert seqs == [o.PAD + b"".join(w + b" " for w in x) + o.END for x in words]
    plain = [int.from_bytes(s[i - o.DEPTH : i + 1][::-1], "big") for s in seqs for i in range(o.DEPTH, len(s))]
    assert o.codes(seqs).tolist() == plain
    code = np.unique(plain)
    known = code, -np.arange(1.0, len(code) + 1)
    counts = dict.fromkeys([w for x in words for w in x], 3) | {None: 6}

    def refuse(*args, **kwargs):
        raise AssertionError("all codes of a group are sorted")

    monkeypatch.setattr(np, "unique", refuse)
    got = o.score_words(known, counts, words, 100, 10)
    assert [g[0] for g in got] == [len(w) + 1 for w in words]
    logs = iter([known[1][np.searchsorted(code, c)] for c in plain])
    for w, g in zip(words, got):
        tree = [sum(next(logs) for _ in range(len(x) + 1)) for x in w] + [next(logs)]
        chance = [np.exp(t) * o.TREE_SHARE + c * (1 - o.TREE_SHARE) / 100 for t, c in zip(tree, [3] * len(w) + [6])]
        assert abs(sum(np.log10(chance)) - g[3]) < 1e-9
