"""Merges replayed by whole arrays: the same ids as by the greedy rule, without a look-up for each pair."""

import random

import public_tokenizers
import pytest

from veilspark.llm import op6_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def want(word, rank):
    return [rank[word]] if word in rank else op6_bpe.greedy(word, rank)


def test_pairs_are_not_looked_up_one_by_one():
    class Counted(dict):
        calls = 0

        def get(self, *a):
            self.calls += 1
            return super().get(*a)

    rank = Counted(op6_bpe.ranks(PATH))
    r = random.Random(1)
    words = {bytes(r.choice(b" etaoinshrdlu019") for _ in range(r.randint(1, 14))) for _ in range(3000)}
    op6_bpe.replay([b"qzxv"], rank)  # makes what a vocabulary needs once
    rank.calls = 0
    got = op6_bpe.replay(words, rank)
    assert rank.calls == 0  # several for each word before
    assert got == {w: want(w, rank) for w in words}


def test_all_bytes_runs_and_long_words(monkeypatch):
    monkeypatch.setattr(op6_bpe, "TURN_WORDS", 70)
    rank = op6_bpe.ranks(PATH)
    r = random.Random(2)
    for alphabet in (b"a", b"ab", bytes(range(256)), "é漢🎉 ".encode(), b"the in"):
        words = [bytes(r.choice(alphabet) for _ in range(r.randint(0, most))) for most in (3, 20, 120, 2 * op6_bpe.LONG_BYTES) for _ in range(60)]
        assert op6_bpe.replay(words, rank) == {w: want(w, rank) for w in words}


@pytest.mark.parametrize("shuffled", [False, True])
def test_any_vocabulary(shuffled):
    """Also such that rank a longer token below the ones it is made of."""
    for seed in range(60):
        r = random.Random(seed)
        tokens = [bytes([c]) for c in range(256)]
        more = [b"a", b"b", b"c"]
        while len(more) < 40:
            t = r.choice(more) + r.choice(more)
            if t not in more and len(t) < 9:
                more.append(t)
        more = more[3:]
        if shuffled:
            r.shuffle(more)
        rank = {t: i for i, t in enumerate(tokens + more)}
        words = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 14))) for _ in range(200)}
        assert op6_bpe.replay(words, rank) == {w: want(w, rank) for w in words}


def test_a_vocabulary_without_some_bytes():
    rank = {b"a": 0, b"b": 1, b"ab": 2, b"bc": 3}
    assert op6_bpe.replay([b"aab", b"abc", b""], rank | {b"c": 4}) == {b"aab": [0, 2], b"abc": [2, 4], b"": []}
    assert op6_bpe.replay([b"aab", b"bbc"], rank) == {b"aab": [0, 2], b"bbc": [1, 3]}
    with pytest.raises(KeyError):
        op6_bpe.replay([b"abc"], rank)


def test_a_group_that_failed_leaves_no_pieces(monkeypatch):
    codec = op6_bpe.Codec(PATH, public_tokenizers.PATTERN)
    first = codec.encode(["qzxv jjwq"])
    with monkeypatch.context() as m:
        m.setattr(op6_bpe, "replay", lambda words, rank: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            codec.encode(["vvkz ppzx"])
    assert codec.encode(["ppzx", "qzxv jjwq"])[1] == first[0]
    assert codec.encode(["ppzx vvkz"]) == op6_bpe.Codec(PATH, public_tokenizers.PATTERN).encode(["ppzx vvkz"])
