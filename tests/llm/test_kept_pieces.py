"""Pieces that a worker keeps when there are more of them than it may."""

import gc

import public_tokenizers

from veilspark.llm import op6_bpe


def test_pieces_of_the_texts_at_hand_stay(monkeypatch):
    codec = op6_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, kept=6)
    whole = op6_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    replayed, real = [], op6_bpe.replay
    monkeypatch.setattr(op6_bpe, "replay", lambda words, rank: replayed.append(sorted(w := list(words))) or real(w, rank))
    texts = [["qzxv jjwq vvkz"], ["qzxv jjwq ppzx mmqw ttzq"], ["qzxv kkzw"]]
    got = [codec.encode(t) for t in texts]
    assert replayed[1] == [b" mmqw", b" ppzx", b" ttzq"]
    assert got == [whole.encode(t) for t in texts] and len(codec.known) <= 6


def test_collection_is_on_again():
    with op6_bpe.uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()
