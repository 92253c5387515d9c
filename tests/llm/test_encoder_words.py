"""A worker's encoder keeps half a million words, so that those of later batches are not encoded again."""

import numpy as np

from tallyglass.llm import tokenbin


def test_half_a_million_words_are_encoded_once(monkeypatch):
    e = tokenbin.Encoder(tokenbin.default_vocabulary(), "<u2")
    text, fresh = " ".join(f"w{k:x}" for k in range(500_000)), []
    first, own = e.encode([text]), e._fresh
    monkeypatch.setattr(e, "_fresh", lambda words: fresh.extend(words) or own(words))
    again = e.encode([text])
    assert np.array_equal(first[0], again[0]) and not fresh
