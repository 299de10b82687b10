import random

import numpy as np

from tripleloom.llm import hashing as H


def slow(word):
    return sum((c + 1) * pow(H.BYTE, j, 1 << 64) for j, c in enumerate(word)) % (1 << 64)


def test_words_hash_alike_in_any_block(monkeypatch):
    rng = random.Random(1)
    texts = [b"The cat  sat\non the mat", b"", b"   ", b"x" * 10, b"a b", "éa Ñu".encode(), bytes(rng.choice(b"abcdef") for _ in range(3000)) + b" q"]
    got = H.Hasher().words(texts)
    monkeypatch.setattr(H, "BLOCK", 700)  # the last text's first word takes five blocks
    for w in (got, H.Hasher().words(texts)):
        for i, t in enumerate(texts):
            want = [slow(x) for x in t.translate(H.LOWER).split()]
            assert w.of(i).tolist() == H.mix(np.array(want, np.uint64)).tolist()


def test_runs_hash_alike_anywhere():
    h = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    all_ = H.runs(h, 5)
    assert len(all_) == 46 and all(H.runs(h[i : i + 5], 5)[0] == all_[i] for i in range(46))
    assert len(np.unique(all_)) == 46 and len(H.runs(h[:4], 5)) == 0
