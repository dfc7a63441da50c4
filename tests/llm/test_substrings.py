import hashlib
import random
from collections import Counter

import numpy as np
from msgspark.llm import substrings as U

from .brute import documents, frame, repeated_words


def compare(spark, rows, length, gram):
    got = U.remove_repeated(frame(spark, rows), length=length, gram=gram).collect()
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, g, k) in zip(rows, repeated_words(rows, length))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(want, key=key)
    return sum(w[2] > 0 for w in want)


def test_against_brute_force(spark):
    rows = documents(spark, 120)
    assert compare(spark, rows, 35, 12) > 5


def test_short_windows_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(U, "HOT", 3)
    rnd = random.Random(1)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(120):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60))]
        if i % 3:
            copy = list(passage)
            copy[rnd.randrange(30)] = f"e{rnd.randrange(4)}"
            at = rnd.randint(0, len(words))
            words[at:at] = copy
        rows.append((i, " ".join(words)))
    assert compare(spark, rows, 9, 4) > 60


def test_index_counts_patterns():
    rnd = np.random.default_rng(3)
    symbols = np.append(rnd.integers(1, 5, 400), 0)
    index = U.FMIndex(symbols, 12)
    text = symbols.tolist()
    for n in (1, 2, 5, 8, 11):
        for at in rnd.integers(0, 380, 20):
            pattern = text[at : at + n]
            lo, hi = np.array([0]), np.array([index.n])
            for s in reversed(pattern):
                lo, hi = index.extend(np.array([s]), lo, hi)
            assert hi[0] - lo[0] == sum(text[i : i + n] == pattern for i in range(len(text)))


def test_index_is_compressed():
    """Words of a steep distribution: about the entropy and some ranks, under plain 32-bit symbols by far."""
    rnd = np.random.default_rng(5)
    symbols = np.append(np.unique(np.minimum(rnd.zipf(1.3, 200_000), 50_000), return_inverse=True)[1] + 1, 0)
    index = U.FMIndex(symbols, 40)
    p = np.bincount(symbols) / len(symbols)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    print(f"{index.bits:.1f} bits a symbol, entropy {entropy:.1f}")
    assert index.bits < 1.25 * (entropy + 1) + 1.1 + 64 * 1.2 * len(p) / len(symbols)  # ranks, often bits, and two numbers for each node


def test_repeated_and_single_stretches_go_through_the_index():
    rnd = random.Random(8)
    stretches = [[rnd.randint(1, 6) for _ in range(rnd.randint(6, 14))] for _ in range(60)]
    weights = [rnd.choice([1, 1, 1, 3]) for _ in stretches]
    symbols = np.array([x for s in stretches for x in (*s, 0)])
    ends = np.cumsum([len(s) + 1 for s in stretches]) - 1
    begins = ends - np.array([len(s) for s in stretches])
    seen = Counter()
    for s, w in zip(stretches, weights):
        for i in range(len(s) - 5):
            seen[tuple(s[i : i + 6])] += w
    want = [b + i for s, b in zip(stretches, begins) for i in range(len(s) - 5) if seen[tuple(s[i : i + 6])] > 1]
    assert np.flatnonzero(U.repeated_starts(symbols, begins, ends, np.array(weights), 6)).tolist() == want


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, "x y " * 150_000), (3, " ".join(f"w{i}" for i in range(1000, 1040))), (4, "x y " * 20), (5, "z")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in U.remove_repeated(frame(spark, rows)).collect()}
    assert got == {1: (300_000, 40), 2: (300_000, 300_000), 3: (40, 40), 4: (40, 40), 5: (1, 0)}


def test_empty(spark):
    assert U.remove_repeated(frame(spark, [])).collect() == []
    assert U.remove_repeated(frame(spark, [(1, None), (2, "")])).count() == 2
