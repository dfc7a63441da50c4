"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from msgspark.llm import collocations as C

from .brute import ODD, documents, fold, frame

SCHEMA = "n long, rank string, text string, lang string, phrase string, score long"


def plain(rows, least=10, longest=3, share=50, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {x: n for x, n in counts.items() if len(x[1]) > 1 and n >= least}
    inside = {}
    for (lang, p), n in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(n, inside.get((lang, p[i : i + k]), 0))
    found = {}
    for (lang, p), a in candidates.items():
        if 100 * inside.get((lang, p), 0) >= share * a:
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, totals[lang], -s) for lang, all_ in found.items() for r, (s, a, p, x, y) in enumerate(sorted(all_)[:top], 1))


def texts(seed, n=120):
    rnd = random.Random(seed)
    bag = ["a", "b", "c", "Ä", "ä", "x", "Foo", "foo"] + ["the", "of"] * 3
    return [("".join(rnd.choice(bag) + rnd.choice([" "] * 8 + ["\t", "  ", ". ", ", ", "\n", "!?", " - ", " ", "\x85"]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize(("least", "longest", "share", "top"), [(10, 3, 50, 2000), (2, 4, 30, 2000), (3, 3, 100, 7), (5, 2, 50, 2000), (1, 5, 60, 50)])
def test_against_a_plain_count(spark, least, longest, share, top):
    rows = texts(least)
    df = spark.createDataFrame([(1, "r", t, g, "p", 2) for t, g in rows], SCHEMA).repartition(5)
    got = C.collocations(df, least, longest, share, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, longest, share, top)


def test_documents(spark):
    rows = documents(spark) + [(7, "Twice upon a time. " * 3000), (8, "end word"), (9, "end word")]
    assert sorted(map(tuple, C.collocations(frame(spark, rows)).collect())) == plain([(t, "en") for _, t in rows])


def test_odd_rows(spark):
    rows = [(t, "en") for t in ODD] * 12 + [("w" * 1_000_000 + " x", "de")] * 10 + [("one long piece " * 200_000, "fr"), (None, None), ("", "x")]
    df = spark.createDataFrame([(1, "r", t, g, "p", 2) for t, g in rows], SCHEMA)
    assert sorted(map(tuple, C.collocations(df).collect())) == plain(rows)
    assert C.collocations(df.where("false")).collect() == []
    assert C.collocations(df.where("text = 'one'").limit(3)).collect() == []


def test_scores_pass_64_bits(spark):
    level = spark.createDataFrame([("en", "p q", 3_000_000_000_000, 1, [5_000_000_000_000, 3_000_000_000_000], [4_000_000_000_001, 3_000_000_000_000])], "lang string, phrase string, f long, name long, heads array<long>, tails array<long>")
    row = C.scored(level, 2, None).first()
    assert row.score == 10**6 * 3_000_000_000_000**2 // (5_000_000_000_000 * 4_000_000_000_001)


def test_sequences():
    words, sequence = C.word_sequence(pa.array([b"a b.c", None, b"", b".", b"b A\x0b\x0bd", "Äx a".encode()], pa.large_binary()))
    names = [w.as_py().decode() for w in words]
    assert [None if n == 0 else names[n - 1] for n in sequence] == [None, "a", "b", None, "c", None, "b", "a", None, "d", None, "Äx", "a"]
    assert C.unpack(C.pack(sequence), len(sequence)).tolist() == sequence.tolist()


def test_pairs_of_large_names():
    small = np.array([0, 3, 4, 3, 4, 0, 4, 4])
    large = np.where(small > 0, small + (1 << 40), 0)
    for x in (small, large):
        left, right, counts, at, which = C.pairs(x)
        assert [(a - (x[1] - 3), b - (x[1] - 3), n) for a, b, n in zip(left.tolist(), right.tolist(), counts.tolist())] == [(3, 4, 2), (4, 3, 1), (4, 4, 1)]
        assert at.tolist() == [1, 2, 3, 6] and which.tolist() == [0, 1, 0, 2]
    assert [x.tolist() for x in C.pairs(np.empty(0, np.int64))] == [[]] * 5
