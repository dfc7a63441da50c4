"""Leaves, trees, proofs and folds against a plain version."""

import zlib
from hashlib import sha256

import pytest
from msgspark.llm import manifest as M

from .brute import fold

SCHEMA = "source string, text string, extra string, doc_id long, lang string, n_chars long, part long, name long"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text))


def climb(nodes, at=None):
    """The root of some nodes, and what stands before and after the node at a place on its way up."""
    path = []
    while len(nodes) > 1:
        if at is not None:
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            path.append((run[: at % 8], run[at % 8 + 1 :]))
            at //= 8
        nodes = [h(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], path


def plain(rows):
    """Sorted result rows; of equal rows, which have equal leaves, all places are tried."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((((r[0] is not None, r[0] or 0, leaf(*r)), r) for r in rows if r[2] == x), key=lambda y: y[0]) for x in langs}
    subroots = [climb([k[2] for k, _ in trees[x]])[0] for x in langs]
    out = []
    for t, x in enumerate(langs):
        nodes = [k[2] for k, _ in trees[x]]
        for i, (k, r) in enumerate(trees[x]):
            root, high = climb(subroots, t)
            path = climb(nodes, i)[1] + high
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            now = leaf(*r[:4], fold(r[4])) if tampered else k[2]
            for before, after in path:
                now = h([*before, now, *after])
            out.append((r[0], k[2], subroots[t], root, h(s for a, b in path for s in a + b), now, now == root))
    return sorted(out, key=repr)


def rows_of(n, langs):
    return [(i, None if i % 11 == 0 else f"s{i % 3}", langs[i % len(langs)], None if i % 5 == 0 else i, None if i % 7 == 0 else f"Text {i} Ünï" * (i % 4)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(s, t, "x", i, g, n, 1, 2) for i, s, g, n, t in rows], SCHEMA)


@pytest.mark.parametrize(("n", "langs", "leaves", "fan"), [(1, ["en"], 4096, 64), (2, [None, "en"], 4096, 64), (8, ["en"], 3, 2), (9, ["en"], 4, 2), (150, ["en"], 7, 2), (150, ["en", None, "é", "z", "und"], 5, 3), (90, [f"l{i}" for i in range(80)], 4, 2), (65, ["a"], 64, 64), (600, ["a", "a", "a", "b"], 16, 4)])
def test_against_a_plain_version(spark, monkeypatch, n, langs, leaves, fan):
    monkeypatch.setattr(M, "LEAVES", leaves)
    monkeypatch.setattr(M, "FAN", fan)
    rows = rows_of(n, langs)
    got = M.manifest(frame(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    """Null ids, ids that tie with other texts, repeated rows, empty and very long texts, no rows."""
    monkeypatch.setattr(M, "LEAVES", 6)
    rows = rows_of(40, ["en", None]) + [(None, "s", "en", 1, "A null id"), (None, "s", "en", 1, "Another"), (5, "s", "en", 1, "Same id"), (7, None, None, None, None), (8, "", "", 0, ""), (9, "s", "en", 1, "LONG " * 300_000)] + [(12, "s", "en", 1, "SAME")] * 20
    got = sorted(map(tuple, M.manifest(frame(spark, rows)).collect()), key=repr)
    assert got == plain(rows)
    assert M.manifest(frame(spark, rows).where("false")).collect() == []


def test_the_forest_does_not_care_about_order_or_grouping():
    nodes = [h([str(i)]) for i in range(75)]
    want, _ = climb(nodes)
    for step in (1, 3, 10, 75):
        forests = []
        for i in range(0, 75, step):
            f = M.Forest(1)
            for at in reversed(range(i, min(75, i + step))):
                f.add(1, 75, 0, at, nodes[at])
            forests.append(f)
        whole = M.Forest(1)
        for f in forests[::2] + forests[1::2]:
            for (tree, level, place), run in f.open.items():
                whole.merge(tree, 75, level, place, run)
            whole.root = whole.root or f.root
        assert whole.root == want and not whole.open
