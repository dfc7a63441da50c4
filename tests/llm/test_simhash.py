import random
from itertools import combinations

import xxhash
from msgspark.llm import simhash as S

from .brute import SPLIT, documents, fold, frame, unite


def plain(text):
    words = SPLIT.findall(fold(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_every_pair():
    masks = S.covering_masks(2)
    assert all(any(not (1 << a | 1 << b) & m for m in masks) for a, b in combinations(range(64), 2))


def test_groups_against_brute_force(spark):
    rows = documents(spark)
    rows += [(20_000 + i, rows[10][1] + f" tail{i}") for i in range(12)]
    got = S.simhash_groups(frame(spark, rows)).collect()
    prints = [plain(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = unite(distinct, [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, prints)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_links_of_crowded_buckets(spark):
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(500)}
    base = rnd.getrandbits(64)
    prints |= {base ^ sum(1 << rnd.randrange(16) for _ in range(rnd.randint(0, 9))) for _ in range(900)}  # more than PAIRED in a bucket
    for p in list(prints)[:200]:
        prints.add(p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    prints = sorted(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    edges = S.near_fingerprints(spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")).collect()
    want = unite([signed(p) for p in prints], [(signed(a), signed(b)) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2])
    got = unite([signed(p) for p in prints], [(e.a, e.b) for e in edges])
    assert got == want
    assert len(edges) <= 28 * len(prints)


def test_keeps_one_row_of_each_group(spark):
    rows = documents(spark, 40)
    docs = frame(spark, rows)
    kept = S.one_of_each_group(docs)
    assert kept.columns == docs.columns
    groups = {(r.component_id, None if r.component_id is not None else r.fingerprint) for r in S.simhash_groups(docs).collect()}
    assert kept.count() == len(groups)
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in groups}


def test_empty(spark):
    assert S.simhash_groups(frame(spark, [])).collect() == []
    assert S.one_of_each_group(frame(spark, [])).collect() == []


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 997}" for i in range(300_000))
    rows = [(1, long), (2, long + " more words at its end"), (3, "x" * 3_000_000), (4, long)]
    got = {r.doc_id: r for r in S.simhash_groups(frame(spark, rows)).collect()}
    assert [got[i].fingerprint for i, _ in rows] == [f"{plain(t):016x}" for _, t in rows]
    assert got[4].component_id == 1


def test_copies_fold_before_they_meet(spark):
    docs = frame(spark, [(5, "a row of many copies")] * 500 + [(None, "no id")] * 300 + [(None, "other words without id")] + [(6, "a row of many copies")])
    kept = S.one_of_each_group(docs)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(5, "a row of many copies"), (None, "no id"), (None, "other words without id")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
