import random
import zlib

from msgspark.llm.sharding import minimax_cuts, shard_documents

SCHEMA = "doc_id long, text string, shard string, slot string"


def greedy(sizes, capacity):
    n, left = 1, capacity
    for s in sizes:
        if s > left:
            n, left = n + 1, capacity
        left -= s
    return n


def smallest(sizes, shards):
    c = max(max(sizes), -(-sum(sizes) // shards))
    while greedy(sizes, c) > shards:
        c += 1
    return c


def test_capacity_is_the_smallest(spark):
    rnd = random.Random(1)
    for n, top in ((40, 9), (300, 2000), (25, 1), (500, 100000)):
        sizes = [rnd.randint(1, top) for _ in range(n)]
        keys = sorted({rnd.randrange(-(2**63), 2**63) for _ in range(2 * n)})[:n]
        groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, bytes long")
        cuts, capacity = minimax_cuts(groups, 7)
        assert capacity == smallest(sizes, 7)
        loads = [0] * 7
        for k, s in zip(keys, sizes):
            loads[sum(k > c for c in cuts)] += s
        assert max(loads) == capacity


def test_law_bytes(spark):
    rows = [(i, "x" * (i % 50), "a", "b") for i in range(400)] + [(None, None, None, None), (1, "é", "", ""), (1, "é", "", "")] + [(1000 + i, "copy " * 9, "", "") for i in range(200)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), 16).collect()
    assert len(got) == len(rows)
    by = {}
    texts = {}
    want = sorted((r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32, r["size"]) for r in got) == want
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard <= 15 and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
        texts.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(len(v) == 1 for v in texts.values())


def test_empty(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA), 16).collect() == []


def test_very_long_texts_and_many_equal_rows(spark):
    rows = [(1, "é" * 2_000_000, "", "")] + [(2, "same", "", "")] * 3000 + [(i, f"t{i}", "", "") for i in range(3, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = shard_documents(df, 16).collect()
    long = [r for r in got if r.doc_id == 1]
    assert [(r["size"], r.text_crc32) for r in long] == [(4_000_001, zlib.crc32(("é" * 2_000_000).encode()))]
    same = [r for r in got if r.doc_id == 2]
    assert len(same) == 3000 and len({r.shard for r in same}) == 1
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
