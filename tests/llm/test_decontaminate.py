import hashlib

from msgspark.llm import decontaminate as D

from .brute import contamination, documents, frame


def test_against_brute_force(spark):
    rows = documents(spark, 120)
    text = next(t for _, t in rows if t and len(t.split()) > 80)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    words = text.split()
    items += [(900, " ".join(words[5:18])), (901, " ".join(words[20:26])), (902, None), (903, "... !"), (None, " ".join(words[5:18])), (904, " ".join(words[30:42])), (905, " ".join(words[:70])), (905, "one"), (906, "x y " * 30), (907, " ".join(words[40:52]) + " other")]
    rows += [(30_000, " ".join(words[5:17])), (30_001, "Lead in. " + " ".join(words[5:19]).upper()), (30_002, " ".join(words[:10]) + " gap " + " ".join(words[10:30])), (30_003, "X-y " * 12)]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, print string")
    got = D.decontamination(frame(spark, rows), bench).collect()
    want = [(i, n, h, k, hashlib.sha256(s.encode()).hexdigest(), c) for (i, _), (n, h, k, s, c) in zip(rows, contamination(rows, items))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=key) == sorted(want, key=key)
    assert sum(w[2] > 0 for w in want) > 5
    docs = frame(spark, rows)
    kept = D.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)


def test_repetitive_and_very_long_texts(spark):
    """Equal windows fold: a million repetitive words meet a repetitive item without pairs of places."""
    item = "x y " * 2000
    rows = [(1, item), (2, "x y " * 500_000), (3, "lead " * 30 + "x y " * 7 + "tail " * 30), (4, "y x " * 6), (5, " ".join(f"w{i}" for i in range(300_000))), (6, None)]
    bench = spark.createDataFrame([(1, item), (2, "Y x " * 300), (3, " ".join(f"w{i}" for i in range(1000, 1400))), (4, "x y x")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in D.decontamination(frame(spark, rows), bench).collect()}
    assert got == {1: (4000, 4000, 3, True), 2: (1_000_000, 1_000_000, 3, True), 3: (74, 14, 3, True), 4: (12, 11, 1, True), 5: (300_000, 400, 1, False), 6: (0, 0, 0, False)}


def test_stage_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "m", "n"), (1, "a b", 8, "m", "n"), (None, None, 9, "m", None)], "doc_id long, text string, id int, hash string, `row.x` string")
    bench = spark.createDataFrame([(1, "c d")], "item_id long, text string")
    assert sorted(map(tuple, D.clean_documents(docs, bench).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontamination(frame(spark, []), bench).collect() == []
    got = D.decontamination(frame(spark, [(1, "a b")]), bench).first()
    assert (got.n_words, got.n_hit, got.n_items, got.contaminated) == (2, 0, 0, False)
