"""Nested documents written in parts, against a plain writer that builds the tree."""

import json
import random

import pytest
from msgspark.operators import catalogs
from msgspark.sources import files as S

SCHEMA = "seq long, value string, locale string, key string, part string"


def tree(rows):
    root = {}
    for key, value in rows:
        *path, leaf = key.split(".")
        node = root
        for p in path:
            if not isinstance(node.get(p), dict):
                node[p] = {}
            node = node[p]
        node[leaf] = value
    return root


def written(spark, rows, folder, flat=False, parts=None):
    df = spark.createDataFrame([(s, v, loc, k, "x") for loc, k, v, s in rows], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if parts:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        names = S.write_catalogs(df, f"file://{folder}", flat)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return {n: (folder / n).read_text() for n in names}


def whole(found):
    """The tree without objects that are empty: an object whose entries are all gone isn't written."""
    return {k: w for k, v in found.items() if (w := whole(v) if isinstance(v, dict) else v) != {}}


@pytest.mark.parametrize(("parts", "seed"), [(1, 1), (3, 2), (7, 3), (16, 4)])
def test_random_catalogs(spark, tmp_path, parts, seed):
    rnd = random.Random(seed)
    rows = []
    for locale in ("de", "en", "fr-CA"):
        for i in range(60):
            key = ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
            rows.append((locale, key, rnd.choice(["x", "ü\\n\n\"", "", "😀 "]) + str(i), i * 3 + 1))
    rnd.shuffle(rows)
    got = written(spark, rows, tmp_path, parts=parts)
    assert set(got) == {"de.json", "en.json", "fr-CA.json"}
    for locale in ("de", "en", "fr-CA"):
        want = whole(tree([(k, v) for loc, k, v, s in sorted(rows, key=lambda r: r[3]) if loc == locale]))
        assert got[f"{locale}.json"] == json.dumps(want, indent=2, ensure_ascii=False) + "\n"
    flat = written(spark, rows, tmp_path, True, parts)
    for locale in ("de", "en", "fr-CA"):
        assert flat[f"{locale}.json"] == json.dumps(dict((k, v) for loc, k, v, s in sorted(rows, key=lambda r: r[3]) if loc == locale), indent=2, ensure_ascii=False) + "\n"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["de.json", "en.json", "fr-CA.json"]


@pytest.mark.parametrize(
    "keys",
    [["a", "a.b"], ["a.b", "a"], ["a.b", "a", "a.c"], ["x", "a.b", "y", "a", "z", "a.c"], ["a", "b", "a"], ["a.b.c", "a.b", "a.b.d", "a.e"], ["a.b", "q", "a", "a.c.d", "r", "a.c"], ["", ".", "a.", ".a", "a..b"]],
)
def test_leaves_that_are_branches(spark, tmp_path, keys):
    rows = [("en", k, f"v{i}", i) for i, k in enumerate(keys)]
    assert written(spark, rows, tmp_path, parts=3)["en.json"] == json.dumps(whole(tree([(k, v) for _, k, v, _ in rows])), indent=2, ensure_ascii=False) + "\n"


def test_odd_rows(spark, tmp_path):
    rows = [("en", None, "x", 1), ("en", "a", None, 2), (None, "a", "x", 3)]
    assert written(spark, rows, tmp_path) == {}
    assert written(spark, [*rows, ("en", "k" * 50_000, "v" * 200_000, 4)], tmp_path) == {"en.json": json.dumps({"k" * 50_000: "v" * 200_000}, indent=2) + "\n"}
    assert S.write_catalogs(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none") == []


def test_no_document_is_gathered(spark):
    rows = spark.createDataFrame([(1, "v", "en", "a.b", "x")], SCHEMA)
    plan = catalogs.document_lines(catalogs.document_order(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "collect_list" not in plan
