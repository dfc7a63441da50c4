"""String leaves of JSON documents against a plain reader that builds the tree."""

import json
import random

import pytest
from msgspark.functions import json_leaves as L
from msgspark.operators import catalogs
from msgspark.sources import files as S


def plain(tree, key=""):
    out = {}
    for name, value in tree.items():
        here = f"{key}.{name}" if key else name
        if isinstance(value, str):
            out[here] = value
        elif isinstance(value, dict):
            out |= plain(value, here)
    return out


def made(r, depth=0):
    """A random document's text; names repeat, and so do dotted keys."""
    kind = r.choice(["object"] * 4 + ["string"] * 3 + ["array", "other"]) if depth else "object"
    if kind == "object" and depth < 5:
        pairs = [f"{json.dumps(r.choice(['a', 'b', 'c', 'a.b', '', 'é', 'q' + chr(34)]))}{r.choice(['', ' '])}:{made(r, depth + 1)}" for _ in range(r.randint(0, 4))]
        return "{ " + ", ".join(pairs) + "}"
    if kind == "array":
        return "[" + ",".join(made(r, depth + 1) for _ in range(r.randint(0, 3))) + "]"
    return r.choice(["1", "-0.5e+3", "true", "false", "null"]) if kind == "other" else json.dumps(r.choice(["x", "ü\n", "\\", "😀", ""]))


def test_random_documents():
    r = random.Random(3)
    for _ in range(4000):
        text = made(r)
        assert L.leaves(text) == list(plain(json.loads(text)).items()), text


@pytest.mark.parametrize("text", ["", " ", "{", "}", "{]", '{"a"}', '{"a":}', '{"a":1,}', "{'a':1}", '{"a":01}', '{"a":NaN}', '{"a":"\n"}', '{"a":"x" "b":1}', "[1,]", "{} {}", '{"a":"\\x"}', '{"a":[1 2]}', '{"a":1}]'])
def test_malformed(text):
    with pytest.raises(L.Malformed):
        L.leaves(text)


@pytest.mark.parametrize("text", ["[]", '["a"]', '"a"', "1", "null", ' {"a": [{"b": "c"}], "n": {"o": null}} '])
def test_without_leaves(text):
    assert L.leaves(text) == []


def test_order_and_repeats():
    assert L.leaves('{"z": "1", "a": {"y": "2", "b": "3"}, "z": "4"}') == [("z", "4"), ("a.y", "2"), ("a.b", "3")]
    assert L.leaves('{"a": {"x": "1"}, "b": "2", "a": {"y": "3"}}') == [("a.y", "3"), ("b", "2")]
    assert L.leaves('{"a": {"x": "1"}, "b": "2", "a": 5}') == [("b", "2")]
    assert L.leaves('{"": {"a": "1"}, "a": "2"}') == [("a", "2")]
    assert L.leaves('{"a": "\\ud800"}') == [("a", "�")]
    deep = '{"a":' * 20_000 + '"x"' + "}" * 20_000
    assert [len(k) for k, _ in L.leaves(deep)] == [39_999]
    assert L.leaves(f'{{"b": "1", "c": {deep}, "b": "2"}}')[0] == ("b", "2")


def test_flatten_keeps_order(spark):
    rows = [(1, '{"z": "1", "a": {"y": "2", "b": ["no"], "c": "3"}}'), (2, None), (3, "{"), (4, "[]"), (5, '{"k": "' + "x" * 300_000 + '"}')]
    df = spark.createDataFrame(rows, "`key` long, `a.j` string")
    got = catalogs.flatten_json(df.withColumnRenamed("a.j", "seq"), "seq", "key", place="at").toDF("id", "key", "value", "seq").orderBy("id", "seq").collect()
    assert [(r.id, r.key, r.value[:3], r.seq) for r in got] == [(1, "z", "1", 0), (1, "a.y", "2", 1), (1, "a.c", "3", 2), (5, "k", "xxx", 0)]
    with pytest.raises(Exception, match="Malformed"):
        catalogs.flatten_json(df.withColumnRenamed("a.j", "j"), "j", "key", strict=True).collect()
    assert catalogs.flatten_json(df.where("false").withColumnRenamed("a.j", "j"), "j").collect() == []
    plan = catalogs.flatten_json(df.withColumnRenamed("a.j", "j"), "j", "key")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_string_maps_of_odd_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"z": "1", "b.c": "2", "n": 5, "o": {"x": "y"}, "z": "3"}')
    assert [(r.key, r.value, r.seq) for r in S.read_entries(spark, str(tmp_path / "m.json"), False).collect()] == [("z", "3", 0), ("b.c", "2", 1)]
    with pytest.raises(Exception, match="malformed"):
        S.read_entries(spark, str(tmp_path / "m.json"), True).collect()
    (tmp_path / "c.json").write_text('{"a": {"tag": "p"}, "a": {"tag": "b"}}')
    assert [(r.key, r.context) for r in S.read_context(spark, str(tmp_path / "c.json")).collect()] == [("a", '{"tag":"b"}')]


def test_source_catalog_in_file_order(spark, tmp_path):
    from msgspark.config import Config

    (tmp_path / "en.json").write_text('{"z": "1", "m": {"y": "2", "a": "3"}, "b": "4", "z": "5"}')
    got = S.read_source_catalog(spark, Config("en", ("de",)), str(tmp_path)).orderBy("seq").collect()
    assert [(r.locale, r.key, r.value, r.seq) for r in got] == [("en", "z", "5", 0), ("en", "m.y", "2", 1), ("en", "m.a", "3", 2), ("en", "b", "4", 3)]
    (tmp_path / "map.json").write_text('{"Two": "k.z", "One": "k.a", "Three": "k.z"}')
    got = S.read_source_catalog(spark, Config("en", ("de",), mode="inline", inline_component="@/t"), str(tmp_path)).orderBy("seq").collect()
    assert [(r.key, r.value, r.seq) for r in got] == [("k.z", "Three", 0), ("k.a", "One", 1)]
