"""Sources, sinks and the streaming extension."""

import json

import pytest
from msgspark.config import Config
from msgspark.functions.text import source_hash
from msgspark.sources import files as S
from msgspark.streaming.incremental import follow


def test_read_sources(spark, tmp_path):
    for name in ("src/a.tsx", "src/deep/b.ts", "src/deep/b.test.ts", "node_modules/c.ts"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"// {name}\n")
    got = {r.path: r.content for r in S.read_sources(spark, str(tmp_path), ["src/**/*.{ts,tsx}"], ["**/*.test.ts"]).collect()}
    assert got == {"src/a.tsx": "// src/a.tsx\n", "src/deep/b.ts": "// src/deep/b.ts\n"}


def test_string_maps(spark, tmp_path):
    (tmp_path / "lock.json").write_text('{"a": "1", "b": "2", "a": "3"}')
    (tmp_path / "bad.json").write_text("{ not json")
    assert {r.key: r.hash for r in S.read_string_map(spark, str(tmp_path / "lock.json"), True).collect()} == {"a": "3", "b": "2"}
    assert S.read_string_map(spark, str(tmp_path / "none.json"), True).collect() == []
    assert S.read_string_map(spark, str(tmp_path / "bad.json"), False).collect() == []
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|malformed"):
        S.read_string_map(spark, str(tmp_path / "bad.json"), True).collect()


def test_split_catalog(spark, tmp_path):
    rows = [("en", "a.b.c", "1", 0), ("en", "top", "2", 1), ("de", ".x", "3", 2)]
    df = spark.createDataFrame(rows, "locale string, key string, value string, seq long")
    path = str(tmp_path / "catalog")
    S.write_split(df, path)
    S.write_split(df.where("locale = 'de'").withColumn("value", source_hash("value")), path)
    got = {(r.locale, r.key): r.value for r in S.read_split(spark, path).collect()}
    assert got["en", "a.b.c"] == "1" and got["en", "top"] == "2" and len(got["de", ".x"]) == 16
    assert S.read_split(spark, str(tmp_path / "none")).collect() == []


def test_stream(spark, tmp_path):
    schema = "locale string, key string, value string, seq long"
    spark.createDataFrame([("en", "a", "old", 0), ("en", "a", "new", 1), ("en", "b", "same", 2)], schema).write.parquet(str(tmp_path / "in"))
    lock = spark.createDataFrame([("en", "b", "same")], "locale string, key string, v string").select("locale", "key", source_hash("v").alias("hash"))
    seen = []
    follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: lock, lambda df, epoch: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.key, r.value) for r in seen] == [("a", "new")]


def test_writers(spark, tmp_path):
    rows = [("de", "a.b", "Ä", 1), ("de", "a.c", 'q"', 2), ("fr", "a.b", "é", 1), ("fr", "x", "y", 0)]
    catalog = spark.createDataFrame(rows, "locale string, key string, value string, seq long")
    folder = f"file://{tmp_path}/messages"
    assert S.write_catalogs(catalog, folder) == ["de.json", "fr.json"]
    assert (tmp_path / "messages/de.json").read_text() == json.dumps({"a": {"b": "Ä", "c": 'q"'}}, indent=2, ensure_ascii=False) + "\n"
    S.write_catalogs(catalog, folder, flat=True)
    assert (tmp_path / "messages/fr.json").read_text() == '{\n  "x": "y",\n  "a.b": "é"\n}\n'
    assert sorted(p.name for p in (tmp_path / "messages").iterdir()) == ["de.json", "fr.json"]
    mapping = spark.createDataFrame([("Two", "k.b", 2), ("One", "k.a", 1), ("Uno", "k.a", 3)], "text string, key string, seq long")
    S.write_map(mapping, folder)
    assert json.loads((tmp_path / "messages/map.json").read_text()) == {"One": "k.a", "Two": "k.b", "Uno": "k.a"}
    S.write_map(mapping.where("false"), folder, "empty.json")
    assert (tmp_path / "messages/empty.json").read_text() == "{}\n"
    with pytest.raises(ValueError, match="several"):
        S.write_documents(spark.createDataFrame([("a", "1"), ("a", "2")], "name string, document string"), folder)
    assert not (tmp_path / "messages/a").exists()


def test_source_locale(spark, tmp_path):
    mapping = spark.createDataFrame([("Two", "k.b", 2), ("One", "k.a", 1), ("Uno", "k.a", 3)], "text string, key string, seq long")
    want = {("k.a", "Uno"), ("k.b", "Two")}
    for split in (False, True):
        folder = f"file://{tmp_path}/{split}"
        c = Config("en", ("de",), split_by_namespace=split)
        S.write_source_locale(mapping, c, folder)
        got = S.read_source_catalog(spark, c, folder)
        assert {(r.key, r.value) for r in got.collect()} == want and {r.locale for r in got.collect()} == {"en"}
    c = Config("en", ("de",), mode="inline", inline_component="@/t")
    S.write_source_locale(mapping, c, f"file://{tmp_path}/inline")
    assert not (tmp_path / "inline").exists()
    S.write_map(mapping, f"file://{tmp_path}/inline")
    assert {(r.key, r.value) for r in S.read_source_catalog(spark, c, f"file://{tmp_path}/inline").collect()} == want


def test_stale_partitions_are_deleted(spark, tmp_path):
    schema, folder = "locale string, key string, value string, seq long", f"file://{tmp_path}/split"
    assert S.write_split(spark.createDataFrame([("de", "a.x", "1", 1), ("de", "b/c.x", "2", 2), ("fr", "b.x", "3", 1)], schema), folder) == []
    assert S.write_split(spark.createDataFrame([("de", "a.y", "4", 1)], schema), folder) == [("de", "b/c")]
    assert sorted((r.locale, r.key, r.value) for r in S.read_split(spark, folder).collect()) == [("de", "a.y", "4"), ("fr", "b.x", "3")]


def test_context_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a.b": {"tag": "p"}, "a.c": {"tag": "b"}}')
    (tmp_path / "bad.json").write_text('{"a.b": {')
    assert {(r.key, json.loads(r.context)["tag"]) for r in S.read_context(spark, f"file://{tmp_path}/c.json").collect()} == {("a.b", "p"), ("a.c", "b")}
    assert S.read_context(spark, f"file://{tmp_path}/bad.json").collect() == [] == S.read_context(spark, f"file://{tmp_path}/none.json").collect()
