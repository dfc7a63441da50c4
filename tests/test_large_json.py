"""JSON files read in parts against the reader of whole documents."""

import json
import random

import pytest
from msgspark.config import Config
from msgspark.functions import json_chunks as C
from msgspark.functions import json_leaves as L
from msgspark.sources import files as S
from msgspark.sources import large_json

from .test_json_leaves import made

ODD = [
    '{"z": "1", "b.c": "2", "n": 5, "o": {"x": "y"}, "z": "3", "a,b": "c,\\"d,\\\\", "n": "6", "b.c": null}',
    '{"a": {"x": "1,2", "q": {"r": "s", "t": ["u,", {"v": "w"}]}}, "b": "2", "a": {"y": "3", "x": "4", "y": "5,"}, "": {"b": "7"}, "c": [1, "2", {"d": "e"}]}',
    '{"a": {"b": {"c,c": {"d": "1", "e": "2"}, "f": "3"}, "g": "4"}, "h": [1, "x,"], "i": "5,", "j": {}}',
    '["a", {"b": "c"}, ["d,e"]]',
    '{"a": "1", "b": {"c": "2"}}, {"d": "3"}',
    '{"a": "1", "b": "2"},',
    '\ufeff{"a": "1", "b": "2"}',
    '{"a": "1", "b": "2, 3}',
]


def whole(reader, *args):
    try:
        return list(reader(*args))
    except L.Malformed:
        return None


@pytest.fixture
def small(spark, monkeypatch):
    """Every file is large, and cut into blocks of a few bytes."""
    monkeypatch.setattr(large_json, "WHOLE", -1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "31b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("text", ODD)
def test_files_in_parts(spark, tmp_path, small, text):
    (tmp_path / "en.json").write_text(text)
    for strict in (False, True):
        want = whole(lambda t, s: L.entries(t, s).items(), text, strict)
        if want is None and strict:
            with pytest.raises(L.Malformed, match="malformed map .*en.json"):
                S.read_entries(spark, str(tmp_path / "en.json"), strict)
        else:
            got = S.read_entries(spark, str(tmp_path / "en.json"), strict).orderBy("seq").collect()
            assert [tuple(r) for r in got] == [(k, v, i) for i, (k, v) in enumerate(want or [])]
    want = whole(L.leaves, text)
    if want is None:
        with pytest.raises(L.Malformed):
            S.read_source_catalog(spark, Config("en", ("de",)), str(tmp_path))
    else:
        got = S.read_source_catalog(spark, Config("en", ("de",)), str(tmp_path)).orderBy("seq").collect()
        assert [tuple(r) for r in got] == [("en", k, v, i) for i, (k, v) in enumerate(want)]


def test_no_task_reads_the_whole_file(spark, tmp_path, monkeypatch):
    """One line without a break, twice as large as what is read whole: several tasks read it, each a part of it."""
    monkeypatch.setattr(large_json, "WHOLE", 1 << 20)
    want = {f"Text {i}, {'x' * (i % 50)}": f"k{i % 7}" for i in range(60_000)}
    (tmp_path / "m.json").write_text(json.dumps(want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        found, _ = large_json.members(spark, str(tmp_path / "m.json"))
        parts = found.selectExpr("shiftright(id, 40) AS part").groupBy("part").count().collect()
        got = S.read_entries(spark, str(tmp_path / "m.json"), True).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(parts) > 8 and max(r["count"] for r in parts) < 10_000
    assert [(r.key, r.value) for r in got] == list(want.items()) and [r.seq for r in got] == list(range(60_000))


def parts_of(text, r):
    """The document's stretches between commas, dealt to parts that begin outside strings."""
    out, inside = [[]], 0
    for s in text.split(","):
        if out[-1] and not inside and r.random() < 0.4:
            out.append([])
        out[-1].append(s)
        inside ^= C.quotes(s) & 1
    return out


def in_parts(text, r):
    """Names, numbers and value of each member that no array holds."""
    parts = parts_of(text, r)
    each = [x for i, p in enumerate(parts) for x in C.read(i, i + 1 == len(parts), p)]
    begins = C.compose([x for x in each if isinstance(x, dict)])
    for m in each:
        if isinstance(m, C.Member):
            levels = begins[m.id >> 40]
            kept = levels[: len(levels) - m.up]
            if all(x.kind == "{" for x in kept):
                yield len(kept[1:]) + m.depth, [x.name for x in kept if x.name is not None] + m.names, m


def test_random_documents_in_random_parts(monkeypatch):
    monkeypatch.setattr(C, "PIECE", 1)
    r, bad = random.Random(4), 0
    for k in range(6000):
        text = made(r).replace("ü", r.choice(["ü", ",", "a,b", '\\\\\\",']))
        if k % 2:
            at = r.randrange(len(text))
            text = text[:at] + r.choice(["", ",", "}", "]", '"', "{", "[", "\\", ":", '","', "},{"]) + text[at + r.randint(0, 2) :]
        want = whole(lambda t: L.entries(t).items(), text)
        try:
            found = list(in_parts(text, r))
        except L.Malformed:
            assert want is None, text
            bad += 1
            continue
        first, last = {}, {}
        for depth, names, m in found:
            if depth == 0:
                first.setdefault(names[0], m.id)
                last[names[0]] = m.value
        assert [(n, last[n]) for n in first if last[n] is not None] == want, text
        leaves = [(names, m.value) for _, names, m in found if m.value is not None]
        assert leaves == [([s.name for s in path], v) for path, v in L.string_leaves(text, repeats=True)], text
    assert 500 < bad < 4000
