"""Operators on the examples and invariants that fix their meaning."""

import json
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from msgspark import config
from msgspark.functions.text import source_hash
from msgspark.operators import catalogs, graph, keys, planning, scanning, validation
from msgspark.plans import keygen
from msgspark.plans import translate as P
from pyspark.sql import functions as F

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def catalog(spark, entries, locale="es"):
    return spark.createDataFrame([(locale, k, v, i) for i, (k, v) in enumerate(entries.items())], "locale string, key string, value string, seq long")


def lock_of(spark, entries, locale="es"):
    rows = spark.createDataFrame([(locale, k, v) for k, v in entries.items()], "locale string, key string, value string")
    return rows.select("locale", "key", source_hash("value").alias("hash"))


@pytest.mark.parametrize(
    ("source", "target", "lock", "want"),
    [
        ({"t": "Hello", "n": "New"}, {"t": "Hola"}, {"t": "Hello"}, {"n": ("added", "New"), "t": ("unchanged", "Hola")}), ({"t": "Hello 2"}, {"t": "Hola"}, {"t": "Hello"}, {"t": ("modified", "Hello 2")}),
        ({"t": "Hello"}, {"t": "Hola", "o": "Old"}, {"t": "Hello"}, {"t": ("unchanged", "Hola"), "o": ("removed", None)}), ({"a": "1", "b": "2"}, {"a": "x", "b": "y"}, {}, {"a": ("modified", "1"), "b": ("modified", "2")}),
        ({}, {}, {"gone": "x"}, {}), ({"a": "1"}, {}, {"a": "1"}, {"a": ("added", "1")}), ({"a": "1"}, {"a": ""}, {"a": "1"}, {"a": ("unchanged", "")}),
    ],
)
def test_diff(spark, source, target, lock, want):
    d = catalogs.catalog_diff(catalog(spark, source), catalog(spark, target), lock_of(spark, lock))
    assert {r.key: (r.status, r.value) for r in d.collect()} == want


def test_lock_is_kept_for_each_locale(spark):
    """A run of one locale must not hide another's stale translations."""
    src = catalog(spark, {"t": "New"}).union(catalog(spark, {"t": "New"}, "fr"))
    tgt = catalog(spark, {"t": "Hola"}).union(catalog(spark, {"t": "Salut"}, "fr"))
    lock = lock_of(spark, {"t": "Old"}).union(lock_of(spark, {"t": "Old"}, "fr"))
    done = catalog(spark, {"t": "Nuevo"})
    after = catalogs.lock_upsert(src, lock, done)
    status = {r.locale: r.status for r in catalogs.catalog_diff(src, tgt, after).collect()}
    assert status == {"es": "unchanged", "fr": "modified"}


def test_flatten_and_unflatten(spark):
    doc = {"a": {"b": "x", "c": {"d": "y"}, "e": [1, "z"], "f": 3, "g": None, "h": {}}, "i": "w", "j": True}
    df = spark.createDataFrame([("en", json.dumps(doc))], "locale string, j string")
    flat = {r.key: r.value for r in catalogs.flatten_json(df, "j", "locale").collect()}
    assert flat == {"a.b": "x", "a.c.d": "y", "i": "w"}
    again = catalogs.unflatten_documents(catalog(spark, flat, "en"), "locale").first().document
    assert json.loads(again) == {"a": {"b": "x", "c": {"d": "y"}}, "i": "w"} and again.endswith("}\n")


def test_any_depth_is_read(spark):
    deep = '{"a": ' * 30 + '"x"' + "}" * 30
    df = spark.createDataFrame([(1, deep), (2, "no json"), (3, None), (4, "[1]"), (5, '{"a": "y"}')], "path int, j string")
    assert sorted(map(tuple, catalogs.flatten_json(df, "j", "path").collect())) == [(1, ".".join("a" * 30), "x"), (5, "a", "y")]


def test_pick_messages(spark):
    c = catalog(spark, {"nav": "1", "nav.a.b": "2", "navy": "3", "x.nav": "4", "form.a": "5"})
    assert {r.key for r in catalogs.pick_messages(c, spark.createDataFrame([("nav",), ("form.a",)], "ns string")).collect()} == {"nav", "nav.a.b", "form.a"}


@pytest.mark.parametrize(
    ("existing", "new", "want"),
    [(["auth.signIn"], ["auth.signIn"], ["auth.signIn2"]), ([], ["a.k", "a.k", "a.k2"], ["a.k", "a.k2", "a.k22"]), (["a.k", "a.k2"], ["a.k", "b.k", "a.k"], ["a.k3", "b.k", "a.k4"]), ([], [], [])],
)
def test_collisions(spark, existing, new, want):
    proposed = spark.createDataFrame([(k, i) for i, k in enumerate(new)], "key string, seq long")
    got = keys.resolve_collisions(proposed, spark.createDataFrame([(k,) for k in existing], "key string"))
    assert [r.final_key for r in sorted(got.collect(), key=lambda r: r.seq)] == want


def test_leaf_and_branch(spark):
    m = lambda *ks: spark.createDataFrame([(f"t{i}", k, i) for i, k in enumerate(ks)], "text string, key string, seq long")
    names = lambda df: [r.final_key for r in sorted(df.collect(), key=lambda r: r.seq)]
    assert names(keys.rename_conflicts(m("a.b", "a.b.c", "z"))) == ["a.bLabel", "a.b.c", "z"]
    assert names(keys.rename_conflicts(m("a.b", "a.b.c", "a.bLabel"))) == ["a.bLabel2", "a.b.c", "a.bLabel"]


@FEW
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=3).map(".".join), unique=True, max_size=12))
def test_renaming_leaves_no_conflict(spark, names):
    m = spark.createDataFrame([(f"t{i}", k, i) for i, k in enumerate(names)], "text string, key string, seq long")
    out = [r.final_key for r in keys.rename_conflicts(m).collect()]
    assert len(set(out)) == len(names) and not [a for a in out for b in out if b.startswith(a + ".")]


def test_unanimous(spark):
    rows = [("x", "a.b"), ("x", "a.c"), ("y", "a.b"), ("y", "c.b"), ("z", "a"), ("z", "a.b")]
    assert {r.f: r.ns for r in keys.unanimous_namespace(spark.createDataFrame(rows, "f string, key string"), "f").collect()} == {"x": "a", "y": None, "z": None}


def test_supplement(spark):
    strings = spark.createDataFrame([("a", "t-call", "k1", 1), ("a", "T-component", "k2", 2), ("b", "t-call", "k3", 3), ("c", "jsx-text", "k4", 4), ("d", "t-call", None, 5), ("e", "T-component", "k6", 6)], "text string, type string, id string, seq long")
    got = keys.supplement_map(spark.createDataFrame([("e", "old")], "text string, key string"), strings)
    assert {r.text: r.key for r in got.collect()} == {"a": "k2", "b": "k3", "e": "old"}
    assert {r.text for r in keys.bare_strings(strings).collect()} == {"c"}


@pytest.mark.parametrize(("tokens", "target", "most", "want"), [([4, 4], 2000, 50, 1), ([1] * 10, 99999, 3, 4), ([9], 1, 50, 1), ([], 5, 5, 0), ([3, 2, 1], 5, 50, 2), ([9, 1, 9], 5, 50, 3)])
def test_batches(spark, tokens, target, most, want):
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(tokens)], "g string, seq long, tokens long")
    rows = planning.token_batches(df, "g", target_tokens=target, max_entries=most).collect()
    assert len({r.batch_id for r in rows}) == want and len(rows) == len(tokens)


@FEW
@given(st.lists(st.integers(1, 12), max_size=30), st.integers(1, 20), st.integers(1, 6))
def test_batch_invariants(spark, tokens, target, most):
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(tokens)], "g string, seq long, tokens long")
    rows = sorted(planning.token_batches(df, "g", target_tokens=target, max_entries=most).collect(), key=lambda r: r.seq)
    ids = [r.batch_id for r in rows]
    assert ids == sorted(ids) and sorted(set(ids)) == list(range(len(set(ids))))
    for b in set(ids):
        own = [r.tokens for r in rows if r.batch_id == b]
        assert len(own) <= most and (sum(own) <= target or len(own) == 1)


def context_by_hand(rows, limit):
    out = set()
    for wave in sorted({r[3] for r in rows}):
        own = {r[0].split(".")[0] for r in rows if r[3] == wave}
        seen = sorted((r for r in rows if r[3] < wave), key=lambda r: (r[0].split(".")[0] not in own, r[3], r[2]))[:limit]
        out |= {(wave, r[0], i + 1) for i, r in enumerate(seen) if r[1]}
    return out


def test_wave_context(spark):
    rows = [(f"{'abcde'[i * 7 % 5]}.k{i}", "" if i % 4 == 0 else "v", i, i // 6) for i in range(48)]
    df = spark.createDataFrame([("es", *r) for r in rows], "locale string, key string, value string, seq long, wave_id long")
    got = {(r.wave_id, r.key, r["rank"]) for r in planning.wave_context(df, "locale", limit=5).collect()}
    assert got == context_by_hand(rows, 5)


@FEW
@given(st.lists(st.sampled_from(["{a}", "{b}", "%s", "x"]), max_size=6), st.lists(st.sampled_from(["{a}", "{b}", "%s", "x"]), max_size=6))
def test_bag_difference(spark, a, b):
    pairs = spark.createDataFrame([(1, " ".join(a), " ".join(b))], "id int, source string, translated string")
    r = validation.placeholder_check(pairs).first()
    ca, cb = Counter(x for x in a if x != "x"), Counter(x for x in b if x != "x")
    assert (r.missing, r.extra) == (sorted((ca - cb).elements()), sorted((cb - ca).elements())) and r.valid == (ca == cb)
    rows = validation.placeholder_diff(pairs, "id").collect()
    assert {x.placeholder: x.missing - x.extra for x in rows} == {k: ca[k] - cb[k] for k in ca | cb if ca[k] != cb[k]}


def test_siblings_and_headings(spark):
    rows = [("f", "c", "h2", i, t) for i, t in enumerate(["A", "B", "A", "D", "E", "F", "G"])] + [("f", None, "p", 9, "alone"), ("g", "c", "p", 1, "x")]
    df = spark.createDataFrame(rows, "file string, component string, tag string, seq long, text string")
    got = {(r.file, r.seq): (r.siblings, r.heading) for r in scanning.enrich(df).collect()}
    assert got["f", 0] == (["B", "A", "D", "E", "F"], None) and got["f", 6] == (["A", "B", "A", "D", "E"], "A")
    assert got["f", 2] == (["A", "B", "D", "E", "F"], None) and got["f", 9] == (None, "A") and got["g", 1] == (None, None)


def test_reachability_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 6), (3, None)], "src int, dst int")
    assert {r.node for r in graph.reachable(spark.createDataFrame([(1,), (9,)], "node int"), edges).collect()} == {1, 2, 3, 9}


def test_link_priority(spark):
    files = spark.createDataFrame([("a/x.ts",), ("a/x/index.tsx",), ("a/y/index.ts",), ("a/z.tsx",), ("a/w.css",)], "file string")
    asked = spark.createDataFrame([("m", b) for b in ("a/x", "a/y", "a/z.js", "a/w.css", "a/none")], "importer string, base string")
    assert {r.base: r.file for r in graph.resolve_links(asked, files).collect()} == {"a/x": "a/x/index.tsx", "a/y": "a/y/index.ts", "a/z.js": "a/z.tsx", "a/w.css": "a/w.css"}


# The translation plan


class Flaky:
    """Fails or loses placeholders so many times, then answers."""

    def __init__(self, errors=0, losses=0):
        self.left, self.losses, self.calls = errors, losses, 0

    def __call__(self, entries, locale, context):
        self.calls += 1
        if self.left:
            self.left -= 1
            raise RuntimeError("down")
        lost = self.losses > 0
        self.losses -= 1
        return {k: "gone" if lost else v for k, v in entries.items()}, 10, 5


def test_retries_and_fallback():
    waits = []
    o = P.Options(retries=2, wait=waits.append)
    assert P.attempt(Flaky(errors=2), {"a": "{x}"}, "es", [], o) == ({"a": "{x}"}, 10, 5, True) and waits == [1, 2]
    waits.clear()
    assert P.attempt(Flaky(losses=1), {"a": "{x}"}, "es", [], o) == ({"a": "{x}"}, 20, 10, True) and waits == []
    assert P.attempt(Flaky(losses=9), {"a": "{x}"}, "es", [], o) == ({"a": "gone"}, 30, 15, False)
    with pytest.raises(RuntimeError):
        P.attempt(Flaky(errors=9), {"a": "x"}, "es", [], o)
    second = Flaky()
    assert P.with_fallback(Flaky(errors=9), second, {"a": "x"}, "es", [], o)[0] == {"a": "x"} and second.calls == 1
    with pytest.raises(ValueError, match="missing"):
        P.attempt(lambda e, locale, c: ({}, 1, 1), {"a": "x"}, "es", [], o)


def failing_in_french(entries, locale, context):
    if locale == "fr":
        raise RuntimeError("no French")
    return {k: f"{v}!{len(context)}" for k, v in entries.items()}, 7, 3


def test_run_publishes_whole_locales(spark):
    src = catalog(spark, {f"n.k{i}": f"v{i}" for i in range(7)}).union(catalog(spark, {"n.k0": "v0"}, "fr"))
    tgt = catalog(spark, {"n.k0": "alt", "gone": "x"}).union(catalog(spark, {"old": "vieux"}, "fr"))
    lock = lock_of(spark, {"n.k0": "v0"}).union(lock_of(spark, {"old": "o"}, "fr"))
    out = P.run(src, tgt, lock, failing_in_french, options=P.Options(retries=0, max_entries=2, concurrency=2, wait=lambda s: None))
    got = {(r.locale, r.key): r.value for r in out.catalog.collect()}
    assert got["es", "n.k0"] == "alt" and got["fr", "old"] == "vieux" and ("es", "gone") not in got and ("fr", "n.k0") not in got
    assert got["es", "n.k1"] == "v1!0" and got["es", "n.k5"] == "v5!4" and len(got) == 8
    assert {(r.locale, r.key) for r in out.lock.collect()} == {("es", f"n.k{i}") for i in range(7)} | {("fr", "old")}
    report = {r.locale: r.asDict() for r in out.report.collect()}
    assert report["es"]["tokens_in"] == 21 and report["fr"]["errors"] == 1 and report["es"]["removed"] == 1
    dry = P.run(src, tgt, lock, failing_in_french, dry=True)
    assert {r.locale: (r.added, r.removed) for r in dry.report.collect()} == {"es": (6, 1), "fr": (1, 1)}
    with pytest.raises(P.CostLimit):
        P.run(src, tgt, lock, failing_in_french, max_usd=0.0, prices=(1.0, 1.0))
    assert {r.status for r in P.run(src, tgt, lock, failing_in_french, force=True, dry=True).diff.where(F.col("key") == "n.k0").where("locale = 'es'").collect()} == {"modified"}


def greedy(rows, target, most):
    out, state = [], {}
    for group, seq, t in sorted(rows):
        batch, total, count = state.get(group, (0, 0, 0))
        if count and (total + t > target or count >= most):
            batch, total, count = batch + 1, 0, 0
        state[group] = (batch, total + t, count + 1)
        out.append((group, seq, batch))
    return out


def test_token_batches_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(planning, "CHUNK", 60)
    rnd = random.Random(3)
    rows = [(g, i, rnd.choice([1, 5, 30, 120, 400])) for g, n in (("a", 700), ("b", 40), ("c", 121), (None, 130)) for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, seq long, tokens long")
    for target, most in ((300, 50), (2000, 7), (10_000, 50), (1, 1)):
        got = planning.token_batches(df, "g", target_tokens=target, max_entries=most).collect()
        assert sorted((r.g or "", r.seq, r.batch_id) for r in got) == greedy([(g or "", i, t) for g, i, t in rows], target, most)


def sequential_names(rows, taken):
    used, out = set(taken), []
    for key, seq in sorted(rows, key=lambda x: x[1]):
        name, n = key, 2
        while name in used:
            name, n = f"{key}{n}", n + 1
        used.add(name)
        out.append((key, seq, name))
    return sorted(out, key=str)


def test_collisions_against_one_stream(spark):
    rnd = random.Random(5)
    bag = ["a.b", "a.b2", "a.b3", "a.b22", "a.c", "nodot", "nodot2", "x.y1", "x.y", "z.only"]
    rows = [(rnd.choice(bag), i) for i in range(120)] + [("q.alone", 500)]
    taken = ["a.b", "x.y12", "far.off"]
    got = keys.resolve_collisions(spark.createDataFrame(rows, "key string, seq long"), spark.createDataFrame([(t,) for t in taken], "key string"))
    assert sorted(map(tuple, got.collect()), key=str) == sequential_names(rows, taken)
    got = keys.resolve_collisions(spark.createDataFrame(rows, "key string, seq long"), spark.createDataFrame([], "key string"))
    assert sorted(map(tuple, got.collect()), key=str) == sequential_names(rows, [])


def test_renames_against_one_stream(spark):
    rnd = random.Random(6)
    bag = ["a", "a.b", "a.b.c", "a.bLabel", "a.bLabel.x", "aLabel", "aLabel2", "a.bLabel2", "k", "k.v.w", "kLabel.z"]
    rows = [(f"t{i}", rnd.choice(bag), i) for i in range(60)]
    every = {k for _, k, _ in rows}
    hits = {k for k in every if any(o.startswith(k + ".") for o in every)}
    used, want = set(every), []
    for t, k, i in rows:
        name, n = k, 2
        if k in hits:
            used.discard(k)
            name = f"{k}Label"
            while name in used:
                name, n = f"{k}Label{n}", n + 1
            used.add(name)
        want.append((t, k, i, name))
    got = keys.rename_conflicts(spark.createDataFrame(rows, "text string, key string, seq long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


class Moody:
    """Fails at first for one batch in each process; gives keys of one part too."""

    def __init__(self, fails):
        self.fails, self.calls = fails, 0

    def __call__(self, strings, known):
        self.calls += 1
        if self.calls <= self.fails:
            raise RuntimeError("busy")
        return {**{i: "save" if s["text"].startswith("S") else "form.name" for i, s in enumerate(strings)}, 99: "x.y"}, 10, 5


def test_generate_keys(spark):
    strings = spark.createDataFrame([("Save", 3, "src/app/b/page.tsx", "Form"), ("Send", 1, "src/app/a/page.tsx", None), ("Name", 2, "src/app/a/page.tsx", None), ("Last name", 4, "src/x.tsx", "Z"), ("Save", 9, "z", "Z"), ("Old", 5, "z", "")], "text string, seq long, file string, component string")
    mapping = spark.createDataFrame([("Old", "form.name", 1), ("Gone", "gone.text", 2)], "text string, key string, seq long")
    used, seen = [], []
    options = P.Options(max_entries=2, retries=2, wait=lambda s: None)
    got = keygen.generate_keys(strings, mapping, Moody(2), options=options, on_usage=lambda a, b: used.append((a, b)), on_progress=lambda a, b: seen.append((a, b)))
    assert sorted(map(tuple, got.collect())) == [("Last name", "form.name3", 4), ("Name", "form.name2", 2), ("Old", "form.name", 1), ("Save", "form.save", 3), ("Send", "a.save", 1)]
    assert used == [(20, 10)] and seen == [(4, 4)]
    with pytest.raises(keygen.KeyGenerationFailed, match="busy"):
        keygen.generate_keys(strings, mapping, Moody(99), options=options)
    assert keygen.generate_keys(strings, mapping, Moody(99), keygen.StubKeys(), options=options).count() == 5
    assert [tuple(r) for r in keygen.generate_keys(strings.where("text = 'Old'"), mapping, Moody(99), options=options).collect()] == [("Old", "form.name", 1)]


def test_confirmation_and_progress(spark):
    source = catalog(spark, {"a.b": "x", "a.c": "y"}, "de")
    target, lock = catalog(spark, {}, "de"), spark.createDataFrame([], "locale string, key string, hash string")
    asked, seen, used = [], [], []
    r = P.run(source, target, lock, P.StubTranslator(), confirm=lambda usd: asked.append(usd))
    assert asked == [None] and r.report.count() == 0 and r.catalog.count() == 0
    r = P.run(source, target, lock, P.StubTranslator(), confirm=lambda usd: usd > 0, prices=(1.0, 2.0), on_progress=lambda a, b: seen.append((a, b)), on_usage=lambda a, b: used.append((a, b)))
    assert r.catalog.count() == 2 and seen == [(2, 2)] and used == [(100, 50)]


def test_imports_of_sources(spark):
    files = [("src/app/a.tsx", '"use client"; import x from "./b"; import y from "#lib/c"; import type { T } from "./t";'), ("src/app/b/index.ts", 'export * from "@/d.js"; import "react";'), ("src/lib/c.ts", 'const z = () => import("~/e");'), ("src/d.ts", ""), ("e.mjs", 'import "/src/app/a";'), ("src/app/t.ts", ""), ("src/app/bad.ts", "import ( {"), ("src/app/none.ts", None)]
    df = spark.createDataFrame(files, "path string, content string")
    aliases = config.path_aliases('{"compilerOptions": {"paths": {"#lib/*": ["src/missing/*", "src/lib/*"]}}}')
    edges = graph.import_edges(graph.file_facts(df), aliases)
    assert sorted(map(tuple, edges.collect())) == [("e.mjs", "src/app/a.tsx"), ("src/app/a.tsx", "src/app/b/index.ts"), ("src/app/a.tsx", "src/lib/c.ts"), ("src/app/b/index.ts", "src/d.ts"), ("src/lib/c.ts", "e.mjs")]
    assert {r.path for r in graph.client_files(df, aliases).collect()} == {"src/app/a.tsx", "src/app/b/index.ts", "src/lib/c.ts", "src/d.ts", "e.mjs"}


def test_token_batches_scan_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(planning, "CHUNK", 60)
    monkeypatch.setattr(planning, "FAN", 2)
    rnd = random.Random(4)
    rows = [(g, i, rnd.choice([1, 5, 30, 120, 400])) for g, n in (("a", 700), ("b", 61), (None, 300)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, seq long, tokens long")
    got = planning.token_batches(df, "g", target_tokens=900, max_entries=20).collect()
    assert sorted((r.g or "", r.seq, r.batch_id) for r in got) == greedy([(g or "", i, t) for g, i, t in rows], 900, 20)
    whole = planning.token_batches(df.where("g = 'a'").select("seq", "tokens"), target_tokens=900, max_entries=20).collect()
    assert sorted(("", r.seq, r.batch_id) for r in whole) == greedy([("", i, t) for g, i, t in rows if g == "a"], 900, 20)


def test_fixed_batches_of_odd_groups(spark):
    rows = [("a", i) for i in range(7)] + [(None, 1), (None, 2), ("a", None)]
    got = planning.fixed_batches(spark.createDataFrame(rows, "g string, seq long"), ["g"], 3).collect()
    assert sorted((r.g or "", r.seq or -1, r.batch_id) for r in got) == sorted([("", 1, 0), ("", 2, 0)] + [("a", -1 if s is None else s or -1, b) for s, b in [(None, 0), (0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2)]])
    plan = planning.fixed_batches(spark.createDataFrame(rows, "g string, seq long"), ["g"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan or "_part" in plan
    assert planning.fixed_batches(spark.createDataFrame([], "g string, seq long"), ["g"], 3).collect() == []


def test_collisions_of_many_kinds_against_one_stream(spark):
    rnd = random.Random(9)
    for bag in (["k", "k2", "k22", "k222", "m", "m02", "m2"], ["a1", "a12", "a2", "b", "c9", "c99", "c10"], ["x", "y", "z7"]):
        rows = [(rnd.choice(bag), i) for i in range(150)]
        taken = [rnd.choice(bag) + str(rnd.randint(0, 40)) for _ in range(60)] + ["k", "y", "x02", "x" + "9" * 30, None]
        got = keys.resolve_collisions(spark.createDataFrame([*rows, (None, 999)], "key string, seq long"), spark.createDataFrame([(t,) for t in taken], "key string"))
        found = sorted(map(tuple, got.where("key IS NOT NULL").collect()), key=str)
        assert found == sequential_names(rows, [t for t in taken if t])
        assert [tuple(r) for r in got.where("key IS NULL").collect()] == [(None, 999, None)]


def test_a_million_proposals_with_a_million_taken_names(spark):
    n = 1_000_000
    proposed = spark.range(n).select(F.lit("a.key").alias("key"), (n - F.col("id")).alias("seq"))
    taken = spark.range(n).select(F.concat(F.lit("a.key"), (2 * F.col("id") + 2).cast("string")).alias("key"))  # all even numbers
    got = keys.resolve_collisions(proposed, taken)
    row = got.agg(F.count_distinct("final_key").alias("n"), F.max("final_key").alias("x"), F.sum(F.when(F.col("final_key") == "a.key", 1).otherwise(F.substring("final_key", 6, 20).cast("long"))).alias("s"), F.max_by("final_key", "seq").alias("last")).first()
    assert row.n == n and row.s == n * n and row.last == f"a.key{2 * n - 1}"  # the odd numbers
    assert "FlatMapCoGroups" in got._jdf.queryExecution().optimizedPlan().toString()  # only for keys that feed each other, of which there are none
    assert keys.resolve_collisions(proposed.where("false"), taken).collect() == []


def test_module_declarations(spark):
    catalog = spark.createDataFrame([("en", "b.x"), ("en", "a.y"), ("en", "top"), ("de", "z.z")], "locale string, key string")
    locales = spark.createDataFrame([("en",), ("en",), ("fr",), (None,)], "locale string")
    module = 'declare module "next-intl" {\n  interface AppConfig {\n    Messages: %s;\n  }\n}\n'
    got = dict(map(tuple, catalogs.module_declarations(catalog, locales).collect()))
    assert got["en"] == 'import _root from "./en/_root.json";\nimport a from "./en/a.json";\nimport b from "./en/b.json";\n\ntype Messages = {\n  _root: typeof _root;\n  a: typeof a;\n  b: typeof b;\n};\n\n' + module % "Messages"
    assert got["fr"] == "type Messages = Record<string, never>;\n\n" + module % "Messages" and len(got) == 2
    got = dict(map(tuple, catalogs.module_declarations(catalog, locales, split=False).collect()))
    assert got["fr"] == 'import messages from "./fr.json";\n\n' + module % "typeof messages" and len(got) == 2


def test_client_namespaces(spark):
    sites = spark.createDataFrame([("a", "x.k"), ("a", "x.l"), ("b", "y.k"), ("c", "x.k"), ("c", "plain"), (None, "z.k"), ("a", None)], "file string, key string")
    clients = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "path string")
    assert [tuple(r) for r in keys.client_namespaces(sites, clients).collect()] == [("x", 2)]


def test_keys_are_asked_for_in_alphabetical_order(spark):
    names = ["b", "B", "é", "e", "É", "Zebra", "_x", "ab", None, "Äpfel", "apfel"]
    strings = spark.createDataFrame([(f"t{i}", i, "f.tsx", n) for i, n in enumerate(names)], "text string, seq long, file string, component string")
    want = [None, "_x", "ab", "apfel", "Äpfel", "b", "B", "e", "é", "É", "Zebra"]
    assert [r.component for r in keys.keygen_order(strings).orderBy("rank").collect()] == want
    seen = keygen.generate_keys(strings, spark.createDataFrame([], "text string, key string, seq long"), keygen.StubKeys(), options=P.Options(max_entries=3))
    assert seen.count() == len(names)
