"""Column functions on the examples that fix their meaning."""

import time

import pytest
from msgspark.functions import text as T
from pyspark.sql import functions as F


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'map<string,string>' if isinstance(v, dict) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hello {name}, you have %d <strong>items</strong>", ["%d", "</strong>", "<strong>", "{name}"]), ("{n} and {n}", ["{n}", "{n}"]), ("{{user.name}} {0} %s %@ %.2f", ["%.2f", "%@", "%s", "{0}", "{{user.name}}"]),
        ("<br/> <a href='x'>", ["<a href='x'>", "<br/>"]), ("none", []), ("", []),
    ],
)
def test_placeholders(spark, text, want):
    assert one(spark, T.placeholders("t"), t=text) == want


@pytest.mark.parametrize(
    ("text", "ignored"),
    [("sign-in", False), ("API", False), ("my-css-class", True), ("API_KEY", True), ("V2", True), ("$1,000", True), ("https://x", True), ("😀", True), ("", True), (" ﻿", True), ("Größe", False), ("日本", False), ("  Save ", False), ("100%", True)],
)
def test_ignored_texts(spark, text, ignored):
    assert one(spark, T.is_ignored_text("t"), t=text) is ignored


def test_lengths_and_tokens(spark):
    assert one(spark, T.utf16_length("t"), t="a😀") == 3
    assert [one(spark, T.estimate_tokens("t"), t=x) for x in ("", "abcd", "abcde", "😀😀😀")] == [1, 1, 2, 2]
    assert one(spark, T.entry_tokens("k", "t"), k="abcd", t="abcdefgh") == 3
    assert one(spark, T.trim_unicode("t"), t="﻿  a b \n") == "a b"


@pytest.mark.parametrize(("key", "ns", "segment", "part", "rest"), [("a.b.c", "a", "a", "a", "b.c"), ("a", None, "a", "_root", "a"), (".a", None, None, "_root", ".a")])
def test_namespaces(spark, key, ns, segment, part, rest):
    assert [one(spark, f("k"), k=key) for f in (T.namespace, T.first_segment, T.partition_of, T.key_in_partition)] == [ns, segment, part, rest]
    assert one(spark, T.rejoin_key(T.partition_of("k"), T.key_in_partition("k")), k=key) == key


@pytest.mark.parametrize(
    ("path", "want"),
    [("src/app/dashboard/settings/page.tsx", "dashboard.settings"), ("app/page.tsx", None), ("pages/about.tsx", "about"), ("pages/blog/index.tsx", "blog"), ("src/components/hero/Hero.tsx", "hero"), ("lib/x.ts", None)],
)
def test_routes(spark, path, want):
    assert one(spark, T.route_path("p"), p=path) == want


@pytest.mark.parametrize(
    ("component", "route", "path", "split", "want"),
    [
        ("FeaturesGrid", None, None, "/", "featuresGrid"), (None, "/dashboard/[id]", None, "/", "dashboard"), (None, "dashboard.settings", None, "/", "dashboard.settings"), (None, "dashboard.settings", None, ".", "settings"),
        (None, None, "src/sections/Hero.tsx", "/", "hero"), (None, None, "src/Pricing/index.tsx", "/", "pricing"), (None, None, "src/(group)/page.tsx", "/", "common"), (None, "[id]", "page.tsx", "/", "common"), (None, None, None, "/", "common"),
    ],
)
def test_inferred_namespaces(spark, component, route, path, split, want):
    assert one(spark, T.infer_namespace("c", "r", "p", split), c=component, r=route, p=path) == want


def test_interpolation_is_single_pass(spark):
    assert one(spark, T.interpolate("t", "v"), t="{a} and {b} {c}", v={"a": "{b}", "b": "2"}) == "{b} and 2 {c}"
    assert one(spark, T.interpolate("t", "v"), t="plain", v={}) == "plain"


@pytest.mark.parametrize(("header", "want"), [("de-DE,de;q=0.9,en;q=0.8", "de"), ("en;q=0.1,fr", "fr"), ("xx", "en"), ("", "en"), ("es;q=bad,de", "es")])
def test_accept_language(spark, header, want):
    got = one(spark, T.accept_language("h", ["en", "de", "fr", "es"], "en"), h=header)
    assert got == want


def test_small_ones(spark):
    assert one(spark, T.format_cost(F.lit(0.00123))) == "~$0.0012" and one(spark, T.format_cost(F.lit(2.34))) == "~$2.34"
    assert one(spark, T.format_usage(F.lit(1500), F.lit(20))) == "1,500 in + 20 out = 1,520 tokens"
    assert one(spark, T.auto_prefix("k", "n"), k="save", n="hero") == "hero.save" and one(spark, T.auto_prefix("k", "n"), k="a.b", n="hero") == "a.b"
    assert one(spark, T.strip_namespace("k", "n"), k="hero.a.b", n="hero") == "a.b" and one(spark, T.strip_namespace("k", "n"), k="heroes.a", n="hero") == "heroes.a"
    assert one(spark, T.context_hint("a", "b", "c", "d", "e"), a=None, b="h1", c="Hero", d="", e=None) == "HTML: <h1>, component: Hero"
    assert one(spark, T.context_hint("a", "a", "a", "a", "a"), a=None) is None
    assert one(spark, T.strip_json_comments("j"), j='{ /* a */ "x": 1 // b'.replace(" // b", "\n// b")).strip() == '{  "x": 1'
    assert one(spark, T.is_translatable_prop("p"), p="title") and not one(spark, T.is_translatable_prop("p", ["class"]), p="class")
    assert one(spark, T.is_ignored_tag("p"), p="SCRIPT") and one(spark, T.is_content_prop("p"), p="alt") and not one(spark, T.is_content_prop("p"), p="Alt")


def test_trim_is_linear(spark):
    long = spark.range(1).select(F.concat(F.lit("\u3000 a"), F.repeat(F.lit(" "), 1_000_000), F.lit("b\ufeff\u2009\u200a\n")).alias("t")).cache()
    long.count()
    took = []
    for _ in range(3):
        began = time.perf_counter()
        assert long.select(F.length(T.trim_unicode("t"))).first()[0] == 1_000_002
        took.append(time.perf_counter() - began)
    assert min(took) < 0.5  # most of it Spark's own start of a job; by a regular expression it took minutes
    assert one(spark, T.trim_unicode("t"), t="\u0085\u200bx\u001c") == "\u0085\u200bx\u001c"  # no spaces by the rule


def test_placeholders_in_the_order_of_utf16_units(spark):
    text = '{b} <b x="\U0001f600"> <b x="￮"> <b x=""> {b} {a} <b x="\U00010000">'
    found = one(spark, T.placeholders("t"), t=text)
    assert found == sorted(found, key=lambda p: p.encode("utf-16-be")) and len(found) == 7 and found != sorted(found)
    plain = one(spark, T.placeholders("t"), t="{b} </i> {a} %s {b}")
    assert plain == sorted(plain) == ["%s", "</i>", "{a}", "{b}", "{b}"]
