"""Extraction and rewriting of JSX sources."""

import pytest
from msgspark.functions import jsx
from msgspark.operators import jsx_strings as X

CARD = """import { useState } from "react";
export default function Card({ user, n }) {
  const [open, setOpen] = useState(false);
  const items = [{ title: "First item", id: "x1" }, { label: cond ? "Yes please" : other ? "No thanks" : "-" }];
  return (
    <div className="box" title="Card title">
      <h2>Hello there</h2> <p>You have <b>{n}</b> new messages</p>
      <input placeholder={`Search ${user.name} in ${place}`} aria-label={'Find it'} type="text" />
      {open ? "Close panel" : "Open panel"} {" padded "} {items.map((i) => <li key={i}>Row text</li>)}
      <code>skip me</code> <a href="/x" alt="https://x.y">{t("Old text", "old.key")}</a> <T id="k.id">Wrapped here</T>
    </div>
  );
}
"""


def rows(code, *columns):
    names = [c.split()[0] for c in X.SCHEMA.split(", ")][2:]
    return [tuple(r[names.index(c)] for c in columns) for r in X.extract(code)]


def test_all_kinds():
    got = set(rows(CARD, "text", "type", "tag", "prop"))
    want = {
        ("First item", "object-property", None, "title"), ("Yes please", "object-property", None, "label"), ("No thanks", "object-property", None, "label"), ("Card title", "jsx-attribute", "div", "title"),
        ("Hello there", "jsx-text", "h2", None), ("You have", "jsx-text", "p", None), ("new messages", "jsx-text", "p", None), ("Search {userName} in {place}", "jsx-attribute", "input", "placeholder"),
        ("Find it", "jsx-attribute", "input", "aria-label"), ("Close panel", "jsx-expression", "div", None), ("Open panel", "jsx-expression", "div", None), ("padded", "jsx-expression", "div", None),
        ("Row text", "jsx-text", "li", None), ("Old text", "t-call", "a", None), ("Wrapped here", "T-component", "div", None),
    }
    assert got == want
    assert {c for (c,) in rows(CARD, "component")} == {"Card"}
    assert ("Hello there", 7, 10) in rows(CARD, "text", "line", "col")
    assert ("You have", "You have <b>{1}</b> new messages") in rows(CARD, "text", "composite")
    assert ("Old text", "old.key") in rows(CARD, "text", "id") and ("Wrapped here", "k.id") in rows(CARD, "text", "id")


@pytest.mark.parametrize(
    ("code", "component"),
    [
        ("const A = () => <p>Some words</p>;", "A"), ("export const B = memo(forwardRef((p, r) => { return <p>Some words</p>; }));", "B"), ("export default () => <p>Some words</p>", "__default__"), ("export default function () { return <p>Some words</p> }", "__default__"),
        ("function C() { const inner = () => <p>Some words</p>; return inner(); }", "C"), ("function D() { function Inner() { return <p>Some words</p> } return <Inner/> }", "Inner"), ("class E extends X { render() { return <p>Some words</p> } }", "E"), ("const el = <p>Some words</p>;", None),
        ("const F = function () { return <><p>Some words</p></> }", "F"), ("async function G(): Promise<X<Y>> { const a = x < y; return <p>Some words</p> }", "G"),
    ],
)
def test_component_names(code, component):
    assert rows(code, "text", "component") == [("Some words", component)]


def test_module_constants():
    code = 'export const PLANS = [{ title: "Free plan", key: "free", nested: { description: `For ${who}` } }, { title: cond ? "A b" : "C d" }];\nlet other = { title: "Not const" };\nfunction helper() { return { title: "No JSX here" }; }'
    assert rows(code, "text", "type", "const") == [(t, "module-object-property", "PLANS") for t in ("Free plan", "For {who}", "A b", "C d")]


def test_reader_copes():
    assert rows("const A = () => <p>it's &amp; &quot;fine&quot; // not a comment</p>;", "text") == [("it's & \"fine\" // not a comment",)]
    assert rows("const r = /[/<]p>/g; const s = `a ${`b ${1}`} <p>`; const A = () => <X.Y a={{ b: 1 }} {...z}>Deep words</X.Y>", "text", "tag") == [("Deep words", "Y")]
    for bad in ("const a = (", "<p>never closed", '"open', "`open ${"):
        with pytest.raises(jsx.Unreadable):
            X.extract(bad)
    assert X.extract("") == []


def test_template_names():
    text = lambda s: jsx.template_text(jsx.Reader(s).read()[0])
    assert text("`Hi ${a} ${a} ${b.c.d}`") == "Hi {a} {a2} {bCD}" and text("`${f()}`") is None and text(r"`a\n\u0041\${x}`") == "a\nA${x}"


def test_rewrite():
    keys = {"Hello there": "card.hello", "Card title": "card.title", "Open panel": "card.open", "First item": "card.first", "Search {userName} in {place}": "card.search", "Old text": "card.old"}
    out, n, client = X.rewrite(CARD, keys)
    assert client and n == 5
    for part in ('<h2>{t("hello")}</h2>', 'title={t("title")}', '"Close panel" : t("open")', 'title: t("first")', 'placeholder={t("search", { userName: user.name, place })}', 'const t = useTranslations("card");', 'import { useTranslations } from "next-intl";'):
        assert part in out
    assert X.rewrite(out, keys) == (out, 0, True)
    assert X.rewrite(CARD, {}) == (CARD, 0, True)
    mixed, _, _ = X.rewrite("export async function P() { return <p>Some words <b>More words</b></p> }", {"Some words": "a.b", "More words": "c.d"})
    assert 'await getTranslations()' in mixed and '{t("a.b")}' in mixed and "next-intl/server" in mixed


def test_rewrite_inline():
    keys = {"Hello there": "card.hello", "Card title": "card.title"}
    out, n, _ = X.rewrite(CARD, keys, mode="inline")
    assert n == 2
    for part in ('<h2><T id="card.hello">Hello there</T></h2>', 'title={t("Card title", "card.title")}', "const t = useT();", 'import { T, useT } from "@/components/t";'):
        assert part in out
    assert X.rewrite(out, keys, mode="inline")[0] == out
    found = {(f[0], f[1], f[6]) for f in X.extract(out) if f[1] in ("T-component", "t-call")}
    assert ("Hello there", "T-component", "div") not in found and {x[0] for x in found} >= {"Hello there", "Card title"}


def test_inline_sides():
    keys = {"Hello there": "a.hello", "Close panel": "a.close"}
    page = "export default async function P() { return <p title='Close panel'>Hello there</p>; }"
    out = X.rewrite(page, keys, mode="inline")[0]
    assert "const t = await createT();" in out and 'import { T, createT } from "@/components/t-server";' in out
    assert "const t = createT();" in X.rewrite(page.replace("async ", ""), keys, mode="inline")[0]
    client = X.rewrite(out, keys, mode="inline", client=True)[0]
    assert 'import { T, useT } from "@/components/t";' in client and "await useT();" in client and "createT" not in client
    old = """import { T, useT } from '@/components/t/t-server'; import { createT as make } from "@/components/t";
const messages = 1; export function P() { const t = useT(lost), u = make(messages), v = x.useT(lost); return <p>{useT(lost)}</p> }"""
    out, n, _ = X.rewrite(old, {}, mode="inline")
    assert n == 0 and out == old.replace("/t/t-server'", "/t-server'").replace('"@/components/t"', '"@/components/t-server"').replace("{ T, useT }", "{ T, createT }").replace("t = useT(lost)", "t = createT()").replace("{useT(lost)}", "{createT()}")
    assert X.rewrite(out, {}, mode="inline")[0] == out and X.rewrite(page, {}, mode="inline")[0] == page


def test_operators(spark):
    files = spark.createDataFrame([("src/Card.tsx", CARD), ("bad.tsx", "<p>"), ("none.tsx", None), ("plain.ts", "export const x = 1;")], "path string, content string")
    got = X.extract_strings(files).collect()
    assert {r.file for r in got} == {"src/Card.tsx"} and [r.seq for r in got] == list(range(15))
    out = {r.path: r for r in X.rewrite_sources(files, spark.createDataFrame([("Hello there", "card.hello"), ("Nowhere", "x.y")], "text string, key string")).collect()}
    assert out["src/Card.tsx"].replaced == 1 and out["bad.tsx"].content == "<p>" and out["none.tsx"].content is None and len(out) == 4


PAGE = """import { getTranslations as load } from "next-intl/server";
export default async function Page({ params }) {
  const t = 5;
  return <main><h1>Hello there</h1>{[1].map(t => <b key={t}>More of it</b>)}</main>;
}
export const Side = async ({ a }: { a: string }): Promise<X> => {
  const tt = await load("page");
  return <p title="Close panel">{tt("old")} Some text</p>;
};
function Plain(props: Props) {
  return <i>Hello there</i>;
}
class Old extends React.Component { render() { return <u>Hello there</u>; } }
"""


def test_hooks_names_and_aliases():
    keys = {"Hello there": "page.hello", "More of it": "page.more", "Close panel": "page.close", "Some text": "page.some"}
    out, n, client = X.rewrite(PAGE, keys)
    assert (n, client) == (5, False)
    for part in ('const tr = await load("page");', '<h1>{tr("hello")}</h1>', '<b key={t}>{tr("more")}</b>', 'title={tt("close")}', '{tt("some")}', 'const t = useTranslations("page");', '<i>{t("hello")}</i>', "<u>Hello there</u>"):
        assert part in out, part
    assert out.count("getTranslations") == 1 and out.count("const tt =") == 1 and 'import { useTranslations } from "next-intl";' in out
    assert X.rewrite(out, keys)[1] == 0
    long = "export default async function P({ " + ", ".join(f"name{i}" for i in range(200)) + " }) { return <p>Hello there</p>; }"
    assert 'const t = await getTranslations("page");' in X.rewrite(long, keys)[0]
    assert 'const t = useTranslations("page");' in X.rewrite(long, keys, client=True)[0]


def test_imports_are_extended():
    code = 'import { useLocale, } from "next-intl";\nexport function A() { return <p>Hello there</p>; }'
    assert 'import { useLocale, useTranslations } from "next-intl";' in X.rewrite(code, {"Hello there": "hello"})[0]


def test_deep_nesting():
    code = "export default function P() { return " + "<a>" * 4000 + "Hello there" + "</a>" * 4000 + "; }"
    assert [r[0] for r in X.extract(code)] == ["Hello there"]
    assert X.rewrite(code, {"Hello there": "a.b"})[1] == 1
    assert [r[0] for r in X.extract("const a = " + "(" * 20000 + ")" * 20000 + "; export const P = () => { return <p>Some text</p> }")] == ["Some text"]


def test_runtime_imports():
    code = """import React, { type X, useState as u } from "react"; import type { A } from "./a"; import { type B } from './b'; import "./c.css";
    export { d } from "./d"; export * from "./e"; export type { F } from "./f"; const g = () => import("./g"); const h = <p onClick={() => import('./h')}>{import("./i")}</p>; // import "./j"
    foo.import("./k"); const s = 'import "./l"';"""
    assert sorted(jsx.runtime_imports(jsx.read(code))) == ["./c.css", "./d", "./e", "./g", "./h", "./i", "react"]
    assert jsx.imports(jsx.read(code))[0].names == (("default", "React"), ("X", "X"), ("useState", "u"))


def test_scan_counts_while_it_runs(spark):
    rows = [("a.tsx", "export const A = () => <p>One</p>;"), ("b.tsx", "const B = () => <p>{</p>;"), ("c.tsx", None), ("d.tsx", ""), ("e.tsx", "export const E = () => <p>Two<b>three</b></p>;")]
    strings, seen = X.scan(spark.createDataFrame(rows, "path string, content string"))
    assert sorted(r.text for r in strings.collect()) == ["One", "Two", "three"]
    assert seen.get == {"files": 5, "unreadable": 2, "strings": 3}
    strings, seen = X.scan(spark.createDataFrame([], "path string, content string"))
    assert strings.collect() == [] and seen.get == {"files": 0, "unreadable": 0, "strings": 0}


MAPPED = {"Welcome to our platform": "hero.welcome", "Search...": "common.search", "Hi": "a.hi", "Bye": "b.bye"}
WELCOME = "Welcome to our platform"


@pytest.mark.parametrize(
    ("code", "options", "want"),
    [
        (f'"use client";\nconst Page = () => <h1>{WELCOME}</h1>;', {}, '"use client";\nimport { useTranslations } from "next-intl";\nconst Page = () => {\n\tconst t = useTranslations("hero");\n\treturn <h1>{t("welcome")}</h1>;\n};'),
        (f"const Page = () => <h1>{WELCOME}</h1>;", {"waiting": True}, 'import { getTranslations } from "next-intl/server";\nconst Page = async () => {\n\tconst t = await getTranslations("hero");\n\treturn <h1>{t("welcome")}</h1>;\n};'),
        (f"export default () => <h1>{WELCOME}</h1>;", {"waiting": True}, 'import { getTranslations } from "next-intl/server";\nexport default async () => {\n\tconst t = await getTranslations("hero");\n\treturn <h1>{t("welcome")}</h1>;\n};'),
        (f"const Hero = () => {{ return <h1>{WELCOME}</h1>; }};", {"waiting": True}, 'import { getTranslations } from "next-intl/server";\nconst Hero = async () => {\n\tconst t = await getTranslations("hero"); return <h1>{t("welcome")}</h1>; };'),
        ('const Page = () => <input placeholder="Search..." />;', {"mode": "inline"}, 'import { createT } from "@/components/t-server";\nconst Page = () => {\n\tconst t = createT();\n\treturn <input placeholder={t("Search...", "common.search")} />;\n};'),
        ("export const A = () => (\n  <p>Hi</p>\n)\nfunction B() { return null }\n", {}, 'import { useTranslations } from "next-intl";\nexport const A = () => {\n\tconst t = useTranslations("a");\n\treturn (\n  <p>{t("hi")}</p>\n);\n}\nfunction B() { return null }\n'),
        ("const A = memo(p => <p title='Hi'>Bye</p>, same), n = 1", {}, 'import { useTranslations } from "next-intl";\nconst A = memo(p => {\n\tconst t = useTranslations();\n\treturn <p title={t("a.hi")}>{t("b.bye")}</p>;\n}, same), n = 1'),
        ("const A = <T,>(x: T) => <p>Hi</p>\ntype Q = 1", {"waiting": True}, 'import { useTranslations } from "next-intl";\nconst A = <T,>(x: T) => {\n\tconst t = useTranslations("a");\n\treturn <p>{t("hi")}</p>;\n}\ntype Q = 1'),
        ("const A = () => <B render={() => <p>Hi</p>} />;", {}, 'import { useTranslations } from "next-intl";\nconst A = () => {\n\tconst t = useTranslations("a");\n\treturn <B render={() => <p>{t("hi")}</p>} />;\n};'),
        ("const A = () => <p>Hi</p>;", {"waiting": True, "module": "my-lib"}, 'import { useTranslations } from "my-lib";\nconst A = () => {\n\tconst t = useTranslations("a");\n\treturn <p>{t("hi")}</p>;\n};'),
        ("const A = () => <T>none</T>;", {}, "const A = () => <T>none</T>;"),
    ],
)
def test_components_whose_body_is_an_expression(code, options, want):
    got, replaced, _ = X.rewrite(code, MAPPED, **options)
    assert got == want
    assert X.rewrite(got, MAPPED, **options)[0] == got


def test_sources_with_a_text_twice_in_the_map(spark):
    files = spark.createDataFrame([("a.tsx", "export default function P() { return <p>Hi</p>; }")], "path string, content string")
    mapping = spark.createDataFrame([("Hi", "a.one"), ("Hi", "a.two"), ("Hi", None), (None, "x")], "text string, key string")
    assert 't("two")' in X.rewrite_sources(files, mapping).first().content


def hero(declaration, rest, server=False):
    line = 'import { getTranslations } from "next-intl/server";' if server else 'import { useTranslations } from "next-intl";'
    return f"{line}\n{'async ' * server}function Hero() {{\n  const t = {declaration};\n{rest}\n}}"


KEYED = {"Welcome": "hero.welcome", "Start": "hero.start", "Sign up": "common.signUp"}


@pytest.mark.parametrize(
    ("before", "after"),
    [
        (hero("useTranslations()", "  return <p><b>Welcome</b>Start</p>;"), hero('useTranslations("hero")', '  return <p><b>{t("welcome")}</b>{t("start")}</p>;')),
        (hero('useTranslations("other")', "  return <b>Welcome</b>;"), hero('useTranslations("hero")', '  return <b>{t("welcome")}</b>;')),
        (hero('useTranslations("hero")', "  return <b>Welcome</b>;"), hero('useTranslations("hero")', '  return <b>{t("welcome")}</b>;')),
        (hero("await getTranslations()", "  return <b>Welcome</b>;", True), hero('await getTranslations("hero")', '  return <b>{t("welcome")}</b>;', True)),
        (hero("useTranslations()", "  return <p><b>Welcome</b>Sign up</p>;"), hero("useTranslations()", '  return <p><b>{t("hero.welcome")}</b>{t("common.signUp")}</p>;')),
        # old calls follow the namespace, by scopes
        (hero('useTranslations("hero")', '  return <p title={t("old", { n })}>{t.rich(\'a.b\')}Sign up</p>;'), hero("useTranslations()", '  return <p title={t("hero.old", { n })}>{t.rich("hero.a.b")}{t("common.signUp")}</p>;')),
        (hero('useTranslations("x")', '  function f({ t }) { return t("mine"); }\n  const g = (t) => t("mine");\n  { const t = h; t("mine"); }\n  return <p>{a.t("b")}Welcome{t("own")}</p>;'), hero("useTranslations()", '  function f({ t }) { return t("mine"); }\n  const g = (t) => t("mine");\n  { const t = h; t("mine"); }\n  return <p>{a.t("b")}{t("hero.welcome")}{t("x.own")}</p>;')),
        (hero('useTranslations("common")', '  return <p>{t("a")}{t("b")}Sign up</p>;'), hero('useTranslations("common")', '  return <p>{t("a")}{t("b")}{t("signUp")}</p>;')),
    ],
)
def test_translators_that_are_there_change_their_namespace(before, after):
    got, n, _ = X.rewrite(before, KEYED, retarget=True)
    assert got == after and n
    assert X.rewrite(got, KEYED, retarget=True)[0] == got


@pytest.mark.parametrize("use", ["t(key)", "t(`k${i}`)", "f(t)", "{...t}", "t", "t.call(null)", "t"])
def test_translators_with_unknown_keys_stay(use):
    before = hero('useTranslations("x")', f"  const other = [{use}];\n  return <p>Sign up</p>;")
    got = X.rewrite(before, KEYED, retarget=True)[0]
    assert 'const t = useTranslations("x")' in got and 'const tr = useTranslations("common")' in got and use in got
    before = hero("useTranslations(space)", '  return <p>{t("a")}Sign up</p>;')
    got = X.rewrite(before, KEYED, retarget=True)[0]
    assert "const t = useTranslations(space)" in got and '{t("a")}{tr("signUp")}' in got
