"""Constants as functions of a translator: uses, reasons, plans over files, rewritten code."""

import pytest
from msgspark.functions import bindings as B
from msgspark.functions import jsx as J
from msgspark.operators import factories as K
from msgspark.operators import jsx_strings as X

HEAD = 'export const ITEMS: Item[] = [{ title: "Hello there" }]\n'
KEYS = {"Hello there": "list.hello", "Close panel": "list.close"}


def reason(code):
    return {name: why for name, _, _, why in K.facts(HEAD + code)[0]}["ITEMS"]


@pytest.mark.parametrize(
    ("code", "why"),
    [
        ("function P() { return <p>{ITEMS[0].title}</p>; }", None),
        ("const P = memo(() => { const f = () => ITEMS; return <p>{f}</p>; });", None),
        ("const P = async ({ ITEMS }) => { return <p>{ITEMS}</p>; }; let x = (ITEMS) => ITEMS.push(1); function q(ITEMS) { ITEMS = 1 }", None),
        ("const P = () => { const [a, ITEMS] = f(); return ITEMS.push(1); }; const o = { ITEMS: 1 }.ITEMS; type T = (typeof ITEMS)[0]; export { ITEMS }", None),
        ("type A = typeof ITEMS\n  | string\nfunction P() { const x: typeof ITEMS = ITEMS; return <p a={`${ITEMS}`} /> }", None),
        ("export const first = ITEMS[0];", "used outside a component"),
        ("function helper() { return ITEMS }", "used outside a component"),
        ("export default ITEMS", "used outside a component"),
        ("class P { render() { return ITEMS } }", "used outside a component"),
        ("function P({ x = ITEMS }) { return <p /> }", "used in a parameter's default"),
        ("const P = () => <p>{ITEMS}</p>;", "used in a component without a block body"),
        ("function P() { ITEMS = []; }", "changed by assignment"),
        ("function P() { ITEMS[0].title = 'x'; }", "changed by assignment"),
        ("function P() { ITEMS.length += 1; }", "changed by assignment"),
        ("function P() { ITEMS[0]!.list.sort(); }", "changed by .sort()"),
        ("function P() { delete ITEMS[0]; }", "changed by delete"),
        ("function P() { ITEMS.n++; }", "changed by an update"),
        ("function P() { --ITEMS.n; }", "changed by an update"),
        ("function P() { return ITEMS(1) }", "called"),
        ("function P() { return <ITEMS.Icon /> }", "used as an element"),
        ("function P() { for (const ITEMS of y) { f(ITEMS) } }", "bound again by a loop, method or catch"),
        ("function P() { return typeof ITEMS === 'object' }", "its type is asked for"),
        ("export { ITEMS as other }", "exported under another name"),
        ("function P() { return ITEMS === 1 || ITEMS <= 2 || ITEMS != 3 }", None),
    ],
)
def test_reasons(code, why):
    assert reason(code) == why


def test_constants():
    code = "const a = { b: 1 }, c: D<{ e: string }> = [1]\n  .map(f)\nexport const g = h as\n  const\nlet i = 1; const { j } = k; const l = () => { const m = 1 }"
    assert [(d.name, d.exported, code[slice(*d.value)]) for d in B.constants(code, J.read(code))] == [("a", False, "{ b: 1 }"), ("c", False, "[1]\n  .map(f)"), ("g", True, "h as\n  const"), ("l", False, "() => { const m = 1 }")]
    assert B.pattern_names(J.read("{ a, b: { c }, d = e, ...f }, [g, , h = 1], i: T, ...j")) == set("acdfghij")
    assert [n for n, *_ in K.facts('const x = { title: "Hello there", f: (t) => t };')[0]] == ["x"] and K.facts('const x = { title: "Hello there", f: (t) => t };')[0][0][3] == "it binds t itself"


def test_rewrite():
    code = HEAD + 'export function P() {\n  const t = useTranslations("list");\n  return <ul title="Close panel">{f({ ITEMS, ITEMS: 1 })}{g(ITEMS)}</ul>;\n}\n'
    out, n, _ = X.rewrite(code, KEYS, factories={"ITEMS"}, uses={"ITEMS"})
    for part in ('export const ITEMS = (t: any): Item[] => ([{ title: t("list.hello") }])\n', "const tr = useTranslations();", "{ ITEMS: ITEMS(tr), ITEMS: 1 }", "g(ITEMS(tr))", 'title={tr("list.close")}'):
        assert part in out, part
    assert n == 2 and K.facts(out)[0] == [] and X.rewrite(out, KEYS)[1] == 0
    assert "= (t) => (" in X.rewrite('const ITEMS = [{ title: "Hello there" }];', KEYS, factories={"ITEMS"}, typed=False)[0]
    inline = X.rewrite(code, KEYS, mode="inline", client=True, factories={"ITEMS"}, uses={"ITEMS"})[0]
    assert 't("Hello there", "list.hello")' in inline and 'import { useT } from "@/components/t";' in inline
    server = X.rewrite("export default async function P() { return <p>{ITEMS}</p>; }", {}, uses={"ITEMS"})[0]
    assert "const t = await getTranslations();" in server and "{ITEMS(t)}" in server


def test_plan(spark):
    use = "export function P() { return <p>{%s[0].title}</p>; }"
    rows = [
        ("lib/a.ts", 'export const A = { title: "Hello there" };\nexport const B = { title: "Hello there" }; const C = { title: "Hello there" }; export const metadata = { title: "Hello there" }; export const D = { title: "Unknown text" };', True),
        ("app/one.tsx", 'import { A as a, B, type D } from "../lib/a";\n' + use % "a" + " B.push(1);", True),
        ("app/two.tsx", 'import { A } from "../lib/a";\n' + use % "A", True),
        ("lib/e.ts", 'export const E = { title: "Hello there" };', True),
        ("other.ts", 'import { E } from "./lib/e";', False),
        ("lib/f.ts", 'export const F = { title: "Hello there" };', True),
        ("barrel.ts", 'export { F } from "./lib/f"; export * from "./lib/h";', True),
        ("lib/g.ts", 'export const G = { title: "Hello there" };', True),
        ("lazy.ts", 'export const x = () => import("./lib/g");', True),
        ("lib/h.ts", 'export const H = { title: "Hello there" };', True),
        ("bad.tsx", "<p>", True), ("none.tsx", None, True), (None, 'export const Z = { title: "Hello there" };', True), ("empty.ts", "", True),
    ]
    files = spark.createDataFrame(rows, "path string, content string, included boolean")
    mapping = spark.createDataFrame([*KEYS.items(), ("Hello there", "again.hello"), (None, "n")], "text string, key string")
    got = {(r.path, r.name, r.role): r.reason for r in K.factory_plan(files, mapping).collect()}
    assert got == {
        ("lib/a.ts", "A", "constant"): None, ("app/one.tsx", "a", "import"): None, ("app/two.tsx", "A", "import"): None,
        ("lib/a.ts", "B", "constant"): "changed by .push()", ("app/one.tsx", "B", "import"): "changed by .push()", ("lib/a.ts", "C", "constant"): None,
        ("lib/e.ts", "E", "constant"): "imported by a file that stays as it is", ("other.ts", "E", "import"): "imported by a file that stays as it is",
        ("lib/f.ts", "F", "constant"): "exported again", ("lib/g.ts", "G", "constant"): "imported as a whole", ("lib/h.ts", "H", "constant"): "exported again",
    }
    assert K.factory_plan(files.limit(0), mapping).isEmpty() and K.factory_plan(files, mapping.limit(0)).isEmpty()
    done = {r.path: r for r in X.rewrite_sources(files.where("included"), mapping.where("key <> 'again.hello'"), factories=K.factory_plan(files, mapping)).collect()}
    assert "a(t)[0].title" in done["app/one.tsx"].content and "B.push(1)" in done["app/one.tsx"].content and done["lib/a.ts"].replaced == 2
    assert not done["lib/f.ts"].modified and done["app/two.tsx"].modified and done["app/two.tsx"].replaced == 0
