"""Extraction of user-facing strings from JSX sources, and their rewriting to calls of a translator."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import bindings as B
from ..functions import jsx as J
from ..functions import text as T

_KEBAB, _CONSTANT, _URL, _NUMBER = (re.compile(p) for p in (T.KEBAB, T.CONSTANT, T.URL, T.NUMBER))


def ignored(text: str) -> bool:
    """Python twin of functions.text.is_ignored_text."""
    t = text.strip(T.SPACES)
    return not t or bool(_KEBAB.match(t) or _CONSTANT.match(t) or _URL.match(t) or _NUMBER.match(t)) or not any(c.isalpha() for c in t)


@dataclass(frozen=True)
class Scope:
    component: str | None = None
    carrier: str | None = None  # what a function at this place would be called
    const: str | None = None  # the module-level const around
    function: bool = False
    shows: bool = False  # the function around has JSX
    tag: str | None = None
    body: int | None = None  # where the component's body begins
    waits: bool = False  # the component is async


@dataclass
class Found:
    text: str
    type: str
    at: int
    end: int
    scope: Scope
    prop: str | None = None
    id: str | None = None
    composite: str | None = None
    node: J.Token | None = None


class Extractor:
    """One pass over a file's tokens [EXT1-EXT11]."""

    def __init__(self, code: str, props: list[str] | None = None) -> None:
        self.reader = J.Reader(code)
        self.props = T.TRANSLATABLE_PROPS if props is None else props
        self.found: list[Found] = []
        self.tokens: list[J.Token] = []
        self.bodies: dict[int, tuple[list[J.Token], list[J.Token]]] = {}  # of components: parameters and body, by where the body begins
        self.expressions: dict[int, int] = {}  # of components whose body is an expression: where it ends, by where it begins
        self.heads: dict[int, int] = {}  # of components: where "async" would stand, by where the body begins

    def run(self) -> list[Found]:
        with J.deep(self.reader.code):
            self.tokens = self.reader.read()
            self.statements(self.tokens, Scope())
        return sorted(self.found, key=lambda f: f.at)

    def add(self, text: str | None, kind: str, at: int, end: int, scope: Scope, node: J.Token | None = None, **more: str | None) -> None:
        if text and not ignored(text):
            self.found.append(Found(text, kind, at, end, scope, node=node, **more))

    def texts(self, tokens: list[J.Token], kind: str, at: int, scope: Scope, trim: bool = True, **more: str | None) -> bool:
        """Adds a value's literal, template or the branches of its conditional; whether it was one of these."""
        tokens = J.unwrap(tokens)
        if branches := J.ternary(tokens):
            for b in branches:
                inner = J.unwrap(b)
                if J.ternary(inner):
                    self.texts(inner, kind, at, scope, **more)
                elif len(inner) == 1 and inner[0].kind in ("string", "template"):
                    text = inner[0].text.strip() if inner[0].kind == "string" else J.template_text(inner[0])
                    self.add(text, kind, at, inner[0].end, scope, inner[0], **more)
            return True
        if len(tokens) == 1 and tokens[0].kind in ("string", "template"):
            t = tokens[0]
            text = (t.text.strip() if trim else t.text) if t.kind == "string" else J.template_text(t)
            self.add(text, kind, at, t.end, scope, t, **more)
            return True
        return False

    def statements(self, tokens: list[J.Token], scope: Scope) -> None:
        """Tokens of the module, a block or an expression."""
        i, top = 0, scope == Scope()
        local = scope
        while i < len(tokens):
            t, before = tokens[i], tokens[i - 1] if i else None
            if t.kind == "punct" and t.text == ";" and top:
                local = scope
            if t.kind == "name" and t.text in ("function", "class") and not (before and before.text == "."):
                i = self.declared(tokens, i, local)
                if top:
                    local = scope
                continue
            if t.kind == "name" and top and t.text in ("const", "let", "var", "export", "import", "type", "interface"):
                local = scope
                if t.text in ("const", "let", "var") and i + 1 < len(tokens) and tokens[i + 1].kind == "name":
                    name = tokens[i + 1].text
                    local = replace(scope, carrier=name, const=name if t.text == "const" else None)
                elif t.text == "export" and i + 1 < len(tokens) and tokens[i + 1].text == "default":
                    local = replace(scope, carrier="__default__")
            elif t.kind == "punct" and t.text == "=>":
                j = self.arrow(tokens, i, local)
                i = j
                continue
            elif t.kind == "name" and t.text == "t" and i + 1 < len(tokens) and tokens[i + 1].kind == "group" and tokens[i + 1].text == "(" and not (before and before.text in (".", "function")):
                self.call(t, tokens[i + 1], local)
            self.token(t, before, local)
            i += 1

    def declared(self, tokens: list[J.Token], i: int, scope: Scope) -> int:
        """A function or a class from its keyword on; returns what follows."""
        before = tokens[i - 1] if i else None
        waits = before is not None and before.text == "async"
        if waits:
            before = tokens[i - 2] if i > 1 else None
        statement = J.begins_statement(self.reader.code, before, tokens[i])
        j, name = i + 1, None
        while j < len(tokens) and not (tokens[j].kind == "group" and tokens[j].text == "{"):
            if tokens[j].kind == "name" and name is None and j <= i + 2:
                name = tokens[j].text
            if tokens[j].kind == "group" and tokens[j].text == "(":
                break
            j += 1
        params = j
        while j < len(tokens) and not (tokens[j].kind == "group" and tokens[j].text == "{"):
            j += 1
        if j >= len(tokens):
            return i + 1
        default = before is not None and before.text == "default"
        own = (name or ("__default__" if default else None)) if statement else None if scope.function else scope.carrier
        body, is_class = tokens[j], tokens[i].text == "class"
        at = None if is_class else body.start + 1  # a class has no body that a translator could stand in
        inner = replace(scope, component=own or scope.component, carrier=None, function=True, shows=J.has_jsx(body.parts), const=None, tag=None, body=at if own or is_class else scope.body, waits=waits if own else scope.waits)
        if own and at:
            self.bodies[at] = (tokens[params:j], body.parts)
            self.heads[at] = tokens[i].start
        for t in tokens[params:j]:
            self.token(t, None, inner)
        self.statements(body.parts, inner)
        return j + 1

    def arrow(self, tokens: list[J.Token], i: int, scope: Scope) -> int:
        own = None if scope.function else scope.carrier
        body = tokens[i + 1] if i + 1 < len(tokens) else None
        first = i - 1  # the parameters, before them perhaps async; a result type may stand between
        while first > 0 and not (tokens[first].kind == "group" and tokens[first].text == "(" and (first + 1 == i or tokens[first + 1].text == ":")) and not (first + 1 == i and tokens[first].kind == "name"):
            first -= 1
        waits = first > 0 and tokens[first - 1].text == "async"
        inner = replace(scope, component=own or scope.component, carrier=None, function=True, const=None, tag=None, waits=waits if own else scope.waits)
        params, generic = tokens[max(0, first) : i], first > 0 and tokens[first - 1].text == ">"
        if body is not None and body.kind == "group" and body.text == "{":
            inner = replace(inner, shows=J.has_jsx(body.parts), body=body.start + 1 if own else scope.body)
            if own:
                self.component(body.start + 1, params, body.parts, generic)
            self.statements(body.parts, inner)
            return i + 2
        j = B.value_end(self.reader.code, tokens, i + 1) if i + 1 < len(tokens) else i + 1
        parts = tokens[i + 1 : j]
        if own and parts:
            self.component(parts[0].start, params, parts, generic)
            self.expressions[parts[0].start] = parts[-1].end
        self.statements(parts, replace(inner, shows=J.has_jsx(parts), body=parts[0].start if own and parts else scope.body, tag=scope.tag))
        return j

    def component(self, at: int, params: list[J.Token], parts: list[J.Token], generic: bool) -> None:
        self.bodies[at] = (params, parts)
        if params and not generic:  # before type parameters nothing can be put by the reader's tokens alone
            self.heads[at] = params[0].start

    def token(self, t: J.Token, before: J.Token | None, scope: Scope) -> None:
        if t.kind == "jsx":
            self.element(t, scope)
        elif t.kind == "template":
            for p in t.parts:
                if isinstance(p, list):
                    self.statements(p, scope)
        elif t.kind == "group":
            value = before is not None and (before.kind == "punct" and before.text not in (";", "=>") or before.text in ("return", "default", "satisfies", "as"))
            if t.text == "{" and (value or before is None and scope.const):
                self.object(t, scope)
            elif t.parts and t.text in "([":
                parts, last = [], 0
                for k, x in enumerate(t.parts):  # an object in an argument or an element
                    if x.kind == "group" and x.text == "{" and (k == 0 or t.parts[k - 1].text in (",", ":", "?", "&&", "||", "??", "=")):
                        self.statements(t.parts[last:k], scope)
                        self.object(x, scope)
                        last = k + 1
                parts = t.parts[last:]
                self.statements(parts, scope)
            else:
                self.statements(t.parts, scope)

    def object(self, group: J.Token, scope: Scope) -> None:
        parts, i = group.parts, 0
        while i < len(parts):
            j = i
            while j < len(parts) and not (parts[j].kind == "punct" and parts[j].text == ","):
                j += 1
            item = parts[i:j]
            if len(item) > 2 and item[0].kind in ("name", "string") and item[1].text == ":":
                self.property(item[0].text, item[2:], scope)
            else:
                self.statements(item, scope)
            i = j + 1

    def property(self, name: str, value: list[J.Token], scope: Scope) -> None:
        if name in T.CONTENT_PROPS:
            if not scope.function and scope.const:
                self.texts(value, "module-object-property", value[0].start, scope, prop=name)
            elif scope.function and scope.shows and scope.component:
                self.texts(value, "object-property", value[0].start, scope, prop=name)
        for k, x in enumerate(value):
            if x.kind == "group" and x.text == "{" and k == 0:
                self.object(x, scope)
                value = value[1:]
                break
        self.statements(value, scope)

    def call(self, name: J.Token, args: J.Token, scope: Scope) -> None:
        a = args.parts
        if a and a[0].kind == "string" and (len(a) == 1 or a[1].text == ","):
            second = a[2].text if len(a) > 2 and a[2].kind == "string" and (len(a) == 3 or a[3].text == ",") else None
            self.found.append(Found(a[0].text, "t-call", name.start, args.end, scope, id=second))

    def element(self, e: J.Token, scope: Scope) -> None:
        tag = e.text.rsplit(".", 1)[-1] or None
        inside = replace(scope, tag=tag) if tag else scope
        if e.text == "T":
            text = "".join(c.text for c in e.children if c.kind == "text").strip()
            own = next((v.text for n, _, _, v in e.attributes if n == "id" and v is not None and v.kind == "string"), None)
            if text:
                self.found.append(Found(text, "T-component", e.start, e.end, scope, id=own))
        skip = tag is not None and tag.lower() in T.IGNORED_TAGS
        for name, start, end, value in e.attributes:
            if value is None:
                continue
            if name in self.props and name not in T.NEVER_PROPS and not skip:
                if value.kind == "string":
                    self.add(value.text, "jsx-attribute", start, end, inside, value, prop=name)
                elif value.kind == "group":
                    self.texts(value.parts, "jsx-attribute", start, inside, trim=False, prop=name)
            if value.kind == "group":
                self.statements(value.parts, inside)
            elif value.kind == "jsx":
                self.element(value, inside)
        composite = composite_context(e) if tag else None
        for c in e.children:
            if c.kind == "text":
                if not (inside.tag and inside.tag.lower() in T.IGNORED_TAGS) and inside.tag != "T":
                    self.add(c.text.strip(), "jsx-text", c.start, c.end, inside, c, composite=composite)
            elif c.kind == "hole":
                if not (inside.tag and inside.tag.lower() in T.IGNORED_TAGS):
                    self.texts(c.parts, "jsx-expression", c.start, inside)
                self.statements(c.parts, inside)
            else:
                self.element(c, inside)


def composite_context(e: J.Token) -> str | None:
    """An element's text with its elements numbered and its expressions named, if it has both text and others [EXT9]."""
    parts, n, texts, others = [], 1, 0, 0
    for c in e.children:
        if c.kind == "text":
            if c.text.strip():
                parts.append(c.text.strip())
                texts += 1
        elif c.kind == "hole":
            if c.parts:
                last = c.parts[-1]
                path = last.kind == "name" and all(p.kind == "name" if k % 2 == 0 else p.text in (".", "?.") for k, p in enumerate(c.parts))
                parts.append("{" + (last.text if path else "expr") + "}")
                others += 1
        else:
            tag = c.text.rsplit(".", 1)[-1]
            parts.append(f"<{tag}>{{{n}}}</{tag}>" if tag else f"{{{n}}}")
            n, others = n + 1, others + 1
    return " ".join(parts) if texts and others else None


SCHEMA = "file string, seq long, text string, type string, line int, col int, component string, prop string, tag string, id string, const string, composite string"


def extract(code: str, props: list[str] | None = None) -> list[tuple]:
    """Rows of SCHEMA without file and seq."""
    x = Extractor(code, props)
    return [(f.text, f.type, *x.reader.place(f.at), None if f.type == "module-object-property" else f.scope.component, f.prop, None if f.type.endswith("object-property") else f.scope.tag, f.id, f.scope.const if f.type == "module-object-property" else None, f.composite) for f in x.run()]


def _read(files: DataFrame, props: list[str] | None, path: str, content: str) -> DataFrame:
    """SCHEMA and readable: a row for each string, with readable null, and one for each file, without text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in J.pieces(batches):
            rows = []
            for file, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(file, i, *r, None) for i, r in enumerate(extract(code or "", props))]
                    readable = code is not None
                except J.Unreadable:
                    readable = False
                rows.append((file, *[None] * 11, readable))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 6, pa.bool_()]
            names = [*[c.split()[0] for c in SCHEMA.split(", ")], "readable"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(run, f"{SCHEMA}, readable boolean")


def extract_strings(files: DataFrame, props: list[str] | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """SCHEMA: the strings of each source file, in source order [SRC2, EXT1-11]. Files that cannot be read give no rows, null contents neither; nesting has no limit but memory. Each file is a row of its own; nothing is shuffled."""
    return _read(files, props, path, content).where("text IS NOT NULL").drop("readable")


def scan(files: DataFrame, props: list[str] | None = None, path: str = "path", content: str = "content") -> tuple[DataFrame, Observation]:
    """The strings of each source file as extract_strings has them, and what the scan counts on the way [SRC1, SNK10]: files, unreadable (null contents among them) and strings.

    The counts come with the first action on the strings, from its tasks, and no second pass is made; a task that is repeated counts once. Until then observation.get waits. Give the strings to one action, such as a write: each action would read the files again.
    """
    seen = Observation(f"scan-{uuid.uuid4().hex}")
    rows = _read(files, props, path, content)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    counted = rows.observe(seen, n(F.col("readable").isNotNull()).alias("files"), n(~F.coalesce("readable", F.lit(True))).alias("unreadable"), n(F.col("text").isNotNull()).alias("strings"))
    return counted.where("text IS NOT NULL").drop("readable"), seen


def is_client(code: str) -> bool:
    """Whether a file runs in the browser: a 'use client' directive, or a hook imported [CG7]."""
    if re.match(r"""\s*(?://[^\n]*\n\s*|/\*.*?\*/\s*)*['"]use client['"]""", code, re.DOTALL):
        return True
    names = [n for m in re.finditer(r"import\s+(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from", code) for n in m[1].split(",")]
    return any(re.match(r"\s*use[A-Z]\w*", n) and n.split()[0] != "useT" for n in names if n.strip())


@dataclass(frozen=True)
class Translator:
    """The translator of a component: its name, its namespace (None: none), and whether the component has it already."""

    name: str
    space: str | None
    there: bool
    args: J.Token | None = None  # where it is there, the brackets around its namespace


def translator_in(body: list[J.Token], makers: set[str]) -> Translator | None:
    """A `const name = [await] maker("namespace")` among a body's statements; makers: names under which a file can call one."""
    for i, t in enumerate(body):
        if t.text == "const" and i + 3 < len(body) and body[i + 1].kind == "name" and body[i + 2].text == "=":
            j = i + 3 + (body[i + 3].text == "await")
            if j + 1 < len(body) and body[j].text in makers and body[j + 1].kind == "group" and body[j + 1].text == "(":
                args = body[j + 1].parts
                if not args or len(args) == 1 and args[0].kind == "string":
                    return Translator(body[i + 1].text, args[0].text if args else None, True, body[j + 1])
    return None


def common_space(keys: set[str]) -> str | None:
    """The namespace that all keys share, None if any has none or two differ [AGG13]."""
    spaces = {k.split(".")[0] if k.find(".") > 0 else None for k in keys}
    return spaces.pop() if len(spaces) == 1 else None


def retargeted(code: str, body: list[J.Token], own: Translator, keys: set[str]) -> tuple[Translator, list[tuple[int, int, str]]] | None:
    """The component's own translator under the namespace that its old and new keys share, or under none, and the edits that its declaration and its calls need; None if it can stay as it is, or if any use of it is no call with a plain string, so that its keys aren't known [CG6].

    Uses are found by scopes: a name that a parameter, a block or a function binds again is another one.
    """
    calls = B.Calls(code, body, {own.name})
    if calls.reasons:
        return None
    full = [(text, f"{own.space}.{text.text}" if own.space else text.text) for text in calls.keys]
    space = common_space(keys | {key for _, key in full})
    if space == own.space:
        return None
    edits = [(own.args.start, own.args.end, f'("{space}")' if space else "()")]
    edits += [(text.start, text.end, json.dumps(key[len(space) + 1 :] if space else key, ensure_ascii=False)) for text, key in full]
    return Translator(own.name, space, True), edits


def translator_for(found: list[J.Token], params: list[J.Token], keys: set[str], makers: set[str], outer: set[str], bare: bool = False) -> Translator:
    """The component's own translator if all keys lie in its namespace (bare: if it has none), else a new one under a name that nothing in the component or around it (outer) binds; existing calls are never touched [CG5, CG6]."""
    own = translator_in(found, makers)
    if own and (own.space is None or not bare and all(k.startswith(own.space + ".") for k in keys)):
        return own
    taken, n, name = J.names_in(params) | J.bound_names(found) | outer, 1, "t"
    while name in taken:
        n, name = n + 1, "tr" if n == 1 else f"tr{n}"
    return Translator(name, None if bare else common_space(keys), False)


def local_names(imported: list[J.Import], name: str, source: str) -> list[str]:
    """The names under which a file has imported something [CG14]."""
    return [local for x in imported if x.source == source and not x.type_only for other, local in x.names if other == name]


def with_import(code: str, name: str, source: str) -> str:
    """code that imports name from source: unchanged if it does, in the braces of an import from there, else in a line of its own after a directive [CG14]."""
    imported = J.imports(J.read(code))
    if local_names(imported, name, source):
        return code
    for x in imported:
        if x.source == source and x.group is not None and not x.type_only and x.names:
            inner = code[x.group.start + 1 : x.group.end - 1].strip().rstrip(",")
            return f"{code[: x.group.start]}{{ {inner}, {name} }}{code[x.group.end :]}"
    directive = re.match(r"""\s*['"]use (?:client|server)['"];?\s*?\n""", code)
    at = directive.end() if directive else 0
    return f'{code[:at]}import {{ {name} }} from "{source}";\n{code[at:]}'


def one_inline_source(code: str, tokens: list[J.Token], client: bool, module: str) -> str:
    """code whose imports of the inline runtime come from the source and under the hook of its side, with the calls of that hook renamed; on the server createT(name) loses a name that nothing binds [CG13].

    Client files take useT from module, others createT from module-server; module/t-server is an older name of the latter. A local alias stays.
    """
    ours = [i for i in J.imports(tokens) if i.source in (module, f"{module}-server", f"{module}/t-server") and i.names and not i.type_only]
    source, old, new = (module, "createT", "useT") if client else (f"{module}-server", "useT", "createT")
    edits, renamed, bound = [], False, J.bound_names(tokens) | {local for i in J.imports(tokens) for _, local in i.names}
    for i in ours:
        if i.source != source:
            edits.append((i.end - len(i.source) - 1, i.end - 1, source))
        for item in B.split(i.group.parts) if i.group else ():
            if item and item[0].text == old:
                edits.append((item[0].start, item[0].end, new))
                renamed |= len(item) == 1
    local = {x for i in ours for name, x in i.names if name in (old, new)}
    todo = [tokens] if renamed or not client and local else []
    while todo:
        here = [t for t in todo.pop() if isinstance(t, J.Token)]
        for k, t in enumerate(here):
            args = here[k + 1] if k + 1 < len(here) else None
            if t.kind == "name" and t.text in local and args is not None and args.kind == "group" and args.text == "(" and not (k and here[k - 1].text in (".", "?.", "function")):
                if renamed and t.text == old:
                    edits.append((t.start, t.end, new))
                if not client and len(args.parts) == 1 and args.parts[0].kind == "name" and args.parts[0].text not in bound:
                    edits.append((args.start, args.end, "()"))
            todo += ([t.parts] if t.kind in ("group", "hole") else []) + [p for p in t.parts if isinstance(p, list)]
            todo += [[v] for *_, v in t.attributes if v is not None] + [t.children]
    for start, end, text in sorted(edits, reverse=True):
        code = code[:start] + text + code[end:]
    return code


def rewrite(code: str, keys: dict[str, str], module: str = "next-intl", mode: str = "keys", inline_module: str = "@/components/t", client: bool | None = None, factories: set[str] | None = None, uses: set[str] | None = None, typed: bool = True, waiting: bool = False, retarget: bool = False) -> tuple[str, int, bool]:
    """(code, replaced, client) with mapped strings as calls of a translator [CG2, CG4-6]: JSX text, attributes, expressions, ternary branches and content properties of components.

    mode "inline" [CG3] keeps the source text: <T id="key">text</T> for JSX text and t("text", "key") for the rest, from inline_module, on the server from inline_module-server (one_inline_source). In mode "keys" each component with a replaced string gets a translator at the start of its body, with the namespace if all its keys share one, then without it in the keys.
    A translator that is there is used where it fits, else a new one gets a name of its own (translator_for); imports are reused under their aliases, extended or added. client: whether the file reaches the browser (see graph.client_files); by itself judged by is_client. Async components of other files await their translator.
    retarget: a translator that is there gets the namespace that its old and new keys share, or none, with its calls rewritten, if all of them are known (retargeted); else, and without retarget, it stays as it is.
    waiting: components of such files that aren't async become so, but for hooks, which cannot (only with the default module, which alone has a server side). A component whose body is an expression gets a block around it, with the translator and a return.
    factories: constants of this file that become functions of a translator, with the mapped texts in them as its calls; uses: names of such functions, imported ones too, that components call with their translator, which then has no namespace (see factories.factory_plan) [CG12]. typed: whether the file may have types.
    Strings outside components are left. The result is read again; if that fails, or nothing is replaced, the code comes back unchanged. Running twice changes nothing.
    """
    given, x = code, Extractor(code)
    strings, client, inline = x.run(), is_client(code) if client is None else client, mode == "inline"
    if inline and (code := one_inline_source(code, x.tokens, client, inline_module)) != given:
        x = Extractor(code)
        strings = x.run()
    found = [f for f in strings if f.text in keys and f.node is not None and f.scope.component and re.match("[A-Z]|__default__$|use[A-Z]", f.scope.component) and f.scope.body in x.bodies and f.type != "module-object-property"]
    wrapped = [d for d in B.constants(code, x.tokens) if d.name in factories] if factories else []
    held = [f for f in x.found if f.type == "module-object-property" and f.node is not None and f.text in keys and any(d.value[0] <= f.node.start < d.value[1] for d in wrapped)]
    handed = [u for u in B.Uses(code, x.tokens, uses).found if u.body in x.bodies] if uses else []
    if not found and not held and not handed:
        return code, 0, client
    imported = J.imports(x.tokens)
    hook, getter = (("useT", "createT"), (inline_module, f"{inline_module}-server")) if inline else (("useTranslations", "getTranslations"), (module, f"{module}/server"))
    makers = {n: local_names(imported, n, source) for n, source in zip(hook, getter, strict=True)}
    every = {n for names in makers.values() for n in names} | set(hook)
    outer = J.bound_names(x.tokens, deeply=False) | {local for i in imported for _, local in i.names}
    translators: dict[int, Translator] = {}
    bare = {u.body for u in handed}
    calls = {f.scope.body for f in found if not (inline and f.type == "jsx-text")} | bare
    edits: list[tuple[int, int, str]] = []
    for body in {f.scope.body for f in found} | bare:
        params, parts = x.bodies[body]
        own = translator_in(parts, every) if inline or retarget else None
        if own and not inline:
            moved = retargeted(code, parts, own, {keys[f.text] for f in found if f.scope.body == body}) if body not in bare and own.args else None
            own, more = moved or (None, [])
            edits += more
        translators[body] = own or translator_for(parts, params, set() if inline else {keys[f.text] for f in found if f.scope.body == body}, set() if inline else every, outer, body in bare)
    for d in wrapped:
        kind = code[d.at.end : d.equals.start].strip()
        edits += [(d.at.end, d.value[0], f" = (t{': any' * typed}){kind} => ("), (d.value[1], d.value[1], ")")]
    for u in handed:
        call = f"{u.name.text}({translators[u.body].name})"
        edits.append((u.name.start, u.name.end, f"{u.name.text}: {call}" if u.short else call))
    for f in found + held:
        key, tr = keys[f.text], Translator("t", None, True) if f.type == "module-object-property" else translators[f.scope.body]
        short = key[len(tr.space) + 1 :] if tr.space and not inline else key
        values = J.template_values(f.node) if f.node.kind == "template" else []
        if inline and f.type == "jsx-text":
            raw = code[f.node.start : f.node.end]
            edits.append((f.node.start + len(raw) - len(raw.lstrip()), f.node.end - len(raw) + len(raw.rstrip()), f'<T id="{key}">{raw.strip()}</T>'))
            continue
        extra = ", { " + ", ".join(n if n == e else f"{n}: {e}" for n, e in values) + " }" if values else ""
        call = f"{tr.name}({json.dumps(f.text, ensure_ascii=False)}, {json.dumps(key)}{extra})" if inline else f'{tr.name}("{short}"{extra})'
        if f.type == "jsx-text":
            raw = code[f.node.start : f.node.end]
            lead, tail = len(raw) - len(raw.lstrip()), len(raw) - len(raw.rstrip())
            edits.append((f.node.start + lead, f.node.end - tail, "{" + call + "}"))
        elif f.type == "jsx-attribute" and code[f.node.start - 1] == "=":
            edits.append((f.node.start, f.node.end, "{" + call + "}"))
        else:
            edits.append((f.node.start, f.node.end, call))
    waits = {f.scope.body: f.scope.waits for f in found} | {u.body: u.waits for u in handed}
    split = not client and (inline or module == "next-intl")  # whether a server side exists
    hooks = {f.scope.body for f in found if re.match("use[A-Z]", f.scope.component)}
    needed: set[tuple[str, str]] = set()
    for body, tr in translators.items():
        if tr.there or inline and body not in calls:
            continue
        if waiting and split and not inline and not waits[body] and body in x.heads and body not in hooks:
            edits.append((x.heads[body], x.heads[body], "async "))
            waits[body] = True
        k = 1 if split and (inline or waits[body]) else 0
        if not makers[hook[k]]:
            needed.add((hook[k], getter[k]))
        argument = f'"{tr.space}"' if tr.space and not inline else ""
        line = f"\n\tconst {tr.name} = {'await ' * (k and waits[body])}{(makers[hook[k]] or [hook[k]])[0]}({argument});"
        if body in x.expressions:  # a block around the expression and the edits in it
            edits += [(body, body, f"{{{line}\n\treturn "), (x.expressions[body], x.expressions[body], ";\n}")]
        else:
            edits.append((body, body, line))
    if inline and any(f.type == "jsx-text" for f in found):
        needed.add(("T", getter[0 if client else 1]))
    out = code
    for start, end, new in sorted(edits, reverse=True):
        out = out[:start] + new + out[end:]
    try:
        for name, source in sorted(needed):
            out = with_import(out, name, source)
        J.read(out)
    except J.Unreadable:
        return given, 0, client
    return out, len(found) + len(held), client


def rewrite_sources(files: DataFrame, mapping: DataFrame, path: str = "path", content: str = "content", clients: DataFrame | None = None, factories: DataFrame | None = None, mode: str = "keys", waiting: bool = False, retarget: bool = False) -> DataFrame:
    """path, content, replaced, client, modified (whether the content is new) of every file [CG1, SNK8]. Each file meets only the keys of its own texts: its strings are joined with the map (text, key) and gathered by file.

    clients: paths of files that reach the browser over imports (graph.client_files); without it each file is judged by itself. factories: rows of factories.factory_plan, whose constants and uses are rewritten too. mode, waiting, retarget: see rewrite. Of a text that the map has several times the greatest key counts, as in keys.replacement_sites. Files that cannot be read come back unchanged.
    """
    strings = extract_strings(files, path=path, content=content).select(F.col("file").alias(path), "text").distinct()
    keyed = mapping.where("text IS NOT NULL AND key IS NOT NULL").groupBy("text").agg(F.max("key").alias("key"))
    own = strings.join(keyed, "text").groupBy(path).agg(F.map_from_entries(F.collect_set(F.struct("text", "key"))).alias("keys"))
    joined = files.select(path, content).join(own, path, "left")
    known = joined.withColumn("client", F.lit(None).cast("boolean")) if clients is None else joined.join(clients.select(F.col("path").alias(path), F.lit(True).alias("client")).distinct(), path, "left").na.fill(False, ["client"])
    none = F.lit(None).cast("array<string>")
    if factories is None:
        known = known.withColumn("consts", none).withColumn("uses", none)
    else:
        planned = factories.where("reason IS NULL").groupBy(F.col("path").alias(path)).agg(F.collect_set(F.when(F.col("role") == "constant", F.col("name"))).alias("consts"), F.collect_set("name").alias("uses"))
        known = known.join(planned, path, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in J.pieces(batches):
            out: list[list] = [[], [], [], []]
            for file, code, keys, reaches, consts, uses in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                judged = is_client(code or "") if reaches is None else reaches
                typed = bool(re.search(r"\.[mc]?tsx?$", file or ""))
                try:
                    row = rewrite(code, dict(keys or {}), client=judged, mode=mode, factories=set(consts or []), uses=set(uses or []), typed=typed, waiting=waiting, retarget=retarget) if code and (keys or uses or mode == "inline") else (code, 0, judged)
                except J.Unreadable:
                    row = (code, 0, judged)
                for col, v in zip(out, (*row, row[0] != code), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.bool_())], [path, "content", "replaced", "client", "modified"])

    return known.mapInArrow(run, f"{path} string, content string, replaced int, client boolean, modified boolean")


def totals(rewritten: DataFrame) -> DataFrame:
    """One row: files, files_modified, strings_wrapped, files_skipped, client_files of rewrite_sources' rows [AGG15]."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return rewritten.agg(F.count("*").alias("files"), n(F.col("modified")).alias("files_modified"), n(F.col("replaced")).alias("strings_wrapped"), n(~F.col("modified")).alias("files_skipped"), n(F.col("client")).alias("client_files"))
