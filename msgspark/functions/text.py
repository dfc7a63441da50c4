"""Column functions over texts, keys and paths. SURVEY ids are given in brackets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Lists and patterns that decide results.
TRANSLATABLE_PROPS = ["placeholder", "title", "alt", "aria-label", "aria-description", "aria-placeholder", "label"]
NEVER_PROPS = ["className", "class", "id", "key", "ref", "href", "src", "type", "name", "value", "htmlFor", "for", "role", "style", "data-testid", "data-cy", "onClick", "onChange", "onSubmit", "onFocus", "onBlur"]
IGNORED_TAGS = ["script", "style", "code", "pre", "svg", "path", "circle", "rect", "line", "polyline", "polygon"]
CONTENT_PROPS = ["title", "description", "label", "text", "content", "heading", "subtitle", "caption", "summary", "message", "placeholder", "alt"]
PLACEHOLDER = r"\{\{[\w.]+\}\}|\{[\w.]+\}|%[sd@]|%\.\d+f|</?[\w-]+(?:\s[^>]*)?\s*/?>"
KEBAB, CONSTANT = r"^[a-z0-9]+(?:-[a-z0-9]+){2,}$", r"^(?=.*[_0-9])[A-Z0-9_]+$"
URL, NUMBER = r"^https?://", r"^[0-9.,%$€£¥]+$"
APP_ROUTE, PAGES_ROUTE, COMPONENT_ROUTE = r"app/(.+?)/page\.[jt]sx?$", r"pages/(.+?)\.[jt]sx?$", r"components/(.+?)/"
LOCALE = r"^[a-zA-Z0-9_-]+$"
CHARS_PER_TOKEN = 4

#: Fixed value: every Unicode space, and the byte order mark.
SPACES = "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def struct_of(fields: list[tuple[str, DataType]], ddl: str = "") -> StructType:
    """A schema of typed columns, whatever their names, and of columns in DDL after them."""
    more = StructType.fromDDL(ddl).fields if ddl else []
    return StructType([*[StructField(name, kind) for name, kind in fields], *more])


def lit_any(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_unicode(c: Column | str) -> Column:
    """Trim every Unicode space and the byte order mark at both ends, in one look at each character [STR17]."""
    return F.btrim(lit_any(c), F.lit(SPACES))


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 code units, exact for astral characters too."""
    return (F.octet_length(F.encode(lit_any(c), "UTF-16BE")) / 2).cast("long")


def source_hash(c: Column | str) -> Column:
    """First 16 hex digits of SHA-256 [STR2]."""
    return F.substring(F.sha2(lit_any(c), 256), 1, 16)


def estimate_tokens(c: Column | str) -> Column:
    """One token for four UTF-16 units, rounded up, one at least [STR3]."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(utf16_length(c) / CHARS_PER_TOKEN))


def entry_tokens(key: Column | str, value: Column | str) -> Column:
    return estimate_tokens(key) + estimate_tokens(value)


def placeholders(c: Column | str) -> Column:
    """All placeholders and tags of a text, sorted by UTF-16 units, repeats kept [STR1, WIN12]. That is the order of their bytes unless characters beyond U+FFFF stand in them, so only texts with such get sort keys."""
    text = lit_any(c)
    found = F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), 1)
    keyed = F.array_sort(F.transform(found, lambda p: F.struct(F.encode(p, "UTF-16BE").alias("k"), p.alias("p"))))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), F.transform(keyed, lambda x: x["p"])).otherwise(F.array_sort(found))


def is_ignored_text(c: Column | str, trimmed: bool = False) -> Column:
    """Texts that nobody translates: blank, identifiers, addresses, numbers, no letter at all [FLT1-3]. trimmed: c is trimmed already, so that it isn't trimmed again for each of the rules."""
    t = lit_any(c) if trimmed else trim_unicode(c)
    return (t == "") | t.rlike(KEBAB) | t.rlike(CONSTANT) | t.rlike(URL) | t.rlike(NUMBER) | ~t.rlike(r"\p{L}")


def is_translatable_prop(c: Column | str, custom: Iterable[str] | None = None) -> Column:
    """The deny list wins; a custom list replaces the default one [FLT4]."""
    name = lit_any(c)
    return ~name.isin(NEVER_PROPS) & name.isin(list(TRANSLATABLE_PROPS if custom is None else custom))


def is_ignored_tag(c: Column | str) -> Column:
    return F.lower(lit_any(c)).isin(IGNORED_TAGS)


def is_content_prop(c: Column | str) -> Column:
    return lit_any(c).isin(CONTENT_PROPS)


def is_valid_locale(c: Column | str) -> Column:
    return lit_any(c).rlike(LOCALE)


def is_pascal_case(c: Column | str) -> Column:
    name = lit_any(c)
    return name.rlike("^[A-Z]") | (name == "__default__")


def namespace(key: Column | str) -> Column:
    """Before the first dot, null where there is none or it leads [B7, first predicate]."""
    k = lit_any(key)
    return F.when(F.instr(k, ".") > 1, F.substring_index(k, ".", 1))


def first_segment(key: Column | str) -> Column:
    """Before the first dot, the whole key where there is none, null for an empty segment [B7, second predicate]."""
    return F.nullif(F.substring_index(lit_any(key), ".", 1), F.lit(""))


def partition_of(key: Column | str) -> Column:
    """The file of a split catalog: namespace, or _root [STR9]."""
    return F.coalesce(namespace(key), F.lit("_root"))


def key_in_partition(key: Column | str) -> Column:
    k = lit_any(key)
    return F.when(namespace(k).isNull(), k).otherwise(F.substring(k, F.instr(k, ".") + 1, F.length(k)))


def rejoin_key(ns: Column | str, rest: Column | str) -> Column:
    """The inverse of partition_of and key_in_partition [SRC7]."""
    return F.when(lit_any(ns) == "_root", lit_any(rest)).otherwise(F.concat_ws(".", lit_any(ns), lit_any(rest)))


def strip_namespace(key: Column | str, ns: Column | str) -> Column:
    k, n = lit_any(key), lit_any(ns)
    return F.when(F.startswith(k, F.concat(n, F.lit("."))), F.substring(k, F.length(n) + 2, F.length(k))).otherwise(k)


def auto_prefix(key: Column | str, ns: Column | str) -> Column:
    """Keys of one segment get a namespace [STR7]."""
    k = lit_any(key)
    return F.when(F.instr(k, ".") == 0, F.concat_ws(".", lit_any(ns), k)).otherwise(k)


def route_path(path: Column | str) -> Column:
    """Route of a source file, by app router, pages router or component folder, in this order; null for others [STR4]."""
    p = lit_any(path)
    app, pages, part = (F.regexp_extract(p, pattern, 1) for pattern in (APP_ROUTE, PAGES_ROUTE, COMPONENT_ROUTE))
    dotted = lambda c: F.replace(c, F.lit("/"), F.lit("."))
    return F.when(app != "", dotted(app)).when(pages != "", F.nullif(dotted(F.regexp_replace(pages, "/index$", "")), F.lit(""))).when(part != "", part)


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, F.length(c)))


def infer_namespace(component: Column | str, route: Column | str, path: Column | str, split_on: str = "/") -> Column:
    """Namespace from component, else route, else file name, else its folder, else 'common' [STR5].

    split_on: the separator within routes; route_path gives dots, so "." is the form that names the last segment of those.
    """
    component, route, path = lit_any(component), lit_any(route), lit_any(path)
    last = F.get(F.reverse(F.filter(F.split(route, f"\\Q{split_on}\\E"), lambda s: (s != "") & ~F.startswith(s, F.lit("[")))), F.lit(0))
    parts = F.reverse(F.split(F.regexp_replace(path, r"\.\w+$", ""), "/"))
    stem, folder = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return (
        F.when(F.length(component) > 0, lower_first(component))
        .when((F.length(route) > 0) & last.isNotNull(), F.lower(last))
        .when((F.length(path) > 0) & (F.length(stem) > 0) & ~stem.isin("index", "page", "layout"), lower_first(stem))
        .when((F.length(path) > 0) & (F.length(folder) > 0) & ~F.startswith(folder, F.lit("[")) & ~F.startswith(folder, F.lit("(")), lower_first(folder))
        .otherwise("common")
    )


def context_hint(composite: Column | str, tag: Column | str, component: Column | str, prop: Column | str, route: Column | str) -> Column:
    """What a translator should know of an entry, null if nothing [STR13]."""
    part = lambda c, before, after="": F.when(F.length(lit_any(c)) > 0, F.concat(F.lit(before), lit_any(c), F.lit(after)))
    return F.nullif(F.concat_ws(", ", part(composite, 'part of: "', '"'), part(tag, "HTML: <", ">"), part(component, "component: "), part(prop, "prop: "), part(route, "route: ")), F.lit(""))


def accept_language(header: Column | str, supported: list[str], default: str) -> Column:
    """The first supported primary language by descending weight, ties in header order; else the default [STR12, WIN13]."""
    parts = F.transform(F.split(lit_any(header), ","), lambda p, i: F.struct((-F.coalesce(F.get(F.split(F.trim(p), ";q="), F.lit(1)).try_cast("double"), F.lit(1.0))).alias("q"), i.alias("i"), F.lower(F.get(F.split(F.get(F.split(F.trim(p), ";q="), F.lit(0)), "-"), F.lit(0))).alias("lang")))
    found = F.filter(F.array_sort(parts), lambda x: x["lang"].isin(supported))
    return F.coalesce(F.get(found, F.lit(0))["lang"], F.lit(default))


def interpolate(template: Column | str, values: Column | str) -> Column:
    """Put values (a map) in place of {name}, in a single pass, so that inserted braces stay as they are; unknown names stay [STR11]."""
    t, v = lit_any(template), lit_any(values)
    marks = F.regexp_extract_all(t, F.lit(r"(\{\w+\})"), 1)
    filled = F.transform(marks, lambda m: F.coalesce(F.try_element_at(v, F.substring(m, F.lit(2), F.length(m) - 2)), m))
    pieces = F.split(t, r"\{\w+\}")
    return F.array_join(F.transform(F.arrays_zip(pieces.alias("a"), filled.alias("b")), lambda x: F.concat(F.coalesce(x["a"], F.lit("")), F.coalesce(x["b"], F.lit("")))), "")


def format_cost(usd: Column | str) -> Column:
    """Four decimals under a cent, else two [STR16]. Halves of the shortest decimal form round up."""
    c = lit_any(usd)
    return F.when(c < 0.01, F.concat(F.lit("~$"), F.format_string("%.4f", c))).otherwise(F.concat(F.lit("~$"), F.format_string("%.2f", c)))


def format_usage(tokens_in: Column | str, tokens_out: Column | str) -> Column:
    a, b = lit_any(tokens_in), lit_any(tokens_out)
    return F.concat(F.format_number(a, 0), F.lit(" in + "), F.format_number(b, 0), F.lit(" out = "), F.format_number(a + b, 0), F.lit(" tokens"))


def strip_json_comments(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(lit_any(c), r"(?s)/\*.*?\*/", ""), r"(?m)^\s*//.*$", "")
