"""Scanning operators: text nodes and attributes of markup, enrichment of extracted strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import saved

TAG_AND_TEXT = r"<(/?[\w-]+)[^<>]*>([^<>]*)"
ATTRIBUTE = r"""\s([a-zA-Z-]+)="([^"<>]*)\""""


def text_nodes(pages: DataFrame, html: str = "html", row_id: str = "page_id") -> DataFrame:
    """row_id, pos, tag, text of each text node that anyone may translate [EXT1]. tag: the mark right before the text; a closing one has a slash.

    Built-in functions only, so the scan, the regular expression (one pass, of whole matches) and the filters run in the JVM. Text inside ignored tags (script, style, code ...) is left out. Null markup has no nodes; repeated rows give theirs each; markup of any length is one value.
    """
    mark = lambda n: F.lower(F.regexp_extract(n, r"^<(/?[\w-]+)", 1))
    node = lambda n: F.struct(mark(n).alias("tag"), T.trim_unicode(F.substring(n, F.instr(n, ">") + 1, F.length(n))).alias("text"))
    found = F.transform(F.regexp_extract_all(html, F.lit(TAG_AND_TEXT), 0), node)  # marked and trimmed inside the generator, once for each node: filters above it read columns
    rows = pages.select(row_id, F.posexplode(found).alias("pos", "n")).select(row_id, (F.col("pos") + 1).cast("long").alias("pos"), "n.tag", "n.text")
    return rows.where(~T.is_ignored_tag("tag") & ~T.is_ignored_text("text", trimmed=True))


def attributes(pages: DataFrame, html: str = "html", row_id: str = "page_id", custom: list[str] | None = None) -> DataFrame:
    """row_id, pos, name, value of each attribute that may be translated [EXT2]; values are not trimmed. Null markup has none; repeated rows give theirs each."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(ATTRIBUTE), 1).alias("name"), F.regexp_extract_all(html, F.lit(ATTRIBUTE), 2).alias("value"))
    rows = pages.select(row_id, F.posexplode(both).alias("pos", "a")).select(row_id, (F.col("pos") + 1).cast("long").alias("pos"), "a.name", "a.value")
    return rows.where(T.is_translatable_prop("name", custom) & ~T.is_ignored_text("value"))


def sibling_texts(strings: DataFrame, file: str = "file", component: str = "component", limit: int = 5) -> DataFrame:
    """strings with siblings: the first `limit` other occurrences in the component of the file, in order; null if there are none [WIN1, AGG9].

    Only the first limit + 1 rows of a component can be siblings; they are taken by rank, gathered (a bounded array) and joined back, so a component of any size never meets in one array.
    """
    group = F.coalesce(component, F.lit("__root__"))
    ranked = strings.withColumn("_g", group)
    heads = ranked.select(file, "_g", "seq", "text").withColumn("_n", F.row_number().over(Window.partitionBy(file, "_g").orderBy("seq"))).where(F.col("_n") <= limit + 1)
    heads = heads.groupBy(file, "_g").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_h"))
    others = F.slice(F.filter("_h", lambda x: x["seq"] != F.col("seq")), 1, limit)
    out = ranked.join(heads, [file, "_g"]).withColumn("siblings", F.transform(others, lambda x: x["text"]))
    return out.withColumn("siblings", F.when(F.size("siblings") > 0, F.col("siblings"))).select(*strings.columns, "siblings")


def section_headings(strings: DataFrame, file: str = "file", tag: str = "tag") -> DataFrame:
    """strings with heading: the file's first text of h1 to h3, null where it is the text itself [WIN2]. Rows with a null file have none; of equal seq any."""
    first = strings.where(F.col(tag).rlike("^h[1-3]$")).groupBy(file).agg(F.min_by("text", "seq").alias("_h"))
    return strings.join(first, file, "left").withColumn("heading", F.when(F.col("_h") != F.col("text"), F.col("_h"))).drop("_h")


def enrich(strings: DataFrame) -> DataFrame:
    """strings (file, component, tag, seq, text) with route, siblings and heading [EXT12]. The strings are written once, so that their extraction is not repeated for each of the joins."""
    return section_headings(sibling_texts(saved(strings))).withColumn("route", T.route_path("file"))


def context_entries(mapping: DataFrame, strings: DataFrame) -> DataFrame:
    """key, context: the first occurrence of each mapped text as JSON without empty fields [SNK5, JN7]. Null texts match nothing; of equal seq the least other fields; a text that the map repeats gives a row for each key."""
    fields = [c for c in ("type", "component", "prop", "tag", "route", "composite") if c in strings.columns]
    first = strings.groupBy("text").agg(F.min(F.struct("seq", *fields)).alias("_f"))
    filled = [F.when(F.length(F.col("_f").getField(c)) > 0, F.col("_f").getField(c)).alias(c) for c in fields]
    return mapping.join(first, "text").select("key", F.to_json(F.struct(*filled)).alias("context"))


def prompt_groups(strings: DataFrame) -> DataFrame:
    """file, n, block: the lines about a file's strings in a key prompt [AGG10, WIN9]. A prompt is one value, so give it a batch's strings.

    A line has the text, then component, tag, prop, const, section (heading), the first three siblings and the composite context, as far as the columns are there and filled.
    """
    named = [(c, label) for c, label in (("component", "component"), ("tag", "tag"), ("prop", "prop"), ("const", "const"), ("heading", "section"), ("composite", "composite")) if c in strings.columns]
    more = ["siblings"] if "siblings" in strings.columns else []
    lines = strings.groupBy(F.coalesce(F.nullif("file", F.lit("")), F.lit("(unknown)")).alias("file")).agg(F.array_sort(F.collect_list(F.struct("seq", "text", *[c for c, _ in named], *more))).alias("all"))

    def line(x: Column) -> Column:
        quoted = lambda c, label: F.concat(F.lit(f'{label}: "'), x[c], F.lit('"')) if label in ("section", "composite") else F.concat(F.lit(f"{label}: "), x[c])
        parts = [F.concat(F.lit('"'), x["text"], F.lit('"')), *[F.when(F.length(x[c]) > 0, quoted(c, label)) for c, label in named]]
        if more:
            shown = F.array_join(F.transform(F.slice(x["siblings"], 1, 3), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
            parts.append(F.when(F.size(x["siblings"]) > 0, F.concat(F.lit("siblings: ["), shown, F.lit("]"))))
        return F.concat(F.lit("  "), F.array_join(F.array_compact(F.array(*parts)), ", "))

    return lines.select("file", F.size("all").cast("long").alias("n"), F.array_join(F.transform("all", line), "\n").alias("block"))


RULES = """Give each text of this user interface a key of two parts, namespace.name, both in camelCase.
All texts of one component have one namespace: of its route, else of the component, else of its folder.
Use the namespaces common, auth, nav, form and error only for texts that many unrelated components share.
Equal texts have equal keys. Keys are short and say what the text means."""


def key_prompts(strings: DataFrame, mapping: DataFrame, known: int = 30, rules: str = "") -> DataFrame:
    """file, prompt: rules (see RULES), the first `known` map entries for consistency, then the file with its route and its strings [STR15, WIN8]. The entries are `known` rows at most, so they go to all tasks as one literal."""
    head = mapping.orderBy("seq").limit(known).collect()
    lines = "\n".join(f'  {r.key} <- "{r.text}"' for r in head)
    start = f"{rules}\n\n" * bool(rules) + f"Known keys:\n{lines}\n" * bool(head)
    groups = prompt_groups(strings)
    route = F.coalesce(F.concat(F.lit(" (route: "), T.route_path("file"), F.lit(")")), F.lit("")) if rules else F.lit("")
    return groups.select("file", F.concat(F.lit(f"{start}Strings of "), "file", route, F.lit(":\n"), "block").alias("prompt"))


def translation_prompts(batches: DataFrame, language: str, key: str = "key", text: str = "text", order: str = "seq", by: tuple[str, ...] = ("batch_id",), tone: str | None = None, glossary: dict[str, str] | None = None, hint: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """by, prompt: what a model is asked for each batch of texts [STR14]. A prompt is one value; batches are bounded by planning.

    language: a column of `by`. Tone and glossary are the project's; hint: a column shown after its text; earlier: (by, key, source, value) of translations that a batch is shown, in key order.
    """
    fields = [F.col(order), F.col(key).alias("k"), F.col(text).alias("t"), (F.col(hint) if hint else F.lit(None).cast("string")).alias("h")]
    line = lambda x: F.concat(F.lit('  "'), x["k"], F.lit('": "'), x["t"], F.lit('"'), F.coalesce(F.concat(F.lit(" ("), F.nullif(x["h"], F.lit("")), F.lit(")")), F.lit("")))
    rows = batches.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("l"))
    parts = [F.concat(F.lit("Translate to "), F.col(language), F.lit(":"))]
    if tone:
        parts.append(F.lit(f"Tone: {tone}"))
    if glossary:
        parts.append(F.lit("Terms:\n" + "\n".join(f'  "{a}" is "{b}"' for a, b in glossary.items())))
    if earlier is not None:
        shown = F.transform(F.array_sort(F.collect_list(F.struct(F.col("key").alias("k"), F.col("source").alias("s"), F.col("value").alias("v")))), lambda x: F.concat(F.lit('  "'), x["s"], F.lit('" is "'), x["v"], F.lit('"')))
        rows = rows.join(earlier.groupBy(*by).agg(F.array_join(shown, "\n").alias("e")), list(by), "left")
        parts.append(F.when(F.col("e").isNotNull(), F.concat(F.lit("Translated earlier:\n"), "e")))
    parts.append(F.array_join(F.transform("l", line), "\n"))
    return rows.select(*by, F.array_join(F.array_compact(F.array(*parts)), "\n").alias("prompt"))
