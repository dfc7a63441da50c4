"""Constants of modules that hold texts, planned to become functions of a translator, over all files that import them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bindings as B
from ..functions import jsx as J
from . import graph, jsx_strings

#: Exports that the framework reads itself, so that they stay plain.
RESERVED = [
    "metadata", "generateMetadata", "viewport", "generateViewport", "revalidate", "dynamic", "dynamicParams", "fetchCache",
    "runtime", "preferredRegion", "maxDuration", "generateStaticParams",
]

FACTS = "path string, consts array<struct<name string, exported boolean, texts array<string>, reason string>>, imports array<struct<source string, name string, local string, reason string>>, sources array<string>"


def facts(code: str, included: bool = True) -> tuple[list[tuple], list[tuple]]:
    """(constants with texts, imports) of a file, each with the reason why it can't take part, or None [CG9, CG10]. Whole modules are imported as '*'."""
    x = jsx_strings.Extractor(code)
    found = [f for f in x.run() if f.type == "module-object-property"] if included else []
    if not included:
        x.tokens = J.read(code)
    declared = [(d, [f.text for f in found if d.value[0] <= f.node.start < d.value[1]]) for d in (B.constants(code, x.tokens) if found else [])]
    declared = [(d, texts) for d, texts in declared if texts]
    imported = [i for i in J.imports(x.tokens) if not i.type_only]
    locals_ = {local for i in imported for _, local in i.names}
    reasons: dict[str, str] = {}
    if included and (declared or locals_):
        uses = B.Uses(code, x.tokens, {d.name for d, _ in declared} | locals_)
        reasons = {u.name.text: "used where no translator can stand" for u in uses.found if u.body not in x.bodies} | uses.reasons
    consts = [(d.name, d.exported, texts, reasons.get(d.name) or ("it binds t itself" if "t" in J.names_in(d.tokens) else None)) for d, texts in declared]
    out = []
    for i in imported:
        if code.startswith("export", i.start):
            out += [(i.source, name, None, "exported again") for name in ([item[0].text for item in B.split(i.group.parts) if item] if i.group else ["*"])]
        for name, local in i.names:
            why = "imported as a whole" if name == "*" else reasons.get(local) if included else "imported by a file that stays as it is"
            out.append((i.source, name, local, why))
    rest = [t for t in x.tokens if not any(i.start <= t.start < i.end for i in imported)]
    whole = [*J.runtime_imports(rest), *re.findall(r"""\brequire\(\s*['"]([^'"]+)['"]""", code)]
    return consts, out + [(source, "*", None, "imported as a whole") for source in dict.fromkeys(whole)]


def file_facts(files: DataFrame) -> DataFrame:
    """FACTS of files (path, content, included); files that can't be read and null contents have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        const = pa.struct([("name", text), ("exported", pa.bool_()), ("texts", pa.list_(text)), ("reason", text)])
        link = pa.struct([("source", text), ("name", text), ("local", text), ("reason", text)])
        for batch in J.pieces(batches):
            rows = []
            for path, code, included in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    consts, links = facts(code, bool(included)) if code is not None else (None, [])
                except J.Unreadable:
                    continue
                if consts is not None:
                    named = [dict(zip(("name", "exported", "texts", "reason"), c, strict=True)) for c in consts]
                    linked = [dict(zip(("source", "name", "local", "reason"), c, strict=True)) for c in links]
                    rows.append((path, named, linked, list(dict.fromkeys(c[0] for c in links))))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((text, pa.list_(const), pa.list_(link), pa.list_(text)))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "consts", "imports", "sources"])

    return files.select("path", "content", "included").mapInArrow(run, FACTS)


def factory_plan(files: DataFrame, mapping: DataFrame, aliases: list[tuple[str, bool, list[str]]] | None = None) -> DataFrame:
    """path, name, role ('constant' or 'import', whose name is the local one), reason: null for what becomes a function of the translator, or a call of one, else why not [CG9-CG11, FLT14].

    files (path, content, and included, if only some may be rewritten); mapping (text, key). A constant takes part if it holds a text of the map, all its uses stand in components and none changes it [CG10], and all its importers are files that can be rewritten and use it as safely [JN15-JN17]. The reasons of a constant are those of its file, else the least of its importers'.
    Files are read once; candidates meet the map, the imports and the files in equi-joins. Null paths, contents, texts and repeated rows add nothing.
    """
    if "included" not in files.columns:
        files = files.withColumn("included", F.lit(True))
    known = graph.saved(file_facts(files.where("path IS NOT NULL")))
    consts = known.select("path", F.explode("consts").alias("c")).select("path", "c.*")
    reserved = F.col("exported") & F.col("name").isin(RESERVED)
    held = consts.where(~reserved).withColumn("text", F.explode("texts")).join(mapping.select("text").distinct(), "text", "left_semi")
    candidates = graph.saved(held.select("path", "name", "exported", "reason").distinct())
    links = known.select(F.col("path").alias("src"), F.explode("imports").alias("i")).select("src", "i.source", F.col("i.name").alias("name"), "i.local", F.col("i.reason").alias("why"))
    links = links.join(graph.resolved_imports(known, aliases), ["src", "source"]).withColumnRenamed("dst", "path")
    shared = candidates.where("exported").select("path", "name")
    edges = links.where("name <> '*'").join(shared, ["path", "name"]).unionByName(links.where("name = '*'").drop("name").join(shared, "path"))
    edges = graph.saved(edges.select("path", "name", "src", "local", "why"))
    blocked = edges.groupBy("path", "name").agg(F.min("why").alias("why"))
    settled = candidates.join(blocked, ["path", "name"], "left").select("path", "name", F.coalesce("reason", "why").alias("reason"))
    importers = edges.where("local IS NOT NULL").drop("why").join(settled, ["path", "name"]).select(F.col("src").alias("path"), F.col("local").alias("name"), F.lit("import").alias("role"), "reason")
    return settled.select("path", "name", F.lit("constant").alias("role"), "reason").unionByName(importers.distinct())
