"""Catalog operators: diff, merge, lock, partitions, nesting. Catalogs are (locale, key, value, seq); locks (locale, key, hash)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json_leaves
from ..functions import text as T
from .graph import saved

ID = ["locale", "key"]


def catalog_diff(source: DataFrame, target: DataFrame, lock: DataFrame) -> DataFrame:
    """locale, key, status, value, seq: which entries are added, modified, unchanged (with the target's value) or removed [JN1].

    One full outer join on (locale, key), the lock joined on the same keys, so all three meet in one partitioning. Added goes before modified; a missing,
    empty or other hash means modified. Keys only in the lock give nothing. Null locales and keys meet nothing, so they are added or removed; a key that repeats on a side gives a row for each pair.
    """
    s = source.select(*ID, F.col("value").alias("s_value"), "seq", F.lit(True).alias("in_s"))
    t = target.select(*ID, F.col("value").alias("t_value"), F.lit(True).alias("in_t"))
    both = s.join(t, ID, "full_outer").join(lock.select(*ID, "hash"), ID, "left")
    same = F.col("hash").eqNullSafe(T.source_hash("s_value"))
    status = F.when(F.col("in_t").isNull(), "added").when(F.col("in_s").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    out = both.withColumn("status", status)
    value = F.when(F.col("status") == "unchanged", F.col("t_value")).when(F.col("status") != "removed", F.col("s_value"))
    return out.select(*ID, "status", value.alias("value"), "seq")


def to_translate(diff: DataFrame) -> DataFrame:
    """Added entries, then modified ones, each in source order: locale, key, value, seq, rank [JN5]."""
    return diff.where(F.col("status").isin("added", "modified")).select(*ID, "value", "seq", (F.col("status") == "modified").cast("int").alias("rank"))


def diff_counts(diff: DataFrame) -> DataFrame:
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    return diff.groupBy("locale").agg(*map(n, ("added", "modified", "unchanged", "removed")))


def merge(kept: DataFrame, translated: DataFrame) -> DataFrame:
    """kept, overlaid with translated; keys in neither fall away [JN4]. Null values of translated count; null keys meet nothing; keys should stand once on each side, else each pair is a row."""
    new = translated.select(*ID, F.col("value").alias("new"), F.lit(True).alias("is_new"))
    return kept.select(*ID, F.col("value").alias("old")).join(new, ID, "full_outer").select(*ID, F.when(F.col("is_new"), F.col("new")).otherwise(F.col("old")).alias("value"))


def lock_upsert(source: DataFrame, lock: DataFrame, translated: DataFrame) -> DataFrame:
    """The lock after a run: translated keys of the source get its hash, others keep theirs, keys that left the source go [SNK3]. Translated keys that the source lacks, and null keys, give nothing; repeated translated keys count once."""
    done = translated.select(*ID, F.lit(True).alias("done")).distinct()
    out = source.select(*ID, "value").join(lock.select(*ID, "hash"), ID, "left").join(done, ID, "left")
    return out.select(*ID, F.when(F.col("done"), T.source_hash("value")).otherwise(F.col("hash")).alias("hash")).where("hash IS NOT NULL")


def overlay(existing: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """existing overwritten by new, null values too [SET4]. Null keys meet nothing; keys should stand once on each side."""
    n = new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    return existing.select(key, F.col(value).alias("_old")).join(n, key, "full_outer").select(key, F.when(F.col("_is"), F.col("_new")).otherwise(F.col("_old")).alias(value))


def invert_map(mapping: DataFrame) -> DataFrame:
    """text -> key turned to key -> value; of several texts with a key the last by seq wins, of equal seq any [SRC8]. Null keys are one key; no rows give none."""
    return mapping.groupBy("key").agg(F.max_by("text", "seq").alias("value"))


def split(catalog: DataFrame) -> DataFrame:
    """catalog with ns (the file of a split catalog) and rest (the key in it) [SNK2]. A null key has ns _root and stays null."""
    return catalog.withColumn("ns", T.partition_of("key")).withColumn("rest", T.key_in_partition("key"))


def rejoin(parts: DataFrame) -> DataFrame:
    return parts.withColumn("key", T.rejoin_key("ns", "rest")).drop("ns", "rest")


def stale_partitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partitions (locale, ns) of old that new no longer has, once each [SET5]. Null locales never match, so they are stale."""
    return old.select("locale", "ns").distinct().join(new.select("locale", "ns").distinct(), ["locale", "ns"], "left_anti")


def flatten_json(docs: DataFrame, column: str, *keep: str, place: str | None = None, strict: bool = False) -> DataFrame:
    """keep, key, value and, under the name `place` if one is given, the place from 0 in the document of the string leaves of JSON objects, by dotted path; arrays, numbers, booleans and nulls vanish [STR6].

    Each document is read once, by a tokenizer with a stack of paths (functions.json_leaves), so depth has no limit; of a repeated key the last value counts, at the place of the first. Documents that are null or no object give no rows, nor do those
    that are no JSON, unless strict: then they raise. Nothing is shuffled. A document is one value, so it must fit in a task, and so do its leaves.
    """
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    schema = T.struct_of([(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)], "key string, value string, seq long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, document in enumerate(batch.column(0)):
                try:
                    found = json_leaves.leaves(document.as_py()) if document.is_valid else []
                except json_leaves.Malformed:
                    if strict:
                        raise
                    continue
                for start in range(0, len(found), LEAVES):
                    part = found[start : start + LEAVES]
                    owner += [i] * len(part)
                    rows += [(k, v, start + j) for j, (k, v) in enumerate(part)]
                    if len(rows) >= LEAVES:
                        yield _leaf_batch(batch, owner, rows)
                        owner, rows = [], []
            if rows:
                yield _leaf_batch(batch, owner, rows)

    out = docs.select(F.col(column).cast("string").alias("document"), *kept).mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "key", "value", *([F.col("seq").alias(place)] if place else []))


LEAVES = 100_000  # of a batch of rows


def _leaf_batch(batch: pa.RecordBatch, owner: list[int], rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    kept = [batch.column(i).take(pa.array(owner, pa.int64())) for i in range(1, batch.num_columns)]
    names = [*batch.schema.names[1:], "key", "value", "seq"]
    return pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)]], names)


def unflatten_documents(catalog: DataFrame, *by: str) -> DataFrame:
    """One nested JSON document for each group of `by`: by, document [AGG6, SNK1].

    A document is one value, so a group must fit in a task by nature; group by partition (ns) to keep documents small. A leaf that is also a branch
    gives way to the branch, as does a branch to a later leaf.
    """

    def build(key: tuple, table: pa.Table) -> pa.Table:
        root: dict = {}
        for k, v in zip(*(table.sort_by("seq")[c].to_pylist() for c in ("key", "value")), strict=True):
            *path, leaf = k.split(".")
            node = root
            for p in path:
                if not isinstance(node.get(p), dict):
                    node[p] = {}
                node = node[p]
            node[leaf] = v
        return pa.table({**{b: [x.as_py()] for b, x in zip(by, key, strict=True)}, "document": [json.dumps(root, indent=2, ensure_ascii=False) + "\n"]})

    schema = ", ".join(f"{b} {catalog.schema[b].dataType.simpleString()}" for b in by)
    return catalog.select(*by, "key", "value", "seq").groupBy(*by).applyInArrow(build, f"{schema}, document string")


def document_order(catalog: DataFrame, flat: bool = False) -> DataFrame:
    """locale, path, value, place: the entries that a nested document has, place (an array) being their order in it.

    An entry stands in the object of its path, an object where its first entry stands. Of a repeated key the last value counts, at the first place. A leaf that is also a branch gives way to a later entry of the branch, as does a branch to a later leaf,
    each at the other's place; what such a leaf has replaced is gone, whatever comes later. flat: keys are names as they are. All of it is joins on prefixes, so a document of any size meets in no task. `seq` must tie nothing within a locale; rows
    with a null key or value are left out.
    """
    rows = catalog.where("locale IS NOT NULL AND key IS NOT NULL AND value IS NOT NULL").select("locale", "key", "value", "seq", (F.array("key") if flat else F.split("key", r"\.")).alias("path"))
    if flat:
        last = rows.groupBy("locale", "key").agg(F.max_by("value", "seq").alias("value"), F.min("seq").alias("first"))
        return last.select("locale", F.array("key").alias("path"), "value", F.array("first").alias("place"))
    prefixes = F.transform("path", lambda _, i: F.array_join(F.slice("path", 1, i + 1), "."))
    each = rows.select("locale", "key", "seq", F.size("path").alias("n"), F.posexplode(prefixes).alias("d", "prefix"))
    leaves = rows.groupBy("locale", "key").agg(F.max("seq").alias("leaf_at")).select(F.col("locale").alias("of"), F.col("key").alias("prefix"), "leaf_at")
    met = each.join(leaves, (each.locale == leaves.of) & (each.prefix == leaves.prefix), "left").select("locale", "key", "seq", "n", "d", each.prefix, "leaf_at")
    gathered = met.groupBy("locale", "key", "seq", "n").agg(F.array_sort(F.collect_list(F.struct("d", "prefix", F.coalesce("leaf_at", F.lit(-1).cast("long")).alias("leaf_at")))).alias("up"))  # as many as the key has parts
    reset = lambda i: F.coalesce(F.array_max(F.transform(F.slice("up", 1, i), lambda x: x["leaf_at"])), F.lit(-1).cast("long"))  # noqa: E731  when a leaf last took the place of what is above
    timed = saved(gathered.select("locale", "key", "seq", "n", F.transform("up", lambda x, i: F.struct(x["prefix"].alias("prefix"), x["leaf_at"].alias("leaf_at"), reset(i).alias("reset"))).alias("up")))
    events = timed.select("locale", "seq", "n", F.posexplode("up").alias("d", "x"))
    first = events.where("seq > x.reset").groupBy("locale", "x.prefix").agg(F.min("seq").alias("first"), F.max(F.when(F.col("d") + 1 < F.col("n"), F.col("seq"))).alias("branch_at"))
    alive = timed.where((F.element_at("up", -1)["leaf_at"] == F.col("seq")) & (F.element_at("up", -1)["reset"] < F.col("seq")))
    asked = alive.select("locale", "key", "seq", "n", F.posexplode(F.transform("up", lambda x: x["prefix"])).alias("d", "prefix"))
    placed = asked.join(first, ["locale", "prefix"]).groupBy("locale", "key", "seq").agg(F.array_sort(F.collect_list(F.struct("d", "first"))).alias("up"), F.max(F.when(F.col("d") + 1 == F.col("n"), F.col("branch_at"))).alias("branch_at"))
    kept = placed.where(F.col("branch_at").isNull() | (F.col("branch_at") < F.col("seq"))).select("locale", "key", "seq", F.transform("up", lambda x: x["first"]).alias("place"))
    return kept.join(rows, ["locale", "key", "seq"]).select("locale", "path", "value", "place")


def document_lines(entries: DataFrame) -> DataFrame:
    """locale, part, n, value: the lines of each locale's document; parts follow each other, and in a part the rows by n. entries: document_order.

    Rows are range-partitioned by locale and place, and each learns the path after its own: within a partition by a window over it, at its end from a list of the partitions' first rows. So a row by itself can write its leaf, the braces that close after
    it and those that open before the next one, which follow from the common beginning of the two paths.
    """
    spark, key = entries.sparkSession, Window.partitionBy("part").orderBy("n")
    ranged = saved(entries.repartitionByRange("locale", "place").sortWithinPartitions("locale", "place").select("locale", "path", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")))
    ends = ranged.groupBy("part").agg(F.min_by(F.struct("locale", "path"), "n").alias("first"), F.max_by("locale", "n").alias("last")).orderBy("part").collect()  # a row for each partition
    edges = [(x.part, after.first.locale if after else None, after.first.path if after else None, before is None or before.last != x.first.locale) for before, x, after in zip([None, *ends], ends, [*ends[1:], None], strict=False)]
    known = spark.createDataFrame(edges, "part int, after_locale string, after_path array<string>, begins boolean")
    near = F.struct("locale", "path")
    rows = ranged.select("*", F.lead(near).over(key).alias("next"), F.lag("locale").over(key).alias("before")).join(F.broadcast(known), "part")  # as many as partitions
    follows = F.when(F.col("next").isNotNull(), F.col("next")).otherwise(F.struct(F.col("after_locale").alias("locale"), F.col("after_path").alias("path")))
    rows = rows.select("locale", "part", "n", "path", F.col("value").alias("text"), F.when(F.col("before").isNull(), F.col("begins")).otherwise(F.col("before") != F.col("locale")).alias("new"), F.when(follows["locale"] == F.col("locale"), follows["path"]).alias("then"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_lines(*row) for row in zip(*(batch.column(c).to_pylist() for c in range(3, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], ["locale", "part", "n", "value"])

    return rows.mapInArrow(run, "locale string, part int, n long, value string")


def _opened(path: list[str], depth: int) -> list[str]:
    return [f"{'  ' * (i + 1)}{json.dumps(path[i], ensure_ascii=False)}: {{" for i in range(depth, len(path) - 1)]


def _lines(path: list[str], text: str, new: bool, then: list[str] | None) -> str:
    """What an entry writes: new, whether it is the document's first; then, the path after it, None for the last."""
    common, depth = 0, len(path) - 1
    while then is not None and common < min(depth, len(then) - 1) and path[common] == then[common]:
        common += 1
    out = ["{", *_opened(path, 0)] if new else []
    out.append(f"{'  ' * len(path)}{json.dumps(path[-1], ensure_ascii=False)}: {json.dumps(text, ensure_ascii=False)}" + "," * (then is not None and common == depth))
    out += [f"{'  ' * d}}}" + "," * (then is not None and d - 1 == common) for d in range(depth, common, -1)]
    return "\n".join(out + (_opened(then, common) if then is not None else ["}"]))


def flat_documents(catalog: DataFrame, *by: str) -> DataFrame:
    """One flat JSON document for each group of `by`, keys as they are, in seq order; of a repeated key the last value [SNK1, SNK4]. A document is one value, so a group must fit in a task by nature."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        flat = dict(zip(table["key"].to_pylist(), table["value"].to_pylist(), strict=True))
        return pa.table({**{b: [x.as_py()] for b, x in zip(by, key, strict=True)}, "document": [json.dumps(flat, indent=2, ensure_ascii=False) + "\n"]})

    schema = ", ".join(f"{b} {catalog.schema[b].dataType.simpleString()}" for b in by)
    return catalog.select(*by, "key", "value", "seq").groupBy(*by).applyInArrow(build, f"{schema}, document string")


def run_summary(diff: DataFrame) -> DataFrame:
    """One row: translated, cached, locales of a diff [SNK10, AGG2]."""
    status = lambda *names: F.coalesce(F.sum(F.col("status").isin(*names).cast("long")), F.lit(0).cast("long"))
    return diff.agg(status("added", "modified").alias("translated"), status("unchanged").alias("cached"), F.countDistinct("locale").alias("locales"))


def type_declarations(catalog: DataFrame) -> DataFrame:
    """locale, declaration: imports and members of a typed message module, one for each namespace in order [SNK7]."""
    names = F.array_sort(F.collect_set(T.partition_of("key")))
    text = lambda c, before, mid, after: F.array_join(F.transform(c, lambda n: F.concat(F.lit(before), n, F.lit(mid), n, F.lit(after))), "\n")
    n = F.col("names")
    lines = F.concat_ws("\n", text(n, "import ", ' from "./', '.json";'), F.lit("type Messages = {"), text(n, "  ", ": typeof ", ";"), F.lit("};"))
    return catalog.groupBy("locale").agg(names.alias("names")).select("locale", lines.alias("declaration"))


#: What surrounds the members of a typed message module.
MODULE_HEAD, MODULE_END = 'declare module "next-intl" {\n  interface AppConfig {\n    Messages: ', ";\n  }\n}\n"
NO_MESSAGES = "type Messages = Record<string, never>;\n\n"


def module_declarations(catalog: DataFrame, locales: DataFrame, split: bool = True) -> DataFrame:
    """locale, document: the declaration file that types the messages of each locale of `locales` [SNK7]; rows of `catalog` for other locales are left out, null and repeated locales fold.

    split: an import and a member for each namespace, in order, from the locale's folder; a locale without entries has no messages at all. Else one import of the locale's file, whatever it holds.
    """
    wanted = locales.select("locale").where("locale IS NOT NULL").distinct()
    if not split:
        return wanted.select("locale", F.concat(F.lit('import messages from "./'), "locale", F.lit(f'.json";\n\n{MODULE_HEAD}typeof messages{MODULE_END}')).alias("document"))
    spaces = catalog.select("locale", T.partition_of("key").alias("ns")).distinct().groupBy("locale").agg(F.array_sort(F.collect_list("ns")).alias("names"))  # a file's members are one value by nature
    lines = lambda line: F.array_join(F.transform("names", line), "\n")
    imports = lines(lambda n: F.concat(F.lit("import "), n, F.lit(' from "./'), F.col("locale"), F.lit("/"), n, F.lit('.json";')))
    members = lines(lambda n: F.concat(F.lit("  "), n, F.lit(": typeof "), n, F.lit(";")))
    text = F.concat(imports, F.lit("\n\ntype Messages = {\n"), members, F.lit("\n};\n\n"))
    return wanted.join(spaces, "locale", "left").select("locale", F.concat(F.when(F.col("names").isNull(), F.lit(NO_MESSAGES)).otherwise(text), F.lit(f"{MODULE_HEAD}Messages{MODULE_END}")).alias("document"))


def pick_messages(catalog: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Entries whose key is one of the namespaces or lies below one [FLT11]: prefixes are exploded, so the join is an equi-join. Null keys and namespaces match nothing; repeated ones count once."""
    parts = F.split("key", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    wanted = catalog.select("key", F.explode(prefixes).alias("ns")).join(namespaces.select("ns").distinct(), "ns", "left_semi").select("key").distinct()
    return catalog.join(wanted, "key", "left_semi")


def runtime_lookup(sites: DataFrame, catalog: DataFrame) -> DataFrame:
    """sites (id, children, ...) with text: the message of the id, else the children [JN14]. A null id, an unknown one and a null message give the children; keys should stand once in the catalog."""
    return sites.join(catalog.select(F.col("key").alias("id"), F.col("value").alias("_message")), "id", "left").withColumn("text", F.coalesce("_message", "children")).drop("_message")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by an order that ties nothing [AGG11]."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
