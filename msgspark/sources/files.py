"""Sources and sinks: source files by glob, JSON catalogs, locks and maps, split catalogs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import json_leaves
from ..functions import text as T
from ..operators import catalogs
from . import large_json


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ** over folders, * and ? within a name, {a,b} alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            depth += 1
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if depth else ","}.get(c, re.escape(c))
        if c == "}":
            depth -= 1
        i += 1
    return f"^{out}$"


def inventory(files: DataFrame, include: list[str], exclude: list[str] | None = None, path: str = "path") -> DataFrame:
    """files that an include glob matches and no exclude glob does [SRC1]."""
    hit = F.lit(False)
    for g in include:
        hit = hit | F.col(path).rlike(glob_pattern(g))
    for g in exclude or []:
        hit = hit & ~F.col(path).rlike(glob_pattern(g))
    return files.where(hit)


def read_sources(spark: SparkSession, root: str, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """path (relative to root) and content of each source file, read whole by Spark from any store; filters on paths come before contents are used [SRC1]."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("content"))
    base = re.escape(root.rstrip("/").split("://")[-1].lstrip("/"))
    return inventory(files.withColumn("path", F.regexp_replace(F.url_decode("full"), f"^.*?{base}/", "")), include, exclude).select("path", "content")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """One row, column document; no row if the file is missing [SRC3]."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "document string")
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("document"))


def read_entries(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """key, value, seq of the strings of a flat JSON object, in the order of the file; of a repeated key the last value at the first place. Missing files are empty. strict: malformed files, and objects below the top, raise; else malformed files are empty and such objects are left out.

    Files above large_json.WHOLE are read at once, in parts, and no task holds one; smaller ones in one task, when rows are asked for.
    """
    if large_json.is_large(spark, path):
        try:
            return large_json.entries(spark, path, strict)
        except json_leaves.Malformed as e:
            if strict:
                raise json_leaves.Malformed(f"malformed map {path}: {e}") from None
            return spark.createDataFrame([], "key string, value string, seq long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document in batch.column(0).to_pylist():
                try:
                    found = list(json_leaves.entries(document, strict).items())
                except json_leaves.Malformed as e:
                    if strict:
                        raise json_leaves.Malformed(f"malformed map {path}: {e}") from None
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array(range(len(found)), pa.int64())], ["key", "value", "seq"])

    return read_json_document(spark, path).mapInArrow(run, "key string, value string, seq long")


def read_string_map(spark: SparkSession, path: str, strict: bool, key: str = "key", value: str = "hash") -> DataFrame:
    """key, value of a flat JSON object [SRC4, SRC5]: strict for locks, else for maps, as read_entries has it."""
    return read_entries(spark, path, strict).select(F.col("key").alias(key), F.col("value").alias(value))


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Java objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, fs: object, file: object, place: str) -> None:
    """Moves a file, a Java path, to a place, over what is there."""
    to, _ = _hadoop(spark, place)
    fs.mkdirs(to.getParent())
    fs.delete(to, False)
    fs.rename(file, to)
    fs.delete(to.getParent().suffix(f"/.{to.getName()}.crc"), False)


def write_documents(documents: DataFrame, folder: str) -> list[str]:
    """Writes each row (name, document) as the file folder/name with one newline at its end, replacing what is there; returns the names [SNK1].

    Executors write the texts, partitioned by name, to a folder beside; the driver then only moves the files, so it sees names and never a document. A name in two rows raises ValueError before anything is replaced.
    """
    spark = documents.sparkSession
    beside = f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    rows = documents.select("name", F.regexp_replace("document", "\\n$", "").alias("value"))
    several = rows.groupBy("name").count().where("count > 1").first()
    if several:
        raise ValueError(f"{several[0]} has several documents")
    rows.repartition("name").write.partitionBy("name").text(beside)
    top, fs = _hadoop(spark, beside)
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    moves = []
    try:
        for part in fs.listStatus(top):
            if part.isDirectory():
                name = unescape(part.getPath().getName().removeprefix("name="))
                files = [f.getPath() for f in fs.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
                moves.append((name, files[0]))
        for name, file in moves:
            _replace(spark, fs, file, f"{folder.rstrip('/')}/{name}")
    finally:
        fs.delete(top, True)
    return sorted(n for n, _ in moves)


def write_catalogs(catalog: DataFrame, folder: str, flat: bool = False) -> list[str]:
    """One JSON file for each locale, nested (or flat) in the order of catalogs.document_order, two spaces, a newline at the end; returns the names [SNK1].

    No document meets in a task or on the driver: executors write its lines in parts, and the parts' bytes are then streamed into one file, which is moved to its place. Nothing is replaced before all files are whole.
    """
    return _write_lines(catalogs.document_lines(catalogs.document_order(catalog, flat)), folder, ".json")


def _write_lines(lines: DataFrame, folder: str, suffix: str) -> list[str]:
    """The lines of catalogs.document_lines as one file for each locale, of its name and the suffix."""
    spark = lines.sparkSession
    beside = f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    lines.sortWithinPartitions("locale", "part", "n").select("locale", "part", "value").write.partitionBy("locale", "part").text(beside)
    top, fs = _hadoop(spark, beside)
    jvm = spark.sparkContext._jvm
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    whole = []
    try:
        for outer in fs.globStatus(top.suffix("/locale=*")):
            inner = sorted(fs.listStatus(outer.getPath()), key=lambda f: int(f.getPath().getName().removeprefix("part=")))
            parts = [f.getPath() for d in inner for f in sorted(fs.listStatus(d.getPath()), key=lambda f: f.getPath().getName()) if f.getPath().getName().startswith("part-")]
            if len(parts) > 1:
                made, _ = _hadoop(spark, f"{beside}/whole-{len(whole)}")
                out = fs.create(made)
                try:
                    for part in parts:
                        source = fs.open(part)
                        try:
                            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                        finally:
                            source.close()
                finally:
                    out.close()
                parts = [made]
            whole.append((unescape(outer.getPath().getName().removeprefix("locale=")) + suffix, parts[0]))
        for name, made in whole:
            _replace(spark, fs, made, f"{folder.rstrip('/')}/{name}")
    finally:
        fs.delete(top, True)
    return sorted(n for n, _ in whole)


def write_map(mapping: DataFrame, folder: str, name: str = "map.json") -> list[str]:
    """The map text -> key as one flat JSON file in seq order, written as catalogs are [SNK4]; an empty map is {}."""
    rows = mapping.select(F.lit(name).alias("locale"), F.col("text").alias("key"), F.col("key").alias("value"), "seq")
    return _write_lines(catalogs.document_lines(catalogs.document_order(rows, flat=True)), folder, "") or write_documents(mapping.sparkSession.createDataFrame([(name, "{}")], "name string, document string"), folder)


def write_split(catalog: DataFrame, path: str, delete_stale: bool = True) -> list[tuple[str, str]]:
    """A catalog as a table partitioned by locale and ns: partitions that it holds are replaced, and those of its locales that it no longer holds are deleted and returned [SNK2]. Partitions are listed and compared by name; no file is read for that."""
    spark = catalog.sparkSession
    rows = catalogs.split(catalog).select("locale", "ns", "rest", "value", "seq")
    before = partitions(spark, path) if delete_stale else None
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("locale", "ns").parquet(path)
    if before is None:
        return []
    locales = rows.select("locale").distinct()
    stale = [(r.locale, r.ns, r.folder) for r in catalogs.stale_partitions(before.join(locales, "locale", "left_semi"), rows).join(before, ["locale", "ns"]).collect()]
    for *_, folder in stale:
        p, fs = _hadoop(spark, folder)
        fs.delete(p, True)
    return sorted((a, b) for a, b, _ in stale)


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """locale, ns, folder of each partition of a split catalog; none if it is missing."""
    found = []
    if _exists(spark, path):
        top, fs = _hadoop(spark, path)
        unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        for outer in fs.globStatus(top.suffix("/locale=*/ns=*")):
            p = outer.getPath()
            found.append((unescape(p.getParent().getName().removeprefix("locale=")), unescape(p.getName().removeprefix("ns=")), str(p)))
    return spark.createDataFrame(found, "locale string, ns string, folder string")


def write_source_locale(mapping: DataFrame, config: Config, folder: str) -> None:
    """The source locale's messages from the map text -> key: nested, or split by namespace; none in inline mode, where sources hold the texts [SNK6]."""
    if config.mode == "inline":
        return
    first = mapping.groupBy("key").agg(F.min("seq").alias("seq"))
    rows = catalogs.invert_map(mapping).join(first, "key").select(F.lit(config.source_locale).alias("locale"), "key", "value", "seq")
    if config.split_by_namespace:
        write_split(rows, folder)
    else:
        write_catalogs(rows, folder)


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """key, context (JSON) of a file of contexts by key; no rows if it is missing or malformed [SRC6]. Of a repeated key the last context counts."""
    parsed = F.map_entries(F.from_json("document", "map<string,string>", {"mode": "PERMISSIVE"}))
    each = read_json_document(spark, path).select(F.posexplode(parsed).alias("seq", "e"))
    return each.where("e.key IS NOT NULL").groupBy(F.col("e.key").alias("key")).agg(F.max_by("e.value", "seq").alias("context"))


def read_source_catalog(spark: SparkSession, config: Config, folder: str, map_file: str | None = None) -> DataFrame:
    """locale, key, value, seq of the source locale, seq being the place in its file [SRC8]: in inline mode from the map (the last text of a key, at the place of its first), split from partitions, else from the locale's nested JSON file. A file that is there but malformed raises. Large files are read as read_entries reads them."""
    if config.mode == "inline":
        rows = read_entries(spark, map_file or f"{folder}/map.json", strict=False).groupBy(F.col("value").alias("key")).agg(F.max_by("key", "seq").alias("value"), F.min("seq").alias("seq"))
    elif config.split_by_namespace:
        return read_split(spark, folder).where(F.col("locale") == config.source_locale)
    elif large_json.is_large(spark, path := f"{folder}/{config.source_locale}.json"):
        rows = large_json.leaves(spark, path)
    else:
        rows = catalogs.flatten_json(read_json_document(spark, path), "document", place="seq", strict=True)
    return rows.select(F.lit(config.source_locale).alias("locale"), "key", "value", "seq")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """locale, key, value, seq of such a table; no rows if it is missing [SRC7]."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "locale string, key string, value string, seq long")
    return spark.read.parquet(path).select("locale", T.rejoin_key("ns", "rest").alias("key"), "value", "seq")
