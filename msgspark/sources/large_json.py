"""JSON files that no task holds: cut at commas by Spark's reader, read in parts, put together by joins."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_chunks
from ..functions.json_leaves import Malformed
from ..functions.jsx import pieces
from ..operators.graph import saved

WHOLE = 4 << 20  # bytes of a file that a task reads whole
ROWS, CHARACTERS = 10_000, 1 << 24  # of a batch that a task returns, or a string of more

_MEMBERS = "chunk int, id long, up int, depth int, parent long, names array<string>, ids array<long>, value string, leaf long, note string"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.string()]
_ROW = (1 << 33) - 1  # what monotonically_increasing_id counts within a partition


def is_large(spark: SparkSession, path: str) -> bool:
    """Whether the file is read in parts: it is larger than WHOLE and not compressed, as compressed files cannot be cut."""
    return length(spark, path) > WHOLE and spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)) is None


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file, 0 if it is missing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getLen() if fs.exists(p) else 0


def _quotes(value: Column) -> Column:
    """json_chunks.quotes in the JVM."""
    plain = F.when(F.contains(value, F.lit("\\")), F.regexp_replace(value, r"(?s)\\.", "")).otherwise(value)
    return F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))


def members(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """id, depth, parent, names, ids, value, leaf of each member of the objects that no array holds: its number, in the order of the file; how many members lead to it, and the number of the last (-1 for none); names and numbers of these and of itself,
    or its own alone if its value, then null, is no string; else which string of its part it is, from 0. And the number of strings of each part, which may count some that arrays hold. Raises Malformed at once.

    Spark cuts the file at all commas. Whether a comma is in a string follows from the quotes before it: their number is counted by block of the file, so that the driver, with a row for each block, can let a part begin at the first comma outside strings
    in each. A task reads a part not knowing which brackets are open at its begin; it says which it closes and leaves open, and the driver, with a row for each part, fits them together.
    """
    at = F.col("_metadata.file_block_start").alias("start")
    cut = saved(spark.read.option("lineSep", ",").text(path).select("value", at, F.monotonically_increasing_id().alias("n")))
    odd = _quotes(F.col("value")) % 2
    blocks = cut.groupBy("start").agg((F.sum(odd) % 2).alias("odd"), F.min(F.when(odd == 1, F.col("n"))).alias("first"), F.max("n").alias("end"), F.sum(F.octet_length("value")).alias("bytes"), F.count("*").alias("segments")).orderBy("start").collect()
    if sum(b.bytes + b.segments for b in blocks) - 1 != length(spark, path):
        raise Malformed("a byte order mark or a comma at the end")  # which Spark's reader drops
    last, inside, dealt = -1, False, []
    for b in blocks:
        head, until = last, -1
        if inside:
            until = b.end if b.first is None else b.first
        if until < b.end:
            last += 1
        dealt.append((b.start, head, until, last))
        inside ^= b.odd == 1
    parts = F.broadcast(spark.createDataFrame(dealt, "start long, head int, until long, body int"))
    placed = cut.join(parts, "start").select(F.when(F.col("n") <= F.col("until"), F.col("head")).otherwise(F.col("body")).alias("chunk"), "start", "n", "value")
    ordered = placed.repartitionById(last + 1, "chunk").sortWithinPartitions("chunk", "start", "n").select("chunk", "value")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
        for piece in pieces(batches):
            yield from zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for number, found in groupby(segments(batches), key=lambda row: row[0]):
            strings = 0
            for x in json_chunks.read(number, number == last, (value for _, value in found)):
                if isinstance(x, dict):
                    rows.append((number, *[None] * 8, json.dumps(x | {"strings": strings})))
                else:
                    rows.append((number, *x, None if x.value is None else strings, None))
                    strings += x.value is not None
                    size += len(x.names[-1]) + len(x.value or "")
                if len(rows) >= ROWS or size >= CHARACTERS:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    parsed = saved(ordered.mapInArrow(run, _MEMBERS))
    notes = parsed.where("note IS NOT NULL").select("chunk", "note").orderBy("chunk").collect()
    summaries = [json.loads(r.note) for r in notes]
    begins = json_chunks.compose(summaries)
    known = []
    for i, levels in enumerate(begins):
        named = [x for x in levels if x.name is not None]
        array = next((d for d, x in enumerate(levels) if x.kind == "["), len(levels))
        known.append((i, len(levels), array, [x.name for x in named], [x.id for x in named]))
    above = F.broadcast(spark.createDataFrame(known, "chunk int, levels int, array int, over array<string>, over_ids array<long>"))
    kept = F.col("levels") - F.col("up")
    inner = parsed.where("note IS NULL").join(above, "chunk").where(F.col("array") >= kept).withColumn("over_n", F.greatest(kept - 1, F.lit(0)))
    whole = lambda over, own: F.when(F.col("value").isNull() | (F.col("over_n") == 0), F.col(own)).otherwise(F.concat(F.slice(over, 1, F.col("over_n")), own)).alias(own)
    parent = F.coalesce("parent", F.get("over_ids", F.col("over_n") - 1), F.lit(-1).cast("long")).alias("parent")
    return inner.select("id", (F.col("over_n") + F.col("depth")).alias("depth"), parent, whole("over", "names"), whole("over_ids", "ids"), "value", "leaf"), [x["strings"] for x in summaries]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], ["chunk", "id", "up", "depth", "parent", "names", "ids", "value", "leaf", "note"])


def _after(rows: DataFrame, part: str, sizes: list[tuple[int, int]], n: str) -> DataFrame:
    """key, value, seq: from key, value, the part (of which sizes has the rows, in order) and the place in it, from 0."""
    before, offsets = 0, []
    for number, size in sizes:
        offsets.append((number, before))
        before += size
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"{part} int, before long"))
    return rows.join(known, part).select("key", "value", (F.col("before") + F.col(n)).alias("seq"))


def _in_order(strings: DataFrame, sizes: list[int]) -> DataFrame:
    """key, value, seq if all strings of all parts are there, once each: as the parts have numbered them. Nothing is shuffled."""
    return _after(strings.withColumn("chunk", F.shiftright("id", 40).cast("int")), "chunk", list(enumerate(sizes)), "leaf")


def numbered(rows: DataFrame) -> DataFrame:
    """key, value, seq: from key, value, place, seq being the place's rank from 0. Rows are sorted by ranges, whose sizes the driver adds up."""
    ranged = saved(rows.repartitionByRange("place").sortWithinPartitions("place").select("key", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("n")))
    return _after(ranged, "part", [(r["part"], r["count"]) for r in ranged.groupBy("part").count().orderBy("part").collect()], "n")


def _told_apart(rows: DataFrame, *by: Column) -> tuple[bool, int]:
    """Whether all rows differ by a digest of `by`, which alone is shuffled; and how many have a value."""
    found = rows.groupBy(F.xxhash64(*by).alias("digest")).agg(F.count("*").alias("times"), F.count("value").alias("strings")).agg(F.max("times"), F.sum("strings")).first()
    return (found[0] or 1) == 1, found[1] or 0


def entries(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """key, value, seq as functions.json_leaves.entries has them; raises Malformed."""
    found, sizes = members(spark, path)
    top = found.where("depth = 0").select(F.get("names", F.lit(0)).alias("key"), "id", "value", "leaf")
    apart, strings = _told_apart(top, F.col("key"))
    if strict and strings < sum(sizes):
        below = found.where("depth > 0 AND value IS NOT NULL").agg(F.min(F.struct("id", F.get("names", F.lit(0)).alias("name"))).alias("x")).first().x
        if below is not None:
            raise Malformed(f"{below.name} is no string")
    if apart and strings == sum(sizes):
        return _in_order(top.where("value IS NOT NULL"), sizes)
    return numbered(top.groupBy("key").agg(F.max(F.struct("id", "value"))["value"].alias("value"), F.min("id").alias("place")).where("value IS NOT NULL"))


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """key, value, seq as functions.json_leaves.leaves has them; raises Malformed."""
    found, sizes = members(spark, path)
    name = F.element_at("names", -1).alias("name")
    key = F.aggregate("names", F.lit(""), lambda k, n: F.when(k == "", n).otherwise(F.concat(k, F.lit("."), n)))
    rows = found.where("value IS NOT NULL").select("id", "names", "ids", key.alias("key"), "value", "leaf")
    once, strings = _told_apart(found, F.col("parent"), name)
    if once and strings == sum(sizes) and _told_apart(rows, F.col("key"))[0]:
        return _in_order(rows, sizes)
    if once:
        rows = rows.withColumn("place", F.array("id"))
    else:  # the last value of a name counts, with all below it, at the place of the first
        repeated = saved(found.groupBy("parent", name).agg(F.count("*").alias("times"), F.min("id").alias("first"), F.max("id").alias("last")).where("times > 1"))
        moved = found.select(F.col("id").alias("step"), "parent", name).join(repeated, ["parent", "name"]).select("step", "first", "last")
        steps = rows.select("id", F.posexplode("ids").alias("d", "step")).join(moved, "step", "left")
        places = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", F.coalesce("first", "step").alias("first")))).alias("up"), F.bool_and(F.coalesce("last", "step") == F.col("step")).alias("kept"))
        rows = rows.join(places.where("kept").select("id", F.transform("up", lambda x: x["first"]).alias("place")), "id")
    return numbered(rows.groupBy("key").agg(F.max(F.struct("place", "value"))["value"].alias("value"), F.min("place").alias("place")))
