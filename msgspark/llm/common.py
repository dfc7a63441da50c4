"""Shared helpers: table reading, cutting lineage in the cluster's shared folder, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..operators.graph import listed, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and the other letters."""
    return F.translate(c, UPPER, LOWER)


def packed_rows(df: DataFrame, *keys: Column) -> DataFrame:
    """Keys beside a struct `row` of all columns of df: helper columns cannot clash with the caller's names. select("row.*") gives the rows again."""
    return df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row"), *keys)


def beside(docs: DataFrame, column: str, compute: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.Array]]], kind: DataType) -> DataFrame:
    """row (all columns of docs, whatever their names) and value: what a function makes of a column. compute() is called once for each task; its result gets batches of one column and gives the values for each in turn, in one array or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = compute()
        for batch in batches:
            at = 0
            for part in values(batch.select([1])):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), part], ["row", "value"])
                at += len(part)

    packed = packed_rows(docs, F.col("`" + column.replace("`", "``") + "`").alias("value"))
    return packed.mapInArrow(run, StructType([packed.schema["row"], StructField("value", kind)]))


def unpacked(rows: DataFrame, value: str) -> list[Column]:
    """The columns of rows made by beside(), of which the one named `value` is new, or replaces one in its place."""
    names = rows.schema["row"].dataType.fieldNames()
    return [F.col("value").alias(c) if c == value else F.col("row").getField(c).alias(c) for c in (names if value in names else [*names, value])]


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later stages survive the loss of executors and never recompute it."""
    spark = df.sparkSession
    path = listed(f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def named(table: DataFrame) -> DataFrame:
    """The table, written, with a column name that numbers its rows from 1 without gaps: partition by partition, in a partition as they stand."""
    rows = cut(table.withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, sizes = 1, []
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        sizes.append((r.part, before))
        before += r.n
    offsets = rows.sparkSession.createDataFrame(sizes, "part long, before long")
    out = rows.withColumn("part", part).join(F.broadcast(offsets), "part").select(*table.columns, (F.col("before") + within).alias("name"))  # offsets: as many as partitions
    out._cut_path = rows._cut_path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later step reads, and let Spark drop the shuffle files behind them."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars, until nothing changes.

    edges: two columns a, b of one orderable type. Returns node, root for every node that has an edge, root being the
    smallest node of its component. Self loops, nulls and repeated edges are harmless; no edges give an empty result.
    Each round groups by node with map-side minima and joins written tables, so that hubs are split by AQE.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = None
    while True:
        both = now.select("a", "b").union(now.select(b.alias("a"), a.alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.join(least, "a").where("b > a").select(b.alias("a"), F.col("m").alias("b")).distinct())
        small = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        pairs = F.array(F.struct(a.alias("a"), F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))
        after = cut(large.join(small, "a").select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct())
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now, least, large, small)
        now = after
        if seen == state:
            return now.select(a.alias("node"), b.alias("root")).union(now.select(b.alias("node"), b.alias("root")).distinct())
        state = seen
