"""Validation operators: placeholder bags of source and translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def bag_minus(a: Column, b: Column) -> Column:
    """Elements of array a beyond their number in b, sorted, with multiplicity [SET3]."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    beyond = F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(F.lit(0), count(a, x) - count(b, x))))
    return F.array_sort(F.flatten(beyond))


def placeholder_check(pairs: DataFrame) -> DataFrame:
    """pairs (source, translated, ...) with valid, missing and extra: placeholders compared as bags, row by row, without a shuffle."""
    out = pairs.withColumn("_s", T.placeholders("source")).withColumn("_t", T.placeholders("translated"))
    out = out.withColumn("missing", bag_minus(F.col("_s"), F.col("_t"))).withColumn("extra", bag_minus(F.col("_t"), F.col("_s"))).drop("_s", "_t")
    return out.withColumn("valid", (F.size("missing") == 0) & (F.size("extra") == 0))


def placeholder_diff(pairs: DataFrame, row_id: str) -> DataFrame:
    """row_id, placeholder, missing, extra: one row for each placeholder whose number differs [SET3, AGG8]."""
    each = lambda c, n: pairs.select(row_id, F.explode(T.placeholders(c)).alias("placeholder"), F.lit(n).alias("_n"))
    counts = each("source", 1).union(each("translated", -1)).groupBy(row_id, "placeholder").agg(F.sum("_n").cast("long").alias("_d")).where("_d <> 0")
    zero = F.lit(0).cast("long")
    return counts.select(row_id, "placeholder", F.greatest(zero, F.col("_d")).alias("missing"), F.greatest(zero, -F.col("_d")).alias("extra"))


def batch_validation(pairs: DataFrame, *by: str) -> DataFrame:
    """by, failures, valid: a batch is valid if no translated entry fails; entries without a translation are skipped [AGG18]."""
    checked = placeholder_check(pairs.withColumn("source", F.coalesce("source", F.lit(""))))
    bad = F.coalesce(F.sum((F.col("translated").isNotNull() & ~F.col("valid")).cast("long")), F.lit(0).cast("long"))
    return checked.groupBy(*by).agg(bad.alias("failures")).withColumn("valid", F.col("failures") == 0)
