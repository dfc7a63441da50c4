"""Sharding: minimax contiguous partition of ordered atomic groups. Native: DataFrame functions, and driver arithmetic over a bounded grid."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

BUCKET_BITS = 12  # buckets of the group order, for prefix sums in many tasks
CELLS = 32768  # cells of each grid that comes to the driver
CHUNKS = 512  # row chunks a shard, for gapless slots in many tasks


class _Ends:
    """What the driver knows of the groups' cumulative ends: cells with their least and largest end. between(t) bounds the largest end <= t."""

    def __init__(self) -> None:
        self.cells: list[tuple[int, int]] = [(0, 0)]

    def add(self, cells: list[tuple[int, int]], spans: list[tuple[int, int]]) -> None:
        """Put the finer cells that were counted within the spans in place of those that lay there."""
        kept = [c for c in self.cells if not any(lo < c[0] and c[1] <= hi for lo, hi in spans)]
        self.cells = sorted({*kept, *cells})
        self.firsts = [c[0] for c in self.cells]

    def around(self, x: int, y: int) -> tuple[int, int]:
        """The span from x to y, widened to whole cells."""
        first, _ = self.cells[bisect_right(self.firsts, x) - 1]
        return first - 1, max(y, self.cells[bisect_right(self.firsts, y) - 1][1])

    def between(self, t: int) -> tuple[int, int]:
        least, most = self.cells[bisect_right(self.firsts, t) - 1]
        return (most, most) if most <= t else (least, t) if least < most else (least, least)


def _walk(ends: _Ends, capacity: int, shards: int, total: int) -> list[tuple[int, int]]:
    """Lower and upper bounds of the greedy cuts under a capacity."""
    cuts, lo, hi = [], 0, 0
    for _ in range(shards):
        lo, hi = ends.between(min(lo + capacity, total))[0], ends.between(min(hi + capacity, total))[1]
        cuts.append((lo, hi))
    return cuts


def _smallest(ok, lo: int, hi: int) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """groups: key long (its order is the groups' order, unique), bytes long. Returns the last key of each shard but the last, and the smallest capacity. Neither may be null; a key that repeats counts as
    several groups, between which a cut may not lie (its shards then hold more than the capacity), so fold them first.

    Binary search of the smallest capacity with which greedy filling needs at most `shards` shards. The groups' cumulative ends stay distributed: the driver
    gets, for a grid of CELLS cells, each cell's least and largest end, searches with them as bounds, and asks again with a finer grid
    only for the spans in which cuts may lie, until all bounds meet; the result is exact.
    """
    bucket = F.shiftright("key", 64 - BUCKET_BITS)
    within = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ran = cut(groups.withColumn("bucket", bucket).withColumn("run", F.sum("bytes").over(within)))
    sums = sorted((r.bucket, r.n, r.m) for r in ran.groupBy("bucket").agg(F.max("run").alias("n"), F.max("bytes").alias("m")).collect())  # 2 ** BUCKET_BITS at most
    total, largest = sum(n for _, n, _ in sums), max((m for *_, m in sums), default=0)
    if not total:
        discard(ran)
        return [], 0
    base, at = {}, 0
    for b, n, _ in sums:
        base[b], at = at, at + n
    spark = groups.sparkSession
    offsets = spark.createDataFrame(sorted(base.items()), "bucket int, base long")
    placed = cut(ran.join(F.broadcast(offsets), "bucket").select("key", (F.col("run") + F.col("base")).alias("end")))  # offsets: as many as buckets
    ends, spans, width = _Ends(), [(0, total)], 2 * total
    lo, hi = max(largest, -(-total // shards)), -(-total // shards) + largest
    while True:
        width = max(1, min(width // 2, sum(y - x for x, y in spans) // CELLS))
        inside = F.lit(False)
        for x, y in spans:
            inside = inside | ((F.col("end") > x) & (F.col("end") <= y))
        rows = placed.where(inside).groupBy(F.expr(f"end div {width}").alias("cell")).agg(F.min("end").alias("x"), F.max("end").alias("y")).collect()  # about CELLS rows
        ends.add([(r.x, r.y) for r in rows], spans)
        lo = _smallest(lambda c: _walk(ends, c, shards, total)[-1][1] >= total, lo, hi)
        hi = _smallest(lambda c: _walk(ends, c, shards, total)[-1][0] >= total, lo, hi)
        low, high = _walk(ends, lo, shards, total), _walk(ends, hi, shards, total)
        if lo == hi and all(x == y for x, y in low):
            break
        spans = []
        for x, y in sorted(ends.around(x, y) for (x, _), (_, y) in zip(low, high, strict=True)):
            if spans and x <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(y, spans[-1][1]))
            else:
                spans.append((x, y))
    wanted = sorted({x for x, _ in low[:-1] if 0 < x < total})
    keys = sorted(r.key for r in placed.where(F.col("end").isin(wanted)).select("key").collect())  # shards - 1 at most
    discard(ran, placed)
    return keys, lo


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Every document in one of `shards` shards under the law `bytes`: row_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts form an atomic group (keyed by XXH64 and size; a null text counts as empty, size 1), ordered by that hash; the shards are contiguous in this order and the
    largest shard is as small as any such cut makes it. A document's shard follows from its own hash and shards - 1 cut keys, so that no group
    meets in one task, however large. Slots count from 0 without gaps in each shard, by chunks into which rows are salted, equal ones too. Texts of any length are measured and hashed whole, by the JVM. Repeated rows get slots of their own; null row_ids are kept; no rows
    give no rows; other columns are ignored.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(row_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("key"), F.rand().alias("salt")))
    keys, _ = minimax_cuts(rows.groupBy("key").agg(F.sum("size").alias("bytes")), shards)
    shard = F.lit(0)
    for k in keys:
        shard = shard + (F.col("key") > F.lit(k)).cast("int")
    chunk = F.pmod(F.xxhash64("doc_id", "text_crc32", "salt"), F.lit(CHUNKS)).cast("int")
    rows = rows.withColumn("shard", shard).withColumn("chunk", chunk)
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))  # shards * CHUNKS rows at most
    counts = counts.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("base"))
    slot = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "key")) - 1 + F.col("base")
    return rows.join(F.broadcast(counts), ["shard", "chunk"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
