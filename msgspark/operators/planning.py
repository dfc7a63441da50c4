"""Planning operators: greedy token batches, waves, context of earlier waves, cost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import saved


CHUNK = 65_536  # rows of a group that one task takes


def group_index(df: DataFrame, by: list[str], order: list[str | Column], name: str = "_i") -> DataFrame:
    """df, written, with the place (from 0) of each row in its group of `by` by `order`, which must tie nothing within a group. No group needs to fit in a task.

    Rows are range-partitioned by group and order and ranked in their partition; the partitions' counts by group give the offsets. So there are as many offsets as partitions and groups, and one sort.
    """
    part = "_part"
    ranged = df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id())
    rows = saved(ranged.withColumn("_r", F.row_number().over(Window.partitionBy(part, *by).orderBy(*order)) - 1))
    ahead = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part, *by).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(ahead), F.lit(0).cast("long"))).drop("_n")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (part, *by)]
    joined = rows.alias("l").join(offsets.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._r") + F.col("r._o")).alias(name))


def token_batches(entries: DataFrame, *by: str, target_tokens: int = 2000, max_entries: int = 50, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """entries (by, order, tokens, ...) with batch_id from 0 in each group of `by` [WIN3].

    A new batch begins before an entry if the batch isn't empty and would exceed target_tokens, or holds max_entries. A group is cut into chunks of CHUNK rows in order. A batch holds max_entries at most, so the first batch that begins in a chunk
    begins at one of its first max_entries rows; for each of these a chunk finds how many batches begin in it and where the first one of the next chunk begins. These jumps compose, which is associative, so they are scanned as a tree: FAN neighbours
    become one, round by round, and then each learns where it begins from the one above (entry_points). Nothing that grows with the rows reaches the driver; groups of one chunk need none of this. `order` must tie nothing within a group; null
    tokens count as 0. Give it the columns of the order and the tokens only, so that texts don't move.
    """
    by, columns = list(by), entries.columns
    rows = group_index(entries, by, list(order)).withColumn("_c", F.floor(F.col("_i") / CHUNK))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    taken, several = max_entries, not rows.where(F.col("_c") > 0).isEmpty()

    def nexts(tokens: list[int | None]) -> np.ndarray:
        """For every row where the next batch begins if one begins there."""
        sums = np.concatenate([[0], np.cumsum([t or 0 for t in tokens])])
        here = np.arange(len(tokens))
        return np.clip(np.searchsorted(sums, sums[:-1] + target_tokens, "right") - 1, here + 1, here + taken)

    def jumps(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        after, n = np.append(nexts(table["tokens"].to_pylist()), 0), min(CHUNK, table.num_rows)
        at, begun = np.arange(taken), np.zeros(taken, np.int64)
        while (at < n).any():
            go = at < n
            begun += go
            at = np.where(go, after[np.minimum(at, n)], at)
        return pa.table({**_same(by, key), "_c": [key[-1].as_py()], "to": [(at - n).tolist()], "begun": [begun.tolist()]})

    entry, base = F.lit(0).cast("long").alias("_entry"), F.lit(0).cast("long").alias("_base")
    if several:
        groups = rows.where(F.col("_c") > 0).select(*by).distinct()
        ahead = rows.where((F.col("_c") > 0) & (F.col("_i") % CHUNK < taken)).withColumn("_c", F.col("_c") - 1)
        light = [*by, "_c", "_i", "tokens"]
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
        wide = rows.select(*light).union(ahead.select(*light)).alias("l")
        wide = wide.join(groups.alias("r"), same, "left_semi") if by else wide
        known = entry_points(saved(wide.groupBy(*by, "_c").applyInArrow(jumps, T.struct_of([(c, kinds[c]) for c in by], "_c long, to array<long>, begun array<long>"))), by)
        numbered = rows.alias("l").join(known.alias("r"), [*same, F.col("l._c") == F.col("r._c")], "left").select("l.*", F.coalesce("r._entry", F.lit(0)).cast("long").alias("_entry"), F.coalesce("r._base", F.lit(0)).cast("long").alias("_base"))
    else:
        numbered = rows.select("*", entry, base)

    def number(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        entry, base = table["_entry"][0].as_py(), table["_base"][0].as_py()
        after, begins, at = nexts(table["tokens"].to_pylist()), np.zeros(table.num_rows, np.int64), entry
        while at < table.num_rows:
            begins[at] = 1
            at = int(after[at])
        return table.select(columns).append_column("batch_id", pa.array(base - 1 + np.cumsum(begins)))

    return numbered.groupBy(*by, "_c").applyInArrow(number, T.struct_of([(c, kinds[c]) for c in columns], "batch_id long"))


FAN = 64  # neighbouring chunks that one step of the scan composes


def _same(by: list[str], key: tuple) -> dict[str, pa.Array]:
    return {c: pa.array([k.as_py()], k.type) for c, k in zip(by, key, strict=False)}


def entry_points(jumps: DataFrame, by: list[str]) -> DataFrame:
    """by, _c, _entry, _base: at which row of each chunk the first batch begins, and how many begin in the chunks before it. jumps: by, _c (from 0), to and begun, lists by the row at which a batch may begin.

    An exclusive scan over the composition of jumps. Going up, FAN neighbours are composed to one, until each group is one; going down, each learns its entry from the one above and those to its left. Rounds grow with the logarithm of the longest
    group's chunks; a task holds FAN lists.
    """
    head = [(c, jumps.schema[c].dataType) for c in by]

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_c")
        tos, begins = np.array(table["to"].to_pylist()), np.array(table["begun"].to_pylist())
        to, begun = tos[0], begins[0]
        for t, b in zip(tos[1:], begins[1:], strict=True):
            to, begun = t[to], begun + b[to]
        return pa.table({**_same(by, key), "_c": [key[-1].as_py()], "to": [to.tolist()], "begun": [begun.tolist()]})

    def spread(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("_c")
        entry, base, entries, bases = above["_entry"][0].as_py(), above["_base"][0].as_py(), [], []
        for to, begun in zip(table["to"].to_pylist(), table["begun"].to_pylist(), strict=True):
            entries.append(entry)
            bases.append(base)
            entry, base = to[entry], base + begun[entry]
        return table.select([*by, "_c"]).append_column("_entry", pa.array(entries, pa.int64())).append_column("_base", pa.array(bases, pa.int64()))

    block = F.expr(f"_c div {FAN}").alias("_block")
    levels, most = [jumps], jumps.agg(F.max("_c")).first()[0] or 0
    while most > 0:
        most //= FAN
        composed = levels[-1].groupBy(*by, block).applyInArrow(compose, T.struct_of(head, "_c long, to array<long>, begun array<long>"))
        levels.append(saved(composed))
    known = levels[-1].select(*by, "_c", F.lit(0).cast("long").alias("_entry"), F.lit(0).cast("long").alias("_base"))
    for level in reversed(levels[:-1]):
        right = known.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(by)], F.col("_c").alias("_at"), "_entry", "_base").groupBy(*[f"_of{i}" for i in range(len(by))], "_at")
        known = saved(level.groupBy(*by, block).cogroup(right).applyInArrow(spread, T.struct_of(head, "_c long, _entry long, _base long")))
    return known


def fixed_batches(df: DataFrame, by: list[str], size: int, order: str = "seq") -> DataFrame:
    """df with batch_id: each `size` rows of a group in order [WIN4], over group_index, so that no group has to fit in a task. Rows that tie in `order` are neighbours, in any order."""
    return group_index(df, by, [order]).withColumn("batch_id", F.floor(F.col("_i") / size)).drop("_i")


def wave_of(batch: Column | str, concurrency: int) -> Column:
    """Waves of `concurrency` batches [WIN5]."""
    return F.floor(T.lit_any(batch) / concurrency)


def wave_context(entries: DataFrame, *by: str, limit: int = 15) -> DataFrame:
    """by, wave_id, key, rank: what each wave is shown of earlier waves' keys [JN13, WIN7].

    Keys of the wave's own namespaces come first, both parts in seq order, cut at `limit`; then those without a source value go, so that fewer may be left. Which entries
    an earlier wave can give is a prefix of the group's order; so for each wave only the first `limit` keys overall and the first `limit` of each of its namespaces are candidates. Each is a bounded top-k: Spark keeps `limit` rows of a group in each task
    before it shuffles them (WindowGroupLimit), so no group meets whole. The candidates are joined by equality on namespace, and no range join is made.
    """
    e = entries.select(*by, "wave_id", "key", "value", "seq", T.first_segment("key").alias("ns"))
    top = lambda rows, *groups: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy("wave_id", "seq"))).where(F.col("_n") <= limit)
    first = top(e, *by).select(*by, F.col("wave_id").alias("from_wave"), "key", "value", "seq", F.col("ns").alias("from_ns"))
    own = top(e.where("ns IS NOT NULL"), *by, "ns").select(*by, F.col("wave_id").alias("from_wave"), "key", "value", "seq", F.col("ns").alias("from_ns"))
    waves = e.select(*by, "wave_id").distinct()
    spaces = e.where("ns IS NOT NULL").select(*by, "wave_id", "ns").distinct()
    same = spaces.join(own.withColumnRenamed("from_ns", "ns"), [*by, "ns"]).where("from_wave < wave_id").withColumn("same", F.lit(1)).drop("ns")
    others = waves.join(first, [*by]).where("from_wave < wave_id").join(spaces.withColumnRenamed("ns", "from_ns"), [*by, "wave_id", "from_ns"], "left_anti").withColumn("same", F.lit(0)).drop("from_ns")
    ranked = same.unionByName(others).withColumn("rank", F.row_number().over(Window.partitionBy(*by, "wave_id").orderBy(F.desc("same"), "from_wave", "seq")))
    return ranked.where((F.col("rank") <= limit) & (F.length("value") > 0)).select(*by, "wave_id", "key", F.col("rank").cast("long").alias("rank"))


def cost_estimate(catalog: DataFrame, *by: str, locales: int = 1, batch_size: int = 50, overhead: int = 200) -> DataFrame:
    """by, input_tokens, output_tokens, batches: what a run over whole catalogs takes [AGG5]; give a delta for the cost of a delta."""
    n, tokens = F.count("*"), F.coalesce(F.sum(T.entry_tokens("key", "value")), F.lit(0).cast("long"))
    out = catalog.groupBy(*by).agg(n.alias("_n"), tokens.alias("_t")).withColumn("batches", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_n") / batch_size)))
    return out.select(*by, ((F.col("_t") + overhead * F.col("batches")) * locales).cast("long").alias("input_tokens"), (F.col("_t") * locales).cast("long").alias("output_tokens"), "batches")


def usage_totals(usage: DataFrame, *by: str) -> DataFrame:
    """by, tokens_in, tokens_out, total of usage (tokens_in, tokens_out); missing numbers count as 0 [AGG3]."""
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(c)
    return usage.groupBy(*by).agg(n("tokens_in"), n("tokens_out")).withColumn("total", F.col("tokens_in") + F.col("tokens_out"))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, tokens_in, tokens_out, ...) with usd: by the model's price for a million tokens, null for unknown models [STR20]."""
    out = usage.join(prices.select("model", "usd_in", "usd_out"), "model", "left")
    return out.withColumn("usd", (F.col("tokens_in") * F.col("usd_in") + F.col("tokens_out") * F.col("usd_out")) / 1_000_000).drop("usd_in", "usd_out")
