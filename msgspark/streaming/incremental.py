"""Extension: catalog changes as a stream. Each micro-batch of source entries is diffed against the lock, as in a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def changed_entries(batch: DataFrame, lock: DataFrame) -> DataFrame:
    """The batch's last version of each (locale, key) whose hash the lock lacks."""
    last = batch.groupBy("locale", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    known = lock.select("locale", "key", F.col("hash").alias("_h"))
    return last.join(known, ["locale", "key"], "left").where(~T.source_hash("value").eqNullSafe(F.col("_h"))).drop("_h")


def follow(entries: DataFrame, read_lock: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query over a stream of entries (locale, key, value, seq); handle gets each micro-batch's changed entries and its id, and must be idempotent for an id."""
    return entries.writeStream.foreachBatch(lambda batch, epoch: handle(changed_entries(batch, read_lock()), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
