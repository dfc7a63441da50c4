"""Key generation: new texts in batches to a model, with the retries and the fallback of translations, then collisions and path conflicts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keys as K
from ..operators.graph import saved
from ..operators.planning import group_index
from .calls import CallLog
from .translate import Options


class KeyModel(Protocol):
    """A model: a batch's strings (as dicts of their columns) and some known (text, key) pairs in; keys by place in the batch, input and output tokens out. Called on executors, so it must pickle."""

    def __call__(self, strings: list[dict], known: list[tuple[str, str]]) -> tuple[dict[int, str], int, int]: ...


class StubKeys:
    """gen.k and eight hex digits of the text's SHA-256, 100 tokens in and 50 out for a call."""

    def __call__(self, strings: list[dict], known: list[tuple[str, str]]) -> tuple[dict[int, str], int, int]:
        return {i: "gen.k" + hashlib.sha256(s["text"].encode()).hexdigest()[:8] for i, s in enumerate(strings)}, 100, 50


class KeyGenerationFailed(Exception):
    """A batch failed in all attempts of the model and of the fallback."""


def propose(model: KeyModel, strings: list[dict], known: list[tuple[str, str]], options: Options) -> tuple[dict[int, str], int, int]:
    """Up to retries + 1 calls, after an exception waiting 1, 2, 4 ... s, 30 at most, but not after the last [UDF2, UDF4]. Places outside the batch are ignored; strings without a key stay without."""
    for n in range(options.retries + 1):
        try:
            found, a, b = model(strings, known)
            return {i: k for i, k in found.items() if 0 <= i < len(strings)}, a, b
        except Exception:
            if n == options.retries:
                raise
            options.wait(min(2**n, 30))
    raise AssertionError


def with_fallback(model: KeyModel, fallback: KeyModel | None, strings: list[dict], known: list[tuple[str, str]], options: Options) -> tuple[dict[int, str], int, int]:
    try:
        return propose(model, strings, known, options)
    except Exception:
        if fallback is None:
            raise
        return propose(fallback, strings, known, options)


def _spelled(answer: tuple[dict[int, str], int, int]) -> tuple[dict[str, str], int, int]:
    """With names as JSON has them."""
    return {str(i): k for i, k in answer[0].items()}, answer[1], answer[2]


def generate_keys(
    strings: DataFrame, mapping: DataFrame, model: KeyModel, fallback: KeyModel | None = None, options: Options | None = None, all_texts: DataFrame | None = None, shown: int = 30, on_usage: Callable[[int, int], None] | None = None, on_progress: Callable[[int, int], None] | None = None
) -> DataFrame:
    """text, key, seq: the map of texts after a run [UDF4]. strings: text, seq and file, component, ... where known; mapping: text, key, seq.

    Entries whose text no longer occurs (in all_texts, else in strings) go. Texts without an entry are taken once each, ordered by file, component (both in alphabetical order) and seq, and asked for in batches of options.max_entries, all side by side on at most options.concurrency tasks; each is shown the first `shown`
    entries. Each answer is written to a log (see calls) before anything else, so a task that is run again, or a run of the same options.run, doesn't repeat a call that was answered. If a batch fails, KeyGenerationFailed: nothing is published. Keys of one part get the namespace of their component or file; then collisions get
    numbers (old keys are never changed by them) and leaves that are branches get 'Label'. on_usage is told the tokens, on_progress the texts asked for and all [UDF7].
    """
    options = options or Options()
    active = K.active_entries(mapping, strings if all_texts is None else all_texts).select("text", "key", "seq")
    extra = [c for c in strings.columns if c not in ("text", "seq", "file", "component")]
    get = lambda c: F.col(c) if c in strings.columns else F.lit(None).cast("string")
    fresh = K.new_strings(strings.select("text", "seq", get("file").alias("file"), get("component").alias("component"), *extra), active)
    ordered = fresh.withColumn("_file", F.coalesce("file", F.lit(""))).withColumn("_component", F.coalesce("component", F.lit("")))
    rows = group_index(ordered, [], [K.alphabetical("_file"), K.alphabetical("_component"), "seq", "text"], "_place").drop("_file", "_component")
    known = [(r.text, r.key) for r in active.orderBy("seq", "text").limit(shown).collect()]
    names = [c for c in rows.columns if c not in ("_place", "_batch")]
    log = CallLog.of(strings.sparkSession, options.run)

    def call(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        try:
            strings = table.select(names).to_pylist()
            found, a, b = log.once((key[0].as_py(), strings, known), lambda: _spelled(with_fallback(model, fallback, strings, known, options)))
            found = {int(i): k for i, k in found.items()}
            error = None
        except Exception as e:
            found, a, b, error = {}, 0, 0, str(e) or type(e).__name__
        n = table.num_rows
        columns = {"text": table["text"], "_place": table["_place"], "seq": table["seq"], "file": table["file"], "component": table["component"]}
        answers = {"key": pa.array([found.get(i) for i in range(n)], pa.string()), "tokens_in": pa.array([a] + [0] * (n - 1), pa.int64()), "tokens_out": pa.array([b] + [0] * (n - 1), pa.int64()), "error": pa.array([error] * n, pa.string())}
        return pa.table(columns | answers)

    batches = rows.withColumn("_batch", F.floor(F.col("_place") / options.max_entries)).repartition(options.concurrency, "_batch")
    done = saved(batches.groupBy("_batch").applyInArrow(call, f"text string, _place long, seq {rows.schema['seq'].dataType.simpleString()}, file string, component string, key string, tokens_in long, tokens_out long, error string"))
    if not options.run:
        log.drop()  # no other run can find it
    used_in, used_out, failed, n = done.agg(F.sum("tokens_in"), F.sum("tokens_out"), F.min("error"), F.count("*")).first()
    if failed is not None:
        raise KeyGenerationFailed(failed)
    if on_progress:
        on_progress(n, n)
    if on_usage and (used_in or used_out):
        on_usage(used_in, used_out)
    route = T.route_path("file")
    asked = done.where("key IS NOT NULL").withColumn("key", T.auto_prefix("key", T.infer_namespace("component", route, F.coalesce("file", F.lit("")))))
    settled = K.resolve_collisions(asked.select("text", "key", F.col("_place").alias("seq"), F.col("seq").alias("first")), active)
    late = 1 << 61  # new entries come after all old ones
    both = active.select("text", "key", "seq", F.col("seq").alias("first")).unionByName(settled.select("text", F.col("final_key").alias("key"), (F.col("seq") + late).alias("seq"), "first"))
    return K.rename_conflicts(saved(both)).select("text", F.col("final_key").alias("key"), F.col("first").alias("seq"))
