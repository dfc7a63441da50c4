"""The translation plan: diff, batches, waves of model calls with retries and a fallback, validation, all-or-nothing publication."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogs, planning
from ..operators.graph import saved, saved_path
from .calls import CallLog


class Translator(Protocol):
    """A model: texts by key, locale and prompt context in; translations by key, input and output tokens out. Called on executors, so it must pickle."""

    def __call__(self, entries: dict[str, str], locale: str, context: list[str]) -> tuple[dict[str, str], int, int]: ...


class StubTranslator:
    """translated_<key> for every key, 100 tokens in and 50 out for a call."""

    def __call__(self, entries: dict[str, str], locale: str, context: list[str]) -> tuple[dict[str, str], int, int]:
        return {k: f"translated_{k}" for k in entries}, 100, 50


class CountingTranslator:
    """The number of earlier translations shown, and the key."""

    def __call__(self, entries: dict[str, str], locale: str, context: list[str]) -> tuple[dict[str, str], int, int]:
        return {k: f"{len(context)}_{k}" for k in entries}, 100, 50


@dataclass(frozen=True)
class Renaming:
    """A prefix and the key, 100 tokens in and 50 out."""

    prefix: str

    def __call__(self, entries: dict[str, str], locale: str, context: list[str]) -> tuple[dict[str, str], int, int]:
        return {k: f"{self.prefix}{k}" for k in entries}, 100, 50


@dataclass(frozen=True)
class Refusing:
    """Refuses one locale; others as the stub."""

    locale: str

    def __call__(self, entries: dict[str, str], locale: str, context: list[str]) -> tuple[dict[str, str], int, int]:
        if locale == self.locale:
            raise ConnectionError(locale)
        return StubTranslator()(entries, locale, context)


@dataclass(frozen=True)
class Options:
    target_tokens: int = 2000
    max_entries: int = 50
    retries: int = 2
    concurrency: int = 3
    validate: bool = True
    context_limit: int = 15
    run: str | None = None  # a name under which a later run finds the answers of one that broke off
    wait: Callable[[float], None] = time.sleep


_PLACEHOLDER = None


def _bag(text: str) -> list[str]:
    import re

    global _PLACEHOLDER
    _PLACEHOLDER = _PLACEHOLDER or re.compile(T.PLACEHOLDER, re.ASCII)
    return sorted(m[0] for m in _PLACEHOLDER.finditer(text))


def attempt(model: Translator, entries: dict[str, str], locale: str, context: list[str], options: Options) -> tuple[dict[str, str], int, int, bool]:
    """Up to retries + 1 calls [UDF2]. An exception, or an answer whose keys aren't the batch's, waits 1, 2, 4 ... s, 30 at most, but not after the last call; a placeholder mismatch tries again at once, and the last answer is taken with valid False. Tokens of all answered calls are summed."""
    used_in = used_out = 0
    for n in range(options.retries + 1):
        try:
            out, a, b = model(entries, locale, context)
            used_in, used_out = used_in + a, used_out + b
            if set(out) != set(entries):
                raise ValueError(f"{len(set(out) ^ set(entries))} keys missing or unasked")
        except Exception:
            if n == options.retries:
                raise
            options.wait(min(2**n, 30))
            continue
        valid = not options.validate or all(_bag(entries[k]) == _bag(out[k]) for k in entries)
        if valid or n == options.retries:
            return out, used_in, used_out, valid
    raise AssertionError


def with_fallback(model: Translator, fallback: Translator | None, entries: dict[str, str], locale: str, context: list[str], options: Options) -> tuple[dict[str, str], int, int, bool]:
    """The fallback has a full budget of its own, after the model has failed by exceptions [UDF3]."""
    try:
        return attempt(model, entries, locale, context, options)
    except Exception:
        if fallback is None:
            raise
        return attempt(fallback, entries, locale, context, options)


OUT = "locale string, key string, value string, batch_id long, tokens_in long, tokens_out long, valid boolean, error string"


def plan_batches(entries: DataFrame, options: Options) -> DataFrame:
    """Entries to translate (locale, key, value, seq, rank) with batch_id and wave_id; added ones first."""
    tokens = entries.withColumn("tokens", T.entry_tokens("key", "value"))
    light = planning.token_batches(tokens.select("locale", "rank", "seq", "key", "tokens"), "locale", target_tokens=options.target_tokens, max_entries=options.max_entries, order=("rank", "seq", "key"))
    joined = entries.join(light.select("locale", "key", "batch_id"), ["locale", "key"])
    return joined.select("locale", "key", "value", "batch_id", planning.wave_of("batch_id", options.concurrency).alias("wave_id"))


def run_wave(wave: DataFrame, context: dict[str, list[tuple[str, str]]], model: Translator, fallback: Translator | None, options: Options, log: CallLog | None = None, tasks: int | None = None, answered: Accumulator | None = None) -> DataFrame:
    """One model call for each (locale, batch_id) of one or more waves; a batch that fails gives one row with error. context: what each locale is shown, keys and translations. log: where answers are looked up before a call and written after it.

    Batches are dealt to options.concurrency lanes a locale, and a lane to one task, which takes its batches in order; so no more calls of a locale are under way at once, however many batches there are. tasks: how many tasks the lanes are dealt to, all side by side; answered: gets the number of entries of each batch when its call is done.
    """
    examples = {locale: [f"{k}: {v}" for k, v in sorted(shown)] for locale, shown in context.items()}

    def call(key: tuple, table: pa.Table) -> pa.Table:
        locale, batch = key[0].as_py(), key[2].as_py()
        table = table.sort_by("key")
        entries = dict(zip(table["key"].to_pylist(), table["value"].to_pylist(), strict=True))
        shown = examples.get(locale, [])
        ask = lambda: with_fallback(model, fallback, entries, locale, shown, options)
        try:
            out, a, b, valid = log.once((locale, batch, entries, shown), ask) if log else ask()
        except Exception as e:
            return pa.table({"locale": [locale], "key": [None], "value": [None], "batch_id": [batch], "tokens_in": [0], "tokens_out": [0], "valid": [False], "error": [str(e)]}).cast(_ARROW)
        if answered is not None:
            answered.add(len(out))
        n = len(out)
        share = lambda total: [total] + [0] * (n - 1)  # noqa: E731  a batch's tokens stand in its first row
        return pa.table({"locale": [locale] * n, "key": list(out), "value": list(out.values()), "batch_id": [batch] * n, "tokens_in": share(a), "tokens_out": share(b), "valid": [valid] * n, "error": [None] * n}).cast(_ARROW)

    laned = wave.withColumn("_lane", F.pmod("batch_id", F.lit(options.concurrency)))
    dealt = laned.repartition(tasks, "locale", "_lane") if tasks else laned  # a stated number of tasks isn't coalesced, so calls don't wait for each other
    return dealt.groupBy("locale", "_lane", "batch_id").applyInArrow(call, OUT)


_ARROW = pa.schema([("locale", pa.string()), ("key", pa.string()), ("value", pa.string()), ("batch_id", pa.int64()), ("tokens_in", pa.int64()), ("tokens_out", pa.int64()), ("valid", pa.bool_()), ("error", pa.string())])


class _Told:
    """Tells on_progress of entries answered, while a wave runs: a thread looks at the accumulator that the batches' tasks add to. A task that is repeated may add twice, so what is told never passes the wave's entries, and the end of a wave is told exactly."""

    def __init__(self, spark: SparkSession, on_progress: Callable[[int, int], None] | None) -> None:
        self.tell, self.answered = on_progress, spark.sparkContext.accumulator(0) if on_progress else None
        self.said = self.before = self.total = 0

    @contextmanager
    def wave(self, size: int) -> Iterator[None]:
        if self.tell is None:
            yield
            return
        start, over = self.answered.value, threading.Event()

        def look() -> None:
            while not over.wait(0.05):
                self.say(self.before + min(self.answered.value - start, size))

        thread = threading.Thread(target=look, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()

    def say(self, n: int) -> None:
        if self.tell is not None and n > self.said:
            self.said = n
            self.tell(n, self.total)


@dataclass
class _Course:
    """How far a locale has come: its waves and batches, the next wave, how many waves the next round takes, what is shown."""

    waves: int
    batches: int
    at: int = 0
    step: int = 1
    shown: tuple[tuple[int, str, str], ...] = ()  # batch_id, key, value, in order

    def settled(self, limit: int) -> bool:
        return len(self.shown) >= limit

    def end(self, limit: int) -> int:
        return self.waves if self.settled(limit) else min(self.waves, self.at + self.step)

    def lanes(self, concurrency: int) -> int:
        """Of the next round."""
        return min(concurrency, self.batches - self.at * concurrency)

    def learn(self, found: list[tuple[int, str, str]], limit: int) -> None:
        """The first keys by batch and name, each as its first batch has it. A round that adds nothing doubles the next one."""
        first: dict[str, tuple[int, str, str]] = {}
        for row in sorted([*self.shown, *found]):
            first.setdefault(row[1], row)
        shown = tuple(sorted(first.values())[:limit])
        self.step, self.shown = 2 * self.step if shown == self.shown else 1, shown


def translate(entries: DataFrame, model: Translator, fallback: Translator | None = None, options: Options | None = None, on_progress: Callable[[int, int], None] | None = None, on_usage: Callable[[int, int], None] | None = None) -> DataFrame:
    """Translations of entries (locale, key, value, seq, rank) [UDF1]: OUT's columns.

    A wave is `concurrency` batches of a locale side by side over the cluster, and is shown up to context_limit earlier translations of its locale: the first ones by batch and key. Once there are as many, no later wave changes them, so all waves that
    are left run as one round, still with at most `concurrency` calls of a locale at once. Until then waves run one after another; where one has added nothing to what is shown (a model that refuses a locale), the next round takes twice as many, all
    shown the same. So rounds don't grow with the waves, but with context_limit and the logarithm of the waves. Each answer is written to a log as soon as it is there, and each round's answers before the next: neither a task that is run again
    nor, under options.run, a run after one that broke off calls the model for what was answered. on_progress is told the entries answered and all after each batch, at the end on_usage the tokens [UDF7].
    """
    options = options or Options()
    spark, limit = entries.sparkSession, options.context_limit
    batches = saved(plan_batches(entries, options))
    sizes = batches.groupBy("locale").agg((F.max("wave_id") + 1).alias("waves"), (F.max("batch_id") + 1).alias("batches"), F.count("*").alias("entries")).collect()  # a row for each locale
    courses = {r.locale: _Course(r.waves, r.batches) for r in sizes}
    log, told = CallLog.of(spark, options.run), _Told(spark, on_progress)
    told.total, done, paths = sum(r.entries for r in sizes), spark.createDataFrame([], OUT), []
    while going := {name: c for name, c in courses.items() if c.at < c.waves}:
        ends = {name: c.end(limit) for name, c in going.items()}
        spans = spark.createDataFrame([(name, c.at, ends[name]) for name, c in going.items()], "_of string, _from long, _to long")
        wave = batches.join(F.broadcast(spans), F.col("locale").eqNullSafe(F.col("_of")) & (F.col("wave_id") >= F.col("_from")) & (F.col("wave_id") < F.col("_to"))).select(batches.columns)  # a row for each locale
        lanes = sum(c.lanes(options.concurrency) for c in going.values())
        context = {name: [(k, v) for _, k, v in c.shown] for name, c in going.items() if name is not None}
        with told.wave(wave.count() if on_progress else 0):
            paths.append(saved_path(run_wave(wave, context, model, fallback, options, log, min(lanes, TASKS), told.answered)))
        done = spark.read.schema(OUT).parquet(*paths)
        latest = spark.read.schema(OUT).parquet(paths[-1]).where("key IS NOT NULL")
        open_ = [name for name, c in going.items() if ends[name] < c.waves and not c.settled(limit)]
        learned = latest.where(F.col("locale").isin(open_)).select("locale", "batch_id", "key", "value")
        first = learned.groupBy("locale", "key").agg(F.min_by(F.struct("batch_id", "key", "value"), "batch_id").alias("x")) if open_ else None
        found = first.withColumn("_n", F.row_number().over(Window.partitionBy("locale").orderBy("x.batch_id", "key"))).where(F.col("_n") <= limit).collect() if open_ else []  # context_limit rows of a locale at most
        for name, c in going.items():
            if name in open_:
                c.learn([tuple(r.x) for r in found if r.locale == name], limit)
            c.at = ends[name]
        if on_progress:
            told.before += latest.count()
            told.say(told.before)
    if not options.run:
        log.drop()  # no other run can find it
    if on_usage:
        used = done.agg(F.sum("tokens_in"), F.sum("tokens_out")).first()
        if used[0] or used[1]:
            on_usage(used[0], used[1])
    return done


TASKS = 10_000  # of a round at most; more lanes than that share tasks


@dataclass(frozen=True)
class Result:
    catalog: DataFrame
    lock: DataFrame
    report: DataFrame
    diff: DataFrame


class CostLimit(Exception):
    """The estimate exceeds the limit."""


def run(source: DataFrame, target: DataFrame, lock: DataFrame, model: Translator, fallback: Translator | None = None, options: Options | None = None, force: bool = False, max_usd: float | None = None, prices: tuple[float, float] | None = None, dry: bool = False, confirm: Callable[[float | None], bool] | None = None, on_progress: Callable[[int, int], None] | None = None, on_usage: Callable[[int, int], None] | None = None) -> Result:
    """Diff, translate what is new or changed, merge and update the lock, for all locales at once [§3.1].

    The lock is keyed by (locale, key) and read once, so a locale's run never hides another's changes. A locale with a failed batch publishes nothing: its catalog and lock
    stay (its removed keys too). force: an empty lock, so all targets are modified. max_usd with prices (USD for a million tokens in and out): CostLimit if the estimate of the
    delta is higher; without prices nothing blocks. confirm is asked with the estimate (None without prices); False ends the run with nothing changed and an empty report [UDF6]. dry: no model call; the report has the counts.
    """
    diff = saved(catalogs.catalog_diff(source, target, lock.where("false") if force else lock))
    todo = catalogs.to_translate(diff)
    if (max_usd is not None or confirm) and not dry and not todo.isEmpty():
        e = planning.cost_estimate(todo).first()
        usd = (e.input_tokens * prices[0] + e.output_tokens * prices[1]) / 1e6 if prices else None
        if usd is not None and max_usd is not None and usd > max_usd:
            raise CostLimit(f"{usd:.4f} > {max_usd}")
        if confirm and not confirm(usd):
            return Result(target, lock, catalogs.diff_counts(diff).where("false"), diff)
    counts = catalogs.diff_counts(diff)
    if dry:
        return Result(target, lock, counts, diff)
    done = saved(translate(todo, model, fallback, options, on_progress, on_usage))
    failed = done.where("error IS NOT NULL").select("locale").distinct()
    good = done.where("error IS NULL").join(failed, "locale", "left_anti")
    kept = diff.where("status = 'unchanged'").join(failed, "locale", "left_anti")
    old = target.join(failed, "locale", "left_semi").select("locale", "key", "value")
    catalog = catalogs.merge(kept, good).unionByName(old)
    new_lock = catalogs.lock_upsert(source.join(failed, "locale", "left_anti"), lock, good).unionByName(lock.join(failed, "locale", "left_semi").select("locale", "key", "hash"))
    used = done.groupBy("locale").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("error").alias("errors"), F.sum((~F.col("valid")).cast("long")).alias("unchecked"))
    report = counts.join(used, "locale", "left").na.fill(0)
    return Result(catalog, new_lock, report, diff)

