"""Paid calls: the log, tasks that die, progress while a wave runs."""

import os
import pathlib
import subprocess
import sys
import textwrap
import threading
import time
from collections import Counter

import pytest
from msgspark.operators import graph, planning
from msgspark.plans import calls, keygen
from msgspark.plans import translate as P
from msgspark.plans.calls import CallLog
from pyspark.sql import functions as F


def test_log(spark, tmp_path, monkeypatch):
    log = CallLog(f"file://{tmp_path}")
    asked = []
    ask = lambda: asked.append(1) or ({"k": "v"}, 1, 2)
    assert log.once(("de", 0, {"a": "b"}), ask) == [{"k": "v"}, 1, 2] == log.once(("de", 0, {"a": "b"}), ask)
    assert log.once(("de", 1, {"a": "b"}), ask) and len(asked) == 2
    with pytest.raises(ZeroDivisionError):
        log.once(("x",), lambda: 1 / 0)
    assert log.once(("x",), lambda: 7) == 7
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    log.drop()
    assert not tmp_path.exists()
    monkeypatch.setattr(calls, "shared_folder", lambda spark: "nowhere://x")
    with pytest.raises(ValueError, match="no log"):
        CallLog.of(spark)


KILLED = """
    import os, sys
    from pyspark.sql import SparkSession
    from msgspark.plans import translate as P

    folder = sys.argv[1]
    spark = SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{folder}/shared").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")

    class Counted:
        def __call__(self, entries, locale, context):
            with open(f"{folder}/calls", "a") as f:
                f.write(min(entries) + chr(10))
            return {k: "x" + k for k in entries}, 1, 1

    class Dying(P.Options):
        pass

    def die_once(batches):
        for batch in batches:
            yield batch
        if not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)

    rows = spark.createDataFrame([("de", f"k{i:03}", "v", i, 0) for i in range(60)], "locale string, key string, value string, seq long, rank int")
    options = P.Options(max_entries=5, concurrency=20, validate=False)
    plain = P.run_wave
    P.run_wave = lambda wave, shown, model, fallback, options, log, tasks, answered: plain(wave, shown, model, fallback, options, log, 1, answered).mapInArrow(die_once, P.OUT)
    done = P.translate(rows, Counted(), options=options)
    print("answers", done.where("error IS NULL").count())
"""


def test_a_task_that_dies_after_its_calls_does_not_call_again(tmp_path):
    script = tmp_path / "killed.py"
    script.write_text(textwrap.dedent(KILLED))
    env = os.environ | {"PYTHONPATH": str(pathlib.Path(__file__).parents[1])}
    done = subprocess.run([sys.executable, str(script), str(tmp_path)], capture_output=True, text=True, env=env, timeout=300)
    assert "answers 60" in done.stdout, done.stderr[-2000:]
    assert (tmp_path / "died").exists()
    asked = Counter((tmp_path / "calls").read_text().split())
    assert len(asked) == 12 and set(asked.values()) == {1}


class Flaky:
    """Counts its calls in a file; refuses one batch until a flag is there."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, entries, locale, context):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(min(entries) + "\n")
        if "k07" in entries and not os.path.exists(f"{self.folder}/flag"):
            raise ValueError("not now")
        return {k: f"x{k}" for k in entries}, 1, 1


def test_a_later_run_of_the_same_name_pays_for_what_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([("de", f"k{i:02}", "v", i, 0) for i in range(20)], "locale string, key string, value string, seq long, rank int")
    options = P.Options(max_entries=5, retries=0, concurrency=8, validate=False, run=f"named-{tmp_path.name}-{time.time()}", wait=lambda s: None)
    first = P.translate(rows, Flaky(str(tmp_path)), options=options)
    assert first.where("error IS NOT NULL").count() == 1 and first.where("key IS NOT NULL").count() == 15
    (tmp_path / "flag").touch()
    assert P.translate(rows, Flaky(str(tmp_path)), options=options).where("key IS NOT NULL").count() == 20
    assert Counter((tmp_path / "calls").read_text().split()) == {"k00": 1, "k05": 2, "k10": 1, "k15": 1}


class Keys:
    def __init__(self, folder):
        self.folder = folder

    def __call__(self, strings, known):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(strings[0]["text"] + "\n")
        return {i: f"a.{s['text']}" for i, s in enumerate(strings)}, 1, 1


def test_key_calls_are_paid_once(spark, tmp_path):
    strings = spark.createDataFrame([(f"t{i:02}", i) for i in range(12)], "text string, seq long")
    none = spark.createDataFrame([], "text string, key string, seq long")
    options = P.Options(max_entries=4, run=f"keys-{tmp_path.name}-{time.time()}")
    for _ in range(2):
        got = keygen.generate_keys(strings, none, Keys(str(tmp_path)), options=options)
        assert {(r.text, r.key) for r in got.collect()} == {(f"t{i:02}", f"a.t{i:02}") for i in range(12)}
    assert Counter((tmp_path / "calls").read_text().split()) == {"t00": 1, "t04": 1, "t08": 1}


class Slow:
    """Waits until two calls are under way at once, then longer for later batches."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, entries, locale, context):
        open(f"{self.folder}/{min(entries)}", "w").close()
        for _ in range(400):
            if len(os.listdir(self.folder)) > 1:
                break
            time.sleep(0.05)
        else:
            raise AssertionError("calls wait for each other")
        time.sleep(1.5 * int(min(entries)[1:]))
        return {k: f"x{k}" for k in entries}, 1, 1


def test_progress_comes_while_a_wave_runs(spark, tmp_path):
    rows = spark.createDataFrame([("de", f"k{i}", "v", i, 0) for i in range(4)], "locale string, key string, value string, seq long, rank int")
    seen = []
    done = P.translate(rows, Slow(str(tmp_path)), options=P.Options(max_entries=1, retries=0, concurrency=4, validate=False), on_progress=lambda a, b: seen.append((a, b, threading.current_thread() is threading.main_thread())))
    assert done.where("error IS NULL").count() == 4
    assert seen[-1][:2] == (4, 4) and [a for a, *_ in seen] == sorted({a for a, *_ in seen}) and len(seen) > 1 and not seen[0][2]


def test_wave_context_keeps_bounded_groups(spark):
    rows = spark.range(1000).select(F.lit("de").alias("locale"), F.floor(F.col("id") / 100).alias("wave_id"), F.concat(F.lit("n."), "id").alias("key"), F.lit("v").alias("value"), F.col("id").alias("seq"))
    plan = planning.wave_context(rows, "locale")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_scratch_deletes_what_operators_have_written(spark):
    rows = spark.createDataFrame([("de", f"k{i}", "v", i, 0) for i in range(6)], "locale string, key string, value string, seq long, rank int")
    with graph.scratch(spark) as tables:
        with graph.scratch(spark) as inner:
            graph.saved(rows).count()
        assert len(inner) == 1 and not pathlib.Path(inner[0].removeprefix("file://")).exists()
        assert P.translate(rows, P.StubTranslator()).count() == 6
        assert tables and all(pathlib.Path(t.removeprefix("file://")).exists() for t in tables if "calls-" not in t)
    assert not any(pathlib.Path(t.removeprefix("file://")).exists() for t in tables)
    kept = graph.saved_path(rows)
    assert pathlib.Path(kept.removeprefix("file://")).exists()
