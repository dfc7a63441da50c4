"""Rounds of the translation plan: many waves, few Spark jobs."""

import time

from msgspark.plans import translate as P


def refusing_german(entries, locale, context):
    if locale == "de":
        raise ConnectionError(locale)
    return {k: f"{len(context)}:{min(context, default='')}" for k in entries}, 1, 1


def counted(monkeypatch):
    rounds, plain = [], P.run_wave
    monkeypatch.setattr(P, "run_wave", lambda *args: rounds.append(args[1]) or plain(*args))
    return rounds


def entries(spark, n, locales):
    return spark.createDataFrame([(x, f"k{i:03}", "v", i, 0) for x in locales for i in range(n)], "locale string, key string, value string, seq long, rank int")


def test_rounds_do_not_grow_with_the_waves(spark, monkeypatch):
    rounds = counted(monkeypatch)
    options = P.Options(max_entries=2, retries=0, concurrency=2, validate=False, context_limit=6)
    got = P.translate(entries(spark, 120, ["de", "fr"]), refusing_german, options=options).collect()  # 30 waves of each locale
    assert len(rounds) <= 5
    assert {r.key: r.value for r in got if r.locale == "fr"} == {f"k{i:03}": "0:" if i < 4 else "4:k000: 0:" if i < 8 else "6:k000: 0:" for i in range(120)}
    failed = [r for r in got if r.locale == "de"]
    assert len(failed) == 60 and {(r.key, r.error) for r in failed} == {(None, "de")} and {r.batch_id for r in failed} == set(range(60))


class Crowd:
    """Fails if more than two calls of the locale are under way."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, entries, locale, context):
        mine = self.folder / min(entries)
        mine.touch()
        time.sleep(0.05)
        n = len(list(self.folder.iterdir()))
        mine.unlink()
        return {k: str(n) for k in entries}, 1, 1


def test_calls_of_a_round_keep_to_the_concurrency(spark, tmp_path):
    options = P.Options(max_entries=1, retries=0, concurrency=2, validate=False, context_limit=0)
    got = P.translate(entries(spark, 40, ["de"]), Crowd(tmp_path), options=options).collect()
    assert len(got) == 40 and {int(r.value) for r in got} <= {1, 2}
