import zlib

import numpy as np

from msgspark.llm import toxicity as T

from .brute import documents, frame


def tables(spark, sf="sf0.1"):
    return [spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(spark):
    """About a twentieth of the toxic rows of this table are junk without any toxic word left, and its foreign roots occur in clean rows too."""
    docs, labels = tables(spark)
    got = T.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hit, miss, false = (sum(1 for r in got if (r.predicted, r.toxic) == x) for x in ((1, 1), (0, 1), (1, 0)))
    assert hit / (hit + miss) > 0.85 and hit / (hit + false) > 0.93
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.94


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs, labels = tables(spark, "sf0.01")
    docs, labels = docs.limit(300), labels.withColumn("toxic", labels.toxic)
    flipped = labels.withColumn("toxic", T.F.when(T.held_out(T.F.col("doc_id")), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    assert sorted(T.toxicity(docs, labels).collect()) == sorted(T.toxicity(docs.drop("lang", "source"), flipped).collect())


def test_grammar():
    g = T.Grammar({"^idio": 5.0}, -3.0, [4.0, 5.0, 0.5, 0.5, 4.0, 0.0, 0.0])
    r = T.Transducer(g)
    assert r.score("You are an idiot.") > r.score("An idiot passed.") > 0.3
    assert r.score("He is not an idiot.") < 0.3 and r.score("She said idiot again.") < 0.3
    assert r.score("I will kill you.") > 0.3 > r.score("They said: we will kill time.")
    assert r.score("Not now. Idiot!!") > 0.3
    assert r.score("") == r.score(None) == r.score("plain words") < 0.3


def test_every_row_and_odd_cases(spark):
    rows = documents(spark)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows if i is not None] + [(None, 1), (1, None), (1, 0)], "doc_id long, toxic int")
    got = T.toxicity(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    assert T.toxicity(frame(spark, []), labels).collect() == []
    assert all(r.predicted == 0 for r in T.toxicity(frame(spark, rows), labels.where("false")).collect())


def test_fitted_weights_keep_the_order_of_clauses(spark):
    """Whatever the labelled rows hold: threats and aimed insults over plain ones over neutral texts over denied and reported ones."""
    for sf in ("sf0.01", "sf0.1"):
        g = T.fit(*tables(spark, sf))
        r, word = T.Transducer(g), max((e for e in g.lexicon), key=lambda e: g.lexicon[e]).removeprefix("^")
        plain, aimed, denied, reported, threat, neutral = (r.score(t) for t in (f"the {word} went", f"you {word} went", f"this is not {word} here", f"he said {word} again", "I will kill you", "plain words went"))
        assert aimed >= plain > neutral >= denied and neutral >= reported and threat > neutral
        weights = dict(zip(T.FEATURES, g.weights))
        assert weights["aimed"] >= weights["plain"] >= 0 >= weights["denied"] and weights["threat"] >= weights["plain"] and weights["reported"] <= 0


def test_ordered_weights_against_a_grid():
    """The least loss over a fine grid of the two steps that matter."""
    x = np.zeros((4, 7))
    x[1, 0], x[2, 1], x[3, 2] = 1, 1, 1
    x, y, n = np.vstack([x, x]), np.array([0.0] * 4 + [1.0] * 4), np.array([50.0, 10, 10, 3, 5, 20, 15, 30])
    bias, w = T.ordered_weights(x, y, n)

    def loss(b, plain, more, denied):
        z = b + x[:, 0] * plain + x[:, 1] * (plain + more) - x[:, 2] * denied
        return n @ (np.logaddexp(0, z) - y * z) + T.CERTAINTY / 2 * ((plain - 1) ** 2 + (more - 0.5) ** 2 + (denied - 0.5) ** 2) + 5e-7 * b * b

    best = loss(bias, w[0], w[1] - w[0], -w[2])
    assert w[2] == 0  # denied insults are toxic in these rows, but never count for it
    for b in np.linspace(-4, 2, 25):
        for plain in np.linspace(0, 6, 25):
            for more in np.linspace(0, 3, 13):
                for denied in (0, 0.2, 1.0):
                    assert loss(b, plain, more, denied) >= best - 1e-6


def test_long_words_can_be_entries(spark):
    long = "insult" * 8
    docs = spark.createDataFrame([(i, f"row {i} of text" + (f" {long}{'x' * (i % 5)}" if i % 3 == 0 else "")) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    assert any(e.startswith("^ins") for e in T.fit(docs, labels).lexicon)
