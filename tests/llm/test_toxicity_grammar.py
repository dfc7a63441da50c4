"""The composed machine against an enumeration of all paths, and features and scores against a plain version."""

import math
import random

import pyarrow as pa
import pytest
from msgspark.llm import toxicity as T

PARTS = (T.negation, T.report, T.aim, T.threat)


def paths(machine, symbols):
    """Every output of a machine with the weight of its heaviest path."""
    front = {(0, ""): 0.0}
    for s in symbols:
        after = {}
        for (state, out), w in front.items():
            for o, to, more in machine.arcs[state].get(s, ()):
                after[to, out + o] = max(w + more, after.get((to, out + o), -1.0))
        front = after
    best = {}
    for (state, out), w in front.items():
        if state in machine.final:
            best[out] = max(w, best.get(out, -1.0))
    return best


def cascade(symbols):
    """All outputs of the four machines one after the other."""
    found = {symbols: 0.0}
    for part in PARTS:
        after = {}
        for s, w in found.items():
            for out, more in paths(part(), s).items():
                after[out] = max(w + more, after.get(out, -1.0))
        found = after
    return found


def test_composition_against_all_paths():
    rnd = random.Random(3)
    whole = T.clauses()
    for _ in range(1500):
        symbols = "".join(rnd.choice("ooooitnrhc") for _ in range(rnd.randint(0, 14)))
        weight, out = whole.best(symbols)
        found = cascade(symbols)
        assert weight == max(found.values()) and found[out] == weight, symbols


@pytest.mark.parametrize(
    ("symbols", "out"),
    [
        ("tooi", "tooa"), ("tci", "tca"), ("ict", "act"), ("iot", "aot"), ("ooi", "ooi"), ("tnoi", "tnoj"), ("nci", "nci"), ("nooooi", "nooooi"), ("ri", "rq"), ("roooooooooooi", "roooooooooooi"),
        ("ictr", "qctr"), ("ir", "ir"), ("ht", "xt"), ("hot", "xot"), ("hoot", "ooot"), ("th", "to"), ("tohoo", "toooo"), ("nht", "nkt"), ("rht", "rut"), ("htcr", "utcr"),
    ],
)
def test_order_distance_and_scope(symbols, out):
    assert T.clauses().best(symbols)[1] == out


def plain_features(reader, text):
    words = [reader.classify(w) for w in (text or "").encode().split()]
    ends = [i for i, (x, _) in enumerate(words) if x.endswith(".")]
    hits = [i for i, (x, _) in enumerate(words) if x[:1] in ("i", "h")]
    spans = []
    for h in hits:
        lo = max([h - T.REACH, 0, *(e + 1 for e in ends if e < h)])
        hi = min([h + T.REACH + 1, len(words), *(e + 1 for e in ends if e >= h)])
        if spans and lo < spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    counts, best, insults = dict.fromkeys("iajqx", 0), 0.0, 0
    for lo, hi in spans:
        symbols = "".join(x for x, _ in words[lo:hi]).replace(".", "")
        found = cascade(symbols)
        out = T.clauses().best(symbols)[1]
        assert found[out] == max(found.values())
        kinds = [o for s, o in zip(symbols, out) if s == "i"]
        for k in "aijq":
            if k in kinds:
                counts[k] += 1
                break
        counts["x"] += "x" in out
        for k, w in zip(kinds, [w for x, w in words[lo:hi] if x[:1] == "i"]):
            if k in "ai":
                best, insults = max(best, w), insults + 1
    if not any(counts.values()):
        return None
    return [math.log1p(counts[k]) for k in "iajqx"] + [best, min(1.0, 20 * insults / len(words))]


def test_features_and_scores_against_a_plain_version():
    g = T.Grammar({"^idio": 5.0, "scum": 2.0}, -3.0, [4.0, 5.0, 0.5, 0.5, 4.0, 0.1, 1.0])
    reader, rnd = T.Transducer(g), random.Random(7)
    bag = ["you", "idiot", "idiots,", "scum.", "not", "said", "kill", "kill", "the", "a", "lights", "and", "-", ",", "Well,", "end.", "never", "Idiot!", "(you)", "they"] + ["word"] * 12
    texts = [" ".join(rnd.choice(bag) for _ in range(rnd.randint(0, 60))) for _ in range(150)] + [None, "", "  ", "...", "idiot", "kill you"]
    want = [plain_features(reader, t) for t in texts]
    assert reader.all_features(pa.array(texts, pa.string())) == want
    for t, f, s in zip(texts, want, reader.scores(pa.array(texts, pa.string()))):
        z = g.bias + sum(w * x for w, x in zip(g.weights, f or [0.0] * 7))
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-12 and s == reader.score(t)


def test_sentences():
    g = T.Grammar({"^idio": 5.0}, -3.0, [4.0, 5.0, 0.5, 0.5, 4.0, 0.0, 0.0])
    r = T.Transducer(g)
    assert r.score("You, idiot!") == r.score("You idiot!") > r.score("An idiot.")
    assert r.score("Kill it before you go.") == r.score("You should kill the lights.") == r.score("you kill") == r.score("")
    assert r.score("I will kill you.") == r.score("We'll kill all you see.") > 0.3
    assert r.score("'You idiot', he said.") < 0.3 and r.score("Nobody here is an idiot.") < 0.3


def test_very_long_texts():
    r = T.Transducer(T.Grammar({"^idio": 5.0}, -3.0, [4.0, 5.0, 0.5, 0.5, 4.0, 0.0, 1.0]))
    assert r.features("idiot " * 300_000)[0] == math.log1p(1)
    assert r.features("word " * 1_000_000 + "idiot")[5:] == [5.0, 20 / 1_000_001]
    assert 0 <= r.score("you kill idiot, " * 50_000) <= 1
