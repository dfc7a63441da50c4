"""Toxicity: insult, threat, target, negation and report transducers composed into one weighted grammar of clauses; its lexicon and weights are fitted on labelled rows."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .automata import Machine, compose, machine
from .common import beside, cut, unpacked
from .wordtable import chunks, split_words

#: Closed word classes of the transducers other than insults, which are learned.
TARGETS = frozenset("you your yours yourself u they them their he she him her his we us people everyone those these du ihr dich euch dein deine sie vous toi ton ta tu te eux ustedes vosotros usted ti ellos".split())
NEGATIONS = frozenset("not never no nobody without isn't aren't wasn't don't doesn't didn't nicht kein keine nie ohne pas jamais sans nunca sin jamás".split())
REPORTED = frozenset("said says say called calls quote quoted wrote claimed reported according sagte nannte laut zitiert dit appelé selon cité dijo llamó según".split())
THREATS = frozenset("kill hurt destroy burn shoot stab beat punish crush murder attack töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
STEMS = range(3, 7)  # lengths of word beginnings that may be learned, besides whole words
CACHED, LONGEST = 300_000, 48
DENIED, QUOTED, AIMED, GUESSED, THREATENED = 4, 10, 3, 2, 2  # scopes in symbols: of negation, report, a target before, a target after an insult, a target after a threat
REACH = QUOTED + 2  # words on either side of an insult or threat that can matter
FEATURES = ["plain", "aimed", "denied", "reported", "threat", "weight", "share"]
_BOUNDS = re.compile(r"^[^\w]+|[^\w]+$")


def negation() -> Machine:
    """Reads other o, insult i, target t, negation n, report r, threat h, comma c. After a negation, within DENIED symbols and before a comma, insults become denied j, threats denied k."""
    rules = []
    for k in range(DENIED + 1):
        down = str(max(0, k - 1))
        rules += [(str(k), "otr", None, down, 0.0), (str(k), "i", "j" if k else "i", down, 0.0), (str(k), "h", "k" if k else "h", down, 0.0), (str(k), "n", None, str(DENIED), 0.0), (str(k), "c", None, "0", 0.0)]
    return machine(rules, map(str, range(DENIED + 1)))


def report() -> Machine:
    """Insults become quoted q and threats quoted u within QUOTED symbols after a verb or mark of report, or if one follows a comma: '"you idiot", he said'."""
    rules = [("0", "otnc", None, "0", 0.0), ("0", "ijhk", None, "0", 0.0), ("0", "r", None, str(QUOTED), 0.0), ("0", "ij", "q", "v2", 2.0), ("0", "hk", "u", "v2", 2.0)]
    for k in range(1, QUOTED + 1):
        down = str(k - 1)
        rules += [(str(k), "otnc", None, down, 0.0), (str(k), "ij", "q", down, 0.0), (str(k), "hk", "u", down, 0.0), (str(k), "r", None, str(QUOTED), 0.0)]
    for k in range(3):  # guesses: up to two symbols, a comma, up to two symbols, the report
        rules += [(f"v{k}", "c", None, "w2", 0.0), (f"w{k}", "r", None, "0", 0.0)]
        if k:
            rules += [(f"v{k}", "ot", None, f"v{k - 1}", 0.0), (f"v{k}", "ij", "q", f"v{k - 1}", 0.0), (f"v{k}", "hk", "u", f"v{k - 1}", 0.0), (f"w{k}", "ot", None, f"w{k - 1}", 0.0)]
    return machine(rules, map(str, range(QUOTED + 1)))


def aim() -> Machine:
    """Insults become aimed a within AIMED symbols after a target, over commas too ('you, idiot'), or if a target follows within GUESSED symbols ('idiots like you')."""
    rules = [("0", "ojqunrhkci", None, "0", 0.0), ("0", "t", None, f"s{AIMED}", 0.0), ("0", "i", "a", f"g{GUESSED}", 1.0)]
    for k in range(1, AIMED + 1):
        down = f"s{k - 1}" if k > 1 else "0"
        rules += [(f"s{k}", "ojqunrhkc", None, down, 0.0), (f"s{k}", "i", "a", down, 1.0), (f"s{k}", "t", None, f"s{AIMED}", 0.0)]
    for k in range(1, GUESSED + 1):
        rules += [(f"g{k}", "t", None, f"s{AIMED}", 0.0)]
        if k > 1:
            rules += [(f"g{k}", "oc", None, f"g{k - 1}", 0.0), (f"g{k}", "i", "a", f"g{k - 1}", 1.0)]
    return machine(rules, ["0", *(f"s{k}" for k in range(1, AIMED + 1))])


def threat() -> Machine:
    """A threat stays one, as x, if a target follows within THREATENED symbols ('kill you', but not 'kill the lights' or 'you kill'); else it is another word."""
    rules = [("0", "oiajqutnrkc", None, "0", 0.0), ("0", "h", "o", "0", 0.0), ("0", "h", "x", f"p{THREATENED}", 1.0)]
    for k in range(1, THREATENED + 1):
        rules += [(f"p{k}", "t", None, "0", 0.0)]
        if k > 1:
            rules += [(f"p{k}", "o", None, f"p{k - 1}", 0.0)]
    return machine(rules, ["0"])


@lru_cache(maxsize=1)
def clauses() -> Machine:
    """The grammar of clauses: negation, report, aim and threat, composed."""
    return reduce(compose, (negation(), report(), aim(), threat()))


@dataclass
class Grammar:
    """The fitted model: weights of insult stems and words, and of clause features. Small: max_entries lexicon entries at most."""

    lexicon: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    strength: float = 0.0  # of a threat, as an entry's weight is of an insult


def beginnings(word: str) -> list[str]:
    """What of a word can be an entry of the lexicon: '^' and a beginning of it, or the whole word."""
    return [f"^{word[:n]}" for n in STEMS if len(word) >= n] + [word]


class Transducer:
    """Tags words by the lexicon and the closed classes, and reads the clauses around insults and threats by the composed grammar."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar, self.cache, self.read = grammar, {}, {}
        self.machine = clauses()

    def classify(self, chunk: bytes) -> tuple[str, float]:
        """Symbols of a white-space-free chunk: its class, then c for a comma-like or . for a sentence-ending mark at its end; and the weight of an insult."""
        text = chunk.decode()
        mark = "." if text[-1] in ".!?|" else "c" if text[-1] in ",;:" else ""
        word = _BOUNDS.sub("", text).lower()
        if not word:
            return mark, 0.0
        lexicon = self.grammar.lexicon
        weight = max((lexicon[b] for b in beginnings(word) if b in lexicon), default=0.0)
        for kind, ok in (("i", weight > 0), ("h", word in THREATS), ("r", word in REPORTED), ("n", word in NEGATIONS or word.endswith("n't")), ("t", word in TARGETS)):
            if ok:
                return kind + mark, weight
        return "o" + mark, 0.0

    def tag(self, words: list[bytes]) -> list[tuple[str, float]]:
        if len(self.cache) > CACHED:
            self.cache.clear()
        out = []
        for w in words:
            found = self.cache.get(w)
            if found is None:
                found = self.classify(w)
                if len(w) <= LONGEST:
                    self.cache[w] = found
            out.append(found)
        return out

    def clause(self, symbols: str) -> str:
        """What the grammar makes of a clause; plain words always have a path."""
        out = self.read.get(symbols)
        if out is None:
            out = self.machine.best(symbols)[1]
            if len(symbols) <= LONGEST and len(self.read) < CACHED:
                self.read[symbols] = out
        return out

    def of_tags(self, tags: list[tuple[str, float]], of: np.ndarray, ends: np.ndarray, hits: np.ndarray) -> list[float] | None:
        """Features of a text whose words have the tags `of`; ends: words that end a sentence; hits: words that are insults or threats.

        A clause is the words within REACH of insults and threats, in one sentence. Its insults are aimed, plain, denied or reported, whichever of these is the strongest. Only aimed and plain insults, and threats if they have a strength, add to weight and share.
        """
        counts = dict.fromkeys("aijqx", 0)
        best, insults = 0.0, 0
        cut = np.searchsorted(ends, hits)  # of a hit the sentence
        lo = np.maximum(hits - REACH, np.where(cut > 0, ends[cut - 1] + 1 if len(ends) else 0, 0))
        hi = np.minimum(hits + REACH + 1, np.where(cut < len(ends), ends[np.minimum(cut, len(ends) - 1)] + 1 if len(ends) else len(of), len(of)))
        new = np.flatnonzero(np.concatenate([[True], lo[1:] >= hi[:-1]]))
        for a, b in zip(lo[new].tolist(), hi[np.append(new[1:] - 1, len(hits) - 1)].tolist(), strict=True):
            here = [tags[k] for k in of[a:b].tolist()]
            symbols = "".join([x for x, _ in here]).replace(".", "")
            out = self.clause(symbols)
            kept = [o for s, o in zip(symbols, out, strict=True) if s == "i"]
            weights = [w for (x, w) in here if x[:1] == "i"]
            strongest = next((k for k in "aijq" if k in kept), None)
            if strongest:
                counts[strongest] += 1
            counts["x"] += "x" in out
            if self.grammar.strength and "x" in out:
                best, insults = max(best, self.grammar.strength), insults + out.count("x")
            for k, w in zip(kept, weights, strict=True):
                if k in "ai":
                    best, insults = max(best, w), insults + 1
        if not any(counts.values()):
            return None
        return [math.log1p(counts[k]) for k in "iajqx"] + [best, min(1.0, 20.0 * insults / len(of))]

    def all_features(self, texts: pa.Array) -> list[list[float] | None]:
        """Features of every text, None if no clause of it matched anything. Words are tagged once for each distinct one."""
        words = split_words(texts)
        out: list[list[float] | None] = [None] * len(texts)
        if not len(words):
            return out
        kinds = words.array().dictionary_encode()
        tags, of = self.tag(kinds.dictionary.to_pylist()), kinds.indices.to_numpy()
        hit = np.array([x[:1] in ("i", "h") for x, _ in tags])
        end = np.array([x.endswith(".") for x, _ in tags])
        hits, ends = np.flatnonzero(hit[of]), None
        at = np.searchsorted(hits, words.first)
        for d in np.flatnonzero(at[1:] > at[:-1]).tolist():
            a, b = int(words.first[d]), int(words.first[d + 1])
            mine = of[a:b]
            ends = np.flatnonzero(end[mine])
            out[d] = self.of_tags(tags, mine, ends, hits[at[d] : at[d + 1]] - a)
        return out

    def features(self, text: str | None) -> list[float] | None:
        return self.all_features(pa.array([text], pa.string()))[0]

    def scores(self, texts: pa.Array) -> list[float]:
        """1 / (1 + e^-z), z being the bias and the weighted features."""
        out = []
        for found in self.all_features(texts):
            z = self.grammar.bias + (sum(w * x for w, x in zip(self.grammar.weights, found, strict=True)) if found else 0.0)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out

    def score(self, text: str | None) -> float:
        return self.scores(pa.array([text], pa.string()))[0]


def held_out(row_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(row_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def _batches(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)


#: What a unit of each step adds to the weights of FEATURES: plain insults, aimed ones beyond plain ones, threats beyond plain insults, denied ones and reported ones (both downwards), weight, share.
STEPS = np.array([[1, 1, 0, 0, 1, 0, 0], [0, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 1, 0, 0], [0, 0, -1, 0, 0, 0, 0], [0, 0, 0, -1, 0, 0, 0], [0, 0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 0, 1]], float)
PRIOR = np.array([1.0, 0.5, 0.5, 0.5, 0.5, 0.0, 0.0])  # steps where labelled rows say nothing
CERTAINTY = 0.05  # of the prior, in rows


def ordered_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, list[float]]:
    """Bias and clause weights of a logistic regression on n rows of features x and label y, under what a clause means: threats and aimed insults weigh at least as much as plain ones, these at least nothing, and denied and reported ones at most nothing.

    The order is kept by steps that cannot be negative (STEPS), each drawn to PRIOR, so a clause that no labelled row holds keeps its place too. Newton's method on the steps that are free, halved until the loss falls.
    """
    z = np.hstack([np.ones((len(x), 1)), x @ STEPS.T])
    drawn, pull = np.concatenate([[0.0], PRIOR]), np.concatenate([[1e-6], np.full(len(STEPS), CERTAINTY)])
    w = drawn.copy()

    def loss(v: np.ndarray) -> float:
        t = z @ v
        return float(n @ (np.logaddexp(0, t) - y * t) + pull @ (v - drawn) ** 2 / 2)

    now = loss(w)
    for _ in range(200):
        m = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (n * (m - y)) + pull * (w - drawn)
        free = np.concatenate([[True], (w[1:] > 0) | (slope[1:] < 0)])
        bend = (z[:, free] * (n * m * (1 - m))[:, None]).T @ z[:, free] + np.diag(pull[free])
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(bend, slope[free])
        size, was = 1.0, now
        while size > 1e-9:
            after = w - size * step
            after[1:] = np.maximum(after[1:], 0)
            if (then := loss(after)) < now:
                w, now = after, then
                break
            size /= 2
        if was - now < 1e-9 * max(1.0, abs(now)):
            break
    return float(w[0]), (w[1:] @ STEPS).tolist()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", max_labelled: int = 30_000, max_entries: int = 2000, candidates: int = 3000, least_g: float = 22.0, max_alike: int = 8000) -> Grammar:
    """Grammar from at most max_labelled labelled rows that aren't held out (those with the least hashes of their ids); a document's label is the largest of its rows'.

    Candidates are the words and word beginnings whose presence in distinct texts goes with the label most significantly (G >= least_g). Near copies of one toxic text would make all its rare words telling: candidates
    that stand in nearly the same texts (of max_alike toxic ones) as those of several other roots are left out, and so are entries that a shorter one always outweighs. Words of any length count. The clause weights keep the order of what clauses mean (ordered_weights).
    No labelled rows, or no toxic ones, give a grammar without entries that scores low.
    """
    known = labels.select(F.col(row_id).cast("long").alias("_id"), F.col("toxic").alias("_toxic")).where("_id IS NOT NULL AND _toxic IS NOT NULL")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)  # the bound for what is broadcast next
    texts = docs.select(F.col(row_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", F.col("_toxic").cast("int").alias("_toxic"))

    def words_of(t: str) -> set[str]:
        return {w for w in (_BOUNDS.sub("", x).lower() for x in {c.decode() for c in set(t.encode().split())}) if w}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a batch's texts by entry and label."""
        for whole in batches:
            for batch in _batches(whole, 500):
                seen: dict[tuple[str, int], int] = {}
                for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for b in {b for w in words_of(t or "") for b in beginnings(w)}:
                        seen[b, y] = seen.get((b, y), 0) + 1
                keys = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["entry", "toxic", "n"])

    distinct = cut(texts.groupBy("_text").agg(F.max("_toxic").alias("_toxic")))  # max_labelled rows at most
    totals = {r._toxic: r.n for r in distinct.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sum(n for y, n in totals.items() if y > 0), totals.get(0, 0)
    if not pos or not neg:
        return Grammar()
    counted = distinct.mapInArrow(spread, "entry string, toxic int, n long").groupBy("entry").agg(F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(F.col("n"))).alias("q"))
    p, q = F.col("p"), F.col("q")
    expected = (p + q) * pos / (pos + neg)
    g = 2 * (p * F.log(p / expected) + F.when(q > 0, q * F.log(q / (p + q - expected))).otherwise(0.0))
    weight = F.log((p + 0.5) / (pos + 1)) - F.log((q + 0.5) / (neg + 1))
    found = counted.where((p > 2) & (p > expected)).withColumn("g", g).withColumn("weight", weight).where((F.col("g") >= least_g) & (F.col("weight") > 2.5))
    chosen_entries = found.orderBy(F.desc("g"), "entry").limit(candidates).collect()
    entries, support = {r.entry: r.weight for r in chosen_entries}, {r.entry: r.p for r in chosen_entries}
    # A beginning gives way to a longer one that is as frequent in toxic texts and more telling.
    better = {"^" + f.removeprefix("^")[:n] for f in entries for n in STEMS for e in ["^" + f.removeprefix("^")[:n]] if e != f and e in entries and entries[f] > entries[e] + 0.3 and support[f] >= 0.9 * support[e]}
    order = [e for e in entries if e not in better]
    if not order:
        return Grammar()
    at = {e: i for i, e in enumerate(order)}

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _batches(whole, 500):
                rows = [sorted({at[b] for w in words_of(t or "") for b in beginnings(w) if b in at}) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["held"])

    held = sorted(r.held for r in distinct.where("_toxic > 0").orderBy(F.xxhash64("_text")).limit(max_alike).mapInArrow(holds, "held array<int>").collect())
    has = np.zeros((len(order), len(held)), np.float32)
    for i, row in enumerate(held):
        has[row, i] = 1
    both, alone = has @ has.T, has.sum(axis=1)
    alike = both >= 0.6 * (alone[:, None] + alone - both)
    lexicon: dict[str, float] = {}
    for i, e in enumerate(order):  # entries by their significance
        roots = {order[j].removeprefix("^")[:3] for j in np.flatnonzero(alike[i])}
        if len(roots) < 6 and len(lexicon) < max_entries:
            lexicon[e] = entries[e]
    lexicon = {e: w for e, w in lexicon.items() if not any(lexicon.get(b, -1.0) >= w for b in beginnings(e.removeprefix("^")) if b.startswith("^") and len(b) < len(e) + (e[0] != "^"))}  # a longer entry that a shorter one outweighs never decides
    grammar = Grammar(lexicon, strength=float(np.median(list(lexicon.values()))) if lexicon else 0.0)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Transducer(grammar)
        for whole in batches:
            for batch in chunks(whole, 0):
                rows = [x or [0.0] * len(FEATURES) for x in reader.all_features(batch.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    sample = distinct.mapInArrow(matched, "x array<double>, y int").groupBy("x", "y").count().collect()  # max_labelled rows at most
    grammar.bias, grammar.weights = ordered_weights(np.array([r.x for r in sample]), np.array([float(r.y > 0) for r in sample]), np.array([float(r["count"]) for r in sample]))
    return grammar


def scored_rows(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """row (all columns of docs) and value (the score of the text) for every row; see score_documents."""

    def compute() -> Callable[[pa.RecordBatch], Iterator[pa.Array]]:
        reader = Transducer(grammar)
        return lambda whole: (pa.array(reader.scores(batch.column(0)), pa.float64()) for batch in chunks(whole, 0))

    return beside(docs, text, compute, DoubleType())


def score_documents(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """docs with `score` double added (a column of this name is replaced, all others stay whatever their names). Every row is read whole and on its own, so repeated rows score alike; null and empty texts have the bias's score.

    Very long texts are one chunk; memory follows the longest text.
    """
    found = scored_rows(docs.drop("score"), grammar, text)
    return found.select(*unpacked(found, "score"))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Scores depend on the text alone.

    Null and empty texts score the bias alone; repeated rows and ids, null ids (held out as the empty text's crc32 says) and ties score row by row; labels with null columns are ignored; without usable labels all score low; other columns are ignored.
    """
    grammar = fit(docs, labels, text, row_id)
    rows = score_documents(docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text")), grammar)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
