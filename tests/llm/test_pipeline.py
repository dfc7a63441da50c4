from itertools import combinations

import corpus_pipeline as C
import public_tokenizers
from msgspark.llm import secrets, simhash, toxicity
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from .brute import contamination, unite

SF = "/root/testdata/sf0.001"


def masked(text):
    out, end = [], 0
    for _, s, e in secrets.spans_of(text):
        if s >= end:
            out += [text[end:s], "[SECRET]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def test_run_against_a_plain_version(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    reader = toxicity.Transducer(toxicity.fit(docs, labels))
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if reader.score(r.text) < C.THRESHOLD)
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    root = unite(list(prints), [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    rows = [(i, t) for i, t in rows if root[i] == i]
    bad = contamination(rows, [(r.item_id, r.text) for r in bench.collect()])
    rows = [(i, masked(t)) for (i, t), b in zip(rows, bad) if not b[-1]]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = sorted((i, k, min(4096, n - 4096 * k)) for i, t in rows for n in [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1] for k in range(-(-n // 4096)))
    got = C.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == want
    assert len({r.sequence_id for r in got}) == -(-sum(n for *_, n in want) // 4096)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert C.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated and empty rows, a very long text, and columns whose names the stages use themselves."""
    names = "score, id, hash, first, again, row, _id, _hash, print, spans"
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n.strip()}` string" for n in names.split(","))
    own = tuple(f"own {n.strip()}" for n in names.split(","))
    rows = [(1, "plain words stay here", "en", "a", *own), (1, "plain words stay here", "en", "a", *own), (2, None, None, None, *own), (None, "a null id", "en", None, *own), (3, "", "en", "a", *own), (4, "long tail " * 100_000, "en", "a", *own), (5, "token = abcdefgh123", "en", "a", *[None] * 10)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        found = got.collect()
        assert all(tuple(r)[4:] in (own, (None,) * 10) for r in found), name
        assert len(found) == (5 if name == "simhash_dedup" else 7), name
    assert {r.text for r in C.secrets_stage(spark, docs, SF).collect() if r.doc_id == 5} == {"[SECRET]"}
    assert C.packing_stage(spark, docs, SF).select("doc_id").distinct().count() == 6


def test_stages_with_names_that_need_quotes(spark):
    names = ["meta.lang", "row", "a b", "b`t", "n_chars"]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *[StructField(n, StringType()) for n in names[:-1]], StructField("in", StructType([StructField("x.y", StringType())])), StructField("n_chars", LongType())])
    own = ("m", "r", "s", "t", ("z",))
    docs = spark.createDataFrame([(i, f"some words of row {i} token = abcdefgh{i}", *own, 5) for i in range(6)] + [(6, None, *[None] * 5, None)], schema)
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        found = got.collect()
        assert len(found) == 7 and all(tuple(r)[2:7] in (own, (None,) * 5) for r in found if r.text), name
    assert C.packing_stage(spark, docs, SF).select("doc_id").distinct().count() == 7
