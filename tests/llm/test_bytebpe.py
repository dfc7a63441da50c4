"""Encoding and decoding against the tokenizer library."""

import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from msgspark.llm import bytebpe as B
from msgspark.llm.queries import byte_bpe_ranks

from .brute import documents, frame


@pytest.fixture(scope="module")
def bpe():
    return B.ByteBPE(byte_bpe_ranks())


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_the_pattern_is_the_published_one():
    assert B.PATTERN == public_tokenizers.PATTERN


def test_code_points_of_all_kinds(bpe, library):
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}\t{chr(c)}  " for c in range(start, start + 64) if not 0xD800 <= c < 0xE000) for start in range(0, 0x30000, 64)]
    assert [ids(x) for x in bpe.encode(texts)] == library.encode_ordinary_batch(texts)


def test_one_by_one_and_together(bpe, library):
    rnd = random.Random(2)
    tokens = list(bpe.ranks)
    joined = (b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 10))).decode("utf-8", "ignore") for _ in range(8000))
    pieces = sorted({p for t in joined for p in bpe.split(t)})
    found, first = bpe.merge_all([p.encode() for p in pieces])
    for k, p in enumerate(pieces):
        want = library.encode_ordinary(p)
        assert bpe.merge(p.encode()) == want == found[first[k] : first[k + 1]].tolist()


@pytest.mark.parametrize("seed", range(12))
def test_any_ranks(tmp_path, seed):
    """Ranks in random order, so that merges make pairs that come before others."""
    rnd = random.Random(seed)
    words = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))) for _ in range(60)})
    rnd.shuffle(words)
    ranks = [bytes([b]) for b in range(256)] + words
    if seed % 2:
        ranks = words[:20] + ranks[:256] + words[20:]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" " + str(i).encode() + b"\n" for i, t in enumerate(ranks)))
    own = B.ByteBPE(str(path))
    library = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    pieces = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 40))) for _ in range(1500)})
    found, first = own.merge_all([p.encode() for p in pieces])
    for k, p in enumerate(pieces):
        want = library.encode_ordinary(p)
        assert own.merge(p.encode()) == want, p
        assert found[first[k] : first[k + 1]].tolist() == want, p


def test_very_long_pre_tokens(bpe, library):
    rnd = random.Random(5)
    for text in ("a" * 200_000, " " * 200_000, "".join(rnd.choice("abcdefgh") for _ in range(200_000)), "é" * 50_000):
        assert ids(bpe.encode([text])[0]) == library.encode_ordinary(text)


def test_the_memory_of_words_is_bounded(bpe, library, monkeypatch):
    monkeypatch.setattr(B, "CACHED", 50)
    for k in range(6):
        text = " ".join(f"word{k}x{i}" for i in range(60))
        assert ids(bpe.encode([text])[0]) == library.encode_ordinary(text)
        assert len(bpe.known) <= 400


def test_queue():
    rnd, queue, held = random.Random(1), B.RankQueue(5000), []
    for _ in range(20_000):
        if rnd.random() < 0.5:
            x = (rnd.randrange(5000), rnd.randrange(100))
            queue.push(*x)
            held.append(x)
        elif held:
            assert queue.pop() == min(held)
            held.remove(min(held))
        else:
            assert queue.pop() is None


def test_documents(spark, library):
    rows = documents(spark)
    got = sorted(map(tuple, B.token_report(frame(spark, rows), byte_bpe_ranks()).collect()), key=repr)
    want = []
    for i, t in rows:
        found = library.encode_ordinary(t or "")
        want.append((i, len(found), sha256(np.array(found, "<u4").tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert B.token_report(frame(spark, []), byte_bpe_ranks()).collect() == []


def test_names_and_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 'x' AS ids, 1 AS `a.key`, CAST(X'61FF62' AS STRING) AS text, 2 AS key UNION ALL SELECT 'y', NULL, NULL, 3")
    got = B.decode_documents(B.encode_documents(docs, byte_bpe_ranks(), "a.key"), byte_bpe_ranks(), "a.key")
    assert got.columns == ["a.key", "ids", "decoded"]
    assert sorted([(r[0], bytes(r.decoded)) for r in got.collect()], key=repr) == [(1, "a�b".encode()), (None, b"")]
