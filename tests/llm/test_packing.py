import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from msgspark.llm import packing as P
from tokenizers import Tokenizer

from .brute import documents, frame

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, size):
    """Sequences hold their pieces gapless from 0."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_pieces_against_the_tokenizer(spark):
    rows = documents(spark, 60) + [(70, "İstanbul ΑΣ Σ ß ﬁ 'S don't <|endoftext|>x é ́ 1234 漢字かな 　 !!!")]
    t = Tokenizer.from_file(PATH)
    got = P.token_pieces(frame(spark, rows), PATH, longest=300, with_ids=True).collect()
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(i, k, 300 * k, ids[300 * k : 300 * k + 300]) for k in range(-(-len(ids) // 300))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(((r.doc_id, r.piece, r.start, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_pack(spark):
    pieces = P.token_pieces(frame(spark, documents(spark)), PATH)
    rows = P.pack(pieces).collect()
    assert len(rows) == pieces.count()
    counts = np.bincount([r.length for r in rows], minlength=4097)
    assert check(rows, 4096) == P.lower_bound(counts, 4096)
    assert P.pack(pieces.where("false")).collect() == []


def test_groups_exchange(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 40)
    rnd = random.Random(2)
    lengths = [rnd.choice([rnd.randint(1, 400), rnd.randint(300, 1000), 1000]) for _ in range(600)]
    pieces = spark.createDataFrame([(i, n, "a", "b") for i, n in enumerate(lengths)], "doc_id long, length long, gap string, sequence_id string")
    rows = P.pack(pieces, 1000).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    bound = P.lower_bound(np.bincount(lengths, minlength=1001), 1000)
    assert bound <= check(rows, 1000) <= 1.02 * bound + 1


def test_certified_partitions_keep_their_bins(spark, monkeypatch):
    """Bins and bounds of every partition against plain counts; certified ones move nothing but their emptiest bin."""
    monkeypatch.setattr(P, "GROUP", 50)
    rnd = random.Random(8)
    lengths = [rnd.choice([rnd.randint(1, 90), 334, rnd.randint(480, 700)]) for _ in range(700)]
    pieces = spark.createDataFrame([(i, n, "p") for i, n in enumerate(lengths)], "doc_id long, length long, partition_id string")
    rows = P.pack(pieces, 1000).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    total, bound = check(rows, 1000), P.lower_bound(np.bincount(lengths, minlength=1001), 1000)
    assert bound <= total <= 1.03 * bound + 1
    by = defaultdict(list)
    for r in rows:
        by[r.partition_id, r.partition_bins, r.partition_bound].append(r)
    assert len({p for p, *_ in by}) == len(by) > 10
    certified = 0
    for (partition, bins, least), own in by.items():
        settled = defaultdict(int)
        for r in own:
            settled[r.sequence_id] += r.length
        assert least <= bins and len(settled) <= bins
        if bins == least and partition >> 56 == 0:
            certified += 1
            assert len(settled) >= bins - 1
            if len(settled) == bins:
                assert P.lower_bound(np.bincount([r.length for r in own], minlength=1001), 1000) == least
        elif bins > least and partition >> 56 == 0:
            assert all(n == 1000 for n in settled.values())
    assert certified


def test_merges_are_the_tokenizers():
    """Random pieces, single bytes and long repetitions, against the model's own merges."""
    t, m = Tokenizer.from_file(PATH), P.WordTokenizer(PATH).merges
    rnd = random.Random(6)
    words = ["".join(rnd.choice("etaoinshrdlué") for _ in range(rnd.randint(1, 30))) for _ in range(2000)] + list("abé.") + ["a" * n for n in range(1, 90)] + ["....", "!?" * 20]
    raw = [w.encode() for w in words] + [b""]
    ids, counts = m(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist())] == [t.encode(w, add_special_tokens=False).ids for w in words] + [[]]


def test_very_long_and_repetitive_texts(spark):
    rnd = random.Random(9)
    texts = ["x y " * 500_000, "".join(rnd.choice("abc é.") for _ in range(500_000)), "a" * 200_000, None, ""]
    t = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    for r in P.token_pieces(frame(spark, list(enumerate(texts))), PATH, with_ids=True).orderBy("doc_id", "piece").collect():
        assert r.start == len(got[r.doc_id])
        got[r.doc_id] += r.ids
    assert [got[i] for i in range(5)] == [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def best(lengths, size):
    """Fewest bins, by trying all ways."""
    least = len(lengths)

    def go(i, bins):
        nonlocal least
        if len(bins) >= least:
            return
        if i == len(lengths):
            least = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= size:
                go(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return least


def test_bound_never_exceeds_the_optimum():
    rnd = random.Random(4)
    for _ in range(150):
        lengths = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        assert P.lower_bound(np.bincount(lengths, minlength=31), 30) <= best(lengths, 30)
    assert P.lower_bound(np.bincount([16] * 5, minlength=31), 30) == 5


def test_other_tokenizers_encode_whole_texts():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    texts = ["Hello  there, world", None, "", "Tabs\tand\nlines"]
    assert [np.frombuffer(b, "<u4").tolist() for b in P.WordTokenizer(path).encode(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_are_exact():
    """Case, tails, apostrophes, marks and letters outside Latin, and full caches."""
    w, t = P.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(1)
    letters = "aBcéÉßÀøŁıİſςΣжЖ漢ªºǅ́'’0²-!?.,<|"
    for text in [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(400)) for _ in range(5)] + ["THE!! dog's dogs' l'ÉTÉ É. É́."]:
        assert [np.frombuffer(b, "<u4").tolist() for b in w.encode([text])] == [t.encode(text, add_special_tokens=False).ids]
