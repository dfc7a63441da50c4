"""Benchmark decontamination: winnowed fingerprints of documents and items are joined, and hits extended to whole windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed_rows
from .rolling import grams, leftmost_minima
from .wordtable import SPACES, Words, binary_array, chunks, hash_words, split_words

WINDOW, GRAM = 13, 8  # words of a shared span, and of a fingerprint
BITS = 26  # of the filter of item fingerprints: 8 MB, whatever the number of items
#: Fixed value: the words are runs of 0-9, a-z (A-Z lower-cased) and bytes from 0x80; all else is space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_HIT = pa.struct([("print", pa.int64()), ("window", pa.binary()), ("need", pa.int32()), ("places", pa.list_(pa.int32()))])


def fingerprints(h: np.ndarray, need: int, window: int, gram: int) -> np.ndarray:
    """For every `need` consecutive words the fingerprint that stands for them: of a whole window the k-gram of least hash, of the words of a shorter item the hash of them all."""
    if need == window:
        g = grams(h, gram)
        return g[leftmost_minima(g, window - gram + 1)]
    return grams(h, need) ^ np.uint64(need * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def folded(words: Words, h: np.ndarray, at: np.ndarray, need: int) -> tuple[list[bytes], np.ndarray]:
    """Digests of the distinct ones among the `need` words from each place of `at`, and which of them each place has."""
    place = at[:, None] + np.arange(need)
    used, which = np.unique(place, return_inverse=True)
    which = which.reshape(place.shape)
    sizes = np.diff(words.offsets)[used]
    ends = np.cumsum(sizes)
    data = words.data[np.repeat(words.offsets[used] - (ends - sizes), sizes) + np.arange(ends[-1])]
    kinds = binary_array(data, np.concatenate([[0], ends])).dictionary_encode()
    texts, ids = kinds.dictionary.to_pylist(), kinds.indices.to_numpy()[which]
    _, first, of = np.unique(grams(h, need)[at], return_index=True, return_inverse=True)
    of = of.ravel()
    if not (ids == ids[first[of]]).all():  # different words of one hash
        _, first, of = np.unique(ids, axis=0, return_index=True, return_inverse=True)
        of = of.ravel()
    return [blake2b(b" ".join([texts[i] for i in row]), digest_size=16).digest() for row in ids[first].tolist()], of


def window_hits(texts: pa.Array, needs: list[int], bits: np.ndarray | None, window: int, gram: int) -> tuple[np.ndarray, list[list[dict]]]:
    """Of each text the number of words, and its distinct windows of needs' lengths with their fingerprints and places; only those whose fingerprint is in the bitmap, if there is one."""
    words = split_words(texts, SPACES, FOLD)
    counts, found = np.diff(words.first), [[] for _ in range(len(texts))]
    h = hash_words(words)
    for need in needs:
        prints = fingerprints(h, need, window, gram)
        good = np.ones(len(prints), bool)
        if bits is not None:
            v = prints & np.uint64((1 << BITS) - 1)
            good = (bits[(v >> np.uint64(3)).astype(np.int64)] >> (v & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(good)
        doc = np.searchsorted(words.first, at, "right") - 1
        whole = at + need <= words.first[doc + 1]
        at, doc = at[whole], doc[whole]
        if not len(at):
            continue
        digests, of = folded(words, h, at, need)
        order = np.lexsort((at, of, doc))
        at, doc, of = at[order], doc[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (of[1:] != of[:-1])]))
        for a, b in zip(new.tolist(), np.append(new[1:], len(at)).tolist(), strict=True):
            d = int(doc[a])
            found[d].append({"print": prints[at[a]].astype(np.int64), "window": digests[of[a]], "need": need, "places": at[a:b] - words.first[d]})
    return counts, found


def item_windows(benchmark: DataFrame, window: int, gram: int, text: str, item_id: str) -> DataFrame:
    """item_id, words (digest of all the item's words), print, window, need: a row for each distinct window of an item; items shorter than a window are one of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 1):
                words = split_words(batch.column(1), SPACES, FOLD)
                every = []
                for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    at = words.offsets[i : j + 1]
                    every.append(blake2b((at - at[0]).tobytes() + words.data[at[0] : at[-1]].tobytes(), digest_size=16).digest())
                out: list[list] = [[], [], [], []]
                sizes = np.diff(words.first)
                for need in sorted({min(window, n) for n in sizes.tolist() if n}):
                    pick = np.flatnonzero(np.minimum(sizes, window) == need)
                    _, hits = window_hits(batch.column(1).take(pa.array(pick)), [need], None, window, gram)
                    for i, found in zip(pick.tolist(), hits, strict=True):
                        for hit in found:
                            for col, v in zip(out, (i, hit["print"], hit["window"], need), strict=True):
                                col.append(v)
                owner = pa.array(out[0], pa.int64())
                digest = pa.array(every, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), digest.take(owner), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32())], ["item_id", "words", "print", "window", "need"])

    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id IS NOT NULL")
    return items.mapInArrow(run, "item_id long, words binary, print long, window binary, need int")


@lru_cache(maxsize=2)
def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _filter(items: DataFrame) -> bytes:
    """A bitmap of the items' fingerprints, made by Spark in slices; its size does not depend on the data."""
    bit = (F.col("print").bitwiseAND(F.lit((1 << BITS) - 1)) + 1).alias("bit")
    rows = items.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    whole = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        whole[(r.slice - 1) * 4096 : (r.slice - 1) * 4096 + len(part)] = part
    return zlib.compress(whole.tobytes(), 1)


def decontamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Winnowing keeps the k-gram of least hash of every `window` words on both sides, so equal windows have equal fingerprints. Documents' windows whose fingerprints miss a
    bitmap of fixed size made of the items' are dropped at once (false passes only). The hits left are extended to their whole windows, whose words are digested (128 bits), and both sides meet in an equi-join on fingerprint and
    window: different contexts of one fingerprint never form pairs. A document's equal windows are one row with many places; documents with the same set of windows look up their items once. Spark broadcasts the
    items' side if it is under its limit and else shuffles both sides, with skewed keys split by AQE.
    Null texts have no words; items without words or id match nothing; an item id that occurs in several rows counts once; repeated rows of docs get a row each; other columns are ignored. Texts
    of any length are read whole, in chunks of about wordtable.CHUNK bytes, one longer text being a chunk of its own; a document's places are one array, no longer than its words.
    """
    items = cut(item_windows(benchmark, window, gram, item_text, item_id))
    packed = _filter(items)
    needs = sorted(r.need for r in items.select("need").distinct().collect())  # `window` values at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _unpack(packed)
        for whole in batches:
            for batch in chunks(whole, 2):
                counts, hits = window_hits(batch.column(2), needs, bits, window, gram)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(_HIT))], ["doc_id", "text_hash", "n_words", "hits"])

    rows = docs.select(F.col(row_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rows = cut(rows.mapInArrow(run, f"doc_id {id_type}, text_hash long, n_words long, hits array<struct<print:bigint,window:binary,need:int,places:array<int>>>").withColumn("row", F.monotonically_increasing_id()))
    asked = rows.where("size(hits) > 0").select("row", F.explode("hits").alias("h")).select("row", "h.*")
    met = asked.join(items.select("print", "window").distinct(), ["print", "window"], "left_semi")
    spans = F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("s"), (p + F.col("need")).alias("e"))))))
    by = cut(met.groupBy("row").agg(spans.alias("spans"), F.array_sort(F.collect_set("window")).alias("windows")).withColumn("kind", F.xxhash64("windows")))
    sets = by.select("kind", "windows").distinct()
    of = sets.select("kind", "windows", F.explode("windows").alias("window")).join(items.select("window", "words").distinct(), "window").select("kind", "windows", "words").distinct()
    of = of.join(items.select("words", F.col("item_id").cast("string").alias("item")).distinct(), "words")
    of = of.groupBy("kind", "windows").agg(F.array_sort(F.collect_set("item")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e"))
    union = F.aggregate("spans", start, lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["e"]))).alias("n"), F.greatest(acc["e"], x["e"]).alias("e")))
    by = by.join(of, ["kind", "windows"]).select("row", union["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = rows.drop("hits").join(by, "row", "left")
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id", **parameters: object) -> DataFrame:
    """The rows of docs, with all their columns (whatever their names), that aren't contaminated; null and empty texts stay, repeated rows share their fate."""
    found = decontamination(docs, benchmark, text, row_id, **parameters)
    bad = cut(found.where("contaminated").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct())
    marked = packed_rows(docs, F.col(row_id).alias("id"), F.xxhash64(text).alias("hash"))
    return marked.alias("m").join(bad.alias("b"), F.expr("m.id <=> b.id AND m.hash = b.hash"), "left_anti").select("row.*")
