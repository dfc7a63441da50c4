"""Phrase collocation mining by hierarchical pair naming: words get names, neighbouring names of frequent phrases become the name of their pair, and a name points to the two it was made from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, named
from .wordtable import buffers, chunks, split_words

SEGMENT = 6_000_000  # bytes of text of one language in a segment, about; a longer text is a segment of its own
HELD = 24_000_000  # bytes of text of all languages that a task holds before it closes its segments
SLOTS = (1 << 26) - 5  # of the bitmap of frequent pairs, 8 MB: a filter before an exact join, whose false passes the join drops
SALTS = 64
#: What parts words, and what ends a piece.
BLANKS, ENDS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPLIT, _END = np.isin(np.arange(256), list(BLANKS + ENDS)), np.isin(np.arange(256), list(ENDS))


def pack(sequence: np.ndarray) -> bytes:
    """A sequence of names, byte planes apart, compressed."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(sequence.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(packed, n * 8, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def word_sequence(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of texts, and the texts as one sequence of word numbers from 1, with a 0 before each piece."""
    spelled, parts = [], []
    for part in chunks(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
        words = split_words(part.column(0), _SPLIT, _FOLD)
        if not len(words):
            continue
        raw, bounds = buffers(part.column(0))
        begin = ~_SPLIT[raw]
        begin[1:] &= _SPLIT[raw[:-1]]
        heads = bounds[:-1][bounds[:-1] < len(raw)]
        begin[heads] = ~_SPLIT[raw[heads]]
        ends = _END[raw]
        ends[heads] = True
        coded = words.array().dictionary_encode()
        spelled.append(coded.dictionary)
        parts.append((coded.indices.to_numpy(), np.cumsum(ends)[begin]))
    if not parts:
        return pa.array([], pa.large_binary()), np.empty(0, np.int64)
    merged, at, out = pa.concat_arrays(spelled).dictionary_encode(), 0, []
    for dictionary, (numbers, pieces) in zip(spelled, parts, strict=True):
        names = merged.indices.slice(at, len(dictionary)).to_numpy().astype(np.int64)[numbers] + 1
        at += len(dictionary)
        gaps = np.ones(len(names), np.int64)
        gaps[1:] = pieces[1:] > pieces[:-1]
        spaced = np.zeros(len(names) + int(gaps.sum()), np.int64)
        spaced[np.arange(len(names)) + np.cumsum(gaps)] = names
        out.append(spaced)
    return merged.dictionary, np.concatenate(out)


def segments(docs: DataFrame) -> DataFrame:
    """segment long, lang, words array<binary>, counts array<long>, n, sequence: a row for each run of texts of one language in a task, which is the unit in which equal words and pairs are folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            sizes.pop(lang)
            words, sequence = word_sequence(pa.concat_arrays(held.pop(lang)))
            if len(words):
                counts = pa.array(np.bincount(sequence)[1:], pa.int64())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), column) for column in (words.cast(pa.binary()), counts)]
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([lang], pa.string()), *lists, pa.array([len(sequence)], pa.int64()), pa.array([pack(sequence)], pa.binary())], ["segment", "lang", "words", "counts", "n", "sequence"])
                made += 1

        for batch in batches:
            for part in chunks(batch, 1):
                for lang in pc.unique(part.column(0)):
                    texts, key = part.column(1).filter(pc.equal(part.column(0), lang)).cast(pa.large_binary()), lang.as_py()
                    held.setdefault(key, []).append(texts)
                    sizes[key] = sizes.get(key, 0) + int(pc.sum(pc.binary_length(texts)).as_py()) + 64 * len(texts)
                    if sizes[key] >= SEGMENT:
                        yield from close(key)
                while sum(sizes.values()) >= HELD:
                    yield from close(max(sizes, key=sizes.__getitem__))
        for key in list(held):
            yield from close(key)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "segment long, lang string, words array<binary>, counts array<long>, n long, sequence binary")


def pairs(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of neighbours that both have names, in order: left, right, count; and where each occurrence of a pair stands and which one it is."""
    at = np.flatnonzero((sequence[:-1] > 0) & (sequence[1:] > 0))
    left, right = sequence[at], sequence[at + 1]
    width = int(sequence.max(initial=0)) + 1
    if width < 1 << 31:
        keys, which, counts = np.unique(left * width + right, return_inverse=True, return_counts=True)
        return keys // width, keys % width, counts, at, which
    known, numbers = np.unique(sequence, return_inverse=True)  # names too large to put two in 64 bits: by their numbers in this segment
    keys, which, counts = np.unique(numbers[at] * len(known) + numbers[at + 1], return_inverse=True, return_counts=True)
    return known[keys // len(known)], known[keys % len(known)], counts, at, which


def slot(left: Column | np.ndarray, right: Column | np.ndarray) -> Column | np.ndarray:
    """The place of a pair in the bitmap; columns and arrays alike, without overflow."""
    return ((left % SLOTS) * 1_000_003 + (right % SLOTS) * 31_337) % SLOTS


def local_pairs(sequences: DataFrame) -> DataFrame:
    """left, right, n: the pairs of each segment, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                left, right, counts, *_ = pairs(unpack(packed.as_py(), n))
                for i in range(0, len(left), 1_000_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 1_000_000], pa.int64()) for c in (left, right, counts)], ["left", "right", "n"])

    return sequences.select("n", "sequence").mapInArrow(run, "left long, right long, n long")


def asked_pairs(sequences: DataFrame, names: DataFrame) -> DataFrame:
    """segment, at, left, right: of the pairs of each segment, by their order, those that may have a name. A bitmap of the named pairs' slots, made by Spark in slices, drops most others."""
    bit = (slot(F.col("left"), F.col("right")) + 1).alias("bit")
    slices = names.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()  # 4 KB each, 8 MB at most
    bits = np.zeros((SLOTS + 5) // 8, np.uint8)
    for r in slices:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bits[(r.slice - 1) * 4096 : (r.slice - 1) * 4096 + len(part)] = part
    shared = sequences.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                left, right, *_ = pairs(unpack(packed.as_py(), n))
                place = slot(left, right)
                at = np.flatnonzero(shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                for i in range(0, len(at), 1_000_000):
                    here = at[i : i + 1_000_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(len(here), segment), here, left[here], right[here])], ["segment", "at", "left", "right"])

    return sequences.select("segment", "n", "sequence").mapInArrow(run, "segment long, at long, left long, right long")


def renamed(sequences: DataFrame, replies: DataFrame, words: bool) -> DataFrame:
    """segment, n, sequence: each word number, or else each pair of neighbours, replaced by its name; 0 where it has none. replies: segment, at (the word's number less 1, or the pair's place in order), name. Segments without names are left out."""

    def run(_: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        at, name = theirs.column("at").to_numpy(), theirs.column("name").to_numpy()
        out: list[tuple[int, int, bytes]] = []
        for segment, n, packed in zip(mine.column("segment").to_pylist(), mine.column("n").to_pylist(), mine.column("sequence"), strict=True):
            if not len(at):
                continue
            now = unpack(packed.as_py(), n)
            if words:
                table = np.zeros(int(now.max()) + 1, np.int64)
                table[at + 1] = name
                after = table[now]
            else:
                left, _, _, places, which = pairs(now)
                table = np.zeros(len(left), np.int64)
                table[at] = name
                after = np.zeros(n, np.int64)
                after[places] = table[which]
            out.append((segment, len(after), pack(after)))
        return pa.table({"segment": pa.array([r[0] for r in out], pa.int64()), "n": pa.array([r[1] for r in out], pa.int64()), "sequence": pa.array([r[2] for r in out], pa.binary())})

    return sequences.select("segment", "n", "sequence").groupBy("segment").cogroup(replies.withColumnRenamed("segment", "of").groupBy("of")).applyInArrow(run, "segment long, n long, sequence binary")


def phrases(docs: DataFrame, least: int = 10, longest: int = 3) -> tuple[list[DataFrame], DataFrame]:
    """The names of levels 1 to `longest`, and lang, n (all word occurrences).

    Level 1: lang, phrase (a word with at least `least` occurrences), f, heads, tails, last, name. Level k adds left and right, the names on level k - 1 of the phrase without its last and without its first word. heads and tails
    hold the frequencies of the phrase's first 1, 2, ... and last 1, 2, ... words, taken over from the two it points to. A phrase below `least` has no name, and so no longer phrase with it is counted.
    """
    first = cut(segments(docs))
    totals = cut(first.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")))
    spelled = first.select("segment", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("segment", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counted = spelled.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    levels = [named(counted.select("lang", F.col("word").cast("string").alias("phrase"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"), F.col("word").cast("string").alias("last"), "word"))]
    replies = spelled.select("segment", "lang", "at", "word").join(levels[0].select("lang", "word", "name"), ["lang", "word"]).select("segment", "at", "name")
    sequences = cut(renamed(first, replies, True))
    discard(first)
    while True:
        found = local_pairs(sequences).groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        l, r = levels[-1].alias("l"), levels[-1].alias("r")
        joined = found.alias("x").join(l, F.col("x.left") == F.col("l.name")).join(r, F.col("x.right") == F.col("r.name"))
        phrase = F.concat_ws(" ", "l.phrase", "r.last").alias("phrase")
        levels.append(named(joined.select("l.lang", phrase, "x.f", F.concat("l.heads", F.array("x.f")).alias("heads"), F.concat("r.tails", F.array("x.f")).alias("tails"), "r.last", "x.left", "x.right")))
        if len(levels) == longest:
            discard(sequences)
            return levels, totals
        replies = asked_pairs(sequences, levels[-1]).join(levels[-1].select("left", "right", "name"), ["left", "right"]).select("segment", "at", "name")
        after = cut(renamed(sequences, replies, False))
        discard(sequences)
        sequences = after


def scored(level: DataFrame, length: int, longer: DataFrame | None, share: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of one level at their lowest-scoring cut, without those that a longer phrase with at least share % of their occurrences holds.

    Only phrases one word longer need a look, through their pointers: a still longer one holds one of these, which occurs at least as often. Products are decimals of 38 digits.
    """
    wide = lambda c: c.cast("decimal(15,0)")
    cuts = [F.struct(F.expr(f"(cast(f AS decimal(15,0)) * cast(f AS decimal(15,0)) * cast(1000000 AS decimal(7,0))) div (cast(heads[{k - 1}] AS decimal(15,0)) * cast(tails[{length - k - 1}] AS decimal(15,0)))").alias("score"), F.lit(k).alias("k"), F.col("heads")[k - 1].alias("l"), F.col("tails")[length - k - 1].alias("r")) for k in range(1, length)]
    rows = level.select("lang", "phrase", F.col("f").alias("a"), "name", F.array_min(F.array(*cuts)).alias("c"))
    if longer is not None:
        over = longer.select(F.explode(F.array("left", "right")).alias("name"), "f").groupBy("name").agg(F.max("f").alias("most"))
        rows = rows.join(over, "name", "left").where(F.col("most").isNull() | (wide(F.col("most")) * 100 < wide(F.col("a")) * share))
    return rows.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` collocations of each language among phrases of 2 to `longest` words with at least `least` occurrences.

    docs: lang and text, other columns are ignored. Null languages count as und, null and empty texts have no words; repeated rows count as often as they occur; words and texts of any length are whole; a phrase never crosses a
    piece's end; no rows, or none frequent, give no rows. Equal scores rank by frequency, then by the phrase's bytes. Each language's best are found by slices of its phrases first, so that no language meets in one task.
    """
    levels, totals = phrases(docs, least, longest)
    rows = [scored(level, k, levels[k] if k < longest else None, share) for k, level in enumerate(levels, 1) if k > 1]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
