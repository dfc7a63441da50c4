"""Substring dedup: compressed FM-index per shard; backward search over a wavelet tree gives matching statistics of streamed stretches of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .rolling import grams, leftmost_minima
from .wordtable import Words, chunks, hash_words, split_words

LENGTH, GRAM = 35, 12  # words of a repeated window, and of the anchor k-grams that route windows to shards
SHARD = 16_384  # stretches of a shard, about
HOT = 64  # distinct stretches of an anchor over which its windows are routed one by one


class Bits:
    """Bits with ranks: a count for every 65,536 bits and a 16-bit one for every 64, so 1.25 bits each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]
        self.far = before[::1024]
        self.near = (before - np.repeat(self.far, 1024)[: len(before)]).astype(np.uint16)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.far[at >> 16] + self.near[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    @property
    def size(self) -> int:
        return 8 * (self.words.nbytes + self.far.nbytes + self.near.nbytes)


class FMIndex:
    """Compressed FM-index of sequences of word ids: the Burrows-Wheeler transform in a wavelet tree shaped by the words' frequencies.

    A word that makes up 1/f of all words has a code of log2(f) bits, rounded up (canonical, the shorter codes first), so the tree takes the transform's entropy of order 0 and a bit a symbol at most, and frequent words take few levels. On
    each level the unfinished symbols stand in order of their codes' beginnings; a node is where one beginning starts, and how many ones stand before it.
    Every number from 0 to the largest symbol must occur. Suffixes are sorted to `depth` symbols, which patterns may not exceed; the suffix array itself is not kept, but one bit for each suffix: whether its sequence is `often` in the input. Sequences are joined by symbol 0.
    """

    def __init__(self, symbols: np.ndarray, depth: int, often: np.ndarray | None = None) -> None:
        n = len(symbols)
        rank, h = symbols.astype(np.int64), 1
        while True:
            ahead = np.zeros(n, np.int64)
            if h < n:
                ahead[:-h] = rank[h:] + 1
            key = rank * (int(ahead.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            h *= 2
            if h >= depth or new[-1] == n - 1:
                break
        self.n = n
        self.often = np.packbits(often[order] if often is not None else np.zeros(n, bool), bitorder="little")
        counts = np.bincount(symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.lengths = np.maximum(1, np.ceil(np.log2(n / np.maximum(counts, 1)))).astype(np.int8)
        self.top = int(self.lengths.max())
        by_length = np.argsort(self.lengths, kind="stable")
        self.codes = np.empty(len(counts), np.int64)  # shifted to `top` bits
        self.codes[by_length] = np.concatenate([[0], np.cumsum(np.int64(1) << (self.top - self.lengths[by_length].astype(np.int64)))[:-1]])
        bwt = symbols[order - 1]
        codes, lengths = self.codes[bwt], self.lengths[bwt]
        self.levels: list[tuple[Bits, int, np.ndarray, np.ndarray]] = []
        for level in range(self.top):
            live = lengths > level
            codes, lengths = codes[live], lengths[live]
            begin = codes >> (self.top - level)
            low = int(begin.min())
            begin -= low
            if level:
                by = np.argsort(begin.astype(np.uint16) if begin.max() < 65536 else begin, kind="stable")  # 16 bits are sorted by radix
                codes, lengths, begin = codes[by], lengths[by], begin[by]
            bits = Bits((codes >> (self.top - level - 1) & 1).astype(bool))
            starts = np.concatenate([[0], np.cumsum(np.bincount(begin))])[:-1]
            self.levels.append((bits, low, starts.astype(np.int32), bits.rank(starts).astype(np.int32)))

    @property
    def bits(self) -> float:
        """Bits a symbol of the transform and what is needed to search it, without the table of words."""
        return (sum(b.size + 8 * (x.nbytes + y.nbytes) for b, _, x, y in self.levels) + 8 * self.often.nbytes) / self.n

    def _count(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a place of the transform."""
        lengths = self.lengths[symbol]
        order = np.argsort(-lengths, kind="stable")
        code, here = self.codes[symbol[order]], at[order]
        left = np.concatenate([[0], np.cumsum(np.bincount(lengths, minlength=self.top + 1))])
        for level, (bits, low, starts, ones) in enumerate(self.levels):
            k = len(symbol) - int(left[level + 1])  # of codes longer than the level
            if not k:
                break
            c, x = code[:k], here[:k]
            node = (c >> (self.top - level)) - low
            one = bits.rank(starts[node] + x) - ones[node]
            here[:k] = np.where(c >> (self.top - level - 1) & 1, one, x - one)
        out = np.empty(len(here), np.int64)
        out[order] = here
        return out

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of symbol + pattern, from those of the patterns: one step of backward search."""
        both = self._count(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.first[symbol]
        return both[: len(lo)] + base, both[len(lo) :] + base

    def repeated(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which intervals stand for two occurrences or more in the input: two suffixes, or one of a sequence that is there often."""
        at = np.minimum(lo, self.n - 1)
        return (hi - lo >= 2) | (hi - lo == 1) & (self.often[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def repeated_starts(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Which places of the joined stretches start a window of `length` symbols that occurs twice or more in all of them; weights: how often a stretch occurs.

    Stretches are streamed against the index. A probe searches backward from a window's end while the interval stands for two occurrences: reaching past the window's
    start, it reports all windows within its match; failing, it rules out all windows that hold the failing string. Probes at the right end find long matches, probes at the left end leap over mismatches.
    """
    hits = np.zeros(len(symbols) + 1, np.int64)
    often = np.zeros(len(symbols), bool)
    often[np.arange(int((ends - begins)[weights > 1].sum())) + np.repeat(begins[weights > 1] - np.cumsum((ends - begins)[weights > 1]) + (ends - begins)[weights > 1], (ends - begins)[weights > 1])] = True
    index = FMIndex(symbols, int((ends - begins).max()) + 1, often)
    a, b, right = begins, ends - length, np.ones(len(begins), bool)
    while len(a):
        end = np.where(right, b, a) + length
        place = end.copy()
        live, lo, hi = np.arange(len(a)), np.zeros(len(a), np.int64), np.full(len(a), index.n, np.int64)
        while len(live):
            lo, hi = index.extend(symbols[place[live] - 1], lo, hi)
            good = index.repeated(lo, hi)
            live, lo, hi = live[good], lo[good], hi[good]
            place[live] -= 1
            good = place[live] > a[live]
            live, lo, hi = live[good], lo[good], hi[good]
        found = place + length <= end  # a whole window, or more
        np.add.at(hits, place[found], 1)
        np.add.at(hits, (end - length + 1)[found], -1)
        won, lost = right & found, right & ~found
        left_won, left_lost = ~right & found, ~right & ~found
        na = np.concatenate([a[won], a[lost], np.maximum(a, place - length)[lost], a[left_won] + 1, place[left_lost]])
        nb = np.concatenate([place[won] - 1, place[lost] - 1 - length, b[lost] - 1, b[left_won], b[left_lost]])
        nr = np.concatenate([np.zeros(won.sum(), bool), np.ones(lost.sum(), bool), np.zeros(lost.sum(), bool), np.ones(left_won.sum(), bool), np.ones(left_lost.sum(), bool)])
        keep = na <= nb
        a, b, right = na[keep], nb[keep], nr[keep]
    return np.cumsum(hits[:-1]) > 0


def _anchors(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: windows of `length` words where a new anchor begins, the windows where the next one does (or the text's windows end), and the anchors, which are the windows' k-grams of least hash."""
    g = grams(hash_words(words), gram)
    place = leftmost_minima(g, length - gram + 1)
    stop = np.maximum(words.first[1:] - length + 1, words.first[:-1])  # of each text's windows
    sizes = stop - words.first[:-1]
    window = np.arange(int(sizes.sum())) + np.repeat(words.first[:-1] - np.cumsum(sizes) + sizes, sizes)
    own = place[window]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    until = window[np.append(new[1:], len(own)) - 1] + 1 if len(own) else new
    return window[new], until, g[own[new]].view(np.int64)


def _keyed(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    return docs.select(F.col(row_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def repeated_intervals(stretches: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """stretches: unit (unique), route, text, n (occurrences). unit, starts, ends: maximal unions of repeated windows, in words, where there are any.

    Windows that are equal must be in stretches of equal route. Each shard, a hash part of the routes, is indexed and its own stretches are streamed against the index.
    """
    spark = stretches.sparkSession
    total = stretches.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, ids, symbols, sizes, weights = [], {}, [], [], []
        for batch in batches:
            units += batch.column(0).to_pylist()
            weights += batch.column(2).to_pylist()
            words = split_words(batch.column(1))
            kinds = words.array().dictionary_encode()
            number = np.array([ids.setdefault(w, len(ids) + 1) for w in kinds.dictionary.to_pylist()], np.int64)
            symbols.append(number[kinds.indices.to_numpy()])
            sizes.append(np.diff(words.first))
        if not units:
            return
        size = np.concatenate(sizes)
        ends = np.cumsum(size + 1) - 1
        begins = ends - size
        joined = np.insert(np.concatenate(symbols), np.cumsum(size), 0)  # symbol 0 after each stretch
        hit = repeated_starts(joined, begins, ends, np.array(weights), length)
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # runs of window starts; the stop symbols keep stretches apart
        of = np.searchsorted(ends, first)
        out: dict[int, tuple[list[int], list[int]]] = {}
        for u, s, e in zip(of.tolist(), (first - begins[of]).tolist(), (last - begins[of] + length - 1).tolist(), strict=True):
            starts, stops = out.setdefault(u, ([], []))
            starts.append(s)
            stops.append(e)
        yield pa.RecordBatch.from_arrays([pa.array([units[u] for u in out], pa.binary()), pa.array([x for x, _ in out.values()], pa.list_(pa.int32())), pa.array([y for _, y in out.values()], pa.list_(pa.int32()))], ["unit", "starts", "ends"])

    return stretches.repartition(parts, "route").select("unit", "text", "n").mapInArrow(run, "unit binary, starts array<int>, ends array<int>")


def remove_repeated(docs: DataFrame, text: str = "text", row_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, kept_sha256, kept (the words left, joined by one space; null where nothing was removed) for every row of docs.

    A word goes if a window of `length` words over it also starts anywhere else, in the same or another document. 1: each window is routed by its anchor, its k-gram
    of least hash, so that equal windows have equal anchors; anchors that occur once rule their windows out. 2: the windows left form stretches, a run of windows with one anchor; equal
    stretches are folded before they move, and an anchor with over HOT distinct stretches is split into its windows, folded again. 3: each shard of routes is FM-indexed, see repeated_intervals.
    4: the intervals return to their documents. Row order, repeated rows and ties do not matter; null texts have no words; other columns are ignored. Texts are read whole, in chunks of about wordtable.CHUNK bytes, a longer text alone.
    """
    width = length - gram + 1

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 2):
                words = split_words(batch.column(2))
                at, _, anchors = _anchors(words, length, gram)
                digests = [hashlib.sha256(t).hexdigest() for t in words.texts()]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, words.first), pa.int32()), pa.array(anchors))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(words.first)), pa.array(digests, pa.string()), lists], ["doc_id", "text_hash", "n_words", "digest", "anchors"])

    source = _keyed(docs, text, row_id)
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = cut(source.mapInArrow(survey, f"doc_id {kind}, text_hash long, n_words long, digest string, anchors array<long>").withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("anchors").alias("anchor"))
    often = cut(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    own = cut(each.join(often, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("anchors")))  # a set of one document's own anchors
    asked = cut(rows.select("row", "doc_id", "text_hash").join(own, "row").groupBy("doc_id", "text_hash").agg(F.first("anchors").alias("anchors")))
    discard(often, own)

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 2):
                words = split_words(batch.column(2))
                at, until, anchors = _anchors(words, length, gram)
                bounds = np.searchsorted(at, words.first)
                wanted = batch.column(3)
                asked = np.zeros(len(at), bool)
                for d in range(batch.num_rows):
                    part = slice(bounds[d], bounds[d + 1])
                    asked[part] = np.isin(anchors[part], wanted[d].values.to_numpy())
                at, until, anchors = at[asked], until[asked], anchors[asked]
                owner = np.searchsorted(words.first, at, "right") - 1
                last = until + length - 2  # of a stretch's words
                text_at, text_to = words.offsets[at] + at, words.offsets[last + 1] + last
                spaced = memoryview(words.spaced())
                parts = [bytes(spaced[a:b]) for a, b in zip(text_at.tolist(), text_to.tolist(), strict=True)]
                units = [hashlib.blake2b(p, digest_size=16).digest() for p in parts]
                rows = pa.array(owner)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - words.first[owner], pa.int32()), pa.array(units, pa.binary()), pa.array(anchors), pa.array(parts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "at", "unit", "route", "text"])

    def same(x: str, y: str) -> F.Column:
        return F.expr(f"{x}.doc_id <=> {y}.doc_id AND {x}.text_hash = {y}.text_hash")

    def with_text(found: DataFrame, *columns: str) -> DataFrame:
        return source.alias("d").join(found.alias("f"), same("d", "f")).select("d.doc_id", "d.text_hash", "d.text", *[f"f.{c}" for c in columns])

    places = cut(with_text(asked, "anchors").mapInArrow(stretch, f"doc_id {kind}, text_hash long, at int, unit binary, route long, text string"))
    folded = cut(places.groupBy("unit", "route", "text").agg(F.count("*").alias("n")))
    hot = cut(folded.groupBy("route").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("route"))  # few: over HOT stretches each

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out: list[list] = [[], [], [], [], []]
                for unit, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words = t.encode().split()
                    for i in range(len(words) - length + 1):
                        part = b" ".join(words[i : i + length])
                        key = hashlib.blake2b(part, digest_size=16).digest()
                        for col, v in zip(out, (unit, i, key, part.decode(), n), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int32(), pa.binary(), pa.string(), pa.int64()), strict=True)], ["stretch", "at", "unit", "text", "n"])

    cold = folded.join(hot, "route", "left_anti").select("unit", "route", "text", "n")
    single = cut(folded.join(hot, "route").select("unit", "text", "n").mapInArrow(windows, "stretch binary, at int, unit binary, text string, n long"))
    few = single.groupBy("unit", "text").agg(F.sum("n").alias("n")).select("unit", F.xxhash64("unit").alias("route"), "text", "n")
    units = cut(cold.unionByName(few))
    intervals = cut(repeated_intervals(units, length))
    of_windows = single.select("stretch", "at", "unit").join(intervals, "unit").groupBy("stretch").agg(F.collect_set("at").alias("starts"))  # a stretch has length - gram + 1 windows at most
    of_windows = of_windows.select(F.col("stretch").alias("unit"), "starts", F.transform("starts", lambda x: x + length).alias("ends"))
    intervals = cut(intervals.unionByName(of_windows))
    discard(folded, units)
    spans = places.select("doc_id", "text_hash", "at", "unit").join(intervals, "unit").select("doc_id", "text_hash", F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct((x["starts"] + F.col("at")).alias("s"), (x["ends"] + F.col("at")).alias("e"))).alias("spans"))
    found = cut(spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("spans")).alias("spans")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 2):
                words = split_words(batch.column(2))
                edge = np.zeros(len(words) + 1, np.int64)
                spans = batch.column(3)
                base = np.repeat(words.first[:-1], spans.value_lengths().to_numpy())
                flat = spans.flatten()
                np.add.at(edge, base + flat.field("s").to_numpy(), 1)
                np.add.at(edge, base + flat.field("e").to_numpy(), -1)
                stay = np.cumsum(edge[:-1]) == 0
                before = np.concatenate([[0], np.cumsum(stay)])
                sizes = np.diff(words.offsets)
                kept = Words(words.data[np.repeat(stay, sizes)], np.concatenate([[0], np.cumsum(sizes[stay])]), before[words.first])
                texts, counts = kept.texts(), np.diff(words.first)
                digests = [hashlib.sha256(t).hexdigest() for t in texts]
                columns = [pa.array(counts), pa.array(counts - np.diff(kept.first)), pa.array(digests, pa.string()), pa.array([bytes(t) for t in texts], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "n_words", "n_removed", "kept_sha256", "kept"])

    changed = with_text(found, "spans").mapInArrow(remove, f"doc_id {kind}, text_hash long, n_words long, n_removed long, kept_sha256 string, kept string")
    same_rows = rows.alias("r").join(found.alias("f"), same("r", "f"), "left_anti")
    return changed.union(same_rows.select("doc_id", "text_hash", "n_words", F.lit(0).cast("long"), "digest", F.lit(None).cast("string")))
