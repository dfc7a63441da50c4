"""Best-fit packing: best-fit decreasing per group, certified by dual-feasible-function bounds; groups with gaps exchange loose bins and rerun."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .wordtable import binary_array, buffers, chunks, split_words

GROUP = 16_384  # pieces that one best-fit run takes
LONGEST = 40  # bytes of words that are merged here; longer ones are rare and left to the tokenizer
#: Fixed value: the pieces of tokenizers for which words may be taken apart.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe, which some tokenizers join with what follows
LATIN = 0x250  # letters under this code point are lower-cased here; NFC leaves them as they are


class Merges:
    """Byte-pair merges of many pieces at once.

    Pieces of one length are the rows of a matrix; in each step every row merges its leftmost pair of least rank, as a tokenizer does for one piece, so all rows get
    narrower by one. Rows without a pair left are done. Ranks are found in a hash table with linear probing.
    """

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], end: str) -> None:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        symbol = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}  # of a byte, in byte-level vocabularies
        self.inner = np.array([vocab.get(symbol[b], -1) for b in range(256)], np.int32)
        self.final = np.array([vocab.get(symbol[b] + end, -1) for b in range(256)], np.int32)
        self.width, self.none = len(vocab), len(merges)
        self.merged = np.array([vocab[a + b] for a, b in merges] + [-1], np.int32)
        code = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        self.bits = max(4, int(len(merges)).bit_length() + 2)
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int32)
        left, slot = np.arange(len(merges)), self._slot(code)
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            at, which = np.unique(slot[free], return_index=True)
            self.keys[at], self.ranks[at] = code[free[which]], free[which]
            left = left[self.keys[slot[left]] != code[left]]
            slot[left] = (slot[left] + 1) % len(self.keys)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = (a.astype(np.int64) * self.width + b).ravel()
        slot = self._slot(code)
        key, out = self.keys[slot], self.ranks[slot]
        wrong = np.flatnonzero(key != code)
        out[wrong] = self.none
        wrong = wrong[key[wrong] != -1]
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % len(self.keys)
            key = self.keys[slot[wrong]]
            hit = key == code[wrong]
            out[wrong[hit]] = self.ranks[slot[wrong[hit]]]
            wrong = wrong[~hit & (key != -1)]
        return out.reshape(a.shape)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (bytes between the offsets), and how many each has."""
        sizes = np.diff(offsets)
        counts, parts = np.zeros(len(sizes), np.int64), []
        for n in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == n)
            raw = data[offsets[rows][:, None] + np.arange(n)]
            x = self.inner[raw]
            x[:, -1] = self.final[raw[:, -1]]
            r = self.rank(x[:, :-1], x[:, 1:])
            while True:
                width = x.shape[1]
                at = r.argmin(axis=1) if width > 1 else np.zeros(len(x), np.int64)
                best = r[np.arange(len(x)), at] if width > 1 else np.full(len(x), self.none)
                over = best == self.none
                if over.any():
                    parts.append((rows[over], x[over]))
                    counts[rows[over]] = width
                    if over.all():
                        break
                    go = ~over
                    rows, x, r, at, best = rows[go], x[go], r[go], at[go], best[go]
                every, column = np.arange(len(x)), np.arange(width - 1)
                x[every, at] = self.merged[best]
                x = np.where(column <= at[:, None], x[:, :-1], x[:, 1:])
                r = np.where(column[:-1] < at[:, None], r[:, :-1], r[:, 1:])
                before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
                r[before, at[before] - 1] = self.rank(x[before, at[before] - 1], x[before, at[before]])
                r[after, at[after]] = self.rank(x[after, at[after]], x[after, at[after] + 1])
        starts = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        for rows, x in parts:
            ids[starts[rows][:, None] + np.arange(x.shape[1])] = x
        return ids, counts


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of every pair, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordTokenizer:
    """Ids of whole texts. Each distinct white-space-free word of a chunk of texts is encoded once.

    That is exact if the tokenizer lower-cases, treats white space as a boundary and makes each run of letters one piece (LETTERS; word_bpe_49k.json is such a one); other tokenizers
    encode whole texts. A word that is Latin letters and then punctuation is two pieces, merged by Merges; every other word, and words over LONGEST bytes, go through the tokenizer.
    Nothing is kept from chunk to chunk, so cost and memory follow the text alone.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        model, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        self.by_words = (
            split[0].get("pattern") == {"Regex": LETTERS} and [x.get("type") for x in split] == ["Split", "ByteLevel"] and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
            and [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "fuse_unk", "byte_fallback"))
            and all(not t["content"][0].isalpha() and any(map(str.isalpha, t["content"])) for t in spec["added_tokens"])
        )
        if self.by_words:
            self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
            letters = [chr(c) if 0xC0 <= c != 0x130 and chr(c).isalpha() and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < LATIN else "" for c in range(LATIN)]
            self.letter = np.array([bool(c) for c in letters])
            self.lowered = np.array([ord(c.lower()) if c else 0 for c in letters], np.int64)
        self.tail = np.isin(np.arange(256), list(TAIL))
        self.alpha = np.array([chr(b).isalpha() and b < 128 for b in range(256)])

    def _native(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for i in range(0, len(texts), 1000) for e in self.tokenizer.encode_batch_fast(texts[i : i + 1000], add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, int(sizes.sum())), sizes

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: ids of pieces, sizes of pieces, and the two pieces of each word."""
        data, offsets = buffers(words)
        start, sizes = offsets[:-1], np.diff(offsets)
        core_end = np.maximum.reduceat(np.where(self.tail[data], -1, np.arange(len(data))), start) + 1
        low, good = data + 32 * (self.alpha[data] & (data < 97)).astype(np.uint8), self.alpha[data]
        two = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
        point = (data[two].astype(np.int64) & 31) << 6 | data[two + 1] & 63
        lowered = self.lowered[point]
        good[two] = good[two + 1] = self.letter[point]
        low[two], low[two + 1] = 0xC0 | lowered >> 6, 0x80 | lowered & 63
        bad = np.concatenate([[0], np.cumsum(~good)])
        fast = (core_end > start) & (sizes <= LONGEST) & (bad[np.maximum(core_end, start)] == bad[start])
        both = np.stack([core_end - start, offsets[1:] - core_end], axis=1)[fast].ravel()
        kinds = binary_array(low[np.repeat(fast, sizes)], np.concatenate([[0], np.cumsum(both)])).dictionary_encode()
        ids, counts = self.merges(*buffers(kinds.dictionary))
        own, own_counts = self._native([w.decode() for w in words.filter(pa.array(~fast)).to_pylist()])
        pieces = np.empty((len(words), 2), np.int64)
        pieces[fast] = kinds.indices.to_numpy().reshape(-1, 2)
        pieces[~fast, 0] = len(counts) + np.arange(len(own_counts))
        pieces[~fast, 1] = len(counts) + len(own_counts)  # a piece without ids
        return np.concatenate([ids, own]), np.concatenate([counts, own_counts, [0]]), pieces

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (and the end). Nulls are empty."""
        if not self.by_words:
            ids, sizes = self._native([t or "" for t in texts.to_pylist()])
            return ids.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])
        words = split_words(texts)
        if not len(words):
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        kinds = words.array().dictionary_encode()
        ids, counts, pieces = self._words(kinds.dictionary)
        of = pieces[kinds.indices.to_numpy()].ravel()
        sizes = counts[of]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ragged(ids.astype("<u4"), (np.cumsum(counts) - counts)[of], sizes), ends[2 * words.first]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        ids, bounds = self.ids(pa.array(texts, pa.string()))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[a:b].tobytes()


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = 1, text: str = "text", row_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if wanted): each text's ids, then end_id, cut into pieces of `longest` where longer.

    Null and empty texts are end_id alone. Rows are worked on in chunks of about wordtable.CHUNK bytes; a longer text is a chunk of its own, so memory follows the longest text. Repeated rows and
    ids each give their own pieces; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        for whole in batches:
            for batch in chunks(whole, 1):
                ids, bounds = encoder.ids(batch.column(1))
                ids = np.insert(ids, bounds[1:], np.uint32(end_id))
                bounds = bounds + np.arange(len(bounds))
                sizes = np.diff(bounds)
                pieces = -(-sizes // longest)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * longest
                length = np.minimum(longest, sizes[owner] - start)
                at = bounds[owner] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """No packing of counts[x] items of each length x needs fewer bins: the best of the dual feasible functions U(e) and u(k)."""
    x = np.arange(size + 1)
    n, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    e = np.arange(0, size // 2 + 1)  # U(e): lengths over size - e count as a whole bin, those under e as nothing
    best = int(np.max(n[-1] - n[size - e + 1] - (-(mass[size - e + 1] - mass[e]) // size)))
    for k in range(1, 33):  # u(k): (k + 1) x / size rounded down, over k, where it isn't whole
        times = (k + 1) * x
        worth = np.where(times % size == 0, k * x, (times // size) * size)  # in 1 / (k * size) of a bin
        best = max(best, -(-int((counts * worth).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, gap of each bin: longest first, each into the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by what is free
    free, gaps = 0, []  # bit c of free: some bin has c free
    for i in order.tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            c = n + (fits & -fits).bit_length() - 1
            b = room[c].pop()
            if not room[c]:
                free &= ~(1 << c)
        else:
            c, b = size, len(gaps)
            gaps.append(size)
        bins[i], offsets[i] = b, size - c
        gaps[b] = left = c - n
        if left:
            room[left].append(b)
            free |= 1 << left
    return bins, offsets, np.array(gaps, np.int64)


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """pieces (any columns; length long from 1 to size) with sequence_id and offset: few sequences of at most size tokens, each gapless from 0.

    Added too, for the partition that each row was settled in: partition_id, partition_bins and partition_bound, its bins and their dual-feasible lower bound.
    Pieces are dealt by hash into partitions of about GROUP rows. Each runs best-fit decreasing and computes its own bound. A partition that meets its bound is certified and its bins are settled, all but
    the emptiest, which is the rounding that a bound for each partition allows. A partition with a gap settles its full bins only. What isn't settled is exchanged: whole bins are dealt anew into fewer
    partitions, which rerun best-fit decreasing and keep the old arrangement where the rerun needs no fewer bins. It ends when all bins meet the bound of the whole, at one partition, or after a round that saved less than a
    thousandth of the bins that it moved. Each task holds one partition; the driver sees a histogram of at most `size` rows and a few sums for each round.
    Pieces of equal length, repeated rows and null ids are fine; no pieces give no rows; existing columns of the added names are replaced.
    """
    added = ["sequence_id", "offset", "gap", "moves", "partition_id", "partition_bins", "partition_bound"]
    pieces = pieces.drop(*added)
    empty = [F.lit(None).cast("boolean" if c == "moves" else "long").alias(c) for c in added]
    now = cut(pieces.select(*pieces.columns, *empty))
    counts = np.zeros(size + 1, np.int64)
    for r in now.groupBy("length").count().collect():  # at most `size` rows
        counts[r.length] = r["count"]
    rows = int(counts.sum())
    if not rows:
        return now.drop("gap", "moves")
    whole, schema = lower_bound(counts, size), now.schema
    deal = next(c for c in ("group", "group_", "group__") if c not in schema.names)

    def run(round_: int):
        def group(key: tuple, table: pa.Table) -> pa.Table:
            lengths = table["length"].to_numpy()
            bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
            ids, offsets, gap_of = (table[c].to_numpy() for c in added[:3]) if table["gap"].null_count == 0 else (None, None, None)
            had = len(np.unique(ids)) if ids is not None else None
            if had is None or had > bound:
                bins, at, gaps = best_fit_decreasing(lengths, size)
                if had is None or len(gaps) < had:
                    ids, offsets, gap_of, had = (round_ << 56) + (key[0].as_py() << 24) + bins, at, gaps[bins], len(gaps)
            emptiest = ids[np.lexsort((ids, -gap_of))[0]]
            moves = (gap_of > 0) & ((ids == emptiest) | (had > bound))
            own = [np.full(len(ids), x, np.int64) for x in ((round_ << 56) + key[0].as_py(), had, bound)]
            new = dict(zip(added, (ids, offsets, gap_of, moves, *own), strict=True))
            return pa.table({c: pa.array(new[c]) if c in new else table[c] for c in schema.names})

        return group

    done, settled, before, round_ = [], 0, None, 0
    while True:
        groups = max(1, -(-rows // GROUP))
        seed = F.xxhash64("sequence_id", F.lit(round_)) if round_ else F.xxhash64(*[c for c in pieces.columns if c != "ids"], F.monotonically_increasing_id())
        out = cut(now.withColumn(deal, F.pmod(seed, F.lit(groups))).groupBy(deal).applyInArrow(run(round_), schema))
        discard(now)
        first, moving = F.col("offset") == 0, F.col("moves")
        bins, loose, rows = out.agg(F.sum(first.cast("long")), F.sum((first & moving).cast("long")), F.sum(moving.cast("long"))).first()
        if settled + bins <= whole or groups == 1 or loose <= 1 or (before is not None and before - bins < loose / 1000):
            done.append(out)
            break
        done.append(out.where(~moving))
        settled, before, round_ = settled + bins - loose, loose, round_ + 1
        now = cut(out.where(moving))
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.drop("gap", "moves")
