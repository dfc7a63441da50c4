"""Byte-level BPE encoding and decoding: merges in the order of a hierarchical-bitmap rank queue, so that a pre-token of any length costs a few steps a byte."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordtable import chunks

#: Fixed value: what splits a text into pre-tokens, before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 150_000  # distinct pre-tokens that a worker remembers from one run of texts to the next; beyond, it begins anew
TOGETHER = 10_000  # new pre-tokens from which on they are merged on one queue
TEXT = 6_000_000  # characters of texts that are worked on at once, about
WIDTH = 256  # bits of a word of the bitmap
BATCH = 8_000_000  # bytes of an Arrow batch, about


class RankQueue:
    """Positions in buckets by rank, under a bitmap of two levels: a bit for each rank with a bucket, in words of WIDTH bits, and a bit for each word that isn't zero."""

    def __init__(self, ranks: int) -> None:
        self.words, self.top = [0] * (ranks // WIDTH + 1), 0
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heapq.heappush(bucket, position)
            return
        bucket.append(position)
        word = rank // WIDTH
        if not self.words[word]:
            self.top |= 1 << word
        self.words[word] |= 1 << rank % WIDTH

    def put(self, rank: int, positions: list[int]) -> None:
        """Several positions, for a bucket that take() empties: in any order."""
        if not self.buckets[rank]:
            self.push(rank, positions[0])
            positions = positions[1:]
        self.buckets[rank] += positions

    def take(self) -> tuple[int, list[int]] | None:
        """The least rank with its whole bucket, or None."""
        found = self.pop()
        if found is None:
            return None
        rank, position = found
        rest = self.buckets[rank]
        if rest:
            self.buckets[rank] = []
            word = rank // WIDTH
            self.words[word] &= ~(1 << rank % WIDTH)
            if not self.words[word]:
                self.top &= ~(1 << word)
        return rank, [position, *rest]

    def pop(self) -> tuple[int, int] | None:
        """The least rank and its leftmost position, or None: the first set bit above leads to the word, the first set bit there to the bucket."""
        top = self.top
        if not top:
            return None
        at = (top & -top).bit_length() - 1
        word = self.words[at]
        rank = at * WIDTH + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        word &= word - 1
        self.words[at] = word
        if not word:
            self.top = top & top - 1
        return rank, bucket.pop()


class Pairs:
    """What two neighbours merge to: every cut of every token into two tokens, in a hash table with linear probing. look: ranks of many pairs, -1 where they are no token."""

    def __init__(self, ranks: dict[bytes, int], bits: int) -> None:
        found = {ranks[token[:i]] << bits | ranks[token[i:]]: rank for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
        self.bits, self.size = bits, max(16, (4 * len(found)).bit_length())
        self.keys, self.ranks = np.full(1 << self.size, -1, np.int64), np.full(1 << self.size, -1, np.int32)
        keys, values = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        at = self._at(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for one place the last stands there
            stands = self.keys[at] == keys
            self.ranks[at[stands]] = values[stands]
            keys, values, at = keys[~stands], values[~stands], at[~stands] + 1 & (1 << self.size) - 1

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.size)).astype(np.int64)

    def look(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        keys = (left << self.bits | right) + np.int64(0)
        at = self._at(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], np.int32(-1))
        wrong = np.flatnonzero((there != keys) & (there >= 0))
        while len(wrong):
            at[wrong] = at[wrong] + 1 & (1 << self.size) - 1
            there = self.keys[at[wrong]]
            hit = there == keys[wrong]
            out[wrong[hit]] = self.ranks[at[wrong[hit]]]
            wrong = wrong[~hit & (there >= 0)]
        return out


class ByteBPE:
    """The encoder and decoder of a file of ranks: a line for each token, base64 of its bytes and its id, which is also the rank of the merge that makes it."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.most = max(self.tokens, default=0) + 1
        self.split = regex.compile(PATTERN).findall

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.ranks, self.most.bit_length())

    @cached_property
    def queue(self) -> RankQueue:
        return RankQueue(self.most)

    @cached_property
    def known(self) -> Known:
        return Known(self)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: of all neighbours whose bytes together are a token, those of least rank merge first, the leftmost of equal ones."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ranks, push, pop, n = self.ranks, self.queue.push, self.queue.pop, len(piece)
        spelled: list[bytes | None] = [piece[i : i + 1] for i in range(n)]  # the token that begins at a byte; None where none does
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wanted = [ranks.get(a + b) for a, b in zip(spelled, spelled[1:], strict=False)]  # the rank of merging with the next token
        wanted.append(None)
        for i, rank in enumerate(wanted):
            if rank is not None:
                push(rank, i)
        while (found := pop()) is not None:
            rank, i = found
            if wanted[i] != rank:
                continue  # stale: the token or its neighbour has merged with another since
            gone = after[i]
            end = after[i] = after[gone]
            token = spelled[i] = self.tokens[rank]
            spelled[gone] = wanted[gone] = wanted[i] = None
            if end < n:
                before[end] = i
                new = wanted[i] = ranks.get(token + spelled[end])
                if new is not None:
                    push(new, i)
            left = before[i]
            if left >= 0:
                new = wanted[left] = ranks.get(spelled[left] + token)
                if new is not None:
                    push(new, left)
        return [ranks[t] for t in spelled if t is not None]

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens, and where each one's begin. Those that are tokens need no merges."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        rest = np.flatnonzero(whole < 0)
        ids, starts = self.merge_together([pieces[i] for i in rest.tolist()])
        sizes = np.ones(len(pieces), np.int64)
        sizes[rest] = np.diff(starts)
        first = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(first[-1], np.int64)
        out[first[:-1][whole >= 0]] = whole[whole >= 0]
        out[np.repeat(first[:-1][rest] - starts[:-1], np.diff(starts)) + np.arange(starts[-1])] = ids
        return out, first

    def merge_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pre-tokens that are no tokens: all on one queue, whose buckets are emptied whole.

        That gives what one after another gives, unless a merge makes a pair of lower rank, which has to come before the rest of its bucket. Pre-tokens in which that happens are merged by themselves.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        n, look, queue = int(first[-1]), self.pairs.look, self.queue
        ids = np.full(n + 1, self.most, np.int64)  # of the token that begins at a byte, -1 where none does; place n stands for no neighbour
        ids[:n] = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)])[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[first[1:] - 1] = before[first[:-1]] = n  # pre-tokens are never empty
        after[n] = n
        wanted = np.append(look(ids[:n], ids[after[:n]]), np.int32(-1))
        odd: set[int] = set()

        def push(places: np.ndarray, ranks: np.ndarray) -> None:
            if len(places) > 16:
                order = np.argsort(ranks, kind="stable")
                places, ranks = places[order], ranks[order]
                cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
                for rank, part in zip(ranks[cuts].tolist(), np.split(places, cuts[1:]), strict=True):
                    queue.put(rank, part.tolist())
            else:
                for rank, place in zip(ranks.tolist(), places.tolist(), strict=True):
                    queue.put(rank, [place])

        at = np.flatnonzero(wanted >= 0)
        push(at, wanted[at])
        while (bucket := queue.take()) is not None:
            rank, places = bucket
            pos = np.unique(np.array(places)) if len(places) > 1 else np.array(places)
            pos = pos[wanted[pos] == rank]  # the others are stale
            if not len(pos):
                continue
            gone = after[pos]
            if len(pos) > 1 and (chained := pos[1:] == gone[:-1]).any():
                here = np.arange(len(pos))
                begun = np.maximum.accumulate(np.where(np.concatenate([[False], chained]), 0, here))
                left_of_two = (here - begun) % 2 == 0  # of overlapping pairs the leftmost, and so on
                pos, gone = pos[left_of_two], gone[left_of_two]
            end = after[gone]
            low = look(rank, ids[end])  # with the next token as it is before its own merge
            ids[pos], ids[gone], wanted[gone] = rank, -1, -1
            after[pos] = end
            before[end] = pos
            prev = before[pos]
            right, left = look(rank, ids[end]), look(ids[prev], rank)
            wanted[pos], wanted[prev] = right, left
            wanted[n] = -1
            bad = ((low >= 0) & (low < rank)) | ((right >= 0) & (right < rank)) | ((left >= 0) & (left < rank))
            if bad.any():
                odd.update((np.searchsorted(first, pos[bad], "right") - 1).tolist())
            a, b = right >= 0, left >= 0
            push(np.concatenate([pos[a], prev[b]]), np.concatenate([right[a], left[b]]))
        stand = np.flatnonzero(ids[:n] >= 0)
        out, starts = ids[stand], np.searchsorted(stand, first)
        if odd:
            parts = np.split(out, starts[1:-1])
            for i in odd:
                parts[i] = np.array(self.merge(pieces[i]))
            out, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, starts

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Distinct pre-tokens are numbered first, then the new ones are merged together."""
        known = self.known
        if len(known) > CACHED:
            known.forget()
        numbers = [np.fromiter(map(known.__getitem__, self.split(t)), np.int32) for t in texts]
        known.settle()
        out = []
        for which in numbers:
            sizes = known.sizes[which]
            ends = np.cumsum(sizes)
            out.append(known.ids[np.repeat(known.first[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Known(dict):
    """Numbers of the pre-tokens met so far. ids: those of all settled ones; first, sizes: where a number's ids begin, and how many they are."""

    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__()
        self.bpe = bpe
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.first, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def settle(self) -> None:
        pieces = [p.encode() for p in self.new]
        self.new = []
        if len(pieces) > TOGETHER:
            ids, starts = self.bpe.merge_all(pieces)
        else:
            each = [self.bpe.merge(p) for p in pieces]
            ids, starts = np.array([i for e in each for i in e], np.int64), np.concatenate([[0], np.cumsum([len(e) for e in each], dtype=np.int64)])
        self.first = np.concatenate([self.first, len(self.ids) + starts[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(starts)])
        self.ids = np.concatenate([self.ids, ids.astype("<u4")])


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    """One for each worker and file; workers keep it, with its cache, from task to task."""
    return ByteBPE(path)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows of a key and bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x or b"") for x in row[1:]) + 64
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _run(docs: DataFrame, ranks: str, key: str, column: str, names: list[str], compute: Callable[[ByteBPE, pa.Array], Iterable[tuple[bytes, ...]]]) -> DataFrame:
    """`key` and binary columns: what compute makes of a binary column, in chunks of about TEXT bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for whole in batches:
            schema = pa.schema([whole.schema.field(0), *[pa.field(n, pa.binary()) for n in names]])
            for batch in chunks(whole, 1, TEXT):
                yield from _batches(((k, *row) for k, row in zip(batch.column(0).to_pylist(), compute(bpe, batch.column(1)), strict=True)), schema)

    kind = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(n, T.BinaryType()) for n in names]])
    name = "`" + key.replace("`", "``") + "`"
    return docs.select(F.col(name).alias("key"), F.col(column).cast("binary").alias("value")).mapInArrow(run, kind).withColumnRenamed("key", key)


def _encoded(bpe: ByteBPE, texts: pa.Array) -> list[bytes]:
    return bpe.encode(t.as_py().decode("utf-8", "replace") if t.is_valid else "" for t in texts)


def encode_documents(docs: DataFrame, ranks: str, key: str = "doc_id") -> DataFrame:
    """The token ids of every whole text, without special tokens.

    docs: `key` and text, other columns are left out; ranks: the path of a file of ranks that all executors have. Returns `key` as it is and ids binary, little-endian
    unsigned 32-bit integers. Null and empty texts have no ids; rows repeated are encoded each; bytes that are no UTF-8 count as U+FFFD; texts and pre-tokens of any
    length are encoded whole, in time that grows with their length (times its logarithm where one rank has many positions).
    """
    return _run(docs, ranks, key, "text", ["ids"], lambda bpe, texts: ((ids,) for ids in _encoded(bpe, texts)))


def decode_documents(encoded: DataFrame, ranks: str, key: str = "doc_id") -> DataFrame:
    """The bytes that token ids stand for: `key`, ids and decoded binary. Null ids decode to nothing; an id that the file has not raises KeyError."""
    return _run(encoded, ranks, key, "ids", ["ids", "decoded"], lambda bpe, ids: ((i.as_py(), bpe.decode(i.as_py() or b"")) for i in ids))


def token_report(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, and decoded again from the ids alone, in one pass. Odd rows as in encode_documents; the digests of a null or empty text are those of no bytes."""
    done = _run(docs, ranks, "doc_id", "text", ["ids", "decoded"], lambda bpe, texts: ((ids, bpe.decode(ids)) for ids in _encoded(bpe, texts)))
    return done.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
