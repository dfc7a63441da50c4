"""SimHash near-dedup: covering locality-sensitive hashing over distinct fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, packed_rows

BLOCKS, BLOCK_BITS = 8, 8
#: Pairs up to this run length are compared one by one; longer runs look up each member's neighbours. Both ways find all pairs.
PAIRED = 128
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, XXH64 of each shingle of `size` words; a bit is 1 if set in over half of them.

    Fewer words make one shingle; no words (null or empty texts) give 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(size, len(words))
    starts, stops = [0, *ends[: len(words) - k].tolist()], (ends[k - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(stops), 8192):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[i : i + 8192], stops[i : i + 8192])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(stops), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash (XXH64 of the text) and fingerprint (the 64 bits as a signed long), a row for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int64())], ["doc_id", "text_hash", "fingerprint"])

    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def covering_masks(radius: int) -> list[int]:
    """Masks that each keep all 64 bits but `radius` of the 8 blocks. Any `radius` differing bits lie in as many blocks at most, so some mask keeps none of them."""
    block = (1 << BLOCK_BITS) - 1
    return [sum(block << (BLOCK_BITS * b) for b in range(BLOCKS) if b not in gone) for gone in combinations(range(BLOCKS), radius)]


def _neighbours(mask: int, radius: int) -> np.ndarray:
    """All changes of at most `radius` of the bits that mask drops."""
    bits = [1 << i for i in range(64) if not mask >> i & 1]
    return np.array([sum(c) for r in range(1, radius + 1) for c in combinations(bits, r)], np.uint64)


def _stars(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph on 0..n-1: a (member, root) pair for each member that isn't its component's least."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def near_fingerprints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fingerprint, long), whose components are those of all pairs within `radius` bits.

    Covering hashing: each fingerprint goes to one bucket of every mask's table, keyed by the bits that the mask keeps. A bucket's members differ only in the dropped 8 * radius bits, so it holds
    2 ** (8 * radius) at most, whatever the input (65,536 at radius 2). Buckets come as sorted runs; in short runs all pairs are compared, in longer ones each member's
    neighbours are looked up by bisection, which finds the same pairs; a run gives a spanning star for each of its components, never all pairs. Give each fingerprint once: repeated ones are linked with themselves, which is harmless, but fill buckets. Nulls must not be there; no rows give no edges.
    """
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("kept")) for i, m in enumerate(masks)])
    rows = prints.select("fingerprint", F.explode(tables).alias("t")).select("t.mask", "t.kept", "fingerprint")
    changes = [_neighbours(m, radius) for m in masks]

    def edges_of(mask: np.ndarray, kept: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of whole runs, sorted by mask, kept and fingerprint."""
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (kept[1:] != kept[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(prints)))
        of = np.repeat(np.arange(len(starts)), sizes)
        bits = prints.view(np.uint64)
        left, right = [], []
        short = np.flatnonzero((sizes[of] > 1) & (sizes[of] <= PAIRED))
        for step in range(1, PAIRED):
            short = short[short + step < len(prints)]
            short = short[of[short] == of[short + step]]
            if not len(short):
                break
            near = short[np.bitwise_count(bits[short] ^ bits[short + step]) <= radius]
            left.append(near)
            right.append(near + step)
        for r in np.flatnonzero(sizes > PAIRED):
            lo, hi = starts[r], starts[r] + sizes[r]
            own = np.sort(bits[lo:hi])
            order = lo + np.argsort(bits[lo:hi], kind="stable")
            for change in changes[mask[lo]]:
                at = np.minimum(np.searchsorted(own, own ^ change), len(own) - 1)
                hit = np.flatnonzero(own[at] == own ^ change)
                left.append(order[hit])
                right.append(order[at[hit]])
        if not left or not sum(map(len, left)):
            return []
        member, root = _stars(np.concatenate(left), np.concatenate(right), len(prints))
        return [(prints[member], prints[root])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_back: list[np.ndarray] = [np.empty(0, t) for t in (np.int32, np.int64, np.int64)]

        def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in edges_of(*parts) if len(parts[0]) else []:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            parts = [np.concatenate([k, c.to_numpy()]) for k, c in zip(kept_back, batch.columns, strict=True)]
            if not len(parts[0]):
                continue
            last = np.flatnonzero((parts[0] != parts[0][-1]) | (parts[1] != parts[1][-1]))
            whole = last[-1] + 1 if len(last) else 0  # the last run may go on in the next batch
            yield from emit([p[:whole] for p in parts])
            kept_back = [p[whole:] for p in parts]
        yield from emit(kept_back)

    return rows.repartition("mask", "kept").sortWithinPartitions("mask", "kept").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, text: str = "text", row_id: str = "doc_id", radius: int = 2) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable by links of at most `radius` differing bits, itself included), for every row.

    Exact copies share a fingerprint and are folded before the search, so a group of any number of copies is one row there. Texts without words have fingerprint 0 and are linked like
    any other. Repeated doc_ids and rows keep a row each; null doc_ids never become a component_id unless nothing else is in it. Other columns are ignored; no rows give no rows. A text of any length is
    fingerprinted whole; memory follows the longest text.
    """
    rows = cut(fingerprints(docs, text, row_id))
    prints = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    linked = components(near_fingerprints(prints, radius))
    of = prints.join(linked, prints.fingerprint == linked.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    roots = cut(of)
    least = cut(roots.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(roots.join(least, "root").select("fingerprint", "component_id"))
    discard(prints, roots, least)
    return rows.join(named, "fingerprint").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, text: str = "text", row_id: str = "doc_id", radius: int = 2) -> DataFrame:
    """One row of docs, with all its columns whatever their names, of each group: the one with the smallest doc_id, of rows that share it the one with the least text hash, of equal rows any.

    Null texts and texts without words are one group (fingerprint 0); rows with null ids stay only in groups without other ids, one of each; no rows give no rows; very long texts are fingerprinted whole.
    """
    groups = simhash_groups(docs, text, row_id, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    of = F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("of")
    keep = cut(groups.groupBy(F.col("component_id").alias("id"), of).agg(F.min("text_hash").alias("hash")).select("id", "hash").distinct())
    marked = packed_rows(docs, F.col(row_id).cast("long").alias("id"), F.xxhash64(text).alias("hash"))
    kept = marked.alias("m").join(keep.alias("k"), F.expr("m.id <=> k.id AND m.hash = k.hash"), "left_semi")
    return kept.groupBy("id", "hash").agg(F.first("row").alias("row")).select("row.*")  # folded in each task before the shuffle, so a row of any number of copies never meets in one
