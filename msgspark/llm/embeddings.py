"""Embedding near-dedup: subspace pigeonhole join of rotated vectors, verified exactly in double precision."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard
from .simhash import _stars

BLOCKS = 4  # of the rotated coordinates, by which vectors are dealt out; each is halved again within its tasks
HOME, GUEST = 262_144, 524_288  # vectors of a cell that one task holds as homes and as guests, about
CELL = 262_144  # vectors at home in a cell, about, as long as the block has coordinates to halve
FLAT, WHOLE = 96_000_000, 192_000_000  # bytes of a task's vectors, by one block's coordinates and by all: both bound HOME and GUEST too
SAMPLE = 4096  # vectors that the cells' borders are taken from; results don't depend on them
BOXES = (512, 32)  # vectors of the outer and the inner boxes of a task's tree
VERIFIED = 65_536  # candidate pairs that are verified at once
SLACK = 1e-6  # of budgets, for rounding


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A fixed random orthogonal matrix: spreads each vector's energy over all blocks."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; row by row, so that a vector gives the same bits in whatever task."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0  # + 0.0: no negative zeros


def known_vectors(vectors: DataFrame, vector: str, row_id: str) -> DataFrame:
    """vec_id, x (binary, the components as they came, floats or doubles), digest (128 bits of the direction), dim; x and digest are null where the vector is null, empty, zero or holds a null or non-finite component."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    width = np.float32 if kind == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            starts = np.cumsum(sizes) - sizes
            xs, digests = [None] * len(sizes), [None] * len(sizes)
            for n in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == n)
                x = values[starts[rows][:, None] + np.arange(n)]
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                rows, x = rows[good], x[good]
                if len(rows):
                    for i, raw, u in zip(rows.tolist(), x.astype(width), unit(x), strict=True):
                        xs[i], digests[i] = raw.tobytes(), blake2b(u.tobytes(), digest_size=16).digest()
            dims = [len(x) // width().nbytes if x else 0 for x in xs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, pa.binary()), pa.array(digests, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "x", "digest", "dim"])

    return vectors.select(F.col(row_id).cast("long").alias("vec_id"), F.col(vector).alias("x")).mapInArrow(run, "vec_id long, x binary, digest binary, dim int")


def _split(coordinates: np.ndarray, parts: int) -> list[np.ndarray]:
    return [p for p in np.array_split(coordinates, parts) if len(p)]


def cell_borders(sample: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each block the medians by which its first `depth` coordinates halve the space."""
    return [np.median(sample[:, block[:depth]], axis=0) if len(sample) else np.zeros(min(depth, len(block))) for block in _split(np.arange(sample.shape[1]), BLOCKS)]


def reached(off: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells (bit c: above border c) whose cell a ball of squared radius `budget` around the row reaches; off: the row's offsets from the borders."""
    rows, cells, used = np.arange(len(off)), np.zeros(len(off), np.int64), np.zeros(len(off))
    for c in range(off.shape[1]):
        d = off[rows, c]
        above = (d > 0).astype(np.int64)
        cross = np.flatnonzero(used + d * d <= budget)
        rows, cells, used = np.concatenate([rows, rows[cross]]), np.concatenate([cells | above << c, cells[cross] | (1 - above[cross]) << c]), np.concatenate([used, used[cross] + d[cross] ** 2])
    return rows, cells


def _boxes(x: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Rows in groups of at most `size`, halved at the median of the coordinate that varies most."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            yield rows
        else:
            p, h = x[rows], len(rows) // 2
            order = np.argpartition(p[:, int(p.std(axis=0).argmax())], h)
            todo += [rows[order[h:]], rows[order[:h]]]


def near_pairs(a: np.ndarray, b: np.ndarray, budget: float, sizes: tuple[int, ...], count: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) within the squared distance, and few others for rounding: the range join of one block of coordinates.

    a is split into boxes within boxes; a box goes on with those rows of b that are within reach of it, and a smallest box is compared with what is left. count[0] grows by the pairs compared.
    """
    limit = np.float32(budget + 1e-5)

    def go(rows: np.ndarray, others: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(others):
            return
        p, q = a[rows], b[others]
        if level == len(sizes):
            if count is not None:
                count[0] += len(p) * len(q)
            i, j = np.nonzero(p @ q.T >= (np.einsum("ij,ij->i", p, p) / 2)[:, None] + (np.einsum("ij,ij->i", q, q) - limit) / 2)
            yield rows[i], others[j]
            return
        for box in _boxes(p, sizes[level]):
            x = p[box]
            d = q - np.minimum(np.maximum(q, x.min(axis=0)), x.max(axis=0))
            yield from go(rows[box], others[np.einsum("ij,ij->i", d, d) <= limit], level + 1)

    if len(a):
        yield from go(np.arange(len(a)), np.arange(len(b)), 0)


def fitting(bound: int, each: int) -> tuple[int, int]:
    """Homes and guests, twice as many, of which each takes some bytes of a bound."""
    return max(1, min(HOME, bound // (3 * each))), max(1, min(GUEST, 2 * bound // (3 * each)))


def flat_bytes(dim: int) -> int:
    """Of a copy that is dealt to a cell: a block's coordinates, the other blocks' lengths, and what names it."""
    return 4 * (-(-dim // BLOCKS) + BLOCKS) + 40


def tiled(rows: DataFrame, homes: Column, guests: Column, names: tuple[str, str]) -> DataFrame:
    """Rows with home and guest, in a grid of homes by guests chunks, so that each home meets each guest in one tile: every row goes to its tiles, with the part it has there. names: of the tile's two numbers."""
    mixed = lambda salt, m: F.pmod(F.xxhash64("node", F.lit(salt)), m).cast("int")
    tile = lambda i, j, h, g: F.struct(i.alias(names[0]), j.alias(names[1]), h.alias("home"), g.alias("guest"))
    kept = [c for c in rows.columns if c not in ("home", "guest")]
    rows = rows.withColumn("_hs", homes).withColumn("_gs", guests).withColumn("_i", mixed(names[0], F.col("_hs"))).withColumn("_j", mixed(names[1], F.col("_gs")))
    as_home = F.transform(F.filter(F.sequence(F.lit(0), F.col("_gs") - 1), lambda j: F.col("home")), lambda j: tile(F.col("_i"), j, F.lit(True), F.col("guest") & (j == F.col("_j"))))
    as_guest = F.transform(F.filter(F.sequence(F.lit(0), F.col("_hs") - 1), lambda i: F.col("guest") & ~(F.col("home") & (i == F.col("_i")))), lambda i: tile(i, F.col("_j"), F.lit(False), F.lit(True)))
    return rows.select(*kept, F.explode(F.concat(as_home, as_guest)).alias("_t")).select(*kept, "_t.*")


def pigeonhole_links(distinct: DataFrame, dim: int, n: int, width: type, cosine: float) -> DataFrame:
    """distinct: node, x, copies; n rows. Rows (node, links, root): links to other nodes' copies found in one task, and a spanning star of them.

    cosine >= c means squared distance <= 2 - 2c, so some block of the rotated vectors is within that block's share, proportional to its width. Over CELL vectors, a block's space is halved along as many coordinates as it takes
    (at medians of a bounded sample); a vector is at home in one cell and a guest in every cell that its ball reaches. What moves there is the block's coordinates in single precision and the other blocks' lengths, which bound the rest of the
    distance from below (flat_bytes). In a task the block is halved again, by the same argument, and each half is range-joined by boxes (near_pairs): vectors with a partner within reach are spotted.
    Only these move whole, to the tiles in which they were spotted, where the union of candidates is verified by the full product. A pair counts in the first block and half whose share it meets, so in one place only.
    Cells, and what is spotted in them, are split into chunks of homes by chunks of guests wherever a task would hold more than FLAT or WHOLE bytes. Pairs never leave a task: it gives counts and a spanning star.
    """
    turn, blocks = rotation(dim), _split(np.arange(dim), BLOCKS)
    share = lambda part, whole, of: of * len(part) / whole * (1 + SLACK) + SLACK
    shares = [share(b, dim, 2 - 2 * cosine) for b in blocks]
    most_home, most_guest = fitting(FLAT, flat_bytes(dim))
    depth = max(0, min(*(len(b) for b in blocks), int(np.log2(max(1, n / min(CELL, most_home))))))
    decode = lambda cells: unit(np.frombuffer(b"".join(cells.to_pylist()), width).reshape(-1, dim).astype(np.float64))
    turned_of = lambda x: np.einsum("ij,jk->ik", x, turn)  # noqa: E731  # the same bits for a vector in whatever task
    sample = [r.x for r in distinct.orderBy(F.xxhash64("node")).limit(SAMPLE).select("x").collect()] if depth else []
    borders = cell_borders(turned_of(decode(pa.array(sample, pa.binary()))) if sample else np.empty((0, dim)), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                turned = turned_of(decode(batch.column(1)))
                lengths = np.sqrt(np.stack([np.einsum("ij,ij->i", turned[:, b], turned[:, b]) for b in blocks], axis=1)).astype(np.float32)
                for k, (block, border) in enumerate(zip(blocks, borders, strict=True)):
                    off = turned[:, block[: len(border)]] - border
                    own = (off > 0) @ (1 << np.arange(len(border)))
                    rows, cells = reached(off, shares[k])
                    low = np.hstack([turned[:, block].astype(np.float32), np.delete(lengths, k, axis=1)])
                    for part in range(0, len(rows), 20_000):
                        r, c = rows[part : part + 20_000], cells[part : part + 20_000]
                        size = low.shape[1] * 4
                        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(r), [None, pa.py_buffer(low[r].tobytes())]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), flat, pa.array(k << 32 | c), pa.array(own[r] == c)], ["node", "low", "cell", "home"])

    dealt = distinct.select("node", "x").mapInArrow(deal, "node long, low binary, cell long, home boolean")
    if depth or n > min(most_home, most_guest):
        sizes = {r.cell: (r.h, r.g) for r in dealt.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("h"), F.count("*").alias("g")).collect()}  # BLOCKS * n / CELL rows, BLOCKS * 2 ** (dim / BLOCKS) at most
    else:
        sizes = {k << 32: (n, n) for k in range(len(blocks))}
    chunks = distinct.sparkSession.createDataFrame([(c, -(-h // most_home) or 1, -(-g // most_guest)) for c, (h, g) in sizes.items()], "cell long, hs int, gs int")
    tiles = tiled(dealt.join(F.broadcast(chunks), "cell").withColumn("guest", F.lit(True)), F.col("hs"), F.col("gs"), ("i", "j")).drop("hs", "gs")

    def spot(key: tuple, table: pa.Table) -> pa.Table:
        """The vectors of a tile that have a partner within a half's budget, the block's share and, as far as the other blocks' lengths tell, the whole distance."""
        k = key[0].as_py() >> 32
        b = len(blocks[k])
        node, home, guest = (table[c].to_numpy() for c in ("node", "home", "guest"))
        low = np.frombuffer(b"".join(table["low"].to_pylist()), np.float32).reshape(len(node), -1)
        h, g, met = np.flatnonzero(home), np.flatnonzero(guest), np.zeros(len(node), bool)
        for half in _split(np.arange(b), 2):
            part = np.ascontiguousarray(low[:, half])
            for i, j in near_pairs(part[h], part[g], share(half, b, shares[k]), BOXES):
                p, q = h[i], g[j]
                new = (node[p] != node[q]) & ~(met[p] & met[q])
                p, q = p[new], q[new]
                for at in range(0, len(p), VERIFIED):
                    x, y = low[p[at : at + VERIFIED]], low[q[at : at + VERIFIED]]
                    d = (x - y) ** 2
                    own = d[:, :b].sum(axis=1)
                    good = (own <= shares[k] + 1e-4) & (own + d[:, b:].sum(axis=1) <= 2 - 2 * cosine + 1e-4)
                    met[p[at : at + VERIFIED][good]] = met[q[at : at + VERIFIED][good]] = True
        return table.select(["cell", "i", "j", "node", "home", "guest"]).filter(pa.array(met))

    spotted = cut(tiles.groupBy("cell", "i", "j").applyInArrow(spot, "cell long, i int, j int, node long, home boolean, guest boolean"))
    whole_home, whole_guest = fitting(WHOLE, dim * 16)
    held = spotted.groupBy("cell", "i", "j").agg(F.sum(F.col("home").cast("long")).alias("h"), F.sum(F.col("guest").cast("long")).alias("g"))
    held = held.select("cell", "i", "j", F.greatest(F.lit(1), F.ceil(F.col("h") / whole_home)).cast("int").alias("hs"), F.greatest(F.lit(1), F.ceil(F.col("g") / whole_guest)).cast("int").alias("gs"))
    parts = tiled(spotted.join(held, ["cell", "i", "j"]), F.col("hs"), F.col("gs"), ("i2", "j2")).join(distinct.select("node", "x", "copies"), "node")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py() >> 32
        node, copies, home, guest = (table[c].to_numpy() for c in ("node", "copies", "home", "guest"))
        x = decode(table["x"].combine_chunks())
        h, g = np.flatnonzero(home), np.flatnonzero(guest)
        turned = turned_of(x)
        halves = _split(blocks[k], 2)
        budgets = [share(half, len(blocks[k]), shares[k]) for half in halves]

        def within(part: np.ndarray, budget: float, p: np.ndarray, q: np.ndarray) -> np.ndarray:
            d = turned[p][:, part] - turned[q][:, part]
            return np.einsum("ij,ij->i", d, d) <= budget

        names, first = np.unique(node, return_inverse=True)  # a node may be here as home and as guest
        links, stars = np.zeros(len(node), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]

        def verify(half: int, p: np.ndarray, q: np.ndarray) -> None:
            other = node[p] != node[q]
            p, q = p[other], q[other]
            tests = [(halves[half], budgets[half], True), (blocks[k], shares[k], True), *((halves[i], budgets[i], False) for i in range(half)), *((blocks[i], shares[i], False) for i in range(k))]
            for part, budget, want in tests:  # a pair that an earlier part admits is counted there
                good = within(part, budget, p, q) == want
                p, q = p[good], q[good]
            true = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
            p, q = p[true], q[true]
            np.add.at(links, p, copies[q])
            stars.append((first[p], first[q]))
            if sum(len(s) for s, _ in stars) > 10 * VERIFIED:  # only a spanning star of all links so far is kept
                stars[:] = [_stars(*map(np.concatenate, zip(*stars, strict=True)), len(names))]

        for half, part in enumerate(halves):
            low = turned[:, part].astype(np.float32)
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in near_pairs(low[h], low[g], budgets[half], BOXES):
                waiting.append((h[i], g[j]))
                if sum(len(w) for w, _ in waiting) >= VERIFIED:
                    p, q = map(np.concatenate, zip(*waiting, strict=True))
                    for at in range(0, len(p), VERIFIED):
                        verify(half, p[at : at + VERIFIED], q[at : at + VERIFIED])
                    waiting = []
            if waiting:
                verify(half, *map(np.concatenate, zip(*waiting, strict=True)))
        member, root = _stars(*map(np.concatenate, zip(*stars, strict=True)), len(names))
        counted = np.bincount(first, weights=links, minlength=len(names)).astype(np.int64)
        to = names.copy()
        to[member] = names[root]
        out = (counted > 0) | (to != names)
        return pa.table({"node": names[out], "links": counted[out], "root": to[out]})

    return parts.select("cell", "i", "j", "i2", "j2", "node", "x", "copies", "home", "guest").groupBy("cell", "i", "j", "i2", "j2").applyInArrow(meet, "node long, links long, root long")


def embedding_groups(vectors: DataFrame, vector: str = "embedding", row_id: str = "vec_id", cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept, for every row of vectors.

    Two vectors link at a cosine >= `cosine` in double precision. Vectors of equal direction to the last bit are folded first and counted by their number. Null, empty and zero vectors and those with null or non-finite components link with
    nothing, nor do vectors of different lengths. Each row is a vector of its own, also if its id repeats; a null id is never a component's name while another is there. No rows give no rows; other columns are ignored.
    """
    width = np.float32 if vectors.schema[vector].dataType.elementType.simpleString() == "float" else np.float64
    rows = cut(known_vectors(vectors, vector, row_id).withColumn("row", F.monotonically_increasing_id()))
    # A node is the least row number of vectors of one direction; any of them stands for all.
    nodes = cut(rows.where("digest IS NOT NULL").groupBy("dim", "digest").agg(F.first("x").alias("x"), F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    found = None
    for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect():  # as many as there are lengths of vectors
        links = pigeonhole_links(nodes.where(F.col("dim") == r.dim), r.dim, r.n, width, cosine)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "node long, links long, root long")
    found = cut(found)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "top")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(counted, "node", "left").join(roots, "node", "left")
    known = cut(known.select("dim", "digest", "copies", "least", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("top", "node").alias("top")))
    least = cut(known.groupBy("top").agg(F.min("least").alias("component_id")))
    known = cut(known.join(least, "top").select("dim", "digest", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"))
    discard(nodes, found, least)
    linked = rows.where("digest IS NOT NULL").join(known, ["dim", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
