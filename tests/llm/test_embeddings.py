import math

import numpy as np
from msgspark.llm import embeddings as E

from .brute import unite

SCHEMA = "vec_id long, embedding array<float>, label int, v string, node string, links string"


def brute(rows, cosine):
    ok = [i for i, (_, x) in enumerate(rows) if x and None not in x and all(map(math.isfinite, x)) and any(x)]
    u = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in ok}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(u[a]) == len(u[b]) and u[a] @ u[b] >= cosine]
    n = [0] * len(rows)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    root = unite(range(len(rows)), pairs)
    least = {}
    for i, (vid, _) in enumerate(rows):
        if vid is not None:
            least[root[i]] = min(vid, least.get(root[i], vid))
    return [(vid, n[i], least.get(root[i])) for i, (vid, _) in enumerate(rows)]


def compare(spark, rows, cosine=0.95):
    df = spark.createDataFrame([(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], 0, "a", "b", "c") for i, x in rows], SCHEMA)
    rows = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in E.embedding_groups(df, cosine=cosine).collect()), key=key)
    assert got == sorted(brute(rows, cosine), key=key)
    return got


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 24))
    near = base[rng.integers(0, 120, 200)] + rng.normal(size=(200, 24)) * rng.uniform(0.02, 0.5, (200, 1))
    rows = list(enumerate(np.vstack([base, near, base[:20], base[:5] * 3]).tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [math.nan] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [math.inf] * 24), (None, base[1].tolist()), (7, base[7].tolist()), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    assert sum(n > 0 for _, n, _ in compare(spark, rows)) > 100
    monkeypatch.setattr(E, "HOME", 8)
    monkeypatch.setattr(E, "CELL", 20)
    monkeypatch.setattr(E, "GUEST", 50)
    compare(spark, rows)


def test_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(E, "HOME", 40)
    rng = np.random.default_rng(2)
    rows = [(int(i), x) for i, x in zip(rng.permutation(300), (rng.normal(size=16) + rng.normal(size=(300, 16)) * 0.03).tolist())]
    assert min(n for _, n, _ in compare(spark, rows)) > 200


def test_few_pairs_are_compared():
    """The boxes find every pair of a block within the budget, and compare under a twentieth of all pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(51_282, 64))
    x[1000:1300] = x[:300] + rng.normal(size=(300, 64)) * 0.2
    low = (E.unit(x) @ E.rotation(64))[:, :8].astype(np.float32)
    count, found = [0], 0
    for i, j in E.near_pairs(low, low, 0.0125, E.BOXES, count):
        found += int((((low[i].astype(np.float64) - low[j]) ** 2).sum(axis=1) <= 0.0125).sum())
    print(f"compared {count[0] / len(low) ** 2:.4f} of all pairs, within the budget {found / len(low) ** 2:.6f}")
    assert count[0] < 0.05 * len(low) ** 2
    some = low[:500].astype(np.float64)
    want = sum(int((((low.astype(np.float64) - v) ** 2).sum(axis=1) <= 0.0125).sum()) for v in some)
    assert want == sum(int((((low[i].astype(np.float64) - low[j]) ** 2).sum(axis=1) <= 0.0125).sum()) for i, j in E.near_pairs(low[:500], low, 0.0125, E.BOXES))


def test_reached_cells():
    rng = np.random.default_rng(4)
    off = rng.normal(size=(200, 5))
    rows, cells = E.reached(off, 0.8)
    got = sorted(zip(rows.tolist(), cells.tolist()))
    want = [(r, c) for r in range(200) for c in range(32) if sum(off[r, b] ** 2 for b in range(5) if (off[r, b] > 0) != (c >> b & 1)) <= 0.8]
    assert got == want


def test_doubles(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 12))
    rows = list(enumerate(np.vstack([base, base + rng.normal(size=(60, 12)) * 0.1, base[:9] * 1e200]).tolist()))
    got = E.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute([(i, (np.array(x) / max(map(abs, x))).tolist()) for i, x in rows], 0.95))


def test_empty(spark):
    assert compare(spark, []) == []
    assert compare(spark, [(1, None)]) == [(1, 0, 1)]


def copies(dim, n, block_bytes):
    """Mean number of cells that a vector goes to over all blocks, and the bytes that move for it, at n vectors, from a sample."""
    rng = np.random.default_rng(11)
    x = E.unit(rng.normal(size=(8192, dim))) @ E.rotation(dim)
    blocks = E._split(np.arange(dim), E.BLOCKS)
    depth = max(0, min(*(len(b) for b in blocks), int(np.log2(max(1, n / min(E.CELL, E.fitting(E.FLAT, E.flat_bytes(dim))[0]))))))
    borders, total = E.cell_borders(x[:4096], depth), 0
    for block, border in zip(blocks, borders):
        off = x[4096:, block[: len(border)]] - border
        total += sum(len(E.reached(off[i : i + 64], 0.1 * len(block) / dim)[0]) for i in range(0, 4096 if depth < 10 else 512, 64)) / (4096 if depth < 10 else 512)
    return total, total * block_bytes


def test_bytes_that_move_for_a_vector():
    """At 1, 16 and 256 million vectors of 64 coordinates: before, whole vectors of 256 bytes and 40 of names moved to 35, 230 and about 1,500 cells."""
    each, found = E.flat_bytes(64), []
    for millions, before in ((1, 35), (16, 230), (256, 1500)):
        n, moved = copies(64, millions * 1_048_576, each)
        found.append(n)
        print(f"{millions} million vectors: {n:.1f} copies of {each} bytes, {moved / 1000:.1f} kB a vector")
        assert moved < before * 296 / 5
    print(f"copies grow with the power {np.log(found[2] / found[1]) / np.log(16):.2f}")


def test_real_cells(spark, monkeypatch):
    """Three levels of cells with tiles of several chunks, by whole results."""
    monkeypatch.setattr(E, "CELL", 400)
    monkeypatch.setattr(E, "HOME", 150)
    monkeypatch.setattr(E, "GUEST", 300)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2600, 24))
    near = base[rng.integers(0, 2600, 500)] + rng.normal(size=(500, 24)) * rng.uniform(0.05, 0.4, (500, 1))
    dense = rng.normal(size=24) + rng.normal(size=(300, 24)) * 0.05
    rows = np.vstack([base, near, dense]).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    u = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    root = unite(range(len(rows)), zip(*(x.tolist() for x in np.nonzero(np.triu(close)))))
    got = E.embedding_groups(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, int(close[i].sum()), root[i]) for i in range(len(rows))]
    assert sum(1 for r in got if r.n_links > 200) >= 250


def test_wide_vectors_fit_in_tasks():
    for dim in (8, 64, 768, 4096):
        home, guest = E.fitting(E.FLAT, E.flat_bytes(dim))
        assert (home + guest) * E.flat_bytes(dim) <= E.FLAT and guest <= E.GUEST and home >= 1
        home, guest = E.fitting(E.WHOLE, dim * 16)
        assert (home + guest) * dim * 16 <= E.WHOLE
