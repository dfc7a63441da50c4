"""Merkle dataset manifest: a sparse forest of unresolved runs, merged by partitions and then by groups of partitions, whose runs close as soon as their last sibling comes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, discard, named

ARITY = 8
LEAVES, FAN = 4096, 64  # leaves of a part, and parts that one merge takes
SORTED = 262_144  # leaves that one task sorts at most, about; fewer where spark.sql.shuffle.partitions asks for more tasks
TOP = 0  # the tree of the languages' subroots; languages are trees from 1
Run = tuple[int, int, int]  # tree, level, place: the nodes ARITY * place and after on that level
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes on a level of a tree."""
    for _ in range(level):
        leaves = -(-leaves // ARITY)
    return leaves


class Forest:
    """The monoid: runs of which some nodes are known. `add` and `merge` may come in any order and grouping. A run that is whole becomes a node of the level above, and the last node of a language's tree one of TOP."""

    def __init__(self, trees: int) -> None:
        self.leaves = {TOP: trees}
        self.open: dict[Run, list[str | None]] = {}
        self.closed: dict[Run, list[str]] = {}
        self.root: str | None = None

    def add(self, tree: int, leaves: int, level: int, at: int, node: str) -> None:
        """leaves: of the whole tree, so that the arity of its last runs is known."""
        self.leaves[tree] = leaves
        while True:
            n = width(self.leaves[tree], level)
            if n == 1:
                if tree == TOP:
                    self.root = node
                    return
                tree, level, at = TOP, 0, tree - 1
                continue
            place = at // ARITY
            run = self.open.setdefault((tree, level, place), [None] * min(ARITY, n - place * ARITY))
            run[at - place * ARITY] = node
            if None in run:
                return
            del self.open[tree, level, place]
            self.closed[tree, level, place] = run
            level, at, node = level + 1, place, digest(run)

    def merge(self, tree: int, leaves: int, level: int, place: int, nodes: list[str | None]) -> None:
        for i, node in enumerate(nodes):
            if node is not None:
                self.add(tree, leaves, level, place * ARITY + i, node)

    def above(self, run: Run) -> Iterator[Run]:
        """A run and all above it, up to the root's."""
        tree, level, place = run
        while True:
            if width(self.leaves[tree], level) > 1:
                yield tree, level, place
            if width(self.leaves[tree], level + 1) > 1:
                level, place = level + 1, place // ARITY
            elif tree != TOP:
                tree, level, place = TOP, 0, (tree - 1) // ARITY
            else:
                return


_NODES = "part long, tree long, leaves long, level int, place long, nodes array<string>, closed boolean, root string"
_SCHEMA = pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("leaves", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("nodes", pa.list_(pa.string())), ("closed", pa.bool_()), ("root", pa.string())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)] if rows else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _planted(table: pa.Table, trees: int) -> Forest:
    forest = Forest(trees)
    for tree, leaves, at, leaf in zip(*(table.column(c).to_pylist() for c in ("tree", "leaves", "at", "leaf")), strict=True):
        forest.add(tree, leaves, 0, at, leaf)
    return forest


def _parts(placed: DataFrame, trees: int) -> DataFrame:
    """Of each part of the leaves the runs that it leaves open, with the nodes it knows of them, and the runs above these."""

    def run(table: pa.Table) -> pa.Table:
        part, forest = table.column("part")[0].as_py(), _planted(table, trees)
        wanted = dict.fromkeys(above for run in forest.open for above in forest.above(run))
        rows = [(part, t, forest.leaves[t], level, place, forest.open.get((t, level, place), []), False, None) for t, level, place in wanted]
        return _table(rows + [(part, None, None, None, None, None, None, forest.root)] * (forest.root is not None))

    return placed.groupBy("part").applyInArrow(run, _NODES)


def _merged(fragments: DataFrame, trees: int) -> DataFrame:
    """Groups of FAN fragments become one: the runs that closed on the way, and those still open."""

    def run(table: pa.Table) -> pa.Table:
        forest, part = Forest(trees), table.column("part")[0].as_py()
        for tree, leaves, level, place, nodes in zip(*(table.column(c).to_pylist() for c in ("tree", "leaves", "level", "place", "nodes")), strict=True):
            forest.merge(tree, leaves, level, place, nodes)
        rows = [(part, t, forest.leaves[t], level, place, nodes, closed, None) for closed, runs in ((False, forest.open), (True, forest.closed)) for (t, level, place), nodes in runs.items()]
        return _table(rows + [(part, None, None, None, None, None, None, forest.root)] * (forest.root is not None))

    return fragments.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInArrow(run, _NODES)


def _proved(placed: DataFrame, context: DataFrame, trees: int, root: str, id_type: str) -> DataFrame:
    """Every leaf with its subroot, the root, the digest of its proof, and the root that its other text's leaf folds to. A part grows its forest again; the runs it shares with others come from context."""

    def run(_: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        forest = _planted(mine, trees)
        runs = forest.closed | {(t, level, place): nodes for t, level, place, nodes in zip(*(theirs.column(c).to_pylist() for c in ("tree", "level", "place", "nodes")), strict=True)}
        forest.leaves |= {t: n for t, n in zip(*(theirs.column(c).to_pylist() for c in ("tree", "leaves")), strict=True)}
        up: dict[Run, list[tuple[str, str]]] = {}  # of the nodes above a run: what stands before and after each in its own run

        def steps(tree: int, level: int, at: int) -> list[tuple[str, str]]:
            """What stands before and after a node, and each node above it, in its run."""
            n = width(forest.leaves[tree], level)
            if n == 1:
                return steps(TOP, 0, tree - 1) if tree != TOP else []
            key = (tree, level, at // ARITY)
            nodes, i = runs[key], at % ARITY
            if key not in up:
                up[key] = steps(tree, level + 1, at // ARITY)
            return [("".join(nodes[:i]), "".join(nodes[i + 1 :])), *up[key]]

        def subroot(tree: int, leaf: str) -> str:
            if tree not in tops:
                height = next(h for h in range(64) if width(forest.leaves[tree], h) == 1)
                tops[tree] = digest(runs[tree, height - 1, 0]) if height else leaf
            return tops[tree]

        tops: dict[int, str] = {}
        out: list[tuple] = []
        for tree, at, leaf, other in zip(*(mine.column(c).to_pylist() for c in ("tree", "at", "leaf", "other")), strict=True):
            path = steps(tree, 0, at)
            folded = other or leaf
            for before, after in path:
                folded = digest((before, folded, after))
            out.append((leaf, subroot(tree, leaf), root, digest(x for step in path for x in step), folded, folded == root))
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return pa.table([mine.column("doc_id"), *([pa.array(c) for c in zip(*out, strict=True)])], names=["doc_id", *names])

    return placed.groupBy("part").cogroup(context.withColumnRenamed("part", "of").groupBy("of")).applyInArrow(run, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def leaf_of(text: Column) -> Column:
    """The leaf of a row with the given text: sha256 of its fields, each as its bytes' count, a colon and its value, or - for null."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[value(text if c == "text" else F.col(c).cast("string")) for c in FIELDS]), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    docs: FIELDS, any other columns are ignored. Leaves are numbered by lang (null first), doc_id (null first) and leaf, by one range sort that equal rows are salted in, so neither a language nor a row that is repeated meets in one task. LEAVES
    neighbours are a part. Each part resolves what it can; fragments of FAN neighbouring parts are merged until one is left, and the runs that close on the way are written, never collected: the driver gets the root only. (A plain
    treeReduce merges partitions by remainder, whose fragments aren't neighbours and close no run before its last step.) A part then asks, by joins, for the runs that it shares with others.

    A row of which 3 divides the unsigned crc32 of the decimal doc_id has its text's A-Z lower-cased before its root is folded again; null doc_ids and null texts stay as they are. Rows that are equal in all fields have equal leaves at
    places of their own, so their proofs may differ; which of them gets which place is open. Texts of any length are hashed whole, by the JVM. No rows give no rows; one row is its own root, with the proof of no siblings.
    """
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_of(ascii_lower(F.col("text"))))
    rows = cut(docs.select("doc_id", "lang", leaf_of(F.col("text")).alias("leaf"), other.alias("other"), F.rand().alias("salt")))
    n = rows.count()
    order = ["lang", "doc_id", "leaf", "salt"]
    tasks = min(-(-n // LEAVES), max(-(-n // SORTED), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))) or 1
    ordered = named(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("salt"))
    groups = cut(ordered.groupBy("lang").agg(F.min("name").alias("start"), F.count("*").alias("leaves")))
    trees = groups.count()
    ranked = named(groups.repartitionByRange("lang").sortWithinPartitions("lang"))
    same = F.col("o.lang").eqNullSafe(F.col("t.lang"))
    placed = cut(ordered.alias("o").join(ranked.alias("t"), same).select(F.expr(f"(o.name - 1) div {LEAVES}").alias("part"), F.col("t.name").alias("tree"), "t.leaves", (F.col("o.name") - F.col("t.start")).alias("at"), "o.doc_id", "o.leaf", "o.other"))
    discard(rows, ordered, groups, ranked)
    parts = -(-n // LEAVES)
    first = fragments = cut(_parts(placed, trees))
    closed, found = [], [fragments]
    while parts > 1:
        fragments = cut(_merged(fragments.where("root IS NULL AND NOT closed"), trees))
        closed.append(fragments.where("closed"))
        found.append(fragments)
        parts = -(-parts // FAN)
    root = next((r.root for table in reversed(found) for r in table.where("root IS NOT NULL").select("root").limit(1).collect()), "")
    runs = closed[0] if closed else first.where("closed")
    for more in closed[1:]:
        runs = runs.union(more)
    wanted = first.where("root IS NULL").select("part", "tree", "level", "place")
    context = wanted.join(runs.select("tree", "leaves", "level", "place", "nodes"), ["tree", "level", "place"]).select("part", "tree", "leaves", "level", "place", "nodes")
    return _proved(placed, context, trees, root, docs.schema["doc_id"].dataType.simpleString())
