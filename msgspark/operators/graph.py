"""Graph operators: reachability over import edges, import resolution by priority."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsx as J

#: Extensions of source files, in the order in which they are tried.
EXTENSIONS = [".tsx", ".ts", ".jsx", ".js", ".mts", ".cts", ".mjs", ".cjs"]


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary folder for each local application (tests), else ValueError: executors would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="msgspark-")
    return base.rstrip("/")


_open: list[list[str]] = []


def listed(path: str) -> str:
    """Notes a table for the scratch() around, if there is one."""
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that operators have written to the shared folder inside it, training-data operators too: with scratch(spark): result(...).write... DataFrames made inside cannot be read afterwards. The list of tables so far is
    what it gives. An inner scratch() deletes its own only."""
    mine: list[str] = []
    _open.append(mine)
    try:
        yield mine
    finally:
        _open.remove(mine)
        for place in mine:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved_path(df: DataFrame) -> str:
    """Writes df to the shared folder and returns the place."""
    path = listed(f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later steps neither recompute it nor lose it with an executor."""
    return df.sparkSession.read.schema(df.schema).parquet(saved_path(df))


SMALL = 100_000  # nodes that are broadcast in any case


def _sized(nodes: DataFrame, n: int) -> DataFrame:
    """n nodes for a join: broadcast if they are few by count, else left to Spark's size check, as sorting would shuffle all edges in a round."""
    return F.broadcast(nodes) if n <= SMALL else nodes


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node: all that can be reached from roots (node) over edges (src, dst), the roots included; cycles, nulls and repeated edges are fine [CG8].

    A frontier loop over edges that are written once: each round joins the new nodes with the edges, drops those seen and appends its frontier, so a round writes its own nodes only.
    """
    spark = roots.sparkSession
    frontier = roots.select("node").where("node IS NOT NULL").distinct()
    schema, paths, total = frontier.schema, [], 0
    edges = saved(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst"))
    while True:
        paths.append(saved_path(frontier))
        now = spark.read.schema(schema).parquet(paths[-1])
        seen = spark.read.schema(schema).parquet(*paths)
        n = now.count()
        if not n:
            return seen
        total += n
        ahead = edges.join(_sized(now, n), F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        frontier = ahead.join(_sized(seen, total), "node", "left_anti")


def file_facts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, client (whether the file runs in the browser by itself), sources (its runtime imports, distinct, in order) of each file that can be read [AGG17, CG7]. Null contents have no row."""
    from .jsx_strings import is_client

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in J.pieces(batches):
            out: list[list] = [[], [], []]
            for file, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    sources = J.runtime_imports(J.read(code)) if code is not None else None
                except J.Unreadable:
                    sources = None
                if sources is not None:
                    for col, v in zip(out, (file, is_client(code), sources), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.list_(pa.string()))], ["path", "client", "sources"])

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(run, "path string, client boolean, sources array<string>")


def normalized(path: Column) -> Column:
    """A path from the project's root without '.', '..' and empty parts."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_bases(importer: Column, source: Column, aliases: list[tuple[str, bool, list[str]]]) -> Column:
    """Places that an import may mean, in order [JN12]: relative to the importer; '@/' under src, then the root; '~/' and '/' under the root; else by aliases (prefix, exact, targets), all that fit, as ordered."""
    folder = F.regexp_replace(importer, "/?[^/]*$", "")
    rest = lambda n: F.substring(source, F.lit(n), F.length(source))
    none = F.array().cast("array<string>")
    by_alias = none
    for prefix, exact, targets in aliases:
        fits = source == prefix if exact else F.startswith(source, F.lit(prefix))
        places = F.array(*[F.lit(t) if exact else F.concat(F.lit(t.rstrip("/") + "/"), rest(len(prefix) + 1)) for t in targets])
        by_alias = F.concat(by_alias, F.when(fits, places).otherwise(none))
    found = (
        F.when(F.startswith(source, F.lit(".")), F.array(F.concat(folder, F.lit("/"), source)))
        .when(F.startswith(source, F.lit("@/")), F.array(F.concat(F.lit("src/"), rest(3)), rest(3)))
        .when(F.startswith(source, F.lit("~/")), F.array(rest(3)))
        .when(F.startswith(source, F.lit("/")), F.array(rest(2)))
        .otherwise(by_alias)
    )
    return F.transform(found, normalized)


def resolved_imports(facts: DataFrame, aliases: list[tuple[str, bool, list[str]]] | None = None) -> DataFrame:
    """src, source, dst: the file of facts (path, sources) that each import means: the first place, then the first candidate file, that is a known file [JN12]. One equi-join by sorting: neither side is ever broadcast."""
    asked = facts.select(F.col("path").alias("src"), F.explode("sources").alias("source"))
    places = asked.select("src", "source", F.posexplode(import_bases(F.col("src"), F.col("source"), aliases or [])).alias("p", "base"))
    files = places.select("src", "source", "p", F.posexplode(candidates(F.col("base"))).alias("q", "file"))
    known = facts.select(F.col("path").alias("file")).distinct()
    found = files.join(known.hint("merge"), "file")  # both grow with the files, and Spark takes the exploded candidates to be as small as the compressed paths
    return found.groupBy("src", "source").agg(F.min_by("file", F.struct("p", "q")).alias("dst"))


def import_edges(facts: DataFrame, aliases: list[tuple[str, bool, list[str]]] | None = None) -> DataFrame:
    """src, dst: which files of facts (path, sources) import which others at run time [JN12]."""
    return resolved_imports(facts, aliases).select("src", "dst").distinct()


def client_files(files: DataFrame, aliases: list[tuple[str, bool, list[str]]] | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """path of every file that reaches the browser: client files and all that they import at run time, at any depth [CG8, AGG17]."""
    facts = saved(file_facts(files, path, content))
    return reachable(facts.where("client").select(F.col("path").alias("node")), import_edges(facts, aliases)).select(F.col("node").alias("path"))


def candidates(base: Column) -> Column:
    """Files that an import of `base` may mean, in order [JN12]: itself; without an extension with each extension and as folder with an index; .js forms also as their sources."""
    ext = F.regexp_extract(base, r"(\.[A-Za-z0-9]+)$", 1)
    bare = F.flatten(F.array(*[F.array(F.concat(base, F.lit(e)), F.concat(base, F.lit(f"/index{e}"))) for e in EXTENSIONS]))
    stem = F.regexp_replace(base, r"\.[A-Za-z0-9]+$", "")
    esm = F.array(*[F.concat(stem, F.lit(e)) for e in EXTENSIONS])
    more = F.when(ext == "", bare).when(ext.isin(".js", ".jsx", ".mjs", ".cjs"), esm).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(base), more)


def resolve_links(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (importer, base) with file: the first candidate that is a known file; imports that resolve to nothing fall away [JN12]."""
    asked = imports.select("importer", "base", F.posexplode(candidates(F.col("base"))).alias("pos", "file"))
    known = files.select("file").distinct()
    return asked.join(known, "file").groupBy("importer", "base").agg(F.min_by("file", "pos").alias("file"))
