"""How much of a task's input is held as Python objects at once."""

import pyarrow as pa
from msgspark.functions import jsx as J
from msgspark.operators import graph, jsx_strings, keys
from pyspark.sql import functions as F


def test_batches_are_cut(spark):
    batch = pa.RecordBatch.from_pydict({"n": list(range(300))})
    assert [p.num_rows for p in J.pieces([batch, batch.slice(0, 0)])] == [128, 128, 44]
    files = spark.range(1000, numPartitions=1).select(F.concat(F.lit("p"), "id", F.lit(".tsx")).alias("path"), F.concat(F.lit("export const A = () => <p>Text "), "id", F.lit("</p>;\n")).alias("content"))
    assert jsx_strings.extract_strings(files).count() == 1000 and graph.file_facts(files).count() == 1000
    mapping = files.select(F.concat(F.lit("Text "), F.regexp_extract("path", r"\d+", 0)).alias("text"), F.lit("a.b").alias("key"))
    assert jsx_strings.rewrite_sources(files, mapping).where("replaced = 1").count() == 1000


def test_maps_and_client_files_are_not_broadcast(spark):
    strings = graph.saved(spark.range(60).select(F.concat(F.lit("f"), F.col("id") % 7).alias("file"), F.concat(F.lit("t"), F.col("id") % 5).alias("text")))
    sites = keys.replacement_sites(strings, strings.select("text", F.concat("text", F.lit(".k")).alias("key")))
    used = keys.client_namespaces(sites, strings.where("file < 'f3'").select(F.col("file").alias("path")))
    assert {(r.namespace, r.files) for r in used.collect()} == {(f"t{i}", 3) for i in range(5)}
    assert "Broadcast" not in used._jdf.queryExecution().executedPlan().toString()
