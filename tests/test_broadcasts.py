"""What joins of the graph operators broadcast."""

from msgspark.operators import graph
from pyspark.sql import functions as F


def test_imports_are_resolved_without_a_broadcast(spark):
    facts = graph.saved(spark.range(50).select(F.concat(F.lit("src/p"), "id", F.lit(".ts")).alias("path"), F.array(F.concat(F.lit("./p"), (2 * F.col("id")).cast("string"))).alias("sources")))
    edges = graph.import_edges(facts)
    assert edges.count() == 25
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


def test_reachable_broadcasts_by_count(spark, monkeypatch):
    edges = spark.range(1, 200).select(F.col("id").alias("src"), (F.col("id") * 2).alias("dst")).union(spark.range(1, 200).select("id", F.col("id") * 3))
    want, todo = set(), {1}
    while todo:
        want |= todo
        todo = {n * k for n in todo for k in (2, 3) if n < 200} - want
    roots, plain, said = spark.createDataFrame([(1,)], "node long"), graph._sized, []
    monkeypatch.setattr(graph, "_sized", lambda nodes, n: said.append((n, nodes.count())) or plain(nodes, n))
    for small in (3, 100_000):
        monkeypatch.setattr(graph, "SMALL", small)
        assert sorted(r.node for r in graph.reachable(roots, edges).collect()) == sorted(want)
    assert said and all(n == m for n, m in said)
