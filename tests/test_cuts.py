"""Plans are cut by columns on disk, and only edges that are asked for are ranked."""

from pyspark.sql import functions as F

from strandgraph.operators import traverse
from strandgraph.operators.graph import Graph, materialise
from strandgraph.schema import EDGES, NODES, table


def graph(spark):
    nodes = [{"id": f"service:n{i}", "type": "ServiceNode", "name": f"n{i}"} for i in range(6)]
    edges = [{"id": f"CALLS:OBSERVED:service:n{a}->service:n{b}", "source": f"service:n{a}", "target": f"service:n{b}", "type": "CALLS", "provenance": "OBSERVED", "callCount": a + b, "signal": (a + b, a, 0.0, None, None, None)} for a, b in ((0, 1), (1, 2), (2, 0), (3, 2), (4, 3))]
    return Graph(table(spark, NODES, nodes), table(spark, EDGES, edges))


def test_a_cut_is_read_by_columns(spark):
    cut = materialise(graph(spark).edges)
    assert cut.count() == 5 and len(cut.inputFiles()) > 0
    plan = cut.select("source")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert plan < cut._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_pairs_are_those_of_the_paths(spark):
    g = graph(spark)
    roots = [f"service:n{i}" for i in range(6)]
    for direction in ("up", "down"):
        pairs = {(r["root"], r["node"]) for r in traverse.reached_pairs(g, roots, direction, 10).collect()}
        assert pairs == {(r["root"], r["node"]) for r in traverse.breadth_first(g, roots, direction, 10).collect()}
        some = g.best_edges(direction, g.nodes.filter("id = 'service:n2'").select(F.col("id").alias("near")))
        assert {(r["near"], r["far"]) for r in some.collect()} == {(r["near"], r["far"]) for r in g.best_edges(direction).collect() if r["near"] == "service:n2"}
