"""traces are landed by every task, and spans meet what is told of their sites in one join."""

from pathlib import Path

from pyspark.sql import functions as F

from strandgraph.operators import ingest
from strandgraph.operators.graph import Graph
from strandgraph.plans import bound, traced
from strandgraph.schema import EDGES, NODES, SPANS, table

SMALL = "/root/testdata/sf0.001"


def test_every_task_writes_requests(spark, tmp_path, monkeypatch):
    rows = spark.range(60).select((F.col("id") % 3).cast("int").alias("file"), F.col("id").cast("string").alias("value")).repartition(4, "value")
    monkeypatch.setattr(traced, "requests", lambda *_: rows)
    for single, most in ((False, 4), (True, 1)):
        path = traced.land_requests(spark, SMALL, single=single)
        files = [len([*Path(path, f"file={k}").glob("part-*")]) for k in range(3)]
        assert max(files) == most
        assert sorted(int(r["value"]) for r in spark.read.text(path).collect()) == [*range(60)]


def test_spans_meet_their_places_in_one_join(spark):
    nodes = [
        {"id": "service:shop", "type": "ServiceNode", "name": "shop", "discoveredVia": "static"},
        {"id": "file:shop:src/a.py", "type": "FileNode", "name": "a.py", "service": "shop", "path": "src/a.py"},
        {"id": "symbol:shop:src/a.py#f", "type": "SymbolNode", "name": "f", "qualname": "f", "service": "shop", "relPath": "src/a.py", "span": (1, 9)},
        {"id": "database:own", "type": "DatabaseNode", "name": "own", "engine": "mysql"},
    ]
    g = Graph(table(spark, NODES, nodes), table(spark, EDGES, [{"id": "CONNECTS_TO:service:shop->database:own", "source": "service:shop", "target": "database:own", "type": "CONNECTS_TO", "provenance": "EXTRACTED"}]))
    at = lambda **a: {k: v for k, v in {"code.file.path": a.get("path"), "code.line.number": a.get("line"), "code.function.name": a.get("fn"), "server.address": a.get("peer")}.items() if v}
    given = [(at(), None), (at(path="/x/src/a.py", line="3", fn="f"), None), (at(path="/x/src/a.py", line="30", fn="g"), None), (at(path="/x/src/a.py", line="3"), None), (at(peer="shop"), None), (at(), "mysql"), (at(peer="h"), "mysql")]
    spans = [{"service": "Shop", "traceId": "t", "spanId": str(i), "attributes": a, "dbSystem": db} for i, (a, db) in enumerate(given)] * 2
    placed = ingest.placed(table(spark, SPANS, spans), g)
    got = sorted((r["spanId"], r["_src"], r["_peer"], r["_to"], r["_declared"]) for r in placed.collect())
    one = [
        ("0", "service:shop", None, None, None), ("1", "symbol:shop:src/a.py#f", None, None, None), ("2", "symbol:shop:src/a.py#g", None, None, None), ("3", "symbol:shop:src/a.py#f", None, None, None),
        ("4", "service:shop", "shop", "service:shop", None), ("5", "service:shop", None, None, "database:own"), ("6", "service:shop", "h", None, "database:own"),
    ]
    assert got == sorted(one * 2, key=lambda r: r[0])
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_every_pair_of_deliveries_calls(spark):
    """Two deliveries of a parent and of its child are four calls, and one if they are counted once."""
    spans = [{"service": "a", "traceId": "t", "spanId": "1", "kind": 2, "attributes": {}}, {"service": "b", "traceId": "t", "spanId": "2", "parentSpanId": "1", "kind": 2, "attributes": {}}] * 2
    g = Graph(table(spark, NODES, []), table(spark, EDGES, []))
    for dedupe, n in ((False, 4), (True, 1)):
        edges = ingest.land(table(spark, SPANS, spans), g, dedupe=dedupe).edges
        assert [(r["id"], r["callCount"]) for r in edges.collect()] == [("CALLS:OBSERVED:service:a->service:b", n)]


def test_edges_of_one_provenance(spark):
    t = bound.tables(spark, SMALL)
    every = bound.flat_edges(spark, t).filter("provenance = 'EXTRACTED'")
    some = bound.flat_edges(spark, t, "EXTRACTED")
    assert some.dtypes == every.dtypes
    assert sorted(map(str, some.collect())) == sorted(map(str, every.collect()))
    # All orders are observed calls, so that none are asked.
    assert "o_orderkey" not in some._jdf.queryExecution().optimizedPlan().toString()
    stale = bound.flat_edges(spark, t).filter("provenance = 'STALE'")
    assert sorted(map(str, bound.flat_edges(spark, t, "STALE").collect())) == sorted(map(str, stale.collect()))
