"""Joins that once sent a side that grows with the graph through the driver."""

import re

from strandgraph.operators import ask, ingest, lifecycle, traverse
from strandgraph.operators import graph as graphs
from strandgraph.operators.graph import Graph, materialise, side
from strandgraph.schema import EDGES, NODES, SPANS, table
from strandgraph.streaming import live


def graph(spark, n=6):
    """A ring of n services in compressed files, which look small however many they are."""
    nodes = [{"id": f"service:n{i}", "type": "ServiceNode", "name": f"n{i}"} for i in range(n)]
    edges = [{"id": f"CALLS:OBSERVED:service:n{i}->service:n{(i + 1) % n}", "source": f"service:n{i}", "target": f"service:n{(i + 1) % n}", "type": "CALLS", "provenance": "OBSERVED", "callCount": i, "signal": (i, i, 0.0, None, None, None)} for i in range(n)]
    return Graph(materialise(table(spark, NODES, nodes)), materialise(table(spark, EDGES, edges)))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_merge_sends_no_side_through_the_driver(spark):
    g = graph(spark)
    part = Graph(g.nodes.filter("id <> 'service:n5'"), g.edges.filter("source <> 'service:n1'"), g.now)
    merged = lifecycle.merge_snapshot(part, g.nodes, g.edges)
    assert sorted(r[0] for r in merged.edges.select("id").collect()) == sorted(r[0] for r in g.edges.select("id").collect())
    assert merged.nodes.count() == 6
    for df in (merged.nodes, merged.edges):
        assert "Join" in planned(df) and "Broadcast" not in planned(df)


def sent(df):
    """The columns of files of which each broadcast is made."""
    lines = planned(df).split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for j, x in enumerate(lines) if j > i and all(depth(y) > depth(line) for y in lines[i + 1 : j + 1])]
            out.append({c for x in below for m in re.findall(r"FileScan parquet \[([^\]]*)\]", x) for c in re.findall(r"(\w+)#", m)})
    return out


def test_questions_go_to_the_nodes(spark, monkeypatch):
    g = graph(spark)
    asked = spark.createDataFrame([(1, "why is n1 failing?"), (2, "n2 and service:n3"), (3, "")], "q int, question string")
    got = []
    for few in (graphs.FEW, 0):
        monkeypatch.setattr(graphs, "FEW", few)
        scores = ask.entity_scores(g.nodes, asked, "q", "question")
        got.append(sorted(tuple(r) for r in scores.collect()))
        assert not any("id" in columns for columns in sent(scores))
    assert got[0] == got[1] and [r[:2] for r in got[0]] == [(1, "service:n1"), (2, "service:n2"), (2, "service:n3")]


def test_a_small_side_is_sent_and_a_large_one_dealt(spark, monkeypatch):
    g = graph(spark)
    ids = materialise(g.nodes.select("id"))
    assert "Broadcast" in planned(g.edges.join(side(ids.withColumnRenamed("id", "source")), "source"))
    monkeypatch.setattr(graphs, "FEW", 5)
    assert "Broadcast" not in planned(g.edges.join(side(ids.withColumnRenamed("id", "source")), "source"))


def test_a_walk_ranks_edges_it_may_use(spark, monkeypatch):
    """Of a ring of 40 and two callers of one node, walks from that node use few edges."""
    g = graph(spark, 40)
    more = [{"id": f"CALLS:OBSERVED:service:{a}->service:{b}", "source": f"service:{a}", "target": f"service:{b}", "type": "CALLS", "provenance": "OBSERVED", "callCount": 1} for a, b in (("a", "root"), ("b", "a"))]
    nodes = [{"id": f"service:{n}", "type": "ServiceNode", "name": n} for n in ("a", "b", "root")]
    g = Graph(g.nodes.unionByName(table(spark, NODES, nodes)), g.edges.unionByName(table(spark, EDGES, more)))
    made, plain = [], traverse.materialise
    monkeypatch.setattr(traverse, "materialise", lambda df: (lambda out: (made.append(out.count()), out)[1])(plain(df)))
    for few in (graphs.FEW, 0):
        monkeypatch.setattr(traverse, "FEW", few)
        monkeypatch.setattr(graphs, "FEW", few)
        (r,) = traverse.longest_incoming_walks(g, ["service:root"]).collect()
        assert r["path"] == ["service:root", "service:a", "service:b"]
        assert max(made) <= 3


def test_no_list_of_nodes_goes_through_the_driver(spark):
    g = graph(spark)
    roots = spark.createDataFrame([("service:n1",), ("service:nowhere",)], "root string")
    for asked in (["service:n1", "service:nowhere"], roots):
        found = traverse.roots_frame(g, asked)
        assert [r[0] for r in found.collect()] == ["service:n1"]
        assert not any("id" in columns for columns in sent(found))
    for df in (g.owners(), g.call_sources(), g.scope()):
        assert df.count() == 6 and not sent(df)


def test_landed_spans_and_known_ids_are_dealt(spark, monkeypatch):
    """Children meet their parents, and what is new meets the ids of the graph, without either going through the driver."""
    g = graph(spark)
    rows = [{"service": "n1", "env": "unknown", "traceId": "t", "spanId": "1", "kind": 2, "attributes": {}}, {"service": "new", "env": "unknown", "traceId": "t", "spanId": "2", "parentSpanId": "1", "kind": 2, "attributes": {}}]
    spans = materialise(table(spark, SPANS, rows))
    pairs = materialise(ingest.caller_pairs(spans))
    joined, calls = [], ingest.calls
    monkeypatch.setattr(ingest, "calls", lambda *a: joined.append(calls(*a)) or joined[-1])
    for given in (None, pairs):
        done = ingest.land(spans, g, pairs=given)
        assert [r["id"] for r in done.nodes.collect()] == ["service:new"]
        assert [r["id"] for r in done.edges.collect()] == ["CALLS:OBSERVED:service:n1->service:new"]
        assert not any({"_svc", "_src"} & columns for columns in sent(joined[-1]))
        assert not any(columns == {"id"} for df in (done.nodes, done.edges) for columns in sent(df))


def test_edges_of_a_live_table_ask_declared_ids_by_key(spark, tmp_path):
    g = graph(spark)
    t = live.LiveTable(spark, str(tmp_path / "t"), parts=1)
    t.commit(0, {"edges": g.edges.filter("source = 'service:n1'"), "failing": g.nodes.select("id").withColumnRenamed("id", "service")})
    found = t.edges(g)
    assert [r["source"] for r in found.collect()] == ["service:n1"]
    assert not any(columns == {"id"} for columns in sent(found))
