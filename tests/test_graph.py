"""Operators on hand-built graphs of a few nodes."""

import pytest
from pyspark.sql import functions as F

from strandgraph.engine import Engine, NotFound
from strandgraph.operators import ask, divergence, lifecycle, policy, rootcause, traverse
from strandgraph.operators.graph import Graph
from strandgraph.schema import EDGES, INCIDENTS, NODES, table


def make_edge(kind, a, b, prov="EXTRACTED", spans=None, errors=0, p95=None, age=0.0, **more):
    mark = "" if prov == "EXTRACTED" else "OBSERVED:" if prov == "STALE" else f"{prov}:"
    signal = None if spans is None else (spans, errors, age, None if p95 is None else (p95, p95), None, None)
    return {"id": f"{kind}:{mark}{a}->{b}", "source": a, "target": b, "type": kind, "provenance": prov, "signal": signal, "callCount": spans, **more}


def make_graph(spark, nodes, edges):
    kinds = {"service": "ServiceNode", "database": "DatabaseNode", "file": "FileNode", "frontier": "FrontierNode", "infra": "InfraNode", "config": "ConfigNode", "symbol": "SymbolNode"}
    rows = []
    for n in nodes:
        n = {"id": n} if isinstance(n, str) else n
        rows.append({"type": kinds[n["id"].split(":")[0]], "name": n["id"].split(":", 1)[1], **n})
    return Graph(table(spark, NODES, rows), table(spark, EDGES, edges))


@pytest.fixture(scope="module")
def demo(spark):
    return make_graph(
        spark,
        ["service:a", {"id": "service:b", "dependencies": {"pg": "7.4.0"}}, {"id": "database:db", "engine": "postgresql", "engineVersion": "15", "host": "db"}, {"id": "file:b:db.js", "service": "b", "path": "db.js"}, "frontier:x"],
        [make_edge("CALLS", "service:a", "service:b"), make_edge("CONTAINS", "service:b", "file:b:db.js"), make_edge("CONNECTS_TO", "file:b:db.js", "database:db"), make_edge("CONNECTS_TO", "service:b", "database:db"), make_edge("CALLS", "frontier:x", "service:b", "OBSERVED", 5)],
    )


def test_blast_radius(demo):
    got = {r["node"]: (r["distance"], round(r["confidence"], 3)) for r in traverse.blast_radius(demo, ["database:db"]).collect()}
    assert got == {"file:b:db.js": (1, 0.5), "service:b": (1, 0.5), "service:a": (2, 0.25)}
    assert traverse.blast_radius(demo, ["database:none"]).count() == 0


def test_dependencies_skip_containment_and_frontiers(demo):
    got = {r["node"]: r["distance"] for r in traverse.transitive_dependencies(demo, ["service:a"], 3).collect()}
    assert got == {"service:b": 1, "database:db": 2}
    with pytest.raises(ValueError):
        traverse.transitive_dependencies(demo, ["service:a"], 11)


def test_best_edge_prefers_observed(spark):
    g = make_graph(spark, ["service:a", "service:b"], [make_edge("CALLS", "service:a", "service:b"), make_edge("CALLS", "service:a", "service:b", "OBSERVED", 1000)])
    r = traverse.blast_radius(g, ["service:b"]).first()
    assert r["provenance"] == "OBSERVED" and r["confidence"] == 1.0


def test_cycles_end_and_shortest_distance_wins(spark):
    e = [make_edge("CALLS", f"service:{a}", f"service:{b}") for a, b in ("ab", "bc", "ca", "ac", "dc")]
    g = make_graph(spark, [f"service:{x}" for x in "abcd"], e)
    got = {r["node"]: (r["distance"], "".join(p[-1] for p in r["path"])) for r in traverse.blast_radius(g, ["service:c"]).collect()}
    assert got == {"service:a": (1, "ca"), "service:b": (1, "cb"), "service:d": (1, "cd")}


def test_random_graphs_against_plain_bfs(spark):
    import random
    from collections import deque

    random.seed(5)
    names = [f"service:{i:02d}" for i in range(25)]
    pairs = {(random.choice(names), random.choice(names)) for _ in range(60)}
    pairs = {(a, b) for a, b in pairs if a != b}
    g = make_graph(spark, names, [make_edge("CALLS", a, b) for a, b in pairs])
    got = {(r["root"], r["node"]): r["distance"] for r in traverse.breadth_first(g, names[:6], "down", 4).collect()}
    want = {}
    for root in names[:6]:
        seen, queue = {root: 0}, deque([root])
        while queue:
            x = queue.popleft()
            for a, b in pairs:
                if a == x and b not in seen and seen[x] < 4:
                    seen[b] = seen[x] + 1
                    queue.append(b)
        want |= {(root, n): d for n, d in seen.items() if n != root}
    assert got == want


def test_observed_dependencies_roll_up_files(spark):
    g = make_graph(spark, ["service:api", "service:ledger", {"id": "file:api:src/pay.ts", "service": "api", "path": "src/pay.ts"}], [make_edge("CONTAINS", "service:api", "file:api:src/pay.ts"), make_edge("CALLS", "file:api:src/pay.ts", "service:ledger", "OBSERVED", 44)])
    deps, summary = traverse.observed_dependencies(g, ["service:api", "service:ledger"])
    assert [(r["origin"], r["target"]) for r in deps.collect()] == [("service:api", "service:ledger")]
    s = {r["origin"]: r for r in summary.collect()}
    assert s["service:ledger"]["observed"] and s["service:ledger"]["inboundVolume"] == 44 and s["service:api"]["observed"]


def incident(i, node, message="boom", **more):
    return {"id": i, "timestamp": f"2026-01-01T00:00:0{i[-1]}", "service": node.split(":")[1], "traceId": "t", "spanId": i, "errorMessage": message, "affectedNode": node, "attributes": {}, **more}


def test_root_cause_overload(spark):
    g = make_graph(
        spark,
        [f"service:{s}" for s in ("load", "front", "checkout", "shipping")],
        [make_edge("CALLS", "service:load", "service:front", "OBSERVED", 1000), make_edge("CALLS", "service:front", "service:checkout", "OBSERVED", 1000, 8), make_edge("CALLS", "service:checkout", "service:shipping", "STALE", 1000, 8, 4000.0)],
    )
    r = rootcause.root_cause(g, "service:front", table(spark, INCIDENTS, []))
    assert r["rootCauseNode"] == "service:load" and r["traversalPath"] == ["service:front", "service:load"]
    assert [c["classification"] for c in r["candidates"]] == ["primary-failure", "symptom-only"]


def test_root_cause_thrower_stays(spark):
    g = make_graph(spark, ["service:front", "service:payments"], [make_edge("CALLS", "service:front", "service:payments", "OBSERVED", 200, 5)])
    r = rootcause.root_cause(g, "service:front", table(spark, INCIDENTS, [incident("i1", "service:payments")]))
    assert r["rootCauseNode"] == "service:payments" and r["candidates"][0]["classification"] == "primary-failure"


def test_root_cause_compat(demo, spark):
    r = rootcause.root_cause(demo, "database:db", table(spark, INCIDENTS, []))
    assert r["rootCauseNode"] == "service:b" and "8.0.0" in r["fixRecommendation"]
    assert rootcause.root_cause(demo, "service:a", table(spark, INCIDENTS, [])) is None


def test_relate_and_find_path(demo):
    r = {(x["a"], x["b"]): x for x in traverse.relate(demo, [("service:a", "database:db"), ("database:db", "service:a"), ("service:a", "service:none")]).collect()}
    assert r["service:a", "database:db"]["direction"] == "a->b" and r["database:db", "service:a"]["direction"] == "b->a"
    assert r["service:a", "service:none"]["note"] == "node not found: service:none"
    assert r["service:a", "database:db"]["down"]["path"] == ["service:a", "service:b", "database:db"]


def test_host_mismatch_suppresses_halves(spark):
    g = make_graph(
        spark,
        [{"id": "service:orders", "dbConnectionTarget": "a.db:5432"}, {"id": "database:a.db", "engine": "postgresql", "host": "a.db"}, {"id": "database:b.db", "engine": "postgresql", "host": "b.db"}, "config:x.env"],
        [make_edge("CONFIGURED_BY", "service:orders", "config:x.env"), make_edge("CONNECTS_TO", "service:orders", "database:a.db"), make_edge("CONNECTS_TO", "service:orders", "database:b.db", "OBSERVED", 100)],
    )
    assert [r["type"] for r in divergence.divergences(g).collect()] == ["host-mismatch"]


def test_dead_probe_is_dampened(spark):
    literal = (None, None, None, None, None, "literal")
    g = make_graph(
        spark,
        ["service:cart", {"id": "file:cart:c.cs", "service": "cart"}, {"id": "database:bad", "engine": "redis", "host": "bad", "discoveredVia": "static"}, {"id": "database:good", "engine": "redis", "host": "good", "discoveredVia": "merged"}],
        [make_edge("CONNECTS_TO", "file:cart:c.cs", "database:bad", confidence=0.85, evidence=literal), make_edge("CONNECTS_TO", "file:cart:c.cs", "database:good", confidence=0.85, evidence=literal), make_edge("CONNECTS_TO", "file:cart:c.cs", "database:good", "OBSERVED", 200)],
    )
    found = {r["target"]: r["confidence"] for r in divergence.divergences(g).collect()}
    assert found == {"database:bad": 0.1}


def test_column_drift(spark):
    c = lambda n, *p: (n, list(p), 0.85, None)
    g = make_graph(spark, [{"id": "infra:sql-table:orders", "kind": "sql-table", "columns": [c("id", "EXTRACTED", "OBSERVED"), c("total", "EXTRACTED"), c("amount", "OBSERVED")]}, {"id": "infra:sql-table:quiet", "kind": "sql-table", "columns": [c("id", "EXTRACTED")]}], [])
    assert {(r["type"], r["column"]) for r in divergence.divergences(g).collect()} == {("missing-observed", "total"), ("missing-extracted", "amount")}


def test_policies(demo, spark):
    p = policy.load('{"version": 1, "policies": [{"id": "p1", "severity": "critical", "rule": {"type": "structural", "fromNodeType": "ServiceNode", "edgeType": "CONNECTS_TO", "toNodeType": "DatabaseNode"}}, {"id": "p2", "severity": "info", "rule": {"type": "ownership", "nodeType": "ServiceNode"}}, {"id": "p3", "severity": "warning", "rule": {"type": "compatibility"}}]}')
    found = {r["id"] for r in policy.evaluate(demo, p).collect()}
    assert found == {"p1:service:a", "p2:service:a", "p2:service:b", "p3:service:b:driver-engine:pg@7.4.0:postgresql@15"}
    c = policy.check(demo, p, {"kind": "add"}).first()
    assert not c["allowed"] and c["blocking"] == 1 and c["hypothetical"] == '{"kind": "add"}'
    with pytest.raises(ValueError):
        policy.load('{"version": 1, "policies": [{"id": "x", "severity": "info", "rule": {}}, {"id": "x", "severity": "info", "rule": {}}]}')


def test_diff_merge_promote_retire(demo, spark):
    changed = Graph(demo.nodes.filter("id <> 'frontier:x'"), demo.edges.withColumn("provenance", F.when(F.col("id") == "CALLS:service:a->service:b", "STALE").otherwise(F.col("provenance"))), demo.now)
    got = {(r["kind"], r["id"], r["change"]) for r in lifecycle.graph_diff(demo, changed).collect()}
    assert got == {("node", "frontier:x", "removed"), ("edge", "CALLS:service:a->service:b", "changed")}
    with pytest.raises(ValueError):
        lifecycle.merge_snapshot(demo, demo.nodes, demo.edges.withColumn("target", F.col("source")))
    merged = lifecycle.merge_snapshot(Graph(demo.nodes.filter("id <> 'service:a'"), demo.edges.filter("source <> 'service:a'"), demo.now), demo.nodes, demo.edges)
    assert merged.edges.count() == demo.edges.count() and merged.nodes.count() == demo.nodes.count()
    g = make_graph(spark, ["service:a", {"id": "service:b", "aliases": ["b.svc"]}, {"id": "frontier:b.svc", "host": "b.svc"}], [make_edge("CALLS", "service:a", "frontier:b.svc", "OBSERVED", 3), make_edge("CALLS", "service:a", "service:b", "OBSERVED", 4)])
    e = lifecycle.promote(g).edges.collect()
    assert [(r["id"], r["callCount"]) for r in e] == [("CALLS:OBSERVED:service:a->service:b", 7)]
    files = make_graph(spark, ["service:a", {"id": "file:a:x.py", "service": "a"}], [make_edge("CONTAINS", "service:a", "file:a:x.py", evidence=("x.py", None, None, None, None, None))])
    left = lifecycle.retire_missing(files, spark.createDataFrame([("y.py",)], "path string"))
    assert left.edges.count() == 0 and {r["id"] for r in left.nodes.collect()} == {"service:a"}


def test_upsert_revives_and_adds(spark):
    old = table(spark, EDGES, [make_edge("CALLS", "service:a", "service:b", "STALE", 10, 1)])
    fresh = table(spark, EDGES, [make_edge("CALLS", "service:a", "service:b", "OBSERVED", 5, 0), make_edge("CALLS", "service:a", "service:c", "OBSERVED", 1)])
    got = {r["id"]: (r["provenance"], r["callCount"], r["signal"]["errorCount"]) for r in lifecycle.upsert(old, fresh).collect()}
    assert got == {"CALLS:OBSERVED:service:a->service:b": ("OBSERVED", 15, 1), "CALLS:OBSERVED:service:a->service:c": ("OBSERVED", 1, 0)}


def test_engine(demo, spark):
    e = Engine(spark, {"default": demo})
    assert e.search("SERVICE:a").count() == 1
    assert e.ask("what breaks if b dies")["intent"] == "blast-radius"
    assert [*e.ask("what does db depend on")["sections"]] == ["blast"]
    told = ask.ask(demo, "why is db failing", table(spark, INCIDENTS, [incident("i1", "database:db")]).withColumn("ordinal", F.lit(1)))
    assert (told["entities"][0], told["scope"], [*told["sections"]][:3]) == ("database:db", "node", ["root-cause", "incidents", "blast"])
    assert e.ask("who calls")["scope"] is None and [*e.ask("hello")["sections"]] == ["shape", "busiest", "divergence"]
    with pytest.raises(NotFound):
        e.node("service:none")
    with pytest.raises(NotFound):
        e.graph("other")


def walks_by_hand(pairs, root, depth=5):
    """The longest simple walk against the edges, the smallest of equals."""
    best = [root]

    def go(path):
        nonlocal best
        if (-len(path), path) < (-len(best), best):
            best = path
        if len(path) <= depth:
            for a, b in pairs:
                if b == path[-1] and a not in path:
                    go([*path, a])

    go([root])
    return best


@pytest.mark.parametrize("beam", [1, 3, 64])
def test_longest_walks_like_all_walks(spark, beam):
    import random

    rng = random.Random(beam)
    names = [f"service:{i:02d}" for i in range(14)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(26)}
    pairs = {(a, b) for a, b in pairs if a != b}
    g = make_graph(spark, names, [make_edge("CALLS", a, b) for a, b in pairs])
    got = {r["root"]: r["path"] for r in traverse.longest_incoming_walks(g, names, beam=beam).collect()}
    assert got == {n: walks_by_hand(pairs, n) for n in names}


def test_longest_walk_through_hubs(spark, monkeypatch):
    """Three layers of sixty, each joined with all of the next: 216,000 walks, of which few are made."""
    layers = [["service:root"], *([f"service:{c}{i:02d}" for i in range(60)] for c in "abc")]
    pairs = [(x, y) for near, far in zip(layers[:-1], layers[1:], strict=True) for y in near for x in far]
    g = make_graph(spark, [n for layer in layers for n in layer], [make_edge("CALLS", x, y) for x, y in pairs])
    made, plain = [], traverse.materialise
    monkeypatch.setattr(traverse, "materialise", lambda df: (lambda out: (made.append(out.count()), out)[1])(plain(df)))
    (r,) = traverse.longest_incoming_walks(g, ["service:root"]).collect()
    assert r["path"] == ["service:root", "service:a00", "service:b00", "service:c00"]
    assert max(made) <= len(pairs)


def test_causes_of_many_roots(spark):
    names = [f"service:{s}" for s in ("load", "front", "checkout", "shipping", "payments", "cart", "x", "y")]
    edges = [
        make_edge("CALLS", "service:load", "service:front", "OBSERVED", 1000), make_edge("CALLS", "service:front", "service:checkout", "OBSERVED", 1000, 8),
        make_edge("CALLS", "service:checkout", "service:shipping", "STALE", 1000, 8, 4000.0), make_edge("CALLS", "service:front", "service:payments", "OBSERVED", 200, 5),
        make_edge("CALLS", "service:cart", "service:x", "STALE", 30), make_edge("CALLS", "service:x", "service:y", "STALE", 20),
    ]
    told = table(spark, INCIDENTS, [incident("i1", "service:payments"), incident("i2", "service:cart"), incident("i3", "service:y")])
    got = {r["root"]: r for r in rootcause.navigated_causes(make_graph(spark, names, edges), names, told).collect()}
    assert {k: (r["node"], r["phase"]) for k, r in got.items()} == {
        "service:front": ("service:load", "victim"), "service:checkout": ("service:load", "victim"), "service:payments": ("service:payments", "dead-end"),
        "service:cart": ("service:y", "dead-end"), "service:y": ("service:y", "dead-end"),
    }
    assert got["service:checkout"]["path"] == ["service:checkout", "service:front", "service:load"]
    assert got["service:cart"]["path"] == ["service:cart", "service:x", "service:y"] and got["service:cart"]["candidates"][1]["classification"] == "symptom-only"
