"""Steps whose rows or bytes once grew beyond what they have to tell."""

from strandgraph.operators import divergence, lifecycle
from strandgraph.operators.graph import Graph
from strandgraph.schema import EDGES, NODES, table


def edge(a, b, kind="CALLS", provenance="OBSERVED", **more):
    mark = "" if provenance == "EXTRACTED" else f"{provenance}:"
    return {"id": f"{kind}:{mark}{a}->{b}", "source": a, "target": b, "type": kind, "provenance": provenance, **more}


def test_diff_sends_digests_of_what_is_equal(spark):
    signal = lambda n, hist: (n, 0, 0.0, None, hist, None)
    before = [edge(f"service:a{i}", "service:b", callCount=i, signal=signal(i, {1: 2, 3: 4})) for i in range(6)]
    after = [dict(r) for r in before[1:]] + [edge("service:new", "service:b")]
    after[0]["signal"] = signal(1, {3: 4, 1: 2})
    after[1] |= {"callCount": 9, "provenance": "STALE"}
    after[2]["signal"] = signal(3, {1: 2, 3: 5})
    b, a = table(spark, EDGES, before), table(spark, EDGES, after)
    d = lifecycle.diff(b, a)
    got = {r["id"]: (r["change"], r["fields"] and tuple(r["fields"])) for r in d.collect()}
    assert got == {before[0]["id"]: ("removed", None), after[-1]["id"]: ("added", None), before[2]["id"]: ("changed", ("provenance", "callCount")), before[3]["id"]: ("changed", ("signal",))}
    # No join takes whole rows of both sides that have not been found to differ.
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "LeftSemi" in plan


def test_stitch_sends_twins_of_declared_edges_only(spark, monkeypatch):
    nodes = [{"id": f"service:{n}", "type": "ServiceNode", "name": n} for n in "abcd"]
    edges = [edge("service:a", "service:b", provenance="EXTRACTED"), edge("service:b", "service:c", provenance="EXTRACTED"), edge("service:b", "service:d", provenance="EXTRACTED"), edge("service:b", "service:d", provenance="OBSERVED")]
    edges += [edge(f"service:x{i}", "service:d") for i in range(50)]
    cut, keep = [], lifecycle.materialise
    monkeypatch.setattr(lifecycle, "materialise", lambda df: cut.append(keep(df)) or cut[-1])
    starts = spark.createDataFrame([("service:a",)], "service string")
    found = lifecycle.stitch(Graph(table(spark, NODES, nodes), table(spark, EDGES, edges)), starts)
    assert sorted(r["id"] for r in found.collect()) == ["CALLS:INFERRED:service:a->service:b", "CALLS:INFERRED:service:b->service:c"]
    assert [c.count() for c in cut] == [3, 2]


KINDS = ("missing-extracted", "missing-observed", "version-mismatch", "host-mismatch", "compat-violation")


def mixed(spark):
    """A graph with divergences of every kind: some told by a host mismatch, one of dead code."""
    nodes = [{"id": "service:a", "type": "ServiceNode", "name": "a", "dbConnectionTarget": "one.db:5432", "dependencies": {"pg": "7.0.0", "request": "2.0.0"}}, {"id": "service:b", "type": "ServiceNode", "name": "b"}, {"id": "config:a", "type": "ConfigNode", "name": "a"}]
    nodes += [{"id": f"database:{n}.db", "type": "DatabaseNode", "name": n, "engine": "postgresql", "engineVersion": "15", "host": f"{n}.db"} for n in ("one", "two", "three")]
    columns = [("id", ["EXTRACTED", "OBSERVED"], 0.8, None), ("x", ["EXTRACTED"], 0.8, None), ("y", ["OBSERVED"], 0.9, None)]
    nodes += [{"id": "infra:sql-table:t", "type": "InfraNode", "name": "t", "kind": "sql-table", "columns": columns}]
    literal = (None, None, None, None, None, "literal")
    edges = [edge("service:a", "config:a", "CONFIGURED_BY", "EXTRACTED", confidence=0.8), edge("service:a", "service:b", provenance="EXTRACTED", confidence=0.8), edge("service:b", "service:a", provenance="EXTRACTED", confidence=0.8), edge("service:b", "service:a"), edge("service:b", "infra:sql-table:t")]
    edges += [edge("service:a", "database:one.db", "CONNECTS_TO", "EXTRACTED", confidence=0.8), edge("service:a", "database:two.db", "CONNECTS_TO"), edge("service:b", "database:three.db", "CONNECTS_TO", "EXTRACTED", confidence=0.8, evidence=literal), edge("service:b", "database:two.db", "CONNECTS_TO")]
    return Graph(table(spark, NODES, nodes), table(spark, EDGES, edges))


def test_divergences_of_some_types_are_those_of_all(spark):
    g = mixed(spark)
    every = [tuple(r) for r in divergence.divergences(g).collect()]
    assert {r[0] for r in every} == {*KINDS} and 0.1 in {r[7] for r in every}
    for types in ({k} for k in KINDS), ({*KINDS} - {"missing-extracted"},), (set(),):
        for some in types:
            assert [tuple(r) for r in divergence.divergences(g, types=some).collect()] == [r for r in every if not some or r[0] in some]
    undeclared = ("CALLS", "service:b", "infra:sql-table:t")
    seen = lambda **more: {(r["type"], r["source"], r["target"]) for r in divergence.buckets(g, **more).collect()}
    assert undeclared in seen() and undeclared not in seen(declared_only=True)


def test_kinds_that_are_not_asked_for_are_not_looked_for(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("not asked for")

    for name in ("buckets", "missing", "compatibility", "column_drift"):
        monkeypatch.setattr(divergence, name, never)
    assert [r["source"] for r in divergence.divergences(mixed(spark), types={"host-mismatch"}).collect()] == ["service:a"]
