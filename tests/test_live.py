"""Live tables, streams over many micro-batches, timers, monitors and polling."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import ingest
from strandgraph.operators.graph import Graph
from strandgraph.schema import EDGES, INCIDENTS, NODES, SPANS, conform, empty, struct, table
from strandgraph.sources import otlp, polling
from strandgraph.streaming import live, pipelines, timers


def node(i, **more):
    return {"id": f"service:n{i}", "type": "ServiceNode", "name": f"n{i}", **more}


def edge(i, n=1):
    return {"id": f"CALLS:OBSERVED:service:n{i}->service:z", "source": f"service:n{i}", "target": "service:z", "type": "CALLS", "provenance": "OBSERVED", "callCount": n, "signal": (n, 0, 0.0, None, None, None)}


def test_commit_writes_what_it_touches(spark, tmp_path):
    t = live.LiveTable(spark, str(tmp_path / "t"), parts=16)
    t.commit(0, {"edges": table(spark, EDGES, [edge(i) for i in range(400)]), "nodes": table(spark, NODES, [node(i) for i in range(400)])})
    whole, first = t.folder.size("data/edges"), t.manifest(0)
    t.commit(1, {"edges": table(spark, EDGES, [edge(7, 5)])})
    second = t.manifest(1)
    assert t.folder.size("data/edges") - whole < whole / 8
    assert len({k for k in first if first[k] != second[k]}) == 1
    got = {r["id"]: r["callCount"] for r in t.read().collect()}
    assert len(got) == 400 and got[edge(7)["id"]] == 6 and got[edge(8)["id"]] == 1
    t.commit(1, {"edges": table(spark, EDGES, [edge(7, 5)])})  # a replayed batch changes nothing
    assert t.manifest(1) == second


def test_old_generations_go(spark, tmp_path):
    t = live.LiveTable(spark, str(tmp_path / "t"), parts=2, keep=2)
    for b in range(5):
        t.commit(b, {"nodes": table(spark, NODES, [node(i) for i in range(4 * b, 4 * b + 8)])})
    assert t.batches() == [3, 4] and t.read("nodes").count() == 24
    named = {(g, p) for b in (3, 4) for (_, p), g in t.manifest(b).items()}
    there = {(g, int(p.removeprefix("_part="))) for g in t.folder.names("data/nodes") for p in t.folder.names(f"data/nodes/{g}") if p.startswith("_part=")}
    assert there == named


def test_a_batch_that_died_is_done_again(spark, tmp_path, monkeypatch):
    t = live.LiveTable(spark, str(tmp_path / "t"), parts=4)
    t.commit(0, {"nodes": table(spark, NODES, [node(1)])})

    def dies(*_):
        raise RuntimeError("lost")

    fresh = {"nodes": table(spark, NODES, [node(2)])}
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(live.LiveTable, "_events", staticmethod(dies))
        t.commit(1, fresh)
    assert t.current() == 0 and [r["id"] for r in t.read("nodes").collect()] == ["service:n1"]
    t.commit(1, fresh)
    assert sorted(r["id"] for r in t.read("nodes").collect()) == ["service:n1", "service:n2"]
    assert len([g for g in t.folder.names("data/nodes") if g.startswith("g-1-")]) == 1


def test_changes(spark, tmp_path):
    t = live.LiveTable(spark, str(tmp_path / "t"), parts=4)
    t.commit(0, {"nodes": table(spark, NODES, [node(i) for i in range(6)]), "edges": table(spark, EDGES, [edge(1)])})
    t.commit(1, {"nodes": table(spark, NODES, [node(2, owner="a"), node(9)])})
    gone = spark.createDataFrame([("service:n3",)], "id string")
    t.commit(2, {"nodes": live.removal(gone, NODES), "edges": live.removal(spark.createDataFrame([(edge(1)["id"],)], "id string"), EDGES)})
    got = {(r["batch"], r["event"], r["id"]): r["fields"] for r in t.changes().filter("batch > 0").collect()}
    # A null owner is less than any other, and of two values the lesser one stays.
    assert got == {(1, "node-added", "service:n9"): None, (2, "node-removed", "service:n3"): None, (2, "edge-removed", edge(1)["id"]): None}
    assert t.read().count() == 0 and t.read("nodes").count() == 6
    violations = spark.createDataFrame([("v1", "bad")], "id string, message string")
    told = live.feed(t, violations=violations).filter("event = 'policy-violation'").first()
    assert (told["id"], json.loads(told["payload"])) == ("v1", {"message": "bad"})


def test_nodes_merge_in_any_order(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        rows.append({"id": f"infra:sql-table:t{i % 4}", "type": "InfraNode", "name": f"t{i % 4}", "columns": [(f"c{rng.randrange(3)}", [rng.choice(["OBSERVED", "EXTRACTED"])], rng.choice([0.5, 0.9]), None)]})
        rows.append({"id": f"symbol:a:f#s{i % 3}", "type": "SymbolNode", "span": (rng.randrange(90), 99)})
    whole = live.merge_nodes(empty(spark, NODES), table(spark, NODES, rows))
    rng.shuffle(rows)
    parts = empty(spark, NODES)
    for k in range(0, len(rows), 30):
        parts = live.merge_nodes(parts, table(spark, NODES, rows[k : k + 30]))
    key = lambda df: sorted((r["id"], str(r["columns"]), str(r["span"])) for r in df.collect())
    assert key(whole) == key(parts) and whole.count() == 7


def request(service, spans, env=None):
    attributes = [{"key": "service.name", "value": {"stringValue": service}}] + ([{"key": "deployment.environment", "value": {"stringValue": env}}] if env else [])
    return json.dumps({"resourceSpans": [{"resource": {"attributes": attributes}, "scopeSpans": [{"spans": spans}]}]})


def span(i, parent=None, kind=2, attributes=None, at=None, status=0, trace="t"):
    start = 1_700_000_000_000_000_000 + (at if at is not None else i) * 1_000_000_000
    given = [{"key": k, "value": {"stringValue": v}} for k, v in (attributes or {}).items()]
    return {"traceId": trace, "spanId": str(i), "parentSpanId": str(parent) if parent else "", "name": "op", "kind": kind, "startTimeUnixNano": str(start), "endTimeUnixNano": str(start + 1_000_000), "attributes": given, "status": {"code": status}}


LINES = [
    request("parent-svc", [span(1, attributes={"code.file.path": "/x/a.py", "code.line.number": "3", "code.function.name": "f"})], "prod"),
    request("child-svc", [span(2, parent=1)]),
    request("leaf", [span(3, parent=2, status=2)]),
    request("child-svc", [span(2, parent=1)]),
    *(request("caller", [span(10 + k, kind=3, attributes={"server.address": "peer", "http.response.status_code": "404"})]) for k in range(5)),
]


def test_split_traces(spark, tmp_path):
    """Three files, children before parents, one a micro-batch: what a batch gives, duplicates and bursts across batches included."""
    order = [1, 2, 4, 5, 0, 3, 6, 7, 8]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text("\n".join(LINES[i] for i in order[3 * k : 3 * k + 3]))
        time.sleep(0.02)
    g = Graph(table(spark, NODES, [{"id": "service:leaf", "type": "ServiceNode", "name": "leaf"}, {"id": "service:db", "type": "ServiceNode", "name": "db"}]), table(spark, EDGES, [{"id": "CALLS:service:leaf->service:db", "source": "service:leaf", "target": "service:db", "type": "CALLS", "provenance": "EXTRACTED"}]))
    t = live.LiveTable(spark, str(tmp_path / "live"), parts=2, feed=False)
    pipelines.ingest_stream(spark, str(source), t, g, str(tmp_path / "cp"), str(tmp_path / "incidents"), once=True, max_files=1, lines=True, dedupe=True).awaitTermination()
    batch = ingest.land(otlp.flatten(otlp.read_requests(spark, str(source), lines=True)), g, dedupe=True)
    key = lambda df: sorted((r["id"], r["callCount"]) for r in df.collect())
    assert key(t.edges(g)) == key(batch.edges)
    assert ("CALLS:OBSERVED:file:parent-svc:x/a.py->service:child-svc", 1) in key(batch.edges) and ("CALLS:INFERRED:service:leaf->service:db", None) in key(batch.edges)
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    assert ids(t.read_nodes()) == ids(batch.nodes)
    told = spark.read.schema(INCIDENTS).json(str(tmp_path / "incidents"))
    assert ids(told) == ids(batch.incidents) == ["t:14", "t:3"]
    assert t.read("failures").count() == 0


def test_waiting_state_is_dropped(spark, tmp_path):
    """Spans wait for partners for a second here; those of earlier runs are gone, and a parent that comes later finds nobody."""
    def run(k, i, parent):
        table(spark, SPANS, [{"service": f"s{i}", "env": "unknown", "traceId": "t", "spanId": str(i), "parentSpanId": parent, "kind": 2, "attributes": {}}]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = pipelines.with_callers(spark.readStream.schema(SPANS).parquet(str(tmp_path / "in")), window="1 second")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sum(o["numRowsTotal"] for o in q.recentProgress[-1]["stateOperators"])

    left = []
    for k, (i, parent) in enumerate([(2, "1"), (5, None), (6, None), (1, None)]):
        left.append(run(k, i, parent))
        time.sleep(3)
    assert max(left) <= 4
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter("span is not null").count() == 4 and out.filter("pair is not null").count() == 0


def test_stale_timers(spark, tmp_path):
    hour = 3600
    seen = [("a", "CALLS", 0), ("a", "CALLS", hour // 2), ("a", "CALLS", 5 * hour), ("b", "OTHER", 0), ("b", "OTHER", 20 * hour), ("c", "CALLS", 6 * hour), ("z", "OTHER", 30 * hour)]
    rows = spark.createDataFrame(seen, "id string, type string, s long").select("id", "type", F.timestamp_seconds(1_700_000_000 + F.col("s")).alias("ts"))
    got = timers.drain_stale(spark, rows, str(tmp_path), slices=4).select("edgeId", F.unix_seconds("lastObserved").alias("s")).collect()
    assert sorted((r["edgeId"], r["s"] - 1_700_000_000) for r in got) == [("a", hour // 2), ("a", 5 * hour), ("c", 6 * hour)]


def test_alarms_once(spark, tmp_path):
    def land(*keys):
        spark.createDataFrame([(k, k.upper()) for k in keys], "key string, text string").write.mode("append").parquet(str(tmp_path / "in"))
        return sorted(r["key"] for r in timers.drain_alarms(spark, str(tmp_path / "in"), str(tmp_path)).collect())

    assert land("a", "b", "a") == ["a", "b"]
    assert land("b", "c") == ["a", "b", "c"]
    assert land("a") == ["a", "b", "c"]


def test_poll_asks_again_after_a_failure(spark, tmp_path):
    clock, broken, log = tmp_path / "clock", tmp_path / "broken", tmp_path / "log"
    log.mkdir()

    def fetch(account, since, until, broken=str(broken), log=str(log)):
        import os
        import uuid

        if os.path.exists(broken) and account == "two":
            raise RuntimeError("provider is down")
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{account} {since} {until}")
        yield account, since, until

    provider = polling.source("poll-test", "account string, since string, until string", fetch, ["one", "two"], "00", clock=lambda: clock.read_text())

    def tick(at):
        clock.write_text(at)
        stream = polling.poll_stream(spark, provider)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination()

    tick("10")
    broken.write_text("")
    with pytest.raises(Exception, match="provider is down"):
        tick("20")
    broken.unlink()
    tick("30")
    rows = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # The failed range is asked for again, then what followed; no range is asked for twice in what is kept.
    assert [r for r in rows if r[0] == "two"][0] == ("two", "00", "10")
    for account in ("one", "two"):
        mine = [r[1:] for r in rows if r[0] == account]
        assert mine[0][0] == "00" and mine[-1][1] >= "20" and all(a[1] == b[0] for a, b in zip(mine[:-1], mine[1:], strict=True))


QUESTIONS = [
    ("Why is checkout failing?", "root-cause"), ("root cause of the 503", "root-cause"), ("what breaks if orders.db goes away", "blast-radius"), ("who calls billing", "blast-radius"),
    ("where does the code disagree with production", "divergence"), ("recent errors on cart", "incidents"), ("what does it talk to at runtime", "observed"), ("what does cart depend on", "dependencies"), ("hello there", "overview"),
]


def test_written_questions(spark):
    from strandgraph.operators import ask

    df = spark.createDataFrame(QUESTIONS, "q string, want string")
    assert [(r["q"], r["got"]) for r in df.select("q", ask.intent(F.col("q")).alias("got")).collect()] == QUESTIONS
    words = df.limit(1).select(ask.tokens(F.lit("Why does the orderService call checkout-api at runtime?")).alias("t")).first()["t"]
    assert words == ["order", "checkout", "api"]
    assert conform(df, struct("q string")).columns == ["q"]


def test_large_tables_are_merged_some_partitions_at_a_time(spark, tmp_path, monkeypatch):
    """The same rows and events, however many partitions are merged at once; edges that no fresh one meets are not joined."""
    steps = [
        {"edges": table(spark, EDGES, [edge(i) for i in range(60)]), "nodes": table(spark, NODES, [node(i) for i in range(20)])},
        {"edges": table(spark, EDGES, [edge(i, 3) for i in range(50, 90)])},
        {"edges": live.removal(spark.createDataFrame([(edge(i)["id"],) for i in range(40, 60)], "id string"), EDGES).unionByName(table(spark, EDGES, [edge(41, 9), edge(99)]))},
    ]
    seen = []
    for at_once in (live.AT_ONCE, 0):
        monkeypatch.setattr(live, "AT_ONCE", at_once)
        merges, merge = [], live.merge_edges
        counted = lambda old, fresh, merge=merge, merges=merges: merges.append(old.count()) or merge(old, fresh)
        kinds = live.GRAPH_KINDS | {"edges": live.Kind(EDGES, "id", counted, "edge-added", None, "edge-removed")}
        t = live.LiveTable(spark, str(tmp_path / str(at_once)), parts=3, kinds=kinds)
        for b, fresh in enumerate(steps):
            t.commit(b, fresh)
        assert not t.folder.names("fresh") and sum(merges) == 10 + 1
        assert (len(merges) > 6) == (at_once == 0)
        events = sorted((r["batch"], r["event"], r["id"]) for r in t.changes().collect())
        seen.append((sorted((r["id"], r["callCount"]) for r in t.read().collect()), t.read("nodes").count(), events))
    assert seen[0] == seen[1]
    calls = {edge(i)["id"]: n for i, n in [*((i, 1) for i in range(40)), *((i, 3) for i in range(60, 90)), (41, 9), (99, 1)]}
    assert dict(seen[0][0]) == calls and seen[0][1] == 20
    assert [e for e in seen[0][2] if e[0] == 2] == sorted([(2, "edge-removed", edge(i)["id"]) for i in range(40, 60) if i != 41] + [(2, "edge-added", edge(99)["id"])])
