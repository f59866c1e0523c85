"""Spans, OTLP, incidents and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from strandgraph.functions import latency, text
from strandgraph.operators import incidents, ingest
from strandgraph.operators.graph import Graph
from strandgraph.schema import EDGES, INCIDENTS, NODES, SPANS, empty, table
from strandgraph.sources import connectors, otlp, otlp_proto
from strandgraph.streaming import pipelines
from strandgraph.streaming.live import LiveTable


def span(i, kind=3, service="a", attributes=None, **more):
    return {"service": service, "env": "unknown", "traceId": "t", "spanId": i, "name": "s", "kind": kind, "startTimeUnixNano": 1_700_000_000_000_000_000 + int(i) * 1_000_000_000, "durationNanos": 5_000_000, "statusCode": 0, "attributes": attributes or {}, **more}


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [{"id": "service:a", "type": "ServiceNode", "name": "a"}, {"id": "service:b", "type": "ServiceNode", "name": "b", "aliases": ["b.svc"]}]
    return Graph(table(spark, NODES, nodes), empty(spark, EDGES))


def test_dispatch(spark, graph):
    rows = [
        span("1", attributes={"server.address": "b.svc"}),
        span("2", attributes={"server.address": "nowhere"}),
        span("3", dbSystem="postgresql", dbTable="orders", attributes={"server.address": "pg.host"}),
        span("4", kind=4, messagingSystem="kafka", messagingDestination="orders"),
        span("5", kind=5, service="b", messagingSystem="kafka", messagingDestination="orders"),
        span("6", attributes={"server.address": "localhost"}),
        span("7", attributes={"server.address": "b", "code.file.path": "/src/pay.py", "code.line.number": "4", "http.response.status_code": "503"}),
        span("8", kind=2, service="b", parentSpanId="6"),
    ]
    got = {(r["type"], r["source"], r["target"]): (r["callCount"], r["signal"]["errorCount"]) for r in ingest.observed_edges(table(spark, SPANS, rows), graph).collect()}
    assert got == {
        ("CALLS", "service:a", "service:b"): (2, 0),
        ("CALLS", "service:a", "frontier:nowhere"): (1, 0),
        ("CONNECTS_TO", "service:a", "database:pg.host"): (1, 0),
        ("CALLS", "service:a", "infra:sql-table:orders"): (1, 0),
        ("PUBLISHES_TO", "service:a", "infra:kafka-topic:orders"): (1, 0),
        ("CONSUMES_FROM", "service:b", "infra:kafka-topic:orders"): (1, 0),
        ("CALLS", "file:a:src/pay.py", "service:b"): (1, 1),
    }


def test_land(spark):
    nodes = [
        {"id": "service:Shop", "type": "ServiceNode", "name": "Shop", "discoveredVia": "static"},
        {"id": "service:b", "type": "ServiceNode", "name": "b"},
        {"id": "service:c", "type": "ServiceNode", "name": "c"},
        {"id": "file:Shop:src/pay.py", "type": "FileNode", "service": "Shop", "path": "src/pay.py"},
        {"id": "symbol:Shop:src/pay.py#charge", "type": "SymbolNode", "service": "Shop", "relPath": "src/pay.py", "qualname": "charge", "span": (1, 9)},
        {"id": "route:shop:POST /pay/:id", "type": "RouteNode", "service": "shop", "method": "POST", "pathTemplate": "/pay/:id"},
        {"id": "infra:sql-table:orders", "type": "InfraNode", "name": "orders", "kind": "sql-table", "columns": [("id", ["EXTRACTED"], 0.85, None)]},
        {"id": "frontier:gone", "type": "FrontierNode", "name": "gone", "host": "gone"},
    ]
    edges = [{"id": "CALLS:service:Shop->service:c", "source": "service:Shop", "target": "service:c", "type": "CALLS", "provenance": "EXTRACTED"}]
    g = Graph(table(spark, NODES, nodes), table(spark, EDGES, edges))
    at = lambda line, f: {"server.address": "b", "code.file.path": "/srv/src/pay.py", "code.line.number": line, "code.function.name": f}
    rows = [
        span("1", service="shop", attributes=at("4", "charge"), statusCode=2),
        span("2", service="shop", attributes=at("40", "refund")),
        span("3", service="shop", kind=2, name="s", httpRoute="/pay/{x}", httpMethod="post"),
        span("4", service="shop", dbSystem="postgresql", dbTable="orders", dbColumns=["id", "total"], attributes={"server.address": "pg"}),
        span("5", service="new", attributes={"server.address": "gone"}, env="prod"),
        span("6", service="new", kind=2, graphqlOperationName="Cart", graphqlOperationType="QUERY", env="prod"),
        span("7", service="new", kind=2, rpcSystem="grpc", rpcService="p.S", rpcMethod="M", env="prod"),
        span("8", service="new", kind=2, websocketChannel="/ws", env="prod"),
        span("9", service="new", kind=3, websocketChannel="/ws", rpcSystem="grpc", rpcService="p.S", rpcMethod="M", attributes={"server.address": "b"}, env="prod"),
        *(span(str(i), attributes={"server.address": "b", "http.response.status_code": "404"}, service="b2") for i in range(20, 25)),
    ]
    done = ingest.land(table(spark, SPANS, rows), g)
    made = {r["id"]: r for r in done.nodes.collect()}
    assert {*made} == {"service:new:prod", "service:b2", "symbol:Shop:src/pay.py#refund", "database:pg", "infra:sql-table:orders", "frontier:gone", "graphql:new:query Cart", "grpc:p.S/M", "ws:new:/ws"}
    assert [(c["name"], c["provenances"], c["confidence"]) for c in made["infra:sql-table:orders"]["columns"]] == [("id", ["EXTRACTED", "OBSERVED"], 0.9), ("total", ["OBSERVED"], 0.9)]
    assert made["frontier:gone"]["lastObserved"] and made["service:new:prod"]["env"] == "prod" and made["database:pg"]["engine"] == "postgresql"
    got = {r["id"]: r["callCount"] for r in done.edges.collect()}
    assert got == {
        "CALLS:OBSERVED:symbol:Shop:src/pay.py#charge->service:b": 1,
        "CALLS:OBSERVED:symbol:Shop:src/pay.py#refund->service:b": 1,
        "CONTAINS:OBSERVED:service:Shop->file:Shop:src/pay.py": None,
        "CONTAINS:OBSERVED:file:Shop:src/pay.py->symbol:Shop:src/pay.py#refund": None,
        "CONTAINS:OBSERVED:service:shop->route:shop:POST /pay/:id": 1,
        "CONNECTS_TO:OBSERVED:service:Shop->database:pg": 1,
        "CALLS:OBSERVED:service:Shop->infra:sql-table:orders": 1,
        "CALLS:OBSERVED:service:new:prod->frontier:gone": 1,
        "CONTAINS:OBSERVED:service:new:prod->graphql:new:query Cart": 1,
        "CONTAINS:OBSERVED:service:new:prod->grpc:p.S/M": 1,
        "CONNECTS_TO:OBSERVED:service:new:prod->ws:new:/ws": 1,
        "CALLS:OBSERVED:service:new:prod->service:b": 1,
        "CALLS:OBSERVED:service:b2->service:b": 5,
        "CALLS:INFERRED:service:Shop->service:c": None,
    }
    told = {r["id"]: r for r in done.incidents.collect()}
    assert {*told} == {"t:1", "t:24"} and told["t:1"]["affectedNode"] == "symbol:Shop:src/pay.py#charge"
    assert (told["t:24"]["incidentCount"], told["t:24"]["errorMessage"]) == (5, "5 consecutive HTTP 404 responses to b")


OTLP = {
    "resourceSpans": [
        {
            "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "service-a"}}, {"key": "deployment.environment", "value": {"stringValue": "prod"}}]},
            "scopeSpans": [{"spans": [{"traceId": "t1", "spanId": "s1", "parentSpanId": "", "name": "GET /x", "kind": 2, "startTimeUnixNano": "1000000000", "endTimeUnixNano": "1050000000", "attributes": [{"key": "http.response.status_code", "value": {"intValue": "500"}}], "status": {"code": 0}}]}],
        },
        {"resource": {"attributes": []}, "scopeSpans": [{"spans": [{"traceId": "t1", "spanId": "s2", "parentSpanId": "s1", "name": "pg.query", "kind": 3, "startTimeUnixNano": "1010000000", "endTimeUnixNano": "1040000000", "attributes": [{"key": "db.system", "value": {"stringValue": "postgresql"}}, {"key": "db.statement", "value": {"stringValue": "SELECT id, total FROM orders WHERE x = 1"}}], "status": {"code": 2}, "events": [{"name": "exception", "attributes": [{"key": "exception.message", "value": {"stringValue": "boom"}}]}]}]}]},
    ]
}


def test_otlp_flatten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text(json.dumps(OTLP))
    a, b = sorted(otlp.flatten(otlp.read_requests(spark, str(tmp_path / "in"))).collect(), key=lambda r: r["spanId"])
    assert (a["service"], a["env"], a["durationNanos"], a["parentSpanId"]) == ("service-a", "prod", 50_000_000, None)
    assert b["service"] == "unidentified" and not b["resourceServiceNamePresent"]
    assert (b["dbTable"], b["dbColumns"], b["exception"]["message"]) == ("orders", ["id", "total", "x"], "boom")


def test_stream_equals_batch(spark, tmp_path, graph):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text(json.dumps(OTLP))
    (source / "2.json").write_text(json.dumps(OTLP))
    edges = LiveTable(spark, str(tmp_path / "edges"))
    pipelines.ingest_stream(spark, str(source), edges, graph, str(tmp_path / "cp"), str(tmp_path / "incidents"), once=True, max_files=1).awaitTermination()
    landed = ingest.land(otlp.flatten(otlp.read_requests(spark, str(source))), graph)
    batch = landed.edges
    row = lambda df: sorted((r["id"], r["type"], r["name"], str(r["columns"])) for r in df.collect())
    assert row(edges.read_nodes()) == row(landed.nodes) and row(landed.nodes)
    key = lambda df: {r["id"]: (r["callCount"], r["signal"] and r["signal"]["errorCount"]) for r in df.collect()}
    assert key(edges.edges(graph)) == key(batch) and key(batch)
    assert spark.read.schema(INCIDENTS).json(str(tmp_path / "incidents")).select("id").distinct().count() == 2
    before = edges.current()
    edges.commit(before, {"edges": batch})  # a replayed batch changes nothing
    assert edges.current() == before


def test_bursts(spark):
    rows = [("a", i * 1000, 404) for i in range(6)] + [("b", i * 100_000, 404) for i in range(6)]
    got = incidents.bursts(spark.createDataFrame(rows, "peer string, ms long, code int"), ["peer"], "ms", "code").collect()
    assert [(r["peer"], r["n"], r["first_ms"], r["last_ms"], r["code"]) for r in got] == [("a", 5, 0, 4000, 404)]


def test_messages(spark):
    a = spark.createDataFrame([(1, {"http.response.status_code": "503", "http.route": "/x", "http.method": "GET"}), (2, {"rpc.grpc.status_code": "14"}), (3, {"error.type": "ECONNREFUSED", "server.address": "db"}), (4, {}), (5, {"http.status_code": "500"})], "i int, a map<string,string>")
    got = {r["i"]: r["m"] for r in a.select("i", incidents.message(F.lit(None).cast("string"), F.col("a")).alias("m")).collect()}
    assert got == {1: "503 on GET /x", 2: "gRPC UNAVAILABLE", 3: "ECONNREFUSED connecting to db", 4: "unknown error", 5: "HTTP 500"}


def test_latency_neighbourhoods(spark):
    hundred = spark.range(1, 101).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("ms"))
    q = latency.quantiles(latency.histogram(hundred, ["k"], "ms"), ["k"], {"p50": 0.5, "p95": 0.95}).first()
    assert 85 < q["p95"] < 106 and 45 < q["p50"] < 55
    edges = spark.createDataFrame([(0.0,), (-1.0,), (8.0,), (0.125,), (1e9,)], "ms double").select(latency.bucket(F.col("ms")).alias("b"))
    assert [r["b"] for r in edges.collect()] == [0, 0, 1 + 13 * 16, 1 + 7 * 16, latency.OVERFLOW]


def test_counter_deltas(spark):
    rows = [(1, "q", 'SELECT * FROM "Users"', 10), (2, "q", 'SELECT * FROM "Users"', 13), (3, "q", 'SELECT * FROM "Users"', 2), (1, "j", "SELECT * FROM a JOIN b ON 1 = 1", 1), (2, "j", "SELECT * FROM a JOIN b ON 1 = 1", 5)]
    got = connectors.single_table_deltas(spark.createDataFrame(rows, "poll int, queryid string, query string, calls long")).collect()
    assert [(r["targetName"], r["callCount"]) for r in got] == [("users", 3)]


def test_poll_resolves_routes_and_tables(spark):
    nodes = [{"id": "service:api", "type": "ServiceNode", "name": "api"}, {"id": "route:api:GET /u/:id", "type": "RouteNode", "name": "r", "service": "api", "method": "GET", "pathTemplate": "/u/:id"}, {"id": "infra:sql-table:users", "type": "InfraNode", "name": "users", "kind": "sql-table"}]
    g = Graph(table(spark, NODES, nodes), empty(spark, EDGES))
    logs = spark.createDataFrame([("2026-01-01T00:00:00Z", {"service_name": "api"}, "get", "https://x/u/7?a=1", 500)], "timestamp string, labels map<string,string>, method string, url string, status int")
    s = connectors.MAPPERS["cloud-run"](logs)
    edges, missed = connectors.poll(s, g, "service:gateway")
    assert [(r["target"], r["callCount"], r["signal"]["errorCount"]) for r in edges.collect()] == [("route:api:GET /u/:id", 1, 1)] and missed.count() == 0


@pytest.mark.parametrize(
    ("sql", "columns"),
    [
        ("INSERT INTO t (a, B) VALUES (1, 2)", ["a", "b"]),
        ("UPDATE t SET a = f(b, c), d = 2 WHERE e > 1 AND g IN (1)", ["a", "d", "e", "g"]),
        ("DELETE FROM t WHERE x.y = 'where z = 1'", ["y"]),
        ("SELECT t.a AS q, count(*), \"B\" FROM t WHERE c IS NULL ORDER BY d", ["a", "b", "c"]),
        (None, []),
    ],
)
def test_sql_columns(sql, columns):
    assert text.columns_of(sql) == columns


def test_protobuf_requests(spark, tmp_path):
    def field(n, kind, body):
        key = bytes([n << 3 | kind]) if n < 16 else b""
        return key + (bytes([len(body)]) + body if kind == 2 else body)

    text_value = lambda s: field(1, 2, s.encode())
    attribute = lambda k, v: field(1, 2, k.encode()) + field(2, 2, v)
    span_bytes = field(1, 2, b"\x01" * 4) + field(2, 2, b"\x02" * 2) + field(5, 2, b"op") + field(6, 0, b"\x03") + field(7, 1, (1_000_000_000).to_bytes(8, "little")) + field(8, 1, (1_005_000_000).to_bytes(8, "little")) + field(9, 2, attribute("http.route", text_value("/x"))) + field(15, 2, field(3, 0, b"\x02"))
    resource = field(1, 2, field(1, 2, attribute("service.name", text_value("svc"))))
    request = field(1, 2, resource + field(2, 2, field(2, 2, span_bytes)))
    (tmp_path / "a.pb").write_bytes(request)
    (tmp_path / "b.pb").write_bytes(request[:-3])
    good, bad = otlp_proto.read_protobuf(spark, str(tmp_path))
    r = otlp.flatten(good).first()
    assert (r["service"], r["traceId"], r["kind"], r["durationNanos"], r["statusCode"], r["httpRoute"]) == ("svc", "01010101", 3, 5_000_000, 2, "/x")
    assert bad.count() == 1


def test_burst_stream(spark, tmp_path):
    rows = [span(str(i), attributes={"server.address": "b", "http.response.status_code": "404"}) for i in range(6)]
    table(spark, SPANS, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pipelines.burst_stream(spark.readStream.schema(SPANS).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    # A timeout on processing time keeps the query waiting for it, so it is stopped once its batch is there.
    ended = time.time() + 120
    while time.time() < ended and not any(p["numInputRows"] for p in run.recentProgress):
        time.sleep(0.5)
    run.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["service"], r["peer"], r["n"], r["code"]) for r in got] == [("a", "b", 5, 404)]
