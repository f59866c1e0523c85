"""Snapshots, ledgers, logs, connectors, and the expressions they use."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.functions import identity as ids
from strandgraph.functions import spans as sp
from strandgraph.functions import text, versions, weights
from strandgraph.operators import ask, ingest, search
from strandgraph.operators.graph import Graph
from strandgraph.schema import EDGES, INCIDENTS, LOGS, NODES, struct, table
from strandgraph.sources import connectors, tables
from strandgraph.streaming import pipelines


def one(spark, expr, **columns):
    """The value of an expression over one row."""
    return spark.createDataFrame([tuple(columns.values())], T.StructType([T.StructField(k, T.StringType()) for k in columns])).select(expr.alias("v")).first()["v"] if columns else spark.range(1).select(expr.alias("v")).first()["v"]


def graph(spark):
    return Graph(table(spark, NODES, [{"id": "service:a", "type": "ServiceNode", "name": "a"}, {"id": "service:b", "type": "ServiceNode", "name": "b"}]), table(spark, EDGES, [{"id": "CALLS:service:a->service:b", "source": "service:a", "target": "service:b", "type": "CALLS", "provenance": "EXTRACTED"}]), "2026-01-01 00:00:00")


def test_struct_reads_nested_types():
    s = struct("a int, b array<struct<x:map<string,bigint>,y:double>>")
    assert s["b"].dataType.elementType["x"].dataType == T.MapType(T.StringType(), T.LongType())


def test_snapshots(spark, tmp_path):
    g = graph(spark)
    tables.save_graph(g, str(tmp_path / "g"))
    again = tables.load_graph(spark, str(tmp_path / "g"))
    assert again.edges.collect() == g.edges.collect() and again.now == g.now
    assert tables.load_graph(spark, str(tmp_path / "none")).nodes.count() == 0
    document = {"schemaVersion": 2, "exportedAt": "2026-01-01 00:00:00", "graph": {"nodes": [{"key": "service:a", "attributes": {"id": "service:a", "type": "ServiceNode", "name": "a"}}], "edges": [{"attributes": {"id": "CALLS:FRONTIER:service:a->frontier:x", "source": "service:a", "target": "frontier:x", "type": "CALLS", "provenance": "FRONTIER"}}]}}
    old = tables.read_snapshot_json(spark, json.dumps(document)).edges.first()
    assert (old["id"], old["provenance"]) == ("CALLS:OBSERVED:service:a->frontier:x", "OBSERVED")
    with pytest.raises(ValueError):
        tables.read_snapshot_json(spark, json.dumps({"schemaVersion": 99}))
    bare = lambda v: {"schemaVersion": v, "graph": {"nodes": [{"id": "infra:sql-table:t", "type": "InfraNode", "kind": "sql-table", "name": "t", "pgDriverVersion": "1"}, {"id": "infra:x:y", "type": "InfraNode", "kind": "x"}]}}
    for version, columns in ((1, []), (5, []), (6, None)):
        got = {r["id"]: r["columns"] for r in tables.read_snapshot_json(spark, json.dumps(bare(version))).nodes.collect()}
        assert got == {"infra:sql-table:t": columns, "infra:x:y": None}


def test_ledgers(spark, tmp_path):
    path = str(tmp_path / "i")
    tables.append_incidents(table(spark, INCIDENTS, [{"id": "1", "service": "a", "errorMessage": "x"}]), path)
    tables.append_incidents(table(spark, INCIDENTS, [{"id": "2", "service": "a", "errorMessage": "y"}]), path)
    assert tables.read_incidents(spark, path).count() == 2
    found = spark.createDataFrame([("p:1",), ("p:2",)], "id string")
    for _ in range(2):
        tables.append_violations(found, spark, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).count() == 2


def test_logs(spark):
    rows = [{"id": str(i), "projectName": "p", "source": "s", "timestamp": t} for i, t in enumerate(["2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z", "garbled", "2025-01-01T00:00:00Z"])]
    logs = table(spark, LOGS, rows).withColumn("ordinal", F.col("id").cast("int"))
    kept = tables.keep_logs(logs, F.lit("2026-01-02T01:00:00Z").cast("timestamp"), hours=48, keep=2)
    assert {r["id"] for r in kept.collect()} == {"1", "2"}
    assert [r["id"] for r in tables.list_logs(logs, project="p", since="2026-01-01T00:00:00Z").collect()] == ["0", "1"]


def test_owners_take_the_first_rule(spark):
    paths = spark.createDataFrame([("src/a.py",), ("docs/x.md",), ("other",)], "path string")
    got = {r["path"]: r["owner"] for r in tables.owners_of(paths, "# c\n*.py @one\n/src/ @two\n/docs/** @three\n", spark).collect()}
    assert got == {"src/a.py": "@one", "docs/x.md": "@three"}


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_connectors(spark):
    c = ("targetKind", "targetName", "callCount", "errorCount")
    rest = spark.createDataFrame([("t1", "/rest/v1/users?x=1", "GET", 500), ("t2", "/rest/v1/rpc/f", "POST", 200), ("t3", "/auth", "GET", 200), ("t4", "/rest/v1/users", "GET", 404)], "timestamp string, path string, method string, status int")
    assert rows_of(connectors.rest_edge_logs(rest), *c) == [("rpc", "f", 1, 0), ("table", "users", 2, 1)]
    insights = spark.createDataFrame([(["a", "b"], None, 3, 1, "t"), ([], ["s.c"], None, None, "t")], "tables array<string>, qualified_tables array<string>, count long, errors long, last_run string")
    assert rows_of(connectors.query_insights(insights), *c) == [("table", "a", 3, 1), ("table", "b", 3, 1), ("table", "c", 1, 0)]
    routes = table(spark, NODES, [{"id": "route:s:GET /u/:id", "type": "RouteNode", "service": "s", "method": "GET", "pathTemplate": "/u/:id"}])
    http = spark.createDataFrame([("t", "get", "/u/12", 404), ("t", "get", "/u/13?q", 200), ("t", "post", "/u/1", 200)], "timestamp string, method string, path string, status int")
    assert rows_of(connectors.http_route_logs(http, routes), *c) == [("route", "route:s:GET /u/:id", 2, 1), ("unmatched", "unmatched", 1, 0)]
    flows = spark.createDataFrame([("t", "x", ""), ("t", "x", "reset"), ("t", None, "")], "timestamp string, peerServiceId string, dropCause string")
    assert rows_of(connectors.network_flows(flows), *c) == [("service", "x", 2, 1)]
    worker = spark.createDataFrame([("t", "w", "GET /a?b", 500), ("t", "w", "cron", 200)], "timestamp string, script string, trigger string, status int")
    assert rows_of(connectors.worker_traces(worker), *c, "method", "path") == [("service", "w", 1, 1, "GET", "/a")]
    builds = spark.createDataFrame([("1", "app", "ERRORED", "BAD_CODE", "m", "t"), ("2", "app", "ERRORED", "BUILD_TIMEOUT", "m", "t"), ("3", "app", "FINISHED", None, None, "t")], "id string, app string, status string, errorCode string, errorMessage string, finishedAt string")
    assert rows_of(connectors.failed_builds(builds), "id", "affectedNode") == [("build:1", "service:app")]


def test_token_bucket():
    now = [0.0]
    bucket = connectors.TokenBucket(2.0, 2, lambda: now[0])
    assert [bucket.wait() for _ in range(4)] == [0.0, 0.0, 0.5, 1.0]
    now[0] = 5.0
    assert bucket.wait() == 0.0 and connectors.TokenBucket.backoff(2) == pytest.approx(3.2)


def test_identity(spark):
    parsed = one(spark, ids.parse_edge_id("e"), e="CALLS:OBSERVED:file:a:x->y.py->service:b")
    assert (parsed["type"], parsed["provenance"], parsed["source"], parsed["target"]) == ("CALLS", "OBSERVED", "file:a:x->y.py", "service:b")
    assert one(spark, ids.service_id("n", "e"), n="a", e="prod") == "service:a:prod" and one(spark, ids.service_id("n", "e"), n="a", e="unknown") == "service:a"
    assert one(spark, ids.symbol_file("s"), s="symbol:a:src/x#y.py#f~1") == "file:a:src/x#y.py"


def test_texts(spark):
    assert one(spark, text.normalised_template(F.col("p")), p="/Users/{id}/42/?a#b") == "/users/:param/:param"
    c = one(spark, text.connection(F.col("u")), u="postgres://u:p@h.x:5432/db?ssl=1")
    assert (c["scheme"], c["host"], c["port"], c["database"]) == ("postgres", "h.x", 5432, "db")
    e = one(spark, text.engine_of_image(F.col("i")), i="reg/postgres:15.2-alpine")
    assert (e["engine"], e["version"]) == ("postgresql", "15.2")
    assert one(spark, text.iso_from_nanos(F.lit(1_700_000_000_123_999_999).cast("long"))) == "2023-11-14T22:13:20.123Z"
    assert text.plural("category") == "categories" and text.singular("boxes") == "box" and text.snake("HTTPServerName") == "http_server_name"
    assert text.mask_comments("a // b 'c'\n'// d' /* e */") == "a         \n'// d'        "
    assert one(spark, text.is_test_path(F.col("p")), p="a/x.spec.ts") and not one(spark, text.is_test_path(F.col("p")), p="a/spec.ts")


def test_versions(spark):
    assert one(spark, versions.older(F.col("a"), F.col("b")), a="^7.4", b="8.0.0")
    ok = lambda r: one(spark, versions.admits_only_from(F.col("a"), F.col("b")), a=r, b="18.17.0")
    assert [ok(r) for r in (">=18.17.0", "^20", "18.x || 20.x", ">=16", "*", "18.17.0 - 20")] == [True, True, False, False, False, True]
    assert one(spark, versions.dotted_older(F.col("a"), F.col("b")), a="1.9", b="1.10.0")


def test_weights(spark):
    grade = lambda n, e: one(spark, weights.observed_confidence(F.lit(n).cast("long"), F.lit(e).cast("long")))
    assert [grade(n, e) for n, e in ((1, 0), (10, 0), (100, 0), (1000, 0), (100, 100), (None, 0))] == [0.4, 0.7, 0.95, 1.0, 0.75, 1.0]
    assert [one(spark, weights.recency_weight(F.lit(x).cast("double"))) for x in (None, 0, 86_400_000, 86_400_001)] == [0.8, 1.0, 0.5, 0.3]


def test_span_predicates(spark):
    a = spark.createDataFrame([({"url.full": "http://h.x:80/a", "http.response.header.content-type": "Text/Event-Stream"},)], "a map<string,string>")
    r = a.select(sp.peer(F.col("a")).alias("p"), sp.is_stream(F.lit(5).cast("long"), F.col("a"), F.lit(None).cast("string")).alias("s"), sp.is_loopback(F.lit("127.0.0.9")).alias("l"), sp.relative_path(F.lit("/srv/app/src/x.py"), F.lit(None).cast("string"), F.lit("repo/app")).alias("r")).first()
    assert (r["p"], r["s"], r["l"], r["r"]) == ("h.x", True, True, "src/x.py")


def test_search_and_phases(spark):
    g = graph(spark)
    texts = search.embed_text(g.nodes)
    assert search.changed(texts, texts.select("id", "digest")).count() == 0
    assert {r["id"] for r in ask.busiest(g).select(F.col("service").alias("id")).collect()} == {"service:a"}
    ran = pipelines.rerun(["x/package.json", "a/b.py"], {"services": lambda: None, "calls": lambda: None, "infra": lambda: None}, spark)
    assert ran == ["services", "calls"]
    projects = spark.createDataFrame([("shop", False), ("shop-api", False)], "project string, paused boolean")
    routed = ingest.route_to_projects(spark.createDataFrame([("shop-api-eu",), ("my_shop",), ("zzz",)], "service string"), projects)
    assert {r["service"]: r["project"] for r in routed.collect()} == {"shop-api-eu": "shop-api", "my_shop": "shop", "zzz": "default"}
