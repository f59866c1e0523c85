"""Registered queries over landed inputs: requests, streams, providers' rows, snapshots, ledgers and source trees.

Each query makes its input from the driver's tables, writes it as files where
the source reads files, and reads it back through the engine's source.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..operators.graph import Graph
from ..schema import NODES, conform
from ..sources import connectors, otlp, tables
from ..sources.extract import run as extract
from ..streaming import pipelines
from ..streaming.live import LiveTable
from . import bound
from .queries import query


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see; a temporary one only where driver and executors are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/landed-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return tempfile.mkdtemp(prefix="landed-")


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _attribute(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, value): OTLP documents of events, five hundred to a document; ten kinds of spans by event_id."""
    ev = bound.tables(spark, sf_dir)["events"]
    n, m = F.col("event_id"), F.col("event_id") % 10
    on = lambda *kinds: m.isin(*kinds)
    peer = F.when(on(0), _text("nation-", n % 25, ".db")).when(on(6), _text("sup", n % 60)).when(on(7), _text("h", n % 9)).when(on(9), F.lit("customer-1"))
    fields = {
        "server.address": peer,
        "db.system": F.when(on(0), "postgresql"),
        "db.statement": F.when(on(0), _text("SELECT id, c", n % 3, " FROM t_", n % 7, " WHERE k = 1")),
        "messaging.system": F.when(on(1, 2), "kafka"),
        "messaging.destination.name": F.when(on(1, 2), _text("topic-", n % 5)),
        "graphql.operation.name": F.when(on(3), _text("op", n % 4)),
        "graphql.operation.type": F.when(on(3), "query"),
        "rpc.system": F.when(on(4), "grpc"),
        "rpc.service": F.when(on(4), "shop.Cart"),
        "rpc.method": F.when(on(4), _text("m", n % 3)),
        "http.request.header.upgrade": F.when(on(5), "websocket"),
        "url.path": F.when(on(5), _text("/ws", n % 3)),
        "http.route": F.when(on(8), "/pay/{id}"),
        "http.method": F.when(on(8), "post"),
        "http.response.status_code": F.when(on(6) & (F.col("event_type") == "error"), "503").when(on(7), "404"),
        "code.file.path": F.when(on(9), "/srv/src/app.py"),
    }
    span = F.struct(
        _text(n % 500).alias("traceId"),
        n.cast("string").alias("spanId"),
        F.lit("op").alias("name"),
        F.when(on(0, 6, 7, 9), 3).when(on(1), 4).when(on(2), 5).otherwise(2).alias("kind"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("startTimeUnixNano"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + n * 1000).cast("string").alias("endTimeUnixNano"),
        F.array_compact(F.array(*(_attribute(k, v) for k, v in fields.items()))).alias("attributes"),
        F.struct(F.lit(0).alias("code")).alias("status"),
    )
    service = F.when(on(9), _text("supplier-", n % 20)).otherwise(_text("customer-", F.col("user_id") % 100))
    doc = (n / 500).cast("long")
    by_service = ev.groupBy(doc.alias("doc"), service.alias("service")).agg(F.collect_list(span).alias("spans"))
    resource = F.struct(F.array(_attribute("service.name", F.col("service"))).alias("attributes"))
    one = F.struct(resource.alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))
    return by_service.groupBy("doc").agg(F.to_json(F.struct(F.collect_list(one).alias("resourceSpans"))).alias("value"))


def land_requests(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files with a document of ``requests`` a line: as many files as there are partitions of data."""
    path = f"{scratch(spark)}/requests"
    requests(spark, sf_dir).select("value").write.text(path)
    return path


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.flatten(otlp.read_requests(spark, land_requests(spark, sf_dir), lines=True))


def declared(spark: SparkSession, sf_dir: str) -> Graph:
    """The bound graph's nodes with a declared route of every second customer, and no edges."""
    t = bound.tables(spark, sf_dir)
    name = _text("customer-", F.col("c_custkey"))
    routes = t["customer"].filter("c_custkey % 2 = 0").select(_text("route:", name, ":POST /pay/:id").alias("id"), F.lit("RouteNode").alias("type"), name.alias("service"), F.lit("POST").alias("method"), F.lit("/pay/:id").alias("pathTemplate"))
    g = bound.graph(spark, sf_dir, t)
    return Graph(g.nodes.unionByName(conform(routes, NODES)), g.edges.limit(0), g.now)


@query
def otlp_spans(spark, sf_dir):
    return _spans(spark, sf_dir).select("service", "env", "traceId", "spanId", "kind", "durationNanos", "dbSystem", "dbTable", F.array_join("dbColumns", ",").alias("columns"), "messagingDestination", "graphqlOperationName", "rpcMethod", "websocketChannel", "httpRoute")


@query
def span_nodes(spark, sf_dir):
    return ingest.land(_spans(spark, sf_dir), declared(spark, sf_dir)).nodes.select("id", "type", "name", "service", "engine", "kind")


@query
def span_edges(spark, sf_dir):
    return ingest.land(_spans(spark, sf_dir), declared(spark, sf_dir)).edges.select("id", "provenance", "callCount", F.col("signal.errorCount").alias("errorCount"))


@query
def span_routes(spark, sf_dir):
    edges = ingest.land(_spans(spark, sf_dir), declared(spark, sf_dir)).edges
    return edges.filter("target like 'route:%'").select("source", "target", "callCount", "confidence")


@query
def span_columns(spark, sf_dir):
    nodes = ingest.land(_spans(spark, sf_dir), declared(spark, sf_dir)).nodes
    return nodes.filter("columns is not null").select("id", F.inline("columns")).select("id", "name", F.array_join("provenances", ",").alias("provenances"), "confidence")


@query
def span_bursts(spark, sf_dir):
    """Client failures of two services, a tenth of a second apart for each event between them."""
    few = _text("customer-", F.regexp_extract("service", r"(\d+)$", 1).cast("int") % 2)
    spans = _spans(spark, sf_dir).withColumns({"service": few, "startTimeUnixNano": F.col("spanId").cast("long") * 100_000_000})
    told = ingest.burst_incidents(ingest.placed(spans, declared(spark, sf_dir)))
    return told.select("id", "service", "errorMessage", "incidentCount", "httpStatusCode", "affectedNode")


@query
def stream_edges(spark, sf_dir):
    """The requests drained as a stream into an edge table."""
    where = scratch(spark)
    table, graph = LiveTable(spark, f"{where}/edges"), declared(spark, sf_dir)
    pipelines.ingest_stream(spark, land_requests(spark, sf_dir), table, graph, f"{where}/progress", f"{where}/incidents", once=True, lines=True).awaitTermination()
    return table.edges(graph).select("id", "provenance", "callCount", F.col("signal.errorCount").alias("errorCount"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = bound.tables(spark, sf_dir)["events"]
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 7 == 0, 404).otherwise(200)
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return ev.select("event_id", "user_id", stamp.alias("timestamp"), status.alias("status"), F.when(F.col("event_id") % 2 == 0, "get").otherwise("POST").alias("method"))


def _told(signals: DataFrame) -> DataFrame:
    return signals.select("targetKind", "targetName", "callCount", "errorCount", "lastObservedIso")


@query
def connector_rest(spark, sf_dir):
    n = F.col("event_id")
    path = F.when(n % 3 == 0, _text("/rest/v1/rpc/f", n % 4)).when(n % 3 == 1, _text("/rest/v1/t", n % 5, "?id=eq.", n)).otherwise(F.lit("/auth/v1/token"))
    return _told(connectors.MAPPERS["supabase"](_logs(spark, sf_dir).withColumn("path", path)))


@query
def connector_insights(spark, sf_dir):
    logs, n = _logs(spark, sf_dir), F.col("event_id")
    listed = F.when(n % 3 > 0, F.array(_text("a", n % 4), _text("B", n % 3))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = logs.select(listed.alias("tables"), F.array(_text("shop.q", n % 2)).alias("qualified_tables"), F.when(n % 5 > 0, n % 5).alias("count"), F.when(F.col("status") == 500, 1).alias("errors"), F.col("timestamp").alias("last_run"))
    return _told(connectors.MAPPERS["planetscale"](rows))


@query
def connector_routes(spark, sf_dir):
    n = F.col("event_id")
    nodes = declared(spark, sf_dir).nodes.filter("id in ('route:customer-2:POST /pay/:id')")
    path = F.when(n % 4 == 0, F.lit("/other")).otherwise(_text("/pay/", n))
    return _told(connectors.MAPPERS["railway"](_logs(spark, sf_dir).withColumn("path", path), nodes))


@query
def connector_flows(spark, sf_dir):
    n = F.col("event_id")
    flows = _logs(spark, sf_dir).select("timestamp", F.when(n % 3 > 0, _text("peer-", n % 6)).alias("peerServiceId"), F.when(n % 8 == 0, "policy").alias("dropCause"))
    return _told(connectors.MAPPERS["railway-flows"](flows))


@query
def connector_cloud(spark, sf_dir):
    n = F.col("event_id")
    logs = _logs(spark, sf_dir).withColumns({"labels": F.when(n % 5 > 0, F.create_map(F.lit("service_name"), _text("svc-", n % 6))), "url": _text("https://x.example/p/", n % 3, "?q=", n)})
    return connectors.MAPPERS["cloud-run"](logs).select("targetKind", "targetName", "method", "path", "callCount", "errorCount")


@query
def connector_workers(spark, sf_dir):
    n = F.col("event_id")
    logs = _logs(spark, sf_dir).withColumns({"script": _text("w-", n % 3), "trigger": F.when(n % 4 == 0, "cron").otherwise(_text("GET https://x.example/k/", n % 2, "?a=1"))})
    return connectors.MAPPERS["cloudflare"](logs).select("targetKind", "targetName", "method", "path", "callCount", "errorCount")


@query
def connector_builds(spark, sf_dir):
    n = F.col("event_id")
    code = F.when(n % 3 == 0, "BUILD_TIMEOUT").when(n % 3 == 1, "EAS_BUILD_FAILED")
    builds = _logs(spark, sf_dir).select(n.cast("string").alias("id"), _text("app-", n % 4).alias("app"), F.when(F.col("status") == 500, "ERRORED").otherwise("FINISHED").alias("status"), code.alias("errorCode"), F.when(n % 2 == 0, "no").alias("errorMessage"), F.col("timestamp").alias("finishedAt"))
    return connectors.MAPPERS["eas"](builds).select("id", "service", "errorType", "errorMessage", "affectedNode")


@query
def connector_poll(spark, sf_dir):
    """Signals about suppliers by name or alias's node, folded into edges of a gateway."""
    n = F.col("event_id")
    flows = _logs(spark, sf_dir).select("timestamp", _text("Supplier-", n % 30).alias("peerServiceId"), F.when(n % 8 == 0, "policy").alias("dropCause"))
    edges, missed = connectors.poll(connectors.MAPPERS["railway-flows"](flows), declared(spark, sf_dir), "service:gateway")
    found = edges.select("id", "callCount", F.col("signal.errorCount").alias("errorCount"))
    return found.unionByName(missed.select(F.concat(F.lit("unresolved:"), "targetName").alias("id"), "callCount", "errorCount"))


@query
def snapshot_round_trip(spark, sf_dir):
    """Saved twice and read back: the second save is what readers see."""
    path = f"{scratch(spark)}/graph"
    g = bound.graph(spark, sf_dir)
    tables.save_graph(g, path)
    tables.save_graph(Graph(g.nodes, g.edges.filter("type <> 'CONTAINS'"), g.now), path)
    back = tables.load_graph(spark, path)
    nodes = back.nodes.groupBy(F.lit("node").alias("kind"), "type").agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(back.edges.groupBy(F.lit("edge").alias("kind"), "type").agg(F.count(F.lit(1)).alias("n")))


@query
def incident_ledger(spark, sf_dir):
    """Incidents appended in two parts; the oldest of the ledger, in order of arrival."""
    from ..operators import incidents

    path = f"{scratch(spark)}/incidents"
    ev = bound.tables(spark, sf_dir)["events"].filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"), F.lit("boom").alias("errorMessage"), _text("service:customer-", F.col("user_id") % 50).alias("affectedNode"))
    odd = F.col("id").cast("long") % 2 == 1
    for part in (ev.filter(odd), ev.filter(~odd)):
        tables.append_incidents(part.orderBy(F.col("id").cast("long")), path)
    return incidents.listing(tables.read_incidents(spark, path), 200).select("id", "affectedNode")


@query
def stale_ledger(spark, sf_dir):
    """Stale events of one sweep, appended and listed: the newest first."""
    from ..operators import lifecycle

    path = f"{scratch(spark)}/stale"
    events = lifecycle.stale_sweep(bound.graph(spark, sf_dir))[1].filter("edgeType = 'CONNECTS_TO'")
    tables.append_stale_events(events.orderBy("edgeId"), path)
    tables.append_stale_events(events.filter("1 = 0"), path)
    return tables.list_stale_events(tables.read_stale_events(spark, path), "CONNECTS_TO", 50).select("edgeId", "edgeType")


@query
def unrouted_services(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    known = bound.tables(spark, sf_dir)["customer"].select(_text("customer-", F.col("c_custkey")).alias("service"))
    return tables.unrouted(spans, known).groupBy("service").agg(F.count(F.lit(1)).alias("n"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a service of each supplier, with a manifest, routes, a data source and a call to the next one."""
    s = bound.tables(spark, sf_dir)["supplier"].select(F.col("s_suppkey").alias("k"))
    name, last = _text("sup-", F.col("k")), _text("sup-", F.col("k") + 1)
    manifest = _text('{"name": "', name, '", "version": "1.0.', F.col("k") % 7, '", "dependencies": {"express": "^4.0.0", "pg": "8.', F.col("k") % 5, '.0"}, "engines": {"node": ">=18"}}')
    app = _text("const express = require('express')\nconst users = require('./users')\nconst app = express()\napp.get('/v", F.col("k") % 3, "/:id', users)\nfetch('http://", last, "/pay')\n")
    users = F.lit("class Base {}\nclass Users extends Base {\n  list() {\n    return 1\n  }\n}\n")
    dotenv = _text("DATABASE_URL=postgres://u:p@db", F.col("k") % 4, ".host:5432/shop\n")
    files = F.array(*(F.struct(_text(name, p).alias("path"), c.alias("content")) for p, c in (("/package.json", manifest), ("/src/app.js", app), ("/src/users.js", users), ("/.env", dotenv))))
    return s.select(F.inline(files))


@query
def extract_nodes(spark, sf_dir):
    graph, _, _ = extract.extract(tree(spark, sf_dir))
    kept = graph.nodes.filter("type in ('ServiceNode', 'RouteNode', 'DatabaseNode', 'FileNode')")
    return kept.select("id", "type", "framework", "version", F.col("dependencies")["pg"].alias("pg"), "engine")


@query
def extract_edges(spark, sf_dir):
    graph, _, _ = extract.extract(tree(spark, sf_dir))
    return graph.edges.filter("type in ('IMPORTS', 'INHERITS', 'CALLS') or (type = 'CONNECTS_TO' and source like 'service:%')").select("type", "source", "target", "provenance")


@query
def extract_services(spark, sf_dir):
    return extract.discover(tree(spark, sf_dir))


__all__ = ["declared", "land_requests", "requests", "scratch", "tree"]
