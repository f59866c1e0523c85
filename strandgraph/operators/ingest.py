"""Spans to graph: which edges a span tells of, folded by one aggregation.

A branch is chosen by priority (database, messaging, GraphQL, gRPC, WebSocket,
HTTP peer, parent); each branch yields an array of calls, which is exploded, so
a batch of spans is one projection, joins with the few distinct services, hosts
and call sites, and one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity as ids
from ..functions import spans as sp
from ..functions import text
from ..schema import EDGES, INCIDENTS, NODES, SPANS, conform
from . import incidents as inc
from .graph import Graph, materialise, side, whole
from .lifecycle import fold_columns, fold_observed, stitch


def resolve_hosts(hosts: DataFrame, services: DataFrame) -> DataFrame:
    """(host, env, service) of distinct (host, env).

    An id with the environment comes first, then the id without, then a name
    or alias in the same environment, an unknown one, or any.
    """
    names = services.filter("type = 'ServiceNode'").select(
        F.col("id").alias("service"), "name", F.coalesce("env", F.lit("unknown")).alias("_env"), F.explode(F.array_distinct(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))))).alias("_host")
    )
    joined = hosts.join(names, F.lower("host") == F.lower("_host"))
    order = (
        F.when(F.col("service") == F.concat(F.lit("service:"), "host", F.lit(":"), "env"), 0)
        .when(F.col("service") == F.concat(F.lit("service:"), "host"), 1)
        .when(F.col("_env") == F.col("env"), 2)
        .when(F.col("_env") == "unknown", 3)
        .otherwise(4)
    )
    return joined.groupBy("host", "env").agg(F.min(F.struct(order.alias("o"), "service")).alias("m")).select("host", "env", F.col("m.service").alias("service"))


def fuse_services(spans: DataFrame, services: DataFrame) -> DataFrame:
    """(service, env, id, name, known): the node a span's service is.

    By exact id, else by case-blind name among declared ones (the smaller id of
    several), else a new one that ``known`` denies.
    """
    seen = spans.select("service", "env").distinct().withColumn("_id", ids.service_id("service", "env"))
    # Services of the graph that no span may be are not sent.
    exact = services.filter("type = 'ServiceNode'").join(seen.select(F.col("_id").alias("id")), "id", "left_semi")
    exact = exact.groupBy(F.col("id").alias("_id")).agg(F.min("name").alias("_own"), F.lit(True).alias("_known"))
    declared = services.filter("type = 'ServiceNode' and coalesce(discoveredVia, 'static') <> 'otel'")
    declared = declared.join(seen.select(F.lower("service").alias("_n")), F.lower("name") == F.col("_n"), "left_semi")
    named = declared.groupBy(F.lower("name").alias("_n")).agg(F.min(F.struct("id", "name")).alias("_named"))
    out = seen.join(exact, "_id", "left").join(named, F.lower("service") == F.col("_n"), "left")
    known = F.coalesce("_known", F.lit(False))
    return out.select(
        "service",
        "env",
        F.when(known, F.col("_id")).otherwise(F.coalesce("_named.id", "_id")).alias("id"),
        F.coalesce(F.when(known, F.col("_own")).otherwise(F.col("_named.name")), "service").alias("name"),
        (known | F.col("_named").isNotNull()).alias("known"),
    )


def route_matches(asked: DataFrame, routes: DataFrame) -> DataFrame:
    """(service, method, template, route) of distinct requests: the declared route that serves them.

    Same service, equal normalised template, and the method equal, ALL or not
    known; the smaller id of several.  Requests repeat, so each is matched once.
    """
    known = routes.filter("type = 'RouteNode'").select(F.col("service").alias("_s"), F.upper("method").alias("_m"), text.normalised_template(F.col("pathTemplate")).alias("_t"), F.col("id").alias("_route"))
    once = asked.select("service", "method", "template").distinct().withColumn("_n", text.normalised_template(F.col("template")))
    joined = once.join(known, (F.col("service") == F.col("_s")) & (F.col("_n") == F.col("_t"))).filter("method is null or _m = method or _m = 'ALL'")
    return joined.groupBy("service", "method", "template").agg(F.min("_route").alias("route"))


def reconcile_files(seen: DataFrame, files: DataFrame) -> DataFrame:
    """(service, path, file): the declared file of an observed path: equal, else the longest that the path ends with.

    Suffixes of the observed path are exploded, so this is an equi join.
    """
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tried = seen.select("service", "path").distinct().select("service", "path", F.explode(suffixes).alias("_p"))
    told = F.coalesce(F.col("discoveredVia"), F.lit("static")) == "otel"
    known = files.filter("type = 'FileNode'").select("service", F.col("path").alias("_p"), F.col("id").alias("file"), told.alias("_told"))
    best = F.max(F.struct(F.length("_p").alias("n"), "file")).alias("b")
    # A file that only telemetry knows is found by its whole path alone.
    return tried.join(known, ["service", "_p"]).filter("not _told or _p = path").groupBy("service", "path").agg(best).select("service", "path", F.col("b.file").alias("file"))


def enclosing_symbols(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """sites (site, file, line, function) with the symbol around the line: by name, then the smallest span, then the later start."""
    known = symbols.filter("type = 'SymbolNode'").select(F.concat(F.lit("file:"), "service", F.lit(":"), "relPath").alias("file"), F.col("id").alias("symbol"), F.col("qualname").alias("_q"), F.col("span.startLine").alias("_a"), F.col("span.endLine").alias("_b"))
    joined = sites.join(known, "file").filter("line between _a and _b")
    named = F.substring_index("_q", ".", -1) == F.substring_index("function", ".", -1)
    order = F.struct(F.when(named, 0).otherwise(1).alias("o"), (F.col("_b") - F.col("_a")).alias("n"), (-F.col("_a")).alias("s"), "symbol")
    return joined.groupBy("site").agg(F.min(order).alias("m")).select("site", F.col("m.symbol").alias("symbol"))


def declared_database(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    """(service, engine, database): the one declared database of an engine that a service or its files connect to.

    ``of`` (id) limits the services that are looked at.
    """
    databases = graph.nodes.filter("type = 'DatabaseNode'").select(F.col("id").alias("target"), "engine")
    edges = graph.valid_edges().filter("type = 'CONNECTS_TO' and provenance = 'EXTRACTED'").select(F.col("source").alias("member"), "target")
    members = graph.scope() if of is None else materialise(graph.scope(of))
    found = members.join(edges, "member").join(databases, "target").groupBy(F.col("node").alias("service"), "engine").agg(F.count_distinct("target").alias("n"), F.min("target").alias("database"))
    return found.filter("n = 1").select("service", "engine", "database")


#: What a call tells of the node it goes to.
TARGET = ("type", "name", "service", "engine", "host", "provider", "kind", "operationType", "operationName", "rpcService", "rpcMethod", "channel")


#: What ``placed`` tells of a span.
PLACE = ("_svc", "_known", "_file", "_rel", "_line", "_symbol", "_src", "site", "_peer", "_to", "_declared")


def placed(spans: DataFrame, graph: Graph) -> DataFrame:
    """spans with the node of their service, the file or symbol of their call site, and what their peer is.

    ``_svc`` is the fused service, ``_known`` whether the graph has it;
    ``_file`` and ``_rel`` the declared file of the call site (else the path as
    observed), ``_symbol`` the symbol around its line; ``_src`` is the finest of
    these, ``site`` all of them, with the symbol to be made (``minted``) where
    the file has symbols but none there.  ``_to`` is the service of ``_peer``,
    ``_declared`` the database that a service without one declares.  All that
    differs between spans in this (``_at``) is matched once, and spans meet it
    in one join, which sends no span as long as there is little of it.
    """
    a = F.col("attributes")
    path = F.nullif(F.regexp_replace(F.replace(sp.code_path(a), F.lit("\\"), F.lit("/")), r"^(?:[A-Za-z]:)?/+", ""), F.lit(""))
    at = F.struct("service", "env", path.alias("_path"), sp.code_line(a).alias("_line"), sp.code_function(a).alias("_fn"), sp.peer(a).alias("_peer"), "dbSystem")
    s = spans.withColumn("env", F.coalesce("env", F.lit("unknown"))).withColumn("_at", at)
    seen = materialise(s.filter("service is not null").select("_at").distinct())
    # Structs are equal where the same fields are null.
    return s.join(side(materialise(_places(seen.select("_at", "_at.*"), graph))), "_at").drop("_at")


def _places(seen: DataFrame, graph: Graph) -> DataFrame:
    """``_at`` of distinct spans and their ``PLACE``."""
    fused = fuse_services(seen, graph.nodes).withColumnsRenamed({"id": "_svc", "name": "_name", "known": "_known"})
    s = materialise(seen.join(fused, ["service", "env"]))
    paths = s.filter("_path is not null").select(F.col("_name").alias("service"), F.col("_path").alias("path"))
    files = reconcile_files(paths, graph.nodes).select(F.col("service").alias("_name"), F.col("path").alias("_path"), F.col("file").alias("_declared_file"))
    hosts = s.filter("_peer is not null").select(F.col("_peer").alias("host"), "env").distinct()
    resolved = resolve_hosts(hosts, graph.nodes).withColumnsRenamed({"host": "_peer", "service": "_to"})
    users = s.filter("dbSystem is not null and _peer is null").select(F.col("_svc").alias("id")).distinct()
    local = declared_database(graph, users).withColumnsRenamed({"service": "_svc", "engine": "dbSystem", "database": "_declared"})
    s = s.join(files, ["_name", "_path"], "left").join(resolved, ["_peer", "env"], "left").join(local, ["_svc", "dbSystem"], "left")
    s = s.withColumn("_file", F.coalesce("_declared_file", ids.file_id("_name", "_path")))
    s = s.withColumn("_rel", ids.file_path("_file"))
    sites = s.filter("_file is not null and _line is not null").select(F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_fn").alias("function")).distinct()
    sites = sites.withColumn("site", F.struct("file", "line", "function"))
    around = enclosing_symbols(sites, graph.nodes).select(F.col("site.file").alias("_file"), F.col("site.line").alias("_line"), F.col("site.function").alias("_f"), F.col("symbol").alias("_symbol"))
    full = graph.nodes.filter("type = 'SymbolNode'").select(F.concat(F.lit("file:"), "service", F.lit(":"), "relPath").alias("_file"), F.lit(True).alias("_full")).distinct()
    near = (s["_file"] == around["_file"]) & (s["_line"] == around["_line"]) & s["_fn"].eqNullSafe(around["_f"])
    s = s.join(around, near, "left").drop(around["_file"], around["_line"], around["_f"]).join(full, "_file", "left")
    new = F.col("_symbol").isNull() & F.col("_full") & F.col("_fn").isNotNull() & F.col("_line").isNotNull()
    s = s.withColumn("_minted", F.when(new, ids.symbol_id("_name", "_rel", "_fn")))
    site = F.struct(F.col("_svc").alias("svc"), F.col("_name").alias("name"), F.col("_file").alias("file"), F.col("_rel").alias("path"), F.col("_minted").alias("minted"), F.col("_fn").alias("function"), F.col("_line").alias("line"))
    return s.withColumn("_src", F.coalesce("_symbol", "_minted", "_file", "_svc")).withColumn("site", site).select("_at", *PLACE)


def _target(node_type: str, label, **fields) -> Column:
    given = {"type": F.lit(node_type), "name": ids.col(label), **{k: ids.col(v) for k, v in fields.items()}}
    return F.struct(*(given.get(n, F.lit(None)).cast("string").alias(n) for n in TARGET))


#: What a child needs to know of the span that started it.
PARENT = ("service", "env", "attributes", "httpMethod", "httpRoute")


def tells_itself(kind: Column) -> Column:
    """Whether a span's own protocol says what it calls, whoever its parent is."""
    serves = sp.serves(kind)
    return F.coalesce(
        F.col("dbSystem").isNotNull()
        | (F.col("messagingSystem").isNotNull() & F.col("messagingDestination").isNotNull() & sp.moves_messages(kind))
        | (F.col("graphqlOperationName").isNotNull() & F.col("graphqlOperationType").isNotNull() & serves)
        | ((F.coalesce("rpcSystem", F.lit("")) == "grpc") & F.col("rpcService").isNotNull() & F.col("rpcMethod").isNotNull() & serves)
        | (F.col("websocketChannel").isNotNull() & serves),
        F.lit(False),
    )


def caller_pairs(spans: DataFrame, arrived: str | None = None, window: str = "5 minutes") -> DataFrame:
    """(child, parent): spans that may be known by their parent only, with what is needed of that parent.

    A plain join in batch.  On a stream, ``arrived`` is the watermarked time of
    arrival: pairs meet within ``window`` of each other, in whatever batches
    they come, and state older than that is dropped.
    """
    timed = [F.col(arrived)] if arrived else []
    few = F.map_filter("attributes", lambda k, _: k.startswith("code."))
    parent = F.struct(*(few.alias(c) if c == "attributes" else F.col(c) for c in PARENT))
    child = spans.filter(F.col("parentSpanId").isNotNull() & ~tells_itself(F.col("kind")))
    child = child.select(F.struct(*(f.name for f in SPANS.fields)).alias("child"), F.col("traceId").alias("_t"), F.col("parentSpanId").alias("_p"), *(c.alias("_c") for c in timed))
    above = spans.select(parent.alias("parent"), F.col("traceId").alias("_pt"), F.col("spanId").alias("_ps"), *(c.alias("_a") for c in timed))
    same = (F.col("_t") == F.col("_pt")) & (F.col("_p") == F.col("_ps"))
    if arrived:
        same = same & F.expr(f"_c between _a - interval {window} and _a + interval {window}")
    return child.join(above, same).filter("child.service <> parent.service").select("child", "parent")


def _evidence() -> Column:
    """What a placed span tells of the site of its call."""
    no_text = F.lit(None).cast("string")
    return F.when(F.col("_rel").isNotNull(), F.struct(F.col("_rel").alias("file"), F.col("_line").alias("line"), no_text.alias("snippet"), F.col("httpMethod").alias("method"), F.col("httpRoute").alias("pathTemplate"), no_text.alias("hostSource")))


def with_pairs(spans: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """spans (``_role`` null), and of each pair the child (c) and the parent (p) under one ``_pair``, so that all are placed in one pass.

    Without ``pairs`` parents are sought among the spans themselves, once these
    are placed: then there are the spans alone, without ``_role``.
    """
    if pairs is None:
        return conform(spans, SPANS)
    pairs = materialise(pairs.withColumn("_pair", F.monotonically_increasing_id()))
    names = [f.name for f in SPANS.fields]
    side = lambda df, role: conform(df, SPANS).select(*names) if role is None else conform(df.select(f"{role}.*", "_pair"), struct_with(SPANS))
    own = side(spans, None).select(*names, F.lit(None).cast("long").alias("_pair"), F.lit(None).cast("string").alias("_role"))
    return own.unionByName(side(pairs, "child").withColumn("_role", F.lit("c"))).unionByName(side(pairs, "parent").withColumn("_role", F.lit("p")))


def struct_with(schema: T.StructType) -> T.StructType:
    """A schema with the key of pairs behind it."""
    return T.StructType([*schema.fields, T.StructField("_pair", T.LongType())])


def calls(spans: DataFrame, graph: Graph) -> DataFrame:
    """Every call that spans (``placed`` ``with_pairs``, then ``evaluated``) tell of: (type, source, target, ts, isError, ms, evidence, traceId, spanId), the node it goes to and where it comes from.

    Database, messaging, GraphQL, gRPC and WebSocket spans come first; what is
    none of these, or does not stand on the side that tells, is a call to a
    peer, or else from the parent's service.  A span that serves a declared
    route also tells of that route.
    """
    paired = "_role" in spans.columns
    s = spans.filter("_role is null") if paired else spans
    kept = ["ts", "isError", "ms", "evidence", "traceId", "spanId", "site"]
    direct = s.select(F.inline("_calls"), *kept, "dbColumns")
    no_columns = F.lit(None).cast("array<string>").alias("dbColumns")
    # Spans that told nothing themselves: their parent's service called theirs.
    child, above = spans.filter("_typed is null and size(_calls) = 0"), spans
    if paired:
        child, above, meet = child.filter("_role = 'c'"), above.filter("_role = 'p'"), ["_pair"]
    else:
        child, meet = child.filter("parentSpanId is not null").withColumnsRenamed({"traceId": "_trace", "parentSpanId": "_parent"}), ["_trace", "_parent"]
        above = above.select("*", F.col("traceId").alias("_trace"), F.col("spanId").alias("_parent"))
        child = child.withColumn("traceId", F.col("_trace"))
    child = child.select(*meet, F.col("_svc").alias("target"), "service", "ts", "isError", "ms", "traceId", "spanId")
    above = above.select(*meet, F.col("service").alias("_caller"), F.col("_src").alias("source"), "evidence", "site")
    fallback = child.join(whole(above), meet).filter("service <> _caller").select(F.lit("CALLS").alias("type"), "source", "target", _target("ServiceNode", F.col("service")).alias("node"), *kept, no_columns)
    out = direct.unionByName(fallback)
    template = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(inc.attribute(F.col("attributes"), "next.span_name"), "name"), r"^executing api route \((?:pages|app)\) (/\S*)$", 1), F.lit("")), "httpRoute")
    asked = s.filter(sp.serves(F.col("kind"))).withColumns({"template": template, "method": F.upper("httpMethod")}).filter("template is not null")
    routes = materialise(route_matches(asked, graph.nodes)).withColumnsRenamed({"service": "_s", "method": "_m", "template": "_t"})
    same = (F.col("service") == F.col("_s")) & (F.col("template") == F.col("_t")) & F.col("method").eqNullSafe(F.col("_m"))
    no_evidence = F.lit(None).cast(evidence_type())
    served = asked.join(routes, same).select(F.lit("CONTAINS").alias("type"), ids.service_id("service").alias("source"), F.col("route").alias("target"), _target("RouteNode", "template").alias("node"), "ts", "isError", "ms", no_evidence.alias("evidence"), "traceId", "spanId", F.lit(None).cast(s.schema["site"].dataType).alias("site"), no_columns)
    return out.unionByName(served).filter("source <> target and target is not null")


#: What is asked of a span once its calls are known.
EVALUATED = (
    "service", "env", "traceId", "spanId", "parentSpanId", "name", "kind", "startTimeUnixNano", "statusCode", "attributes", "exception", "dbColumns", "httpRoute", "httpMethod",
    "_pair", "_role", "_svc", "_known", "_file", "_symbol", "_src", "evidence", "site", "ts", "isError", "ms", "_typed", "_calls",
)


def evaluated(s: DataFrame) -> DataFrame:
    """``EVALUATED`` of placed spans with ``_typed``, the calls their protocol tells of (null if it tells nothing), and ``_calls``, these or those to a peer."""
    out, serves = sp.calls_out(F.col("kind")), sp.serves(F.col("kind"))

    def call(kind: str, target, node, source="_src"):
        return F.struct(F.lit(kind).alias("type"), F.col(source).alias("source"), target.alias("target"), node.alias("node"))

    local_name = F.coalesce("dbName", "dbSystem")
    database = F.when(F.col("_peer").isNotNull(), ids.database_id("_peer")).otherwise(F.coalesce("_declared", ids.database_id(None, "service", local_name)))
    database_node = _target("DatabaseNode", F.coalesce("_peer", local_name), engine="dbSystem", host="_peer")
    collection = inc.attribute(F.col("attributes"), "db.collection.name", "db.mongodb.collection")
    table = F.coalesce("dbTable", text.sql_table(F.col("dbStatement")))
    infra = lambda kind, name: _target("InfraNode", name, provider=F.lit("self"), kind=kind)
    db = F.array_compact(
        F.array(
            F.when(out, call("CONNECTS_TO", database, database_node)),
            F.when(out & (F.col("dbSystem") == "mongodb") & collection.isNotNull(), call("CALLS", ids.infra_id(F.lit("mongodb-collection"), collection), infra(F.lit("mongodb-collection"), collection))),
            F.when(out & (F.col("dbSystem") != "mongodb") & table.isNotNull(), call("CALLS", ids.infra_id(F.lit("sql-table"), table), infra(F.lit("sql-table"), table))),
        )
    )
    topic_kind = F.concat("messagingSystem", F.lit("-topic"))
    topic, topic_node = ids.infra_id(topic_kind, "messagingDestination"), infra(topic_kind, "messagingDestination")
    messages = F.when(F.col("kind") == 5, F.array(call("CONSUMES_FROM", topic, topic_node))).otherwise(F.array(call("PUBLISHES_TO", topic, topic_node)))
    graphql_kind = F.lower("graphqlOperationType")
    graphql_node = _target("GraphQLOperationNode", "graphqlOperationName", service="service", operationType=graphql_kind, operationName="graphqlOperationName")
    graphql = F.array(call("CONTAINS", ids.graphql_id("service", "graphqlOperationType", "graphqlOperationName"), graphql_node))
    grpc_node = _target("GrpcMethodNode", "rpcMethod", rpcService="rpcService", rpcMethod="rpcMethod")
    grpc = F.array(call("CONTAINS", ids.grpc_id("rpcService", "rpcMethod"), grpc_node))
    socket_node = _target("WebSocketChannelNode", "websocketChannel", service="service", channel="websocketChannel")
    websocket = F.array(call("CONNECTS_TO", ids.websocket_id("service", "websocketChannel"), socket_node))
    foreign = F.col("_peer").isNotNull() & (F.lower("_peer") != F.lower("service")) & ~sp.is_loopback(F.col("_peer"))
    none = F.slice(F.array(call("CALLS", F.col("_svc"), _target("ServiceNode", "service"))), 1, 0)
    http = F.when(out & foreign & (F.col("_to") != F.col("_svc")), F.array(call("CALLS", F.col("_to"), _target("ServiceNode", "_peer"))))
    http = http.when(out & foreign & F.col("_to").isNull(), F.array(call("CALLS", ids.frontier_id("_peer"), _target("FrontierNode", "_peer", host="_peer")))).otherwise(none)
    typed = (
        F.when(F.col("dbSystem").isNotNull(), db)
        .when(F.col("messagingSystem").isNotNull() & F.col("messagingDestination").isNotNull() & sp.moves_messages(F.col("kind")), messages)
        .when(F.col("graphqlOperationName").isNotNull() & F.col("graphqlOperationType").isNotNull() & serves, graphql)
        .when((F.col("rpcSystem") == "grpc") & F.col("rpcService").isNotNull() & F.col("rpcMethod").isNotNull() & serves, grpc)
        .when(F.col("websocketChannel").isNotNull() & serves, websocket)
    )
    stream = sp.is_stream(F.col("durationNanos"), F.col("attributes"), F.col("websocketChannel"))
    # Columns belong to the table that the same statement names.
    facts = {"ts": F.timestamp_micros((F.col("startTimeUnixNano") / 1000).cast("long")), "isError": sp.is_error(F.col("statusCode"), F.col("attributes")), "ms": sp.latency_ms(F.col("durationNanos"), stream)}
    out = s.withColumn("evidence", _evidence()).withColumns(facts).withColumn("_typed", typed).withColumn("_calls", F.coalesce("_typed", http))
    return out.select(*(c for c in EVALUATED if c in out.columns))


def evidence_type():
    return EDGES["evidence"].dataType


def dispatch(spans: DataFrame, graph: Graph) -> DataFrame:
    """(type, source, target, ts, isError, ms, evidence, traceId, spanId) of every call that spans tell of."""
    return materialise(calls(materialise(evaluated(placed(with_pairs(spans), graph))), graph)).drop("node", "site", "dbColumns")


def observed_edges(spans: DataFrame, graph: Graph, dedupe: bool = False) -> DataFrame:
    """Observed edges of a batch of spans.  Redelivered spans count again unless ``dedupe``."""
    if dedupe:
        spans = spans.dropDuplicates(["traceId", "spanId"])
    return fold_observed(dispatch(spans, graph))


@dataclass(frozen=True)
class Landed:
    """What a batch of spans brings.

    Nodes that are new or changed (whole rows), edges to fold, incidents to
    append.  ``observed`` are the edges without inferred ones, ``failing`` the
    services from which these are inferred, ``placed`` the spans at their place.
    """

    nodes: DataFrame
    edges: DataFrame
    incidents: DataFrame
    observed: DataFrame
    failing: DataFrame
    placed: DataFrame


#: Tables whose nodes carry columns, and how sure a column is that a statement touched.
COLUMN_KINDS = ("sql-table", "supabase-table")
OBSERVED_COLUMN = 0.9


def land(spans: DataFrame, graph: Graph, dedupe: bool = False, pairs: DataFrame | None = None, tell_bursts: bool = True) -> Landed:
    """A batch of spans, from services to incidents.

    Nodes: services, databases, infrastructure, frontiers, operations, methods,
    channels, files and symbols that the graph lacks, frontiers seen again, and
    tables with the columns that statements touched.  Edges: observed calls,
    served routes, containment of observed files and symbols, and edges
    inferred where a span failed (status 2).  Incidents: failed spans, and
    bursts of client failures within the batch (if ``tell_bursts``).  No input
    row is dropped: spans without a service count as ``unidentified`` where they
    are read.  Only ``graph`` is asked, so a part of the spans lands the same
    beside any other; ``pairs`` brings children whose parents came elsewhere.
    """
    if dedupe:
        spans = spans.dropDuplicates(["traceId", "spanId"])
    if pairs is None:
        # Read several times: requests are parsed once.
        spans = materialise(spans)
    # Both are read many times below: cut their plans, so that spans are joined once.
    every = materialise(evaluated(placed(with_pairs(spans, pairs), graph)))
    told = materialise(calls(every, graph))
    at = every if pairs is None else every.filter("_role is null")
    known = whole(graph.nodes.select("id"))

    otel = F.lit("otel").alias("discoveredVia")
    services = at.filter("not _known").groupBy(F.col("_svc").alias("id")).agg(F.min("service").alias("name"), F.min(F.nullif("env", F.lit("unknown"))).alias("env"))
    services = services.select("id", F.lit("ServiceNode").alias("type"), "name", "env", F.lit("unknown").alias("language"), otel)
    files = told.filter("site.file is not null").groupBy(F.col("site.file").alias("id")).agg(F.min("site.name").alias("service"), F.min("site.path").alias("path"))
    files = files.select("id", F.lit("FileNode").alias("type"), F.substring_index("path", "/", -1).alias("name"), "service", "path", sp.language(F.col("path")).alias("language"), otel)
    symbols = told.filter("site.minted is not null").groupBy(F.col("site.minted").alias("id")).agg(F.min("site").alias("m"), F.min("site.line").alias("line"))
    symbols = symbols.select("id", F.lit("SymbolNode").alias("type"), F.col("m.function").alias("name"), F.lit("function").alias("kind"), F.col("m.function").alias("qualname"), F.col("m.name").alias("service"), F.col("m.path").alias("relPath"), F.struct(F.col("line").alias("startLine"), F.col("line").alias("endLine")).alias("span"), otel)
    targets = told.filter("node.type not in ('ServiceNode', 'RouteNode')").groupBy(F.col("target").alias("id")).agg(F.min("node").alias("m"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    is_frontier = F.col("m.type") == "FrontierNode"
    version = F.when(F.col("m.type") == "DatabaseNode", F.lit("unknown"))
    targets = targets.select("id", "m.*", version.alias("engineVersion"), F.when(is_frontier, F.col("first")).alias("firstObserved"), F.when(is_frontier, F.col("last")).alias("lastObserved"), F.when(~is_frontier & (F.col("m.type") != "InfraNode"), "otel").alias("discoveredVia"))
    new = None
    for df in (services, files, symbols, targets):
        rows = conform(df, NODES)
        new = rows if new is None else new.unionByName(rows)
    new = new.join(known, "id", "left_anti")

    touched = told.filter(F.col("node.kind").isin(*COLUMN_KINDS) & (F.size("dbColumns") > 0)).select(F.col("target").alias("table"), F.explode("dbColumns").alias("column"))
    touched = touched.distinct().select("table", "column", F.lit("OBSERVED").alias("provenance"), F.lit(OBSERVED_COLUMN).alias("confidence"), F.lit(None).cast("string").alias("sdk"))
    tables = touched.select(F.col("table").alias("id")).distinct()
    before = graph.nodes.join(tables, "id", "left_semi").select(F.col("id").alias("table"), F.explode("columns").alias("c"))
    before = before.select("table", F.col("c.name").alias("column"), F.explode_outer("c.provenances").alias("provenance"), F.col("c.confidence").alias("confidence"), "c.sdkWrites").select("table", "column", "provenance", "confidence", F.explode_outer("sdkWrites").alias("sdk"))
    folded = fold_columns(touched.unionByName(before)).withColumnsRenamed({"table": "id", "columns": "_columns"})
    seen = told.filter("node.type = 'FrontierNode'").groupBy(F.col("target").alias("id")).agg(F.max("ts").alias("_seen"))
    again = graph.nodes.join(tables.union(seen.select("id")), "id", "left_semi")
    rows = new.unionByName(again.select(*new.columns)).join(folded, "id", "left").join(seen, "id", "left")
    last = F.when(F.col("type") == "FrontierNode", F.greatest("lastObserved", "_seen")).otherwise(F.col("lastObserved"))
    nodes = conform(rows.withColumns({"columns": F.coalesce("_columns", "columns"), "lastObserved": last}), NODES)

    observed = materialise(fold_observed(told))
    contains = told.filter("site.file is not null").select(F.col("site.svc").alias("source"), F.col("site.file").alias("target"))
    contains = contains.union(told.filter("site.minted is not null").select("site.file", "site.minted")).distinct()
    contains = contains.select(ids.edge_id("CONTAINS", "source", "target", "OBSERVED").alias("id"), "source", "target", F.lit("CONTAINS").alias("type"), F.lit("OBSERVED").alias("provenance"))
    failing = at.filter("statusCode = 2").select(F.col("_svc").alias("service"))
    inferred = stitch(Graph(graph.nodes, graph.edges.unionByName(observed), graph.now), failing)
    declared = whole(graph.edges.select("id"))
    seen = observed.unionByName(conform(contains, EDGES).join(declared, "id", "left_anti").select(*observed.columns))
    edges = seen.unionByName(inferred.join(declared, "id", "left_anti").select(*observed.columns))

    incidents = span_incidents(at, F.coalesce("_symbol", "_file", "_svc"))
    if tell_bursts:
        incidents = incidents.unionByName(burst_incidents(at))
    return Landed(nodes, edges, incidents, seen, failing.distinct(), at)


def burst_incidents(spans: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One incident for each burst of client failures: how many, the commonest code, from when to when.

    ``failures`` are those of the spans, if earlier ones are to be counted with them.
    """
    found = inc.bursts(client_failures(spans) if failures is None else failures, ["service", "peer"], "ms", "code", last="id")
    iso = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    node = spans.groupBy("service").agg(F.min("_svc").alias("affectedNode"))
    said = F.concat(F.col("n").cast("string"), F.lit(" consecutive HTTP "), F.col("code").cast("string"), F.lit(" responses to "), F.col("peer"))
    made = found.join(node, "service").select(
        "id",
        iso(F.col("last_ms")).alias("timestamp"),
        "service",
        F.substring_index("id", ":", 1).alias("traceId"),
        F.substring_index("id", ":", -1).alias("spanId"),
        F.lit("http-failure").alias("errorType"),
        said.alias("errorMessage"),
        "affectedNode",
        F.col("code").alias("httpStatusCode"),
        F.col("n").cast("int").alias("incidentCount"),
        iso(F.col("first_ms")).alias("firstTimestamp"),
        iso(F.col("last_ms")).alias("lastTimestamp"),
    )
    return conform(made, INCIDENTS)


def overlay(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """nodes with the rows of ``changed`` in place of those of the same id."""
    return nodes.join(changed.select("id"), "id", "left_anti").select(*nodes.columns).unionByName(changed.select(*nodes.columns))


def parent_calls(spans: DataFrame) -> DataFrame:
    """(traceId, spanId, parentSpanId, service, parentService): spans with the span that started them."""
    parents = spans.select("traceId", F.col("spanId").alias("parentSpanId"), F.col("service").alias("parentService"))
    return spans.select("traceId", "spanId", "parentSpanId", "service").join(parents, ["traceId", "parentSpanId"])


def span_incidents(spans: DataFrame, affected: Column | None = None) -> DataFrame:
    """Incidents of failed spans: status 2 or an exception, else HTTP 500 and above, else a gRPC failure.

    ``affected`` names the node at fault; without it, the file of the call site as observed, else the service.
    """
    a = F.col("attributes")
    failed = sp.is_error(F.col("statusCode"), a) | F.col("exception").isNotNull()
    path = sp.code_path(a)
    if affected is None:
        affected = F.when(path.isNotNull(), sp.source_node(F.col("service"), F.col("env"), a)).otherwise(ids.service_id("service", "env"))
    made = spans.filter(failed).select(
        F.concat("traceId", F.lit(":"), "spanId").alias("id"),
        text.iso_from_nanos(F.col("startTimeUnixNano")).alias("timestamp"),
        "service",
        "traceId",
        "spanId",
        inc.attribute(a, "error.type").alias("errorType"),
        inc.message(F.col("exception.message"), a).alias("errorMessage"),
        F.col("exception.type").alias("exceptionType"),
        F.col("exception.stacktrace").alias("exceptionStacktrace"),
        "attributes",
        affected.alias("affectedNode"),
        inc.http_status(a).alias("httpStatusCode"),
    )
    return conform(made, INCIDENTS)


def client_failures(spans: DataFrame) -> DataFrame:
    """(service, peer, ms, code, id): 400s seen by callers, of which bursts are incidents."""
    code = inc.http_status(F.col("attributes"))
    return spans.filter(sp.calls_out(F.col("kind")) & code.between(400, 499) & (F.coalesce("statusCode", F.lit(0)) != 2)).select("service", F.coalesce(sp.peer(F.col("attributes")), "spanId").alias("peer"), (F.col("startTimeUnixNano") / 1_000_000).cast("long").alias("ms"), code.alias("code"), F.concat("traceId", F.lit(":"), "spanId").alias("id"))


def route_to_projects(spans: DataFrame, projects: DataFrame, default: str = "default") -> DataFrame:
    """spans with the project they belong to.

    projects: (project, paused).  A project of the service's name wins, then
    one whose name is the longest leading run of its ``-`` or ``_`` parts, then
    one that is among its parts, else the default.  Services are few, so names
    are matched once each.
    """
    seen = spans.select("service").distinct()
    parts = F.split(F.lower("service"), "[-_]")
    live = projects.filter("not coalesce(paused, false)").select("project", F.lower("project").alias("_p"))
    runs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    keys = F.array_distinct(F.concat(F.array(F.struct(F.lit(0).alias("o"), F.lower("service").alias("k"))), F.transform(runs, lambda r: F.struct(F.lit(1).alias("o"), r.alias("k"))), F.transform(parts, lambda r: F.struct(F.lit(2).alias("o"), r.alias("k")))))
    tried = seen.select("service", F.inline(keys))
    hit = tried.join(live, F.col("k") == F.replace("_p", F.lit("_"), F.lit("-"))).groupBy("service").agg(F.min(F.struct("o", (-F.length("k")).alias("n"), "project")).alias("m")).select("service", F.col("m.project").alias("_project"))
    return spans.join(hit, "service", "left").withColumn("project", F.coalesce("_project", F.lit(default))).drop("_project")
