"""Queries over the driver's tables: each applies an operator of the engine to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions import latency, text, versions, weights
from ..operators import ask, compat, divergence, incidents, ingest, lifecycle, policy, rootcause, search, traverse
from ..operators.graph import Graph
from ..schema import EDGES, conform
from ..sources import connectors, tables
from . import bound

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROOT_PARTS = tuple(f"infra:sql-table:part-{i}" for i in (1, 2, 3))
ROOT_DATABASES = tuple(f"database:nation-{i}.db" for i in range(5))
ROOT_CUSTOMERS = tuple(f"service:customer-{i}" for i in range(1, 31))
ROOT_SUPPLIERS = tuple(f"service:supplier-{i}" for i in range(1, 6))
PAIRS = [(f"service:customer-{i}", f"infra:sql-table:part-{j}") for i in range(1, 21) for j in (1, 2)] + [("infra:sql-table:part-1", "service:customer-1"), ("service:customer-1", "service:nowhere")]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(c):
    return F.round(c, 6)


def _joined(c):
    return F.array_join(c, ">")


def _calls(t: dict[str, DataFrame]) -> DataFrame:
    j = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(
        F.lit("CALLS").alias("type"), F.concat(F.lit("service:customer-"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("service:supplier-"), F.col("l_suppkey").cast("string")).alias("target"),
        F.col("l_shipdate").alias("ts"), (F.col("l_returnflag") == "R").alias("isError"), F.col("l_quantity").alias("ms"), F.lit(None).cast("struct<file:string,line:int,snippet:string,method:string,pathTemplate:string,hostSource:string>").alias("evidence"),
    )


@query
def blast_radius_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traverse.blast_radius(bound.graph(spark, sf_dir), list(ROOT_PARTS + ROOT_DATABASES))
    return found.select("root", "node", "distance", "provenance", _joined("path").alias("path"), six("confidence").alias("confidence"))


@query
def edge_observed_upsert(spark, sf_dir):
    e = lifecycle.fold_observed(_calls(bound.tables(spark, sf_dir)))
    return e.select("id", F.col("signal.spanCount").alias("span_count"), F.col("signal.errorCount").alias("error_count"), F.date_format("lastObserved", "yyyy-MM-dd").alias("last_day"), "confidence", F.col("signal.latencyMs.p50").alias("p50"), F.col("signal.latencyMs.p95").alias("p95"))


@query
def observed_confidence(spark, sf_dir):
    e = bound.graph(spark, sf_dir).edges.filter("signal is not null")
    return e.select("id", weights.observed_confidence(F.col("signal.spanCount"), F.col("signal.errorCount")).alias("grade"))


@query
def edge_confidence(spark, sf_dir):
    return bound.graph(spark, sf_dir).with_confidence().select("id", six("weight").alias("weight"))


@query
def edge_confidence_live_age(spark, sf_dir):
    g = bound.graph(spark, sf_dir)
    return g.edges.select("id", six(weights.edge_confidence(g.now_column(), live_age=True)).alias("weight"))


@query
def precision_floor(spark, sf_dir):
    e = bound.graph(spark, sf_dir).edges
    kept = weights.passes_floor(F.col("provenance"), F.col("confidence"), 0.8)
    return e.groupBy("type", "provenance", kept.alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@query
def best_edge_per_neighbour(spark, sf_dir):
    return bound.graph(spark, sf_dir).best_edges("up").select("near", "far", F.col("edge.id").alias("id"), F.col("edge.provenance").alias("provenance"))


@query
def transitive_dependencies(spark, sf_dir):
    found = traverse.transitive_dependencies(bound.graph(spark, sf_dir), list(ROOT_CUSTOMERS[:10] + ROOT_SUPPLIERS), 2)
    return found.select("root", "node", "distance", "edgeType", "provenance", _joined("path").alias("path"), six("confidence").alias("confidence"))


@query
def observed_dependencies(spark, sf_dir):
    return traverse.observed_dependencies(bound.graph(spark, sf_dir), list(ROOT_SUPPLIERS))[0].select("origin", "id", "source", "target", "type", "callCount")


@query
def observed_summary(spark, sf_dir):
    g = bound.graph(spark, sf_dir)
    s = traverse.observed_dependencies(g, g.nodes.filter("type = 'ServiceNode'").select(F.col("id").alias("root")))[1]
    return s.withColumn("inboundLastObserved", F.date_format("inboundLastObserved", "yyyy-MM-dd"))


@query
def node_context(spark, sf_dir):
    c = traverse.classified_context(bound.graph(spark, sf_dir))
    return c.select("node", "errorsEmittedHere", "errorsFromCallers", "callCount", "outboundVolume", "latencyP95Ms", "stale", "classification", "victim")


@query
def expand_up(spark, sf_dir):
    return traverse.expand(bound.graph(spark, sf_dir), list(ROOT_SUPPLIERS), "up").select("origin", "node", "edgeType", "provenance", "classification", "outboundVolume")


@query
def expand_down(spark, sf_dir):
    return traverse.expand(bound.graph(spark, sf_dir), list(ROOT_CUSTOMERS), "down").select("origin", "node", "edgeType", "provenance", "classification", "callCount")


@query
def find_path(spark, sf_dir):
    return traverse.find_path(bound.graph(spark, sf_dir), PAIRS, "down").select("a", "b", _joined("path").alias("path"), "length")


@query
def relate(spark, sf_dir):
    r = traverse.relate(bound.graph(spark, sf_dir), PAIRS)
    return r.select("a", "b", "related", "direction", _joined("down.path").alias("down"), _joined("up.path").alias("up"), "grainGap", "note")


@query
def longest_walk(spark, sf_dir):
    w = traverse.longest_incoming_walks(bound.graph(spark, sf_dir), list(ROOT_PARTS + ROOT_DATABASES))
    return w.select("root", _joined("path").alias("path"), six("confidence").alias("confidence"))


@query
def failing_chain(spark, sf_dir):
    return rootcause.failing_chains(bound.graph(spark, sf_dir), list(ROOT_CUSTOMERS)).select("root", _joined("path").alias("path"), F.array_join(F.transform("errors", lambda e: e.cast("string")), ",").alias("errors"), six("confidence").alias("confidence"))


@query
def stale_chain(spark, sf_dir):
    return rootcause.stale_chains(bound.graph(spark, sf_dir), list(ROOT_CUSTOMERS)).select("root", _joined("path").alias("path"), six("confidence").alias("confidence"))


@query
def load_origin(spark, sf_dir):
    return rootcause.load_origin(bound.graph(spark, sf_dir), list(ROOT_SUPPLIERS)).select("alert", "node", "outboundVolume", "callCount")


@query
def root_cause_base(spark, sf_dir):
    t = bound.tables(spark, sf_dir)
    return rootcause.base_causes(bound.graph(spark, sf_dir, t), list(ROOT_CUSTOMERS + ROOT_DATABASES), _incidents(t)).select("root", "source", "culprit", "reason", _joined("path").alias("path"), six("confidence").alias("confidence"))


@query
def root_cause_all(spark, sf_dir):
    """The navigated cause of every service, in one set of joins."""
    t = bound.tables(spark, sf_dir)
    g = bound.graph(spark, sf_dir, t)
    services = g.nodes.filter("type = 'ServiceNode'").select(F.col("id").alias("root"))
    found = rootcause.navigated_causes(g, services, _incidents(t))
    return found.select("root", "node", "phase", "reason", _joined("path").alias("path"), six("confidence").alias("confidence"), F.size("candidates").alias("candidates"))


@query
def longest_walk_all(spark, sf_dir):
    """The longest walk against the edges from every database and supplier; suppliers are hubs of callers."""
    g = bound.graph(spark, sf_dir)
    roots = g.nodes.filter("type = 'DatabaseNode' or id like 'service:supplier-%'").select(F.col("id").alias("root"))
    return traverse.longest_incoming_walks(g, roots).select("root", _joined("path").alias("path"), six("confidence").alias("confidence"))


@query
def latency_hist(spark, sf_dir):
    li = bound.tables(spark, sf_dir)["lineitem"]
    return latency.histogram(li, ["l_suppkey"], "l_extendedprice")


@query
def latency_quantile(spark, sf_dir):
    li = bound.tables(spark, sf_dir)["lineitem"]
    return latency.quantiles(latency.histogram(li, ["l_suppkey"], "l_extendedprice"), ["l_suppkey"], {"p50": 0.5, "p95": 0.95})


@query
def counter_delta(spark, sf_dir):
    ev = bound.tables(spark, sf_dir)["events"]
    q = F.col("user_id") % 40
    polls = ev.select(F.col("event_id").alias("poll"), q.alias("queryid"), F.concat(F.lit("SELECT a FROM public.t_"), q.cast("string"), F.lit(" WHERE b = 1")).alias("query"), (F.col("event_id") * 7919 % 1000).alias("calls"))
    return connectors.statement_deltas(polls).select("targetName", "callCount", "errorCount")


@query
def route_normalise(spark, sf_dir):
    p = bound.tables(spark, sf_dir)["pages"]
    return p.select("page_id", text.normalised_template(text.url_path(F.col("url"))).alias("template"))


@query
def url_host(spark, sf_dir):
    p = bound.tables(spark, sf_dir)["pages"]
    return p.groupBy(text.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query
def parent_span_join(spark, sf_dir):
    # Of lines with the same number in an order the one of the smallest supplier is the span.
    li = bound.tables(spark, sf_dir)["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    spans = li.select(F.col("l_orderkey").cast("string").alias("traceId"), F.col("l_linenumber").cast("string").alias("spanId"), F.when(F.col("l_linenumber") > 1, (F.col("l_linenumber") - 1).cast("string")).alias("parentSpanId"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("service"))
    joined = ingest.parent_calls(spans)
    return joined.groupBy("parentService", "service").agg(F.count(F.lit(1)).alias("n"))


@query
def shape_counts(spark, sf_dir):
    return ask.shape(bound.graph(spark, sf_dir))


@query
def busiest(spark, sf_dir):
    return ask.busiest(bound.graph(spark, sf_dir))


@query
def unobserved(spark, sf_dir):
    return ask.unobserved(bound.graph(spark, sf_dir))


@query
def symbol_range_join(spark, sf_dir):
    t = bound.tables(spark, sf_dir)
    spans = spark.createDataFrame([("outer", 1, 60), ("outer.mid", 10, 30), ("outer.mid.low", 20, 25), ("late", 20, 25)], "q string, a int, b int")
    symbols = t["supplier"].crossJoin(F.broadcast(spans)).select(F.lit("SymbolNode").alias("type"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("service"), F.lit("src/app.py").alias("relPath"), F.col("q").alias("qualname"), F.struct(F.col("a").alias("startLine"), F.col("b").alias("endLine")).alias("span"))
    symbols = symbols.withColumn("id", ids.symbol_id("service", "relPath", "qualname"))
    sites = t["lineitem"].select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), F.concat(F.lit("file:supplier-"), F.col("l_suppkey").cast("string"), F.lit(":src/app.py")).alias("file"), F.col("l_quantity").cast("int").alias("line"), F.when(F.col("l_returnflag") == "R", "late").otherwise("other").alias("function"))
    # Of lines with the same number in an order the smallest supplier's is the site, then the smaller line, then the smaller name.
    order = F.struct(F.regexp_extract("file", r"(\d+):", 1).cast("long").alias("supplier"), "line", "function", "file")
    sites = sites.groupBy("site").agg(F.min(order).alias("m")).select("site", "m.file", "m.line", "m.function")
    found = ingest.enclosing_symbols(sites, symbols)
    return found.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("site").alias("sites"))


def _rounded(d: DataFrame) -> DataFrame:
    return d.select("type", "source", "target", "edgeType", "column", six("confidence").alias("confidence"))


@query
def divergence_missing_observed(spark, sf_dir):
    return _rounded(divergence.missing(bound.graph(spark, sf_dir)).filter("type = 'missing-observed'"))


@query
def divergence_missing_extracted(spark, sf_dir):
    return _rounded(divergence.missing(bound.graph(spark, sf_dir)).filter("type = 'missing-extracted'"))


@query
def divergence_host_mismatch(spark, sf_dir):
    return divergence.host_mismatch(bound.graph(spark, sf_dir)).select("source", "target", "declared", "observed", six("confidence").alias("confidence"))


@query
def divergence_compatibility(spark, sf_dir):
    return divergence.compatibility(bound.graph(spark, sf_dir), compat.Matrix(spark)).select("type", "source", "target", "declared", "observed")


@query
def divergence_column_drift(spark, sf_dir):
    return _rounded(divergence.column_drift(bound.graph(spark, sf_dir)))


@query
def divergence_ranked(spark, sf_dir):
    return _rounded(divergence.divergences(bound.graph(spark, sf_dir), types={"missing-observed", "host-mismatch", "version-mismatch", "compat-violation"}))


def _policy(kind: str, **rule) -> policy.Policy:
    return policy.Policy(f"p-{kind}", kind, "critical" if kind == "structural" else "warning", {"type": kind, **rule})


def _violations(d: DataFrame) -> DataFrame:
    return d.select("id", "severity", "onViolation", "nodeId", "edgeId")


@query
def policy_structural(spark, sf_dir):
    return _violations(policy.structural(bound.graph(spark, sf_dir), _policy("structural", fromNodeType="ServiceNode", edgeType="CONNECTS_TO", toNodeType="DatabaseNode")))


@query
def policy_ownership(spark, sf_dir):
    return _violations(policy.ownership(bound.graph(spark, sf_dir), _policy("ownership", nodeType="ServiceNode")))


@query
def policy_provenance(spark, sf_dir):
    return _violations(policy.provenance(bound.graph(spark, sf_dir), _policy("provenance", edgeType="CALLS", required=["OBSERVED", "INFERRED"])))


@query
def policy_blast_radius(spark, sf_dir):
    return _violations(policy.blast_radius(bound.graph(spark, sf_dir), policy.Policy("p-blast-radius", "b", "error", {"type": "blast-radius", "nodeType": "DatabaseNode", "maxAffected": 60, "depth": 2})))


@query
def policy_compatibility(spark, sf_dir):
    return _violations(policy.evaluate(bound.graph(spark, sf_dir), [_policy("compatibility")])).drop("edgeId")


@query
def policy_field_guard(spark, sf_dir):
    return _violations(policy.field_guard(bound.graph(spark, sf_dir), _policy("field-guard", nodeType="InfraNode", nodeKind="firestore-collection", guardSet="guardedFields", subjectSet="client-written-columns")))


@query
def policy_check(spark, sf_dir):
    p = [_policy("structural", fromNodeType="ServiceNode", edgeType="CONNECTS_TO", toNodeType="DatabaseNode"), _policy("ownership", nodeType="ServiceNode")]
    return policy.check(bound.graph(spark, sf_dir), p).drop("hypothetical")


@query
def policy_applicable(spark, sf_dir):
    p = [_policy("structural", fromNodeType="ServiceNode", edgeType="CONNECTS_TO", toNodeType="DatabaseNode"), _policy("provenance", edgeType="DEPENDS_ON", required="OBSERVED")]
    return policy.applicable(bound.graph(spark, sf_dir), p).groupBy("policyId", "role").agg(F.count(F.lit(1)).alias("n"))


@query
def policy_reach(spark, sf_dir):
    """Nodes that a blast-radius rule on databases has to do with: the databases, and what depends on them."""
    p = [_policy("blast-radius", nodeType="DatabaseNode", maxAffected=60, depth=2)]
    return policy.applicable(bound.graph(spark, sf_dir), p).select("node", "role")


_THRESHOLDS = {"CALLS": 365 * 86_400_000, "CONNECTS_TO": 3_600_000}


@query
def stale_sweep(spark, sf_dir):
    return lifecycle.stale_sweep(bound.graph(spark, sf_dir), _THRESHOLDS)[0].groupBy("type", "provenance").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("c")).withColumn("c", six("c"))


@query
def stale_events(spark, sf_dir):
    return lifecycle.stale_sweep(bound.graph(spark, sf_dir), _THRESHOLDS)[1].select("edgeId", "edgeType", "thresholdMs", "ageMs")


@query
def trace_stitch(spark, sf_dir):
    g = bound.graph(spark, sf_dir)
    starts = g.nodes.filter("type = 'ServiceNode'").select(F.col("id").alias("service"))
    return lifecycle.stitch(g, starts).select("id", "source", "target", "type", "provenance", "confidence")


@query
def frontier_promotion(spark, sf_dir):
    p = lifecycle.promote(bound.graph(spark, sf_dir))
    return p.edges.filter("type = 'DEPENDS_ON'").select("id", "source", "target", "callCount")


def _incidents(t: dict[str, DataFrame]) -> DataFrame:
    """Events as incidents: errors of users are failures of the customer of that number."""
    ev = t["events"].filter("event_type in ('error', 'view')")
    failed = F.col("event_type") == "error"
    attributes = F.create_map(F.lit("http.response.status_code"), F.lit("503"), F.lit("http.route"), F.concat(F.lit("/r/"), (F.col("event_id") % 3).cast("string")), F.lit("http.method"), F.lit("GET"))
    restated = F.concat(F.lit("503 on GET /r/"), (F.col("event_id") % 3).cast("string"))
    customer = F.concat(F.lit("customer-"), F.col("user_id").cast("string"))
    return ev.select(
        F.concat(F.lit("i"), F.floor(F.col("event_id") / 2).cast("long").cast("string")).alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), customer.alias("service"),
        F.concat(F.lit("t"), (F.col("event_id") % 200).cast("string")).alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.when(failed, "Boom").alias("errorType"),
        F.when(failed, F.concat(F.lit("boom "), (F.col("event_id") % 5).cast("string"))).otherwise(restated).alias("errorMessage"), F.lit(None).cast("string").alias("exceptionType"), F.lit(None).cast("string").alias("exceptionStacktrace"),
        attributes.alias("attributes"), F.concat(F.lit("service:customer-"), (F.col("user_id") % 50).cast("string")).alias("affectedNode"), F.col("event_id").alias("ordinal"),
    )


@query
def incident_dedupe(spark, sf_dir):
    return incidents.dedupe(_incidents(bound.tables(spark, sf_dir))).select("ordinal", "id", "errorMessage", "affectedNode")


@query
def incident_rollup(spark, sf_dir):
    return incidents.rollup(_incidents(bound.tables(spark, sf_dir)))


@query
def incident_list(spark, sf_dir):
    return incidents.listing(_incidents(bound.tables(spark, sf_dir)), 500).select("ordinal", "id", "timestamp")


@query
def incident_match(spark, sf_dir):
    t = bound.tables(spark, sf_dir)
    nodes = bound.graph(spark, sf_dir, t).nodes.select(F.col("id").alias("node"))
    return incidents.match_nodes(_incidents(t), nodes).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query
def incident_localise(spark, sf_dir):
    t = bound.tables(spark, sf_dir)
    return incidents.localise(_incidents(t), bound.graph(spark, sf_dir, t).nodes.select(F.col("id").alias("node"))).select("node", "culprit", "fix")


@query
def burst_4xx(spark, sf_dir):
    ev = bound.tables(spark, sf_dir)["events"]
    f = ev.select((F.col("user_id") % 20).alias("peer"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.lit(400) + F.col("event_id") % 4).alias("code"))
    return incidents.bursts(f, ["peer"], "ms", "code", gap_ms=7_200_000)


def _changed(g: Graph) -> Graph:
    edges = g.edges.filter("id not like '%customer-1->%'").withColumn("provenance", F.when(F.col("id").like("%customer-2->%"), "STALE").otherwise(F.col("provenance")))
    nodes = g.nodes.filter("type <> 'FrontierNode'").withColumn("owner", F.when(F.col("id") == "service:customer-3", "someone").otherwise(F.col("owner")))
    return Graph(nodes, conform(edges, EDGES), g.now)


@query
def graph_diff_nodes(spark, sf_dir):
    g = bound.graph(spark, sf_dir)
    return lifecycle.diff(g.nodes, _changed(g).nodes).select("id", "change", F.array_join("fields", ",").alias("fields"))


@query
def graph_diff_edges(spark, sf_dir):
    g = bound.graph(spark, sf_dir)
    return lifecycle.diff(g.edges, _changed(g).edges).select("id", "change", F.array_join("fields", ",").alias("fields"))


@query
def snapshot_merge(spark, sf_dir):
    g = bound.graph(spark, sf_dir)
    part = Graph(g.nodes.filter("type <> 'DatabaseNode' or id < 'database:nation-2'"), g.edges.filter("type = 'CALLS'"), g.now)
    merged = lifecycle.merge_snapshot(part, g.nodes.filter("type = 'DatabaseNode' and id < 'database:nation-20'"), g.edges.filter("type = 'CONNECTS_TO'"))
    return merged.edges.groupBy("type", "provenance").agg(F.count(F.lit(1)).alias("n"))


@query
def vector_top_k(spark, sf_dir):
    e = bound.tables(spark, sf_dir)["embeddings"]
    found = search.vector_search_many(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding"), "vec_id", "q", k=5)
    return found.select("q", "rank", "vec_id", F.round("score", 5).alias("score"))


@query
def vector_top_k_hundredths(spark, sf_dir):
    """The same; it has no SQL twin and is tested against a plain version."""
    return vector_top_k(spark, sf_dir)


@query
def substring_search(spark, sf_dir):
    return search.substring_search(bound.graph(spark, sf_dir).nodes, "Supplier-1", None).select("id", "type", "score")


@query
def embed_digest(spark, sf_dir):
    return search.embed_text(bound.graph(spark, sf_dir).nodes).select("id", "digest")


@query
def ask_intent(spark, sf_dir):
    c = bound.tables(spark, sf_dir)["conversations"]
    asked = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 4 == 0, " what breaks if this dies").when(F.col("turn") % 4 == 1, " seen at runtime").when(F.col("turn") % 4 == 2, " throws 503").otherwise(" who uses it"))
    return c.select("conv_id", "turn", ask.intent(asked).alias("intent"))


@query
def ask_tokens(spark, sf_dir):
    c = bound.tables(spark, sf_dir)["conversations"]
    return c.select("conv_id", "turn", F.array_join(F.array_sort(ask.tokens(F.coalesce("text", F.lit("")))), " ").alias("tokens"))


@query
def ask_entities(spark, sf_dir):
    asked = spark.createDataFrame([(1, "why is supplier-1 failing?"), (2, "what does customer 17 call"), (3, "anything about nation 3 databases"), (4, "part-7 and part-8"), (5, "customer-12 and nation-3.db?")], "q int, question string")
    g = bound.graph(spark, sf_dir)
    return ask.matched_entities(ask.entity_scores(g.nodes, asked, "q", "question"), "q")


@query
def log_ring(spark, sf_dir):
    return tables.keep_logs(_logs(spark, sf_dir), F.lit("2035-01-01").cast("timestamp"), hours=24 * 365 * 60, keep=100).select("projectName", "source", "ordinal")


def _logs(spark, sf_dir):
    ev = bound.tables(spark, sf_dir)["events"]
    return ev.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("projectName"), F.col("event_type").alias("source"), F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("serviceName"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_id").alias("ordinal"))


@query
def log_query(spark, sf_dir):
    return tables.list_logs(_logs(spark, sf_dir), project="p1", source="error", limit=50).select("id", "serviceName", "timestamp")


@query
def sql_table(spark, sf_dir):
    return _statements(spark, sf_dir).select("id", text.sql_table(F.col("s")).alias("one"), text.from_table(F.col("s")).alias("first"))


def _statements(spark, sf_dir):
    o = bound.tables(spark, sf_dir)["orders"]
    k = F.col("o_orderkey")
    s = (
        F.when(k % 5 == 0, F.concat(F.lit("SELECT id, total FROM public.Orders_"), k.cast("string"), F.lit(" WHERE status = 'x'")))
        .when(k % 5 == 1, F.concat(F.lit("select * from a_"), k.cast("string"), F.lit(" a join b on a.id = b.id")))
        .when(k % 5 == 2, F.concat(F.lit('INSERT INTO "Items_'), k.cast("string"), F.lit('" (a, b) VALUES (1, 2)')))
        .when(k % 5 == 3, F.concat(F.lit("update things_"), k.cast("string"), F.lit(" set a = 1 where b = 2")))
        .otherwise(F.lit("select 1 from pg_catalog.pg_class"))
    )
    return o.select(k.alias("id"), s.alias("s"))


@query
def sql_columns(spark, sf_dir):
    return _statements(spark, sf_dir).select("id", F.array_join(text.sql_columns("s"), ",").alias("columns"))


@query
def edge_id_parse(spark, sf_dir):
    return bound.graph(spark, sf_dir).edges.select("id", ids.parse_edge_id("id").alias("p")).select("id", "p.*")


@query
def version_checks(spark, sf_dir):
    p = bound.tables(spark, sf_dir)["part"]
    v = F.concat(F.lit("^"), (F.col("p_size") % 12).cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(".1"))
    return p.select("p_partkey", versions.older(v, F.lit("6.3.0")).alias("is_older"), versions.admits_only_from(v, F.lit("4.2")).alias("admits"), versions.clean(v).alias("cleaned"))


@query
def column_fold(spark, sf_dir):
    li = bound.tables(spark, sf_dir)["lineitem"]
    seen = li.select(F.concat(F.lit("t"), (F.col("l_suppkey") % 5).cast("string")).alias("table"), F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("column"), F.when(F.col("l_linenumber") % 2 == 0, "OBSERVED").otherwise("EXTRACTED").alias("provenance"), F.col("l_discount").alias("confidence"))
    return lifecycle.fold_columns(seen).select("table", F.inline("columns")).select("table", "name", F.array_join("provenances", ",").alias("provenances"), "confidence")


@query
def signal_fold(spark, sf_dir):
    li = bound.tables(spark, sf_dir)["lineitem"]
    s = li.select(F.lit("CALLS").alias("type"), F.lit("service:poller").alias("source"), F.concat(F.lit("infra:sql-table:part-"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_quantity").alias("callCount"), (F.col("l_quantity") - 20).alias("errorCount"), F.col("l_shipdate").alias("ts"))
    return lifecycle.fold_signals(s).select("id", "callCount", F.col("signal.errorCount").alias("errorCount"), "confidence")


@query
def host_resolve(spark, sf_dir):
    t = bound.tables(spark, sf_dir)
    hosts = t["supplier"].select(F.concat(F.lit("sup"), F.col("s_suppkey").cast("string")).alias("host"), F.lit("prod").alias("env")).union(t["customer"].select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")), F.lit("unknown")))
    return ingest.resolve_hosts(hosts, bound.graph(spark, sf_dir, t).nodes)


@query
def file_reconcile(spark, sf_dir):
    t = bound.tables(spark, sf_dir)
    seen = t["supplier"].select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("service"), F.when(F.col("s_suppkey") % 3 == 0, "srv/build/src/app.py").otherwise("app.py").alias("path"))
    return ingest.reconcile_files(seen, bound.graph(spark, sf_dir, t).nodes)


@query
def declared_database(spark, sf_dir):
    return ingest.declared_database(bound.graph(spark, sf_dir))


@query
def connector_status(spark, sf_dir):
    ev = bound.tables(spark, sf_dir)["events"]
    polls = ev.select((F.col("user_id") % 30).alias("connector"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"), F.floor(F.col("value")).cast("long").alias("signals"))
    return connectors.status(polls, F.lit("2035-01-01").cast("timestamp"))


def span_frame(spark: SparkSession, sf_dir: str, t: dict[str, DataFrame] | None = None) -> DataFrame:
    """Events as spans: users' services calling suppliers over HTTP."""
    from ..schema import SPANS

    t = t or bound.tables(spark, sf_dir)
    ev = t["events"]
    peer = F.concat(F.lit("sup"), (F.col("event_id") % 60).cast("string"))
    attributes = F.create_map(F.lit("server.address"), peer, F.lit("http.response.status_code"), F.when(F.col("event_type") == "error", "500").when(F.col("event_id") % 11 == 0, "404").otherwise("200"), F.lit("http.route"), F.lit("/pay"), F.lit("http.method"), F.lit("POST"))
    return conform(
        ev.select(F.concat(F.lit("customer-"), (F.col("user_id") % 100).cast("string")).alias("service"), F.lit("unknown").alias("env"), (F.col("event_id") % 500).cast("string").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.lit("call").alias("name"), F.lit(3).alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("startTimeUnixNano"), (F.col("value") * 1_000_000).cast("long").alias("durationNanos"), F.lit(0).alias("statusCode"), attributes.alias("attributes")),
        SPANS,
    )


@query
def span_dispatch(spark, sf_dir):
    t = bound.tables(spark, sf_dir)
    e = ingest.observed_edges(span_frame(spark, sf_dir, t), bound.graph(spark, sf_dir, t))
    return e.select("id", "callCount", F.col("signal.errorCount").alias("errorCount"), "confidence")


@query
def span_incidents(spark, sf_dir):
    return ingest.span_incidents(span_frame(spark, sf_dir)).select("id", "service", "errorMessage", "httpStatusCode", "affectedNode")


@query
def project_routing(spark, sf_dir):
    projects = spark.createDataFrame([("customer", False), ("customer-1", False), ("customer-2", True)], "project string, paused boolean")
    return ingest.route_to_projects(span_frame(spark, sf_dir), projects).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query
def call_sites(spark, sf_dir):
    return connectors.single_call_sites(bound.graph(spark, sf_dir))
