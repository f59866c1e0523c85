"""Provider statistics and logs, landed as rows, mapped to signals about targets.

Each mapper is a projection and one aggregation; a signal is (targetKind,
targetName, method, path, callCount, errorCount, lastObservedIso).  ``resolve``
joins signals to nodes, and ``fold_signals`` adds them to the graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions import text
from ..operators.graph import Graph, materialise
from ..operators.lifecycle import fold_signals
from ..schema import INCIDENTS, SIGNALS, conform

#: Builds that fail for these reasons say nothing about the code.
TRANSIENT_BUILD_ERRORS = ("BUILD_CANCELED", "BUILD_TIMEOUT", "CAPACITY_EXCEEDED", "INTERNAL_ERROR", "NETWORK_ERROR", "QUEUE_TIMEOUT", "UNKNOWN_ERROR", "WORKER_LOST")


def _signals(df: DataFrame) -> DataFrame:
    return conform(df, SIGNALS)


def _count(df: DataFrame, keys: list[Column], failed: Column, ts: str = "timestamp") -> DataFrame:
    return _signals(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("callCount"), F.count_if(failed).alias("errorCount"), F.max(ts).alias("lastObservedIso")))


def rest_edge_logs(logs: DataFrame) -> DataFrame:
    """(timestamp, path, method, status) of a REST gateway: /rest/v1/<table> and /rest/v1/rpc/<function>."""
    rpc = F.regexp_extract("path", r"/rest/v1/rpc/([^/?]+)", 1)
    table = F.regexp_extract("path", r"/rest/v1/([^/?]+)", 1)
    named = logs.withColumns({"_k": F.when(rpc != "", "rpc").when((table != "") & (table != "rpc"), "table"), "_n": F.when(rpc != "", rpc).otherwise(table)}).filter("_k is not null")
    return _count(named, [F.col("_k").alias("targetKind"), F.col("_n").alias("targetName")], F.col("status") >= 500)


def statement_deltas(polls: DataFrame, name: Callable[[Column], Column] = text.from_table) -> DataFrame:
    """Calls between polls of statement counters (poll, queryid, query, calls).

    The first sight of a statement and a counter that fell are baselines; a
    statement without one table is left out.
    """
    order = Window.partitionBy("queryid").orderBy("poll")
    before = F.lag("calls").over(order)
    delta = F.when(before.isNotNull() & (F.col("calls") >= before), F.col("calls") - before).otherwise(0)
    counted = polls.withColumns({"_d": delta, "_t": name(F.col("query"))}).filter("_d > 0 and _t is not null")
    return _signals(counted.groupBy(F.lit("table").alias("targetKind"), F.col("_t").alias("targetName"), "poll").agg(F.sum("_d").alias("callCount"), F.lit(0).cast("long").alias("errorCount")).groupBy("targetKind", "targetName").agg(F.sum("callCount").alias("callCount"), F.sum("errorCount").alias("errorCount")))


def single_table_deltas(polls: DataFrame) -> DataFrame:
    """The same for statements that name one table only: joins are not attributed."""
    return statement_deltas(polls, text.sql_table)


def query_insights(rows: DataFrame) -> DataFrame:
    """Windowed counts by query (tables, qualified_tables, count, errors, last_run): one signal for each table, at least one call."""
    tables = F.when(F.size("tables") > 0, F.col("tables")).otherwise(F.coalesce("qualified_tables", F.expr("cast(array() as array<string>)")))
    each = rows.withColumn("_t", F.explode(tables)).withColumn("_t", text.bare_name(F.col("_t")))
    return _signals(each.groupBy(F.lit("table").alias("targetKind"), F.col("_t").alias("targetName")).agg(F.sum(F.greatest(F.lit(1), F.coalesce(F.col("count"), F.lit(1)))).cast("long").alias("callCount"), F.sum(F.coalesce("errors", F.lit(0))).cast("long").alias("errorCount"), F.max("last_run").alias("lastObservedIso")))


def http_route_logs(logs: DataFrame, routes: DataFrame) -> DataFrame:
    """HTTP logs (timestamp, method, path, status) by declared route; what no route matches is counted as unmatched.  400 and above are errors here."""
    known = routes.filter("type = 'RouteNode'").select(F.col("id").alias("_r"), F.upper("method").alias("_m"), text.normalised_template(F.col("pathTemplate")).alias("_t"))
    # Paths repeat: match each distinct one once.
    asked = logs.select(F.upper("method").alias("m"), "path").distinct().withColumn("_t", text.normalised_template(F.col("path")))
    hit = asked.join(known, "_t").filter("_m = m or _m = 'ALL'").groupBy("m", "path").agg(F.min("_r").alias("route"))
    joined = logs.withColumn("m", F.upper("method")).join(hit, ["m", "path"], "left")
    return _count(joined, [F.when(F.col("route").isNotNull(), "route").otherwise("unmatched").alias("targetKind"), F.coalesce("route", F.lit("unmatched")).alias("targetName")], F.col("status") >= 400)


def network_flows(flows: DataFrame) -> DataFrame:
    """Flows (timestamp, peerServiceId, dropCause) by peer; a drop cause is an error."""
    return _count(flows.filter("peerServiceId is not null"), [F.lit("service").alias("targetKind"), F.col("peerServiceId").alias("targetName")], F.coalesce("dropCause", F.lit("")) != "")


def cloud_request_logs(logs: DataFrame, label: str) -> DataFrame:
    """Request logs (timestamp, labels, method, url, status) by service label, method and path."""
    name = F.try_element_at("labels", F.lit(label))
    ready = logs.withColumns({"_n": name, "_p": text.url_path(F.col("url"))}).filter("_n is not null and _n <> ''")
    return _count(ready, [F.lit("service").alias("targetKind"), F.col("_n").alias("targetName"), F.upper("method").alias("method"), F.col("_p").alias("path")], F.col("status") >= 500)


def worker_traces(events: DataFrame) -> DataFrame:
    """Worker events (timestamp, script, trigger, status): triggers that read ``METHOD path``."""
    pattern = r"^(GET|HEAD|POST|PUT|PATCH|DELETE|OPTIONS) (\S+)"
    ready = events.withColumns({"_m": F.regexp_extract("trigger", pattern, 1), "_p": text.url_path(F.regexp_extract("trigger", pattern, 2))}).filter("_m <> ''")
    return _count(ready, [F.lit("service").alias("targetKind"), F.col("script").alias("targetName"), F.col("_m").alias("method"), F.col("_p").alias("path")], F.col("status") >= 500)


def failed_builds(builds: DataFrame) -> DataFrame:
    """Incidents of builds (id, app, status, errorCode, errorMessage, finishedAt) that failed for lasting reasons; they make no edge."""
    bad = builds.filter((F.col("status") == "ERRORED") & ~F.coalesce("errorCode", F.lit("")).isin(*TRANSIENT_BUILD_ERRORS))
    return conform(bad.select(F.concat(F.lit("build:"), "id").alias("id"), F.col("finishedAt").alias("timestamp"), F.col("app").alias("service"), F.col("errorCode").alias("errorType"), F.coalesce("errorMessage", F.lit("build failed")).alias("errorMessage"), ids.service_id("app").alias("affectedNode")), INCIDENTS)


#: Provider -> mapper of its landed rows (those that need more take it as further arguments).
MAPPERS: dict[str, Callable] = {
    "supabase": rest_edge_logs,
    "supabase-statements": statement_deltas,
    "neon": single_table_deltas,
    "planetscale": query_insights,
    "railway": http_route_logs,
    "railway-flows": network_flows,
    "render": http_route_logs,
    "firebase": lambda logs: cloud_request_logs(logs, "function_name"),
    "cloud-run": lambda logs: cloud_request_logs(logs, "service_name"),
    "cloudflare": worker_traces,
    "eas": failed_builds,
}


def resolve(signals: DataFrame, graph: Graph, source: str) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved): signals with the node they are about.

    A route id stands for itself; a method and path go to a declared route of
    the service, else the service; tables and functions to infra nodes, and to
    the one database of the source if that is all there is.
    """
    nodes = graph.nodes.select("id", "type", "name", "kind", "service", "method", "pathTemplate")
    routes = nodes.filter("type = 'RouteNode'").select(F.col("service").alias("targetName"), F.upper("method").alias("_m"), text.normalised_template(F.col("pathTemplate")).alias("_t"), F.col("id").alias("_route"))
    # Written once: both uses below must see the same keys.
    s = materialise(signals.withColumns({"_key": F.monotonically_increasing_id(), "_t": text.normalised_template(F.col("path"))}))
    by_route = s.filter("path is not null").join(routes, ["targetName", "_t"]).filter("_m = method or _m = 'ALL'").groupBy("_key").agg(F.min("_route").alias("_route"))
    services = nodes.filter("type = 'ServiceNode'").groupBy(F.lower("name").alias("_n")).agg(F.min("id").alias("_service"))
    tables = nodes.filter("type = 'InfraNode'").groupBy(F.lower("name").alias("_n"), F.when(F.col("kind").contains("rpc"), "rpc").otherwise("table").alias("targetKind")).agg(F.min("id").alias("_infra"))
    exact = nodes.select(F.col("id").alias("targetName"), F.col("id").alias("_exact"))
    databases = graph.valid_edges().filter((F.col("type") == "CONNECTS_TO") & (F.col("source") == source)).join(nodes.filter("type = 'DatabaseNode'").select(F.col("id").alias("target")), "target").agg(F.when(F.count_distinct("target") == 1, F.min("target")).alias("_database"))
    joined = s.join(by_route, "_key", "left").join(exact, "targetName", "left").withColumn("_n", F.lower("targetName")).join(services, "_n", "left").join(tables, ["_n", "targetKind"], "left").crossJoin(F.broadcast(databases))
    target = F.coalesce("_route", "_exact", F.when(F.col("targetKind") == "service", F.col("_service")), "_infra", F.when(F.col("targetKind").isin("table", "rpc"), F.col("_database")))
    out = joined.withColumn("target", target).select(*signals.columns, "target")
    return out.filter("target is not null"), out.filter("target is null")


def single_call_sites(graph: Graph) -> DataFrame:
    """(service, target, file): the one file of a service that is declared to call a target."""
    owner = graph.owners().select(F.col("node").alias("source"), F.col("owner").alias("service"))
    files = graph.valid_edges().filter("provenance = 'EXTRACTED' and type <> 'CONTAINS' and source like 'file:%'").select("source", "target").join(owner, "source")
    return files.groupBy("service", "target").agg(F.count_distinct("source").alias("n"), F.min("source").alias("file")).filter("n = 1").select("service", "target", "file")


def poll(signals: DataFrame, graph: Graph, source: str, kind: str = "CALLS") -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved) of one poll: resolve, attribute to the one call site if there is one, fold."""
    resolved, missed = resolve(signals, graph, source)
    sites = single_call_sites(graph).filter(F.col("service") == source).select("target", "file")
    placed = resolved.join(sites, "target", "left").select(F.lit(kind).alias("type"), F.coalesce("file", F.lit(source)).alias("source"), "target", "callCount", F.coalesce("errorCount", F.lit(0)).alias("errorCount"), F.col("lastObservedIso").try_cast("timestamp").alias("ts")).filter("source <> target")
    return fold_signals(placed), missed


def status(polls: DataFrame, now: Column, stale_ms: int = 300_000) -> DataFrame:
    """(connector, state): of each connector's latest poll (at, ok, signals): error, stale, healthy or idle."""
    last = polls.groupBy("connector").agg(F.max(F.struct("at", "ok", "signals")).alias("l"), F.max(F.when(F.col("ok"), F.col("at"))).alias("ok_at"))
    age = F.unix_millis(now) - F.unix_millis(F.col("ok_at"))
    state = F.when(~F.col("l.ok"), "error").when(F.coalesce(age > stale_ms, F.lit(True)), "stale").when(F.col("l.signals") > 0, "healthy").otherwise("idle")
    return last.select("connector", state.alias("state"))


class TokenBucket:
    """Allows ``rate`` calls a second up to ``burst`` at once; retries wait 200 ms, then four times longer each."""

    def __init__(self, rate: float, burst: int, clock) -> None:
        self.rate, self.burst, self.clock = rate, burst, clock
        self.level, self.at = float(burst), clock()

    def wait(self) -> float:
        """Seconds until the next call may go; the call is counted."""
        now = self.clock()
        self.level = min(self.burst, self.level + (now - self.at) * self.rate)
        self.at = now
        self.level -= 1
        return max(0.0, -self.level / self.rate)

    @staticmethod
    def backoff(attempt: int) -> float:
        return 0.2 * 4**attempt
