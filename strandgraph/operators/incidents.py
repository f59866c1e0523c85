"""Incidents: messages, matching to nodes, dedup, bursts, rollups and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as ids

BURST_SIZE, BURST_GAP_MS = 5, 60_000
DEFAULT_LIMIT, MAX_LIMIT = 50, 200

# Names of gRPC status codes, as its specification numbers them.
GRPC_STATUS = (
    "OK", "CANCELLED", "UNKNOWN", "INVALID_ARGUMENT", "DEADLINE_EXCEEDED", "NOT_FOUND", "ALREADY_EXISTS", "PERMISSION_DENIED", "RESOURCE_EXHAUSTED",
    "FAILED_PRECONDITION", "ABORTED", "OUT_OF_RANGE", "UNIMPLEMENTED", "INTERNAL", "UNAVAILABLE", "DATA_LOSS", "UNAUTHENTICATED",
)


def attribute(attributes: Column, *names: str) -> Column:
    """The first attribute that is present and not empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(attributes, F.lit(n)), F.lit("")) for n in names))


def http_status(attributes: Column) -> Column:
    return F.coalesce(F.try_element_at(attributes, F.lit("http.response.status_code")).try_cast("int"), F.try_element_at(attributes, F.lit("http.status_code")).try_cast("int"))


def grpc_status(attributes: Column) -> Column:
    return F.try_element_at(attributes, F.lit("rpc.grpc.status_code")).try_cast("int")


def http_message(attributes: Column) -> Column:
    """``<status> on <METHOD> <route>`` as far as known; null without status and route."""
    status = http_status(attributes).cast("string")
    route = attribute(attributes, "http.route", "http.target", "url.path")
    where = F.concat_ws(" ", F.when(route.isNotNull(), attribute(attributes, "http.request.method", "http.method")), route)
    where = F.when(route.isNotNull(), where)
    return F.coalesce(F.concat(status, F.lit(" on "), where), F.concat(F.lit("HTTP "), status), F.concat(F.lit("error on "), where))


def other_message(attributes: Column) -> Column:
    """A gRPC status by name, else an error type and its peer."""
    code = grpc_status(attributes)
    names = F.array(*(F.lit(n) for n in GRPC_STATUS))
    name = F.when(code.between(0, len(GRPC_STATUS) - 1), F.get(names, code)).otherwise(F.concat(F.lit("status "), code.cast("string")))
    detail = attribute(attributes, "rpc.grpc.status_message")
    grpc = F.when(code != 0, F.concat(F.lit("gRPC "), name, F.coalesce(F.concat(F.lit(": "), detail), F.lit(""))))
    kind = attribute(attributes, "error.type")
    peer = attribute(attributes, "server.address", "net.peer.name", "net.host.name")
    typed = F.when((kind != "_OTHER") & ~kind.rlike(r"^\d+$"), F.concat(kind, F.coalesce(F.concat(F.lit(" connecting to "), peer), F.lit(""))))
    return F.coalesce(grpc, typed)


def message(exception_message: Column, attributes: Column) -> Column:
    """What went wrong, never the span's name."""
    return F.coalesce(exception_message, http_message(attributes), other_message(attributes), F.lit("unknown error"))


def match_nodes(incidents: DataFrame, nodes: DataFrame) -> DataFrame:
    """incidents x (node): by affected node, by service, or by the file of an affected symbol; each pair once.

    An OR join would compare all pairs; the keys of an incident are exploded
    instead, so this is one equi join.
    """
    keys = F.array_compact(F.array_distinct(F.array("affectedNode", F.concat(F.lit("service:"), F.col("service")), ids.symbol_file("affectedNode"))))
    return incidents.withColumn("node", F.explode(keys)).join(nodes.select("node").distinct(), "node")


def match_nodes_plain(incidents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same without the symbol's file, as listings do."""
    keys = F.array_compact(F.array_distinct(F.array("affectedNode", F.concat(F.lit("service:"), F.col("service")))))
    return incidents.withColumn("node", F.explode(keys)).join(nodes.select("node").distinct(), "node")


def is_synthesized() -> Column:
    """An incident that only restates an HTTP status."""
    return F.coalesce(F.col("exceptionType").isNull() & F.col("exceptionStacktrace").isNull() & F.col("errorType").isNull() & (http_message(F.col("attributes")) == F.col("errorMessage")), F.lit(False))


def dedupe(incidents: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Each id once (the first), and no restated HTTP failure beside a real one of the same trace and node."""
    key = F.coalesce("id", F.concat("traceId", F.lit(":"), "spanId"))
    keyed = incidents.withColumn("_key", F.coalesce(key, F.concat(F.lit("\0row:"), F.col(ordinal).cast("string"))))
    first = keyed.groupBy("_key").agg(F.min(ordinal).alias(ordinal))
    once = keyed.join(first, ["_key", ordinal], "left_semi").drop("_key").withColumn("_synth", is_synthesized())
    real = once.filter("not _synth and traceId is not null").select(F.col("traceId").alias("_t"), F.col("affectedNode").alias("_n")).distinct()
    restated = once.filter("_synth and traceId is not null").join(real, (F.col("traceId") == F.col("_t")) & F.col("affectedNode").eqNullSafe(F.col("_n")), "left_anti")
    return once.filter("not _synth or traceId is null").unionByName(restated).drop("_synth")


def _blocks(failures: DataFrame, key: list[str], ts_ms: str, code: str, size: int, gap_ms: int, last: str | None) -> DataFrame:
    """failures with their session, their row in it and the block of ``size`` rows that this falls in."""
    by = [ts_ms, code, *([last] if last else [])]
    order = Window.partitionBy(*key).orderBy(*by)
    new = F.when(F.col(ts_ms) - F.lag(ts_ms).over(order) > gap_ms, 1).otherwise(0)
    session = failures.withColumn("_new", new).withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    within = Window.partitionBy(*key, "_session").orderBy(*by)
    return session.withColumn("_row", F.row_number().over(within)).withColumn("_block", F.ceil(F.col("_row") / size))


def open_failures(failures: DataFrame, key: list[str], ts_ms: str, code: str, size: int = BURST_SIZE, gap_ms: int = BURST_GAP_MS, last: str | None = None) -> DataFrame:
    """The failures that a later one may still complete to a burst: the unfinished block of each key's last session."""
    blocks = _blocks(failures, key, ts_ms, code, size, gap_ms, last)
    every = Window.partitionBy(*key)
    ends = blocks.withColumn("_last", F.max(F.struct("_session", "_row")).over(every))
    open_ = (F.col("_session") == F.col("_last._session")) & (F.col("_block") == F.ceil(F.col("_last._row") / size)) & (F.col("_last._row") % size != 0)
    return ends.filter(open_).select(*failures.columns)


def bursts(failures: DataFrame, key: list[str], ts_ms: str, code: str, size: int = BURST_SIZE, gap_ms: int = BURST_GAP_MS, last: str | None = None) -> DataFrame:
    """key, first_ms, last_ms, n, code of each run of ``size`` failures with gaps up to gap_ms.

    A gap starts a session; within one, every ``size`` failures are a burst.
    The code is the most frequent one, the first seen of equals.  Time is event
    time, so a replay gives the same bursts.  ``last`` names a column whose
    value in the failure that completes the burst is kept.
    """
    blocks = _blocks(failures, key, ts_ms, code, size, gap_ms, last)
    counts = blocks.groupBy(*key, "_session", "_block", code).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_seen"), F.min(ts_ms).alias("_lo"), F.max(ts_ms).alias("_hi"), F.max(F.struct("_row", (F.col(last) if last else F.lit(None)).alias("v"))).alias("_last"))
    out = counts.groupBy(*key, "_session", "_block").agg(F.sum("_n").alias("n"), F.min("_lo").alias("first_ms"), F.max("_hi").alias("last_ms"), F.min(F.struct((-F.col("_n")).alias("m"), "_seen", F.col(code).alias("c"))).alias("_best"), F.max("_last").alias("_last"))
    return out.filter(F.col("n") == size).select(*key, "first_ms", "last_ms", "n", F.col("_best.c").alias(code), *([F.col("_last.v").alias(last)] if last else []))


def rollup(incidents: DataFrame, top: int = 6) -> DataFrame:
    """The nodes with most incidents: key, n, latest, message of the latest."""
    key = F.coalesce("affectedNode", F.concat(F.lit("service:"), F.col("service")))
    grouped = incidents.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("timestamp", "errorMessage")).alias("m"))
    return grouped.select("key", "n", F.col("m.timestamp").alias("latest"), F.col("m.errorMessage").alias("message")).orderBy(F.desc("n"), F.desc("latest"), "key").limit(top)


def listing(incidents: DataFrame, limit: int = DEFAULT_LIMIT, ordinal: str = "ordinal") -> DataFrame:
    """The oldest incidents in order of arrival."""
    return incidents.orderBy(ordinal).limit(min(limit, MAX_LIMIT))


def history(incidents: DataFrame, node: str, limit: int = 20, ordinal: str = "ordinal") -> DataFrame:
    """The latest incidents of a node."""
    nodes = incidents.sparkSession.createDataFrame([(node,)], "node string")
    return match_nodes_plain(incidents, nodes).orderBy(F.desc(ordinal)).limit(limit)


def localise(incidents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, culprit, file, reason, fix) from each node's latest incident."""
    matched = match_nodes(incidents, nodes)
    same = Window.partitionBy("node", "errorMessage")
    order = Window.partitionBy("node").orderBy(F.desc("timestamp"), F.desc("id"))
    latest = matched.withColumn("_same", F.count(F.lit(1)).over(same)).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    a = F.col("attributes")
    path = attribute(a, "code.file.path", "code.filepath")
    line = attribute(a, "code.line.number", "code.lineno")
    location = F.concat(path, F.coalesce(F.concat(F.lit(":"), line), F.lit("")))
    route = attribute(a, "http.route")
    finer = F.when((F.col("affectedNode") != F.col("node")) & F.col("affectedNode").rlike("^(file|symbol):"), F.col("affectedNode"))
    reason = F.concat(F.col("service"), F.lit(": "), F.col("errorMessage"), F.coalesce(F.concat(F.lit(" at "), location), F.lit("")), F.lit(" (x"), F.col("_same").cast("string"), F.lit(")"))
    fix = F.coalesce(F.concat(F.lit("Inspect "), location, F.coalesce(F.concat(F.lit(" handling "), route), F.lit(""))), F.concat(F.lit("Inspect the handler for "), route))
    return latest.select("node", F.coalesce(finer, "node").alias("culprit"), finer.alias("file"), reason.alias("reason"), fix.alias("fix"))
