"""Declared against observed: where code and production disagree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions import weights
from . import compat
from .graph import Graph, materialise

OBSERVABLE = ("CALLS", "CONNECTS_TO", "PUBLISHES_TO", "CONSUMES_FROM")
DEAD_CODE_CONFIDENCE = 0.1
#: Which kind leads at equal confidence.
LEAD = {"missing-extracted": 0, "missing-observed": 1, "version-mismatch": 2, "host-mismatch": 3, "compat-violation": 4}
COLUMNS = ("type", "source", "target", "edgeType", "column", "declared", "observed", "confidence", "reason")


def buckets(graph: Graph, declared_only: bool = False) -> DataFrame:
    """One row for each (type, source, target): the edge in each provenance slot.

    ``declared_only`` leaves out those, but for connections, that no declaration
    of an observable type fills.

    The slot is the provenance in the edge's id, so a stale edge fills the
    observed slot.  Database connections of a file count for its service.  Of
    several edges in a slot the greater id stands.
    """
    databases = graph.nodes.filter("type = 'DatabaseNode'").select(F.col("id").alias("target"), F.lit(True).alias("_db"))
    edges = graph.valid_edges().join(databases, "target", "left")
    lifted = F.when((F.col("type") == "CONNECTS_TO") & F.col("_db") & ids.file_service("source").isNotNull(), ids.service_id(ids.file_service("source"))).otherwise(F.col("source"))
    graded = weights.clamp(F.coalesce("confidence", weights.edge_confidence(graph.now_column())))
    edge = F.struct("id", "provenance", graded.alias("grade"), F.col("evidence.hostSource").alias("hostSource"))
    slot = ids.id_provenance("id")
    key = ["type", "source", "target"]
    slots = edges.select("type", lifted.alias("source"), "target", slot.alias("_slot"), edge.alias("_edge"))
    if declared_only:
        other = F.col("type") != "CONNECTS_TO"
        declared = edges.filter(other & F.col("type").isin(*OBSERVABLE) & (slot == "EXTRACTED")).select("type", lifted.alias("source"), "target").distinct()
        slots = slots.filter(~other).unionByName(slots.filter(other).join(materialise(declared), key, "left_semi"))
    return slots.groupBy(*key).agg(*(F.max(F.when(F.col("_slot") == p, F.col("_edge"))).alias(p.lower()) for p in ("EXTRACTED", "OBSERVED", "INFERRED")))


def _shape(df: DataFrame, **values) -> DataFrame:
    kinds = {"confidence": "double"}
    return df.select(*(values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def missing(graph: Graph, grouped: DataFrame | None = None) -> DataFrame:
    """missing-observed and missing-extracted edges, with hostSource for what follows."""
    grouped = buckets(graph) if grouped is None else grouped
    kind = graph.nodes.select(F.col("id").alias("_id"), F.col("type").alias("_kind"))
    b = grouped.filter("type <> 'CONTAINS'").join(kind.select(F.col("_id").alias("source"), F.col("_kind").alias("from")), "source", "left").join(kind.select(F.col("_id").alias("target"), F.col("_kind").alias("to")), "target", "left")
    b = b.filter("coalesce(`from`, '') <> 'SymbolNode' and coalesce(`to`, '') <> 'SymbolNode'")
    unseen = b.filter(F.col("extracted").isNotNull() & F.col("observed").isNull() & F.col("type").isin(*OBSERVABLE) & ~F.coalesce("to", F.lit("")).isin("FrontierNode", "ServerActionNode"))
    undeclared = b.filter(F.col("observed").isNotNull() & F.col("extracted").isNull() & (F.coalesce("to", F.lit("")) != "WebSocketChannelNode"))
    arrow = F.concat("source", F.lit(" -> "), "target", F.lit(" ("), "type", F.lit(")"))
    first = _shape(unseen, type=F.lit("missing-observed"), source=F.col("source"), target=F.col("target"), edgeType=F.col("type"), declared=F.col("extracted.hostSource"), confidence=F.col("extracted.grade"), reason=F.concat(F.lit("Declared but not seen in production: "), arrow))
    second = _shape(undeclared, type=F.lit("missing-extracted"), source=F.col("source"), target=F.col("target"), edgeType=F.col("type"), confidence=F.col("observed.grade"), reason=F.concat(F.lit("Seen in production but not declared: "), arrow))
    return first.unionByName(second)


def host_mismatch(graph: Graph) -> DataFrame:
    """Services whose configured database host is not the one production connects to."""
    raw = F.trim("dbConnectionTarget")
    services = graph.nodes.filter("type = 'ServiceNode'").select(F.col("id").alias("source"), F.nullif(F.regexp_replace(raw, r":\d+$", ""), F.lit("")).alias("declared")).filter("declared is not null")
    configured = graph.valid_edges().filter("type = 'CONFIGURED_BY' and provenance = 'EXTRACTED'").select("source")
    databases = graph.nodes.filter("type = 'DatabaseNode'").select(F.col("id").alias("target"), F.nullif(F.trim("host"), F.lit("")).alias("observed"))
    edges = graph.with_confidence().filter("type = 'CONNECTS_TO' and provenance = 'OBSERVED'").select("source", "target", "weight")
    hit = services.join(configured, "source", "left_semi").join(edges, "source").join(databases, "target").filter("observed is not null and observed <> declared")
    return _shape(hit, type=F.lit("host-mismatch"), source=F.col("source"), target=F.col("target"), declared=F.col("declared"), observed=F.col("observed"), confidence=weights.clamp(F.col("weight")), reason=F.concat(F.lit("Configured for "), "declared", F.lit(" but connected to "), "observed"))


def compatibility(graph: Graph, matrix: compat.Matrix) -> DataFrame:
    """version-mismatch and compat-violation on observed database edges."""
    edges = graph.valid_edges().filter("provenance = 'OBSERVED'")
    old = compat.driver_engine(graph, matrix, edges)
    first = _shape(old, type=F.lit("version-mismatch"), source=F.col("service"), target=F.col("target"), declared=F.concat("driver", F.lit("@"), "declared"), observed=F.concat("engine", F.lit("@"), "engineVersion"), confidence=F.lit(1.0), reason=F.concat("driver", F.lit(" below "), "minDriver", F.lit(" for "), "engine", F.lit(" "), "engineVersion"))
    databases = graph.nodes.filter("type = 'DatabaseNode'").select(F.col("id").alias("target"))
    linked = edges.filter("type = 'CONNECTS_TO'").select(F.col("source").alias("service"), "target").join(databases, "target", "left_semi")
    replaced = compat.deprecated_api(graph, matrix).join(linked, "service")
    second = _shape(replaced, type=F.lit("compat-violation"), source=F.col("service"), target=F.col("target"), declared=F.concat("package", F.lit("@"), "declared"), confidence=F.lit(1.0), reason=F.concat("package", F.lit(" should be replaced")))
    return first.unionByName(second)


def column_drift(graph: Graph) -> DataFrame:
    """Columns of SQL tables that only the schema or only production knows, where both know some."""
    tables = graph.nodes.filter("type = 'InfraNode' and kind = 'sql-table' and columns is not null")
    declared = lambda c: F.array_contains(c["provenances"], "EXTRACTED")
    observed = lambda c: F.array_contains(c["provenances"], "OBSERVED")
    both = tables.filter(F.exists("columns", declared) & F.exists("columns", observed))
    one = both.select("id", F.explode("columns").alias("c")).filter(declared(F.col("c")) != observed(F.col("c")))
    kind = F.when(declared(F.col("c")), "missing-observed").otherwise("missing-extracted")
    return _shape(one, type=kind, source=F.col("id"), target=F.col("id"), column=F.col("c.name"), confidence=weights.clamp(F.col("c.confidence")), reason=F.concat(F.lit("Column known to one side only: "), "c.name"))


def suppress_host_halves(found: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Without the two missing halves that a host mismatch (of ``hosts``, else of ``found``) explains."""
    hosts = found.filter("type = 'host-mismatch'") if hosts is None else hosts
    seen = hosts.select("source", "target").distinct().withColumn("_type", F.lit("missing-extracted"))
    said = hosts.select(ids.database_id("declared").alias("target")).distinct().withColumn("_type", F.lit("missing-observed"))
    out = found.join(seen, (found.source == seen.source) & (found.target == seen.target) & (found.type == seen._type), "left_anti")
    return out.join(said, (out.target == said.target) & (out.type == said._type), "left_anti")


def dampen_dead_code(graph: Graph, found: DataFrame, grouped: DataFrame) -> DataFrame:
    """Low confidence for hard-coded, never observed databases of services that do use another of the same engine."""
    databases = graph.nodes.filter("type = 'DatabaseNode'").select(F.col("id").alias("target"), "engine", F.coalesce(F.col("discoveredVia").isin("otel", "merged"), F.lit(False)).alias("_via"))
    touched = graph.valid_edges().filter("provenance in ('OBSERVED', 'STALE')").select("target").distinct().withColumn("_touched", F.lit(True))
    stores = databases.join(touched, "target", "left").select("target", "engine", (F.col("_via") | F.coalesce("_touched", F.lit(False))).alias("_seen"))
    links = grouped.filter("type = 'CONNECTS_TO'").join(stores, "target").filter("observed is not null or _seen")
    alive = links.groupBy("source", "engine").agg(F.count_distinct("target").alias("_n"))
    probe = found.filter("type = 'missing-observed' and edgeType = 'CONNECTS_TO' and declared = 'literal'").select("source", "target").join(stores.filter("not _seen"), "target").join(alive, ["source", "engine"]).select("source", "target", F.lit(True).alias("_dead")).distinct()
    out = found.join(probe, ["source", "target"], "left")
    dead = F.coalesce(F.col("_dead"), F.lit(False)) & (F.col("type") == "missing-observed") & (F.col("edgeType") == "CONNECTS_TO")
    return out.withColumns({"confidence": F.when(dead, F.least(F.lit(DEAD_CODE_CONFIDENCE), "confidence")).otherwise(F.col("confidence")), "reason": F.when(dead, F.concat("reason", F.lit("; reads as dead or flag-gated code"))).otherwise(F.col("reason"))}).select(*COLUMNS)


def divergences(graph: Graph, matrix: compat.Matrix | None = None, types: set[str] | None = None, min_confidence: float | None = None, node: str | None = None) -> DataFrame:
    """All divergences (of ``types``), most certain first: detect, suppress, dampen, filter, sort.  Only kinds that are asked for are looked for."""
    matrix = matrix or compat.Matrix(graph.spark)
    asked = lambda *kinds: not types or not types.isdisjoint(kinds)
    halves = asked("missing-observed", "missing-extracted")
    found = []
    if halves:
        grouped = buckets(graph, declared_only=not asked("missing-extracted"))
        found += [missing(graph, grouped), column_drift(graph)]
    if halves or asked("host-mismatch"):
        hosts = host_mismatch(graph)
        found.append(materialise(hosts) if halves else hosts)
    if asked("version-mismatch", "compat-violation"):
        found.append(compatibility(graph, matrix))
    out = reduce(DataFrame.unionByName, found or [host_mismatch(graph).limit(0)])
    if halves:
        out = dampen_dead_code(graph, suppress_host_halves(out, hosts=found[2]), grouped)
    if types:
        out = out.filter(F.col("type").isin(*types))
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    if node:
        out = out.filter((F.col("source") == node) | (F.col("target") == node))
    lead = weights.choose(F.col("type"), LEAD, 9)
    return out.orderBy(F.desc("confidence"), lead, "source", "target", F.coalesce("column", F.lit("")))
