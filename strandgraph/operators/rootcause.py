"""Root cause: what fails, where it starts, and who only suffers from it.

Chains, contexts and causes are computed for any number of nodes at once;
``root_cause`` asks for one of them, and only its row comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions import weights
from . import compat, incidents as inc
from .graph import Graph, materialise, side, whole
from .traverse import classified_context, find_path, longest_incoming_walks, reached_pairs, roots_frame

MAX_HOPS = 5
LOAD_CEILING, LOAD_ANCHOR = 0.9, 0.45


def service_calls(graph: Graph) -> DataFrame:
    """(from, to, edge): calls lifted to services; frontier targets and calls within a service are left out."""
    frontier = graph.nodes.filter("type = 'FrontierNode'").select(F.col("id").alias("target"))
    calls = graph.with_confidence().filter("type = 'CALLS'").join(frontier, "target", "left_anti")
    owner = graph.owners().select(F.col("node").alias("target"), F.col("owner").alias("to"))
    source = graph.call_sources().select(F.col("member").alias("source"), F.col("service").alias("from"))
    edge = F.struct("id", "provenance", "weight", F.coalesce("signal.errorCount", F.lit(0)).alias("errors"), F.coalesce("signal.spanCount", "callCount", F.lit(0)).alias("volume"))
    return calls.join(source, "source").join(owner, "target").filter("`from` <> `to`").select("from", "to", edge.alias("edge"))


def _follow(graph: Graph, roots, hops: DataFrame, order, max_hops: int) -> DataFrame:
    """Greedy walks: at each hop the best edge by ``order`` to a service not yet on the path."""
    hops = materialise(hops)
    now = materialise(roots_frame(graph, roots)).select("root", F.array("root").alias("path"), F.expr("cast(array() as array<string>)").alias("provenances"), F.expr("cast(array() as array<bigint>)").alias("errors"), F.lit(1.0).alias("confidence"))
    done = None
    for _ in range(max_hops):
        open_ = side(now).withColumn("from", F.element_at("path", -1)).join(hops, "from").filter(~F.array_contains("path", F.col("to")))
        best = open_.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy(*order))).filter("_r = 1")
        step = materialise(best.select("root", F.concat("path", F.array("to")).alias("path"), F.concat("provenances", F.array("edge.provenance")).alias("provenances"), F.concat("errors", F.array("edge.errors")).alias("errors"), (F.col("confidence") * F.col("edge.weight")).alias("confidence")))
        if step.isEmpty():
            break
        ended = now.join(side(step.select("root")), "root", "left_anti")
        done = ended if done is None else done.union(ended)
        now = step
    out = now if done is None else done.union(now)
    return out.filter(F.size("path") > 1).select("root", "path", "provenances", "errors", weights.clamp(F.col("confidence")).alias("confidence"), F.element_at("path", -1).alias("culprit"))


def failing_chains(graph: Graph, roots, max_hops: int = MAX_HOPS) -> DataFrame:
    """From each service along the calls that fail most (then the more trusted, then the smaller id)."""
    hops = service_calls(graph).filter("edge.errors > 0")
    order = (F.desc("edge.errors"), F.desc(ids.rank("edge.provenance")), "to", "edge.id")
    return _follow(graph, roots, hops, order, max_hops)


def stale_chains(graph: Graph, roots, max_hops: int = MAX_HOPS) -> DataFrame:
    """From each service along calls whose best provenance is stale, the busiest first."""
    calls = service_calls(graph)
    best = calls.groupBy("from", "to").agg(F.min(F.struct((-ids.rank("edge.provenance")).alias("o"), F.col("edge.id").alias("i"), "edge")).alias("b")).select("from", "to", F.col("b.edge").alias("edge"))
    return _follow(graph, roots, best.filter("edge.provenance = 'STALE'"), (F.desc("edge.volume"), "to"), max_hops)


def compat_matches(graph: Graph, walks: DataFrame, matrix: compat.Matrix) -> DataFrame:
    """(root, culprit, reason, fix): the first service on a root's walk (cut) that a rule convicts.

    Databases are judged by drivers, services (and files and symbols) by runtime
    needs, then by package conflicts.
    """
    kinds = graph.nodes.select(F.col("id").alias("root"), F.col("type").alias("_kind"), F.col("engine").alias("_engine"), F.col("engineVersion").alias("_version"))
    steps = side(walks).join(kinds, "root").select("root", "_kind", "_engine", "_version", F.posexplode("path").alias("at", "node")).join(graph.owners(), "node")
    declared = whole(compat.dependencies(graph.nodes).withColumnsRenamed({"service": "owner"}))
    from ..functions import versions

    drivers = steps.filter("_kind = 'DatabaseNode'").join(declared, "owner").join(F.broadcast(matrix.pairs), (F.col("package") == F.col("driver")) & (F.col("_engine") == F.col("engine")))
    old = F.col("minEngine").isNotNull() & ~F.coalesce(versions.coerce(F.col("_version"))[0] >= versions.coerce(F.col("minEngine"))[0], F.lit(False))
    drivers = drivers.filter(~old & versions.older(F.col("version"), F.col("minDriver"))).select("root", "at", F.lit(0).alias("rule"), "owner", F.concat("driver", F.lit(" below "), "minDriver", F.lit(" for "), "engine").alias("reason"), F.concat(F.lit("Upgrade "), "driver", F.lit(" to >= "), "minDriver").alias("fix"))
    others = steps.filter("_kind in ('ServiceNode', 'FileNode', 'SymbolNode')")
    runtime = others.join(compat.node_engine(graph, matrix).withColumnRenamed("service", "owner"), "owner").select("root", "at", F.lit(1).alias("rule"), "owner", F.concat("package", F.lit(" needs runtime "), "minNode").alias("reason"), F.concat(F.lit("Raise the runtime to >= "), "minNode").alias("fix"))
    clash = others.join(compat.package_conflict(graph, matrix).withColumnRenamed("service", "owner"), "owner").select("root", "at", F.lit(2).alias("rule"), "owner", F.concat("package", F.lit(" needs "), "requires").alias("reason"), F.concat(F.lit("Upgrade "), "requires", F.lit(" to >= "), "minRequired").alias("fix"))
    found = drivers.union(runtime).union(clash)
    return found.groupBy("root").agg(F.min(F.struct("at", "rule", "owner", "reason", "fix")).alias("m")).select("root", F.col("m.owner").alias("culprit"), "m.reason", "m.fix")


def load_origin(graph: Graph, alerts, incidents: DataFrame | None = None) -> DataFrame:
    """(alert, node, outboundVolume, callCount): the dependent that drives the load; pure sources first."""
    upstream = reached_pairs(graph, alerts, "up", 10).select(F.col("root").alias("alert"), "node").filter("alert <> node")
    context = materialise(classified_context(graph, incidents, materialise(upstream.select(F.col("node").alias("id")).distinct())))
    order = F.struct(F.when(F.col("callCount") == 0, 0).otherwise(1).alias("kind"), (-F.col("outboundVolume")).alias("volume"), "node")
    # One row for each alert and task is shuffled, not each pair.
    best = upstream.join(side(context.filter("outboundVolume > 0")), "node").groupBy("alert").agg(F.min(order).alias("b")).select("alert", F.col("b.node").alias("node"))
    return best.join(side(context), "node").select("alert", "node", "outboundVolume", "callCount", "errorsEmittedHere", "errorsFromCallers", "stale", "latencyP95Ms")


def load_confidence(origin_volume, seed):
    """How sure a load origin is, from the seed's errors, staleness, saturation and the origin's volume."""
    clean = (seed["errorsFromCallers"] > 0) & (seed["errorsEmittedHere"] == 0)
    partly = seed["errorsFromCallers"] > seed["errorsEmittedHere"]
    evidence = (
        F.when(clean, 0.45).when(partly, 0.2).otherwise(0.0)
        + F.when(seed["stale"], 0.2).otherwise(0.0)
        + F.when(F.coalesce(seed["latencyP95Ms"], F.lit(0.0)) >= weights.SATURATION_P95_MS, 0.15).otherwise(0.0)
        + (weights.volume_weight(origin_volume) - 0.5) * 0.4
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(LOAD_CEILING), LOAD_ANCHOR + F.least(F.lit(1.0), evidence) * (LOAD_CEILING - LOAD_ANCHOR)))


def base_causes(graph: Graph, roots, incidents: DataFrame, matrix: compat.Matrix | None = None) -> DataFrame:
    """(root, source, culprit, reason, fix, path, provenances, confidence): compatibility, else failing calls, else incidents."""
    matrix = matrix or compat.Matrix(graph.spark)
    start = materialise(roots_frame(graph, roots))
    walks = materialise(longest_incoming_walks(graph, start))
    first = side(walks).join(compat_matches(graph, walks, matrix), "root").select("root", F.lit(0).alias("priority"), F.lit("compat").alias("source"), "culprit", "reason", "fix", "path", "provenances", "confidence")
    services = start.join(whole(graph.nodes.filter("type = 'ServiceNode'").select(F.col("id").alias("root"))), "root", "left_semi")
    chains = failing_chains(graph, services)
    asked = materialise(chains.select(F.col("culprit").alias("node")).union(start.select(F.col("root").alias("node"))).distinct())
    where = inc.localise(incidents, side(asked))
    told = where.select(F.col("node").alias("_node"), F.col("culprit").alias("_to"), "file", F.col("reason").alias("_reason"), F.col("fix").alias("_fix"))
    name = F.regexp_replace("culprit", "^service:", "")
    plain = F.concat(name, F.lit(" fails its calls ("), F.element_at("errors", -1).cast("string"), F.lit(" errors)"))
    extra = F.when(F.col("file").isNotNull(), F.array("file")).otherwise(F.expr("cast(array() as array<string>)"))
    seen = F.when(F.col("file").isNotNull(), F.array(F.lit("OBSERVED"))).otherwise(F.expr("cast(array() as array<string>)"))
    second = chains.join(told, F.col("culprit") == F.col("_node"), "left").select(
        "root", F.lit(1).alias("priority"), F.lit("cross-service").alias("source"), F.coalesce("_to", "culprit").alias("culprit"), F.coalesce("_reason", plain).alias("reason"),
        F.when(F.col("_reason").isNotNull(), F.col("_fix")).otherwise(F.concat(F.lit("Inspect "), name)).alias("fix"), F.concat("path", extra).alias("path"), F.concat("provenances", seen).alias("provenances"), weights.clamp(F.col("confidence") * weights.INCIDENT_CONFIDENCE).alias("confidence"),
    )
    third = side(start).join(told, F.col("root") == F.col("_node")).select(
        "root", F.lit(2).alias("priority"), F.lit("incident").alias("source"), F.col("_to").alias("culprit"), F.col("_reason").alias("reason"), F.col("_fix").alias("fix"), F.concat(F.array("root"), extra).alias("path"), seen.alias("provenances"), F.lit(weights.INCIDENT_CONFIDENCE).alias("confidence"),
    )
    every = first.union(second).union(third)
    best = every.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy("priority"))).filter("_r = 1")
    return best.drop("_r", "priority")


def navigated_causes(graph: Graph, roots, incidents: DataFrame, matrix: compat.Matrix | None = None) -> DataFrame:
    """(root, node, reason, fix, path, provenances, confidence, phase, candidates) of the cause of each failing node; roots without one are left out.

    All roots go through the same phases in one set of joins.  A base cause that
    only suffers from its callers is a victim: what drives the load is the
    cause, if anything does.  A root that was found by its own incident alone is
    a dead end: the last node of its stale calls is the cause, if it has any.
    Else the base cause stands.  ``candidates`` hold the cause first.
    """
    base = materialise(base_causes(graph, roots, incidents, matrix))
    context = classified_context(graph, incidents, base.select(F.col("culprit").alias("id")).distinct())
    had = F.struct("errorsFromCallers", "errorsEmittedHere", "stale", "latencyP95Ms").alias("seed")
    seeds = base.join(context.select(F.col("node").alias("culprit"), "victim", had), "culprit", "left")
    victim = F.coalesce("victim", F.lit(False))
    alone = (F.col("source") == "incident") & (F.col("culprit") == F.col("root")) & (F.size("path") == 1)
    seeds = materialise(seeds.withColumn("phase", F.when(victim, "victim").when(alone, "dead-end").otherwise("base")).withColumn("last", F.try_element_at("provenances", F.lit(-1))))

    suffering = seeds.filter("phase = 'victim'")
    drivers = load_origin(graph, suffering.select("root").distinct(), incidents).select(F.col("alert").alias("root"), F.col("node").alias("driver"), F.col("outboundVolume").alias("volume"))
    drivers = drivers.join(side(suffering.select("root", "seed")), "root")
    drivers = drivers.select("root", "driver", load_confidence(F.col("volume"), {k: F.col(f"seed.{k}") for k in ("errorsFromCallers", "errorsEmittedHere", "stale", "latencyP95Ms")}).alias("drive"))
    ends = stale_chains(graph, seeds.filter("phase = 'dead-end'").select("root").distinct())
    ends = ends.select("root", F.col("culprit").alias("end"), F.col("confidence").alias("ended"), F.col("path").alias("end_path"), F.col("provenances").alias("end_provenances"))
    every = seeds.join(whole(drivers), "root", "left").join(whole(ends), "root", "left")

    candidate = lambda node, kind, reason, confidence, provenance: F.struct(
        node.alias("node"), F.lit(kind).alias("classification"), reason.alias("reason"), confidence.cast("double").alias("confidence"), provenance.alias("provenance")
    )
    driven = candidate(F.col("driver"), "primary-failure", F.concat("driver", F.lit(" overloads "), "root", F.lit(", which only suffers")), F.col("drive"), F.lit("OBSERVED"))
    suffers = candidate(F.col("culprit"), "symptom-only", F.concat(F.col("seed.errorsFromCallers").cast("string"), F.lit(" errors arrive from callers; the fault is not here")), F.least("confidence", F.lit(0.4)), F.col("last"))
    stale = candidate(F.col("end"), "primary-failure", F.lit("the last observed calls lead here, but they are stale"), F.col("ended"), F.lit("STALE"))
    surfaced = candidate(F.col("culprit"), "symptom-only", F.lit("the failure surfaced here"), F.least("confidence", F.lit(weights.CEILING["STALE"])), F.col("last"))
    stands = candidate(F.col("culprit"), "primary-failure", F.col("reason"), F.col("confidence"), F.col("last"))
    candidates = F.when((F.col("phase") == "victim") & F.col("driver").isNotNull(), F.array(driven, suffers)).when(F.col("phase") == "victim", F.array(suffers))
    candidates = candidates.when((F.col("phase") == "dead-end") & F.col("end").isNotNull(), F.array(stale, surfaced)).otherwise(F.array(stands))
    told = materialise(every.withColumn("candidates", candidates).withColumn("top", F.col("candidates")[0]))

    ways = find_path(graph, told.filter("top.node <> culprit and end is null").select(F.col("root").alias("a"), F.col("top.node").alias("b")).distinct(), "up")
    ways = ways.select(F.col("a").alias("root"), F.col("path").alias("way"), F.transform("edges", lambda e: e["provenance"]).alias("way_provenances"))
    ended = (F.col("phase") == "dead-end") & F.col("end").isNotNull()
    moved = F.col("top.node") != F.col("culprit")
    path = F.when(ended, F.col("end_path")).when(moved, F.coalesce("way", F.array("root", "top.node"))).otherwise(F.col("path"))
    provenances = F.when(ended, F.col("end_provenances")).when(moved, F.coalesce("way_provenances", F.array("top.provenance"))).otherwise(F.col("provenances"))
    return told.join(whole(ways), "root", "left").select("root", F.col("top.node").alias("node"), F.col("top.reason").alias("reason"), "fix", path.alias("path"), provenances.alias("provenances"), F.col("top.confidence").alias("confidence"), "phase", "candidates")


def root_cause(graph: Graph, node: str, incidents: DataFrame, matrix: compat.Matrix | None = None, navigate: bool = True) -> dict | None:
    """The cause for one failing node, with ranked candidates; None if nothing points anywhere."""
    if navigate:
        rows = navigated_causes(graph, [node], incidents, matrix).collect()
    else:
        rows = base_causes(graph, [node], incidents, matrix).withColumnRenamed("culprit", "node").collect()
    if not rows:
        return None
    r = rows[0].asDict(recursive=True)
    out = {"rootCauseNode": r["node"], "rootCauseReason": r["reason"], "traversalPath": r["path"], "edgeProvenances": r["provenances"], "confidence": r["confidence"], "fixRecommendation": r["fix"]}
    return out | {"candidates": r["candidates"]} if navigate else out
