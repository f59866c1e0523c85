"""Bounded traversals over a Graph, for one origin or for many at once.

All origins advance together in one loop (the ``root`` column tells them
apart), a node is visited once for each origin, and the loop ends when nothing
is left to visit.  Paths are the smallest in binary order among the shortest,
so results do not depend on insertion order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weights
from .graph import FEW, Graph, materialise, side, whole

MAX_PATH = 5


def roots_frame(graph: Graph, roots: list[str] | DataFrame) -> DataFrame:
    """(root) of origins that exist in the graph."""
    known = graph.nodes.select(F.col("id").alias("root"))
    if not isinstance(roots, DataFrame):
        # The caller's list was in the driver anyway; the nodes never are.
        return known.join(F.broadcast(graph.spark.createDataFrame([(r,) for r in roots], "root string")), "root", "left_semi").distinct()
    return roots.join(whole(known), "root", "left_semi").distinct()


def breadth_first(graph: Graph, roots: list[str] | DataFrame, direction: str, depth: int) -> DataFrame:
    """(root, node, distance, path, confidence, type, provenance, edges) of all nodes within depth, roots excepted."""
    start = materialise(roots_frame(graph, roots))
    none = "cast(array() as array<struct<type:string,provenance:string,errorCount:bigint,p95:double,anomalous:boolean>>)"
    now = start.select("root", F.col("root").alias("node"), F.array("root").alias("path"), F.lit(1.0).alias("confidence"), F.expr(none).alias("edges"))
    seen, levels = start.select("root", F.col("root").alias("node")), []
    for distance in range(1, depth + 1):
        # Only edges of nodes just reached are ranked, so few roots do not deal all edges anew.
        best = graph.best_edges(direction, now.select(F.col("node").alias("near")))
        reached = side(now).join(best, F.col("node") == F.col("near")).select(
            "root",
            F.col("far").alias("node"),
            F.struct(F.concat("path", F.array("far")).alias("path"), (F.col("confidence") * F.col("edge.weight")).alias("confidence"), F.concat("edges", F.array(F.struct(*(F.col(f"edge.{c}").alias(c) for c in ("type", "provenance", "errorCount", "p95", "anomalous"))))).alias("edges")).alias("w"),
        )
        fresh = reached.groupBy("root", "node").agg(F.min("w").alias("w")).join(whole(seen), ["root", "node"], "left_anti")
        now = materialise(fresh.select("root", "node", "w.path", "w.confidence", "w.edges"))
        if now.isEmpty():
            break
        levels.append(now.withColumn("distance", F.lit(distance)))
        seen = seen.union(now.select("root", "node"))
    if not levels:
        levels = [now.withColumn("distance", F.lit(0)).filter("false")]
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    last = F.element_at("edges", -1)
    return out.select("root", "node", F.col("distance").cast("long").alias("distance"), "path", weights.clamp(F.col("confidence")).alias("confidence"), last["type"].alias("type"), last["provenance"].alias("provenance"), "edges")


def reached(graph: Graph, start: DataFrame, direction: str, depth: int) -> DataFrame:
    """(id) of nodes within depth of any of the start nodes (id), these left out: one row a node, whoever reaches it."""
    links = graph.links(direction).withColumnRenamed("far", "id")
    seen = now = materialise(start.select("id").distinct())
    found = None
    for _ in range(depth):
        step = side(now).withColumnRenamed("id", "near").join(links, "near").select("id").distinct()
        now = materialise(step.join(whole(seen), "id", "left_anti"))
        if now.isEmpty():
            break
        found = now if found is None else found.union(now)
        seen = seen.union(now)
    return now.filter("false") if found is None else found


def reached_pairs(graph: Graph, roots: list[str] | DataFrame, direction: str, depth: int) -> DataFrame:
    """(root, node) of all nodes within depth, roots excepted: ``breadth_first`` where nobody asks for the way."""
    start = materialise(roots_frame(graph, roots))
    links, now = graph.links(direction), start.select("root", F.col("root").alias("node"))
    seen, found = now, None
    for _ in range(depth):
        step = side(now).withColumnRenamed("node", "near").join(links, "near").select("root", F.col("far").alias("node")).distinct()
        now = materialise(step.join(whole(seen), ["root", "node"], "left_anti"))
        if now.isEmpty():
            break
        found = now if found is None else found.union(now)
        seen = seen.union(now)
    return now.filter("false") if found is None else found


def blast_radius(graph: Graph, roots: list[str] | DataFrame, depth: int = 10) -> DataFrame:
    """Everything that depends on each root: root, node, distance, provenance, path, confidence."""
    return breadth_first(graph, roots, "up", depth).select("root", "node", "distance", "provenance", "path", "confidence").orderBy("root", "distance", "node")


def transitive_dependencies(graph: Graph, roots: list[str] | DataFrame, depth: int = 3) -> DataFrame:
    """Everything each root depends on.  Containment hops use up depth but are not reported."""
    if not 1 <= depth <= 10:
        raise ValueError("depth must lie in 1..10")
    found = breadth_first(graph, roots, "down", depth).filter("type <> 'CONTAINS'")
    return found.select("root", "node", "distance", F.col("type").alias("edgeType"), "provenance", "path", "confidence").orderBy("root", "distance", "node")


def find_path(graph: Graph, pairs: list[tuple[str, str]] | DataFrame, direction: str, depth: int = MAX_PATH) -> DataFrame:
    """(a, b, path, edges, length) of the smallest shortest path from a to b along (down) or against (up) the edges."""
    if not isinstance(pairs, DataFrame):
        pairs = graph.spark.createDataFrame(pairs, "a string, b string")
    pairs = materialise(pairs)
    found = breadth_first(graph, pairs.select(F.col("a").alias("root")).distinct(), direction, depth)
    hit = side(pairs).join(found, (F.col("a") == F.col("root")) & (F.col("b") == F.col("node")))
    same = pairs.filter("a = b").join(whole(graph.nodes.select(F.col("id").alias("a"))), "a", "left_semi")
    out = hit.select("a", "b", "path", "edges", F.col("distance").alias("length"))
    return out.union(same.select("a", "b", F.array("a").alias("path"), F.expr("cast(array() as array<struct<type:string,provenance:string,errorCount:bigint,p95:double,anomalous:boolean>>)").alias("edges"), F.lit(0).cast("long").alias("length")))


def relate(graph: Graph, pairs: list[tuple[str, str]] | DataFrame, depth: int = MAX_PATH) -> DataFrame:
    """For each (a, b): related, direction, the paths down and up, whether they carry a signal, grainGap, note."""
    if not isinstance(pairs, DataFrame):
        pairs = graph.spark.createDataFrame(pairs, "a string, b string")
    signal = F.forall("edges", lambda e: (F.coalesce(e["errorCount"], F.lit(0)) > 0) | e["p95"].isNotNull() | e["anomalous"]) & (F.size("edges") > 0)
    sides = []
    for name in ("down", "up"):
        found = find_path(graph, pairs, name, depth)
        sides.append(found.select("a", "b", F.struct("path", F.transform("edges", lambda e: e["type"]).alias("types"), F.transform("edges", lambda e: e["provenance"]).alias("provenances"), signal.alias("carriesSignal")).alias(name)))
    known = graph.nodes.select(F.col("id"))
    here_a = known.select(F.col("id").alias("a"), F.lit(True).alias("has_a"))
    here_b = known.select(F.col("id").alias("b"), F.lit(True).alias("has_b"))
    out = pairs.join(whole(here_a), "a", "left").join(whole(here_b), "b", "left").join(sides[0], ["a", "b"], "left").join(sides[1], ["a", "b"], "left")
    first = F.coalesce(F.col("down.path"), F.col("up.path"))
    fine = F.col("a").rlike("^(file|symbol):") & F.col("b").rlike("^(file|symbol):")
    gap = fine & F.exists(first, lambda n: ~n.rlike("^(file|symbol):"))
    return out.select(
        "a",
        "b",
        first.isNotNull().alias("related"),
        F.when(F.col("down").isNotNull(), "a->b").when(F.col("up").isNotNull(), "b->a").alias("direction"),
        "down",
        "up",
        F.coalesce(gap, F.lit(False)).alias("grainGap"),
        F.when(F.col("has_a").isNull(), F.concat(F.lit("node not found: "), "a"))
        .when(F.col("has_b").isNull(), F.concat(F.lit("node not found: "), "b"))
        .when(first.isNull(), F.lit(f"no path within {depth} hops"))
        .alias("note"),
    )


def node_context(graph: Graph, incidents: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Per node: errorsEmittedHere, errorsFromCallers, callCount, outboundVolume, lastInbound, latencyP95Ms, stale.

    Counts run over the node and, for services, its files.  Each direction is
    one aggregation over the edges, whose sums are joined with the nodes.
    """
    scope = graph.scope(nodes)
    if nodes is not None:
        scope = materialise(scope)
    edges = graph.valid_edges().filter("type <> 'CONTAINS'").select("source", "target", "type", "provenance", "lastObserved", F.coalesce("callCount", "signal.spanCount", F.lit(0)).alias("volume"), F.coalesce("signal.errorCount", F.lit(0)).alias("errors"), F.col("signal.latencyMs.p95").alias("p95"))

    def folded(end: str, **aggs) -> DataFrame:
        """``aggs`` of the edges at each member, then of a node's members: edges are summed where they lie, and only sums are joined."""
        mine = edges if nodes is None else edges.join(side(scope.select(F.col("member").alias(end))), end, "left_semi")
        sums = mine.groupBy(F.col(end).alias("member")).agg(*(f(c).alias(name) for name, (f, c) in aggs.items()))
        return scope.join(sums, "member").groupBy("node").agg(*(f(name).alias(name) for name, (f, _) in aggs.items()))

    stale = F.col("provenance") == "STALE"
    into = folded("target", errorsFromCallers=(F.sum, "errors"), callCount=(F.sum, "volume"), latencyP95Ms=(F.max, "p95"), lastInbound=(F.max, "lastObserved"), stale_in=(F.max, stale))
    out_of = folded("source", outboundVolume=(F.sum, "volume"), outboundErrors=(F.sum, F.when(F.col("type") == "CALLS", F.col("errors")).otherwise(0)), stale_out=(F.max, stale))
    every = graph.nodes.select(F.col("id").alias("node"))
    if nodes is not None:
        every = materialise(every.join(side(nodes.select(F.col("id").alias("node"))), "node", "left_semi"))
    joined = every.join(into, "node", "left").join(out_of, "node", "left")
    if incidents is not None:
        from .incidents import match_nodes

        counts = match_nodes(incidents, whole(every) if nodes is None else side(every)).groupBy("node").agg(F.count(F.lit(1)).alias("incidents"))
        joined = joined.join(counts, "node", "left")
    else:
        joined = joined.withColumn("incidents", F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    return joined.select(
        "node",
        (F.coalesce("incidents", zero) + F.coalesce("outboundErrors", zero)).alias("errorsEmittedHere"),
        F.coalesce("errorsFromCallers", zero).alias("errorsFromCallers"),
        F.coalesce("callCount", zero).alias("callCount"),
        F.coalesce("outboundVolume", zero).alias("outboundVolume"),
        "lastInbound",
        "latencyP95Ms",
        (F.coalesce("stale_in", F.lit(False)) | F.coalesce("stale_out", F.lit(False))).alias("stale"),
    )


def classified_context(graph: Graph, incidents: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """node_context with classification and whether the node is a victim of load."""
    c = node_context(graph, incidents, nodes)
    args = (F.col("errorsEmittedHere"), F.col("errorsFromCallers"), F.col("stale"), F.col("latencyP95Ms"))
    return c.withColumn("classification", weights.classify(*args)).withColumn("victim", weights.is_victim(*args))


def expand(graph: Graph, origins: list[str] | DataFrame, direction: str, incidents: DataFrame | None = None) -> DataFrame:
    """One hop: origin, node, edgeType, provenance, classification and context of each best-edge neighbour.

    A neighbour whose best edge is containment is left out.
    """
    start = roots_frame(graph, origins)
    best = materialise(graph.best_edges(direction, materialise(start.withColumnRenamed("root", "near"))).filter("edge.type <> 'CONTAINS'"))
    context = classified_context(graph, incidents, best.select(F.col("far").alias("id")).distinct())
    return best.join(context, F.col("far") == F.col("node")).select(F.col("near").alias("origin"), "node", F.col("edge.type").alias("edgeType"), F.col("edge.provenance").alias("provenance"), *(c for c in context.columns if c != "node")).orderBy("origin", "node")


def observed_dependencies(graph: Graph, origins: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies, summary): distinct observed outbound edges of each origin's scope, and what calls it.

    Frontier targets stay, unlike in traversals.
    """
    start = materialise(roots_frame(graph, origins))
    scope = graph.scope(start.withColumnRenamed("root", "id"))
    edges = graph.valid_edges().filter("type <> 'CONTAINS'")
    outward = scope.join(edges, F.col("member") == F.col("source"))
    dependencies = outward.filter("provenance = 'OBSERVED'").select(F.col("node").alias("origin"), "id", "source", "target", "type", "callCount", "lastObserved").dropDuplicates(["origin", "id"])
    declared = outward.groupBy("node").agg(F.max(F.col("provenance") == "EXTRACTED").alias("declared"), F.count_distinct(F.when(F.col("provenance") == "OBSERVED", F.col("id"))).alias("n"))
    inward = scope.join(edges.filter("provenance = 'OBSERVED'"), F.col("member") == F.col("target")).groupBy("node").agg(
        F.count(F.lit(1)).alias("inboundObservedCount"), F.sum(F.coalesce("callCount", "signal.spanCount", F.lit(1))).alias("inboundVolume"), F.max("lastObserved").alias("inboundLastObserved")
    )
    summary = start.withColumnRenamed("root", "node").join(declared, "node", "left").join(inward, "node", "left")
    summary = summary.select(
        F.col("node").alias("origin"),
        ((F.coalesce("n", F.lit(0)) > 0) | (F.coalesce("inboundObservedCount", F.lit(0)) > 0)).alias("observed"),
        F.coalesce("inboundObservedCount", F.lit(0)).cast("long").alias("inboundObservedCount"),
        F.coalesce("declared", F.lit(False)).alias("hasExtractedOutbound"),
        F.coalesce("inboundVolume", F.lit(0)).cast("long").alias("inboundVolume"),
        "inboundLastObserved",
    )
    return dependencies.orderBy("origin", "target", "source", "id"), summary


def walk_bounds(best: DataFrame, depth: int) -> DataFrame:
    """(near, bound) of nodes with a walk along ``best``: its most hops, ``depth`` at most, nodes counted as often as they come.

    No simple walk is longer, so a prefix that cannot reach a length is known
    before it is extended.
    """
    now = materialise(best.select("near").distinct())
    levels = [now.withColumn("bound", F.lit(1))]
    for k in range(2, depth + 1):
        now = materialise(best.join(side(now.withColumnRenamed("near", "far")), "far", "left_semi").select("near").distinct())
        if now.isEmpty():
            break
        levels.append(now.withColumn("bound", F.lit(k)))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return materialise(out.groupBy("near").agg(F.max("bound").alias("bound")))


def _walks_of(roots: DataFrame, best: DataFrame, bounds: DataFrame, length: int, beam: int) -> tuple[DataFrame, DataFrame]:
    """(found, cut): the smallest simple walk of exactly ``length`` hops of each root, and roots of which prefixes were left out.

    Of a root's prefixes only the ``beam`` smallest that may still get there are
    extended.  Whatever comes of those left out is larger than what comes of the
    kept ones, so a walk that is found is the smallest.
    """
    now = roots.select("root", F.array("root").alias("path"), F.expr("cast(array() as array<string>)").alias("provenances"), F.lit(1.0).alias("confidence"))
    order = Window.partitionBy("root").orderBy("path")
    reach = side(bounds.withColumnsRenamed({"near": "far", "bound": "_more"}))
    cut = roots.select("root").limit(0)
    for k in range(1, length + 1):
        step = side(now).withColumn("near", F.element_at("path", -1)).join(best, "near").filter(~F.array_contains("path", F.col("far")))
        if k < length:
            step = step.join(reach, "far").filter(F.lit(k) + F.col("_more") >= length)
        step = step.select("root", F.concat("path", F.array("far")).alias("path"), F.concat("provenances", F.array("edge.provenance")).alias("provenances"), (F.col("confidence") * F.col("edge.weight")).alias("confidence"))
        if k == length:
            # Only the smallest stays: one row for each root and task is shuffled.
            least = step.groupBy("root").agg(F.min(F.struct("path", "provenances", "confidence")).alias("w"))
            return materialise(least.select("root", "w.*")), materialise(cut.distinct())
        ranked = materialise(step.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= beam + 1))
        cut = cut.union(ranked.filter(F.col("_r") == beam + 1).select("root"))
        now = ranked.filter(F.col("_r") <= beam).drop("_r")
    raise ValueError("a walk has at least one hop")


def edges_against(graph: Graph, start: DataFrame, depth: int) -> DataFrame:
    """(near, far, edge): the best edges that walks of up to ``depth`` hops against them can use, from the nodes (near) of ``start``.

    Edges of a node are ranked when it is reached.  Of many nodes reached, those
    to which no edge goes are dropped first, by ids alone.
    """
    now, seen, out = start, start, None
    for _ in range(depth):
        if now.count() > FEW:
            now = materialise(now.join(whole(graph.links("up").select("near").distinct()), "near", "left_semi"))
        best = materialise(graph.best_edges("up", now).select("near", "far", F.struct("edge.provenance", "edge.weight").alias("edge")))
        out = best if out is None else out.unionByName(best)
        now = materialise(best.select(F.col("far").alias("near")).distinct().join(whole(seen), "near", "left_anti"))
        if now.isEmpty():
            break
        seen = seen.union(now)
    return out


def longest_incoming_walks(graph: Graph, roots: list[str] | DataFrame, depth: int = MAX_PATH, beam: int = 64) -> DataFrame:
    """(root, path, provenances, confidence): the longest simple walk against best edges; the smallest path of equals.

    Lengths are tried from the longest that a root's bound allows.  A root for
    which the ``beam`` smallest prefixes lead nowhere, though others were left
    out, is tried again with a beam 64 times as wide; so the answer is exact,
    and a hub costs beam times neighbours and not all walks through it.
    """
    start = materialise(roots_frame(graph, roots))
    best = edges_against(graph, start.withColumnRenamed("root", "near"), depth)
    bounds = walk_bounds(best, depth)
    start = start.join(side(bounds.withColumnRenamed("near", "root")), "root", "left")
    open_ = materialise(start.select("root", F.coalesce("bound", F.lit(0)).alias("bound")))
    out = None
    for length in range(depth, 0, -1):
        mine, width = open_.filter(F.col("bound") >= length).select("root"), beam
        while not mine.isEmpty():
            found, cut = _walks_of(mine, best, bounds, length, width)
            out = found if out is None else out.union(found)
            told = found.select("root")
            open_ = materialise(open_.join(side(told), "root", "left_anti"))
            mine, width = materialise(cut.join(side(told), "root", "left_anti")), width * 64
    alone = open_.select("root", F.array("root").alias("path"), F.expr("cast(array() as array<string>)").alias("provenances"), F.lit(1.0).alias("confidence"))
    return (alone if out is None else out.union(alone)).select("root", "path", "provenances", weights.clamp(F.col("confidence")).alias("confidence"))
