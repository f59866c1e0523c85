"""What changes a graph over time: folding, staleness, stitching, promotion, retirement, merge and diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions import latency, weights
from ..schema import EDGES, conform
from .graph import Graph, materialise, side, whole


def fold_observed(calls: DataFrame) -> DataFrame:
    """Observed edges from calls (type, source, target, ts, isError, ms, evidence): one aggregation.

    Counts, latest time (late calls do not move it back), the first evidence,
    the latency histogram with its p50 and p95, and the confidence.  The
    histogram is built from a bucket aggregation, so a hot edge sends at most
    530 rows from each task.
    """
    key = ["type", "source", "target"]
    stats = calls.groupBy(*key).agg(
        F.count(F.lit(1)).alias("spanCount"),
        F.sum(F.when(F.col("isError"), 1).otherwise(0)).cast("long").alias("errorCount"),
        F.max("ts").alias("lastObserved"),
        F.min(F.when(F.col("evidence").isNotNull(), F.struct("ts", "evidence"))).alias("first"),
    )
    hist = latency.histogram(calls.filter("ms is not null"), key, "ms")
    points = latency.quantiles(hist, key, {"p50": 0.5, "p95": 0.95}).drop("samples")
    maps = hist.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("latencyHist"))
    joined = stats.join(points, key, "left").join(maps, key, "left")
    signal = F.struct("spanCount", "errorCount", F.lit(0.0).alias("lastObservedAgeMs"), F.when(F.col("p50").isNotNull(), F.struct("p50", "p95")).alias("latencyMs"), "latencyHist", F.lit(None).cast("boolean").alias("anomalous"))
    out = joined.select(
        F.concat("type", F.lit(":OBSERVED:"), "source", F.lit("->"), "target").alias("id"),
        "source",
        "target",
        "type",
        F.lit("OBSERVED").alias("provenance"),
        weights.observed_confidence(F.col("spanCount"), F.col("errorCount")).alias("confidence"),
        "lastObserved",
        F.col("spanCount").alias("callCount"),
        F.col("first.evidence").alias("evidence"),
        signal.alias("signal"),
        F.when(F.col("source").rlike("^(file|symbol):"), "file").otherwise("service").alias("grain"),
    )
    return conform(out, EDGES)


def fold_signals(signals: DataFrame) -> DataFrame:
    """Observed edges from pre-counted signals (type, source, target, callCount, errorCount, ts): sums instead of repeated calls."""
    calls = F.greatest(F.lit(0), F.col("callCount").cast("long"))
    kept = signals.withColumns({"callCount": calls, "errorCount": F.least(F.greatest(F.lit(0), F.col("errorCount").cast("long")), calls)}).filter("callCount >= 1")
    out = kept.groupBy("type", "source", "target").agg(F.sum("callCount").alias("spanCount"), F.sum("errorCount").alias("errorCount"), F.max("ts").alias("lastObserved"))
    signal = F.struct("spanCount", "errorCount", F.lit(0.0).alias("lastObservedAgeMs"), F.lit(None).cast("struct<p50:double,p95:double>").alias("latencyMs"), F.lit(None).cast("map<int,bigint>").alias("latencyHist"), F.lit(None).cast("boolean").alias("anomalous"))
    return conform(
        out.select(F.concat("type", F.lit(":OBSERVED:"), "source", F.lit("->"), "target").alias("id"), "source", "target", "type", F.lit("OBSERVED").alias("provenance"), weights.observed_confidence(F.col("spanCount"), F.col("errorCount")).alias("confidence"), "lastObserved", F.col("spanCount").alias("callCount"), signal.alias("signal"), F.lit("service").alias("grain")),
        EDGES,
    )


def upsert(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """edges with newly folded ones added: counts and histograms sum, the latest time stays, stale edges revive."""
    old, new = edges.alias("o"), fresh.alias("n")
    joined = old.join(new, F.col("o.id") == F.col("n.id"), "full")
    both = F.col("o.id").isNotNull() & F.col("n.id").isNotNull()
    zero = F.lit(0).cast("long")
    spans = F.coalesce("o.signal.spanCount", "o.callCount", zero) + F.coalesce("n.signal.spanCount", "n.callCount", zero)
    errors = F.coalesce("o.signal.errorCount", zero) + F.coalesce("n.signal.errorCount", zero)
    merged = latency.merge_maps(F.col("o.signal.latencyHist"), F.col("n.signal.latencyHist"))
    # An edge that only tells of structure has no counts, and gets none by being told again.
    counted = F.coalesce("o.signal.spanCount", "o.callCount", "n.signal.spanCount", "n.callCount").isNotNull()
    signal = F.when(both & counted, F.struct(spans.alias("spanCount"), errors.alias("errorCount"), F.lit(0.0).alias("lastObservedAgeMs"), _quantiles_of(merged).alias("latencyMs"), merged.alias("latencyHist"), F.coalesce("o.signal.anomalous", "n.signal.anomalous").alias("anomalous"))).otherwise(F.coalesce("o.signal", "n.signal"))
    values = {
        "provenance": F.coalesce("n.provenance", "o.provenance"),
        "confidence": F.when(both & counted, weights.observed_confidence(spans, errors)).otherwise(F.coalesce("n.confidence", "o.confidence")),
        "lastObserved": F.greatest("o.lastObserved", "n.lastObserved"),
        "callCount": F.when(both & counted, spans).otherwise(F.coalesce("o.callCount", "n.callCount")),
        "signal": signal,
    }
    return joined.select(*(values.get(f.name, F.coalesce(f"o.{f.name}", f"n.{f.name}")).cast(f.dataType).alias(f.name) for f in EDGES.fields))


def _quantiles_of(hist: Column) -> Column:
    """p50 and p95 of a histogram held as a map."""
    entries = F.array_sort(F.map_entries(hist))
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda s, e: s + e["value"])

    def at(q: float) -> Column:
        rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(q) * total))
        step = lambda a, e: F.struct((a["s"] + e["value"]).alias("s"), F.when((a["s"] < rank) & (a["s"] + e["value"] >= rank), e["key"]).otherwise(a["b"]).alias("b"))
        found = F.aggregate(entries, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("int").alias("b")), step)
        return F.round(latency.midpoint(found["b"]), 2)

    return F.when(F.size(entries) > 0, F.struct(at(0.5).alias("p50"), at(0.95).alias("p95")))


def stale_sweep(graph: Graph, thresholds: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, events): observed edges older than their type's threshold become stale; one event for each."""
    limit = weights.stale_after_ms(F.col("type")) if thresholds is None else weights.choose(F.col("type"), thresholds, weights.STALE_AFTER_MS_OTHER)
    age = weights.age_ms(F.col("lastObserved"), graph.now_column())
    turned = (F.col("provenance") == "OBSERVED") & F.col("lastObserved").isNotNull() & (age > limit)
    marked = graph.valid_edges().withColumn("_turned", F.coalesce(turned, F.lit(False)))
    edges = marked.withColumns({"provenance": F.when(F.col("_turned"), "STALE").otherwise(F.col("provenance")), "confidence": F.when(F.col("_turned"), weights.STALE_CONFIDENCE).otherwise(F.col("confidence"))}).drop("_turned")
    events = marked.filter("_turned").select(F.col("id").alias("edgeId"), "source", "target", F.col("type").alias("edgeType"), limit.cast("long").alias("thresholdMs"), age.alias("ageMs"), "lastObserved", graph.now_column().alias("transitionedAt"))
    return edges, events


def stitch(graph: Graph, services: DataFrame, depth: int = 2) -> DataFrame:
    """Inferred edges from services (service) with a failed span: along declared edges that nobody observed.

    The walk stops at edges with an observed twin; each inferred edge comes once.
    """
    key = ["type", "source", "target"]
    # Cut, so that Spark sees how few these are: of all observed edges only their twins are sent.
    declared = materialise(graph.valid_edges().filter("provenance = 'EXTRACTED' and type in ('CALLS', 'CONNECTS_TO', 'DEPENDS_ON')").select(*key).distinct())
    seen = graph.valid_edges().filter((ids.id_provenance("id") == "OBSERVED") & F.col("type").isin("CALLS", "CONNECTS_TO", "DEPENDS_ON")).select(*key)
    open_edges = side(materialise(declared.join(whole(seen.join(side(declared), key, "left_semi")), key, "left_anti")))
    now, visited, out = services.select("service").distinct(), services.select("service").distinct(), None
    for _ in range(depth):
        step = now.join(open_edges, F.col("service") == F.col("source")).select("type", "source", "target").distinct()
        out = step if out is None else out.union(step)
        now = step.select(F.col("target").alias("service")).distinct().join(whole(visited), "service", "left_anti")
        visited = visited.union(now)
    found = out.distinct()
    return conform(found.select(F.concat("type", F.lit(":INFERRED:"), "source", F.lit("->"), "target").alias("id"), "source", "target", "type", F.lit("INFERRED").alias("provenance"), F.lit(weights.INFERRED_CONFIDENCE).alias("confidence")), EDGES)


def promotions(graph: Graph) -> DataFrame:
    """(frontier, service): frontiers whose host is a service's name or alias; the smaller id of several."""
    names = graph.nodes.filter("type = 'ServiceNode'").select(F.col("id").alias("service"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)"))))).alias("host"))
    frontiers = graph.nodes.filter("type = 'FrontierNode'").select(F.col("id").alias("frontier"), F.coalesce("host", "name").alias("host"))
    return frontiers.join(names, "host").groupBy("frontier").agg(F.min("service").alias("service"))


def promote(graph: Graph, allowed: DataFrame | None = None) -> Graph:
    """The graph with frontiers turned into the services they are: edges rewired, equal ones merged.

    Merged edges sum their call counts; signal and evidence of the one with the
    smaller old id stay.  ``allowed`` (id) limits which frontiers may go.
    """
    found = promotions(graph)
    if allowed is not None:
        found = found.join(allowed.withColumnRenamed("id", "frontier"), "frontier", "left_semi")
    to = found.select(F.col("frontier").alias("_f"), F.col("service").alias("_s"))
    edges = graph.valid_edges()
    edges = edges.join(to.withColumnsRenamed({"_f": "source", "_s": "_a"}), "source", "left").join(to.withColumnsRenamed({"_f": "target", "_s": "_b"}), "target", "left")
    moved = edges.withColumns({"_old": F.col("id"), "source": F.coalesce("_a", "source"), "target": F.coalesce("_b", "target")}).filter("source <> target")
    mark = F.when(ids.id_provenance("_old") == "EXTRACTED", F.lit("")).otherwise(F.concat(ids.id_provenance("_old"), F.lit(":")))
    moved = moved.withColumn("id", F.concat("type", F.lit(":"), mark, "source", F.lit("->"), "target"))
    rest = [f.name for f in EDGES.fields if f.name not in ("id", "callCount", "lastObserved")]
    merged = moved.groupBy("id").agg(F.sum("callCount").alias("callCount"), F.max("lastObserved").alias("lastObserved"), *(F.min_by(c, "_old").alias(c) for c in rest))
    nodes = graph.nodes.join(to.withColumnRenamed("_f", "id"), "id", "left_anti")
    return Graph(nodes, conform(merged, EDGES), graph.now)


def retire_missing(graph: Graph, files: DataFrame) -> Graph:
    """Without extracted edges whose evidence file (path) is gone, and files that then have no edge."""
    gone = (F.col("provenance") == "EXTRACTED") & F.col("evidence.file").isNotNull()
    kept = graph.valid_edges().withColumn("_file", F.when(gone, F.col("evidence.file")))
    stay = kept.filter("_file is null").unionByName(kept.filter("_file is not null").join(files.select(F.col("path").alias("_file")).distinct(), "_file", "left_semi").select(*kept.columns)).drop("_file")
    touched = stay.select(F.col("source").alias("id")).union(stay.select(F.col("target").alias("id"))).distinct()
    nodes = graph.nodes.filter("type <> 'FileNode'").unionByName(graph.nodes.filter("type = 'FileNode'").join(touched, "id", "left_semi").select(*graph.nodes.columns))
    return Graph(nodes, stay, graph.now)


def merge_snapshot(graph: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """Insert what a snapshot has and the graph lacks; edges need both ends.  An invalid snapshot is refused as a whole."""
    bad = nodes.filter("id is null or type is null").limit(1).count() + edges.filter("id is null or source is null or target is null or source = target").limit(1).count()
    if bad:
        raise ValueError("the snapshot is not valid")
    more = nodes.dropDuplicates(["id"]).join(whole(graph.nodes.select("id")), "id", "left_anti").select(*graph.nodes.columns)
    every = graph.nodes.unionByName(more)
    end = lambda name: whole(every.select(F.col("id").alias(name)))
    fresh = edges.dropDuplicates(["id"]).join(whole(graph.edges.select("id")), "id", "left_anti").join(end("source"), "source", "left_semi").join(end("target"), "target", "left_semi")
    return Graph(every, graph.edges.unionByName(fresh.select(*graph.edges.columns)), graph.now)


def canonical(df: DataFrame, side: str | None = None) -> Column:
    """A row (or the struct ``side`` of its fields beside the id) as one text in which equal rows are equal: fixed field order, maps as sorted entries."""
    values = []
    for f in df.schema.fields:
        at = f.name if side is None or f.name == "id" else f"{side}.{f.name}"
        kind = f.dataType.simpleString()
        values.append((F.array_sort(F.map_entries(at)) if kind.startswith("map") else _sorted_maps(f, at)).alias(f.name))
    return F.to_json(F.struct(*values))


def _sorted_maps(f, at: str) -> Column:
    kind = f.dataType
    if kind.typeName() == "struct" and any(x.dataType.typeName() == "map" for x in kind.fields):
        return F.when(F.col(at).isNotNull(), F.struct(*((F.array_sort(F.map_entries(F.col(at)[x.name])) if x.dataType.typeName() == "map" else F.col(at)[x.name]).alias(x.name) for x in kind.fields)))
    return F.col(at)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change, fields): added, removed or changed rows of two snapshots of a table, with the changed fields.

    The snapshots meet by id and digest; only rows whose digests differ meet as
    a whole, to tell their fields.
    """
    names = [c for c in before.columns if c in {*after.columns} and c != "id"]
    digest = lambda df, side: df.select("id", F.unhex(F.md5(canonical(df.select("id", *names)))).alias(side))
    met = digest(before, "b").join(digest(after, "a"), "id", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("b") != F.col("a"), "changed")
    found = materialise(met.select("id", change.alias("change")).filter("change is not null"))
    told = side(materialise(found.filter("change = 'changed'").select("id").distinct()))
    whole = lambda df, side: df.select("id", F.struct(*names).alias(side)).join(told, "id", "left_semi")
    kinds = dict(before.dtypes)
    same = lambda c: (F.to_json(F.struct(F.array_sort(F.map_entries(f"b.{c}")))) == F.to_json(F.struct(F.array_sort(F.map_entries(f"a.{c}"))))) if kinds[c].startswith("map") else (F.to_json(F.struct(f"b.{c}")) == F.to_json(F.struct(f"a.{c}")))
    fields = F.array_compact(F.array(*(F.when(~F.coalesce(same(c), F.lit(False)), c) for c in names)))
    both = whole(before, "b").join(whole(after, "a"), "id")
    # Rows that share an id meet in every pair; those that are equal tell nothing.
    text = lambda side: canonical(before.select("id", *names), side)
    changed = both.filter(text("b") != text("a")).select("id", F.lit("changed").alias("change"), fields.alias("fields"))
    return found.filter("change <> 'changed'").select("id", "change", F.lit(None).cast("array<string>").alias("fields")).unionByName(changed)


def graph_diff(before: Graph, after: Graph) -> DataFrame:
    """diff of nodes and edges: (kind, id, change, fields)."""
    return diff(before.nodes, after.nodes).withColumn("kind", F.lit("node")).unionByName(diff(before.edges, after.edges).withColumn("kind", F.lit("edge")))


def fold_columns(observed: DataFrame) -> DataFrame:
    """(table, columns): columns of tables from (table, column, provenance, confidence[, sdk]); names lower-case, provenances united."""
    name = F.lower("column")
    have = "sdk" in observed.columns
    each = observed.groupBy("table", name.alias("name")).agg(
        F.sort_array(F.collect_set("provenance")).alias("provenances"), F.max("confidence").alias("confidence"), (F.sort_array(F.collect_set("sdk")) if have else F.lit(None).cast("array<string>")).alias("sdkWrites")
    )
    return each.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("name", "provenances", "confidence", "sdkWrites"))).alias("columns"))
