"""From files to a graph: run the producers, then resolve and fold what they found."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import text, weights
from ...operators.graph import Graph, materialise
from ...schema import EDGES, NODES, conform
from . import code, data, manifests, platform  # noqa: F401 - they register their producers
from .base import FIELDS, PRODUCERS

RECORDS = (
    "producer string, kind string, id string, type string, name string, service string, path string, source string, target string, edgeType string, confidence double,"
    " line int, snippet string, method string, pathTemplate string, hostSource string, column string, sdk string, attrs string, file string"
)


def extract_records(files: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Records of all producers (or some) over (service, path, content): one Arrow-batched map, no shuffle.

    A producer that fails on a file gives an error record, and the rest go on.
    ``file`` is the file that a record was found in.
    """
    chosen = {n: p for n, p in PRODUCERS.items() if only is None or n in only}
    names = (*FIELDS, "file")
    kinds = {"confidence": pa.float64(), "line": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for service, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = f"{service}/{path}"
                for name, (paths, f) in chosen.items():
                    if paths.search(path or ""):
                        try:
                            out += [{**r, "producer": name, "file": file} for r in f(service, path, content or "")]
                        except Exception as e:  # noqa: BLE001
                            out.append({"producer": name, "kind": "error", "service": service, "path": path, "name": f"{type(e).__name__}: {e}", "file": file})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], kinds.get(n, pa.string())) for n in names], names=list(names))

    return files.select("service", "path", "content").mapInArrow(run, RECORDS)


def discover(files: DataFrame, depth: int = 5) -> DataFrame:
    """(name, directory) of services: the first manifest of a directory, the first directory of a name."""
    found = extract_records(files.filter(F.size(F.split("path", "/")) <= depth + 1).withColumn("service", F.lit("")), ("services",)).filter("kind = 'node'")
    d = found.select("name", F.get_json_object("attrs", "$.directory").alias("directory"), F.get_json_object("attrs", "$.order").cast("int").alias("order"))
    one = d.groupBy("directory").agg(F.min_by("name", "order").alias("name"))
    return one.groupBy("name").agg(F.min("directory").alias("directory"))


def assign(files: DataFrame, services: DataFrame) -> DataFrame:
    """files (path, content) with the service of the innermost directory they lie in, and their path within it.

    The folders of a path are exploded, so this is an equi join.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    tried = files.select("path", F.explode(folders).alias("directory")).join(services, "directory")
    inner = tried.groupBy("path").agg(F.max(F.struct(F.length("directory").alias("n"), "name")).alias("m")).select("path", F.col("m.name").alias("service"), F.col("m.n").alias("n"))
    joined = files.join(inner, "path")
    return joined.select("service", F.when(F.col("n") > 0, F.expr("substring(path, n + 2)")).otherwise(F.col("path")).alias("path"), "content")


def _attr(name: str, kind: str = "string"):
    return F.get_json_object("attrs", f"$.{name}").cast(kind)


def build(records: DataFrame, floor: float = weights.PRECISION_FLOOR) -> tuple[Graph, DataFrame]:
    """(graph, rejected): the graph of the records, and edges under the precision floor."""
    raw = records.filter("kind = 'node'")
    simple = ("language", "framework", "version", "nodeEngine", "engine", "engineVersion", "host", "kind", "provider", "fileType", "method", "pathTemplate", "operationType", "operationName", "rpcService", "rpcMethod", "channel", "module", "exportName")
    nodes = raw.withColumn("_o", F.coalesce(_attr("order", "int"), F.lit(0))).groupBy("id").agg(F.min(F.struct("_o", "path", "type", "name", "service", "line", "attrs")).alias("m")).select("id", "m.*")
    deps = F.when(F.get_json_object("attrs", "$.dependencies").isNotNull(), F.from_json(F.get_json_object("attrs", "$.dependencies"), "map<string,string>"))
    nodes = nodes.select("id", "type", "name", F.when(F.col("type") != "ServiceNode", F.col("service")).alias("service"), F.when(F.col("type") != "ServiceNode", F.col("path")).alias("path"), "line", F.when(F.col("type") == "ServiceNode", _attr("directory")).alias("repoPath"), deps.alias("dependencies"), _attr("port", "int").alias("port"), *(_attr(s).alias(s) for s in simple), F.lit("static").alias("discoveredVia"))

    named = records.filter("kind = 'symbol'")
    key = Window.partitionBy("service", "path", "name")
    ordinal = F.when(F.count(F.lit(1)).over(key) > 1, F.row_number().over(key.orderBy("line")) - 1)
    symbols = named.withColumn("_n", ordinal).withColumn("id", F.concat(F.lit("symbol:"), "service", F.lit(":"), "path", F.lit("#"), "name", F.when(F.col("_n").isNotNull(), F.concat(F.lit("~"), F.col("_n").cast("string"))).otherwise("")))
    symbols = symbols.select("id", "service", "path", "name", "line", _attr("end", "int").alias("end"), _attr("kind").alias("skind"), F.from_json("attrs", "bases array<string>, interfaces array<string>").alias("up"))
    symbol_nodes = symbols.select("id", F.lit("SymbolNode").alias("type"), "name", "service", F.col("skind").alias("kind"), F.col("name").alias("qualname"), F.col("path").alias("relPath"), F.struct(F.col("line").alias("startLine"), F.col("end").alias("endLine")).alias("span"), F.lit("static").alias("discoveredVia"))
    shape = conform(nodes, NODES).unionByName(conform(symbol_nodes, NODES))

    edges = records.filter("kind in ('edge', 'fk')").select("edgeType", "source", "target", "confidence", "path", "line", "snippet", "method", "pathTemplate", "hostSource")
    edges = edges.unionByName(_symbol_edges(records, symbols)).unionByName(_imports(records)).unionByName(_calls(records, shape)).unionByName(_model_uses(records))
    evidence = F.struct(F.col("path").alias("file"), "line", "snippet", "method", "pathTemplate", "hostSource")
    folded = edges.filter("source <> target").groupBy("edgeType", "source", "target").agg(F.max("confidence").alias("confidence"), F.min(F.struct("path", F.coalesce("line", F.lit(0)).alias("o"), evidence.alias("e"))).alias("m"))
    every = folded.select(F.concat("edgeType", F.lit(":"), "source", F.lit("->"), "target").alias("id"), "source", "target", F.col("edgeType").alias("type"), F.lit("EXTRACTED").alias("provenance"), "confidence", F.col("m.e").alias("evidence"), F.when(F.col("source").rlike("^(file|symbol):"), "file").otherwise("service").alias("grain"))
    kept = every.filter(F.coalesce("confidence", F.lit(0.0)) >= floor)

    cols = records.filter("kind = 'column'").groupBy("id", F.lower("column").alias("name")).agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("sdk")).alias("sdk"))
    columns = cols.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", F.array(F.lit("EXTRACTED")).alias("provenances"), "confidence", F.when(F.size("sdk") > 0, F.col("sdk")).alias("sdkWrites")))).alias("columns"))
    guards = records.filter("kind = 'guard'").groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.split("name", ","))))).alias("guardedFields"))
    aliases = records.filter("kind = 'alias'").groupBy(F.concat(F.lit("service:"), "service").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("aliases"))
    platforms = records.filter("kind = 'platform'").groupBy(F.concat(F.lit("service:"), "service").alias("id")).agg(F.min("name").alias("platform"), F.min("target").alias("platformName"))
    one_db = kept.filter("type = 'CONNECTS_TO' and target like 'database:%'").groupBy(F.col("source").alias("id")).agg(F.when(F.count_distinct("target") == 1, F.min(F.regexp_replace("target", "^database:", ""))).alias("dbConnectionTarget"))
    full = shape.drop("columns", "guardedFields", "aliases", "platform", "platformName", "dbConnectionTarget")
    for more in (columns, guards, aliases, platforms, one_db):
        full = full.join(more, "id", "left")
    known = full.select("id")
    linked = kept.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(conform(full, NODES), conform(linked, EDGES)), every.filter(F.coalesce("confidence", F.lit(0.0)) < floor)


_EDGE = ("edgeType", "source", "target", "confidence", "path", "line", "snippet", "method", "pathTemplate", "hostSource")


def _edge(df: DataFrame, edge_type, source, target, confidence=None) -> DataFrame:
    none = F.lit(None).cast("string")
    have = {*df.columns}
    return df.select(edge_type.alias("edgeType"), source.alias("source"), target.alias("target"), (F.lit(0.85) if confidence is None else confidence).alias("confidence"), "path", (F.col("line") if "line" in have else F.lit(None).cast("int")).alias("line"), none.alias("snippet"), (F.col("method") if "method" in have else none).alias("method"), (F.col("pathTemplate") if "pathTemplate" in have else none).alias("pathTemplate"), none.alias("hostSource"))


def _symbol_edges(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """Containment, inheritance, implementation and calls between symbols; names must be unique in the service."""
    file_id = F.concat(F.lit("file:"), "service", F.lit(":"), "path")
    contains = _edge(symbols, F.lit("CONTAINS"), file_id, F.col("id"))
    bare = symbols.select("service", F.substring_index("name", ".", -1).alias("bare"), F.col("id").alias("to"), "skind")
    unique = bare.groupBy("service", "bare").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to"), F.min("skind").alias("to_kind")).filter("n = 1")
    up = symbols.select("id", "service", "path", "line", F.explode(F.concat(F.transform("up.bases", lambda b: F.struct(F.lit("INHERITS").alias("k"), b.alias("b"))), F.transform("up.interfaces", lambda b: F.struct(F.lit("IMPLEMENTS").alias("k"), b.alias("b"))))).alias("u"))
    inherits = _edge(up.select("*", F.col("u.b").alias("bare")).join(unique, ["service", "bare"]).filter("to_kind = 'class'"), F.col("u.k"), F.col("id"), F.col("to"))
    sites = records.filter("kind = 'symbol-call'").select("service", "path", F.col("name").alias("bare"), "line").withColumn("site", F.monotonically_increasing_id())
    around = sites.join(symbols.select("service", "path", F.col("id").alias("from"), F.col("line").alias("a"), F.col("end").alias("b")), ["service", "path"]).filter("line between a and b")
    inner = around.groupBy("site", "service", "path", "bare", "line").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("n"), "from")).alias("m"))
    calls = _edge(inner.join(unique, ["service", "bare"]), F.lit("CALLS"), F.col("m.from"), F.col("to"))
    return contains.unionByName(inherits).unionByName(calls)


def _imports(records: DataFrame) -> DataFrame:
    """Imports of files that exist: of the candidates for one import, the first."""
    files = records.filter("kind = 'node' and type = 'FileNode'").select("service", F.col("path").alias("name"), F.col("id").alias("to"))
    found = records.filter("kind = 'import'").select("service", "path", "name", "line", F.col("target").alias("spec"), F.col("confidence").alias("rank")).join(files, ["service", "name"])
    best = found.groupBy("service", "path", "spec").agg(F.min(F.struct("rank", "to", "line")).alias("m")).select("service", "path", F.col("m.to").alias("to"), F.col("m.line").alias("line"))
    packages = records.filter("kind = 'import-package'").select("service", "path", F.col("name").alias("folder"), "line").join(files.withColumn("folder", F.regexp_replace("name", "/?[^/]*$", "")), ["service", "folder"]).select("service", "path", "to", "line")
    every = best.unionByName(packages)
    return _edge(every, F.lit("IMPORTS"), F.concat(F.lit("file:"), "service", F.lit(":"), "path"), F.col("to"))


def _calls(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """URL literals by host to services, client calls by method and template to routes."""
    names = nodes.filter("type = 'ServiceNode'").select(F.col("id").alias("to"), F.lower("name").alias("name"))
    aliases = records.filter("kind = 'alias'").select(F.concat(F.lit("service:"), "service").alias("to"), F.lower("name").alias("name"))
    hosts = names.unionByName(aliases).groupBy("name").agg(F.min("to").alias("to"))
    urls = records.filter("kind = 'url'").select("name", "source", "path", "line", "confidence", "pathTemplate").join(hosts, "name")
    first = _edge(urls, F.lit("CALLS"), F.col("source"), F.col("to"), F.col("confidence"))
    routes = nodes.filter("type = 'RouteNode'").select(F.col("id").alias("to"), F.col("service").alias("_owner"), F.upper("method").alias("_m"), text.normalised_template(F.col("pathTemplate")).alias("_t"))
    calls = records.filter("kind = 'client-call'").select("service", "source", "path", "line", "method", "pathTemplate", text.normalised_template(F.col("pathTemplate")).alias("_t"))
    hit = calls.join(routes, "_t").filter("(_m = method or _m = 'ALL') and _owner <> service")
    one = hit.groupBy("source", "path", "line", "method", "pathTemplate").agg(F.count_distinct("to").alias("n"), F.min("to").alias("to")).filter("n = 1")
    return first.unionByName(_edge(one, F.lit("CALLS"), F.col("source"), F.col("to")))


def _model_uses(records: DataFrame) -> DataFrame:
    """Uses of mapped classes in other files; ambiguous class names are dropped."""
    models = records.filter("kind = 'model'").groupBy("service", "name").agg(F.count_distinct("target").alias("n"), F.min("target").alias("to"), F.min("path").alias("_home")).filter("n = 1")
    uses = records.filter("kind = 'model-use'").select("service", "path", "name", "line", "confidence").join(models, ["service", "name"]).filter("path <> _home")
    return _edge(uses, F.lit("CALLS"), F.concat(F.lit("file:"), "service", F.lit(":"), "path"), F.col("to"), F.col("confidence"))


def errors(records: DataFrame) -> DataFrame:
    """(producer, file, message) of producers that failed."""
    return records.filter("kind = 'error'").select("producer", F.concat_ws("/", "service", "path").alias("file"), F.col("name").alias("message"))


def extract(files: DataFrame, floor: float = weights.PRECISION_FLOOR) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, rejected edges, errors) of a source tree (path, content)."""
    placed = assign(files, discover(files))
    # Written once: what follows reads the records many times.
    found = materialise(extract_records(placed))
    # Manifests lie at a service's root, so their own name is the service's.
    graph, rejected = build(found, floor)
    return graph, rejected, errors(found)


__all__ = ["FIELDS", "RECORDS", "assign", "build", "discover", "errors", "extract", "extract_records"]
