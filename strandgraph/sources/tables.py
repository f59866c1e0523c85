"""Snapshots, ledgers and logs: readers with fixed schemas, writers that append or replace."""

from __future__ import annotations

import json
import time
import uuid
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import Graph
from ..schema import EDGES, INCIDENTS, LOGS, NODES, STALE_EVENTS, conform, empty

SNAPSHOT_VERSION = 7
META = "schemaVersion int, exportedAt string, save string, at long"
LOG_KEEP, LOG_HOURS = 1000, 24
LOG_LIMIT, LOG_MAX = 100, 1000


def _snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A row for each finished save; none where nothing was saved."""
    try:
        return spark.read.schema(META).json(f"{path}/meta")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], META)


def save_graph(graph: Graph, path: str) -> None:
    """Nodes and edges as Parquet in a folder of this save; a row that points at it comes last.

    Until that row is there, readers see the save before, so a torn save shows
    neither new nodes with old edges nor nothing.
    """
    spark = graph.spark
    save = f"save-{uuid.uuid4().hex}"
    graph.nodes.write.parquet(f"{path}/{save}/nodes")
    graph.edges.write.parquet(f"{path}/{save}/edges")
    at = (_snapshots(spark, path).agg(F.max("at")).first()[0] or 0) + 1
    spark.createDataFrame([(SNAPSHOT_VERSION, graph.now, save, at)], META).coalesce(1).write.mode("append").json(f"{path}/meta")


def load_graph(spark: SparkSession, path: str) -> Graph:
    """A saved graph; a missing one is empty, an unknown version is refused."""
    meta = _snapshots(spark, path).orderBy(F.desc("at"), F.desc("save")).first()
    if meta is None:
        return Graph(empty(spark, NODES), empty(spark, EDGES))
    if meta["schemaVersion"] != SNAPSHOT_VERSION:
        raise ValueError(f"unknown snapshot version {meta['schemaVersion']}")
    base = f"{path}/{meta['save']}" if meta["save"] else path
    return Graph(spark.read.schema(NODES).parquet(f"{base}/nodes"), spark.read.schema(EDGES).parquet(f"{base}/edges"), meta["exportedAt"])


def migrated(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of older documents (with ``schemaVersion``) in the current shape.

    Before version 3 a provenance FRONTIER meant an observed edge, whose id
    follows from its ends; before version 6 tables had no list of columns.
    Fields that were retired (version 2) are not read, and versions 4, 5 and 7
    only allowed more.
    """
    table = (F.col("type") == "InfraNode") & F.col("kind").isin("sql-table", "supabase-table")
    bare = (F.col("schemaVersion") < 6) & table & F.col("columns").isNull()
    nodes = nodes.withColumn("columns", F.when(bare, F.array().cast(nodes.schema["columns"].dataType)).otherwise(F.col("columns")))
    old = F.coalesce((F.col("schemaVersion") < 3) & (F.col("provenance") == "FRONTIER"), F.lit(False))
    whole = F.col("type").isNotNull() & F.col("source").isNotNull() & F.col("target").isNotNull()
    observed = F.concat("type", F.lit(":OBSERVED:"), "source", F.lit("->"), "target")
    return nodes, edges.withColumns({"id": F.when(old & whole, observed).otherwise(F.col("id")), "provenance": F.when(old, "OBSERVED").otherwise(F.col("provenance"))})


def _for_json(kind):
    """A schema as JSON can hold it: map keys are texts (``conform`` casts them back)."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _for_json(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_for_json(kind.elementType))
    return T.MapType(T.StringType(), _for_json(kind.valueType)) if isinstance(kind, T.MapType) else kind


DOCUMENT = "struct<schemaVersion:int,exportedAt:string,graph:struct<nodes:array<string>,edges:array<string>>>"


def read_snapshots(texts: DataFrame) -> Graph:
    """The graph of exported documents (value): {schemaVersion, exportedAt, graph: {nodes: [{key, attributes}], edges: [...]}}.

    Documents of any version are migrated; an unknown version is refused.
    """
    read = texts.select(F.from_json("value", DOCUMENT).alias("d")).select(F.coalesce("d.schemaVersion", F.lit(1)).alias("schemaVersion"), "d.exportedAt", "d.graph")
    about = read.agg(F.min("schemaVersion").alias("low"), F.max("schemaVersion").alias("high"), F.max("exportedAt").alias("at")).first()
    for version in (about["low"], about["high"]):
        if version is not None and not 1 <= version <= SNAPSHOT_VERSION:
            raise ValueError(f"unknown snapshot version {version}")

    def rows(kind: str, schema: T.StructType) -> DataFrame:
        each = read.select("schemaVersion", F.explode(f"graph.{kind}").alias("row"))
        parsed = F.from_json(F.coalesce(F.get_json_object("row", "$.attributes"), "row"), _for_json(schema))
        kept = T.StructType([*schema.fields, T.StructField("schemaVersion", T.IntegerType())])
        return conform(each.select(parsed.alias("r"), "schemaVersion").select("r.*", "schemaVersion"), kept)

    nodes, edges = migrated(rows("nodes", NODES), rows("edges", EDGES))
    return Graph(conform(nodes, NODES), conform(edges, EDGES), about["at"] or "1970-01-01 00:00:00")


def read_snapshot_json(spark: SparkSession, text: str) -> Graph:
    """The graph of one exported document."""
    return read_snapshots(spark.createDataFrame([(text,)], "value string"))


def load_diff_side(spark: SparkSession, where: str) -> Graph:
    """A snapshot to compare with: a document at an http(s) URL, or a saved graph's path."""
    if where.startswith(("http://", "https://")):
        with urlopen(where, timeout=30) as reply:  # noqa: S310
            return read_snapshot_json(spark, reply.read().decode())
    if where.endswith(".json"):
        return read_snapshots(spark.read.text(where, wholetext=True))
    return load_graph(spark, where)


def _append(rows: DataFrame, path: str) -> None:
    """Append with the time of the append and the row's number in it, which tell the order of arrival."""
    at = time.time_ns()
    rows.withColumns({"_at": F.lit(at).cast("long"), "_row": F.monotonically_increasing_id()}).write.mode("append").json(path)


def _in_order(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A ledger with ``ordinal``, which ascends by append, then row.

    Rows of a ledger that another writer made have no append; they come first, in the order that files are read.
    """
    kept = T.StructType([*schema.fields, T.StructField("_at", T.LongType()), T.StructField("_row", T.LongType())])
    order = F.struct(F.coalesce("_at", F.lit(0)).alias("at"), F.coalesce("_row", F.monotonically_increasing_id()).alias("row"))
    return spark.read.schema(kept).json(path).withColumn("ordinal", order).drop("_at", "_row")


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """The incident ledger with an ordinal in order of arrival: by append, then row."""
    return _in_order(spark, path, INCIDENTS)


def append_incidents(incidents: DataFrame, path: str) -> None:
    _append(conform(incidents, INCIDENTS), path)


def read_stale_events(spark: SparkSession, path: str) -> DataFrame:
    return _in_order(spark, path, STALE_EVENTS)


def append_stale_events(events: DataFrame, path: str) -> None:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    _append(conform(events.withColumns({"lastObserved": iso("lastObserved"), "transitionedAt": iso("transitionedAt")}), STALE_EVENTS), path)


def list_stale_events(events: DataFrame, edge_type: str | None = None, limit: int = 50) -> DataFrame:
    """The newest first."""
    if edge_type:
        events = events.filter(F.col("edgeType") == edge_type)
    return events.orderBy(F.desc("ordinal")).limit(limit)


def append_violations(found: DataFrame, spark: SparkSession, path: str) -> None:
    """Append violations whose id the log does not have."""
    from ..operators.policy import new_violations

    try:
        log = spark.read.schema("id string").json(path)
        log.limit(0).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = spark.createDataFrame([], "id string")
    new_violations(found, log).write.mode("append").json(path)


def keep_logs(logs: DataFrame, now, order: str = "ordinal", keep: int = LOG_KEEP, hours: int = LOG_HOURS) -> DataFrame:
    """The newest ``keep`` entries of each project and source, none older than ``hours``; unreadable times stay."""
    ts = F.col("timestamp").try_cast("timestamp")
    fresh = logs.filter(ts.isNull() | (F.unix_millis(now) - F.unix_millis(ts) <= hours * 3_600_000))
    newest = Window.partitionBy("projectName", "source").orderBy(F.desc(order))
    return fresh.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= keep).drop("_r")


def list_logs(logs: DataFrame, project: str | None = None, source: str | None = None, service: str | None = None, since: str | None = None, limit: int = LOG_LIMIT) -> DataFrame:
    """Newest first."""
    for name, value in (("projectName", project), ("source", source), ("serviceName", service)):
        if value is not None:
            logs = logs.filter(F.col(name) == value)
    if since is not None:
        logs = logs.filter(F.col("timestamp").try_cast("timestamp") >= F.lit(since).cast("timestamp"))
    return logs.orderBy(F.desc("timestamp"), "id").limit(min(limit, LOG_MAX))


def unrouted(spans: DataFrame, known: DataFrame) -> DataFrame:
    """Spans of services that match no project."""
    return spans.join(known.select("service").distinct(), "service", "left_anti")


def extraction_coverage(errors: DataFrame, files: int = 100) -> DataFrame:
    """(producer, n, files): errors by producer and their first files."""
    counts = errors.groupBy("producer").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("producer").orderBy("file")
    # Only the first files of each producer are gathered.
    named = errors.filter("file is not null").select("producer", "file").distinct().withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= files)
    named = named.groupBy("producer").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return counts.join(named, "producer", "left").select("producer", "n", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), ignored: tuple[str, ...] = ("node_modules", ".git", "dist", "build", ".next", "vendor", "target", "__pycache__", ".venv", "venv", "coverage")) -> DataFrame:
    """(path, content) of a source tree, paths relative to its root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    out = raw.select(relative.alias("path"), F.col("content").cast("string").alias("content"))
    out = out.filter(~F.col("path").rlike(r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in ignored) + r")/"))
    return out.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions)) if extensions else out


def owners_of(paths: DataFrame, codeowners: str, spark: SparkSession) -> DataFrame:
    """(path, owner) by the first matching rule of an ownership file."""
    rules = [(_glob(parts[0]), parts[1]) for line in codeowners.splitlines() if len(parts := line.split("#")[0].split()) >= 2]
    if not rules:
        return paths.select("path", F.lit(None).cast("string").alias("owner")).filter("false")
    # The first rule that matches, as one expression: no row meets more rules than it needs.
    owner = F.coalesce(*(F.when(F.col("path").rlike(pattern), F.lit(who)) for pattern, who in rules))
    return paths.select("path").distinct().withColumn("owner", owner).filter("owner is not null")


def _glob(pattern: str) -> str:
    import re

    anchored = pattern.startswith("/")
    body = pattern.strip("/")
    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|\?|[^*?]+", body))
    return ("^" if anchored else "(^|/)") + out + "(/|$)"


def instrumentation(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """packages (package, version) with the coverage of the first registry entry whose least version they reach.

    registry: (package, ordinal, fromVersion, coverage).
    """
    from ..functions import versions

    joined = packages.join(registry, "package").filter(F.col("fromVersion").isNull() | ~F.coalesce(versions.older(F.col("version"), F.col("fromVersion")), F.lit(False)))
    return joined.groupBy("package", "version").agg(F.min_by("coverage", "ordinal").alias("coverage"))

