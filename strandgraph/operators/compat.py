"""Compatibility rules as small dimension tables, and the joins that apply them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import versions
from .graph import Graph, whole

# Verdicts depend on these versions.
PAIRS = [
    # driver, engine, least driver version, from engine version
    ("pg", "postgresql", "8.0.0", "14"),
    ("mysql2", "mysql", "3.0.0", "8"),
    ("mongoose", "mongodb", "7.0.0", "7"),
    ("psycopg2", "postgresql", "2.9.0", "14"),
    ("pymongo", "mongodb", "4.0.0", "7"),
    ("mysql-connector-python", "mysql", "8.0.0", "8"),
]
NODE_ENGINES = [
    # package, from version, least runtime version
    ("vitest", "2.0.0", "18.0.0"),
    ("next", "14.0.0", "18.17.0"),
    ("@modelcontextprotocol/sdk", "1.0.0", "18.0.0"),
]
CONFLICTS = [
    # package, from version, required package, least version of it
    ("@tanstack/react-query", "5.0.0", "react", "18.0.0"),
    ("react-router-dom", "7.0.0", "react", "18.0.0"),
    ("next", "14.0.0", "react", "18.2.0"),
]
DEPRECATED = [
    # package, up to version (none: every version)
    ("request", "2.88.2"),
    ("node-uuid", None),
]


class Matrix:
    """The four rule tables.  They are rules, not data: a few rows, so joins broadcast them."""

    def __init__(self, spark: SparkSession, pairs=PAIRS, node_engines=NODE_ENGINES, conflicts=CONFLICTS, deprecated=DEPRECATED) -> None:
        self.pairs = spark.createDataFrame(pairs, "driver string, engine string, minDriver string, minEngine string")
        self.node_engines = spark.createDataFrame(node_engines, "package string, fromVersion string, minNode string")
        self.conflicts = spark.createDataFrame(conflicts, "package string, fromVersion string, requires string, minRequired string")
        self.deprecated = spark.createDataFrame(deprecated, "package string, maxVersion string")

    @classmethod
    def with_remote(cls, spark: SparkSession, text: str) -> Matrix:
        """The bundled rules and those of a JSON document of the same shape."""
        more = json.loads(text)
        return cls(
            spark,
            PAIRS + [(p["driver"], p["engine"], p["minDriverVersion"], p.get("minEngineVersion")) for p in more.get("pairs", [])],
            NODE_ENGINES + [(p["package"], p.get("packageMinVersion"), p["minNodeVersion"]) for p in more.get("nodeEngineConstraints", [])],
            CONFLICTS + [(p["package"], p.get("packageMinVersion"), p["requires"]["name"], p["requires"]["minVersion"]) for p in more.get("packageConflicts", [])],
            DEPRECATED + [(p["package"], p.get("packageMaxVersion")) for p in more.get("deprecatedApis", [])],
        )


def dependencies(nodes: DataFrame) -> DataFrame:
    """(service, package, version) of declared dependencies."""
    return nodes.filter("type = 'ServiceNode' and dependencies is not null").select(F.col("id").alias("service"), F.explode("dependencies").alias("package", "version")).filter("version is not null and version <> ''")


def driver_engine(graph: Graph, matrix: Matrix, edges: DataFrame) -> DataFrame:
    """(service, target, edgeId, driver, declared, engine, engineVersion, minDriver): drivers too old for the database behind an edge."""
    databases = graph.nodes.filter("type = 'DatabaseNode'").select(F.col("id").alias("target"), "engine", "engineVersion")
    linked = edges.filter("type = 'CONNECTS_TO'").select(F.col("id").alias("edgeId"), F.col("source").alias("service"), "target").join(databases, "target")
    declared = dependencies(graph.nodes).withColumnsRenamed({"package": "driver", "version": "declared"})
    pairs = F.broadcast(matrix.pairs)
    joined = declared.join(pairs, "driver").join(linked, ["service", "engine"])
    old_engine = F.col("minEngine").isNotNull() & ~F.coalesce(versions.coerce(F.col("engineVersion"))[0] >= versions.coerce(F.col("minEngine"))[0], F.lit(False))
    return joined.filter(~old_engine & versions.older(F.col("declared"), F.col("minDriver"))).select("service", "target", "edgeId", "driver", "declared", "engine", "engineVersion", "minDriver")


def node_engine(graph: Graph, matrix: Matrix) -> DataFrame:
    """(service, package, declared, nodeEngine, minNode): packages that need a newer runtime than declared."""
    declared = dependencies(graph.nodes).withColumnRenamed("version", "declared")
    engines = graph.nodes.filter("type = 'ServiceNode' and nodeEngine is not null and nodeEngine <> ''").select(F.col("id").alias("service"), "nodeEngine")
    joined = declared.join(F.broadcast(matrix.node_engines), "package").join(whole(engines), "service")
    early = F.coalesce(F.col("fromVersion").isNotNull() & versions.older(F.col("declared"), F.col("fromVersion")), F.lit(False))
    return joined.filter(~early & ~versions.admits_only_from(F.col("nodeEngine"), F.col("minNode"))).select("service", "package", "declared", "nodeEngine", "minNode")


def package_conflict(graph: Graph, matrix: Matrix) -> DataFrame:
    """(service, package, declared, requires, minRequired, found): packages whose companion is missing or too old."""
    declared = dependencies(graph.nodes).withColumnRenamed("version", "declared")
    other = declared.withColumnsRenamed({"package": "requires", "declared": "found"})
    joined = declared.join(F.broadcast(matrix.conflicts), "package").join(whole(other), ["service", "requires"], "left")
    early = F.coalesce(F.col("fromVersion").isNotNull() & versions.older(F.col("declared"), F.col("fromVersion")), F.lit(False))
    bad = F.col("found").isNull() | F.coalesce(versions.older(F.col("found"), F.col("minRequired")), F.lit(False))
    return joined.filter(~early & bad).select("service", "package", "declared", "requires", "minRequired", "found")


def deprecated_api(graph: Graph, matrix: Matrix) -> DataFrame:
    """(service, package, declared): packages that should be replaced."""
    declared = dependencies(graph.nodes).withColumnRenamed("version", "declared")
    joined = declared.join(F.broadcast(matrix.deprecated), "package")
    newer = F.coalesce(F.col("maxVersion").isNotNull() & versions.older(F.col("maxVersion"), F.col("declared")), F.lit(False))
    return joined.filter(~newer).select("service", "package", "declared")
