"""The property graph: node and edge tables and the views that all queries share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions import weights


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """What is written within leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the plan of an iteration: Parquet in the shared folder where the cluster names one, else the cache (recomputed if lost).

    Later steps read only the columns they ask for, and the size of what was
    written tells Spark which side of a join is small.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        path = f"{folder}/cut-{uuid.uuid4().hex}"
        with tidy(spark):
            df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def whole(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that grows with the graph: dealt by key, never sent through the driver.

    Compressed files look small to Spark, the fewer columns are read the more
    so, and what looks small is broadcast.
    """
    return df.hint("merge")


#: Rows of ids that a driver takes at once.
FEW = 200_000


def side(cut: DataFrame) -> DataFrame:
    """A cut frame as the smaller side of a join: up to ``FEW`` rows are sent to all tasks, more are dealt by key."""
    return F.broadcast(cut) if cut.count() <= FEW else whole(cut)


@dataclass(frozen=True)
class Graph:
    """nodes and edges, at a time: ages are measured against ``now``."""

    nodes: DataFrame
    edges: DataFrame
    now: str = "2001-11-04 00:00:00"

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def now_column(self) -> Column:
        return F.lit(self.now).cast("timestamp")

    def valid_edges(self) -> DataFrame:
        """No self-loops; one row for each id."""
        return self.edges.filter("source <> target")

    def with_confidence(self) -> DataFrame:
        """edges with ``weight``, the confidence a path multiplies."""
        return self.valid_edges().withColumn("weight", weights.edge_confidence(self.now_column()))

    def best_edges(self, direction: str, of: DataFrame | None = None) -> DataFrame:
        """(near, far, edge): the best edge to each neighbour, of the nodes (near) of ``of`` only if it is given.

        direction "up" follows edges backwards (far is the source), "down"
        forwards.  Neighbours of type FrontierNode are dropped before ranking.
        Ties go to the smaller edge id.  One partial aggregation, no sort.
        """
        near, far = ("target", "source") if direction == "up" else ("source", "target")
        frontier = self.nodes.filter("type = 'FrontierNode'").select(F.col("id").alias(far))
        edges = self.with_confidence()
        if of is not None:
            edges = edges.join(side(of.select(F.col("near").alias(near))), near, "left_semi")
        edges = edges.join(frontier, far, "left_anti")
        edge = F.struct((-ids.rank("provenance")).alias("order"), "id", "type", "provenance", "weight", "callCount", F.col("signal.spanCount").alias("spanCount"), F.col("signal.errorCount").alias("errorCount"), F.col("signal.latencyMs.p95").alias("p95"), F.coalesce(F.col("signal.anomalous"), F.lit(False)).alias("anomalous"))
        return edges.groupBy(F.col(near).alias("near"), F.col(far).alias("far")).agg(F.min(edge).alias("edge"))

    def links(self, direction: str) -> DataFrame:
        """(near, far) of all edges that ``best_edges`` ranks, as often as there are such."""
        near, far = ("target", "source") if direction == "up" else ("source", "target")
        frontier = self.nodes.filter("type = 'FrontierNode'").select(F.col("id").alias(far))
        return self.valid_edges().join(frontier, far, "left_anti").select(F.col(near).alias("near"), F.col(far).alias("far"))

    def scope(self, nodes: DataFrame | None = None) -> DataFrame:
        """(node, member): each node itself and, for services, the files it contains."""
        own = (self.nodes if nodes is None else self.nodes.join(side(nodes), "id", "left_semi")).select(F.col("id").alias("node"), "type")
        contains = self.valid_edges().filter("type = 'CONTAINS'").select(F.col("source").alias("node"), F.col("target").alias("member"))
        files = self.nodes.filter("type = 'FileNode'").select(F.col("id").alias("member"))
        inside = whole(own.filter("type = 'ServiceNode'")).join(contains, "node").join(whole(files), "member", "left_semi").select("node", "member")
        return own.select("node", F.col("node").alias("member")).union(inside).distinct()

    def call_sources(self) -> DataFrame:
        """(service, member): a service, its files and their symbols, from which it calls."""
        contains = self.valid_edges().filter("type = 'CONTAINS'").select("source", "target")
        kind = self.nodes.select(F.col("id").alias("target"), "type")
        services = self.nodes.filter("type = 'ServiceNode'").select(F.col("id").alias("service"))
        files = whole(services).join(contains, F.col("service") == F.col("source")).join(whole(kind.filter("type = 'FileNode'").select("target")), "target").select("service", F.col("target").alias("member"))
        symbols = whole(files).join(contains, F.col("member") == F.col("source")).join(whole(kind.filter("type = 'SymbolNode'").select("target")), "target").select("service", F.col("target").alias("member"))
        return services.select("service", F.col("service").alias("member")).union(files).union(symbols).distinct()

    def owners(self) -> DataFrame:
        """(node, owner): the service that a node is or lies in, through files to symbols; the smaller id of several."""
        contains = self.valid_edges().filter("type = 'CONTAINS'").select(F.col("source").alias("parent"), F.col("target").alias("node"))
        services = self.nodes.filter("type = 'ServiceNode'").select(F.col("id").alias("node"), F.col("id").alias("owner"))
        first = contains.join(whole(services.withColumnRenamed("node", "parent")), "parent").select("node", "owner")
        second = contains.join(whole(first.withColumnRenamed("node", "parent")), "parent").select("node", "owner")
        ranked = services.select("node", F.struct(F.lit(0).alias("far"), "owner").alias("o"))
        ranked = ranked.union(first.select("node", F.struct(F.lit(1).alias("far"), "owner").alias("o"))).union(second.select("node", F.struct(F.lit(2).alias("far"), "owner").alias("o")))
        return ranked.groupBy("node").agg(F.min("o").alias("o")).select("node", F.col("o.owner").alias("owner"))
