"""One object with every query: what a server, a command line or an agent would call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ask, compat, divergence, incidents, lifecycle, policy, rootcause, search, traverse
from .operators.embeddings import EmbeddingCache
from .operators.graph import Graph
from .schema import INCIDENTS, empty
from .sources import tables


class NotFound(LookupError):
    """No such node, project or snapshot."""


class Engine:
    """Queries over the graphs of projects.

    Results are lazy DataFrames, except where one object is the answer
    (``root_cause``, ``ask``).
    """

    def __init__(self, spark: SparkSession, graphs: dict[str, Graph], incidents_table: DataFrame | None = None, policies: list[policy.Policy] | None = None, matrix: compat.Matrix | None = None) -> None:
        self.spark, self.graphs, self.policies = spark, graphs, policies or []
        self.incidents = incidents_table if incidents_table is not None else empty(spark, INCIDENTS).withColumn("ordinal", F.monotonically_increasing_id())
        self.matrix = matrix or compat.Matrix(spark)

    def graph(self, project: str = "default") -> Graph:
        if project not in self.graphs:
            raise NotFound(f"no project {project}")
        return self.graphs[project]

    def _existing(self, g: Graph, node: str) -> str:
        if not g.nodes.filter(F.col("id") == node).limit(1).count():
            raise NotFound(f"node not found: {node}")
        return node

    def nodes(self, project: str = "default") -> DataFrame:
        return self.graph(project).nodes

    def edges(self, project: str = "default") -> DataFrame:
        return self.graph(project).edges

    def node(self, node: str, project: str = "default") -> DataFrame:
        g = self.graph(project)
        return g.nodes.filter(F.col("id") == self._existing(g, node))

    def node_edges(self, node: str, project: str = "default") -> DataFrame:
        g = self.graph(project)
        self._existing(g, node)
        return g.edges.filter((F.col("source") == node) | (F.col("target") == node))

    def blast_radius(self, node: str, depth: int = 10, project: str = "default") -> DataFrame:
        return traverse.blast_radius(self.graph(project), [node], depth)

    def dependencies(self, node: str, depth: int = 3, project: str = "default") -> DataFrame:
        return traverse.transitive_dependencies(self.graph(project), [node], depth)

    def observed_dependencies(self, node: str, project: str = "default") -> tuple[DataFrame, DataFrame]:
        return traverse.observed_dependencies(self.graph(project), [node])

    def root_cause(self, node: str, project: str = "default", navigate: bool = True) -> dict | None:
        g = self.graph(project)
        return rootcause.root_cause(g, self._existing(g, node), self.incidents, self.matrix, navigate)

    def expand(self, node: str, direction: str = "up", project: str = "default") -> DataFrame:
        if direction not in ("up", "down"):
            raise ValueError("direction is up or down")
        return traverse.expand(self.graph(project), [node], direction, self.incidents)

    def relate(self, a: str, b: str, depth: int = 5, project: str = "default") -> DataFrame:
        return traverse.relate(self.graph(project), [(a, b)], depth)

    def divergences(self, types: set[str] | None = None, min_confidence: float | None = None, node: str | None = None, project: str = "default") -> DataFrame:
        return divergence.divergences(self.graph(project), self.matrix, types, min_confidence, node)

    def violations(self, severity: str | None = None, policy_id: str | None = None, project: str = "default") -> DataFrame:
        return policy.select_violations(policy.evaluate(self.graph(project), self.policies), severity, policy_id)

    def applicable_policies(self, node: str, project: str = "default") -> DataFrame:
        return policy.applicable(self.graph(project), self.policies).filter(F.col("node") == node)

    def check_policies(self, action: dict | None = None, project: str = "default") -> DataFrame:
        return policy.check(self.graph(project), self.policies, action)

    def incident_list(self, limit: int = incidents.DEFAULT_LIMIT) -> DataFrame:
        return incidents.listing(self.incidents, limit)

    def incident_history(self, node: str, limit: int = 20) -> DataFrame:
        return incidents.history(self.incidents, node, limit)

    def stale_events(self, path: str, edge_type: str | None = None, limit: int = 50) -> DataFrame:
        return tables.list_stale_events(tables.read_stale_events(self.spark, path), edge_type, limit)

    def logs(self, logs: DataFrame, **filters) -> DataFrame:
        return tables.list_logs(logs, **filters)

    def search(self, query: str, limit: int | None = 10, project: str = "default", vectors: EmbeddingCache | None = None) -> DataFrame:
        """By substring, or, given a refreshed cache of embeddings, the nearest nodes by cosine."""
        nodes = self.graph(project).nodes
        if vectors is None:
            return search.substring_search(nodes, query, limit)
        asked = self.spark.createDataFrame([(0, query)], "q int, question string")
        near = vectors.search(asked, limit or 10)
        return near.join(nodes.select("id", "type", "name"), "id").select("id", "type", "name", "score").orderBy(F.desc("score"), "id")

    def ask(self, question: str, project: str = "default") -> dict:
        return ask.ask(self.graph(project), question, self.incidents)

    def diff(self, against: str | Graph, project: str = "default") -> DataFrame:
        base = against if isinstance(against, Graph) else tables.load_diff_side(self.spark, against)
        return lifecycle.graph_diff(base, self.graph(project))

    def summary(self, project: str = "default") -> dict[str, DataFrame]:
        g = self.graph(project)
        return {"shape": ask.shape(g), "unobserved": ask.unobserved(g), "divergences": divergence.divergences(g, self.matrix).limit(3)}

    def merge(self, nodes: DataFrame, edges: DataFrame, project: str = "default") -> Graph:
        self.graphs[project] = lifecycle.merge_snapshot(self.graph(project), nodes, edges)
        return self.graphs[project]
