"""Policies: rules over nodes and edges, each one a filter, an anti join or a traversal.

A violation is (id, policyId, severity, onViolation, subject, message, nodeId,
edgeId); the id is ``<policy>:<suffix>``, so it is stable between runs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import compat
from .graph import Graph
from .traverse import breadth_first, reached

#: Action when a policy names none.
DEFAULT_ACTION = {"info": "log", "warning": "alert", "error": "alert", "critical": "block"}


@dataclass(frozen=True)
class Policy:
    id: str
    name: str
    severity: str
    rule: dict = field(hash=False)
    on_violation: str | None = None

    @property
    def action(self) -> str:
        return self.on_violation or DEFAULT_ACTION[self.severity]


def load(text: str) -> list[Policy]:
    """Policies of a document {version: 1, policies: [...]}; ids must be unique."""
    document = json.loads(text)
    if document.get("version") != 1:
        raise ValueError("unknown policy version")
    out = [Policy(p["id"], p.get("name", p["id"]), p["severity"], p["rule"], p.get("onViolation")) for p in document["policies"]]
    if len({p.id for p in out}) != len(out):
        raise ValueError("policy ids must be unique")
    return out


def _made(df: DataFrame, policy: Policy, suffix: Column, message: Column, node: Column | None = None, edge: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.concat(F.lit(policy.id + ":"), suffix).alias("id"),
        F.lit(policy.id).alias("policyId"),
        F.lit(policy.rule["type"]).alias("ruleType"),
        F.lit(policy.severity).alias("severity"),
        F.lit(policy.action).alias("onViolation"),
        message.alias("message"),
        (none if node is None else node).alias("nodeId"),
        (none if edge is None else edge).alias("edgeId"),
    )


def structural(graph: Graph, policy: Policy) -> DataFrame:
    """Nodes of one type without an edge of a type to a node of another."""
    r = policy.rule
    targets = graph.nodes.filter((F.col("type") == r["toNodeType"]) & (F.col("type") != "FrontierNode")).select(F.col("id").alias("target"))
    linked = graph.valid_edges().filter(F.col("type") == r["edgeType"]).join(targets, "target", "left_semi").select(F.col("source").alias("id"))
    bad = graph.nodes.filter(F.col("type") == r["fromNodeType"]).join(linked, "id", "left_anti")
    return _made(bad, policy, F.col("id"), F.concat(F.lit(f"{r['fromNodeType']} "), "id", F.lit(f" lacks {r['edgeType']} to a {r['toNodeType']}")), node=F.col("id"))


def ownership(graph: Graph, policy: Policy) -> DataFrame:
    """Nodes of a type whose field is missing, empty or no text."""
    r = policy.rule
    name = r.get("field", "owner")
    kind = dict(graph.nodes.dtypes).get(name)
    value = F.col(name) if kind == "string" else F.lit(None).cast("string")
    bad = graph.nodes.filter((F.col("type") == r["nodeType"]) & (value.isNull() | (value == "")))
    return _made(bad, policy, F.col("id"), F.concat(F.lit(f"{r['nodeType']} "), "id", F.lit(f" has no {name}")), node=F.col("id"))


def provenance(graph: Graph, policy: Policy) -> DataFrame:
    """Edges of a type (to a target) whose provenance is not among the required."""
    r = policy.rule
    required = [r["required"]] if isinstance(r["required"], str) else list(r["required"])
    bad = graph.valid_edges().filter((F.col("type") == r["edgeType"]) & ~F.col("provenance").isin(*required))
    if r.get("targetNodeId"):
        bad = bad.filter(F.col("target") == r["targetNodeId"])
    return _made(bad, policy, F.col("id"), F.concat("id", F.lit(" is "), "provenance", F.lit(f"; required {' | '.join(sorted(required))}")), edge=F.col("id"))


def blast_radius(graph: Graph, policy: Policy) -> DataFrame:
    """Nodes of a type on which too many others depend: one traversal for all of them."""
    r = policy.rule
    roots = graph.nodes.filter(F.col("type") == r["nodeType"]).select(F.col("id").alias("root"))
    counts = breadth_first(graph, roots, "up", r.get("depth") or 10).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    bad = counts.filter(F.col("n") > r["maxAffected"])
    return _made(bad, policy, F.col("root"), F.concat(F.col("root"), F.lit(" affects "), F.col("n").cast("string"), F.lit(f" > {r['maxAffected']}")), node=F.col("root"))


def compatibility(graph: Graph, policy: Policy, matrix: compat.Matrix | None = None) -> DataFrame:
    """Dependencies that do not fit a database, the runtime or each other, or should be replaced."""
    matrix = matrix or compat.Matrix(graph.spark)
    wanted = policy.rule.get("kind")
    at = lambda kind, *rest: F.concat("service", F.lit(f":{kind}:"), *rest)
    out = []
    if wanted in (None, "driver-engine"):
        bad = compat.driver_engine(graph, matrix, graph.valid_edges())
        out.append(_made(bad, policy, at("driver-engine", "driver", F.lit("@"), "declared", F.lit(":"), "engine", F.lit("@"), "engineVersion"), F.concat("driver", F.lit(" below "), "minDriver"), node=F.col("service"), edge=F.col("edgeId")))
    if wanted in (None, "node-engine"):
        bad = compat.node_engine(graph, matrix)
        out.append(_made(bad, policy, at("node-engine", "package", F.lit("@"), "declared"), F.concat("package", F.lit(" needs runtime "), "minNode"), node=F.col("service")))
    if wanted in (None, "package-conflict"):
        bad = compat.package_conflict(graph, matrix)
        out.append(_made(bad, policy, at("package-conflict", "package", F.lit("@"), "declared"), F.concat("package", F.lit(" needs "), "requires", F.lit(" "), "minRequired"), node=F.col("service")))
    if wanted in (None, "deprecated-api"):
        bad = compat.deprecated_api(graph, matrix)
        out.append(_made(bad, policy, at("deprecated-api", "package", F.lit("@"), "declared"), F.concat("package", F.lit(" should be replaced")), node=F.col("service")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def field_guard(graph: Graph, policy: Policy) -> DataFrame:
    """Fields that clients write but the guard set lacks; nodes without a guard set are silent."""
    r = policy.rule
    nodes = graph.nodes.filter(F.col("type") == r["nodeType"])
    if r.get("nodeKind"):
        nodes = nodes.filter(F.col("kind") == r["nodeKind"])
    written = F.transform(F.filter("columns", lambda c: F.array_contains(c["sdkWrites"], "client")), lambda c: c["name"])
    guard = F.col(r.get("guardSet", "guardedFields"))
    bad = nodes.filter(guard.isNotNull()).select("id", F.explode(F.array_except(written, guard)).alias("f"))
    return _made(bad, policy, F.concat("id", F.lit(":"), "f"), F.concat("id", F.lit(" takes unguarded field "), "f"), node=F.col("id"))


EVALUATORS = {"structural": structural, "ownership": ownership, "provenance": provenance, "blast-radius": blast_radius, "compatibility": compatibility, "field-guard": field_guard}


def evaluate(graph: Graph, policies: list[Policy]) -> DataFrame:
    """Violations of all policies, one row for each id."""
    out = None
    for p in policies:
        found = EVALUATORS[p.rule["type"]](graph, p)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return graph.spark.createDataFrame([], "id string, policyId string, ruleType string, severity string, onViolation string, message string, nodeId string, edgeId string")
    return out.dropDuplicates(["id"])


def new_violations(found: DataFrame, log: DataFrame) -> DataFrame:
    """Violations that the log does not have yet."""
    return found.join(log.select("id").distinct(), "id", "left_anti")


def select_violations(found: DataFrame, severity: str | None = None, policy_id: str | None = None) -> DataFrame:
    if severity:
        found = found.filter(F.col("severity") == severity)
    return found.filter(F.col("policyId") == policy_id) if policy_id else found


def can_promote(found: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Frontiers (id) that no blocking violation names; the path of a violation is its node alone."""
    blocked = found.filter("onViolation = 'block'").select(F.col("nodeId").alias("id")).filter("id is not null").distinct()
    return frontiers.join(blocked, "id", "left_anti")


def check(graph: Graph, policies: list[Policy], action: dict | None = None) -> DataFrame:
    """(allowed, violations, blocking, hypothetical): allowed unless a violation blocks.  The action is echoed, not applied."""
    found = evaluate(graph, policies)
    out = found.agg(F.count(F.lit(1)).alias("violations"), F.coalesce(F.sum(F.when(F.col("onViolation") == "block", 1).otherwise(0)), F.lit(0)).cast("long").alias("blocking"))
    return out.select((F.col("blocking") == 0).alias("allowed"), "violations", "blocking", F.lit(json.dumps(action, sort_keys=True) if action else None).cast("string").alias("hypothetical"))


def applicable(graph: Graph, policies: list[Policy]) -> DataFrame:
    """(node, policyId, role): which policies say something about which nodes.

    role is "subject" for nodes a rule judges and "region" for nodes that the
    rule's edges reach; for a blast-radius rule these are the dependents of its
    subjects, to the rule's depth.
    """
    out = graph.nodes.select(F.col("id").alias("node"), F.lit("").alias("policyId"), F.lit("").alias("role")).filter("false")
    for p in policies:
        r, kind = p.rule, p.rule["type"]
        subject = {"structural": r.get("fromNodeType"), "ownership": r.get("nodeType"), "blast-radius": r.get("nodeType"), "compatibility": "ServiceNode", "field-guard": r.get("nodeType")}.get(kind)
        if subject:
            nodes = graph.nodes.filter(F.col("type") == subject)
            if kind == "field-guard" and r.get("nodeKind"):
                nodes = nodes.filter(F.col("kind") == r["nodeKind"])
            out = out.union(nodes.select("id", F.lit(p.id), F.lit("subject")))
        if kind == "blast-radius":
            reach = reached(graph, graph.nodes.filter(F.col("type") == subject).select("id"), "up", r.get("depth") or 10)
            others = reach.join(graph.nodes.filter(F.col("type") != subject).select("id"), "id", "left_semi")
            out = out.union(others.select("id", F.lit(p.id), F.lit("region")))
        if kind == "structural":
            out = out.union(graph.nodes.filter(F.col("type") == r["toNodeType"]).select("id", F.lit(p.id), F.lit("region")))
        if kind == "provenance":
            edges = graph.valid_edges().filter(F.col("type") == r["edgeType"])
            if r.get("targetNodeId"):
                edges = edges.filter(F.col("target") == r["targetNodeId"])
            out = out.union(edges.select("source", F.lit(p.id), F.lit("subject"))).union(edges.select("target", F.lit(p.id), F.lit("region")))
    return out.distinct()
