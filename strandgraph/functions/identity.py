"""Identifiers of nodes and edges as column expressions.

The grammar is the join-key contract of the whole engine: an id says what an
entity is, so two sides that never met agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far a provenance can be trusted; higher wins.
RANK = {"OBSERVED": 3, "INFERRED": 2, "EXTRACTED": 1, "STALE": 0}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def service_id(name, env=None) -> Column:
    """service:<name>, or with an environment that is known."""
    base = F.concat(F.lit("service:"), col(name))
    if env is None:
        return base
    e = col(env)
    return F.when(e.isNull() | e.isin("", "unknown"), base).otherwise(F.concat(base, F.lit(":"), e))


def service_name(node_id) -> Column:
    """Name part, up to the first colon behind the prefix."""
    return F.regexp_extract(col(node_id), r"^service:([^:]*)", 1)


def service_env(node_id) -> Column:
    return F.nullif(F.regexp_extract(col(node_id), r"^service:[^:]*:(.*)$", 1), F.lit(""))


def database_id(host, service=None, name=None) -> Column:
    """database:<host>, or database:<service>/<name> for a local one."""
    if service is None:
        return F.concat(F.lit("database:"), col(host))
    return F.concat(F.lit("database:"), col(service), F.lit("/"), col(name))


def config_id(path) -> Column:
    return F.concat(F.lit("config:"), col(path))


def infra_id(kind, name) -> Column:
    return F.concat(F.lit("infra:"), col(kind), F.lit(":"), col(name))


def frontier_id(host) -> Column:
    return F.concat(F.lit("frontier:"), col(host))


def file_id(service, path) -> Column:
    return F.concat(F.lit("file:"), col(service), F.lit(":"), col(path))


def file_service(node_id) -> Column:
    return F.nullif(F.regexp_extract(col(node_id), r"^file:([^:]+):", 1), F.lit(""))


def file_path(node_id) -> Column:
    return F.nullif(F.regexp_extract(col(node_id), r"^file:[^:]+:(.+)$", 1), F.lit(""))


def route_id(service, method, template) -> Column:
    return F.concat(F.lit("route:"), col(service), F.lit(":"), F.upper(col(method)), F.lit(" "), col(template))


def graphql_id(service, kind, name) -> Column:
    return F.concat(F.lit("graphql:"), col(service), F.lit(":"), F.lower(col(kind)), F.lit(" "), col(name))


def grpc_id(service, method) -> Column:
    return F.concat(F.lit("grpc:"), col(service), F.lit("/"), col(method))


def websocket_id(service, channel) -> Column:
    return F.concat(F.lit("ws:"), col(service), F.lit(":"), col(channel))


def symbol_id(service, path, qualname, ordinal=None) -> Column:
    base = F.concat(F.lit("symbol:"), col(service), F.lit(":"), col(path), F.lit("#"), col(qualname))
    return base if ordinal is None else F.when(col(ordinal).isNull(), base).otherwise(F.concat(base, F.lit("~"), col(ordinal).cast("string")))


def symbol_file(node_id) -> Column:
    """The id of the file that a symbol's id lies in (split at the last #), or null."""
    return F.when(col(node_id).startswith("symbol:"), F.concat(F.lit("file:"), F.regexp_extract(col(node_id), r"^symbol:(.+)#[^#]*$", 1)))


def action_id(service, module, export) -> Column:
    return F.concat(F.lit("action:"), col(service), F.lit(":"), col(module), F.lit("#"), col(export))


def edge_id(kind, source, target, provenance="EXTRACTED") -> Column:
    """<TYPE>:<source>-><target>; observed and inferred edges carry their provenance."""
    kind = F.lit(kind) if isinstance(kind, str) and kind.isupper() else col(kind)
    mark = "" if provenance == "EXTRACTED" else f"{provenance}:"
    return F.concat(kind, F.lit(":" + mark), col(source), F.lit("->"), col(target))


def parse_edge_id(edge) -> Column:
    """struct<type, provenance, source, target>; the last arrow splits, as in sources that contain one."""
    e = col(edge)
    kind = F.substring_index(e, ":", 1)
    rest = F.substring(e, F.length(kind) + 2, F.length(e))
    mark = F.regexp_extract(rest, r"^(OBSERVED|INFERRED):", 1)
    body = F.when(mark != "", F.substring(rest, F.length(mark) + 2, F.length(rest))).otherwise(rest)
    target = F.substring_index(body, "->", -1)
    source = F.substring(body, F.lit(1), F.length(body) - F.length(target) - 2)
    return F.struct(kind.alias("type"), F.when(mark != "", mark).otherwise("EXTRACTED").alias("provenance"), source.alias("source"), target.alias("target"))


def id_provenance(edge) -> Column:
    """The slot an edge fills: the provenance in its id, which a stale edge keeps."""
    mark = F.regexp_extract(col(edge), r"^[A-Z_]+:(OBSERVED|INFERRED):", 1)
    return F.when(mark != "", mark).otherwise("EXTRACTED")


def rank(provenance) -> Column:
    out = None
    for name, value in RANK.items():
        out = (F.when if out is None else out.when)(col(provenance) == name, value)
    return out.otherwise(0)
