"""Predicates and picks over spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.incidents import attribute, grpc_status, http_status
from . import identity as ids
from . import text

STREAM_AFTER_NS = 60_000_000_000


def env_of(span: Column, resource: Column) -> Column:
    """Environment: the span's attributes before the resource's, the new name before the old; else unknown."""
    names = ("deployment.environment.name", "deployment.environment")
    return F.coalesce(attribute(span, *names), attribute(resource, *names), F.lit("unknown"))


def db_system(attributes: Column) -> Column:
    raw = attribute(attributes, "db.system", "db.system.name")
    return F.when(raw == "mongoose", "mongodb").otherwise(raw)


def db_table(attributes: Column) -> Column:
    system = db_system(attributes)
    statement = attribute(attributes, "db.statement", "db.query.text")
    return F.coalesce(attribute(attributes, "db.sql.table"), F.when(F.coalesce(system, F.lit("")) != "mongodb", attribute(attributes, "db.collection.name")), text.sql_table(statement))


def is_error(status: Column, attributes: Column) -> Column:
    """A failed span: status 2, a gRPC status other than 0, or HTTP 500 and above (400s are the caller's)."""
    return F.coalesce(status == 2, F.lit(False)) | F.coalesce(grpc_status(attributes) != 0, F.lit(False)) | F.coalesce(http_status(attributes) >= 500, F.lit(False))


def is_stream(duration: Column, attributes: Column, websocket: Column) -> Column:
    """A connection that stays open, whose duration is no latency."""
    kind = attribute(attributes, "http.response.header.content-type", "http.response.content_type")
    return websocket.isNotNull() | F.coalesce(F.contains(F.lower(kind), F.lit("text/event-stream")), F.lit(False)) | F.coalesce(duration > STREAM_AFTER_NS, F.lit(False))


def latency_ms(duration: Column, stream: Column) -> Column:
    return F.when((duration > 0) & ~stream, duration / 1e6)


def peer(attributes: Column) -> Column:
    return F.coalesce(attribute(attributes, "server.address", "net.peer.name", "net.host.name"), text.url_host(attribute(attributes, "url.full", "http.url")))


def is_loopback(host: Column) -> Column:
    return F.lower(host).rlike(r"^(localhost|ip6-localhost|\[?::1\]?|127(\.\d{1,3}){3})$")


def calls_out(kind: Column) -> Column:
    """Whether a span's side makes the call: kinds internal (0), client (3), producer (4), or none given."""
    return kind.isNull() | kind.isin(0, 3, 4)


def moves_messages(kind: Column) -> Column:
    return F.coalesce(kind.isin(4, 5), F.lit(False))


def serves(kind: Column) -> Column:
    return kind.isNull() | ~kind.isin(3, 4, 5)


def code_path(attributes: Column) -> Column:
    return attribute(attributes, "code.file.path", "code.filepath")


def code_line(attributes: Column) -> Column:
    return attribute(attributes, "code.line.number", "code.lineno").try_cast("int")


def code_function(attributes: Column) -> Column:
    return attribute(attributes, "code.function.name", "code.function")


def relative_path(path: Column, root: Column, repo_path: Column) -> Column:
    """A runtime path from the repository's root: below a known root, else below the last part that the repository is named by, else without drive and leading slash."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^file://", "")
    base = F.substring_index(repo_path, "/", -1)
    marked = lambda m: F.concat(F.lit("/"), m, F.lit("/"))
    return (
        F.when(root.isNotNull() & p.startswith(F.concat(root, F.lit("/"))), F.substring(p, F.length(root) + 2, F.length(p)))
        .when(repo_path.isNotNull() & F.contains(p, marked(repo_path)), _after_last(p, marked(repo_path)))
        .when(base.isNotNull() & F.contains(p, marked(base)), _after_last(p, marked(base)))
        .otherwise(F.regexp_replace(p, r"^(?:[A-Za-z]:)?/+", ""))
    )


def _after_last(x: Column, mark: Column) -> Column:
    return F.element_at(F.split(x, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E"))), -1)


# Languages of file extensions.
LANGUAGES = {
    "py": "python", "go": "go", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "rb": "ruby", "php": "php", "cs": "csharp", "java": "java", "kt": "kotlin", "kts": "kotlin", "rs": "rust", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp",
}


def language(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for k, v in LANGUAGES.items():
        out = (F.when if out is None else out.when)(extension == k, v)
    return out


def source_node(service: Column, env: Column, attributes: Column) -> Column:
    """The caller: the file of the call site if the span tells it, else the service."""
    path = F.regexp_replace(F.replace(code_path(attributes), F.lit("\\"), F.lit("/")), r"^(?:[A-Za-z]:)?/+", "")
    return F.when(path.isNotNull() & (path != ""), ids.file_id(service, path)).otherwise(ids.service_id(service, env))
