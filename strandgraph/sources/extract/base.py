"""What a producer yields, and helpers to read texts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from ...functions.text import line_of, mask_comments, snippet

#: Record fields, in the order of the output table.
FIELDS = ("producer", "kind", "id", "type", "name", "service", "path", "source", "target", "edgeType", "confidence", "line", "snippet", "method", "pathTemplate", "hostSource", "column", "sdk", "attrs")
STRUCTURAL, CALL_SITE, URL_LITERAL, URL_SUPPORTED, HOST_SHAPE = 0.85, 0.85, 0.7, 0.5, 0.2

Record = dict
Producer = Callable[[str, str, str], Iterator[Record]]
PRODUCERS: dict[str, tuple[re.Pattern, Producer]] = {}


def producer(name: str, paths: str) -> Callable[[Producer], Producer]:
    """Register a producer for the paths that a pattern finds."""

    def add(f: Producer) -> Producer:
        PRODUCERS[name] = (re.compile(paths), f)
        return f

    return add


def node(type_: str, id_: str, name: str, service: str, path: str, line: int | None = None, **attrs) -> Record:
    return {"kind": "node", "type": type_, "id": id_, "name": name, "service": service, "path": path, "line": line, "attrs": json.dumps(attrs, sort_keys=True) if attrs else None}


def edge(kind: str, source: str, target: str, path: str, confidence: float = STRUCTURAL, text: str | None = None, at: int | None = None, **more) -> Record:
    line = line_of(text, at) if text is not None and at is not None else None
    return {"kind": "edge", "edgeType": kind, "source": source, "target": target, "path": path, "confidence": confidence, "line": line, "snippet": snippet(text, line) if line else None, **more}


def column(table: str, name: str, path: str, sdk: str | None = None) -> Record:
    return {"kind": "column", "id": table, "column": name, "path": path, "confidence": STRUCTURAL, "sdk": sdk}


def file_node(service: str, path: str) -> str:
    return f"file:{service}:{path}"


def infra(kind: str, name: str) -> str:
    return f"infra:{kind}:{name}"


def resource(kind: str, name: str, service: str, path: str, text: str, at: int, edge_type: str = "CALLS", confidence: float = CALL_SITE, provider: str | None = None) -> Iterator[Record]:
    """An infra node and the file's edge to it."""
    yield node("InfraNode", infra(kind, name), name, service, path, kind=kind, provider=provider or kind.split("-")[0])
    yield edge(edge_type, file_node(service, path), infra(kind, name), path, confidence, text, at)


def masked(path: str, text: str) -> str:
    return mask_comments(text, hash_comments=path.endswith((".py", ".rb", ".tf", ".yaml", ".yml", ".toml")) or path.rsplit("/", 1)[-1].startswith((".env", "Dockerfile")))


def finds(pattern: str, text: str, flags: int = 0) -> Iterator[re.Match]:
    return re.finditer(pattern, text, flags)


def yaml_documents(text: str) -> list:
    """Parsed YAML documents; what does not parse gives none."""
    import yaml

    try:
        return [d for d in yaml.safe_load_all(text) if d is not None]
    except yaml.YAMLError:
        return []


def json_document(text: str):
    """Parsed JSON, comments and trailing commas allowed; None if it does not parse."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            return json.loads(re.sub(r",(\s*[}\]])", r"\1", mask_comments(text)))
        except ValueError:
            return None


def toml_document(text: str) -> dict:
    import tomllib

    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def block_from(text: str, at: int, opening: str = "{", closing: str = "}") -> str:
    """The balanced block that opens at or behind a position."""
    start = text.find(opening, at)
    if start < 0:
        return ""
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == opening) - (text[i] == closing)
        if not depth:
            return text[start + 1 : i]
    return text[start + 1 :]


JS = r"\.(?:[mc]?[jt]s|[jt]sx)$"
PY = r"\.py$"
GO = r"\.go$"
ANY_CODE = r"\.(?:py|go|[mc]?[jt]s|[jt]sx|rb|php|cs|java|kts?|rs|cc|cpp|cxx|hpp|h)$"
