"""Where services run: containers, clusters, infrastructure code and hosting platforms."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .base import Record, STRUCTURAL, edge, file_node, finds, infra, json_document, node, producer, resource, toml_document, yaml_documents

K8S_KINDS = ("Deployment", "StatefulSet", "DaemonSet", "Service", "Ingress", "CronJob", "Job")


@producer("compose", r"(?:^|/)(?:docker-)?compose[^/]*\.ya?ml$")
def compose(service: str, path: str, text: str) -> Iterator[Record]:
    for d in yaml_documents(text):
        for name, body in ((d.get("services") or {}) if isinstance(d, dict) else {}).items():
            yield node("InfraNode", infra("compose-service", name), name, service, path, kind="compose-service", provider="docker")
            needs = (body or {}).get("depends_on") or []
            for other in needs if isinstance(needs, list) else needs.keys():
                yield edge("DEPENDS_ON", infra("compose-service", name), infra("compose-service", other), path)


@producer("dockerfile", r"(?:^|/)Dockerfile[^/]*$")
def dockerfile(service: str, path: str, text: str) -> Iterator[Record]:
    stages = {m[2].lower() for m in finds(r"(?im)^FROM\s+(\S+)\s+AS\s+(\S+)", text)}
    images = [m for m in finds(r"(?im)^FROM\s+(?:--\S+\s+)?(\S+)", text) if m[1].lower() not in stages | {"scratch"}]
    if images:
        yield from resource("container-image", images[-1][1], service, path, text, images[-1].start(), "RUNS_ON", STRUCTURAL, "docker")
    for m in finds(r"(?im)^EXPOSE\s+(.+)$", text):
        for p in re.findall(r"(\d+)(?:/\w+)?", m[1]):
            yield from resource("port", p, service, path, text, m.start(), "CONNECTS_TO", STRUCTURAL, "docker")


@producer("kubernetes", r"\.ya?ml$")
def kubernetes(service: str, path: str, text: str) -> Iterator[Record]:
    for d in yaml_documents(text):
        if isinstance(d, dict) and d.get("kind") in K8S_KINDS and isinstance(d.get("metadata"), dict) and d["metadata"].get("name"):
            name = "/".join(x for x in (d["metadata"].get("namespace"), d["metadata"]["name"]) if x)
            kind = f"k8s-{d['kind'].lower()}"
            yield node("InfraNode", infra(kind, name), name, service, path, kind=kind, provider="kubernetes")


@producer("terraform", r"\.tf$")
def terraform(service: str, path: str, text: str) -> Iterator[Record]:
    blocks = list(finds(r'(?m)^resource\s+"(aws_\w+)"\s+"(\w+)"\s*\{', text))
    known = {(m[1], m[2]) for m in blocks}
    for m in blocks:
        yield node("InfraNode", infra(m[1], m[2]), m[2], service, path, kind=m[1], provider="aws")
        depth, i = 1, m.end()
        while depth and i < len(text):
            depth += (text[i] == "{") - (text[i] == "}")
            i += 1
        for r in {(a, b) for a, b in re.findall(r"\b(aws_\w+)\.(\w+)", text[m.end() : i])}:
            if r in known and r != (m[1], m[2]):
                yield edge("DEPENDS_ON", infra(m[1], m[2]), infra(*r), path)


def _on(service: str, path: str, kind: str, name: str, edge_type: str, provider: str) -> Iterator[Record]:
    yield node("InfraNode", infra(kind, name), name, service, path, kind=kind, provider=provider)
    yield edge(edge_type, f"service:{service}", infra(kind, name), path)


@producer("cloudflare", r"(?:^|/)wrangler\.(?:toml|jsonc?)$")
def cloudflare(service: str, path: str, text: str) -> Iterator[Record]:
    d = toml_document(text) if path.endswith("toml") else json_document(text)
    if not isinstance(d, dict):
        return
    yield {"kind": "platform", "service": service, "name": "cloudflare", "target": d.get("name"), "path": path}
    yield from _on(service, path, "cloudflare-runtime", "workers", "RUNS_ON", "cloudflare")
    routes = [*d.get("routes", []), *([d["route"]] if d.get("route") else [])]
    for r in routes:
        yield from _on(service, path, "cloudflare-route", r.get("pattern", "") if isinstance(r, dict) else str(r), "CONNECTS_TO", "cloudflare")
    for key, kind, field in (("kv_namespaces", "cloudflare-kv", "binding"), ("r2_buckets", "cloudflare-r2", "bucket_name"), ("d1_databases", "cloudflare-d1", "database_name")):
        for b in d.get(key, []):
            yield from _on(service, path, kind, str(b.get(field) or b.get("binding")), "DEPENDS_ON", "cloudflare")
    for b in (d.get("durable_objects") or {}).get("bindings", []):
        yield from _on(service, path, "cloudflare-durable-object", str(b.get("class_name") or b.get("name")), "DEPENDS_ON", "cloudflare")
    queues = d.get("queues") or {}
    for key in ("producers", "consumers"):
        for q in queues.get(key, []):
            yield from _on(service, path, "cloudflare-queue", str(q.get("queue")), "DEPENDS_ON", "cloudflare")
    for c in (d.get("triggers") or {}).get("crons", []):
        yield from _on(service, path, "cloudflare-cron", c, "DEPENDS_ON", "cloudflare")
    for k in d.get("vars") or {}:
        yield from _on(service, path, "cloudflare-env", k, "DEPENDS_ON", "cloudflare")
    for s in d.get("services", []):
        yield edge("CALLS", f"service:{service}", f"service:{s.get('service')}", path)


@producer("vercel", r"(?:^|/)vercel\.json$")
def vercel(service: str, path: str, text: str) -> Iterator[Record]:
    d = json_document(text)
    if isinstance(d, dict):
        yield {"kind": "platform", "service": service, "name": "vercel", "target": d.get("name"), "path": path}
        yield from _on(service, path, "vercel-platform", "vercel", "RUNS_ON", "vercel")
        for c in d.get("crons", []):
            yield from _on(service, path, "vercel-cron", str(c.get("path")), "DEPENDS_ON", "vercel")
        for f in d.get("functions") or {}:
            yield from _on(service, path, "vercel-function", f, "DEPENDS_ON", "vercel")
        for k in d.get("env") or {}:
            yield from _on(service, path, "vercel-env", k, "DEPENDS_ON", "vercel")
        for r in [*d.get("rewrites", []), *d.get("routes", [])]:
            yield from _on(service, path, "vercel-route", str(r.get("source") or r.get("src")), "CONNECTS_TO", "vercel")


@producer("railway", r"(?:^|/)railway\.(?:toml|json)$")
def railway(service: str, path: str, text: str) -> Iterator[Record]:
    d = toml_document(text) if path.endswith("toml") else json_document(text)
    if isinstance(d, dict):
        yield {"kind": "platform", "service": service, "name": "railway", "target": None, "path": path}
        yield from _on(service, path, "railway-platform", "railway", "RUNS_ON", "railway")
        cron = (d.get("deploy") or {}).get("cronSchedule")
        if cron:
            yield from _on(service, path, "railway-cron", cron, "DEPENDS_ON", "railway")


@producer("supabase-project", r"(?:^|/)supabase/config\.toml$")
def supabase_project(service: str, path: str, text: str) -> Iterator[Record]:
    d = toml_document(text)
    yield {"kind": "platform", "service": service, "name": "supabase", "target": d.get("project_id"), "path": path}
    yield from _on(service, path, "supabase-platform", str(d.get("project_id") or "supabase"), "RUNS_ON", "supabase")
    for key, kind in (("functions", "supabase-function"), ("storage", "supabase-storage")):
        body = d.get(key)
        names = (body.get("buckets", {}) if key == "storage" else body) if isinstance(body, dict) else {}
        for n in names:
            yield from _on(service, path, kind, n, "DEPENDS_ON", "supabase")
    if "auth" in d:
        yield from _on(service, path, "supabase-auth", "auth", "DEPENDS_ON", "supabase")


__all__ = ["cloudflare", "compose", "dockerfile", "file_node", "kubernetes", "railway", "supabase_project", "terraform", "vercel"]
