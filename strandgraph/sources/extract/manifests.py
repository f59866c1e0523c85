"""Services, aliases, configuration and databases from manifests and configuration files."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from ...functions.text import ENGINE_OF_IMAGE, ENGINE_OF_SCHEME
from .base import Record, STRUCTURAL, edge, file_node, finds, json_document, node, producer, toml_document, yaml_documents

#: Manifest file -> (order, language): the first in order names a directory's service.
MANIFESTS = (
    ("package.json", "javascript"), ("pyproject.toml", "python"), ("requirements.txt", "python"), ("setup.py", "python"), ("go.mod", "go"), ("Gemfile", "ruby"), ("composer.json", "php"),
    (".csproj", "csharp"), ("pom.xml", "java"), ("build.gradle.kts", "kotlin"), ("build.gradle", "java"), ("Cargo.toml", "rust"), ("CMakeLists.txt", "cpp"), ("Dockerfile", "unknown"),
)
_FRAMEWORKS = {"express": "express", "fastify": "fastify", "hono": "hono", "next": "next", "@nestjs/core": "nestjs", "fastapi": "fastapi", "flask": "flask", "django": "django", "rails": "rails", "sinatra": "sinatra", "laravel/framework": "laravel", "slim/slim": "slim", "actix-web": "actix"}


def clean(version: str) -> str:
    return re.sub(r"^[\^~>=<v\s]+", "", str(version).strip())


def parse_manifest(path: str, text: str) -> dict | None:
    """{name, language, version, dependencies, nodeEngine, order} of a manifest; None for other files."""
    base = path.rsplit("/", 1)[-1]
    order = next((i for i, (n, _) in enumerate(MANIFESTS) if base == n or (n == ".csproj" and base.endswith(n))), None)
    if order is None:
        return None
    folder = path.rsplit("/", 2)[-2] if path.count("/") else None
    out = {"order": order, "language": MANIFESTS[order][1], "name": folder, "version": None, "dependencies": {}, "nodeEngine": None}
    deps: dict[str, str] = out["dependencies"]
    if base in ("package.json", "composer.json"):
        d = json_document(text)
        if not isinstance(d, dict):
            return None
        out["name"] = d.get("name") or folder
        out["version"] = d.get("version")
        for key in ("dependencies", "devDependencies") if base == "package.json" else ("require", "require-dev"):
            deps.update({k: str(v) for k, v in (d.get(key) or {}).items()})
        out["nodeEngine"] = (d.get("engines") or {}).get("node")
        if "typescript" in deps:
            out["language"] = "typescript"
        if d.get("workspaces"):
            out["workspaces"] = True
    elif base in ("pyproject.toml", "Cargo.toml"):
        d = toml_document(text)
        project = d.get("project") or (d.get("tool", {}).get("poetry") or {}) if base == "pyproject.toml" else d.get("package", {})
        out["name"], out["version"] = project.get("name") or folder, str(project.get("version") or "") or None
        listed = project.get("dependencies", {}) if base == "pyproject.toml" else d.get("dependencies", {})
        if isinstance(listed, dict):
            deps.update({k: (v if isinstance(v, str) else str(v.get("version", "")) if isinstance(v, dict) else "") for k, v in listed.items()})
        else:
            deps.update(_requirement(x) for x in listed if _requirement(x))
    elif base == "requirements.txt":
        deps.update(r for r in map(_requirement, text.splitlines()) if r)
    elif base == "setup.py":
        if m := re.search(r"name\s*=\s*['\"]([^'\"]+)", text):
            out["name"] = m[1]
    elif base == "go.mod":
        if m := re.search(r"(?m)^module\s+(\S+)", text):
            out["name"] = m[1].rsplit("/", 1)[-1]
        deps.update({m[1]: m[2] for m in finds(r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v[\w.+-]+)", text)})
    elif base == "Gemfile":
        deps.update({m[1]: m[2] or "" for m in finds(r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", text)})
    elif base.endswith(".csproj"):
        out["name"] = base[: -len(".csproj")]
        deps.update({m[1]: m[2] for m in finds(r'<PackageReference\s+Include="([^"]+)"\s+Version="([^"]+)"', text)})
    elif base == "pom.xml":
        try:
            root = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
            out["name"], out["version"] = root.findtext("artifactId") or folder, root.findtext("version")
            deps.update({f"{d.findtext('groupId')}:{d.findtext('artifactId')}": d.findtext("version") or "" for d in root.iter("dependency")})
        except ET.ParseError:
            return None
    elif base.startswith("build.gradle"):
        deps.update({m[1]: m[2] for m in finds(r"(?:implementation|api|compile)\s*\(?\s*['\"]([^:'\"]+:[^:'\"]+):([^'\"]+)['\"]", text)})
    elif base == "CMakeLists.txt":
        if m := re.search(r"project\s*\(\s*([\w-]+)", text, re.I):
            out["name"] = m[1]
    return out


def _requirement(line: str):
    m = re.match(r"\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=~><!]=?\s*([\w.*]+))?", line.split("#")[0])
    return (m[1].lower(), m[2] or "") if m else None


@producer("services", r"(?:^|/)(?:package\.json|pyproject\.toml|requirements\.txt|setup\.py|go\.mod|Gemfile|composer\.json|[^/]+\.csproj|pom\.xml|build\.gradle(?:\.kts)?|Cargo\.toml|CMakeLists\.txt|Dockerfile)$")
def services(service: str, path: str, text: str) -> Iterator[Record]:
    """A service node for a manifest; the discovery step keeps the first of a directory and of a name."""
    m = parse_manifest(path, text)
    if m and (m["name"] or service):
        name = m["name"] or service
        framework = next((f for k, f in _FRAMEWORKS.items() if k in {d.lower() for d in m["dependencies"]}), None)
        yield node("ServiceNode", f"service:{name}", name, name, path, directory=path.rsplit("/", 1)[0] if "/" in path else "", order=m["order"], language=m["language"], version=m["version"], dependencies={k: clean(v) for k, v in m["dependencies"].items()}, nodeEngine=m["nodeEngine"], framework=framework)


_COMPOSE = r"(?:^|/)(?:docker-)?compose[^/]*\.ya?ml$"


@producer("aliases", rf"{_COMPOSE}|(?:^|/)Dockerfile$|\.ya?ml$")
def aliases(service: str, path: str, text: str) -> Iterator[Record]:
    """Other names of services: compose names and network aliases, image labels, workload names."""

    def alias(name: str) -> Record:
        return {"kind": "alias", "service": service, "name": name, "path": path}

    if path.rsplit("/", 1)[-1] == "Dockerfile":
        for m in finds(r'(?im)^LABEL\s+.*?(?:service|org\.opencontainers\.image\.title)\s*=\s*"?([\w.-]+)', text):
            yield alias(m[1])
        return
    for d in yaml_documents(text):
        if not isinstance(d, dict):
            continue
        if isinstance(d.get("services"), dict):
            for name, body in d["services"].items():
                build = (body or {}).get("build")
                where = build.get("context") if isinstance(build, dict) else build
                if where and where.strip("./").rsplit("/", 1)[-1] == service:
                    yield alias(name)
                    if (body or {}).get("container_name"):
                        yield alias(body["container_name"])
                    networks = (body or {}).get("networks")
                    for n in networks.values() if isinstance(networks, dict) else ():
                        for a in (n or {}).get("aliases", []):
                            yield alias(a)
        elif d.get("kind") in ("Service", "Deployment") and isinstance(d.get("metadata"), dict) and d["metadata"].get("name"):
            name = d["metadata"]["name"]
            if service in name or name in service:
                yield alias(name)


@producer("configs", r"\.ya?ml$|(?:^|/)\.env(?!.*(?:example|sample|template))[^/]*$|(?:^|/)(?:app|eas)\.json$")
def configs(service: str, path: str, text: str) -> Iterator[Record]:
    yield node("ConfigNode", f"config:{path}", path.rsplit("/", 1)[-1], service, path, fileType="env" if "/.env" in f"/{path}" else path.rsplit(".", 1)[-1])
    yield edge("CONFIGURED_BY", f"service:{service}", f"config:{path}", path)


def parse_url(url: str) -> dict | None:
    m = re.match(r"([A-Za-z][\w+]*)://(?:[^@/\s]*@)?(\[[^\]]*\]|[^:/?,\s]+)?(?::(\d+))?(?:[^/\s]*/([^?;\s]*))?", url.strip().strip("\"'"))
    engine = ENGINE_OF_SCHEME.get(m[1].lower()) if m else None
    return {"engine": engine, "host": m[2], "port": int(m[3]) if m[3] else None, "name": m[4]} if engine and m[2] else None


def _database(service: str, path: str, parser: int, found: dict, literal: bool = True) -> Iterator[Record]:
    host = found["host"]
    yield node("DatabaseNode", f"database:{host}", found.get("name") or host, service, path, engine=found.get("engine") or "unknown", engineVersion=str(found.get("version") or "unknown"), host=host, port=found.get("port"), order=parser)
    yield edge("CONNECTS_TO", f"service:{service}", f"database:{host}", path, STRUCTURAL, hostSource="literal" if literal else "config")
    yield node("ConfigNode", f"config:{path}", path.rsplit("/", 1)[-1], service, path, fileType=path.rsplit(".", 1)[-1])
    yield edge("CONFIGURED_BY", f"service:{service}", f"config:{path}", path)


#: Environment variables that hold a connection URL.
URL_KEYS = tuple("DATABASE_URL DB_URL POSTGRES_URL POSTGRESQL_URL PG_URL PGURL MYSQL_URL MARIADB_URL MONGO_URL MONGODB_URL MONGO_URI MONGODB_URI REDIS_URL SQL_URL DATABASE_URI DIRECT_URL".split())


@producer("databases", r"(?:^|/)(?:[^/]*db-config[^/]*\.ya?ml|\.env[^/]*|schema\.prisma|drizzle\.config\.[jt]s|knexfile\.[jt]s|ormconfig\.(?:json|ya?ml)|config/config\.json|[^/]*data-?source\.[jt]s)$|\.cs$|appsettings[^/]*\.json$|" + _COMPOSE)
def databases(service: str, path: str, text: str) -> Iterator[Record]:
    """Databases from ten kinds of configuration; of several for a host the smaller order wins."""
    base = path.rsplit("/", 1)[-1]
    if "db-config" in base:
        for d in yaml_documents(text):
            d = d.get("database", d) if isinstance(d, dict) and isinstance(d.get("database"), dict) else d
            if isinstance(d, dict) and d.get("host"):
                yield from _database(service, path, 0, {"host": d["host"], "port": d.get("port"), "name": d.get("database") or d.get("name"), "engine": ENGINE_OF_SCHEME.get(str(d.get("engine", "")).lower(), d.get("engine")), "version": d.get("engineVersion")}, False)
    elif base.startswith(".env"):
        for m in finds(r"(?m)^\s*(?:export\s+)?([A-Za-z_]+)\s*=\s*(\S+)", text):
            if m[1].upper() in URL_KEYS and (u := parse_url(m[2])):
                yield from _database(service, path, 1, u, False)
    elif base == "schema.prisma":
        if m := re.search(r"datasource\s+\w+\s*\{(.*?)\}", text, re.S):
            provider = re.search(r'provider\s*=\s*"(\w+)"', m[1])
            engine = ENGINE_OF_SCHEME.get(provider[1], provider[1]) if provider else "unknown"
            url = re.search(r'url\s*=\s*"([^"]+)"', m[1])
            yield from _database(service, path, 2, (url and parse_url(url[1])) or {"host": f"{engine}-prisma", "engine": engine}, bool(url))
    elif base.startswith(("drizzle.config", "knexfile")) or "data-source" in base or "datasource" in base.lower():
        order = 3 if base.startswith("drizzle") else 4 if base.startswith("knex") else 6
        for m in finds(r"['\"]((?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis)://[^'\"]+)['\"]", text):
            if u := parse_url(m[1]):
                yield from _database(service, path, order, u)
        if m := re.search(r"host\s*:\s*['\"]([^'\"]+)['\"]", text):
            kind = re.search(r"(?:dialect|client|type)\s*:\s*['\"](\w+)['\"]", text)
            port = re.search(r"port\s*:\s*(\d+)", text)
            yield from _database(service, path, order, {"host": m[1], "engine": ENGINE_OF_SCHEME.get(kind[1].replace("pg", "postgres"), kind[1]) if kind else "unknown", "port": int(port[1]) if port else None})
    elif base.startswith("ormconfig") or base == "config.json":
        found = json_document(text) if base.endswith("json") else next(iter(yaml_documents(text)), None)
        entries = found if isinstance(found, list) else list(found.values()) if isinstance(found, dict) and base == "config.json" else [found]
        for e in entries:
            if isinstance(e, dict) and e.get("host"):
                kind = str(e.get("type") or e.get("dialect") or "")
                yield from _database(service, path, 5 if base.startswith("orm") else 7, {"host": e["host"], "port": e.get("port"), "name": e.get("database"), "engine": ENGINE_OF_SCHEME.get(kind, kind or "unknown")})
    elif path.endswith(".cs") or base.startswith("appsettings"):
        for m in finds(r"(?i)\b(?:Host|Server|Data Source)=([\w.-]+)(?:;|,)[^\"']*", text):
            engine = "postgresql" if re.search(r"Npgsql|UseNpgsql|Host=", text) else "mssql"
            yield from _database(service, path, 8, {"host": m[1], "engine": engine}, path.endswith(".cs"))
    else:
        for d in yaml_documents(text):
            for name, body in ((d.get("services") or {}) if isinstance(d, dict) else {}).items():
                image = str((body or {}).get("image") or "")
                m = re.match(r"(?:.*/)?([^/:@]+)(?::(\d+(?:\.\d+)*))?", image)
                if m and m[1].lower() in ENGINE_OF_IMAGE:
                    yield from _database(service, path, 9, {"host": name, "engine": ENGINE_OF_IMAGE[m[1].lower()], "version": m[2]}, False)


__all__ = ["aliases", "configs", "databases", "file_node", "parse_manifest", "services"]
