"""Files, symbols, imports, routes and calls from source code."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

from .base import ANY_CODE, CALL_SITE, GO, HOST_SHAPE, JS, PY, Record, STRUCTURAL, URL_LITERAL, edge, file_node, finds, line_of, masked, node, producer

LANGUAGE = {"py": "python", "go": "go", "rb": "ruby", "php": "php", "cs": "csharp", "java": "java", "kt": "kotlin", "kts": "kotlin", "rs": "rust"}


def language(path: str) -> str:
    e = path.rsplit(".", 1)[-1].lower()
    return LANGUAGE.get(e) or ("typescript" if "t" in e and e[-2:] in ("ts", "sx") and e != "jsx" else "javascript" if e.endswith(("js", "jsx")) else "cpp")


@producer("files", ANY_CODE)
def files(service: str, path: str, text: str) -> Iterator[Record]:
    yield node("FileNode", file_node(service, path), path.rsplit("/", 1)[-1], service, path, language=language(path))
    yield edge("CONTAINS", f"service:{service}", file_node(service, path), path)


def python_symbols(text: str) -> list[tuple[str, str, int, int, list[str]]]:
    """(kind, qualname, start, end, bases) of classes and functions, exactly."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out = []

    def visit(body, prefix: str, in_class: bool) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                out.append(("class", prefix + n.name, n.lineno, n.end_lineno or n.lineno, [b.id if isinstance(b, ast.Name) else b.attr for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]))
                visit(n.body, f"{prefix}{n.name}.", True)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "constructor" if in_class and n.name == "__init__" else "method" if in_class else "function"
                out.append((kind, prefix + n.name, n.lineno, n.end_lineno or n.lineno, []))
                visit(n.body, f"{prefix}{n.name}.", False)

    visit(tree.body, "", False)
    return out


#: Extension group -> patterns (kind, pattern with the name in group 1).
_SYMBOLS = (
    (JS, (("class", r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([\w,\s]+))?"), ("function", r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\("), ("function", r"(?m)^\s*(?:export\s+)?const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("method", r"(?m)^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*\([^)]*\)\s*(?::\s*[\w<>\[\]| ]+)?\s*\{"))),
    (GO, (("function", r"(?m)^func\s+(\w+)\s*\("), ("method", r"(?m)^func\s+\([^)]*\)\s*(\w+)\s*\("), ("class", r"(?m)^type\s+(\w+)\s+(?:struct|interface)"))),
    (r"\.rb$", (("class", r"(?m)^\s*(?:class|module)\s+([\w:]+)(?:\s*<\s*([\w:]+))?"), ("method", r"(?m)^\s*def\s+(?:self\.)?(\w+[?!]?)"))),
    (r"\.php$", (("class", r"(?m)^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s\\]+))?"), ("method", r"(?m)^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+(\w+)\s*\("))),
    (r"\.(?:cs|java)$", (("class", r"(?m)^\s*(?:(?:public|private|protected|internal|static|abstract|final|sealed|partial)\s+)*(?:class|interface|record|struct|enum)\s+(\w+)(?:<[^>]*>)?(?:\s*(?:extends|:)\s*([\w.]+))?(?:\s+implements\s+([\w,\s.]+))?"), ("method", r"(?m)^\s+(?:(?:public|private|protected|internal|static|final|async|override|virtual|abstract|synchronized)\s+)+[\w<>\[\],.? ]+?\s(\w+)\s*\([^;{]*\)\s*(?:throws [\w, .]+)?\s*\{"))),
    (r"\.kts?$", (("class", r"(?m)^\s*(?:(?:data|open|abstract|sealed|private|internal)\s+)*(?:class|interface|object)\s+(\w+)(?:[^:\n{]*:\s*(\w+))?"), ("function", r"(?m)^\s*(?:(?:private|internal|override|suspend|open|inline)\s+)*fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(\w+)\s*\("))),
    (r"\.rs$", (("class", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"), ("function", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"))),
    (r"\.(?:cc|cpp|cxx|hpp|h)$", (("class", r"(?m)^\s*(?:class|struct)\s+(\w+)(?:\s*(?:final)?\s*:\s*(?:public|private|protected)?\s*([\w:]+))?\s*\{"), ("function", r"(?m)^[\w:<>,*&\s]+?\s[*&]?([\w:~]+)\s*\([^;{]*\)\s*(?:const)?\s*\{"))),
)


def symbols_of(path: str, text: str) -> list[tuple[str, str, int, int, list[str], list[str]]]:
    """(kind, qualname, start, end, bases, interfaces); exact for Python, by patterns and braces otherwise."""
    if path.endswith(".py"):
        return [(*s, []) for s in python_symbols(text)]
    clean = masked(path, text)
    found = []
    for ext, patterns in _SYMBOLS:
        if re.search(ext, path):
            for kind, pattern in patterns:
                for m in finds(pattern, clean):
                    start = line_of(clean, m.start(1))
                    open_at = clean.find("{", m.end() - 1)
                    end = start
                    if not path.endswith(".rb") and 0 <= open_at:
                        depth = 0
                        for i in range(open_at, len(clean)):
                            depth += (clean[i] == "{") - (clean[i] == "}")
                            if not depth:
                                end = line_of(clean, i)
                                break
                    elif path.endswith(".rb"):
                        indent = len(m[0].lstrip("\n")) - len(m[0].lstrip())
                        stop = re.compile(rf"(?m)^[ \t]{{{max(0, indent)}}}end\b").search(clean, m.end())
                        end = line_of(clean, stop.start()) if stop else start
                    base = [m[2].split(".")[-1].strip()] if m.lastindex and m.lastindex >= 2 and m[2] else []
                    faces = [x.strip().split("\\")[-1] for x in m[3].split(",")] if m.lastindex and m.lastindex >= 3 and m[3] else []
                    found.append((kind, m[1], start, max(start, end), base, faces))
    out, seen = [], set()
    classes = [f for f in found if f[0] == "class"]
    for kind, name, a, b, base, faces in found:
        around = [c for c in classes if c[2] <= a and b <= c[3] and c[1] != name]
        inner = max(around, key=lambda c: c[2], default=None)
        qual = f"{inner[1]}.{name}" if inner and kind != "class" else name
        if name in ("constructor", "__construct", "initialize") or (inner and name == inner[1]):
            kind = "constructor"
        if (qual, a) not in seen:
            seen.add((qual, a))
            out.append((kind, qual, a, b, base, faces))
    return sorted(out, key=lambda s: (s[2], s[1]))


@producer("symbols", ANY_CODE)
def symbols(service: str, path: str, text: str) -> Iterator[Record]:
    """Symbols, and what they inherit or implement; the graph step resolves names and numbers equal ones."""
    for kind, qual, a, b, base, faces in symbols_of(path, text):
        yield {"kind": "symbol", "type": "SymbolNode", "name": qual, "service": service, "path": path, "line": a, "attrs": json.dumps({"kind": kind, "end": b, "bases": base, "interfaces": faces})}


@producer("symbol-calls", PY)
def symbol_calls(service: str, path: str, text: str) -> Iterator[Record]:
    """Calls by bare name with their line, to be resolved to unique symbols."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
            yield {"kind": "symbol-call", "name": n.func.id, "service": service, "path": path, "line": n.lineno}


@producer("imports", rf"{JS}|{PY}|{GO}")
def imports(service: str, path: str, text: str) -> Iterator[Record]:
    """Candidate target paths of imports within the service; only existing files become edges."""
    folder = path.rsplit("/", 1)[0] if "/" in path else ""

    def wanted(base: str, at: int, endings: tuple[str, ...]) -> Iterator[Record]:
        parts: list[str] = []
        for p in base.split("/"):
            if p == "..":
                parts[:] = parts[:-1]
            elif p not in ("", "."):
                parts.append(p)
        for rank, e in enumerate(endings):
            yield {"kind": "import", "service": service, "path": path, "name": "/".join(parts) + e, "line": line_of(text, at), "confidence": float(rank), "target": base}

    if re.search(JS, path):
        for m in finds(r"(?:from|import|require\()\s*['\"](\.{1,2}/[^'\"]+)['\"]", text):
            stem = re.sub(r"\.[mc]?js$", "", m[1])
            yield from wanted(f"{folder}/{stem}", m.start(), ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.js"))
    elif path.endswith(".py"):
        for m in finds(r"(?m)^\s*from\s+(\.*)([\w.]*)\s+import\s+([\w, ]+)|^\s*import\s+([\w.]+)", text):
            dots, module, names, plain = m[1] or "", m[2] or "", m[3] or "", m[4]
            if plain:
                yield from wanted(plain.replace(".", "/"), m.start(), (".py", "/__init__.py"))
                continue
            base = "/".join([folder, *[".."] * (len(dots) - 1)]) if dots else ""
            stem = f"{base}/{module.replace('.', '/')}"
            yield from wanted(stem, m.start(), (".py", "/__init__.py"))
            for n in names.split(","):
                yield from wanted(f"{stem}/{n.strip().split(' ')[0]}", m.start(), (".py",))
    else:
        for m in finds(r'"([\w./-]+/[\w./-]+)"', text):
            parts = m[1].split("/")
            for k in range(1, min(4, len(parts))):
                yield {"kind": "import-package", "service": service, "path": path, "name": "/".join(parts[k:]), "line": line_of(text, m.start())}


_VERBS = "get|post|put|patch|delete|options|head|all"


def _route(service: str, path: str, text: str, at: int, method: str, template: str, framework: str) -> Iterator[Record]:
    t = re.sub(r"[?#].*$", "", template)
    t = re.sub(r"/+$", "", t if t.startswith("/") else "/" + t) or "/"
    m = {"ANY": "ALL", "USE": "ALL"}.get(method.upper(), method.upper())
    id_ = f"route:{service}:{m} {t}"
    yield node("RouteNode", id_, f"{m} {t}", service, path, line_of(text, at), method=m, pathTemplate=t, framework=framework)
    yield edge("CONTAINS", f"service:{service}", id_, path, STRUCTURAL, text, at)


@producer("routes", rf"{JS}|{PY}|{GO}|\.(?:rb|php|rs)$")
def routes(service: str, path: str, text: str) -> Iterator[Record]:
    """HTTP routes of JavaScript, Python, Go, Ruby, PHP and Rust frameworks."""
    clean = masked(path, text)
    base = path.rsplit("/", 1)[-1]
    if re.search(JS, path):
        prefixes = {m[2]: m[1] for m in finds(r"\.use\(\s*['\"`](/[^'\"`]*)['\"`]\s*,\s*(\w+)", clean)}
        framework = next((f for f in ("fastify", "hono", "express") if re.search(rf"['\"]{f}['\"]", clean)), "express")
        for m in finds(rf"\b(\w+)\.({_VERBS})\s*\(\s*['\"`](/[^'\"`]*)['\"`]", clean):
            if m[1] not in ("axios", "http", "client", "request", "fetch", "api", "supertest"):
                yield from _route(service, path, text, m.start(), m[2], prefixes.get(m[1], "") + m[3], framework)
        for m in finds(r"\.route\(\s*\{[^}]*?method\s*:\s*['\"](\w+)['\"][^}]*?url\s*:\s*['\"]([^'\"]+)['\"]", clean):
            yield from _route(service, path, text, m.start(), m[1], m[2], "fastify")
        if c := re.search(r"@Controller\(\s*(?:['\"]([^'\"]*)['\"])?", clean):
            for m in finds(r"@(Get|Post|Put|Patch|Delete|All)\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)", clean):
                yield from _route(service, path, text, m.start(), m[1], "/" + "/".join(x.strip("/") for x in (c[1] or "", m[2] or "") if x), "nestjs")
        if m := re.search(r"(?:^|/)app/(.*?)/?route\.[jt]sx?$", path):
            template = "/" + "/".join(p for p in m[1].split("/") if p and not p.startswith("("))
            for v in finds(r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b", clean):
                yield from _route(service, path, text, v.start(), v[1], template, "next")
        elif m := re.search(r"(?:^|/)pages/(api/.*?)(?:/index)?\.[jt]sx?$", path):
            yield from _route(service, path, text, 0, "ALL", "/" + m[1], "next")
    elif path.endswith(".py"):
        flask_prefix = {m[1]: m[2] for m in finds(r"(\w+)\s*=\s*(?:Blueprint|APIRouter)\([^)]*?(?:url_prefix|prefix)\s*=\s*['\"]([^'\"]+)['\"]", clean)}
        for m in finds(r"@(\w+)\.(get|post|put|patch|delete|options|head)\(\s*['\"]([^'\"]*)['\"]", clean):
            yield from _route(service, path, text, m.start(), m[2], flask_prefix.get(m[1], "") + m[3], "fastapi")
        for m in finds(r"@(\w+)\.route\(\s*['\"]([^'\"]*)['\"]([^)]*)\)", clean):
            methods = re.findall(r"['\"](\w+)['\"]", m[3].split("methods", 1)[1]) if "methods" in m[3] else ["GET"]
            for v in methods:
                yield from _route(service, path, text, m.start(), v, flask_prefix.get(m[1], "") + m[2], "flask")
        if base == "urls.py":
            for m in finds(r"\b(?:re_)?path\(\s*r?['\"]\^?([^'\"]*?)\$?['\"]\s*,\s*(?!include)", clean):
                yield from _route(service, path, text, m.start(), "ALL", "/" + re.sub(r"<(?:\w+:)?(\w+)>", r":\1", m[1]), "django")
    elif path.endswith(".go"):
        framework = next((f for f in ("gin", "echo", "fiber", "chi") if re.search(rf'/{f}(?:/v\d+)?"|"[^"]*/{f}[^"]*"', text)), "net/http")
        groups = {m[1]: m[2] for m in finds(r"(\w+)\s*:?=\s*\w+\.Group\(\s*\"([^\"]*)\"", clean)}
        for m in finds(r"\b(\w+)\.(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|Any|Get|Post|Put|Patch|Delete|Options|Head|All)\(\s*\"(/[^\"]*)\"", clean):
            yield from _route(service, path, text, m.start(), m[2], groups.get(m[1], "") + m[3], framework)
        for m in finds(r"\.?Handle(?:Func)?\(\s*\"(?:(GET|POST|PUT|PATCH|DELETE)\s+)?(/[^\"]*)\"", clean):
            yield from _route(service, path, text, m.start(), m[1] or "ALL", m[2], "net/http")
    elif path.endswith(".rb"):
        rails = base == "routes.rb"
        for m in finds(r"(?m)^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]", clean):
            yield from _route(service, path, text, m.start(), m[1], "/" + m[2].lstrip("/"), "rails" if rails else "sinatra")
        for m in finds(r"(?m)^\s*resources\s+:(\w+)", clean) if rails else ():
            for v, t in (("GET", ""), ("POST", ""), ("GET", "/:id"), ("PUT", "/:id"), ("PATCH", "/:id"), ("DELETE", "/:id")):
                yield from _route(service, path, text, m.start(), v, f"/{m[1]}{t}", "rails")
    elif path.endswith(".php"):
        for m in finds(r"Route::(get|post|put|patch|delete|any)\(\s*['\"]([^'\"]+)['\"]", clean):
            yield from _route(service, path, text, m.start(), m[1], m[2], "laravel")
        for m in finds(r"\$\w+->(get|post|put|patch|delete|any)\(\s*['\"](/[^'\"]*)['\"]", clean):
            yield from _route(service, path, text, m.start(), m[1], m[2], "slim")
    else:
        for m in finds(r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]+)\"", clean):
            yield from _route(service, path, text, m.start(), m[1], m[2], "actix")
        for m in finds(r"\.route\(\s*\"([^\"]+)\"\s*,\s*web::(get|post|put|patch|delete)\(\)", clean):
            yield from _route(service, path, text, m.start(), m[2], m[1], "actix")


@producer("actions", JS)
def actions(service: str, path: str, text: str) -> Iterator[Record]:
    """Exported functions of a module marked as server code."""
    if re.match(r"\s*['\"]use server['\"]", text):
        for m in finds(r"export\s+(?:default\s+)?async\s+function\s+(\w+)|export\s+const\s+(\w+)\s*=\s*async", masked(path, text)):
            name = m[1] or m[2]
            id_ = f"action:{service}:{path}#{name}"
            yield node("ServerActionNode", id_, name, service, path, line_of(text, m.start()), module=path, exportName=name)
            yield edge("CONTAINS", file_node(service, path), id_, path, STRUCTURAL, text, m.start())


@producer("proto", r"\.proto$")
def proto(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    package = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", clean)
    for s in finds(r"\bservice\s+(\w+)\s*\{", clean):
        end = clean.find("}", s.end())
        depth, i = 1, s.end()
        while depth and i < len(clean):
            depth += (clean[i] == "{") - (clean[i] == "}")
            end, i = i, i + 1
        for r in finds(r"\brpc\s+(\w+)\s*\(", clean[s.end() : end]):
            full = f"{package[1]}.{s[1]}" if package else s[1]
            id_ = f"grpc:{full}/{r[1]}"
            yield node("GrpcMethodNode", id_, r[1], service, path, line_of(text, s.end() + r.start()), rpcService=full, rpcMethod=r[1])
            yield edge("CONTAINS", f"service:{service}", id_, path, STRUCTURAL, text, s.end() + r.start())


@producer("graphql", rf"\.(?:graphql|gql)$|{JS}|{PY}")
def graphql(service: str, path: str, text: str) -> Iterator[Record]:
    for m in finds(r"\btype\s+(Query|Mutation|Subscription)\s*\{([^}]*)\}", text):
        for f in finds(r"(?m)^\s*(\w+)\s*(?:\(|:)", m[2]):
            id_ = f"graphql:{service}:{m[1].lower()} {f[1]}"
            yield node("GraphQLOperationNode", id_, f[1], service, path, line_of(text, m.start()), operationType=m[1].lower(), operationName=f[1])
            yield edge("CONTAINS", f"service:{service}", id_, path, STRUCTURAL, text, m.start())


@producer("websockets", rf"{JS}|{PY}|{GO}")
def websockets(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    for m in finds(r"new\s+WebSocketServer\(\s*\{[^}]*path\s*:\s*['\"]([^'\"]+)|@\w+\.websocket\(\s*['\"]([^'\"]+)|\.ws\(\s*['\"](/[^'\"]*)", clean):
        channel = m[1] or m[2] or m[3]
        id_ = f"ws:{service}:{channel}"
        yield node("WebSocketChannelNode", id_, channel, service, path, line_of(text, m.start()), channel=channel)
        yield edge("CONNECTS_TO", f"service:{service}", id_, path, STRUCTURAL, text, m.start())


@producer("http-calls", ANY_CODE)
def http_calls(service: str, path: str, text: str) -> Iterator[Record]:
    """URL literals by host, and client calls by method and path; the graph step joins them to services and routes."""
    clean = masked(path, text)
    for m in finds(r"['\"`](https?|wss?)://([\w.-]+)(?::(\d+))?(/[^'\"`\s]*)?", clean):
        yield {"kind": "url", "service": service, "path": path, "name": m[2].lower(), "target": m[3], "line": line_of(text, m.start()), "pathTemplate": m[4], "confidence": URL_LITERAL, "source": file_node(service, path)}
    for m in finds(r"\b(?:axios|client|http|api|requests|httpx|session|fetch)(?:\.(get|post|put|patch|delete))?\(\s*f?['\"`](?:\$?\{[^}]*\}|https?://([\w.-]+)(?::\d+)?)?(/[^'\"`]*)['\"`](?:\s*,\s*\{[^}]*?method\s*:\s*['\"](\w+))?", clean):
        yield {"kind": "client-call", "service": service, "path": path, "method": (m[1] or m[4] or "GET").upper(), "name": (m[2] or "").lower() or None, "pathTemplate": re.sub(r"\$?\{[^}]*\}", ":param", m[3]), "line": line_of(text, m.start()), "confidence": CALL_SITE, "source": file_node(service, path)}


def source_map_targets(path: str, document: dict) -> list[str]:
    """Original paths that a generated file's map names, relative to the repository."""
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    out = []
    for s in document.get("sources", []):
        parts: list[str] = []
        for p in f"{folder}/{document.get('sourceRoot', '')}/{s}".split("/"):
            if p == "..":
                parts[:] = parts[:-1]
            elif p not in ("", "."):
                parts.append(p)
        out.append("/".join(parts))
    return out


@producer("source-maps", r"\.map$")
def source_maps(service: str, path: str, text: str) -> Iterator[Record]:
    """Generated file -> original, when a map names just one."""
    try:
        targets = source_map_targets(path, json.loads(text))
    except ValueError:
        return
    if len(targets) == 1:
        yield {"kind": "source-map", "service": service, "path": path[: -len(".map")], "name": targets[0], "confidence": HOST_SHAPE}
