"""Data stores that code touches: queues, caches, object stores, collections and tables with their columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ...functions.text import columns_of, plural, snake
from .base import CALL_SITE, GO, HOST_SHAPE, JS, PY, Record, STRUCTURAL, URL_SUPPORTED, block_from, column, edge, file_node, finds, infra, masked, node, producer, resource

_CODE = rf"{JS}|{PY}|{GO}"


def table(name: str, service: str, path: str, text: str, at: int, columns: list[str], confidence: float = STRUCTURAL) -> Iterator[Record]:
    yield from resource("sql-table", name, service, path, text, at, confidence=confidence, provider="sql")
    for c in dict.fromkeys(columns):
        yield column(infra("sql-table", name), c.lower(), path)


def foreign(child: str, parent: str, path: str) -> Iterator[Record]:
    """A foreign key between tables; not onto itself."""
    if child != parent:
        yield {"kind": "fk", "source": infra("sql-table", child), "target": infra("sql-table", parent), "edgeType": "REFERENCES", "path": path, "confidence": STRUCTURAL}


@producer("kafka", _CODE)
def kafka(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    if re.search(r"kafka", clean, re.I):
        sends = r"\.send(?:Batch)?\(\s*\{[^}]*?topic\s*:\s*['\"`]([\w.-]+)|\.(?:produce|send)\(\s*['\"]([\w.-]+)|kafka\.Writer\{[^}]*?Topic:\s*\"([\w.-]+)|Topic:\s*\"([\w.-]+)\"[^}]*?Balancer"
        reads = r"\.subscribe\(\s*\{[^}]*?topics?\s*:\s*\[?\s*['\"`]([\w.-]+)|\.subscribe\(\s*\[\s*['\"]([\w.-]+)|KafkaConsumer\(\s*['\"]([\w.-]+)|kafka\.ReaderConfig\{[^}]*?Topic:\s*\"([\w.-]+)"
        for kind, pattern in (("PUBLISHES_TO", sends), ("CONSUMES_FROM", reads)):
            for m in finds(pattern, clean, re.S):
                yield from resource("kafka-topic", next(g for g in m.groups() if g), service, path, text, m.start(), kind)


@producer("redis", _CODE)
def redis(service: str, path: str, text: str) -> Iterator[Record]:
    """Hosts of Redis URLs; the grade lies under the default floor."""
    for m in finds(r"rediss?://(?:[^@/'\"\s]*@)?([\w.-]+)", masked(path, text)):
        yield from resource("redis", m[1], service, path, text, m.start(), confidence=URL_SUPPORTED)


@producer("aws", _CODE)
def aws(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    for kind, pattern in (("s3-bucket", r"Bucket\s*[:=]\s*['\"]([\w.-]+)"), ("dynamodb-table", r"TableName\s*[:=]\s*['\"]([\w.-]+)|\.Table\(\s*['\"]([\w.-]+)")):
        for m in finds(pattern, clean):
            yield from resource(kind, m[1] or m[2], service, path, text, m.start(), provider="aws")


@producer("grpc-clients", _CODE)
def grpc_clients(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    if re.search(r"@grpc/|grpc-js|google\.golang\.org/grpc|import grpc|_pb2_grpc|_grpc_pb", clean):
        for m in finds(r"new\s+(?:\w+\.)*(\w+?)(?:Service)?Client\(|(\w+?)(?:Service)?Stub\(|New(\w+?)(?:Service)?Client\(", clean):
            yield from resource("grpc-service", m[1] or m[2] or m[3], service, path, text, m.start(), provider="grpc")
    if re.search(r"@aws-sdk/", clean):
        for m in finds(r"from\s+['\"]@aws-sdk/client-([\w-]+)['\"]", clean):
            for c in finds(r"new\s+(\w+Client)\(", clean):
                yield from resource(f"aws-{m[1]}", c[1], service, path, text, c.start(), provider="aws")


@producer("supabase", JS)
def supabase(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    m = re.search(r"createClient\(\s*(?:['\"`]https?://([\w.-]+)|(?:process\.env\.|import\.meta\.env\.)?(\w+))", clean)
    if m and "supabase" in clean.lower():
        host = m[1] or m[2]
        yield from resource("supabase", host, service, path, text, m.start())
        for kind, pattern in (("supabase-table", r"\.from\(\s*['\"`](\w+)['\"`]\s*\)"), ("supabase-rpc", r"\.rpc\(\s*['\"`](\w+)['\"`]")):
            for t in finds(pattern, clean):
                yield from resource(kind, f"{host}/{t[1]}", service, path, text, t.start(), provider="supabase")


@producer("firestore", JS)
def firestore(service: str, path: str, text: str) -> Iterator[Record]:
    """Collections, the fields written to them and by which kind of client."""
    clean = masked(path, text)
    if not re.search(r"firestore", clean, re.I):
        return
    sdk = "admin" if re.search(r"firebase-admin", clean) else "client"
    for m in finds(r"\bcollection\(\s*(?:\w+\s*,\s*)?['\"`]([\w/]+)['\"`]", clean):
        yield from resource("firestore-collection", m[1], service, path, text, m.start(), provider="firestore")
        tail = clean[m.end() : m.end() + 600]
        if w := re.search(r"(?:addDoc|setDoc|updateDoc|\.add|\.set|\.update)\s*\(", clean[max(0, m.start() - 80) : m.end() + 200]):
            for f in finds(r"(?m)(?:^|[{,])\s*(\w+)\s*:", block_from(tail, 0)):
                yield column(infra("firestore-collection", m[1]), f[1], path, sdk)
            del w


@producer("firestore-rules", r"\.rules$")
def firestore_rules(service: str, path: str, text: str) -> Iterator[Record]:
    """Fields that rules allow to be written, per collection."""
    clean = masked("x.ts", text)
    for m in finds(r"match\s+/(\w+)/\{", clean):
        body = block_from(clean, clean.find("}", m.end()) + 1)
        fields = {f for k in finds(r"hasOnly\(\s*\[([^\]]*)\]", body) for f in re.findall(r"['\"](\w+)['\"]", k[1])}
        if fields:
            yield {"kind": "guard", "id": infra("firestore-collection", m[1]), "name": ",".join(sorted(fields)), "path": path, "service": service}


@producer("mongoose", JS)
def mongoose(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    for m in finds(r"\bmodel(?:<[^>]*>)?\(\s*['\"`](\w+)['\"`](?:\s*,\s*(\w+))?(?:\s*,\s*['\"`](\w+)['\"`])?", clean):
        option = re.search(rf"{m[2]}\s*=\s*new\s+(?:\w+\.)?Schema\(.*?collection\s*:\s*['\"](\w+)", clean, re.S) if m[2] else None
        yield from resource("mongodb-collection", m[3] or (option and option[1]) or plural(m[1].lower()), service, path, text, m.start(), provider="mongodb")
    if re.search(r"['\"]mongodb['\"]", clean):
        for m in finds(r"\.collection(?:<[^>]*>)?\(\s*['\"`](\w+)['\"`]", clean):
            yield from resource("mongodb-collection", m[1], service, path, text, m.start(), provider="mongodb")


@producer("sqlalchemy", PY)
def sqlalchemy(service: str, path: str, text: str) -> Iterator[Record]:
    """Declarative models with their columns and foreign keys; flask models without a name take their class's."""
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    lines = text.split("\n")
    for c in (n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)):
        bases = {ast.unparse(b) for b in c.bases}
        flask = any(b.endswith("db.Model") for b in bases)
        name, cols, parents = None, [], []
        for n in c.body:
            target = n.targets[0] if isinstance(n, ast.Assign) else n.target if isinstance(n, ast.AnnAssign) else None
            value = getattr(n, "value", None)
            if not isinstance(target, ast.Name):
                continue
            if target.id == "__tablename__":
                name = value.value if isinstance(value, ast.Constant) and isinstance(value.value, str) else ""
            elif isinstance(value, ast.Call) and ast.unparse(value.func).split(".")[-1] in ("Column", "mapped_column"):
                first = value.args[0] if value.args else None
                cols.append(first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else target.id)
                parents += [a.args[0].value.split(".")[-2] for a in ast.walk(value) if isinstance(a, ast.Call) and ast.unparse(a.func).split(".")[-1] == "ForeignKey" and a.args and isinstance(a.args[0], ast.Constant) and "." in str(a.args[0].value)]
        if name is None and flask:
            name = snake(c.name)
        if name and (cols or flask):
            at = sum(len(x) + 1 for x in lines[: c.lineno - 1])
            yield from table(name, service, path, text, at, cols, CALL_SITE)
            for p in parents:
                yield from foreign(name, p, path)
            yield {"kind": "model", "service": service, "path": path, "name": c.name, "target": infra("sql-table", name)}
    for m in finds(r"\b(?:query|get|select)\(\s*([A-Z]\w+)|\b([A-Z]\w+)\.query\b", masked(path, text)):
        yield {"kind": "model-use", "service": service, "path": path, "name": m[1] or m[2], "line": text.count("\n", 0, m.start()) + 1, "confidence": CALL_SITE}


@producer("django", r"(?:^|/)models(?:/[^/]+)?\.py$|models/[^/]+\.py$")
def django(service: str, path: str, text: str) -> Iterator[Record]:
    parts = path.split("/")
    app = parts[parts.index("models") - 1] if "models" in parts[:-1] and parts.index("models") else parts[-2] if len(parts) > 1 else service
    clean = masked(path, text)
    for m in finds(r"(?m)^class\s+(\w+)\(([^)]*\bModel)\)\s*:", clean):
        rest = re.split(r"(?m)^\S", clean[m.end() :])[0]
        if re.search(r"abstract\s*=\s*True", rest):
            continue
        meta = re.search(r"db_table\s*=\s*['\"]([^'\"]+)", rest)
        name = meta[1] if meta else f"{app}_{m[1].lower()}"
        fields = list(finds(r"(?m)^\s{4}(\w+)\s*=\s*models\.(\w+)\(\s*(?:['\"]?([\w.]+)['\"]?)?", rest))
        yield from table(name, service, path, text, m.start(), [f[1] + ("_id" if f[2] in ("ForeignKey", "OneToOneField") else "") for f in fields if f[2] != "ManyToManyField"], CALL_SITE)
        for f in fields:
            if f[2] in ("ForeignKey", "OneToOneField") and f[3] and f[3] != "self":
                yield from foreign(name, f"{app}_{f[3].split('.')[-1].lower()}", path)


@producer("drizzle", JS)
def drizzle(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    names = {}
    for m in finds(r"(?:const|let)\s+(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\(\s*['\"`](\w+)['\"`]\s*,", clean):
        names[m[1]] = m[2]
    for m in finds(r"(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\(\s*['\"`](\w+)['\"`]\s*,", clean):
        body = block_from(clean, m.end())
        yield from table(m[2], service, path, text, m.start(), [c[2] or c[1] for c in finds(r"(?m)^\s*(\w+)\s*:\s*\w+\(\s*(?:['\"`](\w+)['\"`])?", body)])
        for r in finds(r"references\(\s*\(\)[^=]*=>\s*(\w+)\.", body):
            if r[1] in names:
                yield from foreign(m[2], names[r[1]], path)


@producer("prisma", r"\.prisma$")
def prisma(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked("x.ts", text)
    models = {m[1]: m for m in finds(r"\bmodel\s+(\w+)\s*\{([^}]*)\}", clean)}
    mapped = lambda n: (re.search(r'@@map\("([^"]+)"\)', models[n][2]) or [None, n])[1]
    for name, m in models.items():
        cols = []
        for f in finds(r"(?m)^\s*(\w+)\s+(\w+)(\[\])?\??(.*)$", m[2]):
            if f[2] in models:
                if "@relation" in f[4] and "fields:" in f[4]:
                    yield from foreign(mapped(name), mapped(f[2]), path)
            elif not f[1].startswith("@"):
                alias = re.search(r'@map\("([^"]+)"\)', f[4])
                cols.append(alias[1] if alias else f[1])
        yield from table(mapped(name), service, path, text, m.start(), cols)


@producer("active-record", r"(?:^|/)(?:schema\.rb|models/.*\.rb)$")
def active_record(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    if path.endswith("schema.rb"):
        for m in finds(r"create_table\s+\"(\w+)\".*?do\s*\|t\|(.*?)(?m:^\s*end)", clean, re.S):
            yield from table(m[1], service, path, text, m.start(), [c[1] for c in finds(r"t\.(?!index)\w+\s+\"(\w+)\"", m[2])])
        for m in finds(r"add_foreign_key\s+\"(\w+)\",\s*\"(\w+)\"", clean):
            yield from foreign(m[1], m[2], path)
    else:
        for m in finds(r"(?m)^\s*class\s+(\w+)\s*<\s*(?:ApplicationRecord|ActiveRecord::Base)", clean):
            own = re.search(r"self\.table_name\s*=\s*['\"](\w+)", clean)
            name = own[1] if own else plural(snake(m[1]))
            yield from resource("sql-table", name, service, path, text, m.start(), provider="sql")
            for b in finds(r"belongs_to\s+:(\w+)", clean):
                yield from foreign(name, plural(b[1]), path)


@producer("eloquent", r"\.php$")
def eloquent(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    for m in finds(r"Schema::(?:create|table)\(\s*['\"](\w+)['\"]", clean):
        body = block_from(clean, m.end())
        cols = [c[1] for c in finds(r"\$table->(?!foreign\b|index\b|unique\b|primary\b|drop)\w+\(\s*['\"](\w+)['\"]", body)]
        cols += ["id"] if "$table->id()" in body else []
        cols += ["created_at", "updated_at"] if "$table->timestamps()" in body else []
        yield from table(m[1], service, path, text, m.start(), cols)
        for f in finds(r"foreign\(\s*['\"]\w+['\"]\s*\)[^;]*?->on\(\s*['\"](\w+)|foreignId\(\s*['\"](\w+)_id['\"]\s*\)[^;]*?->constrained\(\s*(?:['\"](\w+)['\"])?", body):
            yield from foreign(m[1], f[1] or f[3] or plural(f[2]), path)
    for m in finds(r"class\s+(\w+)\s+extends\s+(?:Model|Authenticatable)\b", clean):
        own = re.search(r"\$table\s*=\s*['\"](\w+)", clean)
        yield from resource("sql-table", own[1] if own else plural(snake(m[1])), service, path, text, m.start(), provider="sql")


@producer("go-sql", GO)
def go_sql(service: str, path: str, text: str) -> Iterator[Record]:
    """Raw SQL in query calls, and structs of an object mapper."""
    clean = masked(path, text)
    for m in finds(r"\.(?:Query|QueryRow|Exec)(?:Context)?\(\s*(?:\w+\s*,\s*)?[`\"]([^`\"]+)[`\"]", clean):
        t = re.search(r"(?i)\b(?:from|into|update)\s+[\"`]?([\w.]+)", m[1])
        if t and not re.search(r"(?i)\bjoin\b", m[1]):
            yield from table(t[1].split(".")[-1].lower(), service, path, text, m.start(), columns_of(m[1]), CALL_SITE)
    if "gorm" in clean:
        for m in finds(r"type\s+(\w+)\s+struct\s*\{", clean):
            body = block_from(clean, m.end() - 1)
            if "gorm" in body:
                own = re.search(rf"func\s+\(\w*\s*\*?{m[1]}\)\s+TableName\(\)\s+string\s*\{{\s*return\s+\"(\w+)\"", clean)
                cols = []
                for f in finds(r"(?m)^\s*(\w+)\s+([\w.*\[\]]+)(?:\s+`([^`]*)`)?", body):
                    named = re.search(r"column:(\w+)", f[3] or "")
                    if f[1] != "gorm" and not f[2].startswith(("[]", "*")) and (f[2].islower() or "." in f[2]):
                        cols.append(named[1] if named else snake(f[1]))
                if "gorm.Model" in body:
                    cols += ["id", "created_at", "updated_at", "deleted_at"]
                yield from table(own[1] if own else plural(snake(m[1])), service, path, text, m.start(), cols)


@producer("ef-core", r"\.cs$")
def ef_core(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    for m in finds(r"DbSet<(\w+)>\s+(\w+)", clean):
        body = re.search(rf"class\s+{m[1]}\b[^{{]*", clean)
        cols = [c[1] for c in finds(r"public\s+(?:int|long|string|bool|decimal|double|float|Guid|DateTime|DateTimeOffset|byte\[\])\??\s+(\w+)\s*\{", block_from(clean, body.end()))] if body else []
        yield from table(m[2], service, path, text, m.start(), cols)


@producer("zod", JS)
def zod(service: str, path: str, text: str) -> Iterator[Record]:
    clean = masked(path, text)
    for m in finds(r"(?:const|let)\s+(\w+)\s*=\s*z\.object\(\s*\{", clean):
        name = infra("zod-schema", m[1])
        yield node("InfraNode", name, m[1], service, path, kind="zod-schema", provider="zod")
        yield edge("CONTAINS", file_node(service, path), name, path, STRUCTURAL, text, m.start())
        for f in finds(r"(?m)(?:^|[{,])\s*(\w+)\s*:\s*z\.", "{" + block_from(clean, m.end() - 1)):
            yield column(name, f[1], path)


@producer("hosts", _CODE)
def hosts(service: str, path: str, text: str) -> Iterator[Record]:
    """Literals that only look like internal hosts; graded far below the floor."""
    for m in finds(r"['\"]([a-z][a-z0-9-]*\.(?:internal|local|svc(?:\.cluster\.local)?))['\"]", masked(path, text)):
        yield {"kind": "url", "service": service, "path": path, "name": m[1], "line": text.count("\n", 0, m.start()) + 1, "confidence": HOST_SHAPE, "source": file_node(service, path)}
