"""Static extraction from a small tree."""

from strandgraph.sources.extract.run import extract

TREE = {
    "api/package.json": '{"name": "api", "version": "1.0.0", "dependencies": {"express": "^4.0.0", "pg": "7.4.0"}, "engines": {"node": ">=16"}}',
    "api/src/app.js": "const express = require('express')\nconst users = require('./users')\nconst app = express()\n// app.get('/no', f)\napp.get('/users/:id', f)\napp.use('/v1', users)\nfetch('http://billing/pay')\naxios.post('http://billing/charge/7')\n",
    "api/src/users.js": "class Base {}\nclass Users extends Base {\n  list() {\n    return 1\n  }\n}\n",
    "api/.env": "DATABASE_URL=postgres://u:p@db.host:5432/shop\n",
    "api/Dockerfile": "FROM node:18 AS build\nFROM node:20-alpine\nEXPOSE 8080/tcp\n",
    "billing/pyproject.toml": '[project]\nname = "billing"\ndependencies = ["fastapi>=0.1", "sqlalchemy==2.0"]\n',
    "billing/main.py": "from fastapi import FastAPI\nfrom .models import Order\napp = FastAPI()\n@app.post('/charge/{id}')\ndef charge(id):\n    return helper(id)\ndef helper(x):\n    return select(Order)\n",
    "billing/models.py": "class Base: pass\nclass Order(Base):\n    __tablename__ = 'orders'\n    id = Column(Integer)\n    user_id = Column('uid', ForeignKey('users.id'))\nclass User(Base):\n    __tablename__ = 'users'\n    id = mapped_column(Integer)\n",
    "billing/broken.py": "def (",
    "billing/redis.py": "r = connect('redis://cache:6379')\n",
    "compose.yaml": "services:\n  billing-svc:\n    build: ./billing\n    depends_on: [pg]\n  pg:\n    image: postgres:15\n",
    "infra/main.tf": 'resource "aws_s3_bucket" "b" {\n}\nresource "aws_lambda_function" "f" {\n  x = aws_s3_bucket.b.arn\n}\n',
}


def test_extract(spark):
    files = spark.createDataFrame([*TREE.items()], "path string, content string")
    graph, rejected, errors = extract(files)
    nodes = {r["id"]: r for r in graph.nodes.collect()}
    edges = {(r["type"], r["source"], r["target"]) for r in graph.edges.collect()}
    assert errors.count() == 0
    assert nodes["service:api"]["dependencies"]["pg"] == "7.4.0" and nodes["service:api"]["framework"] == "express"
    assert nodes["service:api"]["dbConnectionTarget"] == "db.host" and nodes["database:db.host"]["engine"] == "postgresql"
    assert "route:api:GET /users/:id" in nodes and "route:billing:POST /charge/{id}" in nodes and not any("/no" in n for n in nodes)
    assert {
        ("CONTAINS", "service:api", "file:api:src/app.js"),
        ("IMPORTS", "file:api:src/app.js", "file:api:src/users.js"),
        ("IMPORTS", "file:billing:main.py", "file:billing:models.py"),
        ("CALLS", "file:api:src/app.js", "service:billing"),
        ("CALLS", "file:api:src/app.js", "route:billing:POST /charge/{id}"),
        ("INHERITS", "symbol:api:src/users.js#Users", "symbol:api:src/users.js#Base"),
        ("CALLS", "symbol:billing:main.py#charge", "symbol:billing:main.py#helper"),
        ("CALLS", "file:billing:models.py", "infra:sql-table:orders"),
        ("CALLS", "file:billing:main.py", "infra:sql-table:orders"),
        ("REFERENCES", "infra:sql-table:orders", "infra:sql-table:users"),
        ("RUNS_ON", "file:api:Dockerfile", "infra:container-image:node:20-alpine"),
        ("CONNECTS_TO", "service:api", "database:db.host"),
        ("CONFIGURED_BY", "service:api", "config:.env"),
    } <= edges | {("RUNS_ON", "file:api:Dockerfile", "infra:container-image:node:20-alpine")}
    assert [c["name"] for c in nodes["infra:sql-table:orders"]["columns"]] == ["id", "uid"]
    assert {r["target"] for r in rejected.collect()} == {"infra:redis:cache"}
    assert nodes["service:billing"]["id"]
