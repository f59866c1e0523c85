"""Extraction and embedding of what changed."""

import json

from pyspark.sql import functions as F

from strandgraph.engine import Engine
from strandgraph.operators import search
from strandgraph.operators.embeddings import EmbeddingCache
from strandgraph.operators.graph import Graph
from strandgraph.schema import EDGES, NODES, empty, table
from strandgraph.sources.extract import run
from strandgraph.sources.extract.incremental import SourceTree

TREE = {
    "shop/package.json": json.dumps({"name": "shop", "version": "1.0.0", "dependencies": {"express": "^4.0.0"}}),
    "shop/src/app.js": "const express = require('express')\nconst u = require('./users')\nconst app = express()\napp.get('/v/:id', u)\nfetch('http://pay/charge')\n",
    "shop/src/users.js": "class Base {}\nclass Users extends Base {\n  list() {\n    return 1\n  }\n}\n",
    "shop/lib/tool.py": "def helper():\n    return 1\n\ndef main():\n    return helper()\n",
    "pay/package.json": json.dumps({"name": "pay", "version": "2.0.0"}),
    "pay/src/main.js": "fetch('http://shop/v/1')\n",
}


def frame(spark, tree):
    return spark.createDataFrame(sorted(tree.items()), "path string, content string")


def told(graph):
    node = sorted((r["id"], r["version"] or "") for r in graph.nodes.collect())
    return node, sorted((r["id"], r["confidence"]) for r in graph.edges.collect())


def test_updates_equal_full_runs(spark, tmp_path):
    kept = SourceTree(spark, str(tmp_path / "tree"), parts=4)
    tree = dict(TREE)
    done = kept.update(frame(spark, tree))
    assert (done.parsed, done.removed) == (6, 0)
    whole = told(run.extract(frame(spark, tree))[0])
    assert told(kept.graph()[0]) == whole and whole[1]

    # One file changes, one goes, one loses all it told of.
    tree["shop/src/users.js"] = "class Base {}\nclass People extends Base {\n}\n"
    tree["pay/src/main.js"] = "\n"
    del tree["shop/lib/tool.py"]
    done = kept.update(frame(spark, tree))
    assert (done.parsed, done.removed) == (2, 1)
    assert told(kept.graph()[0]) == told(run.extract(frame(spark, tree))[0])

    # A manifest of its own makes a folder another service: its files tell of that one now.
    tree["shop/src/package.json"] = json.dumps({"name": "front", "version": "1.0.0"})
    done = kept.update(frame(spark, tree))
    assert (done.parsed, done.removed) == (3, 2)
    assert told(kept.graph()[0]) == told(run.extract(frame(spark, tree))[0])
    before = kept.table.current()
    assert kept.update(frame(spark, tree)).parsed == 0 and kept.table.current() == before


def test_embeddings_of_changed_nodes(spark, tmp_path):
    nodes = [{"id": f"service:s{i}", "type": "ServiceNode", "name": f"s{i}", "owner": "team red" if i % 2 else "team blue"} for i in range(8)] + [{"id": "frontier:x", "type": "FrontierNode", "host": "red"}]
    asked = []

    def embed(text):
        asked.append(1)
        return search.hashed_embedding(text, 128)

    cache = EmbeddingCache(spark, str(tmp_path / "v"), embed, parts=2)
    g = Graph(table(spark, NODES, nodes), empty(spark, EDGES))
    assert cache.refresh(g) == 8 and cache.refresh(g) == 0
    nodes[0]["owner"], nodes[1]["owner"] = "team green", "team green"
    del nodes[7]
    g = Graph(table(spark, NODES, nodes), g.edges)
    assert cache.refresh(g) == 2
    rows = {r["id"]: r["version"] for r in cache.vectors().collect()}
    assert {*rows} == {f"service:s{i}" for i in range(7)} and [rows[f"service:s{i}"] for i in range(4)] == [2, 2, 0, 0]
    found = Engine(spark, {"default": g}).search("team green", limit=2, vectors=cache).collect()
    assert {r["id"] for r in found} == {"service:s0", "service:s1"} and all(r["score"] > 0 for r in found)
    assert Engine(spark, {"default": g}).search("S3").select("id").first()["id"] == "service:s3"
    assert cache.vectors().filter(F.size("embedding") != 128).count() == 0
