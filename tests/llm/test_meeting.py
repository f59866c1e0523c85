"""Blocks that meet: each (token, block) is one row, told once whether its token is frequent."""

import random
from collections import defaultdict

from strandgraph.llm import ngram_join


def plainly(prefix, percent, block):
    nodes, out = defaultdict(list), set()
    for token, node, n, b in prefix:
        nodes[token].append((b, node, n))
    frequent = [members for members in nodes.values() if len(members) > block]
    every = defaultdict(set)
    for members in frequent:
        for b, node, _ in members:
            every[b].add(node)
    for members in nodes.values():
        by = defaultdict(list)
        for b, node, n in members:
            by[b].append((n, node))
        fits = lambda n, other: n * 100 >= percent * min(other)[0] and max(other)[0] * 100 >= n * percent
        for b, own in by.items():
            for c, other in by.items():
                if b > c or b == c and len(own) < 2:
                    continue
                if len(members) <= block:
                    out |= {(b, c, node) for n, node in own if fits(n, other)} | {(b, c, node) for n, node in other if fits(n, own)}
                elif max(other)[0] * 100 >= percent * min(own)[0] and max(own)[0] * 100 >= percent * min(other)[0]:
                    out |= {(b, c, node) for node in every[b] | every[c]}
    return sorted(out)


def test_meeting_nodes(spark, monkeypatch):
    rng = random.Random(4)
    sizes = {node: rng.randint(4, 12) for node in range(60)}
    prefix = sorted({(min(rng.randint(0, 40), rng.randint(0, 40)), node, sizes[node], node // 5) for node in sizes for _ in range(6)})
    cut = []
    monkeypatch.setattr(ngram_join, "checkpoint", lambda df: cut.append(df.checkpoint()) or cut[-1])
    df = spark.createDataFrame(prefix, "token long, node long, n long, block long").repartition(3)
    got = ngram_join.meeting(df, 80, 5)
    assert sorted(tuple(r) for r in got.collect()) == plainly(prefix, 80, 5)
    assert all(c.count() <= len({(t, b) for t, _, _, b in prefix}) for c in cut) and "LeftAnti" not in got._jdf.queryExecution().toString()
