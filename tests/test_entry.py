"""Registered queries, and those of the engine against their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SOME = ("blast_radius_multi", "edge_observed_upsert", "edge_confidence", "transitive_dependencies", "observed_summary", "node_context", "expand_up", "relate", "failing_chain", "load_origin", "latency_quantile", "counter_delta", "route_normalise", "symbol_range_join", "divergence_ranked", "policy_compatibility", "stale_events", "trace_stitch", "incident_dedupe", "burst_4xx", "graph_diff_edges", "snapshot_merge", "vector_top_k", "ask_tokens", "ask_intent", "ask_entities", "span_dispatch", "sql_table", "column_fold", "connector_rest", "connector_insights", "incident_ledger", "unrouted_services", "extract_edges")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_registry():
    import __spark_entry__ as e

    names = e.queries()
    assert len(names) > 60 and {*e.oracle_sql()} <= {*names}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sql, name):
    import __spark_entry__ as e

    value = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    df = e.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(value(r[c]) for c in columns)) for r in df.collect())
    done = sql.execute(e.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(value(r[names.index(c)]) for c in columns)) for r in done.fetchall())
    assert got == want
