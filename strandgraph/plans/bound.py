"""A deterministic topology over the driver's tables.

Customers and suppliers are services, nations databases, parts tables, regions
frontiers; orders are the calls between them.  The flat node and edge relations
are plain SQL that Spark and other engines read alike, so a query and its twin
start from the same facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, materialise
from ..schema import EDGES, NODES, conform, struct

NOW = "2001-11-04 00:00:00"
STALE_BEFORE = "1998-01-01 00:00:00"

NODE_SQL = """
select 'service:customer-' || cast(c_custkey as string) as id, 'ServiceNode' as type, 'customer-' || cast(c_custkey as string) as name,
       case when c_custkey % 7 = 0 then null else c_mktsegment end as owner, cast(null as string) as engine, cast(null as string) as engineVersion,
       cast(null as string) as host, cast(null as string) as kind, 'static' as discoveredVia,
       case c_custkey % 4 when 0 then '>=16' when 1 then '>=18.17.0' when 2 then '^20' end as nodeEngine,
       case when c_custkey % 6 = 0 then 'nation-' || cast(c_nationkey as string) || '.db:5432' end as dbConnectionTarget,
       cast(null as string) as service, cast(null as string) as path, c_custkey as k
from {customer}
union all
select 'service:supplier-' || cast(s_suppkey as string), 'ServiceNode', 'supplier-' || cast(s_suppkey as string), 'supply', null, null, null, null, 'static', null, null, null, null, s_suppkey from {supplier}
union all
select 'file:supplier-' || cast(s_suppkey as string) || ':src/app.py', 'FileNode', 'app.py', null, null, null, null, null, 'static', null, null, 'supplier-' || cast(s_suppkey as string), 'src/app.py', s_suppkey from {supplier} where s_suppkey % 2 = 0
union all
select 'database:nation-' || cast(n_nationkey as string) || '.db', 'DatabaseNode', 'nation-' || cast(n_nationkey as string), null,
       case n_nationkey % 3 when 0 then 'postgresql' when 1 then 'mysql' else 'mongodb' end,
       case n_nationkey % 5 when 0 then '13' when 1 then '14' when 2 then '15.2' when 3 then '8' else '7' end,
       'nation-' || cast(n_nationkey as string) || '.db', null, case when n_nationkey % 4 = 0 then 'merged' else 'static' end, null, null, null, null, n_nationkey from {nation}
union all
select 'config:customer-' || cast(c_custkey as string) || '.env', 'ConfigNode', 'customer-' || cast(c_custkey as string) || '.env', null, null, null, null, null, 'static', null, null, null, 'customer-' || cast(c_custkey as string) || '.env', c_custkey from {customer} where c_custkey % 2 = 0
union all
select 'infra:sql-table:part-' || cast(p_partkey as string), 'InfraNode', 'part-' || cast(p_partkey as string), null, null, null, null,
       case when p_partkey % 50 = 1 then 'firestore-collection' else 'sql-table' end, 'otel', null, null, null, null, p_partkey from {part}
union all
select 'frontier:region-' || cast(r_regionkey as string), 'FrontierNode', 'region-' || cast(r_regionkey as string), null, null, null, case when r_regionkey = 1 then 'supplier-3' else 'region-' || cast(r_regionkey as string) end, null, 'otel', null, null, null, null, r_regionkey from {region}
"""

_OBSERVED_AS = f"case when max(l_shipdate) < timestamp '{STALE_BEFORE}' then 'STALE' else 'OBSERVED' end"
EDGE_SQL = f"""
select 'CALLS:OBSERVED:service:customer-' || cast(o_custkey as string) || '->service:supplier-' || cast(l_suppkey as string) as id,
       'service:customer-' || cast(o_custkey as string) as source, 'service:supplier-' || cast(l_suppkey as string) as target, 'CALLS' as type,
       {_OBSERVED_AS} as provenance, cast(null as double) as confidence, max(l_shipdate) as lastObserved, cast(count(*) as bigint) as spanCount,
       cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as errorCount, cast(max(l_quantity) * 40 as double) as p95, cast(null as string) as hostSource
from {{orders}} join {{lineitem}} on o_orderkey = l_orderkey group by o_custkey, l_suppkey
union all
select 'CALLS:OBSERVED:' || case when l_suppkey % 2 = 0 then 'file:supplier-' || cast(l_suppkey as string) || ':src/app.py' else 'service:supplier-' || cast(l_suppkey as string) end || '->infra:sql-table:part-' || cast(l_partkey as string),
       case when l_suppkey % 2 = 0 then 'file:supplier-' || cast(l_suppkey as string) || ':src/app.py' else 'service:supplier-' || cast(l_suppkey as string) end,
       'infra:sql-table:part-' || cast(l_partkey as string), 'CALLS', 'OBSERVED', null, max(l_shipdate), cast(count(*) as bigint),
       cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint), cast(max(l_quantity) * 10 as double), null
from {{lineitem}} group by l_suppkey, l_partkey
union all
select 'CONNECTS_TO:service:customer-' || cast(c_custkey as string) || '->database:nation-' || cast(c_nationkey as string) || '.db', 'service:customer-' || cast(c_custkey as string),
       'database:nation-' || cast(c_nationkey as string) || '.db', 'CONNECTS_TO', 'EXTRACTED', 0.85, null, null, null, null, case when c_custkey % 2 = 0 then 'literal' else 'config' end from {{customer}}
union all
select 'CONNECTS_TO:OBSERVED:service:customer-' || cast(c_custkey as string) || '->database:nation-' || cast(case when c_custkey % 6 = 0 then (c_nationkey + 3) % 25 else c_nationkey end as string) || '.db', 'service:customer-' || cast(c_custkey as string),
       'database:nation-' || cast(case when c_custkey % 6 = 0 then (c_nationkey + 3) % 25 else c_nationkey end as string) || '.db', 'CONNECTS_TO', 'OBSERVED', null, timestamp '2001-11-03 12:00:00', cast(1 + c_custkey % 120 as bigint), cast(c_custkey % 7 as bigint), null, null
from {{customer}} where c_custkey % 3 = 0
union all
select 'CONFIGURED_BY:service:customer-' || cast(c_custkey as string) || '->config:customer-' || cast(c_custkey as string) || '.env', 'service:customer-' || cast(c_custkey as string), 'config:customer-' || cast(c_custkey as string) || '.env', 'CONFIGURED_BY', 'EXTRACTED', 0.85, null, null, null, null, null from {{customer}} where c_custkey % 2 = 0
union all
select 'DEPENDS_ON:database:nation-' || cast(n_nationkey as string) || '.db->frontier:region-' || cast(n_regionkey as string), 'database:nation-' || cast(n_nationkey as string) || '.db', 'frontier:region-' || cast(n_regionkey as string), 'DEPENDS_ON', 'EXTRACTED', 0.7, null, null, null, null, null from {{nation}}
union all
select 'CALLS:service:customer-' || cast(c_custkey as string) || '->service:supplier-' || cast(c_custkey * 7 % 10 + 1 as string), 'service:customer-' || cast(c_custkey as string), 'service:supplier-' || cast(c_custkey * 7 % 10 + 1 as string), 'CALLS', 'EXTRACTED', 0.85, null, null, null, null, null from {{customer}} where c_custkey % 5 = 0
union all
select 'CONTAINS:service:supplier-' || cast(s_suppkey as string) || '->file:supplier-' || cast(s_suppkey as string) || ':src/app.py', 'service:supplier-' || cast(s_suppkey as string), 'file:supplier-' || cast(s_suppkey as string) || ':src/app.py', 'CONTAINS', 'EXTRACTED', 0.85, null, null, null, null, null from {{supplier}} where s_suppkey % 2 = 0
"""

FLAT_EDGES = struct("id string, source string, target string, type string, provenance string, confidence double, lastObserved timestamp, spanCount bigint, errorCount bigint, p95 double, hostSource string")

#: Declared dependencies: (service, package, version).
DEPENDENCY_SQL = """
select 'service:customer-' || cast(c_custkey as string) as service, p.package as package,
       case p.package when 'pg' then case when c_custkey % 2 = 0 then '^7.4.0' else '8.11.0' end when 'request' then '2.88.0'
                      when 'mysql2' then case when c_custkey % 2 = 0 then '~2.3.0' else '3.6.0' end when 'next' then '14.1.0'
                      when 'react' then case when c_custkey % 5 = 0 then '17.0.2' else '18.2.0' end
                      when 'mongoose' then case when c_custkey % 2 = 0 then '6.12.0' else '7.5.0' end else '2.1.0' end as version
from {customer} join (select 0 as m, 'pg' as package union all select 0, 'request' union all select 1, 'mysql2' union all select 1, 'next' union all select 1, 'react' union all select 2, 'mongoose' union all select 2, 'vitest') p on c_custkey % 3 = p.m
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _sql(spark: SparkSession, text: str, t: dict[str, DataFrame]) -> DataFrame:
    return spark.sql(text, **{n: df for n, df in t.items() if "{" + n + "}" in text})


def flat_edges(spark: SparkSession, t: dict[str, DataFrame], provenance: str | None = None) -> DataFrame:
    """The edge relation, of one ``provenance`` only if it is given: then parts of it that never have that one are not made."""
    if provenance is None:
        return _sql(spark, EDGE_SQL, t)
    parts = [p for p in EDGE_SQL.split("union all") if f"'{provenance}'" in p]
    # The first part of the whole relation names its columns.
    return conform(_sql(spark, "union all".join(parts), t).toDF(*FLAT_EDGES.names), FLAT_EDGES).filter(F.col("provenance") == provenance)


def graph(spark: SparkSession, sf_dir: str, t: dict[str, DataFrame] | None = None, provenance: str | None = None) -> Graph:
    """The topology as a Graph, with the edges of one ``provenance`` only if it is given."""
    t = t or tables(spark, sf_dir)
    deps = _sql(spark, DEPENDENCY_SQL, t).groupBy(F.col("service").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("package", "version"))).alias("dependencies"))
    nodes = _sql(spark, NODE_SQL, t).join(deps, "id", "left")
    column = lambda name, provenances, confidence, sdk: F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, provenances)).alias("provenances"), F.lit(confidence).alias("confidence"), (F.array(*map(F.lit, sdk)) if sdk else F.lit(None).cast("array<string>")).alias("sdkWrites"))
    is_part = F.col("type") == "InfraNode"
    columns = F.when(is_part & (F.col("k") % 50 == 0), F.array(column("id", ["EXTRACTED", "OBSERVED"], 0.85, []), column("total", ["EXTRACTED"], 0.85, []), column("amount", ["OBSERVED"], 0.9, [])))
    columns = columns.when(is_part & (F.col("k") % 50 == 1), F.array(column("a", ["EXTRACTED"], 0.85, ["client"]), column("b", ["EXTRACTED"], 0.85, ["admin", "client"]), column("c", ["EXTRACTED"], 0.85, ["admin"])))
    aliases = F.when(F.col("id").startswith("service:supplier-"), F.array(F.concat(F.lit("sup"), F.col("k").cast("string"))))
    nodes = nodes.withColumns({"columns": columns, "guardedFields": F.when(is_part & (F.col("k") % 50 == 1), F.array(F.lit("a"))), "aliases": aliases})
    signal = F.when(
        F.col("spanCount").isNotNull(),
        F.struct("spanCount", "errorCount", F.lit(0.0).alias("lastObservedAgeMs"), F.when(F.col("p95").isNotNull(), F.struct((F.col("p95") / 2).alias("p50"), F.col("p95"))).alias("latencyMs"), F.lit(None).cast("map<int,bigint>").alias("latencyHist"), F.lit(None).cast("boolean").alias("anomalous")),
    )
    evidence = F.when(F.col("hostSource").isNotNull(), F.struct(F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("pathTemplate"), "hostSource"))
    edges = flat_edges(spark, t, provenance).withColumns({"signal": signal, "callCount": F.col("spanCount"), "evidence": evidence, "grain": F.when(F.col("source").startswith("file:"), "file").otherwise("service")})
    # Folded once: what a query asks of the graph does not scan and join the fact tables again.
    return Graph(materialise(conform(nodes, NODES)), materialise(conform(edges, EDGES)), NOW)
