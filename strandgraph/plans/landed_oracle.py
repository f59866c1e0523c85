"""SQL twins of ``landed``: what the landed inputs say, from the tables they were made of."""

from __future__ import annotations

from .oracle import _GRADE, G

_E = "select *, event_id % 10 as m, 'customer-' || (user_id % 100) as c from events"
_KIND = "case when m in (0, 6, 7, 9) then 3 when m = 1 then 4 when m = 2 then 5 else 2 end"
_WHO = "case when m = 9 then 'supplier-' || (event_id % 20) else c end"

#: Calls of every span: source, target and whether it failed.
_CALLS = f"""with e as ({_E}), known as (select 'supplier-' || s_suppkey as s, s_suppkey % 2 = 0 as even from supplier),
calls as (
  select 'CONNECTS_TO' as type, 'service:' || c as source, 'database:nation-' || (event_id % 25) || '.db' as target, false as bad from e where m = 0
  union all select 'CALLS', 'service:' || c, 'infra:sql-table:t_' || (event_id % 7), false from e where m = 0
  union all select 'PUBLISHES_TO', 'service:' || c, 'infra:kafka-topic:topic-' || (event_id % 5), false from e where m = 1
  union all select 'CONSUMES_FROM', 'service:' || c, 'infra:kafka-topic:topic-' || (event_id % 5), false from e where m = 2
  union all select 'CONTAINS', 'service:' || c, 'graphql:' || c || ':query op' || (event_id % 4), false from e where m = 3
  union all select 'CONTAINS', 'service:' || c, 'grpc:shop.Cart/m' || (event_id % 3), false from e where m = 4
  union all select 'CONNECTS_TO', 'service:' || c, 'ws:' || c || ':/ws' || (event_id % 3), false from e where m = 5
  union all select 'CALLS', 'service:' || c, case when k.s is null then 'frontier:sup' || (event_id % 60) else 'service:' || k.s end, event_type = 'error' from e left join known k on k.s = 'supplier-' || (event_id % 60) where m = 6
  union all select 'CALLS', 'service:' || c, 'frontier:h' || (event_id % 9), false from e where m = 7
  union all select 'CONTAINS', 'service:' || c, 'route:' || c || ':POST /pay/:id', false from e where m = 8 and user_id % 100 % 2 = 0 and exists (select 1 from customer where c_custkey = user_id % 100)
  union all select 'CALLS', 'file:supplier-' || (event_id % 20) || ':' || case when coalesce(k.even, false) then 'src/app.py' else 'srv/src/app.py' end, 'service:customer-1', false from e left join known k on k.s = 'supplier-' || (event_id % 20) where m = 9),
sums as (select type, source, target, count(*) as n, count(*) filter (bad) as bad from calls group by all),
sites as (select distinct source as file, 'service:' || split_part(source, ':', 2) as svc from calls where source like 'file:%')"""

_EDGES = _CALLS + """
select type || ':OBSERVED:' || source || '->' || target as id, 'OBSERVED' as provenance, n::bigint as "callCount", bad::bigint as "errorCount" from sums
union all select 'CONTAINS:OBSERVED:' || svc || '->' || file, 'OBSERVED', null, null from sites"""


def _signals(kind: str, name: str, failed: str, rows: str, where: str = "true") -> str:
    return f"""with l as (select *, case when event_type = 'error' then 500 when event_id % 7 = 0 then 404 else 200 end as status, strftime(ts, '%Y-%m-%dT%H:%M:%S') as stamp, event_id as n from {rows})
      select {kind} as "targetKind", {name} as "targetName", count(*) as "callCount", count(*) filter ({failed}) as "errorCount", max(stamp) as "lastObservedIso" from l where {where} group by 1, 2"""


_STATUS = "case when event_type = 'error' then 500 when event_id % 7 = 0 then 404 else 200 end"

LANDED_SQL: dict[str, str] = {
    "otlp_spans": f"""with e as ({_E}) select {_WHO} as service, 'unknown' as env, (event_id % 500)::varchar as "traceId", event_id::varchar as "spanId", ({_KIND})::int as kind, (event_id * 1000)::bigint as "durationNanos",
      case when m = 0 then 'postgresql' end as "dbSystem", case when m = 0 then 't_' || (event_id % 7) end as "dbTable", case when m = 0 then 'id,c' || (event_id % 3) || ',k' end as columns, case when m in (1, 2) then 'topic-' || (event_id % 5) end as "messagingDestination",
      case when m = 3 then 'op' || (event_id % 4) end as "graphqlOperationName", case when m = 4 then 'm' || (event_id % 3) end as "rpcMethod", case when m = 5 then '/ws' || (event_id % 3) end as "websocketChannel", case when m = 8 then '/pay/{{id}}' end as "httpRoute" from e""",
    "span_nodes": _CALLS + f""", made as (
      select 'service:' || s as id, 'ServiceNode' as type, s as name, null as service, null as engine, null as kind from (select distinct {_WHO} as s from e)
      union select 'database:nation-' || (event_id % 25) || '.db', 'DatabaseNode', 'nation-' || (event_id % 25) || '.db', null, 'postgresql', null from e where m = 0
      union select 'infra:sql-table:t_' || (event_id % 7), 'InfraNode', 't_' || (event_id % 7), null, null, 'sql-table' from e where m = 0
      union select 'infra:kafka-topic:topic-' || (event_id % 5), 'InfraNode', 'topic-' || (event_id % 5), null, null, 'kafka-topic' from e where m in (1, 2)
      union select 'graphql:' || c || ':query op' || (event_id % 4), 'GraphQLOperationNode', 'op' || (event_id % 4), c, null, null from e where m = 3
      union select 'grpc:shop.Cart/m' || (event_id % 3), 'GrpcMethodNode', 'm' || (event_id % 3), null, null, null from e where m = 4
      union select 'ws:' || c || ':/ws' || (event_id % 3), 'WebSocketChannelNode', '/ws' || (event_id % 3), c, null, null from e where m = 5
      union select target, 'FrontierNode', substr(target, 10), null, null, null from calls where target like 'frontier:%'
      union select file, 'FileNode', 'app.py', split_part(file, ':', 2), null, null from sites)
      select * from made where id not in (select 'service:customer-' || c_custkey from customer union all select 'service:supplier-' || s_suppkey from supplier union all select 'file:supplier-' || s_suppkey || ':src/app.py' from supplier where s_suppkey % 2 = 0 union all select 'database:nation-' || n_nationkey || '.db' from nation)""",
    "span_edges": _EDGES,
    "stream_edges": _EDGES,
    "span_routes": _CALLS + f""" select source, target, n::bigint as "callCount", {_GRADE.format(n='n', e='bad')} as confidence from sums where target like 'route:%'""",
    "span_columns": f"""with e as ({_E}) select distinct 'infra:sql-table:t_' || (event_id % 7) as id, unnest(['id', 'c' || (event_id % 3), 'k']) as name, 'OBSERVED' as provenances, 0.9::double as confidence from e where m = 0""",
    "span_bursts": """with e as (select event_id, 'customer-' || (user_id % 2) as c from events where event_id % 10 = 7), a as (select *, event_id % 9 as p, case when event_id - lag(event_id) over (partition by c, event_id % 9 order by event_id) > 600 then 1 else 0 end as fresh from e),
      s as (select *, sum(fresh) over (partition by c, p order by event_id rows unbounded preceding) as session from a), b as (select *, (row_number() over (partition by c, p, session order by event_id) + 4) // 5 as block from s)
      select (max(event_id) % 500) || ':' || max(event_id) as id, c as service, '5 consecutive HTTP 404 responses to h' || p as "errorMessage", 5::int as "incidentCount", 404::int as "httpStatusCode", 'service:' || c as "affectedNode" from b group by c, p, session, block having count(*) = 5""",
    "connector_rest": _signals("case when n % 3 = 0 then 'rpc' else 'table' end", "case when n % 3 = 0 then 'f' || (n % 4) else 't' || (n % 5) end", "status >= 500", "events", "n % 3 < 2"),
    "connector_insights": f"""with l as (select event_id as n, {_STATUS} as status, strftime(ts, '%Y-%m-%dT%H:%M:%S') as stamp from events), t as (select *, unnest(case when n % 3 > 0 then ['a' || (n % 4), 'b' || (n % 3)] else ['q' || (n % 2)] end) as t from l)
      select 'table' as "targetKind", t as "targetName", sum(case when n % 5 > 0 then n % 5 else 1 end)::bigint as "callCount", sum(case when status = 500 then 1 else 0 end)::bigint as "errorCount", max(stamp) as "lastObservedIso" from t group by 2""",
    "connector_routes": _signals("case when n % 4 > 0 and n % 2 = 1 then 'route' else 'unmatched' end", "case when n % 4 > 0 and n % 2 = 1 then 'route:customer-2:POST /pay/:id' else 'unmatched' end", "status >= 400", "events"),
    "connector_flows": _signals("'service'", "'peer-' || (n % 6)", "n % 8 = 0", "events", "n % 3 > 0"),
    "connector_cloud": f"""select 'service' as "targetKind", 'svc-' || (event_id % 6) as "targetName", case when event_id % 2 = 0 then 'GET' else 'POST' end as method, '/p/' || (event_id % 3) as path, count(*) as "callCount", count(*) filter ({_STATUS} >= 500) as "errorCount" from events where event_id % 5 > 0 group by 2, 3, 4""",
    "connector_workers": f"""select 'service' as "targetKind", 'w-' || (event_id % 3) as "targetName", 'GET' as method, '/k/' || (event_id % 2) as path, count(*) as "callCount", count(*) filter ({_STATUS} >= 500) as "errorCount" from events where event_id % 4 > 0 group by 2, 4""",
    "connector_builds": """select 'build:' || event_id as id, 'app-' || (event_id % 4) as service, case when event_id % 3 = 1 then 'EAS_BUILD_FAILED' end as "errorType", case when event_id % 2 = 0 then 'no' else 'build failed' end as "errorMessage", 'service:app-' || (event_id % 4) as "affectedNode" from events where event_type = 'error' and event_id % 3 > 0""",
    "connector_poll": """with f as (select event_id % 30 as s, count(*) as n, count(*) filter (event_id % 8 = 0) as bad from events group by 1)
      select case when s_suppkey is null then 'unresolved:Supplier-' || s else 'CALLS:OBSERVED:service:gateway->service:supplier-' || s end as id, n::bigint as "callCount", bad::bigint as "errorCount" from f left join supplier on s_suppkey = s""",
    "snapshot_round_trip": G + " select 'node' as kind, type, count(*) as n from nodes group by type union all select 'edge', type, count(*) from raw_edges where type <> 'CONTAINS' group by type",
    "incident_ledger": """select event_id::varchar as id, 'service:customer-' || (user_id % 50) as "affectedNode" from events where event_type = 'error' order by event_id % 2 desc, event_id limit 200""",
    "stale_ledger": G + """ select id as "edgeId", type as "edgeType" from raw_edges where type = 'CONNECTS_TO' and provenance = 'OBSERVED' order by id desc limit 50""",
    "unrouted_services": f"""with e as ({_E}) select {_WHO} as service, count(*) as n from e where {_WHO} not in (select 'customer-' || c_custkey from customer) group by 1""",
    "extract_services": "select 'sup-' || s_suppkey as name, 'sup-' || s_suppkey as directory from supplier",
    "extract_nodes": """select 'service:sup-' || s_suppkey as id, 'ServiceNode' as type, 'express' as framework, '1.0.' || (s_suppkey % 7) as version, '8.' || (s_suppkey % 5) || '.0' as pg, null as engine from supplier
      union all select 'route:sup-' || s_suppkey || ':GET /v' || (s_suppkey % 3) || '/:id', 'RouteNode', 'express', null, null, null from supplier
      union all select distinct 'database:db' || (s_suppkey % 4) || '.host', 'DatabaseNode', null, null, null, 'postgresql' from supplier
      union all select 'file:sup-' || s_suppkey || ':src/' || f, 'FileNode', null, null, null, null from supplier, (values ('app.js'), ('users.js')) v(f)""",
    "extract_edges": """with s as (select 'sup-' || s_suppkey as s, s_suppkey as k from supplier)
      select 'IMPORTS' as type, 'file:' || s || ':src/app.js' as source, 'file:' || s || ':src/users.js' as target, 'EXTRACTED' as provenance from s
      union all select 'INHERITS', 'symbol:' || s || ':src/users.js#Users', 'symbol:' || s || ':src/users.js#Base', 'EXTRACTED' from s
      union all select 'CONNECTS_TO', 'service:' || s, 'database:db' || (k % 4) || '.host', 'EXTRACTED' from s
      union all select 'CALLS', 'file:' || s || ':src/app.js', 'service:sup-' || (k + 1), 'EXTRACTED' from s where exists (select 1 from supplier where s_suppkey = k + 1)""",
}
