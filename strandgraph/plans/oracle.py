"""The same questions as plain SQL for another engine: what a query's result is checked against."""

from __future__ import annotations

from ..operators import ask
from . import bound
from .queries import PAIRS, ROOT_CUSTOMERS, ROOT_DATABASES, ROOT_PARTS, ROOT_SUPPLIERS

_T = {t: t for t in bound.TABLES}
_NODES = bound.NODE_SQL.format(**_T)
_EDGES = bound.EDGE_SQL.format(**_T)
_DEPS = bound.DEPENDENCY_SQL.format(**_T)


def _list(names) -> str:
    return ", ".join(f"('{n}')" for n in names)


_CEILING = "case provenance when 'OBSERVED' then 1.0 when 'INFERRED' then 0.7 when 'EXTRACTED' then 0.5 else 0.3 end::double"
_VOLUME = "case when spanCount is null or spanCount <= 0 then 0.5 else least(1.0, 0.5 + log10(spanCount + 1) / 3) end"
_CLEAN = "case when spanCount is null or spanCount <= 0 then 1.0 when errorCount / spanCount <= 0.01 then 1.0 when errorCount / spanCount >= 0.5 then 0.3 else 1.0 - 1.4 * errorCount / spanCount end"
_RANK = "case provenance when 'OBSERVED' then 3 when 'INFERRED' then 2 when 'EXTRACTED' then 1 else 0 end"

#: Nodes, edges with weights, best edges in both directions, owners and scopes.
G = f"""
with recursive nodes as ({_NODES}), raw_edges as ({_EDGES}), deps as ({_DEPS}),
edges as (select *, case when spanCount is null then {_CEILING} else greatest(0, least(1, {_CEILING} * {_VOLUME} * {_CLEAN})) end as weight, {_RANK} as prov_rank from raw_edges where source <> target),
frontier as (select id as fid from nodes where type = 'FrontierNode'),
up as (select target as near, source as far, * from edges where source not in (select fid from frontier) qualify row_number() over (partition by target, source order by prov_rank desc, id) = 1),
down as (select source as near, target as far, * from edges where target not in (select fid from frontier) qualify row_number() over (partition by source, target order by prov_rank desc, id) = 1),
scope as (select id as node, id as member from nodes union select e.source, e.target from edges e join nodes n on n.id = e.source and n.type = 'ServiceNode' join nodes f on f.id = e.target and f.type = 'FileNode' where e.type = 'CONTAINS'),
owner as (select id as node, id as owner from nodes where type = 'ServiceNode' union select e.target, e.source from edges e join nodes n on n.id = e.source and n.type = 'ServiceNode' where e.type = 'CONTAINS'),
inward as (select node, sum(coalesce(errorCount, 0)) as errs, sum(coalesce(spanCount, 0)) as vol, max(p95) as p95, bool_or(provenance = 'STALE') as st from scope join edges on member = target where type <> 'CONTAINS' group by node),
outward as (select node, sum(coalesce(spanCount, 0)) as vol, sum(case when type = 'CALLS' then coalesce(errorCount, 0) else 0 end) as errs, bool_or(provenance = 'STALE') as st from scope join edges on member = source where type <> 'CONTAINS' group by node),
ctx0 as (select id as node, coalesce(o.errs, 0)::bigint as errorsEmittedHere, coalesce(i.errs, 0)::bigint as errorsFromCallers, coalesce(i.vol, 0)::bigint as callCount, coalesce(o.vol, 0)::bigint as outboundVolume, i.p95 as latencyP95Ms, coalesce(i.st, false) or coalesce(o.st, false) as stale from nodes left join inward i on i.node = id left join outward o on o.node = id),
ctx as (select *, case when errorsEmittedHere > 0 and (stale or coalesce(latencyP95Ms, 0) >= 1000) and errorsFromCallers >= errorsEmittedHere then 'symptom-only' when errorsEmittedHere > 0 then 'primary-failure' when errorsFromCallers > 0 then 'symptom-only' else 'unrelated' end as classification,
  errorsFromCallers > 0 and (stale or coalesce(latencyP95Ms, 0) >= 1000) and errorsEmittedHere <= errorsFromCallers as victim from ctx0),
slots as (select type, case when type = 'CONNECTS_TO' and source like 'file:%' and target like 'database:%' then 'service:' || split_part(source, ':', 2) else source end as source, target,
  max(case when id not like '%:OBSERVED:%' then weight end) as ew, max(case when id not like '%:OBSERVED:%' then coalesce(confidence, weight) end) as extracted, max(case when id like '%:OBSERVED:%' then coalesce(confidence, weight) end) as observed, max(case when id not like '%:OBSERVED:%' then hostSource end) as hostSource from edges group by all)
"""


def _bfs(direction: str, roots, depth: int) -> str:
    """All shortest paths in a recursive table, the smallest of each kept."""
    among = roots if isinstance(roots, str) else f"id in (select * from (values {_list(roots)}))"
    return f""", walk as (
  select id as root, id as node, 0 as distance, [id] as path, 1.0::double as confidence, null::varchar as type, null::varchar as provenance from nodes where {among}
  union all
  select w.root, b.far, w.distance + 1, list_append(w.path, b.far), w.confidence * b.weight, b.type, b.provenance from walk w join {direction} b on b.near = w.node where w.distance < {depth} and not list_contains(w.path, b.far)),
found as (select * from walk where distance > 0 and node <> root qualify row_number() over (partition by root, node order by distance, path) = 1)"""


_PAIR_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
_BUCKET = "case when {x} <= 0 then 0 when floor(log2({x})) < -10 then 1 when floor(log2({x})) > 22 then 529 else 1 + (floor(log2({x})) + 10) * 16 + least(greatest(floor(({x} / pow(2.0, floor(log2({x}))) - 1) * 16), 0), 15) end::int"
_MID = "case when {b} <= 0 then 0.0 when {b} >= 529 then 8388608.0 else pow(2.0, floor(({b} - 1) / 16) - 10) * (1 + (({b} - 1) % 16 + 0.5) / 16) end"
_GRADE = "round(greatest(0, least(1, case when {n} >= 100 then 0.95 + 0.05 * least(1.0, ({n} - 100) / 900) when {n} >= 10 then 0.7 + 0.2 * ({n} - 10) / 90 when {n} > 0 then 0.4 + 0.2 * ({n} - 1) / 9 else 0.4 end - case when {n} > 0 then 0.2 * least(1.0, {e} / {n}) else 0 end)), 3)::double"


def _quantile(q: float) -> str:
    return f"round(min(case when upto >= greatest(1, ceil({q} * total)) then {_MID.format(b='bucket')} end), 2)"


def _version(x: str) -> str:
    return "[" + ", ".join(f"coalesce(try_cast(regexp_extract({x}, '(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?', {i}) as int), 0)" for i in (1, 2, 3)) + "]"


_OLD_DRIVERS = f"""select d.service, e.target, e.id as edge, d.package, d.version, n.engine, n.engineVersion, e.provenance, p.least from deps d join (values ('pg', 'postgresql', '8.0.0', 14), ('mysql2', 'mysql', '3.0.0', 8), ('mongoose', 'mongodb', '7.0.0', 7)) p(driver, engine, least, eng) on p.driver = d.package
  join edges e on e.source = d.service and e.type = 'CONNECTS_TO' join nodes n on n.id = e.target and n.engine = p.engine where {_version('n.engineVersion')}[1] >= p.eng and {_version('d.version')} < {_version('p.least')}"""
_INCIDENTS = """select 'i' || (event_id // 2)::varchar as id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, 'customer-' || user_id::varchar as service, 't' || (event_id % 200)::varchar as traceId, event_type = 'view' as synth,
  case when event_type = 'error' then 'boom ' || (event_id % 5)::varchar else '503 on GET /r/' || (event_id % 3)::varchar end as errorMessage, 'service:customer-' || (user_id % 50)::varchar as affectedNode, event_id as ordinal from events where event_type in ('error', 'view')"""
_ALL_MISSING = """select 'missing-observed' as type, s.source, s.target, s.type as edgeType, null::varchar as "column", extracted as c, hostSource from slots s left join nodes t on t.id = s.target where extracted is not null and observed is null and s.type in ('CALLS', 'CONNECTS_TO', 'PUBLISHES_TO', 'CONSUMES_FROM') and coalesce(t.type, '') not in ('FrontierNode', 'ServerActionNode')"""
_HOSTS = """select e.source, e.target, regexp_replace(n.dbConnectionTarget, ':\\d+$', '') as declared, d.host as observed, e.weight from edges e join nodes n on n.id = e.source and n.type = 'ServiceNode' and n.dbConnectionTarget is not null join nodes d on d.id = e.target and d.type = 'DatabaseNode'
  where e.type = 'CONNECTS_TO' and e.provenance = 'OBSERVED' and d.host <> regexp_replace(n.dbConnectionTarget, ':\\d+$', '') and e.source in (select source from edges where type = 'CONFIGURED_BY' and provenance = 'EXTRACTED')"""
_THRESHOLD = "case type when 'CALLS' then 31536000000 when 'CONNECTS_TO' then 3600000 else 86400000 end"
_TURNED = f"(provenance = 'OBSERVED' and lastObserved is not null and greatest(0, epoch_ms(timestamp '{bound.NOW}') - epoch_ms(lastObserved)) > {_THRESHOLD})"
_STATEMENTS = """select o_orderkey as id, case o_orderkey % 5 when 0 then 'orders_' || o_orderkey::varchar when 2 then 'items_' || o_orderkey::varchar when 3 then 'things_' || o_orderkey::varchar when 4 then 'pg_class' end as one,
  case o_orderkey % 5 when 0 then 'orders_' || o_orderkey::varchar when 1 then 'a_' || o_orderkey::varchar when 2 then 'items_' || o_orderkey::varchar when 3 then 'things_' || o_orderkey::varchar end as first from orders"""

# The values are the operator's own, which hold them once; written questions in the tests say what they must give.
_INTENT_CASES = "\n".join(f"when regexp_matches(t, '{pattern}') then '{name}'" for name, pattern in ask.INTENTS)
_COMMON = ", ".join(f"'{w}'" for w in dict.fromkeys(ask.STOP_WORDS + ask.INTENT_WORDS))

ORACLE_SQL: dict[str, str] = {
    "blast_radius_multi": G + _bfs("up", ROOT_PARTS + ROOT_DATABASES, 10) + " select root, node, distance::bigint as distance, provenance, array_to_string(path, '>') as path, round(confidence, 6) as confidence from found",
    "edge_observed_upsert": f"""with c as (select o_custkey, l_suppkey, l_shipdate, l_returnflag, {_BUCKET.format(x='l_quantity')} as bucket from orders join lineitem on o_orderkey = l_orderkey),
      h as (select o_custkey, l_suppkey, bucket, count(*) as n from c group by all), w as (select *, sum(n) over (partition by o_custkey, l_suppkey order by bucket) as upto, sum(n) over (partition by o_custkey, l_suppkey) as total from h),
      q as (select o_custkey, l_suppkey, {_quantile(0.5)} as p50, {_quantile(0.95)} as p95 from w group by all),
      s as (select o_custkey, l_suppkey, count(*) as n, count(*) filter (l_returnflag = 'R') as e, strftime(max(l_shipdate), '%Y-%m-%d') as d from c group by all)
      select 'CALLS:OBSERVED:service:customer-' || o_custkey || '->service:supplier-' || l_suppkey as id, n::bigint as span_count, e::bigint as error_count, d as last_day, {_GRADE.format(n='n', e='e')} as confidence, p50, p95 from s join q using (o_custkey, l_suppkey)""",
    "observed_confidence": G + f" select id, {_GRADE.format(n='spanCount', e='errorCount')} as grade from edges where spanCount is not null",
    "edge_confidence": G + " select id, round(weight, 6) as weight from edges",
    "edge_confidence_live_age": G
    + f""", a as (select *, greatest(0, epoch_ms(timestamp '{bound.NOW}') - epoch_ms(lastObserved)) as age from edges)
      select id, round(case when spanCount is null then {_CEILING} else greatest(0, least(1, {_CEILING} * {_VOLUME} * {_CLEAN} * case when age is null then 0.8 when age <= 3600000 then 1.0 when age <= 86400000 then 1.0 - 0.5 * (age - 3600000) / 82800000 else 0.3 end)) end, 6) as weight from a""",
    "precision_floor": G + " select type, provenance, (provenance <> 'EXTRACTED' or coalesce(confidence, 0) >= 0.8) as kept, count(*) as n from edges group by all",
    "best_edge_per_neighbour": G + " select near, far, id, provenance from up",
    "transitive_dependencies": G + _bfs("down", ROOT_CUSTOMERS[:10] + ROOT_SUPPLIERS, 2) + " select root, node, distance::bigint as distance, type as edgeType, provenance, array_to_string(path, '>') as path, round(confidence, 6) as confidence from found where type <> 'CONTAINS'",
    "observed_dependencies": G + f" select distinct node as origin, id, source, target, type, spanCount as callCount from scope join edges on member = source where type <> 'CONTAINS' and provenance = 'OBSERVED' and node in (select * from (values {_list(ROOT_SUPPLIERS)}))",
    "observed_summary": G
    + """, o as (select node, count(distinct id) filter (provenance = 'OBSERVED') as n, bool_or(provenance = 'EXTRACTED') as x from scope join edges on member = source where type <> 'CONTAINS' group by node),
      i as (select node, count(*) as n, sum(coalesce(spanCount, 1)) as v, strftime(max(lastObserved), '%Y-%m-%d') as l from scope join edges on member = target where type <> 'CONTAINS' and provenance = 'OBSERVED' group by node)
      select id as origin, coalesce(o.n, 0) > 0 or coalesce(i.n, 0) > 0 as observed, coalesce(i.n, 0)::bigint as "inboundObservedCount", coalesce(x, false) as "hasExtractedOutbound", coalesce(v, 0)::bigint as "inboundVolume", l as "inboundLastObserved" from nodes left join o on o.node = id left join i on i.node = id where type = 'ServiceNode'""",
    "node_context": G + ' select node, errorsEmittedHere as "errorsEmittedHere", errorsFromCallers as "errorsFromCallers", callCount as "callCount", outboundVolume as "outboundVolume", latencyP95Ms as "latencyP95Ms", stale, classification, victim from ctx',
    "expand_up": G + f""" select near as origin, far as node, type as "edgeType", provenance, classification, outboundVolume as "outboundVolume" from up join ctx on node = far where type <> 'CONTAINS' and near in (select * from (values {_list(ROOT_SUPPLIERS)}))""",
    "expand_down": G + f""" select near as origin, far as node, type as "edgeType", provenance, classification, callCount as "callCount" from down join ctx on node = far where type <> 'CONTAINS' and near in (select * from (values {_list(ROOT_CUSTOMERS)}))""",
    "find_path": G + _bfs("down", {a for a, _ in PAIRS}, 5) + f" select a, b, array_to_string(path, '>') as path, distance::bigint as length from (values {_PAIR_VALUES}) p(a, b) join found on root = a and node = b",
    "relate": G
    + _bfs("down", {a for a, _ in PAIRS}, 5)
    + f""", back as (
  select id as root, id as node, 0 as distance, [id] as path from nodes where id in (select a from (values {_PAIR_VALUES}) p(a, b))
  union all select w.root, x.far, w.distance + 1, list_append(w.path, x.far) from back w join up x on x.near = w.node where w.distance < 5 and not list_contains(w.path, x.far)),
  ups as (select * from back where distance > 0 qualify row_number() over (partition by root, node order by distance, path) = 1)
  select a, b, f.path is not null or u.path is not null as related, case when f.path is not null then 'a->b' when u.path is not null then 'b->a' end as direction, array_to_string(f.path, '>') as down, array_to_string(u.path, '>') as up, false as "grainGap",
  case when a not in (select id from nodes) then 'node not found: ' || a when b not in (select id from nodes) then 'node not found: ' || b when f.path is null and u.path is null then 'no path within 5 hops' end as note
  from (values {_PAIR_VALUES}) p(a, b) left join found f on f.root = a and f.node = b left join ups u on u.root = a and u.node = b""",
    "longest_walk": G + _bfs("up", ROOT_PARTS + ROOT_DATABASES, 5) + " select root, array_to_string(path, '>') as path, round(confidence, 6) as confidence from walk qualify row_number() over (partition by root order by len(path) desc, path) = 1",
    "longest_walk_all": G + _bfs("up", "type = 'DatabaseNode' or id like 'service:supplier-%'", 5) + " select root, array_to_string(path, '>') as path, round(confidence, 6) as confidence from walk qualify row_number() over (partition by root order by len(path) desc, path) = 1",
    "failing_chain": G
    + f""", hops as (select s.node as a, o.owner as b, e.* from edges e join (select node, member from scope) s on s.member = e.source join owner o on o.node = e.target where e.type = 'CALLS' and errorCount > 0 and s.node <> o.owner and s.node like 'service:%')
      select a as root, a || '>' || b as path, errorCount::varchar as errors, round(weight, 6) as confidence from hops where a in (select * from (values {_list(ROOT_CUSTOMERS)})) qualify row_number() over (partition by a order by errorCount desc, prov_rank desc, b, id) = 1""",
    "stale_chain": G
    + f""", hops as (select s.node as a, o.owner as b, e.* from edges e join scope s on s.member = e.source join owner o on o.node = e.target where e.type = 'CALLS' and s.node <> o.owner and s.node like 'service:%'),
      best as (select * from hops qualify row_number() over (partition by a, b order by prov_rank desc, id) = 1)
      select a as root, a || '>' || b as path, round(weight, 6) as confidence from best where provenance = 'STALE' and a in (select * from (values {_list(ROOT_CUSTOMERS)})) qualify row_number() over (partition by a order by spanCount desc, b) = 1""",
    "load_origin": G + _bfs("up", ROOT_SUPPLIERS, 10) + ' select root as alert, f.node, outboundVolume as "outboundVolume", callCount as "callCount" from found f join ctx c on c.node = f.node where outboundVolume > 0 qualify row_number() over (partition by root order by case when callCount = 0 then 0 else 1 end, outboundVolume desc, f.node) = 1',
    "latency_hist": f"select l_suppkey, {_BUCKET.format(x='l_extendedprice')} as bucket, count(*) as n from lineitem group by all",
    "latency_quantile": f"with h as (select l_suppkey, {_BUCKET.format(x='l_extendedprice')} as bucket, count(*) as n from lineitem group by all), w as (select *, sum(n) over (partition by l_suppkey order by bucket) as upto, sum(n) over (partition by l_suppkey) as total from h) select l_suppkey, max(total)::bigint as samples, {_quantile(0.5)} as p50, {_quantile(0.95)} as p95 from w group by l_suppkey",
    "counter_delta": """with p as (select user_id % 40 as q, event_id * 7919 % 1000 as calls, lag(event_id * 7919 % 1000) over (partition by user_id % 40 order by event_id) as before from events)
      select 't_' || q as "targetName", sum(calls - before)::bigint as "callCount", 0::bigint as "errorCount" from p where before is not null and calls > before group by q""",
    "route_normalise": r"""with p as (select page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') as x from pages), q as (select page_id, regexp_replace(case when x like '/%' then x else '/' || x end, '/+$', '') as x from p)
      select page_id, case when x = '' then '/' else array_to_string(list_transform(string_split(x, '/'), lambda s: case when regexp_matches(s, '^(?:[:*].*|\{.*\}|\[.*\]|<.*>|\$\{.*\}|\d+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{24,})$') then ':param' else lower(s) end), '/') end as template from q""",
    "url_host": r"select lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '')) as host, count(*) as n from pages group by 1",
    "parent_span_join": """with s as (select l_orderkey as t, l_linenumber as i, 'supplier-' || min(l_suppkey) as service from lineitem group by 1, 2)
      select p.service as "parentService", c.service, count(*) as n from s c join s p on p.t = c.t and p.i = c.i - 1 where c.i > 1 group by all""",
    "shape_counts": G + " select 'node' as kind, type as name, count(*) as n from nodes group by all union all select 'provenance', provenance, count(*) from edges group by all union all select 'edge', type, count(*) from edges group by all",
    "busiest": G + " select near as service, count(*) as n from down join nodes n on n.id = near and n.type = 'ServiceNode' where down.type <> 'CONTAINS' group by near order by n desc, service limit 6",
    "unobserved": G + " select id from nodes where type = 'ServiceNode' and id not in (select source from edges where provenance = 'OBSERVED' union select target from edges where provenance = 'OBSERVED')",
    "symbol_range_join": """with sym as (select * from (values ('outer', 1, 60), ('outer.mid', 10, 30), ('outer.mid.low', 20, 25), ('late', 20, 25)) v(q, a, b)), site as (select l_orderkey * 10 + l_linenumber as site, l_suppkey as s, l_quantity::int as line, case when l_returnflag = 'R' then 'late' else 'other' end as f from lineitem qualify row_number() over (partition by l_orderkey * 10 + l_linenumber order by l_suppkey, l_quantity::int, f) = 1),
      hit as (select *, 'symbol:supplier-' || s || ':src/app.py#' || q as symbol from site join sym on line between a and b qualify row_number() over (partition by site order by case when split_part(q, '.', -1) = f then 0 else 1 end, b - a, -a, symbol) = 1)
      select symbol, count(*) as n, sum(site)::bigint as sites from hit group by all""",
    "divergence_missing_observed": G + f' , m as ({_ALL_MISSING}) select type, source, target, edgeType as "edgeType", "column", round(c, 6) as confidence from m',
    "divergence_missing_extracted": G + """ select 'missing-extracted' as type, source, target, type as "edgeType", null::varchar as "column", round(observed, 6) as confidence from slots where observed is not null and extracted is null and type <> 'CONTAINS'""",
    "divergence_host_mismatch": G + f", h as ({_HOSTS}) select source, target, declared, observed, round(weight, 6) as confidence from h",
    "divergence_compatibility": G
    + f""", o as ({_OLD_DRIVERS}) select 'version-mismatch' as type, service as source, target, package || '@' || version as declared, engine || '@' || engineVersion as observed from o where provenance = 'OBSERVED'
      union all select 'compat-violation', d.service, e.target, 'request@' || d.version, null from deps d join edges e on e.source = d.service and e.type = 'CONNECTS_TO' and e.provenance = 'OBSERVED' where d.package = 'request'""",
    "divergence_column_drift": """select type, 'infra:sql-table:part-' || p_partkey as source, 'infra:sql-table:part-' || p_partkey as target, null::varchar as "edgeType", c as "column", confidence::double as confidence from part, (values ('missing-observed', 'total', 0.85), ('missing-extracted', 'amount', 0.9)) v(type, c, confidence) where p_partkey % 50 = 0""",
    "divergence_ranked": G
    + f""", h as ({_HOSTS}), o as ({_OLD_DRIVERS}), m as ({_ALL_MISSING}),
      seen as (select n.id, n.engine, n.discoveredVia in ('otel', 'merged') or exists (select 1 from edges e where e.target = n.id and e.provenance in ('OBSERVED', 'STALE')) as seen from nodes n where n.type = 'DatabaseNode'),
      alive as (select distinct s.source, x.engine from slots s join seen x on x.id = s.target where s.type = 'CONNECTS_TO' and (s.observed is not null or x.seen)),
      every as (select m.type, m.source, m.target, m.edgeType, null::varchar as col, case when m.hostSource = 'literal' and m.edgeType = 'CONNECTS_TO' and not x.seen and a.source is not null then least(0.1, m.c) else m.c end as c from m left join seen x on x.id = m.target left join alive a on a.source = m.source and a.engine = x.engine where m.target not in (select 'database:' || declared from h)
        union all select 'host-mismatch', source, target, null, null, weight from h union all select 'version-mismatch', service, target, null, null, 1.0 from o where provenance = 'OBSERVED'
        union all select 'compat-violation', d.service, e.target, null, null, 1.0 from deps d join edges e on e.source = d.service and e.type = 'CONNECTS_TO' and e.provenance = 'OBSERVED' where d.package = 'request'
        union all select 'missing-observed', 'infra:sql-table:part-' || p_partkey, 'infra:sql-table:part-' || p_partkey, null, 'total', 0.85 from part where p_partkey % 50 = 0)
      select type, source, target, edgeType as "edgeType", col as "column", round(c, 6)::double as confidence from every""",
    "policy_structural": G + """ select 'p-structural:' || id as id, 'critical' as severity, 'block' as "onViolation", id as "nodeId", null::varchar as "edgeId" from nodes where type = 'ServiceNode' and id not in (select e.source from edges e join nodes d on d.id = e.target and d.type = 'DatabaseNode' where e.type = 'CONNECTS_TO')""",
    "policy_ownership": G + """ select 'p-ownership:' || id as id, 'warning' as severity, 'alert' as "onViolation", id as "nodeId", null::varchar as "edgeId" from nodes where type = 'ServiceNode' and coalesce(owner, '') = ''""",
    "policy_provenance": G + """ select 'p-provenance:' || id as id, 'warning' as severity, 'alert' as "onViolation", null::varchar as "nodeId", id as "edgeId" from edges where type = 'CALLS' and provenance not in ('OBSERVED', 'INFERRED')""",
    "policy_blast_radius": G + _bfs("up", [f"database:nation-{i}.db" for i in range(25)], 2) + """ select 'p-blast-radius:' || root as id, 'error' as severity, 'alert' as "onViolation", root as "nodeId", null::varchar as "edgeId" from found group by root having count(*) > 60""",
    "policy_compatibility": G
    + f""", o as ({_OLD_DRIVERS}), v as (select distinct service, 'driver-engine:' || package || '@' || version || ':' || engine || '@' || engineVersion as s from o
      union select d.service, 'node-engine:' || d.package || '@' || d.version from deps d join nodes n on n.id = d.service where n.nodeEngine = '>=16' and d.package in ('next', 'vitest')
      union select d.service, 'node-engine:next@' || d.version from deps d join nodes n on n.id = d.service where n.nodeEngine = '>=18.0.0' and d.package = 'next'
      union select d.service, 'package-conflict:next@' || d.version from deps d join deps r on r.service = d.service and r.package = 'react' where d.package = 'next' and {_version('r.version')} < [18, 2, 0]
      union select service, 'deprecated-api:request@' || version from deps where package = 'request')
      select 'p-compatibility:' || service || ':' || s as id, 'warning' as severity, 'alert' as "onViolation", service as "nodeId" from v""",
    "policy_field_guard": """select 'p-field-guard:infra:sql-table:part-' || p_partkey || ':b' as id, 'warning' as severity, 'alert' as "onViolation", 'infra:sql-table:part-' || p_partkey as "nodeId", null::varchar as "edgeId" from part where p_partkey % 50 = 1""",
    "policy_check": G + """, b as (select count(*) as n from nodes where type = 'ServiceNode' and id not in (select e.source from edges e join nodes d on d.id = e.target and d.type = 'DatabaseNode' where e.type = 'CONNECTS_TO')), a as (select count(*) as n from nodes where type = 'ServiceNode' and coalesce(owner, '') = '')
      select b.n = 0 as allowed, a.n + b.n as violations, b.n as blocking from a, b""",
    "policy_applicable": G + """ select 'p-structural' as "policyId", case when type = 'ServiceNode' then 'subject' else 'region' end as role, count(*) as n from nodes where type in ('ServiceNode', 'DatabaseNode') group by all
      union all select 'p-provenance', 'subject', count(distinct source) from edges where type = 'DEPENDS_ON' union all select 'p-provenance', 'region', count(distinct target) from edges where type = 'DEPENDS_ON'""",
    "policy_reach": G + _bfs("up", "type = 'DatabaseNode'", 2) + " select id as node, 'subject' as role from nodes where type = 'DatabaseNode' union all select distinct node, 'region' from found where node not in (select id from nodes where type = 'DatabaseNode')",
    "stale_sweep": G + f" select type, case when {_TURNED} then 'STALE' else provenance end as provenance, count(*) as n, round(sum(case when {_TURNED} then 0.3 else coalesce(confidence, 0) end), 6)::double as c from edges group by 1, 2",
    "stale_events": G + f""" select id as "edgeId", type as "edgeType", {_THRESHOLD}::bigint as "thresholdMs", (epoch_ms(timestamp '{bound.NOW}') - epoch_ms(lastObserved))::bigint as "ageMs" from edges where {_TURNED}""",
    "trace_stitch": G
    + """, opened as (select distinct type, source, target from edges e where provenance = 'EXTRACTED' and type in ('CALLS', 'CONNECTS_TO', 'DEPENDS_ON') and not exists (select 1 from edges o where o.type = e.type and o.source = e.source and o.target = e.target and o.id like '%:OBSERVED:%')),
      one as (select o.* from opened o join nodes n on n.id = o.source and n.type = 'ServiceNode'), two as (select * from one union select o.* from opened o where o.source in (select target from one))
      select type || ':INFERRED:' || source || '->' || target as id, source, target, type, 'INFERRED' as provenance, 0.6::double as confidence from two""",
    "frontier_promotion": G + """ select case when target = 'frontier:region-1' then 'DEPENDS_ON:' || source || '->service:supplier-3' else id end as id, source, case when target = 'frontier:region-1' then 'service:supplier-3' else target end as target, null::bigint as "callCount" from edges where type = 'DEPENDS_ON'""",
    "incident_dedupe": f"""with i as ({_INCIDENTS}), once as (select * from i qualify row_number() over (partition by id order by ordinal) = 1)
      select ordinal, id, errorMessage as "errorMessage", affectedNode as "affectedNode" from once o where not synth or not exists (select 1 from once r where not r.synth and r.traceId = o.traceId and r.affectedNode = o.affectedNode)""",
    "incident_rollup": f"with i as ({_INCIDENTS}) select affectedNode as key, count(*) as n, max(timestamp) as latest, max(struct_pack(a := timestamp, b := errorMessage)).b as message from i group by 1 order by n desc, latest desc, key limit 6",
    "incident_list": f"with i as ({_INCIDENTS}) select ordinal, id, timestamp from i order by ordinal limit 200",
    "incident_match": G + f", i as ({_INCIDENTS}), m as (select distinct ordinal, k as node from i, (select unnest([affectedNode, 'service:' || service]) as k)) select node, count(*) as n from m where node in (select id from nodes) group by node",
    "burst_4xx": """with f as (select user_id % 20 as peer, epoch_us(ts) // 1000 as ms, (400 + event_id % 4)::int as code from events), a as (select *, case when ms - lag(ms) over (partition by peer order by ms, code) > 7200000 then 1 else 0 end as fresh from f),
      s as (select *, sum(fresh) over (partition by peer order by ms, code rows unbounded preceding) as session from a), b as (select *, row_number() over (partition by peer, session order by ms, code) as r from s),
      c as (select peer, session, (r + 4) // 5 as block, code, count(*) as n, min(r) as seen, min(ms) as lo, max(ms) as hi from b group by all)
      select peer, min(lo) as first_ms, max(hi) as last_ms, sum(n)::bigint as n, first(code order by n desc, seen) as code from c group by peer, session, block having sum(n) = 5""",
    "graph_diff_nodes": G + """ select id, 'removed' as change, null::varchar as fields from nodes where type = 'FrontierNode' union all select 'service:customer-3', 'changed', 'owner'""",
    "graph_diff_edges": G + """ select id, 'removed' as change, null::varchar as fields from edges where id like '%customer-1->%' union all select id, 'changed', 'provenance' from edges where id like '%customer-2->%' and provenance <> 'STALE'""",
    "snapshot_merge": G + """, n2 as (select id from nodes where type <> 'DatabaseNode' or id < 'database:nation-20') select type, provenance, count(*) as n from edges where type = 'CALLS' or (type = 'CONNECTS_TO' and source in (select id from n2) and target in (select id from n2)) group by all""",
    "vector_top_k": """with s as (select q.vec_id as q, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score from embeddings e, (select * from embeddings where vec_id % 100 = 0) q), r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s)
      select q, rank::int as rank, vec_id, round(score, 5) as score from r where rank <= 5""",
    "substring_search": G + " select id, type, 1.0::double as score from nodes where contains(lower(id), 'supplier-1') or contains(lower(name), 'supplier-1')",
    "ask_intent": f"""with q as (select conv_id, turn, lower(coalesce(text, '') || case turn % 4 when 0 then ' what breaks if this dies' when 1 then ' seen at runtime' when 2 then ' throws 503' else ' who uses it' end) as t from conversations) select conv_id, turn, case {_INTENT_CASES} else 'overview' end as intent from q""",
    "ask_tokens": f"""with w as (select conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')), lambda x: length(x) >= 2 and not list_contains([{_COMMON}], x)) as t from conversations) select conv_id, turn, coalesce(array_to_string(list_sort(t), ' '), '') as tokens from w""",
    "ask_entities": G + f"""
, q as (select unnest([1, 2, 3, 4, 5]) as q, unnest(['why is supplier-1 failing?', 'what does customer 17 call', 'anything about nation 3 databases', 'part-7 and part-8', 'customer-12 and nation-3.db?']) as text),
a as (select q, lower(text) as text, list_filter(list_distinct(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')), lambda x: length(x) >= 2 and not list_contains([{_COMMON}], x)) as asked from q),
k as (select id, regexp_replace(id, '^[^:]*:', '') as body, coalesce(name, id) as name from nodes where type <> 'FrontierNode'),
kt as (select id, lower(body) as body, lower(name) as lname, regexp_extract_all(lower(regexp_replace(body || ' ' || name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+') as known, regexp_extract_all(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+') as label from k),
m as (select q, id, len(list_intersect(asked, known)) as n, len(list_intersect(asked, label)) as ln, len(asked) as words, (length(body) >= 2 and contains(text, body)) or (length(lname) >= 2 and contains(text, lname)) as named from a, kt),
f as (select q, id as node, case when named then greatest(0.9, n / words) else least(0.85, 0.3 + 0.7 * n / words) end as s, case when named then 'id' when ln > 0 then 'label' else 'token' end as via from m where n > 0 or named),
r as (select *, row_number() over (partition by q order by round(s, 6) desc, case via when 'id' then 3 when 'label' then 2 else 1 end desc, node) as rank from f)
select q, rank::int as rank, node, round(round(s, 6), 3)::double as score, via from r where rank <= 3""",
    "embed_digest": G + """ select id, substring(sha1(concat_ws(' ', id, name, case when type = 'ServiceNode' and owner is not null then 'owner=' || owner end, case when type = 'DatabaseNode' then 'engine=' || engine end, case when type = 'DatabaseNode' then 'engineVersion=' || engineVersion end, case when type = 'DatabaseNode' then 'host=' || host end, case when type = 'ConfigNode' then 'path=' || path end, case when type = 'InfraNode' then 'kind=' || kind end, case when type = 'FileNode' then 'service=' || service end, case when type = 'FileNode' then 'path=' || path end, case when type = 'FrontierNode' then 'host=' || host end)), 1, 16) as digest from nodes""",
    "incident_localise": G + f", i as ({_INCIDENTS}), m as (select distinct k as node, i.* from i, (select unnest([affectedNode, 'service:' || service]) as k)) select node, node as culprit, 'Inspect the handler for /r/' || (ordinal % 3) as fix from m where node in (select id from nodes) qualify row_number() over (partition by node order by timestamp desc, id desc, ordinal) = 1",
    "sql_columns": "select o_orderkey as id, case o_orderkey % 5 when 0 then 'id,total,status' when 2 then 'a,b' when 3 then 'a,b' else '' end as columns from orders",
    "call_sites": G + " select split_part(source, ':', 2) as service, target, min(source) as file from edges where provenance = 'EXTRACTED' and type <> 'CONTAINS' and source like 'file:%' group by 1, 2 having count(distinct source) = 1",
    "log_ring": """select 'p' || (user_id % 3) as "projectName", event_type as source, event_id as ordinal from events qualify row_number() over (partition by user_id % 3, event_type order by event_id desc) <= 100""",
    "log_query": """select event_id::varchar as id, 'svc-' || (user_id % 7) as "serviceName", strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp from events where user_id % 3 = 1 and event_type = 'error' order by timestamp desc, id limit 50""",
    "sql_table": _STATEMENTS,
    "edge_id_parse": G + " select id, type, case when id like '%:OBSERVED:%' then 'OBSERVED' else 'EXTRACTED' end as provenance, source, target from edges",
    "version_checks": "select p_partkey, [p_size % 12, p_partkey % 7, 1] < [6, 3, 0] as is_older, [p_size % 12, p_partkey % 7, 1] >= [4, 2, 0] as admits, (p_size % 12) || '.' || (p_partkey % 7) || '.1' as cleaned from part",
    "column_fold": """select 't' || (l_suppkey % 5) as "table", lower(l_returnflag || l_linestatus) as name, array_to_string(list_sort(list_distinct(list(case when l_linenumber % 2 = 0 then 'OBSERVED' else 'EXTRACTED' end))), ',') as provenances, max(l_discount) as confidence from lineitem group by 1, 2""",
    "signal_fold": f"""with s as (select l_partkey, sum(l_quantity::bigint) as n, sum(least(greatest(0, (l_quantity - 20)::bigint), l_quantity::bigint)) as e from lineitem where l_quantity >= 1 group by 1)
      select 'CALLS:OBSERVED:service:poller->infra:sql-table:part-' || l_partkey as id, n::bigint as "callCount", e::bigint as "errorCount", {_GRADE.format(n='n', e='e')} as confidence from s""",
    "host_resolve": "select 'sup' || s_suppkey as host, 'prod' as env, 'service:supplier-' || s_suppkey as service from supplier union all select 'customer-' || c_custkey, 'unknown', 'service:customer-' || c_custkey from customer",
    "file_reconcile": "select 'supplier-' || s_suppkey as service, 'srv/build/src/app.py' as path, 'file:supplier-' || s_suppkey || ':src/app.py' as file from supplier where s_suppkey % 6 = 0",
    "declared_database": G + " select e.source as service, n.engine, e.target as database from edges e join nodes n on n.id = e.target and n.type = 'DatabaseNode' where e.type = 'CONNECTS_TO' and e.provenance = 'EXTRACTED'",
    "connector_status": """with p as (select user_id % 30 as connector, max(struct_pack(a := ts, o := event_type <> 'error', s := floor(value)::bigint)) as l, max(case when event_type <> 'error' then ts end) as ok from events group by 1) select connector, case when not l.o then 'error' else 'stale' end as state from p""",
    "span_dispatch": f"""with s as (select user_id % 100 as c, event_id % 60 as p, count(*) as n, count(*) filter (event_type = 'error') as e from events group by all), t as (select c, p, n, e, exists (select 1 from supplier where s_suppkey = p) as known from s)
      select 'CALLS:OBSERVED:' || case when exists (select 1 from customer where c_custkey = c) then 'service:customer-' || c else 'service:customer-' || c end || '->' || case when known then 'service:supplier-' || p else 'frontier:sup' || p end as id, n::bigint as "callCount", e::bigint as "errorCount", {_GRADE.format(n='n', e='e')} as confidence from t""",
    "span_incidents": """select (event_id % 500) || ':' || event_id as id, 'customer-' || (user_id % 100) as service, '500 on POST /pay' as "errorMessage", 500::int as "httpStatusCode", 'service:customer-' || (user_id % 100) as "affectedNode" from events where event_type = 'error'""",
    "project_routing": """select case when user_id % 100 = 1 then 'customer-1' else 'customer' end as project, count(*) as n from events group by 1""",
}