"""SQL twins of ``traced``: what the traces say, from the events they were made of."""

from __future__ import annotations

from .oracle import _HOSTS, G

#: Traces of events: services by name and node, the source of the first call, and the calls of all spans.
_TRACES = (
    G
    + """, ev as (select event_id as n, event_id // 4 as g, event_id % 4 as r, case when event_id // 4 % 3 = 0 then ':staging' else '' end as env from events),
t as (select ev.*, 'supplier-' || (g % 20 + 1) as s, s_suppkey is not null as known, coalesce(s_suppkey % 2 = 0, false) as even, g % 30 + 1 as line, 'service:customer-' || (g % 30 + 1) as c from ev left join supplier on s_suppkey = g % 20 + 1),
named as (select *, 'service:' || s || case when known then '' else env end as svc, 'service:ghost-' || (g % 5) || env as ghost, 'file:' || s || case when even then ':src/app.py' else ':srv/src/app.py' end as file,
  case when even then 'symbol:' || s || ':src/app.py#' || case when line <= 10 then 'f0' else 'f' || (g % 2) end end as symbol from t),
linked as (select a.*, exists (select 1 from events p where p.event_id = a.n - case when a.r = 3 then 2 else 1 end) as parented from named a),
told as (
  select 'CALLS' as type, coalesce(symbol, file) as source, c as target, g % 13 = 0 or g % 7 = 0 as bad from linked where r = 1 and parented
  union all select 'CALLS', c, svc, false from linked where r = 2 and parented
  union all select 'CALLS', c, ghost, false from linked where r = 3 and parented),
sums as (select type, source, target, count(*) as n, count(*) filter (bad) as bad from told group by all),
sites as (select distinct svc, file, case when even and line > 10 then symbol end as minted from linked where r = 1 and parented),
held as (select svc as source, file as target from sites union select file, minted from sites where minted is not null),
failing as (select svc as f from named where r = 0 and g % 11 = 0 union select c from named where r = 1 and g % 13 = 0),
open as (select type, source, target from raw_edges r where provenance = 'EXTRACTED' and type in ('CALLS', 'CONNECTS_TO', 'DEPENDS_ON') and source <> target and not exists (select 1 from sums s where s.type = r.type and s.source = r.source and s.target = r.target)),
one as (select distinct open.* from open join failing on f = source),
two as (select distinct open.* from open where source in (select target from one) and source not in (select f from failing)),
landed as (
  select 'node' as kind, svc as id, 'ServiceNode' as type, s as name, null::bigint as n, null::bigint as errors from named where r in (0, 2) and not known
  union select 'node', ghost, 'ServiceNode', 'ghost-' || (g % 5), null, null from named where r = 3
  union select 'node', file, 'FileNode', 'app.py', null, null from linked where r = 1 and parented and not even
  union select 'node', symbol, 'SymbolNode', 'f1', null, null from linked where r = 1 and parented and even and line > 10 and g % 2 = 1
  union all select 'edge', type || ':OBSERVED:' || source || '->' || target, type, 'OBSERVED', n, bad from sums
  union all select 'edge', 'CONTAINS:OBSERVED:' || source || '->' || target, 'CONTAINS', 'OBSERVED', null, null from held
  union all select 'edge', type || ':INFERRED:' || source || '->' || target, type, 'INFERRED', null, null from (select * from one union select * from two)
  union all select 'incident', 't' || g || ':' || n, case when even and line <= 10 then symbol else file end, 'boom', null, null from named where r = 0 and g % 11 = 0
  union all select 'incident', 't' || g || ':' || n, c, case when g % 7 = 0 then 'HTTP 503' else 'unknown error' end, null, null from named where r = 1 and (g % 13 = 0 or g % 7 = 0))"""
)
_LANDED = _TRACES + " select kind, id, type, name, n::bigint as n, errors::bigint as errors from landed"

_OBSERVED_IDS = "select id from raw_edges where provenance = 'OBSERVED' and source <> target"

_DIGEST = """substring(sha1(concat_ws(' ', id, name, case when type = 'ServiceNode' and own is not null then 'owner=' || own end, case when type = 'DatabaseNode' then 'engine=' || engine end,
  case when type = 'DatabaseNode' then 'engineVersion=' || engineVersion end, case when type = 'DatabaseNode' then 'host=' || host end, case when type = 'ConfigNode' then 'path=' || path end,
  case when type = 'InfraNode' then 'kind=' || kind end, case when type = 'FileNode' then 'service=' || service end, case when type = 'FileNode' then 'path=' || path end)), 1, 16)"""

TRACED_SQL: dict[str, str] = {
    "extract_incremental": """with s as (select count(*) as s from supplier), p as (select page_id as n, 'sup-' || (page_id % s) as own, 'sup-' || ((page_id * 3 + page_id // s // 2 + case when page_id % 10 = 0 then 1 else 0 end) % s) as dest, s from pages, s),
      later as (select * from p where n % 7 <> 0)
      select 'edge' as kind, 'CONTAINS:service:' || own || '->file:' || own || ':src/page' || n || '.js' as id from later
      union all select 'edge', 'CALLS:file:' || own || ':src/page' || n || '.js->service:' || dest from later
      union all select 'parsed', (select count(*) from p) + (select max(s) from s) || ' of run 0, 0 removed'
      union all select 'parsed', (select count(*) from later where n % 10 = 0) || ' of run 1, ' || (select count(*) from p where n % 7 = 0) || ' removed'""",
    "embedding_cache": G
    + f""", c as (select *, try_cast(regexp_extract(id, '^service:customer-(\\d+)$', 1) as int) as c from nodes where type <> 'FrontierNode'),
      o as (select *, case when c % 5 = 0 then 'new' else owner end as own from c where c is null or c % 7 <> 0)
      select id, {_DIGEST} as digest, case when c % 5 = 0 then 1 else 0 end::bigint as version, 64::int as dims from o""",
    "traced_landed": _LANDED,
    "stream_traced": _LANDED,
    "stream_changes": _TRACES + " select kind || '-added' as event, id from landed where kind = 'node' or (kind = 'edge' and name = 'OBSERVED')",
    "change_feed": G
    + """, mine as (select id, type, owner, regexp_extract(id, '^service:customer-(\\d+)$', 1) as d from nodes), kept as (select *, try_cast(d as int) as k from mine),
      seen as (select id, try_cast(regexp_extract(source, '^service:customer-(\\d+)$', 1) as int) as k from raw_edges where provenance = 'OBSERVED'), left_ as (select * from kept where k is null or k % 5 <> 0)
      select 'node-added' as event, id, '{}' as payload from kept union all select 'edge-added', id, '{}' from seen
      union all select 'node-updated', id, '{"fields":["owner"]}' from kept where k % 3 = 0 and owner is not null and owner <> 'A'
      union all select 'node-removed', id, '{}' from kept where k % 5 = 0 union all select 'edge-removed', id, '{}' from seen where k % 5 = 0
      union all select 'policy-violation', 'no-owner:' || id, '{"message":"a service has no owner"}' from left_ where type = 'ServiceNode' and owner is null
      union all select 'stale-transition', id, '{"from":"OBSERVED","to":"STALE"}' from raw_edges where type = 'CONNECTS_TO' and provenance = 'OBSERVED'
      union all select 'extraction-complete', 'default', '{"fileCount":' || count(*) filter (type = 'FileNode') || ',"nodesAdded":' || count(*) || ',"edgesAdded":0}' from left_""",
    "stale_timers": """with o as (select distinct case event_type when 'error' then 'CONNECTS_TO' when 'view' then 'DEPENDS_ON' else 'CALLS' end as type, user_id, event_type, epoch_us(ts) // 1000 as ms from events),
      l as (select *, case type when 'CALLS' then 3600000 when 'CONNECTS_TO' then 14400000 else 86400000 end as t, lead(ms) over (partition by type, user_id, event_type order by ms) as after from o)
      select type || ':OBSERVED:service:user-' || user_id || '->service:' || event_type as "edgeId", type as "edgeType", t::bigint as "thresholdMs", ms::bigint as "lastMs" from l
      where after - ms > t or (after is null and ms + t + 1 <= (select max(ms) - 600000 from o))""",
    "monitor_once": G
    + f""", a as (select 'divergence' as kind, 'divergence|host-mismatch|' || source || '|' || target as key from ({_HOSTS})
      union select 'stale', 'stale|' || id || '|2001-11-04 00:00:00' from raw_edges where type = 'CONNECTS_TO' and provenance = 'OBSERVED' union select 'policy', 'policy|' || id from nodes where type = 'ServiceNode' and owner is null)
      select kind, key, 1::bigint as n from a""",
    "snapshot_versions": G
    + """ select id, type, case when kind = 'sql-table' and k % 50 = 0 then 3 when kind <> 'sql-table' then 3 when k % 4 <> 3 then 0 end::int as n from nodes where type = 'InfraNode'
      union all select id, 'OBSERVED', spanCount::int from raw_edges where type = 'CONNECTS_TO' and provenance = 'OBSERVED'""",
    "unobserved_quiet": G
    + """, third as (select source, target from raw_edges where provenance = 'OBSERVED' and source <> target and target like 'service:%' and try_cast(regexp_extract(source, '^service:customer-(\\d+)$', 1) as int) % 3 = 0)
      select id from nodes where type = 'ServiceNode' and id not in (select source from third union select target from third)""",
    "page_call_sites": """with s as (select count(*) as s from supplier), p as (select page_id as n, 'service:sup-' || (page_id % s) as service, 'service:sup-' || ((page_id * 3 + page_id // s // 2) % s) as target, 'file:sup-' || (page_id % s) || ':src/page' || page_id || '.js' as file from pages, s)
      select service, target, min(file) as file from p group by 1, 2 having count(*) = 1""",
}
