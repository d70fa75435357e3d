"""DuckDB SQL for the queries in :mod:`hostweave.catalog`, over the same tables.

Each text is complete. It starts from the flow view and repeats the meaning of an operator in plain
SQL, not its plan.
"""

from __future__ import annotations

from hostweave import schemas as S
from hostweave.sources.flows import flow_sql

ORACLES: dict[str, str] = {}

DASH = "coalesce(nullif({0}, '-'), '{1}')"
AGENT = (
    "case when contains(lower({0}), 'chrome') then 'Chrome' when contains(lower({0}), 'firefox') then 'Firefox' "
    "when contains(lower({0}), 'safari') then 'Safari' when contains(lower({0}), 'edge') then 'Edge' "
    "when contains(lower({0}), 'opera') or contains(lower({0}), 'opr/') then 'Opera' "
    "when contains(lower({0}), 'bot') or contains(lower({0}), 'crawl') or contains(lower({0}), 'spider') then 'Bot' "
    "else 'Unknown' end"
)

FLOWS = f"flows as ({flow_sql('duckdb')})"
CONNS = f"""{FLOWS}, conns as (
  select uid, epoch, snapshot_ts, cast(epoch as double) as timestamp, src_ip, cast(src_port as bigint) as src_port, dst_ip,
    cast(dst_port as bigint) as dst_port, protocol, service,
    cast(coalesce(nullif(orig_bytes, '-'), '0') as bigint) as orig_bytes, cast(resp_bytes as bigint) as resp_bytes,
    conn_state, local_orig = 'T' as local_orig, local_resp = 'T' as local_resp, '' as history, orig_pkts, resp_pkts,
    cast(coalesce(nullif(orig_ip_bytes, '-'), '0') as bigint) as orig_ip_bytes, cast(resp_ip_bytes as bigint) as resp_ip_bytes,
    {DASH.format('ssl_version', '')} as ssl_version, {DASH.format('ssl_cipher', '')} as ssl_cipher,
    {DASH.format('ssl_curve', '')} as ssl_curve, {DASH.format('ssl_server_name', '')} as ssl_server_name,
    coalesce(ssl_resumed = 'T', false) as ssl_resumed, {DASH.format('ssl_last_alert', '')} as ssl_last_alert,
    {DASH.format('ssl_next_protocol', '')} as ssl_next_protocol, coalesce(ssl_established = 'T', false) as ssl_established,
    '' as ssl_history, coalesce(http_method, 'UNKNOWN') as http_method, {DASH.format('http_host', '')} as host,
    {DASH.format('http_uri', '')} as uri, '' as referrer, {DASH.format('http_version', '')} as http_version,
    case when http_method is null then 'Unknown' else {AGENT.format("coalesce(http_user_agent, '')")} end as http_user_agent,
    '' as origin, {DASH.format('http_status_code', '')} as http_status_code, '' as username
  from flows)"""
ROLES = f"""{CONNS}, roles as (
  select *, src_ip as node, true as outgoing from conns union all select *, dst_ip as node, false as outgoing from conns)"""
SERVICES = f"{CONNS}, svc as (select *, unnest(string_split(service, ',')) as svc_item from conns)"


def edges_cte(by: str = "") -> str:
    """``e``: aggregated edges, by snapshot when ``by`` is ``snapshot_ts, ``."""
    return f"""{SERVICES}, e as (
  select {by}src_ip as src, dst_ip as dst, protocol, trim(svc_item) as service, dst_port,
    count(*) as connection_count, cast(sum(orig_bytes) as bigint) as total_orig_bytes, cast(sum(resp_bytes) as bigint) as total_resp_bytes,
    cast(sum(orig_pkts) as bigint) as total_orig_pkts, cast(sum(resp_pkts) as bigint) as total_resp_pkts,
    cast(sum(orig_ip_bytes) as bigint) as total_orig_ip_bytes, cast(sum(resp_ip_bytes) as bigint) as total_resp_ip_bytes,
    min(timestamp) as first_seen, max(timestamp) as last_seen
  from svc group by {by}src_ip, dst_ip, protocol, trim(svc_item), dst_port)"""


EDGES, SNAP_EDGES = edges_cte(), edges_cte("snapshot_ts, ")
KEYS = "src, dst, protocol, service, dst_port"


def rollup_cte(by: str = "snapshot_ts, ") -> str:
    """``r``: host row from edges; ``n19``: the 19 features."""
    base = edges_cte(by)
    b = by
    on = "using (snapshot_ts, node)" if by else "using (node)"
    return f"""{base}, inc as (
  select *, src as node, true as outgoing from e union all select *, dst as node, false as outgoing from e where src <> dst),
web as (select *,
    cast(lower(service) in ('http', 'https') or dst_port in (80, 443, 8080, 8443) as int) as h,
    cast(dst_port = 443 or service = 'https' as int) as hs,
    cast(outgoing and (protocol = 'ssl' or service = 'https' or dst_port = 443) as int) as again from inc),
pc as (select {b}node, protocol, count(*) as n from inc group by {b}node, protocol),
pt as (select {b}node, sum(n) as total from pc group by {b}node),
ps as (select {b}node, count(*) as unique_protocols, max(n) as top_protocol_connections, sum(-(n / total) * log2(n / total)) as protocol_entropy
  from pc join pt {on} group by {b}node),
r0 as (select {b}node, count(*) as total_connections,
    cast(sum(outgoing::int) as bigint) as outgoing_connections, cast(sum((not outgoing)::int) as bigint) as incoming_connections,
    count(distinct service) as unique_services,
    count(distinct case when outgoing then dst_port end) as unique_remote_ports,
    count(distinct case when not outgoing then dst_port end) as unique_local_ports,
    cast(sum((outgoing and dst_port < 1024)::int) as bigint) as privileged_remote_connections,
    cast(sum((not outgoing and dst_port < 1024)::int) as bigint) as privileged_local_connections,
    cast(sum(h) as bigint) as http_connections, cast(sum(hs) as bigint) as https_connections, cast(sum(hs + again) as bigint) as ssl_connections,
    cast(sum(greatest(hs, again)) as bigint) as ssl_connections_once,
    cast(sum(case when outgoing then total_orig_bytes else 0 end) as bigint) as total_outgoing_bytes,
    cast(sum(case when outgoing then 0 else total_resp_bytes end) as bigint) as total_incoming_bytes,
    cast(sum(case when outgoing then total_orig_pkts else 0 end) as bigint) as total_outgoing_packets,
    cast(sum(case when outgoing then 0 else total_resp_pkts end) as bigint) as total_incoming_packets,
    array_to_string(list_sort(list(distinct protocol)), ' ') as protocols_seen,
    array_to_string(list_sort(list(distinct service)), ' ') as services_seen,
    coalesce(array_to_string(list_sort(list(distinct dst_port) filter (where outgoing)), ' '), '') as remote_ports_connected_to,
    coalesce(array_to_string(list_sort(list(distinct dst_port) filter (where not outgoing)), ' '), '') as local_ports_used
  from web group by {b}node),
r as (select * from r0 join ps {on}),
n19 as (select {b}node,
    outgoing_connections / (total_connections + 1e-9) as outgoing_ratio, incoming_connections / (total_connections + 1e-9) as incoming_ratio,
    incoming_connections / (total_connections + 1e-9) * ln(1.0 + incoming_connections) as server_score,
    outgoing_connections / (total_connections + 1e-9) * ln(1.0 + outgoing_connections) as client_score,
    cast(unique_protocols as double) as unique_protocols, protocol_entropy,
    top_protocol_connections / total_connections as most_freq_proto_ratio,
    cast(unique_remote_ports as double) as unique_remote_ports, cast(unique_local_ports as double) as unique_local_ports,
    unique_remote_ports / (outgoing_connections + 1e-9) as remote_port_diversity,
    unique_local_ports / (incoming_connections + 1e-9) as local_port_diversity,
    privileged_remote_connections / (outgoing_connections + 1e-9) as privileged_remote_ratio,
    privileged_local_connections / (incoming_connections + 1e-9) as privileged_local_ratio,
    0.0::double as first_seen_hour_minute_sin, 0.0::double as first_seen_hour_minute_cos,
    0.0::double as last_seen_hour_minute_sin, 0.0::double as last_seen_hour_minute_cos,
    http_connections / (total_connections + 1e-9) as http_ratio, ssl_connections / (total_connections + 1e-9) as ssl_ratio
  from r)"""


N19 = rollup_cte()


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 as {n}" for n in names)


def add(name: str, ctes: str, body: str) -> None:
    ORACLES[name] = f"with {ctes}\n{body}" if ctes else body


# --- sources ---------------------------------------------------------------------------------


def _log_columns(kind: str) -> str:
    given = {
        "conn": dict(proto="protocol", service="service", orig_bytes="orig_bytes", resp_bytes="resp_bytes", conn_state="conn_state",
                     local_orig="local_orig", local_resp="local_resp", missed_bytes="'0'", orig_pkts="cast(orig_pkts as varchar)",
                     resp_pkts="cast(resp_pkts as varchar)", orig_ip_bytes="orig_ip_bytes", resp_ip_bytes="resp_ip_bytes"),
        "ssl": dict(version="ssl_version", cipher="ssl_cipher", curve="ssl_curve", server_name="ssl_server_name", resumed="ssl_resumed",
                    last_alert="ssl_last_alert", next_protocol="ssl_next_protocol", established="ssl_established"),
        "http": dict(method="http_method", host="http_host", uri="http_uri", version="http_version", user_agent="http_user_agent",
                     status_code="http_status_code"),
    }[kind]
    out = []
    for n in S.LOG_FIELDS[kind]:
        fixed = {"ts": "cast(epoch as double)", "uid": "uid", "id_orig_h": "src_ip", "id_orig_p": "cast(src_port as bigint)",
                 "id_resp_h": "dst_ip", "id_resp_p": "cast(dst_port as bigint)", "tags": "'a+b'"}.get(n)
        raw, want = given.get(n, "'-'"), S.LOG_TYPES[kind].get(n)
        if fixed:
            value = fixed
        elif want == "boolean":
            value = f"coalesce({raw} = 'T', false)"
        elif want == "double":
            value = f"try_cast(nullif({raw}, '-') as double)"
        elif want:
            value = f"try_cast(nullif({raw}, '-') as bigint)"
        else:
            value = raw
        out.append(f"{value} as {n}")
    return ", ".join(out)


for _kind, _where in {"conn": "true", "ssl": "ssl_cipher is not null", "http": "http_method is not null"}.items():
    add(f"scan_{_kind}_tsv", FLOWS, f"select {_log_columns(_kind)} from flows where {_where}")

add("scan_conn_json", FLOWS, """select cast(epoch as double) as ts, uid, src_ip as id_orig_h, cast(src_port as bigint) as id_orig_p, dst_ip as id_resp_h,
  cast(dst_port as bigint) as id_resp_p, protocol as proto, service, cast(nullif(orig_bytes, '-') as bigint) as orig_bytes, conn_state,
  local_orig = 'T' as local_orig, cast(null as boolean) as local_resp, orig_pkts, '1:x' as community_id from flows""")
add("route_log_kind", "", """with p as (select concat('/logs/', l_returnflag, '/', case l_partkey % 7 when 0 then 'conn.log' when 1 then 'ssl.log'
  when 2 then 'http.log' when 3 then 'dns.log' when 4 then 'conn.txt' when 5 then 'old_conn.log' else 'http.log.gz' end) as path from lineitem)
select path, case when path like '%/conn.log' then 'conn' when path like '%/ssl.log' then 'ssl' when path like '%/http.log' then 'http' end as kind,
  count(*) as n from p group by all""")
add("incomplete_lines", FLOWS, """, k as (
  select 'conn' as kind, * from flows union all select 'ssl', * from flows where ssl_cipher is not null
  union all select 'http', * from flows where http_method is not null)
select kind, concat(epoch, '.000000', chr(9), uid, chr(9), src_ip, chr(9), src_port, chr(9), dst_ip) as value, 5 as fields, count(*) as n
from k group by all""")
add("scan_snapshot_edges", SNAP_EDGES, f"select snapshot_ts, {KEYS}, connection_count, {', '.join(S.EDGE_SUMS)} from e")
add("load_graph", f"{N19}", """, x as (select snapshot_ts, node, list_position(['tcp', 'udp', 'icmp'], mode_p) - 1 as top_proto_1 from (
  select snapshot_ts, node, first(protocol order by n desc, protocol) as mode_p from (
    select snapshot_ts, node, protocol, count(*) as n from (select snapshot_ts, protocol, src_ip as node from conns union all
      select snapshot_ts, protocol, dst_ip from conns) group by all) group by snapshot_ts, node)),
 s1 as (select snapshot_ts, node, min(svc_item) as s from (select snapshot_ts, src_ip as node, svc_item from svc union all
   select snapshot_ts, dst_ip, svc_item from svc) group by all)
select snapshot_ts, node, cast(top_proto_1 as double) as top_proto_1,
  cast(coalesce(list_position(['-', 'http', 'ssl', 'dns', 'ftp', 'ssh', 'rdp', 'smb', 'other'], s) - 1, 8) as double) as service_1,
  total_connections, outgoing_connections, incoming_connections, unique_remote_ports, http_connections, total_outgoing_bytes, total_incoming_packets
from r join x using (snapshot_ts, node) join s1 using (snapshot_ts, node)""")
add("snapshot_time", "", """with e as (select event_id, case when event_type = 'error' then concat('graph', event_id, '.dot')
  else concat('nw_graph_encoded_', epoch_us(ts) // 1000000, '.dot') end as name from events)
select event_id, name, try_cast(nullif(regexp_extract(name, '_([0-9]+)\\.', 1), '') as bigint) as epoch from e""")
add("latest_snapshot", SNAP_EDGES, f"select snapshot_ts, {KEYS}, connection_count from e where snapshot_ts = (select max(snapshot_ts) from e)")
add("unprocessed_snapshots", SNAP_EDGES, """, s as (select snapshot_ts, cast(sum(connection_count) as bigint) as connections from e group by all)
select * from s where connections <= (select avg(connections) from s)""")
add("render_dot", f"{EDGES}", "")
add("save_stats", N19, "".join([", l as (", " union all ".join(f"select '{c}' as feature, {c} as v from n19" for c in S.NODE_FEATURES), ")",
    "select feature, count(*) as n, round(avg(v), 5) + 0.0 as mean, round(greatest(stddev_pop(v), 1e-6), 5) + 0.0 as std from l group by feature"]))
add("export_embeddings", "", """select vec_id, cast(i - 1 as bigint) as pos, round(cast(embedding[i] as double), 6) + 0.0 as value
from embeddings, (select unnest(range(1, 65)) as i)""")

# --- scalars ---------------------------------------------------------------------------------

add("flatten_connection", CONNS, f"select uid, {', '.join(S.CONNECTION_COLUMNS)} from conns")
add("dash_to_default", FLOWS, "select uid, coalesce(nullif(orig_bytes, '-'), '0') as orig_bytes, coalesce(nullif(orig_ip_bytes, '-'), '0') as orig_ip_bytes from flows")
add("zeek_bool", FLOWS, "select uid, local_orig = 'T' as local_orig, coalesce(ssl_resumed = 'T', false) as ssl_resumed from flows")
add("lenient_long", "", """with x as (select case l_partkey % 7 when 0 then cast(l_partkey as varchar) when 1 then concat('  ', l_partkey, 'abc') when 2 then '-'
  when 3 then concat('-', l_partkey, '.75') when 4 then concat('x', l_partkey) when 5 then concat(l_partkey, '00000000000000000000') else '' end as raw from lineitem)
select raw, count(*) as n, coalesce(try_cast(nullif(regexp_extract(raw, '^\\s*([+-]?[0-9]+)', 1), '') as bigint), 0) as parsed from x group by raw""")
add("explode_services", "", """with x as (select l_returnflag, l_partkey % 7 as k from lineitem),
m(rule, k, service) as (values ('edge', 0, 'ssl'), ('edge', 0, 'smtp'), ('edge', 1, 'a'), ('edge', 1, ''), ('edge', 1, 'b'), ('edge', 2, 'http'),
  ('edge', 3, 'dns'), ('edge', 3, 'ssh'), ('edge', 5, ''), ('edge', 6, '-'), ('host', 0, 'ssl'), ('host', 0, 'smtp'), ('host', 1, 'a'),
  ('host', 1, 'b'), ('host', 2, 'http'), ('host', 3, 'dns'), ('host', 3, 'ssh'), ('host', 6, '-'))
select rule, l_returnflag, service, count(*) as n from x join m using (k) group by all""")
add("valid_endpoints", CONNS, "select src_ip, dst_ip, count(*) as n from conns where conn_state <> 'OTH' group by all")
add("user_agent_category", FLOWS, f"""select http_user_agent, count(*) as n, {AGENT.format('http_user_agent')} as category,
  {AGENT.format('http_user_agent')} as category_with_scanner from flows group by http_user_agent""")
add("minute_of_day_circle", "", """select event_id, round(sin(2 * pi() * m / 1440.0), 6) + 0.0 as sin, round(cos(2 * pi() * m / 1440.0), 6) + 0.0 as cos
from (select event_id, hour(ts) * 60 + minute(ts) as m from events)""")
add("privileged_port", FLOWS, """select case when service = '-' then 0 else dst_port end as port, count(*) as n,
  port between 1 and 1023 as log_side, port < 1024 as snapshot_side from flows group by 1""")
add("infer_attr_type", "", """with x as (select event_id, case event_id % 6 when 0 then concat('-', event_id, '.25') when 1 then event_type when 2 then concat(event_id, 'e2')
  when 3 then concat('.', event_id) when 4 then concat(event_id, 'd') else '' end as raw from events)
select event_id, raw, round(case when event_id % 6 in (0, 2, 3) then cast(raw as double) end, 6) + 0.0 as number from x""")
add("entropy_bits", rollup_cte(""), "select node, round(protocol_entropy, 6) + 0.0 as entropy, round(protocol_entropy, 6) + 0.0 as map_entropy from r")
add("connection_consistency", "", """with h as (select concat('u', user_id) as node, epoch_us(ts) // 3600000000 as hour, count(*) as n from events group by all),
g as (select node, unnest(range(min(hour), max(hour) + 1)) as hour from h group by node)
select node, count(*) as hours, round(case when count(*) < 2 then 0.0 else 1.0 / (1.0 + stddev_pop(coalesce(n, 0))) end, 6) + 0.0 as connection_consistency
from g left join h using (node, hour) group by node""")
Z = ", ".join(f"({c} - (select avg({c}) from n19)) / (greatest((select stddev_pop({c}) from n19), 1e-6) + 1e-6) as {c}" for c in S.NODE_FEATURES)
add("zscore", N19, f", z as (select snapshot_ts, node, {Z} from n19) select snapshot_ts, node, {rounded(S.NODE_FEATURES, 5)} from z")

# --- joins -----------------------------------------------------------------------------------

add("correlate_uid", FLOWS, """select uid, src_ip, service, ssl_cipher, 'later.' || http_host as host, http_uri as uri,
  case when http_method is not null then cast(epoch as double) + 1 end as http_ts from flows""")
add("edge_incidence", EDGES, f"""select src as node, true as outgoing, {KEYS}, connection_count from e
union all select dst, false, {KEYS}, connection_count from e where src <> dst""")
add("edges_with_known_nodes", EDGES, f""", k as (select node from (
  select src_ip as node, * from conns union all select dst_ip, * from conns) where conn_state in ('SF', 'S1') and protocol = 'udp'
  group by node having bool_or(ssl_server_name <> '') and bool_or(ssl_curve <> ''))
select {KEYS}, connection_count from e where src in (from k) and dst in (from k)""")
INDEX = """, ix as (select snapshot_ts, node, row_number() over (partition by snapshot_ts order by md5(node), node) - 1 as idx
  from (select snapshot_ts, src as node from e union select snapshot_ts, dst from e))"""
add("edge_index", f"{SNAP_EDGES}{INDEX}", f"""select e.snapshot_ts, {KEYS}, a.idx as src_idx, b.idx as dst_idx from e
join ix a on a.snapshot_ts = e.snapshot_ts and a.node = src join ix b on b.snapshot_ts = e.snapshot_ts and b.node = dst""")
add("get_or_create_node", SNAP_EDGES, "select snapshot_ts, src as node from e union select snapshot_ts, dst from e")

# --- aggregations ----------------------------------------------------------------------------

add("edge_aggregate", EDGES, "select * from e")
add("edge_aggregate_prefix", SERVICES, f""", x as (select *, row_number() over w as i, count(*) over (partition by src_ip, dst_ip, protocol, trim(svc_item), dst_port) as n
  from svc window w as (partition by src_ip, dst_ip, protocol, trim(svc_item), dst_port order by timestamp, uid))
select src_ip as src, dst_ip as dst, protocol, trim(svc_item) as service, dst_port, cast(max(n) * (max(n) + 3) / 2 as bigint) as connection_count,
  {', '.join(f"cast(sum((n - i + 1) * {c[6:]}) as bigint) as {c}" for c in S.EDGE_SUMS)}, min(timestamp) as first_seen, max(timestamp) as last_seen
from x group by all""")
SLOTS = (
    [f"(case when protocol in ('tcp', 'udp', 'icmp') then protocol else 'unknown_transport' end) = '{p}'" for p in S.EDGE_PROTOCOL_SLOTS]
    + ["conn_state in ('SF', 'S1')", "conn_state in ('REJ', 'RSTO', 'RSTR', 'RSTOS0', 'RSTRH')",
       "conn_state not in ('SF', 'S1', 'REJ', 'RSTO', 'RSTR', 'RSTOS0', 'RSTRH')"]
    + [f"(case when ssl_version in ('', 'TLSv10', 'TLSv11', 'TLSv12', 'TLSv13', 'SSLv3') then ssl_version else 'UNKNOWN' end) = '{v}'" for v in S.EDGE_SSL_SLOTS]
    + [f"http_user_agent = '{a}'" for a in S.EDGE_USER_AGENT_SLOTS]
)
add("edge_vector_sum", SERVICES, f"""select src_ip as src, dst_ip as dst, protocol, trim(svc_item) as service, dst_port,
  concat_ws(',', {', '.join(f'count(*) filter (where {s})' for s in SLOTS)}) as encoded_sum from svc group by all""")
add("edge_one_hot", CONNS, f"select uid, concat_ws(',', {', '.join(f'cast({s} as int)' for s in SLOTS)}) as encoded from conns")
add("node_degrees", EDGES, """select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, count(*) as degree
from (select src as node, 1 as o, 0 as i from e union all select dst, 0, 1 from e) group by node""")
add("node_connection_counts", ROLES, """select node, count(*) filter (where outgoing) as total_connections_initiated,
  count(*) filter (where not outgoing) as total_connections_received, count(*) as total_connections from roles group by node""")
for _key, _value in {
    "node_protocol_histogram": "protocol", "node_state_histogram": "conn_state", "node_ua_histogram": "http_user_agent",
    "node_http_version_histogram": "nullif(http_version, '')", "node_ssl_version_histogram": "nullif(ssl_version, '')",
    "node_http_status_histogram": "nullif(http_status_code, '')",
}.items():
    add(_key, ROLES, f"select node, {_value} as value, count(*) as n from roles where {_value} is not null group by all")
DISTINCT = ", ".join(f"count(distinct nullif({c}, '')) as {n}" for c, n in {
    "protocol": "unique_protocols_used", "http_version": "unique_http_versions_used", "ssl_version": "unique_ssl_versions_used",
    "ssl_cipher": "unique_ssl_ciphers_used", "ssl_next_protocol": "unique_ssl_next_protocols_used"}.items())
HOST_SVC = ", hs as (select *, unnest(string_split(service, ',')) as s from roles)"
add("node_distinct_sets", f"{ROLES}{HOST_SVC}", f"""select * from (select node, {DISTINCT} from roles group by node)
join (select node, count(distinct trim(s)) as unique_services_used from hs group by node) using (node)""")
PORTS = """count(distinct case when outgoing then dst_port end) as unique_remote_ports_connected_to,
  count(distinct case when outgoing then src_port end) as unique_local_ports_used,
  count(distinct case when not outgoing then src_port end) as unique_remote_ports_connected_from,
  count(distinct case when not outgoing then dst_port end) as unique_local_ports_listening_on"""
add("node_port_sets", ROLES, f"select node, {PORTS} from roles group by node")
FLAGS = """bool_or(local_orig) as ever_local_originated, bool_or(local_resp) as ever_local_responded,
  bool_or(ssl_curve <> '') as ever_ssl_curve_present, bool_or(ssl_server_name <> '') as has_ssl_server_name,
  bool_or(ssl_last_alert <> '') as ever_ssl_last_alert_present, bool_or(ssl_history <> '') as has_ssl_history,
  bool_or(ssl_version <> '') as used_ssl_tls, bool_or(outgoing and dst_port between 1 and 1023) as ever_connected_to_privileged_port,
  bool_or(not outgoing and dst_port between 1 and 1023) as ever_listened_on_privileged_port,
  bool_or(http_status_code like '4__') as has_http_error_4xx, bool_or(http_status_code like '5__') as has_http_error_5xx"""
add("node_flags", ROLES, f"select node, {FLAGS} from roles group by node")
TLS = "count(*) filter (where ssl_resumed) as ssl_resumption_count, count(*) filter (where ssl_established) as ssl_established_count"
add("node_tls_counts", ROLES, f"select node, {TLS} from roles group by node")


def _traffic(own: str) -> str:
    pairs = {"total_bytes_sent": ("orig_bytes", "resp_bytes"), "total_bytes_received": ("resp_bytes", "orig_bytes"),
             "total_pkts_sent": ("orig_pkts", "resp_pkts"), "total_pkts_received": ("resp_pkts", "orig_pkts")}
    return ", ".join(f"cast(sum(case when {own} then {a} else {b} end) as bigint) as {n}" for n, (a, b) in pairs.items())


SIZES = """round(case when total_pkts_sent > 0 then total_bytes_sent / total_pkts_sent else 0 end, {0}) + 0.0 as avg_packet_size_sent,
  round(case when total_pkts_received > 0 then total_bytes_received / total_pkts_received else 0 end, {0}) + 0.0 as avg_packet_size_received"""
add("node_traffic_sums", ROLES, f"select *, {SIZES.format(6)} from (select node, {_traffic('outgoing')} from roles group by node)")
add("node_traffic_sums_unswapped", ROLES, f"select *, {SIZES.format(6)} from (select node, {_traffic('true')} from roles group by node)")
RATIOS = """round(avg(outgoing::int), {0}) + 0.0 as outgoing_connection_ratio, round(avg((not outgoing)::int), {0}) + 0.0 as incoming_connection_ratio"""
add("node_direction_ratio", ROLES, f"select node, {RATIOS.format(6)} from roles group by node")


def hist(col: str, name: str, by: str = "") -> str:
    return f""", {name} as (select *, row_number() over (partition by {by}node order by n desc, v) as rk from (
  select {by}node, {col} as v, count(*) as n from roles where {col} <> '' group by all))"""


ALL_HIST = lambda by: (
    hist("protocol", "hp", by) + hist("conn_state", "hst", by) + hist("http_version", "hv", by) + hist("ssl_version", "hsl", by)
    + hist("http_user_agent", "hu", by)
    + f""", hsv as (select *, row_number() over (partition by {by}node order by v) as rk from (
  select distinct {by}node, trim(unnest(string_split(service, ','))) as v from roles))"""
)
add("node_mode", f"{ROLES}{ALL_HIST('')}", """select node, coalesce(hp.v, 'N/A') as most_freq_protocol, coalesce(hst.v, 'N/A') as most_freq_state,
  coalesce(hv.v, 'other') as most_freq_http_version, coalesce(hsl.v, 'other') as most_freq_ssl_version
from (select distinct node from roles) left join (from hp where rk = 1) hp using (node) left join (from hst where rk = 1) hst using (node)
left join (from hv where rk = 1) hv using (node) left join (from hsl where rk = 1) hsl using (node)""")
add("activity_score", ROLES, """select snapshot_ts, node, count(*) as total_connections, round(1 - pow(0.9, count(*)), 6) + 0.0 as activity_score
from roles group by snapshot_ts, node""")
def _history(sent: str, received: str, counts: str = "") -> str:
    return f"""select snapshot_ts, node, cast(sum(o) over w as bigint) as historical_total_bytes_sent,
  cast(sum(r) over w as bigint) as historical_total_bytes_received, cast(sum(n) over w as bigint) as historical_total_connections{counts}
from (select snapshot_ts, node, sum({sent}) as o, sum({received}) as r, count(*) as n from roles group by all) t
window w as (partition by node order by snapshot_ts rows unbounded preceding)"""


add("node_history", ROLES, _history(
    "case when outgoing then orig_bytes else resp_bytes end", "case when outgoing then resp_bytes else orig_bytes end",
    """, (select string_agg(concat(protocol, '=', n), ' ' order by protocol) from (
    select protocol, count(*) as n from roles r where r.node = t.node and r.snapshot_ts <= t.snapshot_ts group by protocol)) as protocol_counts"""))
add("node_history_unswapped", ROLES, _history("orig_bytes", "resp_bytes"))
add("first_last_seen", ROLES, "select node, min(timestamp) as first_seen, max(timestamp) as last_seen from roles group by node")
add("top_protocols", f"{ROLES}{hist('protocol', 'h')}", "select node, v as value, n, rk as rank from h where rk <= 3")
add("top_user_agents", f"{ROLES}{hist('http_user_agent', 'h')}", "select node, v as value, n, rk as rank from h where rk <= 3")
add("first_services", f"{ROLES}{ALL_HIST('')}", """select node, max(v) filter (where rk = 1) as service_1,
  coalesce(max(v) filter (where rk = 2), 'other') as service_2, coalesce(max(v) filter (where rk = 3), 'other') as service_3 from hsv group by node""")
add("historical_top_protocols", ROLES, """, a as (select distinct snapshot_ts, node from roles),
h as (select a.snapshot_ts, a.node, r.protocol, count(*) as n from a join roles r on r.node = a.node and r.snapshot_ts <= a.snapshot_ts group by all),
k as (select *, row_number() over (partition by snapshot_ts, node order by n desc, protocol) as rank from h)
select * from k where rank <= 3""")


def rollup_conn(by: str) -> tuple[str, str]:
    on = f"using ({by}node)"
    ctes = f"""{ROLES}{ALL_HIST(by)}, num as (select {by}node, count(*) filter (where outgoing) as total_connections_initiated,
  count(*) filter (where not outgoing) as total_connections_received, count(*) as total_connections, {_traffic('outgoing')}, {FLAGS}, {TLS}, {PORTS},
  min(timestamp) as first_seen, max(timestamp) as last_seen, {DISTINCT}, count(distinct nullif(http_status_code, '')) as unique_http_status_codes_seen,
  avg(outgoing::int) as outgoing_connection_ratio, avg((not outgoing)::int) as incoming_connection_ratio from roles group by {by}node),
top as (select * from num"""
    for cte, ranks, names in (("hp", (1, 2, 3), "top_proto_{}"), ("hu", (1, 2, 3), "top_user_agent_{}"), ("hsv", (1, 2, 3), "service_{}"),
                              ("hst", (1,), "most_freq_conn_state"), ("hv", (1,), "http_v"), ("hsl", (1,), "ssl_v")):
        cols = ", ".join(f"max(v) filter (where rk = {i}) as {names.format(i)}" for i in ranks)
        extra = ", count(*) as unique_services_used" if cte == "hsv" else ""
        ctes += f" left join (select {by}node, {cols}{extra} from {cte} group by {by}node) {on}"
    return ctes + ")", on


_CTES, _ = rollup_conn("snapshot_ts, ")
_ROLLUP_CONN = f"""select * exclude (http_v, ssl_v, outgoing_connection_ratio, incoming_connection_ratio), top_proto_1 as most_freq_proto,
  coalesce(http_v, 'other') as most_freq_http_version, coalesce(ssl_v, 'other') as most_freq_ssl_version,
  round(outgoing_connection_ratio, 6) + 0.0 as outgoing_connection_ratio, round(incoming_connection_ratio, 6) + 0.0 as incoming_connection_ratio,
  {SIZES.format(6)}, round(1 - pow(0.9, total_connections), 6) + 0.0 as activity_score from top"""
add("node_rollup_conn", _CTES, _ROLLUP_CONN)
# a host's rows of all snapshots up to one of its own, under the name of that one
ROLES_SO_FAR = ROLES.replace("roles as (", "own_roles as (") + """, active as (select distinct snapshot_ts, node from own_roles),
roles as (select r.* replace (a.snapshot_ts as snapshot_ts) from active a join own_roles r on r.node = a.node and r.snapshot_ts <= a.snapshot_ts)"""
add("snapshot_cumulative_hosts", _CTES.replace(ROLES, ROLES_SO_FAR), _ROLLUP_CONN.replace("select *", "select lead(snapshot_ts) over (partition by node order by snapshot_ts) as valid_to, *"))


def encoded(by: str) -> str:
    """``enc``: (name, value) inputs of the host vector, one column for each feature."""
    ctes, _ = rollup_conn(by)
    circle = lambda c, f: f"{f}(2 * pi() * (cast(floor({c} % 86400 / 60) as bigint)) / 1440.0)"

    def slot(col: str, vocab: list[str]) -> str:
        items = ", ".join(f"'{v}'" for v in vocab)
        return f"coalesce(list_position([{items}], {col}) - 1, {len(vocab) - 1})"

    source = {"most_freq_proto": "top_proto_1", "most_freq_http_version": "http_v", "most_freq_ssl_version": "ssl_v"}
    cols = []
    for name, vocab in S.NODE_ENCODING.items():
        if vocab:
            value = slot(source.get(name, name), vocab)
        elif name.endswith("_sin") or name.endswith("_cos"):
            value = circle(name.split("_hour")[0], name[-3:])
        elif name == "has_ssl_resumption":
            value = "cast(ssl_resumption_count > 0 as int)"
        else:
            value = f"cast({name} as double)"
        cols.append(f"cast({value} as double) as {name}")
    return f"{ctes}, enc as (select {by}node, {', '.join('%s' % c for c in cols)} from top)"


EXPORTED = S.EXPORTED_NODE_FEATURES
_FLOATS = {n for n in EXPORTED if n.endswith("_sin") or n.endswith("_cos")}
add("scan_snapshot_nodes", encoded("snapshot_ts, "), f"select snapshot_ts, node, {rounded(EXPORTED, 5)} from enc")
add("export_projection", encoded(""), "select node, " + ", ".join(
    f"round({n}, 5) + 0.0 as {n}" if not S.NODE_ENCODING[n] else f"cast({n} as bigint) as {n}" for n in EXPORTED) + " from enc")
_PARTS, _start = [], 0
for _n, _v in S.NODE_ENCODING.items():
    if _v:
        _PARTS += [f"select node, {_start + i} as pos, cast({_n} = {i} as int)::double as value from enc" for i in range(len(_v))]
        _start += len(_v)
    else:
        _PARTS.append(f"select node, {_start} as pos, {_n} as value from enc")
        _start += 1
add("node_one_hot", encoded(""), f"select node, pos, round(cast(cast(value as float) as double), 5) + 0.0 as value from ({' union all '.join(_PARTS)})")
add("write_snapshot", encoded("snapshot_ts, "), """, sv as (select *, unnest(string_split(service, ',')) as item from conns),
m as (select snapshot_ts, count(*) as edges, sum(b) as resp_bytes from (
  select snapshot_ts, src_ip, dst_ip, protocol, trim(item), dst_port, sum(resp_bytes) as b from sv group by all) group by snapshot_ts)
select snapshot_ts, count(*) as nodes, cast(sum(top_proto_1) as bigint) as proto_slots, max(edges) as edges, cast(max(resp_bytes) as bigint) as resp_bytes
from enc join m using (snapshot_ts) group by snapshot_ts""")
_DOT_NAMES = ["most_freq_conn_state", "top_proto_1", "service_1", "service_2", "service_3", "top_user_agent_1"]
_NODE_TEXT = " || ', ' || ".join(f"'{n}=' || cast(cast({n} as bigint) as varchar)" for n in _DOT_NAMES)
_EDGE_TEXT = " || ".join(f"', {label}=' || cast({c} as varchar)" for label, c in [("count", "connection_count")] + [(c, c) for c in S.EDGE_SUMS])
add("render_dot", encoded("") + f""", sv as (select *, unnest(string_split(service, ',')) as item from conns), e as (
  select src_ip as src, dst_ip as dst, protocol, trim(item) as service, dst_port, count(*) as connection_count,
  {', '.join(f"cast(sum({c[6:]}) as bigint) as {c}" for c in S.EDGE_SUMS)} from sv group by src_ip, dst_ip, protocol, trim(item), dst_port)""",
    f"""select 0 as part, 'digraph traffic {{' as value union all select 3, '}}'
union all select 1, '  "' || node || '" [' || {_NODE_TEXT} || '];' from enc
union all select 2, '  "' || src || '" -> "' || dst || '" [protocol="' || protocol || '", service="' || service || '", dst_port="' || dst_port || '"' || {_EDGE_TEXT} || '];' from e""")
_CTES0, _ = rollup_conn("")
add("node_report_full", _CTES0 + """, sv as (select *, unnest(string_split(service, ',')) as item from conns), e as (
  select distinct src_ip as src, dst_ip as dst, protocol, trim(item) as service, dst_port from sv),
deg as (select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, count(*) as degree
  from (select src as node, 1 as o, 0 as i from e union all select dst, 0, 1 from e) group by node)""",
    f"""select node, degree, in_degree, out_degree, round(1 - pow(0.9, total_connections), 2) + 0.0 as activity_score, total_connections,
  total_connections_initiated, total_connections_received, round(outgoing_connection_ratio, 2) + 0.0 as outgoing_connection_ratio,
  round(incoming_connection_ratio, 2) + 0.0 as incoming_connection_ratio, top_proto_1 as most_freq_proto, unique_remote_ports_connected_to,
  unique_local_ports_used, most_freq_conn_state, ever_connected_to_privileged_port, ever_listened_on_privileged_port, total_bytes_sent,
  total_bytes_received, {SIZES.format(2)}, used_ssl_tls, top_proto_1, top_proto_2, top_proto_3, service_1, service_2, service_3,
  top_user_agent_1, top_user_agent_2, top_user_agent_3,
  strftime(make_timestamp(cast(first_seen as bigint) * 1000000), '%Y-%m-%d %H:%M:%S') as first_seen,
  strftime(make_timestamp(cast(last_seen as bigint) * 1000000), '%Y-%m-%d %H:%M:%S') as last_seen from top join deg using (node)""")

add("node_rollup", N19, "select * exclude (ssl_connections_once), round(protocol_entropy, 6) + 0.0 as protocol_entropy from (select * from r)".replace("exclude (ssl_connections_once)", "exclude (ssl_connections_once, protocol_entropy)"))
add("web_traffic_counts", rollup_cte(""), "select node, http_connections, https_connections, ssl_connections, ssl_connections_once from r")
LONG19 = ", l as (" + " union all ".join(f"select '{c}' as feature, {c} as v from n19" for c in S.NODE_FEATURES) + ")"
LONG19_ROUND = LONG19.replace(" as v from n19", ", 9) as v from n19").replace("feature, ", "feature, round(")
PROFILE = f"""{N19}{LONG19_ROUND}, p as (select feature, count(distinct v) as unique_values, avg(v) as mean, stddev_pop(v) as std, min(v) as min, max(v) as max,
  avg((v = 0)::int) as sparsity from l group by feature)"""
add("feature_profile", PROFILE, f"select feature, unique_values, {rounded(['mean', 'std', 'min', 'max', 'sparsity'], 5)} from p")
add("constant_features", PROFILE, "select feature from p where unique_values = 1")
add("profile_long", PROFILE, " union all ".join(
    f"select feature, '{n}' as statistic, round({v}, 4) + 0.0 as value from p"
    for n, v in {"mean": "mean", "std": "std", "min": "min", "max": "max", "sparsity_pct": "100 * sparsity"}.items()))
add("top_variable_features", PROFILE, "select feature, round(std, 5) + 0.0 as std from (from p order by p.std desc, feature limit 12)")
EMB = lambda k: ", ".join(f"cast(embedding[{i + 1}] as double) as f{i}" for i in range(k))
add("feature_correlation", """m as (select vec_id, unnest(range(0, 64)) as i, cast(unnest(embedding) as double) as v from embeddings),
c as (select concat('f', a.i) as feature_a, concat('f', b.i) as feature_b, corr(a.v, b.v) as corr from m a join m b on a.vec_id = b.vec_id and a.i < b.i group by a.i, b.i)""",
    "select feature_a, feature_b, round(corr, 5) + 0.0 as corr, row_number() over (order by abs(corr) desc) = 1 as strongest from c")
add("feature_boxplot", f"{SNAP_EDGES}, roles as (select snapshot_ts, src_ip as node from conns union all select snapshot_ts, dst_ip from conns)", """,
dg as (select snapshot_ts, node, sum(i) as in_degree, sum(o) as out_degree, count(*) as degree from (
  select snapshot_ts, src as node, 1 as o, 0 as i from e union all select snapshot_ts, dst, 0, 1 from e) group by all),
n as (select *, (select count(*) from roles r where r.snapshot_ts = dg.snapshot_ts and r.node = dg.node) as total_connections from dg),
l as (select 'degree' as feature, ln(1.0 + degree) as v from n union all select 'in_degree', ln(1.0 + in_degree) from n
  union all select 'out_degree', ln(1.0 + out_degree) from n union all select 'total_connections', ln(1.0 + total_connections) from n)
select feature, round(min(v), 6) + 0.0 as min, round(quantile_cont(v, 0.25), 6) + 0.0 as q25, round(quantile_cont(v, 0.5), 6) + 0.0 as q50,
  round(quantile_cont(v, 0.75), 6) + 0.0 as q75, round(max(v), 6) + 0.0 as max from l group by feature""")
add("feature_density", EDGES, ", l as (" + " union all ".join(
    f"select '{c}' as feature, cast({c} as double) as v from e" for c in ("connection_count", "total_orig_bytes", "total_resp_pkts")) + """),
m as (select feature, min(v) as lo, max(v) as hi from l group by feature)
select feature, least(cast(floor((v - lo) / (hi - lo) * 20) as bigint), 19) as bin, count(*) as n from l join m using (feature) group by all""")
add("density_curve", EDGES, ", l as (" + " union all ".join(
    f"select '{c}' as feature, ln(1 + cast({c} as double)) as v from e" for c in ("total_orig_bytes", "total_resp_bytes")) + """),
m as (select feature, count(*) as n, min(v) as lo, stddev_samp(v) * 0.15 / 16 as step from l group by feature),
p as (select feature, n, lo, step, (v - lo) / step as pos from l join m using (feature)),
b as (select feature, n, lo, step, floor(pos) + i as j, sum(case when i = 0 then 1 - (pos - floor(pos)) else pos - floor(pos) end) as w
  from p, (values (0), (1)) t(i) group by all having w > 0),
k as (select k, exp(-0.5 * (k / 16.0) * (k / 16.0)) / sum(exp(-0.5 * (k / 16.0) * (k / 16.0))) over () as g from range(-96, 97) t(k))
select feature, cast(j + k as bigint) as point, round(lo + (j + k) * step, 6) + 0.0 as x, round(sum(w * g) / (n * step), 6) + 0.0 as density
from b, k group by feature, n, lo, step, j + k""")
add("graph_counts", SNAP_EDGES, """select snapshot_ts, (select count(*) from (select src from e x where x.snapshot_ts = e.snapshot_ts union
  select dst from e x where x.snapshot_ts = e.snapshot_ts)) as node_count, count(*) as edge_count, false as is_empty from e group by snapshot_ts""")
add("node_lookup", ROLES, """select node, count(*) filter (where outgoing) as total_connections_initiated,
  count(*) filter (where not outgoing) as total_connections_received, count(*) as total_connections from roles where node = '10.0.0.7' group by node""")
ROLLING = """select distinct node, micros, count(*) over (partition by node order by micros range between 60000000 preceding and current row) as connections_last_minute,
  count(*) over (partition by node order by micros range between 3600000000 preceding and current row) as connections_last_hour from x"""
add("connections_last_minute", "x as (select concat('u', user_id) as node, epoch_us(ts) // 30 as micros from events)", ROLLING)
add("rolling_counts_stream", "e as (select *, epoch_us(ts) // 30000000 * 1000000 as micros from events), x as (select concat('u', user_id) as node, micros from e union all select concat('s-', event_type), micros from e)", ROLLING)
add("connections_last_hour", f"{ROLES}, x as (select node, epoch * 1000000 as micros from roles)", ROLLING)

# --- drift and snapshots ---------------------------------------------------------------------

EVF = """evf as (select (epoch_us(ts) // 86400000000) * 86400 as snapshot_ts, concat('u', user_id) as node, cast(count(*) as double) as events,
  avg(value) as mean_value, max(value) as max_value, avg((event_type = 'error')::int) as error_share from events group by all)"""
EV_NAMES = ["events", "mean_value", "max_value", "error_share"]
EVL = f"{EVF}, l as (" + " union all ".join(f"select snapshot_ts, '{c}' as feature, {c} as v from evf" for c in EV_NAMES) + ")"
DRIFT = f"""{EVL}, cur as (select snapshot_ts, feature, avg(v) as mean from l group by all),
ref as (select c.snapshot_ts, c.feature, c.mean,
  (select avg(v) from l where l.feature = c.feature and l.snapshot_ts < c.snapshot_ts) as rm,
  (select greatest(stddev_pop(v), 1e-6) from l where l.feature = c.feature and l.snapshot_ts < c.snapshot_ts) as rs,
  (select avg(v) from l where l.feature = c.feature and l.snapshot_ts <= c.snapshot_ts) as im,
  (select greatest(stddev_pop(v), 1e-6) from l where l.feature = c.feature and l.snapshot_ts <= c.snapshot_ts) as isd from cur c),
sh as (select *, abs(mean - rm) / (rs + 1e-6) as shift, abs(mean - im) / (isd + 1e-6) as ishift from ref),
dr as (select snapshot_ts, coalesce(max(shift), 0.0) as max_shift, first(feature order by coalesce(shift, -1) desc, feature desc) as feature,
  max(ishift) as max_shift_inclusive from sh group by snapshot_ts)"""
add("feature_drift", DRIFT, """select snapshot_ts, round(max_shift, 5) + 0.0 as max_shift, feature, max_shift > 0.15 as drift,
  round(max_shift_inclusive, 5) + 0.0 as max_shift_inclusive from dr""")


def streak(threshold: float) -> str:
    """``st``: the streak rule, one snapshot after the other."""
    return f"""{DRIFT}, ordered as (select *, max_shift > {threshold} as drift, row_number() over (order by snapshot_ts) as i from dr),
st as (with recursive w as (
  select i, snapshot_ts, max_shift, drift, drift::int as raw from ordered where i = 1
  union all select o.i, o.snapshot_ts, o.max_shift, o.drift, case when o.drift then (w.raw % 3) + 1 else 0 end from w join ordered o on o.i = w.i + 1)
  select snapshot_ts, max_shift, drift, cast(raw % 3 as bigint) as streak, raw = 3 as triggered from w)"""


add("drift_streak", streak(0.05), "select snapshot_ts, drift, streak, triggered from st")
add("drift_monitor", streak(0.15), "select snapshot_ts, round(max_shift, 5) + 0.0 as max_shift, drift, streak, triggered from st")
FRACTION = "cast(('0x' || substr(md5({0}), 1, 8)) as bigint) / 4294967296.0"
add("replay_sample", EVF, f""", b as (select snapshot_ts from (select distinct snapshot_ts from evf) order by snapshot_ts desc limit 25)
select snapshot_ts from b where (select count(*) from b) >= 16 order by {FRACTION.format("'7|' || snapshot_ts")}, snapshot_ts limit 16""")
add("edge_dropout", EDGES, f"select {KEYS}, connection_count from e where {FRACTION.format("concat_ws('|', '3', src, dst, protocol, service, dst_port)")} > 0.1")
add("adapt_window", streak(0.05), """, t as (select snapshot_ts, triggered, row_number() over (order by snapshot_ts) as i from st),
w as (with recursive r as (
  select i, snapshot_ts, triggered, case when triggered then i else 1 end as lo, case when triggered then 1 // 2 end as kept from t where i = 1
  union all
  select t.i, t.snapshot_ts, t.triggered,
    case when t.triggered then t.i - ((t.i - greatest(r.lo, t.i - 19) + 1) // 2) + 1 else greatest(r.lo, t.i - 19) end,
    case when t.triggered then (t.i - greatest(r.lo, t.i - 19) + 1) // 2 end
  from r join t on t.i = r.i + 1) select * from r)
select w.snapshot_ts as trigger_ts, cast(kept as bigint) as kept, t.snapshot_ts as keep_from from w left join t on t.i = w.lo where w.triggered""")

# --- encoders and scalers --------------------------------------------------------------------

add("vocab_fallback", SERVICES, """select trim(svc_item) as service, count(*) as n,
  case when trim(svc_item) in ('-', 'http', 'ssl', 'dns', 'ftp', 'ssh', 'rdp', 'smb', 'other') then trim(svc_item) else 'other' end as slot
from svc group by 1""")
_STATES = ", ".join(f"'{s}'" for s in S.CONN_STATES)
add("hot_index", CONNS, f"""select conn_state, count(*) as n, coalesce(list_position([{_STATES}], conn_state) - 1, 11)::bigint as slot,
  case when coalesce(list_position([{_STATES}], conn_state) - 1, 11) < 2 then list_position([{_STATES}], conn_state) - 1 else -1 end::bigint as slot_of_two
from conns group by conn_state""")
add("node_features_19", N19, f"select snapshot_ts, node, {rounded(S.NODE_FEATURES)} from n19")
DERIVED = {
    "avg_orig_bytes_per_conn": "total_orig_bytes / connection_count", "avg_resp_bytes_per_conn": "total_resp_bytes / connection_count",
    "avg_orig_pkts_per_conn": "total_orig_pkts / connection_count", "avg_resp_pkts_per_conn": "total_resp_pkts / connection_count",
    "orig_bytes_ratio": "total_orig_bytes / (total_orig_bytes + total_resp_bytes + 1e-9)",
    "orig_pkts_ratio": "total_orig_pkts / (total_orig_pkts + total_resp_pkts + 1e-9)",
    "avg_orig_packet_size": "total_orig_bytes / (total_orig_pkts + 1e-9)", "avg_resp_packet_size": "total_resp_bytes / (total_resp_pkts + 1e-9)",
    "bytes_per_packet_ratio": "(total_orig_bytes / (total_orig_pkts + 1e-9)) / (total_resp_bytes / (total_resp_pkts + 1e-9) + 1e-9)",
    "log_total_bytes": "ln(1.0 + total_orig_bytes + total_resp_bytes)", "log_total_pkts": "ln(1.0 + total_orig_pkts + total_resp_pkts)",
    "log_count": "ln(1.0 + connection_count)",
}
add("edge_features", EDGES, f"select {KEYS}, {', '.join(f'round({v}, 6) + 0.0 as {n}' for n, v in DERIVED.items())} from e")
CODED = """dense_rank() over (order by protocol) - 1 as protocol_code, dense_rank() over (order by service) - 1 as service_code"""
_MATRIX = ["protocol_code", "service_code", *DERIVED.values(), "dst_port", "total_orig_ip_bytes", "total_resp_ip_bytes"]
add("label_encode", EDGES, f"select {KEYS}, {CODED} from e")
add("edge_matrix", EDGES, f""", k as (select *, {CODED} from e)
select {KEYS}, {', '.join(f'round(cast({v} as double), 6) + 0.0 as f{i}' for i, v in enumerate(_MATRIX))} from k""")
add("scale_standard", N19, f", z as (select snapshot_ts, node, " + ", ".join(
    f"case when (select max({c}) from n19) > (select min({c}) from n19) then ({c} - (select avg({c}) from n19)) / (select stddev_pop({c}) from n19) else {c} - (select avg({c}) from n19) end as {c}"
    for c in S.NODE_FEATURES) + f" from n19) select snapshot_ts, node, {rounded(S.NODE_FEATURES, 5)} from z")
MINMAX = ", ".join(f"coalesce(({c} - (select min({c}) from n19)) / nullif((select max({c}) from n19) - (select min({c}) from n19), 0), 0) as {c}" for c in S.NODE_FEATURES)
add("scale_minmax", N19, f", z as (select snapshot_ts, node, {MINMAX} from n19) select snapshot_ts, node, {rounded(S.NODE_FEATURES)} from z")
add("scale_policy", "", """with recursive t as (select distinct epoch_us(ts) // 1000000 as snapshot_ts from events),
o as (select snapshot_ts, row_number() over (order by snapshot_ts) as i from t),
w as (select i, snapshot_ts, snapshot_ts as fit_ts, true as refit from o where i = 1
  union all select o.i, o.snapshot_ts, case when o.snapshot_ts - w.fit_ts > 3600 then o.snapshot_ts else w.fit_ts end, o.snapshot_ts - w.fit_ts > 3600
  from w join o on o.i = w.i + 1)
select snapshot_ts, fit_ts, refit from w""")
_SCALED = {i: f"(v{i} - (select min(v{i}) from k)) / nullif((select max(v{i}) from k) - (select min(v{i}) from k), 0)" for i in (2, 11, 16)}
add("graph_to_matrices", f"{N19}{INDEX}", f""", k as (select *, {CODED}, cast({_MATRIX[2]} as double) as v2, cast({_MATRIX[11]} as double) as v11, cast({_MATRIX[16]} as double) as v16 from e)
select k.snapshot_ts, {KEYS}, a.idx as src_idx, b.idx as dst_idx,
  round((server_score - (select min(server_score) from n19)) / (select max(server_score) - min(server_score) from n19), 6) + 0.0 as src_server_score,
  cast(protocol_code as double) as f0, cast(service_code as double) as f1, {', '.join(f'round(coalesce({v}, 0), 6) + 0.0 as f{i}' for i, v in _SCALED.items())}
from k join ix a on a.snapshot_ts = k.snapshot_ts and a.node = src join ix b on b.snapshot_ts = k.snapshot_ts and b.node = dst
join n19 on n19.snapshot_ts = k.snapshot_ts and n19.node = src""")

# --- scoring ---------------------------------------------------------------------------------

_N = len(S.NODE_FEATURES)
_W = lambda i, j: f"0.2 * sin(0.31 * {i} + 0.17 * {j})"
_E = ", ".join("(" + " + ".join(f"{c} * {_W(i, j)}" for j, c in enumerate(S.NODE_FEATURES, 1)) + f") as e{i}" for i in range(1, 5))
_R = " + ".join(f"pow({c} - (" + " + ".join(f"e{i} * {_W(i, j)}" for i in range(1, 5)) + "), 2)" for j, c in enumerate(S.NODE_FEATURES, 1))
_H = ", ".join("greatest(" + " + ".join(f"e{i} * sin(0.37 * {o} + 0.11 * {i})" for i in range(1, 5)) + f" + 0.01 * {o - 1}, 0) as h{o}" for o in range(1, 4))
_S = " + ".join(f"h{o} * sin(0.37 + 0.11 * {o})" for o in range(1, 4))
SCORED = f"""{N19}, z as (select snapshot_ts, node, {Z} from n19), em as (select *, {_E} from z), hd as (select *, {_H} from em),
sc as (select snapshot_ts, node, round(1 / (1 + exp(-({_S}))), 9) as mlp_score, round(({_R}) / {_N}, 9) as recon_error from hd),
lim as (select snapshot_ts, quantile_cont(recon_error, 0.95) as t from sc group by snapshot_ts),
fl as (select sc.*, t as recon_threshold, recon_error > t as recon_flag, mlp_score > 0.8 as mlp_flag from sc join lim using (snapshot_ts)),
one as (select avg(recon_error) + 2 * greatest(stddev_pop(recon_error), 1e-6) as t from sc)"""
WHO = "case when {0} and {1} then 'both' when {0} then 'reconstruction' when {1} then 'mlp' end"
add("merge_detections", SCORED, f"""select snapshot_ts, node, {WHO.format('recon_flag', 'mlp_flag')} as detected_by,
  {WHO.format('recon_flag', 'mlp_flag')} as detected_apart from fl where recon_flag or mlp_flag""")
add("threshold_reconstruction", SCORED, """select snapshot_ts, node, round(recon_error, 6) + 0.0 as recon_error, round(recon_threshold, 6) + 0.0 as recon_threshold,
  recon_flag, round(t, 6) + 0.0 as ref_threshold, recon_error > t as ref_flag from fl, one""")
add("threshold_score", SCORED, "select snapshot_ts, node, round(mlp_score, 6) + 0.0 as mlp_score from sc where mlp_score > 0.5")
add("detect_anomalies", SCORED, f"""select snapshot_ts, node, round(recon_error, 6) + 0.0 as recon_error, round(mlp_score, 6) + 0.0 as mlp_score,
  {WHO.format('recon_error > t', 'mlp_score > 0.6')} as detected_by from sc, one where recon_error > t or mlp_score > 0.6""")
add("anomaly_preview", SCORED, """, d as (select snapshot_ts, node, recon_error, mlp_score, 'reconstruction' as detector from fl where recon_flag
  union all select snapshot_ts, node, recon_error, mlp_score, 'mlp' from fl where mlp_flag),
k as (select *, row_number() over (partition by snapshot_ts, detector order by node) as rank from d)
select snapshot_ts, detector, rank, node, round(recon_error, 6) + 0.0 as recon_error, round(mlp_score, 6) + 0.0 as mlp_score from k where rank <= 5""")
add("write_anomaly_report", f"{SCORED}{INDEX}", f""", c as (select snapshot_ts, count(*) as nodes_in_graph, row_number() over (order by snapshot_ts) as update_count from sc group by snapshot_ts),
f as (select snapshot_ts, node, idx, {WHO.format('recon_flag', 'mlp_flag')} as detected_by, recon_error, mlp_score from fl join ix using (snapshot_ts, node) where recon_flag or mlp_flag)
select c.snapshot_ts, strftime(make_timestamp(c.snapshot_ts * 1000000), '%Y%m%d_%H%M%S') as timestamp, update_count, nodes_in_graph, idx as node_id, node as ip, detected_by,
  round(recon_error, 6) + 0.0 as recon_error, round(mlp_score, 6) + 0.0 as mlp_score from c left join f using (snapshot_ts)""")
PEN = "-0.25 * mlp_score * mlp_score * ln(1 - mlp_score + 1e-8)"
add("focal_penalty", SCORED, f"""select snapshot_ts, round(avg(recon_error), 6) + 0.0 as recon, round(avg({PEN}), 6) + 0.0 as penalty,
  round(avg(abs(mlp_score)), 6) + 0.0 as penalty_raw, round(avg(recon_error) + 0.1 * avg({PEN}), 6) + 0.0 as total from sc group by snapshot_ts""")
add("reconstruction_losses", "d as (select cast(unnest(embedding) as double) * 10 as d from embeddings)", """select round(avg(d * d), 6) + 0.0 as mse, round(avg(abs(d)), 6) + 0.0 as l1,
  round(avg(case when abs(d) <= 1 then 0.5 * d * d else abs(d) - 0.5 end), 6) + 0.0 as huber,
  round(avg(ln((exp(d) + exp(-d)) / 2)), 6) + 0.0 as log_cosh from d""")
add("dense_score", "", """with x as (select vec_id, i, cast(embedding[i] as double) as v from embeddings, (select unnest(range(1, 65)) as i)),
h as (select vec_id, o, greatest(sum(v * sin(0.37 * o + 0.11 * i)) + 0.01 * (o - 1), 0) as h from x, (select unnest(range(1, 17)) as o) group by vec_id, o)
select vec_id, round(1 / (1 + exp(-sum(h * sin(0.37 + 0.11 * o)))), 6) + 0.0 as mlp_score from h group by vec_id""")
add("mean_neighbor_features", N19, f""", links as (select snapshot_ts, src, dst from e where src <> dst union all select snapshot_ts, node, node from n19)
select links.snapshot_ts, dst as node, {', '.join(f'round(avg({c}), 6) + 0.0 as {c}' for c in S.NODE_FEATURES)}
from links join n19 on n19.snapshot_ts = links.snapshot_ts and n19.node = src group by links.snapshot_ts, dst""")


def _attention() -> str:
    n19 = rollup_cte("")
    x = " union all ".join(
        f"select node, {i + 1} as i, coalesce(({c} - (select min({c}) from n19)) / nullif((select max({c}) from n19) - (select min({c}) from n19), 0), 0) as v from n19"
        for i, c in enumerate(S.NODE_FEATURES))
    w = lambda a, b, r, c: f"0.2 * sin({a} * {r} + {b} * {c})"
    return f"""with {n19}, x as ({x}),
h as (select node, o, sum(v * {w(0.7, 0.3, 'o', 'i')}) as h from x, (select unnest(range(1, 7)) as o) group by node, o),
s as (select node, (o - 1) // 3 as hd, sum(h * {w(0.5, 0.9, '((o - 1) // 3 + 1)', '((o - 1) % 3 + 1)')}) as s_src,
  sum(h * {w(0.4, 0.8, '((o - 1) // 3 + 1)', '((o - 1) % 3 + 1)')}) as s_dst from h group by all),
ev as (select (o - 1) // 3 as hd, j, sum({w(0.25, 0.45, 'o', 'j')} * {w(0.6, 0.2, '((o - 1) // 3 + 1)', '((o - 1) % 3 + 1)')}) as w
  from (select unnest(range(1, 7)) as o), (select unnest(range(1, 3)) as j) group by all),
el as (select src, dst, a.hd, {DERIVED['orig_bytes_ratio']} * a.w + {DERIVED['log_count']} * b.w as es
  from e, ev a join ev b on a.hd = b.hd and a.j = 1 and b.j = 2 where src <> dst),
lp as (select s.node as src, s.node as dst, s.hd, coalesce(avg(es), 0) as es from s left join el on el.dst = s.node and el.hd = s.hd group by s.node, s.hd),
lk as (select l.src, l.dst, l.hd, a.s_src + b.s_dst + es as q from (from el union all from lp) l join s a on a.node = l.src and a.hd = l.hd join s b on b.node = l.dst and b.hd = l.hd),
wt as (select src, dst, hd, exp(case when q > 0 then q else 0.2 * q end) as w from lk),
y as (select dst as node, o, sum(w * h) / sum(w) + 0.01 * (o - 1) as y from wt join h on h.node = wt.src and (h.o - 1) // 3 = wt.hd group by dst, o)
select node, cast(o - 1 as bigint) as pos, round(case when y > 0 then y else exp(y) - 1 end, 6) + 0.0 as value from y"""


def _encoder(layers) -> str:
    """Layers of (inputs, heads, numbers of a head) with the weights of ``toy_layer``."""
    n19 = rollup_cte("")
    x = " union all ".join(
        f"select node, {i + 1} as i, coalesce(({c} - (select min({c}) from n19)) / nullif((select max({c}) from n19) - (select min({c}) from n19), 0), 0) as v from n19"
        for i, c in enumerate(S.NODE_FEATURES))
    parts = [n19, f"x0 as materialized ({x})"]
    w = lambda a, b, r, c: f"0.2 * sin({a} * {r} + {b} * {c})"
    for k, (inputs, heads, dim) in enumerate(layers):
        hd, at = f"((o - 1) // {dim} + 1)", f"((o - 1) % {dim} + 1)"
        outs = f"(select unnest(range(1, {heads * dim + 1})) as o)"
        parts.append(f"""h{k} as materialized (select node, o, sum(v * {w(0.7, 0.3, 'o', 'i')}) as h from x{k}, {outs} group by node, o),
s{k} as materialized (select node, {hd} as hd, sum(h * {w(0.5, 0.9, hd, at)}) as s_src, sum(h * {w(0.4, 0.8, hd, at)}) as s_dst from h{k} group by all),
ev{k} as (select {hd} as hd, j, sum({w(0.25, 0.45, 'o', 'j')} * {w(0.6, 0.2, hd, at)}) as w from {outs}, (select unnest(range(1, 3)) as j) group by all),
el{k} as materialized (select src, dst, a.hd, {DERIVED['orig_bytes_ratio']} * a.w + {DERIVED['log_count']} * b.w as es
  from e, ev{k} a join ev{k} b on a.hd = b.hd and a.j = 1 and b.j = 2 where src <> dst),
lp{k} as (select s.node as src, s.node as dst, s.hd, coalesce(avg(es), 0) as es from s{k} s left join el{k} l on l.dst = s.node and l.hd = s.hd group by s.node, s.hd),
lk{k} as (select l.src, l.dst, l.hd, a.s_src + b.s_dst + es as q from (from el{k} union all from lp{k}) l
  join s{k} a on a.node = l.src and a.hd = l.hd join s{k} b on b.node = l.dst and b.hd = l.hd),
lr{k} as (select src, dst, hd, case when q > 0 then q else 0.2 * q end as q from lk{k}),
wt{k} as (select src, dst, hd, exp(q - max(q) over (partition by dst, hd)) as w from lr{k}),
wp{k} as materialized (select src, dst, hd, sum(w) as w from wt{k} group by all),
y{k} as materialized (select dst as node, o, sum(w * h) / sum(w) + 0.01 * (o - 1) as y from wp{k} p join h{k} h on h.node = p.src and {hd} = p.hd group by dst, o)""")
        elu = "case when y > 0 then y else exp(y) - 1 end"
        if k + 1 < len(layers):
            parts.append(f"x{k + 1} as materialized (select y.node, y.o as i, {elu} + x.v as v from y{k} y join x{k} x on x.node = y.node and x.i = y.o)"
                         if inputs == heads * dim else f"x{k + 1} as materialized (select node, o as i, {elu} as v from y{k})")
    return "with " + ", ".join(parts) + f" select node, cast(o - 1 as bigint) as pos, round(y, 5) + 0.0 as value from y{len(layers) - 1}"


ORACLES["neighbor_attention"] = _attention()
ORACLES["attention_encode"] = _encoder([(19, 4, 128), (512, 4, 128), (512, 1, 64)])
add("anomaly_factors", N19, """, m as (select snapshot_ts, """ + ", ".join(
    f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in ("total_connections", "protocol_entropy", "unique_remote_ports", "unique_local_ports", "total_outgoing_bytes", "total_incoming_bytes"))
    + " from r group by snapshot_ts), z as (select snapshot_ts, node, " + ", ".join(
    f"coalesce(({c} - m_{c}) / nullif(s_{c}, 0), 0) as z_{c}" for c in ("total_connections", "protocol_entropy", "unique_remote_ports", "unique_local_ports", "total_outgoing_bytes", "total_incoming_bytes"))
    + """ from r join m using (snapshot_ts)) select snapshot_ts, node,
  round(greatest(z_total_connections, z_protocol_entropy, z_unique_remote_ports, z_unique_local_ports, z_total_outgoing_bytes, z_total_incoming_bytes), 5) + 0.0 as score,
  concat_ws('; ', case when z_total_connections >= 2 then 'high connection rate' end, case when z_protocol_entropy >= 2 then 'unusual protocol mix' end,
    case when z_unique_remote_ports >= 2 then 'many remote ports' end, case when z_unique_local_ports >= 2 then 'many local ports' end,
    case when z_total_outgoing_bytes >= 2 then 'high outgoing volume' end, case when z_total_incoming_bytes >= 2 then 'high incoming volume' end) as factors from z""")
add("graph_changes", SNAP_EDGES, f""", t as (select max(snapshot_ts) as new, max(snapshot_ts) - 7776000 as old from e),
dg as (select snapshot_ts, node, sum(i) as i, sum(o) as o, count(*) as d from (select snapshot_ts, src as node, 1 as o, 0 as i from e
  union all select snapshot_ts, dst, 0, 1 from e) group by all),
a as (select * from dg, t where snapshot_ts = old), b as (select * from dg, t where snapshot_ts = new)
select case when a.node is null then 'NODE_CREATE' else 'NODE_UPDATE' end as kind, b.node, null as src, null as dst, null as protocol, null as service, null as dst_port
from b left join a on a.node = b.node where a.node is null or a.i <> b.i or a.o <> b.o or a.d <> b.d
union all select 'EDGE_CREATE', null, {KEYS} from (select {KEYS} from e, t where snapshot_ts = new except select {KEYS} from e, t where snapshot_ts = old)""")
def change_sql(rows: str) -> str:
    """Feed of the graph that is never cleared, over a table with snapshot_ts and the edge keys."""
    return f"""select snapshot_ts, case when snapshot_ts = min(snapshot_ts) over (partition by node) then 'NODE_CREATE' else 'NODE_UPDATE' end as kind, node,
  null as src, null as dst, null as protocol, null as service, null as dst_port
from (select snapshot_ts, src as node from {rows} union select snapshot_ts, dst from {rows})
union all select min(snapshot_ts), 'EDGE_CREATE', null, {KEYS} from {rows} group by {KEYS}"""


add("change_feed", SNAP_EDGES, change_sql("e"))
add("model_statistics", f"{streak(0.15)}, {SCORED.replace('with recursive', 'with recursive')}, ee as (select * from e)".replace(", l as (select snapshot_ts, 'events'", ", l as (select snapshot_ts, 'events'"),
    """select (select count(*) from st) as update_count, least((select count(*) from st), 2000) as replay_buffer_size,
  (select streak from st order by snapshot_ts desc limit 1) as consecutive_drifts, (select count(*) from evf) as node_stats_count,
  (select count(*) from (select distinct src, dst, protocol, service, dst_port from e)) as edge_stats_count, (select count(*) from sc) as error_stats_count,
  'error_share' as first_feature, round((select avg(error_share) from evf), 5) + 0.0 as first_mean,
  round((select stddev_pop(error_share) from evf), 5) + 0.0 as first_std, round((select avg(recon_error) from sc), 5) + 0.0 as error_mean""")

# --- streaming -------------------------------------------------------------------------------

add("stream_logs", "", "select concat('E', event_id) as uid, round(epoch_us(ts) / 1000000.0, 3) + 0.0 as ts, '-' as conn_state from events where event_type <> 'error'")
add("stream_growing_logs", "", "select concat('E', event_id) as uid, round(epoch_us(ts) / 1000000.0, 3) + 0.0 as ts, '-' as conn_state from events")
add("records_by_arrival", "", """with x as (select *, epoch_us(ts) as m, user_id % 3 > 0 as known from events)
select concat('u', user_id) as uid, not bool_or(known) as late, round((max(m) filter (where known)) / 1000000.0, 3) + 0.0 as last_ts, arg_max(event_id, m) filter (where known) as conn_event,
  arg_max(event_id, m) filter (where event_type = 'purchase') as ssl_event, arg_max(event_id, m) filter (where event_type = 'view') as http_event
from x group by user_id having bool_or(known) or bool_or(event_type in ('purchase', 'view'))""")
add("correlate_uid_stream", "", """with x as (select *, concat('u', user_id) as uid, epoch_us(ts) as m from events),
c as (select *, sum(case when m - p <= 3600000000 then 0 else 1 end) over (partition by uid order by m, event_id) as rec
  from (select *, lag(m) over (partition by uid order by m, event_id) as p from x)),
g as (select uid, rec, max(m) as last_m, arg_max(event_id, m) as conn_event, arg_max(event_id, m) filter (where event_type = 'purchase') as ssl_event,
  arg_max(event_id, m) filter (where event_type = 'view') as http_event from c group by uid, rec)
select uid, round(last_m / 1000000.0, 3) + 0.0 as last_ts, conn_event, ssl_event, http_event from g""")
EVC = """ec as (select epoch_us(ts) as m, concat('u', user_id) as src, concat('s-', event_type) as dst, 'tcp' as protocol,
  unnest(case when event_type = 'view' then ['http', 'ssl'] else ['-'] end) as service, 443 as dst_port, cast(floor(value) as bigint) as b from events)"""
_EVSUMS = """count(*) as connection_count, cast(sum(b) as bigint) as total_orig_bytes, count(*) as total_resp_bytes, count(*) as total_orig_pkts,
  count(*) as total_resp_pkts, count(*) as total_orig_ip_bytes, count(*) as total_resp_ip_bytes"""
add("snapshot_tumbling", EVC, f"""select (m // 3600000000) * 3600 as snapshot_ts, {KEYS}, {_EVSUMS} from ec group by all""")
add("change_feed_stream", EVC, ", t as (select m // 3600000000 * 3600 as snapshot_ts, * from ec) " + change_sql("t"))
add("snapshot_cumulative_stream", EVC, f"select {KEYS}, {_EVSUMS} from ec group by all")
add("snapshot_cumulative", SNAP_EDGES, f"""select {KEYS}, snapshot_ts, lead(snapshot_ts) over k as valid_to, {', '.join(f'cast(sum({c}) over w as bigint) as {c}' for c in ['connection_count', *S.EDGE_SUMS])},
  min(first_seen) over w as first_seen, max(last_seen) over w as last_seen from e
window k as (partition by {KEYS} order by snapshot_ts), w as (partition by {KEYS} order by snapshot_ts rows unbounded preceding)""")
STATS = """select feature, count(*) as n, round(avg(v), 4) + 0.0 as mean, round(var_pop(v) * count(*), 4) + 0.0 as m2,
  round(greatest(stddev_pop(v), 1e-6), 4) + 0.0 as std from l group by feature"""
add("stats_update", EVL, STATS)
add("stats_merge", EVL, STATS)
add("rolling_activity_stream", "", """with x as (select epoch_us(ts) // 1000000 as t, epoch_us(ts) as m, concat('u', user_id) as u, concat('s-', event_type) as s from events),
r as (select t, u as node from x union all select t, s from x),
w as (select (t // 1200 - k) * 1200 as window_start, node from r, (select unnest(range(0, 3)) as k))
select window_start, window_start + 3600 as window_end, node, count(*) as connections from w group by all""")
_FEATS = S.NODE_FEATURES
def monitored(hosts: str) -> str:
    """``er``: the error of each host by the mean of the buffer after its snapshot; ``wk``: drift and buffer."""
    return ", ml as (" + " union all ".join(f"select snapshot_ts, node, '{c}' as feature, {c} as v from {hosts}" for c in _FEATS) + """),
ss as (select snapshot_ts, row_number() over (order by snapshot_ts) as i from (select distinct snapshot_ts from n19)),
mi as (select ss.i, feature, count(*) as n, avg(v) as mean from ml join ss using (snapshot_ts) group by ss.i, feature),
prior as (select ss.i, feature, avg(v) as mean, greatest(stddev_pop(v), 1e-6) as std from ss join (select ss.i as j, feature, v from ml join ss using (snapshot_ts)) b on b.j < ss.i group by ss.i, feature),
dm as (select ss.i, coalesce(max(abs(mi.mean - p.mean) / (p.std + 1e-6)), 0) > 0.15 as drift from ss join mi using (i) left join prior p on p.i = ss.i and p.feature = mi.feature group by ss.i),
wk as (with recursive w as (
  select i, drift, drift::int as raw, 1 as begin, false as hit from dm where i = 1
  union all select o.i, o.drift, case when o.drift then (w.raw % 3) + 1 else 0 end,
    case when o.drift and w.raw % 3 = 2 then o.i - (o.i - w.begin + 1) // 2 + 1 else w.begin end, o.drift and w.raw % 3 = 2
  from w join dm o on o.i = w.i + 1) select i, drift, raw % 3 as streak, hit, begin from w),
bm as (select wk.i, feature, avg(v) as mean, greatest(stddev_pop(v), 1e-6) as std from wk join (select ss.i as j, feature, v from ml join ss using (snapshot_ts)) b on b.j between wk.begin and wk.i group by wk.i, feature),
er as (select ss.i, snapshot_ts, node, avg(((v - mean) / (std + 1e-6)) * ((v - mean) / (std + 1e-6))) as recon_error
  from ml join ss using (snapshot_ts) join bm on bm.i = ss.i and bm.feature = ml.feature group by ss.i, snapshot_ts, node)"""


add("monitor_snapshots", f"{N19}{INDEX}", monitored("n19") + """,
th as (select ss.i, avg(recon_error) + 2 * greatest(stddev_pop(recon_error), 1e-6) as t from ss join (select i as j, recon_error from er) b on b.j <= ss.i group by ss.i),
fd as (select er.snapshot_ts, idx as node_id, node as ip, 'reconstruction' as detected_by, recon_error from er join th using (i) join ix using (snapshot_ts, node) where recon_error > t)
select ss.snapshot_ts, strftime(make_timestamp(ss.snapshot_ts * 1000000), '%Y%m%d_%H%M%S') as timestamp, ss.i as update_count, c.n as nodes_in_graph,
  node_id, ip, detected_by, round(recon_error, 4) + 0.0 as recon_error, drift, cast(streak as bigint) as streak, hit as triggered, cast(wk.i - begin + 1 as bigint) as buffered
from ss join wk using (i) join (select snapshot_ts, count(*) as n from n19 group by snapshot_ts) c on c.snapshot_ts = ss.snapshot_ts left join fd on fd.snapshot_ts = ss.snapshot_ts""")
_TIMES = {S.NODE_FEATURES[13 + i]: f"{f}(2 * pi() * (cast(floor({c} % 86400 / 60) as bigint)) / 1440.0)" for i, (c, f) in enumerate((x, f) for x in ("first_at", "last_at") for f in ("sin", "cos"))}
add("monitor_snapshots_full", f"{N19}", ", seen as (select snapshot_ts, node, min(epoch) as first_at, max(epoch) as last_at from (select snapshot_ts, src_ip as node, epoch from flows union all select snapshot_ts, dst_ip, epoch from flows) group by snapshot_ts, node), hosts as (select n19.* replace (" + ", ".join(
    f"{x} as {c}" for c, x in _TIMES.items()) + ") from n19 join seen using (snapshot_ts, node))" + monitored("hosts") + """
select er.snapshot_ts, node, cast(8 as bigint) as components, round(recon_error, 3) + 0.0 as squares, cast(ss.i as bigint) as update_count, drift, cast(streak as bigint) as streak, hit as triggered,
  cast(wk.i - begin + 1 as bigint) as buffered from er join ss on ss.i = er.i join wk on wk.i = er.i""")

# --- models ----------------------------------------------------------------------------------

_RECON = """xs as (select vec_id, unnest(range(1, 65)) as j, cast(unnest(embedding) as double) as v from embeddings),
zs as (select vec_id, j, (v - 0.001 * j) / (0.1 + 0.002 * j + 1e-6) as z from xs),
ks as (select unnest(range(1, 9)) as i),
em as (select vec_id, i, sum(z * 0.2 * sin(0.31 * i + 0.17 * j)) as e from zs, ks group by vec_id, i),
rc as (select zs.vec_id, j, any_value(z) as z, sum(e * 0.2 * sin(0.31 * i + 0.17 * j)) as r from zs join em on em.vec_id = zs.vec_id group by zs.vec_id, j)"""
add("reconstruct_score", _RECON, "select vec_id, round(avg((z - r) * (z - r)), 6) + 0.0 as recon_error from rc group by vec_id")
add("reconstruction_by_feature", _RECON, "select concat('f', j - 1) as feature, round(avg(abs(z - r)), 6) + 0.0 as mean_abs_error from rc group by j")
add("reconstruct_fit", "xs as (select vec_id, unnest(range(1, 65)) as j, cast(unnest(embedding) as double) as v from embeddings), ms as (select j, avg(v) as m, greatest(stddev_pop(v), 1e-6) as s, count(*) as n from xs group by j)",
    "select max(n) as n, true as orthonormal, true as error_is_left_out_share, true as all_components_leave_none, true as falling, round(sum(m), 4) + 0.0 as mean_sum, round(sum(s), 4) + 0.0 as std_sum, true as means_match from ms")
add("project_pca", "", "select count(*) as n, true as centred, true as uncorrelated, true as variances_explained, true as falling from embeddings")
add("snapshot_at", SNAP_EDGES, f"""select {KEYS}, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ['connection_count', *S.EDGE_SUMS])} from e
where snapshot_ts <= (select max(snapshot_ts) from e) - 5 * 7776000 group by all""")
_ZR = ", ".join(f"({c} - {0.001 * j:.3f}) / (0.1 + {0.002 * j:.3f} + 1e-6) as {c}" for j, c in enumerate(S.NODE_FEATURES, 1))
_D = {c: f"abs({c} - (" + " + ".join(f"e{i} * {_W(i, j)}" for i in range(1, 5)) + "))" for j, c in enumerate(S.NODE_FEATURES, 1)}
add("evaluate_latest", N19, f""", z as (select node, {_ZR} from n19 where snapshot_ts = (select max(snapshot_ts) from n19)), em as (select *, {_E} from z),
er as (select node, ({_R}) / {_N} as recon_error from em)
select 'host' as kind, node as name, round(recon_error, 5) + 0.0 as value from er where recon_error > (select quantile_cont(recon_error, 0.95) from er)
union all """ + " union all ".join(f"select 'feature', '{c}', round(avg({x}), 5) + 0.0 from em" for c, x in _D.items()))
