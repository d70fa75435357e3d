"""One runnable query for each operator, over the star-schema test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from hostweave import functions as fn, schemas as S
from hostweave.operators import (
    attention, changes, connections as cx, detect, drift, edges as ed, features as ft, history, hosts as ho, scaling, stats,
    topology as tp,
)
from hostweave.plans import pipelines
from hostweave.session import cut, is_folder, prepare_session, work_path
from hostweave.sources import flows as fl, logs, snapshots as sn
from hostweave.streaming import arrivals, jobs, monitor

QUERIES: dict = {}
SNAP = ("snapshot_ts",)


def query(name: str):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return f(spark, sf_dir)

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        return run

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as 64 bits and floats rounded, so that two engines can be compared."""
    out = []
    for c, t in df.dtypes:
        if t in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("bigint").alias(c))
        elif t in ("double", "float"):
            # adding 0.0 turns a rounded -0.0 into 0.0
            out.append((F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def text_vector(column: str):
    """A vector of whole numbers as one text."""
    return F.array_join(F.transform(column, lambda v: v.cast("int").cast("string")), ",")


def conns(spark, d):
    return fl.connections(spark, d)


def stored_conns(spark, d):
    """Connections as a written table with the columns hosts and edges are made of: each of their passes reads them."""
    return cut(conns(spark, d).select(*S.GRAPH_COLUMNS), "connections")


def edges(spark, d, by=()):
    return ed.edge_aggregate(conns(spark, d), by)


def stored_edges(spark, d, by=SNAP):
    """Edges as a written table, for queries in which several steps read them."""
    return cut(edges(spark, d, by), "edges")


def hosts19(spark, d):
    """Host features as a written table: statistics, scaling and scoring all read them."""
    return cut(pipelines.host_features(None, stored_edges(spark, d)), "features")


def toy_scored(spark, d):
    """Hosts scored by a model with a head: mean and deviation of the rows themselves, four components
    and a small dense head with weights from a rule, so that SQL can follow the numbers."""
    rows = hosts19(spark, d)
    st = {r["feature"]: r for r in stats.with_std(stats.stats_update(rows, S.NODE_FEATURES)).collect()}  # 19 rows
    rule = toy_model(S.NODE_FEATURES, 4)
    mean, std = (tuple(st[c][v] for c in S.NODE_FEATURES) for v in ("mean", "std"))
    scored = detect.reconstruct_score(rows, detect.Reconstruction(rule.cols, mean, std, rule.components, rule.explained))
    scored = detect.dense_score(scored, "embedding", toy_head((4, 3, 1)))
    return cut(scored.select("snapshot_ts", "node", F.round("recon_error", 9).alias("recon_error"), F.round("mlp_score", 9).alias("mlp_score")), "scored")


def toy_model(names, k=8):
    """A linear autoencoder with numbers from a rule."""
    n = len(names)
    i, j = np.meshgrid(np.arange(1, k + 1), np.arange(1, n + 1), indexing="ij")
    components = 0.2 * np.sin(0.31 * i + 0.17 * j)
    return detect.Reconstruction(
        tuple(names), tuple((0.001 * np.arange(1, n + 1)).tolist()), tuple((0.1 + 0.002 * np.arange(1, n + 1)).tolist()),
        tuple(map(tuple, components.tolist())), (0.0,) * k,
    )


def toy_head(sizes=(64, 16, 1)):
    """A dense head with weights from a rule."""
    layers = []
    for a, b in zip(sizes, sizes[1:]):
        o, i = np.meshgrid(np.arange(b), np.arange(a), indexing="ij")
        layers.append((np.sin(0.37 * (o + 1) + 0.11 * (i + 1)), 0.01 * np.arange(b)))
    return layers


def toy_layer(inputs: int, edge_inputs: int, heads: int, dim: int, activate: bool) -> attention.AttentionLayer:
    """An attention layer with weights from a rule."""
    def grid(rows, cols, a, b):
        r, c = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
        return 0.2 * np.sin(a * (r + 1) + b * (c + 1))

    return attention.AttentionLayer(
        weight=grid(heads * dim, inputs, 0.7, 0.3), att_src=grid(heads, dim, 0.5, 0.9), att_dst=grid(heads, dim, 0.4, 0.8),
        att_edge=grid(heads, dim, 0.6, 0.2), edge_weight=grid(heads * dim, edge_inputs, 0.25, 0.45),
        bias=0.01 * np.arange(heads * dim), activate=activate,
    )


# --- scans, sources, sinks -------------------------------------------------------------------


def _lines(spark, d, kind):
    """Log lines of one kind, each with a commented copy and a cut-off copy that must be skipped."""
    good = cx.log_lines(cx.flow_log_fields(fl.flows(spark, d))[kind], kind)
    copies = F.array(F.col("value"), F.concat(F.lit("#"), F.col("value")), F.substring_index("value", "\t", 5), F.lit(""))
    return good.select(F.explode(copies).alias("value"))


def _log_folder(spark, lines, kind):
    """Lines as packed text files of a log folder in the shared work folder. A packed file is read by one
    task, so its lines are bounded."""
    path = work_path(spark, f"{kind}-logs")
    lines.select("value").write.option("maxRecordsPerFile", 1_000_000).text(path, compression="gzip")
    return path


def _scan(kind):
    def run(spark, d):
        rows = logs.typed(logs.scan_logs(spark, _log_folder(spark, _lines(spark, d, kind), kind), kind, pattern="part-*"), kind)
        if kind == "http":
            rows = rows.withColumn("tags", F.array_join("tags", "+"))
        return tidy(rows)
    return run


for _kind in S.LOG_FIELDS:
    query(f"scan_{_kind}_tsv")(_scan(_kind))


@query("scan_conn_json")
def scan_conn_json(spark, d):
    f = fl.flows(spark, d)
    value = F.concat(
        F.lit('{"ts":'), F.col("epoch"), F.lit(',"uid":"'), F.col("uid"), F.lit('","id.orig_h":"'), F.col("src_ip"),
        F.lit('","id.orig_p":'), F.col("src_port"), F.lit(',"id.resp_h":"'), F.col("dst_ip"), F.lit('","id.resp_p":'),
        F.col("dst_port"), F.lit(',"proto":"'), F.col("protocol"), F.lit('","service":"'), F.col("service"), F.lit('"'),
        F.when(F.col("orig_bytes") == "-", "").otherwise(F.concat(F.lit(',"orig_bytes":'), F.col("orig_bytes"))),
        F.lit(',"conn_state":"'), F.col("conn_state"), F.lit('","local_orig":'), (F.col("local_orig") == "T").cast("string"),
        F.lit(',"orig_pkts":'), F.col("orig_pkts"), F.lit(',"community_id":"1:x"}'),
    )
    rows = logs.scan_logs(spark, _log_folder(spark, f.select(value.alias("value")), "json"), "conn", "json", pattern="part-*")
    return tidy(rows.select(
        "ts", "uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "proto", "service", "orig_bytes", "conn_state",
        "local_orig", "local_resp", "orig_pkts", "community_id",
    ))


@query("route_log_kind")
def route_log_kind(spark, d):
    names = F.array(*[F.lit(n) for n in ("conn.log", "ssl.log", "http.log", "dns.log", "conn.txt", "old_conn.log", "http.log.gz")])
    li = fl.read_table(spark, d, "lineitem")
    path = F.concat(F.lit("/logs/"), F.col("l_returnflag"), F.lit("/"), F.get(names, F.pmod("l_partkey", F.lit(7)).cast("int")))
    return li.select(path.alias("path"), logs.route_log_kind(path).alias("kind")).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("incomplete_lines")
def incomplete_lines(spark, d):
    out = None
    for kind in S.LOG_FIELDS:
        bad = logs.bad_rows(_lines(spark, d, kind), kind)
        out = bad if out is None else out.unionByName(bad)
    return out.groupBy("kind", "value", "fields").agg(F.count(F.lit(1)).alias("n"))


def _encoded_nodes(spark, d, by=SNAP, connections=None):
    connections = stored_conns(spark, d) if connections is None else connections
    return ft.node_one_hot(ho.node_rollup_conn(connections, by), by)


def _exported(spark, d):
    return sn.encoded_node_columns(_encoded_nodes(spark, d), SNAP)


@query("scan_snapshot_nodes")
def scan_snapshot_nodes(spark, d):
    lines = cut(sn.render_nodes(_exported(spark, d), keep=SNAP), "lines")
    return tidy(sn.nodes_from_attributes(sn.parse_nodes(lines, SNAP), SNAP), 5)


@query("scan_snapshot_edges")
def scan_snapshot_edges(spark, d):
    lines = cut(sn.render_edges(edges(spark, d, SNAP), SNAP), "lines")
    return tidy(sn.edges_from_attributes(sn.parse_edges(lines, SNAP), SNAP))


@query("load_graph")
def load_graph(spark, d):
    e = cut(sn.render_edges(edges(spark, d, SNAP), SNAP), "lines")
    n = cut(sn.render_nodes(_exported(spark, d), keep=SNAP), "lines")
    e = cut(sn.edges_from_attributes(sn.parse_edges(e, SNAP), SNAP), "edges")
    n = sn.nodes_from_attributes(sn.parse_nodes(n, SNAP), SNAP)
    nodes, _ = tp.load_graph(n, e)
    return tidy(nodes.select(
        "snapshot_ts", "node", "top_proto_1", "service_1", "total_connections", "outgoing_connections",
        "incoming_connections", "unique_remote_ports", "http_connections", "total_outgoing_bytes", "total_incoming_packets",
    ))


@query("snapshot_time")
def snapshot_time(spark, d):
    e = fl.event_snapshots(spark, d)
    name = F.when(F.col("event_type") == "error", F.concat(F.lit("graph"), F.col("event_id"), F.lit(".dot"))).otherwise(
        F.concat(F.lit("nw_graph_encoded_"), F.floor(F.col("micros") / 1000000), F.lit(".dot"))
    )
    return e.select("event_id", name.alias("name"), sn.snapshot_time(name).alias("epoch"))


@query("latest_snapshot")
def latest_snapshot(spark, d):
    return tidy(sn.latest_snapshot(edges(spark, d, SNAP)).select("snapshot_ts", *S.EDGE_KEYS, "connection_count"))


@query("unprocessed_snapshots")
def unprocessed_snapshots(spark, d):
    snaps = edges(spark, d, SNAP).groupBy("snapshot_ts").agg(F.sum("connection_count").alias("connections"))
    mean = snaps.agg(F.avg("connections").alias("m"))
    done = snaps.crossJoin(F.broadcast(mean)).filter("connections > m").select("snapshot_ts")
    return sn.unprocessed_snapshots(snaps, done)


@query("write_snapshot")
def write_snapshot(spark, d):
    path = work_path(spark, "snapshots")
    nodes, e = pipelines.snapshot_tables(stored_conns(spark, d))
    sn.write_snapshot(nodes, e, path)
    nodes, e = sn.read_snapshots(spark, path)
    n = nodes.groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("nodes"), F.sum("top_proto_1").alias("proto_slots"))
    m = e.groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("edges"), F.sum("total_resp_bytes").alias("resp_bytes"))
    return tidy(n.join(m, "snapshot_ts").withColumn("snapshot_ts", F.col("snapshot_ts").cast("bigint")))


@query("render_dot")
def render_dot(spark, d):
    names = ["most_freq_conn_state", "top_proto_1", "service_1", "service_2", "service_3", "top_user_agent_1"]
    c = stored_conns(spark, d)
    nodes = sn.encoded_node_columns(_encoded_nodes(spark, d, (), c))
    return sn.render_dot(nodes, ed.edge_aggregate(c), names).select(F.col("part").cast("bigint").alias("part"), "value")


@query("node_report_full")
def node_report_full(spark, d):
    c = stored_conns(spark, d)
    degrees = ed.node_degrees(ed.edge_aggregate(c))
    return tidy(ho.node_report_full(ho.node_rollup_conn(c, degrees=degrees)), 2)


@query("write_anomaly_report")
def write_anomaly_report(spark, d):
    scored = toy_scored(spark, d)
    _, rows = pipelines.reports(scored)
    path = work_path(spark, "reports")
    detect.write_report_rows(rows, path)
    return tidy(detect.read_reports(spark, path))


@query("save_stats")
def save_stats(spark, d):
    path = work_path(spark, "stats")
    rows = hosts19(spark, d)
    stats.save_stats(stats.stats_update(rows.filter("snapshot_ts % 2 = 0"), S.NODE_FEATURES), path, 1)
    stats.save_stats(stats.stats_update(rows, S.NODE_FEATURES), path, 2)
    return tidy(stats.with_std(stats.load_stats(spark, path)).select("feature", "n", "mean", "std"), 5)


@query("export_embeddings")
def export_embeddings(spark, d):
    path = work_path(spark, "embeddings")
    detect.export_embeddings(fl.read_table(spark, d, "embeddings"), path, ["vec_id"])
    return tidy(spark.read.parquet(path).select("vec_id", F.posexplode("embedding").alias("pos", "value")))


# --- projections, filters, scalar functions --------------------------------------------------


@query("flatten_connection")
def flatten_connection(spark, d):
    return tidy(conns(spark, d).select("uid", *S.CONNECTION_COLUMNS))


@query("dash_to_default")
def dash_to_default(spark, d):
    f = fl.flows(spark, d)
    return f.select("uid", fn.dash_to_default("orig_bytes", "0").alias("orig_bytes"), fn.dash_to_default("orig_ip_bytes", "0").alias("orig_ip_bytes"))


@query("zeek_bool")
def zeek_bool(spark, d):
    return fl.flows(spark, d).select("uid", fn.zeek_bool("local_orig").alias("local_orig"), fn.zeek_bool("ssl_resumed").alias("ssl_resumed"))


def _odd_numbers():
    k, p = F.pmod("l_partkey", F.lit(7)), F.col("l_partkey").cast("string")
    return (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("  "), p, F.lit("abc"))).when(k == 2, "-")
        .when(k == 3, F.concat(F.lit("-"), p, F.lit(".75"))).when(k == 4, F.concat(F.lit("x"), p))
        .when(k == 5, F.concat(p, F.lit("00000000000000000000"))).otherwise("")
    )


@query("lenient_long")
def lenient_long(spark, d):
    li = fl.read_table(spark, d, "lineitem")
    return li.select(_odd_numbers().alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", "n", fn.lenient_long("raw").alias("parsed"))


def _odd_services():
    k = F.pmod("l_partkey", F.lit(7))
    return (
        F.when(k == 0, "ssl,smtp").when(k == 1, "a,,b").when(k == 2, "http,").when(k == 3, " dns , ssh ").when(k == 4, "")
        .when(k == 5, ",").otherwise("-")
    )


@query("explode_services")
def explode_services(spark, d):
    li = fl.read_table(spark, d, "lineitem").select("l_returnflag", _odd_services().alias("service"))
    both = None
    for rule, keep in (("edge", True), ("host", False)):
        part = ed.explode_services(li, keep).groupBy("l_returnflag", "service").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(rule))
        both = part if both is None else both.unionByName(part)
    return both


@query("valid_endpoints")
def valid_endpoints(spark, d):
    c = conns(spark, d).withColumn("src_ip", F.when(F.col("conn_state") == "OTH", "").otherwise(F.col("src_ip")))
    return tidy(cx.valid_endpoints(c).groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("n")))


@query("user_agent_category")
def user_agent_category(spark, d):
    f = fl.flows(spark, d)
    return f.groupBy("http_user_agent").agg(F.count(F.lit(1)).alias("n")).select(
        "http_user_agent", "n", fn.user_agent_category("http_user_agent").alias("category"),
        fn.user_agent_category("http_user_agent", scanner_rule=True).alias("category_with_scanner"),
    )


@query("minute_of_day_circle")
def minute_of_day_circle(spark, d):
    s, c = fn.minute_of_day_circle(F.col("micros") / 1000000)
    return tidy(fl.event_snapshots(spark, d).select("event_id", s.alias("sin"), c.alias("cos")))


@query("privileged_port")
def privileged_port(spark, d):
    f = fl.flows(spark, d).select(F.when(F.col("service") == "-", 0).otherwise(F.col("dst_port")).alias("port"))
    return tidy(f.groupBy("port").agg(F.count(F.lit(1)).alias("n")).select(
        "port", "n", fn.privileged_port_strict("port").alias("log_side"), fn.privileged_port("port").alias("snapshot_side")
    ))


@query("infer_attr_type")
def infer_attr_type(spark, d):
    e = fl.event_snapshots(spark, d)
    k = F.pmod("event_id", F.lit(6))
    raw = (
        F.when(k == 0, F.concat(F.lit("-"), F.col("event_id"), F.lit(".25"))).when(k == 1, F.col("event_type"))
        .when(k == 2, F.concat(F.col("event_id"), F.lit("e2"))).when(k == 3, F.concat(F.lit("."), F.col("event_id")))
        .when(k == 4, F.concat(F.col("event_id"), F.lit("d"))).otherwise("")
    )
    return tidy(e.select("event_id", raw.alias("raw"), fn.infer_attr_type(raw).alias("number")))


@query("export_projection")
def export_projection(spark, d):
    return tidy(sn.encoded_node_columns(_encoded_nodes(spark, d, ())), 5)


@query("entropy_bits")
def entropy_bits(spark, d):
    h = tp.protocol_histogram(stored_edges(spark, d, ()))
    packed = h.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("protocol", "n"))).alias("m"), F.sum("n").alias("total"))
    per = h.join(packed, "node").groupBy("node").agg(F.sum(fn.entropy_bits("n", "total")).alias("entropy"), F.max(fn.map_entropy_bits("m")).alias("map_entropy"))
    return tidy(per)


@query("connection_consistency")
def connection_consistency(spark, d):
    return tidy(ho.hourly_consistency(fl.event_snapshots(spark, d)))


@query("zscore")
def zscore(spark, d):
    rows = hosts19(spark, d)
    names = S.NODE_FEATURES
    return tidy(stats.zscore_columns(rows, names, stats.stats_update(rows, names)), 5)


# --- joins -----------------------------------------------------------------------------------


@query("correlate_uid")
def correlate_uid(spark, d):
    """Every http record comes twice, the second later with another host; some ssl rows have no
    conn row."""
    f = cut(fl.flows(spark, d).drop("snapshot_ts"), "flows")  # five tables are made of it
    parts = cx.flow_log_fields(f)
    later = parts["http"].withColumn("ts", (F.col("ts").cast("double") + 1).cast("string")).withColumn("host", F.concat(F.lit("later."), F.col("host")))
    orphan = parts["ssl"].withColumn("uid", F.concat(F.col("uid"), F.lit("-orphan")))
    # the fields of the result; a flow's uid settles all others but the address, so no tie falls otherwise than by whole rows
    shown = {"conn": ["id_orig_h", "service"], "ssl": ["cipher"], "http": ["ts", "host", "uri"]}
    merged = cx.correlate_uid(parts["conn"], parts["ssl"].unionByName(orphan), later.unionByName(parts["http"]), shown)
    return tidy(merged.select(
        "uid", F.col("conn.id_orig_h").alias("src_ip"), F.col("conn.service").alias("service"), F.col("ssl.cipher").alias("ssl_cipher"),
        F.col("http.host").alias("host"), F.col("http.uri").alias("uri"), F.col("http.ts").try_cast("double").alias("http_ts"),
    ))


@query("edge_incidence")
def edge_incidence(spark, d):
    return tidy(tp.edge_incidence(edges(spark, d)).select("node", "outgoing", *S.EDGE_KEYS, "connection_count"))


def _tls_hosts(spark, d):
    """Hosts that ever opened a TLS connection with a name; the known set of the join below."""
    c = conns(spark, d)
    return ho.node_flags(c.filter(F.col("conn_state").isin("SF", "S1") & (F.col("protocol") == "udp"))).filter("has_ssl_server_name and ever_ssl_curve_present").select("node")


@query("edges_with_known_nodes")
def edges_with_known_nodes(spark, d):
    return tidy(ed.edges_with_known_nodes(edges(spark, d), _tls_hosts(spark, d)).select(*S.EDGE_KEYS, "connection_count"))


@query("edge_index")
def edge_index(spark, d):
    return tidy(ed.edge_index(stored_edges(spark, d), SNAP).select("snapshot_ts", *S.EDGE_KEYS, "src_idx", "dst_idx"))


@query("merge_detections")
def merge_detections(spark, d):
    s = toy_scored(spark, d)
    flagged = cut(detect.threshold_score(detect.threshold_reconstruction(s)), "flagged")
    one = detect.merge_detections(flagged).select("snapshot_ts", "node", "detected_by")
    apart = detect.merge_separate_detections(flagged.filter("recon_flag"), flagged.filter("mlp_flag"), ["snapshot_ts", "node"])
    return one.join(apart.withColumnRenamed("detected_by", "detected_apart"), ["snapshot_ts", "node"], "full_outer")


@query("get_or_create_node")
def get_or_create_node(spark, d):
    return ed.node_set(edges(spark, d, SNAP), SNAP)


# --- aggregations ----------------------------------------------------------------------------


@query("edge_aggregate")
def edge_aggregate(spark, d):
    return tidy(edges(spark, d))


@query("edge_aggregate_prefix")
def edge_aggregate_prefix(spark, d):
    return tidy(ed.edge_aggregate(conns(spark, d), compat="prefix"))


@query("edge_vector_sum")
def edge_vector_sum(spark, d):
    return tidy(ed.edge_vector_sum(conns(spark, d)).withColumn("encoded_sum", text_vector("encoded_sum")))


@query("node_degrees")
def node_degrees(spark, d):
    return ed.node_degrees(edges(spark, d))


def _host_query(name, f, digits=6):
    query(name)(lambda spark, d: tidy(f(conns(spark, d)), digits))


_host_query("node_connection_counts", ho.node_connection_counts)
for _key, _k in {
    "node_protocol_histogram": "protocol", "node_state_histogram": "state", "node_ua_histogram": "user_agent",
    "node_http_version_histogram": "http_version", "node_ssl_version_histogram": "ssl_version", "node_http_status_histogram": "http_status",
}.items():
    _host_query(_key, lambda c, k=_k: ho.node_histogram(c, k))
_host_query("node_distinct_sets", ho.node_distinct_sets)
_host_query("node_port_sets", ho.node_port_sets)
_host_query("node_flags", ho.node_flags)
_host_query("node_tls_counts", ho.node_tls_counts)
_host_query("node_traffic_sums", ho.node_traffic_sums)
_host_query("node_traffic_sums_unswapped", lambda c: ho.node_traffic_sums(c, compat="unswapped"))
_host_query("node_direction_ratio", ho.node_direction_ratio)
_host_query("node_mode", ho.node_mode)
_host_query("activity_score", lambda c: ho.node_activity_score(c, SNAP))
_host_query("node_history", lambda c: history.node_history(c).withColumn("protocol_counts", F.array_join(F.transform("protocol_counts", lambda x: F.concat(x["protocol"], F.lit("="), x["n"].cast("string"))), " ")))
_host_query("node_history_unswapped", lambda c: history.node_history(c, compat="unswapped").drop("protocol_counts"))
query("node_rollup_conn")(lambda spark, d: tidy(ho.node_rollup_conn(stored_conns(spark, d), SNAP)))
_host_query("first_last_seen", ho.first_last_seen)
_host_query("top_protocols", lambda c: ho.top_categories(c, "protocol"))
_host_query("top_user_agents", lambda c: ho.top_categories(c, "user_agent"))
_host_query("first_services", ho.first_services)
_host_query("historical_top_protocols", history.historical_top_protocols)


@query("node_rollup")
def node_rollup(spark, d):
    r = tp.node_rollup(stored_edges(spark, d), SNAP, with_sets=True)
    for c in ("protocols_seen", "services_seen", "remote_ports_connected_to", "local_ports_used"):
        r = r.withColumn(c, F.array_join(F.col(c).cast("array<string>"), " "))
    return tidy(r.drop("protocol_counts", "service_counts"))


@query("web_traffic_counts")
def web_traffic_counts(spark, d):
    e = stored_edges(spark, d, ())
    once = tp.web_traffic_counts(e, dedupe_ssl=True).select("node", F.col("ssl_connections").alias("ssl_connections_once"))
    return tp.web_traffic_counts(e).join(once, "node")


def _profile(spark, d):
    """Profile of the host features at nine digits; below that, values differ by rounding alone."""
    return stats.feature_profile(tidy(hosts19(spark, d), 9), S.NODE_FEATURES)


@query("feature_profile")
def feature_profile(spark, d):
    return tidy(_profile(spark, d), 5)


def _embedding_columns(spark, d, k):
    df, names = detect.array_columns(fl.read_table(spark, d, "embeddings"), "embedding", k)
    return df.drop("embedding"), names


@query("feature_correlation")
def feature_correlation(spark, d):
    df, names = _embedding_columns(spark, d, 64)
    pairs = stats.feature_correlation(df, names)
    best = stats.strongest_correlation(pairs).select("feature_a", "feature_b", F.lit(True).alias("strongest"))
    return tidy(pairs.join(best, ["feature_a", "feature_b"], "left").fillna(False, ["strongest"]), 5)


@query("constant_features")
def constant_features(spark, d):
    return stats.constant_features(_profile(spark, d))


@query("profile_long")
def profile_long(spark, d):
    return tidy(stats.profile_long(_profile(spark, d)), 4)


@query("feature_boxplot")
def feature_boxplot(spark, d):
    names = ["degree", "in_degree", "out_degree", "total_connections"]
    c = conns(spark, d)
    n = cut(ed.node_degrees(ed.edge_aggregate(c, SNAP), SNAP).join(ho.node_connection_counts(c, SNAP), ["snapshot_ts", "node"]), "degrees")
    return tidy(stats.feature_boxplot(n, names, log1p=True))


@query("feature_density")
def feature_density(spark, d):
    e = stored_edges(spark, d, ())
    return tidy(stats.feature_density(e, ["connection_count", "total_orig_bytes", "total_resp_pkts"], 20))


@query("density_curve")
def density_curve(spark, d):
    e = stored_edges(spark, d, ())
    logs_ = e.select(*[F.log1p(F.col(c).cast("double")).alias(c) for c in ("total_orig_bytes", "total_resp_bytes")])
    return tidy(stats.density_curve(logs_, logs_.columns))


@query("reconstruction_by_feature")
def reconstruction_by_feature(spark, d):
    df, names = _embedding_columns(spark, d, 64)
    return tidy(stats.reconstruction_by_feature(detect.reconstruct_score(df, toy_model(names)), names))


@query("graph_counts")
def graph_counts(spark, d):
    return ed.graph_counts(stored_edges(spark, d), by=SNAP)


@query("node_lookup")
def node_lookup(spark, d):
    return tidy(ed.node_lookup(ho.node_connection_counts(conns(spark, d)), "10.0.0.7"))


# --- windows, sorts, top-k -------------------------------------------------------------------


@query("connections_last_minute")
def connections_last_minute(spark, d):
    """Minute and hour counts; the events are an hour's worth compressed 30 to 1."""
    e = fl.event_snapshots(spark, d).withColumn("micros", F.floor(F.col("micros") / 30))
    return ho.rolling_connections(e)


@query("connections_last_hour")
def connections_last_hour(spark, d):
    c = conns(spark, d)
    rows = ho.host_roles(c).select("node", (F.col("timestamp").cast("bigint") * 1000000).alias("micros"))
    return ho.rolling_connections(rows)


@query("top_variable_features")
def top_variable_features(spark, d):
    return tidy(stats.top_variable_features(_profile(spark, d), 12), 5)


@query("anomaly_preview")
def anomaly_preview(spark, d):
    flagged = detect.threshold_score(detect.threshold_reconstruction(toy_scored(spark, d)))
    return tidy(detect.anomaly_preview(flagged).select("snapshot_ts", "detector", "rank", "node", "recon_error", "mlp_score"))


# --- drift -----------------------------------------------------------------------------------


def _event_features(spark, d):
    """Per day and user: events, mean and largest value, share of errors."""
    e = fl.event_snapshots(spark, d)
    return cut(e.groupBy("snapshot_ts", "node").agg(
        F.count(F.lit(1)).cast("double").alias("events"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"),
        F.avg((F.col("event_type") == "error").cast("int")).alias("error_share"),
    ), "features")


EVENT_FEATURES = ["events", "mean_value", "max_value", "error_share"]


def _event_parts(spark, d):
    return cut(stats.stats_update(_event_features(spark, d), EVENT_FEATURES, SNAP), "parts")


@query("feature_drift")
def feature_drift(spark, d):
    parts = _event_parts(spark, d)
    prior = drift.feature_drift(parts)
    incl = drift.feature_drift(parts, reference="inclusive").select("snapshot_ts", F.col("max_shift").alias("max_shift_inclusive"))
    return tidy(prior.join(incl, "snapshot_ts"), 5)


@query("drift_streak")
def drift_streak(spark, d):
    return tidy(drift.drift_streak(drift.feature_drift(_event_parts(spark, d), threshold=0.05)).drop("max_shift", "feature"))


@query("replay_sample")
def replay_sample(spark, d):
    return drift.replay_sample(_event_features(spark, d), 16, 25, seed=7)


@query("edge_dropout")
def edge_dropout(spark, d):
    return tidy(drift.edge_dropout(edges(spark, d), S.EDGE_KEYS, 0.1, seed=3).select(*S.EDGE_KEYS, "connection_count"))


@query("adapt_window")
def adapt_window(spark, d):
    streak = drift.drift_streak(drift.feature_drift(_event_parts(spark, d), threshold=0.05))
    return drift.adapt_window(_event_features(spark, d), streak, 20)


# --- encoders and scalers --------------------------------------------------------------------


@query("edge_one_hot")
def edge_one_hot(spark, d):
    return ed.edge_one_hot(conns(spark, d)).withColumn("encoded", text_vector("encoded"))


@query("node_one_hot")
def node_one_hot(spark, d):
    return tidy(_encoded_nodes(spark, d, ()).select("node", F.posexplode("encoded").alias("pos", "value")), 5)


@query("vocab_fallback")
def vocab_fallback(spark, d):
    f = ed.explode_services(fl.flows(spark, d).select("service", "http_user_agent"))
    return f.groupBy("service").agg(F.count(F.lit(1)).alias("n")).select("service", "n", fn.vocab_fallback("service", S.SERVICES).alias("slot"))


@query("hot_index")
def hot_index(spark, d):
    c = conns(spark, d)
    v = fn.one_hot("conn_state", S.CONN_STATES)
    rows = c.groupBy("conn_state").agg(F.count(F.lit(1)).alias("n")).withColumn("v", v)
    return tidy(rows.select("conn_state", "n", fn.hot_index("v", 0, len(S.CONN_STATES)).alias("slot"), fn.hot_index("v", 0, 2).alias("slot_of_two")))


@query("node_features_19")
def node_features_19(spark, d):
    return tidy(hosts19(spark, d))


@query("edge_features")
def edge_features(spark, d):
    return tidy(ft.edge_features(edges(spark, d)).select(*S.EDGE_KEYS, *S.EDGE_DERIVED))


def _wide(df, names, column="features"):
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.col(column)[i].alias(n) for i, n in enumerate(names)])


@query("edge_matrix")
def edge_matrix(spark, d):
    return tidy(_wide(ft.edge_matrix(stored_edges(spark, d, ())), [f"f{i}" for i in range(17)]))


@query("label_encode")
def label_encode(spark, d):
    e = stored_edges(spark, d, ())
    return tidy(ft.label_encode(ft.label_encode(e, "protocol"), "service").select(*S.EDGE_KEYS, "protocol_code", "service_code"))


@query("scale_standard")
def scale_standard(spark, d):
    return tidy(scaling.scale(hosts19(spark, d), S.NODE_FEATURES, "standard")[0], 5)


@query("scale_minmax")
def scale_minmax(spark, d):
    return tidy(scaling.scale(hosts19(spark, d), S.NODE_FEATURES, "minmax")[0])


@query("scale_policy")
def scale_policy(spark, d):
    e = fl.event_snapshots(spark, d).select(F.floor(F.col("micros") / 1000000).alias("snapshot_ts"))
    return scaling.scale_policy(e)


@query("graph_to_matrices")
def graph_to_matrices(spark, d):
    m = ft.graph_to_matrices(stored_edges(spark, d), by=SNAP, node_scaling="minmax", edge_scaling="minmax")
    x = _wide(m["edges"], [f"f{i}" for i in range(17)])
    keys = ["snapshot_ts", *S.EDGE_KEYS]
    src = _wide(m["nodes"], S.NODE_FEATURES).select("snapshot_ts", F.col("idx").alias("src_idx"), F.col("server_score").alias("src_server_score"))
    return tidy(x.join(m["edge_index"], keys).join(src, ["snapshot_ts", "src_idx"]).select(*keys, "src_idx", "dst_idx", "src_server_score", "f0", "f1", "f2", "f11", "f16"))


# --- scoring ---------------------------------------------------------------------------------


@query("neighbor_attention")
def neighbor_attention(spark, d):
    e = stored_edges(spark, d, ())
    x = scaling.scale(pipelines.host_features(None, e, ()), S.NODE_FEATURES, "minmax")[0]
    nodes = x.select("node", fn.array_of(S.NODE_FEATURES).alias("x"))
    links = ft.edge_features(e).select("src", "dst", fn.array_of(["orig_bytes_ratio", "log_count"]).alias("e"))
    out = attention.neighbor_attention(nodes, links, toy_layer(19, 2, 2, 3, True))
    return tidy(out.select("node", F.posexplode("x").alias("pos", "value")))


@query("attention_encode")
def attention_encode(spark, d):
    """Three layers: 4 and 4 heads of 128 numbers with residual sums, then one head of 64."""
    e = stored_edges(spark, d, ())
    x = scaling.scale(pipelines.host_features(None, e, ()), S.NODE_FEATURES, "minmax")[0]
    nodes = cut(x.select("node", fn.array_of(S.NODE_FEATURES).alias("x")), "features")
    links = ft.edge_features(e).select("src", "dst", fn.array_of(["orig_bytes_ratio", "log_count"]).alias("e"))
    layers = [toy_layer(19, 2, 4, 128, True), toy_layer(512, 2, 4, 128, True), toy_layer(512, 2, 1, 64, False)]
    return tidy(attention.attention_encode(nodes, links, layers).select("node", F.posexplode("x").alias("pos", "value")), 5)


@query("mean_neighbor_features")
def mean_neighbor_features(spark, d):
    e = stored_edges(spark, d)
    return tidy(attention.mean_neighbor_features(pipelines.host_features(None, e), e, S.NODE_FEATURES, SNAP))


@query("reconstruct_score")
def reconstruct_score(spark, d):
    df, names = _embedding_columns(spark, d, 64)
    return tidy(detect.reconstruct_score(df, toy_model(names)).select("vec_id", "recon_error"))


@query("reconstruct_fit")
def reconstruct_fit(spark, d):
    """What must hold of a fit: components are orthonormal, the mean error is the share of variance
    that they leave out, and all components leave no error."""
    df, names = _embedding_columns(spark, d, 64)
    model, whole = detect.reconstruct_fit(df, names, 16), detect.reconstruct_fit(df, names, 64)
    c = np.array(model.components)
    facts = detect.reconstruct_score(df, model).agg(F.count(F.lit(1)).alias("n"), F.avg("recon_error").alias("error"))
    none_left = detect.reconstruct_score(df, whole).agg(F.max("recon_error").alias("rest"))
    moments = df.agg(*[F.avg(n).alias(n) for n in names]).head()
    return tidy(facts.crossJoin(none_left).select(
        "n", F.lit(float(np.abs(c @ c.T - np.eye(16)).max()) < 1e-8).alias("orthonormal"),
        (F.abs(F.col("error") - (1 - sum(model.explained))) < 1e-3).alias("error_is_left_out_share"), (F.col("rest") < 1e-9).alias("all_components_leave_none"),
        F.lit(all(x >= y for x, y in zip(model.explained, model.explained[1:]))).alias("falling"),
        F.lit(float(sum(model.mean))).alias("mean_sum"), F.lit(float(sum(model.std))).alias("std_sum"),
        F.lit(float(max(abs(moments[n] - m) for n, m in zip(names, model.mean))) < 1e-9).alias("means_match"),
    ), 4)


@query("dense_score")
def dense_score(spark, d):
    e = fl.read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return tidy(detect.dense_score(e, "embedding", toy_head()).select("vec_id", "mlp_score"))


@query("reconstruction_losses")
def reconstruction_losses(spark, d):
    df, names = _embedding_columns(spark, d, 64)
    diff = stats.unpivot_features(df, names).withColumn("value", F.col("value") * 10)
    return tidy(diff.agg(*detect.reconstruction_losses("value")))


@query("focal_penalty")
def focal_penalty(spark, d):
    rows = toy_scored(spark, d).groupBy("snapshot_ts").agg(
        F.avg("recon_error").alias("recon"), detect.focal_penalty("mlp_score").alias("penalty"), detect.focal_penalty("mlp_score", False).alias("penalty_raw")
    )
    return tidy(rows.withColumn("total", detect.total_loss(F.col("recon"), F.col("penalty"))))


@query("threshold_reconstruction")
def threshold_reconstruction(spark, d):
    s = toy_scored(spark, d)
    own = detect.threshold_reconstruction(s)
    ref = detect.threshold_reconstruction(s, stats.stats_update(s, ["recon_error"])).select(
        "snapshot_ts", "node", F.col("recon_threshold").alias("ref_threshold"), F.col("recon_flag").alias("ref_flag")
    )
    return tidy(own.join(ref, ["snapshot_ts", "node"]).drop("mlp_score"))


@query("threshold_score")
def threshold_score(spark, d):
    return tidy(detect.threshold_score(toy_scored(spark, d), 0.5).filter("mlp_flag").select("snapshot_ts", "node", "mlp_score"))


@query("detect_anomalies")
def detect_anomalies(spark, d):
    s = toy_scored(spark, d)
    out = detect.detect_anomalies(s, stats.stats_update(s, ["recon_error"]), score_min=0.6)
    return tidy(out.select("snapshot_ts", "node", "recon_error", "mlp_score", "detected_by"))


@query("project_pca")
def project_pca(spark, d):
    """Facts that hold of principal components whatever their sign: centred, uncorrelated, and with
    the variance that they explain."""
    df, names = _embedding_columns(spark, d, 64)
    out, explained = detect.project_pca(df, names, 3)
    pairs = [(1, 2), (1, 3), (2, 3)]
    facts = out.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"pc{i}").alias(f"m{i}") for i in (1, 2, 3)],
        *[F.corr(f"pc{i}", f"pc{j}").alias(f"r{i}{j}") for i, j in pairs], *[F.var_pop(f"pc{i}").alias(f"v{i}") for i in (1, 2, 3)],
    )
    small = lambda cols: F.greatest(*[F.abs(c) for c in cols]) < 1e-6
    matches = F.greatest(*[F.abs(F.col(f"v{i}") / 64 - explained[i - 1]) for i in (1, 2, 3)]) < 1e-3
    return tidy(facts.select(
        "n", small([F.col(f"m{i}") for i in (1, 2, 3)]).alias("centred"), small([F.col(f"r{i}{j}") for i, j in pairs]).alias("uncorrelated"),
        matches.alias("variances_explained"), ((F.col("v1") >= F.col("v2")) & (F.col("v2") >= F.col("v3"))).alias("falling"),
    ))


@query("evaluate_latest")
def evaluate_latest(spark, d):
    """Newest snapshot: flagged hosts with their error, and the mean error of each feature."""
    found = pipelines.evaluate_latest(None, stored_edges(spark, d), toy_model(S.NODE_FEATURES, 4))
    flagged = found["anomalies"].select(F.lit("host").alias("kind"), F.col("node").alias("name"), F.col("recon_error").alias("value"))
    features = found["feature_errors"].select(F.lit("feature").alias("kind"), F.col("feature").alias("name"), F.col("mean_abs_error").alias("value"))
    return tidy(flagged.unionByName(features), 5)


@query("model_statistics")
def model_statistics(spark, d):
    feats = _event_features(spark, d)
    s = stats.stats_update(feats, EVENT_FEATURES)
    streak = drift.drift_streak(drift.feature_drift(_event_parts(spark, d)))
    e = stats.stats_update(ft.edge_features(edges(spark, d)), ["orig_bytes_ratio", "log_count"])
    err = stats.stats_update(toy_scored(spark, d), ["recon_error"])
    one = detect.model_statistics(s, e, err, streak)
    return tidy(one.select(
        "update_count", "replay_buffer_size", "consecutive_drifts", "node_stats_count", "edge_stats_count", "error_stats_count",
        F.col("node_stats_features")[0]["feature"].alias("first_feature"), F.col("node_stats_features")[0]["mean"].alias("first_mean"),
        F.col("node_stats_features")[0]["std"].alias("first_std"), F.col("error_stats_features")[0]["mean"].alias("error_mean"),
    ), 5)


@query("anomaly_factors")
def anomaly_factors(spark, d):
    out = changes.anomaly_factors(cut(tp.node_rollup(stored_edges(spark, d), SNAP), "hosts"))
    return tidy(out.withColumn("factors", F.array_join("factors", "; ")), 5)


@query("graph_changes")
def graph_changes(spark, d):
    e = stored_edges(spark, d)
    n = ed.node_degrees(e, SNAP)
    mid = e.agg(F.max("snapshot_ts").alias("new"), F.max(F.when(F.lit(True), F.col("snapshot_ts") - fl.SNAPSHOT_SECONDS)).alias("old"))
    at = lambda df, which: df.join(F.broadcast(mid.select(F.col(which).alias("snapshot_ts"))), "snapshot_ts", "left_semi").drop("snapshot_ts")
    return tidy(changes.graph_changes(at(n, "old"), at(n, "new"), at(e, "old"), at(e, "new")))


@query("change_feed")
def change_feed(spark, d):
    """Changes between all neighbouring snapshots of the graph that is never cleared."""
    return tidy(changes.change_feed(stored_edges(spark, d)))


# --- streaming and state ---------------------------------------------------------------------


def _stream(spark, d, name):
    """One of the tables, a file or a folder of files, as a stream of files."""
    files = spark.readStream.schema(fl.read_table(spark, d, name).schema)
    if is_folder(spark, f"{d}/{name}.parquet"):
        return files.parquet(f"{d}/{name}.parquet")
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _event_connections(df):
    """Events in the shape of connections: user to kind of event."""
    return df.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("timestamp"), F.concat(F.lit("u"), "user_id").alias("src_ip"),
        F.concat(F.lit("s-"), "event_type").alias("dst_ip"), F.lit("tcp").alias("protocol"),
        F.when(F.col("event_type") == "view", "http,ssl").otherwise("-").alias("service"), F.lit(443).alias("dst_port"),
        F.floor("value").cast("bigint").alias("orig_bytes"), F.lit(1).cast("bigint").alias("resp_bytes"), F.lit(1).cast("bigint").alias("orig_pkts"),
        F.lit(1).cast("bigint").alias("resp_pkts"), F.lit(1).cast("bigint").alias("orig_ip_bytes"), F.lit(1).cast("bigint").alias("resp_ip_bytes"),
    )


def _to_table(spark, stream, name, partition=None):
    """What a stream writes until all input at hand is processed, however long that takes: rows of a stream
    that still runs are no result. A stream that fails raises its error."""
    out, state = work_path(spark, name), work_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state)
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_logs")
def stream_logs(spark, d):
    """Connection log files, written from the event table, read as a stream."""
    e = fl.read_table(spark, d, "events")
    given = {"ts": (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("string"), "uid": F.concat(F.lit("E"), "event_id").cast("string")}
    value = F.concat_ws("\t", *[given.get(c, F.lit("-")) for c in ["ts", "uid"] + ["-"] * 19])
    short = F.when(F.col("event_type") == "error", F.lit("short\tline")).otherwise(value)
    folder = _log_folder(spark, e.select(short.alias("value")), "conn")
    parsed = logs.stream_logs(spark, folder, "conn", pattern="part-*").select("uid", F.col("ts").try_cast("double").alias("ts"), "conn_state")
    return tidy(_to_table(spark, parsed, "lines"), 3)


def _publish(lines, folder):
    """Text (column value, with its own line ends) in the order of ``at`` as ``<folder>/<part>/conn.log``; files there are replaced."""
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        part, out, n = None, None, 0
        for batch in batches:
            for p, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part:
                    if out:
                        out.close()
                    part, n = p, n + 1
                    store.create_dir(f"{root}/{p}")
                    out = store.open_output_stream(f"{root}/{p}/conn.log")
                out.write(value.encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    ordered = lines.repartition("part").sortWithinPartitions("part", "at").select("part", "value")
    return ordered.mapInArrow(write, "files bigint").agg(F.sum("files")).head()[0]


@query("stream_growing_logs")
def stream_growing_logs(spark, d):
    """Three log files that grow in three steps: each step but the last ends inside a line."""
    e = fl.read_table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("m"))
    given = {"ts": (F.col("m") / 1000000).cast("string"), "uid": F.concat(F.lit("E"), "event_id").cast("string")}
    line = F.concat(F.concat_ws("\t", *[given.get(c, F.lit("-")) for c in ["ts", "uid"] + ["-"] * 19]), F.lit("\n"))
    rows = cut(e.select(F.pmod("event_id", F.lit(3)).alias("part"), F.col("event_id").alias("at"), line.alias("value")), "lines")
    top = rows.agg(F.max("at").alias("t")).head()["t"] or 0
    folder, out, state = work_path(spark, "growing"), work_path(spark, "growing-out"), work_path(spark, "growing-state")
    for upto in (top // 3, 2 * top // 3, top + 3):
        whole, next_ = rows.filter(F.col("at") <= upto), rows.filter((F.col("at") > upto) & (F.col("at") <= upto + 3))
        half = next_.withColumn("value", F.expr("substring(value, 1, 12)"))
        _publish(whole.unionByName(half), folder)
        stream = logs.stream_logs(spark, folder, "conn", growing=True).select("uid", F.col("ts").try_cast("double").alias("ts"), "conn_state")
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination(1800)
    return tidy(spark.read.schema("uid string, ts double, conn_state string").parquet(out), 3)


@query("correlate_uid_stream")
def correlate_uid_stream(spark, d):
    """Each event is a conn row of its user's uid; pauses over the gap cut a user into records."""
    def rows(kind, read=_stream):
        e = read(spark, d, "events").select(
            F.concat(F.lit("u"), "user_id").alias("uid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("m"), "event_type", "event_id"
        )
        e = e.filter(F.col("event_type") == "purchase") if kind == "ssl" else e.filter(F.col("event_type") == "view") if kind == "http" else e
        given = {"ts": (F.col("m") / 1000000).cast("string"), "uid": F.col("uid"), S.LOG_FIELDS[kind][8]: F.col("event_id").cast("string")}
        return e.select(*[given.get(n, F.lit("-")).alias(n) for n in S.LOG_FIELDS[kind]])

    def flat(merged):
        return merged.select(
            "uid", F.col("conn.at").alias("last_ts"), F.col("conn.duration").cast("bigint").alias("conn_event"),
            F.col("ssl.curve").cast("bigint").alias("ssl_event"), F.col("http.host").cast("bigint").alias("http_event"),
        )

    merged = jobs.correlate_uid_stream(rows("conn"), rows("ssl"), rows("http"), gap_seconds=3600)
    closing = jobs.open_records(*[rows(k, fl.read_table) for k in S.LOG_FIELDS], gap_seconds=3600)
    return tidy(_to_table(spark, flat(merged), "merged").unionByName(flat(closing)), 3)


def _user_logs(spark, d, read, kind):
    """Events as log rows of their user's uid. Every third user has no conn rows."""
    e = read(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("uid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("m"), "user_id", "event_type", "event_id")
    mine = {"conn": F.pmod("user_id", F.lit(3)) > 0, "ssl": F.col("event_type") == "purchase", "http": F.col("event_type") == "view"}
    given = {"ts": (F.col("m") / 1000000).cast("string"), "uid": F.col("uid"), S.LOG_FIELDS[kind][8]: F.col("event_id").cast("string")}
    return e.filter(mine[kind]).select(*[given.get(n, F.lit("-")).alias(n) for n in S.LOG_FIELDS[kind]])


@query("records_by_arrival")
def records_by_arrival(spark, d):
    """All events arrive together: a record for each user, and those without a conn row in the table beside."""
    out, state = work_path(spark, "records"), work_path(spark, "records-state")
    merged = arrivals.records_by_arrival(*[_user_logs(spark, d, _stream, k) for k in S.LOG_FIELDS], gap_seconds=1)
    arrivals.finish_records(arrivals.start_records(merged, out, state))
    whole = spark.read.schema(merged.schema).parquet(f"{out}/records").withColumn("late", F.lit(False))
    late = spark.read.schema(merged.schema).parquet(f"{out}/late").withColumn("late", F.lit(True))
    return tidy(whole.unionByName(late).select(
        "uid", "late", F.col("conn.at").alias("last_ts"), F.col("conn.duration").cast("bigint").alias("conn_event"),
        F.col("ssl.curve").cast("bigint").alias("ssl_event"), F.col("http.host").cast("bigint").alias("http_event"),
    ), 3)


@query("rolling_counts_stream")
def rolling_counts_stream(spark, d):
    """Counts at each connection from the stream, and the last ones from its closing step; time runs 30 times as fast."""
    fast = lambda df: _event_connections(df).withColumn("timestamp", F.floor(F.col("timestamp") / 30))
    stream = arrivals.rolling_counts_stream(fast(_stream(spark, d, "events")))
    return tidy(_to_table(spark, stream, "rolling-counts").unionByName(arrivals.open_counts(fast(fl.read_table(spark, d, "events")))))


@query("change_feed_stream")
def change_feed_stream(spark, d):
    """Changes hour by hour from the stream, and those of the open hours from its closing step."""
    feed = arrivals.change_feed_stream(_event_connections(_stream(spark, d, "events")), 3600)
    out, state = work_path(spark, "changes"), work_path(spark, "changes-state")
    arrivals.start_changes(feed, out, state).awaitTermination(1800)
    closing = arrivals.open_changes(_event_connections(fl.read_table(spark, d, "events")), 3600)
    return tidy(spark.read.schema(feed.schema).parquet(out).drop("batch").unionByName(closing))


@query("snapshot_tumbling")
def snapshot_tumbling(spark, d):
    """Closed windows from the stream, and the open ones from its closing step."""
    edges_ = jobs.snapshot_tumbling(_event_connections(_stream(spark, d, "events")), 3600)
    closing = jobs.open_snapshots(_event_connections(fl.read_table(spark, d, "events")), 3600)
    return tidy(_to_table(spark, edges_, "tumbling").unionByName(closing).drop("first_seen", "last_seen"))


@query("snapshot_cumulative")
def snapshot_cumulative(spark, d):
    return tidy(pipelines.snapshot_cumulative(edges(spark, d, SNAP)))


@query("snapshot_cumulative_hosts")
def snapshot_cumulative_hosts(spark, d):
    """All-history hosts, one row for each change, with the columns of node_rollup_conn."""
    return tidy(history.snapshot_cumulative_hosts(stored_conns(spark, d)))


@query("snapshot_at")
def snapshot_at(spark, d):
    """The all-history graph as of the fifth snapshot before the newest."""
    cumulative = cut(pipelines.snapshot_cumulative(edges(spark, d, SNAP)), "cumulative")
    newest = cumulative.agg(F.max("snapshot_ts").alias("t")).head()["t"]
    return tidy(pipelines.snapshot_at(cumulative, newest - 5 * 7776000).drop("snapshot_ts", "first_seen", "last_seen"))


@query("snapshot_cumulative_stream")
def snapshot_cumulative_stream(spark, d):
    out, state = work_path(spark, "cumulative"), work_path(spark, "cumulative-state")
    q = jobs.start_cumulative(jobs.snapshot_cumulative_stream(_event_connections(_stream(spark, d, "events"))), out, state)
    q.awaitTermination(1800)
    return tidy(stats.load_stats(spark, out).drop("first_seen", "last_seen"))


@query("stats_update")
def stats_update(spark, d):
    return tidy(stats.with_std(stats.stats_update(_event_features(spark, d), EVENT_FEATURES)), 4)


@query("stats_merge")
def stats_merge(spark, d):
    parts = _event_parts(spark, d)
    mean = parts.agg(F.avg("snapshot_ts").alias("m"))
    halves = parts.crossJoin(F.broadcast(mean))
    half = lambda c: stats.stats_combine(halves.filter(c).select("feature", "n", "mean", "m2"))
    return tidy(stats.with_std(stats.stats_merge(half("snapshot_ts < m"), half("snapshot_ts >= m"))), 4)


@query("drift_monitor")
def drift_monitor(spark, d):
    """Snapshots in two batches through the monitor's state; the streak runs on across them."""
    root = work_path(spark, "drift")
    parts = _event_parts(spark, d)
    mean = parts.agg(F.avg("snapshot_ts").alias("m"))
    halves = cut(parts.crossJoin(F.broadcast(mean)), "parts")
    out = None
    for i, cond in enumerate(("snapshot_ts < m", "snapshot_ts >= m")):
        batch = halves.filter(cond).drop("m")
        before = jobs.update_state(spark, batch, root, i)
        one = jobs.drift_monitor(spark, batch, before, root, i)
        out = one if out is None else out.unionByName(one)
    return tidy(out.drop("feature"), 5)


@query("monitor_snapshots")
def monitor_snapshots(spark, d):
    """The whole chain in three batches: features, statistics, drift, buffer, model, detection, reports.

    Every snapshot lies in several files. The model has no component (it expects the mean of the
    buffer), so that SQL can follow every finding; ``reconstruct_fit`` checks components.
    """
    src, out = work_path(spark, "monitor-in"), work_path(spark, "monitor-out")
    e = edges(spark, d, SNAP).repartition(3, "src")
    sn.write_partitions(e, f"{src}/edges")
    times = cut(spark.read.parquet(f"{src}/edges").select(F.col("snapshot_ts").cast("bigint").alias("snapshot_ts")).distinct(), "times")
    ends = times.agg(F.percentile_approx("snapshot_ts", [0.3, 0.6]).alias("p")).head()["p"]
    parts = [F.col("snapshot_ts") <= ends[0], (F.col("snapshot_ts") > ends[0]) & (F.col("snapshot_ts") <= ends[1]), F.col("snapshot_ts") > ends[1]]
    for part in parts:
        sn.mark_finished(times.filter(part), src)
        monitor.monitor_snapshots(spark, src, out, "train", k=0, with_nodes=False).awaitTermination(1800)
    found = detect.read_reports(spark, f"{out}/reports")
    drifts = spark.read.parquet(f"{out}/state/drift").select("snapshot_ts", "drift", "streak", "triggered", "buffered")
    return tidy(found.join(drifts, "snapshot_ts").drop("mlp_score"), 4)


@query("monitor_snapshots_full")
def monitor_snapshots_full(spark, d):
    """The monitor as it is shipped: eight components, host statements, two batches.

    A component's sign and direction are no facts, but they are orthonormal: the error of a host and
    the squares of its embedding add up to the squares of its z-scores, which SQL can follow.
    """
    src, out = work_path(spark, "monitor-in"), work_path(spark, "monitor-out")
    rows = cut(conns(spark, d), "connections")
    nodes, e = pipelines.snapshot_tables(rows)
    sn.write_partitions(nodes, f"{src}/nodes")
    sn.write_partitions(e, f"{src}/edges")
    times = cut(spark.read.parquet(f"{src}/edges").select(F.col("snapshot_ts").cast("bigint").alias("snapshot_ts")).distinct(), "times")
    half = times.agg(F.percentile_approx("snapshot_ts", 0.5).alias("p")).head()["p"]
    for part in (F.col("snapshot_ts") <= half, F.col("snapshot_ts") > half):
        sn.mark_finished(times.filter(part), src)
        monitor.monitor_snapshots(spark, src, out, "train", export_every=1).awaitTermination(1800)
    hosts = spark.read.parquet(f"{out}/embeddings")
    squares = F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    drifts = spark.read.parquet(f"{out}/state/drift").select("snapshot_ts", "update_count", "drift", "streak", "triggered", "buffered")
    facts = hosts.select("snapshot_ts", "node", F.size("embedding").alias("components"), (F.col("recon_error") + squares / len(S.NODE_FEATURES)).alias("squares"))
    return tidy(facts.join(drifts, "snapshot_ts"), 3)


@query("rolling_activity_stream")
def rolling_activity_stream(spark, d):
    r = jobs.rolling_activity_stream(_event_connections(_stream(spark, d, "events")), 3600, 1200)
    closing = jobs.open_activity(_event_connections(fl.read_table(spark, d, "events")), 3600, 1200)
    return tidy(_to_table(spark, r, "rolling").unionByName(closing))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs to scored hosts in one plan: edges of each snapshot, host features, detections."""
    prepare_session(spark)
    return tidy(detect.detect_anomalies(toy_scored(spark, sf_dir)))
