"""Host measures from snapshot edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostweave import schemas as S
from hostweave.functions import privileged_port


def edge_incidence(edges: DataFrame) -> DataFrame:
    """Each edge for its source as outgoing and for its target as incoming; a self-loop is outgoing
    only. One pass over the edges."""
    self_loop = F.col("src") == F.col("dst")
    rows = edges.withColumn("outgoing", F.explode_outer(F.when(self_loop, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
    return rows.withColumn("node", F.when(F.col("outgoing"), F.col("src")).otherwise(F.col("dst")))


def _web_flags(df: DataFrame, dedupe_ssl: bool) -> DataFrame:
    service, port = F.lower("service"), F.col("dst_port")
    web = service.isin(S.WEB_SERVICES) | port.isin(S.WEB_PORTS)
    secure = (port == 443) | (service == "https")
    again = F.col("outgoing") & ((F.lower("protocol") == "ssl") | secure)
    ssl = F.when(secure | again, 1).otherwise(0) if dedupe_ssl else secure.cast("int") + again.cast("int")
    return df.withColumns({"_http": web.cast("int"), "_https": secure.cast("int"), "_ssl": ssl})


def web_traffic_counts(edges: DataFrame, by: tuple[str, ...] = (), dedupe_ssl: bool = False) -> DataFrame:
    """Web, secure web and TLS edges of each host.

    By definition a secure web edge counts once as TLS, and an outgoing one once more under the
    TLS rule; ``dedupe_ssl`` counts each edge at most once.
    """
    rows = _web_flags(edge_incidence(edges), dedupe_ssl)
    return rows.groupBy(*by, "node").agg(
        F.sum("_http").alias("http_connections"), F.sum("_https").alias("https_connections"),
        F.sum("_ssl").alias("ssl_connections"),
    )


def protocol_histogram(edges: DataFrame, by: tuple[str, ...] = (), column: str = "protocol") -> DataFrame:
    """Edges of each host per protocol (or service), long form."""
    return edge_incidence(edges).groupBy(*by, "node", column).agg(F.count(F.lit(1)).alias("n"))


def node_rollup(
    edges: DataFrame, by: tuple[str, ...] = (), dedupe_ssl: bool = False, nodes: DataFrame | None = None,
    with_sets: bool = False,
) -> DataFrame:
    """Host row from snapshot edges.

    Edges are first collapsed over the peer: (host, direction, protocol, service, port). That table
    has at most a few rows for each port of a host however many peers it has, and everything else
    is counted from it. ``nodes`` adds the attributes of the snapshot's host statements and the
    hosts without edges. ``with_sets`` adds the sets themselves; they hold distinct values only,
    and ports are 16 bits.
    """
    keys = [*by, "node"]
    out = F.col("outgoing")
    collapsed = edge_incidence(edges).groupBy(*keys, "outgoing", "protocol", "service", "dst_port").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("total_orig_bytes").alias("_ob"), F.sum("total_orig_pkts").alias("_op"),
        F.sum("total_resp_bytes").alias("_rb"), F.sum("total_resp_pkts").alias("_rp"),
    )
    rows = _web_flags(collapsed, dedupe_ssl)
    n, privileged = F.col("_n"), privileged_port("dst_port")
    total = lambda cond, c, name: F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(name)
    numbers = rows.groupBy(*keys).agg(
        F.sum("_n").alias("total_connections"),
        total(out, "_n", "outgoing_connections"), total(~out, "_n", "incoming_connections"),
        total(out & privileged, "_n", "privileged_remote_connections"),
        total(~out & privileged, "_n", "privileged_local_connections"),
        F.sum(F.col("_http") * n).alias("http_connections"), F.sum(F.col("_https") * n).alias("https_connections"),
        F.sum(F.col("_ssl") * n).alias("ssl_connections"),
        total(out, "_ob", "total_outgoing_bytes"), total(~out, "_rb", "total_incoming_bytes"),
        total(out, "_op", "total_outgoing_packets"), total(~out, "_rp", "total_incoming_packets"),
    )
    # Distinct values: one row per (host, kind, value) first, then counts of those rows, so neither
    # step needs a distinct aggregate and a host's edges combine before they are shuffled.
    fact = lambda kind, value: F.struct(kind.alias("kind"), value.cast("string").alias("value"))
    facts = rows.select(*keys, "_n", F.explode(F.array(
        fact(F.lit("p"), F.col("protocol")), fact(F.lit("s"), F.col("service")),
        fact(F.when(out, "r").otherwise("l"), F.col("dst_port")),
    )).alias("f")).groupBy(*keys, "f.kind", "f.value").agg(F.sum("_n").alias("n"))
    is_kind = lambda k: (F.col("kind") == k) & F.col("value").isNotNull()
    protocol, c = F.col("kind") == "p", F.col("n").cast("double")
    every = F.sum(F.when(protocol, F.col("n")))
    measures = [
        F.count_if(is_kind("s")).alias("unique_services"), F.count_if(is_kind("r")).alias("unique_remote_ports"),
        F.count_if(is_kind("l")).alias("unique_local_ports"), F.count_if(protocol).alias("unique_protocols"),
        F.max(F.when(protocol, F.col("n"))).alias("top_protocol_connections"),
        F.greatest(F.log2(every) - F.sum(F.when(protocol, c * F.log2(c))) / every, F.lit(0.0)).alias("protocol_entropy"),
    ]
    if with_sets:
        values = lambda k: F.collect_list(F.when(is_kind(k), F.col("value")))
        ports = lambda k: F.sort_array(F.transform(values(k), lambda v: v.cast("int")))
        counts = lambda k: F.map_from_entries(F.collect_list(F.when(is_kind(k), F.struct("value", "n"))))
        measures += [
            F.sort_array(values("p")).alias("protocols_seen"), F.sort_array(values("s")).alias("services_seen"),
            ports("r").alias("remote_ports_connected_to"), ports("l").alias("local_ports_used"),
            counts("p").alias("protocol_counts"), counts("s").alias("service_counts"),
        ]
    distinct = facts.groupBy(*keys).agg(*measures)
    first = ["total_connections", "outgoing_connections", "incoming_connections", "unique_services", "unique_remote_ports", "unique_local_ports"]
    joined = numbers.join(distinct, keys)
    result = joined.select(*keys, *first, *[c for c in joined.columns if c not in keys and c not in first])
    if nodes is not None:
        numeric = [c for c, t in result.dtypes if c not in keys and t in ("bigint", "int", "double")]
        result = nodes.join(result, keys, "full_outer").fillna(0, subset=numeric)
    return result


def load_graph(nodes: DataFrame, edges: DataFrame, by: tuple[str, ...] = ("snapshot_ts",)) -> tuple[DataFrame, DataFrame]:
    """Snapshot tables to (hosts with their measures, edges)."""
    return node_rollup(edges, by, nodes=nodes), edges
