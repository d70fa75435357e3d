"""What changed between snapshots, and why a host stands out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostweave import schemas as S
from hostweave.operators.scale_out import lookup_join


def graph_changes(prev_nodes: DataFrame, nodes: DataFrame, prev_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """Change feed of two snapshots: kind, node, and for edges the other key columns.

    New hosts and edges are NODE_CREATE and EDGE_CREATE; a host whose row differs is NODE_UPDATE.
    Rows are compared by a 64-bit hash, so only keys and hashes are shuffled.
    """
    values = [c for c in nodes.columns if c != "node"]
    digest = lambda df: df.select("node", F.xxhash64(*values).alias("_h"))
    old = digest(prev_nodes).withColumnRenamed("_h", "_old")
    both = digest(nodes).join(old, "node", "left")
    kind = F.when(F.col("_old").isNull(), "NODE_CREATE").when(F.col("_old") != F.col("_h"), "NODE_UPDATE")
    node_feed = both.select(kind.alias("kind"), "node").filter("kind is not null")
    new_edges = edges.select(*S.EDGE_KEYS).join(prev_edges.select(*S.EDGE_KEYS), S.EDGE_KEYS, "left_anti")
    edge_feed = new_edges.select(F.lit("EDGE_CREATE").alias("kind"), *S.EDGE_KEYS)
    return node_feed.unionByName(edge_feed, allowMissingColumns=True)


def touched(edges: DataFrame, time: str) -> DataFrame:
    """Hosts and edges that take part in each row, as one text ``key`` each, beside the column ``time``.

    A null endpoint is no host.
    """
    node = lambda end: F.when(F.col(end).isNotNull(), F.to_json(F.struct(F.col(end).alias("node"))))
    ends = F.array(node("src"), node("dst"), F.to_json(F.struct(*S.EDGE_KEYS)))
    return edges.select(time, F.explode_outer(ends).alias("key")).filter("key is not null")


def change_rows(found: DataFrame, port_type: str) -> DataFrame:
    """Rows of (snapshot_ts, key, created) as feed rows: snapshot_ts, kind, node, and the edge key columns."""
    types = ", ".join(f"{c} {port_type if c == 'dst_port' else 'string'}" for c in ["node", *S.EDGE_KEYS])
    rows = found.withColumn("_k", F.from_json("key", types))
    host = F.col("_k.node").isNotNull()
    kind = F.when(host & F.col("created"), "NODE_CREATE").when(host, "NODE_UPDATE").when(F.col("created"), "EDGE_CREATE")
    return rows.select("snapshot_ts", kind.alias("kind"), "_k.*").filter("kind is not null")


def change_feed(edges: DataFrame) -> DataFrame:
    """Changes of the graph that is never cleared, between all neighbouring snapshots at once.

    ``edges`` are the edges of each snapshot (snapshot_ts). A host or edge is created in the first
    snapshot it takes part in; a host is updated in each later one, since its counts rise. The rows of
    a hot host are one for each snapshot it is in.
    """
    rows = touched(edges.filter("snapshot_ts is not null"), "snapshot_ts").distinct()
    first = rows.groupBy("key").agg(F.min("snapshot_ts").alias("_first"))
    found = lookup_join(rows, first, ["key"]).withColumn("created", F.col("snapshot_ts") == F.col("_first"))
    return change_rows(found, edges.schema["dst_port"].dataType.simpleString())


# measure -> the factor it stands for
FACTORS = {
    "total_connections": "high connection rate",
    "protocol_entropy": "unusual protocol mix",
    "unique_remote_ports": "many remote ports",
    "unique_local_ports": "many local ports",
    "total_outgoing_bytes": "high outgoing volume",
    "total_incoming_bytes": "high incoming volume",
}


def anomaly_factors(hosts: DataFrame, by: tuple[str, ...] = ("snapshot_ts",), minimum: float = 2.0) -> DataFrame:
    """Score of each host and the factors behind it.

    There is no published formula for this report, so this one is ours: each measure is z-scored
    against its snapshot, the score is the largest z, and the factors are those at ``minimum`` or more.
    """
    stats = hosts.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in FACTORS], *[F.stddev_pop(c).alias(f"_s_{c}") for c in FACTORS]
    )
    joined = lookup_join(hosts.select(*by, "node", *FACTORS), stats, list(by)) if by else hosts.crossJoin(F.broadcast(stats))
    z = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in FACTORS}
    named = [F.when(z[c] >= minimum, F.lit(text)) for c, text in FACTORS.items()]
    return joined.select(
        *by, "node", F.greatest(*z.values()).alias("score"), F.array_compact(F.array(*named)).alias("factors")
    )
