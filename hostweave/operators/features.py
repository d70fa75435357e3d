"""Feature vectors of hosts and edges: encoders, derived measures, label codes, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostweave import schemas as S
from hostweave.functions import array_of, one_hot
from hostweave.operators.edges import edge_index, node_index
from hostweave.operators.hosts import time_circles
from hostweave.operators.scale_out import lookup_join, range_scan
from hostweave.operators.scaling import scale
from hostweave.operators.topology import node_rollup

EPS = 1e-9


def node_one_hot(rollup: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """87-dimensional host vector (column ``encoded``) from the wide host row."""
    rows = time_circles(rollup)
    types = dict(rows.dtypes)
    blocks = []
    for name, vocab in S.NODE_ENCODING.items():
        if vocab:
            blocks.append(one_hot(name, vocab))
        elif name == "has_ssl_resumption":
            blocks.append(F.array((F.col("ssl_resumption_count") > 0).cast("int").cast("float")))
        else:
            value = F.col(name)
            if types[name] == "boolean":
                value = value.cast("int")
            blocks.append(F.array(F.coalesce(value.cast("float"), F.lit(0.0).cast("float"))))
    return rows.select(*keep, "node", F.concat(*blocks).alias("encoded"))


def node_features_19(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 19 host features as columns, from the snapshot host row.

    Time features come from the snapshot's host statements and are 0 without them.
    """
    total, out, inc = (F.col(c).cast("double") for c in ("total_connections", "outgoing_connections", "incoming_connections"))
    outgoing, incoming = out / (total + EPS), inc / (total + EPS)
    given = set(nodes.columns)
    values = {
        "outgoing_ratio": outgoing, "incoming_ratio": incoming,
        "server_score": incoming * F.log1p(inc), "client_score": outgoing * F.log1p(out),
        "unique_protocols": F.col("unique_protocols"), "protocol_entropy": F.col("protocol_entropy"),
        "most_freq_proto_ratio": F.when(total > 0, F.col("top_protocol_connections") / total).otherwise(0.0),
        "unique_remote_ports": F.col("unique_remote_ports"), "unique_local_ports": F.col("unique_local_ports"),
        "remote_port_diversity": F.col("unique_remote_ports") / (out + EPS),
        "local_port_diversity": F.col("unique_local_ports") / (inc + EPS),
        "privileged_remote_ratio": F.col("privileged_remote_connections") / (out + EPS),
        "privileged_local_ratio": F.col("privileged_local_connections") / (inc + EPS),
        "http_ratio": F.col("http_connections") / (total + EPS),
        "ssl_ratio": F.col("ssl_connections") / (total + EPS),
    }
    for name in S.NODE_FEATURES[13:17]:
        values[name] = F.coalesce(F.col(name), F.lit(0.0)) if name in given else F.lit(0.0)
    return nodes.select(*keep, "node", *[values[n].cast("double").alias(n) for n in S.NODE_FEATURES])


def edge_features(edges: DataFrame) -> DataFrame:
    """The 12 derived edge measures beside the edge columns."""
    d = lambda c: F.col(c).cast("double")
    n, ob, rb, op, rp = (d(c) for c in ("connection_count", "total_orig_bytes", "total_resp_bytes", "total_orig_pkts", "total_resp_pkts"))
    per = lambda c: F.coalesce(F.when(n > 0, c / F.nullif(n, F.lit(0.0))), F.lit(0.0))
    size_out, size_in = ob / (op + EPS), rb / (rp + EPS)
    values = [
        per(ob), per(rb), per(op), per(rp), ob / (ob + rb + EPS), op / (op + rp + EPS), size_out, size_in,
        size_out / (size_in + EPS), F.log1p(ob + rb), F.log1p(op + rp), F.log1p(n),
    ]
    return edges.select("*", *[v.alias(name) for v, name in zip(values, S.EDGE_DERIVED)])


def label_codes(values: DataFrame, column: str) -> DataFrame:
    """Code of each distinct value: its position in sorted order.

    The distinct values are numbered in sampled ranges, so values that begin alike are spread over
    tasks as well. A null has no code.
    """
    distinct = values.select(F.col(column).cast("string").alias(column)).distinct().filter(F.col(column).isNotNull())
    numbered = range_scan(distinct.withColumn("_n", F.lit(1).cast("bigint")), [], [column], ["_n"], "label-codes")
    return numbered.select(column, (F.col("_n_run") - 1).alias("code"))


def label_encode(df: DataFrame, column: str, codes: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Add the code of a category. A value the given codes do not know is an error, raised when
    the row is computed."""
    name = name or f"{column}_code"
    table = (label_codes(df, column) if codes is None else codes).withColumnRenamed("code", name)
    joined = lookup_join(df, table, [column], "left")
    checked = F.coalesce(
        F.col(name), F.raise_error(F.concat(F.lit(f"unseen {column}: "), F.coalesce(F.col(column), F.lit("null")))).cast("bigint")
    )
    return joined.withColumn(name, checked)


EDGE_MATRIX_NAMES = [f"{c}_code" for c in S.EDGE_CATEGORICAL] + S.EDGE_DERIVED + S.EDGE_ORIGINAL_NUMERIC


def edge_matrix(
    edges: DataFrame, scaling: str = "none", state: DataFrame | None = None, codes: dict[str, DataFrame] | None = None,
    keep: tuple[str, ...] = tuple(S.EDGE_KEYS),
) -> DataFrame:
    """17-dimensional edge vector: two category codes, 12 derived and 3 original numbers.

    Codes are never scaled. If every numeric column is constant, scaling drops the numbers and only
    the codes stay.
    """
    rows = edge_features(edges)
    for c in S.EDGE_CATEGORICAL:
        rows = label_encode(rows, c, (codes or {}).get(c))
    numeric = S.EDGE_DERIVED + S.EDGE_ORIGINAL_NUMERIC
    kept = rows.select(*keep, *[f"{c}_code" for c in S.EDGE_CATEGORICAL], *[
        F.col(c).cast("double").alias(c if c not in keep else f"_{c}") for c in numeric
    ])
    numeric = [c if c not in keep else f"_{c}" for c in numeric]
    scaled, _ = scale(kept, numeric, scaling, state, on_constant="drop")
    coded = array_of([f"{c}_code" for c in S.EDGE_CATEGORICAL])
    numbers = array_of(numeric)
    dropped = F.forall(numbers, lambda v: v.isNull())
    return scaled.select(*keep, F.when(dropped, coded).otherwise(F.concat(coded, numbers)).alias("features"))


def node_matrix(nodes: DataFrame, scaling: str = "none", state: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Host features, scaled when asked, as one array column."""
    scaled, _ = scale(node_features_19(nodes, keep), S.NODE_FEATURES, scaling, state)
    return scaled.select(*keep, "node", array_of(S.NODE_FEATURES).alias("features"))


def graph_to_matrices(
    edges: DataFrame, nodes: DataFrame | None = None, by: tuple[str, ...] = (), node_scaling: str = "none",
    edge_scaling: str = "none", node_state: DataFrame | None = None, edge_state: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Graph to aligned tables: ``nodes`` (idx, features), ``edge_index`` and ``edges`` (features).

    Rows carry their keys; the position in a dense matrix is the ``idx`` column.
    """
    hosts = node_rollup(edges, by, nodes=nodes)
    index = node_index(edges, by)
    x = node_matrix(hosts, node_scaling, node_state, by).join(index, [*by, "node"])
    return {
        "nodes": x.select(*by, "idx", "node", "features"),
        "edge_index": edge_index(edges, by, index).select(*by, *S.EDGE_KEYS, "src_idx", "dst_idx"),
        "edges": edge_matrix(edges, edge_scaling, edge_state, keep=(*by, *S.EDGE_KEYS)),
    }
