"""Aggregated edges between hosts, and the graph they form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave import schemas as S
from hostweave.functions import split_services
from hostweave.operators.scale_out import dense_index, lookup_join
from hostweave.session import cut

_SUM_SOURCES = {
    "total_orig_bytes": "orig_bytes", "total_resp_bytes": "resp_bytes",
    "total_orig_pkts": "orig_pkts", "total_resp_pkts": "resp_pkts",
    "total_orig_ip_bytes": "orig_ip_bytes", "total_resp_ip_bytes": "resp_ip_bytes",
}


def explode_services(connections: DataFrame, keep_blank: bool = True) -> DataFrame:
    """One row for each service of a connection.

    The outer form plus a null check does the work of a plain explode, but does not make the
    optimizer compute the list a second time to test its size.
    """
    rows = connections.withColumn("service", F.explode_outer(split_services("service", keep_blank)))
    return rows.filter(F.col("service").isNotNull())


def _edge_keys(connections: DataFrame) -> DataFrame:
    return explode_services(connections).withColumnsRenamed({"src_ip": "src", "dst_ip": "dst"})


def edge_aggregate(
    connections: DataFrame, by: tuple[str, ...] = (), compat: str | None = None,
) -> DataFrame:
    """Connections to edges: count, six sums, first and last time.

    ``by`` adds grouping columns such as ``snapshot_ts``. All aggregates combine before the
    shuffle, so a hot edge arrives as one row per task. ``compat='prefix'`` weighs connection i of
    n (in time order) by n-i+1 and counts n(n+3)/2, the sums of the running totals. Connections are dealt by sampled splitters over edge,
    time and content and ranked where they land; a range gives each edge's count and weighed sums, to
    which the counts of its earlier ranges are added. So a hot edge is ranked by many tasks.
    """
    keys = [*by, *S.EDGE_KEYS]
    rows = _edge_keys(connections)
    if compat is None:
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("connection_count"),
            *[F.sum(c).alias(n) for n, c in _SUM_SOURCES.items()],
            F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        )
    if compat != "prefix":
        raise ValueError(f"unknown compat: {compat}")
    values = list(_SUM_SOURCES.values())
    rows = rows.select(*keys, "timestamp", "uid", *values).repartitionByRange(*keys, "timestamp", "uid", *values)
    rows = rows.sortWithinPartitions(*keys, "timestamp", "uid", *values).select(*keys, "timestamp", *values)
    schema = rows.select(*keys).schema.simpleString()[7:-1]
    pieces = rows.mapInArrow(
        _ranked_pieces(len(keys), len(values)), f"{schema}, _part int, _seq int, _n bigint, first_seen double, last_seen double, "
        + ", ".join(f"_{k}_{n} bigint" for k in "sw" for n in _SUM_SOURCES),
    )
    before = Window.partitionBy(*keys).orderBy("_part", "_seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).groupBy(*keys).agg(
        F.sum("_n").alias("_n"),
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in _SUM_SOURCES],
        *[F.sum(F.col(f"_w_{n}") + F.col("_before") * F.col(f"_s_{n}")).alias(f"_w_{n}") for n in _SUM_SOURCES],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    return sums.select(
        *keys, F.expr("_n * (_n + 3) div 2").alias("connection_count"),
        *[((F.col("_n") + 1) * F.col(f"_s_{n}") - F.col(f"_w_{n}")).alias(n) for n in _SUM_SOURCES], "first_seen", "last_seen",
    )


def _ranked_pieces(n_keys: int, n_values: int):
    """One row for each run of equal keys in a batch of ordered rows: its place, its number of rows, first
    and last time, and for each value the sum and the sum weighed by the rank inside the run."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(b for b in batches if b.num_rows):
            columns, rows = batch.columns, batch.num_rows
            new = np.zeros(rows, bool)
            new[0] = True
            for c in columns[:n_keys]:
                codes = c.dictionary_encode("encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], rows)
            rank = np.arange(1, rows + 1) - np.repeat(starts, ends - starts)
            times, known = columns[n_keys], columns[n_keys].is_valid().to_numpy(zero_copy_only=False)
            # times ascend from null, so the first known one is the least and the last one the greatest
            first = np.minimum(starts + np.add.reduceat(~known, starts, dtype=np.int64), ends - 1)
            sums, weighed = [], []
            for c in columns[n_keys + 1:]:
                given, v = c.is_valid().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy()
                none = ~np.logical_or.reduceat(given, starts)
                for out, w in ((sums, np.ones(rows, np.int64)), (weighed, rank)):
                    if np.abs(v.astype(float) * w).sum() >= 2.0 ** 62:
                        raise OverflowError("edge sums exceed 64 bits")
                    out.append(pa.array(np.add.reduceat(v * w, starts), pa.int64(), mask=none))
            place = [pa.array(np.full(len(starts), x, np.int32)) for x in (part, seq)]
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array(starts)) for c in columns[:n_keys]] + place + [pa.array(ends - starts)]
                + [times.take(pa.array(first)), times.take(pa.array(ends - 1)), *sums, *weighed],
                [f"c{i}" for i in range(n_keys + 5 + 2 * n_values)],
            )

    return pieces


def edge_slots() -> list[Column]:
    """The 23 conditions of the edge one-hot vector, in order, over a flat connection."""
    first = S.EDGE_PROTOCOL_SLOTS[0]
    protocol = F.when(F.col("protocol").isin(S.EDGE_PROTOCOL_SLOTS), F.col("protocol")).otherwise(first)
    groups = S.EDGE_STATE_GROUPS
    state = F.when(F.col("conn_state").isin(groups["successful"]), 0).when(
        F.col("conn_state").isin(groups["rejected_reset"]), 1
    ).otherwise(2)
    version = F.coalesce(F.col("ssl_version"), F.lit(""))
    version = F.when(version.isin(S.EDGE_SSL_SLOTS), version).otherwise(S.EDGE_SSL_SLOTS[-1])
    agent = F.coalesce(F.col("http_user_agent"), F.lit(S.DEFAULT_USER_AGENT))
    agent = F.when(agent.isin(S.EDGE_USER_AGENT_SLOTS), agent).otherwise(S.DEFAULT_USER_AGENT)
    return (
        [protocol == p for p in S.EDGE_PROTOCOL_SLOTS]
        + [state == i for i in range(3)]
        + [version == v for v in S.EDGE_SSL_SLOTS]
        + [agent == a for a in S.EDGE_USER_AGENT_SLOTS]
    )


def edge_one_hot(connections: DataFrame, keep: tuple[str, ...] = ("uid",)) -> DataFrame:
    """23-dimensional one-hot vector of each connection."""
    return connections.select(*keep, F.array(*[c.cast("int").cast("float") for c in edge_slots()]).alias("encoded"))


def edge_vector_sum(connections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Element-wise sum of the one-hot vectors of each edge: 23 conditional counts, packed last."""
    keys = [*by, *S.EDGE_KEYS]
    counts = [F.count_if(c).alias(f"_v{i}") for i, c in enumerate(edge_slots())]
    rows = _edge_keys(connections).groupBy(*keys).agg(*counts)
    return rows.select(*keys, F.array(*[F.col(f"_v{i}").cast("float") for i in range(len(counts))]).alias("encoded_sum"))


# --- the graph -------------------------------------------------------------------------------


def node_set(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All endpoints, each once. One pass over the edges; duplicates go before the shuffle."""
    ends = edges.select(*by, F.explode_outer(F.array("src", "dst")).alias("node"))
    return ends.distinct()


def edges_with_known_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose endpoints both exist."""
    ids = nodes.select("node").distinct()
    kept = lookup_join(edges, ids.withColumnRenamed("node", "src"), ["src"], "left_semi")
    return lookup_join(kept, ids.withColumnRenamed("node", "dst"), ["dst"], "left_semi")


def node_index(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Dense 0-based position of every host (within each snapshot when ``by`` names it)."""
    return dense_index(node_set(edges, by), "node", list(by), "idx")


def edge_index(edges: DataFrame, by: tuple[str, ...] = (), index: DataFrame | None = None) -> DataFrame:
    """Edges as pairs of dense positions. Parallel edges are kept.

    Both ends look up the same table of positions, which is written once when it is not given.
    """
    index = cut(node_index(edges, by), "positions") if index is None else index
    src = index.select(*by, F.col("node").alias("src"), F.col("idx").alias("src_idx"))
    dst = index.select(*by, F.col("node").alias("dst"), F.col("idx").alias("dst_idx"))
    out = lookup_join(lookup_join(edges, src, [*by, "src"]), dst, [*by, "dst"])
    return out.select(*edges.columns, "src_idx", "dst_idx")


def node_degrees(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """In, out and total degree over distinct edges; a self-loop adds to both sides."""
    ends = edges.select(
        *by,
        F.explode_outer(F.array(
            F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )).alias("e"),
    )
    return ends.groupBy(*by, F.col("e.node").alias("node")).agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count(F.lit(1)).alias("degree"),
    )


def graph_counts(edges: DataFrame, nodes: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of hosts and edges, and whether there are none."""
    nodes = node_set(edges, by) if nodes is None else nodes
    n = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("edge_count"))
    both = n.join(e, list(by), "full_outer") if by else n.crossJoin(e)  # global: one row each
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return both.select(*by, zero("node_count"), zero("edge_count")).withColumn(
        "is_empty", (F.col("node_count") == 0) & (F.col("edge_count") == 0)
    )


def node_lookup(nodes: DataFrame, node: str) -> DataFrame:
    """One host by name; the filter reaches the scan of a stored snapshot."""
    return nodes.filter(F.col("node") == node)
