"""Hosts over all history: what a graph that is never cleared says about each host at each snapshot."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hostweave.functions import activity_score
from hostweave.operators.hosts import (
    CATEGORY_KINDS, _PORT_SETS, average_packet_sizes, connection_counts, direction_ratios, host_flags, host_roles, node_histograms, seen_times, tls_counts,
    traffic_sums,
)
from hostweave.session import cut

_RUNNING = "node string, snapshot_ts bigint, sizes array<bigint>, names array<array<string>>, counts array<array<bigint>>"


def _running_lists(kinds: list[str], k: int | None):
    """The walk of one task through (node, range, snapshot) in order; it holds one host's counts."""
    schema = pa.schema([("node", pa.string()), ("snapshot_ts", pa.int64()), ("sizes", pa.list_(pa.int64())), ("names", pa.list_(pa.list_(pa.string()))), ("counts", pa.list_(pa.list_(pa.int64())))])
    place = {kind: i for i, kind in enumerate(kinds)}

    def leading(kind: int, counts: dict) -> list[tuple[int, str]]:
        order = [(0 if kinds[kind] == "service" else -n, value) for value, n in counts.items()]
        return sorted(order) if k is None else nsmallest(k, order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, time = None, None
        held: list[dict] = []
        lists: list[list] = []
        changed: set[int] = set()
        out: list[tuple] = []

        def close() -> None:
            for i in changed:
                lists[i] = [value for _, value in leading(i, held[i])]
            changed.clear()
            if time is not None:
                out.append((owner[0], time, [len(c) for c in held], [list(x) for x in lists], [[held[i][v] for v in x] for i, x in enumerate(lists)]))

        for batch in batches:
            for node, part, ts, kind, value, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (node, part) != owner:
                    if owner is not None:
                        close()
                    owner, time = (node, part), ts
                    held, lists = [{} for _ in kinds], [[] for _ in kinds]
                elif ts != time:
                    close()
                    time = ts
                i = place[kind]
                held[i][value] = held[i].get(value, 0) + n
                changed.add(i)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        if owner is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return walk


def running_categories(connections: DataFrame, kinds: list[str], k: int | None = 3, snapshot: str = "snapshot_ts") -> DataFrame:
    """node, snapshot_ts, sizes, names, counts: the values of each kind up to each snapshot of a host.

    sizes has the number of distinct values of each of ``kinds``; names and counts their ``k`` leading
    values (all with ``None``), services in the order of their names, the others by count. One row for
    each snapshot in which the host has a value.

    Counts of (host, snapshot, value) are dealt by sampled splitters over (host, snapshot), so a host
    with very many snapshots is walked by many tasks. Each walk starts with what the host's earlier
    ranges add up to, spread to the ranges by spans, and holds the counts of one host.
    """
    long = node_histograms(connections, kinds, (snapshot,)).select("node", F.col(snapshot).cast("bigint").alias("ts"), "kind", "value", "n")
    long = cut(long.repartitionByRange("node", "ts").withColumn("part", F.spark_partition_id()), "category-changes")
    totals = long.groupBy("node", "part", "kind", "value").agg(F.sum("n").alias("n"))
    spans = long.groupBy("node").agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first < last")  # at most one host for each range
    per = Window.partitionBy("node", "kind", "value").orderBy("part")
    carry = totals.join(spans, "node").select(
        "node", "kind", "value", "part", F.sum("n").over(per.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n"),
        F.coalesce(F.lead("part").over(per), F.col("last")).alias("until"),
    ).filter("part < until")
    carry = carry.select("node", F.explode(F.sequence(F.col("part") + 1, F.col("until"))).alias("part"), F.lit(None).cast("bigint").alias("ts"), "kind", "value", "n")
    rows = long.select("node", "part", "ts", "kind", "value", "n").unionByName(carry)
    ordered = rows.repartition("node", "part").sortWithinPartitions("node", "part", F.col("ts").asc_nulls_first())
    return ordered.mapInArrow(_running_lists(kinds, k), _RUNNING).withColumnRenamed("snapshot_ts", snapshot)


def snapshot_cumulative_hosts(connections: DataFrame, snapshot: str = "snapshot_ts", compat: str | None = None) -> DataFrame:
    """The host rows of :func:`hosts.node_rollup_conn` over all history up to each snapshot.

    A host has a row only for the snapshots in which it is active, with the span it holds for
    (``valid_to`` is its next change, open at the end), so ``pipelines.snapshot_at`` gives the hosts at
    a time. Sums, flags and times run over one row per host and snapshot. A port counts in the
    snapshot in which its host first has it, so set sizes are running sums of first occurrences.
    Modes, leading lists and other set sizes come from :func:`running_categories`.
    """
    by = (snapshot,)
    roles = host_roles(connections)
    numbers = roles.groupBy(*by, "node").agg(*connection_counts(), *traffic_sums(compat), *host_flags(), *tls_counts(), *seen_times())
    entry = lambda i, out, c: F.struct(F.col("src_ip" if out else "dst_ip").alias("node"), F.lit(i).alias("which"), F.col(c).alias("port"))
    ports = connections.select(snapshot, F.explode(F.array(*[entry(i, *v) for i, v in enumerate(_PORT_SETS.values())])).alias("p"))
    ports = ports.filter("p.port is not null").groupBy("p.node", "p.which", "p.port").agg(F.min(snapshot).alias(snapshot))
    fresh = ports.groupBy("node", snapshot).agg(*[F.count_if(F.col("which") == i).alias(n) for i, n in enumerate(_PORT_SETS)])
    rows = numbers.join(fresh, [snapshot, "node"], "left")
    keyed = Window.partitionBy("node").orderBy(snapshot)
    so_far = keyed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    how = {"boolean": F.bool_or, "bigint": F.sum}
    run = {c: how[t] for c, t in rows.dtypes if c not in (snapshot, "node", "first_seen", "last_seen")} | {"first_seen": F.min, "last_seen": F.max}
    fill = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) if c in _PORT_SETS else F.col(c)
    rows = rows.select(snapshot, "node", F.lead(snapshot).over(keyed).alias("valid_to"), *[f(fill(c)).over(so_far).alias(c) for c, f in run.items()])
    rows = rows.select("*", *average_packet_sizes(), *direction_ratios(), activity_score("total_connections").alias("activity_score"))

    lists = running_categories(connections, CATEGORY_KINDS, 3, snapshot)
    at = CATEGORY_KINDS.index
    nth = lambda kind, i: F.get(F.col("names")[at(kind)], F.lit(i - 1))
    size = {
        "protocol": "unique_protocols_used", "service": "unique_services_used", "http_version": "unique_http_versions_used", "http_status": "unique_http_status_codes_seen",
        "ssl_version": "unique_ssl_versions_used", "ssl_cipher": "unique_ssl_ciphers_used", "ssl_next_protocol": "unique_ssl_next_protocols_used",
    }
    packed = lists.select(
        snapshot, "node", *[F.col("sizes")[at(kind)].alias(n) for kind, n in size.items()],
        F.coalesce(nth("protocol", 1), F.lit("N/A")).alias("most_freq_proto"), F.coalesce(nth("state", 1), F.lit("N/A")).alias("most_freq_conn_state"),
        F.coalesce(nth("http_version", 1), F.lit("other")).alias("most_freq_http_version"), F.coalesce(nth("ssl_version", 1), F.lit("other")).alias("most_freq_ssl_version"),
        *[nth("protocol", i).alias(f"top_proto_{i}") for i in (1, 2, 3)], *[nth("user_agent", i).alias(f"top_user_agent_{i}") for i in (1, 2, 3)],
        *[nth("service", i).alias(f"service_{i}") for i in (1, 2, 3)],
    )
    return rows.join(packed, [snapshot, "node"], "left")


def node_history(connections: DataFrame, snapshot: str = "snapshot_ts", compat: str | None = None) -> DataFrame:
    """Totals of each host up to each snapshot: bytes, connections, and counts per protocol.

    The originator's bytes count as sent for the host that started a connection and as received for
    the other one; ``compat='unswapped'`` counts them as sent for both. Connections are summed per
    (snapshot, host) first; the running sums then go over at most one row for each snapshot.
    protocol_counts is an array of (protocol, n) in order of the name.
    """
    swap = F.lit(True) if compat == "unswapped" else F.col("outgoing")
    totals = host_roles(connections).groupBy(snapshot, "node").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(swap, F.col("orig_bytes")).otherwise(F.col("resp_bytes"))).alias("o"),
        F.sum(F.when(swap, F.col("resp_bytes")).otherwise(F.col("orig_bytes"))).alias("r"),
    )
    so_far = Window.partitionBy("node").orderBy(snapshot).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = totals.select(
        snapshot, "node", F.sum("o").over(so_far).alias("historical_total_bytes_sent"),
        F.sum("r").over(so_far).alias("historical_total_bytes_received"),
        F.sum("n").over(so_far).alias("historical_total_connections"),
    )
    lists = running_categories(connections, ["protocol"], None, snapshot)
    counts = F.sort_array(F.arrays_zip(F.col("names")[0].alias("protocol"), F.col("counts")[0].alias("n")))  # as long as the list of protocols
    return sums.join(lists.select(snapshot, "node", counts.alias("protocol_counts")), [snapshot, "node"], "left")


def historical_top_protocols(connections: DataFrame, k: int = 3, snapshot: str = "snapshot_ts") -> DataFrame:
    """The k leading protocols of each host over all history up to each snapshot."""
    lists = running_categories(connections, ["protocol"], k, snapshot)
    return lists.select(snapshot, "node", F.posexplode(F.arrays_zip(F.col("names")[0].alias("protocol"), F.col("counts")[0].alias("n"))).alias("at", "p")).select(
        snapshot, "node", "p.protocol", "p.n", (F.col("at") + 1).alias("rank"),
    )
