"""Host profiles from flat connections.

Every connection counts for its source (outgoing) and its target (incoming). The two roles come
from one ``explode``, so the input is read, or computed, once. Counts, sums and flags combine
before the shuffle; distinct counts and histograms are grouped by value first and by host second,
so a host with a large share of all rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave import schemas as S
from hostweave.functions import (
    activity_score, connection_consistency, dash_to_null, minute_of_day_circle,
    privileged_port_strict, split_services, status_number, user_agent_category,
)
from hostweave.operators.scale_out import range_scan
from hostweave.session import cut


def host_roles(connections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each connection: ``node`` with ``outgoing`` true for the source."""
    rows = connections.withColumn("outgoing", F.explode(F.array(F.lit(True), F.lit(False))))
    return rows.withColumn("node", F.when(F.col("outgoing"), F.col("src_ip")).otherwise(F.col("dst_ip")))


def _present(c: str) -> Column:
    return dash_to_null(c).isNotNull()


# --- single measures (each usable on its own over host_roles) --------------------------------


def connection_counts() -> list[Column]:
    out = F.col("outgoing")
    return [
        F.count_if(out).alias("total_connections_initiated"),
        F.count_if(~out).alias("total_connections_received"),
        F.count(F.lit(1)).alias("total_connections"),
    ]


def traffic_sums(compat: str | None = None) -> list[Column]:
    """Bytes and packets sent and received. ``compat='unswapped'`` keeps originator bytes as
    "sent" for the responder too."""
    if compat not in (None, "unswapped"):
        raise ValueError(f"unknown compat: {compat}")
    own = F.lit(True) if compat == "unswapped" else F.col("outgoing")
    pick = lambda a, b: F.sum(F.when(own, F.col(a)).otherwise(F.col(b)))
    return [
        pick("orig_bytes", "resp_bytes").alias("total_bytes_sent"),
        pick("resp_bytes", "orig_bytes").alias("total_bytes_received"),
        pick("orig_pkts", "resp_pkts").alias("total_pkts_sent"),
        pick("resp_pkts", "orig_pkts").alias("total_pkts_received"),
    ]


def average_packet_sizes() -> list[Column]:
    size = lambda b, p: F.coalesce(F.col(b) / F.nullif(F.col(p), F.lit(0)), F.lit(0.0))
    return [
        size("total_bytes_sent", "total_pkts_sent").alias("avg_packet_size_sent"),
        size("total_bytes_received", "total_pkts_received").alias("avg_packet_size_received"),
    ]


def direction_ratios() -> list[Column]:
    total = F.nullif(F.col("total_connections_initiated") + F.col("total_connections_received"), F.lit(0))
    ratio = lambda c: F.coalesce(F.col(c) / total, F.lit(0.0))
    return [
        ratio("total_connections_initiated").alias("outgoing_connection_ratio"),
        ratio("total_connections_received").alias("incoming_connection_ratio"),
    ]


def host_flags() -> list[Column]:
    """Ever-true flags."""
    out, status = F.col("outgoing"), status_number("http_status_code")
    ever = lambda c, name: F.bool_or(F.coalesce(c, F.lit(False))).alias(name)
    return [
        ever(F.col("local_orig"), "ever_local_originated"),
        ever(F.col("local_resp"), "ever_local_responded"),
        ever(_present("ssl_curve"), "ever_ssl_curve_present"),
        ever(_present("ssl_server_name"), "has_ssl_server_name"),
        ever(_present("ssl_last_alert"), "ever_ssl_last_alert_present"),
        ever(_present("ssl_history"), "has_ssl_history"),
        ever(_present("ssl_version"), "used_ssl_tls"),
        ever(out & privileged_port_strict("dst_port"), "ever_connected_to_privileged_port"),
        ever(~out & privileged_port_strict("dst_port"), "ever_listened_on_privileged_port"),
        ever(status.between(400, 499), "has_http_error_4xx"),
        ever(status.between(500, 599), "has_http_error_5xx"),
    ]


def tls_counts() -> list[Column]:
    return [
        F.count_if("ssl_resumed").alias("ssl_resumption_count"),
        F.count_if("ssl_established").alias("ssl_established_count"),
    ]


# set of ports -> (does it belong to the outgoing role, port column)
_PORT_SETS = {
    "unique_remote_ports_connected_to": (True, "dst_port"),
    "unique_local_ports_used": (True, "src_port"),
    "unique_remote_ports_connected_from": (False, "src_port"),
    "unique_local_ports_listening_on": (False, "dst_port"),
}


def seen_times() -> list[Column]:
    return [F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")]


def _by_host(connections: DataFrame, by: tuple[str, ...], *aggs: Column) -> DataFrame:
    return host_roles(connections).groupBy(*by, "node").agg(*aggs)


def node_connection_counts(connections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _by_host(connections, by, *connection_counts())


def node_traffic_sums(connections: DataFrame, by: tuple[str, ...] = (), compat: str | None = None) -> DataFrame:
    return _by_host(connections, by, *traffic_sums(compat)).select("*", *average_packet_sizes())


def node_direction_ratio(connections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _by_host(connections, by, *connection_counts()).select(*by, "node", *direction_ratios())


def node_flags(connections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _by_host(connections, by, *host_flags())


def node_tls_counts(connections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _by_host(connections, by, *tls_counts())


def node_port_sets(connections: DataFrame, by: tuple[str, ...] = (), approx: bool = False) -> DataFrame:
    """Sizes of the four port sets; ``approx`` swaps the exact count for a bounded sketch.

    The exact form keeps narrow (host, set, port) rows and removes equal ones before the shuffle.
    """
    if approx:
        mine = lambda out, c: F.when(F.col("outgoing") == out, F.col(c))
        return _by_host(connections, by, *[F.approx_count_distinct(mine(*v)).alias(n) for n, v in _PORT_SETS.items()])
    entry = lambda i, out, c: F.struct(
        F.col("src_ip" if out else "dst_ip").alias("node"), F.lit(i).alias("which"), F.col(c).alias("port")
    )
    entries = F.array(*[entry(i, *v) for i, v in enumerate(_PORT_SETS.values())])
    distinct = connections.select(*by, F.explode_outer(entries).alias("_p")).select(*by, "_p.*").distinct()
    return distinct.groupBy(*by, "node").agg(
        *[F.count_if((F.col("which") == i) & F.col("port").isNotNull()).alias(n) for i, n in enumerate(_PORT_SETS)]
    )


def node_activity_score(connections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _by_host(connections, by, F.count(F.lit(1)).alias("total_connections")).withColumn(
        "activity_score", activity_score("total_connections")
    )


def first_last_seen(connections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _by_host(connections, by, *seen_times())


# --- categories ------------------------------------------------------------------------------

# kind -> the text a connection adds to that histogram, or null for none
_CATEGORIES = {
    "protocol": lambda: F.nullif(F.col("protocol"), F.lit("")),
    "state": lambda: F.nullif(F.col("conn_state"), F.lit("")),
    "user_agent": lambda: user_agent_category(F.nullif(F.col("http_user_agent"), F.lit(""))),
    "http_version": lambda: dash_to_null("http_version"),
    "ssl_version": lambda: dash_to_null("ssl_version"),
    "http_status": lambda: status_number("http_status_code").cast("string"),
    "ssl_cipher": lambda: dash_to_null("ssl_cipher"),
    "ssl_next_protocol": lambda: dash_to_null("ssl_next_protocol"),
}
CATEGORY_KINDS = [*_CATEGORIES, "service"]


def node_histograms(connections: DataFrame, kinds: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Long histogram: by..., node, kind, value, n.

    All kinds come from one pass; equal (host, kind, value) rows combine before the shuffle.
    """
    kinds = kinds or CATEGORY_KINDS
    # a kind is a small number until the rows are counted
    token = lambda k, v: F.struct(F.lit(kinds.index(k)).alias("kind"), v.alias("value"))
    tokens = [token(k, _CATEGORIES[k]()) for k in kinds if k != "service"]
    array = F.array(*tokens) if tokens else None
    if "service" in kinds:
        services = F.transform(split_services("service", keep_blank=False), lambda s: token("service", s))
        array = services if array is None else F.concat(array, services)
    ends = F.array("src_ip", "dst_ip")
    rows = connections.select(*by, array.alias("_t"), ends.alias("_e"))
    rows = rows.select(*by, "_e", F.explode_outer("_t").alias("_t")).filter("_t.value is not null")
    rows = rows.select(*by, F.explode_outer("_e").alias("node"), F.col("_t.kind").alias("kind"), F.col("_t.value").alias("value"))
    counted = rows.groupBy(*by, "node", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(k) for k in kinds])
    return counted.withColumn("kind", F.get(names, F.col("kind")))


def node_histogram(connections: DataFrame, kind: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts for each value of one kind and host."""
    return node_histograms(connections, [kind], by).drop("kind")


def node_histogram_map(connections: DataFrame, kind: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The histogram of a host packed into a map; only its distinct values meet in one place."""
    long = node_histogram(connections, kind, by)
    packed = F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n"))))
    return long.groupBy(*by, "node").agg(packed.alias(f"{kind}_counts"))


def node_distinct_sets(connections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sizes of the sets of protocols, services, versions, ciphers and next protocols."""
    kinds = {
        "protocol": "unique_protocols_used", "service": "unique_services_used",
        "http_version": "unique_http_versions_used", "ssl_version": "unique_ssl_versions_used",
        "ssl_cipher": "unique_ssl_ciphers_used", "ssl_next_protocol": "unique_ssl_next_protocols_used",
    }
    long = node_histograms(connections, list(kinds), by)
    return long.groupBy(*by, "node").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in kinds.items()])


def _rank_order() -> list[Column]:
    # services rank alphabetically, all other kinds by count, ties by the smaller text
    return [F.when(F.col("kind") == "service", 0).otherwise(-F.col("n")), F.col("value")]


def node_mode(connections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent protocol, state, HTTP and TLS version; ties go to the smaller text."""
    kinds = ["protocol", "state", "http_version", "ssl_version"]
    long = node_histograms(connections, kinds, by)
    best = lambda k: F.min(F.when(F.col("kind") == k, F.struct((-F.col("n")).alias("c"), F.col("value"))))
    picked = long.groupBy(*by, "node").agg(*[best(k).alias(k) for k in kinds])
    none = {"protocol": "N/A", "state": "N/A", "http_version": "other", "ssl_version": "other"}
    return picked.select(*by, "node", *[F.coalesce(F.col(k)["value"], F.lit(none[k])).alias(f"most_freq_{k}") for k in kinds])


def top_categories(connections: DataFrame, kind: str, k: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """The k leading values of one kind for each host, with rank. Spark limits each task to k rows
    per host before the shuffle."""
    long = node_histograms(connections, [kind], by)
    rank = F.row_number().over(Window.partitionBy(*by, "node").orderBy(*_rank_order()))
    return long.withColumn("rank", rank).filter(F.col("rank") <= k).drop("kind")


def first_services(connections: DataFrame, k: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """The k alphabetically first services of a host as columns, padded with ``other``."""
    ranked = top_categories(connections, "service", k, by)
    slots = [
        F.coalesce(F.max(F.when(F.col("rank") == i, F.col("value"))), F.lit("other")).alias(f"service_{i}")
        for i in range(1, k + 1)
    ]
    return ranked.groupBy(*by, "node").agg(*slots)


# --- the wide host row -----------------------------------------------------------------------


def node_rollup_conn(
    connections: DataFrame, by: tuple[str, ...] = (), compat: str | None = None, approx: bool = False,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """All host measures in one row.

    Three passes over the connections: numbers and flags, port sets, and the category histograms,
    which are ranked per (host, kind) and then packed. Each pass reads its own columns and keeps
    its own narrow rows; all end partitioned by host, so they join without another shuffle. ``degrees`` (see ``edges.node_degrees``) is joined in when given.
    """
    keys = [*by, "node"]
    numbers = _by_host(
        connections, by, *connection_counts(), *traffic_sums(compat), *host_flags(), *tls_counts(), *seen_times(),
    ).join(node_port_sets(connections, by, approx), keys)
    numbers = numbers.select("*", *average_packet_sizes(), *direction_ratios(), activity_score("total_connections").alias("activity_score"))
    long = node_histograms(connections, None, by)
    rank = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(*_rank_order()))
    ranked = long.withColumn("rank", rank)
    kind = lambda k: F.col("kind") == k
    nth = lambda k, i: F.max(F.when(kind(k) & (F.col("rank") == i), F.col("value")))
    packed = ranked.groupBy(*keys).agg(
        *[F.count_if(kind(k)).alias(n) for k, n in {
            "protocol": "unique_protocols_used", "service": "unique_services_used",
            "http_version": "unique_http_versions_used", "http_status": "unique_http_status_codes_seen",
            "ssl_version": "unique_ssl_versions_used", "ssl_cipher": "unique_ssl_ciphers_used",
            "ssl_next_protocol": "unique_ssl_next_protocols_used",
        }.items()],
        F.coalesce(nth("protocol", 1), F.lit("N/A")).alias("most_freq_proto"),
        F.coalesce(nth("state", 1), F.lit("N/A")).alias("most_freq_conn_state"),
        F.coalesce(nth("http_version", 1), F.lit("other")).alias("most_freq_http_version"),
        F.coalesce(nth("ssl_version", 1), F.lit("other")).alias("most_freq_ssl_version"),
        *[nth("protocol", i).alias(f"top_proto_{i}") for i in (1, 2, 3)],
        *[nth("user_agent", i).alias(f"top_user_agent_{i}") for i in (1, 2, 3)],
        *[nth("service", i).alias(f"service_{i}") for i in (1, 2, 3)],
    )
    wide = numbers.join(packed, keys, "left")
    return wide.join(degrees, keys, "left") if degrees is not None else wide


def node_report_full(rollup: DataFrame, history: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Readable host row: ratios and sizes at two places, leading categories, times, history."""
    two = lambda c: F.round(c, 2).alias(c)
    as_time = lambda c: F.date_format(F.timestamp_seconds(F.col(c)), "yyyy-MM-dd HH:mm:ss").alias(c)
    degree = [c for c in ("degree", "in_degree", "out_degree") if c in rollup.columns]
    columns = [
        *by, "node", *degree, two("activity_score"), "total_connections", "total_connections_initiated",
        "total_connections_received", two("outgoing_connection_ratio"), two("incoming_connection_ratio"),
        "most_freq_proto", "unique_remote_ports_connected_to", "unique_local_ports_used",
        "most_freq_conn_state", "ever_connected_to_privileged_port", "ever_listened_on_privileged_port",
        "total_bytes_sent", "total_bytes_received", two("avg_packet_size_sent"),
        two("avg_packet_size_received"), "used_ssl_tls",
        *[f"top_proto_{i}" for i in (1, 2, 3)], *[f"service_{i}" for i in (1, 2, 3)],
        *[f"top_user_agent_{i}" for i in (1, 2, 3)], as_time("first_seen"), as_time("last_seen"),
    ]
    report = rollup.select(*columns)
    if history is None:
        return report
    return report.join(history, [*by, "node"], "left")


# --- time ------------------------------------------------------------------------------------


_MINUTE, _HOUR = 60_000_000, 3_600_000_000


def _counts_in_range():
    """Rolling counts over ordered (node, micros, n) as far as one range knows; it holds one hour of a host."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        node, times, counts = None, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0)
            t, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            codes = names.dictionary_encode().indices.to_numpy()
            new = np.append(True, codes[1:] != codes[:-1])
            if names[0].as_py() == node:  # what is held of the host goes before the batch
                new[0] = False
            else:
                times, counts = times[:0], counts[:0]
            held = len(times)
            all_t, all_n = np.append(times, t), np.append(counts, n)
            new = np.append(np.zeros(held, bool), new)
            # one axis for all hosts: gaps end at an hour and a bit, so rows within a window stay as they are
            gaps = np.append(0, np.minimum(np.diff(all_t), _HOUR + 1))
            axis = np.cumsum(np.where(new, _HOUR + 1, gaps))
            upto = np.append(0, np.cumsum(all_n))
            within = lambda w: (upto[1:] - upto[np.searchsorted(axis, axis - w)])[held:]
            yield pa.RecordBatch.from_arrays(
                [names, batch.column(1), batch.column(2), pa.array(within(_MINUTE)), pa.array(within(_HOUR)), pa.array(np.full(len(t), part, np.int32))],
                ["node", "micros", "n", "minute", "hour", "part"],
            )
            begin = max(np.flatnonzero(new)[-1] if new.any() else 0, int(np.searchsorted(axis, axis[-1] - _HOUR)))
            node, times, counts = names[-1].as_py(), all_t[begin:], all_n[begin:]

    return count


def rolling_connections(events: DataFrame, node: str = "node", micros: str = "micros") -> DataFrame:
    """Connections of a host in the last minute and hour, at each time it is active.

    Both ends of the window count. Sampled splitters over (host, time) deal the times into ranges, which
    split a host of any size, and each range counts on its own. Only the times of a host's later ranges
    that lie within an hour of their range's start look back beyond it; those, with the hour before
    them, are counted by :func:`_counts_by_sums`. Rows without a host are left out.
    """
    arrivals = events.groupBy(F.col(node).alias("node"), F.col(micros).cast("bigint").alias("micros")).agg(F.count(F.lit(1)).alias("n")).filter("node is not null")
    names = ["node", "micros", F.col("minute").alias("connections_last_minute"), F.col("hour").alias("connections_last_hour")]
    timeless = arrivals.filter("micros is null").select("node", "micros", F.lit(0).cast("bigint").alias("minute"), F.lit(0).cast("bigint").alias("hour"))
    ranged = arrivals.filter("micros is not null").repartitionByRange("node", "micros").sortWithinPartitions("node", "micros")
    ranged = cut(ranged.mapInArrow(_counts_in_range(), "node string, micros bigint, n bigint, minute bigint, hour bigint, part int"), "rolling-counts")
    along = Window.partitionBy("node").orderBy("part")
    starts = ranged.groupBy("node", "part").agg(F.min("micros").alias("start"))
    starts = starts.select("node", "part", F.when(F.lag("part").over(along).isNotNull(), F.col("start")).alias("start"), F.lead("start").over(along).alias("next"))
    starts = starts.filter("start is not null or next is not null")  # at most two hosts of a range have another
    known = ranged.join(F.broadcast(starts), ["node", "part"], "left")
    open_ = F.coalesce(F.col("micros") <= F.col("start") + _HOUR, F.lit(False))
    near = F.coalesce(F.col("micros") >= F.col("next") - _HOUR, F.lit(False))
    again = _counts_by_sums(known.filter(open_ | near).select("node", "micros", "n", open_.alias("open")))
    return known.filter(~open_).select(*names).unionByName(again.select(*names)).unionByName(timeless.select(*names))


def _counts_by_sums(arrivals: DataFrame) -> DataFrame:
    """Rolling counts at the ``open`` ones of (node, micros, n).

    A rolling count is arrivals minus departures, a departure being an arrival one window later, so it
    is a difference of running sums. Those run over sampled ranges, however many of them an hour fills.
    """
    # departures lie one microsecond behind the closed end of the window
    shifts = [(0, 1, 1), (_MINUTE + 1, -1, 0), (_HOUR + 1, 0, -1)]
    moves = arrivals.select(
        "node", "micros", "n", "open",
        F.explode_outer(F.array(*[
            F.struct(F.lit(s).cast("bigint").alias("shift"), F.lit(m).alias("m"), F.lit(h).alias("h")) for s, m, h in shifts
        ])).alias("s"),
    ).select(
        "node", (F.col("micros") + F.col("s.shift")).alias("at"), (F.col("open") & (F.col("s.shift") == 0)).alias("arrival"),
        (F.col("n") * F.col("s.m")).alias("minute"), (F.col("n") * F.col("s.h")).alias("hour"),
    )
    runs = range_scan(moves, ["node"], ["at"], ["minute", "hour"], "moves")
    return runs.filter("arrival").select("node", F.col("at").alias("micros"), F.col("minute_run").alias("minute"), F.col("hour_run").alias("hour"))


def hourly_consistency(events: DataFrame, node: str = "node", micros: str = "micros") -> DataFrame:
    """1/(1+population std) of a host's hourly counts between its first and last hour.

    Hours without traffic count as zero. Their number follows from the first and last hour, so the
    zeros are not materialised.
    """
    hour = F.floor(F.col(micros) / F.lit(3_600_000_000))
    per = events.groupBy(F.col(node).alias("node"), hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    sums = per.groupBy("node").agg(
        (F.max("hour") - F.min("hour") + 1).alias("hours"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
    )
    mean = F.col("n") / F.col("hours")
    std = F.sqrt(F.greatest(F.col("n2") / F.col("hours") - mean * mean, F.lit(0.0)))
    return sums.select("node", F.col("hours").cast("bigint"), connection_consistency("hours", std).alias("connection_consistency"))


def time_circles(rollup: DataFrame) -> DataFrame:
    """First and last seen minute of the day as sine and cosine."""
    first, last = minute_of_day_circle("first_seen"), minute_of_day_circle("last_seen")
    names = S.NODE_FEATURES[13:17]
    return rollup.select("*", *[c.alias(n) for c, n in zip([*first, *last], names)])
