"""From log rows to flattened connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostweave import schemas as S
from hostweave.functions import (
    dash_to_default, dash_to_null, lenient_long, user_agent_category, zeek_bool,
)


def tag_parts(
    conn: DataFrame, ssl: DataFrame, http: DataFrame, keep: tuple[str, ...] = (), fields: dict[str, list[str]] = S.LOG_FIELDS,
) -> DataFrame:
    """The three logs as one table: uid, kind, order and one struct column of ``fields`` for each kind."""
    parts = None
    for kind, df in (("conn", conn), ("ssl", ssl), ("http", http)):
        names = fields[kind]
        # The struct starts with the time, so its maximum is the last row; rows of the same time
        # are told apart by their content, which makes the winner independent of the row order.
        order = F.struct(F.col("ts").try_cast("double").alias("at"), *[F.col(n) for n in names])
        part = df.filter(F.coalesce(F.col("uid"), F.lit("")) != "").select(
            "uid", *keep, order.alias(kind)
        )
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts


def last_parts() -> list[Column]:
    """Aggregates that keep the last row of each kind within a group of parts."""
    return [F.max(k).alias(k) for k in S.LOG_FIELDS]


def correlate_uid(conn: DataFrame, ssl: DataFrame, http: DataFrame, fields: dict[str, list[str]] = S.LOG_FIELDS) -> DataFrame:
    """Merge the rows of one uid; the last row of each kind wins; uids without a conn row go.

    One shuffle of the union on ``uid``. The maximum is taken before the shuffle too, so a uid with
    very many rows (a long keep-alive connection) arrives as one row per task. Spark cannot drop a
    struct's unused fields before its maximum: ``fields`` names those to move for each kind, in the
    order that tells rows of the same time apart.
    """
    return tag_parts(conn, ssl, http, fields=fields).groupBy("uid").agg(*last_parts()).filter(F.col("conn").isNotNull())


def flatten_connection(merged: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Merged parts to the flat connection record with its defaults.

    ``-`` counts as missing everywhere except in ``service``, which has a slot of its own for it.
    Columns of the result: uid, then the fields in ``schemas.CONNECTION_COLUMNS``.
    """
    return _flat(merged, F.col, F.col("http").isNotNull(), F.coalesce(F.col("conn.at"), F.lit(0.0)), keep)


def _flat(
    df: DataFrame, part, has_http: Column, timestamp: Column, keep: tuple[str, ...], given: dict[str, Column] | None = None,
) -> DataFrame:
    """The record over ``part(kind)[field]``, a column for each raw field. ``given`` has columns of the
    record that need no parsing."""
    conn, ssl, http = part("conn"), part("ssl"), part("http")
    text = lambda c, d="": F.coalesce(dash_to_null(c), F.lit(d))
    number = lambda c: lenient_long(dash_to_default(c, "0"))
    port = lambda c: lenient_long(c).cast("int")
    columns = {
        "timestamp": timestamp,
        "src_ip": F.coalesce(conn["id_orig_h"], F.lit("")),
        "src_port": port(conn["id_orig_p"]),
        "dst_ip": F.coalesce(conn["id_resp_h"], F.lit("")),
        "dst_port": port(conn["id_resp_p"]),
        "protocol": F.coalesce(conn["proto"], F.lit(S.DEFAULT_PROTOCOL)),
        "service": F.coalesce(conn["service"], F.lit(S.DEFAULT_SERVICE)),
        "orig_bytes": number(conn["orig_bytes"]),
        "resp_bytes": number(conn["resp_bytes"]),
        "conn_state": F.coalesce(conn["conn_state"], F.lit(S.DEFAULT_CONN_STATE)),
        "local_orig": zeek_bool(conn["local_orig"]),
        "local_resp": zeek_bool(conn["local_resp"]),
        "history": text(conn["history"]),
        "orig_pkts": number(conn["orig_pkts"]),
        "resp_pkts": number(conn["resp_pkts"]),
        "orig_ip_bytes": number(conn["orig_ip_bytes"]),
        "resp_ip_bytes": number(conn["resp_ip_bytes"]),
        "ssl_version": text(ssl["version"]),
        "ssl_cipher": text(ssl["cipher"]),
        "ssl_curve": text(ssl["curve"]),
        "ssl_server_name": text(ssl["server_name"]),
        "ssl_resumed": zeek_bool(ssl["resumed"]),
        "ssl_last_alert": text(ssl["last_alert"]),
        "ssl_next_protocol": text(ssl["next_protocol"]),
        "ssl_established": zeek_bool(ssl["established"]),
        "ssl_history": F.lit(""),
        "http_method": F.coalesce(http["method"], F.lit(S.DEFAULT_SERVICE)),
        "host": text(http["host"]),
        "uri": text(http["uri"]),
        "referrer": text(http["referrer"]),
        "http_version": text(http["version"]),
        "http_user_agent": F.when(~has_http, S.DEFAULT_USER_AGENT).otherwise(
            user_agent_category(F.coalesce(http["user_agent"], F.lit("")))
        ),
        "origin": text(http["origin"]),
        "http_status_code": text(http["status_code"]),
        "username": text(http["username"]),
    }
    columns |= given or {}
    return df.select("uid", *keep, *[columns[n].alias(n) for n in S.CONNECTION_COLUMNS])


def valid_endpoints(connections: DataFrame) -> DataFrame:
    """Connections with both addresses."""
    return connections.filter((F.coalesce("src_ip", F.lit("")) != "") & (F.coalesce("dst_ip", F.lit("")) != ""))


def connections_from_logs(conn: DataFrame, ssl: DataFrame, http: DataFrame) -> DataFrame:
    """Raw log tables to valid flat connections."""
    return valid_endpoints(flatten_connection(correlate_uid(conn, ssl, http)))


# --- flow view in the shape of the logs ------------------------------------------------------


def flow_log_fields(flows: DataFrame) -> dict[str, DataFrame]:
    """The flow view split into the raw fields of the three logs."""
    dash = F.lit("-")
    as_text = lambda c: F.col(c).cast("string")
    ids = {
        "ts": F.concat(as_text("epoch"), F.lit(".000000")), "uid": F.col("uid"),
        "id_orig_h": F.col("src_ip"), "id_orig_p": as_text("src_port"),
        "id_resp_h": F.col("dst_ip"), "id_resp_p": as_text("dst_port"),
    }
    given = {
        "conn": {
            "proto": F.col("protocol"), "service": F.col("service"), "orig_bytes": F.col("orig_bytes"),
            "resp_bytes": F.col("resp_bytes"), "conn_state": F.col("conn_state"),
            "local_orig": F.col("local_orig"), "local_resp": F.col("local_resp"),
            "orig_pkts": as_text("orig_pkts"), "resp_pkts": as_text("resp_pkts"),
            "orig_ip_bytes": F.col("orig_ip_bytes"), "resp_ip_bytes": F.col("resp_ip_bytes"),
            "missed_bytes": F.lit("0"),
        },
        "ssl": {
            "version": F.col("ssl_version"), "cipher": F.col("ssl_cipher"), "curve": F.col("ssl_curve"),
            "server_name": F.col("ssl_server_name"), "resumed": F.col("ssl_resumed"),
            "last_alert": F.col("ssl_last_alert"), "next_protocol": F.col("ssl_next_protocol"),
            "established": F.col("ssl_established"),
        },
        "http": {
            "method": F.col("http_method"), "host": F.col("http_host"), "uri": F.col("http_uri"),
            "version": F.col("http_version"), "user_agent": F.col("http_user_agent"),
            "status_code": F.col("http_status_code"), "tags": F.lit("a,b,a"),
        },
    }
    present = {
        "conn": flows, "ssl": flows.filter(F.col("ssl_cipher").isNotNull()),
        "http": flows.filter(F.col("http_method").isNotNull()),
    }
    return {
        kind: present[kind].select(
            *[{**ids, **given[kind]}.get(n, dash).alias(n) for n in S.LOG_FIELDS[kind]]
        )
        for kind in S.LOG_FIELDS
    }


def log_lines(fields: DataFrame, kind: str) -> DataFrame:
    """Raw fields as tab-separated text lines, padded to the least number of fields."""
    pad = S.MIN_FIELDS[kind] - len(S.LOG_FIELDS[kind])
    cells = [F.coalesce(F.col(n), F.lit("-")) for n in S.LOG_FIELDS[kind]] + [F.lit("-")] * pad
    return fields.select(F.concat_ws("\t", *cells).alias("value"))


def from_flows(flows: DataFrame) -> DataFrame:
    """The flow view as flat connections. A flow has one row of each kind at most, so the merge by
    uid and its shuffle are not needed."""
    has_ssl, has_http = F.col("ssl_cipher").isNotNull(), F.col("http_method").isNotNull()
    named = {
        "conn": dict(
            id_orig_h="src_ip", id_orig_p="src_port", id_resp_h="dst_ip", id_resp_p="dst_port",
            proto="protocol", service="service", orig_bytes="orig_bytes", resp_bytes="resp_bytes",
            conn_state="conn_state", local_orig="local_orig", local_resp="local_resp",
            orig_pkts="orig_pkts", resp_pkts="resp_pkts", orig_ip_bytes="orig_ip_bytes",
            resp_ip_bytes="resp_ip_bytes",
        ),
        "ssl": dict(
            version="ssl_version", cipher="ssl_cipher", curve="ssl_curve", server_name="ssl_server_name",
            resumed="ssl_resumed", last_alert="ssl_last_alert", next_protocol="ssl_next_protocol",
            established="ssl_established",
        ),
        "http": dict(
            method="http_method", host="http_host", uri="http_uri", version="http_version",
            user_agent="http_user_agent", status_code="http_status_code",
        ),
    }

    present = {"ssl": has_ssl, "http": has_http}

    class Fields:
        def __init__(self, kind: str):
            self.kind = kind

        def __getitem__(self, name: str) -> Column:
            source = named[self.kind].get(name)
            value = F.col(source).cast("string") if source else F.lit("-")
            return value if self.kind == "conn" else F.when(present[self.kind], value)

    # numbers stay numbers: only what a flow spells as text is parsed
    types = dict(flows.dtypes)
    numbers = {"src_port": "int", "dst_port": "int", "orig_bytes": "bigint", "resp_bytes": "bigint", "orig_pkts": "bigint",
               "resp_pkts": "bigint", "orig_ip_bytes": "bigint", "resp_ip_bytes": "bigint"}
    given = {c: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)) for c, t in numbers.items() if types[c] in ("int", "bigint")}
    return _flat(flows, Fields, has_http, F.col("epoch").cast("double"), ("epoch", "snapshot_ts"), given)
