"""Fixed field lists, vocabularies and defaults of the traffic-graph data model."""

from __future__ import annotations

# --- Fixed values: log layouts -------------------------------------------------------------
CONN_FIELDS = [
    "ts", "uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "proto", "service",
    "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp",
    "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
]
SSL_FIELDS = [
    "ts", "uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "version", "cipher",
    "curve", "server_name", "resumed", "last_alert", "next_protocol", "established",
    "cert_chain_fuids", "subject", "issuer",
]
HTTP_FIELDS = [
    "ts", "uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "trans_depth", "method",
    "host", "uri", "referrer", "version", "user_agent", "origin", "request_body_len",
    "response_body_len", "status_code", "status_msg", "info_code", "info_msg", "tags",
    "username", "password", "proxied",
]
LOG_FIELDS = {"conn": CONN_FIELDS, "ssl": SSL_FIELDS, "http": HTTP_FIELDS}

# Smallest number of tab-separated fields a line of each kind must have.
MIN_FIELDS = {"conn": 21, "ssl": 17, "http": 30}

# Column types of the typed log tables; every field not named here is a string.
LOG_TYPES = {
    "conn": {
        "id_orig_p": "int", "id_resp_p": "int", "duration": "double", "orig_bytes": "bigint",
        "resp_bytes": "bigint", "local_orig": "boolean", "local_resp": "boolean",
        "missed_bytes": "bigint", "orig_pkts": "bigint", "orig_ip_bytes": "bigint",
        "resp_pkts": "bigint", "resp_ip_bytes": "bigint",
    },
    "ssl": {"id_orig_p": "int", "id_resp_p": "int", "resumed": "boolean", "established": "boolean"},
    "http": {
        "id_orig_p": "int", "id_resp_p": "int", "trans_depth": "int", "request_body_len": "bigint",
        "response_body_len": "bigint", "status_code": "int", "tags": "array<string>",
    },
}

CONN_JSON_SCHEMA = (
    "ts double, uid string, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, "
    "`id.resp_p` int, proto string, service string, duration double, orig_bytes bigint, "
    "resp_bytes bigint, conn_state string, local_orig boolean, local_resp boolean, "
    "missed_bytes bigint, history string, orig_pkts bigint, orig_ip_bytes bigint, "
    "resp_pkts bigint, resp_ip_bytes bigint, community_id string, orig_mac_oui string"
)

# --- Fixed values: defaults of a flattened connection --------------------------------------
DEFAULT_PROTOCOL = "tcp"
DEFAULT_SERVICE = "UNKNOWN"
DEFAULT_CONN_STATE = "UNKNOWN"
DEFAULT_USER_AGENT = "Unknown"

CONNECTION_COLUMNS = [
    "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "service", "orig_bytes",
    "resp_bytes", "conn_state", "local_orig", "local_resp", "history", "orig_pkts", "resp_pkts",
    "orig_ip_bytes", "resp_ip_bytes", "ssl_version", "ssl_cipher", "ssl_curve",
    "ssl_server_name", "ssl_resumed", "ssl_last_alert", "ssl_next_protocol", "ssl_established",
    "ssl_history", "http_method", "host", "uri", "referrer", "http_version", "http_user_agent",
    "origin", "http_status_code", "username",
]

# what hosts and edges are made of, with the snapshot
GRAPH_COLUMNS = ["snapshot_ts"] + [c for c in CONNECTION_COLUMNS if c not in ("history", "http_method", "host", "uri", "referrer", "origin", "username")]

# --- Fixed values: host encoder vocabularies, in slot order --------------------------------
PROTOCOLS = ["tcp", "udp", "icmp", "other"]
CONN_STATES = [
    "S0", "S1", "SF", "REJ", "RSTO", "RSTR", "OTH", "SH", "SHR", "RSTOS0", "RSTRH", "other",
]
SERVICES = ["-", "http", "ssl", "dns", "ftp", "ssh", "rdp", "smb", "other"]
USER_AGENTS = ["Firefox", "Chrome", "Safari", "Edge", "curl", "Wget", "Python", "Java", "other"]
HTTP_VERSIONS = ["1.0", "1.1", "2", "other"]
SSL_VERSIONS = ["SSLv3", "TLSv10", "TLSv11", "TLSv12", "TLSv13", "other"]

# Host features in vector order; a list is a one-hot block over that vocabulary, None a scalar.
NODE_ENCODING = {
    "most_freq_proto": PROTOCOLS,
    "most_freq_conn_state": CONN_STATES,
    "top_proto_1": PROTOCOLS,
    "service_1": SERVICES,
    "service_2": SERVICES,
    "service_3": SERVICES,
    "top_user_agent_1": USER_AGENTS,
    "first_seen_hour_minute_sin": None,
    "first_seen_hour_minute_cos": None,
    "last_seen_hour_minute_sin": None,
    "last_seen_hour_minute_cos": None,
    "outgoing_connection_ratio": None,
    "incoming_connection_ratio": None,
    "unique_remote_ports_connected_to": None,
    "unique_local_ports_used": None,
    "unique_remote_ports_connected_from": None,
    "unique_local_ports_listening_on": None,
    "ever_connected_to_privileged_port": None,
    "ever_listened_on_privileged_port": None,
    "unique_http_versions_used": None,
    "most_freq_http_version": HTTP_VERSIONS,
    "unique_http_status_codes_seen": None,
    "has_http_error_4xx": None,
    "has_http_error_5xx": None,
    "unique_ssl_versions_used": None,
    "most_freq_ssl_version": SSL_VERSIONS,
    "unique_ssl_ciphers_used": None,
    "has_ssl_resumption": None,
    "has_ssl_server_name": None,
    "has_ssl_history": None,
}

# Host features left out of a snapshot file.
EXPORT_EXCLUDED = [
    "incoming_connection_ratio", "outgoing_connection_ratio", "unique_remote_ports_connected_to",
    "unique_local_ports_used", "unique_remote_ports_connected_from",
    "unique_local_ports_listening_on", "ever_connected_to_privileged_port",
    "ever_listened_on_privileged_port", "has_http_error_4xx", "has_http_error_5xx",
    "unique_http_status_codes_seen", "unique_http_versions_used", "most_freq_proto",
]
EXPORTED_NODE_FEATURES = [name for name in NODE_ENCODING if name not in EXPORT_EXCLUDED]

# --- Fixed values: edge encoder slots ------------------------------------------------------
EDGE_PROTOCOL_SLOTS = ["unknown_transport", "tcp", "udp", "icmp"]
EDGE_STATE_GROUPS = {
    "successful": ["SF", "S1"],
    "rejected_reset": ["REJ", "RSTO", "RSTR", "RSTOS0", "RSTRH"],
}
EDGE_SSL_SLOTS = ["", "TLSv10", "TLSv11", "TLSv12", "TLSv13", "SSLv3", "UNKNOWN"]
EDGE_USER_AGENT_SLOTS = [
    "Chrome", "Firefox", "Safari", "Edge", "Opera", "Bot", "Nmap", "DebianAPT", "Unknown",
]
EDGE_ONE_HOT_NAMES = [
    "protocol_UNKNOWN", "protocol_TCP", "protocol_UDP", "protocol_ICMP",
    "conn_state_successful", "conn_state_rejected_reset", "conn_state_partial_other_unknown",
    "ssl_version_NONE", "ssl_version_TLSv10", "ssl_version_TLSv11", "ssl_version_TLSv12",
    "ssl_version_TLSv13", "ssl_version_SSLv3", "ssl_version_UNKNOWN",
    "user_agent_Chrome", "user_agent_Firefox", "user_agent_Safari", "user_agent_Edge",
    "user_agent_Opera", "user_agent_Bot", "user_agent_Nmap", "user_agent_DebianAPT",
    "user_agent_Unknown",
]

# --- Fixed values: feature tables ----------------------------------------------------------
EDGE_KEYS = ["src", "dst", "protocol", "service", "dst_port"]
EDGE_SUMS = [
    "total_orig_bytes", "total_resp_bytes", "total_orig_pkts", "total_resp_pkts",
    "total_orig_ip_bytes", "total_resp_ip_bytes",
]
NODE_FEATURES = [
    "outgoing_ratio", "incoming_ratio", "server_score", "client_score", "unique_protocols",
    "protocol_entropy", "most_freq_proto_ratio", "unique_remote_ports", "unique_local_ports",
    "remote_port_diversity", "local_port_diversity", "privileged_remote_ratio",
    "privileged_local_ratio", "first_seen_hour_minute_sin", "first_seen_hour_minute_cos",
    "last_seen_hour_minute_sin", "last_seen_hour_minute_cos", "http_ratio", "ssl_ratio",
]
EDGE_DERIVED = [
    "avg_orig_bytes_per_conn", "avg_resp_bytes_per_conn", "avg_orig_pkts_per_conn",
    "avg_resp_pkts_per_conn", "orig_bytes_ratio", "orig_pkts_ratio", "avg_orig_packet_size",
    "avg_resp_packet_size", "bytes_per_packet_ratio", "log_total_bytes", "log_total_pkts",
    "log_count",
]
EDGE_ORIGINAL_NUMERIC = ["dst_port", "total_orig_ip_bytes", "total_resp_ip_bytes"]
EDGE_CATEGORICAL = ["protocol", "service"]
WEB_SERVICES = ["http", "https"]
WEB_PORTS = [80, 443, 8080, 8443]
