from pyspark.sql import Row, functions as F

from hostweave import functions as fn
from hostweave.operators import connections as cx, edges as ed
from hostweave.sources import logs, snapshots as sn


def conn_line(uid, ts="100.5", src="10.0.0.1", dst="10.0.0.2", service="http", orig="10", resp="20", state="SF", port="80"):
    cells = [ts, uid, src, "4000", dst, port, "tcp", service, "1.0", orig, resp, state, "T", "F", "0", "Sh", "3", "52", "4", "60", "-"]
    return "\t".join(cells)


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_parse_skips_comments_blank_and_short_lines(spark):
    df = lines(spark, "#fields\tts", "", conn_line("A"), "1\t2\t3", conn_line("B")[:-2] + "\t")
    assert [r.uid for r in logs.parse_lines(df, "conn").collect()] == ["A"]
    bad = logs.bad_rows(df, "conn").collect()
    # a line that ends in a tab has no field after it
    assert sorted(r.fields for r in bad) == [3, 20]


def test_dash_everywhere_is_zero_or_missing(spark):
    raw = logs.parse_lines(lines(spark, conn_line("A", orig="-", resp="12abc", service="-")), "conn")
    empty = lambda k: logs.parse_lines(lines(spark, "x"), k)
    row = cx.connections_from_logs(raw, empty("ssl"), empty("http")).head()
    assert (row.orig_bytes, row.resp_bytes, row.service, row.ssl_version) == (0, 12, "-", "")
    assert row.http_user_agent == "Unknown" and row.local_orig is True and row.ssl_established is False


def test_last_row_of_a_kind_wins_and_conn_is_required(spark):
    conn = logs.parse_lines(lines(spark, conn_line("A"), conn_line("A", ts="99.0", state="REJ"), conn_line("")), "conn")
    http_cells = lambda uid, ts, host: "\t".join([ts, uid] + ["-"] * 6 + [host] + ["-"] * 21)
    http = logs.parse_lines(lines(spark, http_cells("A", "1", "old"), http_cells("A", "2", "new"), http_cells("lonely", "1", "x")), "http")
    ssl = logs.parse_lines(lines(spark, "x"), "ssl")
    rows = cx.correlate_uid(conn, ssl, http).collect()
    assert [(r.uid, r.conn.conn_state, r.http.host, r.ssl) for r in rows] == [("A", "SF", "new", None)]


def test_http_tags_are_a_set(spark):
    cells = ["1", "A"] + ["-"] * 18 + ["a,b,a,"] + ["-"] * 9
    row = logs.typed(logs.parse_lines(lines(spark, "\t".join(cells)), "http"), "http").head()
    assert row.tags == ["a", "b"] and row.status_code is None


def test_json_rows_join_like_tab_rows(spark):
    text = '{"ts":5.5,"uid":"J","id.orig_h":"::1","id.orig_p":7,"id.resp_h":"ff02::fb","id.resp_p":5353,"proto":"udp","service":"dns","conn_state":"S0","local_orig":true,"orig_pkts":1}'
    conn = logs.json_as_raw(logs.parse_json_lines(lines(spark, text)))
    empty = lambda k: logs.parse_lines(lines(spark, "x"), k)
    row = cx.connections_from_logs(conn, empty("ssl"), empty("http")).head()
    assert (row.src_ip, row.dst_port, row.orig_bytes, row.local_orig, row.orig_pkts) == ("::1", 5353, 0, True, 1)


def test_route_log_kind(spark):
    names = ["/a/conn.log", "ssl.log", "/a/b/http.log", "/a/dns.log", "/a/conn.txt", "/a/myconn.log"]
    got = lines(spark, *names).select(logs.route_log_kind("value").alias("k")).collect()
    assert [r.k for r in got] == ["conn", "ssl", "http", None, None, None]


def test_scan_reads_only_the_named_log(spark, tmp_path):
    (tmp_path / "day1").mkdir()
    (tmp_path / "day1" / "conn.log").write_text(conn_line("A") + "\n#x\n" + conn_line("B") + "\n")
    (tmp_path / "day1" / "other.log").write_text(conn_line("C") + "\n")
    assert sorted(r.uid for r in logs.scan_logs(spark, str(tmp_path), "conn").collect()) == ["A", "B"]
    kinds = logs.scan_lines(spark, str(tmp_path)).select("kind").distinct().collect()
    assert [r.kind for r in kinds] == ["conn"]


def test_split_services(spark):
    df = lines(spark, "ssl,smtp", "a,,b", "http,", "", ",", " x , y\t")
    got = df.select(fn.split_services("value").alias("e"), fn.split_services("value", False).alias("h")).collect()
    assert [r.e for r in got] == [["ssl", "smtp"], ["a", "", "b"], ["http"], [], [""], ["x", "y\t"]]
    assert [r.h for r in got] == [["ssl", "smtp"], ["a", "b"], ["http"], [], [], ["x", "y"]]


def sample_flood(spark):
    """Connections with the totals of the documented mail-flood flow: 20 over 2 services."""
    rows = [
        Row(uid=f"f{i}", timestamp=float(i), src_ip="a", dst_ip="m", protocol="tcp", service="ssl,smtp", dst_port=2525,
            orig_bytes=1444, resp_bytes=2451, orig_pkts=19, resp_pkts=29, orig_ip_bytes=2444, resp_ip_bytes=4003)
        for i in range(20)
    ]
    return spark.createDataFrame(rows)


def test_edge_aggregate_and_prefix_form(spark):
    c = sample_flood(spark)
    got = {r.service: r for r in ed.edge_aggregate(c).collect()}
    assert set(got) == {"ssl", "smtp"} and got["ssl"].connection_count == 20 and got["smtp"].total_orig_bytes == 28880
    prefix = {r.service: r for r in ed.edge_aggregate(c, compat="prefix").collect()}
    assert prefix["ssl"].connection_count == 20 * 23 // 2
    assert prefix["ssl"].total_orig_bytes == 1444 * 20 * 21 // 2


def test_snapshot_text_round_trip(spark, tmp_path):
    edges = spark.createDataFrame(
        [('h"1', "h\\2", "tcp", "a,b", 443, 2, 1, 2, 3, 4, 5, 6)],
        "src string, dst string, protocol string, service string, dst_port int, connection_count bigint, total_orig_bytes bigint, "
        "total_resp_bytes bigint, total_orig_pkts bigint, total_resp_pkts bigint, total_orig_ip_bytes bigint, total_resp_ip_bytes bigint",
    )
    nodes = spark.createDataFrame([('h"1', 2), ("h\\2", 3)], "node string, service_1 int")
    sn.write_dot(nodes, edges, str(tmp_path), 1700000000, ["service_1"])
    (tmp_path / "nw_graph_encoded_1600000000.dot").write_text('digraph x {\n  "n" [service_1=1, service_1=4, odd];\n}\n')
    back = sn.scan_snapshot_edges(spark, str(tmp_path)).drop("snapshot_ts").collect()
    assert back == edges.collect()
    got = {r.node: (r.snapshot_ts, r.service_1) for r in sn.scan_snapshot_nodes(spark, str(tmp_path)).collect()}
    assert got == {'h"1': (1700000000, 2.0), "h\\2": (1700000000, 3.0), "n": (1600000000, 4.0)}
    listed = sn.list_snapshots(spark, str(tmp_path))
    assert sn.latest_snapshot(listed).head().name == "nw_graph_encoded_1700000000.dot"
    assert listed.count() == 2


def test_numbers_in_texts(spark):
    df = lines(spark, "1d", "nan", "-3e2", ".5", "", "7", "x")
    got = [r.n for r in df.select(fn.infer_attr_type("value").alias("n")).collect()]
    assert got[0] is None and got[1] != got[1] and got[2:] == [-300.0, 0.5, None, 7.0, None]
    assert df.select(F.sum(fn.lenient_long("value"))).head()[0] == 1 - 3 + 7
