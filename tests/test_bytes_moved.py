"""Queries move and write little: what they once computed or moved several times, they do once."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hostweave import catalog, schemas as S
from hostweave.operators import connections as cx, edges as ed, hosts as ho

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_log_folders_are_packed(spark):
    lines = spark.range(50).select(F.concat(F.lit("line "), "id").alias("value"))
    folder = catalog._log_folder(spark, lines, "conn")
    assert all(f.endswith(".gz") for f in os.listdir(folder.removeprefix("file:")) if f.startswith("part-"))
    assert sorted(r.value for r in spark.read.text(folder).collect()) == sorted(f"line {i}" for i in range(50))


@pytest.mark.parametrize("name", ["node_rollup_conn", "node_report_full", "render_dot", "snapshot_cumulative_hosts"])
def test_connections_are_made_once(spark, name):
    assert "l_orderkey" not in plan(entry.queries()[name](spark, SF))  # all passes read the written connections


def test_snapshot_times_come_from_the_written_edges(spark, tmp_path):
    from hostweave.sources import snapshots as sn

    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "snapshot_ts bigint, src string").coalesce(1)
    sn.write_snapshot(rows, rows.mapInArrow(seen, rows.schema), str(tmp_path))
    assert calls.value == 2 and sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/finished").collect()) == [1, 2]


def test_prefix_edges_move_their_connections_once(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 9 == 0 else float(t), f"u{u}", f"h{s}", "t", "tcp", "http,ssl", None if s else 80, None if s == 2 else int(b), 1, 2, 3, 4, 5)
            for i, (t, u, s, b) in enumerate(zip(*(rng.integers(0, m, 300) for m in (20, 3, 3, 9))))]
    c = spark.createDataFrame(rows + rows[:50], "timestamp double, uid string, src_ip string, dst_ip string, protocol string, service string, dst_port int, orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, resp_pkts bigint, orig_ip_bytes bigint, resp_ip_bytes bigint").repartition(5)
    found = ed.edge_aggregate(c, compat="prefix")
    assert "Join" not in plan(found)
    for e in found.collect():
        mine = sorted((r for r in rows + rows[:50] if r[2] == e.src), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[7] or 0))
        n = len(mine)
        want = None if e.src == "h2" else sum((n - i) * r[7] for i, r in enumerate(mine))
        times = [r[0] for r in mine if r[0] is not None]
        assert (e.connection_count, e.total_orig_bytes, e.first_seen, e.last_seen) == (n * (n + 3) // 2, want, min(times), max(times))


def test_rolling_counts_over_cut_hosts(spark):
    """Two hosts over many ranges, dense and sparse in time, beside small ones; only what looks back is counted by sums."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(5)
        times = {"dense": rng.integers(0, 900, 700), "sparse": rng.integers(0, 2_000_000, 700)} | {f"s{i}": rng.integers(0, 5000, 3) for i in range(40)}
        rows = [(h, int(t) * 1_000_000) for h, ts in times.items() for t in ts] + [("dense", None), (None, 5)]
        got = {(r.node, r.micros): (r.connections_last_minute, r.connections_last_hour) for r in ho.rolling_connections(spark.createDataFrame(rows, "node string, micros bigint").repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = {(h, int(t) * 1_000_000): tuple(int(((ts >= t - w) & (ts <= t)).sum()) for w in (60, 3600)) for h, ts in times.items() for t in ts} | {("dense", None): (0, 0)}
    assert got == want


def test_rolling_counts_do_not_sum_what_one_range_knows(spark, monkeypatch):
    seen = []
    sums = ho._counts_by_sums
    monkeypatch.setattr(ho, "_counts_by_sums", lambda a: seen.append(a.count()) or sums(a), raising=False)
    df = spark.range(2000).select(F.concat(F.lit("h"), F.col("id") % 4).alias("node"), (F.col("id") * 10_000_000_000).alias("micros"))
    assert ho.rolling_connections(df).count() == 2000 and len(seen) == 1 and seen[0] < 200


def test_correlated_rows_move_only_what_is_shown(spark):
    found = plan(entry.queries()["correlate_uid"](spark, SF))
    assert "l_orderkey" not in found and "info_msg" not in found and "missed_bytes" not in found


def test_merge_of_some_fields(spark):
    rows = lambda names, *values: spark.createDataFrame([v + ("-",) * (len(names) - len(v)) for v in values], ", ".join(f"{n} string" for n in names))
    conn = rows(S.CONN_FIELDS, ("5", "A", "h1"), ("05", "A", "h2"), ("4", "A", "h9"), ("x", "B", None), (None, "B", ""), ("1", None, "h"), ("1", "", "h"))
    ssl = rows(S.SSL_FIELDS, ("1", "A"), ("1", "lonely"))
    http = rows(S.HTTP_FIELDS, ("1", "A", "late"), ("1", "A", "early"))
    shown = {"conn": ["id_orig_h"], "ssl": ["cipher"], "http": ["ts", "id_orig_h"]}
    got = {r.uid: r for r in cx.correlate_uid(conn, ssl, http, shown).collect()}
    assert got.keys() == {"A", "B"} and got["A"].conn.asDict() == {"at": 5.0, "id_orig_h": "h2"} and got["B"].conn.id_orig_h == ""
    assert got["A"].http.id_orig_h == "late" and got["A"].ssl.cipher == "-" and got["B"].ssl is None and got["B"].http is None
    assert cx.correlate_uid(conn, ssl, http).filter("uid = 'A'").head().conn.ts == "5"
