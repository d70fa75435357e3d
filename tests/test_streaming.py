import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostweave import catalog, schemas as S
from hostweave.operators.connections import connections_from_logs
from hostweave.plans import pipelines
from hostweave.sources import logs, snapshots as sn
from hostweave.operators import changes, detect
from hostweave.operators.edges import edge_aggregate
from hostweave.streaming import arrivals, jobs, monitor
from test_logs import conn_line


def write_logs(folder, uids, start=0.0):
    folder.mkdir(parents=True)
    rows = [conn_line(u, ts=str(start + 10 * i), src=f"10.0.0.{i % 5}", dst=f"10.0.1.{i % 3}", port=str(20 + i % 4)) for i, u in enumerate(uids)]
    (folder / "conn.log").write_text("\n".join(rows) + "\n")
    blank = "\t".join
    (folder / "ssl.log").write_text("\n".join(blank([str(start + 10 * i), u] + ["-"] * 4 + ["TLSv12"] + ["-"] * 10) for i, u in enumerate(uids)) + "\n")
    (folder / "http.log").write_text("#only a comment\n")


def test_logs_to_reports(spark, tmp_path):
    """Logs to snapshots to a trained monitor, then a second run that only detects."""
    write_logs(tmp_path / "logs" / "a", [f"u{i}" for i in range(60)], 1000.0)
    graph, out = str(tmp_path / "graph"), str(tmp_path / "out")
    pipelines.logs_to_snapshots(spark, str(tmp_path / "logs"), graph, seconds=120)
    nodes, edges = sn.read_snapshots(spark, graph)
    assert edges.agg(F.sum("connection_count")).head()[0] == 60 and nodes.filter("most_freq_ssl_version <> 3").count() == 0
    monitor.monitor_snapshots(spark, graph, out, "train", export_every=2).awaitTermination(600)
    drift = spark.read.parquet(f"{out}/state/drift")
    assert drift.count() == edges.select("snapshot_ts").distinct().count()
    again = str(tmp_path / "again")
    monitor.monitor_snapshots(
        spark, graph, again, "detect", model_path=f"{out}/state/model", errors_path=f"{out}/state/error_stats",
    ).awaitTermination(600)
    docs = detect.read_reports(spark, f"{again}/reports")
    assert docs.count() >= drift.count() and docs.agg(F.min("nodes_in_graph")).head()[0] > 0
    assert spark.read.parquet(f"{out}/embeddings").select("snapshot_ts").distinct().count() == drift.count() // 2
    assert spark.read.parquet(f"{out}/state/edge_stats").count() == len(S.EDGE_DERIVED)
    # a later run on other windows keeps the earlier snapshots, and the monitor takes the new ones only
    before = edges.select("snapshot_ts").distinct().count()
    write_logs(tmp_path / "more" / "a", [f"v{i}" for i in range(30)], 9000.0)
    pipelines.logs_to_snapshots(spark, str(tmp_path / "more"), graph, seconds=120)
    _, edges = sn.read_snapshots(spark, graph)
    assert edges.select("snapshot_ts").distinct().count() > before
    monitor.monitor_snapshots(spark, graph, out, "train").awaitTermination(600)
    numbers = sorted(r[0] for r in spark.read.parquet(f"{out}/state/drift").select("update_count").collect())
    assert numbers == list(range(1, edges.select("snapshot_ts").distinct().count() + 1))


def test_stream_merge_equals_batch(spark, tmp_path):
    """Without pauses over the gap the stream gives what the batch merge gives. The last line only
    moves the time on, so that everything before it is emitted."""
    root = tmp_path / "logs"
    write_logs(root / "a", [f"u{i}" for i in range(20)])
    late = root / "b"
    late.mkdir()
    (late / "conn.log").write_text(conn_line("closing", ts="100000") + "\n")
    streams = [logs.stream_logs(spark, str(root), k) for k in S.LOG_FIELDS]
    merged = jobs.connections_stream(*streams)
    q = merged.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(600)
    got = spark.read.parquet(str(tmp_path / "o")).filter("uid <> 'closing'").orderBy("uid").collect()
    want = connections_from_logs(*[logs.scan_logs(spark, str(root), k) for k in S.LOG_FIELDS]).filter("uid <> 'closing'").orderBy("uid").collect()
    assert len(got) == 20 and got == want


def test_monitor_does_not_depend_on_batches(spark, tmp_path):
    """One batch, one batch per snapshot, and a repeated and an empty batch give the same reports."""
    graph = str(tmp_path / "graph")
    write_logs(tmp_path / "logs" / "a", [f"u{i}" for i in range(60)], 1000.0)
    pipelines.logs_to_snapshots(spark, str(tmp_path / "logs"), graph, seconds=120)
    nodes, edges = sn.read_snapshots(spark, graph)
    times = sorted(r[0] for r in edges.select("snapshot_ts").distinct().collect())

    def reports(out):
        rows = detect.read_reports(spark, f"{out}/reports").select("snapshot_ts", "update_count", "ip", "detected_by", F.round("recon_error", 6)).collect()
        return sorted(map(str, rows)), sorted(map(str, spark.read.parquet(f"{out}/state/drift").drop("version").collect()))

    whole = str(tmp_path / "whole")
    monitor.monitor_snapshots(spark, graph, whole, "train", k=3).awaitTermination(600)
    single = str(tmp_path / "single")
    for i, t in enumerate(times):
        part = F.col("snapshot_ts") == t
        args = (spark, nodes.filter(part), edges.filter(part), single, i, "train", f"{single}/state/model", 3)
        monitor.process_snapshots(*args)
        if i == 1:
            monitor.process_snapshots(*args)  # a failed batch is run again
    monitor.process_snapshots(spark, nodes.limit(0), edges.limit(0), single, len(times), "train", f"{single}/state/model", 3)
    assert reports(single) == reports(whole)
    state = monitor._read_state(spark, single, len(times) + 1)
    assert state.updates == len(times) and len(state.buffer) <= len(times)


def test_closing_step_completes_a_bounded_stream(spark, tmp_path):
    """Stream and closing step together give the batch result: windows and records, each once."""
    root = tmp_path / "logs"
    write_logs(root / "a", [f"u{i}" for i in range(40)], 1000.0)
    streams = [logs.stream_logs(spark, str(root), k) for k in S.LOG_FIELDS]
    tables = [logs.scan_logs(spark, str(root), k) for k in S.LOG_FIELDS]
    q = jobs.correlate_uid_stream(*streams).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(600)
    emitted = spark.read.parquet(str(tmp_path / "o"))
    still = jobs.open_records(*tables)
    assert 0 < emitted.count() < 40 and still.count() > 0
    uids = [r[0] for r in emitted.select("uid").union(still.select("uid")).collect()]
    assert sorted(uids) == sorted(f"u{i}" for i in range(40))


def _lines_of(folder, name, kind, rows):
    (folder / name).mkdir(parents=True)
    for k, lines in rows.items():
        (folder / name / f"{k}.log").write_text("\n".join(lines) + "\n")


def test_records_by_arrival_lose_nothing(spark, tmp_path):
    """Three runs: parts that arrive together are one record whatever their times; a part that arrives
    after its record came out, far behind all others in time, is found in the table beside."""
    root, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    root.mkdir()
    ssl = lambda uid, ts: "\t".join([str(ts), uid] + ["-"] * 4 + ["TLSv12"] + ["-"] * 10)

    def run():
        merged = arrivals.records_by_arrival(*[logs.stream_logs(spark, str(root), k) for k in S.LOG_FIELDS], gap_seconds=1)
        arrivals.finish_records(arrivals.start_records(merged, out, state), 240)
        read = lambda name: Counter((r.uid, r.conn and r.conn.ts, r.ssl and r.ssl.ts) for r in spark.read.schema(merged.schema).parquet(f"{out}/{name}").collect())
        return read("records"), read("late")

    _lines_of(root, "one", None, {"conn": [conn_line("A", ts="10"), conn_line("A", ts="12"), conn_line("B", ts="50000")], "ssl": [ssl("A", 900)], "http": ["#nothing"]})
    assert run() == (Counter([("A", "12", "900"), ("B", "50000", None)]), Counter())
    _lines_of(root, "two", None, {"conn": [conn_line("C", ts="90000")], "ssl": [ssl("A", 11)], "http": ["#nothing"]})
    assert run() == (Counter([("A", "12", "900"), ("B", "50000", None), ("C", "90000", None)]), Counter([("A", None, "11")]))
    _lines_of(root, "three", None, {"conn": [conn_line("A", ts="13")], "ssl": ["#nothing"], "http": ["#nothing"]})
    assert run() == (Counter([("A", "12", "900"), ("A", "13", None), ("B", "50000", None), ("C", "90000", None)]), Counter([("A", None, "11")]))


def test_rolling_counts_of_a_stream_in_three_batches(spark, tmp_path):
    """Rows out of order within the delay, in several files: stream and closing step give the batch's counts."""
    rng = random.Random(3)
    rows = sorted((rng.randrange(0, 9000) + rng.random(), f"10.0.0.{rng.randrange(3)}", f"10.0.1.{rng.randrange(2)}") for _ in range(300))
    schema = "timestamp double, src_ip string, dst_ip string"
    folder = tmp_path / "in"
    for i in range(3):
        part = rows[100 * i : 100 * i + 100]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        q = arrivals.rolling_counts_stream(stream, delay="10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "o"))
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    whole = spark.read.schema(schema).parquet(str(folder))
    got = spark.read.parquet(str(tmp_path / "o")).unionByName(arrivals.open_counts(whole, "10 minutes")).collect()
    seen = defaultdict(list)
    for t, a, b in rows:
        for node in (a, b):
            seen[node].append(t)
    micros = {(r.node, r.micros): (r.connections_last_minute, r.connections_last_hour) for r in got}
    assert len(got) == len(micros) == sum(len(set(x)) for x in seen.values())
    for (node, m), (minute, hour) in micros.items():
        t = m / 1e6
        assert minute == sum(t - 60 - 1e-5 <= x <= t + 1e-5 for x in seen[node]) and hour == sum(t - 3600 - 1e-5 <= x <= t + 1e-5 for x in seen[node])


def _events(first, last):
    """Events an hour apart, of three users and two kinds in turn."""
    ids = range(first, last)
    start = datetime(2024, 1, 1)
    return pa.table({
        "event_id": list(ids), "ts": pa.array([start + timedelta(hours=i) for i in ids], pa.timestamp("us")), "user_id": [i % 3 for i in ids],
        "event_type": ["purchase" if i % 2 else "view" for i in ids], "value": [1.5] * len(ids), "props": ["{}"] * len(ids),
    })


def test_a_stream_that_outlasts_a_time_limit_is_no_result(spark, tmp_path, monkeypatch):
    """Waiting ends with the stream, not with a limit; any limit given is over at once here. A failed stream raises."""
    real = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: real(self, timeout and 0.001))
    d = str(tmp_path)
    pq.write_table(_events(0, 200), f"{d}/events.parquet")
    got = catalog.QUERIES["rolling_counts_stream"](spark, d).collect()
    assert len(got) == len({(r.node, r.micros) for r in got}) == 400
    with pytest.raises(StreamingQueryException, match="no such event"):
        bad = catalog._stream(spark, d, "events").select(F.when(F.col("event_id") == 7, F.raise_error(F.lit("no such event"))).otherwise("x").alias("x"))
        catalog._to_table(spark, bad, "bad")


def test_rolling_counts_of_a_table_in_several_files(spark, tmp_path):
    """The stream reads a table that is a folder, also one with folders by value, as the closing step does."""
    whole = _events(0, 200)
    for i in range(2):
        name = f"event_type={('view', 'purchase')[i]}"
        (tmp_path / "values" / "events.parquet" / name).mkdir(parents=True)
        (tmp_path / "files" / "events.parquet").mkdir(parents=True, exist_ok=True)
        part = whole.take(list(range(i, 200, 2)))
        pq.write_table(part, str(tmp_path / "files" / "events.parquet" / f"part-{i}.parquet"))
        pq.write_table(part.drop_columns(["event_type"]), str(tmp_path / "values" / "events.parquet" / name / "part.parquet"))
    micros = [int((t - datetime(1970, 1, 1)).total_seconds()) // 30 * 1_000_000 for t in whole["ts"].to_pylist()]
    seen = defaultdict(list)
    for m, user, kind in zip(micros, whole["user_id"].to_pylist(), whole["event_type"].to_pylist()):
        seen[f"u{user}"].append(m)
        seen[f"s-{kind}"].append(m)
    want = {(n, m, sum(0 <= m - x <= 60_000_000 for x in t), sum(0 <= m - x <= 3_600_000_000 for x in t)) for n, t in seen.items() for m in t}
    for d in ("files", "values"):
        got = [tuple(r) for r in catalog.QUERIES["rolling_counts_stream"](spark, str(tmp_path / d)).collect()]
        assert len(got) == len(want) == 400 and set(got) == want


def test_change_feed_of_a_stream_equals_the_changes_of_neighbouring_snapshots(spark, tmp_path):
    """Rows out of order, a new batch at a time, and a batch that is written twice."""
    schema = "timestamp double, src_ip string, dst_ip string, protocol string, service string, dst_port int, " + ", ".join(
        f"{c} bigint" for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes"))
    rng = random.Random(8)
    data = [(float(1000 + 7 * i + rng.choice((0, 30))), "hot" if i % 3 else f"a{rng.randrange(6)}", f"b{rng.randrange(5)}", "tcp", rng.choice(("http", "http,ssl")),
             rng.choice((80, None)), *[1] * 6) for i in range(150)]
    out, state = str(tmp_path / "o"), str(tmp_path / "s")
    for k in range(3):
        spark.createDataFrame(data[50 * k:50 * k + 50], schema).write.mode("append").parquet(str(tmp_path / "in"))
        feed = arrivals.change_feed_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60, "2 minutes")
        arrivals.start_changes(feed, out, state).awaitTermination(600)
    whole = spark.createDataFrame(data, schema)
    columns = ["snapshot_ts", "kind", "node", *S.EDGE_KEYS]
    written = spark.read.schema(feed.schema).parquet(out).drop("batch")
    assert written.count() > 50
    got = Counter(tuple(r) for r in written.unionByName(arrivals.open_changes(whole, 60, "2 minutes")).select(columns).collect())
    # the graph as of each snapshot, one after the other
    rows = whole.withColumn("snapshot_ts", (F.floor(F.col("timestamp") / 60) * 60).cast("bigint"))
    want, before = Counter(), None
    nodes_at = lambda e: e.select(F.explode(F.array("src", "dst")).alias("node"), "connection_count").groupBy("node").agg(F.sum("connection_count").alias("n"))
    for t in sorted(r[0] for r in rows.select("snapshot_ts").distinct().collect())[:8]:
        now = edge_aggregate(rows.filter(F.col("snapshot_ts") <= t))
        old = now.limit(0) if before is None else before
        found = changes.graph_changes(nodes_at(old), nodes_at(now), old, now)
        want.update((t, r.kind, r.node, *[r[c] for c in S.EDGE_KEYS]) for r in found.collect() if r.kind != "EDGE_CREATE" or r.dst_port is not None)
        before = now
    last = max(r[0] for r in want)
    mine = Counter({r: n for r, n in got.items() if r[0] <= last and (r[1] != "EDGE_CREATE" or r[-1] is not None)})
    assert mine == want
    edges = edge_aggregate(rows, ("snapshot_ts",))
    assert Counter(tuple(r) for r in changes.change_feed(edges).select(columns).collect()) == got
    assert sum(n for r, n in got.items() if r[1] == "EDGE_CREATE") == edges.select(*S.EDGE_KEYS).distinct().count()
