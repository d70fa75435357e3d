"""Files that grow, state over a long life, histories of busy hosts, scans over hot keys."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostweave import schemas as S
from hostweave.operators import drift, history, hosts as ho, scaling
from hostweave.operators.moments import Moments, SlidingMoments, no_moments
from hostweave.operators.scale_out import range_scan
from hostweave.plans import pipelines
from hostweave.session import versions
from hostweave.sources import flows as fl, logs, tail
from hostweave.streaming import monitor
from test_logs import conn_line

SF = "/root/testdata/sf0.001"


@pytest.fixture
def uncoalesced(spark):
    """Small tables keep their ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# --- files that grow


def test_growing_files(spark, tmp_path):
    """Half a line waits for its rest, a file cut to nothing starts anew, a new file is found."""
    folder, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    (folder / "a").mkdir(parents=True)
    log = folder / "a" / "conn.log"

    def read():
        rows = logs.stream_logs(spark, str(folder), "conn", growing=True).select("uid")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(300)
        return Counter(r.uid for r in spark.read.schema("uid string").parquet(out).collect())

    second = conn_line("two")
    log.write_text("#comment\n" + conn_line("one") + "\n" + second[:10])
    assert read() == Counter(["one"])
    assert read() == Counter(["one"])
    log.write_text("#comment\n" + conn_line("one") + "\n" + second + "\r\n" + conn_line("three"))
    assert read() == Counter(["one", "two"])
    with log.open("a") as f:
        f.write("\n\n" + conn_line("four") + "\n")
    (folder / "b").mkdir()
    (folder / "b" / "conn.log").write_text(conn_line("five") + "\n")
    (folder / "b" / "other.log").write_text(conn_line("never") + "\n")
    assert read() == Counter(["one", "two", "three", "four", "five"])
    log.write_text(conn_line("anew") + "\n")
    assert read() == Counter(["one", "two", "three", "four", "five", "anew"])
    log.unlink()
    assert read() == Counter(["one", "two", "three", "four", "five", "anew"])
    log.write_text(conn_line("again") + "\n")
    assert read() == Counter(["one", "two", "three", "four", "five", "anew", "again"])


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_a_line_belongs_to_one_split(spark, tmp_path, split):
    rng = random.Random(split)
    lines = ["x" * rng.randrange(40) + str(i) for i in range(200)] + ["", "é" * 30]
    (tmp_path / "conn.log").write_text("\n".join(lines) + "\nunfinished")
    reader = tail.growing_lines()({"path": str(tmp_path), "names": "conn.log", "split": str(split)}).streamReader(None)
    end = reader.latestOffset()
    got = [v for piece in reader.partitions({}, end) for batch in reader.read(piece) for v in batch.column(0).to_pylist()]
    assert got == lines
    middle = {p: len(("\n".join(lines[:50]) + "\n").encode()) for p in end}
    got = [v for piece in reader.partitions(middle, end) for batch in reader.read(piece) for v in batch.column(0).to_pylist()]
    assert got == lines[50:] and reader.partitions(end, end) == []


# --- state over a long life


def moments_of(rows):
    gap = rows - rows.mean(axis=0)
    return Moments(len(rows), rows.mean(axis=0), gap.T @ gap)


def test_sliding_moments_equal_a_merge_of_the_queue():
    rng = np.random.default_rng(5)
    queue, plain = SlidingMoments(3), []
    for step in range(400):
        m = moments_of(rng.normal(size=(rng.integers(1, 6), 3)) + 100)
        queue.push(step, m)
        plain.append(m)
        gone = max(0, len(plain) - 50) if step % 37 else len(plain) // 2
        queue.drop(gone)
        plain = plain[gone:]
        if step % 10 == 0:
            queue = SlidingMoments.unpacked(queue.packed(), 3)
        joint = no_moments(3)
        for x in plain:
            joint = joint.merge(x)
        assert len(queue) == len(plain) and queue.total().n == joint.n
        assert np.allclose(queue.total().mean, joint.mean) and np.allclose(queue.total().products, joint.products)


def test_a_late_batch_reads_one_state(spark, tmp_path, monkeypatch):
    """After 200 batches: one state file is opened, two stay, and work tables are gone."""
    root = str(tmp_path)
    features = len(S.NODE_FEATURES)
    state = monitor.MonitorState(features)
    rng = np.random.default_rng(1)
    for batch in range(200):
        state.learn(batch, moments_of(rng.normal(size=(4, features))), 0.15, 20)
        first = batch * monitor.STEPS
        if batch % 20 == 19:
            monitor.prune(spark, root, first)
        (tmp_path / "state" / "monitor" / f"version={first}").mkdir(parents=True)
        (tmp_path / "state" / "monitor" / f"version={first}" / "part-0.txt").write_text(state.to_json() + "\n")
        (tmp_path / "features" / f"batch={first}").mkdir(parents=True)
    first = 200 * monitor.STEPS
    monitor.prune(spark, root, first)
    assert versions(spark, f"{root}/state/monitor") == [199 * monitor.STEPS] and versions(spark, f"{root}/features", "batch") == []
    opened = []
    read = type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, path, **k: opened.append(path) or read(self, path, **k))
    again = monitor._read_state(spark, root, first)
    assert opened == [f"{root}/state/monitor/version={199 * monitor.STEPS}"]
    assert again.updates == 200 and len(again.buffer) == len(state.buffer) and np.allclose(again.buffer.total().products, state.buffer.total().products)
    assert monitor._read_state(spark, str(tmp_path / "none"), 5).updates == 0


def test_done_marks_are_read_by_day(spark, tmp_path):
    done = str(tmp_path / "done")
    times = [0, 60, monitor.DAY, 5 * monitor.DAY + 1]
    monitor._mark_done(spark, done, times, 7)
    assert monitor._already_done(spark, done, [0, 120, monitor.DAY, 9 * monitor.DAY], 8) == {0, monitor.DAY}
    assert monitor._already_done(spark, done, times, 7) == set() and monitor._already_done(spark, done, [99 * monitor.DAY], 8) == set()


# --- buffer cuts, scans


def test_buffer_cuts_equal_a_walk(spark, uncoalesced):
    rng = random.Random(2)
    for n, share, size, chunk in ((300, 0.5, 13, 4), (300, 0.05, 2000, 3), (40, 1.0, 5, 1000), (20, 0.0, 5, 7)):
        times = sorted(rng.sample(range(10_000), n))
        hits = {t for t in times if rng.random() < share}
        buffer, want = [], []
        for t in times:
            buffer = [*buffer, t][-size:]
            if t in hits:
                buffer = buffer[len(buffer) - len(buffer) // 2 :]
                want.append((t, len(buffer), buffer[0] if buffer else None))
        snapshots = spark.createDataFrame([(t,) for t in times], "snapshot_ts long")
        streak = spark.createDataFrame([(t, t in hits) for t in times], "snapshot_ts long, triggered boolean")
        got = drift.adapt_window(snapshots, streak, size, chunk=chunk).collect()
        assert sorted(map(tuple, got)) == want


def test_range_scan_of_a_hot_key(spark, uncoalesced):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(20)}", rng.randrange(10**6), rng.randrange(9)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "key string, at long, v long")
    parts = df.repartitionByRange("key", "at").withColumn("p", F.spark_partition_id()).filter("key = 'hot'").select("p").distinct().count()
    got = range_scan(df, ["key"], ["at"], ["v"]).collect()
    sums = defaultdict(int)
    for key, at, v in rows:
        sums[key, at] += v
    run, want = defaultdict(int), {}
    for key, at in sorted(sums):
        run[key] += sums[key, at]
        want[key, at] = run[key]
    assert parts > 3 and len(got) == len(rows) and all(r.v_run == want[r.key, r.at] for r in got)
    whole = range_scan(df, [], ["at", "key"], ["v"]).agg(F.max("v_run")).head()[0]
    assert whole == sum(v for _, _, v in rows)


# --- histories


def test_history_of_a_busy_host(spark, uncoalesced):
    """One host in every connection of many snapshots: its walk is cut into ranges, with the same rows."""
    c = fl.connections(spark, SF).limit(400).withColumn("src_ip", F.lit("10.9.9.9"))
    c = c.withColumn("snapshot_ts", F.pmod(F.xxhash64("uid"), F.lit(97)).cast("bigint")).cache()
    assert c.select("snapshot_ts").distinct().count() > 80
    got = {(r.snapshot_ts, r.node): r for r in history.snapshot_cumulative_hosts(c).collect()}
    times = sorted({t for t, _ in got})
    for t in (times[0], times[len(times) // 2], times[-1]):
        want = ho.node_rollup_conn(c.filter(F.col("snapshot_ts") <= t)).collect()
        for r in want:
            at = max(s for s, n in got if n == r.node and s <= t)
            mine = got[at, r.node].asDict()
            assert mine["valid_to"] is None or mine["valid_to"] > t
            assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in r.asDict().items() if k != "node"} == {k: mine[k] for k in r.asDict() if k != "node"}
    as_of = pipelines.snapshot_at(history.snapshot_cumulative_hosts(c), times[10])
    assert as_of.count() == ho.node_rollup_conn(c.filter(F.col("snapshot_ts") <= times[10])).count()


@pytest.mark.parametrize("age", [3, 100_000])
def test_fits_are_followed_through_ranges(spark, uncoalesced, age):
    """Times over many ranges: dense, sparse, and gaps in which whole ranges lie within one fit's time."""
    rng = np.random.default_rng(age)
    times = sorted({*range(-60, 40), *map(int, rng.integers(100, 3000, 90)), *map(int, rng.integers(10**6, 10**9, 40))})
    df = spark.createDataFrame([(t,) for t in times + times[::3]] + [(None,)], "snapshot_ts bigint").repartition(3)
    want, fit = [], None
    for t in times:
        fit = t if fit is None or t - fit > age else fit
        want.append((t, fit, t == fit))
    assert sorted(tuple(r) for r in scaling.scale_policy(df, age).collect()) == want
    assert scaling.scale_policy(df.filter("snapshot_ts is null"), age).collect() == []


def test_fits_join_few_times_with_each_other(spark, uncoalesced, monkeypatch):
    """Only times at which a chain of fits can enter a range are joined, not all times in each round."""
    seen, write = {}, scaling.cut
    monkeypatch.setattr(scaling, "cut", lambda df, name: seen.setdefault(name, write(df, name)) if name == "fit-jumps" and name not in seen else write(df, name))
    assert scaling.scale_policy(spark.range(20_000).select(F.col("id").alias("snapshot_ts")), 10).count() == 20_000
    assert 0 < seen["fit-jumps"].count() < 1000
