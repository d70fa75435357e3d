"""Structured Streaming jobs: merging, snapshots, rolling activity, statistics, drift.

All jobs work on event time. A watermark bounds their state; its delay is a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hostweave import schemas as S
from hostweave.operators import drift as drift_ops
from hostweave.operators.connections import flatten_connection, last_parts, tag_parts, valid_endpoints
from hostweave.operators.edges import _SUM_SOURCES, _edge_keys
from hostweave.operators.hosts import host_roles
from hostweave.operators.stats import save_stats, stats_combine
from hostweave.session import cut
from hostweave.sources.snapshots import mark_finished, write_partitions

DELAY = "1 minute"


def with_event_time(df: DataFrame, seconds: str = "ts") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds(F.col(seconds).try_cast("double")))


def correlate_uid_stream(conn: DataFrame, ssl: DataFrame, http: DataFrame, gap_seconds: int = 5, delay: str = DELAY) -> DataFrame:
    """Merge the rows of one uid until none has come for more than ``gap_seconds``.

    A row after that starts a new record, which is dropped unless it has a conn row of its own. A
    pause of exactly the gap still belongs to the record. A connection that lasts longer than the
    gap, with its rows at both ends, can split; widen the gap for such logs.
    """
    parts = tag_parts(*[with_event_time(d) for d in (conn, ssl, http)], keep=("event_time",))
    session = F.session_window("event_time", f"{gap_seconds} seconds 1 microsecond")
    merged = parts.withWatermark("event_time", delay).groupBy("uid", session).agg(*last_parts())
    return merged.filter(F.col("conn").isNotNull()).drop("session_window")


def connections_stream(conn: DataFrame, ssl: DataFrame, http: DataFrame, gap_seconds: int = 5, delay: str = DELAY) -> DataFrame:
    """Raw log streams to valid flat connections."""
    return valid_endpoints(flatten_connection(correlate_uid_stream(conn, ssl, http, gap_seconds, delay)))


def snapshot_tumbling(connections: DataFrame, seconds: int = 60, delay: str = DELAY) -> DataFrame:
    """One edge table per time window, emitted when the watermark has passed its end."""
    rows = with_event_time(_edge_keys(connections), "timestamp").withWatermark("event_time", delay)
    grouped = rows.groupBy(F.window("event_time", f"{seconds} seconds").alias("w"), *S.EDGE_KEYS).agg(
        F.count(F.lit(1)).alias("connection_count"), *[F.sum(c).alias(n) for n, c in _SUM_SOURCES.items()],
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    return grouped.select(F.unix_seconds("w.start").alias("snapshot_ts"), *[c for c in grouped.columns if c != "w"])


def snapshot_cumulative_stream(connections: DataFrame) -> DataFrame:
    """Edges over all history, kept as state; use it with update or complete output."""
    return _edge_keys(connections).groupBy(*S.EDGE_KEYS).agg(
        F.count(F.lit(1)).alias("connection_count"), *[F.sum(c).alias(n) for n, c in _SUM_SOURCES.items()],
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )


def rolling_activity_stream(connections: DataFrame, seconds: int = 60, slide: int = 10, delay: str = DELAY) -> DataFrame:
    """Connections of each host in sliding windows."""
    rows = with_event_time(host_roles(connections), "timestamp").withWatermark("event_time", delay)
    w = F.window("event_time", f"{seconds} seconds", f"{slide} seconds")
    return rows.groupBy(w.alias("w"), "node").agg(F.count(F.lit(1)).alias("connections")).select(
        F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), "node", "connections"
    )


def watermark(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """One row: where the watermark of a finished stream over ``rows`` (with event_time) ends.

    Streams keep milliseconds, so the newest time is cut to them.
    """
    newest = F.timestamp_millis(F.unix_millis(F.max("event_time")))
    return rows.agg((newest - F.expr(f"interval {delay}")).alias("_mark"))


def open_snapshots(connections: DataFrame, seconds: int = 60, delay: str = DELAY) -> DataFrame:
    """Closing step of :func:`snapshot_tumbling` over the same, now complete, input: the windows that
    the watermark has not passed and that the stream therefore never wrote."""
    rows = with_event_time(_edge_keys(connections), "timestamp")
    ends = F.timestamp_seconds(F.floor(F.unix_micros("event_time") / (seconds * 1000000)) * seconds + seconds)
    late = rows.withColumn("_end", ends).crossJoin(F.broadcast(watermark(rows, delay))).filter("_end > _mark")  # one row
    grouped = late.groupBy(F.window("event_time", f"{seconds} seconds").alias("w"), *S.EDGE_KEYS).agg(
        F.count(F.lit(1)).alias("connection_count"), *[F.sum(c).alias(n) for n, c in _SUM_SOURCES.items()],
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    return grouped.select(F.unix_seconds("w.start").alias("snapshot_ts"), *[c for c in grouped.columns if c != "w"])


def open_activity(connections: DataFrame, seconds: int = 60, slide: int = 10, delay: str = DELAY) -> DataFrame:
    """Closing step of :func:`rolling_activity_stream`: the windows that were still open."""
    rows = with_event_time(host_roles(connections), "timestamp")
    w = F.window("event_time", f"{seconds} seconds", f"{slide} seconds")
    mark = watermark(rows, delay)
    # a row older than the longest open window cannot be in one
    near = rows.crossJoin(F.broadcast(mark)).filter(F.col("event_time") > F.col("_mark") - F.expr(f"interval {seconds} seconds"))
    counted = near.groupBy(w.alias("w"), "node", "_mark").agg(F.count(F.lit(1)).alias("connections")).filter("w.end > _mark")
    return counted.select(F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), "node", "connections")


def open_records(conn: DataFrame, ssl: DataFrame, http: DataFrame, gap_seconds: int = 5, delay: str = DELAY) -> DataFrame:
    """Closing step of :func:`correlate_uid_stream`: the records that still waited for their gap.

    Only uids with a row near the end can have one; their records are merged again from all their rows.
    """
    parts = tag_parts(*[with_event_time(d) for d in (conn, ssl, http)], keep=("event_time",))
    gap = f"{gap_seconds} seconds 1 microsecond"
    mark = watermark(parts, delay)
    recent = parts.crossJoin(F.broadcast(mark)).filter(F.col("event_time") + F.expr(f"interval {gap}") > F.col("_mark"))
    mine = parts.join(recent.select("uid").distinct(), "uid", "left_semi")
    session = F.session_window("event_time", gap)
    merged = mine.groupBy("uid", session).agg(*last_parts()).crossJoin(F.broadcast(mark))
    return merged.filter(F.col("conn").isNotNull() & (F.col("session_window.end") > F.col("_mark"))).drop("session_window", "_mark")


def start_snapshots(edges: DataFrame, out_dir: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write windowed edges to the snapshot table ``edges`` and mark each window as finished.

    A window comes out once; a repeated batch replaces its windows. ``interval`` (such as
    ``60 seconds``) runs until stopped; without it the data at hand is processed and the query ends,
    and :func:`close_snapshots` then writes the windows that were still open.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}

    def write(batch: DataFrame, batch_id: int) -> None:
        close_snapshots(batch, out_dir)

    return edges.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def close_snapshots(edges: DataFrame, out_dir: str) -> None:
    """Write whole windows of edges (of a batch, or of :func:`open_snapshots`) and mark them finished."""
    root = out_dir.rstrip("/")
    rows = cut(edges, "windows")
    write_partitions(rows, f"{root}/edges")
    mark_finished(rows.select("snapshot_ts").distinct(), root)


def start_cumulative(edges: DataFrame, out_dir: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write the whole graph at each trigger as one version of a table. A repeated batch replaces
    its own version."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    target = out_dir.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    return edges.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_bad_rows(bad: DataFrame, out_dir: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the lines that do not parse beside the stream that drops them."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        bad.writeStream.outputMode("append").format("json").option("checkpointLocation", checkpoint)
        .option("path", out_dir).trigger(**trigger).start()
    )


def _version(root: str, name: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/state/{name}/version={batch_id}"


def update_state(spark: SparkSession, parts: DataFrame, root: str, batch_id: int) -> DataFrame | None:
    """Merge a batch's statistics (one row per snapshot and feature) into the running ones.

    Returns the statistics before the batch (None at the first). Each batch writes its own version
    from the one before it, so a repeated batch gives the same version and counts nothing twice.
    The state is one row per feature, however long the stream runs.
    """
    before = None
    if batch_id > 0:
        older = spark.read.parquet(f"{root.rstrip('/')}/state/node_stats").filter(F.col("version") < batch_id)
        newest = older.agg(F.max("version").alias("version"))  # one row
        before = older.join(F.broadcast(newest), "version", "left_semi").drop("version")
    batch = parts.drop("snapshot_ts")
    merged = stats_combine(batch if before is None else before.unionByName(batch))
    save_stats(merged, f"{root.rstrip('/')}/state/node_stats", batch_id)
    return before


def drift_monitor(
    spark: SparkSession, parts: DataFrame, before: DataFrame | None, root: str, batch_id: int, reference: str = "prior",
) -> DataFrame:
    """Drift and streak of the batch's snapshots, continuing from the batch before.

    What came before enters as one part ahead of all snapshots, and the open streak as that many
    drifting rows; both are dropped from the result, which is written as this batch's version.
    """
    ahead = -1
    rows = parts if before is None else parts.unionByName(before.withColumn("snapshot_ts", F.lit(ahead).cast("bigint")))
    drift = drift_ops.feature_drift(rows, reference=reference).filter(F.col("snapshot_ts") > ahead)
    carried = 0
    if batch_id > 0:
        # a batch without snapshots leaves the streak of the one before it
        older = spark.read.parquet(f"{root.rstrip('/')}/state/drift").filter(F.col("version") < batch_id)
        last = older.agg(F.max_by("streak", F.struct("version", "snapshot_ts")).alias("s")).head()
        carried = int(last["s"] or 0)
    if carried:
        open_streak = spark.range(carried).select(
            (F.col("id") - carried).alias("snapshot_ts"), F.lit(0.0).alias("max_shift"), F.lit("").alias("feature"), F.lit(True).alias("drift")
        )
        drift = drift.unionByName(open_streak)
    streak = drift_ops.drift_streak(drift).filter(F.col("snapshot_ts") > ahead)
    path = _version(root, "drift", batch_id)
    streak.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
