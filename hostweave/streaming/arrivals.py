"""Stateful streams: records that close by silence, rolling counts at each connection, a feed of changes.

All need the state store that has timers (``prepare_state_store``).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hostweave import schemas as S
from hostweave.operators.changes import change_feed, change_rows, touched
from hostweave.operators.edges import _edge_keys
from hostweave.operators.hosts import host_roles, rolling_connections
from hostweave.streaming.jobs import DELAY, watermark, with_event_time

FIELD = "\x00"  # between the fields of a part; logs have none
MINUTE, HOUR = 60, 3600


def prepare_state_store(spark: SparkSession) -> None:
    """Timers need the RocksDB state store, which comes with Spark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- records -----------------------------------------------------------------------------------


def _silence(gap_ms: int):
    """Holds the last part of each kind of a uid until none has arrived for the gap, then gives the record away."""
    from pyspark.sql.streaming import StatefulProcessor

    kinds = list(S.LOG_FIELDS)
    columns = [c for k in kinds for c in (f"{k}_at", k)]

    class Silence(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.parts = handle.getValueState("parts", ", ".join(f"{k}_at double, {k} string" for k in kinds))

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            held = list(self.parts.get()) if self.parts.exists() else [None] * len(columns)
            for frame in rows:
                for kind, at, body in zip(frame["kind"], frame["at"], frame["body"]):
                    i = 2 * kinds.index(kind)
                    at = None if at != at else at
                    # an unreadable time comes before all others
                    if held[i + 1] is None or (at is not None, at or 0.0, body) > (held[i] is not None, held[i] or 0.0, held[i + 1]):
                        held[i], held[i + 1] = at, body
            self.parts.update(tuple(held))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + gap_ms + 1)
            yield pd.DataFrame({c: pd.Series(dtype=object) for c in ["uid", *columns]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            held = self.parts.get()
            self.parts.clear()
            yield pd.DataFrame([[key[0], *held]], columns=["uid", *columns]).astype(object)

        def close(self) -> None:
            pass

    return Silence()


def records_by_arrival(conn: DataFrame, ssl: DataFrame, http: DataFrame, gap_seconds: float = 5) -> DataFrame:
    """Merge the rows of one uid until none has **arrived** for more than ``gap_seconds``, whatever their times.

    Each row gets into one record, and each record comes out once: uid and a struct for each kind, as
    :func:`connections.correlate_uid` gives them. Of several rows of a kind the last by time counts.
    Nothing is too late here: a row that arrives after its record came out begins another one. If
    that has no conn row it is no connection but comes out all the same, with a null ``conn``;
    :func:`start_records` keeps such rows in a table of their own.

    Rows of one batch arrive together. State is one row for each uid that is not yet silent.
    """
    prepare_state_store(conn.sparkSession)
    parts = None
    for kind, df in (("conn", conn), ("ssl", ssl), ("http", http)):
        body = F.concat_ws(FIELD, *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in S.LOG_FIELDS[kind]])
        part = df.filter(F.coalesce(F.col("uid"), F.lit("")) != "").select("uid", F.lit(kind).alias("kind"), F.col("ts").try_cast("double").alias("at"), body.alias("body"))
        parts = part if parts is None else parts.unionByName(part)
    schema = "uid string, " + ", ".join(f"{k}_at double, {k} string" for k in S.LOG_FIELDS)
    found = parts.groupBy("uid").transformWithStateInPandas(_silence(int(gap_seconds * 1000)), schema, "append", "processingTime")

    def struct(kind: str):
        fields = F.split(kind, FIELD, -1)
        row = F.struct(F.col(f"{kind}_at").alias("at"), *[fields[i].alias(n) for i, n in enumerate(S.LOG_FIELDS[kind])])
        return F.when(F.col(kind).isNotNull(), row).alias(kind)

    return found.select("uid", *[struct(k) for k in S.LOG_FIELDS])


def start_records(records: DataFrame, out_dir: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write records to the table ``records`` below ``out_dir``, and those without a conn row to ``late``.

    A repeated batch replaces what it wrote. Without ``interval`` the data at hand is processed, and
    empty batches then watch the clock for the uids that are not yet silent: end it by
    :func:`finish_records`, or by ``stop()`` if the state shall wait for the next run.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    root = out_dir.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        rows.filter("conn is not null").write.mode("overwrite").parquet(f"{root}/records/batch={batch_id}")
        rows.filter("conn is null").write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        rows.unpersist()

    return records.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def finish_records(query: StreamingQuery, seconds: float = 1800) -> None:
    """Wait until all data is read and every uid is silent, then stop the query."""
    until = time.monotonic() + seconds
    while query.isActive:
        # a restarted query first repeats the batch it was stopped in, so one empty batch says nothing
        last = query.recentProgress[-3:]
        if len(last) == 3 and all(p.numInputRows == 0 and all(o.numRowsTotal == 0 for o in p.stateOperators) for p in last):
            query.stop()
            return
        if time.monotonic() > until:
            query.stop()
            raise TimeoutError("uids are still not silent")
        time.sleep(0.2)
    query.awaitTermination()


# --- rolling counts ----------------------------------------------------------------------------


def _rolling(minute: int, hour: int):
    """Counts of a host's connections at each time, kept for the longer of two windows."""
    from pyspark.sql.streaming import StatefulProcessor

    class Rolling(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "times binary, counts binary, done bigint")

        def _load(self):
            import numpy as np

            if not self.seen.exists():
                return np.zeros(0, np.int64), np.zeros(0, np.int64), -(2**62)
            times, counts, done = self.seen.get()
            return np.frombuffer(times, np.int64), np.frombuffer(counts, np.int64), done

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pandas as pd

            times, counts, done = self._load()
            new = np.concatenate([f["micros"].to_numpy(np.int64) for f in rows])
            times, at = np.unique(np.concatenate([times, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.ones(len(new))]), len(times)).astype(np.int64)
            self.seen.update((times.tobytes(), counts.tobytes(), done))
            if not any(True for _ in self.handle.listTimers()):
                self._wait(times, done)
            yield pd.DataFrame({"node": [], "micros": [], "a": [], "b": []}).astype({"node": str, "micros": "int64", "a": "int64", "b": "int64"})

        def _wait(self, times, done) -> None:
            open_ = times[times > done]
            if len(open_):
                self.handle.registerTimer(int(-(-open_[0] // 1000)))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import numpy as np
            import pandas as pd

            times, counts, done = self._load()
            mark = timerValues.getCurrentWatermarkInMs() * 1000
            upto = np.concatenate([[0], np.cumsum(counts)])
            due = np.flatnonzero((times > done) & (times <= mark))
            within = lambda s: upto[due + 1] - upto[np.searchsorted(times, times[due] - s * 1_000_000)]
            out = pd.DataFrame({"node": [key[0]] * len(due), "micros": times[due], "a": within(minute), "b": within(hour)})
            kept = times > mark - hour * 1_000_000
            self.seen.update((times[kept].tobytes(), counts[kept].tobytes(), int(max(done, mark))))
            self._wait(times, max(done, mark))
            yield out

        def close(self) -> None:
            pass

    return Rolling()


def rolling_counts_stream(connections: DataFrame, delay: str = DELAY, minute: int = MINUTE, hour: int = HOUR) -> DataFrame:
    """Connections of each host in the last minute and hour, at each time it has one, as a stream.

    Columns node, micros, connections_last_minute, connections_last_hour: the rows of
    :func:`hosts.rolling_connections`. A time comes out, once and exact, when the watermark has passed it,
    so rows may come out of order by up to ``delay``; later ones are dropped by Spark. The state of
    a host is one count for each distinct time of the last hour and of the delay.
    """
    prepare_state_store(connections.sparkSession)
    rows = with_event_time(host_roles(connections), "timestamp").withWatermark("event_time", delay)
    rows = rows.select("node", "event_time", F.unix_micros("event_time").alias("micros"))
    found = rows.groupBy("node").transformWithStateInPandas(_rolling(minute, hour), "node string, micros bigint, a bigint, b bigint", "append", "eventTime")
    return found.select("node", "micros", F.col("a").alias("connections_last_minute"), F.col("b").alias("connections_last_hour"))


def open_counts(connections: DataFrame, delay: str = DELAY) -> DataFrame:
    """Closing step of :func:`rolling_counts_stream` over the same, now complete, input: the times that
    the watermark has not passed."""
    rows = with_event_time(host_roles(connections), "timestamp").select("node", "event_time", F.unix_micros("event_time").alias("micros"))
    mark = watermark(rows, delay).select(F.unix_micros("_mark").alias("_mark"))
    near = rows.crossJoin(F.broadcast(mark)).filter(F.col("micros") >= F.col("_mark") - HOUR * 1_000_000)  # one row
    counted = rolling_connections(near.select("node", "micros"))
    return counted.crossJoin(F.broadcast(mark)).filter("micros > _mark").drop("_mark").distinct()


# --- changes -----------------------------------------------------------------------------------


def _first_seen():
    """Tells a key's first window from its later ones; the windows come closed, and so in order over the batches."""
    from pyspark.sql.streaming import StatefulProcessor

    class FirstSeen(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", "first bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            times = sorted(t for frame in rows for t in frame["snapshot_ts"])
            known = self.seen.exists()
            if not known:
                self.seen.update((int(times[0]),))
            yield pd.DataFrame({"key": key[0], "snapshot_ts": times, "created": [not known and i == 0 for i in range(len(times))]})

        def close(self) -> None:
            pass

    return FirstSeen()


def change_feed_stream(connections: DataFrame, seconds: int = 60, delay: str = DELAY) -> DataFrame:
    """Changes of the graph that is never cleared, window by window: the rows of :func:`changes.change_feed`.

    One row when a host or edge first takes part, and one for each later window a host takes part in. A
    window's rows come out when the watermark has passed its end, so the order of arrival within
    ``delay`` makes no difference. A hot host's connections combine before the shuffle, and the step with
    state gets one row for each window and key. Its state is one number for each host and edge ever seen.
    """
    prepare_state_store(connections.sparkSession)
    rows = with_event_time(_edge_keys(connections), "timestamp").withWatermark("event_time", delay)
    closed = touched(rows, "event_time").groupBy(F.window("event_time", f"{seconds} seconds").alias("w"), "key").agg(F.count(F.lit(1)).alias("n"))
    windows = closed.select("key", F.unix_seconds("w.start").alias("snapshot_ts"))
    found = windows.groupBy("key").transformWithStateInPandas(_first_seen(), "key string, snapshot_ts bigint, created boolean", "append", "none")
    return change_rows(found, connections.schema["dst_port"].dataType.simpleString())


def open_changes(connections: DataFrame, seconds: int = 60, delay: str = DELAY) -> DataFrame:
    """Closing step of :func:`change_feed_stream` over the same, now complete, input: the changes of the
    windows that the watermark has not passed."""
    rows = with_event_time(_edge_keys(connections), "timestamp").filter("event_time is not null")
    start = F.floor(F.unix_micros("event_time") / (seconds * 1000000)) * seconds
    feed = change_feed(rows.withColumn("snapshot_ts", start.cast("bigint")))
    mark = watermark(rows, delay)
    return feed.crossJoin(F.broadcast(mark)).filter(F.timestamp_seconds(F.col("snapshot_ts") + seconds) > F.col("_mark")).drop("_mark")  # one row


def start_changes(feed: DataFrame, out_dir: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write a feed to ``out_dir``, a folder for each batch. A repeated batch replaces its own, so a
    reader can replay the feed from any batch and sees each event once."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    root = out_dir.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return feed.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
