"""The snapshot monitor: every finished snapshot once, whole and in time order."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hostweave import schemas as S
from hostweave.operators.detect import (
    ERROR_FACTOR, SCORE_MIN, export_embeddings, merge_detections, reconstruct_score, report_rows, threshold_score, write_report_rows,
)
from hostweave.operators.drift import BUFFER, DRIFT_THRESHOLD, STREAK
from hostweave.operators.features import edge_features
from hostweave.operators.moments import Moments, SlidingMoments, model_of, no_moments, snapshot_moments
from hostweave.operators.scale_out import dense_index
from hostweave.operators.stats import STD_FLOOR, load_stats, save_stats, stats_combine, stats_update
from hostweave.plans import pipelines
from hostweave.session import prepare_session, remove_folder, versions

STEP = 256  # snapshots that are treated together; what the driver holds at a time is bounded by it
STEPS = 1_000_000  # version numbers that a batch can use
STATES = ("monitor", "node_stats", "edge_stats", "error_stats")
DAY = 86400


class MonitorState:
    """What the monitor carries from snapshot to snapshot; its size is bounded by the buffer.

    updates: snapshots so far. streak: drifting snapshots in a row. seen: moments of all snapshots.
    buffer: moments of the newest snapshots, the model's data. errors: n, mean and m2 of all
    reconstruction errors.
    """

    def __init__(self, features: int):
        self.updates, self.streak = 0, 0
        self.seen: Moments = no_moments(features)
        self.buffer = SlidingMoments(features)
        self.errors = [0, 0.0, 0.0]

    def to_json(self) -> str:
        return json.dumps({
            "updates": self.updates, "streak": self.streak, "seen": self.seen.packed(), "errors": self.errors,
            "buffer": self.buffer.packed(),
        })

    @staticmethod
    def from_json(text: str, features: int) -> MonitorState:
        d, state = json.loads(text), MonitorState(features)
        state.updates, state.streak, state.errors = d["updates"], d["streak"], d["errors"]
        state.seen = Moments.unpacked(d["seen"])
        state.buffer = SlidingMoments.unpacked(d["buffer"], features)
        return state

    def learn(self, ts: int, moments: Moments, threshold: float, size: int) -> dict:
        """Take in one snapshot: drift against all before it, streak, and the cut of the buffer."""
        worst, shift = 0, 0.0
        if self.seen.n:
            shifts = np.abs(moments.mean - self.seen.mean) / (self.seen.std() + 1e-6)
            worst = int(shifts.argmax())
            shift = float(shifts[worst])
        drift = shift > threshold
        self.streak = self.streak + 1 if drift else 0
        self.seen = self.seen.merge(moments)
        self.buffer.push(ts, moments)
        self.buffer.drop(max(0, len(self.buffer) - size))
        triggered = self.streak == STREAK
        if triggered:
            self.buffer.drop(len(self.buffer) - len(self.buffer) // 2)
            self.streak = 0
        self.updates += 1
        return {
            "snapshot_ts": ts, "update_count": self.updates, "max_shift": shift, "feature": S.NODE_FEATURES[worst], "drift": drift,
            "streak": self.streak, "triggered": triggered, "buffered": len(self.buffer),
        }

    def model(self, k: int):
        return model_of(self.buffer.total(), S.NODE_FEATURES, k)

    def add_errors(self, n: int, mean: float, m2: float) -> float | None:
        """Take in the errors of one snapshot; the threshold that now holds, None for fewer than two."""
        a, b, c = self.errors
        total = a + n
        gap = mean - b
        self.errors = [total, b + gap * n / total if total else 0.0, c + m2 + (gap * gap * a * n / total if total else 0.0)]
        return self.errors[1] + ERROR_FACTOR * max((self.errors[2] / total) ** 0.5, STD_FLOOR) if total >= 2 else None


def _newest(spark: SparkSession, root: str, name: str, batch_id: int) -> str | None:
    """Folder of the newest version of a state before this batch; no other version is opened."""
    older = [v for v in versions(spark, f"{root}/state/{name}") if v < batch_id]
    return f"{root}/state/{name}/version={older[-1]}" if older else None


def _read_state(spark: SparkSession, root: str, batch_id: int) -> MonitorState:
    """The newest state before this batch, so that a repeated batch starts where it first did."""
    features, path = len(S.NODE_FEATURES), _newest(spark, root, "monitor", batch_id)
    return MonitorState.from_json(spark.read.text(path).head()["value"], features) if path else MonitorState(features)


def prune(spark: SparkSession, root: str, first: int) -> None:
    """Remove what no batch from version ``first`` on reads: all but the newest earlier state, and the
    feature and score tables of earlier batches. Reports, drift rows and embeddings stay."""
    for name in STATES:
        for v in [v for v in versions(spark, f"{root}/state/{name}") if v < first][:-1]:
            remove_folder(spark, f"{root}/state/{name}/version={v}")
    for name in ("features", "scored"):
        for v in versions(spark, f"{root}/{name}", "batch"):
            if v < first:
                remove_folder(spark, f"{root}/{name}/batch={v}")


def _already_done(spark: SparkSession, done: str, times: list[int], version: int) -> set[int]:
    """Which of some snapshots an earlier version has reported; only the tables of their days are read."""
    days = sorted({t // DAY for t in times} & set(versions(spark, done, "day")))
    if not days:
        return set()
    rows = spark.read.option("basePath", done).schema("snapshot_ts bigint, version bigint").parquet(*[f"{done}/day={d}" for d in days])
    return {int(r["snapshot_ts"]) for r in rows.filter((F.col("version") < version) & F.col("snapshot_ts").isin(times)).select("snapshot_ts").collect()}


def _mark_done(spark: SparkSession, done: str, times: list[int], version: int) -> None:
    for day in sorted({t // DAY for t in times}):
        rows = spark.createDataFrame([(t,) for t in times if t // DAY == day], "snapshot_ts bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{done}/day={day}/version={version}")


def _write_state(spark: SparkSession, state: MonitorState, root: str, batch_id: int) -> None:
    frame = spark.createDataFrame([(state.to_json(),)], "value string")
    frame.coalesce(1).write.mode("overwrite").text(f"{root}/state/monitor/version={batch_id}")


def _merge_edge_stats(spark: SparkSession, edges: DataFrame, root: str, batch_id: int) -> None:
    """Running statistics of the edge measures, one row each."""
    batch = stats_update(edge_features(edges), S.EDGE_DERIVED)
    path = _newest(spark, root, "edge_stats", batch_id)
    if path:
        batch = batch.unionByName(spark.read.parquet(path))
    save_stats(stats_combine(batch), f"{root}/state/edge_stats", batch_id)


def process_snapshots(
    spark: SparkSession, nodes: DataFrame | None, edges: DataFrame, out_dir: str, batch_id: int, mode: str, model_path: str,
    k: int = 8, head: Callable[[DataFrame], DataFrame] | None = None, errors_path: str | None = None,
    buffer: int = BUFFER, drift_threshold: float = DRIFT_THRESHOLD, export_every: int | None = None,
) -> None:
    """Whole snapshots of one batch. Each is treated in time order as if it came alone, so the
    result does not depend on how snapshots fall into batches; only the passes over the rows (two,
    features and scores) are shared. A snapshot is scored by the model that has learnt it, and
    judged by the errors up to and with its own.
    """
    root = out_dir.rstrip("/")
    features_path = f"{root}/features/batch={batch_id}"
    pipelines.host_features(nodes, edges).write.mode("overwrite").parquet(features_path)
    features = spark.read.parquet(features_path)
    moments = snapshot_moments(features, S.NODE_FEATURES)
    state = _read_state(spark, root, batch_id)
    times = sorted(moments)
    numbers: dict[int, int] = {}
    if mode == "train":
        learnt, models = [], {}
        for ts in times:
            learnt.append(state.learn(ts, moments[ts], drift_threshold, buffer))
            models[ts] = state.model(k)
        numbers = {r["snapshot_ts"]: r["update_count"] for r in learnt}
        schema = "snapshot_ts bigint, update_count bigint, max_shift double, feature string, drift boolean, streak bigint, triggered boolean, buffered bigint"
        spark.createDataFrame([tuple(r.values()) for r in learnt], schema).write.mode("overwrite").parquet(f"{root}/state/drift/version={batch_id}")
        node_rows = [(c, state.seen.n, float(state.seen.mean[i]), float(state.seen.products[i, i])) for i, c in enumerate(S.NODE_FEATURES)]
        save_stats(spark.createDataFrame(node_rows, "feature string, n bigint, mean double, m2 double"), f"{root}/state/node_stats", batch_id)
        _merge_edge_stats(spark, edges, root, batch_id)
        if times:
            pipelines.save_model(spark, models[times[-1]], model_path)
        scored = pipelines.score_by_snapshot(features, models)
    elif mode == "detect":
        for ts in times:
            state.updates += 1
            numbers[ts] = state.updates
        scored = reconstruct_score(features, pipelines.load_model(spark, model_path))
    else:
        raise ValueError(f"unknown mode: {mode}")
    scored = head(scored) if head else scored.withColumn("mlp_score", F.lit(None).cast("double"))
    scored_path = f"{root}/scored/batch={batch_id}"
    scored.write.mode("overwrite").parquet(scored_path)
    scored = spark.read.parquet(scored_path)
    limits: dict[int, float | None] = {}
    if mode == "train":
        errors = {r["snapshot_ts"]: r for r in stats_update(scored, ["recon_error"], ("snapshot_ts",)).collect()}  # one row per snapshot
        for ts in times:
            limits[ts] = state.add_errors(errors[ts]["n"], errors[ts]["mean"], errors[ts]["m2"])
        save_stats(spark.createDataFrame([("recon_error", *state.errors)], "feature string, n bigint, mean double, m2 double"), f"{root}/state/error_stats", batch_id)
    else:
        given = load_stats(spark, errors_path or f"{root}/state/error_stats").head()
        whole = MonitorState(0)
        limits = dict.fromkeys(times, whole.add_errors(given["n"], given["mean"], given["m2"]))
    facts = [(ts, numbers[ts], moments[ts].n, limits[ts]) for ts in times]
    per = spark.createDataFrame(facts, "snapshot_ts bigint, update_count bigint, nodes_in_graph bigint, recon_threshold double")
    judged = scored.join(F.broadcast(per.select("snapshot_ts", "update_count", "recon_threshold")), "snapshot_ts")  # one row per snapshot of the batch
    judged = judged.withColumn("recon_flag", F.coalesce(F.col("recon_error") > F.col("recon_threshold"), F.lit(False)))
    index = dense_index(scored.select("snapshot_ts", "node"), "node", ["snapshot_ts"])
    flagged = merge_detections(threshold_score(judged, SCORE_MIN)).join(index, ["snapshot_ts", "node"]).withColumnRenamed("idx", "node_id")
    write_report_rows(report_rows(flagged, per.drop("recon_threshold")), f"{root}/reports/batch={batch_id}", mode="overwrite")
    if export_every:
        due = judged.filter(F.col("update_count") % export_every == 0)
        export_embeddings(due, f"{root}/embeddings/batch={batch_id}", ["snapshot_ts", "node", "recon_error"], mode="overwrite")
    _write_state(spark, state, root, batch_id)


def monitor_snapshots(
    spark: SparkSession, in_dir: str, out_dir: str, mode: str = "detect", model_path: str | None = None, interval: str | None = None,
    k: int = 8, max_files: int | None = 64, head: Callable[[DataFrame], DataFrame] | None = None, errors_path: str | None = None,
    with_nodes: bool = True, buffer: int = BUFFER, drift_threshold: float = DRIFT_THRESHOLD, export_every: int | None = None,
) -> StreamingQuery:
    """Follow the snapshot tables below ``in_dir`` and report the anomalies of each new snapshot.

    The stream is the table ``finished`` (see ``write_snapshot``), whose rows appear after the data of
    their snapshot; the snapshots themselves are then read whole from ``edges`` and, ``with_nodes``,
    from ``nodes``, without which the time-of-day features are 0. A snapshot that is marked again is
    not reported twice. One that is finished late is taken when it appears.

    ``train`` also updates statistics, drift, buffer and model; ``detect`` needs a stored model and its
    error statistics (``errors_path``) and fails without them. ``buffer`` is the number of snapshots
    the model learns from; older ones leave it, as the definition of the monitor says. ``head`` adds
    mlp_score; without one there is no second detector. ``export_every`` writes the embeddings of
    every so-manieth snapshot. Without ``interval`` the data at hand is processed.

    A batch takes at most ``max_files`` marks and treats ``STEP`` snapshots at a time. It reads one
    version of each state and the done-marks of its snapshots' days, and removes what is no longer
    needed (:func:`prune`), so a batch costs the same however many came before it.
    """
    prepare_session(spark)
    root, out = in_dir.rstrip("/"), out_dir.rstrip("/")
    model_path = model_path or f"{out}/state/model"
    reader = spark.readStream.schema("snapshot_ts bigint")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        times = sorted({int(r["snapshot_ts"]) for r in batch.distinct().collect()})  # one number for each snapshot of the batch
        first, done = batch_id * STEPS, f"{out}/done"
        prune(session, out, first)
        for i, a in enumerate(range(0, len(times), STEP)):
            part, version = times[a : a + STEP], first + i
            new = sorted(set(part) - _already_done(session, done, part, version))
            if new:
                here = F.col("snapshot_ts").isin(*new)  # at most STEP values: they prune the folders
                read = lambda name: session.read.parquet(f"{root}/{name}").filter(here).withColumn("snapshot_ts", F.col("snapshot_ts").cast("bigint"))  # noqa: E731, B023
                process_snapshots(
                    session, read("nodes") if with_nodes else None, read("edges"), out, version, mode, model_path, k, head, errors_path,
                    buffer, drift_threshold, export_every,
                )
                _mark_done(session, done, new, version)

    return (
        reader.parquet(f"{root}/finished").writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(**trigger).start()
    )
