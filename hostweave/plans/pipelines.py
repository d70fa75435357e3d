"""The two batch chains: logs to snapshots, and snapshots to anomaly reports."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from hostweave import schemas as S
from hostweave.operators.connections import connections_from_logs
from hostweave.operators.detect import (
    Reconstruction, detect_anomalies, project_pca, reconstruct_fit, reconstruct_score, report_rows,
)
from hostweave.operators.edges import edge_aggregate
from hostweave.operators.features import node_features_19, node_one_hot
from hostweave.operators.hosts import node_rollup_conn
from hostweave.operators.scale_out import dense_index
from hostweave.operators.stats import reconstruction_by_feature, stats_update
from hostweave.operators.topology import node_rollup
from hostweave.session import cut, prepare_session
from hostweave.sources import logs
from hostweave.sources.snapshots import encoded_node_columns, latest_snapshot, write_partitions, write_snapshot

SNAPSHOT = ("snapshot_ts",)


def with_snapshot(connections: DataFrame, seconds: int = 60) -> DataFrame:
    """Add the start of the time window each connection falls into."""
    return connections.withColumn("snapshot_ts", (F.floor(F.col("timestamp") / seconds) * seconds).cast("bigint"))


def snapshot_tables(connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connections with ``snapshot_ts`` to the host and edge tables of all their snapshots."""
    edges = edge_aggregate(connections, SNAPSHOT)
    rollup = node_rollup_conn(connections, SNAPSHOT)
    nodes = encoded_node_columns(node_one_hot(rollup, SNAPSHOT), SNAPSHOT)
    return nodes, edges


def logs_to_snapshots(spark: SparkSession, in_dir: str, out_dir: str, seconds: int = 60) -> None:
    """Read the three logs, merge them, and write one graph per time window.

    A window of this run replaces the same window of an earlier one; all other snapshots stay.
    """
    prepare_session(spark)
    raw = {k: logs.scan_logs(spark, in_dir, k) for k in S.LOG_FIELDS}
    # merged once: the landed table, hosts and edges all start from this run's written rows
    rows = cut(with_snapshot(connections_from_logs(**raw), seconds), "connections")
    write_partitions(rows, f"{out_dir.rstrip('/')}/connections")
    nodes, edges = snapshot_tables(rows)
    write_snapshot(nodes, edges, out_dir, "overwrite")


def snapshot_cumulative(partials: DataFrame) -> DataFrame:
    """Windowed edges to all-history edges.

    A graph that is never cleared repeats every edge in every later snapshot. Here each edge has a
    row only where it changes, with the span of snapshots it holds for (``valid_to`` is the next
    change, open at the end); :func:`snapshot_at` gives the graph at a time.
    """
    keyed = Window.partitionBy(*S.EDGE_KEYS).orderBy("snapshot_ts")
    so_far = keyed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ["connection_count", *S.EDGE_SUMS]
    return partials.select(
        *S.EDGE_KEYS, "snapshot_ts", F.lead("snapshot_ts").over(keyed).alias("valid_to"),
        *[F.sum(c).over(so_far).alias(c) for c in sums],
        F.min("first_seen").over(so_far).alias("first_seen"), F.max("last_seen").over(so_far).alias("last_seen"),
    )


def snapshot_at(cumulative: DataFrame, ts: int) -> DataFrame:
    """The all-history graph as of a snapshot time."""
    open_end = F.col("valid_to").isNull() | (F.col("valid_to") > ts)
    return cumulative.filter((F.col("snapshot_ts") <= ts) & open_end).drop("valid_to")


def host_features(nodes: DataFrame | None, edges: DataFrame, by: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    """Snapshot tables to the 19 host features."""
    return node_features_19(node_rollup(edges, by, nodes=nodes), by)


# --- model -----------------------------------------------------------------------------------


def fit_model(features: DataFrame, k: int = 8) -> tuple[Reconstruction, DataFrame]:
    """Model of normal hosts, and the statistics of its errors on the same rows."""
    model = reconstruct_fit(features, S.NODE_FEATURES, k)
    errors = stats_update(reconstruct_score(features, model), ["recon_error"])
    return model, errors


def save_model(spark: SparkSession, model: Reconstruction, path: str) -> None:
    """Store the model's numbers as one JSON row."""
    text = json.dumps({k: getattr(model, k) for k in ("cols", "mean", "std", "components", "explained")})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Reconstruction:
    """Read a stored model; a missing one is an error, never an untrained model."""
    rows = spark.read.text(path).head(1)
    if not rows:
        raise FileNotFoundError(f"no model at {path}")
    d = json.loads(rows[0][0])
    return Reconstruction(
        tuple(d["cols"]), tuple(d["mean"]), tuple(d["std"]), tuple(tuple(r) for r in d["components"]), tuple(d["explained"])
    )


# --- snapshots to reports ----------------------------------------------------------------------


def score_by_snapshot(features: DataFrame, models: dict[int, Reconstruction]) -> DataFrame:
    """Score each row by the model of its own snapshot; the models of a batch travel with the function."""
    packed = {t: (np.array(m.mean), np.array(m.std), np.array(m.components).reshape(len(m.components), len(m.mean))) for t, m in models.items()}

    @pandas_udf("embedding array<double>, recon_error double")
    def score(times: pd.Series, rows: pd.Series) -> pd.DataFrame:
        values, error, embedding = np.array(rows.tolist(), dtype=float), np.zeros(len(rows)), [None] * len(rows)
        for t in times.unique():
            at = np.flatnonzero(times.to_numpy() == t)
            mean, std, components = packed[int(t)]
            x = (values[at] - mean) / (std + 1e-6)
            e = x @ components.T
            error[at] = ((x - e @ components) ** 2).mean(axis=1)
            for i, v in zip(at.tolist(), e):
                embedding[i] = v
        return pd.DataFrame({"embedding": embedding, "recon_error": error})

    raw = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in S.NODE_FEATURES])
    return features.withColumn("_s", score("snapshot_ts", raw)).select(*features.columns, "_s.embedding", "_s.recon_error")


def score_snapshots(nodes: DataFrame | None, edges: DataFrame, model: Reconstruction, head=None) -> DataFrame:
    """Every host of every snapshot with reconstruction error and score. ``head`` maps the scored
    frame to one with ``mlp_score`` (see ``detect.dense_score``); without one the score is null and
    only the reconstruction can flag."""
    scored = reconstruct_score(host_features(nodes, edges), model)
    return head(scored) if head else scored.withColumn("mlp_score", F.lit(None).cast("double"))


def reports(scored: DataFrame, errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored hosts to (flagged hosts with their position, report rows)."""
    index = dense_index(scored.select(*SNAPSHOT, "node"), "node", list(SNAPSHOT))
    flagged = detect_anomalies(scored, errors).join(index, ["snapshot_ts", "node"]).withColumnRenamed("idx", "node_id")
    counts = scored.groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("nodes_in_graph"))
    return flagged, report_rows(flagged, counts)


def evaluate_latest(nodes: DataFrame | None, edges: DataFrame, model: Reconstruction, errors: DataFrame | None = None, head=None) -> dict[str, DataFrame]:
    """Newest snapshot: flagged hosts, mean error of each feature, and a 3-D projection of the
    embeddings."""
    n, e = None if nodes is None else latest_snapshot(nodes), latest_snapshot(edges)
    scored = score_snapshots(n, e, model, head)
    k = len(model.components)
    wide = scored.select("snapshot_ts", "node", *[F.col("embedding")[i].alias(f"e{i}") for i in range(k)])
    projected, _ = project_pca(wide, [f"e{i}" for i in range(k)], min(3, k))
    return {
        "anomalies": detect_anomalies(scored, errors),
        "feature_errors": reconstruction_by_feature(scored, list(model.cols)),
        "projection": projected,
    }
