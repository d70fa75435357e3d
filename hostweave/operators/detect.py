"""Scores, thresholds, detections and reports for hosts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from hostweave.functions import log_cosh
from hostweave.operators.scale_out import exact_percentiles, lookup_join
from hostweave.operators.stats import STD_FLOOR

ERROR_FACTOR = 2.0
SCORE_MIN = 0.8


# --- reconstruction --------------------------------------------------------------------------


@dataclass(frozen=True)
class Reconstruction:
    """A linear autoencoder: mean, deviation and components, features x k numbers in all."""

    cols: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]  # k rows, one value for each feature
    explained: tuple[float, ...]


def reconstruct_fit(df: DataFrame, cols: list[str], k: int) -> Reconstruction:
    """Learn the structure of normal rows: principal components of z-scored features.

    Moments and components come from tree aggregations; the driver gets the small matrices only.
    """
    d = [F.col(c).cast("double") for c in cols]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(d)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(d)]).head()
    n = len(cols)
    mean = [float(v or 0.0) for v in row[:n]]
    std = [max(float(v or 0.0), STD_FLOOR) for v in row[n:]]
    z = F.array(*[(c - m) / (s + 1e-6) for c, m, s in zip(d, mean, std)])
    model = PCA(k=k, inputCol="z", outputCol="p").fit(df.select(array_to_vector(z).alias("z")))
    return Reconstruction(
        tuple(cols), tuple(mean), tuple(std),
        tuple(tuple(float(v) for v in col) for col in model.pc.toArray().T),
        tuple(float(v) for v in model.explainedVariance.toArray()),
    )


def _dot(values: list[Column], weights) -> Column:
    terms = [v * float(w) for v, w in zip(values, weights)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def reconstruct_score(df: DataFrame, model: Reconstruction) -> DataFrame:
    """Add ``x`` (z-scored once), ``embedding``, ``recon`` and ``recon_error``, the mean squared
    difference. Rows pass through two small matrix products in Arrow batches; as column arithmetic
    the products would be features x components terms long for each output."""
    mean, std = np.array(model.mean), np.array(model.std)
    components = np.array(model.components)

    @pandas_udf("x array<double>, embedding array<double>, recon array<double>, recon_error double")
    def score(rows: pd.Series) -> pd.DataFrame:
        x = (np.array(rows.tolist(), dtype=float).reshape(len(rows), -1) - mean) / (std + 1e-6)
        embedding = x @ components.T
        recon = embedding @ components
        return pd.DataFrame({
            "x": list(x), "embedding": list(embedding), "recon": list(recon), "recon_error": ((x - recon) ** 2).mean(axis=1),
        })

    raw = F.array(*[F.col(c).cast("double") for c in model.cols])
    return df.withColumn("_s", score(raw)).select(*df.columns, "_s.x", "_s.embedding", "_s.recon", "_s.recon_error")


def project_pca(df: DataFrame, cols: list[str], k: int = 3) -> tuple[DataFrame, tuple[float, ...]]:
    """Leading components of scaled features as columns ``pc1``.., and their explained variance."""
    model = reconstruct_fit(df, cols, k)
    z = [(F.col(c).cast("double") - m) / (s + 1e-6) for c, m, s in zip(model.cols, model.mean, model.std)]
    out = df.withColumn("_z", F.array(*z))
    parts = [_dot([F.col("_z")[i] for i in range(len(cols))], w).alias(f"pc{j + 1}") for j, w in enumerate(model.components)]
    return out.select(*df.columns, *parts), model.explained


def array_columns(df: DataFrame, column: str, size: int, prefix: str = "f") -> tuple[DataFrame, list[str]]:
    """An array column as ``size`` scalar columns."""
    names = [f"{prefix}{i}" for i in range(size)]
    return df.select("*", *[F.col(column)[i].cast("double").alias(n) for i, n in enumerate(names)]), names


# --- supplied scoring head -------------------------------------------------------------------


def dense_score(df: DataFrame, column: str, layers: list[tuple[np.ndarray, np.ndarray]], name: str = "mlp_score") -> DataFrame:
    """Score vectors with a given dense head: linear layers with ReLU between, sigmoid at the end.

    ``layers`` holds (weight of out x in, bias). Rows pass in Arrow batches; the weights travel with
    the function, and their size is fixed by the model.
    """
    weights = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in layers]

    @pandas_udf("double")
    def head(vectors: pd.Series) -> pd.Series:
        h = np.array(vectors.tolist(), dtype=float).reshape(len(vectors), -1)
        for i, (w, b) in enumerate(weights):
            h = h @ w.T + b
            if i < len(weights) - 1:
                h = np.maximum(h, 0.0)
        return pd.Series(1.0 / (1.0 + np.exp(-h[:, 0])))

    return df.withColumn(name, head(F.col(column)))


# --- losses ----------------------------------------------------------------------------------


def reconstruction_losses(diff) -> list[Column]:
    """mse, l1, huber (delta 1) and log-cosh as aggregates over a difference column."""
    d = F.col(diff) if isinstance(diff, str) else diff
    a = F.abs(d)
    huber = F.when(a <= 1.0, d * d * 0.5).otherwise(a - 0.5)
    return [
        F.avg(d * d).alias("mse"), F.avg(a).alias("l1"), F.avg(huber).alias("huber"), F.avg(log_cosh(d)).alias("log_cosh"),
    ]


def focal_penalty(score, focal: bool = True, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Mean focal penalty of 0..1 scores, or mean absolute raw score with ``focal=False``."""
    s = F.col(score) if isinstance(score, str) else score
    if not focal:
        return F.avg(F.abs(s))
    return F.avg(-F.lit(alpha) * F.pow(s, F.lit(gamma)) * F.log(F.lit(1.0) - s + F.lit(1e-8)))


def total_loss(recon: Column, penalty: Column, recon_weight: float = 1.0, anomaly_weight: float = 0.1) -> Column:
    return F.lit(recon_weight) * recon + F.lit(anomaly_weight) * penalty


# --- thresholds ------------------------------------------------------------------------------


def threshold_reconstruction(
    scored: DataFrame, reference: DataFrame | None = None, factor: float = ERROR_FACTOR,
    by: tuple[str, ...] = ("snapshot_ts",), percentile: float = 0.95,
) -> DataFrame:
    """Add ``recon_flag`` and the ``recon_threshold`` it comes from.

    ``reference`` is one row of error statistics (n, mean, m2). With at least two reference values
    the threshold is mean + factor x std; otherwise it is the percentile of the row's own snapshot.
    """
    if reference is None:
        limits = exact_percentiles(scored, "recon_error", [percentile], list(by)).select(*by, F.col("p")[0].alias("recon_threshold"))
        if by:
            joined = lookup_join(scored, limits, list(by), "left")
        else:
            joined = scored.crossJoin(F.broadcast(limits))
        return joined.withColumn("recon_flag", F.coalesce(F.col("recon_error") > F.col("recon_threshold"), F.lit(False)))
    one = reference.agg(F.sum("n").alias("_n"), F.max("mean").alias("_mean"), F.max("m2").alias("_m2")).head()
    if not one["_n"] or one["_n"] < 2:
        return threshold_reconstruction(scored, None, factor, by, percentile)
    limit = one["_mean"] + factor * max((one["_m2"] / one["_n"]) ** 0.5, STD_FLOOR)
    return scored.withColumn("recon_threshold", F.lit(limit)).withColumn("recon_flag", F.col("recon_error") > limit)


def threshold_score(scored: DataFrame, minimum: float = SCORE_MIN, column: str = "mlp_score") -> DataFrame:
    return scored.withColumn("mlp_flag", F.coalesce(F.col(column) > minimum, F.lit(False)))


def merge_detections(flagged: DataFrame) -> DataFrame:
    """Rows with any flag, and which detector raised it: reconstruction, mlp or both."""
    both = F.col("recon_flag") & F.col("mlp_flag")
    by = F.when(both, "both").when(F.col("recon_flag"), "reconstruction").when(F.col("mlp_flag"), "mlp")
    return flagged.withColumn("detected_by", by).filter(F.col("detected_by").isNotNull())


def merge_separate_detections(recon: DataFrame, mlp: DataFrame, keys: list[str]) -> DataFrame:
    """The same from two detectors that ran apart, each with its own flagged rows."""
    a = recon.select(*keys, F.lit(True).alias("_r"))
    b = mlp.select(*keys, F.lit(True).alias("_m"))
    both = F.col("_r").isNotNull() & F.col("_m").isNotNull()
    by = F.when(both, "both").when(F.col("_r").isNotNull(), "reconstruction").otherwise("mlp")
    return a.join(b, keys, "full_outer").select(*keys, by.alias("detected_by"))


def detect_anomalies(
    scored: DataFrame, reference: DataFrame | None = None, factor: float = ERROR_FACTOR,
    score_min: float = SCORE_MIN, by: tuple[str, ...] = ("snapshot_ts",),
) -> DataFrame:
    """Flagged hosts of each snapshot with both scores and the detector."""
    return merge_detections(threshold_score(threshold_reconstruction(scored, reference, factor, by), score_min))


def anomaly_preview(flagged: DataFrame, k: int = 5, snapshot: str = "snapshot_ts", order: str = "node") -> DataFrame:
    """First k flagged hosts of each snapshot for each detector, in host order."""
    detectors = F.array_compact(F.array(
        F.when(F.col("recon_flag"), F.lit("reconstruction")), F.when(F.col("mlp_flag"), F.lit("mlp"))
    ))
    rows = flagged.withColumn("detector", F.explode(detectors))
    rank = F.row_number().over(Window.partitionBy(snapshot, "detector").orderBy(order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


# --- reports ---------------------------------------------------------------------------------


REPORT_ROW = (
    "snapshot_ts bigint, kind string, timestamp string, update_count bigint, nodes_in_graph bigint, "
    "node_id bigint, ip string, detected_by string, recon_error double, mlp_score double"
)


def report_rows(detections: DataFrame, snapshots: DataFrame, snapshot: str = "snapshot_ts") -> DataFrame:
    """A report of any size in one shape: a row of kind ``snapshot`` for each snapshot (time, running
    number, hosts in the graph), also for one without findings, and a row of kind ``finding`` for each
    flagged host.

    ``snapshots`` has one row per snapshot: snapshot, nodes_in_graph and update_count; without the
    last the snapshots are numbered by time. ``detections`` needs node_id, node, detected_by,
    recon_error and mlp_score.
    """
    if "update_count" not in snapshots.columns:
        # over one row per snapshot
        snapshots = snapshots.withColumn("update_count", F.row_number().over(Window.orderBy(snapshot)))
    none = lambda t: F.lit(None).cast(t)
    heads = snapshots.select(
        F.col(snapshot).cast("bigint").alias("snapshot_ts"), F.lit("snapshot").alias("kind"),
        F.date_format(F.timestamp_seconds(snapshot), "yyyyMMdd_HHmmss").alias("timestamp"), F.col("update_count").cast("bigint").alias("update_count"),
        F.col("nodes_in_graph").cast("bigint").alias("nodes_in_graph"), none("bigint").alias("node_id"), none("string").alias("ip"),
        none("string").alias("detected_by"), none("double").alias("recon_error"), none("double").alias("mlp_score"),
    )
    found = detections.select(
        F.col(snapshot).cast("bigint").alias("snapshot_ts"), F.lit("finding").alias("kind"), none("string").alias("timestamp"),
        none("bigint").alias("update_count"), none("bigint").alias("nodes_in_graph"), F.col("node_id").cast("bigint").alias("node_id"),
        F.col("node").alias("ip"), "detected_by", "recon_error", F.col("mlp_score").cast("double").alias("mlp_score"),
    )
    return heads.unionByName(found)


def write_report_rows(report: DataFrame, path: str, mode: str = "append") -> None:
    """Write report rows as JSON lines, one folder per snapshot."""
    report.write.mode(mode).partitionBy("snapshot_ts").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Written reports, one row per finding with the facts of its snapshot, or one row of a snapshot
    without findings."""
    rows = spark.read.schema(REPORT_ROW).json(path)
    heads = rows.filter("kind = 'snapshot'").select("snapshot_ts", "timestamp", "update_count", "nodes_in_graph")
    found = rows.filter("kind = 'finding'").select("snapshot_ts", "node_id", "ip", "detected_by", "recon_error", "mlp_score")
    return lookup_join(found, heads, ["snapshot_ts"], "right")


def export_embeddings(scored: DataFrame, path: str, keys: list[str], column: str = "embedding", mode: str = "append") -> None:
    """Write host embeddings as an array of floats with their keys."""
    scored.select(*keys, F.col(column).cast("array<float>").alias("embedding")).write.mode(mode).parquet(path)


def model_statistics(
    node_stats: DataFrame, edge_stats: DataFrame, error_stats: DataFrame, streak: DataFrame, snapshot: str = "snapshot_ts",
    buffer: int = 2000,
) -> DataFrame:
    """One summary row: updates, buffer size, open drift streak, and the three statistics tables."""

    def pack(stats: DataFrame, prefix: str) -> DataFrame:
        # one row per feature, so the packed arrays are as long as the feature list
        rows = stats.withColumn("std", F.greatest(F.sqrt(F.col("m2") / F.nullif(F.col("n"), F.lit(0))), F.lit(STD_FLOOR)))
        return rows.agg(
            F.max("n").alias(f"{prefix}_count"),
            F.sort_array(F.collect_list(F.struct("feature", "mean", "std"))).alias(f"{prefix}_features"),
        )

    last = streak.agg(
        F.count(F.lit(1)).alias("update_count"), F.least(F.count(F.lit(1)), F.lit(buffer)).alias("replay_buffer_size"),
        F.max_by("streak", snapshot).alias("consecutive_drifts"),
    )
    out = last
    for df, prefix in ((node_stats, "node_stats"), (edge_stats, "edge_stats"), (error_stats, "error_stats")):
        out = out.crossJoin(pack(df, prefix))  # one row each
    return out


