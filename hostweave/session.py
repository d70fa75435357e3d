"""Session helpers: runtime settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. All are runtime SQL settings, so an existing session can
# take them; cluster-wide settings (memory, executors, shuffle service) stay with the operator.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split the rows of a hot key in a join even where a later step then needs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the JVM does not compile longer methods; such a stage runs faster when it is not fused
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # merge the sessions of a hot uid before the shuffle, not only after it
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # keep the hash path for grouped vector summaries (default gives up at 128 groups per task)
    "spark.sql.execution.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}

def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder of the cluster for work tables and stream state, from ``spark.checkpoint.dir``.

    A local session (``local[...]``) that names none gets a temporary folder, since driver and
    executors are one process there. On a cluster a folder that only one machine sees would lose
    rows, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="hostweave-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below the shared work folder."""
    return f"{checkpoint_root(spark)}/hostweave/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared work folder and read it back: later steps start from it, and a
    lost executor costs a re-read, not a re-computation. For tables with several readers."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, path: str, key: str = "version") -> list[int]:
    """Numbers of the folders ``<key>=<number>`` in a folder, ascending; their files are not looked at."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(folder):
        return []
    names = [f.getPath().getName() for f in store.listStatus(folder)]
    return sorted(int(n.split("=", 1)[1]) for n in names if re.fullmatch(rf"{key}=\d+", n))


def is_folder(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).isDirectory(folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
