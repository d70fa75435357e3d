"""Feature drift between snapshots, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hostweave.functions import hash_fraction
from hostweave.operators.scale_out import range_scan
from hostweave.operators.stats import stats_history, with_std
from hostweave.session import cut as write_table

DRIFT_THRESHOLD = 0.15
STREAK = 3
BUFFER = 2000


def feature_drift(
    parts: DataFrame, threshold: float = DRIFT_THRESHOLD, reference: str = "prior", snapshot: str = "snapshot_ts",
) -> DataFrame:
    """Largest shift of a feature mean at each snapshot, in reference deviations, and whether it drifts.

    Input: one row of statistics per (snapshot, feature). ``prior`` compares with everything before
    the snapshot, ``inclusive`` with everything up to it. The first snapshot has no prior and does
    not drift.
    """
    if reference not in ("prior", "inclusive"):
        raise ValueError(f"unknown reference: {reference}")
    ref = with_std(stats_history(parts, snapshot, reference == "inclusive")).select(
        snapshot, "feature", F.col("mean").alias("_rm"), F.col("std").alias("_rs")
    )
    shift = F.abs(F.col("mean") - F.col("_rm")) / (F.col("_rs") + 1e-6)
    worst = F.max_by("feature", F.struct(F.coalesce(F.col("shift"), F.lit(-1.0)), F.col("feature")))
    per = parts.join(ref, [snapshot, "feature"]).withColumn("shift", shift)
    return per.groupBy(snapshot).agg(
        F.coalesce(F.max("shift"), F.lit(0.0)).alias("max_shift"), worst.alias("feature")
    ).withColumn("drift", F.col("max_shift") > threshold)


def drift_streak(drift: DataFrame, length: int = STREAK, snapshot: str = "snapshot_ts") -> DataFrame:
    """Length of the run of drifting snapshots, restarting after ``length``, and where it triggers.

    Runs over one row per snapshot, in order; that order is the point, so it is one window.
    """
    order = Window.orderBy(snapshot)
    island = F.sum(F.when(F.col("drift"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = drift.withColumn("_island", island)
    nth = F.sum(F.when(F.col("drift"), 1).otherwise(0)).over(
        Window.partitionBy("_island").orderBy(snapshot).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_nth", nth)
    triggered = F.col("drift") & (F.col("_nth") % length == 0)
    streak = F.when(triggered | ~F.col("drift"), 0).otherwise(F.col("_nth") % length)
    return rows.select(*drift.columns, streak.cast("bigint").alias("streak"), triggered.alias("triggered"))


def buffer_snapshots(snapshots: DataFrame, size: int = BUFFER, snapshot: str = "snapshot_ts", cut: DataFrame | None = None) -> DataFrame:
    """Times of the newest ``size`` snapshots; ``cut`` (column ``keep_from``) drops the older ones."""
    times = snapshots.select(snapshot).distinct()
    if cut is not None:
        newest = cut.agg(F.max("keep_from").alias("_from"))  # one row
        times = times.crossJoin(F.broadcast(newest)).filter(
            F.col("_from").isNull() | (F.col(snapshot) >= F.col("_from"))
        ).drop("_from")
    return times.orderBy(F.desc(snapshot)).limit(size)


def replay_sample(
    snapshots: DataFrame, k: int = 16, size: int = BUFFER, seed: int = 0, snapshot: str = "snapshot_ts",
    cut: DataFrame | None = None,
) -> DataFrame:
    """``k`` random snapshots of the buffer without replacement; none if the buffer holds fewer.

    The draw is a hash of seed and time, so a re-run gives the same sample.
    """
    buffer = buffer_snapshots(snapshots, size, snapshot, cut)
    drawn = buffer.orderBy(hash_fraction(snapshot, seed=seed), snapshot).limit(k)
    enough = drawn.agg((F.count(F.lit(1)) >= k).alias("_ok"))  # one row
    return drawn.crossJoin(F.broadcast(enough)).filter("_ok").drop("_ok")


def edge_dropout(edges: DataFrame, keys: list[str], rate: float = 0.1, seed: int = 0) -> DataFrame:
    """Each edge is dropped with the given probability, by a hash of its key."""
    return edges.filter(hash_fraction(*keys, seed=seed) > rate)


def adapt_window(snapshots: DataFrame, streak: DataFrame, size: int = BUFFER, snapshot: str = "snapshot_ts", chunk: int = 1000) -> DataFrame:
    """Cuts after persistent drift: at each trigger the newest half of the buffer is kept.

    Result: trigger time, number kept, and ``keep_from``, the oldest snapshot kept. The buffer length
    at a trigger depends on all earlier cuts. What a row of triggers does to the length is a function
    of the length before it, a list of at most ``size + 1`` numbers, and such functions compose: each
    chunk of triggers is composed on its own, the chunks are composed with those before them in a
    logarithmic number of joins, and each chunk then starts with the length it really meets.
    """
    hits = streak.filter("triggered").select(snapshot, F.lit(1).cast("bigint").alias("hit"))
    times = snapshots.select(F.col(snapshot).cast("bigint").alias(snapshot)).distinct().join(hits, snapshot, "left")
    times = times.select(F.col(snapshot).alias("ts"), F.lit(1).cast("bigint").alias("one"), F.coalesce("hit", F.lit(0).cast("bigint")).alias("hit"))
    numbered = write_table(range_scan(times, [], ["ts"], ["one", "hit"], "snapshots"), "numbered-snapshots")
    triggers = numbered.filter("hit = 1").select("ts", F.col("one_run").alias("i"), F.col("hit_run").alias("m"))
    before = triggers.select((F.col("m") + 1).alias("m"), F.col("i").alias("last"))
    gaps = triggers.join(before, "m", "left").withColumn("d", F.col("i") - F.coalesce("last", F.lit(0)))
    gaps = gaps.withColumn("chunk", F.floor((F.col("m") - 1) / chunk))
    chunks = write_table(gaps.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("m", "d", "i", "ts"))).alias("cuts")), "cuts")  # at most ``chunk`` of them
    left = lambda length, x: F.shiftright(F.least(length + x["d"], F.lit(size)), 1)
    lengths = F.sequence(F.lit(0).cast("bigint"), F.lit(size).cast("bigint"))
    maps = write_table(chunks.select("chunk", F.aggregate("cuts", lengths, lambda f, x: F.transform(f, lambda b: left(b, x))).alias("f")), "cut-maps")
    n, step = maps.count(), 1
    while step < n:
        earlier = maps.select((F.col("chunk") + step).alias("chunk"), F.col("f").alias("g"))
        joint = F.when(F.col("g").isNull(), F.col("f")).otherwise(F.transform("g", lambda b: F.get(F.col("f"), b.cast("int"))))
        maps, step = write_table(maps.join(earlier, "chunk", "left").select("chunk", joint.alias("f")), "cut-maps"), 2 * step
    met = maps.select((F.col("chunk") + 1).alias("chunk"), F.col("f")[0].alias("length"))
    none = F.array().cast("array<struct<ts: bigint, i: bigint, kept: bigint>>")
    start = F.struct(F.coalesce("length", F.lit(0).cast("bigint")).alias("length"), none.alias("out"))

    def walk(state, x):
        kept = left(state["length"], x)
        return F.struct(kept.alias("length"), F.concat(state["out"], F.array(F.struct(x["ts"].alias("ts"), x["i"].alias("i"), kept.alias("kept")))).alias("out"))

    found = chunks.join(met, "chunk", "left").select(F.explode(F.aggregate("cuts", start, walk)["out"]).alias("o"))
    found = found.select(F.col("o.ts").alias("trigger_ts"), "o.kept", F.when(F.col("o.kept") > 0, F.col("o.i") - F.col("o.kept") + 1).alias("one_run"))
    oldest = numbered.select("one_run", F.col("ts").alias("keep_from"))
    return found.join(oldest, "one_run", "left").select("trigger_ts", "kept", "keep_from")
