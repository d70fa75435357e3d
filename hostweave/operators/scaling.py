"""Scalers with population statistics, their state table, and the refit rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hostweave.session import cut

METHODS = ("none", "standard", "minmax")


def fit_scaler(df: DataFrame, cols: list[str], method: str) -> DataFrame:
    """One row: ``center`` and ``factor`` arrays in column order, and whether any column varies.

    ``standard`` divides by the population standard deviation, ``minmax`` by the range; a constant
    column is divided by 1, so it becomes 0. The state is one row by construction.
    """
    if method not in ("standard", "minmax"):
        raise ValueError(f"invalid scaling method: {method}. Choose 'none', 'standard', or 'minmax'")
    d = [F.col(c).cast("double") for c in cols]
    low = F.array(*[F.min(c) for c in d]).alias("_low")
    high = F.array(*[F.max(c) for c in d]).alias("_high")
    if method == "standard":
        stats = df.agg(F.array(*[F.avg(c) for c in d]).alias("center"), F.array(*[F.stddev_pop(c) for c in d]).alias("factor"), low, high)
    else:
        stats = df.agg(low, high).select("*", F.col("_low").alias("center"), F.zip_with("_high", "_low", lambda a, b: a - b).alias("factor"))
    # A constant column is recognised by its extremes: a computed deviation may keep a rounding rest.
    varies = F.zip_with("_high", "_low", lambda a, b: a > b)
    return stats.select(
        F.lit(method).alias("method"), "center",
        F.zip_with("factor", varies, lambda f, v: F.when(v & (f > 0), f).otherwise(1.0)).alias("factor"),
        F.exists(varies, lambda v: F.coalesce(v, F.lit(False))).alias("any_varying"),
    )


def apply_scaler(df: DataFrame, cols: list[str], state: DataFrame, on_constant: str = "keep") -> DataFrame:
    """Scale columns with a fitted state. When no column varied at the fit, ``keep`` leaves them as
    they are (hosts) and ``drop`` empties them (edges)."""
    one = state.select(F.struct("center", "factor", "any_varying").alias("_s"))
    joined = df.crossJoin(F.broadcast(one))  # the state is one row

    def value(i: int, c: str):
        scaled = (F.col(c).cast("double") - F.col("_s.center")[i]) / F.col("_s.factor")[i]
        fallback = F.col(c).cast("double") if on_constant == "keep" else F.lit(None).cast("double")
        return F.when(F.col("_s.any_varying"), scaled).otherwise(fallback).alias(c)

    position = {c: i for i, c in enumerate(cols)}
    return joined.select(*[value(position[c], c) if c in position else F.col(c) for c in df.columns])


def scale(
    df: DataFrame, cols: list[str], method: str, state: DataFrame | None = None, on_constant: str = "keep",
) -> tuple[DataFrame, DataFrame | None]:
    """Fit (unless a state is given) and scale; returns the frame and the state."""
    if method not in METHODS:
        raise ValueError(f"invalid scaling method: {method}. Choose 'none', 'standard', or 'minmax'")
    if method == "none":
        return df, None
    state = fit_scaler(df, cols, method) if state is None else state
    return apply_scaler(df, cols, state, on_constant), state


def _exits(width: int):
    """Adds to the ordered times of a range, where a chain of fits can enter it, the time from which it goes on beyond."""
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.concatenate([np.empty(0, np.int64), *[b.column(0).to_numpy() for b in batches]])
        if not len(t):
            return
        hop = np.searchsorted(t, t + width)
        hop = np.where(hop < len(t), hop, np.arange(len(t)))
        while not np.array_equal(further := hop[hop], hop):
            hop = further
        entries = int(np.searchsorted(t, t[0] + width)) + 1  # a fit before the range is over by then
        part, many = TaskContext.get().partitionId(), 100_000
        for i in range(0, len(t), many):
            n = len(t[i:i + many])
            onward = pa.array(t[hop[i:i + many]] + width, mask=np.arange(i, i + n) >= entries)
            yield pa.RecordBatch.from_arrays([pa.array(t[i:i + many]), pa.array(np.full(n, part, np.int32)), onward], ["t", "part", "onward"])

    return follow


def _fitted(width: int):
    """The scaler of each time of a range, from its entry and the last fit before it."""
    def fit(rows: pa.Table) -> pa.Table:
        t = np.sort(rows["t"].to_numpy())
        entry, last = rows["entry"][0].as_py(), rows["last"][0].as_py()
        hop = np.searchsorted(t, t + width).tolist()
        fits, i = [], len(t) if entry is None else int(np.searchsorted(t, entry))
        while i < len(t):
            fits.append(i)
            i = hop[i]
        used = np.append(t[np.array(fits, int)], 0 if last is None else last)  # at -1: the last before
        used = used[np.searchsorted(fits, np.arange(len(t)), "right") - 1]
        return pa.table({"t": t, "fit": used})

    return fit


def scale_policy(snapshots: DataFrame, max_age: int = 3600, fit_always: bool = False, ts: str = "snapshot_ts") -> DataFrame:
    """For each snapshot the time of the scaler to use: ``fit_ts`` and whether it is fitted here.

    A scaler is fitted at the first snapshot, and again at the first one more than ``max_age``
    seconds after the last fit (times are whole seconds). Sampled splitters deal the times into
    ranges. A chain of fits enters a range less than ``max_age`` + 1 seconds after its first time, or
    at the next time behind these; each range follows all its entries on its own. The entries that
    the fits really take are followed from the first one by doubling, and each range then finds its
    fits from its entry.
    """
    times = snapshots.select(F.col(ts).cast("bigint").alias("t")).distinct()
    if fit_always:
        return times.select(F.col("t").alias(ts), F.col("t").alias("fit_ts"), F.lit(True).alias("refit"))
    width = max_age + 1
    ranged = times.filter("t is not null").repartitionByRange("t").sortWithinPartitions("t")
    ranged = cut(ranged.mapInArrow(_exits(width), "t bigint, part int, onward bigint"), "times")
    entries = ranged.filter("onward is not null")
    # from each entry to the entry it leads to: in the first range that ends at or after the time to go on from
    ends = ranged.groupBy("part").agg(F.max("t").alias("end"))
    along = Window.orderBy("part")  # one row per range
    ends = F.broadcast(cut(ends.select(F.col("part").alias("to"), "end", F.lag("end").over(along).alias("begin")), "ends"))
    asked = entries.join(ends, (F.col("onward") > F.col("begin")) & (F.col("onward") <= F.col("end")))
    asked = asked.select(F.col("to").alias("part"), F.col("onward").alias("at"), F.col("t").alias("asker"), F.lit(None).cast("bigint").alias("t"))
    given = entries.select("part", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("asker"), "t")
    here = Window.partitionBy("part").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = given.unionByName(asked).withColumn("next", F.min("t").over(here)).filter("asker is not null")
    jumps = cut(found.select(F.col("asker").alias("t"), "next"), "fit-jumps")
    fits = cut(entries.agg(F.min("t").alias("t")).filter("t is not null"), "fits")
    known = fits.count()
    while known:
        fits = cut(fits.unionByName(fits.join(jumps, "t").select(F.col("next").alias("t"))).distinct(), "fits")
        before, known = known, fits.count()
        if known == before:
            break
        onward = jumps.select(F.col("t").alias("next"), F.col("next").alias("then"))
        jumps = cut(jumps.join(onward, "next").select("t", F.col("then").alias("next")), "fit-jumps")
    taken = entries.join(fits, "t").select(F.col("part").alias("to"), F.col("t").alias("entry"), (F.col("onward") - width).alias("left"))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    spans = ends.select(F.col("to").alias("part")).join(taken.withColumnRenamed("to", "part"), "part", "left")
    spans = spans.select("part", "entry", F.max("left").over(earlier).alias("last"))
    out = ranged.select("t", "part").join(F.broadcast(spans), "part").groupBy("part").applyInArrow(_fitted(width), "t bigint, fit bigint")
    return out.select(F.col("t").alias(ts), F.col("fit").alias("fit_ts"), (F.col("t") == F.col("fit")).alias("refit"))
