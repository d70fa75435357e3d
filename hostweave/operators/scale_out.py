"""Building blocks that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.session import cut as write_table


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join rows to a table that has one row for each key.

    An equi join without copies: adaptive execution measures both sides, broadcasts a small one, and
    cuts the rows of a hot key into as many tasks as their size needs (``prepare_session`` turns that
    on, also where a later step groups by the same key).
    """
    return rows.join(lookup, on, how)


def prefix_sums(
    df: DataFrame, keys: list[str], order: list[str], measures: list[str], chunk: Column,
) -> DataFrame:
    """Running sums per key, inclusive of all rows with an equal order value.

    ``chunk`` must not decrease along ``order``. The running sum is taken inside each (key, chunk),
    and the totals of the earlier chunks are added, so a key's rows never meet in one task; only
    its chunk totals do. Result: the rows with ``<measure>_run`` columns.
    """
    cut = df.withColumn("_chunk", chunk)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = cut.select("*", *[F.sum(m).over(within).alias(f"_in_{m}") for m in measures])
    totals = cut.groupBy(*keys, "_chunk").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_c_{m}") for m in measures]
    )
    out = inside.join(carry, [*keys, "_chunk"])
    return out.select(
        *df.columns, *[(F.col(f"_in_{m}") + F.col(f"_c_{m}")).alias(f"{m}_run") for m in measures]
    )


def range_scan(df: DataFrame, keys: list[str], order: list[str], measures: list[str], name: str = "range-scan") -> DataFrame:
    """Running sums per key along ``order`` however many rows a key has: ``<measure>_run`` columns.

    Splitters sampled over (keys, order) deal the rows into ranges, so the rows of one key spread over
    as many tasks as they need; sums run inside each range, and the totals of a key's earlier ranges
    are added. Ranges are written once, since a second sample could draw other splitters. Rows with
    equal order values share their sum, so rows that must differ need a last order column of their
    own. Keys must not be null; without keys the whole table is one.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    return prefix_sums(write_table(ranged, name), keys, order, measures, F.col("_range")).drop("_range")


def dense_index(df: DataFrame, column: str, by: list[str], name: str = "idx", digits: int = 3) -> DataFrame:
    """0-based dense position of each row within ``by``; ``column`` must be unique there.

    The order is that of ``md5(column)``, ties by value. Its leading hex digits cut each group into
    ``16**digits`` even slices, so a group is numbered by many tasks and only the slice sizes are
    summed up in one. The order depends on the values alone, so a re-run task numbers the same.
    """
    hashed = df.withColumn("_h", F.md5(F.col(column).cast("string"))).withColumn("_b", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", column)
    numbered = hashed.withColumn("_r", F.row_number().over(inside))
    return numbered.join(starts, [*by, "_b"]).select(
        *df.columns, (F.col("_start") + F.col("_r") - 1).cast("bigint").alias(name)
    )


def exact_percentiles(
    df: DataFrame, value: str, probs: list[float], by: list[str], accuracy: int = 10000,
) -> DataFrame:
    """Exact percentiles with linear interpolation: by..., n, and ``p`` as array in ``probs`` order.

    The built-in exact percentile keeps every distinct value of a group in one task. Here a bounded
    sketch first gives a bracket that must hold the wanted rank; rows below the bracket are only
    counted, and only the values inside it (about ``4n/accuracy`` of them) are ordered.
    """
    # The sketch promises a rank error of n/accuracy; three times that is left on either side.
    slack = 3.0 / accuracy
    low = [max(0.0, p - slack) for p in probs]
    high = [min(1.0, p + slack) for p in probs]
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", low + high, accuracy).alias("_q"),
    )
    k = len(probs)
    # At the ends the bracket is opened to the true extremes.
    sketch = sketch.select(*by, "n", F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
            (F.col("_min") if low[i] <= 0 else F.col("_q")[i]).alias("lo"),
            (F.col("_max") if high[i] >= 1 else F.col("_q")[k + i]).alias("hi"),
        ) for i, p in enumerate(probs)
    ]).alias("_brackets"))
    if by:
        # one value column beside the keys, so the salt comes from the values
        joined = lookup_join(rows, sketch, by)
    else:
        joined = rows.crossJoin(F.broadcast(sketch))  # one row: a global aggregate
    keys = [*by, "n", "i", "p"]
    pieces = joined.select(*by, "n", "_v", F.explode_outer("_brackets").alias("_b"))
    pieces = pieces.select(*by, "n", F.col("_b.i").alias("i"), F.col("_b.p").alias("p"), F.col("_b.lo").alias("lo"), F.col("_b.hi").alias("hi"), "_v")
    # outside the bracket rows are only counted; the nearest value on either side is known as well
    sides = pieces.groupBy(*keys).agg(
        F.count_if(F.col("_v") < F.col("lo")).alias("_under"), F.count_if(F.col("_v").between(F.col("lo"), F.col("hi"))).alias("_within"),
        F.max(F.when(F.col("_v") < F.col("lo"), F.col("_v"))).alias("_below"), F.min(F.when(F.col("_v") > F.col("hi"), F.col("_v"))).alias("_above"),
    )
    counted = pieces.filter(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_upto", F.sum("_c").over(run)).join(sides, keys)
    ranked = ranked.withColumn("_h", (F.col("n") - 1) * F.col("p")).withColumn("_upto", F.col("_upto") + F.col("_under"))
    covers = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r)
    picked = ranked.groupBy(*keys, "_under", "_within", "_below", "_above").agg(
        F.max("_h").alias("_h"),
        F.max(F.when(covers(F.floor("_h")), F.col("_v"))).alias("_lo"),
        F.max(F.when(covers(F.ceil("_h")), F.col("_v"))).alias("_hi"),
    )
    # a rank next to the bracket has the nearest value; anything else is an error, not a missing number
    missed = F.raise_error(F.lit("exact_percentiles: the bracket does not cover the rank")).cast("double")
    beside = lambda r: F.when(r == F.col("_under") - 1, F.col("_below")).when(r == F.col("_under") + F.col("_within"), F.col("_above"))
    picked = picked.withColumn("_lo", F.coalesce("_lo", beside(F.floor("_h")), missed)).withColumn("_hi", F.coalesce("_hi", beside(F.ceil("_h")), missed))
    frac = F.col("_h") - F.floor("_h")
    each = picked.select(*by, "n", "i", (F.col("_lo") + frac * (F.col("_hi") - F.col("_lo"))).alias("_p"))
    wide = each.groupBy(*by, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("_p"))).alias(f"_p{i}") for i in range(k)])
    return wide.select(*by, "n", F.array(*[f"_p{i}" for i in range(k)]).alias("p"))
