"""Running statistics as mergeable tables, and feature profiles.

Statistics are long: one row for each feature (and each snapshot, when asked) with ``n``, ``mean``
and ``m2``, the sum of squared differences from the mean.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostweave.functions import array_of
from hostweave.operators.scale_out import exact_percentiles

STD_FLOOR = 1e-6


def _melt(df: DataFrame, keys: list[str], structs: dict[str, Column]) -> DataFrame:
    """One row for each named struct."""
    rows = df.select(*keys, F.explode_outer(F.array(*[F.struct(F.lit(n).alias("feature"), s.alias("s")) for n, s in structs.items()])).alias("_x"))
    return rows.select(*keys, "_x.feature", "_x.s.*")


def stats_update(df: DataFrame, cols: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of a batch. The columns are summed side by side in one partial aggregation and
    turned into rows afterwards, so the data is not multiplied by the number of features."""
    d = lambda c: F.col(c).cast("double")
    wide = df.groupBy(*by).agg(*[
        F.struct(
            F.count(c).alias("n"), F.coalesce(F.avg(d(c)), F.lit(0.0)).alias("mean"),
            (F.coalesce(F.var_pop(d(c)), F.lit(0.0)) * F.count(c)).alias("m2"),
        ).alias(f"_{i}") for i, c in enumerate(cols)
    ])
    return _melt(wide, list(by), {c: F.col(f"_{i}") for i, c in enumerate(cols)})


def stats_merge(state: DataFrame, batch: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Merge two statistics tables with the pairwise update of mean and m2."""
    keys = [*by, "feature"]
    a, b = state.alias("a"), batch.alias("b")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    na, nb = zero("a.n"), zero("b.n")
    ma, mb = zero("a.mean"), zero("b.mean")
    n = na + nb
    delta = mb - ma
    safe = F.nullif(n, F.lit(0)).cast("double")
    return a.join(b, keys, "full_outer").select(
        *keys, n.cast("bigint").alias("n"),
        F.coalesce(ma + delta * nb / safe, F.lit(0.0)).alias("mean"),
        (zero("a.m2") + zero("b.m2") + F.coalesce(delta * delta * na * nb / safe, F.lit(0.0))).alias("m2"),
    )


def stats_combine(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Merge any number of statistics rows at once. The spread of the part means is taken around
    the joint mean, which does not lose digits."""
    keys = [*by, "feature"]
    mean = parts.groupBy(*keys).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("_mean")
    )
    gap = F.col("mean") - F.col("_mean")
    return parts.join(mean, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2")
    )


def with_std(stats: DataFrame) -> DataFrame:
    """Add the population standard deviation, at least 1e-6."""
    std = F.sqrt(F.col("m2") / F.nullif(F.col("n"), F.lit(0)))
    return stats.withColumn("std", F.when(F.col("n") > 0, F.greatest(std, F.lit(STD_FLOOR))))


def stats_history(parts: DataFrame, snapshot: str = "snapshot_ts", inclusive: bool = False) -> DataFrame:
    """Statistics of everything before each snapshot (or up to and including it).

    Input is one row per (snapshot, feature). The sums are taken around a value near the data (the
    first mean of the feature), so the squares stay small.
    """
    order = Window.partitionBy("feature").orderBy(snapshot)
    frame = order.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    origin = F.first("mean").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = parts.withColumn("_o", origin).withColumn("_d", F.col("mean") - F.col("_o"))
    n = F.col("n")
    sums = rows.select(
        snapshot, "feature", "_o",
        F.sum(n).over(frame).alias("_n"),
        F.sum(n * F.col("_d")).over(frame).alias("_s1"),
        F.sum(F.col("m2") + n * F.col("_d") * F.col("_d")).over(frame).alias("_s2"),
    )
    shift = F.col("_s1") / F.nullif(F.col("_n"), F.lit(0))
    return sums.select(
        snapshot, "feature", F.coalesce("_n", F.lit(0)).alias("n"), (F.col("_o") + shift).alias("mean"),
        F.greatest(F.col("_s2") - F.col("_n") * shift * shift, F.lit(0.0)).alias("m2"),
    )


def zscore_columns(df: DataFrame, cols: list[str], stats: DataFrame) -> DataFrame:
    """(x - mean)/(std + 1e-6) with running statistics; columns without statistics stay.

    The statistics are pivoted into one row, so the join side is one row whatever the data.
    """
    floor = with_std(stats)
    pick = lambda c, what: F.max(F.when(F.col("feature") == c, F.col(what)))
    one = floor.agg(*[pick(c, "mean").alias(f"_m{i}") for i, c in enumerate(cols)], *[pick(c, "std").alias(f"_s{i}") for i, c in enumerate(cols)])
    joined = df.crossJoin(F.broadcast(one))
    position = {c: i for i, c in enumerate(cols)}

    def value(c: str) -> Column:
        i = position[c]
        z = (F.col(c).cast("double") - F.col(f"_m{i}")) / (F.col(f"_s{i}") + F.lit(1e-6))
        return F.coalesce(z, F.col(c).cast("double")).alias(c)

    return joined.select(*[value(c) if c in position else F.col(c) for c in df.columns])


def save_stats(stats: DataFrame, path: str, version: int) -> None:
    """Write one version of a statistics table. A repeated write of a version replaces it."""
    stats.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a statistics table."""
    table = spark.read.parquet(path)
    newest = table.agg(F.max("version").alias("version"))
    return table.join(F.broadcast(newest), "version", "left_semi").drop("version")


# --- profiles --------------------------------------------------------------------------------


def unpivot_features(df: DataFrame, cols: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns to rows: keep..., feature, value."""
    doubles = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot(list(keep), cols, "feature", "value")


def feature_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values, mean, population deviation, extremes and share of zeros of each feature."""
    return unpivot_features(df, cols).groupBy("feature").agg(
        F.count_distinct("value").alias("unique_values"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg((F.col("value") == 0).cast("int")).alias("sparsity"),
    )


def constant_features(profile: DataFrame) -> DataFrame:
    return profile.filter(F.col("unique_values") == 1).select("feature")


def top_variable_features(profile: DataFrame, k: int = 12) -> DataFrame:
    """The k features with the largest deviation, ties by name."""
    return profile.select("feature", "std").orderBy(F.desc("std"), "feature").limit(k)


def profile_long(profile: DataFrame) -> DataFrame:
    """Profile columns to rows: feature, statistic, value. Sparsity is in percent."""
    wide = profile.select("feature", "mean", "std", "min", "max", (F.col("sparsity") * 100).alias("sparsity_pct"))
    return wide.unpivot(["feature"], ["mean", "std", "min", "max", "sparsity_pct"], "statistic", "value")


def feature_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of each pair of features: feature_a, feature_b, corr.

    The matrix comes from one tree aggregation over the rows; only features x features numbers
    reach the driver. Pairs with a constant feature have no correlation (null).
    """
    vectors = df.select(array_to_vector(array_of(cols)).alias("v"))
    # Centred first: the two-pass form keeps its digits for large means.
    matrix = Correlation.corr(vectors, "v").head()[0].toArray()
    spark = df.sparkSession
    rows = [
        (a, b, None if matrix[i, j] != matrix[i, j] else float(matrix[i, j]))
        for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j
    ]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def strongest_correlation(pairs: DataFrame) -> DataFrame:
    """The pair with the largest absolute correlation."""
    return pairs.filter("corr is not null").orderBy(F.desc(F.abs("corr")), "feature_a", "feature_b").limit(1)


def feature_boxplot(df: DataFrame, cols: list[str], log1p: bool = False, approx: bool = False) -> DataFrame:
    """Quartiles and extremes of each feature, of log1p values when asked."""
    rows = unpivot_features(df, cols)
    if log1p:
        rows = rows.withColumn("value", F.log1p("value"))
    ends = rows.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    probs = [0.25, 0.5, 0.75]
    if approx:
        quart = rows.groupBy("feature").agg(F.percentile_approx("value", probs, 10000).alias("p"))
    else:
        quart = exact_percentiles(rows, "value", probs, ["feature"]).drop("n")
    return quart.join(ends, "feature").select(
        "feature", "min", *[F.col("p")[i].alias(f"q{25 * (i + 1)}") for i in range(3)], "max"
    )


def feature_density(df: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """Fixed-width histogram of each feature between its extremes: feature, bin, n.

    The extremes are one row; the counts combine before the shuffle.
    """
    ends = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")).alias(f"_{i}") for i, c in enumerate(cols)])
    joined = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).crossJoin(F.broadcast(ends))
    picked = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("v"), F.col(f"_{i}.lo").alias("lo"), F.col(f"_{i}.hi").alias("hi"))
        for i, c in enumerate(cols)
    ])
    rows = joined.select(F.explode_outer(picked).alias("x")).select("x.*")
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    place = F.coalesce(F.floor((F.col("v") - F.col("lo")) / width * bins), F.lit(0))
    return rows.filter("v is not null").groupBy("feature", F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density_curve(df: DataFrame, cols: list[str], factor: float = 0.15, fine: int = 16) -> DataFrame:
    """Gaussian density of each feature: feature, point (its number on the grid), x, density.

    The bandwidth is ``factor`` times the sample deviation, the grid has ``fine`` points to a bandwidth and
    begins at the smallest value. Each value is shared between its two grid points, and the counts of the
    points, which combine before the shuffle, are spread by the kernel to six bandwidths. The densities
    times the grid's step add up to 1; points that nothing reaches have no row. Rows grow with the
    features' spread, not with the table. Nulls and NaN are left out; a feature that is constant, infinite
    somewhere or without two values has no curve.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    one = df.agg(*[
        F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), (F.stddev_samp(v) * F.lit(factor / fine)).alias("step")).alias(f"_{i}") for i, v in enumerate(value.values())
    ])
    joined = df.select(*[v.alias(c) for c, v in value.items()]).crossJoin(F.broadcast(one))  # one row
    picked = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v"), F.col(f"_{i}").alias("s")) for i, c in enumerate(cols)])
    rows = joined.select(F.explode_outer(picked).alias("x")).select("x.feature", "x.v", "x.s.*").filter("v is not null and step > 0 and step < double('infinity')")
    place = rows.withColumn("_at", (F.col("v") - F.col("lo")) / F.col("step")).withColumn("_j", F.floor("_at")).withColumn("_r", F.col("_at") - F.col("_j"))
    keys = ["feature", "n", "lo", "step"]
    # the share of the next point is summed beside its own, so a value is one row before the shuffle
    bins = place.groupBy(*keys, "_j").agg(F.sum(1 - F.col("_r")).alias("_own"), F.sum("_r").alias("_next"))
    reach = range(-6 * fine, 6 * fine + 1)
    total = math.fsum(math.exp(-0.5 * (k / fine) ** 2) for k in reach)
    near = bins.select(*keys, "_j", "_own", "_next", F.explode(F.sequence(F.lit(reach[0]), F.lit(reach[-1] + 1))).alias("k"))
    weight = lambda k: F.when(k.between(reach[0], reach[-1]), F.exp(-0.5 * (k / F.lit(float(fine))) ** 2) / total).otherwise(0.0)
    spread = F.col("_own") * weight(F.col("k")) + F.col("_next") * weight(F.col("k") - 1)
    points = near.groupBy(*keys, (F.col("_j") + F.col("k")).alias("point")).agg(F.sum(spread).alias("_d")).filter("_d > 0")
    return points.select(
        "feature", F.col("point").cast("bigint").alias("point"), (F.col("lo") + F.col("point") * F.col("step")).alias("x"),
        (F.col("_d") / (F.col("n") * F.col("step"))).alias("density"),
    )


def reconstruction_by_feature(scored: DataFrame, names: list[str], x: str = "x", recon: str = "recon") -> DataFrame:
    """Mean absolute reconstruction error of each feature over all rows."""
    wide = scored.agg(*[F.avg(F.abs(F.col(x)[i] - F.col(recon)[i])).alias(f"_{i}") for i in range(len(names))])
    return _melt(wide, [], {n: F.struct(F.col(f"_{i}").alias("mean_abs_error")) for i, n in enumerate(names)})


