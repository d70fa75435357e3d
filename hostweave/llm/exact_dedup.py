"""Exact duplicates by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.session import cut

SPACES = r"[\x20\x09-\x0D]+"
HEAD = 32  # characters of a text that the sampled splitters look at first
HEAVY_LIMIT = 65536  # at most so many texts can hold more than 1/65536 of the rows
HEAVY_ROWS = 64  # a text with fewer copies is never split


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """``docs`` in content order: id, row, norm, h, part, place, run_id, run_size.

    Equal texts, or parts of about ``part_rows`` of them, are runs; place counts from 1 in a run.
    """
    rows = docs.select(F.col(id_col).alias("id"), row.alias("row"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))
    total = docs.select(F.lit(1)).count()
    part_rows = max(HEAVY_ROWS, total // HEAVY_LIMIT)
    # a count above total / HEAVY_LIMIT is reached by fewer than HEAVY_LIMIT texts
    heavy = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part_rows)
    heavy = heavy.select("h", F.ceil(F.col("n") / part_rows).alias("parts"))
    rows = rows.join(F.broadcast(heavy), "h", "left").select(
        "id", "row", "norm", "h", F.substring("norm", 1, HEAD).alias("head"),
        F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(-1)).alias("part"),
    )
    same = Window.partitionBy("head", "h", "norm", "part").orderBy(F.col("id").asc_nulls_last())
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.repartitionByRange("head", "h", "part").select(
        "id", "row", "norm", (F.col("part") >= 0).alias("cut_up"), F.row_number().over(same).alias("place"),
        F.first("id").over(same).alias("run_id"), F.count(F.lit(1)).over(whole).alias("run_size"),
    )


def _joined_heads(heads: DataFrame) -> DataFrame:
    """Heads of parts (run_id, run_size, sha, norm) in content order: sha, run_id, and place, keep and size of their group."""
    heads = heads.select("run_id", "run_size", "sha", "norm", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("h"))
    group = Window.partitionBy("head", "h", "norm").orderBy(F.col("run_id").asc_nulls_last())
    all_of = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return heads.repartitionByRange("head", "h").select(
        F.col("sha").alias("g_sha"), F.col("run_id").alias("g_run"), F.row_number().over(group).alias("g_place"),
        F.first("run_id").over(group).alias("g_keep"), F.sum("run_size").over(all_of).alias("g_size"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Method: the normalised texts are range-partitioned by sampled splitters and sorted externally,
    so equal texts lie next to each other; a window that starts anew wherever the full text differs
    from its neighbour finds the smallest identifier and the size of each run. The sort order is
    (first 32 characters, 64-bit hash, text, part, id): splitters stay short whatever the length of
    the texts, and texts with the same beginning still spread over many tasks.

    A text with many copies is cut into parts of about ``max(64, rows / 65536)`` rows by a hash of
    the id. Each part is a run of its own in the first sort; the heads of the parts (fewer than
    131,072, whatever the size of the input) go through a second sort of the same kind, which joins
    the parts to groups. Only tables of that bounded size are broadcast.

    Cases: a null or empty text is one text like any other; of rows with equal text and equal id
    exactly one is kept; a null id sorts last, so it stays only if its group has no other id; an
    empty table gives no rows; other columns of ``docs``, whatever their names, are not looked at.
    """
    runs = _sorted_runs(docs, id_col, text_col, F.lit(None).cast("int")).drop("row")
    head = F.col("cut_up") & (F.col("place") == 1)
    # only the heads of parts keep their text, for the second sort
    runs = cut(runs.withColumn("sha", F.sha2("norm", 256)).withColumn("norm", F.when(head, F.col("norm"))), "content-sort")
    groups = _joined_heads(runs.filter(head))
    in_group = F.col("cut_up") & (F.col("sha") == F.col("g_sha")) & F.col("run_id").eqNullSafe(F.col("g_run"))
    joined = runs.join(F.broadcast(groups), in_group, "left")
    first = (F.col("place") == 1) & (~F.col("cut_up") | (F.col("g_place") == 1))
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("cut_up"), F.col("g_keep")).otherwise(F.col("run_id")).alias("keep_id"),
        F.when(F.col("cut_up"), F.col("g_size")).otherwise(F.col("run_size")).cast("bigint").alias("group_size"),
        first.alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Whole rows take part in the content sort, so they need not be joined to their decision.
    """
    runs = _sorted_runs(docs, id_col, text_col, F.struct("*"))
    firsts = runs.filter("place = 1").select("row", "cut_up", "run_id", "run_size", F.sha2("norm", 256).alias("sha"))
    firsts = cut(firsts, "content-heads")
    heads = firsts.filter("cut_up").withColumn("norm", normalised(F.col("row").getField(text_col)))
    kept = _joined_heads(heads).filter("g_place = 1")
    # at most one part of a group stays, so the join neither drops nor repeats rows
    of_parts = firsts.filter("cut_up").join(
        F.broadcast(kept), (F.col("sha") == F.col("g_sha")) & F.col("run_id").eqNullSafe(F.col("g_run")), "left_semi",
    )
    return firsts.filter("not cut_up").unionByName(of_parts).select("row.*")
