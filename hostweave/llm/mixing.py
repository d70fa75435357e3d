"""Mixing of sources to target weights by temperature, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.operators.scale_out import lookup_join
from hostweave.session import cut

BLOCK_ROWS = 1000  # documents of a block, about
MOST_BLOCKS = 65536  # of a source; its blocks grow beyond that
SMALL_TABLE = 10_000  # sources up to which their table is broadcast; more meet the rows in a plain join
BITS = 5  # by which a pass over the sources narrows an exponent
PASSES = 11
TINY = 1e-12  # by which rounding may miss an entropy
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _exact_sum(values: Column) -> Column:
    """A sum in two whole parts of 30 bits after the point, which does not depend on the order in which tasks end."""
    scaled = values * F.lit(2.0**30)
    low = F.floor((scaled - F.floor(scaled)) * F.lit(2.0**30))
    return (F.sum(F.floor(scaled)).cast("double") + F.sum(low).cast("double") / F.lit(2.0**30)) / F.lit(2.0**30)


def sums_at(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent a, over all shares p: the sum of p**a and that of p**a * ln(p). Each share is raised once for each."""
    p, a = F.col("share"), F.col("a")
    each = shares.select("share", F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("a"))
    raised = F.pow(p, a)
    found = each.groupBy("a").agg(_exact_sum(raised).alias("s"), _exact_sum(raised * F.ln(p)).alias("t"))
    return {r["a"]: (r["s"], r["t"]) for r in found.collect()}  # a row for each exponent


def bisect_exponents(shares: DataFrame, tests: list) -> list[float]:
    """For each test the exponent in 0..1 where ``test(a, s, t)`` turns from true to false.

    ``s`` and ``t`` are those of :func:`sums_at`. All tests share each pass over the shares. A pass narrows every bracket to the ``2**BITS``-th part,
    and PASSES of them leave less than the distance of two doubles near 1.
    """
    brackets = [(0.0, 1.0)] * len(tests)
    for _ in range(PASSES if tests else 0):
        marks = [[lo + (hi - lo) * k / 2**BITS for k in range(1, 2**BITS)] for lo, hi in brackets]
        found = sums_at(shares, sorted({a for each in marks for a in each}))
        for i, test in enumerate(tests):
            lo, hi = brackets[i]
            for a in marks[i]:
                if a not in found or not test(a, *found[a]):
                    hi = min(a, hi)
                    break
                lo = a
            brackets[i] = (lo, hi)
    return [hi for _, hi in brackets]


def source_weights(
    totals: DataFrame, target_entropy: float | None = None, most_repeats: float | None = None, budget_share: float = 1.0,
) -> DataFrame:
    """``totals`` (source, tokens, n_rows) with weight, exponent and quota, the tokens to draw.

    Weights are token shares to the power of one exponent in 0 (all alike) to 1 (as they come).
    ``target_entropy``, a share of the logarithm of the number of sources with tokens, is met from
    above by the largest exponent that reaches it. ``most_repeats`` bounds quota / tokens of every
    source by the smallest exponent that keeps to it. With both, the larger exponent holds; with
    none it is 1. If not even exponent 1 can keep a limit, 1 is taken. The budget is ``budget_share`` times all tokens.

    The table of sources is written once and read by each pass over it, so neither the driver nor one
    task holds it; the driver gets a few numbers for each exponent that is tried. Without any tokens
    the exponent is 1 and all weights are 0.
    """
    totals = cut(totals.select("source", "tokens", "n_rows"), "mixing-totals")
    all_of = totals.agg(
        F.sum("tokens").alias("tokens"), F.count(F.when(F.col("tokens") > 0, 1)).alias("n"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least"),
    ).first()
    total, n = all_of["tokens"] or 0, all_of["n"]
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    shares = totals.filter("tokens > 0").select(share.alias("share"))
    tests = []
    if target_entropy is not None:
        wanted = target_entropy * math.log(max(n, 1)) - TINY
        tests.append(lambda a, s, t: math.log(s) - a * t / s >= wanted)
    if most_repeats is not None:
        # a source is repeated p**(a - 1) / s times, the smallest one most often
        least = (all_of["least"] or 1) / max(total, 1)
        tests.append(lambda a, s, t: budget_share * least ** (a - 1) / s > most_repeats)
    exponent = max(bisect_exponents(shares, tests), default=1.0) if total else 1.0
    whole = sums_at(shares, [exponent])[exponent][0] if total else 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(whole)).otherwise(F.lit(0.0))
    return totals.select(
        "source", "tokens", "n_rows", F.lit(exponent).alias("exponent"), weight.alias("weight"),
        F.round(weight * F.lit(float(total)) * F.lit(float(budget_share))).cast("bigint").alias("quota"),
    )


def _order(seed: int, *parts) -> Column:
    return F.xxhash64(F.lit(seed + 1), *parts)


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    return [
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("row_hash"),
    ]


def _look_up(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    return left.join(F.broadcast(right), "source") if few else lookup_join(left, right, ["source"])


def _block(row_hash: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(row_hash, 20), blocks).cast("int")


def mixing_plan(rows: DataFrame, target_entropy: float | None, most_repeats: float | None, budget_share: float, seed: int) -> tuple[DataFrame, bool]:
    """One row per source, and whether they are few: weight, blocks, passes, and where the last pass ends.

    ``rows`` has source, tokens and row_hash. The last pass takes the blocks in front of edge_block in
    its order, and of that block the rows up to (edge_order, edge_hash); null means none of its rows.
    """
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    plan = source_weights(totals, target_entropy, most_repeats, budget_share).select(
        "source", "weight", F.least(F.ceil(F.col("n_rows") / BLOCK_ROWS), F.lit(MOST_BLOCKS)).alias("blocks"),
        F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(0)).cast("int").alias("passes"),
        F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(F.lit(-1)).alias("rest"),
    )
    plan = cut(plan, "mixing-plan")
    few = plan.count() <= SMALL_TABLE
    placed = _look_up(rows, plan, few).withColumn("block", _block(F.col("row_hash"), F.col("blocks")))
    sums = placed.groupBy("source", "block", "passes", "rest").agg(F.sum("tokens").alias("t"))
    by_block = Window.partitionBy("source").orderBy(_order(seed, "source", "block", "passes"), "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(by_block), F.lit(0)))
    edge = sums.filter("before <= rest and before + t > rest").select("source", F.col("block").alias("edge_block"), "before")
    edge = cut(plan.join(edge, "source", "left"), "mixing-edges")
    inside = _look_up(rows, edge, few).filter(_block(F.col("row_hash"), F.col("blocks")) == F.col("edge_block"))
    inside = inside.withColumn("o", _order(seed, "row_hash", "passes"))
    # equal rows are taken together or not at all
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("o", "row_hash"))
    last = inside.withColumn("fits", upto <= F.col("rest")).filter("fits").groupBy("source").agg(F.max(F.struct("o", "row_hash")).alias("e"))
    last = last.select("source", F.col("e.o").alias("edge_order"), F.col("e.row_hash").alias("edge_hash"))
    return cut(edge.join(last, "source", "left").drop("before", "rest"), "mixing-plan"), few


def copies(seed: int) -> Column:
    """How often a row with the columns of its source's plan is drawn."""
    block = _block(F.col("row_hash"), F.col("blocks"))
    mine, edge = _order(seed, "source", block, "passes"), _order(seed, "source", "edge_block", "passes")
    own = _order(seed, "row_hash", "passes")
    in_front = (mine < edge) | ((mine == edge) & (block < F.col("edge_block")))
    within = (own < F.col("edge_order")) | ((own == F.col("edge_order")) & (F.col("row_hash") <= F.col("edge_hash")))
    extra = F.when(F.col("edge_block").isNull(), False).when(block == F.col("edge_block"), F.coalesce(within, F.lit(False))).otherwise(in_front)
    return F.col("passes") + extra.cast("int")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = 0.95,
    most_repeats: float | None = 4.0, budget_share: float = 1.0, seed: int = 0,
) -> DataFrame:
    """The schedule of a mixture: one row per drawn copy of a row of ``docs``.

    Columns: id, source, tokens (words), copy (0, 1, ...: the pass over the source), block, block_place
    and place (where the copy stands in its pass), weight, row_hash.

    A source's rows are cut into blocks by a hash, about 1,000 rows each. A pass runs through all
    blocks in an order of its own, and through the rows of a block in an order of its own. A source
    whose quota is q times its tokens has floor(q) whole passes; of the next pass it takes the blocks,
    and in the block where the quota ends the rows, that fit in order. Each source so gets its quota,
    less at most one row, and no row is drawn more than once more often than another of its source.

    Texts are read once for their word counts and never shuffled. Only block totals of a source meet
    in one task (at most 65,536), and the rows of its one cut block. Orders depend on hashes of the
    id, text and seed alone.

    Cases: a null source is the source with the empty name; a null or empty text has 0 words; a row
    without words is drawn with its neighbours; a source without any words gets no quota and is not
    drawn; equal rows are drawn together, so they can leave a quota short by all of them; an empty
    table gives no rows; other columns are not looked at.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), *_keys(docs, id_col, text_col, source_col, seed), word_count(F.col(text_col)).alias("tokens")), "mixing-rows")
    plan, few = mixing_plan(rows, target_entropy, most_repeats, budget_share, seed)
    drawn = _look_up(rows, plan, few).withColumn("copies", copies(seed)).filter("copies > 0")
    drawn = drawn.withColumn("block", _block(F.col("row_hash"), F.col("blocks")))
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return drawn.select(
        F.col("id").alias(id_col), "source", "tokens", "copy", "block", _order(seed, "source", "block", "copy").alias("block_place"),
        _order(seed, "row_hash", "copy").alias("place"), "weight", "row_hash",
    )


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = 0.95,
    most_repeats: float | None = 4.0, budget_share: float = 1.0, seed: int = 0,
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` draws it, with all their columns.

    Rows only meet the one-row-per-source plan; no text is shuffled.
    """
    rows = cut(docs.select(*_keys(docs, id_col, text_col, source_col, seed), word_count(F.col(text_col)).alias("tokens")), "mixing-rows")
    plan, few = mixing_plan(rows, target_entropy, most_repeats, budget_share, seed)
    wrapped = docs.select(F.struct("*").alias("row"), *_keys(docs, id_col, text_col, source_col, seed))
    drawn = _look_up(wrapped, plan, few).withColumn("copies", copies(seed)).filter("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
