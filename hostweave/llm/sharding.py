"""Sharding by balanced label propagation, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostweave.operators.scale_out import dense_index, lookup_join
from hostweave.session import cut

ROUNDS = 8
SLACK = 0.05  # by which linked documents may overfill a shard in the last rounds, until the sizes are levelled
PART = 8  # a part of a group is at most a shard's share over this, in bytes
PART_ROWS = 65536  # and at most so many rows, about
BIG = 256  # documents above a shard's share over this are placed one by one; fewer than BIG * shards
SMALL = 8192  # documents above a shard's share over this are levelled before the rest
BUCKETS = 1024  # of a shard or of the pool that are moved as a whole


def _spread(*columns) -> Column:
    return F.xxhash64(*columns)


def propagate(nodes: DataFrame, links: DataFrame, shards: int, share: float, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """node, shard: ``nodes`` (node, size) moved round by round towards the shards of their neighbours.

    ``links`` (a, b) are undirected; a repeated link counts as often as it stands there. Every node
    starts in a shard by its hash. In a round a node asks for the shard that most of its neighbours
    are in, if more are there than in its own. Two rounds share an order of the shards; in the first
    of them a node asks only for a later shard, in the second only for an earlier one, so neighbours
    never swap for ever. A shard admits askers up to its quota of
    ``(1 + s) * share`` bytes, where s begins at one, so that full shards can exchange rows, and halves
    every second round down to ``slack``; if more ask, the part that fits is drawn by a hash. It ends
    after ``rounds`` or when nobody asked in two rounds. Only tables of one row per shard are broadcast.
    """
    spark = nodes.sparkSession
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))), "links")
    state = cut(nodes.select("node", "size", F.pmod(_spread(F.lit(7), "node"), F.lit(shards)).cast("int").alias("shard")), "shards")
    idle = 0
    for number in range(1, rounds + 1):
        placed = state.select(F.col("node").alias("other"), F.col("shard").alias("theirs"))
        votes = lookup_join(both, placed, ["other"]).groupBy("node", "theirs").agg(F.count(F.lit(1)).alias("votes"))
        votes = votes.join(state, "node")
        best = votes.groupBy("node", "size", "shard").agg(
            F.max(F.struct("votes", _spread(F.lit(number), "theirs"), "theirs")).alias("best"), F.max(F.when(F.col("theirs") == F.col("shard"), F.col("votes"))).alias("own"),
        )
        target = F.col("best.theirs")
        ahead = _spread(F.lit(50 + (number - 1) // 2), target) > _spread(F.lit(50 + (number - 1) // 2), "shard")
        onward = ahead if number % 2 else ~ahead & (target != F.col("shard"))
        asking = best.filter(onward & (F.col("best.votes") > F.coalesce("own", F.lit(0)))).select("node", "size", target.alias("target"))
        asking = cut(asking, "asking")
        load = state.groupBy(F.col("shard").alias("target")).agg(F.sum("size").alias("load"))
        asked = asking.groupBy("target").agg(F.sum("size").alias("asked")).join(load, "target")
        quota = (1 + max(slack, 0.5 ** (number // 2))) * share
        room = F.greatest(F.lit(0.0), F.lit(quota) - F.col("load")) / F.col("asked")
        quotas = {r["target"]: r["room"] for r in asked.select("target", room.alias("room")).collect()}  # one row per shard
        idle = idle + 1 if not quotas else 0
        if idle == 2:
            break
        if quotas:
            rooms = spark.createDataFrame(list(quotas.items()), "target int, room double")
            draw = F.pmod(_spread(F.lit(100 + number), "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
            moved = asking.join(F.broadcast(rooms), "target").filter(draw < F.col("room")).select("node", "target")
            state = cut(state.join(moved, "node", "left").select("node", "size", F.coalesce("target", "shard").alias("shard")), "shards")
    return state.select("node", "shard")


def star_links(rows: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The rows (row, size, key, ...) whose key stands more than once, with part and part_head; and their links.

    A row is linked with the first row of its part of the group, and that with the first row of the
    group: as many links as rows, no pairs. A group that is a large share of a shard is cut into parts
    by a hash, so that it can lie on few shards, and no row has more than about ``PART_ROWS`` links.
    """
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("row").alias("head")).filter("n > 1")
    parts = F.greatest(F.ceil(F.col("bytes") * PART / F.lit(max(share, 1.0))), F.ceil(F.col("n") / PART_ROWS))
    linked = lookup_join(rows, groups.select("key", "head", F.least(parts, F.col("n")).alias("parts")), ["key"])
    linked = cut(linked.withColumn("part", F.pmod(_spread("row"), F.col("parts"))).drop("parts"), "linked")
    heads = linked.groupBy("key", "part").agg(F.min("row").alias("part_head"))
    linked = cut(lookup_join(linked, heads, ["key", "part"]), "linked")
    to_part = linked.filter("row <> part_head").select(F.col("row").alias("a"), F.col("part_head").alias("b"))
    to_head = linked.filter("row = part_head and row <> head").select(F.col("row").alias("a"), F.col("head").alias("b"))
    return linked, to_part.unionByName(to_head)


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["load"] for r in rows.groupBy("shard").agg(F.sum("size").alias("load")).collect()}  # one row per shard
    return [found.get(s, 0) for s in range(shards)]


def kept_in_place(linked: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """``linked`` (with shard) as those that stay and those beyond a shard's share, whole buckets at a time."""
    linked = linked.withColumn("bucket", F.pmod(_spread(F.lit(3), "key", "part"), F.lit(BUCKETS)))
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bucket"))
    sums = linked.groupBy("shard", "bucket").agg(F.sum("size").alias("bytes")).withColumn("upto", upto)
    fits = cut(sums.select("shard", "bucket", (F.col("upto") <= F.lit(share)).alias("stays")), "buckets")
    marked = cut(lookup_join(linked, fits, ["shard", "bucket"]).drop("bucket"), "levelled")
    return marked.filter("stays").drop("stays"), marked.filter("not stays").drop("stays", "shard")


def _place_big(big: DataFrame, loads: list[int], share: float, spark: SparkSession) -> DataFrame:
    """Documents that are a large part of a shard, largest first, copies together where they fit.

    They are fewer than ``BIG`` times the number of shards, whatever the size of the input.
    """
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for r in big.select("row", "size", F.hex("key").alias("name"), "part").collect():
        groups.setdefault((-r["size"], r["name"], r["part"]), []).append((r["row"], r["size"]))
    placed = []
    for _, rows in sorted(groups.items()):
        whole = sum(size for _, size in rows)
        units = [rows] if min(loads) + whole <= share else [[x] for x in sorted(rows)]
        for unit in units:
            s = loads.index(min(loads))
            loads[s] += sum(size for _, size in unit)
            placed.extend((row, s) for row, _ in unit)
    return big.join(F.broadcast(spark.createDataFrame(placed, "row bigint, shard int")), "row")


def _fill(pool: DataFrame, loads: list[int], share: float) -> DataFrame:
    """``pool`` laid along the free room of all shards: each row gets the shard in which its middle falls.

    Buckets of rows are laid as a whole if they lie inside one shard's room; only the rows of the at
    most ``shards`` buckets that cross an edge are put in order. Copies share a bucket.
    """
    room = [max(0.0, share - x) for x in loads]
    buckets = max(BUCKETS, min(1 << 16, pool.count() // 10_000))
    pool = pool.withColumn("bucket", F.pmod(_spread(F.lit(5), "key", "part"), F.lit(buckets)))
    sums = pool.groupBy("bucket").agg(F.sum("size").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy())
    sums = sums.withColumn("end", F.sum("bytes").over(Window.orderBy("bucket"))).withColumn("total", total)  # one row per bucket
    edges, at = [], 0.0
    for x in room[:-1]:
        at += x
        edges.append(at / max(sum(room), 1.0))
    shard_at = lambda place: F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e * F.col("total") <= place)) if edges else F.lit(0)
    sums = sums.withColumn("begin", F.col("end") - F.col("bytes"))
    sums = cut(sums.select("bucket", "begin", "total", shard_at(F.col("begin")).alias("low"), shard_at(F.col("end") - 1).alias("high")), "pool-buckets")
    inside = pool.join(F.broadcast(sums.filter("low = high").select("bucket", F.col("low").alias("shard"))), "bucket")
    across = pool.join(F.broadcast(sums.filter("low < high")), "bucket")
    upto = F.sum("size").over(Window.partitionBy("bucket").orderBy("key", "part", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    across = across.withColumn("shard", shard_at(F.col("begin") + upto - F.col("size") / 2)).drop("begin", "total", "low", "high")
    return inside.unionByName(across).drop("bucket")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text plus 1. Documents with equal texts are linked
    (``star_links``) and moved together by balanced label propagation (``propagate``) under quotas of
    bytes. Then the sizes are levelled: what overfills a shard, and all documents without links, fill
    the shards up to equal sizes, the largest first, so that shards differ by about a small
    document. law is 'bytes'; slot numbers the rows of a shard from 0 without gaps; grown_shard is null.

    Cases: a null text has no bytes (size 1, checksum 0) and is a copy of other null texts only; null
    and repeated ids keep their rows, as each row is a document; a document larger than a shard's
    share stands alone, with the others levelled around it; an empty table gives no rows; other
    columns are not looked at. Groups of equal texts are told by sha256.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = cut(docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("crc"), F.coalesce(F.unhex(F.sha2(text, 256)), F.lit("").cast("binary")).alias("key"),
    ), "rows")
    share = (rows.agg(F.sum("size").alias("total")).head()["total"] or 0) / shards
    linked, links = star_links(rows, share)
    found = propagate(linked.select(F.col("row").alias("node"), "size"), links, shards, share, rounds, slack)
    linked = linked.join(found.withColumnRenamed("node", "row"), "row")
    columns = ["id", "row", "size", "crc", "key", "part"]
    kept, freed = kept_in_place(linked.select(*columns, "shard"), share)
    single = rows.join(linked.select("row"), "row", "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    pool = cut(freed.select(*columns).unionByName(single.select(*columns)), "pool")
    loads = _loads(kept, shards)
    size = F.col("size")
    placed = [kept.select(*columns, "shard")]
    big = pool.filter(size > share / BIG)
    placed.append(_place_big(big, loads, share, spark).select(*columns, "shard"))
    for part in (pool.filter((size <= share / BIG) & (size > share / SMALL)), pool.filter(size <= share / SMALL)):
        filled = cut(_fill(part, loads, share).select(*columns, F.col("shard").cast("int").alias("shard")), "filled")
        loads = [a + b for a, b in zip(loads, _loads(filled, shards))]
        placed.append(filled)
    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    whole = dense_index(cut(whole, "placed"), "row", ["shard"], "slot")
    return whole.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
