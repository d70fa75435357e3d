"""Prefix trie of conversations, with a count-min screen of prefix digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hostweave.llm.hashing import mix64
from hostweave.operators.scale_out import lookup_join, range_scan
from hostweave.session import cut

WORD = r"[^\x20\x09-\x0D]+"
HEAD = 3  # most turns that a conversation takes over
SKETCH_ROWS = 3
LEAST_BITS, MOST_BITS = 12, 25  # of a sketch row; at most three rows of 4 MB go to the tasks
BLOCK = 2048  # bytes of a sketch that are summed together
CHUNK = 1 << 16  # bytes of the text of identifiers that is passed on at a time
_U = np.uint64
_SEEDS = mix64(np.arange(1, SKETCH_ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_PARTS = ["p1", "p2", "p3", "p4"]


# --- conversations -----------------------------------------------------------------------------


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, j (1, 2, ... in the order of turns), digest, words; texts stay where they are read."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"), F.lit(1).cast("bigint").alias("one"),
    )
    # equal turns come in the order of their digests; only equal rows are told apart by where they were read
    rows = rows.withColumn("read", F.monotonically_increasing_id())
    return range_scan(rows, ["conv_id"], ["turn", "digest", "read"], ["one"], "turns").select("conv_id", F.col("one_run").alias("j"), "digest", "words")


def rebuilt_turns(turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: (steps, conversations).

    ``turns`` is the result of ``numbered_turns``; ``base`` and ``taken`` are expressions of conv_id:
    whose turns come first, and how many (at most ``HEAD``) of them replace as many own ones. steps:
    conv_id, depth (from 1), digest, words, size; conversations: conv_id, size (its rebuilt turns).
    """
    turns = cut(turns, "numbered-turns")
    heads = turns.filter(F.col("j") <= HEAD).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("j", "digest", "words"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("j").alias("own")).withColumn("base", base).withColumn("h", taken)
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("got", F.size("head").cast("bigint"))
    convs = cut(convs.withColumn("size", F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("base", "own"), "conversations")
    first = convs.select("conv_id", F.explode("head").alias("t"), "size")
    first = first.select("conv_id", F.col("t.j").alias("depth"), "t.digest", "t.words", "size")
    rest = lookup_join(turns.filter(F.col("j") > taken), convs.select("conv_id", "h", "got", "size"), ["conv_id"])
    rest = rest.select("conv_id", (F.col("got") + F.col("j") - F.col("h")).alias("depth"), "digest", "words", "size")
    return first.unionByName(rest), convs.select("conv_id", "size")


def whole_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form of ``rebuilt_turns``."""
    return rebuilt_turns(turns, F.col("conv_id"), F.lit(0))


# --- digests -----------------------------------------------------------------------------------


def _key(sums: list[Column], depth: Column) -> list[Column]:
    return [F.xxhash64(*sums, depth), F.xxhash64(depth, *reversed(sums))]


def prefix_digests(steps: DataFrame) -> DataFrame:
    """conv_id, depth, words, ends, k1, k2 (the prefix up to here), u1, u2 (the one before).

    A prefix is named by 128 bits: sums over its turns of four 32-bit pieces of hashes of (digest,
    place). Sums run along a conversation by ``range_scan``, so a very long one is dealt like others.
    """
    one, two = F.xxhash64("digest", "depth"), F.xxhash64("depth", "digest")
    low = F.lit(0xFFFFFFFF)
    rows = steps.select(
        "conv_id", "depth", "words", (F.col("depth") == F.col("size")).alias("ends"), F.shiftrightunsigned(one, 32).alias("p1"),
        one.bitwiseAND(low).alias("p2"), F.shiftrightunsigned(two, 32).alias("p3"), two.bitwiseAND(low).alias("p4"),
    )
    rows = range_scan(rows, ["conv_id"], ["depth"], _PARTS, "steps")
    here = _key([F.col(f"{p}_run") for p in _PARTS], F.col("depth"))
    before = _key([F.col(f"{p}_run") - F.col(p) for p in _PARTS], F.col("depth") - 1)
    return rows.select("conv_id", "depth", "words", "ends", here[0].alias("k1"), here[1].alias("k2"), before[0].alias("u1"), before[1].alias("u2"))


# --- count-min screen --------------------------------------------------------------------------


def _places(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix64(keys + _SEEDS[row]) >> _U(64 - bits)).astype(np.int64)


def _batched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def block_bytes(bits: int) -> int:
    return min(BLOCK, 1 << bits >> 3)


def sketch_blocks(keys: DataFrame, bits: int) -> DataFrame:
    """block, twos: which counters of a count-min sketch of the one column of ``keys`` reach two.

    A counter saturates at two: 'one' and 'two or more' are all that the screen asks for. Each task
    fills a sketch of its own; the sketches are added block by block of ``BLOCK`` bytes.
    """
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((SKETCH_ROWS, 1 << bits), np.uint8)
        for table in _batched(batches, 1 << 16):
            values = table.column(0).to_numpy().view(_U)
            for row in range(SKETCH_ROWS):
                at, n = np.unique(_places(values, row, bits), return_counts=True)
                counters[row, at] = np.minimum(counters[row, at] + np.minimum(n, 2).astype(np.uint8), 2)
        ones = np.packbits(counters >= 1).reshape(-1, block_bytes(bits))
        twos = np.packbits(counters >= 2).reshape(ones.shape)
        some = np.flatnonzero(ones.any(axis=1))
        for a in range(0, len(some), 256):
            part = some[a : a + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array([ones[i].tobytes() for i in part], pa.binary()), pa.array([twos[i].tobytes() for i in part], pa.binary())],
                ["block", "ones", "twos"],
            )

    def add(table: pa.Table) -> pa.Table:
        ones, twos = 0, 0
        for o, t in zip(table["ones"], table["twos"]):
            o, t = np.frombuffer(o.as_buffer(), np.uint8), np.frombuffer(t.as_buffer(), np.uint8)
            twos, ones = twos | t | (ones & o), ones | o
        return pa.table({"block": table["block"][:1], "twos": pa.array([twos.tobytes()], pa.binary())})

    filled = keys.mapInArrow(fill, "block int, ones binary, twos binary")
    return filled.groupBy("block").applyInArrow(add, "block int, twos binary")


def screened(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` with shared and parent_shared: false where an estimate of one proves one conversation.

    A count-min estimate is never too low, so a prefix whose estimate is one belongs to one
    conversation. The sketch has about four counters a prefix up to 2**25 a row (12 MB in all); beyond
    that it proves less and more prefixes are grouped exactly, with the same result.
    """
    total = prefixes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * total).bit_length()))
    table = np.zeros(SKETCH_ROWS << bits >> 3, np.uint8)
    for r in sketch_blocks(prefixes.select("k1"), bits).toLocalIterator():
        table[r["block"] * block_bytes(bits) :][: len(r["twos"])] = np.frombuffer(r["twos"], np.uint8)

    def maybe(keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for row in range(SKETCH_ROWS):
            at = _places(keys.view(_U), row, bits) + (row << bits)
            found &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return found

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batched(batches, 1 << 14):
            shared, above = maybe(t["k1"].to_numpy()), maybe(t["u1"].to_numpy()) | (t["depth"].to_numpy() == 1)
            t = t.append_column("shared", pa.array(shared)).append_column("parent_shared", pa.array(above))
            yield from t.combine_chunks().to_batches()

    kinds = "conv_id bigint, depth bigint, words bigint, ends boolean, k1 bigint, k2 bigint, u1 bigint, u2 bigint, shared boolean, parent_shared boolean"
    return prefixes.select(*[c.split()[0] for c in kinds.split(", ")[:8]]).mapInArrow(screen, kinds)


# --- hashes of identifier lists ----------------------------------------------------------------


def end_hashes(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the comma-joined ascending conv_ids of each key of ``ends`` (k1, k2, conv_id).

    The identifiers of a key may be many: they are sorted by sampled splitters and turned into pieces
    of text in many tasks; what one task sees of a key is a stream of pieces, and it holds one.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batched(batches, 1 << 13):
            k1, k2, ids = (t.column(i).to_numpy() for i in range(3))
            first = np.flatnonzero((np.diff(k1, prepend=~k1[:1]) != 0) | (np.diff(k2, prepend=~k2[:1]) != 0))
            rows = [(k1[a], k2[a], ids[a], ",".join(map(str, ids[a:b].tolist()))) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "first", "piece"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for a, b, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.as_buffer())
            if out:
                yield _hash_rows(out)
        if key is not None:
            yield _hash_rows([(*key, state.hexdigest())])

    ordered = ends.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    cut_up = ordered.mapInArrow(pieces, "k1 bigint, k2 bigint, first bigint, piece string")
    streamed = cut_up.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return streamed.mapInArrow(hashes, "k1 bigint, k2 bigint, ends_sha256 string")


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])


# --- the operator ------------------------------------------------------------------------------


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations: ``NODE``.

    ``steps`` and ``convs`` come from ``rebuilt_turns`` or ``whole_turns``. A node is a distinct
    sequence of first turns; the root has none and all conversations, those without turns too. conv_id
    is the smallest member, parent_conv_id the parent's (root: null), n_children the children,
    n_leaves the childless nodes in the subtree, saved_tokens the sum over the subtree of (n_convs - 1)
    times the words of the last turn, ends_sha256 the hash of the members that end here.

    A count-min sketch of all prefix digests proves most prefixes to have one member (``screened``);
    such tails are turned into nodes where they stand. Only the others are grouped. Sums over subtrees
    need no walk from level to level: a childless node, and what a node saves, is booked on its
    smallest member at the node's depth, so the sum over a subtree is, over the node's members, what
    is booked on them from this depth on (``range_scan`` from the end).

    Cases: rows without conv_id belong to no conversation and take no part; null role or text counts
    as empty; null turns come first; equal turns come in the order of sha256(length of role : role
    text), so repeated rows are turns of their own; an empty table gives no rows; other columns are not
    looked at; texts are hashed where they are read, whatever their length.
    """
    prefixes = cut(screened(cut(prefix_digests(steps), "prefix-digests")), "prefixes")
    shared, alone = prefixes.filter("shared"), prefixes.filter("not shared")
    nodes = cut(shared.groupBy("k1", "k2", "depth").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.min("u1").alias("u1"), F.min("u2").alias("u2"),
        F.first("parent_shared").alias("parent_shared"), F.max("ends").alias("some_end"),
    ), "shared-nodes")
    below = nodes.select("u1", "u2", "parent_shared").unionByName(alone.select("u1", "u2", "parent_shared")).filter("parent_shared")
    children = below.groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "shared-nodes")
    saved = (F.col("n_convs") - 1) * F.col("words")
    leaf = (F.col("n_children") == 0).cast("bigint")

    booked = nodes.select("conv_id", "depth", saved.alias("own"), leaf.alias("leaf"))
    members = shared.select("conv_id", "depth", "k1", "k2").join(booked, ["conv_id", "depth"], "left")
    members = members.select("conv_id", (-F.col("depth")).alias("back"), "k1", "k2", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("own", "leaf")])
    none = F.lit(None).cast("bigint")
    tails = alone.filter("ends").select("conv_id", (-F.col("depth")).alias("back"), none.alias("k1"), none.alias("k2"), F.lit(0).cast("bigint").alias("own"), F.lit(1).cast("bigint").alias("leaf"))
    summed = range_scan(members.unionByName(tails), ["conv_id"], ["back"], ["own", "leaf"], "members").filter("k1 is not null")
    subtree = summed.groupBy("k1", "k2").agg(F.sum("own_run").alias("saved_tokens"), F.sum("leaf_run").alias("n_leaves"))

    zero = F.lit(0).cast("bigint")
    root = _key([zero] * 4, zero)
    ends = shared.filter("ends").select("k1", "k2", "conv_id").unionByName(convs.filter("size = 0").select(root[0].alias("k1"), root[1].alias("k2"), "conv_id"))
    ended = cut(end_hashes(ends), "ends")
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    top = _root(convs, nodes, alone, saved, leaf)
    top = cut(top.crossJoin(ended.filter((F.col("k1") == root[0]) & (F.col("k2") == root[1])).agg(F.max("ends_sha256").alias("e"))), "root")

    above = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("above"))
    first = F.broadcast(top.select(F.col("conv_id").alias("first")))  # one row

    def parent(rows: DataFrame) -> DataFrame:
        inner = lookup_join(rows.filter("parent_shared and depth > 1"), above, ["u1", "u2"])
        outer = rows.filter("not parent_shared or depth = 1").crossJoin(first)
        outer = outer.withColumn("above", F.when(F.col("depth") == 1, F.col("first")).otherwise(F.col("conv_id"))).drop("first")
        return inner.unionByName(outer).withColumnRenamed("above", "parent_conv_id")

    many = parent(nodes.join(subtree, ["k1", "k2"])).join(ended, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))
    one = F.lit(1).cast("bigint")
    single = parent(alone).select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(F.col("ends"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nobody).alias("ends_sha256"),
    )
    top = top.select("conv_id", zero.alias("depth"), none.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("e", nobody).alias("ends_sha256"))
    return top.unionByName(many.select(*NODE)).unionByName(single)


def _root(convs: DataFrame, nodes: DataFrame, alone: DataFrame, saved: Column, leaf: Column) -> DataFrame:
    """The root's conv_id and counts, in one row; no row if there is no conversation."""
    all_of = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    many = nodes.agg(F.sum(saved).alias("saved"), F.sum(leaf).alias("leaves"), F.count_if(F.col("depth") == 1).alias("children"))
    one = alone.agg(F.count_if("ends").alias("ends"), F.count_if(F.col("depth") == 1).alias("heads"))
    row = all_of.crossJoin(many).crossJoin(one).filter("n_convs > 0")  # one row each
    children = F.col("children") + F.col("heads")
    return row.select(
        "conv_id", "n_convs", children.alias("n_children"), F.when(children == 0, F.lit(1)).otherwise(F.coalesce("leaves", F.lit(0)) + F.col("ends")).cast("bigint").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved_tokens"),
    )


def conversation_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    base: Column | None = None, taken: Column | None = None,
) -> DataFrame:
    """``prefix_trie`` of a table of turns; ``base`` and ``taken`` as in ``rebuilt_turns``."""
    numbered = numbered_turns(turns, conv_col, turn_col, role_col, text_col)
    return prefix_trie(*(whole_turns(numbered) if base is None else rebuilt_turns(numbered, base, taken)))
