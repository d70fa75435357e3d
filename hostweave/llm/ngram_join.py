"""Near-duplicate documents by word shingles, joined through parity sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.llm.components import components
from hostweave.llm.hashing import SHINGLE, mix64, shingle_hashes, slices
from hostweave.session import cut

PERCENT = 80  # similarity in hundredths
SLICE = 1 << 20  # bytes of text hashed at a time
BATCH = 4 << 20  # bytes of text whose sketch blocks are posted together
OFTEN = 8  # a block that so many sets of a batch hold is posted once for the batch
WORDS = 8  # 64-bit words of the short parity sketch
LEADERS = 8  # members of a block's group that all others are compared with first
BUCKET = 16 << 20  # bytes of posted blocks that meet in one bucket, about
MARK_BITS = 1 << 24  # bits of the table of documents that have a candidate, whatever the input
_U = np.uint64
_BAND = mix64(np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15))


def largest(band: int, percent: int = PERCENT) -> int:
    """The largest set size in a band: sizes from 2**band, and the partners of those below 2**(band + 1)."""
    return -(-(2 << band) * 100 // percent) - 1


def budget(size: int, band: int, percent: int = PERCENT) -> int:
    """The most elements in which a set and any partner in the band can differ."""
    other = min(size * 100 // percent, largest(band, percent))
    return (100 - percent) * (size + other) // (100 + percent)


def n_blocks(band: int, percent: int = PERCENT) -> int:
    """Blocks of a band's sketch: more than any pair in it can differ in, and some to choose from."""
    return max((100 - percent) * 2 * largest(band, percent) // (100 + percent) + 2, (3 << band) // 4 + 1)


def bands_of(size: int, percent: int = PERCENT) -> list[int]:
    """The one or two bands of a set; two sets that can be similar share the smaller one's own band."""
    own = size.bit_length() - 1
    return [own, own - 1] if own and size <= largest(own - 1, percent) else [own]


def sketch_blocks(hashes: np.ndarray, band: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and contents of the blocks of a set's sketch that have an element.

    The sketch is a row of blocks, each very wide; an element flips one bit of one block. A block is
    held as the XOR of a random word for each flipped bit, which equals that of another set exactly
    if the same bits are set. Differing bits, and so differing blocks, are never more than differing
    elements.
    """
    block = ((hashes >> _U(32)) * _U(n_blocks(band, percent))) >> _U(32)
    first = np.flatnonzero(np.diff(block, prepend=_U(2**63)))
    return block[first], np.bitwise_xor.reduceat(mix64(hashes ^ _BAND[band]), first)


def posted_keys(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of all blocks of a set in its bands: hash, a bit for empty blocks, 5 bits of the band.

    Empty blocks come last in the order of keys, and only a set with fewer other blocks than it must
    offer posts some.
    """
    out = []
    for band in bands_of(len(hashes), percent):
        block, content = sketch_blocks(hashes, band, percent)
        out.append(mix64(content ^ (block * _U(0xD6E8FEB86659FD93))) & ~_U(63) | _U(band))
        lacking = budget(len(hashes), band, percent) + 1 - len(block)
        if lacking > 0:
            empty = np.setdiff1d(np.arange(n_blocks(band, percent), dtype=_U), block)
            out.append(np.sort(mix64(empty * _U(0xA0761D6478BD642F) + _BAND[band]) & ~_U(63) | _U(32 + band))[:lacking])
    return np.concatenate(out)


def short_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch of 512 bits."""
    bits = np.bincount((hashes & _U(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def set_id(hashes: np.ndarray) -> int:
    """64-bit name of a set; equal sets have equal names."""
    return int(mix64(np.array([np.bitwise_xor.reduce(mix64(hashes + _BAND[1])) + _U(len(hashes))], _U)).view(np.int64)[0])


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    for a, b in slices([len(t) for t in texts], SLICE):
        yield from shingle_hashes(texts[a:b], SHINGLE)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """id, set_id, n_shingles, and the number of non-empty blocks in the set's bands (own, below)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, own, below = [], [], [], []
            for hashes in _sets(_texts(batch, 1)):
                sizes.append(len(hashes))
                full = [len(sketch_blocks(hashes, b, percent)[0]) for b in bands_of(len(hashes), percent)] if len(hashes) else [0]
                ids.append(set_id(hashes) if len(hashes) else None)
                own.append(full[0]), below.append(full[1] if len(full) > 1 else -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(own, pa.int32()), pa.array(below, pa.int32())],
                ["id", "set_id", "n_shingles", "own", "below"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, set_id bigint, n_shingles bigint, own int, below int")


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """All 64-bit numbers of a column of packed arrays, one after the other."""
    parts = [np.zeros(0, np.int64)]
    for chunk in column.chunks:
        if len(chunk):
            # an offset array of the chunk's own rows, then its stretch of the data
            at = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.int64))
    return np.concatenate(parts)


_POSTED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("sets", pa.binary())])
_COUNTED = "kind int, key bigint, set_id bigint, batch bigint, n bigint, sets array<bigint>"


def post_blocks(docs: DataFrame, text_col: str, buckets: int, percent: int = PERCENT) -> DataFrame:
    """How many sets hold each block, told to those sets: kind, key, set_id, batch, n, sets.

    A row for each (key, set) whose block another set may share (kind 0). Keys are dealt into
    ``buckets``, a shuffle partition for each; a bucket gets packed arrays. A block that many sets of a batch hold goes there as a
    number (kind 1, with the batch's name), and the batch's list of its sets stays in a bucket of the
    batch (kind 2), so a block that a third of all documents hold is spread like any other.
    """
    def post(texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for hashes in _sets(texts):
            if len(hashes):
                name = set_id(hashes)
                if name not in seen:
                    seen[name] = posted_keys(hashes, percent)
        if not seen:
            return
        names = np.fromiter(seen, np.int64, len(seen))
        keys = np.concatenate(list(seen.values()))
        sets = np.repeat(names, [len(k) for k in seen.values()])
        order = np.argsort(keys, kind="stable")
        keys, sets = keys[order], sets[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        counts = np.diff(first, append=len(keys))
        batch = int(np.bitwise_xor.reduce(mix64(names.view(_U))).view(np.int64)) if len(names) else 0
        often = np.repeat(counts >= OFTEN, counts)
        rows: list[tuple] = []
        for kind, k, s in ((0, keys[~often], sets[~often]), (1, keys[first[counts >= OFTEN]], counts[counts >= OFTEN])):
            bucket = (k >> _U(6)) % _U(buckets)
            by = np.argsort(bucket, kind="stable")
            k, s, bucket = k[by], s[by], bucket[by]
            start = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(k)]):
                rows.append((int(bucket[a]), kind, batch, k[a:b].tobytes(), s[a:b].astype(np.int64).tobytes()))
        if often.any():
            rows.append((buckets + batch % buckets, 2, batch, keys[often].tobytes(), sets[often].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _POSTED)], schema=_POSTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        total = 0
        for batch in batches:
            for text in _texts(batch, 0):
                held.append(text)
                total += len(text)
                if total >= BATCH:
                    yield from post(held)
                    held, total = [], 0
        if held:
            yield from post(held)

    def count(table: pa.Table) -> pa.Table:
        out_key, out_batch, lists = [], [], []
        of = lambda kind: table.filter(pc.equal(table["kind"], kind))
        held = of(2)
        for batch, k, s in zip(held["batch"].to_pylist(), held["keys"], held["sets"]):
            keys, sets = np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(s.as_buffer(), np.int64)
            start = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(keys)]):
                out_key.append(keys[a]), out_batch.append(batch), lists.append(sets[a:b])
        n_lists = len(lists)
        single = of(0)
        keys, sets = _numbers(single["keys"]), _numbers(single["sets"])
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
        keys, sets = keys[new], sets[new]
        many = of(1)
        many_keys, many_n = _numbers(many["keys"]), _numbers(many["sets"])
        many_batch = np.repeat(many["batch"].to_numpy(), pc.binary_length(many["keys"]).to_numpy() // 8)
        names, at = np.unique(np.concatenate([keys, many_keys]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.ones(len(keys)), many_n]), len(names)).astype(np.int64)
        n_single = total[at[: len(keys)]]
        shared = n_single > 1
        keys, sets, n_single = keys[shared], sets[shared], n_single[shared]
        n_many = total[at[len(at) - len(many_keys) :]]
        kinds = np.repeat(np.array([2, 0, 1], np.int32), [n_lists, len(keys), len(many_keys)])
        nothing = lambda n: pa.nulls(n, pa.int64())
        return pa.table([
            pa.array(kinds), pa.array(np.concatenate([np.array(out_key, np.int64), keys, many_keys])),
            pa.concat_arrays([nothing(n_lists), pa.array(sets), nothing(len(many_keys))]),
            pa.concat_arrays([pa.array(out_batch, pa.int64()), nothing(len(keys)), pa.array(many_batch)]),
            pa.concat_arrays([nothing(n_lists), pa.array(n_single), pa.array(n_many)]),
            pa.array([*(x.tolist() for x in lists), *[None] * (len(keys) + len(many_keys))], pa.list_(pa.int64())),
        ], ["kind", "key", "set_id", "batch", "n", "sets"])

    posted = docs.select(text_col).mapInArrow(run, "bucket int, kind int, batch bigint, keys binary, sets binary")
    return posted.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(count, _COUNTED)


def n_buckets(sets: DataFrame) -> int:
    """Buckets for the blocks of ``sets`` (own, below; one row per text): as many as their bytes ask for.

    A block is posted with its set, in 16 bytes. Sets without enough blocks of their own also post
    empty ones, at most as many as the rest again for all but the smallest sets.
    """
    blocks = sets.agg(F.sum(F.col("own") + F.greatest("below", F.lit(0))).alias("n")).first()["n"] or 0
    return max(1, -(-16 * blocks // BUCKET))


def _two_to(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)


def offered_blocks(counted: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, set_id: the blocks in which a set looks for partners.

    A pair that differs in at most d elements agrees in all but d blocks. Each set offers the first
    ``budget + 1`` of its blocks in one order for all sets, the rarest first; of the blocks in which
    a pair agrees the first one then is offered by both. Blocks that one set alone holds come first
    and find nobody, so most sets offer nothing here.
    """
    single = counted.filter("kind = 0").select("set_id", "key", "n")
    lists = counted.filter("kind = 2").select("batch", "key", "sets")
    many = counted.filter("kind = 1").select("batch", "key", "n").join(lists, ["batch", "key"])
    told = single.unionByName(many.select(F.explode("sets").alias("set_id"), "key", "n"))
    told = told.repartition("set_id").dropDuplicates(["set_id", "key"])
    told = told.withColumn("band", F.col("key").bitwiseAND(F.lit(31)).cast("int"))
    told = told.withColumn("empty", F.col("key").bitwiseAND(F.lit(32)) > 0)
    size = F.col("n_shingles")
    band_top = F.ceil(_two_to(F.col("band") + 1) * 100 / F.lit(percent)) - 1
    d = F.floor((100 - percent) * (size + F.least(F.floor(size * 100 / F.lit(percent)), band_top)) / F.lit(100 + percent))
    rows = told.join(sets.select("set_id", "n_shingles", "own", "below"), "set_id")
    here = F.when(_two_to(F.col("band") + 1) > size, F.col("own")).otherwise(F.col("below"))
    band = Window.partitionBy("set_id", "band")
    rows = rows.withColumn("shared", F.sum(F.when(F.col("empty"), 0).otherwise(1)).over(band))
    rows = rows.withColumn("place", F.row_number().over(band.orderBy("empty", "n", "key")))
    return rows.filter(F.col("place") <= d + 1 - (here - F.col("shared"))).select("key", "set_id")


def marked_sets(docs: DataFrame, text_col: str, marks: np.ndarray) -> DataFrame:
    """set_id, n, s0..s7 (short sketch) and elements of the sets whose mark is set."""
    fields = "set_id bigint, n bigint, " + ", ".join(f"s{i} bigint" for i in range(WORDS)) + ", elements binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], {}
            for hashes in _sets(_texts(batch, 0)):
                if len(hashes):
                    name = set_id(hashes)
                    bit = _mark(name)
                    if marks[bit >> 6] >> _U(bit & 63) & _U(1):
                        found[name] = hashes
            names = list(found)
            sketches = [short_sketch(found[x]) for x in names]
            columns = [pa.array(names, pa.int64()), pa.array([len(found[x]) for x in names], pa.int64())]
            columns += [pa.array([int(s[i]) for s in sketches], pa.int64()) for i in range(WORDS)]
            columns += [pa.array([found[x].tobytes() for x in names], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["set_id", "n", *[f"s{i}" for i in range(WORDS)], "elements"])

    return docs.select(text_col).mapInArrow(run, fields)


def _mark(name: int) -> int:
    return (name >> 7) & (MARK_BITS - 1)


def _close(a: str, b: str, percent: int) -> Column:
    """Sizes and short sketches leave the pair possible."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.lit(0)
    for i in range(WORDS):
        apart = apart + F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")))
    return (n * percent <= m * 100) & (m * percent <= n * 100) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by comparing all elements."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    elements = sets.select("set_id", "elements")
    joined = pairs.join(elements.withColumnRenamed("set_id", "a").withColumnRenamed("elements", "x"), "a")
    joined = joined.join(elements.withColumnRenamed("set_id", "b").withColumnRenamed("elements", "y"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def similar_links(offered: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between sets whose components are those of all links.

    First every member of a block's group is compared with at most ``LEADERS`` of them, the smallest
    by hash in each of as many classes, so a group of n needs a multiple of n comparisons. Then, in
    each group, only the members outside the component that most of its members are in are compared
    with all that they are not yet in one component with: members of that component need no further
    link among each other, so no link between different components is lost.
    """
    columns = ["set_id", "n", *[f"s{i}" for i in range(WORDS)]]
    members = cut(offered.join(sets.select(*columns), "set_id"), "members")
    small = members.select("key", *columns)
    spread = F.xxhash64("set_id")
    heads = members.groupBy("key", F.pmod(spread, F.lit(LEADERS)).alias("class")).agg(
        F.min_by(F.struct(*columns), spread).alias("head"), F.count(F.lit(1)).alias("c"),
    )
    heads = heads.select("key", "head.*")
    one, two = small.alias("x"), heads.alias("y")
    pairs = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.set_id") != F.col("y.set_id")) & _close("x", "y", percent))
    pairs = pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()
    pairs = cut(pairs, "leader-pairs")
    links = cut(verify_pairs(pairs, sets, percent), "leader-links")
    joined = members.select("key", *columns).join(
        components(links).select(F.col("node").alias("set_id"), "component"), "set_id", "left",
    ).withColumn("component", F.coalesce("component", "set_id"))
    joined = cut(joined, "grouped-members")
    most = joined.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
        F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("total"),
    ).filter("m.c < total").select("key", F.col("m.component").alias("main"))
    split = joined.join(most, "key")
    outside, everyone = split.filter("component != main").alias("x"), split.alias("y")
    more = outside.join(everyone, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & _close("x", "y", percent))
    more = more.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()
    more = cut(more.join(pairs, ["a", "b"], "left_anti"), "outside-pairs")
    return links.unionByName(cut(verify_pairs(more, sets, percent), "outside-links"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Two documents link when their sets of five-word shingles have a Jaccard similarity of at least
    ``percent`` hundredths; component_id is the smallest id that links reach. Equal sets are one node,
    so copies cost nothing beyond their own row. Sets are compared through parity sketches in bands
    of sizes (``sketch_blocks``): pairs that may be similar share an offered block, pass the size and
    512-bit sketch tests and are verified on all elements. Shingles are 64-bit hashes, and so are the
    names of sets.

    Texts are read three times and never shuffled; what is shuffled is 16 bytes per sketch block, and
    the elements of sets that have a candidate. Which those are goes to the tasks as a table of 2 MB
    at any size of input; false marks cost work only.

    Cases: null and empty texts have no shingles and link with nothing (component_id is the id); fewer
    than five words are one shingle; a repeated row is in the component of its copies; a null id keeps
    its row, and component_id is null only if all ids of its component are; an empty table gives no
    rows; other columns are not looked at.
    """
    rows = cut(shingle_sets(docs, id_col, text_col, percent), "shingle-sets")
    known = rows.filter("set_id is not null").groupBy("set_id").agg(
        F.min("id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("own").alias("own"), F.first("below").alias("below"),
    )
    known = cut(known, "known-sets")
    counted = cut(post_blocks(docs, text_col, n_buckets(rows), percent), "blocks")
    offered = cut(offered_blocks(counted, known, percent), "offered")
    shared = offered.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    offered = cut(offered.join(shared.select("key"), "key", "left_semi"), "offered")
    place = F.shiftright("set_id", 7).bitwiseAND(F.lit(MARK_BITS - 1))
    words = offered.select(F.shiftright(place, 6).alias("w"), _two_to(place.bitwiseAND(F.lit(63)).cast("int")).alias("m"))
    marks = np.zeros(MARK_BITS // 64, _U)
    for r in words.groupBy("w").agg(F.bit_or("m").alias("m")).toLocalIterator():
        marks[r["w"]] = r["m"] & (2**64 - 1)
    sets = cut(marked_sets(docs, text_col, marks).dropDuplicates(["set_id"]), "sets")
    found = components(similar_links(offered, sets, percent)).withColumnRenamed("node", "set_id")
    classes = known.join(found, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    named = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = classes.join(named, "component").select("set_id", "component_id")
    with_set = rows.filter("set_id is not null").join(named, "set_id").select("id", "n_shingles", "component_id")
    without = rows.filter("set_id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return with_set.unionByName(without).withColumnRenamed("id", id_col)
