"""Repeated passages, found with suffix arrays built by two-stage sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from hostweave.llm.hashing import mix64, powers, slices
from hostweave.session import cut

LENGTH = 100  # bytes of a passage
GRAM = 48  # bytes of an anchor, a multiple of 8
BATCH = 4 << 20  # bytes of text posted together
SLICE = 1 << 19  # bytes of text anchored at a time, so that the arrays stay in the cache
OFTEN = 32  # an anchor with so many different regions in a batch is dealt by region
PART = 4096  # regions of one anchor that are sorted together
MARK_BITS = 1 << 24  # bits of the table of marked documents, whatever the input
BUCKET = 8 << 20  # bytes of text whose regions meet in one bucket, on average
_U = np.uint64
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_inverse_powers = np.ones(1, _U)


# --- suffix arrays -----------------------------------------------------------------------------


def words_at(data: np.ndarray, padded: int) -> np.ndarray:
    """For each position the next eight bytes as one big-endian number; zeros follow the data."""
    wide = np.zeros(len(data) + padded + 8, np.uint8)
    wide[: len(data)] = data
    out = np.zeros(len(data) + padded, _U)
    for j in range(8):
        out = (out << _U(8)) | wide[j : j + len(out)].astype(_U)
    return out


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than the one that follows it."""
    if not len(data):
        return np.zeros(0, bool)
    change = np.flatnonzero(data[1:] != data[:-1])
    rises = data[change + 1] > data[change]
    # a run of equal bytes is like its last byte; the last run is larger than the empty suffix
    ends = np.append(change, len(data) - 1)
    return np.repeat(np.append(rises, False), np.diff(ends, prepend=-1))


def suffix_array(data: np.ndarray, depth: int | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """Positions of the suffixes of ``data`` (bytes) in order, by two-stage sorting.

    First stage: only suffixes smaller than their successor are sorted directly, eight bytes at a
    time within groups that are still equal. Second stage: buckets of equal first bytes are scanned
    from the left; the suffix before each scanned one, if it is larger than its successor, goes to
    the next free place of its own bucket. With ``depth`` the order is right for so many first bytes.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    depth = min(depth or n, n)
    if words is None:
        words = words_at(data, 8 * (-(-depth // 8) + 1))
    small = smaller_than_next(data)
    direct = np.flatnonzero(small)
    direct = direct[np.argsort(words[direct], kind="stable")]
    active = np.arange(len(direct))
    group = _groups(words[direct], np.zeros(len(direct), np.int64))
    for at in range(8, depth, 8):
        sizes = np.bincount(group, minlength=1)
        tied = sizes[group] > 1
        active, group = active[tied], group[tied]
        if not len(active):
            break
        rows = direct[active]
        keys = words[np.minimum(rows + at, len(words) - 1)]
        order = np.lexsort((keys, group))
        direct[active] = rows[order]
        group = _groups(keys[order], group)
    return _induce(data, small, direct)


def _groups(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Numbers of runs of equal (group, key), both sorted."""
    if not len(keys):
        return group
    new = np.zeros(len(keys), np.int64)
    new[1:] = (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])
    return np.cumsum(new)


def _induce(data: np.ndarray, small: np.ndarray, direct: np.ndarray) -> np.ndarray:
    """The whole array from its sorted smaller-than-next part, bucket by bucket."""
    n = len(data)
    out = np.empty(n, np.int64)
    counts = np.bincount(data, minlength=256)
    begin = np.cumsum(counts) - counts
    free = begin.copy()  # where the next larger-than-next suffix of a bucket goes
    firsts = data[direct]
    split = np.searchsorted(firsts, np.arange(257))

    def scan(suffixes: np.ndarray, byte: int) -> np.ndarray:
        """Place what stands before the scanned suffixes; return what fell into the same bucket."""
        before = suffixes[suffixes > 0] - 1
        before = before[~small[before]]
        heads = data[before]
        same = before[heads == byte]
        later, heads = before[heads != byte], heads[heads != byte]
        order = np.argsort(heads, kind="stable")
        later, heads = later[order], heads[order]
        sizes = np.bincount(heads, minlength=256)
        within = np.arange(len(later)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[free[heads] + within] = later
        np.add(free, sizes, out=free)
        return same

    # the last suffix is followed by the empty one, the smallest of all
    last = n - 1
    out[free[data[last]]] = last
    free[data[last]] += 1
    for byte in np.flatnonzero(counts).tolist():
        at = int(begin[byte])
        while at < free[byte]:
            wave = out[at : int(free[byte])].copy()
            at = int(free[byte])
            same = scan(wave, byte)
            out[at : at + len(same)] = same
            free[byte] += len(same)
        own = direct[split[byte] : split[byte + 1]]
        out[at : at + len(own)] = own
        scan(own, byte)
    return out


def common_prefixes(order: np.ndarray, words: np.ndarray, limit: int) -> np.ndarray:
    """Whether each suffix in order shares its first ``limit`` bytes with the one before it."""
    equal = np.ones(len(order), bool)
    equal[:1] = False
    left = np.flatnonzero(equal)
    for at in [*range(0, limit - 7, 8), *([limit - 8] if limit % 8 else [])]:
        left = left[words[order[left] + at] == words[order[left - 1] + at]]
    equal[:] = False
    equal[left] = True
    return equal


# --- anchors -----------------------------------------------------------------------------------


def _inverse(at: np.ndarray) -> np.ndarray:
    global _inverse_powers
    need = int(at.max()) + 1 if len(at) else 1
    if len(_inverse_powers) < need:
        size = max(need, 2 * len(_inverse_powers))
        _inverse_powers = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, _INVERSE)]))
    return _inverse_powers[at]


def text_regions(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Regions of all windows of ``length`` bytes: text number, start, windows, anchor, content hash.

    The anchor of a window is the gram in it with the least hash, the leftmost of equals, so equal
    windows have equal anchors at equal places. Neighbouring windows with one anchor are a region; it
    holds the bytes of them all. The same window never stands twice in one region.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.view(_U), empty.view(_U)
    w8 = words_at(data, gram)
    m = len(data) - gram + 1
    hashes = np.zeros(m, _U)
    for j in range(0, gram, 8):
        hashes = mix64(hashes + w8[j : j + m] * _U(0xD6E8FEB86659FD93))
    least = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(m, dtype=_U)
    span, step = length - gram + 1, 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(data) - length + 1], least[span - step : span - step + len(data) - length + 1])
    anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= (begins + sizes)[text]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return empty, empty, empty, empty.view(_U), empty.view(_U)
    anchor, text = anchor[starts], text[starts]
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    windows = np.diff(first, append=len(starts))
    begin = starts[first]
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(data.astype(_U) + _U(1)) * powers(len(data)), dtype=_U)])
    end = begin + windows + length - 1
    content = mix64((total[end] - total[begin]) * _inverse(begin) + (windows.astype(_U) << _U(40)))
    return text[first], begin - begins[text[first]], windows, hashes[anchor[first]], content


def _names(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


_POSTED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("anchors", pa.binary()), ("contents", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("windows", pa.binary())])
_FOUND = "kind int, anchor bigint, part bigint, id bigint, start int, windows int"


def matched_regions(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds over ``docs`` (id, text): kind, anchor, part, id, start, windows.

    Kind 0: all windows of the region stand earlier, in an equal region. Kind 1: the first of equal
    regions, whose anchor other regions have too; it must be sorted with them. part is -1 if all
    regions of the anchor are sorted together, else the part it is sorted in.

    A batch posts each region once, for its first place. Regions are dealt by anchor; an anchor that
    has many regions in a batch is dealt by content instead, with a note to the anchor's bucket, so a
    passage that a third of all documents have is spread like any other.
    """
    def post(ids: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = []
        for a, b in slices([len(t) for t in texts], SLICE):
            text, *rest = text_regions(texts[a:b])
            found.append((text + a, *rest))
        text, start, windows, anchor, content = (np.concatenate(x) for x in zip(*found))
        if not len(text):
            return
        owner = np.array(ids, np.int64)[text]
        order = np.lexsort((start, owner, content, anchor))
        owner, start, windows, anchor, content = owner[order], start[order], windows[order], anchor[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        # equal places of rows with equal ids: none is earlier
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        again = ~new & ((owner != owner[lead]) | (start != start[lead]))
        rows = []
        if again.any():
            # by a text's own number, so that long runs of copies spread
            where = (mix64(owner[again].view(_U)) % _U(buckets)).astype(np.int64)
            rows.extend(_dealt(where, 3, anchor[again], content[again], owner[again], start[again], windows[again]))
        owner, start, windows, anchor, content = owner[new], start[new], windows[new], anchor[new], content[new]
        first = np.flatnonzero(np.diff(anchor, prepend=~anchor[:1]))
        counts = np.diff(first, append=len(anchor))
        often = np.repeat(counts >= OFTEN, counts)
        where = np.where(often, mix64(content ^ anchor) % _U(buckets), anchor % _U(buckets)).astype(np.int64)
        for kind, pick in ((0, ~often), (1, often)):
            rows.extend(_dealt(where[pick], kind, anchor[pick], content[pick], owner[pick], start[pick], windows[pick]))
        noted = anchor[first[counts >= OFTEN]]
        none = np.zeros(len(noted), np.int64)
        rows.extend(_dealt((noted % _U(buckets)).astype(np.int64), 2, noted, none.view(_U), none, none, none))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _POSTED)], schema=_POSTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(i), texts.append(t)
                total += len(t)
                if total >= BATCH:
                    yield from post(ids, texts)
                    ids, texts, total = [], [], 0
        if ids:
            yield from post(ids, texts)

    def match(table: pa.Table) -> pa.Table:
        def column(kind: int, name: str, dtype) -> np.ndarray:
            return np.frombuffer(b"".join(r[name] for r in rows if r["kind"] == kind), dtype)

        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        parts = []
        for kind in (0, 1):
            parts.append([column(kind, n, d) for n, d in (("anchors", _U), ("contents", _U), ("ids", np.int64), ("starts", np.int32), ("windows", np.int32))])
        anchor, content, owner, start, windows = (np.concatenate(p) for p in zip(*parts))
        spread = np.repeat([False, True], [len(parts[0][0]), len(parts[1][0])])
        order = np.lexsort((start, owner, content, anchor, spread))
        anchor, content, owner, start, windows, spread = (x[order] for x in (anchor, content, owner, start, windows, spread))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (spread[1:] != spread[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
        again = ~new & ((owner != owner[lead]) | (start != start[lead]))
        noted = np.unique(column(2, "anchors", _U))
        f_anchor, f_owner, f_start, f_windows, f_spread = (x[new] for x in (anchor, owner, start, windows, spread))
        first = np.flatnonzero((np.diff(f_anchor, prepend=~f_anchor[:1]) != 0) | (np.diff(f_spread.astype(np.int8), prepend=-1) != 0))
        counts = np.diff(first, append=len(f_anchor))
        within = np.arange(len(f_anchor)) - np.repeat(first, counts)
        known = f_spread | np.isin(f_anchor, noted)
        many = np.repeat(counts > PART, counts)
        part = np.where(f_spread, (1 << 32) + bucket * (1 << 20) + within // PART, np.where(known | many, within // PART, -1))
        need = known | np.repeat(counts > 1, counts)
        out = [np.concatenate(x) for x in (
            (np.zeros(int(again.sum()), np.int32), np.ones(int(need.sum()), np.int32), np.zeros(len(column(3, "ids", np.int64)), np.int32)),
            (_names(anchor[again]), _names(f_anchor[need]), column(3, "anchors", np.int64)),
            (np.full(int(again.sum()), -1), part[need], np.full(len(column(3, "ids", np.int64)), -1)),
            (owner[again], f_owner[need], column(3, "ids", np.int64)),
            (start[again], f_start[need], column(3, "starts", np.int32)),
            (windows[again], f_windows[need], column(3, "windows", np.int32)),
        )]
        return pa.table([pa.array(x) for x in out], ["kind", "anchor", "part", "id", "start", "windows"])

    posted = docs.select("id", "text").mapInArrow(run, "bucket int, kind int, anchors binary, contents binary, ids binary, starts binary, windows binary")
    return posted.groupBy("bucket").applyInArrow(match, _FOUND)


def _dealt(bucket: np.ndarray, kind: int, anchor, content, owner, start, windows) -> Iterator[tuple]:
    """Packed rows of one kind, one for each bucket."""
    by = np.argsort(bucket, kind="stable")
    bucket, anchor, content, owner, start, windows = (x[by] for x in (bucket, anchor, content, owner, start, windows))
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)]):
        yield (
            int(bucket[a]), kind, anchor[a:b].tobytes(), content[a:b].tobytes(), owner[a:b].astype(np.int64).tobytes(),
            start[a:b].astype(np.int32).tobytes(), windows[a:b].astype(np.int32).tobytes(),
        )


# --- sorting of regions ------------------------------------------------------------------------


def repeated_windows(texts: list[bytes], ids: np.ndarray, starts: np.ndarray, split: np.ndarray, length: int = LENGTH):
    """Windows of some regions that stand earlier in another of them, and first windows of split ones.

    Returns (id, start) of the repeated windows, and (id, start, two hashes) of the first of each
    class of equal windows that has a region of a split anchor.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begins = np.cumsum(sizes) - sizes
    words = words_at(data, 8 * (-(-length // 8) + 2))
    order = suffix_array(data, length, words)
    region = np.repeat(np.arange(len(texts)), sizes)
    order = order[order - begins[region[order]] + length < sizes[region[order]]]
    equal = common_prefixes(order, words, length)
    kind = np.cumsum(~equal)
    r = region[order]
    at = starts[r] + order - begins[r]
    by = np.lexsort((at, ids[r], kind))
    order, r, kind, at = order[by], r[by], kind[by], at[by]
    new = np.diff(kind, prepend=0) != 0
    lead = np.maximum.accumulate(np.where(new, np.arange(len(kind)), 0)) if len(kind) else np.zeros(0, np.int64)
    again = ~new & ((ids[r] != ids[r[lead]]) | (at != at[lead]))
    whole = np.zeros(len(kind) + 1, bool)
    whole[kind[split[r]]] = True
    first = np.flatnonzero(new & whole[kind])
    one, two = np.zeros(len(first), _U), np.zeros(len(first), _U)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        w = words[order[first] + k]
        one, two = mix64(one * _U(3) + w), mix64(two * _U(5) ^ w)
    return ids[r[again]], at[again], ids[r[first]], at[first], _names(one), _names(two)


def _flat(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and fields of the structs in a column of lists."""
    flat = pc.list_flatten(lists)
    fields = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]
    return pc.list_parent_indices(lists).to_numpy(), fields


def _runs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts of one document as (id, start, windows)."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    first = np.flatnonzero((np.diff(ids, prepend=~ids[:1]) != 0) | (np.diff(starts, prepend=-9) != 1))
    return ids[first], starts[first], np.diff(first, append=len(ids))


def sorted_regions(found: DataFrame, docs: DataFrame, groups: int) -> DataFrame:
    """kind, id, start, windows, one, two: repeated windows (0) and first windows of split anchors (1).

    The regions of kind 1 in ``found`` get their bytes from ``docs``, a document's regions together;
    then the regions of an anchor, or of a part of it, meet in one task and are suffix-sorted.
    """
    need = found.filter("kind = 1").select("id", F.struct("anchor", "part", "start", "windows").alias("r"))
    wanted = need.groupBy("id").agg(F.collect_list("r").alias("regions"))
    texts = marked(docs, need.select("id")).join(wanted, "id")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows, (anchor, part, start, windows) = _flat(batch.column(2))
            where = (mix64(anchor.view(_U) + mix64(part.view(_U))) % _U(groups)).astype(np.int32)
            ids = batch.column(0).to_numpy()[rows]
            ends = start + windows + LENGTH - 1
            for a in range(0, len(rows), 20_000):
                z = slice(a, a + 20_000)
                pieces = [texts[r][x:y] for r, x, y in zip(rows[z].tolist(), start[z].tolist(), ends[z].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[z]), pa.array(ids[z]), pa.array(start[z].astype(np.int32)), pa.array(part[z] >= 0), pa.array(pieces, pa.binary())],
                    ["group", "id", "start", "split", "bytes"],
                )

    def sort(table: pa.Table) -> pa.Table:
        ids, at, f_ids, f_at, one, two = repeated_windows(
            table["bytes"].to_pylist(), table["id"].to_numpy(), table["start"].to_numpy().astype(np.int64), table["split"].to_numpy(),
        )
        ids, at, windows = _runs(ids, at)
        n, m = len(ids), len(f_ids)
        return pa.table([
            pa.array(np.repeat(np.array([0, 1], np.int32), [n, m])), pa.array(np.concatenate([ids, f_ids])), pa.array(np.concatenate([at, f_at]).astype(np.int32)),
            pa.array(np.concatenate([windows, np.ones(m, np.int64)]).astype(np.int32)),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(one)]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(two)]),
        ], ["kind", "id", "start", "windows", "one", "two"])

    pieces = texts.select("id", "text", "regions").mapInArrow(fetch, "group int, id bigint, start int, split boolean, bytes binary")
    return pieces.groupBy("group").applyInArrow(sort, "kind int, id bigint, start int, windows int, one bigint, two bigint")


def _mark_place(column: str):
    return F.xxhash64(column).bitwiseAND(F.lit(MARK_BITS - 1))


def marked(docs: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``docs`` that may have their id in ``ids``, or (``inside=False``) surely have not.

    A table of 2 MB at any size of input tells most other rows before their text is shuffled; at a
    size where it is full, all texts are. It never decides a result: the rows are joined after it.
    """
    place = _mark_place("id")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = ids.select(F.shiftright(place, 6).alias("w"), bit.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    table = np.zeros(MARK_BITS // 64, _U)
    for r in words.toLocalIterator():
        table[r["w"]] = r["m"] & (2**64 - 1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _place bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            hit = (table[at >> 6] >> (at & 63).astype(_U)) & _U(1)
            yield batch.filter(pa.array((hit == 1) == inside))

    return docs.withColumn("_place", place).mapInArrow(run, schema).drop("_place")


# --- the operator ------------------------------------------------------------------------------


_RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<begin: int, end: int>>"


def merged_spans(rows: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Row, begin and end of the maximal runs of bytes that some windows cover; rows below 2**23."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order].astype(np.int64), starts[order].astype(np.int64) + windows[order] + length - 1
    reach = np.maximum.accumulate((rows << 40) + ends)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] << 40) + starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1 if len(first) else first
    return rows[first], starts[first], reach[last] - (rows[last] << 40)


def bucket_count(text_bytes: int) -> int:
    """Buckets for so many bytes of text: their size does not depend on the input, nor on any setting."""
    return max(2, -(-text_bytes // BUCKET))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if it is covered by a string of 100 bytes that also starts earlier: in a document with
    a smaller id, or earlier in the same one. Strings are judged on the input and lie in one document.

    Every window of 100 bytes belongs to the region of its anchor (``text_regions``), so all windows of
    the corpus are searched. Equal regions need no sorting: all but the first repeat. Different regions
    with one anchor are suffix-sorted by two-stage sorting, and neighbours that share 100 bytes are
    equal windows. An anchor with very many regions is sorted in parts; the first window of each class
    of a part is then compared with those of the other parts by two 64-bit hashes.

    Cases: a null text counts as empty; ids must be whole numbers; if ids are null or repeated, the
    rows are put in order by (id, nulls first, hash of the text), and each row counts as a document of
    its own, so of repeated rows the later ones lose their text; an empty table gives no rows; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # 8 bytes a row; partial counts first
    counted = rows.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("text")).alias("bytes"))
    counted = counted.agg(F.max("c").alias("most"), F.count_if(F.col("id").isNull()).alias("nulls"), F.sum("bytes").alias("bytes")).head()
    own = (counted["most"] or 0) > 1 or counted["nulls"] > 0
    if own:
        ordered = rows.withColumn("tie", F.xxhash64("text")).orderBy(F.col("id").asc_nulls_first(), "tie")
        numbered = cut(ordered.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "numbered")
        rows = numbered.select(F.col("row").alias("id"), "text")
    parts = bucket_count(counted["bytes"] or 0)
    found = cut(matched_regions(rows, parts), "matched-regions")
    sorted_ = cut(sorted_regions(found, rows, 4 * parts), "sorted-regions")
    same = Window.partitionBy("one", "two").orderBy("id", "start")
    later = sorted_.filter("kind = 1").withColumn("first", F.first(F.struct("id", "start")).over(same))
    later = later.filter(F.struct("id", "start") != F.col("first"))
    runs = found.filter("kind = 0").select("id", "start", "windows").unionByName(
        sorted_.filter("kind = 0").select("id", "start", "windows"),
    ).unionByName(later.select("id", "start", "windows"))
    by_document = cut(runs.groupBy("id").agg(F.collect_list(F.struct("start", "windows")).alias("runs")), "runs")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(1).cast(pa.binary()).to_pylist(), batch.num_rows
            row, (start, windows) = _flat(batch.column(2))
            row, begin, end = merged_spans(row.astype(np.int64), start, windows)
            gone = np.bincount(row, end - begin, n).astype(np.int64)
            at = np.searchsorted(row, np.arange(n + 1))
            begins, ends, kept = begin.tolist(), end.tolist(), []
            for i, text in enumerate(texts):
                a, b = int(at[i]), int(at[i + 1])
                if a < b:
                    text = b"".join([text[: begins[a]], *(text[x:y] for x, y in zip(ends[a : b - 1], begins[a + 1 : b])), text[ends[b - 1] :]])
                kept.append(hashlib.sha256(text).hexdigest())
            spans = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["begin", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone), pa.array(np.diff(at).astype(np.int64)), pa.array(kept),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    changed = marked(rows, by_document.select("id")).join(by_document, "id", "left").select("id", "text", "runs")
    untouched = marked(rows, by_document.select("id"), inside=False)
    untouched = untouched.withColumn("runs", F.lit(None).cast("array<struct<start: int, windows: int>>"))
    result = changed.unionByName(untouched).mapInArrow(finish, _RESULT)
    if own:
        back = numbered.select(F.col("row").alias("id"), F.col("id").alias("own_id"))
        result = result.join(back, "id").drop("id").withColumnRenamed("own_id", "id")
    return result.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
