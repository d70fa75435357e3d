"""Document fingerprints by one-permutation MinHash with optimal densification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hostweave.llm.hashing import mix64, shingle_hashes, slices
from hostweave.session import cut

BINS = 128  # a power of two; one byte is kept for each
SLICE = 1 << 20  # bytes of text hashed at a time
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(7102014))
_LANE = _rng.integers(1, 2**63, BINS, dtype=np.int64).astype(_U)
_PROBES = _rng.integers(0, BINS, (4096, BINS))  # attempt, bin -> bin asked next


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bytes for a set of 64-bit shingle hashes, sorted; no bytes for an empty set.

    The top bits of a hash choose its bin, and a bin keeps its smallest hash. An empty bin asks other
    bins in a fixed pseudo-random order of its own until it meets a full one, and takes that one's
    hash. Of each bin's hash, scrambled with the bin's number, the low byte is kept.
    """
    if not len(hashes):
        return b""
    shift = _U(64 - (BINS.bit_length() - 1))
    bins = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    least, full = np.zeros(BINS, _U), np.zeros(BINS, bool)
    least[bins[first]] = hashes[first]
    full[bins[first]] = True
    missing, donor, attempt = np.flatnonzero(~full), np.arange(BINS), 0
    while len(missing):
        if attempt < len(_PROBES):
            asked = _PROBES[attempt, missing]
        else:  # practically never: the nearest full bin to the right
            asked = (missing + attempt - len(_PROBES) + 1) % BINS
        found = full[asked]
        donor[missing[found]] = asked[found]
        missing = missing[~found]
        attempt += 1
    return (mix64(least[donor] ^ _LANE) & _U(255)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    Bytes of different hashes agree with chance 1/256; that share is taken out. Two empty sets are
    alike (1.0), an empty and another one are not (0.0).
    """
    if not a or not b:
        return 1.0 if a == b else 0.0
    share = float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))
    return min(1.0, max(0.0, (share - 1 / 256) / (1 - 1 / 256)))


def fingerprints(texts: list[bytes]) -> list[bytes]:
    out: list[bytes] = []
    for a, b in slices([len(t) for t in texts], SLICE):
        out.extend(map(fingerprint, shingle_hashes(texts[a:b])))
    return out


def add_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` and a column with the fingerprint of each text in hexadecimal; equal texts get equal
    fingerprints, null and empty texts the empty string. No shuffle."""
    place = docs.columns.index(text_col)
    # one column of whole rows, as names with backticks cannot be passed one by one
    rows = docs.select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints([t or b"" for t in batch.column(0).field(place).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.hex() for p in prints], pa.string())], ["row", "print"])

    found = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("print", StringType())]))
    return found.select("row.*", F.col("print").alias(name))


_ROW = "id {t}, n_chars bigint, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], nexts: list[str], id_type) -> list[pa.Array]:
    """The result columns of some documents and the documents that follow them."""
    edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
    coded = [t.encode() for t in edited]
    own, other, after = fingerprints([t.encode() for t in texts]), fingerprints(coded), fingerprints([x.encode() for x in nexts[-1:]])
    following = [*own[1:], *after]
    return [
        pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in coded]),
        pa.array(own, pa.binary()), pa.array(other, pa.binary()), pa.array(map(likeness, own, other), pa.float64()),
        pa.array(map(likeness, own, following), pa.float64()),
    ]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text is the text with its last half (rounded down) replaced by as many first
    characters of the next document in order of the id, after the last one of the first. Result: id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The documents are range-partitioned by (id, text hash) and sorted, so a document's successor is
    the next row of the task. A task leaves its first and its last document aside with their texts;
    a second, small step pairs each last one with the first of the next task that has rows. Texts are
    shuffled once, and a task holds one slice of texts at a time.

    Cases: a null text counts as empty; null ids come first; rows with equal ids are put in order by
    a hash of their text; a single document follows itself; an empty table gives no rows; other
    columns are not looked at.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    schema = _ROW.format(t=id_type) + ", task int, edge int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, names, kind = TaskContext.get().partitionId(), [], None

        def edge(which: int, i, t: str) -> pa.RecordBatch:
            blank = [pa.array([None], a) for a in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            columns = [pa.array([i], kind), *blank, pa.array([task], pa.int32()), pa.array([which], pa.int32()), pa.array([t])]
            return pa.RecordBatch.from_arrays(columns, names)

        waiting: list[tuple] = []
        for batch in batches:
            names, kind = ["id", "n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next", "task", "edge", "text"], batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if ids and not waiting:
                yield edge(1, ids[0], texts[0])
            ids, texts = [*(w[0] for w in waiting), *ids], [*(w[1] for w in waiting), *texts]
            for a, b in slices([len(t) for t in texts[:-1]], SLICE):
                n = b - a
                columns = _rows(ids[a:b], texts[a:b], texts[a + 1 : b + 1], kind)
                columns += [pa.array([task] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)
            waiting = [(ids[-1], texts[-1])] if ids else waiting
        if waiting:
            yield edge(2, *waiting[0])

    done = cut(ordered.mapInArrow(run, schema), "fingerprints")
    edges = done.filter("edge > 0").select("id", "task", "edge", "text")
    # one row for each task that had documents
    tasks = Window.orderBy("task")
    follow = edges.filter("edge = 1").select(
        "task", F.coalesce(F.lead("task").over(tasks), F.first("task").over(tasks)).alias("next_task"),
    )
    firsts = edges.filter("edge = 1").select(F.col("task").alias("next_task"), F.col("text").alias("next_text"))
    pairs = edges.filter("edge = 2").join(follow, "task").join(firsts, "next_task").select("id", "text", "next_text")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, x in zip(*(c.to_pylist() for c in batch.columns)):
                columns = _rows([i], [t], [x], batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next"])

    whole = done.filter("edge = 0").drop("task", "edge", "text").unionByName(pairs.mapInArrow(last, _ROW.format(t=id_type)))
    return whole.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
