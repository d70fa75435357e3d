"""Packing of tokenised documents into sequences by vector best fit."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostweave.llm.token_count import KEPT, LONG, PartEncoder
from hostweave.session import cut

END_ID = b"\0\0\0\0"
GROUP = 20_000  # pieces that one task packs together
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


class WordIds(dict):
    """Token ids of a piece of text without ASCII white space, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.encoder = PartEncoder(path)
        self.packed = [struct.pack("<I", i) for i in range(self.encoder.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.merged: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        parts = self.encoder.parts(text)
        if parts is None:
            ids = np.array(self.encoder.encode(text), "<u4").tobytes()
        else:
            ids = b"".join(map(self._merge, parts))
        if len(word) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids

    def _merge(self, part: str) -> bytes:
        ids = self.merged.get(part)
        if ids is None:
            ids = b"".join(map(self.packed.__getitem__, self.encoder.merge(part)))
            if len(part) <= LONG:
                if len(self.merged) >= KEPT // 2:
                    self.merged.clear()
                self.merged[part] = ids
        return ids


_encoders: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: id, piece, start, length, ids_crc32.

    A document is the ids of its text and then id 0; only a longer one than ``capacity`` is cut, into
    pieces of that length, the last of which may be shorter. A null text counts as empty.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = WordIds(vocabulary)
        ids_of, step = _encoders[vocabulary].__getitem__, 4 * capacity
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = b"".join(map(ids_of, text.split())) + END_ID if text else END_ID
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {PIECES}")


def best_fit(
    lengths: np.ndarray, capacity: int, most_documents: int, most_attention: int, weights: tuple[float, float, float], rule: str,
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; longest pieces first.

    A piece asks for (tokens, one document, squared length), each as a share of its capacity. Among
    the open bins with room in all three, ``rule="norm"`` takes the one whose weighted residual after
    placing is smallest, ``rule="dot"`` the one whose weighted dot product of demand and residual is
    largest. A new bin is opened only if no open bin has room.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = int((lengths >= capacity).sum())
    bins[order[:full]] = np.arange(full)  # nothing fits beside them
    rest = order[full:]
    name = np.zeros(len(rest) + 1, np.int64)  # open bins: number and residuals
    tokens, count, attention = (np.zeros(len(rest) + 1, np.int64) for _ in range(3))
    opened, k = full, 0
    least = int(lengths[rest[-1]]) if len(rest) else 0
    w_t, w_d, w_a = weights[0] / capacity**2, weights[1] / most_documents**2, weights[2] / float(most_attention) ** 2
    for step, i in enumerate(rest.tolist()):
        size = int(lengths[i])
        cost = size * size
        if step % 512 == 511:  # bins in which not even the shortest piece fits are closed
            keep = np.flatnonzero((tokens[:k] >= least) & (count[:k] > 0) & (attention[:k] >= least * least))
            k = len(keep)
            for a in (name, tokens, count, attention):
                a[:k] = a[keep]
        fits = np.flatnonzero((tokens[:k] >= size) & (count[:k] >= 1) & (attention[:k] >= cost))
        if len(fits):
            t, d, a = tokens[fits], count[fits], attention[fits]
            if rule == "dot":
                score = w_t * size * t + w_d * d + w_a * float(cost) * a
                b = fits[int(np.argmax(score))]
            else:
                score = w_t * (t - size) ** 2 + w_d * (d - 1) ** 2 + w_a * (a - cost).astype(float) ** 2
                b = fits[int(np.argmin(score))]
        else:
            b = k
            name[b], tokens[b], count[b], attention[b] = opened, capacity, most_documents, most_attention
            opened += 1
            k += 1
        bins[i], offsets[i] = name[b], capacity - tokens[b]
        tokens[b] -= size
        count[b] -= 1
        attention[b] -= cost
    return bins, offsets


def pack_pieces(
    pieces: DataFrame, capacity: int = 2048, most_documents: int | None = None, most_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", group: int = GROUP,
) -> DataFrame:
    """``pieces`` (with a length of 1 to ``capacity``) and the columns sequence_id and offset.

    Every sequence keeps to ``capacity`` tokens, ``most_documents`` pieces and ``most_attention``, the
    sum of squared lengths; left out, the last two cannot bind. The written pieces are dealt by their
    place into groups of about ``group`` rows, each packed by one task from the lengths alone, so a
    task's work and memory do not grow with the input, whatever ids repeat. Only the last few
    sequences of a group stay unfilled.

    Cases: an empty table gives no rows; equal rows are packed as often as they occur.
    """
    most_documents = most_documents or capacity
    most_attention = most_attention or capacity * capacity
    pieces = cut(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))
    columns = pieces.columns

    def run(table: pa.Table) -> pa.Table:
        bins, offsets = best_fit(table["length"].to_numpy(), capacity, most_documents, most_attention, weights, rule)
        first = (table["_group"][0].as_py() if len(table) else 0) << 32
        out = table.select(columns)
        return out.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    # the place in the written table, so a repeated task deals its rows as before
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **limits,
) -> DataFrame:
    """Tokenise ``docs`` and pack all pieces: id, piece, start, length, ids_crc32, sequence_id, offset.

    Cases as in ``token_pieces`` and ``pack_pieces``; null and repeated ids are packed like others.
    """
    pieces = token_pieces(docs, vocabulary, capacity, id_col, text_col)
    return pack_pieces(pieces, capacity, **limits)
