"""Token counts with a shortcut for words that are one token."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KEPT = 800_000  # cached words of a worker; the cache starts anew beyond that
LONG = 64  # longer words are not cached
# Printable ASCII and Latin-1 letters: NFC leaves them alone and lower case works letter by letter.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def load(path: str):
    """The tokenizer of a vocabulary file; one thread, since Spark runs the tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes in order for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


_LETTERS = byte_letters()


class PartEncoder:
    """Token numbers of pre-tokens that are plain, straight from the merges of the tokenizer's model."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def parts(self, word: str) -> list[str] | None:
        """The pre-tokens of a word without white space; None if only the tokenizer itself knows."""
        if word.isascii() and word.isalpha():
            return [word.lower()]
        if not _PLAIN.fullmatch(word) or ("<|" in word and any(s in word for s in self.special)):
            return None
        return _PARTS.findall(word.lower())

    def merge(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part if part.isascii() else "".join(map(_LETTERS.__getitem__, part.encode())))]

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def whole_tokens(encoder: PartEncoder) -> frozenset[str]:
    """The vocabulary strings that are proved to encode alone as exactly one token.

    Each string that ends a word is written out and encoded by the tokenizer itself; it is taken only
    if it is one pre-token and comes back as one token with the same number.
    """
    back = {c: b for b, c in enumerate(_LETTERS)}
    vocabulary = encoder.tokenizer.get_vocab(with_added_tokens=False)
    ends = [(n, bytes(map(back.__getitem__, s[:-4])).decode(errors="ignore")) for s, n in vocabulary.items() if s.endswith("</w>") and len(s) > 4]
    ends = [(n, s) for n, s in ends if _PLAIN.fullmatch(s) and s == s.lower() and _PARTS.findall(s) == [s]]
    found = encoder.tokenizer.encode_batch([s for _, s in ends], add_special_tokens=False)
    return frozenset(s for (n, s), e in zip(ends, found) if e.ids == [n])


class WordCounts(dict):
    """Number of tokens of a piece of text without ASCII white space, as UTF-8 bytes.

    The tokenizer never joins across white space, so these numbers add up to those of a text.
    """

    def __init__(self, path: str):
        super().__init__()
        self.encoder = PartEncoder(path)
        self.whole = whole_tokens(self.encoder)
        self.merged: dict[str, int] = {}

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        parts = self.encoder.parts(text)
        if parts is None:
            n = len(self.encoder.encode(text))
        else:
            n = 0
            for part in parts:
                n += 1 if part in self.whole else self._merge(part)
        if len(word) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n

    def _merge(self, part: str) -> int:
        n = self.merged.get(part)
        if n is None:
            n = len(self.encoder.merge(part))
            if len(part) <= LONG:
                if len(self.merged) >= KEPT // 2:
                    self.merged.clear()
                self.merged[part] = n
        return n


_counters: dict[str, WordCounts] = {}


def counter(path: str) -> WordCounts:
    """One counter for each worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = WordCounts(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a tokenizer file that lower-cases, drops white space and marks word
    ends; every machine must have it. A vocabulary string that encodes alone as one token is counted
    without the tokenizer; only the other pre-tokens are merged, once for each distinct one that a
    worker has in its bounded cache. Texts with special strings, or letters outside Latin-1, take the
    tokenizer's own path word by word. No shuffle; memory is that of one Arrow batch and the caches.

    Cases: a null text counts as empty and has 0 bytes and 0 tokens; ids, null or repeated, go
    through unchanged; an empty table gives no rows; other columns are not looked at.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).__getitem__
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            tokens = [sum(map(count, t.split())) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) if t else 0 for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
