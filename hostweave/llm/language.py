"""Languages of a document as a mixture, inferred by expectation-maximisation over n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CELLS = 1 << 15  # hashed byte trigrams
PER_LANGUAGE = 20_000  # labelled rows of one language that the model is fitted on, about
STEPS = 20
_LETTER = re.compile(r"[^\W\d_]")
# what a byte counts as: letters and all parts of longer characters themselves, the rest a space
_KIND = np.full(256, 32, np.uint32)
_KIND[97:123] = np.arange(97, 123)
_KIND[128:] = np.arange(128, 256)


def trigram_cells(text: str, cells: int = CELLS) -> np.ndarray:
    """The cell of each trigram of a text: lower-cased, with runs of other characters as one space."""
    kinds = _KIND[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    keep = kinds != 32
    keep[1:] |= kinds[:-1] != 32
    kinds = kinds[keep]
    mixed = (kinds[:-2] * np.uint32(0x9E3779B1)) ^ (kinds[1:-1] * np.uint32(0x85EBCA77)) ^ (kinds[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(7)).astype(np.int64) % cells


@dataclass(frozen=True)
class LanguageModel:
    """Likelihood of each trigram cell (rows) under each language (columns)."""

    languages: tuple[str, ...]
    likelihood: np.ndarray


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit trigram likelihoods on labelled rows.

    The bound is ``per_language``: of a language with more labelled rows, about so many are taken, by
    a hash of the id. Counting combines inside each task; the driver receives one number per language
    and cell. Rows with a null text, label or id are not learnt from; without any labelled row the
    model has no languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.ones((CELLS, 0)))
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / sizes[name]))).otherwise(share)
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), CELLS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[languages.index(lang)] += np.bincount(trigram_cells(text), minlength=CELLS)
        which, cell = np.nonzero(counts)
        if len(cell):
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(cell, pa.int32()), pa.array(counts[which, cell])], ["which", "cell", "n"])

    counted = drawn.select("text", "lang").mapInArrow(run, "which int, cell int, n bigint")
    total = np.full((CELLS, len(languages)), 0.05)
    for r in counted.groupBy("which", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["cell"], r["which"]] += r["n"]
    return LanguageModel(languages, total / total.sum(axis=0))


def infer_mixture(counts: np.ndarray, likelihood: np.ndarray, penalty: float = 1.0) -> tuple[list[int], np.ndarray, float]:
    """Language set, shares and score of one document.

    ``counts`` are those of its distinct cells, ``likelihood`` their rows of the model. Neighbouring
    trigrams share letters, so a document of n trigrams counts as n / 3 independent ones. A set of k
    languages is worth its log-likelihood less ``penalty * (k - 1) * log(n / 3) / 2``; sets are tried
    in order of the shares that expectation-maximisation gives over all languages. The score is the
    share of the first language, times its chance against the other single languages where the set
    has one member.
    """
    n = float(counts.sum())
    single = counts @ np.log(likelihood) / 3
    best = int(np.argmax(single))
    chance = np.exp(single - single[best])
    fee = penalty * np.log(max(n / 3, 2.0)) / 2

    def fit(columns: list[int]) -> tuple[np.ndarray, float]:
        part = likelihood[:, columns]
        shares = np.full(len(columns), 1 / len(columns))
        for _ in range(STEPS):
            each = part @ shares
            new = shares * ((counts / each) @ part) / n
            if np.abs(new - shares).max() < 1e-4:
                shares = new
                break
            shares = new
        return shares, float(counts @ np.log(part @ shares)) / 3

    chosen, shares, value = [best], np.ones(1), float(single[best])
    if likelihood.shape[1] > 1:
        all_shares, top = fit(list(range(likelihood.shape[1])))
        if top - fee > value:  # no set is likelier than all languages together
            order = np.argsort(-all_shares, kind="stable").tolist()
            for k in range(2, len(order) + 1):
                if top - fee * (k - 1) <= value:
                    break
                part, worth = fit(order[:k])
                if worth - fee * (k - 1) > value:
                    chosen, shares, value = order[:k], part, worth - fee * (k - 1)
    lead = int(np.argmax(shares))
    score = float(shares[lead]) if len(chosen) > 1 else float(1 / chance.sum())
    put = np.argsort(-shares, kind="stable")
    return [chosen[i] for i in put], shares[put], min(1.0, max(0.0, score))


def _identify(text: str | None, model: LanguageModel, penalty: float) -> tuple[str, float, list[str], list[float]]:
    if not text or not model.languages or not _LETTER.search(text):
        return "und", 0.0, [], []
    counts = np.bincount(trigram_cells(text), minlength=CELLS)
    cells = np.flatnonzero(counts)
    chosen, shares, value = infer_mixture(counts[cells].astype(float), model.likelihood[cells], penalty)
    return model.languages[chosen[0]], value, [model.languages[i] for i in chosen], shares.tolist()


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float, text_col: str = "text", penalty: float = 1.0) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least ``least_score``, with all their columns.

    Rows with ``und`` (see ``identify_languages``) always go. No shuffle.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_identify(t, model, penalty)[:2] for t in batch.column(0).field(place).to_pylist()]
            yield batch.filter(pa.array([name != "und" and score >= least_score for name, score in found], pa.bool_()))

    # one column of whole rows, as names with backticks cannot be passed one by one
    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, languages, shares (largest first).

    Cases: a text that is null, empty or without a letter is ``und`` with score 0, and so is every
    text if the model knows no language; ids go through unchanged, null and repeated ones too; an
    empty table gives no rows; other columns are not looked at. No shuffle; whole texts are read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "lang_pred", "score", "languages", "shares"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, found, parts = zip(*(_identify(t, model, penalty) for t in batch.column(1).to_pylist())) if batch.num_rows else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(found, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], names,
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, lang_pred string, score double, languages array<string>, shares array<double>",
    )
    return out.withColumnRenamed("id", id_col)
