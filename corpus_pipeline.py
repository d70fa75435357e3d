"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostweave.llm.exact_dedup import drop_exact_duplicates
from hostweave.llm.language import keep_identified, learn_languages
from hostweave.llm.mixing import mix_documents
from hostweave.llm.ngram_join import ngram_jaccard_join
from hostweave.llm.packing import pack_documents
from hostweave.llm.queries import prepare, vocabulary
from hostweave.session import cut

LEAD = 0.1  # least lead of the first language, from 0 (all alike) to 1 (no other)
CAPACITY = 2048


def least_score(languages: int) -> float:
    """The score of a text whose first of so many languages has a lead of ``LEAD``; no lead is 1 / languages."""
    even = 1 / max(1, languages)
    return even + LEAD * (1 - even)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters, or without a leading language, go.

    A null or empty text has no letters. Each row is judged by its own text, so rows with one id or one
    text may stay together. Where no row has an id, a text and a language nothing is learned, and the
    result is empty, as it is for an empty table.
    """
    prepare(spark)
    model = learn_languages(docs)
    return keep_identified(docs, model, least_score(len(model.languages)))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id.

    A null text counts as empty, so of all null and blank texts one row stays. A row without an id
    gives way to one with an id; of equal ids one row stays. An empty table gives an empty one.
    """
    prepare(spark)
    return drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more the one with the smallest id.

    One row of each group stays: rows without an id come after all others, and of rows with the same
    id the first written one stays. Documents without words are linked with nothing and stay.
    """
    prepare(spark)
    row = "_row"
    while row in docs.columns:
        row += "_"
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col(row).alias("row")).alias("key")
    found = ngram_jaccard_join(docs.select(key, "text"), "key")
    kept = found.filter("key.row = component_id.row").select(F.col("key.row").alias(row))
    return docs.join(kept, row, "left_semi").drop(row)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at 95 % of the largest entropy or above, none more than four times, as many words as there are.

    Rows drawn more than once come out as equal rows. An empty table gives an empty one; see
    ``mix_documents`` for nulls.
    """
    prepare(spark)
    return mix_documents(docs, target_entropy=0.95, most_repeats=4.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens with their place in a sequence; a document drawn twice is packed twice.

    A null text is packed as an empty one, which is its end token alone. An empty table has no pieces.
    """
    prepare(spark)
    return pack_documents(docs, vocabulary(), CAPACITY)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

# Language models, components and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
