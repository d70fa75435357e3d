import random

import pytest
from pyspark.sql import functions as F

from hostweave.llm.queries import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def corpus_settings(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, short, long and repeated texts, repeated and null
    ids, extra columns whose names the operators use inside, and names with blanks and backticks."""
    rng = random.Random(4)
    long_text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(5000)) for _ in range(20_000))
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "", 0), (4, " \t\n", "en", "a", 3),
        (5, "one two  three four five six\tseven eight nine ten", "en", "a", 5), (6, "short", "en", "b", 5), (6, "short", "en", "b", 5), (7, long_text, None, "b", 1),
        (8, long_text + " end", "en", "b", None), (None, "an id is missing here", "en", "c", 1), (None, None, None, "c", 1), (9, "one two three four five six seven eight nine ten", "en", "a", 5),
        (10, "123 456 !!", "en", "d", 5), (6, "another text under the same id", "en", "b", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "norm", "h", "head", "part", "row", "key", "set_id", "tokens", "bucket", "kind", "copies", "block", "edge", "task", "_group", "_place", "runs", "held_out", "weight"):
        df = df.withColumn(name, F.lit("clash"))
    df = df.withColumn("a `quoted` name", F.lit(1)).withColumn("nested", F.struct(F.lit(2).alias("with space"), F.lit("x").alias("with`tick")))
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
