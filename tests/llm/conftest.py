import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, print string, first string, other string, score string, pos string, shard string, weight string, _topic string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def rows_of(docs):
    """docs as rows of DOCS; its other columns are named as operators name their own."""
    return [(i, t, "en", "web", None if t is None else len(t), "a", "b", "c", "d", "e", "f", "g", "h", "i") for i, t in docs]


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda docs: spark.createDataFrame(rows_of(docs), DOCS)


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls in any column, empty and blank texts, repeated rows, a doc_id with two texts, and a very long text."""
    rng = random.Random(1)
    long = prose(rng, 60_000, 5000)
    some = prose(rng, 80)
    spark_rows = [(1, some), (1, some), (2, None), (None, some), (None, None), (3, ""), (4, "  \n "), (5, long), (6, "one"), (7, some + " more"), (8, prose(rng, 90)), (8, prose(rng, 70)), (9, "..."), (10, "日本語の文章 ünï")]
    df = docs_of(spark_rows)
    from pyspark.sql import functions as F

    nulls = df.where("doc_id = 8").withColumns({c: F.lit(None).cast(t) for c, t in df.dtypes if c not in ("doc_id", "text")}).withColumn("doc_id", F.lit(11).cast("bigint"))
    return df.union(nulls)


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
