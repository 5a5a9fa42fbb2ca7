import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").persist()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and extra columns whose names operators use."""
    long = " ".join(f"w{i % 977} x{i % 13}" for i in range(60_000))
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (0, None, "en", "a", None), (1, "", None, "a", 0), (2, " \n\t ", "en", None, 4), (3, base, "en", "a", 3), (4, base, "en", "b", 3), (5, base.upper(), None, None, None),
        (6, long, "en", "a", 9), (7, long + " tail", "fr", "b", 9), (8, "word", "en", "a", 4), (8, "word", "en", "a", 4), (9, "été où çà\nété où çà", "fr", "b", 1), (10, "12 34 !!", "en", "a", 8),
        (None, base, "en", "a", 1), (11, "line one here is the same\nLINE one, here is the same!\n\nlast", "en", "a", 1),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("g", "id", "n", "rank", "component_id", "score", "line_no", "h", "key")}).persist()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
