import os

import pytest

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no data")
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies, and columns with names the operators use."""
    long_text = " ".join(f"w{i % 911}x" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma", "en", "s1"), (1, "alpha beta gamma", "en", "s1"), (2, None, "en", None),
        (3, "", None, "s2"), (4, " \t\n ", "fr", "s2"), (None, "alpha beta gamma", "en", "s1"), (5, long_text, "en", "s1"),
        (6, long_text, "fr", None), (7, "1234 567", None, "s3"), (8, "été à la ï 漢字 😀 ok", "fr", "s1"), (8, "another text", "en", "s1"),
        (9, "\x1c\x85\xa0 odd space", "en", "s2"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    extra = "1 AS _group, 2 AS size, 'x' AS words, 3 AS target, 'y' AS key, 4 AS _key, 5 AS _slot, array(1) AS ids"
    return spark.createDataFrame(rows, schema).selectExpr("*", *extra.split(", "))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
