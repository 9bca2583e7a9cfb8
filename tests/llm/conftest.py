import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Missing cells, empty and very long texts, repeated rows, and extra columns with names used inside."""
    long_text = " ".join(f"word{i % 7000} alpha{i % 13}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g h i j k l m n o p q r s t u v", "x", 1), (1, "a b c d e f g h i j k l m n o p q r s t u v", "x", 1),
        (2, None, "x", 2), (3, "", None, 3), (None, "same line that is shared\nown line of none", "y", 4),
        (4, "Same line that is shared \nown line of four", "y", None), (5, long_text, "z", 5), (6, long_text + " end", "z", 6),
        (7, " \n\t ", "z", 7), (None, None, None, None), (8, "one two three", "é", 8), (9, "one two three", "é", 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lines int").selectExpr("*", "1 as _doc", "2 as _host", "3 as n_words")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
