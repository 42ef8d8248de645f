import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with names the operators use themselves."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    rows = [(1, "A first text of a few words here.", 1.0), (2, None, 2.0), (None, "A first text of a few words here.", None), (3, "", 3.0), (4, "   \n\t ", 4.0),
            (5, long, 5.0), (5, long, 5.0), (6, "word", 6.0), (7, "Word", 7.0), (None, None, None), (8, "é ü 漢字 🙂 \x01 \x00 end", 8.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score double").selectExpr("*", "1 AS id", "2 AS path", "'x' AS key", "3 AS h", "4 AS block", "5 AS n")
