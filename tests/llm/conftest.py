import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table with columns that clash with names used inside the operators."""

    def build(rows):
        rows = [(*r, None, None)[:3] if len(r) < 3 else r for r in rows]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        return df.selectExpr("*", "1 AS fp", "'x' AS label", "0 AS size", "0 AS row", "'k' AS key", "1 AS n", "0D AS score", "'en' AS lang", "0L AS n_chars")

    return build


#: Texts that every text operator must survive.
ODD = [(1, None, "a"), (2, "", "a"), (3, "   \t\n", None), (4, "word " * 20_000, "b"), (4, "word " * 20_000, "b"), (None, "one two three", "b"),
       (5, "Ünïcode   text ▁ with <|endoftext|> and \x0b tabs", "a"), (6, "one two three", "c")]
