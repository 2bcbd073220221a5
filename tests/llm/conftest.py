import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) with nulls, empty and very long texts, repeated rows and clashing extra columns."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "1 as score", "'x' as label", "'y' as node", "2 as bucket", "3 as start", "'z' as key", "'h' as host")

    return make
