import pytest

LONG = "word " * 60_000 + "the end"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names of results."""
    rows = [(1, "The mit license is short and the same words follow here again", "en", "a"), (2, None, "en", "a"),
            (3, "", None, None), (4, LONG, "en", "b"), (None, "a text without any id at all", None, "b"),
            (5, "same words for a copy of this text", "en", None), (6, "same words for a copy of this text", "en", "a"),
            (6, "same words for a copy of this text", "en", "a"), (7, " \t\n ", "fr", "c"), (8, "123 456", None, "c"),
            (None, None, None, None), (9, "ÄÖ ü İK ß x", "de", "a")]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F
    clashes = ["size", "score", "labels", "shard", "slot", "law", "n_words", "kept", "_place", "_seen", "_block", "_full",
               "predicted", "lang_pred", "_again", "_leak_id", "node", "id", "target", "copies"]
    return df.withColumns({c: F.lit("mine") for c in clashes})
