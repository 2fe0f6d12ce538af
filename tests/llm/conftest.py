import pytest
from pyspark.sql import types as T

LONG = "word " * 40_000
ROWS = [
    (1, "The mit license applies. Mail joe.doe@example.com or 10.0.0.1 now.", "en"), (2, None, "en"), (3, "", "de"), (4, " \n\t ", None),
    (5, "éÉ 中文 \U0001f600 <|endoftext|> tail", "fr"), (6, LONG, "en"), (7, "x" * 5_000, "en"), (8, "one", "en"),
    (9, "same words here and there again", "en"), (9, "same words here and there again", "en"), (None, "no id at all", "en"), (10, "card 4041894974608795 +49 170 1234567", "de"),
]
EXTRA = ["key", "id", "h", "spans", "base", "ids", "n_tokens", "__word", "__maybe", "n_chars"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and columns whose names operators use themselves."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *[T.StructField(c, T.LongType()) for c in EXTRA]])
    return spark.createDataFrame([(*r, *range(len(EXTRA))) for r in ROWS], schema)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
