import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs(spark):
    """Rows with a clashing extra column, from (doc_id, text[, lang]) tuples."""

    def make(rows):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n_tokens", T.StringType())])
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "clash", "clash") for r in rows], schema)

    return make
