"""What the tests of the training-data operators share."""

import pytest
from pyspark.sql.types import StructType

TABLES = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Build documents from (doc_id, text), (.., lang) or (.., source) rows, in two parts."""

    def build(rows, extra=None):
        full = [(*row, *("en", "a")[len(row) - 2 :])[:4] for row in rows]
        df = spark.createDataFrame(
            [(*row, len(row[1] or "")) for row in full], StructType.fromDDL(DOCS)
        ).repartition(2)
        return df.selectExpr("*", *(f"'x' AS {name}" for name in extra or ()))

    return build
