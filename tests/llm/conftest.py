import os
import sys

import pytest
from pyspark.sql import functions as F, types as T

sys.path.insert(0, os.path.dirname(__file__))

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# names that operators use for columns of their own
CLASHES = ("row", "words", "key", "size", "node", "hashes", "part", "id", "spans", "terms", "n_words", "band")


@pytest.fixture()
def documents(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, source); with ``clashes``, more columns."""

    def make(rows, clashes=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clashes:
            df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
        return df

    return make
