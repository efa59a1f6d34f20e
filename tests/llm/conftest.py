import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns that clash with names that the operators use inside.
CLASHES = ["size", "class", "key", "slice", "node", "text_sha256", "target", "shard", "piece", "kept", "marks", "id", "h", "u", "copies", "copy", "own_id", "_id", "_copy", "_own_id", "rejected", "y", "place"]


@pytest.fixture
def documents(spark):
    """A maker of documents tables from (doc_id, text[, lang, source]) rows."""

    def make(rows, clash=False):
        whole = [(i, t, *(rest or (None, None)), len(t or "")) for i, t, *rest in rows]
        df = spark.createDataFrame(whole, DOCUMENTS)
        if clash:
            df = df.selectExpr("*", *(f"cast(null as string) as {c}" for c in CLASHES))
        return df

    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
