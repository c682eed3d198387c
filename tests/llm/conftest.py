import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        """documents of (doc_id, text) pairs; extra: with columns whose names clash."""
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(i, t, None, None, None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(data, schema)
        if extra:
            from pyspark.sql import functions as F
            for c in ("key", "size", "shard", "cell", "at", "start", "group", "hash", "score", "n", "rank", "id"):
                df = df.withColumn(c, F.lit("clash"))
        return df
    return make
