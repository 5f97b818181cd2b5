import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("doc", "digest", "tag", "fp", "score", "size", "copy", "best", "keep_id", "w", "__doc", "__tag", "__digest"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make
