import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]) rows, with extra columns whose names clash."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            names = [*df.columns, "Text", "digest", "kept", "size"]
            df = df.selectExpr("*", "'x' AS t2", "1 AS d2", "2 AS k2", "3 AS s2").toDF(*names)
        return df

    return make
